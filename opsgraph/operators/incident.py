"""Root-cause analysis of incidents (incident_id, uid, t_ns): the causal graph around a symptom, and what it says."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.stored import cut
from opsgraph.operators.traverse import managers, ownership_chain, related

SECOND_NS = 1_000_000_000
KEEP_WITHOUT_EVENTS = ["REFERENCES_SPEC", "SCHEDULED_ON", "USES_SERVICE_ACCOUNT", "GRANTS_TO", "BINDS_ROLE"]


def spine(edges: DataFrame, incidents: DataFrame) -> DataFrame:
    """(incident_id, uid, role, distance, step): owners, farthest first, each followed by its manager, up to the symptom."""
    chain = ownership_chain(edges, incidents.select("uid").distinct())
    own = incidents.join(chain, "uid").select("incident_id", F.col("owner").alias("node"), "distance", F.lit("owner").alias("role"))
    m = own.join(managers(edges, own.select(F.col("node").alias("uid")).distinct()).filter("manager is not null").withColumnRenamed("uid", "node"), "node")
    rows = own.union(m.select("incident_id", F.col("manager").alias("node"), "distance", F.lit("manager").alias("role")))
    rows = rows.groupBy("incident_id", "node").agg(F.max(F.struct("distance", "role")).alias("r")).select("incident_id", F.col("node").alias("uid"), "r.role", "r.distance")
    order = Window.partitionBy("incident_id").orderBy(F.desc("distance"), F.desc("role"), "uid")
    return cut(rows.withColumn("step", F.row_number().over(order)))  # all else is joined to it


def causal_graph(edges: DataFrame, resources: DataFrame, events: DataFrame, incidents: DataFrame, lookback_ns: int) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) around the incidents: SPINE and RELATED nodes, SPINE and ATTACHMENT edges."""
    line = spine(edges, incidents)
    at = line.join(incidents.select("incident_id", "t_ns"), "incident_id").select("incident_id", "uid", "t_ns")
    side = cut(related(edges, resources, at, lookback_ns))
    busy = side.join(events.select(F.col("uid").alias("related"), "ts_ns"), "related").join(incidents.select("incident_id", "t_ns"), "incident_id").filter(F.col("ts_ns").between(F.col("t_ns") - lookback_ns, F.col("t_ns"))).select("incident_id", "related").distinct().withColumn("busy", F.lit(True))
    side = side.join(busy, ["incident_id", "related"], "left").filter(F.coalesce("busy", F.lit(False)) | F.col("relation").isin(*KEEP_WITHOUT_EVENTS))
    side = cut(side)
    nodes = line.select("incident_id", "uid", F.lit("SPINE").alias("part"), "step").union(side.select("incident_id", F.col("related"), F.lit("RELATED"), F.lit(None).cast("int")).distinct())
    owns = edges.filter(F.col("type").isin("OWNS", "MANAGES")).select("type", "src", "dst")
    a, b = (line.select("incident_id", F.col("uid").alias(k), F.col("distance").alias(f"d_{k}")) for k in ("src", "dst"))
    along = owns.join(a, "src").join(b, ["incident_id", "dst"]).filter(((F.col("type") == "OWNS") & (F.col("d_src") == F.col("d_dst") + 1)) | (F.col("type") == "MANAGES"))
    out = along.select("incident_id", F.lit("SPINE").alias("part"), "type", "src", "dst").union(side.select("incident_id", F.lit("ATTACHMENT"), "relation", F.col("uid"), F.col("related")))
    return nodes, out.distinct()


def root_cause(line: DataFrame, events: DataFrame, incidents: DataFrame) -> DataFrame:
    """Per incident the first node of the spine that has an event at or before the failure, and its lag in ms."""
    rows = line.join(events.select("uid", "id", "ts_ns", "event_type", "config_changed"), "uid").join(incidents.select("incident_id", "t_ns"), "incident_id").filter("ts_ns <= t_ns")
    first = F.min(F.struct("step", (-F.col("ts_ns")).alias("late"), "id", "uid", "ts_ns", "event_type", "config_changed")).alias("r")
    return rows.groupBy("incident_id", "t_ns").agg(first).select("incident_id", "r.uid", "r.id", "r.step", F.floor((F.col("t_ns") - F.col("r.ts_ns")) / 1_000_000).alias("lag_ms"), causation(F.col("r.event_type"), F.col("r.config_changed")).alias("causation"))


def causation(event_type: Column, config_changed: Column) -> Column:
    return F.when(config_changed, "ConfigChange").when(event_type == "DELETE", "Deletion").when(event_type == "CREATE", "Creation").otherwise("StateChange")


def explanation(line: DataFrame, names: DataFrame) -> DataFrame:
    """Per incident the spine as text, root first; names: uid, kind, name."""
    rows = line.join(names.select("uid", "kind", "name"), "uid")
    said = F.array_sort(F.collect_list(F.struct("step", F.concat_ws("/", "kind", "name").alias("text"))))
    return rows.groupBy("incident_id").agg(said.alias("s")).select("incident_id", F.array_join(F.col("s.text"), " -> ").alias("explanation"))


def symptom_type(issues: Column, message: Column, status: Column) -> Column:
    m = F.lower(message)
    return (
        F.when(F.array_contains(issues, "OOMKilled"), "OOMKilled")
        .when(F.array_contains(issues, "CrashLoopBackOff"), "CrashLoop")
        .when(F.arrays_overlap(issues, F.array(F.lit("ImagePullBackOff"), F.lit("ErrImagePull"))), "ImagePullError")
        .when(m.rlike("imagepull|pull image"), "ImagePullError")
        .when(m.rlike("crashloop"), "CrashLoop")
        .when(m.rlike("unschedulable|insufficient"), "SchedulingFailure")
        .when(m.rlike("timeout|deadline"), "Timeout")
        .when(status == "Error", "Error")
        .when(status == "Warning", "Degraded")
        .when(status == "Terminating", "Terminating")
        .otherwise("Unknown")
    )


def confidence(spec_changed: Column, lag_ms: Column, relation: Column, error_match: Column, spine_length: Column) -> Column:
    """(score, rationale) from the five weighted factors."""
    factors = [
        (0.35, F.when(spec_changed, 1.0).otherwise(0.0), "spec changed"),
        (0.30, F.greatest(F.lit(0.0), 1 - lag_ms / 600_000), "close in time"),
        (0.20, F.when(relation == "OWNS", 1.0).when(relation == "MANAGES", 0.8).when(relation == "TRIGGERED_BY", 0.7).otherwise(0.5), "relation"),
        (0.05, F.when(error_match, 1.0).otherwise(0.0), "error matches"),
        (0.10, F.least(F.lit(1.0), spine_length / 3), "chain is whole"),
    ]
    score = sum((w * f for w, f, _ in factors), F.lit(0.0))
    why = F.array_join(F.array_compact(F.array(*[F.when(f > 0, F.lit(text)) for _, f, text in factors])), ", ")
    return F.struct(F.round(score, 6).alias("score"), why.alias("rationale"))


def evidence(edges_of: DataFrame, causes: DataFrame, most: int = 5) -> DataFrame:
    """Per incident up to `most` pieces: managers, nearness in time and ownership, from graph edges (incident_id, part, type, src, dst) and roots (incident_id, lag_ms)."""
    a = edges_of.filter("part = 'SPINE'").select("incident_id", F.when(F.col("type") == "MANAGES", "MANAGES").otherwise("STRUCTURAL").alias("kind"), F.concat_ws(" ", "src", "type", "dst").alias("text"))
    b = causes.select("incident_id", F.lit("TEMPORAL").alias("kind"), F.concat(F.col("lag_ms"), F.lit(" ms before the failure")).alias("text"))
    order = Window.partitionBy("incident_id").orderBy(F.when(F.col("kind") == "MANAGES", 0).when(F.col("kind") == "TEMPORAL", 1).otherwise(2), "text")
    return a.union(b).withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= most)


def excluded(events: DataFrame, roots: DataFrame, incidents: DataFrame, newest: int = 5, shown: int = 3) -> DataFrame:
    """The newest config changes of the incident's namespace before the failure that aren't the root; incidents: with namespace."""
    rows = incidents.select("incident_id", "namespace", "t_ns").join(events.filter("config_changed").select("uid", "id", "namespace", "ts_ns"), "namespace").filter("ts_ns <= t_ns")
    order = Window.partitionBy("incident_id").orderBy(F.desc("ts_ns"), F.desc("id"))
    top = rows.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= newest)
    rest = top.join(roots.select("incident_id", F.col("uid")), ["incident_id", "uid"], "left_anti")
    return rest.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= shown)


def with_fallback(incidents: DataFrame, roots: DataFrame, graph_nodes: DataFrame) -> DataFrame:
    """Every incident once: its root; else the symptom, with quality degraded if there is a graph, symptom_only if not."""
    has = graph_nodes.select("incident_id").distinct().withColumn("has", F.lit(True))
    rows = incidents.join(roots.withColumnRenamed("uid", "root"), "incident_id", "left").join(has, "incident_id", "left")
    quality = F.when(F.col("root").isNotNull(), "full").when(F.col("has"), "degraded").otherwise("symptom_only")
    return rows.select("incident_id", "uid", F.coalesce("root", "uid").alias("root"), F.coalesce("causation", F.lit("Unknown")).alias("causation"), quality.alias("quality"))
