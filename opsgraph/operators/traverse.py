"""Walks over the resource graph, for many starting points at once.

Edges are (type, src, dst). A walk is a loop of joins on a frontier, one per hop, with a bound on the hops; it leaves out
what it has seen, or paths carry what they have visited, so cycles end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.stored import cut, stored

SECOND_NS = 1_000_000_000


def neighbours(edges: DataFrame, uids: DataFrame, resources: DataFrame | None = None) -> DataFrame:
    """(uid, direction, type, other) of all edges at the given uids; with resources, only those whose other end is one."""
    out = edges.join(uids.select(F.col("uid").alias("src")), "src").select(F.col("src").alias("uid"), F.lit("out").alias("direction"), "type", F.col("dst").alias("other"))
    into = edges.join(uids.select(F.col("uid").alias("dst")), "dst").select(F.col("dst").alias("uid"), F.lit("in").alias("direction"), "type", F.col("src").alias("other"))
    rows = out.union(into)
    return rows if resources is None else rows.join(resources.select(F.col("uid").alias("other")), "other", "left_semi").select("uid", "direction", "type", "other")


def events_of(events: DataFrame, uid: str, start_ns: int, end_ns: int) -> DataFrame:
    return events.filter((F.col("uid") == uid) & F.col("ts_ns").between(start_ns, end_ns)).orderBy("ts_ns", "id")


def walk(arcs: DataFrame, starts: DataFrame, hops: int) -> DataFrame:
    """(uid, other, distance): what each start (uid) reaches over arcs (at, next) in at most `hops`, at its least distance; itself at 0.

    A hop joins the resources that the last one found new. The arcs are stored once, and so is every hop but the last, so
    each resource is expanded once and nothing is computed again.
    """
    arcs = arcs.select("at", "next").distinct()
    arcs = stored(arcs, "arcs") if hops > 1 else arcs
    seen = front = starts.select("uid", F.col("uid").alias("other"), F.lit(0).alias("distance")).distinct()
    for d in range(1, hops + 1):
        step = front.join(arcs, F.col("other") == F.col("at")).select("uid", F.col("next").alias("other")).distinct()
        front = step.join(seen, ["uid", "other"], "left_anti").withColumn("distance", F.lit(d))
        front = stored(front, "hop") if d < hops else front
        seen = seen.union(front)
    return seen


def ownership_chain(edges: DataFrame, starts: DataFrame, hops: int = 3) -> DataFrame:
    """(uid, owner, distance): owners up to `hops` away, each at its least distance; the start itself at 0."""
    owns = edges.filter("type = 'OWNS'").select(F.col("dst").alias("at"), F.col("src").alias("next"))
    return walk(owns, starts, hops).withColumnRenamed("other", "owner")


def managers(edges: DataFrame, uids: DataFrame, least: float = 0.5) -> DataFrame:
    """(uid, manager, confidence) of uids that something manages; null manager for the others."""
    m = edges.filter((F.col("type") == "MANAGES") & (F.col("confidence") >= least)).select(F.col("dst").alias("uid"), F.col("src").alias("manager"), "confidence")
    return uids.select("uid").join(m, "uid", "left")


def blast_radius(edges: DataFrame, starts: DataFrame, events: DataFrame, window_ns: int, types: list[str] | None = None, hops: int = 3) -> DataFrame:
    """(uid, affected, distance, n_events): what is 1 to `hops` outgoing edges away and went into Warning or Error in (t, t + window).

    starts: (uid, t_ns).
    """
    e = edges.filter(F.col("type").isin(*types)) if types else edges
    reached = walk(e.select(F.col("src").alias("at"), F.col("dst").alias("next")), starts, hops).filter("distance > 0")
    near = starts.select("uid", "t_ns").join(reached.withColumnRenamed("other", "affected"), "uid")
    bad = events.filter(F.col("status").isin("Warning", "Error")).select(F.col("uid").alias("affected"), "ts_ns")
    hit = near.join(bad, "affected").filter((F.col("ts_ns") > F.col("t_ns")) & (F.col("ts_ns") < F.col("t_ns") + window_ns))
    return hit.groupBy("uid", "affected", "distance").agg(F.count("*").alias("n_events"))


def find_root_cause(causes: DataFrame, edges: DataFrame, events: DataFrame, incidents: DataFrame, depth: int = 3, least: float = 0.5, n: int = 10) -> DataFrame:
    """Per incident (incident_id, uid, t_ns) the likely root events: of trigger paths, else of managers of owners, else the failure.

    causes: (src effect, dst cause, confidence). Events carry impact.
    """
    e = events.select("id", "uid", "ts_ns", "impact")
    near = incidents.join(e, "uid").withColumn("gap", F.abs(F.col("ts_ns") - F.col("t_ns"))).filter(F.col("gap") <= 300 * SECOND_NS)
    failure = cut(near.groupBy("incident_id", "uid", "t_ns").agg(F.min(F.struct("gap", "id")).alias("f")).select("incident_id", "uid", "t_ns", F.col("f.id").alias("failure")))
    strong = causes.filter(F.col("confidence") >= least).select(F.col("src").alias("at"), F.col("dst").alias("next"))
    front = failure.select("incident_id", F.col("failure").alias("id"), F.array("failure").alias("path"))
    found = None
    for d in range(1, depth + 1):
        front = front.join(strong, F.col("id") == F.col("at")).filter(~F.array_contains("path", F.col("next")))
        front = cut(front.select("incident_id", F.col("next").alias("id"), F.concat("path", F.array("next")).alias("path")))
        step = front.select("incident_id", "id", F.lit(d).alias("distance"))
        found = step if found is None else found.union(step)
    triggered = found.groupBy("incident_id", "id").agg(F.min("distance").alias("distance")).withColumn("how", F.lit(1))
    chain = ownership_chain(edges, incidents.select("uid").distinct()).filter("distance > 0").select("uid", "owner")
    manages = edges.filter("type = 'MANAGES'").select(F.col("dst").alias("owner"), F.col("src").alias("manager"))
    upper = chain.join(manages, "owner").select("uid", F.col("manager").alias("m")).distinct()
    recent = failure.join(upper, "uid").join(e.select(F.col("uid").alias("m"), "id", "ts_ns"), "m").filter((F.col("ts_ns") <= F.col("t_ns")) & (F.col("ts_ns") >= F.col("t_ns") - 600 * SECOND_NS))
    managed = recent.select("incident_id", "id", F.lit(0).alias("distance"), F.lit(2).alias("how"))
    itself = failure.select("incident_id", F.col("failure").alias("id"), F.lit(0).alias("distance"), F.lit(3).alias("how"))
    every = cut(triggered.union(managed).union(itself))
    best = every.groupBy("incident_id").agg(F.min("how").alias("least_how"))
    rows = every.join(best, "incident_id").filter("how = least_how").join(e, "id")
    nth = F.row_number().over(Window.partitionBy("incident_id").orderBy(F.desc("impact"), F.desc("ts_ns"), "id"))
    method = F.element_at(F.array(F.lit("trigger"), F.lit("manager"), F.lit("itself")), F.col("how"))
    return rows.withColumn("nth", nth).filter(F.col("nth") <= n).select("incident_id", "nth", "id", "uid", "ts_ns", "impact", "distance", method.alias("method"))


def related(edges: DataFrame, resources: DataFrame, incidents: DataFrame, lookback_ns: int) -> DataFrame:
    """(incident_id, uid, related, relation): what incident resources refer to, run on, use and are selected by, and what lies behind it.

    Nodes count if they live, or were deleted inside the lookback before the incident's time.
    """
    e = edges.select("type", "src", "dst")
    at = incidents.select("incident_id", "uid", "t_ns")
    fwd = at.join(e.filter(F.col("type").isin("REFERENCES_SPEC", "SCHEDULED_ON", "USES_SERVICE_ACCOUNT")), F.col("uid") == F.col("src")).select("incident_id", "uid", "t_ns", F.col("dst").alias("related"), F.col("type").alias("relation"))
    kinds = resources.select(F.col("uid").alias("k_uid"), "kind")
    into = at.join(e.filter("type = 'SELECTS'"), F.col("uid") == F.col("dst")).join(kinds, F.col("src") == F.col("k_uid")).filter(F.col("kind").isin("Service", "NetworkPolicy"))
    selected = into.select("incident_id", "uid", "t_ns", F.col("src").alias("related"), F.lit("SELECTS").alias("relation"))
    ingress = selected.join(e.filter("type = 'REFERENCES_SPEC'"), F.col("related") == F.col("dst")).join(kinds.filter("kind = 'Ingress'"), F.col("src") == F.col("k_uid")).select("incident_id", "uid", "t_ns", F.col("src").alias("related"), F.lit("INGRESS_REF").alias("relation"))
    accounts = fwd.filter("relation = 'USES_SERVICE_ACCOUNT'").select("incident_id", "uid", "t_ns", F.col("related").alias("account"))
    bound = accounts.join(e.filter("type = 'GRANTS_TO'"), F.col("account") == F.col("dst")).select("incident_id", "uid", "t_ns", F.col("src").alias("related"), F.lit("GRANTS_TO").alias("relation"))
    roles = bound.join(e.filter("type = 'BINDS_ROLE'"), F.col("related") == F.col("src")).select("incident_id", "uid", "t_ns", F.col("dst").alias("related"), F.lit("BINDS_ROLE").alias("relation"))
    rows = fwd.union(selected).union(ingress).union(bound).union(roles)
    r = resources.select(F.col("uid").alias("related"), "deleted", "deleted_ns")
    seen = rows.join(r, "related").filter(~F.col("deleted") | F.col("deleted_ns").between(F.col("t_ns") - lookback_ns, F.col("t_ns")))
    return seen.select("incident_id", "uid", "related", "relation").distinct()


def reachable(edges: DataFrame, starts: DataFrame, depth: int, directed: bool = False) -> DataFrame:
    """(uid, other, distance) of all resources within `depth` edges, in either direction unless directed."""
    e = edges.select(F.col("src").alias("at"), F.col("dst").alias("next"))
    return walk(e if directed else e.union(e.select("next", "at")), starts, depth)


def induced_subgraph(edges: DataFrame, uids: DataFrame) -> DataFrame:
    """The edges both of whose ends are among the uids."""
    return edges.join(uids.select(F.col("uid").alias("src")), "src", "left_semi").join(uids.select(F.col("uid").alias("dst")), "dst", "left_semi")


def live(column: Column) -> Column:
    return ~F.coalesce(column, F.lit(False))
