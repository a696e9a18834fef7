"""Causal paths: from each incident's symptom upstream over the graph to what most likely started it.

All incidents of a job walk together, one join a depth. What walks are labels, one for a way from a symptom to a node:
where it has been, its cause edges, its worst severity and its earliest anomaly. Of the ways that meet at a node only
those are kept from which a best path can still come (see `worth_keeping`), so at most `most_labels` walk on for each
incident and node however many ways there are. Of the paths that end at a root the best one is kept.

`causal_paths` lists a path for each incident and root, which are as many as the incidents below a hub times the causes
right above it. `top_paths` gives the best of them without listing all: incidents whose labels at a hub are alike have the
same causes there, with the same scores, so what ends at a hub's own causes is worked out once for each such class.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import comb

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.stored import discard, stored
from opsgraph.operators import rules
from opsgraph.operators.traverse import reachable

SECOND_NS = 1_000_000_000
#: Lags from which a lead over the failure fits best, no longer fits best, and gets no worse (s); least score.
BEST_FROM_S, BEST_TO_S, WORST_FROM_S, LEAST = 30, 300, 300 + 400, 0.6
#: What a message of a failed image pull says if the image, the login or the network is to blame.
IMAGE_MISSING = "manifest unknown|not found|does not exist|name unknown"
LOGIN_FAILED = "unauthorized|forbidden|authentication required|access denied|no basic auth credentials|x509"
NO_NETWORK = "i/o timeout|context deadline exceeded|connection refused|no such host|network unreachable"
PULL = ["ImagePullBackOff", "ErrImagePull"]
PRESSURE = ["DiskPressure", "NodeDiskPressure", "NodeMemoryPressure", "MemoryPressure", "NodePIDPressure", "PIDPressure", "NodeNetworkPressure", "NodeNotReady"]
FAILURE_REASONS = "(?i)Failed|BackOff|ErrImagePull|Evicted|OOMKilled"


def cut(df: DataFrame) -> DataFrame:
    """df, stored with its paths and traits in columns, which are small there."""
    return stored(df, "causal")


def upstream_edges(edges: DataFrame) -> DataFrame:
    """(at, up, edge, cause): the direction from effect to cause of each edge; cause: the edge can introduce one."""
    cause = F.col("type").isin(*rules.CAUSE_EDGES)
    # A manager and a grant act on what they point at; other references act on what holds them; matter flows from src.
    reverse = F.col("type").isin("MANAGES", "GRANTS_TO") | ~cause
    return edges.select(F.when(reverse, F.col("dst")).otherwise(F.col("src")).alias("at"), F.when(reverse, F.col("src")).otherwise(F.col("dst")).alias("up"), F.col("type").alias("edge"), cause.alias("cause")).distinct()


def severity_score(severity: Column) -> Column:
    return F.when(severity == "critical", 1.0).when(severity == "high", 0.75).when(severity == "medium", 0.5).otherwise(0.25)


def pull_failure(summary: Column) -> Column:
    """What a failed image pull is by its message: ImageNotFound, RegistryAuthFailed, ImagePullTimeout, or ImagePullBackOff, which has its cause elsewhere."""
    said = F.lower(F.coalesce(summary, F.lit("")))
    return F.when(said.rlike(IMAGE_MISSING), "ImageNotFound").when(said.rlike(LOGIN_FAILED), "RegistryAuthFailed").when(said.rlike(NO_NETWORK), "ImagePullTimeout").otherwise("ImagePullBackOff")


def node_context(anomalies: DataFrame) -> DataFrame:
    """Per node (uid, and incident_id if the anomalies have it) what its anomalies say about causes.

    anomalies: uid, category, type, severity, ts_ns, and summary if known. The times are those of the first anomaly that
    can be a cause: whether it is one depends on the incident's failure, and for evictions and image pulls on what else
    happened around it. `soft` ones (creations) are causes with others behind them.
    """
    type_, ts = F.col("type"), F.col("ts_ns")
    cause = (F.coalesce(F.col("category") == "Change", F.lit(False))) | type_.isin(*rules.CAUSE_INTRODUCING)
    soft = type_.isin(*rules.INTERMEDIATE)
    pull = type_.isin(*PULL)
    pulled = pull & pull_failure(F.col("summary") if "summary" in anomalies.columns else F.lit("")).isin(*rules.CAUSE_INTRODUCING)
    own = cause & ~type_.isin(*rules.DERIVED) & ~pull & (type_ != "Evicted")
    first = lambda which, name: F.min(F.when(which, ts)).alias(name)
    keys = [c for c in ("incident_id", "uid") if c in anomalies.columns]
    return anomalies.groupBy(*keys).agg(
        first(cause, "any_cause_ns"),
        first(own, "cause_ns"),
        first(own & ~soft, "hard_ns"),
        first(type_ == "Evicted", "evicted_ns"),
        first(pulled, "pulled_ns"),
        (F.count_if(cause) == 0).alias("only_derived"),
        ((F.count_if(cause) > 0) & (F.count_if(cause & ~soft) == 0)).alias("only_soft"),
        F.count_if(type_.isin(*rules.DEFINITIVE)).cast("boolean").alias("definitive"),
        F.min("ts_ns").alias("node_first_ns"),
        F.max(severity_score(F.col("severity"))).alias("node_severity"),
    )


def first_failures(incidents: DataFrame, anomalies: DataFrame) -> DataFrame:
    """incidents with first_failure_ns: the symptom's earliest anomaly, else the incident's time."""
    keys = [c for c in ("incident_id", "uid") if c in anomalies.columns]
    first = anomalies.groupBy(*keys).agg(F.min("ts_ns").alias("first"))
    return incidents.join(first, keys, "left").select(*incidents.columns, F.coalesce("first", "t_ns").alias("first_failure_ns"))


def surroundings(edges: DataFrame, anomalies: DataFrame, incidents: DataFrame, depth: int) -> DataFrame:
    """(incident_id, pressure, image_changed): is a node under pressure, or was an image changed, in what the incident's walk can reach?

    Only evictions and image pulls ask for it; without any, nothing is walked.
    """
    if not anomalies.filter(F.col("type").isin("Evicted", *PULL)).limit(1).count():
        return incidents.select("incident_id", F.lit(False).alias("pressure"), F.lit(False).alias("image_changed")).distinct()
    told = anomalies.select(*[c for c in ("incident_id", "uid") if c in anomalies.columns], F.col("type").isin(*PRESSURE).alias("pressure"), (F.col("type") == "ImageChanged").alias("image_changed")).filter("pressure or image_changed")
    if "incident_id" in anomalies.columns:
        near = told
    else:
        arcs = upstream_edges(edges).select(F.col("at").alias("src"), F.col("up").alias("dst"))
        reached = reachable(arcs, incidents.select("uid").distinct(), depth, directed=True)
        near = incidents.select("incident_id", "uid").join(reached, "uid").select("incident_id", F.col("other").alias("uid")).join(told.distinct(), "uid")
    found = near.groupBy("incident_id").agg(F.bool_or("pressure").alias("pressure"), F.bool_or("image_changed").alias("image_changed"))
    known = incidents.select("incident_id").distinct().join(found, "incident_id", "left")
    return known.select("incident_id", F.coalesce("pressure", F.lit(False)).alias("pressure"), F.coalesce("image_changed", F.lit(False)).alias("image_changed"))


def temporal_score(lag_ns: Column) -> Column:
    """How well the lead of the first anomaly over the failure fits: little below 5 s, best from 30 s to 5 min, then slowly less, 0.6 at least."""
    s = lag_ns / SECOND_NS
    return F.when(s < 0, 0.0).when(s < 5, 0.3 + 0.2 * s / 5).when(s < BEST_FROM_S, 0.5 + 0.5 * (s - 5) / 25).when(s <= BEST_TO_S, 1.0).otherwise(F.greatest(F.lit(LEAST), 1.0 - 0.3 * (s - BEST_TO_S) / 300))


def confidence(lag_ns: Column, hops: Column, severity: Column, kind: Column, definitive: Column) -> Column:
    """Time .40, distance .35 (full for a definitive root), severity .25, and what kind of root it is; 1 at most."""
    distance = F.when(definitive, 1.0).otherwise(F.greatest(F.lit(0.0), 1.0 - hops / 5))
    boost = F.when(kind.isin(*rules.INTENT_KINDS), 0.05).otherwise(0.0) + F.when(kind.isin(*rules.GITOPS_KINDS), 0.05).otherwise(0.0) + F.when(definitive, 0.15).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), 0.40 * temporal_score(lag_ns) + 0.35 * distance + 0.25 * severity + boost), 9)


# --- labels ------------------------------------------------------------------------------------------------------


def most_labels(depth: int, at: int) -> int:
    """How many labels of an incident can be at a node at most, `at` steps from the symptom, in walks of `depth` steps: 4 severities, `at` + 1 numbers of cause edges and 4 ranges of time, with so many ways each."""
    return 16 * (at + 1) * comb(depth - 1, at - 1) if at < depth else 0


def worth_keeping(kept: list[frozenset], way: frozenset, left: int) -> bool:
    """Can a walk of at most `left` more nodes go on from this way, but from none of the better ones that are kept?

    It can if there are `left` nodes, none on this way, of which every better way has one. So for every continuation the
    best way that it can follow is kept; and no more than binomial(nodes on the way + left, left) are.
    """
    for other in kept:
        return left > 0 and any(worth_keeping([k for k in kept if node not in k], way, left - 1) for node in other - way)
    return True


def _pruned(labels: DataFrame, left: Column, shuffled: bool) -> DataFrame:
    """The labels worth keeping of each incident, node and class; of those in a task only unless shuffled."""
    rows = labels.withColumn("left", left)
    rows = rows.repartition("incident_id", "at") if shuffled else rows
    order = ["incident_id", "at", "hops", "severity", "age", "better", "path"]
    schema = rows.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, kept = None, []
        for b in batches:
            own = zip(*(b.column(c).to_pylist() for c in order[:5]), strict=True)
            mask = []
            for k, way, more in zip(own, b.column("between").to_pylist(), b.column("left").to_pylist(), strict=True):
                if k != key:
                    key, kept = k, []
                way = frozenset(way)
                mask.append(worth_keeping(kept, way, more))
                if mask[-1]:
                    kept.append(way)
            yield b.filter(pa.array(mask, pa.bool_()))

    return rows.sortWithinPartitions(*order).mapInArrow(run, schema).drop("left")


def _labelled(rows: DataFrame) -> DataFrame:
    """Labels (incident_id, failure_ns, pressure, image_changed, most, at, hops, severity, first_ns, path) with their class and order.

    Within a class (cause edges, severity, age) the order says which of two ways is at least as good whatever follows. A
    lead that fits best, or doesn't yet, gets better as it grows; one beyond it gets worse; one at the least score, and
    one after the failure, are as good as others, and the earlier anomaly is shown.
    """
    s = (F.col("failure_ns") - F.col("first_ns")) / SECOND_NS
    age = F.when(F.col("first_ns").isNull() | (s < 0), 0).when(s <= BEST_TO_S, 1).when(s < WORST_FROM_S, 2).otherwise(3)
    never = F.lit(2**63 - 1)
    between = F.transform(F.slice("path", 2, F.greatest(F.size("path") - 2, F.lit(0))), lambda x: x["uid"])
    return rows.withColumn("age", age).withColumn("better", F.when(F.col("age") == 2, -F.col("first_ns")).otherwise(F.coalesce("first_ns", never))).withColumn("between", between)


def _step(uid: Column, kind: Column, edge: Column, edge_kind: Column) -> Column:
    return F.struct(uid.alias("uid"), kind.alias("kind"), edge.alias("edge"), edge_kind.alias("edge_kind"))


def causal_paths(edges: DataFrame, resources: DataFrame, anomalies: DataFrame, incidents: DataFrame, depth: int = 5) -> DataFrame:
    """The best path of each incident and root: incident_id, symptom, root, root_kind, path (symptom first), first_ns, first_failure_ns, hops, severity, definitive, confidence.

    edges: type, src, dst; resources: uid, kind; anomalies: see node_context, of an incident each if they have incident_id;
    incidents: incident_id, uid, t_ns. A node is a root if it has a cause at or before the symptom's first failure. A walk
    ends at one, unless it only materializes the symptom, is managed, refers to something, or has nothing but creations;
    it goes on over materializing edges and nodes without causes of their own, but not into nodes with nothing upstream that
    are no causes, nor beyond them, so that a hub's harmless neighbours aren't walked. Best is the longest path, then the most
    confident, then that with the earliest anomaly. An incident whose symptom is a Service without ready endpoints walks
    from the pods that it selects (`service_starts`).
    """
    best, incidents, _, _ = _walked(edges, resources, anomalies, incidents, depth, classed=False)
    return best.join(incidents.select("incident_id", F.col("uid").alias("symptom")), "incident_id")


def _judged(step: DataFrame) -> DataFrame:
    """Labels on arcs into nodes, after `d` steps: what they are there (root_hops, hops, severity, first_ns), with `emit`, do they end there, and `go_on`."""
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    before = lambda t: F.coalesce(t <= F.col("failure_ns"), F.lit(False))
    around_it = before(F.when(~F.col("pressure"), F.col("evicted_ns"))) | before(F.when(~F.col("image_changed"), F.col("pulled_ns")))
    hard, any_ = before(F.col("hard_ns")) | around_it, before(F.col("cause_ns")) | around_it
    counts = F.col("cause") | (F.col("d") > 1)  # a materializing edge right at the symptom introduces nothing
    stop = hard & counts & ~yes("managed")
    go_on = F.when(stop, yes("refers")).otherwise(~F.col("cause") | F.coalesce("only_derived", F.lit(True)) | yes("only_soft"))
    top = F.col("managed").isNull() & go_on & before(F.col("any_cause_ns")) & (F.col("most") > F.col("d"))  # nothing upstream
    emit = stop | (any_ & ~hard & counts) | top
    return step.withColumns({
        "emit": emit, "go_on": go_on & (F.col("most") > F.col("d")) & F.col("managed").isNotNull(), "root_hops": F.col("hops"), "hops": F.col("hops") + F.col("cause").cast("int"),
        "severity": F.greatest("severity", F.coalesce("node_severity", F.lit(0.25))), "first_ns": F.least("first_ns", "node_first_ns"), "definitive": yes("definitive"),
    })


def _score() -> Column:
    return confidence(F.col("failure_ns") - F.col("first_ns"), F.col("root_hops"), F.col("severity"), F.col("kind"), F.col("definitive"))


def _edge_kind() -> Column:
    return F.when(F.col("cause"), "cause").otherwise("materialization")


#: What a label's ends at a hub's own causes depend on, besides the hub.
STATE = ["d", "failure_ns", "pressure", "image_changed", "most", "steps", "hops", "severity", "first_ns"]


def _walked(edges: DataFrame, resources: DataFrame, anomalies: DataFrame, incidents: DataFrame, depth: int, classed: bool) -> tuple[DataFrame, DataFrame, DataFrame | None, DataFrame | None]:
    """(best path of each incident and root, incidents with their first failure, labels, leaves).

    classed: arcs into causes with nothing upstream and one node below aren't walked but given as leaves, with the labels
    that are at the node below: (incident_id, at, STATE, path). Such a cause is on no label's path, so whether a label ends
    there hangs on its state only. Incidents of services, and anomalies of an incident each, are walked in full.
    """
    depth = max(1, min(depth, 10))
    incidents = first_failures(incidents, anomalies)
    per_incident = "incident_id" in anomalies.columns
    context = node_context(anomalies)
    kinds = resources.select("uid", "kind")
    up = cut(upstream_edges(edges))
    traits = up.groupBy("at").agg(F.bool_or(F.col("edge") == "MANAGES").alias("managed"), F.bool_or(F.col("edge") == "REFERENCES_SPEC").alias("refers")).withColumnRenamed("at", "uid")
    nodes = kinds.join(traits, "uid", "left")
    nodes = cut(nodes if per_incident else nodes.join(context, "uid", "left"))
    if per_incident:
        context = cut(context)
    # A node with nothing upstream that is no cause in any case neither ends a walk nor lets it go on.
    may_end = context.filter(F.coalesce("any_cause_ns", "cause_ns", "evicted_ns", "pulled_ns").isNotNull()).select("uid").distinct().withColumn("may_end", F.lit(True))
    useful = nodes.join(may_end, "uid", "left").filter(F.col("managed").isNotNull() | F.col("may_end")).drop("may_end")
    arcs, leaves = up.join(useful.withColumnRenamed("uid", "up"), "up"), None
    if classed and not per_incident:
        # Services may be the first node of a path.
        tops = arcs.filter("managed is null and kind != 'Service'")
        one = tops.groupBy("up").agg(F.min("at").alias("low"), F.max("at").alias("high")).filter("low = high").select("up")
        leaves = cut(tops.join(one, "up", "left_semi"))
        arcs = arcs.join(leaves.select("up").distinct(), "up", "left_anti")
    arcs = cut(arcs)
    discard(up)
    around = surroundings(edges, anomalies, incidents, depth)
    starts, done = service_starts(edges, nodes, anomalies, incidents)
    know = (lambda df: df.join(context, ["incident_id", "uid"], "left")) if per_incident else (lambda df: df)
    seeds = starts.join(around, "incident_id").join(nodes, "uid")
    seeds = know(seeds)
    itself = _step(F.col("uid"), F.col("kind"), F.lit(""), F.lit(""))
    service = _step(F.col("service"), F.lit("Service"), F.lit(""), F.lit(""))
    pod = _step(F.col("uid"), F.col("kind"), F.lit("SELECTS"), F.lit("materialization"))
    front = seeds.select(
        "incident_id", F.col("service").isNotNull().alias("whole"), F.col("first_failure_ns").alias("failure_ns"), "pressure", "image_changed", (F.lit(depth) - F.when(F.col("service").isNotNull(), 1).otherwise(0)).alias("most"), F.col("uid").alias("at"), F.lit(0).alias("hops"),
        F.greatest(F.coalesce("node_severity", F.lit(0.25)), F.coalesce("service_severity", F.lit(0.25))).alias("severity"), F.least("node_first_ns", "service_first_ns").alias("first_ns"),
        F.when(F.col("service").isNotNull(), F.array(service, pod)).otherwise(F.array(itself)).alias("path"),
    )
    front = cut(front) if leaves is not None else front
    label = ["incident_id", "whole", "failure_ns", "pressure", "image_changed", "most", "at", "hops", "severity", "first_ns", "path"]
    out = labels = None
    for d in range(1, depth + 1):
        front = front.filter(F.col("most") >= d)
        step = front.join(arcs, "at")
        if leaves is not None:
            if done is not None:
                step = step.unionByName(front.filter("whole").join(leaves, "at"))
            at_hubs = front.filter("not whole").join(leaves.select("at").distinct(), "at", "left_semi").withColumns({"d": F.lit(d), "steps": F.size("path")}).select("incident_id", "at", *STATE, "path")
            labels = at_hubs if labels is None else labels.union(at_hubs)
        step = step.filter(~F.exists("path", lambda s: s["uid"] == F.col("up"))).drop("at").withColumnRenamed("up", "uid").withColumn("d", F.lit(d))
        step = _judged(know(step)).filter("emit or go_on")
        step = step.withColumn("path", F.concat("path", F.array(_step(F.col("uid"), F.col("kind"), F.col("edge"), _edge_kind()))))
        step = cut(step.select(*[F.col("uid").alias("at") if c == "at" else c for c in label], "kind", "root_hops", "definitive", "emit", "go_on"))  # both what ends here and what goes on come from it
        shown = F.struct(_score().alias("confidence"), "first_ns", F.col("root_hops").alias("hops"), "severity", "path", "definitive", F.col("kind").alias("root_kind"), F.col("failure_ns").alias("first_failure_ns"))
        order = F.struct(-_score(), F.coalesce("first_ns", F.lit(2**63 - 1)), "root_hops", -F.col("severity"), "path")
        ends = step.filter("emit").groupBy("incident_id", F.col("at").alias("root")).agg(F.min_by(shown, order).alias("best")).select("incident_id", "root", F.lit(d).alias("steps"), "best.*")
        out = ends if out is None else out.union(ends)
        if d < depth:
            going = _labelled(step.filter("go_on").select(*label))
            left = F.col("most") - F.lit(d)
            front = _pruned(_pruned(going, left, shuffled=False), left, shuffled=True).drop("age", "better", "between")
            front = cut(front) if leaves is not None else front  # the step after it and the labels read it
    longest = Window.partitionBy("incident_id", "root").orderBy(F.desc("steps"))
    best = out.withColumn("nth", F.row_number().over(longest)).filter("nth = 1").drop("nth", "steps")
    if done is not None:
        best = with_service_roots(best, done, nodes if not per_incident else know(done.select("incident_id", "uid", "service").join(nodes, "uid", "left")), per_incident)
    return best, incidents, labels, leaves


# --- services ----------------------------------------------------------------------------------------------------


def service_starts(edges: DataFrame, nodes: DataFrame, anomalies: DataFrame, incidents: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(where the walks start, paths that are there without one).

    A walk starts at the symptom. If that is a Service with a NoReadyEndpoints anomaly, it starts at each pod that the
    service selects, with the service as its symptom (service, service_first_ns, service_severity); but if it selects none,
    or all of them are healthy, the service is the only node of its path. A pod is unhealthy if it has an anomaly of a
    failed pod or a warning that speaks of one. The second table, None if there is no such incident, has (incident_id, uid,
    service, first_failure_ns, service_first_ns, service_severity): services alone, and selected pods in case that no
    walk from them finds anything.
    """
    none = lambda kind: F.lit(None).cast(kind)
    plain = incidents.select("incident_id", "uid", "first_failure_ns", none("string").alias("service"), none("long").alias("service_first_ns"), none("double").alias("service_severity"))
    keys = [c for c in ("incident_id", "uid") if c in anomalies.columns]
    bare = anomalies.groupBy(*keys).agg(F.count_if(F.col("type") == "NoReadyEndpoints").alias("n"), F.min("ts_ns").alias("service_first_ns"), F.max(severity_score(F.col("severity"))).alias("service_severity")).filter("n > 0").drop("n")
    bare = incidents.join(nodes.filter("kind = 'Service'").select("uid"), "uid").join(bare, keys)
    bare = cut(bare.select("incident_id", F.col("uid").alias("service"), "first_failure_ns", "service_first_ns", "service_severity"))
    if not bare.limit(1).count():
        return plain, None
    chosen = bare.join(edges.filter("type = 'SELECTS'").select(F.col("src").alias("service"), F.col("dst").alias("uid")).distinct(), "service").join(nodes.filter("kind = 'Pod'").select("uid"), "uid")
    failed = F.col("type").isin(*rules.POD_FAILURES) | ((F.col("category") == "Event") & F.col("type").rlike(FAILURE_REASONS))
    sick = anomalies.filter(failed).select(*keys).distinct().withColumn("sick", F.lit(True))
    chosen = chosen.join(sick, keys, "left")
    ill = chosen.groupBy("incident_id").agg(F.bool_or(F.coalesce("sick", F.lit(False))).alias("ill")).filter("ill").select("incident_id")
    pods = cut(chosen.join(ill, "incident_id", "left_semi").select("incident_id", "uid", "first_failure_ns", "service", "service_first_ns", "service_severity"))
    alone = bare.join(ill, "incident_id", "left_anti").select("incident_id", F.col("service").alias("uid"), "first_failure_ns", "service", "service_first_ns", "service_severity")
    starts = plain.join(bare.select("incident_id"), "incident_id", "left_anti").unionByName(pods)
    return starts, alone.unionByName(pods)


def with_service_roots(best: DataFrame, done: DataFrame, known: DataFrame, per_incident: bool) -> DataFrame:
    """best, with services that are their own root, and pods with anomalies from which no walk found a path."""
    walked = best.select("incident_id", F.get("path", F.lit(1))["uid"].alias("uid")).distinct()
    keys = ["incident_id", "uid"] if per_incident else ["uid"]
    info = known.select(*keys, "node_first_ns", "node_severity", "definitive").distinct()
    rows = done.join(walked, ["incident_id", "uid"], "left_anti").join(info, keys, "left")
    own = F.col("uid") == F.col("service")
    rows = rows.filter(own | F.col("node_first_ns").isNotNull())
    first, severity = F.least("node_first_ns", "service_first_ns"), F.greatest(F.coalesce("node_severity", F.lit(0.25)), F.coalesce("service_severity", F.lit(0.25)))
    kind, definitive = F.when(own, "Service").otherwise("Pod"), F.coalesce("definitive", F.lit(False))
    service = _step(F.col("service"), F.lit("Service"), F.lit(""), F.lit(""))
    path = F.when(own, F.array(service)).otherwise(F.array(service, _step(F.col("uid"), F.lit("Pod"), F.lit("SELECTS"), F.lit("materialization"))))
    score = confidence(F.col("first_failure_ns") - first, F.lit(0), severity, kind, definitive)
    return best.unionByName(rows.select("incident_id", F.col("uid").alias("root"), score.alias("confidence"), first.alias("first_ns"), F.lit(0).alias("hops"), severity.alias("severity"), path.alias("path"), definitive.alias("definitive"), kind.alias("root_kind"), "first_failure_ns"))


# --- ranking -----------------------------------------------------------------------------------------------------


def _path_id() -> Column:
    name = F.array_join(F.transform(F.reverse("path"), lambda s: F.concat_ws("|", s["uid"], s["edge"])), ">")
    return F.substring(F.sha2(name, 256), 1, 16)


def _ranked(rows: DataFrame, size: Column, by: str, n: int) -> DataFrame:
    """The n best roots (20 at most) of each `by`, with their rank; size: nodes on the path."""
    order = Window.partitionBy(by).orderBy(F.desc("confidence"), F.desc("definitive"), F.asc_nulls_last("first_ns"), F.desc(size), "root")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= min(n, 20))


def rank_paths(paths: DataFrame, n: int = 5) -> DataFrame:
    """The n best roots of each incident (20 at most) with rank, path_id, and all symptoms that the root leads to."""
    affected = paths.groupBy("root").agg(F.count_distinct("symptom").alias("n_affected"))
    return _ranked(paths, F.size("path"), "incident_id", n).withColumn("path_id", _path_id()).join(affected, "root")


def top_paths(edges: DataFrame, resources: DataFrame, anomalies: DataFrame, incidents: DataFrame, depth: int = 5, n: int = 5) -> DataFrame:
    """rank_paths(causal_paths(...)) without a row for each incident and root; columns as there, and steps.

    What ends at the leaves of a hub (see `_walked`) is worked out for classes: incidents with the same set of label states
    at the hub. A class has the roots, scores and order of its members, so its n best are enough for each of them. Symptoms of
    a root are counted by the sets of classes in which their incidents are.
    """
    best, incidents, labels, leaves = _walked(edges, resources, anomalies, incidents, depth, classed=True)
    symptoms = incidents.select("incident_id", F.col("uid").alias("symptom"))
    best = best.join(symptoms, "incident_id")
    if leaves is None:
        return rank_paths(best, n).withColumn("steps", F.size("path") - 1)
    affected = best.groupBy("root").agg(F.count_distinct("symptom").alias("n"))
    best = best.withColumn("steps", F.size("path") - 1)
    member = labels.groupBy("incident_id", "at").agg(F.sort_array(F.collect_set(F.struct(*STATE))).alias("states"))
    member = member.withColumn("class", F.substring(F.unhex(F.sha2(F.to_json(F.struct("at", "states")), 256)), 1, 16))
    member = cut(member.join(symptoms, "incident_id"))
    classes = member.groupBy("class", "at").agg(F.first("states").alias("states")).select("class", "at", F.explode("states").alias("state"))
    ends = _judged(cut(classes).select("class", "at", "state", "state.*").join(leaves, "at")).filter("emit").withColumnRenamed("up", "root")
    key = F.struct(-F.col("d"), -_score(), F.coalesce("first_ns", F.lit(2**63 - 1)), "root_hops", -F.col("severity"))
    shown = F.struct(_score().alias("confidence"), "first_ns", F.col("root_hops").alias("hops"), "severity", "definitive", F.col("kind").alias("root_kind"), F.col("failure_ns").alias("first_failure_ns"), "steps", "d")
    found = cut(ends.groupBy("class", "root").agg(F.min_by(shown, key).alias("best")).select("class", "root", "best.*"))
    sets = member.groupBy("symptom", "at").agg(F.sort_array(F.collect_set("class")).alias("classes")).groupBy("classes").agg(F.count("*").alias("n"))
    roots = sets.select("classes", "n", F.explode("classes").alias("class")).join(found.select("class", "root"), "class").select("classes", "root", "n")
    alone = F.size("classes") == 1
    affected = affected.union(roots.filter(alone).union(roots.filter(~alone).distinct()).groupBy("root").agg(F.sum("n")))
    few = cut(_ranked(found, F.col("steps"), "class", n).drop("rank"))
    listed = best.withColumns({"class": F.lit(None).cast("binary"), "at": F.lit(None).cast("string"), "d": F.lit(None).cast("int")})
    top = _ranked(listed.unionByName(member.drop("states").join(few, "class"), allowMissingColumns=True), F.col("steps"), "incident_id", n)
    # The paths of what is shown: the first of those labels of a class that end at the root with its best key.
    better = few.select("class", "root", *[F.col(c).alias(f"its_{c}") for c in ("d", "confidence", "first_ns", "hops", "severity")])
    won = ends.join(better, ["class", "root"]).filter((F.col("d") == F.col("its_d")) & (_score() == F.col("its_confidence")) & F.col("first_ns").eqNullSafe(F.col("its_first_ns")) & (F.col("root_hops") == F.col("its_hops")) & (F.col("severity") == F.col("its_severity")))
    won = won.select("class", "root", "state", _step(F.col("root"), F.col("kind"), F.col("edge"), _edge_kind()).alias("step"))
    ways = labels.select("incident_id", "at", F.struct(*STATE).alias("state"), F.col("path").alias("way"))
    shown_ways = top.filter("class is not null").select("incident_id", "root", "class", "at").join(won, ["class", "root"]).join(ways, ["incident_id", "at", "state"])
    whole = shown_ways.groupBy("incident_id", "root").agg(F.min(F.concat("way", F.array("step"))).alias("own_path"))
    top = top.join(whole, ["incident_id", "root"], "left").withColumn("path", F.coalesce("path", "own_path")).drop("own_path", "class", "at", "d")
    return top.withColumn("path_id", _path_id()).join(affected.groupBy("root").agg(F.sum("n").alias("n_affected")), "root")


def explained(ranked: DataFrame) -> DataFrame:
    """paths with a sentence on the path and one on its confidence."""
    steps = F.array_join(F.transform(F.reverse("path"), lambda s: F.concat_ws(" ", s["kind"], s["uid"])), " -> ")
    lead = (F.col("first_failure_ns") - F.col("first_ns")) / SECOND_NS
    why = F.format_string("confidence %.2f: first sign %.0f s before the failure, severity %.2f, %d cause edges, %d steps%s", "confidence", lead, "severity", "hops", F.size("path") - 1, F.when(F.col("definitive"), ", definitive").otherwise(""))
    return ranked.withColumn("explanation", F.concat(F.lit("caused by "), steps)).withColumn("ranking", why)
