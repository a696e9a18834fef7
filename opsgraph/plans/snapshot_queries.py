"""Queries over snapshots of resources, warning events and dashboards, and the SQL that they are compared with.

The SQL never reads the JSON: it says what follows from the numbers that the snapshots are made of.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.functions import status as st
from opsgraph.functions import validate
from opsgraph.functions.facts import facts, with_facts
from opsgraph.functions.json_diff import json_diff, without_noise
from opsgraph.functions.stored import scratch, stored
from opsgraph.operators import anomaly, changes, lineage, significance
from opsgraph.plans import edges, nodes
from opsgraph.plans.incremental import GraphTables
from opsgraph.plans.queries import END, query
from opsgraph.sources.snapshots import CLUSTER_SQL, SNAPSHOTS_SQL, WARNINGS_SQL, cluster, dashboards, resource_snapshots, warning_snapshots
from opsgraph.sources.views import table, ts_ns

MINUTE = 60_000_000_000


def _changes(spark: SparkSession, d: str) -> DataFrame:
    return nodes.build_change_events(resource_snapshots(spark, d))


@query(
    """
    SELECT id, uid, kind, type AS event_type, status, issues, config_changed, CASE WHEN seen THEN type = 'UPDATE' ELSE TRUE END AS status_changed, FALSE AS replicas_changed,
      round(least(1.0, CASE status WHEN 'Error' THEN 0.8 WHEN 'Warning' THEN 0.5 WHEN 'Terminating' THEN 0.6 ELSE 0.1 END + CASE WHEN issues <> '' THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS impact
    FROM v_snaps
    """,
    SNAPSHOTS_SQL,
)
def change_events(spark: SparkSession, d: str) -> DataFrame:
    """Status of all kinds, issues, impact and change flags, from snapshots."""
    rows = _changes(spark, d)
    return rows.select("id", "uid", "kind", "event_type", "status", F.array_join("issues", ",").alias("issues"), "config_changed", "status_changed", "replicas_changed", F.round("impact", 6).alias("impact"))


@query(
    """
    SELECT id, 'c' AS container, issues AS type, CASE WHEN m = 0 THEN n * 2 ELSE 0 END::INT AS restarts, CASE issues WHEN 'CrashLoopBackOff' THEN 0.35 WHEN 'ImagePullBackOff' THEN 0.25 WHEN 'OOMKilled' THEN 0.4 WHEN 'HighRestartCount' THEN 0.2 ELSE 0.35 END::DOUBLE AS impact
    FROM v_snaps WHERE issues <> ''
    """,
    SNAPSHOTS_SQL,
)
def container_issues(spark: SparkSession, d: str) -> DataFrame:
    rows = resource_snapshots(spark, d).filter("kind = 'Pod'").select("id", F.explode(st.container_issues(facts(F.col("data")))).alias("i"))
    return rows.select("id", "i.container", "i.type", "i.restarts", "i.impact")


@query(
    """
    SELECT id, coalesce(CASE WHEN type = 'DELETE' THEN NULL WHEN kind = 'Deployment' AND n = 4 THEN CASE WHEN m = 0 THEN 'Timeout' ELSE 'Waiting' END WHEN kind = 'HelmRelease' AND n % 4 = 1 THEN 'InstallFailed' END, '') AS reason,
      coalesce(CASE WHEN type = 'DELETE' THEN NULL WHEN kind = 'Deployment' AND n = 4 THEN m = 0 WHEN kind = 'HelmRelease' AND n % 4 = 1 THEN TRUE END, FALSE) AS error_like
    FROM v_snaps
    """,
    SNAPSHOTS_SQL,
)
def condition_reasons(spark: SparkSession, d: str) -> DataFrame:
    found = st.condition_reason(facts(F.col("data")))
    return resource_snapshots(spark, d).select("id", F.coalesce(found["reason"], F.lit("")).alias("reason")).withColumn("error_like", st.error_like(F.col("reason")))


@query(
    f"""
    WITH a AS (
      SELECT uid, 'State' AS category, issues AS type, CASE WHEN issues = 'OOMKilled' THEN 'high' ELSE 'critical' END AS severity, ts_ns FROM v_snaps WHERE issues IN ('CrashLoopBackOff', 'ImagePullBackOff', 'OOMKilled')
      UNION ALL SELECT uid, 'State', CASE status WHEN 'Error' THEN 'ErrorStatus' ELSE 'TerminatingStatus' END, CASE status WHEN 'Error' THEN 'high' ELSE 'medium' END, ts_ns FROM v_snaps WHERE status IN ('Error', 'Terminating')
      UNION ALL SELECT uid, 'State', 'NodeNotReady', 'critical', ts_ns FROM v_snaps WHERE kind = 'Node' AND type <> 'DELETE' AND n % 5 IN (1, 2)
      UNION ALL SELECT uid, 'State', 'NodeMemoryPressure', 'high', ts_ns FROM v_snaps WHERE kind = 'Node' AND type <> 'DELETE' AND n % 5 = 3
      UNION ALL SELECT uid, 'State', 'HelmReleaseFailed', 'critical', ts_ns FROM v_snaps WHERE kind = 'HelmRelease' AND type <> 'DELETE' AND n % 4 = 1
      UNION ALL SELECT uid, 'State', 'PVCBindingFailed', 'critical', max(ts_ns) FROM v_snaps WHERE kind = 'PersistentVolumeClaim' GROUP BY uid
        HAVING count(*) FILTER (type <> 'DELETE' AND m = 2) > 0 OR max(ts_ns) FILTER (type <> 'DELETE' AND m = 1) - min(ts_ns) FILTER (type <> 'DELETE' AND m = 1) >= {MINUTE}
      UNION ALL SELECT uid, 'State', 'PodFailed', 'critical', ts_ns FROM v_snaps WHERE kind = 'Pod' AND type <> 'DELETE' AND n % 5 = 3
      UNION ALL SELECT uid, 'State', 'PodPending', 'high', max(ts_ns) FROM v_snaps WHERE kind = 'Pod' AND type <> 'DELETE' AND n % 5 = 2 GROUP BY uid HAVING max(ts_ns) - min(ts_ns) >= {5 * MINUTE}
      UNION ALL SELECT uid, 'State', 'RolloutStuck', 'high', max(ts_ns) FROM v_snaps WHERE kind = 'Deployment' GROUP BY uid HAVING bool_or(config_changed) AND arg_max(CASE WHEN type = 'DELETE' THEN 0 ELSE 3 - n % 4 END, (ts_ns, event_id)) > 0
      UNION ALL SELECT uid, 'Change', 'ResourceDeleted', 'medium', ts_ns FROM v_snaps WHERE type = 'DELETE'
      UNION ALL SELECT uid, 'Change', 'ResourceCreated', 'low', ts_ns FROM v_snaps WHERE type = 'CREATE' AND kind NOT IN ('Node', 'PersistentVolumeClaim', 'HelmRelease')
      UNION ALL SELECT uid, 'Frequency', 'HighRestartCount', 'high', max(ts_ns) FROM v_snaps WHERE kind = 'Pod' GROUP BY uid HAVING max(CASE WHEN type <> 'DELETE' AND m = 0 THEN n * 2 ELSE 0 END) > 3
    ) SELECT * FROM a
    """,
    SNAPSHOTS_SQL,
)
def snapshot_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Detectors that read snapshots; what they read is stored once, else each of them would make it anew."""
    rows = stored(with_facts(_changes(spark, d).select("id", "uid", "kind", "ts_ns", "event_type", "status", "config_changed", "data")), "changes")
    none = rows.select("uid", "kind", "id", "ts_ns", F.lit("").alias("path"), F.lit("").alias("op"), F.lit("").alias("old"), F.lit("").alias("new")).limit(0)
    seen = anomaly.Seen(rows, rows.limit(0), none, END)
    use = ("container_states", "bad_status", "pod_phases", "node_conditions", "rollouts", "gitops", "claims", "lifecycle", "restarts")
    out = None
    for name in use:
        found = anomaly.DETECTORS[name](seen)
        out = found if out is None else out.unionByName(found)
    return out.select("uid", "category", "type", "severity", "ts_ns")


# --- warning events --------------------------------------------------------------------------------------------


@query(
    """
    SELECT id, uid, ts_ns, reason, message, type, count, '' AS source FROM v_warnings
    """,
    WARNINGS_SQL,
)
def k8s_events(spark: SparkSession, d: str) -> DataFrame:
    return nodes.build_k8s_events(warning_snapshots(spark, d))


@query("SELECT id, ts_ns, 'PLACEHOLDER' AS type, uid, kind, CASE kind WHEN 'Pod' THEN '' ELSE 'apps' END AS \"group\", 'v1' AS version, 'ns' AS namespace, name FROM v_warnings", WARNINGS_SQL)
def placeholders(spark: SparkSession, d: str) -> DataFrame:
    return nodes.placeholders(warning_snapshots(spark, d)).drop("involved_uid", "data")


@query("SELECT 'EMITTED_EVENT' AS type, uid AS src, id AS dst FROM v_warnings UNION ALL SELECT 'CHANGED', uid, id FROM v_snaps", WARNINGS_SQL, SNAPSHOTS_SQL)
def event_edges(spark: SparkSession, d: str) -> DataFrame:
    return nodes.event_edges(_changes(spark, d), nodes.build_k8s_events(warning_snapshots(spark, d)))


@query("SELECT id, uid AS involved FROM v_warnings", WARNINGS_SQL)
def involved_uids(spark: SparkSession, d: str) -> DataFrame:
    """Two thirds of the events name what they are about in their data only."""
    rows = warning_snapshots(spark, d)
    rows = validate.enrich(rows.withColumn("resource", F.struct("kind", F.col("involved_uid").alias("involvedObjectUid"))))
    return rows.select("id", F.col("resource.involvedObjectUid").alias("involved"))


def _warnings(spark: SparkSession, d: str) -> DataFrame:
    """Warning events with the kind of what they are about."""
    about = nodes.placeholders(warning_snapshots(spark, d)).select("id", "kind")
    return nodes.build_k8s_events(warning_snapshots(spark, d)).join(about, "id")


_BENIGN = "('Scheduled', 'Pulled')"


@query(
    f"""
    WITH f AS (SELECT *, row_number() OVER (PARTITION BY uid, reason ORDER BY ts_ns, id) AS nth FROM v_warnings WHERE type = 'Warning' AND reason NOT IN {_BENIGN}),
    t AS (SELECT *, CASE WHEN message LIKE 'read-only%' THEN 'ReadOnlyFilesystem' WHEN message LIKE 'no space%' THEN 'VolumeOutOfSpace' WHEN reason = 'FailedMount' THEN CASE WHEN message LIKE 'secret%' THEN 'InvalidConfigReference' ELSE 'VolumeMountFailed' END
      WHEN reason = 'BackOff' AND message LIKE 'image%' THEN 'ImagePullTimeout' WHEN message LIKE 'forbidden%' THEN 'RBACDenied' WHEN reason = 'FailedCreate' AND kind = 'Deployment' THEN 'ReplicaCreationFailure' ELSE reason END AS as_type FROM f WHERE nth = 1)
    SELECT uid, as_type AS type, CASE as_type WHEN 'FailedScheduling' THEN 'critical' WHEN 'ReplicaCreationFailure' THEN 'medium' ELSE 'high' END AS severity, ts_ns FROM t
    UNION ALL SELECT uid, 'HighFrequencyEvent', 'high', ts_ns FROM v_warnings WHERE count > 10
    UNION ALL SELECT uid, 'RepeatedEvent', 'high', {END} FROM v_warnings GROUP BY uid, kind, reason HAVING count(*) >= 3
    """,
    WARNINGS_SQL,
)
def event_anomalies(spark: SparkSession, d: str) -> DataFrame:
    """Detectors that read warning events."""
    rows = _warnings(spark, d)
    seen = anomaly.Seen(rows, rows, rows, END)
    found = anomaly.warning_events(seen).unionByName(anomaly.high_frequency(seen)).unionByName(anomaly.repeated(seen))
    return found.select("uid", "type", "severity", "ts_ns")


@query(
    f"""
    WITH g AS (SELECT *, event_id % 2 = 1 AS spine, (event_id % 90) * {MINUTE} AS gap FROM v_warnings)
    SELECT id, round(least(1.0, CASE WHEN type = 'Warning' THEN 0.3 ELSE 0.2 END + CASE WHEN reason = 'FailedScheduling' THEN 0.5 WHEN reason IN ('BackOff', 'FailedMount', 'Unhealthy') THEN 0.4 WHEN reason = 'Evicted' THEN 0.3 ELSE 0 END
      + CASE WHEN spine THEN 0.15 ELSE 0 END + CASE WHEN gap < {5 * MINUTE} THEN 0.1 WHEN gap < {30 * MINUTE} THEN 0.05 ELSE 0 END + CASE WHEN count > 5 THEN 0.1 ELSE 0 END)::DOUBLE, 6) AS score FROM g
    """,
    WARNINGS_SQL,
)
def k8s_event_significance(spark: SparkSession, d: str) -> DataFrame:
    rows, i = nodes.build_k8s_events(warning_snapshots(spark, d)), F.col("id").cast("long")
    score = significance.k8s_event_significance(F.col("type"), F.col("reason"), i % 2 == 1, (i % 90) * MINUTE, F.col("count"))
    return rows.select("id", F.round(score, 6).alias("score"))


@query(
    f"""
    WITH g AS (SELECT *, event_id % 2 = 1 AS spine, (event_id % 90) * {MINUTE} AS gap, (event_id % 5) / 10.0 AS pattern FROM v_snaps)
    SELECT id, round(least(1.0, CASE WHEN spine THEN 0.15 ELSE 0 END + CASE WHEN config_changed THEN 0.3 WHEN (CASE WHEN seen THEN type = 'UPDATE' ELSE TRUE END) THEN 0.05 ELSE 0 END + 0.2 * pattern
      + CASE WHEN gap < {5 * MINUTE} THEN 0.2 WHEN gap < {30 * MINUTE} THEN 0.1 WHEN gap < {60 * MINUTE} THEN 0.04 ELSE 0 END + CASE WHEN event_id % 7 = 0 THEN 0.1 ELSE 0 END + CASE type WHEN 'DELETE' THEN 0.05 WHEN 'CREATE' THEN 0.03 ELSE 0 END)::DOUBLE, 6) AS score FROM g
    """,
    SNAPSHOTS_SQL,
)
def event_significance(spark: SparkSession, d: str) -> DataFrame:
    i = F.col("id").cast("long")
    score = significance.event_significance(i % 2 == 1, F.col("config_changed"), F.col("status_changed"), (i % 5) / 10, (i % 90) * MINUTE, i % 7 == 0, F.col("event_type"))["score"]
    return _changes(spark, d).select("id", F.round(score, 6).alias("score"))


# --- failure patterns ------------------------------------------------------------------------------------------

_C = "status.containerStatuses[name=a].state."
#: Differences, and the patterns that they show.
_DIFFS = [
    ("Pod", _C + "terminated.exitCode", "replace", "137", [("ContainerOOMKilled", 0.5)]),
    ("Pod", _C + "terminated.exitCode", "replace", "139", [("ContainerCrashed", 0.45)]),
    ("Pod", _C + "terminated.exitCode", "add", "2", [("ContainerCrashed", 0.4)]),
    ("Pod", _C + "terminated.exitCode", "add", "0", []),
    ("Pod", _C + "terminated.reason", "add", '"Error"', [("ContainerCrashed", 0.4)]),
    ("Pod", _C + "waiting.reason", "add", '"CrashLoopBackOff"', [("ContainerCrashLoopBackOff", 0.5)]),
    ("Pod", _C + "waiting.reason", "add", '"VolumeMountCreateContainerError"', [("ContainerStartFailed", 0.4), ("VolumeMountFailed", 0.35)]),
    ("Pod", _C + "running", "remove", None, [("ContainerTerminated", 0.3)]),
    ("Pod", "status.conditions[type=Ready].reason", "replace", '"StartupProbe"', [("StartupProbeFailure", 0.35)]),
    ("Deployment", "status.unavailableReplicas", "replace", "2", [("ReplicasUnavailable", 0.35)]),
    ("Deployment", "status.conditions[type=Progressing].reason", "replace", '"ProgressDeadlineExceeded"', [("RolloutStalled", 0.4)]),
    ("ReplicaSet", "status.readyReplicas", "replace", "0", [("ReplicasUnavailable", 0.3)]),
    ("StatefulSet", "status.readyReplicas", "replace", "1", []),
]
_SHOWN = ", ".join(f"({i}, '{t}', {s}::DOUBLE)" for i, row in enumerate(_DIFFS) for t, s in row[4])
_PATTERNS_SQL = f"v_patterns AS (SELECT event_id::VARCHAR AS id, 'u' || user_id AS uid, p.type, p.severity FROM events JOIN (VALUES {_SHOWN}) AS p(i, type, severity) ON event_id % {len(_DIFFS)} = p.i)"


def _differences(spark: SparkSession, d: str) -> DataFrame:
    i = (F.col("event_id") % len(_DIFFS) + 1).cast("int")
    pick = lambda at: F.element_at(F.array(*[F.lit(row[at]).cast("string") for row in _DIFFS]), i)
    return table(spark, d, "events").select(F.concat(F.lit("u"), "user_id").alias("uid"), pick(0).alias("kind"), F.col("event_id").cast("string").alias("id"), F.lit(0).cast("long").alias("ts_ns"), pick(1).alias("path"), pick(2).alias("op"), F.lit(None).cast("string").alias("old"), pick(3).alias("new"))


@query("SELECT * FROM v_patterns", _PATTERNS_SQL)
def resource_patterns(spark: SparkSession, d: str) -> DataFrame:
    return significance.resource_patterns(_differences(spark, d)).select("id", "uid", "type", "severity")


@query("SELECT uid, id, arg_max(type, severity) AS type, max(severity) AS severity FROM v_patterns GROUP BY uid, id", _PATTERNS_SQL)
def highest_pattern(spark: SparkSession, d: str) -> DataFrame:
    return significance.highest_pattern(significance.resource_patterns(_differences(spark, d))).select("uid", "id", "type", "severity")


@query(
    """
    SELECT event_id::VARCHAR AS id, 'u' || user_id AS uid, 'status.phase' AS path, 'ContainerCrashed' AS type, 0.40::DOUBLE AS severity, 'Failed' AS detail FROM v_first WHERE event_type = 'error'
    UNION ALL SELECT event_id::VARCHAR, 'u' || user_id, 'status.reason', 'PodEvicted', 0.45::DOUBLE, 'Evicted by ' || user_id FROM v_first WHERE event_type IN ('error', 'click') AND user_id % 2 = 0
    """,
    "v_first AS (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id::VARCHAR) = 1)",
)
def snapshot_patterns(spark: SparkSession, d: str) -> DataFrame:
    """Users as pods: what their first events show of a failure; the later ones are differences and show nothing here."""
    e = table(spark, d, "events")
    phase = F.when(F.col("event_type") == "error", "Failed").otherwise("Running")
    reason = F.when(F.col("event_type").isin("error", "click") & (F.col("user_id") % 2 == 0), F.concat(F.lit("Evicted by "), "user_id"))
    rows = e.select(F.col("event_id").cast("string").alias("id"), F.concat(F.lit("u"), "user_id").alias("uid"), ts_ns(F.col("ts")).alias("ts_ns"), F.to_json(F.struct(F.struct(phase.alias("phase"), reason.alias("reason")).alias("status"))).alias("data"))
    first = changes.events_to_diffs(rows).filter("snapshot is not null").withColumn("kind", F.lit("Pod"))
    return significance.snapshot_patterns(first).select("id", "uid", "path", "type", "severity", "detail")


@query(
    """
    WITH l AS (SELECT l_orderkey AS o, l_linenumber AS n, 'l' || l_linenumber || '-' || l_partkey || '-' || round(l_extendedprice * 100)::BIGINT AS m, l_quantity::BIGINT AS q, l_returnflag AS f FROM lineitem)
    SELECT 'o' || o AS uid, 'spec.items[name=' || m || '].qty' AS path, 'replace' AS op, q::VARCHAR AS old, (q + 1)::VARCHAR AS new FROM l WHERE n % 2 = 0 AND f <> 'R'
    UNION ALL SELECT 'o' || o, 'spec.items[name=' || m || '].tags[1]', 'add', NULL, '"b"' FROM l WHERE n % 3 = 0 AND f <> 'R'
    UNION ALL SELECT 'o' || o, 'spec.items[name=' || m || ']', 'remove', '{"name":"' || m || '","qty":' || q || ',"tags":["a"]}', NULL FROM l WHERE f = 'R'
    UNION ALL SELECT DISTINCT 'o' || o, 'spec.items[name=z]', 'add', NULL, '{"name":"z","qty":0,"tags":[]}' FROM l
    """
)
def nested_diff(spark: SparkSession, d: str) -> DataFrame:
    """Orders with their items in two versions: items that were returned gone, some with another quantity or tag, one more, all in another order."""
    item = table(spark, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("n"), F.concat_ws("-", F.concat(F.lit("l"), "l_linenumber"), "l_partkey", F.round(F.col("l_extendedprice") * 100).cast("long")).alias("m"), F.col("l_quantity").cast("long").alias("q"), F.col("l_returnflag").alias("f"))
    shape = lambda name, qty, tags: F.struct(name.alias("name"), qty.alias("qty"), tags.alias("tags"))
    name, a = F.col("m"), F.array(F.lit("a"))
    before = shape(name, F.col("q"), a)
    after = F.when(F.col("f") != "R", shape(name, F.col("q") + F.when(F.col("n") % 2 == 0, 1).otherwise(0), F.when(F.col("n") % 3 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(a)))
    more = shape(F.lit("z"), F.lit(0).cast("long"), F.array().cast("array<string>"))
    docs = item.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(before)).alias("x"), F.reverse(F.array_sort(F.collect_list(after))).alias("y"))
    spec = lambda items: F.to_json(F.struct(F.struct(items.alias("items")).alias("spec"), F.struct(F.rand().cast("string").alias("resourceVersion")).alias("metadata")))
    two = docs.select(F.concat(F.lit("o"), "l_orderkey").alias("uid"), spec(F.col("x")).alias("old"), spec(F.concat(F.array(more), "y")).alias("new"))
    return two.select("uid", F.explode(without_noise(json_diff("old", "new"))).alias("d")).select("uid", "d.*")


# --- edges -----------------------------------------------------------------------------------------------------


_EDGES_SQL = """
    SELECT DISTINCT w.type, w.src, CASE WHEN w.ns = '' THEN w.kind || '//' || w.name ELSE w.kind || '/' || w.ns || '/' || w.name END AS dst FROM v_wanted w JOIN v_there t ON w.kind = t.kind AND w.ns = t.ns AND w.name = t.name
    UNION ALL SELECT 'OWNS', 'c' || c, uid FROM v_pods
    UNION ALL SELECT 'SELECTS', 'Service/ns' || (n_nationkey % 7) || '/svc-' || n_nationkey, uid FROM nation JOIN v_pods ON c % 50 = n_nationkey AND ns = 'ns' || (n_nationkey % 7)
"""


@query(_EDGES_SQL, CLUSTER_SQL)
def snapshot_edges(spark: SparkSession, d: str) -> DataFrame:
    """Edges by owner, selector and all references by name."""
    return edges.build_edges(cluster(spark, d)).select("type", "src", "dst")


@query(
    f"""
    WITH v_left AS (SELECT * FROM v_there WHERE NOT (kind = 'PersistentVolumeClaim' AND name LIKE '%3'))
    SELECT 'edge' AS part, * FROM ({_EDGES_SQL.replace("v_there", "v_left")})
    UNION ALL SELECT DISTINCT 'missing', w.type, w.src, concat_ws('/', w.kind, w.ns, w.name) FROM v_wanted w LEFT JOIN v_left t ON w.kind = t.kind AND w.ns = t.ns AND w.name = t.name WHERE t.name IS NULL
    """,
    CLUSTER_SQL,
)
def batched_edges(spark: SparkSession, d: str) -> DataFrame:
    """The edges, and the references that lack a target, after three batches: two halves of the cluster, then some claims deleted."""
    none = F.lit(None).cast("string")
    events = cluster(spark, d).select(F.concat(F.lit("c-"), "uid").alias("id"), "uid", "kind", none.alias("group"), none.alias("version"), "namespace", "name", none.alias("involved_uid"), F.lit("CREATE").alias("type"), (F.lit(END) - F.pmod(F.xxhash64("uid"), F.lit(21_600)) * 1_000_000_000).alias("ts_ns"), "data")
    half = F.pmod(F.xxhash64("uid"), F.lit(2))
    gone = events.filter("kind = 'PersistentVolumeClaim' and name like '%3'").withColumn("id", F.concat(F.lit("d-"), "uid")).withColumn("type", F.lit("DELETE")).withColumn("ts_ns", F.lit(END + MINUTE))
    store = GraphTables(spark, scratch(spark, "graph"), buckets=int(spark.conf.get("spark.sql.shuffle.partitions")))
    for n, batch in enumerate((events.filter(half == 1), events.filter(half == 0), gone)):
        store.apply(batch, n)
    missing = store.missing_references().select(F.lit("missing").alias("part"), "type", "src", F.concat_ws("/", "kind", "namespace", "name").alias("dst"))
    return store.tables()["edges"].select(F.lit("edge").alias("part"), "type", "src", "dst").union(missing)


@query("SELECT DISTINCT w.src, w.type, w.kind, w.ns AS namespace, w.name FROM v_wanted w LEFT JOIN v_there t ON w.kind = t.kind AND w.ns = t.ns AND w.name = t.name WHERE t.name IS NULL", CLUSTER_SQL)
def missing_references(spark: SparkSession, d: str) -> DataFrame:
    return edges.missing_references(cluster(spark, d)).select("src", "type", "kind", "namespace", "name")


@query(
    f"""
    SELECT DISTINCT w.src AS uid, CASE w.type WHEN 'USES_SERVICE_ACCOUNT' THEN 'ServiceAccountMissing' ELSE 'SecretMissing' END AS type, 'critical' AS severity, 'missing ' || w.kind || '/' || w.ns || '/' || w.name AS summary, {END}::BIGINT AS ts_ns
    FROM v_wanted w LEFT JOIN v_there t ON w.kind = t.kind AND w.ns = t.ns AND w.name = t.name WHERE t.name IS NULL AND w.type IN ('MOUNTS', 'USES_SERVICE_ACCOUNT', 'REFERENCES_SPEC')
    """,
    CLUSTER_SQL,
)
def missing_reference_anomalies(spark: SparkSession, d: str) -> DataFrame:
    latest = cluster(spark, d)
    return anomaly.missing_references(edges.missing_references(latest), latest, END).select("uid", "type", "severity", "summary", "ts_ns")


# --- dashboards ------------------------------------------------------------------------------------------------


_K = "p_partkey"
_USES_SQL = f"""v_uses AS (
  SELECT 'd' || {_K} || '-1-A' AS query, 'm_' || ({_K} % 50) AS metric, 'a' || ({_K} % 7) AS service, 'c' || ({_K} % 3) AS cluster, '' AS namespace FROM part
  UNION ALL SELECT 'd' || {_K} || '-1-B', unnest(['b_' || ({_K} % 20), 'n_' || ({_K} % 30)]), 'j' || ({_K} % 5), '', 'n' || ({_K} % 5) FROM part WHERE {_K} % 4 <> 0
)"""


@query("SELECT DISTINCT 'USES' AS type, query AS src, metric AS dst FROM v_uses", _USES_SQL)
def dashboard_uses(spark: SparkSession, d: str) -> DataFrame:
    return lineage.uses_edges(lineage.queries(dashboards(spark, d)))


@query("SELECT DISTINCT query, service, cluster, namespace FROM v_uses", _USES_SQL)
def dashboard_services(spark: SparkSession, d: str) -> DataFrame:
    return lineage.services(lineage.queries(dashboards(spark, d)))


@query("SELECT DISTINCT 'TRACKS' AS type, metric AS src, service AS dst FROM v_uses", _USES_SQL)
def dashboard_tracks(spark: SparkSession, d: str) -> DataFrame:
    return lineage.tracks_edges(lineage.queries(dashboards(spark, d)))


@query(
    f"""
    SELECT 'CONTAINS' AS type, 'd' || {_K} AS src, 'd' || {_K} || '-1' AS dst FROM part UNION ALL SELECT 'HAS', 'd' || {_K} || '-1', 'd' || {_K} || '-1-' || unnest(['A', 'B']) FROM part
    UNION ALL SELECT 'HAS_VARIABLE', 'd' || {_K}, ['my_cluster', 'namespace', 'handler', 'zzz'][{_K} % 4 + 1] FROM part
    """
)
def dashboard_structure(spark: SparkSession, d: str) -> DataFrame:
    return lineage.structure_edges(dashboards(spark, d))


@query(f"SELECT 'd' || {_K} AS dashboard, ['my_cluster', 'namespace', 'handler', 'zzz'][{_K} % 4 + 1] AS variable, ['scoping', 'entity', 'detail', 'unknown'][{_K} % 4 + 1] AS class FROM part")
def dashboard_variables(spark: SparkSession, d: str) -> DataFrame:
    return lineage.variables(dashboards(spark, d)).select("dashboard", "variable", "class")


@query(f"SELECT 'd' || {_K} AS dashboard, ['overview', 'drilldown', 'detail'][{_K} % 3 + 1] AS level FROM part")
def dashboard_levels(spark: SparkSession, d: str) -> DataFrame:
    return dashboards(spark, d).select(F.col("uid").alias("dashboard"), lineage.hierarchy_level(F.col("tags")).alias("level"))


@query(f"SELECT 'd' || {_K} || '-1-A' AS query, 'ds' AS datasource FROM part UNION ALL SELECT 'd' || {_K} || '-1-B', 'plain' FROM part")
def dashboard_sources(spark: SparkSession, d: str) -> DataFrame:
    return lineage.queries(dashboards(spark, d)).select("query", "datasource")


@query("SELECT DISTINCT 'MONITORS' AS type, 'rule-' || s_suppkey AS src, unnest(['up_' || (s_suppkey % 9), 'down']) AS dst FROM supplier")
def rule_monitors(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("s_suppkey")
    model = F.format_string('{"expr":"avg(up_%d) by (job) > down"}', s % 9)
    data = F.array(F.struct(F.lit("A").alias("refId"), model.alias("model")), F.struct(F.lit("B").alias("refId"), F.lit("{}").alias("model")))
    return lineage.monitors_edges(table(spark, d, "supplier").select(F.concat(F.lit("rule-"), s).alias("uid"), data.alias("data")))
