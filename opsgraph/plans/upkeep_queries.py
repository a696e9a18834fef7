"""Queries of sources and sinks, upkeep, management, incidents and metrics, and the SQL that they are compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.functions import validate
from opsgraph.functions.facts import api_group, api_version, to_seconds
from opsgraph.functions.stored import scratch
from opsgraph.operators import alerts, changes, incident, metrics, timeline, traverse
from opsgraph.plans import maintain, management, nodes
from opsgraph.plans.queries import A_SQL, AS_OF, DAY, E_SQL, END, HOUR, START, query
from opsgraph.sources import events as ev
from opsgraph.sources import views
from opsgraph.sources.snapshots import SNAPSHOTS_SQL, WARNINGS_SQL, dashboards, resource_snapshots, warning_snapshots
from opsgraph.sources.views import table

SECOND = 1_000_000_000

# --- sources and sinks -----------------------------------------------------------------------------------------


def _import_rows(spark: SparkSession, d: str) -> DataFrame:
    """Events as they are imported; one in eleven has no id."""
    e = views.resource_events(spark, d)
    resource = F.struct(F.lit("").alias("group"), F.lit("v1").alias("version"), "kind", "namespace", "name", "uid", F.lit(None).cast("string").alias("involvedObjectUid"))
    return e.select(F.when(F.col("id").cast("long") % 11 > 0, F.col("id")).alias("id"), F.col("ts_ns").alias("timestamp"), "type", resource.alias("resource"), "data", F.length("data").alias("dataSize"), F.lit(0).alias("compressedSize"))


@query("SELECT CASE WHEN id::BIGINT % 11 > 0 THEN id END AS id, ts_ns AS timestamp, type, kind, uid, data FROM v_events", E_SQL)
def audit_log(spark: SparkSession, d: str) -> DataFrame:
    """Events written as JSON lines and read back."""
    path = scratch(spark, "audit")
    ev.write_audit_log(_import_rows(spark, d), path)
    return ev.read_audit_log(spark, path).select("id", "timestamp", "type", "resource.kind", "resource.uid", "data")


@query(f"SELECT count(*) AS events, count(DISTINCT ts_ns // {HOUR}) AS hours, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM v_events WHERE ts_ns BETWEEN {START} AND {END}", E_SQL)
def exported_window(spark: SparkSession, d: str) -> DataFrame:
    """The report of an export that is read back."""
    path = scratch(spark, "export")
    ev.export_events(_import_rows(spark, d), START, END, path)
    return ev.import_report(ev.read_audit_log(spark, path))


@query(f"SELECT id, ts_ns AS timestamp, type, uid, data FROM v_events WHERE ts_ns BETWEEN {START} AND {END} AND id::BIGINT % 11 > 0", E_SQL)
def exported_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a window's events, imported again; an event without id is left out as invalid."""
    path = scratch(spark, "documents")
    ev.export_documents(_import_rows(spark, d), START, END, path, most=50)
    return ev.read_events(spark, path).select("id", "timestamp", "type", "resource.uid", "data")


@query("SELECT namespace, pod, container, ts_ns, message FROM (SELECT role AS namespace, 'pod-' || (conv_id % 20) AS pod, 'c' || (turn % 3) AS container, (1704844800 + conv_id * 60 + turn) * 1000000000 AS ts_ns, coalesce(text, '') AS message FROM conversations)")
def read_logs(spark: SparkSession, d: str) -> DataFrame:
    path, c = scratch(spark, "logs"), table(spark, d, "conversations")
    time = F.date_format(F.timestamp_seconds(F.lit(START // SECOND) + F.col("conv_id") * 60 + F.col("turn")).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ssXXX")
    c.select(F.col("text").alias("_msg"), time.alias("_time"), F.col("role").alias("namespace"), F.concat(F.lit("pod-"), F.col("conv_id") % 20).alias("pod"), F.concat(F.lit("c"), F.col("turn") % 3).alias("container")).write.json(path)
    return ev.read_logs(spark, path).drop("level")


@query("SELECT 'd' || p_partkey AS uid, p_name AS title, 2::BIGINT AS n_queries, ['my_cluster', 'namespace', 'handler', 'zzz'][p_partkey % 4 + 1] AS variable FROM part")
def read_dashboards(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "dashboards")
    dashboards(spark, d).withColumn("templating", F.struct(F.col("templating").alias("list"))).write.json(path)
    rows = ev.read_dashboards(spark, path)
    return rows.select("uid", "title", F.size(F.flatten("panels.targets")).cast("long").alias("n_queries"), F.get("templating", F.lit(0))["name"].alias("variable"))


@query("SELECT 'rule-' || s_suppkey AS uid, s_name AS title, 'A' AS ref FROM supplier")
def read_alert_rules(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "rules")
    data = F.array(F.struct(F.lit("A").alias("refId"), F.lit("{}").alias("model")))
    table(spark, d, "supplier").select(F.concat(F.lit("rule-"), "s_suppkey").alias("uid"), F.col("s_name").alias("title"), data.alias("data")).write.json(path)
    return ev.read_alert_rules(spark, path).select("uid", "title", F.get("data", F.lit(0))["refId"].alias("ref"))


@query("SELECT alert, state, ts_ns FROM v_states", A_SQL)
def read_alert_states(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark, "states")
    views.alert_states(spark, d).drop("seq").write.json(path)
    return ev.read_alert_states(spark, path).drop("instance")


@query("SELECT 'm' || event_type AS metric, 's' AS unit, date_trunc('milliseconds', ts) AS at, value FROM events")
def metric_frames(spark: SparkSession, d: str) -> DataFrame:
    """A frame of each event's point."""
    e = table(spark, d, "events")
    field = F.struct(F.lit("v").alias("name"), F.create_map(F.lit("__name__"), F.concat(F.lit("m"), "event_type")).alias("labels"), F.struct(F.lit("s").alias("unit")).alias("config"))
    first = F.struct(F.lit("t").alias("name"), F.create_map().cast("map<string,string>").alias("labels"), F.struct(F.lit(None).cast("string").alias("unit")).alias("config"))
    values = F.array(F.array(F.unix_millis(F.col("ts").cast("timestamp")).cast("double")), F.array("value"))
    frames = e.select(F.to_json(F.struct(F.struct(F.array(first, field).alias("fields")).alias("schema"), F.struct(values.alias("values")).alias("data"))).alias("frame"))
    return ev.metric_frames(frames).select(metrics.metric_name(F.col("labels")).alias("metric"), "unit", F.col("ts").cast("timestamp_ntz").alias("at"), "value")


@query(
    """
    SELECT s_suppkey AS s, ['apps', '', 'a.b'][s_suppkey % 3 + 1] AS "group", ['v1', 'v1', 'v1beta1'][s_suppkey % 3 + 1] AS version, CASE WHEN s_suppkey % 2 = 0 THEN 1700000000 + s_suppkey ELSE 1700000000 + s_suppkey // 1000 END AS seconds FROM supplier
    """
)
def api_parts(spark: SparkSession, d: str) -> DataFrame:
    """Groups and versions, and times in seconds or milliseconds."""
    s = F.col("s_suppkey")
    text = F.element_at(F.array(F.lit("apps/v1"), F.lit("v1"), F.lit("a.b/v1beta1")), (s % 3 + 1).cast("int"))
    time = F.when(s % 2 == 0, F.lit(1_700_000_000) + s).otherwise(F.lit(1_700_000_000_000) + s)
    return table(spark, d, "supplier").select(s.alias("s"), api_group(text).alias("group"), api_version(text).alias("version"), to_seconds(time).alias("seconds"))


# --- resources -------------------------------------------------------------------------------------------------

_LIVES_SQL = """v_lives AS (
  SELECT uid, arg_min(kind, (ts_ns, event_id)) AS kind, arg_min(namespace, (ts_ns, event_id)) AS namespace, arg_min(name, (ts_ns, event_id)) AS name, min(ts_ns) AS first_ns, any_value(gone) AS gone
  FROM (SELECT *, min(ts_ns) FILTER (type = 'DELETE') OVER (PARTITION BY uid) AS gone FROM v_snaps) WHERE gone IS NULL OR ts_ns <= gone GROUP BY uid
)"""


@query(f"SELECT uid, kind, first_ns <= {AS_OF} AND (gone IS NULL OR gone > {AS_OF}) AS at_time, gone IS NULL OR gone BETWEEN {START} AND {END} AS inside FROM v_lives", SNAPSHOTS_SQL, _LIVES_SQL)
def visible_resources(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes.build_resources(resource_snapshots(spark, d))
    return rows.select("uid", "kind", validate.visible_at(AS_OF).alias("at_time"), F.coalesce(validate.visible_in_window(START, END), F.lit(False)).alias("inside"))


@query("SELECT namespace, kind, name, (arg_min(uid, (gone IS NOT NULL, uid))) AS uid FROM v_lives WHERE kind IN ('Pod', 'Node') GROUP BY ALL", SNAPSHOTS_SQL, _LIVES_SQL)
def find_resources(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes.build_resources(resource_snapshots(spark, d))
    wanted = resource_snapshots(spark, d).filter(F.col("kind").isin("Pod", "Node")).select("namespace", "kind", "name")
    return validate.find_resources(rows, wanted)


@query("SELECT uid, arg_max(id, (ts_ns, event_id)) AS id, max(ts_ns) AS ts_ns FROM v_snaps GROUP BY uid HAVING count(*) FILTER (type = 'DELETE') = 0", SNAPSHOTS_SQL)
def latest_snapshots(spark: SparkSession, d: str) -> DataFrame:
    """The last snapshot of each resource that isn't deleted, and the event that it came with."""
    rows = resource_snapshots(spark, d)
    return maintain.latest_snapshots(rows).select("uid", "ts_ns").join(rows.select("uid", "ts_ns", "id"), ["uid", "ts_ns"])


@query(f"SELECT uid, max(event_id) AS version FROM v_snaps GROUP BY uid HAVING max(event_id) FILTER (ts_ns < {START}) IS NULL OR max(event_id) > max(event_id) FILTER (ts_ns < {START})", SNAPSHOTS_SQL)
def newer_versions(spark: SparkSession, d: str) -> DataFrame:
    rows = resource_snapshots(spark, d)
    last = lambda df: df.groupBy("uid").agg(F.max(F.col("id").cast("long")).alias("version"))
    return maintain.newer_versions(last(rows.filter(F.col("ts_ns") < START)), last(rows), "version")


@query("SELECT CASE WHEN count(*) FILTER (status = 'Error') > 0 THEN 'Critical' WHEN count(*) FILTER (status = 'Warning') > 0 THEN 'Degraded' ELSE 'Healthy' END AS overall, count(*) AS total, count(*) FILTER (status = 'Error') AS error, count(*) FILTER (status = 'Warning') AS warning FROM (SELECT uid, arg_max(status, (ts_ns, id)) AS status FROM v_events GROUP BY uid)", E_SQL)
def cluster_overall(spark: SparkSession, d: str) -> DataFrame:
    return timeline.cluster_overall(views.resource_events(spark, d)).drop("issues")


_TIMELINE_SQL = """v_asked AS (SELECT DISTINCT 'u' || c_custkey AS uid FROM customer),
v_steps AS (SELECT uid, id, ts_ns, lag(status) OVER w AS from_status, status AS to_status, lag(data::JSON ->> '$.k') OVER w AS a, data::JSON ->> '$.k' AS b FROM v_events WINDOW w AS (PARTITION BY uid ORDER BY ts_ns, id)),
v_shown AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts_ns DESC, id DESC) AS nth FROM v_steps WHERE a IS NOT NULL AND (a <> b OR from_status <> to_status))"""


@query(
    """
    SELECT q.uid, q.uid IN (SELECT uid FROM v_events) AS found, nth::INT AS nth, id, ts_ns, from_status, to_status, CASE WHEN nth IS NOT NULL THEN (a <> b)::INT END AS n_diffs FROM v_asked q LEFT JOIN v_shown s ON q.uid = s.uid AND nth <= 50
    """,
    E_SQL,
    _TIMELINE_SQL,
)
def resource_timeline_changes(spark: SparkSession, d: str) -> DataFrame:
    """For as many uids as there are customers, most of which no event is about."""
    asked = table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("uid"))
    rows = changes.resource_timeline_changes(views.resource_events(spark, d), asked)
    return rows.withColumn("n_diffs", F.when(F.col("nth").isNotNull(), F.size("diffs"))).drop("diffs")


@query("SELECT count(*) AS requested, count(*) FILTER (uid IN (SELECT uid FROM v_events)) AS found, (SELECT count(DISTINCT s.uid) FROM v_shown s JOIN v_asked USING (uid)) AS changed, (SELECT count(*) FROM v_shown s JOIN v_asked USING (uid) WHERE nth <= 50) AS shown FROM v_asked", E_SQL, _TIMELINE_SQL)
def timeline_change_summary(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "customer").select(F.concat(F.lit("u"), "c_custkey").alias("uid"))
    return changes.timeline_change_summary(changes.resource_timeline_changes(views.resource_events(spark, d), asked))


# --- management ------------------------------------------------------------------------------------------------

_LABELS = {kind: rule[0] for kind, rule in management.MANAGERS.items()}
_MANAGES_SQL = f"""
v_managers AS (SELECT 'h' || n_nationkey AS uid, ['HelmRelease', 'Kustomization', 'Application'][n_nationkey % 3 + 1] AS kind, 'flux' AS namespace, 'rel-' || n_nationkey AS name, CASE WHEN n_nationkey % 2 = 0 THEN 'ns' || (n_nationkey % 7) ELSE '' END AS target_ns, {START} + n_nationkey::BIGINT * 10 * {SECOND} AS ts_ns, n_nationkey % 4 = 0 AS reconciled FROM nation),
v_managed AS (SELECT c_custkey AS k, 'c' || c_custkey AS uid, 'ns' || (c_custkey % 7) AS namespace, 'rel-' || (c_custkey % 40) || '-x' AS name, CASE WHEN c_custkey % 5 = 0 THEN 'rel-' || (c_custkey % 25) END AS label, {START} + (c_custkey % 300) * {SECOND} AS first_ns FROM customer WHERE c_custkey % 9 <> 0),
v_pairs AS (
  SELECT m.kind, m.uid AS src, r.uid AS dst, coalesce(m.name = r.label, FALSE) AS matched, (r.first_ns - m.ts_ns) / {SECOND} AS lag, CASE m.kind WHEN 'Application' THEN 120 ELSE 30 END AS span, starts_with(r.name, m.name) AS named, m.target_ns = '' OR m.target_ns = r.namespace AS there, m.reconciled, r.label
  FROM v_managers m, v_managed r
), v_scored AS (
  SELECT src, dst, CASE WHEN matched THEN 1.0 ELSE (CASE WHEN named THEN 0.4 ELSE 0 END + CASE WHEN there THEN CASE kind WHEN 'HelmRelease' THEN 0.1 ELSE 0.3 END ELSE 0 END + 0.3 * (1 - lag / span) + CASE WHEN kind = 'HelmRelease' AND reconciled THEN 0.2 ELSE 0 END) END AS confidence
  FROM v_pairs WHERE matched OR (there AND lag BETWEEN 0 AND span AND (kind <> 'Application' OR label IS NOT NULL))
)"""


@query("SELECT 'MANAGES' AS type, src, dst, round(confidence::DOUBLE, 6) AS confidence FROM v_scored WHERE confidence >= 0.5", _MANAGES_SQL)
def manages(spark: SparkSession, d: str) -> DataFrame:
    """Nations as managers of customers, by label or by name, namespace, time and reconciling."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    kind = F.element_at(F.array(*map(F.lit, ["HelmRelease", "Kustomization", "Application"])), (n % 3 + 1).cast("int"))
    target = F.when(n % 2 == 0, F.concat(F.lit("ns"), n % 7)).otherwise("")
    managers = table(spark, d, "nation").select(F.concat(F.lit("h"), n).alias("uid"), kind.alias("kind"), F.lit("flux").alias("namespace"), F.concat(F.lit("rel-"), n).alias("name"), target.alias("target_ns"), (F.lit(START) + n.cast("long") * 10 * SECOND).alias("ts_ns"), (n % 4 == 0).alias("reconciled"))
    marked = F.concat(F.lit("rel-"), k % 25)
    pairs = [x for name, namespace in _LABELS.values() for x in (F.lit(name), marked, *((F.lit(namespace), F.lit("flux")) if namespace else ()))]
    labels = F.when(k % 5 == 0, F.create_map(*pairs)).otherwise(F.create_map().cast("map<string,string>"))
    customers = table(spark, d, "customer")
    resources = customers.select(F.concat(F.lit("c"), k).alias("uid"), F.lit("Deployment").alias("kind"), F.concat(F.lit("ns"), k % 7).alias("namespace"), F.concat(F.lit("rel-"), k % 40, F.lit("-x")).alias("name"), labels.alias("labels"), (F.lit(START) + (k % 300) * SECOND).alias("first_ns"))
    owned = customers.filter(k % 9 == 0).select(F.concat(F.lit("c"), k).alias("dst"))
    return management.manages(managers, resources, owned).select("type", "src", "dst", F.round("confidence", 6).alias("confidence"))


@query(
    f"""
    WITH c AS (SELECT 'cert' || s_suppkey AS uid, 'ns' || (s_suppkey % 7) AS ns, 'x-' || (s_suppkey % 30) AS name, 'x-' || (s_suppkey % 30) || '-tls' AS secret_name, {START} + s_suppkey * {SECOND} AS t FROM supplier),
    s AS (SELECT 'sec' || c_custkey AS uid, 'ns' || (c_custkey % 7) AS ns, 'x-' || (c_custkey % 40) || CASE WHEN c_custkey % 2 = 0 THEN '-tls' ELSE '-other' END AS name, {START} + (c_custkey % 500) * {SECOND} AS t FROM customer),
    p AS (SELECT c.uid AS src, s.uid AS dst, CASE WHEN s.name = c.secret_name THEN 0.5 ELSE 0.2 END + 0.2 + CASE WHEN s.t - c.t BETWEEN 0 AND {300 * SECOND} THEN 0.3 * (1 - (s.t - c.t) / (300.0 * {SECOND})) ELSE 0 END AS confidence FROM c JOIN s ON c.ns = s.ns AND (s.name = c.secret_name OR starts_with(s.name, c.name)))
    SELECT 'CREATES_OBSERVED' AS type, src, dst, round(confidence::DOUBLE, 6) AS confidence FROM p WHERE confidence >= 0.5
    """
)
def creates_observed(spark: SparkSession, d: str) -> DataFrame:
    s, k = F.col("s_suppkey"), F.col("c_custkey")
    name = F.concat(F.lit("x-"), s % 30)
    certificates = table(spark, d, "supplier").select(F.concat(F.lit("cert"), s).alias("uid"), F.concat(F.lit("ns"), s % 7).alias("namespace"), name.alias("name"), F.concat(name, F.lit("-tls")).alias("secret_name"), (F.lit(START) + s * SECOND).alias("ts_ns"))
    secrets = table(spark, d, "customer").select(F.concat(F.lit("sec"), k).alias("uid"), F.concat(F.lit("ns"), k % 7).alias("namespace"), F.concat(F.lit("x-"), k % 40, F.when(k % 2 == 0, "-tls").otherwise("-other")).alias("name"), (F.lit(START) + (k % 500) * SECOND).alias("first_ns"))
    return management.creates_observed(certificates, secrets).withColumn("confidence", F.round("confidence", 6))


def _scored(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Scored edges from nations to customers, and both as resources."""
    k = F.col("c_custkey")
    customers, uid = table(spark, d, "customer"), lambda p, c: F.concat(F.lit(p), F.col(c))
    item = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.cast("string").alias("value"), F.lit(0.1).alias("weight"))
    evidence = F.when(k % 4 == 0, F.array(item("namespace", F.lit("")))).when(k % 4 == 1, F.array(item("label", k % 5))).when(k % 4 == 2, F.array(item("ownership", F.lit("")))).otherwise(F.array().cast(management.EVIDENCE))
    edges = customers.select(uid("n", "c_nationkey").alias("src"), uid("c", "c_custkey").alias("dst"), F.when(k % 3 == 0, 1.0).when(k % 3 == 1, 0.8).otherwise(0.12).alias("confidence"), evidence.alias("evidence"), (F.lit(AS_OF) - (k % 200) * HOUR).alias("validated_ns"))
    owners = F.when(k % 8 == 2, F.array(uid("n", "c_nationkey"))).otherwise(F.array(F.lit("other")))
    resources = customers.select(uid("c", "c_custkey").alias("uid"), F.concat(F.lit("ns"), k % 3).alias("namespace"), (k % 10 == 0).alias("deleted"), F.create_map(F.lit("x"), (k % 7).cast("string")).alias("labels"), owners.alias("owners"))
    nations = table(spark, d, "nation").select(uid("n", "n_nationkey").alias("uid"), F.concat(F.lit("ns"), F.col("n_nationkey") % 3).alias("namespace"), F.lit(False).alias("deleted"), F.create_map().cast("map<string,string>").alias("labels"), F.array().cast("array<string>").alias("owners"))
    resources = resources.union(nations)
    return edges, resources


@query(
    """
    SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst, round((CASE WHEN c >= 1 THEN c WHEN h > 24 THEN greatest(0.1, c * 0.7) WHEN h > 6 THEN greatest(0.1, c * 0.9) ELSE c END)::DOUBLE, 6) AS confidence,
      CASE WHEN h > 168 THEN 'stale' WHEN h <= 1 THEN 'pending' WHEN (c_custkey % 4 = 0 AND c_custkey % 3 <> c_nationkey % 3) OR (c_custkey % 4 = 1 AND c_custkey % 5 <> c_custkey % 7) OR (c_custkey % 4 = 2 AND c_custkey % 8 <> 2) THEN 'invalid' ELSE 'valid' END AS state
    FROM (SELECT *, c_custkey % 200 AS h, [1.0, 0.8, 0.12][c_custkey % 3 + 1] AS c FROM customer WHERE c_custkey % 10 <> 0)
    """
)
def revalidated(spark: SparkSession, d: str) -> DataFrame:
    return management.revalidated(*_scored(spark, d), AS_OF).withColumn("confidence", F.round("confidence", 6))


@query("SELECT 'n' || c_nationkey AS src, 'c' || c_custkey AS dst FROM customer WHERE c_custkey % 200 > 100")
def stale_edges(spark: SparkSession, d: str) -> DataFrame:
    return management.stale_edges(_scored(spark, d)[0], AS_OF - 100 * HOUR).select("src", "dst")


# --- incidents -------------------------------------------------------------------------------------------------

_INCIDENTS_SQL = """v_incidents AS (
  SELECT 'i' || o_orderkey AS incident_id, 'o' || o_orderkey AS o, 'c' || c_custkey AS c, 'n' || n_nationkey AS n, 'r' || n_regionkey AS r, c_custkey, n_nationkey
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 300000
)"""


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "orders").filter("o_totalprice > 300000")
    return rows.select(F.concat(F.lit("i"), "o_orderkey").alias("incident_id"), F.concat(F.lit("o"), "o_orderkey").alias("uid"), F.lit(START).alias("t_ns"))


def _line(spark: SparkSession, d: str) -> DataFrame:
    return incident.spine(views.relation_edges(spark, d).withColumn("confidence", F.lit(1.0)), _incidents(spark, d))


@query("SELECT incident_id, unnest([r, n, c, o]) AS uid, 'owner' AS role, unnest([3, 2, 1, 0])::INT AS distance, unnest([1, 2, 3, 4])::INT AS step FROM v_incidents", _INCIDENTS_SQL)
def incident_spine(spark: SparkSession, d: str) -> DataFrame:
    return _line(spark, d)


@query(
    f"""
    SELECT incident_id, CASE WHEN n_nationkey % 2 = 0 THEN n ELSE c END AS uid, CASE WHEN n_nationkey % 2 = 0 THEN 'en' || n_nationkey ELSE 'ec' || c_custkey END AS id, CASE WHEN n_nationkey % 2 = 0 THEN 2 ELSE 3 END::INT AS step,
      CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey ELSE c_custkey END * 1000 AS lag_ms, CASE WHEN n_nationkey % 2 = 0 THEN 'ConfigChange' WHEN c_custkey % 3 = 0 THEN 'Deletion' WHEN c_custkey % 3 = 1 THEN 'Creation' ELSE 'StateChange' END AS causation
    FROM v_incidents
    """,
    _INCIDENTS_SQL,
)
def incident_root(spark: SparkSession, d: str) -> DataFrame:
    """Even nations have a config change, all customers an event, before the incidents."""
    n, k = F.col("n_nationkey"), F.col("c_custkey")
    event = lambda df, uid, id_, key, kind, config: df.select(uid.alias("uid"), id_.alias("id"), (F.lit(START) - key.cast("long") * SECOND).alias("ts_ns"), kind.alias("event_type"), config.alias("config_changed"))
    of_nations = event(table(spark, d, "nation").filter(n % 2 == 0), F.concat(F.lit("n"), n), F.concat(F.lit("en"), n), n, F.lit("UPDATE"), F.lit(True))
    kind = F.element_at(F.array(*map(F.lit, ["DELETE", "CREATE", "UPDATE"])), (k % 3 + 1).cast("int"))
    of_customers = event(table(spark, d, "customer"), F.concat(F.lit("c"), k), F.concat(F.lit("ec"), k), k, kind, F.lit(False))
    return incident.root_cause(_line(spark, d), of_nations.union(of_customers), _incidents(spark, d))


@query("SELECT incident_id, 'Region/' || r || ' -> Nation/' || n || ' -> Customer/' || c || ' -> Order/' || o AS explanation FROM v_incidents", _INCIDENTS_SQL)
def incident_explanation(spark: SparkSession, d: str) -> DataFrame:
    line = _line(spark, d)
    kind = F.element_at(F.create_map(*[F.lit(x) for kv in {"r": "Region", "n": "Nation", "c": "Customer", "o": "Order"}.items() for x in kv]), F.substring("uid", 1, 1))
    names = line.select("uid", kind.alias("kind"), F.col("uid").alias("name")).distinct()
    return incident.explanation(line, names)


@query("SELECT uid, count(*)::INT AS n, arg_min(reason, ts_ns) AS first, min(ts_ns) AS first_ns FROM v_warnings GROUP BY uid", WARNINGS_SQL)
def with_warnings(spark: SparkSession, d: str) -> DataFrame:
    """The warning events of each resource."""
    warnings = nodes.build_k8s_events(warning_snapshots(spark, d)).withColumnRenamed("uid", "involved_uid")
    uids = views.resource_events(spark, d).select("uid").distinct()
    rows = timeline.with_warnings(uids, warnings)
    return rows.select("uid", F.size("warnings").alias("n"), F.get("warnings", F.lit(0))["reason"].alias("first"), F.get("warnings", F.lit(0))["ts_ns"].alias("first_ns"))


@query("SELECT kind, name, uid, (SELECT count(DISTINCT uid) FROM v_events WHERE namespace = 'ns2' AND (kind, name) > ('Deployment', 'name-1')) > 5 AS has_more FROM (SELECT DISTINCT kind, name, uid FROM v_events WHERE namespace = 'ns2' AND (kind, name) > ('Deployment', 'name-1')) ORDER BY kind, name LIMIT 5", E_SQL)
def namespace_page(spark: SparkSession, d: str) -> DataFrame:
    """A page of a namespace's resources after a cursor of kind and name."""
    rows = views.resource_events(spark, d).filter("namespace = 'ns2'").select("kind", "name", "uid").distinct()
    return timeline.page(rows, ["kind", "name"], ("Deployment", "name-1"), 5)


@query("SELECT DISTINCT kind, namespace, name, uid FROM v_events", E_SQL)
def grouped_by_kind(spark: SparkSession, d: str) -> DataFrame:
    return timeline.grouped_by_kind(views.resource_events(spark, d).select("kind", "namespace", "name", "uid").distinct())


@query(
    """
    SELECT id, CASE WHEN issues = 'OOMKilled' THEN 'OOMKilled' WHEN issues = 'CrashLoopBackOff' THEN 'CrashLoop' WHEN issues = 'ImagePullBackOff' THEN 'ImagePullError' WHEN event_id % 4 = 1 THEN 'SchedulingFailure' WHEN event_id % 4 = 2 THEN 'Timeout'
      WHEN status = 'Error' THEN 'Error' WHEN status = 'Warning' THEN 'Degraded' WHEN status = 'Terminating' THEN 'Terminating' ELSE 'Unknown' END AS symptom FROM v_snaps
    """,
    SNAPSHOTS_SQL,
)
def symptom_types(spark: SparkSession, d: str) -> DataFrame:
    rows = nodes.build_change_events(resource_snapshots(spark, d))
    message = F.element_at(F.array(*map(F.lit, ["", "0/3 nodes: Insufficient cpu", "deadline exceeded", "odd"])), (F.col("id").cast("long") % 4 + 1).cast("int"))
    return rows.select("id", incident.symptom_type(F.col("issues"), message, F.col("status")).alias("symptom"))


@query(
    """
    SELECT o_orderkey AS o, round((0.35 * (o_orderkey % 2) + 0.3 * greatest(0, 1 - (o_orderkey % 700) / 600.0) + 0.2 * [1.0, 0.8, 0.7, 0.5][o_orderkey % 4 + 1] + 0.05 * (o_orderkey % 5 = 0)::INT + 0.1 * least(1.0, (o_orderkey % 6) / 3.0))::DOUBLE, 6) AS score FROM orders
    """
)
def incident_confidence(spark: SparkSession, d: str) -> DataFrame:
    o = F.col("o_orderkey")
    relation = F.element_at(F.array(*map(F.lit, ["OWNS", "MANAGES", "TRIGGERED_BY", "OTHER"])), (o % 4 + 1).cast("int"))
    return table(spark, d, "orders").select(o.alias("o"), incident.confidence(o % 2 == 1, (o % 700) * 1000, relation, o % 5 == 0, o % 6)["score"].alias("score"))


@query("SELECT 'n' || n_nationkey AS uid, 'in' AS direction, 'OWNS' AS type, 'r' || n_regionkey AS other FROM nation")
def resource_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The neighbours of all nations that are regions."""
    uids = table(spark, d, "nation").select(F.concat(F.lit("n"), "n_nationkey").alias("uid"))
    regions = table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("uid"))
    return traverse.neighbours(views.relation_edges(spark, d), uids, regions)


@query(f"SELECT id, ts_ns, status FROM v_events WHERE uid = 'u1' AND ts_ns BETWEEN {START} AND {END}", E_SQL)
def events_of(spark: SparkSession, d: str) -> DataFrame:
    return traverse.events_of(views.resource_events(spark, d), "u1", START, END).select("id", "ts_ns", "status")


# --- metrics and alerts ----------------------------------------------------------------------------------------


@query("SELECT 'a' || (user_id % 20) AS alert, ['normal', 'pending', 'firing'][max(CASE event_type WHEN 'error' THEN 2 WHEN 'click' THEN 1 ELSE 0 END) + 1] AS state FROM (SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type FROM events GROUP BY user_id) GROUP BY user_id % 20")
def rolled_up_alerts(spark: SparkSession, d: str) -> DataFrame:
    """Users as instances of twenty alerts, in their last state."""
    last = views.alert_states(spark, d).groupBy("alert").agg(F.max_by("state", F.struct("ts_ns", "seq")).alias("state"))
    return alerts.rolled_up(last.select(F.concat(F.lit("a"), F.substring("alert", 2, 20).cast("long") % 20).alias("alert"), F.col("alert").alias("instance"), "state"))


@query(f"SELECT alert, from_state, to_state, ts_ns FROM v_transitions WHERE ts_ns BETWEEN {START} AND {END}", A_SQL)
def transitions_between(spark: SparkSession, d: str) -> DataFrame:
    moves = alerts.transitions(views.alert_states(spark, d), keep_days=10_000)
    return alerts.transitions_between(moves, START, END).drop("seq")


@query(f"SELECT alert, arg_max(to_state, (ts_ns, seq)) AS state, max(ts_ns) AS since_ns FROM v_transitions WHERE ts_ns <= {AS_OF} GROUP BY alert", A_SQL)
def current_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.current_states(alerts.transitions(views.alert_states(spark, d), keep_days=10_000), AS_OF)


@query("SELECT series, metric, hour, day_type, n FROM (SELECT 's' || user_id AS series, event_type AS metric, hour(ts)::INT AS hour, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-18' AND ts < TIMESTAMP '2024-01-25' GROUP BY ALL HAVING count(*) >= 3) UNION SELECT 'old', 'm', 1, 'weekday', 9")
def upserted_baselines(spark: SparkSession, d: str) -> DataFrame:
    """Fresh baselines into a table that has them with other numbers, one that stays and one that has expired."""
    at = F.lit("2024-01-25").cast("timestamp")
    fresh = metrics.baselines(views.metric_points(spark, d), at)
    kept = spark.range(1).select(F.lit("old").alias("series"), F.lit("m").alias("metric"), F.lit(1).alias("hour"), F.lit("weekday").alias("day_type"), F.lit(1.0).alias("mean"), F.lit(1.0).alias("stddev"), F.lit(9).cast("long").alias("n"), (at + F.expr("interval 1 hour")).alias("expires_at"))
    expired = kept.withColumn("series", F.lit("gone")).withColumn("expires_at", at)
    held = fresh.withColumn("n", F.lit(0).cast("long")).unionByName(kept).unionByName(expired)
    return metrics.upsert_baselines(held, fresh, at).select("series", "metric", "hour", "day_type", "n")


@query("SELECT count(*) FILTER (n <= 3) AS skipped, count(*) AS series FROM (SELECT count(*) AS n FROM events WHERE ts <= TIMESTAMP '2024-01-05' GROUP BY user_id, event_type)")
def skipped_series(spark: SparkSession, d: str) -> DataFrame:
    return metrics.skipped(views.metric_points(spark, d), F.lit("2024-01-05").cast("timestamp"))


@query("SELECT event_type AS metric, epoch_us(time_bucket(INTERVAL 6 HOUR, ts)) AS start_us, round(avg(value), 6) AS mean, min(value) AS least, max(value) AS most, count(*) AS n FROM events WHERE user_id % 4 = 1 GROUP BY ALL")
def aggregated_metrics(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    points = e.select(F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), "value", F.create_map(F.lit("cluster"), (F.col("user_id") % 4).cast("string")).alias("labels"))
    rows = metrics.aggregated(points, 6 * 3600, cluster="1")
    return rows.select("metric", F.unix_micros("start").alias("start_us"), F.round("mean", 6).alias("mean"), "least", "most", "n")


def _share(column: Column) -> Column:
    return F.round(column, 6)


@query(f"SELECT alert, round(abs(share - 0.25) / 0.5, 6) AS deviation FROM (SELECT alert, count(*) FILTER (state = 'firing') / count(*) AS share FROM v_states WHERE ts_ns BETWEEN {AS_OF - DAY} AND {AS_OF} GROUP BY alert)", A_SQL)
def alert_deviation(spark: SparkSession, d: str) -> DataFrame:
    rows = views.alert_states(spark, d).filter(F.col("ts_ns").between(AS_OF - DAY, AS_OF)).groupBy("alert").agg((F.count_if(F.col("state") == "firing") / F.count("*")).alias("share"))
    return rows.select("alert", _share(alerts.deviation(F.col("share"), F.lit(0.25), F.lit(0.5))).alias("deviation"))
