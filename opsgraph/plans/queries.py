"""Queries over the driver's tables and the SQL that they are compared with."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.functions import validate
from opsgraph.functions.facts import label_match
from opsgraph.operators import alerts, anomaly, causal, changes, logs, metrics, significance, timeline, traverse
from opsgraph.plans import causality, maintain, nodes
from opsgraph.plans.edges import selector_edges
from opsgraph.sources import views
from opsgraph.sources.views import ALERT_STATES_SQL, LOG_LINES_SQL, RELATION_EDGES_SQL, RESOURCE_EVENTS_SQL, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}

DAY = 86_400_000_000_000
HOUR = 3_600_000_000_000
#: 2024-01-10, -20 and -25, inside the events of the tables.
START = 1_704_844_800_000_000_000
END = START + 10 * DAY
AS_OF = START + 15 * DAY


def query(sql: str = "", *views_: str) -> Callable[[Query], Query]:
    """Registers a query under its function's name; views_: common tables that its SQL starts with."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            body = sql.strip()
            start = next((w for w in ("WITH RECURSIVE ", "WITH ") if body.upper().startswith(w)), "")
            head = (start or "WITH ") + ", ".join(v.strip() for v in views_) if views_ else ""
            if start:
                body = body[len(start) :]
                head = head + ", " if head else start
            ORACLE_SQL[f.__name__] = f"{head}{'' if head.endswith((', ', 'WITH ', 'RECURSIVE ')) or not head else ' '}{body}"
        return f

    return add


def _events(spark: SparkSession, d: str) -> DataFrame:
    return views.resource_events(spark, d)


E_SQL, R_SQL, L_SQL, A_SQL = RESOURCE_EVENTS_SQL, RELATION_EDGES_SQL, LOG_LINES_SQL, ALERT_STATES_SQL


# --- timelines -------------------------------------------------------------------------------------------------


@query(
    """
    WITH cur AS (SELECT uid, arg_max(kind, (ts_ns, id)) AS kind, arg_max(namespace, (ts_ns, id)) AS namespace, arg_max(name, (ts_ns, id)) AS name, arg_max(status, (ts_ns, id)) AS status FROM v_events GROUP BY uid),
    named AS (SELECT kind, list_sort(list(DISTINCT namespace || '/' || name) FILTER (status = 'Error')) AS names FROM cur GROUP BY kind)
    SELECT kind, count(*) AS total, count(*) FILTER (status = 'Ready') AS ready, count(*) FILTER (status = 'Warning') AS warning, count(*) FILTER (status = 'Error') AS error,
      count(*) FILTER (status = 'Terminating') AS terminating, count(*) FILTER (status = 'Unknown') AS unknown,
      round((count(*) FILTER (status = 'Error') + count(*) FILTER (status = 'Warning')) / count(*), 6) AS error_rate,
      any_value(coalesce(array_to_string(names[1:20], ', '), '') || CASE WHEN len(names) > 20 THEN ' (+' || (len(names) - 20) || ' more)' ELSE '' END) AS in_error,
      CASE WHEN count(*) FILTER (status = 'Error') > 0 THEN 'Critical' WHEN count(*) FILTER (status = 'Warning') > 0 THEN 'Degraded' ELSE 'Healthy' END AS overall
    FROM cur JOIN named USING (kind) GROUP BY kind
    """,
    E_SQL,
)
def cluster_health(spark: SparkSession, d: str) -> DataFrame:
    return timeline.cluster_health(_events(spark, d))


SEGMENTS_SQL = """segments AS (
  SELECT uid, kind, namespace, name, id, ts_ns AS start_ns, coalesce(lead(ts_ns) OVER (PARTITION BY uid ORDER BY ts_ns, id), (SELECT max(ts_ns) FROM v_events)) AS end_ns, status, message FROM v_events
)"""


@query("SELECT * FROM segments", E_SQL, SEGMENTS_SQL)
def status_segments(spark: SparkSession, d: str) -> DataFrame:
    return timeline.status_segments(_events(spark, d))


@query(
    """
    WITH f AS (SELECT *, CASE WHEN lag((status, message)) OVER w IS DISTINCT FROM (status, message) THEN 1 ELSE 0 END AS n FROM segments WINDOW w AS (PARTITION BY uid ORDER BY start_ns, id)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY uid ORDER BY start_ns, id ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM f)
    SELECT uid, island, status, message, min(start_ns) AS start_ns, max(end_ns) AS end_ns, count(*) AS n_events, max(end_ns) - min(start_ns) AS duration_ns FROM g GROUP BY ALL
    """,
    E_SQL,
    SEGMENTS_SQL,
)
def merge_segments(spark: SparkSession, d: str) -> DataFrame:
    return timeline.merge_segments(timeline.status_segments(_events(spark, d)))


@query(
    f"""
    WITH i AS (SELECT * FROM v_events WHERE ts_ns BETWEEN {START} AND {END}),
    f AS (SELECT *, CASE WHEN lag(status) OVER w IS DISTINCT FROM status THEN 1 ELSE 0 END AS n FROM i WINDOW w AS (PARTITION BY uid ORDER BY ts_ns, id)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY uid ORDER BY ts_ns, id ROWS UNBOUNDED PRECEDING) AS island FROM f),
    r AS (SELECT uid, island, status, min(ts_ns) AS start_ns, coalesce(arg_max(message, (ts_ns, id)) FILTER (message <> ''), '') AS message FROM g GROUP BY ALL)
    SELECT uid, status, message, start_ns, coalesce(lead(start_ns) OVER (PARTITION BY uid ORDER BY island), {END}) AS end_ns FROM r
    """,
    E_SQL,
)
def coalesced_status(spark: SparkSession, d: str) -> DataFrame:
    return timeline.coalesced_status(_events(spark, d), START, END)


@query(
    f"""
    SELECT uid, {START}::BIGINT AS start_ns, min(ts_ns) FILTER (ts_ns >= {START}) AS end_ns, coalesce(arg_max(status, (ts_ns, id)) FILTER (ts_ns < {START}), 'Unknown') AS status
    FROM v_events GROUP BY uid HAVING min(ts_ns) FILTER (ts_ns >= {START}) > {START}
    """,
    E_SQL,
)
def leading_segments(spark: SparkSession, d: str) -> DataFrame:
    return timeline.leading_segments(_events(spark, d), START)


@query(f"SELECT uid, min(ts_ns) < {START} AS pre_existing FROM v_events GROUP BY uid", E_SQL)
def pre_existing(spark: SparkSession, d: str) -> DataFrame:
    return timeline.pre_existing(_events(spark, d), START)


@query(
    f"""
    WITH n AS (SELECT *, ts_ns < {START} AS prior, row_number() OVER (PARTITION BY uid, ts_ns < {START} ORDER BY ts_ns DESC, id DESC) AS nth FROM v_events WHERE ts_ns <= {END}),
    k AS (SELECT *, max((NOT prior)::INT) OVER (PARTITION BY uid) AS inside FROM n WHERE NOT prior OR nth = 1)
    SELECT id, uid, kind, namespace, name, type, ts_ns, status, message, data, value, prior FROM k WHERE inside = 1 OR type <> 'DELETE'
    """,
    E_SQL,
)
def timeline_asof(spark: SparkSession, d: str) -> DataFrame:
    return timeline.timeline(_events(spark, d), START, END)


@query(
    """
    WITH r AS (SELECT DISTINCT kind, namespace, name, uid FROM v_events WHERE (kind, namespace, name) > ('Node', 'ns2', 'name-2')),
    t AS (SELECT *, row_number() OVER (ORDER BY kind, namespace, name) AS nth FROM r)
    SELECT kind, namespace, name, uid, (SELECT count(*) FROM r) > 20 AS has_more FROM t WHERE nth <= 20
    """,
    E_SQL,
)
def timeline_page(spark: SparkSession, d: str) -> DataFrame:
    return timeline.page(_events(spark, d).select("kind", "namespace", "name", "uid").distinct(), ["kind", "namespace", "name"], ("Node", "ns2", "name-2"), 20)


@query(
    """
    WITH t AS (SELECT uid, lag(status) OVER (PARTITION BY uid ORDER BY ts_ns, id) AS from_status, status AS to_status, ts_ns, message AS reason FROM v_events)
    SELECT * FROM t WHERE from_status <> to_status
    """,
    E_SQL,
)
def status_transitions(spark: SparkSession, d: str) -> DataFrame:
    return timeline.status_transitions(_events(spark, d))


@query(
    f"""
    WITH c AS (SELECT *, CASE WHEN lag(status) OVER (PARTITION BY uid ORDER BY ts_ns, id) IS DISTINCT FROM status THEN ts_ns END AS changed FROM v_events),
    s AS (SELECT uid, arg_max(kind, (ts_ns, id)) AS kind, arg_max(status, (ts_ns, id)) AS status, arg_max(message, (ts_ns, id)) AS message, {AS_OF} - max(changed) AS for_ns, count(*) AS n_events FROM c GROUP BY uid)
    SELECT uid, kind, status, message, for_ns, n_events FROM s WHERE status IN ('Error', 'Warning') ORDER BY for_ns DESC, n_events DESC, uid LIMIT 10
    """,
    E_SQL,
)
def top_issues(spark: SparkSession, d: str) -> DataFrame:
    return timeline.top_issues(_events(spark, d), AS_OF)


@query(
    """
    WITH r AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts_ns DESC, id DESC) AS nth FROM v_events)
    SELECT uid, nth, id, ts_ns, status, CASE WHEN length(message) > 512 THEN left(message, 256) || '...' || right(message, 256) ELSE message END AS message FROM r WHERE nth <= 25
    """,
    E_SQL,
)
def resource_summary(spark: SparkSession, d: str) -> DataFrame:
    return timeline.resource_summary(_events(spark, d))


INCIDENTS_SQL = "v_incidents AS (SELECT 'i' || uid AS incident_id, uid, max(ts_ns) AS t_ns FROM v_events WHERE status = 'Error' GROUP BY uid)"


def _incidents(spark: SparkSession, d: str) -> DataFrame:
    """Each resource's last error as an incident."""
    return _events(spark, d).filter("status = 'Error'").groupBy("uid").agg(F.max("ts_ns").alias("t_ns")).select(F.concat(F.lit("i"), F.col("uid")).alias("incident_id"), "uid", "t_ns")


@query(
    f"""
    WITH e AS (SELECT *, status = 'Warning' AS config_changed FROM v_events),
    n AS (SELECT e.*, incident_id, t_ns, row_number() OVER (PARTITION BY incident_id, uid, config_changed ORDER BY ts_ns DESC, id DESC) AS nth FROM e JOIN v_incidents USING (uid) WHERE ts_ns BETWEEN t_ns - {2 * DAY} AND t_ns)
    SELECT incident_id, uid, id, ts_ns, status FROM n WHERE config_changed OR nth <= 10
    """,
    E_SQL,
    INCIDENTS_SQL,
)
def select_events(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).withColumn("config_changed", F.col("status") == "Warning")
    return timeline.select_events(events, _incidents(spark, d), 2 * DAY).select("incident_id", "uid", "id", "ts_ns", "status")


@query("WITH n AS (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY ts_ns DESC, id DESC) AS nth FROM v_events) SELECT uid, id, ts_ns FROM n WHERE nth <= 20", E_SQL)
def select_k8s_events(spark: SparkSession, d: str) -> DataFrame:
    return timeline.newest_per_uid(_events(spark, d).select("uid", "id", "ts_ns"))


@query(
    f"""
    WITH w AS (SELECT 'w' || uid AS incident_id, uid, {START} + 3 * {DAY} AS t_ns FROM (SELECT DISTINCT uid FROM v_events)),
    j AS (SELECT incident_id, w.uid, t_ns, id, ts_ns, status, abs(ts_ns - t_ns) AS gap FROM w LEFT JOIN v_events USING (uid)),
    n AS (SELECT incident_id, uid, t_ns, min(ts_ns) AS first_ns, min((gap, ts_ns, id, status)) FILTER (gap <= {6 * HOUR}) AS near FROM j GROUP BY ALL)
    SELECT incident_id, uid, near[3] AS id, near[2] AS ts_ns, near[4] AS status, CASE WHEN near IS NOT NULL THEN '' WHEN first_ns IS NULL THEN 'no events' WHEN first_ns > t_ns THEN 'first event is later' ELSE 'first event is earlier' END AS hint FROM n
    """,
    E_SQL,
)
def closest_event(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    wanted = events.select("uid").distinct().select(F.concat(F.lit("w"), F.col("uid")).alias("incident_id"), "uid", F.lit(START + 3 * DAY).alias("t_ns"))
    return timeline.closest_event(events, wanted, 6 * HOUR)


@query(f"SELECT uid, max(ts_ns) AS ts_ns, arg_max(id, (ts_ns, id)) AS id, arg_max(type, (ts_ns, id)) AS type, arg_max(status, (ts_ns, id)) AS status, arg_max(data, (ts_ns, id)) AS data FROM v_events WHERE ts_ns <= {END} GROUP BY uid", E_SQL)
def latest_event_at(spark: SparkSession, d: str) -> DataFrame:
    return timeline.latest_event_at(_events(spark, d), END)


@query(
    f"""
    WITH e AS (SELECT *, status = 'Warning' AS cfg, status = 'Error' AS chg FROM v_events),
    p AS (SELECT uid, min((ts_ns, id)) FILTER (cfg) AS c, min((ts_ns, id)) FILTER (type = 'CREATE') AS n, min((abs(ts_ns - {END}), ts_ns, id)) FILTER (chg) AS s, min((ts_ns, id)) AS f FROM e GROUP BY uid)
    SELECT uid, coalesce(c[2], n[2], s[3], f[2]) AS id, coalesce(c[1], n[1], s[2], f[1]) AS ts_ns FROM p
    """,
    E_SQL,
)
def primary_event(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).withColumns({"config_changed": F.col("status") == "Warning", "status_changed": F.col("status") == "Error"})
    return timeline.primary_event(events, F.lit(END))


@query("SELECT array_to_string(list_sort(list(DISTINCT namespace)), ',') AS namespaces, array_to_string(list_sort(list(DISTINCT kind)), ',') AS kinds, min(ts_ns) AS min_ns, max(ts_ns) AS max_ns FROM v_events", E_SQL)
def distinct_metadata(spark: SparkSession, d: str) -> DataFrame:
    return timeline.distinct_metadata(_events(spark, d))


@query(f"SELECT DISTINCT uid, kind, namespace, name FROM v_events WHERE ts_ns BETWEEN {START} AND {END}", E_SQL)
def search_resources(spark: SparkSession, d: str) -> DataFrame:
    return timeline.search_resources(_events(spark, d), START, END)


@query(
    """
    WITH a AS (SELECT count(*) AS events_a, count(DISTINCT uid) AS resources_a FROM v_events), b AS (SELECT count(*) AS events_b, count(DISTINCT uid) AS resources_b FROM v_events WHERE status <> 'Error')
    SELECT *, events_b - events_a AS event_delta, resources_b - resources_a AS resource_delta, round((events_a - abs(events_b - events_a)) / events_a, 6) AS accuracy, events_a = events_b AND resources_a = resources_b AS match FROM a, b
    """,
    E_SQL,
)
def compare_results(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    return timeline.compare_results(events, events.filter("status != 'Error'"))


@query(
    """
    WITH f AS (SELECT *, CASE WHEN lag(status) OVER w IS DISTINCT FROM status THEN 1 ELSE 0 END AS n FROM v_events WINDOW w AS (PARTITION BY uid ORDER BY ts_ns, id)),
    g AS (SELECT *, sum(n) OVER (PARTITION BY uid ORDER BY ts_ns, id ROWS UNBOUNDED PRECEDING) AS island FROM f),
    r AS (SELECT uid, island, status, min(ts_ns) AS a FROM g GROUP BY ALL), e AS (SELECT *, lead(a) OVER (PARTITION BY uid ORDER BY island) AS b FROM r),
    m AS (SELECT *, (b - a) // 60000000000 AS mins FROM e),
    t AS (SELECT uid, island, status || CASE WHEN b IS NULL THEN '' ELSE '(' || CASE WHEN mins < 1 THEN '< 1m' WHEN mins < 60 THEN mins::BIGINT || 'm'
      WHEN mins < 1440 THEN (mins // 60)::BIGINT || 'h' || CASE WHEN mins % 60 = 0 THEN '' ELSE ' ' || (mins % 60)::BIGINT || 'm' END
      ELSE (mins // 1440)::BIGINT || 'd' || CASE WHEN (mins // 60) % 24 = 0 THEN '' ELSE ((mins // 60) % 24)::BIGINT || 'h' END END || ')' END AS x FROM m)
    SELECT uid, 'Ready' AS condition, string_agg(x, ' -> ' ORDER BY island) AS history FROM t GROUP BY uid
    """,
    E_SQL,
)
def condition_history(spark: SparkSession, d: str) -> DataFrame:
    return timeline.condition_history(_events(spark, d).withColumn("condition", F.lit("Ready")))


# --- checks and filters ----------------------------------------------------------------------------------------


def _nested(spark: SparkSession, d: str) -> DataFrame:
    """The events as incoming ones: a few lack an id, a uid, or data."""
    e = _events(spark, d)
    number = F.col("id").cast("long")
    blank = lambda c, k: F.when(number % k == 0, "").otherwise(F.col(c))
    resource = F.struct(F.lit("apps").alias("group"), F.lit("v1").alias("version"), F.col("kind"), F.col("namespace"), F.col("name"), blank("uid", 11).alias("uid"), F.lit("").alias("involvedObjectUid"))
    return e.select(blank("id", 13).alias("id"), F.col("ts_ns").alias("timestamp"), "type", resource.alias("resource"), F.when(number % 17 == 0, None).otherwise(F.col("data")).alias("data"), F.length("data").alias("dataSize"), (F.length("data") - F.col("id").cast("long") % 5 + 2).cast("int").alias("compressedSize"), number.alias("seq"))


REASON_SQL = """v_reasons AS (
  SELECT id::BIGINT AS seq, CASE WHEN id::BIGINT % 13 = 0 THEN 'id is empty' WHEN id::BIGINT % 11 = 0 THEN 'uid is empty' WHEN id::BIGINT % 17 = 0 THEN 'data is empty' WHEN 2 - id::BIGINT % 5 > 0 THEN 'compressed size exceeds size' END AS reason FROM v_events
)"""


@query("SELECT * FROM v_reasons", E_SQL, REASON_SQL)
def validate_events(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate_strict(_nested(spark, d)).select("seq", "reason")


@query("SELECT count(*) AS total, count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason IS NOT NULL) AS invalid FROM v_reasons", E_SQL, REASON_SQL)
def validation_summary(spark: SparkSession, d: str) -> DataFrame:
    return validate.validation_summary(_nested(spark, d))


@query("SELECT id::BIGINT AS seq FROM v_events WHERE id::BIGINT % 13 <> 0", E_SQL)
def validate_import(spark: SparkSession, d: str) -> DataFrame:
    return validate.validate_import(_nested(spark, d)).select("seq")


@query("SELECT id, uid FROM v_events WHERE kind IN ('Pod', 'Node') AND namespace IN ('ns1', 'ns2')", E_SQL)
def filter_resources(spark: SparkSession, d: str) -> DataFrame:
    return validate.filter_resources(_events(spark, d), kinds=["Pod", "Node"], namespaces=["ns1", "ns2"], kind="Service").select("id", "uid")


@query(
    """
    WITH s AS (SELECT i AS selector, 'tier' AS k, 't' || i AS v FROM (SELECT r_regionkey AS i FROM region)), p AS (SELECT c_custkey AS c, 't' || (c_custkey % 4) AS tier, c_mktsegment AS segment FROM customer)
    SELECT selector, c AS customer FROM s JOIN p ON p.tier = s.v AND (selector <> 2 OR segment = 'BUILDING')
    """
)
def selects_edges(spark: SparkSession, d: str) -> DataFrame:
    """Selectors that customers' labels meet: one or two pairs."""
    pods = table(spark, d, "customer").select(F.col("c_custkey").cast("string").alias("uid"), F.lit("a").alias("namespace"), F.create_map(F.lit("tier"), F.concat(F.lit("t"), F.col("c_custkey") % 4), F.lit("segment"), F.col("c_mktsegment")).alias("labels"))
    i = F.col("r_regionkey")
    pair = F.create_map(F.lit("tier"), F.concat(F.lit("t"), i))
    selector = F.when(i == 2, F.map_concat(pair, F.create_map(F.lit("segment"), F.lit("BUILDING")))).otherwise(pair)
    selectors = table(spark, d, "region").select(i.cast("string").alias("uid"), F.lit("a").alias("namespace"), selector.alias("selector"))
    return selector_edges(selectors, pods).select(F.col("src").cast("long").alias("selector"), F.col("dst").cast("long").alias("customer"))


@query("SELECT c_custkey AS customer FROM customer WHERE c_mktsegment = 'BUILDING' AND c_custkey % 4 = 2")
def label_match_filter(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    own = F.create_map(F.lit("tier"), (F.col("c_custkey") % 4).cast("string"), F.lit("segment"), F.col("c_mktsegment"))
    wanted = F.create_map(F.lit("tier"), F.lit("2"), F.lit("segment"), F.lit("BUILDING"))
    return c.filter(label_match(own, wanted)).select(F.col("c_custkey").alias("customer"))


# --- changes ---------------------------------------------------------------------------------------------------


@query(
    """
    WITH d AS (SELECT uid, id, ts_ns, type, data, arg_max(data, (ts_ns, id)) OVER (PARTITION BY uid ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS old FROM v_events)
    SELECT uid, id, ts_ns, type, old IS NOT NULL AND old <> data AS changed, old IS NULL AS first FROM d
    """,
    E_SQL,
)
def detect_changes(spark: SparkSession, d: str) -> DataFrame:
    return changes.data_changes(_events(spark, d))


@query(
    f"""
    WITH e AS (SELECT * FROM v_events WHERE ts_ns BETWEEN {START} AND {END}),
    n AS (SELECT uid, min(ts_ns) AS from_ns, max(ts_ns) AS to_ns, arg_min(data, (ts_ns, id)) AS a, arg_max(data, (ts_ns, id)) AS b, arg_min(id, (ts_ns, id)) AS ia, arg_max(id, (ts_ns, id)) AS ib FROM e GROUP BY uid)
    SELECT uid, from_ns, to_ns, '@@ k @@' || chr(10) || '-  k: ' || (a::JSON ->> '$.k') || chr(10) || '+  k: ' || (b::JSON ->> '$.k') || chr(10) AS diff FROM n WHERE ia <> ib AND (a::JSON ->> '$.k') <> (b::JSON ->> '$.k')
    """,
    E_SQL,
)
def net_spec_change(spark: SparkSession, d: str) -> DataFrame:
    return changes.net_spec_change(_events(spark, d), START, END)


@query(
    """
    WITH d AS (SELECT uid, id, ts_ns, data::JSON ->> '$.k' AS b, lag(data::JSON ->> '$.k') OVER (PARTITION BY uid ORDER BY ts_ns, id) AS a FROM v_events)
    SELECT uid, id, ts_ns, 'k' AS path, 'replace' AS op, a AS old, b AS new FROM d WHERE a <> b
    """,
    E_SQL,
)
def json_diff(spark: SparkSession, d: str) -> DataFrame:
    return changes.diff_rows(_events(spark, d))


_WORDS = "[" + ", ".join(f"'{w}'" for w in significance.ERROR_WORDS) + "]"


@query(f"SELECT namespace, ts_ns, array_to_string(list_filter({_WORDS}, lambda w: contains(lower(message), w)), ',') AS words FROM v_logs", L_SQL)
def error_patterns(spark: SparkSession, d: str) -> DataFrame:
    return views.log_lines(spark, d).select("namespace", "ts_ns", F.array_join(significance.error_patterns(F.col("message")), ",").alias("words"))


# --- graph -----------------------------------------------------------------------------------------------------


@query(
    """
    WITH t AS (SELECT *, CASE WHEN id::BIGINT % 97 = 0 THEN 'DELETE' ELSE type END AS t2 FROM v_events),
    g AS (SELECT *, min(ts_ns) FILTER (t2 = 'DELETE') OVER (PARTITION BY uid) AS gone FROM t),
    k AS (SELECT * FROM g WHERE gone IS NULL OR ts_ns <= gone)
    SELECT uid, arg_min(kind, (ts_ns, id)) AS kind, arg_min(namespace, (ts_ns, id)) AS namespace, arg_min(name, (ts_ns, id)) AS name, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns, any_value(gone) AS deleted_ns, any_value(gone) IS NOT NULL AS deleted FROM k GROUP BY uid
    """,
    E_SQL,
)
def build_resources(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d).withColumn("type", F.when(F.col("id").cast("long") % 97 == 0, "DELETE").otherwise(F.col("type")))
    return nodes.build_resources(events).drop("labels")


@query("SELECT uid, count(*) AS n FROM v_events WHERE ts_ns >= " + str(END) + " GROUP BY uid", E_SQL)
def retain_window(spark: SparkSession, d: str) -> DataFrame:
    events = _events(spark, d)
    _, kept = maintain.retain(nodes.build_resources(events), events, END)
    return kept.groupBy("uid").agg(F.count("*").alias("n"))


@query("SELECT 'edge' AS part, type AS name, count(*) AS n FROM v_edges GROUP BY type UNION ALL SELECT 'node', 'customers', count(*) FROM customer UNION ALL SELECT 'node', 'orders', count(*) FROM orders", R_SQL)
def graph_stats(spark: SparkSession, d: str) -> DataFrame:
    return maintain.graph_stats({"customers": table(spark, d, "customer"), "orders": table(spark, d, "orders")}, views.relation_edges(spark, d))


@query(
    """
    WITH r AS (SELECT DISTINCT uid, kind, namespace, min(ts_ns) AS first_ns FROM v_events GROUP BY uid, kind, namespace)
    SELECT uid, kind = 'Pod' AND NOT EXISTS (SELECT 1 FROM customer WHERE 'u' || c_custkey = uid AND c_custkey % 3 = 0) AS deleted FROM r
    """,
    E_SQL,
)
def mark_missing_deleted(spark: SparkSession, d: str) -> DataFrame:
    listing = table(spark, d, "customer").filter("c_custkey % 3 = 0").select(F.concat(F.lit("u"), F.col("c_custkey")).alias("uid"))
    return maintain.mark_missing_deleted(nodes.build_resources(_events(spark, d)), listing, AS_OF).select("uid", "deleted")


def _rules_sql() -> str:
    out = []
    for i, (name, ck, ct, ek, et, same, low, high, conf) in enumerate(causality.HEURISTICS):
        terms = [f"lag_ms BETWEEN {low} AND {high}"]
        for column, values in (("ck", ck), ("ct", ct), ("ek", ek), ("et", et)):
            if values:
                terms.append(f"{column} IN ({', '.join(repr(v) for v in values)})")
        if same:
            terms.append("cns = ens")
        if name == "same-resource-transition":
            terms.append("cu = eu")
        if name == "namespace-cascade-delete":
            terms.append("cn = ens")
        out.append(f"WHEN {' AND '.join(terms)} THEN {i}")
    return " ".join(out)


_NAMES = ", ".join(f"'{h[0]}'" for h in causality.HEURISTICS)
_CONF = ", ".join(f"{h[8]}::DOUBLE" for h in causality.HEURISTICS)


@query(
    f"""
    WITH p AS (
      SELECT c.id AS dst, e.id AS src, c.kind AS ck, c.type AS ct, e.kind AS ek, e.type AS et, c.namespace AS cns, e.namespace AS ens, c.uid AS cu, e.uid AS eu, c.name AS cn, (e.ts_ns - c.ts_ns) // 1000000 AS lag_ms
      FROM v_events c JOIN v_events e ON e.ts_ns > c.ts_ns AND e.ts_ns <= c.ts_ns + {causality.MAX_LAG_MS * 1_000_000}
    ), r AS (SELECT src, dst, lag_ms, CASE {_rules_sql()} END AS rule FROM p)
    SELECT src, dst, [{_CONF}][rule + 1] AS confidence, lag_ms, [{_NAMES}][rule + 1] AS reason FROM r WHERE rule IS NOT NULL
    """,
    E_SQL,
)
def infer_causality(spark: SparkSession, d: str) -> DataFrame:
    return causality.infer_causality(_events(spark, d))


@query("SELECT id AS src, lag(id) OVER w AS dst, (ts_ns - lag(ts_ns) OVER w) // 1000000 AS duration_ms, 'PRECEDED_BY' AS type FROM v_events WINDOW w AS (PARTITION BY uid ORDER BY ts_ns, id) QUALIFY lag(id) OVER w IS NOT NULL", E_SQL)
def preceded_by(spark: SparkSession, d: str) -> DataFrame:
    return nodes.preceded_by(_events(spark, d))


@query(
    """
    WITH o AS (SELECT src, dst FROM v_edges WHERE type = 'OWNS'), s AS (SELECT 'o' || o_orderkey AS uid FROM orders)
    SELECT uid, uid AS owner, 0 AS distance FROM s UNION ALL SELECT uid, a.src, 1 FROM s JOIN o a ON a.dst = uid UNION ALL SELECT uid, b.src, 2 FROM s JOIN o a ON a.dst = uid JOIN o b ON b.dst = a.src
    UNION ALL SELECT uid, c.src, 3 FROM s JOIN o a ON a.dst = uid JOIN o b ON b.dst = a.src JOIN o c ON c.dst = b.src
    """,
    R_SQL,
)
def ownership_chain(spark: SparkSession, d: str) -> DataFrame:
    return traverse.ownership_chain(views.relation_edges(spark, d), table(spark, d, "orders").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("uid")))


@query(
    """
    WITH s AS (SELECT 'r' || r_regionkey AS uid FROM region), e AS (SELECT DISTINCT src, dst FROM v_edges WHERE type IN ('OWNS', 'REFERENCES_SPEC')),
    d1 AS (SELECT DISTINCT uid, dst AS a FROM s JOIN e ON src = uid), d2 AS (SELECT DISTINCT uid, dst AS a FROM d1 JOIN e ON src = a), d3 AS (SELECT DISTINCT uid, dst AS a FROM d2 JOIN e ON src = a),
    n AS (SELECT uid, a, min(k) AS distance FROM (SELECT *, 1 AS k FROM d1 UNION ALL SELECT *, 2 FROM d2 UNION ALL SELECT *, 3 FROM d3) GROUP BY uid, a)
    SELECT uid, a AS affected, distance, count(*) AS n_events FROM n JOIN (SELECT 'o' || o_orderkey AS o FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 200000) ON o = a GROUP BY ALL
    """,
    R_SQL,
)
def blast_radius(spark: SparkSession, d: str) -> DataFrame:
    """What hangs on each region: costly finished orders count as errors."""
    starts = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("uid"), F.lit(0).cast("long").alias("t_ns"))
    bad = table(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 200000").select(F.concat(F.lit("o"), F.col("o_orderkey")).alias("uid"), F.lit("Error").alias("status"), F.lit(1).cast("long").alias("ts_ns"))
    return traverse.blast_radius(views.relation_edges(spark, d), starts, bad, 10, ["OWNS", "REFERENCES_SPEC"])


@query("SELECT src AS uid, 'out' AS direction, type, dst AS other FROM v_edges WHERE src LIKE 'n%' UNION ALL SELECT dst, 'in', type, src FROM v_edges WHERE dst LIKE 'n%'", R_SQL)
def neighbours(spark: SparkSession, d: str) -> DataFrame:
    return traverse.neighbours(views.relation_edges(spark, d), table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("uid")))


@query("SELECT type, src, dst FROM v_edges WHERE regexp_matches(src, '^[rnc]') AND regexp_matches(dst, '^[rnc]')", R_SQL)
def induced_subgraph(spark: SparkSession, d: str) -> DataFrame:
    edges = views.relation_edges(spark, d)
    uids = edges.select(F.explode(F.array("src", "dst")).alias("uid")).filter(F.col("uid").rlike("^[rnc]")).distinct()
    return traverse.induced_subgraph(edges, uids).select("type", "src", "dst")


@query(
    """
    WITH u AS (SELECT src AS a, dst AS b FROM v_edges UNION SELECT dst, src FROM v_edges), s AS (SELECT 'n' || n_nationkey AS uid FROM nation),
    d1 AS (SELECT DISTINCT uid, b AS other FROM s JOIN u ON a = uid), d2 AS (SELECT DISTINCT uid, b AS other FROM d1 JOIN u ON a = other)
    SELECT uid, other, min(k) AS distance FROM (SELECT uid, uid AS other, 0 AS k FROM s UNION ALL SELECT *, 1 FROM d1 UNION ALL SELECT *, 2 FROM d2) GROUP BY uid, other
    """,
    R_SQL,
)
def reachable(spark: SparkSession, d: str) -> DataFrame:
    return traverse.reachable(views.relation_edges(spark, d), table(spark, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("uid")), 2)


@query(
    """
    SELECT 's' || s_suppkey AS uid, CASE WHEN s_acctbal > 5000 THEN 'n' || s_nationkey END AS manager, CASE WHEN s_acctbal > 5000 THEN round(s_acctbal / 10000, 6) END AS confidence FROM supplier
    """
)
def managers(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    edges = s.select(F.lit("MANAGES").alias("type"), F.concat(F.lit("n"), F.col("s_nationkey")).alias("src"), F.concat(F.lit("s"), F.col("s_suppkey")).alias("dst"), (F.col("s_acctbal") / 10000).alias("confidence"))
    return traverse.managers(edges.filter("confidence > 0.5"), s.select(F.concat(F.lit("s"), F.col("s_suppkey")).alias("uid"))).withColumn("confidence", F.round("confidence", 6))


# --- anomalies -------------------------------------------------------------------------------------------------


def _warnings(spark: SparkSession, d: str) -> DataFrame:
    """Errors and clicks as warning events; the value gives the count."""
    e = _events(spark, d).filter("status != 'Ready'")
    reason = F.when(F.col("status") == "Error", "BackOff").otherwise("Unhealthy")
    return e.select("id", "uid", "kind", "ts_ns", reason.alias("reason"), "message", F.lit("Warning").alias("type"), F.floor(F.col("value")).cast("int").alias("count"))


WARNINGS_SQL = "v_warnings AS (SELECT id, uid, kind, ts_ns, CASE WHEN status = 'Error' THEN 'BackOff' ELSE 'Unhealthy' END AS reason, message, floor(value)::INT AS count FROM v_events WHERE status <> 'Ready')"


def _seen(spark: SparkSession, d: str) -> anomaly.Seen:
    e = _events(spark, d).withColumn("event_type", F.col("type"))
    return anomaly.Seen(e, _warnings(spark, d), e.limit(0), AS_OF)


@query(f"SELECT uid, kind, 'Event' AS category, 'RepeatedEvent' AS type, 'high' AS severity, {AS_OF}::BIGINT AS ts_ns, reason || ' in ' || count(*) || ' events, ' || sum(count) || ' times' AS summary FROM v_warnings GROUP BY uid, kind, reason HAVING count(*) >= 3", E_SQL, WARNINGS_SQL)
def repeated_event(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.repeated(_seen(spark, d))


@query("SELECT uid, kind, 'Event' AS category, 'HighFrequencyEvent' AS type, 'high' AS severity, ts_ns, reason || ' seen ' || count || ' times' AS summary FROM v_warnings WHERE count > 10", E_SQL, WARNINGS_SQL)
def high_frequency_event(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.high_frequency(_seen(spark, d))


@query("SELECT uid, kind, 'Event' AS category, reason AS type, 'high' AS severity, ts_ns, CASE WHEN message IS NULL THEN reason ELSE reason || ': ' || message END AS summary FROM v_warnings QUALIFY row_number() OVER (PARTITION BY uid, reason ORDER BY ts_ns, id) = 1", E_SQL, WARNINGS_SQL)
def warning_event(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.warning_events(_seen(spark, d))


@query(
    """
    WITH t AS (SELECT uid, kind, ts_ns, coalesce((lag(status) OVER (PARTITION BY uid ORDER BY ts_ns, id) <> status)::INT, 0) AS turn FROM v_events)
    SELECT uid, kind, 'Frequency' AS category, 'FlappingState' AS type, 'high' AS severity, max(ts_ns) AS ts_ns, sum(turn) || ' changes of status' AS summary FROM t GROUP BY uid, kind HAVING sum(turn) >= 3
    """,
    E_SQL,
)
def flapping_state(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.flapping(_seen(spark, d))


@query(
    """
    WITH a AS (SELECT CASE WHEN status = 'Error' THEN 'high' ELSE 'low' END AS severity, kind AS category FROM v_events)
    SELECT 'severity' AS by, severity AS name, count(*) AS n FROM a GROUP BY severity UNION ALL SELECT 'category', category, count(*) FROM a GROUP BY category
    """,
    E_SQL,
)
def anomaly_summary(spark: SparkSession, d: str) -> DataFrame:
    return anomaly.summary(_events(spark, d).select(F.when(F.col("status") == "Error", "high").otherwise("low").alias("severity"), F.col("kind").alias("category")))


# --- logs ------------------------------------------------------------------------------------------------------


@query("SELECT namespace, ts_ns, lower(trim(message)) AS message FROM v_logs", L_SQL)
def extract_message(spark: SparkSession, d: str) -> DataFrame:
    return views.log_lines(spark, d).select("namespace", "ts_ns", logs.preprocess(F.col("message")).alias("message"))


def _masked_sql(text: str) -> str:
    for pattern, name in logs.MASKS[:9]:
        text = f"regexp_replace({text}, '{pattern}', '{name}', 'g')"
    return text


@query(f"SELECT namespace, pod, container, ts_ns, {_masked_sql('message')} AS masked FROM v_logs", L_SQL)
def mask_patterns(spark: SparkSession, d: str) -> DataFrame:
    """The masks whose words both dialects cut alike."""
    text = F.col("message")
    for pattern, name in logs.MASKS[:9]:
        text = F.regexp_replace(text, pattern, name)
    return views.log_lines(spark, d).select("namespace", "pod", "container", "ts_ns", text.alias("masked"))


TEMPLATES_SQL = "v_templates AS (SELECT namespace, regexp_replace(lower(trim(message)), '[0-9]+', '<VAR>', 'g') AS pattern, count(*) AS count, min(ts_ns) AS first_ns, max(ts_ns) AS last_ns FROM v_logs GROUP BY ALL)"


def _patterns(rows: DataFrame) -> DataFrame:
    p = F.regexp_replace(F.lower(F.trim("message")), "[0-9]+", "<VAR>")
    return rows.withColumn("pattern", p).groupBy("namespace", "pattern").agg(F.count("*").alias("count"), F.min("ts_ns").alias("first_ns"), F.max("ts_ns").alias("last_ns"))


@query("SELECT namespace, sha256(namespace || '|' || pattern) AS id, pattern, count, first_ns, last_ns FROM v_templates", L_SQL, TEMPLATES_SQL)
def template_counts(spark: SparkSession, d: str) -> DataFrame:
    return logs.template_table(_patterns(views.log_lines(spark, d)))


@query(
    """
    WITH l AS (SELECT *, regexp_replace(lower(trim(message)), '[0-9]+', '<VAR>', 'g') AS pattern, ts_ns >= (SELECT quantile_disc(ts_ns, 0.5) FROM v_logs) AS late FROM v_logs)
    SELECT namespace, pattern, count(*) FILTER (late) AS count, count(*) FILTER (NOT late) = 0 AS novel FROM l GROUP BY namespace, pattern HAVING count(*) FILTER (late) > 0
    """,
    L_SQL,
)
def template_novelty(spark: SparkSession, d: str) -> DataFrame:
    rows = views.log_lines(spark, d)
    half = rows.agg(F.expr("percentile_disc(0.5) within group (order by ts_ns)").alias("half"))
    rows = rows.crossJoin(F.broadcast(half)).withColumn("late", F.col("ts_ns") >= F.col("half"))  # one row
    return logs.novel(_patterns(rows.filter("late")), _patterns(rows.filter("not late"))).select("namespace", "pattern", "count", "novel")


@query(
    f"""
    WITH m AS (SELECT *, regexp_matches(message, '{logs.ERROR}') AS e, regexp_matches(message, '{logs.WARNING}') AS w FROM v_logs)
    SELECT CASE WHEN coalesce(namespace, '') = '' THEN '(no namespace)' ELSE namespace END AS namespace, count(*) FILTER (e) AS errors, count(*) FILTER (w) AS warnings, count(*) AS total, greatest(0, count(*) - count(*) FILTER (e) - count(*) FILTER (w)) AS other FROM m GROUP BY 1
    """,
    L_SQL,
)
def log_overview(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_overview(views.log_lines(spark, d))


@query("SELECT (ts_ns // 3600000000000) * 3600000000000 AS bucket_ns, count(*) AS n FROM v_logs GROUP BY 1", L_SQL)
def log_histogram(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_histogram(views.log_lines(spark, d), 3600)


@query("SELECT pod AS value, count(*) AS n FROM v_logs GROUP BY pod", L_SQL)
def log_aggregate(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_aggregate(views.log_lines(spark, d), "pod")


@query(
    """
    WITH m AS (SELECT * FROM v_logs WHERE namespace = 'user' AND contains(message, 'the')), t AS (SELECT *, row_number() OVER (ORDER BY ts_ns DESC, pod, container, message) AS nth FROM m)
    SELECT namespace, pod, container, ts_ns, message, nth, (SELECT count(*) FROM m) > 100 AS truncated FROM t WHERE nth <= 100
    """,
    L_SQL,
)
def log_search(spark: SparkSession, d: str) -> DataFrame:
    return logs.log_search(views.log_lines(spark, d), text="the", namespace="user")


# --- metrics and alerts ----------------------------------------------------------------------------------------


@query(
    """
    SELECT 's' || user_id AS series, event_type AS metric, hour(ts)::INT AS hour, CASE WHEN isodow(ts) >= 6 THEN 'weekend' ELSE 'weekday' END AS day_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS stddev, count(*) AS n
    FROM events GROUP BY ALL HAVING count(*) >= 3
    """
)
def metric_baseline(spark: SparkSession, d: str) -> DataFrame:
    rows = metrics.baselines(views.metric_points(spark, d))
    return rows.withColumn("mean", F.round("mean", 6)).withColumn("stddev", F.round("stddev", 6))


@query(
    """
    WITH p AS (SELECT 's' || (user_id % 10) AS series, event_type AS metric, ts, value, event_id AS seq FROM events),
    n AS (SELECT series, metric, max(ts) AS at, arg_max(value, (ts, seq)) AS value, arg_max(seq, (ts, seq)) AS last_seq FROM p GROUP BY ALL),
    b AS (SELECT series, metric, avg(p.value) AS mean, stddev_samp(p.value) AS sd, count(*) AS n FROM p JOIN n USING (series, metric) WHERE p.ts <= n.at AND p.seq <> n.last_seq AND hour(p.ts) = hour(n.at) AND (isodow(p.ts) >= 6) = (isodow(n.at) >= 6) AND p.ts >= n.at - INTERVAL 7 DAY GROUP BY ALL HAVING count(*) >= 3),
    z AS (SELECT *, CASE WHEN coalesce(sd, 0) = 0 THEN 0 ELSE (value - mean) / sd END AS z FROM n JOIN b USING (series, metric)),
    s AS (SELECT *, CASE WHEN regexp_matches(lower(metric), '5xx|error|failed|failure') THEN CASE WHEN abs(z) >= 2 THEN 'critical' WHEN abs(z) >= 1.5 THEN 'warning' WHEN abs(z) >= 1 THEN 'info' END
      ELSE CASE WHEN abs(z) >= 3 THEN 'critical' WHEN abs(z) >= 2 THEN 'warning' WHEN abs(z) >= 1.5 THEN 'info' END END AS severity FROM z)
    SELECT series, metric, severity, round(z, 6) AS z, round(value, 6) AS value, round(mean, 6) AS mean, n FROM s WHERE severity IS NOT NULL
    ORDER BY CASE severity WHEN 'critical' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, round(abs(z), 6) DESC, series, metric LIMIT 20
    """
)
def metric_anomalies(spark: SparkSession, d: str) -> DataFrame:
    points = views.metric_points(spark, d).withColumn("series", F.concat(F.lit("s"), F.substring("series", 2, 20).cast("long") % 10))
    return metrics.detect_metric_anomalies(points, F.lit("2100-01-01").cast("timestamp"))


def _moves(spark: SparkSession, d: str) -> DataFrame:
    return alerts.transitions(views.alert_states(spark, d), keep_days=36500)


@query("SELECT * FROM v_transitions", A_SQL)
def alert_transitions(spark: SparkSession, d: str) -> DataFrame:
    return _moves(spark, d)


INTERVALS_SQL = f"""v_intervals AS (
  SELECT alert, to_state AS state, ts_ns AS a, coalesce(lead(ts_ns) OVER (PARTITION BY alert ORDER BY ts_ns, seq), {AS_OF}) AS b FROM v_transitions WHERE ts_ns < {AS_OF}
  UNION ALL SELECT alert, 'normal', {AS_OF - 7 * DAY}, min(ts_ns) FROM v_transitions WHERE ts_ns < {AS_OF} GROUP BY alert HAVING min(ts_ns) > {AS_OF - 7 * DAY}
)"""


@query(f"SELECT alert, state, sum(least(b, {AS_OF}) - greatest(a, {AS_OF - 7 * DAY}))::BIGINT AS held_ns, round(sum(least(b, {AS_OF}) - greatest(a, {AS_OF - 7 * DAY})) / {7 * DAY}, 6) AS share FROM v_intervals WHERE least(b, {AS_OF}) > greatest(a, {AS_OF - 7 * DAY}) GROUP BY alert, state", A_SQL, INTERVALS_SQL)
def state_distribution(spark: SparkSession, d: str) -> DataFrame:
    return alerts.state_distribution(_moves(spark, d), AS_OF - 7 * DAY, AS_OF)


@query(
    f"""
    WITH days AS (SELECT i, {AS_OF - 7 * DAY} + i * {DAY} AS a0, {AS_OF - 7 * DAY} + (i + 1) * {DAY} AS b0 FROM range(7) t(i)),
    g AS (SELECT alert, i, a0, b0 FROM (SELECT alert FROM v_transitions WHERE ts_ns < {AS_OF} GROUP BY alert HAVING min(ts_ns) <= {AS_OF - DAY}), days),
    s AS (SELECT g.alert, i, coalesce(sum(least(b, b0) - greatest(a, a0)) FILTER (least(b, b0) > greatest(a, a0)), 0)::HUGEINT AS held FROM g LEFT JOIN v_intervals v ON v.alert = g.alert AND v.state = 'firing' GROUP BY g.alert, i),
    w AS (SELECT alert, sum(held)::HUGEINT AS total, sum(held * held)::HUGEINT AS squares, count(*) AS n_days FROM s GROUP BY alert)
    SELECT alert, ((2 * total + n_days * {DAY // 10**6}) // (2 * n_days * {DAY // 10**6}))::DOUBLE / 1000000 AS mean, floor(sqrt((n_days * squares - total * total)::DOUBLE / (n_days * (n_days - 1))) / {DAY // 10**6} + 0.5) / 1000000 AS stddev, n_days FROM w
    """,
    A_SQL,
    INTERVALS_SQL,
)
def rolling_alert_baseline(spark: SparkSession, d: str) -> DataFrame:
    return alerts.rolling_baseline(_moves(spark, d), AS_OF)


@query(
    f"""
    WITH w AS (SELECT alert, coalesce(lead(ts_ns) OVER (PARTITION BY alert ORDER BY ts_ns, seq), {AS_OF}) - ts_ns AS held FROM v_transitions WHERE ts_ns BETWEEN {AS_OF - 240 * HOUR} AND {AS_OF}),
    a AS (SELECT alert, count(*) AS n, avg(held) / {240 * HOUR} AS ratio FROM w GROUP BY alert)
    SELECT alert, n, round(least(1.0, (1 - exp(-0.15 * n)) * CASE WHEN ratio < 0.1 THEN 1.3 WHEN ratio < 0.3 THEN 1.1 WHEN ratio < 0.5 THEN 1.0 ELSE 0.8 END), 6) AS score FROM a
    """,
    A_SQL,
)
def flappiness(spark: SparkSession, d: str) -> DataFrame:
    return alerts.flappiness(_moves(spark, d), AS_OF, 240)


@query(
    f"""
    WITH f AS (SELECT alert, min(ts_ns) FILTER (to_state = 'firing' AND ts_ns >= {AS_OF - 7 * DAY}) AS first FROM v_transitions WHERE ts_ns <= {AS_OF} GROUP BY alert),
    s AS (SELECT alert, sum(least(b, {AS_OF}) - greatest(a, {AS_OF - 7 * DAY})) / {7 * DAY} AS share FROM v_intervals WHERE state = 'firing' AND least(b, {AS_OF}) > greatest(a, {AS_OF - 7 * DAY}) GROUP BY alert)
    SELECT alert, CASE WHEN first IS NULL THEN 'stable-normal' WHEN round(share, 6) > 0.8 THEN 'chronic' WHEN {AS_OF} - first < {HOUR} THEN 'new' WHEN {AS_OF} - first < {DAY} THEN 'recent' ELSE 'persistent' END AS onset FROM f LEFT JOIN s USING (alert)
    """,
    A_SQL,
    INTERVALS_SQL,
)
def alert_category(spark: SparkSession, d: str) -> DataFrame:
    return alerts.onset(_moves(spark, d), AS_OF)


@query(
    f"""
    WITH al AS (SELECT alert, max(ts_ns) AS since_ns, arg_max(to_state, (ts_ns, seq)) AS state, count(*) FILTER (ts_ns >= {AS_OF - 24 * HOUR}) AS n_transitions FROM v_transitions WHERE ts_ns <= {AS_OF} GROUP BY alert),
    g AS (SELECT alert, i, {AS_OF - 24 * HOUR} + i * {HOUR} AS at_ns FROM al, range(1, 25) t(i)),
    s AS (SELECT alert, i, coalesce((SELECT arg_max(to_state, (ts_ns, seq)) FROM v_transitions t WHERE t.alert = g.alert AND t.ts_ns <= at_ns), 'normal') AS st FROM g),
    x AS (SELECT alert, '[' || string_agg(upper(left(st, 1)), ' ' ORDER BY i) || ']' AS timeline FROM s GROUP BY alert)
    SELECT alert, timeline, state, n_transitions FROM x JOIN al USING (alert)
    """,
    A_SQL,
)
def alert_timeline(spark: SparkSession, d: str) -> DataFrame:
    return alerts.alerts_aggregated(_moves(spark, d), AS_OF, window_h=24, step_min=60).drop("firing_for")


@query(f"WITH t AS (SELECT *, (ts_ns - lag(ts_ns) OVER (PARTITION BY alert ORDER BY ts_ns, seq)) // 1000000000 AS in_previous_s FROM v_transitions) SELECT alert, from_state, to_state, ts_ns, in_previous_s FROM t WHERE ts_ns BETWEEN {AS_OF - 7 * DAY} AND {AS_OF}", A_SQL)
def alert_details(spark: SparkSession, d: str) -> DataFrame:
    return alerts.alert_details(_moves(spark, d), AS_OF)


@query()
def analyze_alerts(spark: SparkSession, d: str) -> DataFrame:
    return alerts.analyze_alerts(_moves(spark, d), AS_OF)


@query()
def mine_templates(spark: SparkSession, d: str) -> DataFrame:
    return logs.mine_templates(views.log_lines(spark, d))


@query()
def rebalance_templates(spark: SparkSession, d: str) -> DataFrame:
    """Of page urls as log lines, as lines that an access log has."""
    return logs.rebalance(logs.mine_templates(views.access_lines(spark, d)), least=2)


_CAUSAL_SQL = f"""
v_up AS (SELECT DISTINCT CASE type WHEN 'REFERENCES_SPEC' THEN src ELSE dst END AS below, CASE type WHEN 'REFERENCES_SPEC' THEN dst ELSE src END AS up, type = 'REFERENCES_SPEC' AS cause FROM v_edges
), v_nodes AS (
  SELECT 'r' || r_regionkey AS uid, 'Namespace' AS kind FROM region UNION ALL SELECT 'n' || n_nationkey, 'HelmRelease' FROM nation UNION ALL SELECT 'c' || c_custkey, 'Deployment' FROM customer
  UNION ALL SELECT 'o' || o_orderkey, 'Pod' FROM orders UNION ALL SELECT 's' || s_suppkey, 'ConfigMap' FROM supplier UNION ALL SELECT 'p' || p_partkey, 'PersistentVolumeClaim' FROM part
), v_anomalies AS (
  SELECT 'c' || c_custkey AS uid, true AS cause, false AS definitive, {START} - c_custkey % 700 * 1000000000 AS ts, 0.75 AS severity FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT 'n' || n_nationkey, true, false, {START} - 60000000000, 0.75 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 's' || s_suppkey, true, true, {START} - s_suppkey % 900 * 1000000000, 0.5 FROM supplier WHERE s_acctbal < 0
  UNION ALL SELECT 'o' || o_orderkey, false, false, {START} - o_orderkey % 50 * 1000000000, 1.0 FROM orders WHERE o_orderpriority = '1-URGENT'
), v_info AS (
  SELECT n.uid, n.kind, a.cause_ns, a.first_ns, coalesce(a.severity, 0.25) AS severity, coalesce(a.definitive, false) AS definitive, coalesce(a.cause_ns IS NULL, true) AS derived, t.refers
  FROM v_nodes n LEFT JOIN (SELECT uid, min(ts) FILTER (cause) AS cause_ns, min(ts) AS first_ns, max(severity) AS severity, bool_or(definitive) AS definitive FROM v_anomalies GROUP BY uid) a USING (uid)
  LEFT JOIN (SELECT below AS uid, bool_or(cause) AS refers FROM v_up GROUP BY below) t USING (uid)
), v_incidents AS (
  SELECT id AS incident_id, uid AS symptom, coalesce(first_ns, {START}) AS failure, first_ns, severity
  FROM (SELECT 'i' || o_orderkey AS id, 'o' || o_orderkey AS uid FROM orders WHERE o_totalprice > 300000 UNION ALL SELECT 'p' || p_partkey, 'p' || p_partkey FROM part WHERE p_size = 50) JOIN v_info USING (uid)
)"""


@query(
    """
    WITH RECURSIVE walk AS (
      SELECT incident_id, failure, symptom AS below, 0 AS d, 0 AS hops, 0 AS root_hops, severity, first_ns, [symptom] AS path, false AS emit, true AS go_on FROM v_incidents
      UNION ALL
      SELECT incident_id, failure, up, d + 1, hops + cause::INT, hops, greatest(w_severity, severity), least(w_first, first_ns), list_append(path, up), stop OR (refers IS NULL AND on_ AND has AND d + 1 < 5), on_
      FROM (
        SELECT *, CASE WHEN stop THEN coalesce(refers, false) ELSE NOT cause OR derived END AS on_
        FROM (
          SELECT w.incident_id, w.failure, w.d, w.hops, w.path, w.severity AS w_severity, w.first_ns AS w_first, u.up, u.cause, i.severity, i.first_ns, i.refers, i.derived,
            coalesce(i.cause_ns <= w.failure, false) AS has, coalesce(i.cause_ns <= w.failure, false) AND (u.cause OR w.d > 0) AS stop
          FROM walk w JOIN v_up u ON w.below = u.below JOIN v_info i ON i.uid = u.up WHERE w.go_on AND w.d < 5 AND NOT list_contains(w.path, u.up)
        )
      )
    ), ends AS (
      SELECT incident_id, below AS root, kind, d, w.first_ns, root_hops, w.severity, definitive, (failure - w.first_ns) / 1e9 AS s FROM walk w JOIN v_info i ON i.uid = w.below WHERE emit
    ), scored AS (
      SELECT *, round(least(1.0, 0.40 * CASE WHEN s < 0 THEN 0.0 WHEN s < 5 THEN 0.3 + 0.2 * s / 5 WHEN s < 30 THEN 0.5 + 0.5 * (s - 5) / 25 WHEN s <= 300 THEN 1.0 ELSE greatest(0.6, 1.0 - 0.3 * (s - 300) / 300) END
        + 0.35 * CASE WHEN definitive THEN 1.0 ELSE greatest(0.0, 1.0 - root_hops / 5) END + 0.25 * severity + CASE kind WHEN 'HelmRelease' THEN 0.10 WHEN 'ConfigMap' THEN 0.05 WHEN 'PersistentVolumeClaim' THEN 0.05 ELSE 0 END + CASE WHEN definitive THEN 0.15 ELSE 0 END)::DOUBLE, 9) AS c
      FROM ends
    ), best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY incident_id, root ORDER BY d DESC, c DESC, first_ns, root_hops, severity DESC) = 1
    ), ranked AS (SELECT *, row_number() OVER (PARTITION BY incident_id ORDER BY c DESC, definitive DESC, first_ns, d DESC, root)::INT AS rank, count(*) OVER (PARTITION BY root) AS n_affected FROM best)
    SELECT incident_id, rank, root, kind AS root_kind, round(c, 6) AS confidence, d AS steps, first_ns, n_affected FROM ranked WHERE rank <= 5
    """,
    R_SQL,
    _CAUSAL_SQL,
)
def causal_paths(spark: SparkSession, d: str) -> DataFrame:
    """From costly orders and large parts up through orders, customers, nations, their suppliers and regions; poor customers, every other nation and poor suppliers changed."""
    uid = lambda p, c: F.concat(F.lit(p), F.col(c)).alias("uid")
    region, nation, customer, orders, supplier, part = (table(spark, d, t) for t in ("region", "nation", "customer", "orders", "supplier", "part"))
    named = [(region, "r", "r_regionkey", "Namespace"), (nation, "n", "n_nationkey", "HelmRelease"), (customer, "c", "c_custkey", "Deployment"), (orders, "o", "o_orderkey", "Pod"), (supplier, "s", "s_suppkey", "ConfigMap"), (part, "p", "p_partkey", "PersistentVolumeClaim")]
    resources = reduce(DataFrame.union, [df.select(uid(p, c), F.lit(kind).alias("kind")) for df, p, c, kind in named])
    at = lambda s: (F.lit(START) - s.cast("long") * 1_000_000_000).cast("long").alias("ts_ns")
    found = lambda df, u, category, type_, severity, ts: df.select(u, F.lit(category).alias("category"), F.lit(type_).alias("type"), F.lit(severity).alias("severity"), at(ts))
    anomalies = reduce(DataFrame.union, [
        found(customer.filter("c_acctbal < 0"), uid("c", "c_custkey"), "Change", "ImageChanged", "high", F.col("c_custkey") % 700),
        found(nation.filter("n_nationkey % 2 = 0"), uid("n", "n_nationkey"), "Change", "ValuesChanged", "high", F.lit(60)),
        found(supplier.filter("s_acctbal < 0"), uid("s", "s_suppkey"), "Change", "ResourceDeleted", "medium", F.col("s_suppkey") % 900),
        found(orders.filter("o_orderpriority = '1-URGENT'"), uid("o", "o_orderkey"), "State", "ErrorStatus", "critical", F.col("o_orderkey") % 50),
    ])
    incidents = orders.filter("o_totalprice > 300000").select(F.concat(F.lit("i"), "o_orderkey").alias("incident_id"), uid("o", "o_orderkey")).union(part.filter("p_size = 50").select(F.concat(F.lit("p"), "p_partkey"), uid("p", "p_partkey"))).withColumn("t_ns", F.lit(START))
    ranked = causal.top_paths(views.relation_edges(spark, d), resources, anomalies, incidents)
    return ranked.select("incident_id", "rank", "root", "root_kind", F.round("confidence", 6).alias("confidence"), "steps", "first_ns", "n_affected")


from opsgraph.plans import snapshot_queries, upkeep_queries  # noqa: E402, F401  they register their queries with those above
