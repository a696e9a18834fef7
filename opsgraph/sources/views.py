"""The driver's tables seen as resource events, edges, logs, metrics and alert states."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ["Pod", "Deployment", "ReplicaSet", "Node", "Service"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ts_ns(ts: F.Column) -> F.Column:
    """Nanoseconds since the epoch of a timestamp without zone."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def resource_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as flat resource events: id, uid, kind, namespace, name, type, ts_ns, status, message, data."""
    e, user = table(spark, sf_dir, "events"), F.col("user_id")
    kind = F.element_at(F.array(*[F.lit(k) for k in KINDS]), (user % 5 + 1).cast("int"))
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("u"), user).alias("uid"),
        kind.alias("kind"),
        F.concat(F.lit("ns"), user % 7).alias("namespace"),
        F.concat(F.lit("name-"), user).alias("name"),
        F.when(F.col("event_type") == "signup", "CREATE").otherwise("UPDATE").alias("type"),
        ts_ns(F.col("ts")).alias("ts_ns"),
        F.when(F.col("event_type") == "error", "Error").when(F.col("event_type") == "click", "Warning").otherwise("Ready").alias("status"),
        F.when(F.col("event_type") == "error", F.concat(F.lit("failed "), F.get_json_object("props", "$.k"))).otherwise("").alias("message"),
        F.col("props").alias("data"),
        F.col("value"),
    )


RESOURCE_EVENTS_SQL = """
v_events AS (
  SELECT event_id::VARCHAR AS id, 'u' || user_id AS uid, ['Pod', 'Deployment', 'ReplicaSet', 'Node', 'Service'][user_id % 5 + 1] AS kind, 'ns' || (user_id % 7) AS namespace,
    'name-' || user_id AS name, CASE WHEN event_type = 'signup' THEN 'CREATE' ELSE 'UPDATE' END AS type, epoch_us(ts) * 1000 AS ts_ns,
    CASE event_type WHEN 'error' THEN 'Error' WHEN 'click' THEN 'Warning' ELSE 'Ready' END AS status,
    CASE WHEN event_type = 'error' THEN 'failed ' || (props::JSON ->> '$.k') ELSE '' END AS message, props AS data, value
  FROM events
)"""


def relation_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(type, src, dst): region owns nation owns customer owns order; a nation refers to its suppliers; an order mounts its parts."""
    nation, customer, orders, supplier, item = (table(spark, sf_dir, t) for t in ("nation", "customer", "orders", "supplier", "lineitem"))

    def edge(df: DataFrame, kind: str, a: str, src: str, b: str, dst: str) -> DataFrame:
        return df.select(F.lit(kind).alias("type"), F.concat(F.lit(a), F.col(src)).alias("src"), F.concat(F.lit(b), F.col(dst)).alias("dst"))

    parts = [
        edge(nation, "OWNS", "r", "n_regionkey", "n", "n_nationkey"),
        edge(customer, "OWNS", "n", "c_nationkey", "c", "c_custkey"),
        edge(orders, "OWNS", "c", "o_custkey", "o", "o_orderkey"),
        edge(supplier, "REFERENCES_SPEC", "n", "s_nationkey", "s", "s_suppkey"),
        edge(item, "MOUNTS", "o", "l_orderkey", "p", "l_partkey").distinct(),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


RELATION_EDGES_SQL = """
v_edges AS (
  SELECT 'OWNS' AS type, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst FROM nation
  UNION ALL SELECT 'OWNS', 'n' || c_nationkey, 'c' || c_custkey FROM customer
  UNION ALL SELECT 'OWNS', 'c' || o_custkey, 'o' || o_orderkey FROM orders
  UNION ALL SELECT 'REFERENCES_SPEC', 'n' || s_nationkey, 's' || s_suppkey FROM supplier
  UNION ALL SELECT DISTINCT 'MOUNTS', 'o' || l_orderkey, 'p' || l_partkey FROM lineitem
)"""


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conversations as log lines: namespace, pod, container, ts_ns, message."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.col("role").alias("namespace"),
        F.concat(F.lit("pod-"), F.col("conv_id") % 20).alias("pod"),
        F.concat(F.lit("c"), F.col("turn") % 3).alias("container"),
        ((F.col("conv_id") * 60 + F.col("turn")) * F.lit(1_000_000_000)).alias("ts_ns"),
        F.coalesce("text", F.lit("")).alias("message"),
    )


def access_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as lines of an access log."""
    p = table(spark, sf_dir, "pages")
    return p.select(F.lit("web").alias("namespace"), F.lit("pod-0").alias("pod"), F.lit("c0").alias("container"), (F.col("page_id") * F.lit(1_000_000_000)).alias("ts_ns"), F.concat(F.lit("GET "), F.coalesce("url", F.lit(""))).alias("message"))


LOG_LINES_SQL = """
v_logs AS (
  SELECT role AS namespace, 'pod-' || (conv_id % 20) AS pod, 'c' || (turn % 3) AS container, (conv_id * 60 + turn) * 1000000000 AS ts_ns, coalesce(text, '') AS message FROM conversations
)"""


def metric_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as metric points: series, metric, ts, value."""
    e = table(spark, sf_dir, "events")
    return e.select(F.concat(F.lit("s"), F.col("user_id")).alias("series"), F.col("event_type").alias("metric"), F.col("ts").cast("timestamp").alias("ts"), F.col("value"), F.col("event_id").alias("seq"))


def alert_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as alert states: alert, state, ts_ns, seq."""
    e = table(spark, sf_dir, "events")
    state = F.when(F.col("event_type") == "error", "firing").when(F.col("event_type") == "click", "pending").otherwise("normal")
    return e.select(F.concat(F.lit("a"), F.col("user_id")).alias("alert"), state.alias("state"), ts_ns(F.col("ts")).alias("ts_ns"), F.col("event_id").alias("seq"))


ALERT_STATES_SQL = """
v_states AS (
  SELECT 'a' || user_id AS alert, CASE event_type WHEN 'error' THEN 'firing' WHEN 'click' THEN 'pending' ELSE 'normal' END AS state, epoch_us(ts) * 1000 AS ts_ns, event_id AS seq FROM events
), v_transitions AS (
  SELECT alert, coalesce(prev, 'unknown') AS from_state, state AS to_state, ts_ns, seq
  FROM (SELECT *, lag(state) OVER (PARTITION BY alert ORDER BY ts_ns, seq) AS prev FROM v_states) WHERE prev IS DISTINCT FROM state
)"""
