"""The driver's tables seen as snapshots of resources, warning events and dashboards, as JSON where the operators read JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opsgraph.sources.views import table, ts_ns

KINDS = ["Pod", "Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "Node", "PersistentVolumeClaim", "HelmRelease"]


def _object(**fields: Column | str | int) -> Column:
    """A JSON object of the fields that aren't null."""
    return F.to_json(F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(k) for k, v in fields.items()]))


def _condition(kind: str, status: Column, reason: Column | None = None) -> Column:
    return F.struct(F.lit(kind).alias("type"), status.alias("status"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))


def _some(*entries: Column) -> Column:
    """The entries that aren't null, as an array."""
    return F.array_compact(F.array(*entries))


def resource_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as snapshots (id, uid, kind, namespace, name, type, ts_ns, data): a user is a resource, whose kind follows from the id, and what an event says follows from its number."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", (F.col("event_id") % 10).cast("int").alias("n"), (F.col("event_id") % 3).cast("int").alias("m"))
    n, m = F.col("n"), F.col("m")
    n4, n5 = n % 4, n % 5
    when = lambda c, v: F.when(c, F.lit(v))
    waiting = F.when(n == 9, F.struct(F.struct(F.lit("CrashLoopBackOff").alias("reason")).alias("waiting"))).when(n == 8, F.struct(F.struct(F.lit("ImagePullBackOff").alias("reason")).alias("waiting")))
    ended = F.when(n == 7, F.struct(F.struct(F.lit(137).alias("exitCode")).alias("terminated")))
    container = F.struct(F.lit("c").alias("name"), F.when(m == 0, n * 2).otherwise(0).alias("restartCount"), waiting.alias("state"), ended.alias("lastState"))
    phase = F.element_at(F.array(*map(F.lit, ["Running", "Running", "Pending", "Failed", "Succeeded"])), n5 + 1)
    told = F.when(n == 4, F.array(_condition("Available", F.lit("False"), F.when(m == 0, "Timeout").otherwise("Waiting"))))
    node = _some(
        _condition("Ready", F.element_at(F.array(*map(F.lit, ["True", "False", "Unknown", "True", "True"])), n5 + 1)),
        F.when(n5 == 3, _condition("MemoryPressure", F.lit("True"))),
        F.when(n == 4, _condition("NetworkUnavailable", F.lit("True"))),
    )
    release = F.array(
        F.when(n4 == 0, _condition("Ready", F.lit("True")))
        .when(n4 == 1, _condition("Ready", F.lit("False"), F.lit("InstallFailed")))
        .when(n4 == 2, _condition("Ready", F.lit("Unknown")))
        .otherwise(_condition("Stalled", F.lit("True")))
    )
    job = _some(F.when(n == 0, _condition("Complete", F.lit("True"))), F.when(n == 1, _condition("Failed", F.lit("True"))))
    status = {
        "Pod": _object(phase=phase, conditions=F.array(_condition("Ready", F.when(n % 2 == 0, "True").otherwise("False"))), containerStatuses=F.array(container)),
        "Deployment": _object(readyReplicas=n4, availableReplicas=n4, unavailableReplicas=3 - n4, conditions=told),
        "StatefulSet": _object(readyReplicas=n4, currentReplicas=n5),
        "DaemonSet": _object(desiredNumberScheduled=3, numberReady=n4, numberMisscheduled=F.when(n == 5, 1).otherwise(0)),
        "ReplicaSet": _object(readyReplicas=n4, availableReplicas=n4),
        "Job": _object(conditions=job, succeeded=when(n == 2, 1), failed=when(n == 3, 1), active=1),
        "Node": _object(conditions=node),
        "PersistentVolumeClaim": _object(phase=F.element_at(F.array(*map(F.lit, ["Bound", "Pending", "Lost"])), m + 1)),
        "HelmRelease": _object(conditions=release),
    }
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (F.col("user_id") % len(KINDS) + 1).cast("int"))
    type_ = F.when(F.col("event_id") % 101 == 0, "DELETE").when(F.col("event_type") == "signup", "CREATE").otherwise("UPDATE")
    deleting = F.when((kind == "HelmRelease") & (n == 5), "2024-01-01T00:00:00Z")
    metadata = _object(generation=(F.col("event_id") % 7).cast("int"), deletionTimestamp=deleting)
    image = F.concat(F.lit("v"), m)
    # The same spec with its keys in one order or the other.
    spec = F.when(n % 2 == 0, F.format_string('{"replicas":3,"image":"%s","t":{"p":{"a":1,"b":[2]}}}', image)).otherwise(F.format_string('{"t":{"p":{"b":[2],"a":1}},"image":"%s","replicas":3}', image))
    own = F.element_at(F.create_map(*[x for k, v in status.items() for x in (F.lit(k), v)]), kind)
    data = F.concat(F.lit('{"metadata":'), metadata, F.lit(',"spec":'), spec, F.lit(',"status":'), own, F.lit("}"))
    return e.select(
        F.col("event_id").cast("string").alias("id"),
        F.concat(F.lit("u"), "user_id").alias("uid"),
        kind.alias("kind"),
        F.concat(F.lit("ns"), F.col("user_id") % 7).alias("namespace"),
        F.concat(F.lit("name-"), "user_id").alias("name"),
        type_.alias("type"),
        ts_ns(F.col("ts")).alias("ts_ns"),
        F.when(type_ != "DELETE", data).alias("data"),
    )


SNAPSHOTS_SQL = f"""
v_snaps AS (
  SELECT *, CASE WHEN type = 'DELETE' THEN 'Terminating' WHEN kind = 'Pod' THEN CASE WHEN n IN (7, 8, 9) THEN 'Error' WHEN m = 0 AND n >= 3 THEN 'Warning' WHEN n % 5 < 2 THEN CASE WHEN n % 2 = 0 THEN 'Ready' ELSE 'Warning' END WHEN n % 5 = 2 THEN 'Warning' WHEN n % 5 = 3 THEN 'Error' ELSE 'Ready' END
    WHEN kind = 'Deployment' THEN CASE WHEN n % 4 = 3 THEN 'Ready' WHEN n = 4 AND m = 0 THEN 'Error' ELSE 'Warning' END
    WHEN kind = 'StatefulSet' THEN CASE WHEN n % 4 = 3 THEN 'Ready' WHEN n % 5 < 3 THEN 'Warning' ELSE 'Ready' END
    WHEN kind = 'DaemonSet' THEN CASE WHEN n = 5 THEN 'Warning' ELSE 'Ready' END
    WHEN kind = 'ReplicaSet' THEN CASE WHEN n % 4 = 3 THEN 'Ready' ELSE 'Warning' END
    WHEN kind = 'Job' THEN CASE WHEN n IN (1, 3) THEN 'Error' ELSE 'Ready' END
    WHEN kind = 'Node' THEN CASE WHEN n % 5 IN (1, 2) OR n = 4 THEN 'Error' WHEN n % 5 = 3 THEN 'Warning' ELSE 'Ready' END
    WHEN kind = 'PersistentVolumeClaim' THEN ['Ready', 'Warning', 'Error'][m + 1]
    ELSE CASE WHEN n = 5 THEN 'Terminating' WHEN n % 4 = 0 THEN 'Ready' WHEN n % 4 = 2 THEN 'Warning' ELSE 'Error' END END AS status,
    CASE WHEN kind <> 'Pod' OR type = 'DELETE' THEN '' WHEN n = 9 THEN 'CrashLoopBackOff' WHEN n = 8 THEN 'ImagePullBackOff' WHEN n = 7 THEN 'OOMKilled' WHEN m = 0 AND n > 5 THEN 'VeryHighRestartCount' WHEN m = 0 AND n > 2 THEN 'HighRestartCount' ELSE '' END AS issues,
    type = 'UPDATE' AND seen AND event_id % 7 > old_generation AND m <> old_image AS config_changed
  FROM (
    SELECT *, arg_max(event_id % 7, (ts_ns, event_id)) FILTER (type <> 'DELETE') OVER w AS old_generation, arg_max(m, (ts_ns, event_id)) FILTER (type <> 'DELETE') OVER w AS old_image, count(*) FILTER (type <> 'DELETE') OVER w > 0 AS seen
    FROM (
      SELECT event_id, event_id::VARCHAR AS id, 'u' || user_id AS uid, {KINDS}[user_id % {len(KINDS)} + 1] AS kind, 'ns' || (user_id % 7) AS namespace, 'name-' || user_id AS name,
        CASE WHEN event_id % 101 = 0 THEN 'DELETE' WHEN event_type = 'signup' THEN 'CREATE' ELSE 'UPDATE' END AS type, epoch_us(ts) * 1000 AS ts_ns, event_id % 10 AS n, event_id % 3 AS m
      FROM events
    ) WINDOW w AS (PARTITION BY uid ORDER BY ts_ns RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
  )
)"""

REASONS = ["FailedScheduling", "BackOff", "FailedMount", "Unhealthy", "Scheduled", "FailedCreate", "Evicted", "Pulled"]
MESSAGES = ["read-only file system", "no space left on device", 'secret "x" not found', "image pull timeout", "forbidden: cannot list pods", "odd"]


def warning_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as snapshots of kind Event about users: id, kind, uid, type, ts_ns, involved_uid, data."""
    e, i = table(spark, sf_dir, "events"), F.col("event_id")
    pick = lambda values, at: F.element_at(F.array(*map(F.lit, values)), (at % len(values) + 1).cast("int"))
    user = F.concat(F.lit("u"), "user_id")
    involved = F.struct(user.alias("uid"), F.when(F.col("user_id") % 2 == 1, "Deployment").otherwise("Pod").alias("kind"), F.concat(F.lit("name-"), "user_id").alias("name"), F.lit("ns").alias("namespace"), F.when(F.col("user_id") % 2 == 1, "apps/v1").otherwise("v1").alias("apiVersion"))
    data = _object(involvedObject=involved, reason=pick(REASONS, F.floor(i / 2)), message=pick(MESSAGES, F.floor(i / 16)), type=F.when(i % 2 == 0, "Warning"), count=(i % 15 + 1).cast("int"))
    return e.select(i.cast("string").alias("id"), F.lit("Event").alias("kind"), F.concat(F.lit("event-"), i).alias("uid"), F.lit("CREATE").alias("type"), ts_ns(F.col("ts")).alias("ts_ns"), F.when(i % 3 == 0, user).alias("involved_uid"), data.alias("data"))


WARNINGS_SQL = f"""
v_warnings AS (
  SELECT event_id, event_id::VARCHAR AS id, 'u' || user_id AS uid, CASE WHEN user_id % 2 = 1 THEN 'Deployment' ELSE 'Pod' END AS kind, 'name-' || user_id AS name, epoch_us(ts) * 1000 AS ts_ns, {REASONS}[(event_id // 2) % 8 + 1] AS reason,
    {[m.replace('"', "@") for m in MESSAGES]}[(event_id // 16) % 6 + 1].replace('@', '"') AS message, CASE WHEN event_id % 2 = 0 THEN 'Warning' ELSE 'Normal' END AS type, (event_id % 15 + 1)::INT AS count
  FROM events
)"""


def cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest snapshots of a cluster (uid, kind, namespace, name, data): orders are pods, nations nodes and services, suppliers all that refers to others, and what is referred to is there only in part."""
    ns = lambda key: F.concat(F.lit("ns"), F.col(key) % 7)
    named = lambda prefix, key, most: F.concat(F.lit(prefix), F.col(key) % most)

    def rows(df: DataFrame, kind: str, namespace: Column, name: Column, data: Column | None = None) -> DataFrame:
        uid = F.concat_ws("/", F.lit(kind), namespace, name)
        return df.select(uid.alias("uid"), F.lit(kind).alias("kind"), namespace.alias("namespace"), name.alias("name"), (F.lit("{}") if data is None else data).alias("data"))

    orders, nation, customer, supplier, part = (table(spark, sf_dir, t) for t in ("orders", "nation", "customer", "supplier", "part"))
    pod_name = F.concat(F.lit("order-"), "o_orderkey")
    owner = F.array(F.struct(F.concat(F.lit("c"), "o_custkey").alias("uid"), F.lit("ReplicaSet").alias("kind"), F.lit(True).alias("controller")))
    claim = F.struct(F.lit("v").alias("name"), F.struct(named("pvc-", "o_orderkey", 100).alias("claimName")).alias("persistentVolumeClaim"))
    volumes = F.to_json(F.array(claim))
    more = F.format_string('[%s,{"name":"w","configMap":{"name":"cm-%d"}},{"name":"s","secret":{"secretName":"sec-%d"}}]', F.expr("substring(v, 2, length(v) - 2)"), F.col("o_orderkey") % 20, F.col("o_custkey") % 10)
    containers = F.format_string('[{"name":"c","volumeMounts":[{"name":"v","mountPath":"/d"}],"envFrom":[{"configMapRef":{"name":"cm-%d"}}],"env":[{"name":"k","valueFrom":{"secretKeyRef":{"name":"sec-%d"}}}]}]', F.col("o_custkey") % 20, F.col("o_orderkey") % 10)
    pod = F.concat(
        F.lit('{"metadata":'), _object(ownerReferences=owner, labels=F.struct(named("a", "o_custkey", 50).alias("app"), F.lit("x").alias("tier"))),
        F.lit(',"spec":{"nodeName":"node-'), (F.col("o_orderkey") % 30).cast("string"), F.lit('","serviceAccountName":"'), named("sa-", "o_custkey", 5), F.lit('","volumes":'), more, F.lit(',"containers":'), containers, F.lit("}}"),
    )
    pods = rows(orders.withColumn("v", volumes), "Pod", ns("o_custkey"), pod_name, pod)
    nodes = rows(nation, "Node", F.lit(""), F.concat(F.lit("node-"), "n_nationkey"))
    services = rows(nation, "Service", ns("n_nationkey"), F.concat(F.lit("svc-"), "n_nationkey"), _object(spec=F.struct(F.struct(F.concat(F.lit("a"), "n_nationkey").alias("app"), F.lit("x").alias("tier")).alias("selector"))))
    accounts = rows(customer.filter("c_custkey % 11 < 8"), "ServiceAccount", ns("c_custkey"), named("sa-", "c_custkey", 5)).distinct()
    claims = rows(part.filter("p_partkey % 3 > 0"), "PersistentVolumeClaim", ns("p_partkey"), named("pvc-", "p_partkey", 100)).distinct()
    configs = rows(customer, "ConfigMap", ns("c_custkey"), named("cm-", "c_custkey", 20)).distinct()
    secrets = rows(customer.filter("c_custkey % 3 = 0"), "Secret", ns("c_custkey"), named("sec-", "c_custkey", 10)).distinct()
    roles = rows(nation, "Role", ns("n_nationkey"), named("role-", "n_nationkey", 4)).distinct().union(rows(nation, "ClusterRole", F.lit(""), named("role-", "n_nationkey", 4)).distinct())
    s = F.col("s_suppkey")
    sec, svc = F.concat(F.lit("sec-"), s % 10), F.concat(F.lit("svc-"), s % 25)
    texts = {
        "RoleBinding": F.format_string('{"roleRef":{"kind":"%s","name":"role-%d"},"subjects":[{"kind":"ServiceAccount","name":"sa-%d"},{"kind":"User","name":"u"}]}', F.when(s % 2 == 0, "Role").otherwise("ClusterRole"), s % 4, s % 5),
        "Ingress": F.format_string('{"spec":{"defaultBackend":{"service":{"name":"%s"}},"rules":[{"http":{"paths":[{"backend":{"service":{"name":"svc-%d"}}}]}}]}}', svc, (s + 7) % 25),
        "HelmRelease": F.format_string('{"spec":{"valuesFrom":[{"kind":"ConfigMap","name":"cm-%d"},{"kind":"Secret","name":"%s"}],"kubeConfig":{"secretRef":{"name":"sec-%d"}}}}', s % 20, sec, (s + 3) % 10),
        "Kustomization": F.format_string('{"spec":{"decryption":{"secretRef":{"name":"%s"}}}}', sec),
        "GitRepository": F.format_string('{"spec":{"secretRef":{"name":"%s"},"verify":{"secretRef":{"name":"sec-%d"}}}}', sec, (s + 3) % 10),
        "HTTPRoute": F.format_string('{"spec":{"rules":[{"backendRefs":[{"name":"%s"},{"name":"svc-%d","namespace":"ns%d"}]}]}}', svc, (s + 7) % 25, (s + 7) % 25 % 7),
        "ExternalSecret": F.format_string('{"metadata":{"name":"x"},"spec":{"target":{"name":"%s"}}}', sec),
        "Application": F.format_string('{"spec":{"sources":[{"usernameSecret":{"name":"%s"},"helm":{"valuesFrom":[{"kind":"ConfigMap","name":"cm-%d"}]}}]}}', sec, s % 20),
    }
    others = [rows(supplier.filter(s % len(texts) == i), kind, F.concat(F.lit("ns"), s % 7), F.concat(F.lit("x-"), s), text) for i, (kind, text) in enumerate(texts.items())]
    out = pods
    for df in (nodes, services, accounts, claims, configs, secrets, roles, *others):
        out = out.union(df)
    return out


#: What refers to what, as (src, type, kind, namespace, name) of the target; and the targets that are there.
CLUSTER_SQL = """
v_pods AS (SELECT o_orderkey AS o, o_custkey AS c, 'ns' || (o_custkey % 7) AS ns, 'Pod/ns' || (o_custkey % 7) || '/order-' || o_orderkey AS uid FROM orders),
v_suppliers AS (SELECT s_suppkey AS s, s_suppkey % 8 AS k, 'ns' || (s_suppkey % 7) AS ns, ['RoleBinding', 'Ingress', 'HelmRelease', 'Kustomization', 'GitRepository', 'HTTPRoute', 'ExternalSecret', 'Application'][s_suppkey % 8 + 1] || '/ns' || (s_suppkey % 7) || '/x-' || s_suppkey AS uid FROM supplier),
v_claims AS (SELECT DISTINCT 'ns' || (p_partkey % 7) AS ns, 'pvc-' || (p_partkey % 100) AS name FROM part WHERE p_partkey % 3 > 0),
v_there AS (
  SELECT 'Node' AS kind, '' AS ns, 'node-' || n_nationkey AS name FROM nation UNION ALL SELECT 'Service', 'ns' || (n_nationkey % 7), 'svc-' || n_nationkey FROM nation
  UNION ALL SELECT DISTINCT 'ServiceAccount', 'ns' || (c_custkey % 7), 'sa-' || (c_custkey % 5) FROM customer WHERE c_custkey % 11 < 8
  UNION ALL SELECT 'PersistentVolumeClaim', ns, name FROM v_claims
  UNION ALL SELECT DISTINCT 'ConfigMap', 'ns' || (c_custkey % 7), 'cm-' || (c_custkey % 20) FROM customer
  UNION ALL SELECT DISTINCT 'Secret', 'ns' || (c_custkey % 7), 'sec-' || (c_custkey % 10) FROM customer WHERE c_custkey % 3 = 0
  UNION ALL SELECT DISTINCT 'Role', 'ns' || (n_nationkey % 7), 'role-' || (n_nationkey % 4) FROM nation UNION ALL SELECT DISTINCT 'ClusterRole', '', 'role-' || (n_nationkey % 4) FROM nation
), v_wanted AS (
  SELECT uid AS src, 'SCHEDULED_ON' AS type, 'Node' AS kind, '' AS ns, 'node-' || (o % 30) AS name FROM v_pods
  UNION ALL SELECT uid, 'MOUNTS', 'PersistentVolumeClaim', ns, 'pvc-' || (o % 100) FROM v_pods UNION ALL SELECT uid, 'USES_SERVICE_ACCOUNT', 'ServiceAccount', ns, 'sa-' || (c % 5) FROM v_pods
  UNION ALL SELECT uid, 'REFERENCES_SPEC', 'ConfigMap', ns, 'cm-' || (o % 20) FROM v_pods UNION ALL SELECT uid, 'REFERENCES_SPEC', 'ConfigMap', ns, 'cm-' || (c % 20) FROM v_pods
  UNION ALL SELECT uid, 'REFERENCES_SPEC', 'Secret', ns, 'sec-' || (c % 10) FROM v_pods UNION ALL SELECT uid, 'REFERENCES_SPEC', 'Secret', ns, 'sec-' || (o % 10) FROM v_pods
  UNION ALL SELECT uid, 'BINDS_ROLE', CASE WHEN s % 2 = 0 THEN 'Role' ELSE 'ClusterRole' END, CASE WHEN s % 2 = 0 THEN ns ELSE '' END, 'role-' || (s % 4) FROM v_suppliers WHERE k = 0
  UNION ALL SELECT uid, 'GRANTS_TO', 'ServiceAccount', ns, 'sa-' || (s % 5) FROM v_suppliers WHERE k = 0
  UNION ALL SELECT uid, 'REFERENCES_SPEC', 'Service', ns, 'svc-' || (s % 25) FROM v_suppliers WHERE k IN (1, 5) UNION ALL SELECT uid, 'REFERENCES_SPEC', 'Service', ns, 'svc-' || ((s + 7) % 25) FROM v_suppliers WHERE k = 1
  UNION ALL SELECT uid, 'REFERENCES_SPEC', 'Service', 'ns' || ((s + 7) % 25 % 7), 'svc-' || ((s + 7) % 25) FROM v_suppliers WHERE k = 5
  UNION ALL SELECT uid, 'REFERENCES_SPEC', 'ConfigMap', ns, 'cm-' || (s % 20) FROM v_suppliers WHERE k IN (2, 7) UNION ALL SELECT uid, 'REFERENCES_SPEC', 'Secret', ns, 'sec-' || (s % 10) FROM v_suppliers WHERE k IN (2, 3, 4, 6, 7)
  UNION ALL SELECT uid, 'REFERENCES_SPEC', 'Secret', ns, 'sec-' || ((s + 3) % 10) FROM v_suppliers WHERE k IN (2, 4)
)"""


def dashboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as dashboards (uid, title, version, tags, panels, templating), each with a panel of two queries."""
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    target = lambda ref, expr, source: F.struct(F.lit(ref).alias("refId"), expr.alias("expr"), source.alias("datasource"))
    one = F.format_string('sum(rate(m_%d{app="a%d", cluster="c%d", pod=~"x.*"}[5m])) by (pod)', k % 50, k % 7, k % 3)
    two = F.when(k % 4 == 0, F.format_string("rate($metric{namespace=\"n%d\"}[5m])", k % 5)).otherwise(F.format_string('histogram_quantile(0.9, b_%d) / n_%d{job="j%d", namespace="n%d"}', k % 20, k % 30, k % 5, k % 5))
    panel = F.struct(F.lit(1).alias("id"), F.col("p_name").alias("title"), F.lit("graph").alias("type"), F.array(target("A", one, F.lit('{"uid":"ds"}')), target("B", two, F.lit('"plain"'))).alias("targets"))
    tags = F.when(k % 3 == 0, F.array(F.lit("Overview"))).when(k % 3 == 1, F.array(F.lit("x"), F.lit("level:drilldown"))).otherwise(F.array().cast("array<string>"))
    variable = F.array(F.struct(F.element_at(F.array(*map(F.lit, ["my_cluster", "namespace", "handler", "zzz"])), (k % 4 + 1).cast("int")).alias("name"), F.lit("query").alias("type")))
    return p.select(F.concat(F.lit("d"), k).alias("uid"), F.col("p_name").alias("title"), F.lit(1).alias("version"), tags.alias("tags"), F.array(panel).alias("panels"), variable.alias("templating"))
