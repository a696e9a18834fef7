"""Anomaly detectors: functions from a window's events to rows (uid, kind, category, type, severity, ts_ns, summary).

`Window` rows: `changes` are change events (id, uid, kind, ts_ns, event_type, status, issues, config_changed, data, and
facts if they are parsed already),
`warnings` are warning events (id, uid, kind, ts_ns, reason, message, type, count), `diffs` difference rows of the
changes (uid, kind, id, ts_ns, path, op, old, new). A detector is a projection or one aggregation, so all are a union.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.functions.facts import facts, part
from opsgraph.functions.status import condition, container_issues
from opsgraph.operators import rules
from opsgraph.operators.timeline import by_time

MINUTE_NS = 60_000_000_000
WORKLOADS = ["Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Job", "CronJob", "Pod"]


@dataclass
class Seen:
    """What detectors look at."""

    changes: DataFrame
    warnings: DataFrame
    diffs: DataFrame
    end_ns: int


def severity(category: Column, kind: Column, type_: Column) -> Column:
    """The severity of an anomaly: that of its kind's own row, else of the category's and type's, else medium."""
    out = None
    for own in (True, False):  # rows of a kind first
        for c, t, k, level in rules.SEVERITY:
            if bool(k) == own:
                fits = (category == c) & (type_ == t) & ((kind == k) if k else F.lit(True))
                out = F.when(fits, level) if out is None else out.when(fits, level)
    return out.otherwise("medium")


def reason_severity(reason: Column) -> Column:
    """The severity of an event reason."""
    table = F.create_map(*[F.lit(x) for row in rules.REASON_SEVERITY.items() for x in row])
    return F.coalesce(F.element_at(table, reason), F.lit("medium"))


def found(rows: DataFrame, category: str, type_: Column | str, summary: Column | str, ts: Column | None = None, level: Column | None = None) -> DataFrame:
    """rows as anomalies; rows with a null type are none."""
    t, s = (F.lit(x) if isinstance(x, str) else x for x in (type_, summary))
    out = rows.select("uid", "kind", F.lit(category).alias("category"), t.alias("type"), (F.col("ts_ns") if ts is None else ts).alias("ts_ns"), s.alias("summary"), (F.lit(None).cast("string") if level is None else level).alias("level"))
    return out.filter("type is not null").select("uid", "kind", "category", "type", F.coalesce("level", severity(F.col("category"), F.col("kind"), F.col("type"))).alias("severity"), "ts_ns", "summary")


def _rules(*pairs: tuple[Column, str | Column]) -> Column:
    out = F.lit(None).cast("string")
    for when, then in reversed(pairs):
        out = F.when(when, then).otherwise(out)
    return out


def warning_events(w: Seen) -> DataFrame:
    """The first warning of each reason; reasons and messages that tell more are given a type of their own, later rules first."""
    reason, m = F.col("reason"), F.lower("message")
    mount = reason.isin("FailedMount", "FailedAttachVolume")
    image = reason.isin("Failed", "ErrImagePull", "ImagePullBackOff", "BackOff") & m.rlike("image|pull")
    kind = _rules(
        (m.rlike("read-only file ?system"), "ReadOnlyFilesystem"),
        (m.rlike("no space left|disk quota|out of space"), "VolumeOutOfSpace"),
        (mount & ~m.rlike("(secret|configmap).*not found"), "VolumeMountFailed"),
        (image & m.rlike("timeout|deadline"), "ImagePullTimeout"),
        (image & m.rlike("unauthorized|authentication|denied"), "RegistryAuthFailed"),
        (image & m.rlike("not found|manifest unknown"), "ImageNotFound"),
        (m.rlike("forbidden"), "RBACDenied"),
        (mount & m.rlike("(secret|configmap).*not found"), "InvalidConfigReference"),
        ((reason == "FailedCreate") & F.col("kind").isin("Deployment", "ReplicaSet"), "ReplicaCreationFailure"),
        (F.lit(True), reason),
    )
    rows = w.warnings.filter((F.col("type") == "Warning") & ~reason.isin(*rules.BENIGN_REASONS))
    first = F.row_number().over(Window.partitionBy("uid", "reason").orderBy("ts_ns", "id"))
    rows = rows.withColumn("nth", first).filter("nth = 1").withColumn("as_type", kind)
    level = F.when(F.col("as_type") == reason, reason_severity(reason))
    return found(rows, "Event", F.col("as_type"), F.concat_ws(": ", "reason", "message"), level=level)


def high_frequency(w: Seen) -> DataFrame:
    return found(w.warnings.filter("count > 10"), "Event", "HighFrequencyEvent", F.concat_ws(" ", "reason", F.lit("seen"), "count", F.lit("times")))


def repeated(w: Seen, least: int = 3) -> DataFrame:
    """A reason in at least three events; at the end of the window."""
    rows = w.warnings.groupBy("uid", "kind", "reason").agg(F.count("*").alias("n"), F.sum("count").alias("total")).filter(F.col("n") >= least)
    return found(rows, "Event", "RepeatedEvent", F.concat_ws(" ", "reason", F.lit("in"), "n", F.lit("events,"), "total", F.lit("times")), F.lit(w.end_ns))


def _facts(rows: DataFrame) -> Column:
    """The facts of the rows' snapshots: a column of theirs if there is one, else parsed from data."""
    return F.col("facts") if "facts" in rows.columns else facts(F.col("data"))


def container_states(w: Seen) -> DataFrame:
    """Issues of containers, and failing init containers."""
    f = _facts(w.changes)
    rows = w.changes.filter("kind = 'Pod'").withColumn("f", f)
    issues = rows.select("uid", "kind", "ts_ns", F.explode(container_issues(F.col("f"))).alias("i"))
    of_type = F.when(F.col("i.type").isin("CrashLoopBackOff", "ImagePullBackOff", "ErrImagePull", "OOMKilled"), F.col("i.type"))
    init = rows.select("uid", "kind", "ts_ns", F.explode("f.status.initContainerStatuses").alias("c")).filter((F.col("c.state.terminated.exitCode") != 0) | F.col("c.state.waiting.reason").isin("CrashLoopBackOff", "Error"))
    waiting = rows.select("uid", "kind", "ts_ns", F.explode("f.status.containerStatuses").alias("c"))
    create = F.when(F.col("c.state.waiting.reason").isin("CreateContainerConfigError", "CreateContainerError", "RunContainerError"), "ContainerCreateError").when(F.col("c.state.waiting.reason") == "InvalidImageName", "ImagePullError")
    return found(issues, "State", of_type, F.concat_ws(": ", "i.container", "i.type")).union(found(init, "State", "InitContainerFailed", F.concat_ws(" ", F.lit("init container"), "c.name"))).union(found(waiting, "State", create, F.concat_ws(": ", "c.name", "c.state.waiting.reason")))


def bad_status(w: Seen) -> DataFrame:
    kind = F.when(F.col("status") == "Error", "ErrorStatus").when(F.col("status") == "Terminating", "TerminatingStatus")
    return found(w.changes, "State", kind, F.concat(F.lit("status is "), F.col("status")))


def pod_phases(w: Seen) -> DataFrame:
    """Failed, evicted and unschedulable pods, and pods pending for five minutes."""
    phase, reason = part(F.col("data"), "status.phase"), part(F.col("data"), "status.reason")
    pods = w.changes.filter("kind = 'Pod'").withColumn("phase", phase).withColumn("reason", reason)
    f = condition(_facts(w.changes), "PodScheduled")
    kind = F.when(F.col("reason") == "Evicted", "Evicted").when(F.col("phase") == "Failed", "PodFailed").when((f["status"] == "False") & (f["reason"] == "Unschedulable"), "Unschedulable")
    waits = pods.filter("phase = 'Pending'").groupBy("uid", "kind").agg(F.min("ts_ns").alias("a"), F.max("ts_ns").alias("ts_ns")).filter(F.col("ts_ns") - F.col("a") >= 5 * MINUTE_NS)
    return found(pods, "State", kind, F.concat_ws(": ", "phase", "reason")).union(found(waits, "State", "PodPending", "pending for over five minutes"))


def node_conditions(w: Seen) -> DataFrame:
    rows = w.changes.filter("kind = 'Node'").select("uid", "kind", "ts_ns", F.explode(_facts(w.changes)["status"]["conditions"]).alias("c"))
    on = F.col("c.status") == "True"
    kind = F.when((F.col("c.type") == "Ready") & ~on, "NodeNotReady").when((F.col("c.type") == "DiskPressure") & on, "DiskPressure").when((F.col("c.type") == "MemoryPressure") & on, "NodeMemoryPressure").when((F.col("c.type") == "PIDPressure") & on, "NodePIDPressure")
    return found(rows, "State", kind, F.concat_ws(": ", "c.type", "c.reason"))


def rollouts(w: Seen) -> DataFrame:
    """A passed progress deadline; or a config change after which replicas stay unavailable."""
    rows = w.changes.filter(F.col("kind").isin("Deployment", "StatefulSet", "DaemonSet"))
    late = part(F.col("data"), "status.conditions").contains("ProgressDeadlineExceeded")
    missing = F.coalesce(part(F.col("data"), "status.unavailableReplicas").cast("int"), F.lit(0))
    stuck = rows.groupBy("uid", "kind").agg(F.bool_or("config_changed").alias("cfg"), F.max_by(missing, F.struct("ts_ns", "id")).alias("missing"), F.max("ts_ns").alias("ts_ns"), F.bool_or(late).alias("late"))
    kind = F.when(F.col("late") | (F.col("cfg") & (F.col("missing") > 0)), "RolloutStuck")
    rows = w.changes.filter("kind = 'StatefulSet'").withColumn("cfg", F.max(F.col("config_changed").cast("int")).over(by_time().rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    back = F.when((F.col("cfg") == 1) & (part(F.col("data"), "status.currentRevision") != part(F.col("data"), "status.updateRevision")), "UpdateRollback")
    return found(stuck, "State", kind, "the rollout makes no progress").union(found(rows, "State", back, "revisions differ after a change"))


def endpoints(w: Seen) -> DataFrame:
    """Services and slices without a ready endpoint, and ingresses without a backend."""
    ready = "array<struct<conditions:struct<ready:boolean>>>"
    points = F.from_json(part(F.col("data"), "endpoints"), ready)
    none = (F.col("kind") == "EndpointSlice") & ~F.exists(F.coalesce(points, F.array().cast(ready)), lambda e: F.coalesce(e["conditions"]["ready"], F.lit(False)))
    text = F.lower("data")
    kind = F.when(none | ((F.col("kind") == "Service") & text.rlike("no (ready )?endpoints")), "NoReadyEndpoints").when((F.col("kind") == "Ingress") & text.rlike("backend.*(down|unavailable|not found)|no endpoints"), "BackendDown")
    return found(w.changes, "State", kind, "no ready endpoint")


def gitops(w: Seen) -> DataFrame:
    rows = w.changes.filter(F.col("kind").isin("HelmRelease", "Kustomization")).select("uid", "kind", "ts_ns", F.explode(_facts(w.changes)["status"]["conditions"]).alias("c"))
    off = F.col("c.status") == "False"
    reasons = F.col("c.reason").isin("ReconciliationFailed", "BuildFailed", "HealthCheckFailed", "DependencyNotReady")
    bad = off & (F.col("c.type").isin("Ready", "Released") | ((F.col("c.type") == "Reconciling") & reasons))
    return found(rows, "State", F.when(bad, F.concat(F.col("kind"), F.lit("Failed"))), F.concat_ws(": ", "c.type", "c.reason", "c.message"))


def claims(w: Seen) -> DataFrame:
    rows = w.changes.filter("kind = 'PersistentVolumeClaim'").withColumn("phase", part(F.col("data"), "status.phase"))
    per = rows.groupBy("uid", "kind").agg(F.bool_or(F.col("phase") == "Lost").alias("lost"), F.min(F.when(F.col("phase") == "Pending", F.col("ts_ns"))).alias("a"), F.max(F.when(F.col("phase") == "Pending", F.col("ts_ns"))).alias("b"), F.max("ts_ns").alias("ts_ns"))
    return found(per, "State", F.when(F.col("lost") | (F.col("b") - F.col("a") >= MINUTE_NS), "PVCBindingFailed"), "the claim isn't bound")


def config_changes(w: Seen) -> DataFrame:
    """Config changes by kind, without those of replicas or status only and the usual ones of ReplicaSets."""
    paths = w.diffs.groupBy("id").agg(F.bool_and(F.col("path").isin("spec.replicas", "metadata.generation") | F.col("path").startswith("status")).alias("only"))
    rows = w.changes.filter("config_changed and kind != 'ReplicaSet'").join(paths, "id", "left").filter(~F.coalesce("only", F.lit(False)))
    named = {"ConfigMap": "ConfigChange", "Secret": "SecretChange", "HelmRelease": "HelmReleaseUpdated", "Kustomization": "KustomizationUpdated", **{k: f"{k}Modified" for k in ("Role", "ClusterRole", "RoleBinding", "ClusterRoleBinding")}, **{k: "WorkloadSpecModified" for k in ("Deployment", "StatefulSet", "DaemonSet", "Job", "CronJob")}}
    kind = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in named.items() for x in kv]), F.col("kind")), F.lit("SpecModified"))
    return found(rows, "Change", kind, F.concat(F.col("kind"), F.lit(" was changed")))


def diff_changes(w: Seen) -> DataFrame:
    """Taints, images, environment, resource limits, chart values, and chart versions up or down."""
    p = F.col("path")
    kind = _rules(
        ((F.col("kind") == "Node") & p.startswith("spec.taints") & (F.col("op") == "add"), "TaintAdded"),
        (p.rlike(r"containers\[[^\]]*\]\.image$"), "ImageChanged"),
        (p.rlike(r"containers\[[^\]]*\]\.env"), "EnvironmentChanged"),
        (p.rlike(r"containers\[[^\]]*\]\.resources"), "ResourceLimitsChanged"),
        ((F.col("kind") == "HelmRelease") & p.startswith("spec.values"), "ValuesChanged"),
        ((F.col("kind") == "HelmRelease") & (p == "spec.chart.spec.version") & version_less(F.col("old"), F.col("new")), "HelmUpgrade"),
        ((F.col("kind") == "HelmRelease") & (p == "spec.chart.spec.version"), "HelmRollback"),
    )
    return found(w.diffs, "Change", kind, F.concat_ws(" ", "op", "path"))


def version_less(a: Column, b: Column) -> Column:
    """Is version a before b, compared segment by segment as numbers?"""
    parts = lambda v: F.transform(F.split(F.regexp_replace(v, r'["v]', ""), r"[.+-]"), lambda s: F.coalesce(s.try_cast("int"), F.lit(0)))
    return F.coalesce(F.array_max(F.array(parts(a))) != parts(b), F.lit(False)) & (parts(a) < parts(b))


def lifecycle(w: Seen) -> DataFrame:
    t, kind = F.col("event_type"), F.col("kind")
    created = (t == "CREATE") & kind.isin(*WORKLOADS, "Role", "ClusterRole", "RoleBinding", "ClusterRoleBinding", "ServiceAccount")
    a = found(w.changes, "Change", F.when(t == "DELETE", "ResourceDeleted").when(created, "ResourceCreated"), F.concat_ws(" ", "kind", F.lower("event_type")))
    return a.union(found(w.changes, "State", F.when((t == "DELETE") & kind.isin("ConfigMap", "Secret"), "Deleted"), F.concat(kind, F.lit(" was deleted"))))


def flapping(w: Seen, least: int = 3) -> DataFrame:
    """At least three changes of status."""
    rows = w.changes.withColumn("turn", F.coalesce(F.lag("status").over(by_time()) != F.col("status"), F.lit(False)).cast("int"))
    rows = rows.groupBy("uid", "kind").agg(F.sum("turn").alias("n"), F.max("ts_ns").alias("ts_ns")).filter(F.col("n") >= least)
    return found(rows, "Frequency", "FlappingState", F.concat_ws(" ", "n", F.lit("changes of status")))


def restarts(w: Seen, most: int = 3) -> DataFrame:
    n = F.array_max(F.transform(_facts(w.changes)["status"]["containerStatuses"], lambda c: c["restartCount"]))
    from_diffs = w.diffs.filter(F.col("path").endswith("restartCount")).select("uid", "kind", "ts_ns", F.col("new").try_cast("int").alias("n"))
    rows = w.changes.select("uid", "kind", "ts_ns", n.alias("n")).union(from_diffs).groupBy("uid", "kind").agg(F.max("n").alias("n"), F.max("ts_ns").alias("ts_ns"))
    return found(rows.filter(F.col("n") > most), "Frequency", "HighRestartCount", F.concat_ws(" ", "n", F.lit("restarts")))


def config_and_network(w: Seen) -> DataFrame:
    text = F.lower("data")
    policy = F.when((F.col("kind") == "NetworkPolicy") & part(F.col("data"), "spec.policyTypes").contains("Ingress"), "IngressRestriction")
    denied = F.when(F.lower("message").rlike("forbidden|cannot (get|list|watch|create|update|delete)|permission"), "InsufficientPermissions")
    refused = F.when(text.rlike("connection refused|no route to host"), "ConnectionRefused")
    return found(w.changes, "Config", policy, "traffic is restricted").union(found(w.warnings, "Config", denied, F.col("message"))).union(found(w.changes, "Network", refused, "connection refused"))


#: Detectors by name; a caller may add own functions Seen -> anomalies.
DETECTORS: dict[str, Callable[[Seen], DataFrame]] = {f.__name__: f for f in (warning_events, high_frequency, repeated, container_states, bad_status, pod_phases, node_conditions, rollouts, endpoints, gitops, claims, config_changes, diff_changes, lifecycle, flapping, restarts, config_and_network)}


def detect(w: Seen, detectors: dict[str, Callable[[Seen], DataFrame]] | None = None) -> DataFrame:
    """All detectors' anomalies; of those that agree in uid, category, type and second, the first."""
    out = None
    for detector in (detectors or DETECTORS).values():
        rows = detector(w)
        out = rows if out is None else out.unionByName(rows)
    first = F.row_number().over(Window.partitionBy("uid", "category", "type", F.floor(F.col("ts_ns") / 1_000_000_000)).orderBy("ts_ns", "summary"))
    return out.withColumn("nth", first).filter("nth = 1").drop("nth")


def services_without_pods(services: DataFrame, edges: DataFrame, anomalies: DataFrame, ts_ns: int) -> DataFrame:
    """Services (uid, kind, with a selector) that select nothing, or only pods that fail."""
    bad = anomalies.filter(F.col("type").isin(*rules.POD_FAILURES)).select(F.col("uid").alias("dst"), F.lit(1).alias("bad")).distinct()
    picks = edges.filter("type = 'SELECTS'").join(bad, "dst", "left").groupBy(F.col("src").alias("uid")).agg(F.count("*").alias("n"), F.count("bad").alias("n_bad"))
    rows = services.join(picks, "uid", "left").filter(F.coalesce("n", F.lit(0)) == F.coalesce("n_bad", F.lit(0)))
    return found(rows, "State", "NoReadyEndpoints", "no selected pod is ready", F.lit(ts_ns))


def missing_targets(edges: DataFrame, resources: DataFrame, ts_ns: int) -> DataFrame:
    """Resources that mount, or run as, something that isn't there (dst unknown)."""
    rows = edges.filter(F.col("type").isin("MOUNTS", "USES_SERVICE_ACCOUNT", "REFERENCES_SPEC")).join(resources.select(F.col("uid").alias("dst")), "dst", "left_anti")
    rows = rows.join(resources.select(F.col("uid").alias("src"), "kind"), "src").withColumnRenamed("src", "uid").withColumnRenamed("type", "edge")
    kind = F.when(F.col("edge") == "USES_SERVICE_ACCOUNT", "ServiceAccountMissing").otherwise("SecretMissing")
    return found(rows, "State", kind, F.concat(F.lit("missing "), F.col("dst")), F.lit(ts_ns))


def missing_references(missing: DataFrame, resources: DataFrame, ts_ns: int) -> DataFrame:
    """Resources that mount, run as or read something of a name that no resource has: references (src, type, kind, namespace, name) left over when edges are built."""
    rows = missing.filter(F.col("type").isin("MOUNTS", "USES_SERVICE_ACCOUNT", "REFERENCES_SPEC")).withColumnRenamed("kind", "wanted").withColumnRenamed("type", "edge")
    rows = rows.join(resources.select(F.col("uid").alias("src"), "kind"), "src").withColumnRenamed("src", "uid")
    kind = F.when(F.col("edge") == "USES_SERVICE_ACCOUNT", "ServiceAccountMissing").otherwise("SecretMissing")
    return found(rows, "State", kind, F.concat(F.lit("missing "), F.concat_ws("/", "wanted", "namespace", "name")), F.lit(ts_ns))


def expired_certificates(latest: DataFrame, as_of_ns: int) -> DataFrame:
    until = F.unix_micros(F.to_timestamp(part(F.col("data"), "status.notAfter"))) * 1000
    return found(latest.filter("kind = 'Certificate'").withColumn("until", until).filter(F.col("until") < as_of_ns), "State", "CertExpired", "the certificate has expired", F.lit(as_of_ns))


def summary(anomalies: DataFrame) -> DataFrame:
    """(by, name, n): anomalies by severity and by category."""
    count = lambda c: anomalies.groupBy(c).agg(F.count("*").alias("n")).select(F.lit(c).alias("by"), F.col(c).alias("name"), "n")
    return count("severity").union(count("category"))
