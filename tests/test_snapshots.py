"""Status, issues, differences and patterns of snapshots."""

from __future__ import annotations

import json

import pytest
from opsgraph.functions import json_diff as jd
from opsgraph.functions import status as st
from opsgraph.functions.facts import canonical, facts
from opsgraph.operators import changes, significance
from pyspark.sql import functions as F


def cond(**by_type):
    return [{"type": k, "status": v} if isinstance(v, str) else {"type": k, **v} for k, v in by_type.items()]


CASES = [
    ("Deployment", {"spec": {"replicas": 2}, "status": {"readyReplicas": 2, "availableReplicas": 2}}, "Ready"),
    ("Deployment", {"spec": {"replicas": 2}, "status": {"readyReplicas": 1, "unavailableReplicas": 1}}, "Warning"),
    ("Deployment", {"spec": {"replicas": 2}, "status": {"conditions": cond(Available={"status": "False", "reason": "Timeout"})}}, "Error"),
    ("StatefulSet", {"spec": {"replicas": 3}, "status": {"readyReplicas": 3}}, "Ready"),
    ("DaemonSet", {"status": {"desiredNumberScheduled": 2, "numberReady": 2}}, "Ready"),
    ("DaemonSet", {"status": {"desiredNumberScheduled": 2, "numberReady": 2, "numberMisscheduled": 1}}, "Warning"),
    ("ReplicaSet", {"spec": {"replicas": 1}, "status": {"readyReplicas": 0}}, "Warning"),
    ("Pod", {"status": {"phase": "Running", "conditions": cond(Ready="True")}}, "Ready"),
    ("Pod", {"status": {"phase": "Running", "conditions": cond(Ready="False")}}, "Warning"),
    ("Pod", {"status": {"phase": "Running", "containerStatuses": [{"name": "a", "restartCount": 1, "state": {"waiting": {"reason": "CrashLoopBackOff"}}}]}}, "Error"),
    ("Pod", {"status": {"phase": "Running", "containerStatuses": [{"name": "a", "restartCount": 7}]}}, "Warning"),
    ("Node", {"status": {"conditions": cond(Ready="True", MemoryPressure="True")}}, "Warning"),
    ("Node", {"status": {"conditions": cond(Ready="Unknown")}}, "Error"),
    ("Job", {"status": {"failed": 1}}, "Error"),
    ("PersistentVolumeClaim", {"status": {"phase": "Lost"}}, "Error"),
    ("Secret", {}, "Ready"),
    ("HelmRelease", {"status": {"conditions": cond(ready={"status": "False", "reason": "InstallFailed"})}}, "Error"),
    ("HelmRelease", {"status": {"conditions": cond(Stalled="True")}}, "Error"),
    ("HelmRelease", {"metadata": {"deletionTimestamp": "2024-01-01T00:00:00Z"}}, "Terminating"),
    ("Other", {"status": "odd"}, "Ready"),
]


def test_infer_status(spark):
    rows = [(i, k, json.dumps(d), "UPDATE") for i, (k, d, _) in enumerate(CASES)] + [(98, "Pod", None, "DELETE"), (99, "Pod", "not json", "CREATE")]
    df = spark.createDataFrame(rows, "i int, kind string, data string, type string")
    got = dict(df.select("i", st.infer_status(F.col("kind"), facts(F.col("data")), F.col("type"))).collect())
    assert got == {**{i: want for i, (_, _, want) in enumerate(CASES)}, 98: "Terminating", 99: "Ready"}


def test_issues_and_messages(spark):
    pod = {"status": {"phase": "Pending", "containerStatuses": [{"name": "a", "restartCount": 12, "lastState": {"terminated": {"exitCode": 137}}}, {"name": "b", "restartCount": 11}], "initContainerStatuses": [{"name": "i", "state": {"waiting": {"reason": "ErrImagePull", "message": "no"}}}]}}
    df = spark.createDataFrame([(json.dumps(pod),)], "data string").withColumn("f", facts(F.col("data")))
    row = df.select(st.container_issues(F.col("f")).alias("i"), st.error_messages(F.lit("Pod"), F.col("f"), F.lit("Error")).alias("m"), st.highest_impact(st.container_issues(F.col("f"))).alias("top"), st.impact_score(F.lit("Error"), F.lit(1)).alias("s")).first()
    assert [(i["container"], i["type"]) for i in row["i"]] == [("a", "OOMKilled"), ("b", "VeryHighRestartCount"), ("i", "ErrImagePull")]
    assert row["m"][2:] == ["i ErrImagePull: no", "Pending"]
    assert (row["top"], row["s"]) == (0.4, 1.0)


OLD = {"metadata": {"generation": 1}, "spec": {"replicas": 1, "containers": [{"name": "a", "image": "x:1"}, {"name": "b", "image": "y:1"}], "args": [1, 2]}, "status": {"phase": "Running"}}
NEW = {"metadata": {"generation": 2}, "spec": {"replicas": 1, "containers": [{"name": "b", "image": "y:1"}, {"name": "a", "image": "x:2"}], "args": [1, 3, 4]}, "status": {"phase": "Failed"}}


def test_json_diff_matches_arrays_by_key(spark):
    row = spark.range(1).select(jd.json_diff(F.lit(json.dumps(OLD)), F.lit(json.dumps(NEW)))).first()[0]
    assert [tuple(d) for d in row] == [
        ("metadata.generation", "replace", "1", "2"),
        ("spec.args[1]", "replace", "2", "3"),
        ("spec.args[2]", "add", None, "4"),
        ("spec.containers[name=a].image", "replace", '"x:1"', '"x:2"'),
        ("status.phase", "replace", '"Running"', '"Failed"'),
    ]


def test_filters_and_unified_diff(spark):
    df = spark.createDataFrame([(json.dumps(OLD), json.dumps(NEW))], "old string, new string").withColumn("d", jd.json_diff("old", "new"))
    row = df.select(F.size(jd.without_noise(F.col("d"))), F.size(jd.spec_only(F.col("d"))), F.size(jd.status_only(F.col("d"))), jd.unified_diff(jd.spec_only(F.col("d")))).first()
    assert tuple(row)[:3] == (4, 3, 1)
    assert row[3].split("\n")[:3] == ["@@ spec @@", "-  args[1]: 2", "+  args[1]: 3"]


def event(i, uid, kind, type_, ts, data):
    return (str(i), uid, kind, "ns", uid, type_, ts, None if data is None else json.dumps(data))


EVENT = "id string, uid string, kind string, namespace string, name string, type string, ts_ns long, data string"


def test_detect_changes(spark):
    rows = [event(1, "p", "Pod", "CREATE", 1, OLD), event(2, "p", "Pod", "UPDATE", 2, NEW), event(3, "p", "Pod", "UPDATE", 3, NEW), event(4, "p", "Pod", "DELETE", 4, None), event(5, "c", "ConfigMap", "CREATE", 1, {"data": {"a": "1", "b": "2"}}), event(6, "c", "ConfigMap", "UPDATE", 2, {"data": {"b": "2", "a": "1"}}), event(7, "c", "ConfigMap", "UPDATE", 3, {"data": {"a": "3"}})]
    got = {r["id"]: (r["config_changed"], r["status_changed"]) for r in changes.detect_changes(spark.createDataFrame(rows, EVENT)).collect()}
    assert got == {"1": (False, True), "2": (True, True), "3": (False, True), "4": (False, False), "5": (False, True), "6": (False, False), "7": (True, False)}


def test_order_of_keys_is_no_change(spark):
    """At any depth, while other types, orders of arrays and texts that look like numbers are."""
    pairs = [
        ('{"a": {"b": {"x": 1, "y": [{"p": 1, "q": 2}]}}}', '{"a": {"b": {"y": [{"q": 2, "p": 1}], "x": 1}}}', True),
        ('{"a": [1, 2]}', '{"a": [2, 1]}', False),
        ('{"a": "1"}', '{"a": 1}', False),
        ('{"a": 1.0}', '{"a": 1}', True),
        ('{"a": null}', "{}", False),
        ("bad", "bad", True),
    ]
    df = spark.createDataFrame([(i, *p[:2]) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = dict(df.select("i", canonical(F.col("a")).eqNullSafe(canonical(F.col("b")))).collect())
    assert got == {i: p[2] for i, p in enumerate(pairs)}


def test_change_categories(spark):
    rows = [event(1, "p", "Pod", "CREATE", 1, OLD), event(2, "p", "Pod", "UPDATE", 2, NEW)]
    got = changes.change_categories(spark.createDataFrame(rows, EVENT)).orderBy("id").collect()
    assert [tuple(r)[3:] for r in got] == [(False,) * 4, (True, True, False, False)]


def test_resource_patterns(spark):
    rows = [("u", "Pod", "1", 1, "status.containerStatuses[name=a].state.terminated.exitCode", "replace", "0", "137"), ("u", "Deployment", "2", 1, "status.unavailableReplicas", "replace", "0", "2"), ("u", "Pod", "4", 1, "status.containerStatuses[name=b].state.waiting.reason", "add", None, '"VolumeMountError"'), ("u", "Pod", "5", 1, "status.conditions[type=Ready].reason", "replace", '"x"', '"LivenessProbe: ReadinessProbe"'), ("u", "Pod", "6", 1, "status.containerStatuses[name=c].state.terminated.reason", "add", None, '"Completed"'), ("u", "Pod", "7", 1, "status.initContainerStatuses[name=c].state.running", "remove", "{}", None), ("u", "Pod", "3", 1, "spec.x", "add", None, "1")]
    df = spark.createDataFrame(rows, "uid string, kind string, id string, ts_ns long, path string, op string, old string, new string")
    got = sorted((r["id"], r["type"], r["container"], r["severity"]) for r in significance.resource_patterns(df).collect())
    assert got == [
        ("1", "ContainerOOMKilled", "a", 0.5),
        ("2", "ReplicasUnavailable", "", 0.35),
        ("4", "VolumeMountFailed", "b", 0.35),
        ("5", "LivenessProbeFailure", "", 0.4),
        ("5", "ReadinessProbeFailure", "", 0.3),
        ("7", "ContainerTerminated", "c", 0.3),
    ]
    score = spark.range(1).select(significance.event_significance(F.lit(True), F.lit(True), F.lit(True), F.lit(0.5), F.lit(1), F.lit(True), F.lit("DELETE"))["score"]).first()[0]
    assert score == pytest.approx(0.9)


def test_detectors_share_what_they_read(spark, sf_dir):
    from opsgraph.plans.snapshot_queries import snapshot_anomalies

    df = snapshot_anomalies(spark, sf_dir)
    assert not [f for f in df.inputFiles() if "events.parquet" in f]
    assert "from_json" not in df._jdf.queryExecution().optimizedPlan().toString()
