"""Nodes, edges, management, upkeep, walks, incidents and causal paths on a small cluster."""

from __future__ import annotations

import json

import pytest
from opsgraph.operators import anomaly, causal, changes, incident, namespace, rules, traverse
from opsgraph.plans import edges as ed
from opsgraph.plans import maintain, management, nodes
from pyspark.sql import functions as F

S = 1_000_000_000
EVENT = "id string, uid string, kind string, group string, version string, namespace string, name string, involved_uid string, type string, ts_ns long, data string"


def ev(i, uid, kind, type_, t, data, ns="ns"):
    return (i, uid, kind, "", "v1", ns, uid, None, type_, t * S, None if data is None else json.dumps(data))


def meta(**labels):
    return {"labels": labels}


CLUSTER = [
    ev("1", "dep", "Deployment", "CREATE", 10, {"metadata": meta(app="web"), "spec": {"replicas": 1, "selector": {"matchLabels": {"app": "web"}}}, "status": {"readyReplicas": 1, "availableReplicas": 1}}),
    ev("2", "rs", "ReplicaSet", "CREATE", 20, {"metadata": {"ownerReferences": [{"uid": "dep", "kind": "Deployment", "name": "dep", "controller": True}]}}),
    ev("3", "pod", "Pod", "CREATE", 30, {"metadata": {"labels": {"app": "web", "v": "1"}, "ownerReferences": [{"uid": "rs", "kind": "ReplicaSet", "name": "rs"}]}, "spec": {"nodeName": "node", "serviceAccountName": "sa", "containers": [{"name": "a", "volumeMounts": [{"name": "d", "mountPath": "/d"}], "env": [{"valueFrom": {"secretKeyRef": {"name": "gone"}}}]}], "volumes": [{"name": "d", "persistentVolumeClaim": {"claimName": "pvc"}}, {"name": "c", "configMap": {"name": "cm"}}]}, "status": {"phase": "Running"}}),
    ev("4", "node", "Node", "CREATE", 5, {"status": {"conditions": [{"type": "Ready", "status": "True"}]}}, ""),
    ev("5", "sa", "ServiceAccount", "CREATE", 5, {}),
    ev("6", "pvc", "PersistentVolumeClaim", "CREATE", 5, {"spec": {"volumeName": "pv"}}),
    ev("7", "pv", "PersistentVolume", "CREATE", 5, {}, ""),
    ev("8", "cm", "ConfigMap", "CREATE", 5, {"data": {"k": "1"}}),
    ev("9", "svc", "Service", "CREATE", 5, {"spec": {"selector": {"app": "web", "v": "1"}}}),
    ev("10", "svc2", "Service", "CREATE", 5, {"spec": {"selector": {"app": "other"}}}),
    ev("11", "rb", "RoleBinding", "CREATE", 5, {"roleRef": {"kind": "ClusterRole", "name": "cr"}, "subjects": [{"kind": "ServiceAccount", "name": "sa"}, {"kind": "User", "name": "u"}]}),
    ev("12", "cr", "ClusterRole", "CREATE", 5, {"rules": []}, ""),
    ev("13", "ing", "Ingress", "CREATE", 5, {"spec": {"rules": [{"http": {"paths": [{"backend": {"service": {"name": "svc"}}}]}}]}}),
    ev("14", "np", "NetworkPolicy", "CREATE", 5, {"spec": {"podSelector": {}}}),
    ev("15", "cm", "ConfigMap", "UPDATE", 90, {"data": {"k": "2"}}),
    ev("16", "pod", "Pod", "UPDATE", 100, {"metadata": {"labels": {"app": "web", "v": "1"}}, "status": {"phase": "Running", "containerStatuses": [{"name": "a", "restartCount": 4, "state": {"waiting": {"reason": "CrashLoopBackOff"}}}]}}),
    ("17", "e", "Event", "", "v1", "ns", "e", "pod", "CREATE", 101 * S, json.dumps({"reason": "BackOff", "message": "restarting", "type": "Warning", "count": 12, "involvedObject": {"uid": "pod", "kind": "Pod", "name": "pod", "namespace": "ns", "apiVersion": "v1"}})),
]


@pytest.fixture(scope="module")
def cluster(spark):
    events = spark.createDataFrame(CLUSTER, EVENT)
    tables = {k: v.cache() for k, v in maintain.rebuild(events).items()}
    # The pod's references are in its first snapshot.
    first = maintain.latest_snapshots(events.filter("id != '16' and kind != 'Event'"))
    tables["edges"] = ed.build_edges(first).cache()
    return {"events": events, "latest": first, **tables}


def found(df):
    return {(r["type"], r["src"], r["dst"]) for r in df.collect()}


def test_edges(cluster):
    assert found(cluster["edges"]) == {
        ("OWNS", "dep", "rs"), ("OWNS", "rs", "pod"), ("SELECTS", "dep", "pod"), ("SELECTS", "svc", "pod"), ("SELECTS", "np", "pod"),
        ("SCHEDULED_ON", "pod", "node"), ("MOUNTS", "pod", "pvc"), ("USES_SERVICE_ACCOUNT", "pod", "sa"), ("BOUND_TO", "pvc", "pv"),
        ("BINDS_ROLE", "rb", "cr"), ("GRANTS_TO", "rb", "sa"), ("REFERENCES_SPEC", "ing", "svc"), ("REFERENCES_SPEC", "pod", "cm"),
    }
    mounts = cluster["edges"].filter("type = 'MOUNTS'").first()["props"]
    assert mounts == {"volumeName": "d", "mountPath": "/d"}


def test_an_extractor_that_fails_is_left_out(cluster):
    def broken(latest):
        raise ValueError("no")

    with pytest.warns(UserWarning, match="broken left out"):
        got = ed.build_edges(cluster["latest"], {"broken": broken, "other": lambda latest: latest.select("uid"), "owns": ed.owns})
    assert found(got) == {("OWNS", "dep", "rs"), ("OWNS", "rs", "pod")}


def test_missing_reference(cluster):
    got = [tuple(r[c] for c in ("src", "kind", "name")) for r in ed.missing_references(cluster["latest"]).collect()]
    assert got == [("pod", "Secret", "gone")]


def test_references_of_other_kinds(spark):
    rows = [
        ("h", "HelmRelease", "ns", "h", {"spec": {"valuesFrom": [{"kind": "ConfigMap", "name": "v"}], "chart": {"spec": {"sourceRef": {"kind": "HelmRepository", "name": "repo", "namespace": "flux"}}}, "kubeConfig": {"secretRef": {"name": "k"}}}}),
        ("v", "ConfigMap", "ns", "v", {}), ("repo", "HelmRepository", "flux", "repo", {}), ("k", "Secret", "ns", "k", {}),
        ("ku", "Kustomization", "ns", "ku", {"spec": {"sourceRef": {"kind": "GitRepository", "name": "g"}, "decryption": {"secretRef": {"name": "k"}}}}),
        ("g", "GitRepository", "ns", "g", {"spec": {"secretRef": {"name": "k"}}}),
        ("c", "Certificate", "ns", "c", {"spec": {"issuerRef": {"kind": "ClusterIssuer", "name": "i"}}}), ("i", "ClusterIssuer", "", "i", {}),
        ("gw", "Gateway", "ns", "gw", {"spec": {"gatewayClassName": "gc"}}), ("gc", "GatewayClass", "", "gc", {}),
        ("r", "HTTPRoute", "ns", "r", {"spec": {"parentRefs": [{"name": "gw"}], "rules": [{"backendRefs": [{"name": "s"}]}]}}), ("s", "Service", "ns", "s", {}),
        ("app", "Application", "ns", "app", {"spec": {"source": {"passwordSecret": {"name": "k"}, "helm": {"valuesFrom": [{"kind": "ConfigMap", "name": "v"}]}}}}),
        ("es", "ExternalSecret", "ns", "es", {"spec": {"secretStoreRef": {"name": "st"}, "target": {"name": "k"}}}), ("st", "SecretStore", "ns", "st", {}),
    ]
    latest = spark.createDataFrame([(u, k, n, m, json.dumps(d)) for u, k, n, m, d in rows], "uid string, kind string, namespace string, name string, data string")
    got = {(r["src"], r["dst"]) for r in ed.resolved_references(latest).collect()}
    assert got == {("h", "v"), ("h", "repo"), ("h", "k"), ("ku", "g"), ("ku", "k"), ("g", "k"), ("c", "i"), ("gw", "gc"), ("r", "gw"), ("r", "s"), ("app", "k"), ("app", "v"), ("es", "st"), ("es", "k")}


def test_nodes_and_events(cluster):
    change = {r["id"]: r for r in cluster["change_events"].collect()}
    assert (change["16"]["status"], change["16"]["issues"], change["15"]["config_changed"]) == ("Error", ["CrashLoopBackOff"], True)
    warning = cluster["k8s_events"].first()
    assert (warning["uid"], warning["reason"], warning["count"]) == ("pod", "BackOff", 12)
    assert ("EMITTED_EVENT", "pod", "17") in found(cluster["event_edges"])
    assert {"reason": r["reason"] for r in cluster["causes"].filter("src = '16' and dst = '15'").collect()} == {"reason": "config-change-restart"}


def test_sticky_deletion(spark):
    rows = [ev("1", "a", "Pod", "CREATE", 1, {"metadata": meta(x="1")}), ev("2", "a", "Pod", "DELETE", 2, None), ev("3", "a", "Pod", "UPDATE", 3, {"metadata": meta(x="2")}), ev("4", "b", "Pod", "CREATE", 1, {})]
    events = spark.createDataFrame(rows, EVENT)
    got = {r["uid"]: (r["deleted"], r["last_ns"] // S) for r in nodes.build_resources(events).collect()}
    assert got == {"a": (True, 2), "b": (False, 1)}
    resources, kept = maintain.retain(nodes.build_resources(events), events.filter("id != '3'"), 5 * S)
    assert [r["uid"] for r in resources.collect()] == ["b"] and kept.count() == 0


def test_management(spark):
    managers = spark.createDataFrame([("m", "HelmRelease", "ns", "web", "ns", 10 * S, True)], "uid string, kind string, namespace string, name string, target_ns string, ts_ns long, reconciled boolean")
    rows = [("a", "Deployment", "ns", "web-a", {}, 15 * S), ("b", "Deployment", "ns", "zzz", {}, 39 * S), ("c", "Secret", "x", "q", {"helm.toolkit.fluxcd.io/name": "web", "helm.toolkit.fluxcd.io/namespace": "ns"}, 900 * S), ("d", "ReplicaSet", "ns", "web-d", {}, 15 * S)]
    resources = spark.createDataFrame(rows, "uid string, kind string, namespace string, name string, labels map<string,string>, first_ns long")
    owns = spark.createDataFrame([("OWNS", "a", "d")], "type string, src string, dst string")
    got = {r["dst"]: round(r["confidence"], 3) for r in management.manages(managers, resources, owns).collect()}
    assert got == {"a": 0.95, "c": 1.0}


def test_revalidation(spark):
    resources = spark.createDataFrame([("a", "n", False), ("b", "n", False), ("c", "m", False)], "uid string, namespace string, deleted boolean")
    h = 3600 * S
    ns = [("namespace", "x", 1.0)]
    rows = [("a", "b", 0.8, ns, 100 * h), ("a", "c", 0.8, ns, 100 * h), ("b", "a", 1.0, [], 92 * h), ("c", "a", 0.8, [], 99 * h + h // 2), ("c", "b", 0.1, [], 0)]
    edges = spark.createDataFrame(rows, "src string, dst string, confidence double, evidence array<struct<type:string,value:string,weight:double>>, validated_ns long")
    got = {(r["src"], r["dst"]): (round(r["confidence"], 3), r["state"]) for r in management.revalidated(edges, resources, 102 * h).collect()}
    assert got == {("a", "b"): (0.8, "valid"), ("a", "c"): (0.8, "invalid"), ("b", "a"): (1.0, "valid"), ("c", "a"): (0.8, "valid"), ("c", "b"): (0.1, "valid")}


def test_upkeep(cluster, spark):
    changed = spark.createDataFrame([("node", "Node", ""), ("cr", "ClusterRole", ""), ("x", "Pod", "other")], "uid string, kind string, namespace string")
    assert {r[0] for r in maintain.affected_namespaces(changed, cluster["resources"], cluster["edges"]).collect()} == {"ns", "other"}
    assert {r["uid"] for r in maintain.newer_versions(spark.createDataFrame([("a", 1), ("b", 2)], "uid string, v int"), spark.createDataFrame([("a", 2), ("b", 2), ("c", 1)], "uid string, v int"), "v").collect()} == {"a", "c"}


def incidents(spark):
    return spark.createDataFrame([("i", "pod", "ns", 101 * S)], "incident_id string, uid string, namespace string, t_ns long")


def test_incident_analysis(cluster, spark):
    inc = incidents(spark)
    line = incident.spine(cluster["edges"].withColumn("confidence", F.lit(1.0)), inc)
    assert [r["uid"] for r in line.orderBy("step").collect()] == ["dep", "rs", "pod"]
    edges = cluster["edges"].withColumn("confidence", F.lit(1.0))
    graph_nodes, graph_edges = incident.causal_graph(edges, cluster["resources"], cluster["change_events"], inc, 3600 * S)
    assert {r["uid"] for r in graph_nodes.filter("part = 'RELATED'").collect()} >= {"cm", "node", "sa", "svc", "np", "ing", "rb", "cr"}
    assert ("SPINE", "dep", "rs") in {(r["part"], r["src"], r["dst"]) for r in graph_edges.collect()}
    root = incident.root_cause(line, cluster["change_events"], inc)
    assert (root.first()["uid"], root.first()["lag_ms"]) == ("dep", 91000)
    assert incident.explanation(line, cluster["resources"]).first()["explanation"] == "Deployment/dep -> ReplicaSet/rs -> Pod/pod"
    assert incident.with_fallback(inc, root, graph_nodes).first()["quality"] == "full"
    assert [r["uid"] for r in incident.excluded(cluster["change_events"], root, inc).collect()] == ["cm"]
    assert incident.evidence(graph_edges, root).count() == 3
    near = traverse.find_root_cause(cluster["causes"], edges, cluster["change_events"], inc).orderBy("nth").collect()
    assert near[0]["method"] == "trigger" and "15" in {r["id"] for r in near}


def test_causal_path_to_config_map(cluster, spark):
    events = cluster["change_events"]
    seen = anomaly.Seen(events, cluster["k8s_events"].join(cluster["resources"].select("uid", "kind"), "uid"), changes.diff_rows(cluster["events"].filter("kind != 'Event'")).join(cluster["resources"].select("uid", "kind"), "uid"), 102 * S)
    anomalies = anomaly.detect(seen).filter(F.col("ts_ns") >= 50 * S).cache()  # the window begins after the rollout
    types = {(r["uid"], r["type"]) for r in anomalies.collect()}
    assert {("cm", "ConfigChange"), ("pod", "CrashLoopBackOff"), ("pod", "BackOff"), ("pod", "HighFrequencyEvent"), ("pod", "HighRestartCount"), ("pod", "ErrorStatus")} <= types
    ranked = causal.rank_paths(causal.causal_paths(cluster["edges"], cluster["resources"], anomalies, incidents(spark).select("incident_id", "uid", "t_ns")))
    best = causal.explained(ranked).filter("root = 'cm'").first()
    assert best["confidence"] >= 0.6 and [s["uid"] for s in best["path"]] == ["pod", "cm"]
    assert best["explanation"] == "caused by ConfigMap cm -> Pod pod" and best["n_affected"] == 1
    services = cluster["resources"].filter("kind = 'Service'").select("uid", "kind")
    assert {r["uid"] for r in anomaly.services_without_pods(services, cluster["edges"], anomalies, 1).collect()} == {"svc", "svc2"}


def test_namespace_graph(cluster):
    graph_nodes, graph_edges = namespace.namespace_graph(cluster["resources"], cluster["events"].withColumn("status", F.lit("Ready")), cluster["edges"], "ns", 200 * S)
    got = {r["uid"]: r["diff"] for r in graph_nodes.collect()}
    assert {"pod", "cm", "node", "cr"} <= set(got) and "e" not in got
    assert "+  k: " in got["cm"]
    assert graph_edges.count() == cluster["edges"].count()
    assert "cm" not in {r["uid"] for r in namespace.namespace_symptoms(graph_nodes, graph_nodes, 1).collect()}


def test_detectors_by_kind(spark):
    c = lambda **k: [{"type": t, **v} for t, v in k.items()]
    rows = [
        ("1", "n", "Node", 1, "UPDATE", "Error", False, {"status": {"conditions": c(Ready={"status": "False"}, DiskPressure={"status": "True"})}}),
        ("2", "p", "PersistentVolumeClaim", 1, "UPDATE", "Warning", False, {"status": {"phase": "Pending"}}),
        ("3", "p", "PersistentVolumeClaim", 90, "UPDATE", "Warning", False, {"status": {"phase": "Pending"}}),
        ("4", "d", "Deployment", 1, "UPDATE", "Warning", True, {"status": {"unavailableReplicas": 1}}),
        ("5", "h", "HelmRelease", 1, "UPDATE", "Error", False, {"status": {"conditions": c(Ready={"status": "False", "reason": "x"})}}),
        ("6", "s", "Secret", 1, "DELETE", "Terminating", False, None),
        ("7", "e", "Pod", 1, "UPDATE", "Error", False, {"status": {"phase": "Failed", "reason": "Evicted"}}),
        ("8", "l", "EndpointSlice", 1, "UPDATE", "Ready", False, {"endpoints": [{"conditions": {"ready": False}}]}),
        ("9", "q", "StatefulSet", 1, "UPDATE", "Ready", True, {"status": {"currentRevision": "a", "updateRevision": "b"}}),
    ]
    df = spark.createDataFrame([(i, u, k, t * S, e, s, cfg, None if d is None else json.dumps(d)) for i, u, k, t, e, s, cfg, d in rows], "id string, uid string, kind string, ts_ns long, event_type string, status string, config_changed boolean, data string")
    warnings = spark.createDataFrame([("w", "d", "Deployment", S, "FailedCreate", "pods is forbidden", "Warning", 1), ("v", "e", "Pod", S, "Pulled", "", "Warning", 1), ("x", "e", "Pod", S, "FailedMount", 'secret "a" not found', "Warning", 1)], "id string, uid string, kind string, ts_ns long, reason string, message string, type string, count int")
    diffs = spark.createDataFrame([("d", "Deployment", "4", S, "spec.template.spec.containers[name=a].image", "replace", '"1"', '"2"'), ("h", "HelmRelease", "5", S, "spec.chart.spec.version", "replace", '"1.9.0"', '"1.10.0"')], "uid string, kind string, id string, ts_ns long, path string, op string, old string, new string")
    got = {(r["uid"], r["type"], r["severity"]) for r in anomaly.detect(anomaly.Seen(df, warnings, diffs, 100 * S)).collect()}
    assert {
        ("n", "NodeNotReady", "critical"), ("n", "DiskPressure", "medium"), ("p", "PVCBindingFailed", "critical"), ("d", "RolloutStuck", "high"), ("h", "HelmReleaseFailed", "critical"),
        ("s", "Deleted", "high"), ("s", "ResourceDeleted", "medium"), ("e", "Evicted", "high"), ("l", "NoReadyEndpoints", "medium"), ("q", "UpdateRollback", "medium"),
        ("d", "RBACDenied", "high"), ("e", "InvalidConfigReference", "high"), ("d", "ImageChanged", "high"), ("h", "HelmUpgrade", "high"), ("d", "WorkloadSpecModified", "high"),
    } <= got
    assert not {t for _, t, _ in got} & set(rules.BENIGN_REASONS)
    certs = spark.createDataFrame([("c", "Certificate", json.dumps({"status": {"notAfter": "2024-01-01T00:00:00Z"}}))], "uid string, kind string, data string")
    assert anomaly.expired_certificates(certs, 1_800_000_000 * S).count() == 1 and anomaly.expired_certificates(certs, S).count() == 0


def test_own_extractors_give_each_edge_once_without_grouping(spark):
    owner = lambda controller: {"uid": "o", "kind": "ReplicaSet", "controller": controller}
    env = lambda *names: [{"configMapRef": {"name": n}} for n in names]
    pod = {"metadata": {"ownerReferences": [owner(True), owner(False)]}, "spec": {"containers": [{"envFrom": env("a", "b", "a")}], "volumes": [{"name": "v", "configMap": {"name": "a"}}]}}
    rows = [("p", "Pod", "n", "p", json.dumps(pod)), ("ca", "ConfigMap", "n", "a", "{}"), ("cb", "ConfigMap", "n", "b", "{}")]
    latest = spark.createDataFrame(rows, "uid string, kind string, namespace string, name string, data string")
    edges = ed.build_edges(latest)
    assert "min_by(props" not in edges._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r["type"], r["src"], r["dst"], r["props"].get("controller"), r["props"].get("fieldPath")) for r in edges.collect())
    grouped = sorted((r["type"], r["src"], r["dst"], r["props"].get("controller"), r["props"].get("fieldPath")) for r in ed.build_edges(latest, {**ed.EXTRACTORS, "more": ed.owns}).collect())
    assert got == grouped == [("OWNS", "o", "p", "false", None), ("REFERENCES_SPEC", "p", "ca", None, "spec.containers.envFrom[0]"), ("REFERENCES_SPEC", "p", "cb", None, "spec.containers.envFrom[1]")]
