"""Sources, sinks, validation, logs, lineage, alert helpers and streams."""

from __future__ import annotations

import gzip
import json

import pytest
from opsgraph.functions import stored, validate
from opsgraph.operators import alerts, lineage, logs, metrics, timeline
from opsgraph.sources import events as ev
from opsgraph.streaming import jobs
from pyspark.sql import functions as F


def event(i, kind="Pod", name="p", **more):
    return {"id": i, "timestamp": 1, "type": "CREATE", "resource": {"version": "v1", "kind": kind, "name": name, "uid": "u"}, "data": {"a": {"b": 1}}, **more}


def test_read_events(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text(json.dumps({"events": [event("1"), event(""), {**event("2", "Event", "e"), "data": {"involvedObject": {"uid": "x"}}}]}))
    with gzip.open(tmp_path / "in" / "deep" / "b.json.gz", "wt") as f:
        f.write(json.dumps({"events": [event("3")]}))
    (tmp_path / "in" / "bad.json").write_text("{")
    (tmp_path / "in" / "note.txt").write_text("x")
    rows, bad = ev.read_event_dir(spark, str(tmp_path / "in"))
    got = {r["id"]: r for r in rows.collect()}
    assert set(got) == {"1", "2", "3"}
    assert json.loads(got["1"]["data"]) == {"a": {"b": 1}}
    assert got["2"]["resource"]["involvedObjectUid"] == "x"
    assert any(r["file"].endswith("bad.json") for r in bad.collect())
    valid, dropped = ev.read_event_batch(spark, str(tmp_path / "in" / "a.json"))
    assert (valid.count(), dropped) == (2, 1)
    (tmp_path / "empty.json").write_text('{"events": []}')
    with pytest.raises(ValueError, match="no events"):
        ev.read_event_batch(spark, str(tmp_path / "empty.json"))
    report = ev.import_report(rows).first()
    assert (report["events"], report["hours"]) == (3, 1)
    ev.export_events(rows, 0, 10, str(tmp_path / "out"))
    assert ev.read_audit_log(spark, str(tmp_path / "out")).count() == 3


def test_prune(spark):
    data = json.dumps({"kind": "Pod", "metadata": {"name": 'a"b', "managedFields": [{"x": 1}], "labels": {"k": "123", "on": "true"}, "n": 1}, "spec": {"z": True, "version": "123", "none": None}})
    df = spark.createDataFrame([(data,), (None,), ("bad",)], "data string")
    got = [r[0] for r in df.select(validate.prune_managed_fields(F.col("data"))).collect()]
    assert json.loads(got[0]) == {"kind": "Pod", "metadata": {"name": 'a"b', "labels": {"k": "123", "on": "true"}, "n": 1}, "spec": {"z": True, "version": "123", "none": None}}
    assert got[1:] == [None, "bad"]


def test_metric_frames(spark):
    frame = {"schema": {"fields": [{"name": "t"}, {"name": "v", "labels": {"__name__": "m"}, "config": {"unit": "s"}}]}, "data": {"values": [[1000, 2000], [1.5, 2.5]]}}
    df = spark.createDataFrame([(json.dumps(frame),), (json.dumps({"schema": {"fields": []}, "data": {"values": []}}),)], "frame string")
    got = [(r["unit"], r["value"], r["ts"].second) for r in ev.metric_frames(df).collect()]
    assert got == [("s", 1.5, 1), ("s", 2.5, 2)]


def test_metric_helpers(spark):
    df = spark.createDataFrame([({"__name__": "up"},), ({"b": "1", "a": "2"},)], "l map<string,string>")
    assert [r[0] for r in df.select(metrics.metric_name(F.col("l"))).collect()] == ["up", "a=2"]
    z = spark.createDataFrame([("errors", 1.2), ("cpu", 1.2), ("cpu", -3.5), ("errors", 2.0)], "m string, z double")
    assert [r[0] for r in z.select(metrics.z_severity(F.col("m"), F.col("z"))).collect()] == ["info", None, "critical", "critical"]


MASKED = [
    ("connected to 10.0.0.1 in 35 s", "connected to <IP> in <NUM> s"),
    ("returned 404 from http", "returned 404 from http"),
    ("id 550e8400-e29b-41d4-a716-446655440000 gone", "id <UUID> gone"),
    ("mail a@b.com at /var/log/x.log", "mail <EMAIL> at <PATH>"),
    ("pod web-5d4f8c7b9c-x2x4z failed", "pod <K8S_NAME> failed"),
    ("0xdeadbeef and 1234567890", "<HEX> and <TIMESTAMP>"),
]


def test_masking(spark):
    df = spark.createDataFrame(MASKED, "line string, want string")
    assert [r for r in df.select(logs.aggressive_mask(F.col("line")).alias("got"), "want", "line").collect() if r["got"] != r["want"]] == []


def test_templates(spark):
    lines = [("ns", "p", "c", i, f"user {n} logged in from 10.0.0.{i}") for i, n in enumerate(["ann", "bob", "cat", "dan"])] + [("ns", "p", "c", 9, '{"msg": "disk full"}')]
    df = spark.createDataFrame(lines, "namespace string, pod string, container string, ts_ns long, message string")
    got = {r["pattern"]: r["count"] for r in logs.mine_templates(df).collect()}
    assert got == {"user <VAR> logged in from <VAR>": 4, "disk full": 1}
    seen = logs.log_patterns(df, 3, 10).collect()
    assert [(r["pattern"], r["count"], r["novel"]) for r in seen] == [("disk full", 1, True), ("user dan logged in from <VAR>", 1, True)]
    merged = logs.rebalance(spark.createDataFrame([("n", "1", "user <VAR> left now", 5, 1, 2), ("n", "2", "user <VAR> left not", 7, 0, 3), ("n", "3", "something else at all", 9, 1, 1)], "namespace string, id string, pattern string, count long, first_ns long, last_ns long"), least=1)
    assert {r["pattern"]: r["count"] for r in merged.collect()} == {"user <VAR> left not": 12, "something else at all": 9}


def test_templates_are_not_capped(spark):
    """150 unlike patterns of one group stay apart, however the group is dealt out; like ones meet across slots."""
    lines = [("ns", "p", "c", i, f"start a{i}x b{i}x c{i}x") for i in range(150)] + [("ns", "p", "c", i, f"start same{i}x of here") for i in range(30)]
    df = spark.createDataFrame(lines + [("ns", "p", "c", 1, "===="), ("ns", "p", "c", 2, "run my_key=v1x now"), ("ns", "p", "c", 3, "run my_key=v2x now")], "namespace string, pod string, container string, ts_ns long, message string")
    for slot in (10_000, 7, 40):
        got = {r["pattern"]: r["count"] for r in logs.mine_templates(df, slot=slot).collect()}
        assert sum(got.values()) == 183 and got["start <VAR> of here"] == 30 and got["===="] == 1 and got["run my key <VAR> now"] == 2
        assert len(got) == 153 and all(got[f"start a{i}x b{i}x c{i}x"] == 1 for i in range(150))


PROMQL = [
    ('sum(rate(http_requests_total{job="api", code=~"5.."}[5m])) by (service)', ["http_requests_total"], ["sum"], ["rate"], False),
    ("up == 1 and node_load1 offset 5m", ["up", "node_load1"], [], [], False),
    ("rate(x_total{a=\"$var\"}[$__interval])", [], [], ["rate"], True),
    ('count_values("v", build_info)', ["build_info"], ["count_values"], [], False),
]


@pytest.mark.parametrize(("expr", "names", "aggregations", "functions", "variables"), PROMQL)
def test_promql(spark, expr, names, aggregations, functions, variables):
    got = spark.createDataFrame([(expr,)], "e string").select(lineage.promql(F.col("e")).alias("p")).first()["p"]
    assert (got["metrics"], got["aggregations"], got["functions"], got["has_variables"]) == (names, aggregations, functions, variables)


def test_lineage(spark, tmp_path):
    board = {"uid": "d", "title": "t", "version": 1, "tags": ["overview"], "panels": [{"id": 1, "title": "p", "type": "graph", "targets": [{"refId": "A", "expr": 'up{job="api"}', "datasource": {"uid": "ds"}}]}], "templating": {"list": [{"name": "cluster", "type": "query"}]}}
    (tmp_path / "d.json").write_text(json.dumps(board))
    boards = ev.read_dashboards(spark, str(tmp_path / "d.json"))
    q = lineage.queries(boards)
    assert tuple(q.first()) == ("d", "d-1", "d-1-A", 'up{job="api"}', "ds")
    assert {tuple(r) for r in lineage.structure_edges(boards).collect()} == {("CONTAINS", "d", "d-1"), ("HAS", "d-1", "d-1-A"), ("HAS_VARIABLE", "d", "cluster")}
    assert tuple(lineage.tracks_edges(q).first()) == ("TRACKS", "up", "api")
    assert lineage.variables(boards).first()["class"] == "scoping"
    assert lineage.by_level(boards, "overview").count() == 1
    rules = spark.createDataFrame([("r", [("A", "", json.dumps({"expr": "up == 0"}))])], "uid string, data array<struct<refId:string,queryType:string,model:string>>")
    assert tuple(lineage.monitors_edges(rules).first()) == ("MONITORS", "r", "up")


def test_alert_helpers(spark):
    df = spark.createDataFrame([("a", "1", "normal"), ("a", "2", "alerting"), ("b", "1", "pending")], "alert string, instance string, state string")
    assert dict(alerts.rolled_up(df).collect()) == {"a": "firing", "b": "pending"}
    d = spark.createDataFrame([(30,), (300,), (7500,), (273600,)], "s long").select(timeline.duration_text(F.col("s"))).collect()
    assert [r[0] for r in d] == ["< 1m", "5m", "2h 5m", "3d4h"]


def test_log_search_by_time_and_level(spark):
    rows = [("n", "p", "c", t, m) for t, m in enumerate(["level=error a", "level=warn b", "c", "ERROR: d", "e"])]
    lines = spark.createDataFrame(rows, "namespace string, pod string, container string, ts_ns long, message string")
    show = lambda **k: [r["ts_ns"] for r in logs.log_search(lines, **k).orderBy(F.desc("ts_ns")).collect()]
    assert show() == [4, 3, 2, 1, 0] and show(start_ns=1, end_ns=4) == [3, 2, 1]
    assert show(of_level="error") == [3, 0] and show(of_level="warning") == [1] and show(of_level="info", n=1) == [4]


def test_folders_of_a_cluster_have_to_be_shared(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getConf(self):  # noqa: N802
            return {}

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(RuntimeError, match="checkpoint"):
        stored.shared_root(Session())
    assert stored.shared_root(spark)


PROMQL = [
    ("up # down(x) and more\n + node_load1", ["up", "node_load1"], [], True),
    ('rate(x{a="#b", c="}"}[5m:1m] offset 1d)', ["x"], ["rate"], True),
    ("a @ end() / b @ 1609746000 + c @ start ()", ["a", "b", "c"], [], True),
    ("sum(rate(x[5m])", [], [], False),
    ("rate(x[5m)]", [], [], False),
    ("x)", [], [], False),
    ("a +", [], [], False),
    ("", [], [], False),
    ("rate($m[5m])", [], ["rate"], True),
    ("count_values(`q(`, v)", ["v"], [], True),
]


def test_promql_scans_comments_modifiers_and_brackets(spark):
    df = spark.createDataFrame([(i, e) for i, (e, *_) in enumerate(PROMQL)], "i int, expr string").select("i", lineage.promql(F.col("expr")).alias("p"))
    got = {r["i"]: (r["p"]["metrics"], r["p"]["functions"], r["p"]["well_formed"]) for r in df.collect()}
    for i, (expr, *want) in enumerate(PROMQL):
        assert got[i] == tuple(want), expr


STREAM = "id string, uid string, namespace string, type string, ts_ns long, data string"
ROWS = [[("1", "u", "n", "CREATE", 10**9, "a"), ("2", "u", "n", "UPDATE", 2 * 10**9, "a")], [("3", "u", "n", "UPDATE", 3 * 10**9, "b"), ("4", "v", "n", "CREATE", 3 * 10**9, "b")]]


def stream(spark, tmp_path):
    for i, rows in enumerate(ROWS):
        spark.createDataFrame(rows, STREAM).coalesce(1).write.json(str(tmp_path / "in" / str(i)))
    return spark.readStream.schema(STREAM).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).json(str(tmp_path / "in"))


def collected(df, tmp_path, name, mode="append"):
    out = []
    q = jobs.start(df, str(tmp_path / f"check-{name}"), lambda batch, n: out.extend(batch.collect()), mode=mode)
    assert q.awaitTermination(120)
    return out, q


def test_stream_changes(spark, tmp_path):
    got, q = collected(jobs.detect_changes(stream(spark, tmp_path)), tmp_path, "c")
    assert {r["id"]: (r["changed"], r["first"]) for r in got} == {"1": (False, True), "2": (False, False), "3": (True, False), "4": (False, True)}
    assert jobs.statistics(q)["rows"] >= 4


def test_stream_transitions(spark, tmp_path):
    states = stream(spark, tmp_path).select(F.col("uid").alias("alert"), F.col("data").alias("state"), "ts_ns", F.col("id").cast("long").alias("seq"))
    got, _ = collected(jobs.alert_transitions(states), tmp_path, "t")
    assert {(r["alert"], r["from_state"], r["to_state"]) for r in got} == {("u", "unknown", "a"), ("u", "a", "b"), ("v", "unknown", "b")}


def test_stream_writer_and_templates(spark, tmp_path):
    q = jobs.start(stream(spark, tmp_path), str(tmp_path / "check-w"), jobs.keyed_writer(str(tmp_path / "out"), lambda b: {"events": b, "uids": b.select("uid").distinct()}))
    assert q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out" / "events")).count() == 4
    lines = spark.readStream.schema(STREAM).option("recursiveFileLookup", True).json(str(tmp_path / "in")).select("namespace", F.lit("took 5 ms").alias("message"))
    got, _ = collected(jobs.template_counts(lines), tmp_path, "l", "update")
    assert [(r["pattern"], r["count"]) for r in got] == [("took <VAR> ms", 4)]


def test_documents_lie_side_by_side_in_an_hour_and_are_listed_once(spark, tmp_path):
    resource = F.struct(F.lit("").alias("group"), F.lit("v1").alias("version"), F.lit("Pod").alias("kind"), F.lit("n").alias("namespace"), F.lit("p").alias("name"), F.lit("u").alias("uid"), F.lit(None).cast("string").alias("involvedObjectUid"))
    rows = spark.range(500).select(F.col("id").cast("string").alias("id"), (F.col("id") * 20_000_000_000 + 1).alias("timestamp"), F.lit("CREATE").alias("type"), resource.alias("resource"), F.lit("{}").alias("data"), F.lit(2).alias("dataSize"), F.lit(0).alias("compressedSize"))
    path = tmp_path / "out"
    ev.export_documents(rows, 1, 10**15, str(path), most=20)
    files = sorted(path.glob("hour=*/*.json.gz"))
    assert len(files) > 20 and not list(path.glob("hour=*/part=*"))
    read, bad = ev.read_event_dir(spark, str(path))
    assert sorted(int(r["id"]) for r in read.collect()) == list(range(500)) and bad.count() == 0
    assert ev.read_documents(spark, str(path)).select("file").distinct().count() == len(files)
