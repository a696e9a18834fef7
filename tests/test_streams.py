"""Streams against the batch operators: all heuristics across batches, late rows, quiet gaps, the stored graph, statistics."""

from __future__ import annotations

import random
import time

import pytest
from opsgraph.plans.causality import infer_causality
from opsgraph.plans.incremental import GraphTables
from opsgraph.streaming import jobs
from pyspark.sql import functions as F
from test_graph import CLUSTER, EVENT, S
from test_incremental import same


def source(spark, path, batches):
    """A stream whose batches are these rows, one file each."""
    for n, rows in enumerate(batches):
        spark.createDataFrame(rows, EVENT).coalesce(1).write.mode("append").parquet(str(path))
        time.sleep(0.01 * n)
    return spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(str(path))


def run(df, path, each):
    q = jobs.start(df, str(path), each)
    assert q.awaitTermination(180)
    return q


def happenings(seed, n=160):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rnd.choice(["Deployment", "ReplicaSet", "Pod", "Pod", "ConfigMap", "Node", "PersistentVolumeClaim", "Namespace"])
        ns = "" if kind in ("Node", "Namespace") else rnd.choice(["a", "b"])
        name = rnd.choice(["a", "b"]) if kind == "Namespace" else f"n{rnd.randrange(3)}"
        rows.append((f"e{i}", f"{kind}/{ns}/{name}", kind, "", "v1", ns, name, None, rnd.choice(["CREATE", "UPDATE", "UPDATE", "DELETE"]), rnd.randrange(0, 1500) * S + rnd.randrange(S), "{}"))
    return rows


def test_heuristics_across_batches(spark, tmp_path):
    rows = happenings(5)
    parted = tmp_path / "parted"
    run(source(spark, tmp_path / "in", [rows[:50], rows[50:90], rows[90:]]), tmp_path / "c1", jobs.without_late(str(parted), late="1 hour"))
    events = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).parquet(f"{parted}/events")
    got = []
    run(jobs.triggered_by(events, late="1 hour"), tmp_path / "c2", lambda batch, n: got.extend(batch.collect()))
    want = infer_causality(spark.createDataFrame(rows, EVENT)).collect()
    assert len({r["reason"] for r in want}) >= 7
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))


def test_late_rows_are_kept_aside(spark, tmp_path):
    row = lambda i, t: (i, "u", "Pod", "", "v1", "a", "u", None, "UPDATE", t * S, "{}")
    write = jobs.without_late(str(tmp_path), late="10 minutes")
    frame = lambda *rows: spark.createDataFrame(list(rows), EVENT)
    batches = [frame(row("1", 10_000), row("2", 100)), frame(row("3", 9_401), row("4", 9_399), row("5", 12_000)), frame(row("6", 11_399)), frame()]
    for n in (0, 1, 1, 2, 3, 1):  # some are done again
        write(batches[n], n)
    ids = lambda name: sorted(r["id"] for r in spark.read.parquet(f"{tmp_path}/{name}").collect())
    assert ids("late_events") == ["4", "6"] and ids("events") == ["1", "2", "3", "5"]


def test_namespaces_are_given_out_after_a_quiet_gap(spark, tmp_path):
    times = {"a": [100, 104, 108, 114, 120], "b": [101]}  # gaps of 4 s, then of 6 s
    rows = [(f"{ns}{t}", "u", "Pod", "", "v1", ns, "u", None, "UPDATE", t * S, "{}") for ns, ts in times.items() for t in ts]
    last = [("z", "u", "Pod", "", "v1", "z", "u", None, "UPDATE", 500 * S, "{}")]
    got = []
    run(jobs.dirty_namespaces(source(spark, tmp_path / "in", [rows[3:], rows[:3], last]), late="1 minute"), tmp_path / "c", lambda b, n: got.extend(b.collect()))
    assert sorted((r["namespace"], r["first"].second, r["last"].second, r["n"]) for r in got) == [("a", 0, 0, 1), ("a", 40, 48, 3), ("a", 54, 54, 1), ("b", 41, 41, 1)]


def test_stored_graph_of_a_stream(spark, tmp_path):
    store = GraphTables(spark, str(tmp_path / "graph"), buckets=2)
    run(source(spark, tmp_path / "in", [CLUSTER[9:], CLUSTER[:9]]), tmp_path / "c", jobs.graph_updater(store))
    same(store.tables(), spark.createDataFrame(CLUSTER, EVENT))
    assert store.read("events").select("batch").distinct().count() == 2


def test_statistics_of_queries(spark, tmp_path):
    seen = jobs.PipelineStatistics()
    spark.streams.addListener(seen)
    try:
        events = source(spark, tmp_path / "in", [happenings(1, 20), happenings(2, 30)])
        run(jobs.with_time(events).filter(F.col("ts").isNotNull()), tmp_path / "c1", lambda b, n: b.count())

        def fails(batch, n):
            raise ValueError("no")

        with pytest.raises(Exception, match="no"):
            run(events, tmp_path / "c2", fails)
        for _ in range(100):
            if sum(r["errors"] for r in seen.of.values()) and any(r["rows"] == 50 for r in seen.of.values()):
                break
            time.sleep(0.1)
    finally:
        spark.streams.removeListener(seen)
    whole = next(r for r in seen.of.values() if r["rows"] == 50)
    assert whole["batches"] >= 2 and whole["errors"] == 0 and whole["lag_ms"] > 0 and whole["last_event"].startswith("1970-01-01T00:2")
    assert sum(r["errors"] for r in seen.of.values()) == 1
