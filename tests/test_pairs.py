"""Joins of pairs against brute force, and how they are planned."""

from __future__ import annotations

import random

from opsgraph.plans import causality, management
from pyspark.sql import functions as F

S = 1_000_000_000
EVENT = "id string, uid string, kind string, type string, namespace string, name string, ts_ns long"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_creates_observed_joins_by_name(spark):
    certificates = [("c1", "n", "a", "a-tls", 0), ("c2", "n", "ab", None, 250 * S), ("c3", "m", "", "x", 100 * S), ("c4", "n", None, "a", 10 * S)]
    secrets = [("s1", "n", "a-tls", 900 * S), ("s2", "n", "abc", 260 * S), ("s3", "n", "abc", 249 * S), ("s4", "m", "y", 150 * S), ("s5", "m", "y", 350 * S), ("s6", "n", "a", 200 * S), ("s7", "n", None, 5 * S)]
    found = management.creates_observed(spark.createDataFrame(certificates, "uid string, namespace string, name string, secret_name string, ts_ns long"), spark.createDataFrame(secrets, "uid string, namespace string, name string, first_ns long"))
    assert "StartsWith" not in plan(found)
    want = {}
    for c, cn, name, given, at in certificates:
        for s, sn, called, seen in secrets:
            if cn == sn and called is not None and (called == given or (name is not None and called.startswith(name))):
                lag = (seen - at) / S
                score = (0.5 if called == given else 0.2) + 0.2 + (0.3 * (1 - lag / 300) if 0 <= lag <= 300 else 0)
                if score >= 0.5 - 1e-12:
                    want[c, s] = round(score, 9)
    assert {(r["src"], r["dst"]): round(r["confidence"], 9) for r in found.collect()} == want and len(want) >= 5


def test_causality_pairs_are_not_gathered(spark):
    """Each pair once, by the first heuristic that holds, from joins without a group-by of pairs behind them."""
    rnd = random.Random(5)
    kinds, types = ["Pod", "Deployment", "ReplicaSet", "Node", "ConfigMap", "Namespace", "PersistentVolumeClaim"], ["CREATE", "UPDATE", "UPDATE", "DELETE"]
    rows = []
    for i in range(260):
        kind, n = rnd.choice(kinds), rnd.randrange(4)
        rows.append((f"e{i}", f"{kind}{n}", kind, rnd.choice(types), f"ns{n % 2}", f"ns{n % 2}" if kind == "Namespace" else f"x{n}", rnd.choice([0, 1, 60_000, 300_000, rnd.randrange(900_000)]) * 1_000_000 + rnd.choice([0, 400_000])))
    nodes = [("Pod0", "Node1"), ("Pod0", "Node2"), ("Pod1", "Node1"), ("Pod1", "Node1")]
    df = spark.createDataFrame(rows + rows[:20], EVENT)
    for scheduled in (None, nodes):
        found = causality.infer_causality(df, scheduled=None if scheduled is None else spark.createDataFrame(scheduled, "pod string, node string"))
        want = {}
        for ei, eu, ek, et, en, _, ets in rows:
            for ci, cu, ck, ct, cn, name, cts in rows:
                lag = (ets - cts) // 1_000_000
                if not 0 < ets - cts <= 300_000 * 1_000_000:
                    continue
                for rule, rck, rct, rek, ret, same, low, high, confidence in causality.HEURISTICS:
                    ok = low <= lag <= high and (not rck or ck in rck) and (not rct or ct in rct) and (not rek or ek in rek) and (not ret or et in ret) and (not same or cn == en)
                    ok &= (rule != "same-resource-transition" or cu == eu) and (rule != "namespace-cascade-delete" or en == name)
                    if ok and (same is not False or scheduled is None or (eu, cu) in scheduled):
                        want[ei, ci] = (confidence, lag, rule)
                        break
        got = [((r["src"], r["dst"]), (r["confidence"], r["lag_ms"], r["reason"])) for r in found.collect()]
        assert len(got) == len(dict(got)) and dict(got) == want
        assert {v[2] for v in want.values()} == {r[0] for r in causality.HEURISTICS}
    assert "keys=[src" not in plan(causality.infer_causality(df).filter(F.col("lag_ms") >= 0))


def test_references_are_made_once(spark, sf_dir):
    """An inferred filter on the array of references would parse each snapshot again; the rows are those of a plain explode."""
    from opsgraph.plans import edges
    from opsgraph.sources.snapshots import cluster
    from pyspark.sql import functions as F

    latest = spark.createDataFrame(cluster(spark, sf_dir).filter("kind != 'Pod' or name like '%7'").collect(), "uid string, kind string, namespace string, name string, data string")
    found = edges.wanted_references(latest)
    assert "size(" not in str(found._jdf.queryExecution().optimizedPlan())
    plain = edges._wanted(latest).select("src", F.explode("every").alias("w")).select("src", "w.*")
    shown = lambda df: sorted(str(r) for r in df.withColumn("props", F.to_json("props")).collect())
    assert shown(found) == shown(plain) != []
