"""Differences of JSON documents against a plain recursive version, on random nested documents."""

from __future__ import annotations

import json
import random

from opsgraph.functions import json_diff as jd
from opsgraph.operators import changes
from pyspark.sql import functions as F


def brute(old, new):
    out = []

    def compact(v):
        text = json.dumps(v, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        if isinstance(v, dict) and len(v) > 10:
            return f'{{"_type":"object","_keys":{len(v)},"_value":{text}}}'
        if isinstance(v, list) and len(v) > 10:
            return f'{{"_type":"array","_length":{len(v)},"_value":{text}}}'
        return text

    def equal(a, b):
        return json.dumps(a, sort_keys=True) == json.dumps(b, sort_keys=True)

    def objects(path, a, b):
        for k in a.keys() | b.keys():
            member(f"{path}.{k}" if path else k, k in a, a.get(k), k in b, b.get(k), False)

    def member(path, has_a, a, has_b, b, in_array):
        if not has_a:
            out.append((path, "add", None, compact(b)))
        elif not has_b:
            out.append((path, "remove", compact(a), None))
        elif not equal(a, b):
            if isinstance(a, dict) and isinstance(b, dict):
                objects(path, a, b)
            elif isinstance(a, list) and isinstance(b, list) and not in_array:
                arrays(path, a, b)
            else:
                out.append((path, "replace", compact(a), compact(b)))

    def arrays(path, a, b):
        has = lambda s, f: bool(s) and all(isinstance(e, dict) and f in e for e in s)
        field = next((f for f in jd.ARRAY_KEYS if has(a, f) and has(b, f)), None)
        if field is None:
            for i in range(max(len(a), len(b))):
                member(f"{path}[{i}]", i < len(a), a[i] if i < len(a) else None, i < len(b), b[i] if i < len(b) else None, True)
            return
        label = lambda v: "<nil>" if v is None else str(v).lower() if isinstance(v, bool) else str(v)
        x, y = ({label(e[field]): e for e in s} for s in (a, b))
        for k in x.keys() | y.keys():
            member(f"{path}[{field}={k}]", k in x, x.get(k), k in y, y.get(k), True)

    objects("", old, new)
    return sorted(out)


def value(rnd, depth):
    kind = rnd.random()
    if depth and kind < 0.35:
        return {rnd.choice("abcdefghijklmn"): value(rnd, depth - 1) for _ in range(rnd.choice([0, 1, 2, 3, 14]))}
    if depth and kind < 0.5:
        return [value(rnd, depth - 1) for _ in range(rnd.choice([0, 1, 2, 3, 12]))]
    if depth and kind < 0.65:
        return [{rnd.choice(["name", "name", "port", "type"]): rnd.choice(["x", "y", "z"]), "v": value(rnd, depth - 1)} for _ in range(rnd.randrange(4))]
    return rnd.choice([None, True, False, 0, 1, -3, 1.5, "", "a", "1", "true", 'q"[{\\', "é\n", "x" * 120])


def mutated(rnd, v):
    if isinstance(v, dict):
        out = {k: mutated(rnd, x) for k, x in v.items() if rnd.random() > 0.1}
        if rnd.random() < 0.2:
            out["new"] = value(rnd, 1)
        return dict(sorted(out.items(), reverse=rnd.random() < 0.5))
    if isinstance(v, list):
        out = [mutated(rnd, x) for x in v if rnd.random() > 0.1]
        rnd.shuffle(out) if rnd.random() < 0.3 else None
        return out
    return value(rnd, 0) if rnd.random() < 0.15 else v


def test_random_documents(spark):
    rnd = random.Random(3)
    pairs = []
    for i in range(300):
        old = {rnd.choice(["metadata", "spec", "status", "x"]): value(rnd, 5) for _ in range(3)}
        pairs.append((i, old, mutated(rnd, old)))
    df = spark.createDataFrame([(i, json.dumps(a), json.dumps(b)) for i, a, b in pairs], "i int, old string, new string").repartition(4)
    got = {r["i"]: [tuple(d) for d in r["d"]] for r in df.select("i", jd.json_diff("old", "new").alias("d")).collect()}
    some = 0
    for i, a, b in pairs:
        want = brute(a, b)
        some += len(want)
        assert got[i] == want, (a, b)
    assert some > 1000


def test_no_python_and_no_shuffle(spark):
    df = spark.range(1).select(F.lit("{}").alias("old"), F.lit('{"a":1}').alias("new")).select(jd.json_diff("old", "new"))
    plan = df._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan


def rows_of(spark, pairs):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "i int, old string, new string")
    return {r["i"]: [tuple(d) for d in r["d"]] for r in df.select("i", jd.json_diff("old", "new").alias("d")).collect()}


def test_documents_that_are_none(spark):
    got = rows_of(spark, [(None, None), ("{}", "bad"), ('{"a": 1}', '{"a": 1.0}'), ('{"a": 100}', '{"a": 1e2}'), ("[1]", '{"a": 1}'), ('{"a": null}', "{}"), ('{"a": true}', '{"a": 1}'), ('{"a": 12345678901234567890123}', '{"a": "12345678901234567890123"}')])
    assert [got[i] for i in range(4)] == [[]] * 4
    assert got[4] == [("a", "add", None, "1")] and got[5] == [("a", "remove", "null", None)]
    assert got[6] == [("a", "replace", "true", "1")] and len(got[7]) == 1


def test_single_event(spark):
    df = spark.createDataFrame([(1, None, '{"a": 1}'), (2, '{"a": 1}', '{"a": 2, "metadata": {"generation": 3}}')], "i int, old string, new string")
    got = {r["i"]: r["e"] for r in df.select("i", jd.event_diff("old", "new").alias("e")).collect()}
    assert got[1]["snapshot"] == '{"a": 1}' and got[1]["diffs"] is None
    assert got[2]["snapshot"] is None and [d["path"] for d in got[2]["diffs"]] == ["a", "metadata"]


def test_unified_sections(spark):
    old = {"metadata": {"labels": {"a": "1"}}, "spec": {"replicas": 1, "args": [1], "text": "x" * 200}, "status": {"conditions": [{"type": "Ready", "status": "True", "reason": "r"}], "phase": "Running"}}
    new = {"metadata": {"labels": {"a": "2"}}, "spec": {"replicas": 2, "args": "none", "text": "y" * 200}, "status": {"conditions": [{"type": "Ready", "status": "False", "reason": "r"}], "phase": "Failed"}}
    show = lambda a, b: spark.range(1).select(jd.unified_diff(jd.json_diff(F.lit(json.dumps(a)), F.lit(json.dumps(b))))).first()[0]
    assert show(old, new).split("\n") == [
        "@@ metadata.labels @@", '-  a: "1"', '+  a: "2"',
        "@@ spec @@", "-  args: [1 items]", '+  args: "none"', "-  replicas: 1", "+  replicas: 2", f'-  text: "{"x" * 97}..."', f'+  text: "{"y" * 97}..."',
        "@@ status @@", '-  phase: "Running"', '+  phase: "Failed"',
        "@@ status.conditions @@", '-  status.conditions[type=Ready].status: "True"', '+  status.conditions[type=Ready].status: "False"', "",
    ]
    conditions = lambda *c: {"status": {"conditions": list(c) or None}}
    ready = {"type": "Ready", "status": "True"}
    assert show(conditions(), conditions(ready)) == '@@ status.conditions[type=Ready] @@\n+  status: "True"\n'
    assert show(old, old) == ""


def test_categories_of_reordered_documents(spark):
    docs = [{"kind": "a", "metadata": {"labels": {"a": "1", "b": "2"}, "generation": 1}, "x": {"p": 1, "q": {"r": 1, "s": 2}}}, {"x": {"q": {"s": 2, "r": 1}, "p": 1}, "metadata": {"generation": 2, "labels": {"b": "2", "a": "1"}}, "kind": "a"}, {"x": {"q": {"s": 2, "r": 1}, "p": 1}, "metadata": {"labels": {"b": "3", "a": "1"}}, "kind": "b"}]
    rows = [(str(i), "u", i, json.dumps(d)) for i, d in enumerate(docs)]
    got = changes.change_categories(spark.createDataFrame(rows, "id string, uid string, ts_ns long, data string")).orderBy("id").collect()
    assert [tuple(r)[3:] for r in got] == [(False,) * 4, (False,) * 4, (False, False, True, True)]


def test_texts_are_written_of_few_values(spark):
    df = spark.createDataFrame([("{}", "{}")], "old string, new string").select(jd.json_diff("old", "new"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("StructsToJsonEvaluator") <= 4


def test_keys_that_repeat_and_brackets_in_texts(spark):
    item = lambda *names: json.dumps({"a": [{"name": n, "v": i} for i, n in enumerate(names)]})
    deep = lambda v: json.dumps({"a": {"b": [{"name": "[[{", "c": [{"port": 1, "d": {"e": v}}]}]}, "t": "{[" * 50})
    got = rows_of(spark, [(item("x", "y", "x"), item("y", "x")), (deep(1), deep("1")), ('{"a": [[1, 2], [3]]}', '{"a": [[1, 2], [4]]}'), ('{"a": {}}', '{"a": []}'), ('{"a": []}', '{"a": []} '), ('{"a": [{"name": null}]}', '{"a": [{"name": null, "b": 1}]}')])
    assert got[0] == [("a[name=x].v", "replace", "2", "1"), ("a[name=y].v", "replace", "1", "0")]
    assert got[1] == [("a.b[name=[[{].c[port=1].d.e", "replace", "1", '"1"')]
    assert got[2] == [("a[1]", "replace", "[3]", "[4]")] and got[3] == [("a", "replace", "{}", "[]")] and got[4] == []
    assert got[5] == [("a[name=<nil>].b", "add", None, "1")]
