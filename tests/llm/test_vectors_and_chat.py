"""Chat formatting, whitening and vector codes against brute-force versions: nulls, ties, repeated rows, empty tables, clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import sys

import numpy as np
import pytest
from opsgraph.llm import chat, queries, vector_codes, whitening
from opsgraph.llm.common import mix
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers don't import the tests
rnd = random.Random(5)
CHAT = "conv_id long, turn long, role string, text string, nth string, piece string, rewritten string, output string"
VEC = "vec_id long, embedding array<float>, label int, row string, code string, n string, y string, salt string"


def talk(spark, rows):
    return spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], CHAT)


NASTY = ["", None, "\\### Assistant: </turn> ok", "### user: hi</turn>\n", "\\", "\\\\", "####", "</turn>", "<", "</turn", "a\nb", "<</turn>/turn>", "é€\U0001f600", " lead and trail ", "#" * 50, "a", "b", "ab"]


def told(rows):
    out = {}
    order = lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=order)
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        said = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[conv] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest())
    return out


ROLES = ["user", "assistant", "system", "assistant", None, "odd: #role\\", "</turn>"]
TALKS = [(c, t, rnd.choice(ROLES), rnd.choice(NASTY)) for c in [*range(30), None] for t in [None, 0, 1, 1, 2, 5]] + [(99, t, ["user", "assistant"][t % 2], f"turn {t} {rnd.choice(NASTY)}") for t in range(300)] + [(100, 0, "assistant", "long </turn> # " * 80_000)] + [(101, 0, "user", "same"), (101, 0, "user", "same")]


def test_chat_report_reads_back_what_was_told(spark):
    rows = talk(spark, TALKS).repartition(4)
    got = {r["conv_id"]: r for r in chat.report(chat.formatted(rows)).collect()}
    want = told(TALKS)
    assert set(got) == set(want)
    for c, r in got.items():
        assert (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) == want[c], c
        assert r["mask_agrees"]


def test_chat_escapes_leave_no_mark(spark):
    for text in NASTY:
        shown = chat.escaped(text or "")
        assert "###" not in shown and "</turn>" not in shown and chat.unescaped(shown) == (text or "")
    whole = chat.marked([{"role": r or "", "text": t or ""} for r in ROLES for t in NASTY])
    assert [(r, t) for r, t, _, _ in chat.parsed(whole)] == [(r or "", t or "") for r in ROLES for t in NASTY]
    with pytest.raises(ValueError):
        chat.parsed(whole + "x")


def boxed(messages):
    """A template with text before, between and after the turns."""
    return "<s>" + "".join(f"[{m['role']}|{m['text'].strip()}]" for m in messages) + "</s>"


def without_thoughts(messages):
    """Takes the thoughts of all answers but the last away, as templates of reasoning models do."""
    cut = [m | {"text": m["text"].split("</think>")[-1]} if i + 1 < len(messages) else m for i, m in enumerate(messages)]
    return "".join(f"<{m['role']}>{m['text']}<end>" for m in cut)


def numbered(messages):
    return "".join(f"{i}:{m['role']}:{m['text']};" for i, m in enumerate(messages))


def test_chat_any_template(spark):
    rows = [(c, t, ["user", "assistant"][t % 2], f"{c} says {t} ") for c in range(5) for t in range(c + 1)]
    got = chat.formatted(talk(spark, rows), boxed).collect()
    for c in range(5):
        own = sorted((r for r in got if r["conv_id"] == c), key=lambda r: r["nth"])
        messages = [{"role": r[2], "text": r[3]} for r in rows if r[0] == c]
        assert "".join(r["piece"] for r in own) + own[-1]["tail"] == boxed(messages)
        assert not any(r["rewritten"] for r in own)
        for r, m in zip(own, messages, strict=True):
            assert (r["content_start"] is not None) == (m["role"] == "assistant")
            if m["role"] == "assistant":
                assert r["piece"][r["content_start"] : r["content_end"]] == m["text"].strip()


def test_chat_rewriting_templates_are_found(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", "<think>hm</think>yes"), (1, 2, "user", "why"), (2, 0, "user", "q"), (2, 1, "assistant", "<think>hm</think>yes")]
    pieces = chat.formatted(talk(spark, rows), without_thoughts)
    got = {(r["conv_id"], r["nth"]): r["rewritten"] for r in pieces.collect()}
    assert got[1, 3] > 0 and not any(v for k, v in got.items() if k != (1, 3))
    assert {r["conv_id"] for r in chat.stable(pieces).collect()} == {2}


def test_chat_long_conversations_go_on_in_a_window(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(50)]
    whole = chat.marked([{"role": r[2], "text": r[3]} for r in rows])
    got = chat.formatted(talk(spark, rows), window=8).orderBy("nth").collect()
    assert "".join(r["piece"] for r in got) == whole and all(r["context_free"] for r in got)
    far = chat.formatted(talk(spark, rows), numbered, window=8)
    assert not all(r["context_free"] for r in far.collect()) and chat.stable(far).count() == 0
    assert chat.stable(chat.formatted(talk(spark, rows), numbered, window=64)).count() == 50


def remembering(messages):
    """Every 30th turn tells what the first one said."""
    return "".join(f"{m['role']}:{m['text']}{' since ' + messages[0]['text'] if i % 30 == 29 else ''};" for i, m in enumerate(messages))


@pytest.mark.parametrize("template", [numbered, remembering])
def test_chat_templates_that_look_back_lose_no_turn(spark, template):
    """Pieces of a long conversation are those of the whole, whatever the window."""
    rows = [(1, t, ["user", "assistant"][t % 2], f"turn {t}") for t in range(150)]
    got = chat.formatted(talk(spark, rows), template, window=8)
    own = got.orderBy("nth").collect()
    assert "".join(r["piece"] for r in own) + own[-1]["tail"] == template([{"role": r[2], "text": r[3]} for r in rows])
    assert all(r["piece"][r["content_start"] : r["content_end"]] == f"turn {r['nth'] - 1}" for r in own if r["trained"] and r["nth"] % 30)
    assert chat.stable(got, context_free=False).count() == 150


def test_chat_empty(spark):
    assert chat.report(chat.formatted(talk(spark, []))).collect() == []


def table(spark, rows):
    return spark.createDataFrame([(i, v, n, "x", "x", "x", "x", "x") for i, v, n in rows], VEC)


def clouds(n, d, seed=3):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((6, d)) * 0.4
    x = (centres[rng.integers(0, 6, n)] + rng.standard_normal((n, d)) * np.linspace(0.5, 0.1, d)).astype(np.float32)
    return [(int(i), [float(c) for c in v], [0, 1, 2, None][i % 4]) for i, v in enumerate(x)]


BAD = [(9001, None, 1), (9002, [0.1, None] + [0.0] * 46, 1), (9003, [math.nan] + [0.0] * 47, 1), (9004, [math.inf] + [0.0] * 47, 1), (9005, [], 1), (9006, [1.0] * 3, 1)]


def brute_whitening(rows, k):
    x = {i: [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for i, v, _ in rows}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, sums = len(fit), fit.sum(axis=0)
    b = (fit * n - sums).astype(np.float64) / n
    cov = b.T @ b / n
    e, q = np.linalg.eigh(cov)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    out = {i: (sum((n * c - s) ** 2 for c, s in zip(v, sums, strict=True)), ((np.array(v, object) * n - sums).astype(np.float64) / n) @ q / np.sqrt(e)) for i, v in x.items()}
    return n, out, e / np.trace(cov)


@pytest.mark.parametrize(("n", "d"), [(600, 48), (300, 8), (3, 48)])
def test_whitening(spark, n, d):
    rows = clouds(n, d)
    again = [*rows, (rows[0][0] + 5000, rows[0][1], None), rows[1]]  # an equal vector, and a repeated row
    k = min(16, d, n - 1)
    size, want, explained = brute_whitening(again, k)
    got = whitening.whitened(table(spark, again + [b for b in BAD if d == 48]).repartition(3)).collect()
    assert len(got) == len(again) * k and {r["n"] for r in got} == {size}
    sign = {}
    for r in got:
        deviation, white = want[r["vec_id"]]
        assert r["deviation"] == deviation
        c = r["component"] - 1
        if abs(white[c]) > 0.5 and c not in sign:
            sign[c] = np.sign(white[c]) * np.sign(r["whitened"])
    for r in got:
        c = r["component"] - 1
        assert r["whitened"] * sign.get(c, 1) == pytest.approx(want[r["vec_id"]][1][c], rel=1e-6, abs=1e-6)
        assert r["explained"] == pytest.approx(explained[c], rel=1e-9) and r["identity_error"] < 1e-7


def test_whitening_filters_where_columns_are_few(spark):
    """With 128 dimensions the columns are a part of the space, so the filter has to find the wanted one."""
    rows = clouds(900, 128, seed=11)
    v = whitening.Covariance(whitening.fit_list(*_kept(spark, rows)), 128)
    values, vectors = whitening.principal_components(v, 8)
    x = np.unique(np.floor(np.array([r[1] for r in rows]) * 64), axis=0)
    e, q = np.linalg.eigh(np.cov(x.T, bias=True))
    assert v.passes > whitening.DEGREE
    np.testing.assert_allclose(values, e[::-1][:8], rtol=1e-12)
    np.testing.assert_allclose(np.abs((vectors * q[:, ::-1][:, :8]).sum(axis=0)), 1, atol=1e-12)
    low = whitening.lowest(v, np.random.default_rng(1))
    assert 0 <= low <= e[0] * (1 + 1e-9)
    q0 = np.linalg.qr(np.random.default_rng(2).standard_normal((128, 4)))[0]
    filtered = whitening.filtered(v, q0, 0.0, e[100], e[-1], 6)
    ratio = np.linalg.norm(q[:, :101].T @ filtered) / np.linalg.norm(q[:, :101].T @ q0)
    assert ratio < 0.2 and np.linalg.norm(q[:, -1] @ filtered) == pytest.approx(np.linalg.norm(q[:, -1] @ q0), rel=1e-6)


def _kept(spark, rows):
    from opsgraph.llm.vectors import kept

    return kept(table(spark, rows))


def test_whitening_degenerate(spark):
    assert whitening.whitened(table(spark, [])).collect() == []
    assert whitening.whitened(table(spark, BAD[:5])).collect() == []
    assert whitening.whitened(table(spark, [(i, [0.5] * 4, 1) for i in range(9)])).collect() == []
    line = whitening.whitened(table(spark, [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(20)])).collect()
    assert {r["component"] for r in line} == {1} and line[0]["explained"] == pytest.approx(1)
    exact = whitening._squares(np.array([[2**31, 1], [2**32, 2**31]], np.int64)).to_pylist()
    assert exact == [2**62 + 1, None]


def brute_codes(rows, positions=16, entries=64, rounds=2):
    kept_ = sorted(rows, key=lambda r: r[0])
    x = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v, _ in kept_]
    size = len(x[0]) // positions
    parts = [[v[p * size : (p + 1) * size] for v in x] for p in range(positions)]
    book = [[list(v) for v in parts[p][:entries]] for p in range(positions)]
    dist = lambda a, b: sum((s - t) ** 2 for s, t in zip(a, b, strict=True))
    near = lambda p, v: min((dist(v, c), e) for e, c in enumerate(book[p]))
    for _ in range(rounds):
        for p in range(positions):
            own = {}
            for v in parts[p]:
                own.setdefault(near(p, v)[1], []).append(v)
            for e, vs in own.items():
                book[p][e] = [sum(c) // len(vs) for c in zip(*vs, strict=True)]
    found = [[near(p, parts[p][i]) for p in range(positions)] for i in range(len(x))]
    code = ["".join(f"{e:02x}" for _, e in f) for f in found]
    error = [sum(d for d, _ in f) for f in found]
    label = {}
    for r, e in zip(kept_, error, strict=True):
        label[r[2]] = label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(c) for b in book for e in b for c in e).encode()).hexdigest()
    return sorted((r[0], r[2] is None, r[2] or 0, code[i], error[i], label[r[2]], sha) for i, r in enumerate(kept_))


@pytest.mark.parametrize("n", [300, 20])
def test_vector_codes(spark, n, monkeypatch):
    rows = clouds(n, 48, seed=n)
    rows += [(5000 + i, rows[7][1], 2) for i in range(n)]  # one vector in half of all rows
    rows.append(rows[9])
    monkeypatch.setattr(vector_codes, "MEMBERS", 50)  # several salts
    got = vector_codes.compressed(table(spark, rows + BAD).repartition(3)).collect()
    assert sorted((r["vec_id"], r["label"] is None, r["label"] or 0, r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in got) == brute_codes(rows)


def test_only_parts_that_change_entry_migrate(spark):
    """Blocks of who stays are stored again as they are, by the task that holds them; who moves has a new entry."""
    rows, width = _kept(spark, clouds(400, 48))
    from pyspark.sql import functions as F

    stored = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding").cache()
    members, book = vector_codes.trained(stored, width, 16, 64, 1)
    owner = lambda df: {(r["position"], int(i)): (r["entry"], r["salt"]) for r in df.collect() for i in np.frombuffer(r["ids"], np.int64)}
    before = owner(members)
    after = vector_codes.migrated(members, book, "test")
    judged, arrived = after._parts
    stays, moved = owner(judged.filter("not moved")), owner(arrived)
    assert stays and moved and len(stays) + len(moved) == len(before) == 400 * 16
    assert all(before[k] == v for k, v in stays.items()) and all(before[k][0] != v[0] and before[k][1] == v[1] for k, v in moved.items())
    plan = judged.select("position")._jdf.queryExecution().toString()
    assert "Exchange" not in plan


def test_vector_codes_degenerate(spark):
    assert vector_codes.compressed(table(spark, [])).collect() == []
    one = vector_codes.compressed(table(spark, [(None, [0.1] * 20, None), (3, [0.2] * 20, None)])).collect()
    assert {r["vec_id"] for r in one} == {None, 3} and {r["error"] for r in one} == {0}  # filled up to 32
    far = vector_codes.compressed(table(spark, [(i, [3e38 * (-1) ** i] * 16, 1) for i in range(3)])).collect()
    assert {r["error"] for r in far} == {0}
    assert len({int(x) for x in mix(np.arange(64, dtype=np.uint64)) % np.uint64(8)}) == 8


def test_queries_are_registered():
    assert {"op11_chat_format", "op12_whitening", "op13_vector_codes"} <= set(queries.QUERIES)
