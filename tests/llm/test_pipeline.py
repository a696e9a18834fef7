"""The pipeline's stages on the smallest tables: what each keeps, and that the last one holds what the one before kept."""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from compare import duck_rows, spark_rows
from opsgraph.llm import langid, queries
from test_operators import brute_exponent, brute_groups, words
from tokenizers import Tokenizer


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(i))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append((name, docs))
    return out


def test_stages(spark, sf_dir, stages):
    source = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ids = [Counter(r["doc_id"] for r in df.select("doc_id").collect()) for _, df in stages]
    assert all(df.columns == source.columns for _, df in stages[:-1])
    assert set(ids[0]) >= set(ids[1]) >= set(ids[2]) >= set(ids[3])
    assert sum(ids[0].values()) >= 0.98 * source.count()
    assert ids[3] == ids[4]
    last = stages[-1][1].orderBy("start").collect()
    assert [r["start"] for r in last] == [sum(x["n_tokens"] for x in last[:i]) for i in range(len(last))]
    assert [r["doc_id"] for r in last] == sorted(r["doc_id"] for r in last)


def test_run(spark, sf_dir, stages):
    got = corpus_pipeline.run(spark, sf_dir)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, stages[-1][1].collect()))


def brute_language(grams, models):
    """(language, share) of trigrams by plain expectation-maximisation for every set of languages that backward elimination tries."""
    count = Counter(grams.tolist())
    at, n = np.array(list(count)), np.array(list(count.values()), float)

    def fit(langs):
        p = np.array([[models[lang][g] for lang in langs] for g in at])
        share = np.ones(len(langs)) / len(langs)
        for _ in range(400):
            share = share * (p * (n / (p @ share))[:, None]).sum(axis=0) / n.sum()
        return share, float((n * np.log(p @ share)).sum())

    langs, price = sorted(models), langid.PENALTY * np.log(n.sum())
    share, value = fit(langs)
    best = max(langs, key=lambda lang: fit([lang])[1])
    if value - fit([best])[1] <= price:
        return best, 1.0
    while len(langs) > 1:
        fewer = [lang for i, lang in enumerate(langs) if i != int(np.argmin(share))]
        s, v = fit(fewer)
        if value - v > price:
            break
        langs, share, value = fewer, s, v
    return langs[int(np.argmax(share))], float(share.max())


def test_stages_by_brute_force(spark, sf_dir, stages):
    """Each stage on what the one before kept: the first three and the last row by row, mixing by its quotas."""
    rows = lambda df: [r.asDict() for r in df.collect()]
    kept = [rows(spark.read.parquet(f"{sf_dir}/documents.parquet")), *(rows(df) for _, df in stages)]
    ids = [sorted(r["doc_id"] for r in k) for k in kept]

    totals = defaultdict(lambda: np.full(2**langid.BITS, 0.5))
    for r in kept[0]:
        if r["lang"] is not None and r["text"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2:
            np.add.at(totals[r["lang"]], langid.grams(r["text"]), 1)
    models = {lang: n / n.sum() for lang, n in totals.items()}
    known = [(r, langid.grams(r["text"] or "")) for r in kept[0]]
    assert ids[1] == sorted(r["doc_id"] for r, g in known if len(g) and brute_language(g, models)[1] >= 0.4)

    groups = brute_groups([r["text"] for r in kept[1]], 5, 80, 100)
    first = defaultdict(list)
    for i, (_, c) in groups.items():
        first[c].append(kept[1][i]["doc_id"])
    assert ids[2] == sorted(kept[1][i]["doc_id"] for i, (_, c) in groups.items() if kept[1][i]["doc_id"] == min(first[c]))

    windows = set()
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = words(r["text"])
        windows.update(tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12) if w else 0))
    sizes, clean = {len(w) for w in windows}, []
    for r in kept[2]:
        w = words(r["text"])
        hit = {p for n in sizes for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for p in range(i, i + n)}
        if not hit or 20 * len(hit) < len(w):
            clean.append(r["doc_id"])
    assert ids[3] == sorted(clean)

    tokens, longest, placed = Counter(), Counter(), Counter()
    for r in kept[3]:
        n = len((r["text"] or "").split())
        tokens[r["source"]] += n
        longest[r["source"]] = max(longest[r["source"]], n)
    total = sum(tokens.values())
    a = brute_exponent([n / total for n in tokens.values() if n], 1.5)
    z = sum((n / total) ** a for n in tokens.values() if n)
    for r in kept[4]:
        placed[r["source"]] += len((r["text"] or "").split())
    for source, n in tokens.items():
        want = (n / total) ** a / z * total
        assert want - 1 <= placed[source] <= want + longest[source], source
    assert set(ids[4]) <= set(ids[3])

    coder, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for r in sorted(kept[4], key=lambda r: r["doc_id"]):
        coded = np.array([*coder.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((r["doc_id"], start, len(coded), zlib.crc32(coded.tobytes())))
        start += len(coded)
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in kept[5]) == sorted(want)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    df = queries.QUERIES[name](spark, sf_dir)
    names, want = duck_rows(queries.ORACLE_SQL[name], sf_dir)
    assert sorted(df.columns) == names
    assert spark_rows(df) == want
