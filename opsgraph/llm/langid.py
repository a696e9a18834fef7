"""Language identification as a mixture of languages.

Each language has a distribution over hashed character trigrams, counted over all labelled texts. A document's trigrams
are taken as drawn from a mixture of those distributions; expectation-maximisation estimates the proportions. The set of
languages is chosen by penalised likelihood: starting from all, the language with the smallest share goes as long as
the likelihood lost is worth less than PENALTY * log(number of trigrams); likelihoods are those that
expectation-maximisation converges to. The predicted language has the largest share,
which is the score.

The model is 2**BITS counts for each language, whatever the size of the corpus; it passes through the driver, so `lang`
must have a bounded number of values. Very long texts are counted like others, repeated rows each. Null texts and texts without a letter
are `und` with score 0, as is everything if no text is labelled. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import mix, slices

BITS = 14
#: Rounds of expectation-maximisation end when one adds less to the log likelihood.
TOLERANCE = 1e-3
PENALTY = 2.0
UNKNOWN = "und"


def grams(text: str) -> np.ndarray:
    """The hashed trigrams of a text's letters in lower case; what isn't a letter is one space. Empty without letters."""
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(code)
    if not letter.any():
        return np.zeros(0, np.int64)
    code = np.where(letter, code, 32)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32)
    code = np.concatenate([[32], code[keep], [32]]).astype(np.uint64)
    with np.errstate(over="ignore"):
        h = mix((code[:-2] << np.uint64(42)) ^ (code[1:-1] << np.uint64(21)) ^ code[2:])
    return (h >> np.uint64(64 - BITS)).astype(np.int64)


_is_letter = np.zeros(0, bool)


def _letters(code: np.ndarray) -> np.ndarray:
    global _is_letter
    if not len(_is_letter):
        _is_letter = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(0x110000)])
    return _is_letter[code]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """This task's trigram counts for each language."""
    total: dict[str, np.ndarray] = {}
    for batch in slices(batches):
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            total.setdefault(lang, np.zeros(2**BITS, np.int64))
            total[lang] += np.bincount(grams(text), minlength=2**BITS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at), pa.array(n[at])], ["lang", "gram", "n"])


def train(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """The languages and the logarithms of their trigram shares, smoothed, from rows (text, lang) without nulls."""
    counted = labelled.select("text", "lang").mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).collect()
    langs = sorted({r["lang"] for r in counted})
    n = np.full((len(langs), 2**BITS), 0.5)
    number = {lang: i for i, lang in enumerate(langs)}
    for lang, gram, c in counted:
        n[number[lang], gram] += c
    return langs, np.log(n / n.sum(axis=1, keepdims=True)) if langs else np.zeros((0, 2**BITS))


def mixture(count: np.ndarray, log_p: np.ndarray) -> np.ndarray:
    """The shares of all languages for trigrams with these counts; log_p: their log shares, a column for each language."""
    log_p = log_p - log_p.max(axis=1, keepdims=True)
    p, total = np.exp(log_p), count.sum()
    single = count @ log_p
    best = int(np.argmax(single))
    out = np.zeros(p.shape[1])
    live = np.arange(p.shape[1])
    shares, likelihood = _maximised(count, p, live)
    # No set can be likelier than all languages together; if they don't pay for one more than the best single one, it is alone.
    if likelihood - single[best] <= PENALTY * np.log(total):
        out[best] = 1.0
        return out
    while len(live) > 1:
        fewer = np.delete(live, np.argmin(shares))
        s, value = _maximised(count, p, fewer) if len(fewer) > 1 else (np.ones(1), single[fewer[0]])
        if likelihood - value > PENALTY * np.log(total):
            break
        live, shares, likelihood = fewer, s, value
    out[live] = shares
    return out


def _maximised(count: np.ndarray, p: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, float]:
    """Shares by expectation-maximisation, and their log likelihood."""
    q = p[:, live]
    share = np.full(len(live), 1 / len(live))
    total, last = count.sum(), -np.inf
    while True:
        seen = q @ share
        likelihood = float(count @ np.log(seen))
        if likelihood - last < TOLERANCE:  # it never falls
            return share, likelihood
        last = likelihood
        share = share * ((count / seen) @ q) / total


def _predict(langs: list[str], log_p: np.ndarray) -> Callable:
    table = np.ascontiguousarray(log_p.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, score, shares = [], [], []
            for text in batch.column("text").to_pylist():
                g = grams(text) if text is not None and langs else np.zeros(0, np.int64)
                if not len(g):
                    found.append(UNKNOWN), score.append(0.0), shares.append([])
                    continue
                count = np.bincount(g, minlength=2**BITS)
                at = np.flatnonzero(count)
                share = mixture(count[at].astype(float), table[at])
                best = int(np.argmax(share))
                found.append(langs[best]), score.append(float(min(1.0, share[best])))
                shares.append([{"lang": langs[i], "share": float(share[i])} for i in np.flatnonzero(share)])
            kept = [batch.column(i) for i in range(batch.num_columns - 1)]
            made = [pa.array(found, pa.string()), pa.array(score, pa.float64()), pa.array(shares, pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))]
            yield pa.RecordBatch.from_arrays([*kept, *made], [*batch.schema.names[:-1], "lang_pred", "score", "mixture"])

    return run


def predict(docs: DataFrame, langs: list[str], log_p: np.ndarray, keep: list[Column]) -> DataFrame:
    """The columns `keep` of docs, and lang_pred, score, mixture array<struct<lang, share>> of its text."""
    rows = docs.select(*keep, F.col("text").alias("text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_predict(langs, log_p), f"{kept}, lang_pred string, score double, mixture array<struct<lang:string,share:double>>")


def held_out(doc_id: Column) -> Column:
    """The fold that isn't learned from: crc32 of the id as text, modulo 4, is 2. False for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_rows(docs: DataFrame) -> DataFrame:
    """What may be learned from: text and lang of rows outside the held-out fold that have both, and an id."""
    return docs.filter(F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("text").alias("text"), F.col("lang").cast("string").alias("lang"))


def identified(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, mixture."""
    langs, log_p = train(labelled_rows(docs))
    return predict(docs, langs, log_p, [F.col("doc_id").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out")])


def known(docs: DataFrame, least: float = 0.4) -> DataFrame:
    """The rows whose predicted language has at least the share `least`, and isn't `und`; columns as they are."""
    langs, log_p = train(labelled_rows(docs))
    names = docs.columns
    found = predict(docs, langs, log_p, [F.col(f"`{c}`").alias(f"k{i}") for i, c in enumerate(names)])
    found = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return found.select(*[F.col(f"k{i}").alias(c) for i, c in enumerate(names)])
