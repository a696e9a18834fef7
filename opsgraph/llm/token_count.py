"""Token counts with a transducer that runs over chunks of text and composes their state maps.

Texts are cut into chunks of CHUNK characters, each a row, so a very long text is spread over tasks. A chunk maps every
state in which the transducer may enter it to the state in which it leaves and the tokens emitted between. As a state is
the part of a segment read so far, that map is three values: the head up to the first place where a segment surely ends,
which completes any state; the tokens from there to the last such place; and the tail, the state it leaves in. Maps of
adjacent chunks compose, and composition is associative: in every round of a scan a document's neighbouring maps are
joined in pairs, each pair a row of its own, so no task sees more of a document than two heads and tails.

Null counts as empty. Repeated rows and null ids are counted each. A very long text without white space has no sure end:
its head is all of it. Extra columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.bpe import transducer
from opsgraph.llm.common import discard, saved, slices

CHUNK = 1 << 16
#: A segment surely ends between these two characters, whatever stands around them.
SURE = re.compile(r"[^\s᠎](?=[ \t-\r])")

#: The map of a chunk: (head, tokens, tail); without a sure end all is head and tokens is -1.
Map = tuple[str, int, str]


def counted(text: str, path: str) -> int:
    return int(transducer(path).counts(pa.array([text], pa.string()))[0])


def state_map(text: str, path: str) -> Map:
    """The map of a piece of text."""
    first = SURE.search(text)
    if not first:
        return text, -1, ""
    last = len(text) - 1
    while not SURE.match(text, last):
        last -= 1
    return text[: first.end()], counted(text[first.end() : last + 1], path), text[last + 1 :]


def compose(a: Map, b: Map, path: str) -> Map:
    """The map of two adjacent pieces of text."""
    seam = (a[0] if a[1] < 0 else a[2]) + b[0]
    if a[1] >= 0 and b[1] >= 0:
        return a[0], a[1] + counted(seam, path) + b[1], b[2]
    head, n, tail = state_map(seam, path)
    if a[1] < 0 and b[1] < 0:
        return head, n, tail
    if a[1] < 0:  # the seam's end is sure
        return (seam, b[1], b[2]) if n < 0 else (head, n + counted(tail, path) + b[1], b[2])
    return (a[0], a[1], seam) if n < 0 else (a[0], a[1] + counted(head, path) + n, tail)


def finished(whole: Map, path: str) -> int:
    """All tokens of a whole text: its map from the start state, and the end of the last segment."""
    return max(whole[1], 0) + counted(whole[0], path) + counted(whole[2], path)


def _chunk_rows(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = transducer(path)
        for batch in slices(batches):
            text = batch.column("text")
            cut = np.flatnonzero(batch.column("chunks").to_numpy(zero_copy_only=False) > 1)
            tokens = np.zeros(batch.num_rows, np.int64)
            head, tail = [""] * batch.num_rows, [""] * batch.num_rows
            whole = np.setdiff1d(np.arange(batch.num_rows), cut)
            # A text of one chunk enters in the start state only, so its map is finished at once.
            tokens[whole] = coder.counts(text if not len(cut) else text.take(pa.array(whole)))
            for i in cut.tolist():
                head[i], tokens[i], tail[i] = state_map(text[i].as_py(), path)
            keep = [batch.column(c) for c in ("row", "doc_id", "at", "chunks", "n_bytes")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(head, pa.string()), pa.array(tokens), pa.array(tail, pa.string())], ["row", "doc_id", "at", "chunks", "n_bytes", "head", "tokens", "tail"])

    return run


def _composed(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows with a left map, and a right one where there is a neighbour."""
        for batch in batches:
            rows = batch.to_pydict()
            left = zip(rows["head"], rows["tokens"], rows["tail"], strict=True)
            right = zip(rows["head_b"], rows["tokens_b"], rows["tail_b"], strict=True)
            made = [a if b[1] is None else compose(a, b, path) for a, b in zip(left, right, strict=True)]
            columns = [pa.array([m[i] for m in made], kind) for i, kind in enumerate((pa.string(), pa.int64(), pa.string()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("row", "at", "n_bytes")), *columns], ["row", "at", "n_bytes", "head", "tokens", "tail"])

    return run


def scanned(maps: DataFrame, path: str) -> DataFrame:
    """(row, n_bytes, n_tokens) of chunk maps (row, at, n_bytes, head, tokens, tail): a round joins neighbours, half the maps are left."""
    longest = maps.agg(F.max("at")).first()[0] or 0
    now, cols = maps.select("row", "at", "n_bytes", "head", "tokens", "tail"), ["head", "tokens", "tail"]
    stored = None
    while longest:
        right = now.filter("at % 2 = 1").select("row", F.expr("at - 1").alias("at"), F.col("n_bytes").alias("n_b"), *[F.col(c).alias(f"{c}_b") for c in cols])
        pairs = now.filter("at % 2 = 0").join(right, ["row", "at"], "left")
        pairs = pairs.select("row", F.expr("cast(at div 2 as int)").alias("at"), (F.col("n_bytes") + F.coalesce("n_b", F.lit(0))).alias("n_bytes"), *cols, *[f"{c}_b" for c in cols])
        now = saved(pairs.mapInArrow(_composed(path), "row long, at int, n_bytes long, head string, tokens long, tail string"), "maps")
        if stored is not None:
            discard(stored)
        stored, longest = now, longest // 2
    return now.mapInArrow(_finished(path), "row long, n_bytes long, n_tokens long")


def _finished(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.to_pydict()
            n = [finished(m, path) for m in zip(rows["head"], rows["tokens"], rows["tail"], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("n_bytes"), pa.array(n, pa.int64())], ["row", "n_bytes", "n_tokens"])

    return run


def counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """Per document: doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit), for the tokenizers file at `path`."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chunks = F.greatest(F.lit(1), F.ceil(F.length("text") / chunk)).cast("int")
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").alias("doc_id"), text.alias("text")).withColumn("chunks", chunks)
    pieces = rows.select("row", "doc_id", "text", "chunks", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("at"))
    pieces = pieces.withColumn("text", F.when(F.col("chunks") == 1, F.col("text")).otherwise(F.substring("text", F.col("at") * chunk + 1, F.lit(chunk))))
    pieces = pieces.withColumn("n_bytes", F.octet_length("text").cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    mapped = pieces.mapInArrow(_chunk_rows(path), f"row long, doc_id {kind}, at int, chunks int, n_bytes long, head string, tokens long, tail string")
    mapped = saved(mapped, "chunks")
    short = mapped.filter("chunks = 1").select("doc_id", "n_bytes", F.col("tokens").alias("n_tokens"))
    many = mapped.filter("chunks > 1")
    ids = many.filter("at = 0").select("row", "doc_id")
    long = scanned(many, path).join(ids, "row").select("doc_id", "n_bytes", "n_tokens")
    return short.union(long).withColumn("over_limit", F.col("n_tokens") > limit)
