"""Removal of repeated byte strings: suffixes are put in buckets, and buckets are refined by pointers to later offsets.

The bucket identifier of a suffix at depth 8 is its first 8 bytes. Depth doubles by naming each suffix after the pair of
identifiers at its own place and at the depth's offset (16, 32, 64, 128), and identifiers of one depth are used again for
the next, 48 = 32 + 16 and 200 = 128 with an overlap of 56. Identifiers are hashes of the pairs instead of ranks, so a
document is named without the others, and sorting by identifier is Spark's grouping.

Only sampled suffixes travel. In every 200-byte string the 48-byte suffix with the smallest identifier is its anchor, so
equal strings have equal anchors at equal offsets. Consecutive strings with one anchor make a segment. Refinement goes
  1. by the anchor's identifier: a bucket of one suffix is done, nothing in its segment occurs twice;
  2. by the identifier of the whole segment: of equal segments every string occurs again;
  3. by blocks of eight starts in the segments that are alone in a bucket with others: a block whose common 192 bytes
     occur in no other is done, and equal blocks occur again as a whole;
  4. by the 200-byte identifiers inside the blocks left.
The results of a step are used in the next: only buckets still mixed go on. Identifiers compared together have 128 bits
(bucket and name), so that a chance equality isn't to be expected at any corpus size in question.

Null text counts as empty. Texts of under LENGTH bytes stay as they are. Row identity is a hash of doc_id and text, so
repeated rows are occurrences of their own, whose spans are kept once. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import discard, filled, mix, offsets, raw, saved, slices

LENGTH = 200
ANCHOR = 48
#: Strings that start in one block of BLOCK places, counted from the anchor, have CORE bytes in common.
BLOCK = 8
CORE = 192
#: Anchors that one string of LENGTH bytes offers.
REACH = LENGTH - ANCHOR + 1


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The identifier of suffixes from those of their two parts."""
    x = a * np.uint64(0x9FB21C651E98DF25)
    x ^= x >> np.uint64(32)
    x += b
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(29)
    return x


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Identifiers at depths ANCHOR, CORE and LENGTH of every place that has so many bytes after it."""
    n = len(data)
    data = np.ascontiguousarray(data)
    d8 = np.ndarray((n - 7,), "<u8", data, 0, (1,)).copy()
    d16 = _pair(d8[:-8], d8[8:])
    d32 = _pair(d16[:-16], d16[16:])
    anchor = mix(_pair(d32[:-16], d16[32:]))
    d64 = _pair(d32[:-32], d32[32:])
    d128 = _pair(d64[:-64], d64[64:])
    return anchor, mix(_pair(d128[:-64], d64[128:])), mix(_pair(d128[:-72], d128[72:]))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The least of every `width` consecutive entries, from the running least forward and backward in blocks of that width."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def segments(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each segment of the documents data[at[i]:at[i + 1]]: document number, bucket, name, first and last start of its strings, place of the anchor."""
    none = np.zeros(0, np.int64)
    if len(data) < LENGTH:
        return none, none, none, none, none, none
    with np.errstate(over="ignore"):
        anchor, _, name = names(data)
        # The high half decides, the place breaks ties: the leftmost of equal ones, which equal strings agree on.
        ranked = (anchor & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(anchor), dtype=np.uint64)
        place = (sliding_least(ranked, REACH) & np.uint64(0xFFFFFFFF)).astype(np.int64)
        size = np.diff(at)
        long = np.flatnonzero(size >= LENGTH)
        change = np.zeros(len(place) + 1, np.int8)
        np.add.at(change, at[long], 1)
        np.add.at(change, at[long] + size[long] - LENGTH + 1, -1)
        valid = np.cumsum(change[:-1]) > 0
        step = np.ones(len(place), bool)
        step[1:] = place[1:] != place[:-1]
        prior = np.concatenate([[False], valid[:-1]])
        # Consecutive documents of just LENGTH bytes have strings without an invalid place between; so documents cut too.
        step[at[long]] = True
        first = np.flatnonzero(valid & (step | ~prior))
        cut = np.zeros(len(place) + 1, bool)
        cut[first] = True
        last = np.flatnonzero(valid & (np.concatenate([~valid[1:], [True]]) | cut[1:]))
        of = np.searchsorted(at, first, side="right") - 1
        whole = _pair(_pair(name[first], name[last]), (last - first).astype(np.uint64) * np.uint64(512) + (place[first] - first).astype(np.uint64))
        return of, anchor[place[first]].view(np.int64), mix(whole).view(np.int64), first - at[of], last - at[of], place[first] - at[of]


def _segment_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text = filled(batch)
        of, bucket, name, *places = segments(raw(text), offsets(text))
        row = batch.column("row").to_numpy(zero_copy_only=False)[of]
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(name), pa.array(row), *(pa.array(p.astype(np.int32)) for p in places)], ["bucket", "name", "row", "first", "last", "anchor"])


def _parts(batch: pa.RecordBatch, fields: list[str]) -> tuple[np.ndarray, ...]:
    """The rows' `parts` lists end to end: the number of the row that each is of, and its fields."""
    lists = batch.column("parts")
    flat = lists.flatten()
    of = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy(zero_copy_only=False)))
    return of, *(flat.field(k).to_numpy(zero_copy_only=False) for k in fields)


def _batches(columns: dict[str, np.ndarray], most: int = 100_000) -> Iterator[pa.RecordBatch]:
    n = len(next(iter(columns.values())))
    for i in range(0, n, most):
        yield pa.RecordBatch.from_arrays([pa.array(c[i : i + most]) for c in columns.values()], list(columns))


def _block_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The blocks of the listed segments; once: the segment has no equal."""
    for batch in slices(batches):
        text = filled(batch)
        data, at = raw(text), offsets(text)
        with np.errstate(over="ignore"):
            _, core, name = names(data)
        of, first, last, anchor, bucket, once = _parts(batch, ["first", "last", "anchor", "bucket", "once"])
        # Blocks are counted from the anchor, so that equal places of equal strings share a block.
        low, high = (first - anchor + LENGTH) // BLOCK, (last - anchor + LENGTH) // BLOCK
        count = (high - low + 1).astype(np.int64)
        seg = np.repeat(np.arange(len(of)), count)
        block = np.arange(len(seg)) - np.repeat(np.cumsum(count) - count, count) + low[seg]
        start = block * BLOCK - LENGTH + anchor[seg]
        lo, hi = np.maximum(start, first[seg]), np.minimum(start + BLOCK - 1, last[seg])
        base = at[of[seg]]
        with np.errstate(over="ignore"):
            whole = mix(_pair(_pair(name[base + lo], name[base + hi]), (lo - start).astype(np.uint64) * np.uint64(BLOCK) + (hi - start).astype(np.uint64)))
        row = batch.column("row").to_numpy(zero_copy_only=False)[of[seg]]
        middle = core[base + start + BLOCK - 1].view(np.int64)
        yield from _batches({"bucket": bucket[seg], "block": block.astype(np.int32), "core": middle, "whole": whole.view(np.int64), "row": row, "first": lo.astype(np.int32), "last": hi.astype(np.int32), "once": once[seg]})


def _string_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The names of all strings of the listed blocks."""
    for batch in slices(batches):
        text = filled(batch)
        data, at = raw(text), offsets(text)
        with np.errstate(over="ignore"):
            name = names(data)[2].view(np.int64)
        of, first, last, bucket, once = _parts(batch, ["first", "last", "bucket", "once"])
        width = (last - first + 1).astype(np.int64)
        part = np.repeat(np.arange(len(of)), width)
        start = np.arange(len(part)) - np.repeat(np.cumsum(width) - width, width) + first[part]
        row = batch.column("row").to_numpy(zero_copy_only=False)[of[part]]
        yield from _batches({"bucket": bucket[part], "name": name[at[of[part]] + start], "row": row, "start": start.astype(np.int32), "once": once[part]})


def repeated_starts(texts: DataFrame) -> DataFrame:
    """(row, first, last): ranges of starts of strings that start elsewhere too, for texts (row, text)."""
    found = saved(texts.mapInArrow(_segment_rows, "bucket long, name long, row long, first int, last int, anchor int"), "segments", "zstd")
    shared = found.groupBy("bucket").agg(F.count("*").alias("n"), F.min("name").alias("lo"), F.max("name").alias("hi")).filter("n > 1")
    open_ = saved(found.join(shared, "bucket").select(*found.columns, (F.col("lo") < F.col("hi")).alias("mixed")), "buckets", "zstd")
    discard(found)
    span = ["row", "first", "last"]
    mixed = open_.filter("mixed")
    alike = mixed.groupBy("bucket", "name").agg(F.count("*").alias("n"), F.min(F.struct("row", "first", "last", "anchor")).alias("one"))
    alike = saved(alike, "names", "zstd")
    again = mixed.join(alike.filter("n > 1").select("bucket", "name"), ["bucket", "name"])
    again = saved(open_.filter("not mixed").select(*span).union(again.select(*span)), "spans", "zstd")
    discard(open_)
    parts = alike.select("one.*", "bucket", (F.col("n") == 1).alias("once")).groupBy("row").agg(F.collect_list(F.struct("first", "last", "anchor", "bucket", "once")).alias("parts"))
    kinds = "bucket long, block int, core long, whole long, row long, first int, last int, once boolean"
    blocks = saved(texts.join(parts, "row").mapInArrow(_block_rows, kinds), "blocks", "zstd")
    discard(alike)
    key = ["bucket", "block", "core"]
    common = blocks.groupBy(*key).agg(F.bool_or("once").alias("any"), F.count("*").alias("n"), F.min("whole").alias("lo"), F.max("whole").alias("hi")).filter("any and n > 1")
    common = blocks.join(common.select(*key, (F.col("lo") < F.col("hi")).alias("mixed")), key)
    common = saved(common.select(*span, "bucket", "once", "mixed"), "common", "zstd")
    discard(blocks)
    whole = common.filter("not mixed and once").select(*span)
    parts = common.filter("mixed").groupBy("row").agg(F.collect_list(F.struct("first", "last", "bucket", "once")).alias("parts"))
    strings = texts.join(parts, "row").mapInArrow(_string_rows, "bucket long, name long, row long, start int, once boolean")
    strings = saved(strings, "strings", "zstd")
    twice = strings.groupBy("bucket", "name").agg(F.count("*").alias("n"), F.bool_or("once").alias("any")).filter("n > 1 and any")
    single = strings.filter("once").join(twice.select("bucket", "name"), ["bucket", "name"]).select("row", F.col("start").alias("first"), F.col("start").alias("last"))
    return again.union(whole).union(single)


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        text = filled(batch)
        data, at = raw(text), offsets(text)
        spans = batch.column("spans")
        flat, ends = spans.flatten(), spans.offsets.to_numpy(zero_copy_only=False)
        ends = ends - ends[0]
        first, last = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("first", "last"))
        removed, runs, digest = [], [], []
        for r in range(len(text)):
            own = data[at[r] : at[r + 1]]
            lo, hi = first[ends[r] : ends[r + 1]], last[ends[r] : ends[r + 1]] + LENGTH
            if not len(lo):
                removed.append(0), runs.append(0), digest.append(hashlib.sha256(own).hexdigest())
                continue
            change = np.zeros(len(own) + 1, np.int64)
            np.add.at(change, lo, 1)
            np.add.at(change, hi, -1)
            gone = np.cumsum(change[:-1]) > 0
            removed.append(int(gone.sum()))
            runs.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
            digest.append(hashlib.sha256(np.ascontiguousarray(own[~gone])).hexdigest())
        columns = [batch.column("doc_id"), pa.array(np.diff(at)), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _kept_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            own = bytearray((text or "").encode())
            gone = np.zeros(len(own), bool)
            for s in spans:
                gone[s["first"] : s["last"] + LENGTH] = True
            out.append(bytes(np.frombuffer(bytes(own), np.uint8)[~gone]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.binary())], ["doc_id", "kept"])


def _with_spans(docs: DataFrame) -> DataFrame:
    texts = docs.select(F.xxhash64("doc_id", "text").alias("row"), "doc_id", "text")
    spans = repeated_starts(texts.select("row", "text")).groupBy("row").agg(F.collect_set(F.struct("first", "last")).alias("spans"))
    none = F.array().cast("array<struct<first:int,last:int>>")
    return texts.join(spans, "row", "left").select("doc_id", "text", F.coalesce("spans", none).alias("spans"))


def removal_report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256 of the remaining bytes."""
    return _with_spans(docs).mapInArrow(_cut, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, kept): the remaining bytes of each document."""
    return _with_spans(docs).mapInArrow(_kept_text, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, kept binary")
