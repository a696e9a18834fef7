"""N-gram Jaccard join with parity sketches.

A document's set is its distinct word shingles, as 64-bit hashes, which are verified with a second one. Each shingle toggles one bit of a long sketch, so the
sketches of two sets differ in at most as many bits as the sets differ in members. The sketch is cut into parts; two
linked sets differ in at most d members, so of L parts at least L - d are equal (pigeonhole). A part's key is an XOR of
one random word for each toggled bit: equal parts have equal keys.

Size bands have a layout of parts each; a set that can link to one of a band below also posts keys there. A set posts
the first L parts of its size, and knows how many of its keys any linked partner shares at least (`need`): those parts
that can't differ, less its empty parts, which are alike in many sets and aren't posted. If they could be all that is
shared, they are posted, and need is 1.

Candidates come from keys in three linear steps, none of which can lose a link:
  1. keys of one set only are dropped;
  2. sets that share fewer keys with others than they need are dropped, in ROUNDS rounds;
  3. of its keys each set drops the need - 1 that most sets share. Keys have one order for all sets, so of the keys that
     a linked pair shares the rarest is kept by both.

Equal sets are one node of the join, so copies are never paired. It is named by a 64-bit digest of the set; should unlike
sets have the same, which a second digest tells, they are given other names before anything is joined. In a group that shares a key
all members are paired with one only, first the one that shares most with others; groups that still span several classes
take another centre next. Pairs pass if sizes and the Hamming distance of short parity sketches, a bit or more for each
shingle, allow it, and are then verified on the texts. Links found join nodes into classes.

Groups may span several classes even then: documents that share a long passage, or copies each changed on its own. XOR
of a member's sketch and its centre's is the sketch of their difference, and the difference of two members' differences is
their own. So two members link only if what sets one apart from the centre sets the other apart too, for the most part:
as one of them doesn't link to the centre, more than half of what sets the other apart, or so. The differences' finest
sketches, a key for each shingle, are joined under their centre in the same three steps, those that don't link to it
(out) among each other and with the rest. By the third step the frequent keys go, which are the centre's own shingles.
What is left is paired across classes, so no unverified pair between classes is left: classes are exact, though not all
pairs inside a class are listed.

Null text and texts without words have an empty set, linked with nothing. Rows with a null doc_id take part in no links
(component_id null). doc_id may have any type that has an order. Rows with one doc_id are judged each by their own text.
Very long texts are one set each, in one task. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.llm.common import discard, filled, hashed_runs, mix, offsets, raw, saved, slices
from opsgraph.llm.components import components

#: White space of the word rule, and ASCII lower case, for each byte.
SPACE = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOWER = np.where((np.arange(256) >= 65) & (np.arange(256) <= 90), np.arange(256) + 32, np.arange(256)).astype(np.uint8)
PART_BITS = 4096
#: Turns in which groups are tried as stars before differences from a centre are joined.
TURNS = 2
#: Rounds in which sets are dropped that share too few keys.
ROUNDS = 2
#: Slices of the keys that are shuffled one after the other, so that one slice of all posts is in a shuffle at a time.
KEY_SLICES = 4
#: Parts posted beyond those the pigeonhole needs, as a share of them: at most, and for the largest sets of a band.
SPARE, LEAST_SPARE = 0.35, 0.1
#: Longest bit sketch, in words of 64 bits, and bits for each shingle below that: the more, the nearer its distance is to the sets'.
MOST_WORDS = 1024
SHINGLE_BITS = 1
#: Size bands: each starts at RATIO times the last one's start.
RATIO = 1.6
EDGES = np.unique(np.ceil(RATIO ** np.arange(64)).astype(np.int64))
#: Members of a star that one verifying task holds at a time, besides its centre.
STAR = 256


def shingle_sets(text: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of all rows, row by row and sorted in each; and where each row's begin (one more entry)."""
    values, _, begin = checked_sets(text, size, check=False)
    return values, begin


def checked_sets(text: pa.Array, size: int, check: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """shingle_sets with a second, independent hash of each shingle beside the first, all zero unless `check`."""
    data, at = LOWER[raw(text)], offsets(text)
    n = len(text)
    blank = SPACE[data]
    row_start = np.zeros(len(data) + 1, bool)
    row_start[at[:-1]] = True
    word = ~blank
    before = np.concatenate([[False], word[:-1]]) & ~row_start[:-1] if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero(word & ~before)
    after = np.concatenate([word[1:] & ~row_start[1:-1], [False]]) if len(data) else np.zeros(0, bool)
    ends = np.flatnonzero(word & ~after) + 1
    first = np.searchsorted(starts, at)  # of each row's words
    count = np.diff(first)
    # Rows of fewer words than a shingle, but not none, are one shingle of their own length.
    short = np.flatnonzero((count > 0) & (count < size))
    total = max(0, len(starts) - size + 1)
    owner = np.repeat(np.arange(n), count)
    inside = owner[:total] == owner[size - 1 :] if total else np.zeros(0, bool)

    def hashed(seed: int) -> np.ndarray:
        """A hash of every shingle, then of every short row."""
        h = hashed_runs(data, starts, ends, seed)
        value = np.zeros(total, np.uint64)
        for k in range(size):
            value = mix(value * np.uint64(0x9E3779B97F4A7C15) + h[k : k + total])
        few = count[short].astype(np.uint64)
        for k in range(size - 1):
            more = np.flatnonzero(count[short] > k)
            few[more] = mix(few[more] * np.uint64(0x9E3779B97F4A7C15) + h[first[short[more]] + k])
        return np.concatenate([value[inside], few])

    with np.errstate(over="ignore"):
        value = hashed(1)
        second = hashed(2) if check else np.zeros(len(value), np.uint64)
    owner = np.concatenate([owner[:total][inside], short])
    order = np.lexsort((second, value, owner)) if check else np.lexsort((value, owner))
    value, second, owner = value[order], second[order], owner[order]
    keep = np.ones(len(value), bool)
    keep[1:] = (value[1:] != value[:-1]) | (second[1:] != second[:-1]) | (owner[1:] != owner[:-1])
    value, second, owner = value[keep], second[keep], owner[keep]
    return value, second, np.searchsorted(owner, np.arange(n + 1))


def set_digest(values: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests of each row's set."""
    with np.errstate(over="ignore"):
        sums = []
        for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(values ^ np.uint64(salt)), dtype=np.uint64)])
            sums.append(total[begin[1:]] - total[begin[:-1]])
    return sums[0], sums[1]


def most_apart(n: int, num: int, den: int) -> int:
    """The most members by which a set of n shingles differs from a linked set that is not smaller: J >= num / den."""
    # With |B| <= |A| * den / num, the symmetric difference is at most (den - num) / (den + num) * (|A| + |B|).
    return (den - num) * (n + n * den // num) // (den + num)


def band_of(n: int) -> int:
    """The size band of a set; each band's sizes reach RATIO times its smallest."""
    return int(np.searchsorted(EDGES, n, side="right")) - 1


def _spare(apart: int) -> int:
    return 2 + int(apart * SPARE)


@lru_cache
def layout(band: int, num: int, den: int) -> int:
    """Parts of a band's sketches: enough for its largest set."""
    apart = most_apart(int(EDGES[band + 1]) - 1, num, den)
    return apart + 1 + max(2, int(apart * LEAST_SPARE))


@lru_cache(1 << 16)
def posted(n: int, band: int, num: int, den: int) -> tuple[int, int]:
    """How many parts of a band's layout a set of n shingles posts, and how many of them any linked set of the band has too.

    A set not larger than its partner posts apart + 1 + its spare ones, `apart` being the most in which they differ; the
    partner posts those too, as both grow with size. The fewest are equal at one end of the sizes that a smaller one can have.
    """
    parts = layout(band, num, den)
    low, high = max(-(-n * num // den), int(EDGES[band])), min(n, int(EDGES[band + 1]) - 1)
    apart = most_apart(high, num, den)
    return min(parts, apart + 1 + _spare(apart)), min(parts - apart, 1 + _spare(most_apart(low, num, den)))


def sketch_keys(values: np.ndarray, num: int, den: int) -> list[tuple[int, np.ndarray]]:
    """(need, keys) that a set of shingles posts in each of its bands; none if only equal sets can link to it."""
    n = len(values)
    if not most_apart(n, num, den):
        return []
    out = []
    with np.errstate(over="ignore"):
        for b in range(band_of(n), band_of(-(-n * num // den)) - 1, -1):  # the bands of all smaller partners
            parts = layout(b, num, den)
            count, need = posted(n, b, num, den)
            part = (values >> np.uint64(20)) % np.uint64(parts)
            toggled = mix((part << np.uint64(12) | values % np.uint64(PART_BITS)) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(b + 1))
            order = np.argsort(part, kind="stable")
            part = part[order]
            where = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            key = np.zeros(parts, np.uint64)
            key[part[where]] = np.bitwise_xor.reduceat(toggled[order], where)
            key = key[:count]
            full = np.flatnonzero(key)
            # Without the empty parts at least `rest` shared ones are left.
            rest = need - (count - len(full))
            at = full if rest > 0 else np.arange(count)
            out.append((max(rest, 1), mix(key[at] ^ mix((at.astype(np.uint64) << np.uint64(8)) + np.uint64(b) + np.uint64(1 << 40)))))
    return out


def bit_sketches(values: np.ndarray, begin: np.ndarray, bits: int = SHINGLE_BITS) -> tuple[np.ndarray, np.ndarray]:
    """A short parity sketch of each row, one bit toggled for a shingle: 64-bit words and where each row's begin. The least power of two with `bits` bits for each shingle, or MOST_WORDS."""
    n = np.diff(begin)
    words = np.where(n > 0, np.minimum(MOST_WORDS, 2 ** np.ceil(np.log2(np.maximum(n * bits, 64) / 64)).astype(np.int64)), 0)
    at = np.concatenate([[0], np.cumsum(words)]).astype(np.int32)
    owner = np.repeat(np.arange(len(n)), n)
    place = (values >> np.uint64(32)).astype(np.int64) & (words[owner] * 64 - 1)
    out = np.zeros(int(at[-1]), np.uint64)
    np.bitwise_xor.at(out, at[owner] + (place >> 6), np.uint64(1) << (place & 63).astype(np.uint64))
    return out.view(np.int64), at


def may_link(x: str, y: str, num: int, den: int) -> Column:
    """False where sizes or sketches show that two nodes (n, bits) can't link: Hamming distance is at most the difference of the sets.

    Sketch lengths of linked sets differ by a factor of two at most; the longer one is folded.
    """
    n = [F.col(f"{a}.n") for a in (x, y)]
    bits = [F.col(f"{a}.bits") for a in (x, y)]

    def folded(own: Column, other: Column) -> Column:
        half = F.size(other)
        halves = F.zip_with(F.slice(own, F.lit(1), half), F.slice(own, half + 1, half), lambda a, b: a.bitwiseXOR(b))
        return F.when(F.size(own) == 2 * half, halves).otherwise(own)

    apart = F.aggregate(F.zip_with(folded(bits[0], bits[1]), folded(bits[1], bits[0]), lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, k: s + k)
    sizes = (n[0] * num <= n[1] * den) & (n[1] * num <= n[0] * den)
    return sizes & (apart * (den + num) <= (n[0] + n[1]) * (den - num))


def _lists(flat: pa.Array, sizes: list[int]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *sizes]).astype(np.int32)), flat)


def _sketches(size: int, num: int, den: int, shingle_bits: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document; of equal sets only the first of a task carries keys."""
        posted_: set[tuple[int, int]] = set()
        for batch in slices(batches):
            values, begin = shingle_sets(filled(batch), size)
            node, check = (d.view(np.int64) for d in set_digest(values, begin))
            known = batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            bands: list[list[tuple[int, np.ndarray]]] = []
            for r, d in enumerate(zip(node.tolist(), check.tolist(), strict=True)):
                fresh = known[r] and begin[r] < begin[r + 1] and d not in posted_
                bands.append(sketch_keys(values[begin[r] : begin[r + 1]], num, den) if fresh else [])
                posted_.add(d) if fresh else None
            each = [x for row in bands for x in row]
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *(k.view(np.int64) for _, k in each)]))
            keys = pa.StructArray.from_arrays([pa.array([need for need, _ in each], pa.int32()), _lists(flat, [len(k) for _, k in each])], ["need", "keys"])
            bits, bit_at = bit_sketches(values, begin, shingle_bits)
            columns = [batch.column("doc_id"), batch.column("text_hash"), pa.array(np.diff(begin)), pa.array(node), pa.array(check), pa.ListArray.from_arrays(pa.array(bit_at), pa.array(bits)), _lists(keys, [len(row) for row in bands])]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "text_hash", "n_shingles", "node", "digest", "bits", "bands"])

    return run


def _difference(centre: np.ndarray, own: np.ndarray, a: int, b: int, num: int, den: int) -> Iterator[tuple]:
    """(node b, band, role, need, keys) of the difference of b's set from that of a. A set out of reach of a meets others so (role 0), and those within reach (1; theirs is 2)."""
    apart = np.setxor1d(centre, own, assume_unique=True)
    size = len(apart)
    # Linked sets x and y share (|Dx| + |Dy| - |x ^ y|) / 2 of their differences D from the centre c at least, where
    # |x ^ y| <= (den - num) / (den + num) * (|x| + |y|), and |Dy| is more than that share of |y| + |c| if y is out.
    out = size * (den + num) > (den - num) * (len(centre) + len(own))
    half = (size * (den + num) + (den - num) * (len(centre) - len(own))) // (2 * (den + num)) + 1
    keys = mix(apart ^ mix(np.array([a], np.int64).view(np.uint64)))
    other = mix(keys ^ np.uint64(0x452821E638D01377)).view(np.int64)
    if out:
        yield b, a, 0, max(1, half), keys.view(np.int64)
        yield b, ~a, 1, max(1, size - most_apart(len(own), num, den)), other
    else:
        yield b, ~a, 2, max(1, half), other


def _stars(size: int, num: int, den: int, differences: bool) -> Callable:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Rows come sorted by star (a, salt), its centre first. Links (a, b) of members to the centre go out, or for each member the keys of its difference."""
        star, centre, its = None, np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for frame in batches:
            if frame.empty:
                continue
            values, second, begin = checked_sets(pa.array(frame["text"], pa.string()), size)
            digest = set_digest(values, begin)[1].view(np.int64)
            a, salt, b, named = (frame[c].to_numpy() for c in ("a", "salt", "b", "digest"))
            out: list[tuple] = []
            for r in range(len(frame)):
                own, also = values[begin[r] : begin[r + 1]], second[begin[r] : begin[r + 1]]
                if digest[r] != named[r]:  # another text than the node's
                    continue
                if a[r] == b[r]:
                    star, centre, its = (a[r], salt[r]), own, also
                elif star == (a[r], salt[r]):
                    if differences:
                        out.extend(_difference(centre, own, a[r], b[r], num, den))
                        continue
                    _, i, j = np.intersect1d(centre, own, assume_unique=True, return_indices=True)
                    common = int(np.count_nonzero(its[i] == also[j]))
                    if den * common >= num * (len(centre) + len(own) - common) and common:
                        out.append((a[r], b[r]))
            if differences:
                yield pd.DataFrame(out, columns=["node", "band", "role", "need", "keys"]).astype({"node": "int64", "band": "int64", "role": "int32", "need": "int32"})
            else:
                yield pd.DataFrame(out, columns=["a", "b"]).astype("int64")

    return run


def starred(pairs: DataFrame, texts: DataFrame, size: int, num: int, den: int, differences: bool = False) -> DataFrame:
    """The pairs (a, b) whose sets link; or, for each, the keys (node, band, role, need, keys) of b's difference from a.

    Each star is dealt out in pieces of about STAR members, with a copy of its centre each.
    """
    pieces = pairs.groupBy("a").agg(F.ceil(F.count("*") / STAR).cast("long").alias("pieces"))
    salted = saved(pairs.join(pieces, "a").select("a", F.pmod("b", "pieces").alias("salt"), "b"), "pairs")
    routes = salted.union(salted.select("a", "salt", F.col("a").alias("b")).distinct())
    rows = routes.join(texts.withColumnRenamed("node", "b"), "b").select("a", "salt", "b", "digest", "text")
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(parts, "a", "salt").sortWithinPartitions("a", "salt", (F.col("b") != F.col("a")), "b")
    return rows.mapInPandas(_stars(size, num, den, differences), "node long, band long, role int, need int, keys array<long>" if differences else "a long, b long")


def needed(posts: DataFrame, last: bool) -> DataFrame:
    """Of posts (node, band, need, key) those that may still matter, stored: keys that several nodes hold, of nodes that hold `need` of them in a band.

    last: without the need - 1 that most nodes hold, and with freq, the nodes of the key. A window is one node's keys of
    one band, so it is as large as a document, or the nodes of one key. Each has its own job, so that posts are in one
    shuffle at a time.
    """
    holders, own = Window.partitionBy("key"), Window.partitionBy("node", "band")
    shared = saved(posts.withColumn("freq", F.count("*").over(holders)).filter("freq > 1"), "counted")
    if last:
        out = shared.withColumn("rank", F.row_number().over(own.orderBy(F.desc("freq"), "key"))).filter("rank >= need").select("node", "band", "need", "key", "freq")
    else:
        out = shared.withColumn("held", F.count("*").over(own)).filter("held >= need").select("node", "band", "need", "key")
    out = saved(out, "kept" if last else "shared")
    discard(shared)
    return out


def shared_keys(posts: DataFrame, *spent: DataFrame) -> DataFrame:
    """(node, band, need, key, freq), stored: of posts (node, band, need, key) those by which candidates are found. spent: stored tables that only the posts read."""
    # Counted with copies that several tasks have posted: keys held by one node only are found in the rounds below. Most
    # posts go here; a slice of the keys is shuffled at a time, and its shuffle goes before the next one's.
    holders = Window.partitionBy("key")
    parts = []
    for k in range(KEY_SLICES):
        own = posts.filter(F.pmod(F.col("key"), F.lit(KEY_SLICES)) == k)
        parts.append(saved(own.withColumn("n", F.count("*").over(holders)).filter("n > 1").drop("n").distinct(), "shared"))
    discard(*spent)
    shared, stale = reduce(DataFrame.union, parts), parts
    for last in [False] * ROUNDS + [True]:
        fewer = needed(shared, last)
        discard(*stale)
        shared, stale = fewer, [fewer]
    return shared


def told_apart(made: DataFrame) -> DataFrame:
    """The stored sketches with an own node for every set: where sets of unlike digests have one node, all but the least digest's get another."""
    while True:
        unlike = made.groupBy("node").agg(F.min("digest").alias("least"), F.max("digest").alias("most")).filter("least < most")
        unlike = saved(unlike.select("node", "least"), "unlike")
        if not unlike.limit(1).count():
            discard(unlike)
            return made
        other = F.when(F.col("digest") > F.col("least"), F.xxhash64("node", "digest")).otherwise(F.col("node"))
        renamed = saved(made.join(unlike, "node", "left").withColumn("node", other).select(*made.columns), "sketches")
        discard(made, unlike)
        made = renamed


def grouped(docs: DataFrame, size: int, num: int, den: int, shingle_bits: int) -> DataFrame:
    """similar_groups with text_hash: a row is known by doc_id and the hash of its text, as a doc_id may repeat with other texts."""
    source = docs.select(F.col("doc_id").alias("doc_id"), F.col("text").alias("text"), F.xxhash64("text").alias("text_hash"))
    row = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_hash long, n_shingles long, node long, digest long, bits array<long>, bands array<struct<need:int,keys:array<long>>>"
    made = told_apart(saved(source.mapInArrow(_sketches(size, num, den, shingle_bits), row), "sketches"))
    posts = made.select("node", F.posexplode("bands").alias("band", "own")).select("node", F.col("band").cast("long").alias("band"), "own.need", F.explode("own.keys").alias("key"))
    kept = shared_keys(posts)
    sets = saved(made.select("doc_id", "text_hash", "n_shingles", "node"), "sets")
    first_doc = sets.filter("n_shingles > 0 and doc_id is not null").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("row")).select("node", "row.doc_id", "row.text_hash")
    nodes = saved(first_doc, "nodes")
    held = kept.select("node").distinct()
    traits = made.filter(F.size("bands") > 0).join(held, "node").groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("bits").alias("bits"), F.first("digest").alias("digest"))
    traits = saved(traits, "traits")
    discard(made)
    texts = nodes.join(traits.select("node", "digest"), "node").join(source, ["doc_id", "text_hash"]).select("node", "digest", "text").dropDuplicates(["node"])
    texts = saved(texts, "texts", "zstd")
    label = saved(traits.select("node", F.col("node").alias("component")), "labels")
    x, y = traits.alias("x"), traits.alias("y")
    tried: DataFrame | None = None

    def spanning(posts: DataFrame, order: Column) -> DataFrame:
        """Stored members of the groups that span several classes, with the group's first in that order as its centre."""
        members = posts.select("key", "node", "score").join(label, "node")
        spans = members.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.max(F.struct(order.alias("o"), "node", "component")).alias("centre")).filter("low < high")
        members = members.join(spans.select("key", "centre"), "key").select("key", "node", "score", "component", F.col("centre.node").alias("centre"), F.col("centre.component").alias("its"))
        return saved(members, "members")

    def joined(pairs: DataFrame) -> None:
        """Verifies pairs (a, b) that weren't, and joins the classes of those that link."""
        nonlocal tried, label
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti")
        pairs = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).filter(may_link("x", "y", num, den)).select("a", "b")
        pairs = saved(pairs, "tried")
        if not pairs.limit(1).count():
            return
        tried = pairs if tried is None else tried.union(pairs)
        found = saved(starred(pairs, texts, size, num, den), "links")
        if not found.limit(1).count():
            return
        # Links join classes: only the classes' own labels go through components.
        ends = found.join(label.select(F.col("node").alias("a"), F.col("component").alias("u")), "a").join(label.select(F.col("node").alias("b"), F.col("component").alias("v")), "b")
        merged = components(ends.select(F.col("u").alias("a"), F.col("v").alias("b"))).select(F.col("id").alias("component"), F.col("component").alias("root"))
        now = saved(label.join(merged, "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        discard(label, found)
        label = now

    open_ = saved(kept.join(kept.groupBy("node").agg(F.sum("freq").alias("score")), "node").select("key", "node", "score"), "open")
    discard(kept)
    by_score = F.col("score").cast("double")
    for turn in range(TURNS):  # every member with its group's centre, another one each turn
        members = spanning(open_, F.xxhash64(F.lit(turn), "node").cast("double") if turn + 1 < TURNS else by_score)
        discard(open_)
        open_ = members
        if not members.limit(1).count():
            break
        joined(members.filter("component != its").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    # Centres as in the last turn, so that every member of another class has been tried with its centre.
    members = spanning(open_, by_score)
    stars = members.filter("centre != node").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    apart = saved(starred(stars, texts, size, num, den, differences=True), "differences")
    discard(open_, members)
    sizes = saved(apart.select("node", "band", "role", F.size("keys").alias("size")), "sizes")
    kept = shared_keys(apart.select("node", "band", "need", F.explode("keys").alias("key")), apart)
    left = saved(kept.join(sizes, ["node", "band"]).join(label, "node").select("key", "node", "role", "need", "size", "component"), "left")
    discard(sizes, kept)
    u, v = left.alias("x"), left.alias("y")
    # Each must be able to share what the other needs.
    fit = (F.col("x.key") == F.col("y.key")) & (F.col("x.need") <= F.col("y.size")) & (F.col("y.need") <= F.col("x.size"))
    outside = u.filter("role = 0").join(v.filter("role = 0"), fit & (F.col("x.component") < F.col("y.component")))
    across = u.filter("role = 1").join(v.filter("role = 2"), fit & (F.col("x.component") != F.col("y.component")))
    ends = [F.col("x.node").alias("a"), F.col("y.node").alias("b")]
    joined(outside.select(*ends).union(across.select(*ends)))
    open_ = left
    discard(open_, texts, traits)
    owned = saved(nodes.join(label, "node", "left").select("node", F.coalesce("component", "node").alias("component"), "doc_id"), "owned")
    first = owned.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    of_node = owned.join(first, "component").select("node", "component_id")
    return sets.join(of_node, "node", "left").select("doc_id", "text_hash", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def similar_groups(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, shingle_bits: int = SHINGLE_BITS) -> DataFrame:
    """Per document: doc_id, n_shingles (set size), component_id (the smallest doc_id reachable by links). Links: den * |A and B| >= num * |A or B|."""
    return grouped(docs, size, num, den, shingle_bits).drop("text_hash")


def first_of_group(docs: DataFrame, size: int = 5, num: int = 80, den: int = 100, shingle_bits: int = 1) -> DataFrame:
    """docs without those of a group of similar documents but the one with the smallest doc_id; columns as they are.

    Rows that share the smallest doc_id all stay; so do rows with a null doc_id. Rows with one doc_id stay or go each by their own text.
    """
    gone = grouped(docs, size, num, den, shingle_bits).filter("component_id < doc_id").select(F.col("doc_id").alias("__gone"), F.col("text_hash").alias("__text"))
    return docs.join(gone.distinct(), (docs["doc_id"] == F.col("__gone")) & (F.xxhash64(docs["text"]) == F.col("__text")), "left_anti")
