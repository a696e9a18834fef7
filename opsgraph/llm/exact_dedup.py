"""Exact deduplication over an extendible-hash index on shared files, in DataFrame functions only.

Keys are 64-bit hashes of the normalised text. The directory says how many leading key bits each bucket owns: starting
at depth 0, a bucket with more than `capacity` distinct keys is split by one more bit, and the directory doubles while
any bucket needs it. It has two levels: the first is MAX_DEPTH bits deep at most, as it passes through the driver; a
bucket still overfull there has a directory of its own, doubled as often as its keys ask for, and its keys' next bits
are the place in it. Keys that no bit can tell apart stay together in a chain of overflow entries.

Texts themselves meet in a grouping by (bucket, key, text): copies collapse within each input task before anything is
shuffled, so a text that a third of all rows hold is a few rows per task. Grouping compares whole texts byte by byte;
different texts with one key become a chain of several entries. An owner task holds whole buckets, that is
ranges of keys, and writes them as index files (bucket, key, chain, keep_id, group_size) into the shared folder.

Null text counts as empty. Rows with null doc_id take part; a null never stays while a row with an id does. Repeated
rows count each. Extra columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opsgraph.llm.common import saved

#: Depth of the first level of the directory at most; it has 2**MAX_DEPTH slots then.
MAX_DEPTH = 16
#: Buckets of an owner task, where there are more buckets than shuffle partitions.
OWNED = 64
CAPACITY = 4096


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def slot(key: Column, depth: int = MAX_DEPTH) -> Column:
    """The leading `depth` bits of a key."""
    return F.shiftrightunsigned(key, 64 - depth).cast("int")


def directory(keys: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> tuple[list[int], list[int]]:
    """Bucket number of every slot, and for every bucket the bits of its own directory (0: it has none), for keys (key).

    What comes to the driver is one count for each of at most 2**max_depth slots.
    """
    counted = keys.groupBy(slot(F.col("key"), max_depth).alias("slot")).agg(F.approx_count_distinct("key", 0.02).alias("n")).collect()
    counts = [0] * 2**max_depth
    for slot_no, n in counted:
        counts[slot_no] = n
    below = [0]
    for n in counts:
        below.append(below[-1] + n)
    depth, whole = 0, [(0, 0)]  # buckets as (local depth, prefix)
    done: list[tuple[int, int]] = []
    while whole:
        over = []
        for d, prefix in whole:
            lo, hi = prefix << (max_depth - d), (prefix + 1) << (max_depth - d)
            (over if below[hi] - below[lo] > capacity and d < max_depth else done).append((d, prefix))
        depth += bool(over)
        whole = [(d + 1, 2 * prefix + bit) for d, prefix in over for bit in (0, 1)]
    slots, bits = [0] * 2**depth, []
    for number, (d, prefix) in enumerate(sorted(done, key=lambda x: x[1] << (max_depth - x[0]))):
        for at in range(prefix << (depth - d), (prefix + 1) << (depth - d)):
            slots[at] = number
        held = below[(prefix + 1) << (max_depth - d)] - below[prefix << (max_depth - d)]
        # As the keys are hashes, a directory of so many slots has buckets of about half the capacity or less.
        bits.append(min(31, math.ceil(math.log2(held / capacity)) + 1) if held > capacity else 0)
    return slots, bits


def bucket_of(key: Column, slots: list[int], bits: list[int], max_depth: int = MAX_DEPTH) -> Column:
    """The bucket that owns a key: that of its slot, and its place in the bucket's own directory."""
    depth = len(slots).bit_length() - 1
    first = F.element_at(F.lit(slots), slot(key, depth) + 1) if depth else F.lit(slots[0])
    if not any(bits):
        return first.cast("long")
    deeper = F.element_at(F.lit(bits), first + 1)
    # Shifts by the bits of a column are not shifts by 64, so no bits is a case of its own.
    place = F.when(deeper > 0, F.call_function("shiftrightunsigned", F.shiftleft(key, max_depth), F.lit(64) - deeper)).otherwise(F.lit(0))
    return first.cast("long") * F.lit(1 << 32) + place


def build_index(keyed: DataFrame, slots: list[int], bits: list[int], max_depth: int = MAX_DEPTH) -> DataFrame:
    """The stored index (bucket, key, chain, keep_id, group_size, text_sha256) of (doc_id, key, norm): one entry for each different text."""
    texts = keyed.withColumn("bucket", bucket_of(F.col("key"), slots, bits, max_depth)).groupBy("bucket", "key", "norm")
    entries = texts.agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size"))
    entries = entries.select("bucket", "key", F.sha2("norm", 256).alias("text_sha256"), "keep_id", "group_size")
    n_buckets = sum(1 << b for b in bits)
    parts = int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    entries = entries.repartition(max(min(n_buckets, parts), n_buckets // OWNED), "bucket")
    # A chain has the different texts of one key; it is one entry long unless 64-bit keys collide.
    chain = F.row_number().over(Window.partitionBy("bucket", "key").orderBy(F.col("keep_id").asc_nulls_last(), "text_sha256"))
    return saved(entries.withColumn("chain", chain), "index")


def groups(docs: DataFrame, capacity: int = CAPACITY, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Per document: doc_id, keep_id (the smallest doc_id with an equal text), group_size, kept, text_sha256.

    Of rows that share the smallest id and the text, all are marked kept: they are one document delivered twice.
    Null ids: keep_id is null only where all of a group's ids are, and then all its rows are kept.
    """
    norm = docs.select("doc_id", normalised(F.col("text")).alias("norm"))
    keyed = norm.withColumn("key", F.xxhash64("norm"))
    rows = saved(keyed.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256")), "keys")
    slots, bits = directory(rows, capacity, max_depth)
    index = build_index(keyed, slots, bits, max_depth)
    # Where a key has one text, the key alone names the entry; in longer chains the digest of the text does.
    alone = index.groupBy("key").agg(F.max("chain").alias("n")).filter("n > 1")
    collided = alone.limit(1).count() > 0
    entry = index.select("key", "keep_id", "group_size", *(["text_sha256"] if collided else []))
    out = rows.join(entry, ["key", "text_sha256"] if collided else ["key"])
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return out.select("doc_id", "keep_id", "group_size", kept.alias("kept"), "text_sha256")
