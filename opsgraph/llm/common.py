"""Helpers shared by the training-data operators."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Text bytes that a Python worker turns into arrays at a time.
SLICE_BYTES = 2 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, as in tests, a new one under /tmp; never on a cluster."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("opsgraph.scratch", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("opsgraph.scratch", path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: The saved() tables of this process that are there.
made: list[str] = []


#: Spark removes a job's shuffle files when the job ends; by default it waits for the driver's collector.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(df: DataFrame, name: str, codec: str = "snappy", by: str | None = None) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, a lost executor loses nothing, and the job's shuffle files go. by: a column with a folder for each value."""
    spark = df.sparkSession
    path, before = new_path(spark, name), spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        writer = df.write.option("compression", codec)
        (writer.partitionBy(by) if by else writer).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    made.append(path)
    table = spark.read.schema(df.schema).parquet(path)
    table._saved_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes saved() tables that nothing reads any more."""
    for table in tables:
        delete(table.sparkSession, table._saved_at)


def delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    if path in made:
        made.remove(path)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all other characters as they are."""
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `most` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = offsets(batch.column(column))
        at = 0
        while at < batch.num_rows:
            end = max(at + 1, int(np.searchsorted(size, size[at] + most, side="right")) - 1)
            yield batch.slice(at, end - at)
            at = end


def offsets(text: pa.Array) -> np.ndarray:
    """Where each row's bytes start in `raw(text)`, and the end of the last."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    at = np.frombuffer(text.buffers()[1], kind, len(text) + 1, text.offset * np.dtype(kind).itemsize).astype(np.int64)
    return at - at[0]


def raw(text: pa.Array) -> np.ndarray:
    """All bytes of the rows, one after another; null counts as empty."""
    kind = np.int64 if pa.types.is_large_string(text.type) else np.int32
    at = np.frombuffer(text.buffers()[1], kind, len(text) + 1, text.offset * np.dtype(kind).itemsize)
    if at[-1] == at[0]:
        return np.zeros(0, np.uint8)
    return np.frombuffer(text.buffers()[2], np.uint8, int(at[-1] - at[0]), int(at[0]))


def filled(batch: pa.RecordBatch, column: str = "text") -> pa.Array:
    """The column with empty strings for nulls."""
    text = batch.column(column)
    return text.fill_null("") if text.null_count else text


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes about half of the output bits. Works in place."""
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


#: Runs of more bytes than this are hashed one by one.
LONG_RUN = 64


def hashed_runs(codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of bytes codes[start:end]. Equal runs hash alike wherever they stand; two seeds give independent hashes.

    A run is taken eight bytes a step, each mixed into the hash so far; longer runs than LONG_RUN are BLAKE2b digests.
    """
    # Eight bytes from any place on, as one number.
    padded = np.concatenate([codes, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(codes) + 1,), "<u8", padded, strides=(1,))
    start_of, step_of = np.random.Generator(np.random.PCG64(seed)).integers(0, 2**63, 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    size = ends - starts
    out = mix(size.astype(np.uint64) * np.uint64(0xA24BAED4963EE407) + start_of)
    at, left = starts, np.where(size <= LONG_RUN, size, 0)
    rows = np.arange(len(size))
    while True:
        more = left > 0
        if not more.all():
            rows, at, left = rows[more], at[more], left[more]
        if not len(rows):
            break
        block = eight[at] << (np.uint64(8) * (8 - np.minimum(left, 8)).astype(np.uint64))
        out[rows] = mix((out[rows] ^ block) * step_of)
        at, left = at + 8, left - 8
    for r in np.flatnonzero(size > LONG_RUN).tolist():
        digest = hashlib.blake2b(codes[starts[r] : ends[r]].tobytes(), digest_size=8, salt=int(seed).to_bytes(8, "little")).digest()
        out[r] = np.uint64(int.from_bytes(digest, "little"))
    return out
