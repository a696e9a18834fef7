"""Token-id output as one wavelet matrix per shard.

Documents are dealt to tasks by ranges of doc_id and written in ascending order. A shard holds whole documents, about
SHARD tokens, or one document where that is longer. Its file row has the document ids and lengths and the matrix: 16
bit-planes, most significant bit first, each in the stable order of the planes above it, with a count of set bits before
every BLOCK bits. Access, rank (occurrences before a place) and select (place of an occurrence) read the planes only:
select goes from the symbol's run in the last plane's order up, finding in each plane the k-th bit of a kind by a search in
the counts and one block's bits.

Null text is empty: the document has only its end id. Documents with equal ids follow one another in order of text hash;
null ids come first. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.bpe import transducer
from opsgraph.llm.common import filled, saved, slices

LEVELS = 16
SHARD = 1 << 20
BLOCK = 512


class WaveletMatrix:
    """A sequence of 16-bit symbols as bit-planes with rank directories."""

    def __init__(self, size: int, zeros: np.ndarray, planes: np.ndarray, ranks: np.ndarray) -> None:
        self.size, self.zeros, self.planes, self.ranks = size, zeros, planes, ranks

    @classmethod
    def build(cls, ids: np.ndarray) -> WaveletMatrix:
        n = len(ids)
        width = -(-n // BLOCK) * BLOCK // 8
        planes, ranks, zeros = np.zeros((LEVELS, width), np.uint8), np.zeros((LEVELS, width * 8 // BLOCK + 1), np.uint32), np.zeros(LEVELS, np.uint32)
        x = ids.astype(np.uint16)
        for level in range(LEVELS):
            one = (x & np.uint16(1 << (LEVELS - 1 - level))) != 0
            packed = np.packbits(one)
            planes[level, : len(packed)] = packed
            ranks[level, 1:] = np.cumsum(np.bitwise_count(planes[level].view(np.uint64)).reshape(-1, BLOCK // 64).sum(axis=1, dtype=np.uint32))
            sorted_ = np.empty_like(x)
            zeros[level] = n - np.count_nonzero(one)
            np.compress(one, x, out=sorted_[zeros[level] :])
            np.compress(~one, x, out=sorted_[: zeros[level]])
            x = sorted_
        return cls(n, zeros, planes, ranks)

    def to_bytes(self) -> bytes:
        return np.uint32(self.size).tobytes() + self.zeros.tobytes() + self.ranks.tobytes() + self.planes.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        n = int(np.frombuffer(data, np.uint32, 1)[0])
        width = -(-n // BLOCK) * BLOCK // 8
        blocks = width * 8 // BLOCK + 1
        at = 4 + 4 * LEVELS
        zeros = np.frombuffer(data, np.uint32, LEVELS, 4)
        ranks = np.frombuffer(data, np.uint32, LEVELS * blocks, at).reshape(LEVELS, blocks)
        planes = np.frombuffer(data, np.uint8, LEVELS * width, at + 4 * LEVELS * blocks).reshape(LEVELS, width)
        return cls(n, zeros, planes, ranks)

    def _bit(self, level: int, at: int) -> int:
        return int(self.planes[level, at >> 3]) >> (7 - (at & 7)) & 1

    def _ones(self, level: int, at: int) -> int:
        """Set bits of a plane before `at`."""
        block = at // BLOCK
        part = self.planes[level, block * BLOCK // 8 : (at + 7) // 8].copy()
        if at & 7 and len(part):
            part[-1] &= (0xFF00 >> (at & 7)) & 0xFF
        return int(self.ranks[level, block]) + int(np.bitwise_count(part).sum())

    def access(self, at: int) -> int:
        """The symbol at a place."""
        value = 0
        for level in range(LEVELS):
            bit, ones = self._bit(level, at), self._ones(level, at)
            at = int(self.zeros[level]) + ones if bit else at - ones
            value = value << 1 | bit
        return value

    def rank(self, symbol: int, at: int) -> int:
        """How often the symbol stands before `at`."""
        lo = 0
        for level in range(LEVELS):
            a, b = self._ones(level, lo), self._ones(level, at)
            lo, at = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if symbol >> (LEVELS - 1 - level) & 1 else (lo - a, at - b)
        return at - lo

    def _nth(self, level: int, bit: int, k: np.ndarray) -> np.ndarray:
        """Where in a plane the k-th (from 0) bits of a kind are: a search in the counts, then in one block each."""
        before = self.ranks[level].astype(np.int64)
        if not bit:
            before = np.arange(len(before)) * BLOCK - before
        block = np.searchsorted(before, k, side="right") - 1
        # The blocks' bits are unpacked some at a time.
        out = np.empty(len(k), np.int64)
        for i in range(0, len(k), 4096):
            own = block[i : i + 4096]
            bits = np.unpackbits(self.planes[level].reshape(-1, BLOCK // 8)[own], axis=1) == bit
            met = np.cumsum(bits, axis=1, dtype=np.int16) == (k[i : i + 4096] - before[own] + 1)[:, None]
            out[i : i + 4096] = own * BLOCK + np.argmax(met & bits, axis=1)
        return out

    def places(self, symbol: int, first: int = 0, last: int | None = None) -> np.ndarray:
        """The places of the symbol's occurrences first to last (exclusive; None: all), ascending."""
        lo, hi = 0, self.size
        for level in range(LEVELS):
            a, b = self._ones(level, lo), self._ones(level, hi)
            lo, hi = (int(self.zeros[level]) + a, int(self.zeros[level]) + b) if symbol >> (LEVELS - 1 - level) & 1 else (lo - a, hi - b)
        at = np.arange(lo + first, hi if last is None else min(hi, lo + last))
        for level in range(LEVELS - 1, -1, -1):
            bit = symbol >> (LEVELS - 1 - level) & 1
            at = self._nth(level, bit, at - int(self.zeros[level]) if bit else at)
        return at

    def select(self, symbol: int, k: int) -> int:
        """The place of the k-th occurrence, from 0; -1 if there are fewer."""
        at = self.places(symbol, k, k + 1)
        return int(at[0]) if len(at) else -1

    def decode(self) -> np.ndarray:
        """All symbols: the planes' partitions undone from the last to the first."""
        x = np.zeros(self.size, np.uint16)
        for level in range(LEVELS - 1, -1, -1):
            one = np.unpackbits(self.planes[level], count=self.size).view(bool)
            above = np.empty(self.size, np.uint16)
            z = int(self.zeros[level])
            above[~one] = x[:z]
            above[one] = x[z:] | np.uint16(1 << (LEVELS - 1 - level))
            x = above
        return x


SCHEMA = "part int, base long, n_tokens long, doc_ids array<{kind}>, sizes array<long>, matrix binary"


def _shards(path: str, end_id: int, shard: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each shard of this task's documents; base: the tokens of the task's shards before it."""
        coder, part = transducer(path), TaskContext.get().partitionId()
        base, held = 0, 0
        tokens: list[np.ndarray] = []
        sizes: list[np.ndarray] = []
        ids: list[pa.Array] = []

        def closed() -> pa.RecordBatch:
            size = np.concatenate(sizes)
            all_ids = pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.concat_arrays(ids))
            all_sizes = pa.ListArray.from_arrays(pa.array([0, len(size)], pa.int32()), pa.array(size))
            row = [pa.array([part], pa.int32()), pa.array([base], pa.int64()), pa.array([held], pa.int64()), all_ids, all_sizes, pa.array([WaveletMatrix.build(np.concatenate(tokens)).to_bytes()], pa.binary())]
            return pa.RecordBatch.from_arrays(row, ["part", "base", "n_tokens", "doc_ids", "sizes", "matrix"])

        for batch in slices(batches):
            coded, at = coder.coded(filled(batch))
            if len(coded) and int(coded.max()) >> LEVELS:
                raise ValueError(f"token id {int(coded.max())} needs more than {LEVELS} bit-planes")
            # Every document gets its end id: each of its tokens moves by the documents before it.
            size = np.diff(at) + 1
            at = at + np.arange(len(at))
            out = np.full(at[-1], end_id, np.uint16)
            out[np.arange(len(coded)) + np.repeat(np.arange(len(size)), size - 1)] = coded
            begin = 0
            while begin < len(size):
                # As many documents as the shard has room for, one at least in an empty one.
                stop = int(np.searchsorted(at, at[begin] + shard - held, side="right")) - 1
                stop = max(stop, begin + 1) if not held else max(stop, begin)
                if stop > begin:
                    tokens.append(out[at[begin] : at[stop]]), sizes.append(size[begin:stop]), ids.append(batch.column("doc_id").slice(begin, stop - begin))
                    held += int(at[stop] - at[begin])
                if stop < len(size):
                    yield closed()
                    base, held, tokens, sizes, ids = base + held, 0, [], [], []
                begin = stop
        if held:
            yield closed()

    return run


def write(docs: DataFrame, path: str, end_id: int = 0, shard: int = SHARD) -> DataFrame:
    """The stored shards of docs, for the tokenizers file at `path`. An id that doesn't fit into LEVELS bits is an error."""
    if not 0 <= end_id < 1 << LEVELS:
        raise ValueError(f"end id {end_id} needs more than {LEVELS} bit-planes")
    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce(F.col("text"), F.lit(""))
    ordered = docs.select(F.col("doc_id").alias("doc_id"), text.alias("text")).repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return saved(ordered.mapInArrow(_shards(path, end_id, shard), SCHEMA.format(kind=kind)), "shards", "zstd")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(batch.num_rows):
            ids = WaveletMatrix.from_bytes(batch.column("matrix")[r].as_py()).decode().astype("<u4")
            sizes = np.array(batch.column("sizes")[r].as_py(), np.int64)
            at = np.concatenate([[0], np.cumsum(sizes)])
            crc = [zlib.crc32(ids[at[i] : at[i + 1]]) for i in range(len(sizes))]
            start = batch.column("before")[r].as_py() + batch.column("base")[r].as_py() + at[:-1]
            yield pa.RecordBatch.from_arrays([batch.column("doc_ids")[r].values, pa.array(start), pa.array(sizes), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def read_back(shards: DataFrame) -> DataFrame:
    """Per document from the shards: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    kind = shards.schema["doc_ids"].dataType.elementType.simpleString()
    # One row for each writing task, so that its size is set by the number of partitions.
    sums = sorted(shards.groupBy("part").agg(F.sum("n_tokens")).collect())
    before, total = [], 0
    for part, n in sums:
        before.append((part, total))
        total += n
    first = shards.sparkSession.createDataFrame(before, "part int, before long")
    return shards.join(F.broadcast(first), "part").mapInArrow(_documents, f"doc_id {kind}, start long, n_tokens long, ids_crc32 long")


def _lookup(symbol: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                matrix = WaveletMatrix.from_bytes(batch.column("matrix")[r].as_py())
                at = matrix.places(symbol)
                base = batch.column("base")[r].as_py()
                yield pa.RecordBatch.from_arrays([pa.array([batch.column("part")[r].as_py()] * len(at), pa.int32()), pa.array(base + at)], ["part", "place"])

    return run


def occurrences(shards: DataFrame, symbol: int) -> DataFrame:
    """(part, place): where a token id stands, as a place among its writing task's tokens."""
    return shards.mapInArrow(_lookup(symbol), "part int, place long")
