"""Product codes of embeddings by Lloyd's method on members that stay with their codebook entry.

Every part of a vector is a member of its (position, entry, salt): one shuffle brings it there, in blocks. In a round the
owners sum what is resident, which gives the new codebooks, and judge their members by them: members whose entry is still
the nearest stay where they are stored, and only those that change entry go through the next shuffle to their new owner.
An entry with many members is dealt out to salts, so no owner's share grows with the data. The codebooks (positions x
entries x part length numbers) pass through the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import discard, mix, saved
from opsgraph.llm.vectors import floors, kept

SCALE = 256
#: floor(256 * x) beyond this counts as this, so that all distances fit into 64 bits.
MOST = 2**25
#: Members of an owner, on average, if all parts of a position had the same entry; and the most in one stored block.
MEMBERS = 65_536
#: Salts of a label, so that the rows of a common one don't meet in one task.
LABEL_SALTS = 64

MEMBER = "position int, entry int, salt int, n int, ids binary, parts binary"
Codebook = np.ndarray  # positions x entries x part length, int64


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(entry, squared distance) of each part's nearest entry, the lower one of equally near ones; exact."""
    best = np.zeros(len(parts), np.int32)
    least = ((parts - entries[0]) ** 2).sum(axis=1)
    for e in range(1, len(entries)):
        d = ((parts - entries[e]) ** 2).sum(axis=1)
        closer = d < least
        best[closer] = e
        least = np.where(closer, d, least)
    return best, least


def _blocks(position: int, entry: np.ndarray, salt: np.ndarray, ids: np.ndarray, parts: np.ndarray) -> Iterator[tuple]:
    """The members as blocks, one for each (entry, salt)."""
    order = np.lexsort((salt, entry))
    entry, salt, ids, parts = entry[order], salt[order], ids[order], parts[order]
    cuts = np.flatnonzero((np.diff(entry) != 0) | (np.diff(salt) != 0)) + 1
    for a, b in zip(np.r_[0, cuts], np.r_[cuts, len(ids)], strict=True):
        if b > a:
            yield position, int(entry[a]), int(salt[a]), int(b - a), ids[a:b].astype(np.int64).tobytes(), parts[a:b].astype(np.int32).tobytes()


def _batch(rows: list[tuple], names: str, *more: pa.Array) -> pa.RecordBatch:
    kinds = [{"int": pa.int32(), "binary": pa.binary(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in names.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in names.split(", ")])


def _members(b: pa.RecordBatch) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(position, entry, salt, ids, parts) of each block."""
    for r in b.to_pylist():
        yield r["position"], r["entry"], r["salt"], np.frombuffer(r["ids"], np.int64), np.frombuffer(r["parts"], np.int32).reshape(r["n"], -1).astype(np.int64)


def first_members(rows: DataFrame, book: Codebook, width: int, salts: int) -> DataFrame:
    """The parts of (row, embedding) in blocks, each with its nearest entry of the first codebooks."""
    positions, length = book.shape[0], book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _padded(floors(b.column("embedding"), width, SCALE, MOST), positions * length)
                ids = b.column("row").to_numpy()
                salt = (mix(ids.astype(np.uint64)) % np.uint64(salts)).astype(np.int32)
                made = []
                for p in range(positions):
                    part = x[:, p * length : (p + 1) * length]
                    made += _blocks(p, nearest(part, book[p])[0], salt, ids, part)
                yield _batch(made, MEMBER)

    return rows.select("row", "embedding").mapInArrow(run, MEMBER)


def _padded(x: np.ndarray, width: int) -> np.ndarray:
    return np.pad(x, ((0, 0), (0, width - x.shape[1])))


def at_owners(blocks: DataFrame) -> DataFrame:
    """The blocks of each (position, entry, salt) brought together and merged."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, n = None, [], 0
        for b in batches:
            for r in b.to_pylist():
                own = r["position"], r["entry"], r["salt"]
                if held and (own != key or n + r["n"] > MEMBERS):
                    yield _merged(key, held)
                    held, n = [], 0
                key, n = own, n + r["n"]
                held.append(r)
        if held:
            yield _merged(key, held)

    owner = ["position", "entry", "salt"]
    return blocks.repartition(*owner).sortWithinPartitions(*owner).mapInArrow(run, MEMBER)


def _merged(key: tuple, held: list[dict]) -> pa.RecordBatch:
    return _batch([(*key, sum(r["n"] for r in held), b"".join(r["ids"] for r in held), b"".join(r["parts"] for r in held))], MEMBER)


def updated(members: DataFrame, book: Codebook) -> Codebook:
    """The codebooks with each entry at the floor of its members' mean; entries without members stay."""
    length = book.shape[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[tuple[int, int], np.ndarray] = {}
        for b in batches:
            for p, e, _, ids, parts in _members(b):
                total[p, e] = total.get((p, e), 0) + np.append(parts.sum(axis=0), len(ids))
        if total:
            yield _batch([(p, e, i, int(s)) for (p, e), sums in total.items() for i, s in enumerate(sums)], "position int, entry int, i int, s long")

    found = members.mapInArrow(run, "position int, entry int, i int, s long").groupBy("position", "entry", "i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    sums = {(r["position"], r["entry"], r["i"]): int(r["s"]) for r in found}
    out = book.copy()
    for p, e, i in sums:
        if i < length:
            out[p, e, i] = sums[p, e, i] // sums[p, e, length]
    return out


def migrated(members: DataFrame, book: Codebook, name: str) -> DataFrame:
    """The members by their nearest entry of new codebooks: who stays is stored without a shuffle, who changes goes to the new owner."""
    schema = f"{MEMBER}, moved boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for p, e, s, ids, parts in _members(b):
                new = nearest(parts, book[p])[0]
                made += [(*x, x[1] != e) for x in _blocks(p, new, np.full(len(ids), s, np.int32), ids, parts)]
            if made:
                yield _batch(made, schema)

    judged = saved(members.mapInArrow(run, schema), name, by="moved")
    arrived = saved(at_owners(judged.filter("moved").drop("moved")), f"{name}-arrived")
    out = judged.filter("not moved").drop("moved").union(arrived)
    out._parts = [judged, arrived]
    return out


def final_parts(members: DataFrame, book: Codebook) -> DataFrame:
    """(row, position, entry, distance) of each part by the final codebooks."""
    schema = "row long, position int, entry int, distance long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p, _, _, ids, parts in _members(b):
                e, d = nearest(parts, book[p])
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(np.full(len(ids), p, np.int32)), pa.array(e), pa.array(d)], ["row", "position", "entry", "distance"])

    return members.mapInArrow(run, schema)


def digest(book: Codebook) -> str:
    return hashlib.sha256(",".join(map(str, book.ravel().tolist())).encode()).hexdigest()


def trained(rows: DataFrame, width: int, positions: int, entries: int, rounds: int) -> tuple[DataFrame, Codebook]:
    """(members, codebooks) after `rounds` rounds over stored (row, vec_id, embedding), started from the smallest vec_ids.

    The members stand with their entry of the codebooks before the last update.
    """
    n = rows.count()
    first = rows.orderBy(F.asc_nulls_last("vec_id"), "row").limit(entries).select("embedding").toArrow()
    x = floors(first.column("embedding").combine_chunks(), width, SCALE, MOST)
    length = -(-width // positions)
    book = _padded(x, positions * length).reshape(len(x), positions, length).transpose(1, 0, 2).copy()
    members = saved(at_owners(first_members(rows, book, width, max(1, -(-n // MEMBERS)))), "codes-0")
    spent = [members]
    for r in range(rounds):
        book = updated(members, book)
        if r + 1 < rounds:
            members = migrated(members, book, f"codes-{r + 1}")
            discard(*spent)
            spent = members._parts
    return members, book


def compressed(table: DataFrame, positions: int = 16, entries: int = 64, rounds: int = 2) -> DataFrame:
    """(vec_id, label, code, error, label_error, codebooks_sha256): one row for each kept vector, repeated ones too.

    Entries of vectors are floor(256 * x); beyond 2**25 they count as that. A vector whose length isn't a multiple of
    `positions` is filled up with zeros. Rows are left out as `vectors.kept` says; an empty table gives no rows. With
    fewer rows than `entries` there are as many entries; of the rows of one vec_id any comes first, a null vec_id last.
    Labels may be null: those rows are one group. `error` and `label_error` are exact.
    """
    schema = "vec_id long, label int, code string, error long, label_error long, codebooks_sha256 string"
    spark = table.sparkSession
    found, width = kept(table, "label")
    if not width:
        return spark.createDataFrame([], schema)
    if entries > 256:
        raise ValueError("a code has two hex digits for each part: 256 entries at most")
    rows = saved(found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding"), "codes-rows")
    members, book = trained(rows, width, positions, entries, rounds)
    parts = final_parts(members, book)
    entry = [F.max(F.when(F.col("position") == p, F.col("entry"))).alias(f"e{p}") for p in range(positions)]
    none = lambda kind: F.lit(None).cast(kind)
    both = rows.select("row", F.lit(True).alias("own"), "vec_id", "label", none("int").alias("position"), none("int").alias("entry"), none("long").alias("distance"))
    both = both.union(parts.select("row", none("boolean"), none("long"), none("int"), "position", "entry", "distance"))
    one = both.groupBy("row").agg(F.max("vec_id").alias("vec_id"), F.max("label").alias("label"), F.sum("distance").alias("error"), *entry)
    text = F.concat(*[F.lpad(F.lower(F.hex(f"e{p}")), 2, "0") for p in range(positions)])
    coded = saved(one.select("row", "vec_id", "label", text.alias("code"), "error"), "codes")
    discard(rows, *getattr(members, "_parts", [members]))
    return with_label_error(coded).withColumn("codebooks_sha256", F.lit(digest(book))).select("vec_id", "label", "code", "error", "label_error", "codebooks_sha256")


def with_label_error(coded: DataFrame) -> DataFrame:
    """The rows with the error of all rows of the same label; a label's rows are dealt out to salts, its sum goes to each."""
    known = F.col("label").isNull().alias("no_label"), F.coalesce("label", F.lit(0)).alias("own")
    sums = coded.groupBy(*known).agg(F.sum("error").alias("label_error")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(LABEL_SALTS - 1))))
    rows = coded.select("*", *known, F.pmod(F.xxhash64("row"), F.lit(LABEL_SALTS)).cast("int").alias("salt"))
    return rows.join(sums, ["no_label", "own", "salt"]).drop("no_label", "own", "salt", "row")
