"""Whitening of embeddings by principal components that Chebyshev-filtered subspace iteration finds.

The covariance matrix is never formed: all that is known of it are products with a few columns, each a pass over the
vectors, which are stored once as blocks. A polynomial of degree `DEGREE`, applied by its three-term recurrence with one
pass for each term, damps the unwanted part of the spectrum; then QR and Rayleigh-Ritz give new columns, until the wanted
ones are certified. What reaches the driver has as many numbers as the vectors' length times the columns.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opsgraph.llm.common import discard, saved
from opsgraph.llm.vectors import floors, kept

SCALE = 64
#: floor(64 * c) is stored in 32 bits: entries of 2**25 and more count as 2**25.
MOST = 2**31 - 1
#: Vectors in a stored block.
BLOCK = 8192
DEGREE = 8
#: Random columns that join each round, so that a direction which the others miss comes up.
FRESH = 4
#: A wanted pair is certified when its residual is at most this part of the largest eigenvalue.
RESIDUAL = 1e-12
ROUNDS = 60
#: Eigenvalues up to this part of the largest count as zero; nothing can be divided by them.
ZERO = 1e-10


def fit_list(vectors: DataFrame, width: int) -> DataFrame:
    """Each distinct integer vector once, in blocks (n, y): y holds n vectors of 32-bit floor(64 * c)."""

    def integers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                y = floors(b.column("embedding"), width, SCALE, MOST).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([r.tobytes() for r in y], pa.binary())], ["y"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        for b in batches:
            held += b.column("y").to_pylist()
            while len(held) >= BLOCK:
                yield _block(held[:BLOCK])
                held = held[BLOCK:]
        if held:
            yield _block(held)

    return saved(vectors.select("embedding").mapInArrow(integers, "y binary").distinct().mapInArrow(packed, "n int, y binary"), "whiten-fit")


def _block(held: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([len(held)], pa.int32()), pa.array([b"".join(held)], pa.binary())], ["n", "y"])


def _deviations(y: bytes, width: int, n: int, sums: np.ndarray) -> np.ndarray:
    """n * y - S, exact, a row for each vector."""
    return np.frombuffer(y, np.int32).reshape(-1, width).astype(np.int64) * n - sums


def sums_of(blocks: DataFrame, width: int) -> tuple[int, np.ndarray]:
    """(n, S): how many vectors there are, and their exact sum by dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros(width, np.int64), 0
        for b in batches:
            for y in b.column("y").to_pylist():
                m = np.frombuffer(y, np.int32).reshape(-1, width)
                total, n = total + m.sum(axis=0, dtype=np.int64), n + len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, width), pa.int32()), pa.array(np.insert(total, 0, n), pa.int64())], ["i", "s"])

    rows = blocks.mapInArrow(run, "i int, s long").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    got = {r["i"]: int(r["s"]) for r in rows}
    return got.get(-1, 0), np.array([got.get(i, 0) for i in range(width)], np.int64)


def _summed(blocks: DataFrame, of: Callable[[bytes], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of a matrix of this shape over all blocks, added up in the tasks, then by matrix entry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for b in batches:
            for y in b.column("y").to_pylist():
                total += of(y)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["c", "s"])

    out = np.zeros(shape[0] * shape[1])
    for r in blocks.mapInArrow(run, "c int, s double").groupBy("c").agg(F.sum("s").alias("s")).collect():
        out[r["c"]] = r["s"]
    return out.reshape(shape)


class Covariance:
    """Products of the covariance of stored blocks with columns; each is one pass over the blocks."""

    def __init__(self, blocks: DataFrame, width: int) -> None:
        self.blocks, self.width, self.passes = blocks, width, 0
        self.n, self.sums = sums_of(blocks, width)

    def times(self, q: np.ndarray) -> np.ndarray:
        width, n, sums = self.width, self.n, self.sums

        def product(y: bytes) -> np.ndarray:
            b = _deviations(y, width, n, sums) / n
            return b.T @ (b @ q)

        self.passes += 1
        return _summed(self.blocks, product, q.shape) / n

    def trace(self) -> float:
        width, n, sums = self.width, self.n, self.sums
        square = lambda y: ((_deviations(y, width, n, sums) / n) ** 2).sum(axis=0)[None, :]
        return float(_summed(self.blocks, square, (1, width)).sum() / n)

    def identity_error(self, vectors: np.ndarray, values: np.ndarray) -> float:
        """The largest entry of the covariance of what is whitened, without the identity, measured on the vectors."""
        width, n, sums, k = self.width, self.n, self.sums, len(values)

        def moments(y: bytes) -> np.ndarray:
            w = (_deviations(y, width, n, sums) / n) @ vectors / np.sqrt(values)
            return np.vstack([w.sum(axis=0)[None, :], w.T @ w])

        got = _summed(self.blocks, moments, (k + 1, k)) / n
        return float(np.abs(got[1:] - np.outer(got[0], got[0]) - np.eye(k)).max())


def lowest(v: Covariance, rng: np.random.Generator, steps: int = 10) -> float:
    """A lower bound of the spectrum from a few Lanczos steps: the least Ritz value less its residual, 0 at least."""
    q = rng.standard_normal(v.width)
    basis, alpha, beta = [q / np.linalg.norm(q)], [], []
    for _ in range(min(steps, v.width)):
        w = v.times(basis[-1][:, None])[:, 0]
        alpha.append(basis[-1] @ w)
        for _ in range(2):  # twice is enough for orthogonality
            w = w - np.array(basis).T @ (np.array(basis) @ w)
        beta.append(np.linalg.norm(w))
        if beta[-1] <= 1e-12 * max(alpha):
            break
        basis.append(w / beta[-1])
    k = len(alpha)
    values, vectors = np.linalg.eigh(np.diag(alpha) + np.diag(beta[: k - 1], 1) + np.diag(beta[: k - 1], -1))
    return max(0.0, float(values[0] - beta[k - 1] * abs(vectors[-1, 0])))


def filtered(v: Covariance, q: np.ndarray, low: float, high: float, top: float, degree: int = DEGREE) -> np.ndarray:
    """The Chebyshev polynomial that is small on [low, high], of the covariance, times q; scaled so that it is about 1 at top."""
    half, mid = (high - low) / 2, (high + low) / 2
    first = sigma = half / (top - mid)
    before, now = q, (v.times(q) - mid * q) * (sigma / half)
    for _ in range(degree - 1):
        after = 1 / (2 / first - sigma)
        before, now = now, (v.times(now) - mid * now) * (2 * after / half) - (sigma * after) * before
        sigma = after
    return now


def principal_components(v: Covariance, wanted: int = 16, seed: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, eigenvectors as columns) of the `wanted` largest eigenvalues, falling; those that count as zero are left out.

    The columns are twice as many as wanted, and FRESH random ones in each round. Certified: two rounds after each other
    agree in the values, and all residuals |Vq - eq| are at most RESIDUAL times the largest eigenvalue. As fresh columns
    went through the last round's filter, a larger value that had been missed would have changed them. If that isn't
    reached in ROUNDS rounds, it is an error.
    """
    rng = np.random.Generator(np.random.PCG64(seed))
    width = v.width
    held = min(width, 2 * wanted)
    q = np.linalg.qr(rng.standard_normal((width, min(width, held + FRESH))))[0]
    low = lowest(v, rng) if q.shape[1] < width else 0.0
    known, before = np.zeros(0), np.inf
    for _ in range(ROUNDS):
        product = v.times(q)
        small = q.T @ product
        values, turn = np.linalg.eigh((small + small.T) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        q, product = q @ turn, product @ turn
        top, k = max(values[0], 0.0), min(wanted, len(values))
        residual = np.linalg.norm(product[:, :k] - q[:, :k] * values[:k], axis=0).max()
        settled = len(known) == k and np.abs(values[:k] - known).max() <= RESIDUAL * top
        # All of the space at once, or certified; the second small residual in a row, as the first may still get smaller.
        if top == 0.0 or q.shape[1] == width or (settled and max(residual, before) <= RESIDUAL * top):
            good = values[:k] > ZERO * top
            return values[:k][good], q[:, :k][:, good]
        known, before = values[:k].copy(), residual
        q = q[:, :held]
        high = values[held - 1]
        joined = np.hstack([q, rng.standard_normal((width, min(FRESH, width - held)))])
        joined = np.linalg.qr(joined)[0]
        if high <= 1e-12 * top:  # all that isn't zero is in the columns by now
            y = v.times(joined)
        else:
            y = filtered(v, joined, min(low, 0.9 * high), high, top)
        q = np.linalg.qr(y)[0]
    raise RuntimeError(f"no {wanted} components certified in {ROUNDS} rounds")


def whitened(table: DataFrame, components: int = 16) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each kept vector and component.

    Vectors are integers floor(64 * c) + 1000000; the fit is over each distinct one once (n of them), what is returned
    over all rows, repeated ones too. Left out are rows as `vectors.kept` says. Components whose eigenvalue is zero don't
    exist: of vectors that are all alike nothing is returned, nor of an empty table. `deviation`, the exact sum of
    (n * x - S)**2, is null where it doesn't fit into 64 bits.
    """
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    spark = table.sparkSession
    rows, width = kept(table)
    if not width:
        return spark.createDataFrame([], schema)
    blocks = fit_list(rows, width)
    v = Covariance(blocks, width)
    values, vectors = principal_components(v, components)
    k = len(values)
    if not k:
        return spark.createDataFrame([], schema)
    explained, error = values / v.trace(), v.identity_error(vectors, values)
    n, sums = v.n, v.sums
    discard(blocks)
    turned = vectors / np.sqrt(values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            d = floors(b.column("embedding"), width, SCALE, MOST) * n - sums
            white = (d / n) @ turned
            m = len(d)
            yield pa.RecordBatch.from_arrays(
                [b.column("vec_id").take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), _squares(d).take(pa.array(np.repeat(np.arange(m), k))), pa.array(white.ravel()), pa.array(np.tile(explained, m)), pa.array(np.full(m * k, error))],
                ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(run, schema)


def _squares(d: np.ndarray) -> pa.Array:
    """The exact sum of squares of each row; null beyond 64 bits."""
    most = int(np.abs(d).max(initial=0))
    if most * most * d.shape[1] < 2**63:
        return pa.array((d * d).sum(axis=1))
    exact = (d.astype(object) ** 2).sum(axis=1)
    return pa.array([x if x < 2**63 else None for x in exact], pa.int64())
