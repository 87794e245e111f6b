"""Whitening of embeddings from exact integer covariances, computed on bit planes.

Entries become integers, and each dimension's values, shifted to start at zero,
are packed one bit plane at a time across rows into 64-bit words. The sum of the
products of two dimensions is then the sum over pairs of their planes of
2^(a+b) times the number of rows with both bits, a population count of the AND
of two planes. All of it is exact; centring happens on whole numbers before the
eigenvectors are taken.

Rows whose vector is null or holds a null, NaN or infinite entry are left out,
and so are vectors of another length than the commonest (the longest of equally
common ones): they lack entries. Repeated rows count as often as they occur.
An entry beyond 2^42 in size counts as 2^42. Ties of eigenvalues leave the
components free within their space; the sign is such that the entry of largest
size is positive. An empty table gives a model of no components and no rows.
Long vectors need memory for a matrix of the squared length in every task and
in the driver; the number of rows does not matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placelab.llm.common import fresh, map_batches, map_partitions

#: An entry c becomes floor(SCALE * c) + OFFSET.
SCALE, OFFSET = 1024, 100_000

LIMIT = 1 << 52
BATCH_ROWS = 8192
#: Weights 2^w of population counts are kept apart by w // LIMB_BITS, so that 64 bits hold FLUSH_ROWS rows.
LIMB_BITS, FLUSH_ROWS = 31, 1 << 24


@dataclass(frozen=True)
class Whitening:
    """What ``fit`` has found: rows, per dimension sum and least value, components (columns) and eigenvalues."""

    n: int
    sums: list[int]
    low: list[int]
    components: np.ndarray
    eigenvalues: np.ndarray
    trace: float

    @property
    def dimensions(self) -> int:
        return len(self.sums)

    def scales(self, k: int) -> np.ndarray:
        """Deviations of the first ``k`` components; NaN where rounding alone makes the eigenvalue."""
        e = self.eigenvalues[:k]
        least = self.dimensions * np.finfo(float).eps * max(self.eigenvalues.max(initial=0), 0)
        return np.sqrt(np.where(e > least, e, np.nan))

    def explained(self, k: int) -> list[float | None]:
        return [float(e / self.trace) if self.trace else None for e in self.eigenvalues[:k]]


def finite(vector: Column) -> Column:
    """Whether a vector is there and all its entries are numbers."""
    whole = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return F.coalesce(whole, F.lit(False))


def _vectors(df: DataFrame, column: str) -> Column:
    return F.col(column).cast("array<double>")


def whole_numbers(lists: pa.Array, dimensions: int) -> np.ndarray:
    """Rows of integers of a column of vectors that all have ``dimensions`` entries."""
    values = lists.flatten().to_numpy(zero_copy_only=False).reshape(-1, dimensions)
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * values), -LIMIT, LIMIT).astype(np.int64) + OFFSET


def _length(vectors: DataFrame) -> int:
    common = vectors.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return common.d if common else 0


def _statistics(vectors: DataFrame, dimensions: int) -> tuple[int, list[int], list[int], list[int]]:
    """(rows, sums, least values, largest values); one row per task and dimension is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums, low, high = 0, [0] * dimensions, None, None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):  # 2^10 values of 2^52 fit into 64 bits
                x = whole_numbers(batch.column(0).slice(at, 1024), dimensions)
                n += len(x)
                sums = [a + int(b) for a, b in zip(sums, x.sum(axis=0))]
                least, most = x.min(axis=0), x.max(axis=0)
                low, high = (least, most) if low is None else (np.minimum(low, least), np.maximum(high, most))
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(dimensions), pa.int32()), pa.array([n] * dimensions, pa.int64()),
                 pa.array([str(s) for s in sums]), pa.array(low), pa.array(high)], ["d", "n", "s", "l", "h"])

    parts = map_partitions(vectors, run, "d int, n long, s string, l long, h long")
    rows = parts.groupBy("d").agg(
        F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"), F.min("l").alias("l"), F.max("h").alias("h")
    ).orderBy("d").collect()  # one row per dimension
    return rows[0].n, [int(r.s) for r in rows], [r.l for r in rows], [r.h for r in rows]


class BitPlanes:
    """Sums of products of all pairs of dimensions, added up batch by batch.

    ``bits`` holds the number of planes of each dimension. ``totals`` has one
    upper triangular matrix per limb; a product is the sum of limb l times 2^(31 l).
    """

    def __init__(self, bits: list[int]) -> None:
        self.size, self.bits = len(bits), bits
        self.dim = np.repeat(np.arange(len(bits)), bits)
        self.bit = np.concatenate([np.arange(b) for b in bits]) if self.dim.size else np.zeros(0, int)
        self.start = np.concatenate([[0], np.cumsum(bits)[:-1]]).astype(int)
        self.limbs = max(0, 2 * (max(bits, default=1) - 1)) // LIMB_BITS + 1
        self.clear()

    def clear(self) -> None:
        self.rows, self.totals = 0, np.zeros((self.limbs, self.size, self.size), np.int64)

    def pack(self, shifted: np.ndarray) -> np.ndarray:
        """(planes, words): bit b of every row of a dimension, 64 rows to a word."""
        rows = len(shifted)
        words = -(-rows // 64)
        planes = np.zeros((len(self.dim), words * 8), np.uint8)
        across = np.ascontiguousarray(shifted.T)
        for p, (d, b) in enumerate(zip(self.dim, self.bit)):
            planes[p, : -(-rows // 8)] = np.packbits((across[d] >> b).astype(np.uint8) & 1)
        return planes.view(np.uint64)

    def add(self, shifted: np.ndarray) -> None:
        planes = self.pack(shifted)
        self.rows += len(shifted)
        for p in range(len(planes)):
            both = np.bitwise_count(planes[p:] & planes[p]).sum(axis=1, dtype=np.int64)
            d, weight = self.dim[p], self.bit[p:] + self.bit[p]
            both[1 : self.start[d] + self.bits[d] - p] *= 2  # the pair (a, b) of one dimension stands for (b, a) too
            both <<= weight % LIMB_BITS
            for limb in range(self.limbs):
                part = both if self.limbs == 1 else np.where(weight // LIMB_BITS == limb, both, 0)
                self.totals[limb, d] += _by_dimension(part, self.dim[p:], self.size)


def _by_dimension(values: np.ndarray, dims: np.ndarray, size: int) -> np.ndarray:
    edges = np.flatnonzero(np.diff(dims, prepend=-1))
    out = np.zeros(size, np.int64)
    out[dims[edges]] = np.add.reduceat(values, edges)
    return out


def _products(vectors: DataFrame, low: list[int], bits: list[int]) -> list[list[int]]:
    """Exact sums of products of the shifted values; symmetric.

    Tasks hand on one matrix each, by rows, in two halves of 32 bits that can be
    added without overflow; those of a row meet in one place, and the driver gets the sums.
    """
    size = len(low)

    def planes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, base = BitPlanes(bits), np.array(low, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, BATCH_ROWS):
                found.add(whole_numbers(batch.column(0).slice(at, BATCH_ROWS), size) - base)
                if found.rows >= FLUSH_ROWS:
                    yield from handed_on(found)
        if found.rows:
            yield from handed_on(found)

    def handed_on(found: BitPlanes) -> Iterator[pa.RecordBatch]:
        for limb, total in enumerate(found.totals):
            yield pa.RecordBatch.from_arrays(
                [pa.array([limb] * size, pa.int32()), pa.array(range(size), pa.int32()),
                 pa.array([r.tobytes() for r in total & 0xFFFFFFFF]), pa.array([r.tobytes() for r in total >> 32])],
                ["limb", "d", "lower", "upper"])
        found.clear()

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for limb, d, lower, upper in zip(*(c.to_pylist() for c in batch.columns)):
                row = np.frombuffer(lower + upper, np.int64)
                sums[limb, d] = sums[limb, d] + row if (limb, d) in sums else row
        if sums:
            keys = list(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                 pa.array([sums[k].tolist() for k in keys], pa.list_(pa.int64()))], ["limb", "d", "v"])

    parts = map_partitions(vectors, planes, "limb int, d int, lower binary, upper binary")
    rows = map_partitions(parts.repartition("limb", "d"), added, "limb int, d int, v array<long>").collect()
    out = [[0] * size for _ in range(size)]
    for r in rows:
        for j in range(r.d, size):
            out[r.d][j] += (r.v[j] + (r.v[size + j] << 32)) << (LIMB_BITS * r.limb)
    for i in range(size):
        for j in range(i):
            out[i][j] = out[j][i]
    return out


def fit(df: DataFrame, column: str = "embedding") -> Whitening:
    """Covariance of all usable vectors of ``column`` and its eigenvectors, by falling eigenvalue."""
    vectors = df.select(_vectors(df, column).alias("v")).filter(finite(F.col("v")))
    size = _length(vectors)
    if not size:
        return Whitening(0, [], [], np.zeros((0, 0)), np.zeros(0), 0.0)
    vectors = vectors.filter(F.size("v") == size)
    n, sums, low, high = _statistics(vectors, size)
    products = _products(vectors, low, [int(h - l).bit_length() for l, h in zip(low, high)])
    shifted = [s - n * l for s, l in zip(sums, low)]
    # whole numbers are centred before the only division, which rounds correctly
    covariance = np.array([[(n * products[i][j] - shifted[i] * shifted[j]) / n**2 for j in range(size)] for i in range(size)])
    values, found = np.linalg.eigh(covariance)
    values, found = values[::-1], found[:, ::-1]
    signs = np.sign(found[np.abs(found).argmax(axis=0), np.arange(size)])
    return Whitening(n, sums, low, found * signs, np.maximum(values, 0), float(np.trace(covariance)))


def _deviations(centred: np.ndarray, bound: int) -> pa.Array:
    """Sum of squares of every row; null where it is beyond 64 bits."""
    if centred.shape[1] * bound**2 < 1 << 63:
        return pa.array((centred.astype(np.int64) ** 2).sum(axis=1))
    sums = [sum(int(x) ** 2 for x in row) for row in centred]
    return pa.array([s if s < 1 << 63 else None for s in sums], pa.int64())


def transform(df: DataFrame, model: Whitening, column: str = "embedding", k: int | None = None,
              into: str = "whitened", deviation: str = "deviation") -> DataFrame:
    """The usable rows of ``df`` with their first ``k`` whitened components and their deviation from the mean.

    ``deviation`` is the sum over dimensions of (n x - S)^2. Both names get an
    underscore in front if ``df`` has them already. A component without variance is null.
    """
    size, n = model.dimensions, model.n
    k = min(k or size, size)
    into, deviation, vector = fresh(df, into), fresh(df, deviation), fresh(df, "_vector")
    scales = model.scales(k)
    projection = model.components[:, :k] / np.where(np.isnan(scales), 1, scales)
    low, rest = np.array(model.low, np.int64), [s - n * l for s, l in zip(model.sums, model.low)]

    def worker(batch: pa.RecordBatch) -> pa.RecordBatch:
        shifted = whole_numbers(batch.column(batch.num_columns - 1), size) - low
        bound = n * int(np.abs(shifted).max(initial=0)) + max(map(abs, rest), default=0)
        if bound < 1 << 62:
            centred = n * shifted - np.array(rest, np.int64)
        else:
            centred = n * shifted.astype(object) - np.array(rest, object)
        whitened = (centred / n).astype(float) @ projection
        whitened[:, np.isnan(scales)] = np.nan
        flat = pa.array(whitened.reshape(-1), from_pandas=True)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(whitened) + 1) * k, pa.int32()), flat)
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], lists, _deviations(centred, bound)], [*batch.schema.names[:-1], into, deviation])

    rows = df.withColumn(vector, _vectors(df, column)).filter(
        finite(F.col(vector)) & (F.size(vector) == size) & F.lit(size > 0))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    return map_batches(rows, worker, f"{schema}, `{into}` array<double>, `{deviation}` long")


def identity_error(rows: DataFrame, column: str = "whitened") -> float | None:
    """Largest absolute entry of the covariance of whitened vectors minus the identity; None without any.

    ``rows`` is read twice and should be written out. Components that are null everywhere do not count.
    """
    k = rows.agg(F.max(F.size(column))).first()[0] or 0
    if not k:
        return None
    entries = [F.col(column)[i] for i in range(k)]
    means = rows.agg(*[F.avg(e) for e in entries]).first()
    used = [i for i in range(k) if means[i] is not None]
    pairs = [(i, j) for i in used for j in used if i <= j]
    if not pairs:
        return None
    found = rows.agg(*[F.avg((entries[i] - means[i]) * (entries[j] - means[j])) for i, j in pairs]).first()
    return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs))
