"""Whitening of embeddings with covariances by polarisation.

Entries become whole numbers.  One pass gives their number and sums; a second one
adds up the squares of the centred values of each dimension and of each sum of two
dimensions.  All of it is whole-number arithmetic, so the totals are exact in
whatever order tasks add them up, and

    2 cov(i, j) = var(i + j) - var(i) - var(j)

needs no product of two dimensions.  The matrix, of the size of the dimensions
only, is assembled on the driver for ``eigh``.
"""
from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from satledger.llm.common import numbered, place, small_batches
from satledger.llm.vectors import common_length, matrix

#: Grid of the entries, and what is added to their whole numbers.
GRID, SHIFT = 1024, 100_000
#: Entries are held to plus or minus this.
LARGEST = 2.0**42
#: Rows that a task squares at a time.
ROWS = 2048
SUMS = "place int, total decimal(38,0)"
DIGITS = pa.decimal128(38, 0)


def whole_numbers(values: np.ndarray, grid: int = GRID, shift: int = SHIFT) -> np.ndarray:
    return np.floor(grid * np.clip(values, -LARGEST, LARGEST)).astype(np.int64) + shift


def pairs(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimensions ``i <= j``, row by row: ``(i, i)`` stands for dimension ``i`` itself."""
    return np.triu_indices(length)


@dataclass
class Whitening:
    """A fitted whitening: number of vectors, sums, eigenvalues and eigenvectors
    (columns, by falling eigenvalue)."""
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    grid: int = GRID
    shift: int = SHIFT

    @property
    def usable(self) -> np.ndarray:
        """Eigenvalues that are not zero but for rounding."""
        return self.values > self.trace * len(self.sums) * np.finfo(float).eps

    def centres(self) -> np.ndarray:
        """The whole numbers next to the means."""
        return np.array([(2 * s + self.n) // (2 * self.n) for s in self.sums], np.int64)

    def scale(self) -> np.ndarray:
        return self.vectors / np.sqrt(np.where(self.usable, self.values, np.nan))

    def apply(self, x: np.ndarray) -> np.ndarray:
        """Whitened rows of whole numbers ``x``; NaN in components without variance."""
        centre = self.centres()
        rest = np.array([(s - self.n * int(c)) / self.n for s, c in zip(self.sums, centre)])
        return ((x - centre) - rest) @ self.scale()

    def deviations(self, x: np.ndarray) -> list[int]:
        """Per row the exact sum over dimensions of ``(n * x - sum) ** 2``."""
        centre = self.centres()
        z, rest = x - centre, [s - self.n * int(c) for s, c in zip(self.sums, centre)]
        peak = (self.n * (int(np.abs(z).max(initial=0)) + 1)) ** 2 * max(1, z.shape[1])
        kind = np.int64 if peak < 2**63 else object
        away = z.astype(kind) * self.n - np.array(rest, kind)
        return (away * away).sum(axis=1).tolist()


def _add_sums(length: int, grid: int, shift: int):
    """Per task the number of vectors (place -1) and the sum of each dimension."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        n, sums = 0, [0] * length
        for batch in batches:
            x = whole_numbers(matrix(batch.column(0), length)[1], grid, shift)
            n += len(x)
            sums = [a + b for a, b in zip(sums, x.sum(axis=0).tolist())]
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(range(-1, length), pa.int32()), pa.array([n, *sums], DIGITS)], ["place", "total"])

    return run


def _squares(z: np.ndarray) -> list[int]:
    """Exact sums over the rows of the squares of ``z[i]`` and ``z[i] + z[j]``, as in :func:`pairs`."""
    if 4 * int(np.abs(z).max(initial=0)) ** 2 * max(1, len(z)) >= 2**63:
        z = z.astype(object)
    out = []
    for i in range(z.shape[1]):
        added = z[:, i:] + z[:, i:i + 1]
        added[:, 0] = z[:, i]
        out.extend((added * added).sum(axis=0).tolist() if z.dtype == object else np.einsum("ri,ri->i", added, added).tolist())
    return out


def _add_squares(length: int, centre: np.ndarray, grid: int, shift: int):
    def run(batches) -> Iterator[pa.RecordBatch]:
        totals = None
        for batch in batches:
            z = whole_numbers(matrix(batch.column(0), length)[1], grid, shift) - centre
            for at in range(0, len(z), ROWS):
                part = _squares(z[at:at + ROWS])
                totals = part if totals is None else [a + b for a, b in zip(totals, part)]
        if totals is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(totals)), pa.int32()), pa.array(totals, DIGITS)], ["place", "total"])

    return run


def _add_products(model, length: int):
    """Per task the sums of the whitened components and of their products."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        w = model.value
        total = None
        for batch in batches:
            x = whole_numbers(matrix(batch.column(0), length)[1], w.grid, w.shift)
            y = np.hstack([np.ones((len(x), 1)), w.apply(x)[:, w.usable]])
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], ["place", "total"])

    return run


def _totals(parts: DataFrame) -> dict[int, int]:
    """Totals by place: as many as there are (pairs of) dimensions."""
    return {r["place"]: r["total"] for r in parts.groupBy("place").agg(F.sum("total").alias("total")).collect()}


def covariance(n: int, sums: list[int], squares: list[int], centre: list[int]) -> np.ndarray:
    """The covariance matrix (divisor ``n``) from the squares around ``centre``: the
    centre is moved to the exact mean first, each entry is rounded once."""
    length = len(sums)
    rest = [s - n * c for s, c in zip(sums, centre)]
    first, second = (p.tolist() for p in pairs(length))
    # n * n * variance of dimension i, and of the sum of dimensions i and j
    spread = {(i, j): n * q - (rest[i] if i == j else rest[i] + rest[j]) ** 2 for i, j, q in zip(first, second, squares)}
    out = np.empty((length, length))
    for (i, j), both in spread.items():
        twice = 2 * both if i == j else both - spread[i, i] - spread[j, j]
        out[i, j] = out[j, i] = twice / (2 * n * n)
    return out


def fitted(rows: DataFrame, length: int, components: int, grid: int = GRID, shift: int = SHIFT) -> Whitening | None:
    """The whitening of the single column of ``rows``, or None without usable vectors."""
    first = _totals(rows.mapInArrow(_add_sums(length, grid, shift), SUMS)) if length else {}
    if not first:
        return None
    n, sums = int(first[-1]), [int(first[i]) for i in range(length)]
    whitening = Whitening(n, sums, np.zeros(0), np.zeros((length, 0)), 0.0, grid, shift)
    centre = whitening.centres()
    second = _totals(rows.mapInArrow(_add_squares(length, centre, grid, shift), SUMS))
    cov = covariance(n, sums, [int(second[i]) for i in range(len(second))], centre.tolist())
    values, vectors = np.linalg.eigh(cov)
    top = np.argsort(-values, kind="stable")[:components]
    whitening.values, whitening.vectors, whitening.trace = values[top], vectors[:, top], float(np.trace(cov))
    return whitening


def identity_error(rows: DataFrame, length: int, whitening: Whitening, model) -> float:
    """The largest absolute entry of the whitened rows' covariance less the identity."""
    k = int(whitening.usable.sum())
    sums = _totals(rows.mapInArrow(_add_products(model, length), "place int, total double"))
    total = np.array([sums[i] for i in range((k + 1) ** 2)]).reshape(k + 1, k + 1)
    mean = total[0, 1:] / whitening.n
    return float(np.abs(total[1:, 1:] / whitening.n - np.outer(mean, mean) - np.eye(k)).max(initial=0.0))


def _whiten(model, length: int, out: pa.Schema):
    def run(batches) -> Iterator[pa.RecordBatch]:
        w = model.value
        for batch in batches:
            good, values = matrix(batch.column(1), length)
            x = whole_numbers(values, w.grid, w.shift)
            y = w.apply(x)
            flat = pa.array(y.ravel(), mask=~np.isfinite(y.ravel()))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), flat)
            away = pa.array([d if d < 10**38 else None for d in w.deviations(x)], DIGITS)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), away, lists.cast(out[2].type)], schema=out)

    return run


def whitened(table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8,
             grid: int = GRID, shift: int = SHIFT) -> DataFrame:
    """One row per usable vector: ``id, deviation, whitened, n, explained, identity_error``.

    ``x = floor(grid * entry) + shift``; ``deviation``: exact sum over dimensions of
    ``(n * x - sum of x) ** 2`` (decimal; null beyond 38 digits); ``whitened`` and
    ``explained``: arrays by component, from the largest eigenvalue on, at most as
    many as dimensions.  A component without variance (equal or few vectors) is null
    in ``whitened``, 0 in ``explained`` where there is no variance at all, and left out of
    ``identity_error``.

    Null vectors and vectors with null or non-finite entries are dropped, as are
    vectors of another length than the commonest (of several the longest); empty
    vectors count as null.  Entries beyond ``LARGEST`` are held to it.  Null ids
    stay; repeated rows count each; ties between eigenvalues leave the choice of
    their vectors open.  An empty table gives no rows.  Other columns, whatever
    their names, are ignored."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = table.sparkSession
    small_batches(spark)
    rows = numbered(table).select(place(table, id_col).alias("id"), place(table, vector_col).cast("array<double>").alias("vector"))
    out = StructType.fromDDL("deviation decimal(38,0), whitened array<double>")
    schema = StructType([rows.schema["id"], *out.fields])
    length = common_length(rows, "vector")
    vectors = rows.select("vector")
    found = fitted(vectors, length, components, grid, shift)
    if found is None:
        empty = spark.createDataFrame([], schema)
        return empty.select("*", F.lit(0).cast("bigint").alias("n"), F.array().cast("array<double>").alias("explained"),
                            F.lit(0.0).alias("identity_error"))
    model = spark.sparkContext.broadcast(found)
    error = identity_error(vectors, length, found, model)
    share = (found.values / found.trace if found.trace > 0 else np.zeros(len(found.values))).tolist()
    made = rows.mapInArrow(_whiten(model, length, to_arrow_schema(schema)), schema)
    return made.select("*", F.lit(found.n).cast("bigint").alias("n"), F.array(*map(F.lit, share)).alias("explained"),
                       F.lit(error).alias("identity_error"))
