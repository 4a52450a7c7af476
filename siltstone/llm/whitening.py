"""Whitening of embeddings by LOBPCG.

Vectors become whole numbers, y = floor(64 c) (the contract's x is y + 1000000; a shift changes neither
centred rows nor covariance). One pass leaves n and exact sums by dimension; centred rows are
(n y - S) / n, with an exact numerator. The covariance is never formed: each step multiplies it
with a block of vectors, as partial sums of row-block products in the tasks. The step's
block is the residuals and the previous direction; a Rayleigh-Ritz step on iterate,
residuals and direction gives the next iterate. It ends once every residual of the wanted components,
taken from a product of its own, is below TOLERANCE of the largest eigenvalue.

The driver holds blocks of (dimensions x components) numbers, nothing that grows with rows.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from siltstone.llm.rows import ROW, with_row

#: Steps of an entry, components at most, further vectors of the iterate that speed it up.
STEPS, COMPONENTS, GUARD = 64, 32, 8
SHIFT = 1_000_000
#: Entries beyond this size, in steps, count as of this size.
LARGEST = float(2**52)
#: Residual, as part of the largest eigenvalue, that a component must reach; rounds at most.
TOLERANCE, ROUNDS = 1e-12, 500
#: Eigenvalues below this part of the largest are rounding noise: no component.
RANK = 1e-11
#: Rows that are multiplied at once.
TILE = 2048


def whole_numbers(column: pa.Array, dimensions: int) -> np.ndarray:
    """floor(STEPS * c) of vectors without nulls; entries that a vector lacks are 0."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    y = np.clip(np.floor(np.clip(flat, -LARGEST, LARGEST) * STEPS), -LARGEST, LARGEST).astype(np.int64)
    if (sizes == dimensions).all():
        return y.reshape(len(sizes), dimensions)
    out = np.zeros((len(sizes), dimensions), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = y
    return out


@dataclass
class Centre:
    """n, the exact sums of y by dimension, and the largest |y|."""

    n: int
    sums: list[int]
    largest: int

    def exact(self, y: np.ndarray) -> np.ndarray:
        """n y - S, as 64-bit numbers where all fit, else as Python's."""
        if self.n * max(self.largest, 1) < 2**61:
            return self.n * y - np.array(self.sums, dtype=np.int64)
        return y.astype(object) * self.n - np.array(self.sums, dtype=object)

    def rows(self, exact: np.ndarray) -> np.ndarray:
        return (exact / self.n).astype(np.float64)

    @staticmethod
    def deviation(exact: np.ndarray) -> pa.Array:
        """Exact sums of squares; null beyond 64 bits."""
        rough = np.square(exact.astype(np.float64)).sum(axis=1)
        if exact.dtype != object and (not len(rough) or rough.max() < 2**62):
            return pa.array(np.square(exact).sum(axis=1))
        total = np.square(exact.astype(object)).sum(axis=1)
        return pa.array([int(x) if x < 2**63 else None for x in total], pa.int64())


def usable(vectors: DataFrame, embedding: str = "embedding") -> DataFrame:
    """Rows whose vector is there and has finite entries only."""
    v = vectors[f"`{embedding}`"].cast("array<double>")
    odd = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    return vectors.where(v.isNotNull() & ~F.coalesce(F.exists(v, odd), F.lit(True)))


def _tiles(batches, name: str, dimensions: int):
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            yield whole_numbers(batch.column(name).slice(at, TILE), dimensions)


def centre_of(v: DataFrame) -> tuple[int, Centre | None]:
    """Dimensions and centre of (v: array of finite doubles); None without rows or dimensions."""
    dimensions = v.agg(F.max(F.size("v"))).first()[0] or 0
    if not dimensions:
        return 0, None

    def run(batches):
        n, sums, largest = 0, [0] * dimensions, 0
        for y in _tiles(batches, "v", dimensions):
            n, largest = n + len(y), max(largest, int(np.abs(y).max()))
            # high and low halves: sums of 2,048 of them fit in 64 bits
            sums = [a + (int(h) << 26) + int(lo) for a, h, lo in zip(sums, (y >> 26).sum(axis=0), (y & (2**26 - 1)).sum(axis=0), strict=True)]
        if n:
            own = pa.array(sums, pa.decimal128(38, 0))
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dimensions)), own, pa.array(np.full(dimensions, n)), pa.array(np.full(dimensions, largest))], ["i", "s", "n", "largest"])

    got = v.mapInArrow(run, "i bigint, s decimal(38,0), n bigint, largest bigint").groupBy("i").agg(F.sum("s").alias("s"), F.sum("n").alias("n"), F.max("largest").alias("largest")).orderBy("i").collect()
    return dimensions, Centre(got[0].n, [int(r.s) for r in got], got[0].largest)


def block_sums(v: DataFrame, dimensions: int, centre: Centre, work: Callable[[np.ndarray], np.ndarray], shape: tuple[int, int]) -> np.ndarray:
    """The sum of work(centred rows) over all rows: one partial sum a task, then sums by row of the block."""
    names = [f"v{j}" for j in range(shape[1])]

    def run(batches):
        total = None
        for y in _tiles(batches, "v", dimensions):
            own = work(centre.rows(centre.exact(y)))
            total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(shape[0])), *(pa.array(np.ascontiguousarray(total[:, j])) for j in range(shape[1]))], ["i", *names])

    schema = StructType([StructField("i", LongType()), *(StructField(x, DoubleType()) for x in names)])
    got = v.mapInArrow(run, schema).groupBy("i").agg(*[F.sum(x).alias(x) for x in names]).orderBy("i").toArrow()
    return np.stack([got.column(x).to_numpy() for x in names], axis=1)


def _orthonormal(block: np.ndarray, against: np.ndarray) -> np.ndarray:
    """An orthonormal basis of what the block adds to ``against``; directions within rounding of it are left out."""
    norms = np.linalg.norm(block, axis=0)
    block = block[:, norms > 0] / norms[norms > 0]
    for _ in range(2):
        block = block - against @ (against.T @ block)
        left, size, _ = np.linalg.svd(block, full_matrices=False)
        block = left[:, size > 1e-10 * max(1.0, size.max(initial=0.0))]
    q, _ = np.linalg.qr(block - against @ (against.T @ block))
    return q


def lobpcg(product: Callable[[np.ndarray], np.ndarray], dimensions: int, wanted: int, seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues, falling, and their unit vectors (columns) of a symmetric matrix known by its products."""
    width = min(dimensions, wanted + GUARD)
    x, _ = np.linalg.qr(np.random.default_rng(seed).standard_normal((dimensions, width)))
    ax, before = product(x), np.zeros((dimensions, 0))
    for _ in range(ROUNDS):
        values, turn = np.linalg.eigh((x.T @ ax + ax.T @ x) / 2)
        values, turn = values[::-1], turn[:, ::-1]
        x, ax = x @ turn, ax @ turn
        residual = ax - x * values
        bound = TOLERANCE * max(abs(values[0]), np.finfo(float).tiny)
        if (np.linalg.norm(residual, axis=0)[:wanted] <= bound).all():
            ax = product(x)  # the certificate takes a product of its own
            values = (x * ax).sum(axis=0)
            if (np.linalg.norm(ax - x * values, axis=0)[:wanted] <= 2 * bound).all():
                order = np.argsort(-values[:wanted], kind="stable")
                return values[order], x[:, order]
            residual = ax - x * values
        new = _orthonormal(np.concatenate([residual, before], axis=1), x)
        if not new.shape[1]:
            before = np.zeros((dimensions, 0))
            x, _ = np.linalg.qr(x)
            ax = product(x)
            continue
        basis, image = np.concatenate([x, new], axis=1), np.concatenate([ax, product(new)], axis=1)
        _, turn = np.linalg.eigh((basis.T @ image + image.T @ basis) / 2)
        turn = turn[:, ::-1][:, :width]
        before = new @ turn[x.shape[1] :]
        x, ax = basis @ turn, image @ turn
    raise ArithmeticError(f"no certified residuals after {ROUNDS} rounds")


@dataclass
class Whitening:
    """Centre, dimensions, components (columns) with their eigenvalues, trace and the identity error of the fit."""

    dimensions: int
    centre: Centre | None
    vectors: np.ndarray
    values: np.ndarray
    trace: float
    identity_error: float

    def apply(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.centre is None:
            return y, np.zeros((len(y), 0))
        exact = self.centre.exact(y)
        return exact, (self.centre.rows(exact) @ self.vectors) / np.sqrt(self.values)


def fit_whitening(vectors: DataFrame, components: int = COMPONENTS, embedding: str = "embedding") -> Whitening:
    """The whitening of all usable rows of ``vectors``."""
    v = usable(vectors, embedding).select(vectors[f"`{embedding}`"].cast("array<double>").alias("v"))
    dimensions, centre = centre_of(v)
    empty = Whitening(dimensions, centre, np.zeros((dimensions, 0)), np.zeros(0), 0.0, 0.0)
    if centre is None:
        return empty
    n = centre.n

    def product(block: np.ndarray) -> np.ndarray:
        return block_sums(v, dimensions, centre, lambda d: d.T @ (d @ block), block.shape) / n

    trace = float(block_sums(v, dimensions, centre, lambda d: np.square(d).sum(axis=0)[:, None], (dimensions, 1)).sum() / n)
    if trace <= 0:
        return empty
    values, found = lobpcg(product, dimensions, min(components, dimensions))
    real = values > RANK * values[0]
    values, found = values[real], found[:, real]
    white = lambda d: (d @ found) / np.sqrt(values)
    seen = block_sums(v, dimensions, centre, lambda d: white(d).T @ white(d), (len(values), len(values))) / n
    return Whitening(dimensions, centre, found, values, trace, float(np.abs(seen - np.eye(len(values))).max()))


def whiten(vectors: DataFrame, fit: Whitening, embedding: str = "embedding", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns, all by default), ``deviation`` and ``whitened`` (array by component) of each usable row.

    ``deviation`` is the exact sum over dimensions of (n y - S)^2, null beyond 64 bits.
    """
    given = with_row(usable(vectors, embedding), {"v": embedding}, keep)
    given = given.select(ROW, F.col("v").cast("array<double>").alias("v"))
    held = given.sparkSession.sparkContext.broadcast(fit)
    schema = StructType([given.schema[ROW], StructField("deviation", LongType()), StructField("whitened", ArrayType(DoubleType()))])

    def run(batches):
        w = held.value
        for batch in batches:
            for at in range(0, batch.num_rows, TILE):
                part = batch.slice(at, TILE)
                exact, white = w.apply(whole_numbers(part.column("v"), w.dimensions))
                size = white.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (len(white) + 1) * size, size, dtype=np.int32) if size else np.zeros(len(white) + 1, np.int32)), pa.array(white.ravel()))
                yield pa.RecordBatch.from_arrays([part.column(ROW), Centre.deviation(exact), lists], schema.names)

    return given.mapInArrow(run, schema)



def whitening_report(vectors: DataFrame) -> DataFrame:
    """A row for each usable vector and component of the whitening of all of them.

    Rows whose vector is null or holds null or non-finite entries give nothing. Vectors shorter than the
    longest count as if they had zeros there. Components whose eigenvalue is nothing but rounding
    (rank-deficient tables, one vector, vectors that are all equal) do not exist, so such tables give fewer
    rows or none, as an empty table does. Rows that repeat count and are returned as often as they are
    there; vec_id may be null. Other columns are not looked at, whatever their names.
    """
    fit = fit_whitening(vectors)
    white = whiten(vectors, fit, keep=["vec_id"])
    e = fit.values / fit.trace if len(fit.values) else fit.values
    parts = white.select(F.col(f"{ROW}.vec_id").alias("vec_id"), "deviation", F.posexplode("whitened").alias("at", "whitened"))
    explained = F.element_at(F.lit([float(x) for x in e] or [0.0]).cast("array<double>"), F.col("at") + 1)
    n = fit.centre.n if fit.centre else 0
    return parts.select(
        "vec_id", (F.col("at") + 1).cast(IntegerType()).alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened", explained.alias("explained"), F.lit(fit.identity_error).alias("identity_error")
    )
