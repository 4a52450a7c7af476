"""Cells of directions: the coarse level of exact and approximate vector search.

Vectors of about one direction form a cell: a centre and the widest angle between it and a
member. From the angle between a query and the centre follows what the best member can score
at most, so whole cells are left out without a look at their vectors. Centres come from
spherical k-means: a start from a bounded sample, then rounds over all rows, each a sum of
unit vectors by cell. At most MAX_CELLS centres are held by the driver and sent to tasks.
"""

from __future__ import annotations

import json
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from siltstone.sources.store import staged

#: Cells at most, bytes of a block of vectors and rows of it at most.
MAX_CELLS, BLOCK_BYTES, BLOCK_ROWS = 4096, 16 << 20, 16_384
#: Rows of the sample that k-means starts from, for each cell, its bytes at most (a row a cell is always taken), and rounds over all rows.
SAMPLE_PER_CELL, SAMPLE_BYTES, ROUNDS = 16, 64 << 20, 4
#: Room for rounding in a bound.
MARGIN = 1e-6
#: Rows that are compared with all centres at once.
TILE = 2048


def unit_rows(column: pa.Array) -> np.ndarray:
    """Vectors without nulls as rows of length 1, in double; vectors of zeros stay."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return unit(flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0))


def unit(rows: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double; rows of zeros stay."""
    out = rows.astype(np.float64)
    norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
    return np.divide(out, norm, out=out.copy(), where=norm > 0)


def block_rows(dimensions: int) -> int:
    return max(1, min(BLOCK_ROWS, BLOCK_BYTES // (8 * max(dimensions, 1))))


def _tiles(batches, name: str):
    for batch in batches:
        for at in range(0, batch.num_rows, TILE):
            part = batch.slice(at, TILE)
            yield part, unit_rows(part.column(name))


def _start(sample: np.ndarray, k: int) -> np.ndarray:
    """First centres: each the farthest of a few random rows from those before it, weighted by distance."""
    rng = np.random.default_rng(17)
    centres = [sample[0]]
    far = 1 - sample @ sample[0]
    while len(centres) < k:
        weight = np.maximum(far, 0) ** 2
        if weight.sum() <= 0:
            break
        centres.append(sample[rng.choice(len(sample), p=weight / weight.sum())])
        far = np.minimum(far, 1 - sample @ centres[-1])
    return np.array(centres)


def fit_centres(rows: DataFrame, k: int, embedding: str = "embedding") -> np.ndarray:
    """Centres of k cells at most (k <= MAX_CELLS), in unit length, of the rows with any direction.

    Only the start is taken from a sample (SAMPLE_PER_CELL rows a cell, those whose hashes are lowest).
    """
    k = min(k, MAX_CELLS)
    v = rows.select(embedding)
    wide = v.agg(F.max(F.size(embedding))).first()[0] or 1
    size = max(k, 2, min(SAMPLE_PER_CELL * k, SAMPLE_BYTES // (8 * max(wide, 1))))
    sample = unit_rows(v.orderBy(F.xxhash64(embedding)).limit(size).toArrow().column(0))
    sample = sample[np.linalg.norm(sample, axis=1) > 0] if len(sample) else sample
    if not len(sample):
        return np.zeros((0, sample.shape[1] if sample.ndim == 2 else 0))
    centres = _start(sample, k)
    names = [f"s{j}" for j in range(centres.shape[1])]
    schema = StructType([StructField("cell", IntegerType()), *(StructField(x, DoubleType()) for x in names)])
    for _ in range(ROUNDS if len(centres) > 1 else 0):

        def sums(batches, centres=centres):
            total = np.zeros(centres.shape)
            for _, u in _tiles(batches, embedding):
                np.add.at(total, np.argmax(u @ centres.T, axis=1), u)
            met = np.flatnonzero((total != 0).any(axis=1))
            yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), *(pa.array(np.ascontiguousarray(total[met, j])) for j in range(centres.shape[1]))], schema.names)

        got = v.mapInArrow(sums, schema).groupBy("cell").agg(*[F.sum(x).alias(x) for x in names]).toArrow()
        moved = np.stack([got.column(x).to_numpy() for x in names], axis=1)
        length = np.linalg.norm(moved, axis=1, keepdims=True)
        centres = centres.copy()
        own = got.column("cell").to_numpy()
        centres[own] = np.where(length > 0, moved / np.maximum(length, 1e-300), centres[own])
    return centres


@dataclass
class Bounds:
    """Of each cell its centre, the smallest cosine of a member with it, and its parts; a last cell without a centre.

    ``rest`` is what a member of the last cell can score at most: 0 for vectors of zeros, 1 if it holds all.
    """

    centres: np.ndarray
    least: np.ndarray
    parts: np.ndarray
    rest: float

    def of(self, u: np.ndarray) -> np.ndarray:
        """For unit vectors (rows): the most that a member of each cell can score; below -1 for cells without members."""
        top = np.full((len(u), len(self.parts)), self.rest)
        if len(self.centres):
            angle = np.arccos(np.clip(u @ self.centres.T, -1, 1)) - np.arccos(np.clip(self.least, -1, 1))
            top[:, :-1] = np.cos(np.maximum(angle, 0))
        top[np.linalg.norm(u, axis=1) == 0] = 0.0  # a query of zeros scores 0 everywhere
        top += MARGIN
        top[:, self.parts == 0] = -2.0
        return top

    def ranks(self, u: np.ndarray) -> np.ndarray:
        """For unit vectors (rows): the place of each cell in the order of its centre's nearness, from 0; empty cells come last."""
        near = np.full((len(u), len(self.parts)), self.rest)
        if len(self.centres):
            near[:, :-1] = u @ self.centres.T
        near[:, self.parts == 0] = -2.0
        out = np.empty(near.shape, dtype=np.int32)
        np.put_along_axis(out, np.argsort(-near, axis=1, kind="stable"), np.arange(near.shape[1], dtype=np.int32)[None, :], axis=1)
        return out


@dataclass
class CellIndex:
    """Vectors with their cells: ``rows`` (id, embedding, cell, part), the cells' bounds, and the rows of a block.

    Vectors of zeros, which have no direction, are in the last cell. A cell of more than a block's rows,
    such as one of many copies, has several parts.
    """

    rows: DataFrame
    bounds: Bounds
    block: int


def index_vectors(vectors: DataFrame, cells: int | None = None, vector_id: str = "vec_id", embedding: str = "embedding") -> CellIndex:
    """An index of every usable vector; by default with as many cells as there are blocks of rows."""
    rows = usable(vectors, vector_id, embedding)
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(embedding)).alias("d")).first()
    block = block_rows(size.d or 1)
    k = min(MAX_CELLS, cells or -(-size.n // block))
    if k <= 1:  # one cell holds all: no centre is needed, and nothing is ever left out
        parts = np.array([-(-size.n // block)])
        placed = rows.withColumns({"cell": F.lit(0), "part": _part(F.lit(int(max(parts[0], 1))))})
        return CellIndex(placed, Bounds(np.zeros((0, size.d or 0)), np.ones(0), parts, 1.0), block)
    centres = fit_centres(rows, k, embedding)
    k = len(centres)
    schema = StructType([*rows.schema.fields, StructField("cell", IntegerType()), StructField("cosine", DoubleType())])

    def assign(batches):
        for part, u in _tiles(batches, embedding):
            near = u @ centres.T if k else np.zeros((len(u), 0))
            cell = np.argmax(near, axis=1) if k else np.zeros(len(u), np.int64)
            cosine = near[np.arange(len(u)), cell] if k else np.zeros(len(u))
            cell = np.where(np.linalg.norm(u, axis=1) > 0, cell, k)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cell.astype(np.int32)), pa.array(cosine)], schema.names)

    placed = staged(rows.mapInArrow(assign, schema), "cells")
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.min("cosine").alias("least")).collect()  # a row a cell
    least, parts = np.ones(k), np.zeros(k + 1, np.int64)
    for r in sizes:
        parts[r.cell] = -(-r.n // block)
        if r.cell < k:
            least[r.cell] = r.least
    many = F.element_at(F.lit([int(max(p, 1)) for p in parts]), F.col("cell") + 1)
    return CellIndex(placed.drop("cosine").withColumn("part", _part(many)), Bounds(centres, least, parts, 0.0), block)


def _part(parts):
    return F.pmod(F.monotonically_increasing_id(), parts.cast("bigint")).cast("int")


def usable(vectors: DataFrame, vector_id: str, embedding: str) -> DataFrame:
    """Ids and vectors that are there and hold no null."""
    return vectors.select(vector_id, embedding).where(F.col(embedding).isNotNull() & ~F.exists(embedding, lambda x: x.isNull()))


def write_index(index: CellIndex, path: str) -> None:
    """The vectors, a folder for each cell, and the cells' table, at ``path``."""
    index.rows.repartition("cell", "part").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/rows")
    spark = index.rows.sparkSession
    b = index.bounds
    about = json.dumps({"centres": b.centres.tolist(), "least": b.least.tolist(), "parts": b.parts.tolist(), "rest": b.rest, "block": index.block})
    spark.createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")


def read_index(spark: SparkSession, path: str) -> CellIndex:
    about = json.loads(spark.read.text(f"{path}/about", wholetext=True).first()[0])
    rows = spark.read.parquet(f"{path}/rows")
    bounds = Bounds(np.array(about["centres"], dtype=np.float64).reshape(len(about["parts"]) - 1, -1), np.array(about["least"]), np.array(about["parts"]), about["rest"])
    return CellIndex(rows.select(*[c for c in rows.columns if c not in ("cell", "part")], "cell", "part"), bounds, about["block"])
