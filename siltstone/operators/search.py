"""Cosine search of a batch of queries: a join of blocks of queries with blocks of vectors."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, FloatType, IntegerType, StructField, StructType

from siltstone.config import SearchConfig
from siltstone.operators.cells import MARGIN, CellIndex, index_vectors, unit, unit_rows, usable
from siltstone.sources.store import staged

#: Queries and vectors that are multiplied at once, pairs that are scored again at once, and blocks of the index's rows that make a block of queries.
TILE, COLUMNS, PAIRS, QUERY_BLOCKS = 1024, 2048, 16_384, 4
#: Bytes of vectors that travel as one row at most (a vector at least).
PACK_BYTES = 1 << 20
#: Members that are searched exactly to find out how many probes are needed.
TUNING = 256
#: Decimal places of a score that is ranked.
DIGITS = 9


class Best:
    """The best k rows of each query that a task has met, ties by id."""

    def __init__(self, queries: pa.Array, k: int):
        self.queries, self.k = queries, k
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, first: int, scores: np.ndarray, ids: np.ndarray, keep: np.ndarray) -> None:
        """Scores of some rows (columns) for the queries from ``first`` on, where ``keep`` holds."""
        if len(ids) > self.k:  # ties with the k-th stay until ids are compared
            scores = np.where(keep, scores, -np.inf)
            keep = keep & (scores >= np.partition(scores, -self.k, axis=1)[:, -self.k, None])
        i, j = np.nonzero(keep)
        parts = [(i, scores[i, j], ids[j])]
        if first in self.held:
            parts.append(self.held[first])
        i, s, v = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((v, -s, i))
        i = i[order]
        front = np.arange(len(i)) - np.searchsorted(i, i) < self.k
        order = order[front]
        self.held[first] = i[front], s[order], v[order]

    def rows(self, names: list[str]):
        for first, (i, s, v) in self.held.items():
            if len(i):
                yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(first + i)), pa.array(v), pa.array(s)], names)


class Nearest:
    """The best k rows of each query that a task has met, ties by id.

    Products are made in single precision. What may reach a query's k-th best score so far, or its floor, by more than their
    error allows to rule out is scored again in double precision; scores that are kept and compared are only of that kind.
    """

    def __init__(self, queries: pa.Array, q: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int, exclude_same: bool):
        self.queries, self.q, self.q32, self.own, self.k, self.exclude_same = queries, q, q.astype(np.float32), own, k, exclude_same
        self.floor = floor.astype(np.float64)
        self.margin = (q.shape[1] + 4) * 2.0**-23  # twice the largest error of a product of unit vectors
        self.by_own = np.argsort(own, kind="stable") if exclude_same else None
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray, np.ndarray]]] = {}

    def add(self, ids: np.ndarray, m: np.ndarray, asks: np.ndarray | None = None) -> None:
        """Unit vectors (rows of m) for the queries that ask for them, all if None."""
        for first in range(0, len(ids), COLUMNS):
            self._columns(ids[first : first + COLUMNS], m[first : first + COLUMNS], asks)

    def _same(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, column) of one id, by query."""
        own = self.own[self.by_own]
        a, b = np.searchsorted(own, ids, "left"), np.searchsorted(own, ids, "right")
        column = np.repeat(np.arange(len(ids)), b - a)
        at = np.arange(len(column)) - np.repeat(np.cumsum(b - a) - (b - a), b - a) + np.repeat(a, b - a)
        query = self.by_own[at]
        order = np.argsort(query, kind="stable")
        return query[order], column[order]

    def _columns(self, ids: np.ndarray, m: np.ndarray, asks: np.ndarray | None) -> None:
        columns = np.ascontiguousarray(m.astype(np.float32).T)
        same = self._same(ids) if self.exclude_same else None
        for first in range(0, len(self.q), TILE):
            tile = slice(first, first + TILE)
            low = self.floor[tile] - self.margin
            if asks is not None:
                if not asks[tile].any():
                    continue
                low = np.where(asks[tile], low, np.inf)
            low = low.astype(np.float32)
            s = self.q32[tile] @ columns
            if same is not None:
                a, b = np.searchsorted(same[0], (first, first + TILE))
                s[same[0][a:b] - first, same[1][a:b]] = np.nan  # reaches nothing
            met = s >= low[:, None]
            at = np.flatnonzero(met)
            if len(at) > 4 * self.k * len(s) and s.shape[1] > self.k:  # only those that may be among the best k of these columns
                kth = np.partition(np.where(np.isnan(s), -np.inf, s), -self.k, axis=1)[:, -self.k]
                at = np.flatnonzero(s >= np.maximum(low, kth - np.float32(2 * self.margin))[:, None])
            if not len(at):
                continue
            i, j = np.divmod(at, s.shape[1])
            scores = np.concatenate([np.einsum("ij,ij->i", self.q[first + i[p : p + PAIRS]], m[j[p : p + PAIRS]]) for p in range(0, len(at), PAIRS)])
            scores = np.round(scores, DIGITS) + 0.0
            keep = scores >= self.floor[first + i]
            parts = self.held.setdefault(first, [])
            parts.append((i[keep], scores[keep], ids[j[keep]]))
            if sum(len(part[0]) for part in parts[1:]) > len(s):
                self._settle(first)

    def _settle(self, first: int) -> None:
        """Keep the best k of a tile's queries; what is below a query's k-th is not looked at any more."""
        i, s, v = (np.concatenate(c) for c in zip(*self.held[first], strict=True))
        order = np.lexsort((v, -s, i))
        i = i[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        front, last = place < self.k, place == self.k - 1
        i, order = i[front], order[front]
        s, v = s[order], v[order]
        self.held[first] = [(i, s, v)]
        last = last[front]
        self.floor[first + i[last]] = np.maximum(self.floor[first + i[last]], s[last])

    def rows(self, names: list[str]):
        for first in list(self.held):
            self._settle(first)
            i, s, v = self.held[first][0]
            if len(i):
                yield pa.RecordBatch.from_arrays([self.queries.take(pa.array(first + i)), pa.array(v), pa.array(s)], names)


def ranked(found: DataFrame, k: int) -> DataFrame:
    """The best k of each query (query, id, score) from what tasks have kept."""
    query, own, _ = found.columns
    order = Window.partitionBy(query).orderBy(F.desc("score"), own)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def first_results(home: DataFrame, index: CellIndex, k: int, exclude_same: bool) -> DataFrame:
    """(query, id, score): the best k of each query in one part of one cell (query id, embedding, cell, part).

    A task holds a block of queries and a block of vectors.
    """
    query_id, embedding = home.columns[:2]
    vector_id, own_embedding = index.rows.columns[:2]
    schema = StructType([home.schema[query_id], index.rows.schema[vector_id], StructField("score", DoubleType())])
    shape = to_arrow_schema(schema)
    runs = home.groupBy("cell", "part").agg(F.ceil(F.count(F.lit(1)) / index.block).cast("bigint").alias("runs"))
    asked = home.withColumn("uid", F.monotonically_increasing_id()).join(runs, ["cell", "part"]).withColumn("run", F.pmod("uid", "runs")).select("cell", "part", "run", query_id, embedding)
    held = index.rows.join(runs, ["cell", "part"]).withColumn("run", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("runs") - 1)))
    held = held.select("cell", "part", "run", F.col(vector_id).alias("_id"), F.col(own_embedding).alias("_v"))

    def run(queries: pa.Table, vectors: pa.Table) -> pa.Table:
        if not queries.num_rows or not vectors.num_rows:
            return shape.empty_table()
        ids = queries.column(query_id).combine_chunks()
        best = Nearest(ids, unit_rows(queries.column(embedding)), ids.to_numpy(zero_copy_only=False), np.full(len(ids), -np.inf), k, exclude_same)
        best.add(vectors.column("_id").to_numpy().astype(np.int64), unit_rows(vectors.column("_v")))
        return pa.Table.from_batches(list(best.rows(schema.names)), shape) if best.held else shape.empty_table()

    keys = ("cell", "part", "run")
    return asked.groupBy(*keys).cogroup(held.groupBy(*keys)).applyInArrow(run, schema)


def packed(index: CellIndex) -> DataFrame:
    """(cell, ids, block): the index's vectors as rows of many, each of one cell, in the precision that they have."""
    vector_id, embedding = index.rows.columns[:2]
    rows = index.rows.select("cell", F.col(vector_id).cast("bigint").alias("_id"), F.col(embedding).alias("_v"))
    single = rows.schema["_v"].dataType.elementType == FloatType()
    schema = StructType([StructField("cell", IntegerType()), StructField("ids", BinaryType()), StructField("block", BinaryType())])

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            order = np.argsort(batch.column("cell").to_numpy(), kind="stable")
            batch = batch.take(pa.array(order))
            cell, ids = batch.column("cell").to_numpy(), batch.column("_id").to_numpy()
            flat = batch.column("_v").flatten().to_numpy(zero_copy_only=False).astype(np.float32 if single else np.float64).reshape(len(ids), -1)
            most = max(1, PACK_BYTES // max(flat.itemsize * flat.shape[1], 1))
            edges = [0, *(np.flatnonzero(cell[1:] != cell[:-1]) + 1).tolist(), len(cell)]
            cuts = [(a, min(a + most, e)) for s, e in zip(edges[:-1], edges[1:], strict=True) for a in range(s, e, most)]
            yield pa.RecordBatch.from_arrays([pa.array([int(cell[a]) for a, _ in cuts], pa.int32()), pa.array([ids[a:b].tobytes() for a, b in cuts], pa.binary()), pa.array([flat[a:b].tobytes() for a, b in cuts], pa.binary())], schema.names)

    return rows.mapInArrow(run, schema)


def streamed_blocks(asked: DataFrame, index: CellIndex, k: int, exclude_same: bool) -> DataFrame:
    """(query, id, score): of each task its best k for each query at or above the query's floor.

    ``asked``: query id, embedding, floor, cells (those wanted, all if null). A task holds a block of queries; the
    vectors of its share, packed and by cells, stream past it, so it keeps k rows a query however many vectors come. There
    are as many shares as keep all cores busy; with more blocks of queries there are fewer, so results stay in proportion to the queries.
    """
    spark = asked.sparkSession
    query_id, embedding = asked.columns[:2]
    vector_id, own_embedding = index.rows.columns[:2]
    schema = StructType([asked.schema[query_id], index.rows.schema[vector_id], StructField("score", DoubleType())])
    dtype = np.float32 if index.rows.schema[own_embedding].dataType.elementType == FloatType() else np.float64
    cores = spark.sparkContext.defaultParallelism
    count = asked.count()
    runs = max(1, -(-count // index.block) if count <= QUERY_BLOCKS * index.block else -(-count // (QUERY_BLOCKS * index.block)))
    shares = max(1, min(-(-2 * cores // runs), int(index.bounds.parts.sum()) * 2))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    deal = lambda n: F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")
    none = lambda kind: F.lit(None).cast(kind)
    left = asked.withColumn("_run", deal(runs)).withColumn("_share", each(shares)).select(
        "_share", "_run", F.lit(-1).alias("_cell"), F.col(query_id).alias("_q"), F.col(embedding).cast("array<double>").alias("_v"), F.col("floor").alias("_floor"), F.col("cells").alias("_cells"), none("binary").alias("_ids"), none("binary").alias("_block")
    )
    right = packed(index).withColumn("_share", deal(shares)).withColumn("_run", each(runs)).select(
        "_share", "_run", F.col("cell").alias("_cell"), none(asked.schema[query_id].dataType).alias("_q"), none("array<double>").alias("_v"), none("double").alias("_floor"), none("array<int>").alias("_cells"), F.col("ids").alias("_ids"), F.col("block").alias("_block")
    )
    rows = left.union(right).repartition(runs * shares, "_share", "_run").sortWithinPartitions("_share", "_run", "_cell", F.get("_cells", F.lit(0)))
    kind = to_arrow_schema(schema)

    def run(batches):
        key, parts, best, wanted, at, asks = None, [], None, None, None, None

        def given():
            block = pa.Table.from_batches(parts).combine_chunks()
            ids, cells = block.column("_q").combine_chunks(), block.column("_cells").combine_chunks()
            every = cells.is_null().to_numpy(zero_copy_only=False)
            held = Nearest(ids, unit_rows(block.column("_v")), ids.to_numpy(zero_copy_only=False), block.column("_floor").to_numpy(), k, exclude_same)
            return held, None if every.all() else (every, cells.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(ids)), cells.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)))

        def results():
            for b in best.rows(schema.names) if best else ():
                yield pa.RecordBatch.from_arrays([x.cast(f.type) for x, f in zip(b.columns, kind, strict=True)], schema.names)

        for batch in batches:
            share, run_, cell = (batch.column(c).to_numpy() for c in ("_share", "_run", "_cell"))
            edges = np.flatnonzero((share[1:] != share[:-1]) | (run_[1:] != run_[:-1]) | (cell[1:] != cell[:-1])) + 1
            for s, e in zip([0, *edges.tolist()], [*edges.tolist(), len(share)], strict=True):
                if s == e:
                    continue
                if (share[s], run_[s]) != key:
                    yield from results()
                    key, parts, best, at = (share[s], run_[s]), [], None, None
                part = batch.slice(s, e - s)
                if cell[s] < 0:
                    parts.append(part.select(["_q", "_v", "_floor", "_cells"]))
                    continue
                if best is None:
                    if not parts:
                        continue
                    best, wanted = given()
                    parts = []
                if cell[s] != at:
                    at, asks = cell[s], None
                    if wanted is not None:
                        asks = wanted[0].copy()
                        asks[wanted[2][wanted[1] == at]] = True
                if asks is None or asks.any():
                    for packed_ids, block in zip(part.column("_ids"), part.column("_block"), strict=True):
                        ids = np.frombuffer(packed_ids.as_buffer(), np.int64)
                        best.add(ids, unit(np.frombuffer(block.as_buffer(), dtype).reshape(len(ids), -1)), asks)
        yield from results()

    return rows.mapInArrow(run, schema)


def search_index(
    queries: DataFrame, index: CellIndex, k: int, threshold: float | None = None, query_id: str = "query_id", embedding: str = "embedding",
    exclude_same: bool = False, probes: int | None = None,
) -> DataFrame:
    """(query id, vector id, score, rank): the best k of each query over an index, ties by id.

    Each query first meets one part of the cell that may score highest. What its k-th result there scores, or the
    threshold, is held against the bounds of all cells; those that cannot reach it are left out, and only rows that
    reach it come out of a task. Without ``probes`` that is exact; with it, only that many cells, those with the nearest centres, are looked at.
    """
    asked = usable(queries, query_id, embedding)
    parts = index.bounds.parts
    least = -1.0 - MARGIN if threshold is None else float(threshold)
    if len(parts) == 1:
        return ranked(streamed_blocks(asked.withColumns({"floor": F.lit(least), "cells": F.lit(None).cast("array<int>")}), index, k, exclude_same), k)
    held = queries.sparkSession.sparkContext.broadcast(index.bounds)  # MAX_CELLS centres at most
    first_schema = StructType([*asked.schema.fields, StructField("cell", IntegerType()), StructField("part", IntegerType())])

    def tops_of(u: np.ndarray) -> np.ndarray:
        tops = held.value.of(u)
        if probes is not None:
            tops[held.value.ranks(u) >= max(probes, 1)] = -2.0
        return tops

    def first(batches):
        count = 0
        for batch in batches:
            if batch.num_rows:
                home = np.argmax(tops_of(unit_rows(batch.column(embedding))), axis=1)
                part = (count + np.arange(len(home))) % np.maximum(parts[home], 1)
                count += len(home)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(home.astype(np.int32)), pa.array(part.astype(np.int32))], first_schema.names)

    home = staged(asked.mapInArrow(first, first_schema), "asked")
    found = first_results(home, index, k, exclude_same)
    reached = found.groupBy(query_id).agg(F.sort_array(F.collect_list("score"), False).alias("s")).select(query_id, F.get("s", F.lit(k - 1)).alias("reached"))  # k scores a query
    last_schema = StructType([*asked.schema.fields, StructField("floor", DoubleType()), StructField("cells", ArrayType(IntegerType()))])

    def wanted(batches):
        for batch in batches:
            if batch.num_rows:
                tops = tops_of(unit_rows(batch.column(embedding)))
                floor = batch.column("floor").to_numpy()
                cells = [np.flatnonzero(t >= f).astype(np.int32) for t, f in zip(tops, floor, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(query_id), batch.column(embedding), batch.column("floor"), pa.array(cells, pa.list_(pa.int32()))], last_schema.names)

    floors = home.join(reached, query_id, "left").select(query_id, embedding, F.greatest(F.lit(least), "reached").alias("floor"))
    return ranked(streamed_blocks(staged(floors.mapInArrow(wanted, last_schema), "wanted"), index, k, exclude_same), k)


def nearest(
    queries: DataFrame, vectors: DataFrame, k: int, threshold: float | None = None, query_id: str = "query_id", vector_id: str = "vec_id",
    embedding: str = "embedding", exclude_same: bool = False,
) -> DataFrame:
    """(query_id, vector_id, score, rank): the exact best k of each query, ties by id; vector ids are integers.

    Scores are rounded, so that ranks do not hang on the order of sums; one below the threshold is
    dropped before ranking, which gives the same rows as after it. Null vectors, and vectors with a
    null in them, match nothing; empty tables give no rows. Query ids are taken to be unique.
    """
    return search_index(queries, index_vectors(vectors, None, vector_id, embedding), k, threshold, query_id, embedding, exclude_same)


def probes_for(index: CellIndex, k: int, target: float = 0.95, sample: int = TUNING) -> int:
    """The smallest number of probes with which ``target`` of the exact results of some members are found.

    Members with the lowest hashes, ``sample`` of them, are searched exactly; a result is found with so many
    probes as its cell's place in the order of the query's cells says. Every row is indexed all the same.
    """
    vector_id, embedding = index.rows.columns[:2]
    query_id = "_query"
    asked = staged(index.rows.orderBy(F.xxhash64(embedding), vector_id).limit(sample).select(F.col(vector_id).alias(query_id), embedding), "tuning")
    hits = search_index(asked, index, k, None, query_id, embedding, exclude_same=True).select(query_id, vector_id)
    cells = hits.join(index.rows.select(vector_id, "cell"), vector_id).join(asked, query_id).select(embedding, "cell")
    held = index.rows.sparkSession.sparkContext.broadcast(index.bounds)

    def places(batches):
        for batch in batches:
            if batch.num_rows:
                rank = held.value.ranks(unit_rows(batch.column(embedding)))[np.arange(batch.num_rows), batch.column("cell").to_numpy()]
                yield pa.RecordBatch.from_arrays([pa.array(rank)], ["place"])

    counts = cells.mapInArrow(places, "place int").groupBy("place").count().orderBy("place").collect()  # a row a cell at most
    need, seen = target * sum(r["count"] for r in counts), 0
    for r in counts:
        seen += r["count"]
        if seen >= need:
            return r.place + 1
    return 1


def recall(exact: DataFrame, found: DataFrame, query_id: str = "query_id", vector_id: str = "vec_id") -> DataFrame:
    """One row: queries, and the share of the exact results that were found (1 if there are none)."""
    both = exact.join(found.select(query_id, vector_id, F.lit(1).alias("hit")), [query_id, vector_id], "left")
    return both.agg(F.count_distinct(query_id).alias("queries"), F.coalesce(F.avg(F.coalesce("hit", F.lit(0))), F.lit(1.0)).alias("recall"))


def search(queries: DataFrame, vectors: DataFrame, chunks: DataFrame, config: SearchConfig = SearchConfig(), **names) -> DataFrame:
    """Hits with their chunk's columns; a vector without a chunk gives no hit, and ranks close up."""
    vector_id = names.get("vector_id", "vec_id")
    query_id = names.get("query_id", "query_id")
    hits = nearest(queries, vectors, config.top_k, config.threshold, **names).drop("rank").join(chunks, vector_id)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), vector_id)
    return hits.withColumn("rank", F.row_number().over(order))
