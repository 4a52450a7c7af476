"""Vectors by versions: base, deltas, tombstones, compaction, failures and races."""

import pytest

from pyspark.sql import functions as F

from siltstone.operators import search
from siltstone.sources.versions import ConcurrentChange, Manifest, VectorStore

KIND = "vec_id bigint, embedding array<float>, source string"


def _rows(df):
    return sorted((r.vec_id, tuple(r.embedding), r.source) for r in df.collect())


def test_base_and_deltas_are_the_rebuilt_table(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/s")
    assert store.live() == Manifest()
    with pytest.raises(FileNotFoundError):
        store.read()
    table = {i: (float(i), 1.0) for i in range(20)}
    make = lambda rows: spark.createDataFrame([(i, list(v), f"s{i % 3}") for i, v in rows.items()], KIND)
    store.change(make(table))
    store.compact()
    assert store.live().deltas == [] and _rows(store.read()) == _rows(make(table))
    new = {3: (9.0, 9.0), 50: (5.0, 0.5)}
    store.change(make(new), spark.createDataFrame([(4,), (50,), (77,)], "vec_id bigint"))  # 50 is in both, 77 nowhere
    table = {k: v for k, v in (table | new).items() if k != 4}
    store.change(deletes=spark.createDataFrame([(3,), (5,)], "vec_id bigint"))
    store.change(make({5: (1.0, 2.0)}))  # comes back
    table = {k: v for k, v in table.items() if k != 3} | {5: (1.0, 2.0)}
    assert _rows(store.read()) == _rows(make(table))
    queries = make({1: (1.0, 0.2), 2: (0.1, 1.0)}).select(F.col("vec_id").alias("query_id"), "embedding")
    found = {tuple(r) for r in search.nearest(queries, store.read().select("vec_id", "embedding"), 4).collect()}
    assert found == {tuple(r) for r in search.nearest(queries, make(table).select("vec_id", "embedding"), 4).collect()}
    old = store.live()
    store.compact()
    assert store.live().deltas == [] and _rows(store.read()) == _rows(make(table)) == _rows(store.read(old))
    assert len(store.clean()) == len([old.base, *old.deltas]) + 1 and _rows(store.read()) == _rows(make(table))


def test_a_failed_write_changes_nothing(spark, tmp_path):
    store = VectorStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, [1.0], "a"), (2, [2.0], "b"), (2, [2.0], "b")], KIND)
    store.change(rows)
    before = store.live()
    bad = rows.withColumn("embedding", F.when(F.col("vec_id") == 2, F.raise_error(F.lit("no encoder")).cast("array<float>")).otherwise(F.col("embedding")))
    with pytest.raises(Exception, match="no encoder"):
        store.change(bad)
    assert store.live() == before and _rows(store.read()) == [(1, (1.0,), "a"), (2, (2.0,), "b")]


def test_two_writers_do_not_lose_a_change(spark, tmp_path, monkeypatch):
    store = VectorStore(spark, f"file://{tmp_path}/s")
    rows = spark.createDataFrame([(1, [1.0], "a")], KIND)
    store.change(rows)
    stale = store.live()
    store.change(rows.withColumn("vec_id", F.lit(2).cast("bigint")))
    other = VectorStore(spark, f"file://{tmp_path}/s")
    monkeypatch.setattr(other, "live", lambda: stale)
    with pytest.raises(ConcurrentChange):
        other.change(rows.withColumn("vec_id", F.lit(3).cast("bigint")))
    with pytest.raises(ConcurrentChange):
        other.compact()
    assert [r[0] for r in _rows(store.read())] == [1, 2] and len(store.unused()) == 2
