"""Block-joined vector search, exact and by an index, against brute force."""

import numpy as np
import pyarrow as pa
import pytest

from siltstone.operators import cells, search
from siltstone.plans.queries import QUERIES


def _unit(x):
    x = np.array(x, dtype=np.float64)
    n = np.sqrt((x * x).sum())
    return x / n if n > 0 else x


def _plain(queries, vectors, k, threshold, same):
    out = set()
    for qid, q in queries:
        scored = sorted((-round(float(_unit(q) @ _unit(v)), 9) + 0.0, vid) for vid, v in vectors if not (same and qid == vid))
        scored = [x for x in scored if threshold is None or -x[0] >= threshold][:k]
        out |= {(qid, vid, i + 1) for i, (_, vid) in enumerate(scored)}
    return out


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(1)
    base = rng.standard_normal((12, 8))
    single = lambda v: [float(np.float32(x)) for x in v]
    vectors = [(i, single(base[i % 12] + 0.15 * rng.standard_normal(8))) for i in range(500)]
    vectors += [(1000 + i, single(base[0])) for i in range(250)]  # a hot group of copies
    vectors += [(2000 + i, [0.0] * 8) for i in range(15)]
    queries = [*vectors[::37], (5000, [0.0] * 8), (5001, [1.0] * 8)]
    v = spark.createDataFrame([*vectors, (9000, None), (9001, [None] + [1.0] * 7)], "vec_id bigint, embedding array<float>").repartition(3)
    q = spark.createDataFrame([*queries, (9002, None)], "query_id bigint, embedding array<float>")
    return vectors, queries, v, q


@pytest.mark.parametrize("rows", [16_384, 100, 9])
def test_search_is_exact_whatever_the_blocks(tables, monkeypatch, rows):
    vectors, queries, v, q = tables
    monkeypatch.setattr(cells, "BLOCK_ROWS", rows)
    index = cells.index_vectors(v)
    assert (rows > len(vectors)) == (len(index.bounds.parts) == 1)
    for k, threshold, same in ((5, None, True), (3, 0.9, False)):
        got = {(r.query_id, r.vec_id, r["rank"]) for r in search.search_index(q, index, k, threshold, exclude_same=same).collect()}
        assert got == _plain(queries, vectors, k, threshold, same)


def test_bounds_hold_for_every_member(tables):
    vectors, queries, v, _ = tables
    index = cells.index_vectors(v, 20)
    members = index.rows.collect()
    u = np.array([_unit(q) for _, q in queries])
    top = index.bounds.of(u)
    for r in members:
        assert (u @ _unit(r.embedding) <= top[:, r.cell]).all()
    assert sorted(r.vec_id for r in members) == sorted(i for i, _ in vectors)  # every usable row is indexed
    ranks = index.bounds.ranks(u)
    assert (np.sort(ranks, axis=1) == np.arange(ranks.shape[1])).all()


def test_index_on_disk_and_probes(spark, tables, tmp_path):
    vectors, _, v, q = tables
    q = q.where("query_id < 500")
    index = cells.index_vectors(v, 20)
    cells.write_index(index, f"file://{tmp_path}/index")
    read = cells.read_index(spark, f"file://{tmp_path}/index")
    exact = search.search_index(q, read, 5, exclude_same=True)
    assert {tuple(r) for r in exact.collect()} == {tuple(r) for r in search.nearest(q, v, 5, exclude_same=True).collect()}
    probes = search.probes_for(index, 5, 0.95, 100)
    assert 1 <= probes < len(index.bounds.parts)
    row = search.recall(exact, search.search_index(q, read, 5, exclude_same=True, probes=probes)).first()
    assert row.queries == q.count() and row.recall >= 0.9
    assert search.recall(exact.limit(0), exact).first().recall == 1.0
    one = search.search_index(q, read, 5, exclude_same=True, probes=1)
    assert 0 < one.count() <= exact.count()


def test_empty_and_all_null_tables(spark, tables):
    _, _, v, q = tables
    none = spark.createDataFrame([(1, None), (2, None)], "vec_id bigint, embedding array<float>")
    for cells_wanted in (None, 4):
        for left, right in ((q, v.limit(0)), (q.limit(0), v), (q, none), (none.withColumnRenamed("vec_id", "query_id"), v)):
            assert search.search_index(left, cells.index_vectors(right, cells_wanted), 3).count() == 0


def test_vectors_of_zeros_alone(spark):
    v = spark.createDataFrame([(i, [0.0, 0.0]) for i in range(6)], "vec_id bigint, embedding array<float>")
    got = search.search_index(v.withColumnRenamed("vec_id", "query_id"), cells.index_vectors(v, 3), 2, exclude_same=True)
    assert {(r.query_id, r.vec_id) for r in got.collect()} == {(i, j) for i in range(6) for j in [x for x in range(6) if x != i][:2]}


def test_single_precision_loses_nothing():
    """Ties, near ties, copies, zeros, numbers that are none, own ids and floors, against all products in double precision."""
    rng = np.random.default_rng(4)
    m = rng.normal(size=(5000, 7))
    m[1000:2500] = m[0] + rng.normal(size=(1500, 7)) * 1e-6  # closer than single precision tells apart
    m[2500:2600], m[2600], m[2700] = m[3], 0, np.nan
    ids = rng.permutation(5000).astype(np.int64)
    u = search.unit(m)
    asked = np.concatenate([np.arange(0, 1200), [2600, 2700, 2550]])
    floor = np.where(np.arange(len(asked)) % 3 == 0, 0.9, -np.inf)
    best = search.Nearest(pa.array(ids[asked]), u[asked], ids[asked], floor, 5, True)
    for a, b in ((0, 3), (3, 2500), (2500, 5000)):
        best.add(ids[a:b], u[a:b])
    got = {}
    for batch in best.rows(["q", "v", "s"]):
        for q, v, s in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            got.setdefault(q, []).append((-s, v))
    scores = np.round(u[asked] @ u.T, search.DIGITS) + 0.0
    for row, q, low in zip(scores, ids[asked].tolist(), floor, strict=True):
        want = sorted((-s, v) for s, v in zip(row.tolist(), ids.tolist(), strict=True) if v != q and s >= low)[:5]
        assert [v for _, v in got.get(q, [])] == [v for _, v in want]


def test_two_thresholds_take_one_search(spark, monkeypatch):
    searches = []
    once = search.search_index
    monkeypatch.setattr(search, "search_index", lambda *a, **k: searches.append(1) or once(*a, **k))
    QUERIES["q11_topk_threshold"](spark, "/root/testdata/sf0.001")
    assert len(searches) == 1
