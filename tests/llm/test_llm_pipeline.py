"""The pipeline's stages, each against brute force on its own input."""

import collections
import os
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from siltstone.llm import mixing
from siltstone.llm.scratch import materialize
from siltstone.llm.toxicity import toxicity_report

DATA = "/root/testdata/sf0.001"


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def _near_copies(rows):
    sets = {}
    for r in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", _lower(r.text))
        sets[r.doc_id] = frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])
    group = {d: d for d in sets}
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = min(group[a], group[b]), max(group[a], group[b])
                group = {d: x if g == y else g for d, g in group.items()}
    return {d for d, g in group.items() if d == g}


def _clean(rows, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    patterns = set()
    for (text,) in items:
        w = words(text)
        n = min(10, len(w))
        patterns |= {tuple(w[i : i + n]) for i in range(len(w) - n + 1 if n else 0)}
    sizes = {len(p) for p in patterns}
    out = set()
    for r in rows:
        w = words(r.text)
        if not any(tuple(w[i : i + n]) in patterns for n in sizes for i in range(len(w) - n + 1)):
            out.add(r.doc_id)
    return out


def test_stages(spark):
    duckdb = pytest.importorskip("duckdb")
    public = pytest.importorskip("public_tokenizers")
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    steps = dict(corpus_pipeline.STAGES)
    seen = [docs.collect()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, DATA), name)
        assert docs.columns == spark.read.parquet(f"{DATA}/documents.parquet").columns
        seen.append(docs.collect())
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    toxic = {r.doc_id for r in toxicity_report(spark.read.parquet(f"{DATA}/documents.parquet"), labels).where("toxic").collect()}
    assert {r.doc_id for r in seen[1]} == {r.doc_id for r in seen[0]} - toxic
    assert {r.doc_id for r in seen[2]} == _near_copies(seen[1])
    assert {r.doc_id for r in seen[3]} == _clean(seen[2], duckdb.sql(f"select text from '{DATA}/benchmark.parquet'").fetchall())
    documents = __import__("pyarrow").Table.from_pylist([r.asDict() for r in seen[3]])  # noqa: F841  read by the SQL
    taken = {r[0]: r for r in duckdb.sql(mixing.report_sql()).fetchall()}
    rows = collections.Counter(r.doc_id for r in seen[4])
    assert rows == collections.Counter({d: -(-t[-1] // t[4]) for d, t in taken.items() if t[-1]})
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(public.path("word_bpe_49k.json"))
    ids = [(r.doc_id, [*whole.encode(r.text, add_special_tokens=False).ids, 1]) for r in seen[4]]
    start, expected = 0, []
    for doc_id, own in sorted(ids, key=lambda x: (x[0], np.array(x[1], "<u2").tobytes())):
        expected.append((doc_id, start, len(own), zlib.crc32(np.array(own, "<u4").tobytes())))
        start += len(own)
    got = steps["token_id_output"](spark, docs, DATA)
    assert sorted(tuple(r) for r in got.collect()) == sorted(expected)


def test_run_is_registered():
    import __spark_entry__

    assert "pipeline" in __spark_entry__.queries() and len(corpus_pipeline.STAGES) == 5
    assert all(f"op{n}_" in " ".join(__spark_entry__.queries()) for n in range(1, 14))
