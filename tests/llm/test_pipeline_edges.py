"""Every stage of the pipeline on tables with nulls, repeated rows, empty and long texts, clashing names, and on empty ones."""

import pytest

from pyspark.sql import functions as F

import corpus_pipeline

KIND = "doc_id bigint, text string, lang string, source string, n_chars bigint, row string, score double"
DATA = "/root/testdata/sf0.001"
CLEAN = "some words about the river and the hills that nobody has written down before in this very order"


@pytest.fixture(scope="module")
def edge_docs(spark):
    rows = [
        (1, CLEAN, "en", "src1", 5, "clash", 0.5), (2, CLEAN, "en", "src1", 5, "clash", 0.5), (2, CLEAN, "en", "src1", 5, "clash", 0.5), (3, None, None, None, None, None, None), (4, "", "en", "src12", 0, "x", 0.1), (5, " \n\t", None, "src19", 3, "x", 0.1),
        (None, "a text without an id, which is a text like any other for all that", "fr", "src2", 4, "x", None), (6, "w " * 40_000 + "end", "en", "src3", 80_003, "x", 0.0), (7, "short", "zz", "elsewhere", 5, "x", 0.0),
    ]
    return spark.createDataFrame(rows, KIND).repartition(3)


def _ids(df):
    return sorted((r.doc_id is None, r.doc_id or 0) for r in df.select("doc_id").collect())


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_edge_cases(spark, edge_docs, at):
    name, stage = corpus_pipeline.STAGES[at]
    out = stage(spark, edge_docs, DATA)
    if at < len(corpus_pipeline.STAGES) - 1:
        assert out.columns == edge_docs.columns and out.dtypes == edge_docs.dtypes
    if name in ("toxicity", "benchmark_decontamination"):
        assert _ids(out) == _ids(edge_docs)  # all of them are clean; nothing is lost, copies included
    if name == "ngram_jaccard_join":
        assert _ids(out) == _ids(edge_docs.where("doc_id is null or doc_id <> 2"))  # one of the copies stays, empty texts all
    if name == "source_mixing":
        assert set(_ids(out)) <= set(_ids(edge_docs))
    if name == "token_id_output":
        assert out.count() == edge_docs.count()
        assert out.agg(F.min("n_tokens")).first()[0] == 1  # an empty text is its end alone


@pytest.mark.parametrize("at", range(len(corpus_pipeline.STAGES)), ids=[name for name, _ in corpus_pipeline.STAGES])
def test_stage_on_an_empty_table(spark, edge_docs, at):
    assert corpus_pipeline.STAGES[at][1](spark, edge_docs.limit(0), DATA).count() == 0
