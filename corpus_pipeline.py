"""The training-data pipeline: stages over ``documents``, each written and read again.

Stages, in order: documents that the toxicity chain rejects go; of each group of near
copies (5 words, similarity 0.8) one document stays; documents with a benchmark
window go; sources are mixed to target weights; the rest is written as token-ID shards.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.decontaminate import clean_documents
from siltstone.llm.jaccard import distinct_documents
from siltstone.llm.mixing import mixed_documents
from siltstone.llm.scratch import materialize, table
from siltstone.llm.tokens import read_token_shards, write_token_shards
from siltstone.llm.toxicity import civil_documents


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose chance of being toxic is below the threshold (null texts stay)."""
    return civil_documents(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies: that with the smallest doc_id."""
    return distinct_documents(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of ``benchmark``."""
    return clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents at the target weights of domain, language and source; a row for each pass."""
    return mixed_documents(docs)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token-ID shards of the documents; a row per document, read back from the files."""
    import public_tokenizers

    return read_token_shards(write_token_shards(docs, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("source_mixing", mix_sources),
    ("token_id_output", write_tokens),
]

#: Stages one, two and five are beyond SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
