"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from siltstone.llm.decontaminate import contamination_report
from siltstone.llm.html_wrapper import main_text_report
from siltstone.llm.jaccard import jaccard_report
from siltstone.llm.language import language_report
from siltstone.llm.mixing import mix_report
from siltstone.llm.oracle import SQL as SQL
from siltstone.llm.prefix_trie import trie_report
from siltstone.llm.quality_pu import score_quality
from siltstone.llm.quality_rules import quality_report
from siltstone.llm.scratch import table
from siltstone.llm.suffix_dedup import repeats_report
from siltstone.llm.tokens import read_token_shards, write_token_shards
from siltstone.llm.toxicity import toxicity_report
from siltstone.llm.warc import archive_pages, read_archives
from siltstone.llm.whitening import whitening_report


def op1_count_vector_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_report(table(spark, sf_dir, "documents"))


def op2_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_archives(archive_pages(table(spark, sf_dir, "pages"))).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_wrapper_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text_report(table(spark, sf_dir, "pages"))


def op4_suffix_bucket_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats_report(table(spark, sf_dir, "documents"))


def op5_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_positive_unlabelled_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_wu_manber_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_arrow_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    manifest = write_token_shards(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return read_token_shards(manifest)


def op10_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"))


def op11_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening_report(table(spark, sf_dir, "embeddings"))


def op12_family_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie_report(table(spark, sf_dir, "conversations"))


def op13_naive_bayes_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_report(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_count_vector_join, op2_arc_to_warc, op3_wrapper_main_text, op4_suffix_bucket_dedup, op5_toxicity_chain, op6_risk_controlled_rules, op7_positive_unlabelled_quality, op8_wu_manber_decontamination, op9_arrow_token_shards, op10_source_mixing, op11_lobpcg_whitening, op12_family_prefix_trie, op13_naive_bayes_language)}
