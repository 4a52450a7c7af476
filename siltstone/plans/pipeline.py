"""The batch pipeline: fetch, transform, chunk and load, each step tracked and written once."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import replace as replace_settings

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.config import Config, SearchConfig
from siltstone.operators import chunk, load, transform, vectors
from siltstone.operators.answer import ask
from siltstone.operators.evaluate import judge
from siltstone.operators.ledger import previous_metric, read_ledger, report_lines, tracked
from siltstone.operators.search import search
from siltstone.sources.pages import fetch_pages, http_get, read_html_folder, source_table
from siltstone.sources.store import append, read_json, replace, staged, upsert_sources

log = logging.getLogger("siltstone.pipeline")


def run_extract(spark: SparkSession, config: Config, root: str, get: Callable[[str], str] = http_get) -> None:
    with tracked(spark, f"{root}/ledger", "extract") as t:
        seen = Observation()
        fetched = fetch_pages(source_table(spark, config), get).observe(seen, F.count(F.lit(1)).alias("n"), F.count_if(F.col("error").isNotNull()).alias("bad"))
        # a source that could not be fetched keeps its last page; the failed rows are only counted
        fetched = fetched.where(F.col("error").isNull()).drop("error")
        upsert_sources(fetched, f"{root}/raw")
        n, bad = seen.get["n"], seen.get["bad"]
        t.counted(n, n - bad, bad)
        t.metrics["fetch_failures"] = bad


#: Folders of files that a step's table can be filled from: kind, table, reader.
IMPORTS = {
    "html": ("raw", read_html_folder),
    "processed": ("documents", lambda spark, path: with_source(read_json(spark, path, schemas.PROCESSED))),
    "chunked": ("chunked", lambda spark, path: read_json(spark, path, schemas.CHUNKED).fillna("unknown", ["purpose"])),
}


def with_source(processed: DataFrame) -> DataFrame:
    """Processed documents with their source as a column; those without a source or text are left out."""
    return processed.withColumn("source", F.col("metadata.source")).where("source is not null and text is not null")


def run_import(spark: SparkSession, root: str, kind: str, path: str) -> None:
    """Files of a folder (*.html, or *.json of processed or chunked documents) in place of what their sources had."""
    table, read = IMPORTS[kind]
    with tracked(spark, f"{root}/ledger", f"import_{kind}") as t:
        seen = Observation()
        rows = read(spark, path).where("source is not null").observe(seen, F.count(F.lit(1)).alias("n"))
        upsert_sources(rows, f"{root}/{table}")
        t.counted(seen.get["n"], seen.get["n"], 0)


def run_export(spark: SparkSession, root: str, kind: str, path: str) -> None:
    """A table of documents as JSON, a line each: what ``run_import`` reads."""
    table = IMPORTS[kind][0]
    rows = spark.read.parquet(f"{root}/{table}")
    rows = rows.select("text", "metadata") if kind == "processed" else rows
    rows.select(F.to_json(F.struct(*rows.columns), {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}).alias("value")).write.mode("overwrite").text(path)


def run_transform(spark: SparkSession, config: Config, root: str, strict: bool = False) -> None:
    with tracked(spark, f"{root}/ledger", "transform") as t:
        pages = spark.read.parquet(f"{root}/raw")
        seen = Observation()
        docs = transform.to_documents(pages, transform.source_purposes(source_table(spark, config)), config.transform, strict, seen)
        upsert_sources(docs.withColumn("source", F.col("metadata.source")), f"{root}/documents")
        t.counted(seen.get["items_in"], seen.get["items_out"], seen.get["items_skipped"])
        t.metrics["empty_files"] = seen.get["empty_files"]


def run_chunk(spark: SparkSession, config: Config, root: str) -> None:
    before = previous_metric(spark, f"{root}/ledger", "chunk", "avg_chunk_length")
    with tracked(spark, f"{root}/ledger", "chunk") as t:
        docs = spark.read.parquet(f"{root}/documents").select("text", "metadata")
        upsert_sources(chunk.chunk_payload(docs, config.chunk), f"{root}/chunked")
        s = chunk.chunk_statistics(spark.read.parquet(f"{root}/chunked")).first()
        n = spark.read.parquet(f"{root}/documents").count()  # from the files' footers
        t.counted(n, s["total_chunks"], n - s["documents"])
        t.metrics["empty_files"] = n - s["documents"]
        if s["total_chunks"]:
            t.metrics["avg_chunk_length"] = round(s["avg_chunk_length"], 1)
            t.metrics["min_chunk_length"] = s["min_chunk_length"]
            t.metrics["max_chunk_length"] = s["max_chunk_length"]
            if before:
                off = abs(s["avg_chunk_length"] - before) / before * 100
                t.metrics["chunk_size_drift_pct"] = round(off, 1)
                if off > config.chunk.drift_threshold_pct:
                    log.warning("the mean chunk length moved by %.1f %%: %.1f now, %.1f before", off, s["avg_chunk_length"], before)


def run_load(spark: SparkSession, config: Config, root: str, make_encoder: Callable[[], vectors.Encoder] | None = None) -> None:
    with tracked(spark, f"{root}/ledger", "load") as t:
        found = spark.read.parquet(f"{root}/chunked")
        documents = load.numbered(found, ["source", "raw_filename"])
        replace(load.document_table(documents), f"{root}/document_table")
        replace(load.chunks_of(documents, "source", "purpose"), f"{root}/chunks")
        chunks = spark.read.parquet(f"{root}/chunks")
        encoder = make_encoder or (lambda: vectors.hashing_encoder(config.embed.dimension))
        embedded = vectors.embed(chunks.select("chunk_id", F.col("doc_no").alias("doc_id"), "chunk_index", "source", "purpose", "text"), encoder, config.embed)
        seen = Observation()
        counts = (F.count(F.lit(1)).alias("n"), F.count_if(~F.col("embedding_ok")).alias("bad"), F.count_if(transform.is_blank(F.col("text"))).alias("empty"))
        replace(embedded.observe(seen, *counts).drop("text"), f"{root}/vectors")
        n, bad = seen.get["n"], seen.get["bad"]
        loaded = spark.read.parquet(f"{root}/document_table").count()
        t.counted(found.count(), n, bad)
        for name, value in (("documents", loaded), ("empty_chunks", seen.get["empty"]), ("embedding_failures", bad), ("total_chunks_embedded", n - bad)):
            t.metrics[name] = value


def run_pipeline(spark: SparkSession, config: Config, root: str, get: Callable[[str], str] = http_get, make_encoder=None) -> list[str]:
    """All steps; the first that fails ends the run. Returns the lines of the report."""
    run_extract(spark, config, root, get)
    run_transform(spark, config, root)
    run_chunk(spark, config, root)
    run_load(spark, config, root, make_encoder)
    return report_lines(*read_ledger(spark, f"{root}/ledger"))


def search_questions(spark: SparkSession, questions: DataFrame, root: str, config: Config, make_encoder=None) -> DataFrame:
    """Hits of (query_id, query) over a loaded corpus."""
    encoder = make_encoder or (lambda: vectors.hashing_encoder(config.embed.dimension))
    queries = vectors.embed(questions.select("query_id", "query"), encoder, config.embed, "query").select("query_id", "query", "embedding")
    stored = spark.read.parquet(f"{root}/vectors").select("chunk_id", "embedding")
    chunks = spark.read.parquet(f"{root}/chunks").select("chunk_id", "source", "chunk_index", "text")
    return search(queries, stored, chunks, config.search, vector_id="chunk_id")


def answer_questions(spark: SparkSession, questions: DataFrame, root: str, config: Config, make_generator, make_encoder=None) -> DataFrame:
    """Answers for (query_id, query) over a loaded corpus."""
    return ask(questions, search_questions(spark, questions, root, config, make_encoder), make_generator, config.generate)


def ask_and_log(spark: SparkSession, questions: DataFrame, root: str, config: Config, make_generator, make_encoder=None) -> DataFrame:
    """The answers, generated once, and their rows appended to the table of query metrics; if that fails, the answers stand."""
    answers = staged(answer_questions(spark, questions, root, config, make_generator, make_encoder), "answers")
    try:
        append(query_metrics(answers), f"{root}/query_metrics")
    except Exception:
        log.exception("query metrics were not written")
    return answers


def evaluate_questions(spark: SparkSession, labels: DataFrame, root: str, config: Config, make_encoder=None) -> DataFrame:
    """``labels`` (query, expected_source, expected_text_fragment) judged over a loaded corpus, without a score threshold."""
    asked = staged(labels.withColumn("query_id", F.monotonically_increasing_id()).fillna("", ["expected_text_fragment"]), "evaluation")
    hits = search_questions(spark, asked, root, replace_settings(config, search=SearchConfig(config.search.top_k, -1.0)), make_encoder)
    return judge(asked, hits)


def query_metrics(answers: DataFrame) -> DataFrame:
    """Rows for the table of query metrics."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("int")
    return answers.select(
        F.current_timestamp().alias("timestamp"), "query", "num_chunks", "top_score", F.round("avg_top3_score", 4).alias("avg_top3_score"), "fallback",
        zero("prompt_tokens").alias("prompt_tokens"), zero("response_tokens").alias("response_tokens"), zero("latency_ms").alias("llm_latency_ms"), zero("latency_ms").alias("total_latency_ms"),
    ).to(schemas.QUERY_METRICS)
