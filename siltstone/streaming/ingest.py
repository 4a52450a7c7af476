"""The page pipeline as a stream: the same transforms behind ``readStream``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from siltstone.config import Config
from siltstone.operators.chunk import chunk_rows
from siltstone.operators.transform import clean_pages
from siltstone.sources.store import upsert_sources


def page_chunks(pages: DataFrame, config: Config = Config()) -> DataFrame:
    """Chunks of the pages (source, html) that are long enough; stateless, so batch and stream agree."""
    texts = clean_pages(pages, config.transform).where(F.length("text") >= config.transform.min_text_length)
    return chunk_rows(texts.select("source", "text"), "text", config.chunk)


def stream_pages(spark: SparkSession, folder: str, schema: StructType) -> DataFrame:
    """New Parquet files of pages below a folder."""
    return spark.readStream.schema(schema).parquet(folder)


def stream_chunks(pages: DataFrame, out: str, checkpoint: str, config: Config = Config()) -> StreamingQuery:
    """Write the chunks of all pages that are there, replacing those of the same source; then stop.

    A micro-batch that is repeated after a failure writes the same partitions again.
    """
    writer = page_chunks(pages, config).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    return writer.foreachBatch(lambda batch, _: upsert_sources(batch, out)).start()


def windowed_latency(metrics: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Query counts, fallback rate and mean latency by window of ``timestamp``, over batch or stream."""
    rows = metrics.withWatermark("timestamp", late) if metrics.isStreaming else metrics
    return rows.groupBy(F.window("timestamp", width).alias("window")).agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("fallback").cast("int")).alias("fallback_rate"), F.avg("total_latency_ms").alias("avg_latency_ms"))
