"""Pages to documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from siltstone.config import TransformConfig
from siltstone.functions.html import clean_html, clean_html_strict


def source_purposes(sources: DataFrame) -> DataFrame:
    """(source, purpose) of all sources, enabled or not."""
    return sources.select(F.col("name").alias("source"), F.coalesce("purpose", F.lit("unknown")).alias("purpose"))


def with_purpose(rows: DataFrame, purposes: DataFrame) -> DataFrame:
    """Left join on source; a source that is not listed has the purpose ``unknown``.

    The dimension is small as a rule, and then the session's own threshold broadcasts it.
    """
    return rows.join(purposes, "source", "left").withColumn("purpose", F.coalesce("purpose", F.lit("unknown")))


def is_blank(text: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", "")), F.lit(0)) == 0


def clean_pages(pages: DataFrame, config: TransformConfig = TransformConfig(), strict: bool = False, plain: bool = False) -> DataFrame:
    """Pages with ``text``; blank pages are left out. ``plain`` as in ``clean_html``."""
    rows = pages.where(~is_blank(F.col("html")))
    if plain:  # as a generated column, or a filter on the text would clean every page a second time
        return rows.select("*", F.explode(F.array(clean_html(F.col("html"), config.strip_tags, plain))).alias("text"))
    text = clean_html_strict(config.strip_tags)("html") if strict else clean_html(F.col("html"), config.strip_tags)
    return rows.withColumn("text", text)


def to_documents(pages: DataFrame, purposes: DataFrame, config: TransformConfig = TransformConfig(), strict: bool = False, seen: Observation | None = None, plain: bool = False) -> DataFrame:
    """(text, metadata) of the pages whose text is long enough; ``plain`` as in ``clean_html``; ``seen`` gets the counters of ``transform_counts`` on the way."""
    if seen is not None:
        blank = is_blank(F.col("html"))
        text = clean_html_strict(config.strip_tags)("html") if strict else clean_html(F.col("html"), config.strip_tags, plain)
        rows = pages.withColumn("text", text).withColumn("blank", blank)
        out = F.coalesce(~F.col("blank") & (F.length("text") >= config.min_text_length), F.lit(False))
        rows = rows.withColumn("out", out).observe(seen, F.count(F.lit(1)).alias("items_in"), F.count_if("out").alias("items_out"), F.count_if(~F.col("out")).alias("items_skipped"), F.count_if("blank").alias("empty_files"))
        rows = rows.where("out").drop("out", "blank")
    else:
        rows = clean_pages(pages, config, strict, plain).where(F.length("text") >= config.min_text_length)
    rows = with_purpose(rows, purposes)
    meta = F.struct("source", "purpose", "raw_filename", F.current_timestamp().alias("processed_at"), F.length("text").alias("text_length"))
    return rows.select("text", meta.alias("metadata"))


def transform_counts(pages: DataFrame, config: TransformConfig = TransformConfig()) -> DataFrame:
    """items_in, items_out, items_skipped (blank or short) and empty_files of one pass."""
    text = F.when(~is_blank(F.col("html")), clean_html(F.col("html"), config.strip_tags))
    rows = pages.select(F.length(text).alias("n"))
    out = F.coalesce(F.col("n") >= config.min_text_length, F.lit(False))
    return rows.agg(F.count(F.lit(1)).alias("items_in"), F.count_if(out).alias("items_out"), F.count_if(~out).alias("items_skipped"), F.count_if(F.col("n").isNull()).alias("empty_files"))
