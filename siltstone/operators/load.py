"""Documents and chunks as tables with ids."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.operators.transform import is_blank
from siltstone.sources.store import staged


def numbered(found: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with chunks, with ``doc_no`` from 1 in the order of their keys and ``_first``, the chunks before them.

    The input is evaluated once and staged. Rows are dealt out by ranges of the keys, so sparse
    or textual keys make no difference; where a range begins follows from the sizes of the
    ranges before it, a row for each.
    """
    rows = staged(found.where(F.size("chunks") > 0), "chunked")
    ranged = staged(rows.repartitionByRange(*keys).withColumn("_part", F.spark_partition_id()), "ranged")
    n = F.size("chunks").cast("long")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_docs"), F.sum(n).alias("_n"))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = lambda c, w: F.coalesce(F.sum(c).over(w), F.lit(0)).cast("long")
    starts = sizes.select("_part", before("_docs", earlier).alias("_docs"), before("_n", earlier).alias("_n"))
    inside = Window.partitionBy("_part").orderBy(*keys)
    placed = ranged.join(F.broadcast(starts), "_part")  # a row per task
    doc_no = (F.col("_docs") + F.row_number().over(inside)).cast("long").alias("doc_no")
    first = (F.col("_n") + before(n, inside.rowsBetween(Window.unboundedPreceding, -1))).alias("_first")
    return placed.select(*rows.columns, doc_no, first)


def chunks_of(documents: DataFrame, *keep: str) -> DataFrame:
    """Chunks of ``numbered`` documents with chunk ids from 1 and the kept columns."""
    flat = documents.select(*keep, "doc_no", "_first", F.inline("chunks"))
    return flat.select((F.col("_first") + F.col("chunk_index") + 1).cast("long").alias("chunk_id"), "doc_no", *keep, "chunk_index", "text", "chunk_length", "char_offset")


def chunk_table(found: DataFrame, key: str) -> DataFrame:
    """Chunks with document ids and chunk ids, both from 1 in the order of the documents' key."""
    return chunks_of(numbered(found.select(key, "chunks"), [key]), key)


def document_table(documents: DataFrame) -> DataFrame:
    """Rows of the table of documents from ``numbered`` chunked documents."""
    return documents.select(F.col("doc_no").alias("id"), "source", F.coalesce("purpose", F.lit("unknown")).alias("purpose"), "raw_filename", "full_text_length", "processed_at")


def load_quality(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """empty_chunks (white space only), total_chunks_embedded, embedding_failures (vectors of zeros)."""
    left = chunks.agg(F.count_if(is_blank(F.col("text"))).alias("empty_chunks"), F.count(F.lit(1)).alias("total_chunks"))
    zero = F.forall("embedding", lambda x: x == 0)
    right = vectors.agg(F.count(F.lit(1)).alias("total_vectors"), F.count_if(zero).alias("embedding_failures"))
    return left.crossJoin(right)  # one row each


def consistency(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Ids that only one of the two tables has."""
    left = chunks.select("chunk_id").join(vectors.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("no vector").alias("problem"))
    return left.union(vectors.select("chunk_id").join(chunks.select("chunk_id"), "chunk_id", "left_anti").select("chunk_id", F.lit("no chunk").alias("problem")))
