"""Overlapping chunks that end at a space; the one step of the pipeline that is no relation."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructField, StructType

from siltstone.config import ChunkConfig
from siltstone.schemas import CHUNK

_ARROW = pa.list_(pa.struct([("chunk_index", pa.int32()), ("text", pa.string()), ("char_offset", pa.int32()), ("chunk_length", pa.int32())]))


def windows(text: str, size: int, overlap: int, blank: str | None = None) -> Iterator[tuple[int, str]]:
    """(start, text) of the windows of a text that is longer than one, stripped of white space or of the characters of ``blank``."""
    start, total = 0, len(text)
    while start + size < total:
        stop = text.rfind(" ", start + 1, start + size + 1)  # the place right after the window counts
        if stop < 0:
            stop = start + size
        yield start, text[start:stop].strip(blank)
        start += max(1, stop - start - overlap)
    if start < total:
        yield start, text[start:].strip(blank)


def chunk_text(text: str | None, config: ChunkConfig = ChunkConfig(), blank: str | None = None) -> list[dict]:
    """The chunks of one text: those of at least ``minimum`` characters, numbered from 0."""
    if not text:
        return []
    whole = len(text) <= config.size  # a short text stays as it is, unstripped
    pieces = [(0, text)] if whole else windows(text, config.size, config.overlap, blank)
    kept = [(start, piece) for start, piece in pieces if len(piece) >= config.minimum]
    return [{"chunk_index": i, "text": piece, "char_offset": start, "chunk_length": len(piece)} for i, (start, piece) in enumerate(kept)]


def with_chunks(docs: DataFrame, text_col: str = "text", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """The rows with an array column ``chunks``, in place of the text."""
    kept = [c for c in docs.columns if c != text_col]
    schema = StructType([docs.schema[c] for c in kept] + [StructField("chunks", ArrayType(CHUNK))])

    def run(batches):
        for batch in batches:
            chunks = pa.array([chunk_text(t, config) for t in batch.column(text_col).to_pylist()], _ARROW)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), chunks], [*kept, "chunks"])

    return docs.select(*kept, text_col).mapInArrow(run, schema)


def chunk_rows(docs: DataFrame, text_col: str = "text", config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """A row for each chunk; documents without chunks have none."""
    found = with_chunks(docs, text_col, config)
    return found.select(*[c for c in found.columns if c != "chunks"], F.inline("chunks"))


def chunk_payload(docs: DataFrame, config: ChunkConfig = ChunkConfig()) -> DataFrame:
    """Chunked documents with an echo of the settings, without the documents that have no chunk."""
    flat = docs.select("metadata.source", "metadata.purpose", "metadata.raw_filename", "metadata.processed_at", F.col("metadata.text_length").alias("full_text_length"), "text")
    echo = F.struct(F.lit(config.size).alias("chunk_size"), F.lit(config.overlap).alias("chunk_overlap"), F.lit(config.minimum).alias("min_chunk_size"))
    found = with_chunks(flat, "text", config).where(F.size("chunks") > 0)
    return found.select("source", "purpose", "raw_filename", "processed_at", "full_text_length", echo.alias("chunk_config"), "chunks")


def chunk_statistics(found: DataFrame, *by: str) -> DataFrame:
    """Counts and lengths over rows with ``chunks``: documents, skipped, chunks, average, least, most."""
    lengths = F.transform("chunks", lambda c: c["chunk_length"])
    rows = found.select(*by, F.size("chunks").cast("long").alias("n"), F.aggregate(lengths, F.lit(0).cast("long"), lambda a, x: a + x).alias("s"), F.array_min(lengths).alias("lo"), F.array_max(lengths).alias("hi"))
    return _summed(rows, *by)


def _summed(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("documents"), F.count_if(F.col("n") == 0).alias("empty_files"), F.coalesce(F.sum("n"), F.lit(0)).alias("total_chunks"),
        (F.sum("s") / F.when(F.sum("n") > 0, F.sum("n"))).alias("avg_chunk_length"), F.min("lo").alias("min_chunk_length"), F.max("hi").alias("max_chunk_length"),
    )


def drift(current: DataFrame, previous: DataFrame, threshold_pct: float) -> DataFrame:
    """Change of the average length against the stored one (one decimal), if that is above 0."""
    joined = current.select(F.col("avg_chunk_length").alias("current_avg")).crossJoin(previous.select(F.round("avg_chunk_length", 1).alias("previous_avg")))  # one row each
    pct = F.abs(F.col("current_avg") - F.col("previous_avg")) / F.col("previous_avg") * 100
    return joined.where("previous_avg > 0").select("current_avg", "previous_avg", pct.alias("drift_pct"), (pct > threshold_pct).alias("anomaly"))


def setting_statistics(docs: DataFrame, settings: list[ChunkConfig], text_col: str = "text") -> DataFrame:
    """``chunk_statistics`` of the texts for each setting (its place in ``setting``), read once for all of them."""
    schema = "setting int, n bigint, s bigint, lo int, hi int"

    def run(batches):
        for batch in batches:
            rows = []
            for text in batch.column(text_col).to_pylist():
                for i, config in enumerate(settings):
                    found = [c["chunk_length"] for c in chunk_text(text, config)]
                    rows.append((i, len(found), sum(found), min(found, default=None), max(found, default=None)))
            if rows:
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["setting", "n", "s", "lo", "hi"])

    return _summed(docs.select(text_col).mapInArrow(run, schema), "setting")


def sweep(docs: DataFrame, sizes: tuple[int, ...] = (200, 300, 500, 800), overlaps: tuple[float, ...] = (0.0, 0.1, 0.2, 0.3), text_col: str = "text") -> DataFrame:
    """Chunk statistics for each size and share of overlap, in one pass over the texts."""
    settings = [ChunkConfig(size, int(size * share)) for size in sizes for share in overlaps]
    found = setting_statistics(docs, settings, text_col)
    about = lambda f: F.element_at(F.lit([f(c) for c in settings]), F.col("setting") + 1)
    return found.select(about(lambda c: c.size).alias("size"), about(lambda c: c.overlap).alias("overlap"), *[c for c in found.columns if c != "setting"])
