"""Every schema that is read or written; nothing is inferred, and no session is needed."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "boolean": T.BooleanType(), "int": T.IntegerType(), "bigint": T.LongType(), "double": T.DoubleType(), "float": T.FloatType(), "timestamp": T.TimestampType()}


def struct(text: str, **nested: T.DataType) -> T.StructType:
    """A schema from ``name type`` pairs; other types are given by name."""
    pairs = (p.split() for p in text.split(","))
    return T.StructType([T.StructField(name, nested.get(kind) or _TYPES[kind]) for name, kind in pairs])


RAW = struct("source string, raw_filename string, html string, error string")
SOURCES = struct("name string, url string, purpose string, enabled boolean")
METADATA = struct("source string, purpose string, raw_filename string, processed_at timestamp, text_length int")
PROCESSED = struct("text string, metadata metadata", metadata=METADATA)
CHUNK = struct("chunk_index int, text string, char_offset int, chunk_length int")
CHUNK_CONFIG = struct("chunk_size int, chunk_overlap int, min_chunk_size int")
CHUNKED = struct(
    "source string, purpose string, raw_filename string, processed_at timestamp, full_text_length int, chunk_config config, chunks chunks",
    config=CHUNK_CONFIG, chunks=T.ArrayType(CHUNK),
)
DOCUMENTS = struct("id bigint, source string, purpose string, raw_filename string, full_text_length int, processed_at timestamp")
CHUNKS = struct("id bigint, doc_id bigint, chunk_index int, text string, chunk_length int, char_offset int")
VECTORS = struct("chunk_id bigint, doc_id bigint, chunk_index int, source string, purpose string, embedding vector, embedding_ok boolean", vector=T.ArrayType(T.FloatType()))
RUNS = struct("id bigint, run_at timestamp, step string, duration_sec double, items_in bigint, items_out bigint, items_skipped bigint, status string")
METRICS = struct("run_id bigint, metric_name string, metric_value double")
QUERY_METRICS = struct("timestamp timestamp, query string, num_chunks int, top_score double, avg_top3_score double, fallback boolean, prompt_tokens int, response_tokens int, llm_latency_ms int, total_latency_ms int")
EVALUATION = struct("query string, expected_source string, expected_text_fragment string")
