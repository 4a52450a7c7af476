"""Whole texts that have to be dealt out again travel compressed."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType


#: Bytes in front of a packed text that hold its size.
HEAD = 8


def plain(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, text): a row of ``docs`` is known by its id and the hash of its text."""
    text = docs[f"`{text_col}`"]
    return docs.select(docs[f"`{id_col}`"].cast("long").alias("id"), F.xxhash64(text).alias("th"), text.alias("text"))


def packed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, th, z): the same with the text's bytes compressed; a null text is empty."""
    schema = StructType([StructField("id", LongType()), StructField("th", LongType()), StructField("z", BinaryType())])

    def run(batches):
        codec = pa.Codec("zstd", compression_level=1)

        def squeeze(raw):
            return len(raw).to_bytes(HEAD, "little") + codec.compress(raw, asbytes=True)

        for batch in batches:
            text = batch.column("text").cast(pa.large_string()).cast(pa.large_binary())
            z = [squeeze(b"" if not t.is_valid else t.as_buffer()) for t in text]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("th"), pa.array(z, pa.binary())], schema.names)

    return plain(docs, id_col, text_col).mapInArrow(run, schema)


def named(texts: DataFrame, names: DataFrame, name: str) -> DataFrame:
    """(name, z) of the rows (name, id, th): texts are dealt out once, rows that repeat count once."""
    key = F.coalesce("id", F.lit(-(2**63))).alias("_id")
    met = texts.select(key, "th", "z").join(names.select(key, "th", name), ["_id", "th"])
    return met.groupBy("_id", "th", name).agg(F.first("z").alias("z")).select(name, "z")


def unpack(column: pa.Array) -> pa.Array:
    """The texts' bytes."""
    codec = pa.Codec("zstd")

    def loosen(raw):
        size = int.from_bytes(raw[:HEAD].to_pybytes(), "little")
        return codec.decompress(raw[HEAD:], size, asbytes=True) if size else b""

    return pa.array([loosen(z.as_buffer()) for z in column], pa.large_binary())
