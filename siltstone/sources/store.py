"""Parquet and JSON tables of the pipeline: the last good version of a source stays."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StructType


def upsert_sources(rows: DataFrame, path: str) -> None:
    """Replace the partitions of the sources in ``rows``; others keep what they have."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(path)


def replace(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").parquet(path)


def append(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A folder below spark.checkpoint.dir that nothing else uses.

    Without that setting a folder of this machine serves, which only a local master may use.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="siltstone-")
    return f"{base.rstrip('/')}/siltstone-{label}-{uuid.uuid4().hex}"


def staged(rows: DataFrame, label: str) -> DataFrame:
    """``rows`` written once, to a fresh folder, and read back: evaluated once, and no lineage to redo."""
    path = fresh_folder(rows.sparkSession, label)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def read_or_empty(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A table that may not have been written yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_json(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """Documents, chunked documents or evaluation sets kept as JSON: a file each, a list of them, or a line each."""
    text = spark.read.text(path, wholetext=True)
    is_list = F.col("value").rlike(r"^\s*\[")
    one = F.from_json(F.when(~is_list, F.col("value")), schema)
    lines = F.from_json(F.when(~is_list, F.concat(F.lit("["), F.array_join(F.filter(F.split(F.trim("value"), r"\r?\n(?=\{)"), lambda x: F.trim(x) != ""), ","), F.lit("]"))), ArrayType(schema))
    rows = text.select(F.explode(F.coalesce(F.from_json(F.when(is_list, F.col("value")), ArrayType(schema)), lines, F.array(one))).alias("r"))
    return rows.where("r is not null").select("r.*")
