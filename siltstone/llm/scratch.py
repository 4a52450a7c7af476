"""Shared scratch tables: they cut lineage and survive the loss of executors.

Everything is written through Spark (or a file-system URI) below the folder named
by ``spark.checkpoint.dir``; a folder of our own is chosen only where that
setting is missing and the master is local, as in tests.
"""

from __future__ import annotations

import gc
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_fallback: list[str] = []


def scratch_dir(spark: SparkSession) -> str:
    """The shared scratch folder of this session, without a trailing slash."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        if not _fallback:
            _fallback.append("file://" + tempfile.mkdtemp(prefix="siltstone-"))
        base = _fallback[0]
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path below the scratch folder that nothing else uses."""
    return f"{scratch_dir(spark)}/siltstone-{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as Parquet in the scratch folder and return the table read back."""
    path = new_path(df.sparkSession, label)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._siltstone_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that no later plan reads, and let go of finished shuffles."""
    if tables:
        gc.collect()  # plans that Python still names keep their shuffle files alive
        tables[0].sparkSession.sparkContext._jvm.System.gc()
    for table in tables:
        path = getattr(table, "_siltstone_path", None)
        if path:
            remove_path(table.sparkSession, path)


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file-system layer."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the Parquet tables below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
