"""Carry whole input rows beside what an Arrow function computes, safe from name clashes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Name of the struct column that holds the caller's own columns.
ROW = "row"


def with_row(df: DataFrame, inputs: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns, all by default) and the inputs under their new names."""
    kept = df.columns if keep is None else keep
    own = F.struct(*[df[f"`{c}`"] for c in kept]) if kept else F.struct(F.lit(None).cast("int").alias("_none"))
    return df.select(own.alias(ROW), *[df[f"`{c}`"].alias(name) for name, c in inputs.items()])


def append(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterator[tuple[int, int, dict]]], fields: list[StructField]) -> DataFrame:
    """Run ``fn`` over Arrow batches of ``with_row`` output; result: ``row`` and ``fields``.

    ``fn`` yields (first row, row count, columns) for consecutive runs of a batch's rows.
    """
    schema = StructType([df.schema[ROW], *fields])
    names = [f.name for f in fields]

    def run(batches):
        for batch in batches:
            own = batch.column(ROW)
            for first, count, columns in fn(batch):
                yield pa.RecordBatch.from_arrays([own.slice(first, count), *[columns[n] for n in names]], [ROW, *names])

    return df.mapInArrow(run, schema)
