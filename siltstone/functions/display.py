"""Values as reports show them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_value(value: Column) -> Column:
    """Whole numbers without decimals, others with one; null is a dash."""
    return F.when(value.isNull(), "-").when(value == F.floor(value), F.floor(value).cast("string")).otherwise(F.format_string("%.1f", value))


def change(current: Column, previous: Column) -> Column:
    """Signed difference in brackets; empty if equal or if either is missing."""
    diff = current - previous
    return F.when(current.isNull() | previous.isNull() | (diff == 0), "").otherwise(F.format_string(" (%s%.1f)", F.when(diff > 0, "+").otherwise(""), diff))


def run_status(failed: Column, skipped: Column, recorded: Column) -> Column:
    return F.when(failed, "failed").when(skipped > 0, "partial").when(recorded, "success").otherwise("no_data")
