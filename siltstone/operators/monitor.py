"""Monitoring of measured values: mergeable quantile sketches, change detection and drift of histograms."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Relative error of a quantile from a sketch.
ERROR = 0.01
#: Buckets that a baseline is taken from, slack and threshold in its standard deviations.
BASELINE, SLACK, THRESHOLD = 24, 0.5, 4.0


def _gamma(error: float) -> float:
    return (1 + error) / (1 - error)


def sketch(rows: DataFrame, by: list[Column], value: str = "value", error: float = ERROR) -> DataFrame:
    """A row (the groups, bucket, n) for each logarithmic bucket that values of a group fall in.

    Buckets of two sketches add up, so a day is the sum of its hours without reading values again, and no task holds
    the values of a group. Bucket k > 0 or k <= 0 is of positive values in (g^(k-1), g^k], g = (1 + error) / (1 - error);
    values of 0 or less are in the bucket null. Null values count nowhere.
    """
    return rows.where(F.col(value).isNotNull()).groupBy(*by, _bucket(value, error).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _bucket(value: str, error: float) -> Column:
    """The logarithmic bucket of a value, null if it is not positive; what is infinite or no number comes last."""
    at = F.ceil(F.log(F.col(value)) / math.log(_gamma(error)))
    return F.when(F.col(value) < math.inf, F.when(F.col(value) > 0, at.cast("int"))).otherwise(2**31 - 1)


def rolled_up(sketches: DataFrame, by: list[Column]) -> DataFrame:
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))


def quantiles(sketches: DataFrame, by: list[str], wanted: dict[str, float], error: float = ERROR) -> DataFrame:
    """The groups, ``rows``, and each wanted quantile: within ``error`` of the value whose rank is q (rows - 1), rounded down; 0 for what is not positive."""
    g = _gamma(error)
    order = Window.partitionBy(*by).orderBy(F.asc_nulls_first("bucket"))
    upto = sketches.withColumns({"upto": F.sum("n").over(order), "rows": F.sum("n").over(Window.partitionBy(*by))})
    value = F.when(F.col("bucket").isNull(), 0.0).otherwise(2 * F.pow(F.lit(g), F.col("bucket")) / (g + 1))
    at = lambda q: F.min(F.when(F.col("upto") > F.floor(F.lit(q) * (F.col("rows") - 1)), value)).alias
    return upto.groupBy(*by).agg(F.first("rows").alias("rows"), *[at(q)(name) for name, q in wanted.items()])


def exact_quantiles(rows: DataFrame, by: str, wanted: dict[str, float], value: str = "value", error: float = ERROR) -> DataFrame:
    """``by`` and each wanted quantile of all its values that are not null: exact, between two neighbours by interpolation.

    Equal values of a group are counted first. How many values the buckets of a sketch hold tells in which of them the
    wanted ranks are; only their values are put in order, bucket by bucket, so no task holds the values of a group.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_bucket", _bucket("_v", error))
    sums = counts.groupBy(by, "_bucket").agg(F.sum("_n").alias("_n"))
    order = Window.partitionBy(by).orderBy(F.asc_nulls_first("_bucket"))
    sums = sums.withColumns({"_upto": F.sum("_n").over(order), "_rows": F.sum("_n").over(Window.partitionBy(by))})
    low = lambda q: F.floor(F.lit(q) * (F.col("_rows") - 1))
    high = lambda q: F.ceil(F.lit(q) * (F.col("_rows") - 1))
    inside = lambda r: (r >= F.col("_upto") - F.col("_n")) & (r < F.col("_upto"))
    held = sums.where(reduce(lambda a, b: a | b, [inside(rank(q)) for q in wanted.values() for rank in (low, high)]))
    held = held.select(F.col(by).alias("_by"), F.col("_bucket").alias("_at"), (F.col("_upto") - F.col("_n")).alias("_before"), "_rows")
    met = counts.join(held, F.col(by).eqNullSafe(F.col("_by")) & F.col("_bucket").eqNullSafe(F.col("_at")))
    met = met.withColumn("_upto", F.col("_before") + F.sum("_n").over(Window.partitionBy(by, "_bucket").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)))
    at = lambda rank: F.min(F.when(F.col("_upto") > rank, F.col("_v")))
    found = met.groupBy(by).agg(F.first("_rows").alias("_rows"), *[at(rank(q)).alias(f"_{side}_{name}") for name, q in wanted.items() for side, rank in (("low", low), ("high", high))])
    part = lambda q: F.lit(q) * (F.col("_rows") - 1) - low(q)
    between = lambda name, q: F.when(part(q) == 0, F.col(f"_low_{name}")).otherwise(F.col(f"_low_{name}") * (1 - part(q)) + F.col(f"_high_{name}") * part(q))
    return found.select(by, *[between(name, q).alias(name) for name, q in wanted.items()])


def cusum(points: DataFrame, key: str, at: str, value: str, baseline: int = BASELINE, slack: float = SLACK, threshold: float = THRESHOLD) -> DataFrame:
    """``points`` (a row for each key and bucket of time) with ``up``, ``down`` and ``alert`` (up, down or null).

    The first ``baseline`` points of a key give its mean and standard deviation (population); later ones are summed as deviations
    beyond ``slack``, never below 0, once for rises and once for falls. Such a sum is the running total less its lowest value
    so far, so windows give it. An alert is a point at which a sum comes to exceed ``threshold``. Keys whose baseline has
    no spread give no sums.
    """
    order = Window.partitionBy(key).orderBy(at)
    head = F.when(F.col("i") <= baseline, F.col(value))
    rows = points.withColumn("i", F.row_number().over(order))
    whole = Window.partitionBy(key)
    rows = rows.withColumns({"mean": F.avg(head).over(whole), "spread": F.stddev_pop(head).over(whole)})
    z = F.when((F.col("i") > baseline) & (F.col("spread") > 0), (F.col(value) - F.col("mean")) / F.col("spread"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    for name, sign in (("up", 1), ("down", -1)):
        rows = rows.withColumn("_d", F.coalesce(sign * z - slack, F.lit(0.0))).withColumn("_c", F.sum("_d").over(upto))
        rows = rows.withColumn(name, F.col("_c") - F.least(F.min("_c").over(upto), F.lit(0.0)))
    crossed = lambda c: (F.col(c) > threshold) & (F.coalesce(F.lag(c).over(order), F.lit(0.0)) <= threshold)
    alert = F.when(crossed("up"), "up").when(crossed("down"), "down")
    return rows.withColumn("alert", alert).drop("i", "mean", "spread", "_d", "_c")


def stability(counts: DataFrame, key: list[str], period: str, bin_col: str, n: str = "n") -> DataFrame:
    """(key, period, psi): the population stability index of each period's histogram against the one before it.

    ``counts`` has a row for each key, period and bin that is not empty; a bin that one of the two lacks counts as half a row.
    """
    dense = counts.select(*key, period).distinct().join(counts.select(*key, bin_col).distinct(), key).join(counts, [*key, period, bin_col], "left")
    rows = dense.withColumn("_n", F.greatest(F.coalesce(n, F.lit(0)).cast("double"), F.lit(0.5)))
    rows = rows.withColumn("_p", F.col("_n") / F.sum("_n").over(Window.partitionBy(*key, period)))
    rows = rows.withColumn("_q", F.lag("_p").over(Window.partitionBy(*key, bin_col).orderBy(period)))
    return rows.where("_q is not null").groupBy(*key, period).agg(F.sum((F.col("_p") - F.col("_q")) * F.log(F.col("_p") / F.col("_q"))).alias("psi"))
