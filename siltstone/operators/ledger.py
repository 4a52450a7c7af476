"""The ledger of pipeline runs: written by a tracker, read as relations."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siltstone import schemas
from siltstone.functions.display import change, format_value
from siltstone.sources.store import append, read_or_empty

log = logging.getLogger("siltstone.ledger")
#: Steps in the order of a report.
STEPS = ["extract", "transform", "chunk", "load"]


@dataclass
class Step:
    """What a step says of itself while it runs: its counts (in, out, skipped) once it knows them, and named metrics."""

    name: str
    counts: tuple[int, int, int] | None = None
    metrics: dict[str, float] = field(default_factory=dict)

    def counted(self, items_in: int, items_out: int, items_skipped: int, **metrics: float) -> None:
        self.counts = (items_in, items_out, items_skipped)
        self.metrics |= metrics

    def outcome(self, error: BaseException | None) -> str:
        if error is not None:
            return "failed"
        if self.counts is None:
            return "no_data"
        return "partial" if self.counts[2] > 0 else "success"


def _written(spark: SparkSession, path: str, step: Step, seconds: float, error: BaseException | None) -> None:
    """Append a step's run and its metrics. Run ids ascend with time, so that drivers share no counter."""
    now = datetime.now(UTC)
    run_id = int(now.timestamp() * 1e6)
    run = (run_id, now, step.name, round(seconds, 2), *(step.counts or (0, 0, 0)), step.outcome(error))
    append(spark.createDataFrame([run], schemas.RUNS).coalesce(1), f"{path}/runs")
    if step.metrics:
        append(spark.createDataFrame([(run_id, k, float(v)) for k, v in step.metrics.items()], schemas.METRICS).coalesce(1), f"{path}/metrics")


@contextmanager
def tracked(spark: SparkSession, path: str, name: str) -> Iterator[Step]:
    """A step, timed and logged from start to end and written to the ledger; its errors pass through, the ledger's own do not."""
    step, error = Step(name), None
    began = time.perf_counter()
    log.info("%s starts", name)
    try:
        yield step
    except BaseException as e:
        error = e
        raise
    finally:
        seconds = time.perf_counter() - began
        log.info("%s ends after %.1f s: %s, %d in, %d out, %d skipped", name, seconds, step.outcome(error), *(step.counts or (0, 0, 0)))
        try:
            _written(spark, path, step, seconds, error)
        except Exception:
            log.exception("the run of step %s was not written", name)


def read_ledger(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return read_or_empty(spark, f"{path}/runs", schemas.RUNS), read_or_empty(spark, f"{path}/metrics", schemas.METRICS)


def latest_metric(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(step, metric_name, run_id, metric_value) of the newest run that has the metric."""
    joined = metrics.join(runs.select(F.col("id").alias("run_id"), "step"), "run_id")
    return joined.groupBy("step", "metric_name").agg(F.max("run_id").alias("run_id"), F.max_by("metric_value", "run_id").alias("metric_value"))


def previous_metric(spark: SparkSession, path: str, step: str, name: str) -> float | None:
    """The last stored value, or None; nothing that goes wrong here stops a step."""
    try:
        row = latest_metric(*read_ledger(spark, path)).where((F.col("step") == step) & (F.col("metric_name") == name)).first()
        return row["metric_value"] if row else None
    except Exception:
        log.exception("metric %s of step %s could not be read", name, step)
        return None


def last_two(runs: DataFrame) -> DataFrame:
    """The newest two runs of each step with ``recency`` 1 and 2."""
    order = Window.partitionBy("step").orderBy(F.desc("id"))
    return runs.withColumn("recency", F.row_number().over(order)).where("recency <= 2")


def compare_metrics(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per step and metric of the newest two runs: current, previous, how they show, and the change."""
    two = last_two(runs).select(F.col("id").alias("run_id"), "step", "recency")
    joined = metrics.join(two, "run_id")
    side = lambda r: F.max(F.when(F.col("recency") == r, F.col("metric_value")))
    wide = joined.groupBy("step", "metric_name").agg(side(1).alias("current"), side(2).alias("previous"))
    return wide.select("*", format_value(F.col("current")).alias("current_text"), format_value(F.col("previous")).alias("previous_text"), change(F.col("current"), F.col("previous")).alias("change"))


def duration_totals(runs: DataFrame) -> DataFrame:
    """Seconds over the steps by recency; a step without such a run is left out."""
    return last_two(runs).groupBy("recency").agg(F.sum("duration_sec").alias("total_duration"), F.count(F.lit(1)).alias("steps"))


def report_table(runs: DataFrame, metrics: DataFrame) -> DataFrame:
    """(step, place, label, current, previous, change) of the newest two runs of each step: their fields, then their metrics.

    Fields are unpivoted in the plan, so a field and a metric become the same kind of row.
    """
    text = {"run_at": F.date_format("run_at", "yyyy-MM-dd HH:mm"), "status": F.col("status")}
    numbers = ["duration_sec", "items_in", "items_out", "items_skipped"]
    two = last_two(runs)
    field = lambda place, label, value, shown: F.struct(F.lit(place).alias("place"), F.lit(label).alias("label"), value.cast("double").alias("value"), shown.alias("shown"))
    none = F.lit(None)
    fields = [field(i, n, none if n in text else F.col(n), text[n] if n in text else format_value(F.col(n).cast("double"))) for i, n in enumerate(["run_at", *numbers, "status"])]
    rows = two.select("step", "recency", F.inline(F.array(*fields)))
    side = lambda r, c: F.max(F.when(F.col("recency") == r, F.col(c)))
    wide = rows.groupBy("step", "place", "label").agg(side(1, "value").alias("a"), side(2, "value").alias("b"), side(1, "shown").alias("current"), side(2, "shown").alias("previous"))
    moved = F.when(F.col("a").isNotNull(), change(F.col("a"), F.col("b"))).when((F.col("label") == "status") & (F.col("current") != F.col("previous")), " (other)").otherwise("")
    own = compare_metrics(runs, metrics).select("step", F.lit(100).alias("place"), F.col("metric_name").alias("label"), F.col("current_text").alias("current"), F.col("previous_text").alias("previous"), "change")
    return wide.select("step", "place", "label", "current", "previous", moved.alias("change")).union(own)


def report_lines(runs: DataFrame, metrics: DataFrame) -> list[str]:
    """``report_table`` and the totals as text, steps in their order."""
    known = runs.where(F.col("step").isin(STEPS))
    rows = report_table(known, metrics).orderBy("place", "label").collect()
    lines = ["step       figure                    last             before"]
    for step in STEPS:
        own = [f"{step:10s} {r['label']:25s} {r['current'] or '-':16s} {r['previous'] or '-':16s}{r['change'] or ''}".rstrip() for r in rows if r["step"] == step]
        lines += own or [f"{step:10s} no runs yet"]
    return lines + [f"all steps, run {r['recency']} from the end: {r['total_duration']:.1f} s" for r in duration_totals(known).orderBy("recency").collect()]
