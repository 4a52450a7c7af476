"""Change detection and feedback over streams; each has a batch form that gives the same rows."""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siltstone.operators.monitor import BASELINE, SLACK, THRESHOLD, cusum

ALERT = "key string, at timestamp, value double, up double, down double, alert string"
#: Points so far, sums of the baseline's values and squares, the two sums, and open windows as JSON: start -> [sum, rows].
STATE = "n bigint, total double, squares double, up double, down double, windows string"


def hourly(events: DataFrame, key: str, at: str, value: str, width: str = "1 hour") -> DataFrame:
    """(key, at, value): the mean of each key and window of time."""
    rows = events.groupBy(F.col(key).cast("string").alias("key"), F.window(at, width).alias("w")).agg(F.avg(value).alias("value"))
    return rows.select("key", F.col("w.start").alias("at"), "value")


def batch_alerts(points: DataFrame, **settings) -> DataFrame:
    return cusum(points, "key", "at", "value", **settings).select("key", "at", "value", "up", "down", "alert")


def stream_alerts(
    events: DataFrame, key: str, at: str, value: str, minutes: int = 60, late: str = "2 hours", baseline: int = BASELINE, slack: float = SLACK, threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``batch_alerts`` over ``hourly``, each as soon as the watermark has passed its window.

    A key's state is its two sums, its baseline and a sum and count for each window that is still open, so it
    does not grow with history. Windows close in order of time; rows later than the watermark allows count nowhere. A
    timer at the end of the first open window closes it even if the key stays silent.
    """
    width = minutes * 60_000

    def step(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        n, total, squares, up, down, held = state.get if state.exists else (0, 0.0, 0.0, 0.0, 0.0, "{}")
        mark = state.getCurrentWatermarkMs()
        windows = {int(k): v for k, v in json.loads(held).items()}
        if not state.hasTimedOut:
            for batch in batches:
                good = batch.dropna(subset=["at", "value"])
                start = good["at"].to_numpy().astype("datetime64[ms]").astype("int64") // width * width
                for w, rows in good["value"].groupby(start):
                    if w + width > mark:
                        s, c = windows.get(int(w), (0.0, 0))
                        windows[int(w)] = [s + float(rows.sum()), c + len(rows)]
        out = []
        for w in sorted(w for w in windows if w + width <= mark):
            s, c = windows.pop(w)
            point, alert = s / c, None
            if n < baseline:
                total, squares = total + point, squares + point * point
            else:
                mean = total / baseline
                spread = math.sqrt(max(squares / baseline - mean * mean, 0.0))
                if spread > 0:
                    z, was_up, was_down = (point - mean) / spread, up, down
                    up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
                    alert = "up" if up > threshold >= was_up else "down" if down > threshold >= was_down else None
            n += 1
            out.append((group[0], pd.Timestamp(w, unit="ms"), point, up, down, alert))
        state.update((n, total, squares, up, down, json.dumps(windows)))
        if windows:
            state.setTimeoutTimestamp(max(min(windows) + width, mark + 1))
        yield pd.DataFrame(out, columns=["key", "at", "value", "up", "down", "alert"])

    rows = events.select(F.col(key).cast("string").alias("key"), F.col(at).alias("at"), F.col(value).cast("double").alias("value")).withWatermark("at", late)
    return rows.groupBy("key").applyInPandasWithState(step, ALERT, STATE, "append", GroupStateTimeout.EventTimeTimeout)


def latest_feedback(feedback: DataFrame, late: str = "1 day") -> DataFrame:
    """(query_id, rating, correction, rated_at): of each query its last rating by event time, the last id at equal times; feedback: feedback_id and these.

    Repeated deliveries change nothing. Over a stream this is state of one row a query, in update or complete mode.
    """
    rows = feedback.withWatermark("rated_at", late) if feedback.isStreaming else feedback
    last = rows.where(F.col("query_id").isNotNull() & F.col("rating").isNotNull()).groupBy("query_id").agg(F.max_by(F.struct("rating", "correction", "rated_at"), F.struct("rated_at", "feedback_id")).alias("f"))
    return last.select("query_id", "f.*")


def feedback_report(metrics: DataFrame, latest: DataFrame) -> DataFrame:
    """By whether a query fell back: queries, rated, liked, disliked, corrected, and mean top score of the disliked."""
    rows = metrics.join(latest, "query_id", "left")
    bad = F.col("rating") < 0
    return rows.groupBy("fallback").agg(
        F.count(F.lit(1)).alias("queries"), F.count("rating").alias("rated"), F.count_if(F.col("rating") > 0).alias("liked"), F.count_if(bad).alias("disliked"), F.count("correction").alias("corrected"),
        F.avg(F.when(bad, F.col("top_score"))).alias("disliked_score"),
    )
