"""Retrieval quality against labelled queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def judge(labels: DataFrame, hits: DataFrame, query_id: str = "query_id") -> DataFrame:
    """Per labelled query: p1, hit3, reciprocal rank, fragment hit, top score; no hits count as misses."""
    expected = hits.join(labels.select(query_id, "expected_source", "expected_text_fragment"), query_id)
    match = F.col("source") == F.col("expected_source")
    fragment = (F.col("expected_text_fragment") != "") & F.col("text").contains(F.col("expected_text_fragment"))
    per = expected.groupBy(query_id).agg(
        F.max(F.coalesce(match & (F.col("rank") == 1), F.lit(False))).alias("p1"), F.max(F.coalesce(match & (F.col("rank") <= 3), F.lit(False))).alias("hit3"),
        F.min(F.when(match, F.col("rank"))).alias("first"), F.max(F.coalesce(fragment, F.lit(False))).alias("fragment"), F.max(F.round("score", 4)).alias("top_score"),
        F.slice(F.transform(F.array_sort(F.collect_list(F.struct("rank", "source"))), lambda h: h["source"]), 1, 3).alias("top3"),
    )
    no = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return labels.join(per, query_id, "left").select(
        *labels.columns, no("p1"), no("hit3"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), no("fragment"),
        F.coalesce("top_score", F.lit(0.0)).alias("top_score"), F.coalesce("top3", F.array().cast("array<string>")).alias("top3"),
    )


def evaluate(judged: DataFrame) -> DataFrame:
    """One row of means; null for an empty set of queries."""
    share = lambda c: F.avg(F.col(c).cast("int")).alias(c)
    score = lambda hit: F.coalesce(F.avg(F.when(F.col("fragment") == hit, F.col("top_score"))), F.lit(0.0))
    return judged.agg(
        F.count(F.lit(1)).alias("queries"), share("p1").alias("precision_at_1"), share("hit3").alias("precision_at_3"), share("fragment").alias("fragment_rate"),
        F.avg("reciprocal_rank").alias("mrr"), score(True).alias("avg_hit_score"), score(False).alias("avg_miss_score"),
    )


def evaluation_lines(judged: DataFrame, k: int) -> list[str]:
    """Figures and failures as text; what comes to the driver is one row, and a row for each failure."""
    e = evaluate(judged).first()
    if not e["queries"]:
        return ["No queries"]
    lines = [f"MISS {r['query'] if 'query' in judged.columns else r[0]}: expected {r['expected_source']}, got {', '.join(r['top3']) or 'nothing'}" for r in failures(judged).toLocalIterator()]
    shares = (("Precision@1", "precision_at_1"), ("Precision@3", "precision_at_3"), (f"Fragment hit@{k}", "fragment_rate"))
    lines += [f"{'Queries':20s} {e['queries']}"] + [f"{label:20s} {e[c]:.1%}" for label, c in shares]
    return lines + [f"{label:20s} {e[c]:.3f}" for label, c in (("MRR", "mrr"), ("Mean score of hits", "avg_hit_score"), ("Mean score of misses", "avg_miss_score"))]


def failures(judged: DataFrame) -> DataFrame:
    """Queries whose first source or whose fragment is wrong, with what came first."""
    return judged.where(~F.col("p1") | ~F.col("fragment"))
