"""Answers taken apart and held against their context, without a model: citations, claims, facts, calibrated confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Between the claims of an answer, and between words.
SENTENCE, NO_WORD = r"[.!?]+\s+", r"[^0-9\p{L}]+"
#: Share of a claim's words that its context has to hold.
LEAST_SHARE = 0.6
#: The fields of a structured answer.
ANSWER_JSON = "answer string, sources array<string>, confidence string"


def parse_answer(raw: Column) -> Column:
    """A struct (answer, citations, sources, confidence, structured) from JSON with ``answer``, or from plain text.

    ``citations`` are the numbers of ``[i]`` marks in order, each once; ``answer`` is without them; a confidence that is
    not high, medium or low is null. A null answer is empty.
    """
    text = F.coalesce(raw, F.lit(""))
    fenced = F.regexp_replace(text, r"(?s)^\s*```(?:json)?\s*(.*?)\s*```\s*$", "$1")
    read = F.when(fenced.rlike(r"^\s*\{"), F.from_json(fenced, ANSWER_JSON))
    whole = F.coalesce(read["answer"], text)
    marks = F.array_distinct(F.transform(F.regexp_extract_all(whole, F.lit(r"\[([0-9]{1,9})\]"), F.lit(1)), lambda x: x.cast("int")))
    said = F.lower(read["confidence"])
    return F.struct(
        F.trim(F.regexp_replace(F.regexp_replace(whole, r"\s*\[[0-9]{1,9}\]", ""), r"[ \t]+", " ")).alias("answer"), marks.alias("citations"), F.coalesce(read["sources"], F.lit([]).cast("array<string>")).alias("sources"),
        F.when(said.isin("high", "medium", "low"), said).alias("confidence"), read["answer"].isNotNull().alias("structured"),
    )


def dangling(citations: Column, hits: Column) -> Column:
    """The citations that name none of so many hits."""
    return F.filter(citations, lambda i: (i < 1) | (i > hits))


def claims(answers: DataFrame, query_id: str = "query_id", answer: str = "answer") -> DataFrame:
    """(query_id, claim, text): the sentences of each answer that hold a word, numbered from 0."""
    parts = F.filter(F.split(F.coalesce(F.col(answer), F.lit("")), SENTENCE), lambda s: F.regexp_replace(s, NO_WORD, "") != "")
    return answers.select(query_id, F.posexplode(parts).alias("claim", "text"))


def claim_words(found: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, claim, word, fact): the distinct words of each claim in lower case.

    A fact is a word with a digit, or one with a capital that does not begin the claim: numbers, dates and names.
    """
    words = F.filter(F.split("text", NO_WORD), lambda w: w != "")
    is_fact = lambda w, i: w.rlike("[0-9]") | ((i > 0) & (F.lower(F.substring(w, 1, 1)) != F.substring(w, 1, 1)))
    pairs = F.transform(words, lambda w, i: F.struct(F.lower(w).alias("word"), is_fact(w, i).alias("fact")))
    rows = found.select(query_id, "claim", F.inline(pairs))
    return rows.groupBy(query_id, "claim", "word").agg(F.bool_or("fact").alias("fact"))


def grounded_claims(answers: DataFrame, context: DataFrame, query_id: str = "query_id", answer: str = "answer") -> DataFrame:
    """(query_id, claim, text, words, found, missing, grounded): each claim against its query's context (query_id, text), a row a hit.

    A claim is grounded if every fact of it, and LEAST_SHARE of its words, occur in the context. Each hit's text is
    held against the words of its query's answer, so only words that both have become rows, however long the texts
    are; a context is never gathered in one place.
    """
    said = claims(answers, query_id, answer)
    own = F.transform(F.filter(F.split(F.coalesce(F.col(answer), F.lit("")), NO_WORD), lambda w: w != ""), F.lower)
    asked = answers.select(query_id, F.array_distinct(own).alias("_said"))
    known = context.select(query_id, "text").join(asked, query_id).select(query_id, F.explode(F.array_intersect("_said", F.split(F.lower("text"), NO_WORD))).alias("word")).distinct()
    met = claim_words(said, query_id).join(known.withColumn("known", F.lit(True)), [query_id, "word"], "left")
    lost = F.col("fact") & F.col("known").isNull()
    counts = met.groupBy(query_id, "claim").agg(F.count(F.lit(1)).alias("words"), F.count("known").alias("found"), F.sort_array(F.collect_set(F.when(lost, F.col("word")))).alias("missing"))
    whole = (F.size("missing") == 0) & (F.col("found") >= LEAST_SHARE * F.col("words"))
    return said.join(counts, [query_id, "claim"]).withColumn("grounded", whole)


def answer_report(answers: DataFrame, context: DataFrame, query_id: str = "query_id", raw: str = "answer") -> DataFrame:
    """A row for each answer: claims, grounded, grounded_share, missing_facts, citations, dangling, structured, confidence.

    ``grounded_share`` is null without claims; citations count the query's hits from 1.
    """
    parsed = answers.select(query_id, parse_answer(F.col(raw)).alias("a")).select(query_id, "a.*")
    found = grounded_claims(parsed, context, query_id).groupBy(query_id).agg(F.count(F.lit(1)).alias("claims"), F.count_if("grounded").alias("grounded"), F.sum(F.size("missing")).alias("missing_facts"))
    hits = context.groupBy(query_id).agg(F.count(F.lit(1)).cast("int").alias("hits"))
    rows = parsed.join(found, query_id, "left").join(hits, query_id, "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return rows.select(
        query_id, zero("claims"), zero("grounded"), F.when(F.col("claims") > 0, F.col("grounded") / F.col("claims")).alias("grounded_share"), zero("missing_facts"),
        F.size("citations").alias("citations"), F.size(dangling(F.col("citations"), F.coalesce("hits", F.lit(0)))).alias("dangling"), "structured", "confidence",
    )


def calibration(judged: DataFrame, bins: int = 10, score: str = "score", correct: str = "correct") -> DataFrame:
    """(bin, low, high, rows, confidence): of each band of scores from 0 to 1 how often it was right.

    Neighbouring bands that contradict the order of scores are pooled (of all runs of bands that hold a band, the greatest
    least mean), so confidence never falls as the score rises. Empty bands take what is below them, or else 0.
    """
    band = F.least(F.greatest(F.floor(F.col(score) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")
    counts = judged.groupBy(band.alias("bin")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col(correct).cast("int")).alias("right"))
    known = {r["bin"]: (r.rows, r.right) for r in counts.collect()}  # a row a band
    n, y = [known.get(b, (0, 0))[0] for b in range(bins)], [known.get(b, (0, 0))[1] for b in range(bins)]
    mean = lambda a, b: sum(y[a : b + 1]) / sum(n[a : b + 1])
    out, last = [], 0.0
    for b in range(bins):
        if n[b]:
            last = max(min(mean(a, z) for z in range(b, bins) if sum(n[a : z + 1])) for a in range(b + 1) if n[a])
        out.append((b, b / bins, (b + 1) / bins, n[b], float(last)))
    return judged.sparkSession.createDataFrame(out, "bin int, low double, high double, rows bigint, confidence double")


def with_confidence(rows: DataFrame, table: DataFrame, score: str = "score") -> DataFrame:
    """Rows with the calibrated ``confidence`` of their score, and its ``level``: high from 0.8, medium from 0.5, else low."""
    bins = table.collect()
    value = F.element_at(F.lit([r.confidence for r in bins]), F.least(F.greatest(F.floor(F.col(score) * len(bins)), F.lit(0)), F.lit(len(bins) - 1)).cast("int") + 1)
    return rows.withColumn("confidence", value).withColumn("level", F.when(F.col("confidence") >= 0.8, "high").when(F.col("confidence") >= 0.5, "medium").otherwise("low"))
