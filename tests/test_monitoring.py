"""Grounding of answers, sketches, change detection and feedback; streams against batches."""

import datetime
import json
import math
import random
import statistics

import pytest

from pyspark.sql import functions as F

from siltstone.operators import grounding, lexical, monitor
from siltstone.plans.oracle import SQL
from siltstone.plans.queries import QUERIES
from siltstone.streaming import alerts


def test_answers_are_parsed(spark):
    raw = ["Two places [2] and [1], again [2].", json.dumps({"answer": "From [3].", "sources": ["a", "b"], "confidence": "High"}), '```json\n{"answer": "x", "confidence": "sure"}\n```', '{"answer": ', '{"other": 1}', None, "", "no [x] marks"]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").select("i", grounding.parse_answer(F.col("r")).alias("a")).orderBy("i").collect()
    assert [(r.a.answer, r.a.citations, r.a.sources, r.a.confidence, r.a.structured) for r in got] == [
        ("Two places and, again.", [2, 1], [], None, False), ("From.", [3], ["a", "b"], "high", True), ("x", [], [], None, True), ('{"answer":', [], [], None, False), ('{"other": 1}', [], [], None, False), ("", [], [], None, False), ("", [], [], None, False),
        ("no [x] marks", [], [], None, False),
    ]


def test_claims_are_held_against_their_own_context(spark):
    answers = spark.createDataFrame([(1, "The course costs 500 euro [1]. It begins in May 2024. Nobody knows Zagreb."), (2, "The course costs 500 euro [1][3]."), (3, None), (4, "... !")], "query_id int, answer string")
    context = spark.createDataFrame([(1, "A COURSE costs 500 euro; the fee"), (1, "it begins in may 2023"), (3, "unused"), (2, None)], "query_id int, text string")
    parsed = answers.select("query_id", grounding.parse_answer(F.col("answer"))["answer"].alias("answer"))
    got = {(r.query_id, r.claim): (r.missing, r.grounded) for r in grounding.grounded_claims(parsed, context).collect()}
    assert got == {(1, 0): ([], True), (1, 1): (["2024"], False), (1, 2): (["zagreb"], False), (2, 0): (["500"], False)}
    report = {r.query_id: (r.claims, r.grounded, r.missing_facts, r.citations, r.dangling) for r in grounding.answer_report(answers, context).collect()}
    assert report == {1: (3, 1, 2, 1, 0), 2: (1, 0, 1, 2, 1), 3: (0, 0, 0, 0, 0), 4: (0, 0, 0, 0, 0)}


def test_confidence_never_falls_with_the_score(spark):
    rows = [(s, s > t) for s in [i / 100 for i in range(100)] for t in (0.3, 0.45, 0.9)] + [(0.35, False)] * 40
    table = grounding.calibration(spark.createDataFrame(rows, "score double, correct boolean"))
    values = [r.confidence for r in table.orderBy("bin").collect()]
    assert values == sorted(values) and len(values) == 10 and sum(r.rows for r in table.collect()) == len(rows)
    got = grounding.with_confidence(spark.createDataFrame([(-1.0,), (0.5,), (7.0,)], "score double"), table).collect()
    assert [r.confidence for r in got] == [values[0], values[5], values[9]] and got[0].level == "low"


def test_quantiles_of_rolled_up_sketches(spark):
    rng = random.Random(6)
    rows = [(d, h, x) for d in range(2) for h in range(5) for x in [rng.lognormvariate(3, 2) for _ in range(200)]] + [(0, 0, None), (0, 1, 0.0), (1, 1, -4.0)] + [(1, 2, 1e9)] * 700
    hours = monitor.sketch(spark.createDataFrame(rows, "day int, hour int, value double"), [F.col("day"), F.col("hour")])
    got = {r.day: r for r in monitor.quantiles(monitor.rolled_up(hours, [F.col("day")]), ["day"], {"a": 0.0, "b": 0.5, "c": 0.99}).collect()}
    for day in (0, 1):
        values = sorted(x for d, _, x in rows if d == day and x is not None)
        assert got[day].rows == len(values)
        for name, q in (("a", 0.0), ("b", 0.5), ("c", 0.99)):
            want = max(values[math.floor(q * (len(values) - 1))], 0.0)
            assert abs(got[day][name] - want) <= monitor.ERROR * want * (1 + 1e-9)


def _plain_cusum(values, baseline, slack, threshold):
    head = values[:baseline]
    mean, spread = statistics.fmean(head), statistics.pstdev(head)
    up = down = 0.0
    out = []
    for i, v in enumerate(values):
        alert = None
        if i >= baseline and spread > 0:
            z, was = (v - mean) / spread, (up, down)
            up, down = max(0.0, up + z - slack), max(0.0, down - z - slack)
            alert = "up" if up > threshold >= was[0] else "down" if down > threshold >= was[1] else None
        out.append((up, down, alert))
    return out


@pytest.fixture(scope="module")
def series():
    rng = random.Random(3)
    start = datetime.datetime(2024, 1, 1)
    levels = {"a": [10] * 30 + [14] * 20 + [3] * 20, "b": [5] * 70, "flat": [1] * 70}
    rows = []
    for key, level in levels.items():
        for h, x in enumerate(level):
            for _ in range(rng.choice([1, 2, 3])):
                rows.append((key, start + datetime.timedelta(hours=h, minutes=rng.randrange(60)), float(x) + (rng.gauss(0, 1) if key != "flat" else 0.0)))
    return rows


def test_cusum_is_the_plain_recursion(spark, series):
    points = alerts.hourly(spark.createDataFrame(series, "key string, ts timestamp, value double"), "key", "ts", "value")
    rows = alerts.batch_alerts(points).orderBy("key", "at").collect()
    for key in ("a", "b", "flat"):
        own = [r for r in rows if r.key == key]
        want = _plain_cusum([r.value for r in own], monitor.BASELINE, monitor.SLACK, monitor.THRESHOLD)
        assert [r.alert for r in own] == [w[2] for w in want]
        assert all(abs(r.up - w[0]) < 1e-6 and abs(r.down - w[1]) < 1e-6 for r, w in zip(own, want, strict=True))
    assert {r.alert for r in rows if r.key == "a"} >= {"up", "down"} and not any(r.alert for r in rows if r.key == "flat")


def test_streamed_alerts_are_the_batch(spark, series, tmp_path):
    """Files in several batches, rows out of order within the lateness, and one that comes too late and counts in neither."""
    kind = "key string, ts timestamp, value double"
    rows = sorted(series, key=lambda r: r[1])
    for i in range(0, len(rows) - 40, 40):
        rows[i : i + 40] = random.Random(i).sample(rows[i : i + 40], 40)
    size = len(rows) // 4 + 1
    batches = [rows[i : i + size] for i in range(0, len(rows), size)]
    late = ("a", rows[0][1], 1e6)
    end = ("end", max(r[1] for r in rows) + datetime.timedelta(days=2), 0.0)
    batches = [*batches[:3], batches[3] + [late], [end], [end]]
    source = str(tmp_path / "in")
    query = None
    for i, b in enumerate(batches):
        spark.createDataFrame(b, kind).coalesce(1).write.mode("append").parquet(source)
        events = spark.readStream.schema(kind).parquet(source)
        writer = alerts.stream_alerts(events, "key", "ts", "value", late="12 hours").writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).outputMode("append").format("parquet").option("path", str(tmp_path / "out"))
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination(120)
        assert query.exception() is None, i
    got = {(r.key, r.at): (round(r.value, 9), round(r.up, 6), round(r.down, 6), r.alert) for r in spark.read.parquet(str(tmp_path / "out")).collect() if r.key != "end"}
    batch = alerts.batch_alerts(alerts.hourly(spark.createDataFrame(rows, kind), "key", "ts", "value"))
    assert got == {(r.key, r.at): (round(r.value, 9), round(r.up, 6), round(r.down, 6), r.alert) for r in batch.collect()}


def test_stability_of_histograms(spark):
    counts = spark.createDataFrame([("k", 1, 0, 50), ("k", 1, 1, 50), ("k", 2, 0, 50), ("k", 2, 1, 50), ("k", 3, 2, 100)], "key string, week int, bin int, n bigint")
    got = {r.week: r.psi for r in monitor.stability(counts, ["key"], "week", "bin").collect()}
    assert got[2] == pytest.approx(0) and got[3] > 4 and set(got) == {2, 3}


def test_last_rating_holds_in_stream_and_batch(spark, tmp_path):
    t = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    kind = "feedback_id bigint, query_id bigint, rating int, correction string, rated_at timestamp"
    rows = [(1, 7, 1, None, t(1)), (2, 7, -1, "no", t(9)), (3, 7, 1, None, t(5)), (2, 7, -1, "no", t(9)), (4, 8, 1, None, t(2)), (5, 8, -1, None, t(2)), (6, None, 1, None, t(3)), (7, 9, None, None, t(3))]
    want = {(7, -1, "no", t(9)), (8, -1, None, t(2))}
    df = spark.createDataFrame(rows, kind)
    assert {tuple(r) for r in alerts.latest_feedback(df).collect()} == want
    for part in (rows[:3], rows[3:]):
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = alerts.latest_feedback(spark.readStream.schema(kind).parquet(str(tmp_path / "in")))
        query = stream.writeStream.format("memory").queryName("ratings").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
        query.awaitTermination(60)
    assert {tuple(r) for r in spark.table("ratings").collect()} == want
    metrics = spark.createDataFrame([(7, True, 0.4), (8, False, 0.9), (10, False, 0.1)], "query_id bigint, fallback boolean, top_score double")
    got = {r.fallback: (r.queries, r.rated, r.liked, r.disliked, r.corrected, r.disliked_score) for r in alerts.feedback_report(metrics, alerts.latest_feedback(df)).collect()}
    assert got == {True: (1, 1, 0, 1, 1, 0.4), False: (2, 1, 0, 1, 0, 0.9)}


def test_expansion_brings_terms_of_the_best_documents(spark):
    docs = spark.createDataFrame([(1, "exam dates january exam room"), (2, "exam dates february hall"), (3, "january weather"), (4, "cooking"), (5, None)], "doc_id bigint, text string")
    asked = spark.createDataFrame([(1, "exam"), (2, "nothing known"), (3, None)], "query_id bigint, text string")
    first = lexical.bm25(asked, docs, 5)
    terms = {(r.query_id, r.term): r.weight for r in lexical.expanded_terms(lexical.query_terms(asked), docs, first, 2, 1).collect()}
    assert terms == {(1, "exam"): pytest.approx(0.6), (1, "dates"): pytest.approx(0.4), (2, "nothing"): pytest.approx(0.3), (2, "known"): pytest.approx(0.3)}
    got = {(r.query_id, r.doc_id) for r in lexical.expanded_search(asked, docs, 5, feedback=2, count=3).collect()}
    assert {(1, 1), (1, 2), (1, 3)} <= got and not any(d in (4, 5) for _, d in got)
    assert lexical.expanded_search(asked.limit(0), docs, 5).count() == 0


def test_latency_is_exact_and_counts_all_rows(spark, tmp_path):
    """Ties, one value, no value, values of 0 and less, unknown times; by q31 and by its SQL."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(3)
    days = {"2024-01-01": [rng.expovariate(0.1) for _ in range(1001)], "2024-01-02": [7.5], "2024-01-03": [None, None], "2024-01-04": [-3.0, 0.0, 0.0, -1.5, 2.0, None], "2024-01-05": [3.0] * 50 + [4.0] * 50, None: [1.0, 2.0, 4.0]}
    rows = [(d and f"{d} 05:00:00", v) for d, values in days.items() for v in values]
    df = spark.createDataFrame(rows, "ts string, value double").withColumn("ts", F.to_timestamp("ts").cast("timestamp_ntz"))
    df.write.parquet(f"file://{tmp_path}/events.parquet")
    got = QUERIES["q31_latency"](spark, f"file://{tmp_path}")
    want = duckdb.sql(SQL["q31_latency"].replace("from events", f"from '{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert sorted(map(repr, map(tuple, got.select("day", "queries", "fallback_rate", "p50", "p95", "p99").collect()))) == sorted(map(repr, want))
    whole = monitor.exact_quantiles(df, "ts", {"low": 0.0, "top": 1.0}).where("ts = timestamp'2024-01-01 05:00:00'").first()
    assert (whole.low, whole.top) == (min(days["2024-01-01"]), max(days["2024-01-01"]))


def test_only_words_of_the_answer_become_rows(spark, monkeypatch):
    """Long contexts: what meets the claims is no more than the words of the answers, a context."""
    met = []
    distinct = type(spark.range(0)).distinct
    monkeypatch.setattr(type(spark.range(0)), "distinct", lambda df: met.append(df.count()) or distinct(df))
    answers = spark.createDataFrame([(1, "Paris has 20 districts. Lyon none"), (2, None)], "query_id bigint, answer string")
    context = spark.createDataFrame([(1, "in paris HAS the 20 " + " ".join(f"w{i}" for i in range(3000))), (1, "districts, lyon"), (1, None), (2, "x"), (3, "y")], "query_id bigint, text string")
    got = {r.claim: (r.words, r.found, r.missing, r.grounded) for r in grounding.grounded_claims(answers, context).collect()}
    assert got == {0: (4, 4, [], True), 1: (2, 1, [], False)}
    assert met == [5]
