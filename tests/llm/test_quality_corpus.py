"""What op7 takes from the whole corpus does not depend on its samples."""

import random

import numpy as np
import pytest

from siltstone.llm import quality_pu


def test_centre_scale_and_prior_are_of_all_documents(spark, monkeypatch):
    rng = random.Random(3)
    texts = [" ".join(rng.choices(["Plain", "words", "of", "a", "text.", "12", "!!", "#x#"], k=rng.randrange(1, 80))) for _ in range(500)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(5)
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id bigint, quality int")
    fitted, priors = [], []

    class Kept(quality_pu.PositiveUnlabelled):
        def __init__(self, *args):
            super().__init__(*args)
            fitted.append(self)

    def prior_of(p, reached, n, of=getattr(quality_pu, "prior_of", None)):
        priors.append((reached, n))
        return of(p, reached, n)

    monkeypatch.setattr(quality_pu, "PositiveUnlabelled", Kept)
    monkeypatch.setattr(quality_pu, "prior_of", prior_of, raising=False)
    assert quality_pu.score_quality(df, labels, sample=20).count() == 500
    data = [t.encode() for t in texts]
    x = quality_pu.statistics(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])).astype(np.float32).astype(float)
    low, middle, high = np.quantile(x, [0.1, 0.5, 0.9], axis=0, method="inverted_cdf")
    assert fitted[0].centre == pytest.approx(middle)
    assert fitted[0].scale == pytest.approx(np.maximum((high - low) / 2, 0.01))
    reached, n = priors[0]
    assert n == 500 and len(reached) == quality_pu.CROSS and all(r[0] > 20 and all(np.diff(r) <= 0) for r in reached)


def test_counts_above_cuts():
    u, cuts = np.array([0.0, 1, 1, 2, 5]), np.array([0.5, 1, 1, 2, 9])
    assert quality_pu.counts_from(u, cuts).tolist() == [(u >= c).sum() for c in cuts]


def test_least_risk_against_a_plain_loop():
    """Newton's weights beat many small steps of plain gradient descent, and the gradient is that of the value."""
    rng = np.random.default_rng(2)
    p, u = rng.normal(0.7, 1, (300, 3)), np.concatenate([rng.normal(0.7, 1, (400, 3)), rng.normal(-0.7, 1, (600, 3))])
    p, u = (np.concatenate([x, np.ones((len(x), 1))], axis=1) for x in (p, u))
    for share, taken in ((1.0, 0.0), (0.4, 0.4)):
        value = lambda b, t=taken, s=share: quality_pu.risk(p, quality_pu.sums_of(u, b), b, s, t)
        best = quality_pu.minimise(p, lambda b: quality_pu.sums_of(u, b), share, taken)
        b = np.zeros(4)
        for _ in range(3000):
            b = b - 0.3 * value(b)[1]
        plain = sum(np.log1p(np.exp(-x @ b)) for x in p) / len(p) * share + max(0, sum(np.log1p(np.exp(x @ b)) for x in u) / len(u) - taken * sum(np.log1p(np.exp(x @ b)) for x in p) / len(p)) + quality_pu.RIDGE / 2 * (b @ b)
        assert value(b)[0] == pytest.approx(plain) and value(best)[0] <= plain + 1e-5
        for i in range(4):
            d = np.eye(4)[i] * 1e-5
            assert (value(b + d)[0] - value(b - d)[0]) / 2e-5 == pytest.approx(value(b)[1][i], abs=1e-5)


def test_sums_and_edge_cases(spark):
    rng = np.random.default_rng(5)
    x = np.abs(rng.normal(0, 1, (50, len(quality_pu.NAMES)))).astype(np.float32)
    stats = spark.createDataFrame([(r.tolist(),) for r in x], "x array<float>").repartition(4)

    class Model:
        centre, scale = np.zeros(x.shape[1]), np.ones(x.shape[1])

    u = quality_pu.expand(x.astype(float), Model.centre, Model.scale)
    b = rng.normal(0, 0.1, u.shape[1])
    for got, expected in zip(quality_pu.corpus_sums(stats, Model, b), quality_pu.sums_of(u, b), strict=True):
        assert np.allclose(got, expected)
    docs = spark.createDataFrame([(1, "a text"), (None, None), (2, "")], "doc_id bigint, text string")
    labels = spark.createDataFrame([(1, 1), (None, 1), (2, None)], "doc_id bigint, quality int")
    assert quality_pu.score_quality(docs, labels).count() == 3
    assert quality_pu.score_quality(docs.limit(0), labels).count() == 0
