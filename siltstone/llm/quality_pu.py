"""Quality classifier from positive and unlabelled text, by non-negative risk.

Trusted positives are documents labelled 1; everything else is a mixture of good and
bad text. A linear model f on text statistics minimises the non-negative unbiased risk

    prior * E_P[l(f)] + max(0, E_U[l(-f)] - prior * E_P[l(-f)])

with the logistic loss l, so its sigmoid estimates the chance of being good. The class
prior is estimated from classifiers of positives against unlabelled text: above any score
the share of unlabelled text over the share of positives is no smaller than the prior, and
the ratio that is smallest with a margin for sampling estimates it. Positives are scored by
classifiers that were fitted without them (CROSS folds): scores of a classifier's own rows are
too high, and the prior would come out too low.

One pass over the whole texts leaves the statistics of every document: thirteen counts, and
the shares of its words in HASHED groups by hash. Risks, gradients and curvatures of unlabelled
text are sums over all of them, a pass for each Newton step, as are centre, scale and the
prior's tail shares; of labelled positives at most SAMPLE are taken (those whose id hashes lowest).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, FloatType, StructField, StructType

from siltstone.llm import kernel as K
from siltstone.llm.rows import ROW, append, with_row
from siltstone.llm.scratch import materialize

#: Labelled positives that are learnt from at most.
SAMPLE = 20_000
#: Score from which a document is predicted to be good.
THRESHOLD = 0.7
#: Remainder of crc32(doc_id) modulo 4 of the documents whose labels are never learnt.
HELD_OUT = 2
#: Newton steps at most, longest step of a weight, weight of the squared weights, and groups of words.
ROUNDS, REACH, RIDGE, HASHED = 40, 2.0, 0.02, 16
#: Folds of the positives for the prior.
CROSS = 3

NAMES = ["symbols", "shouts", "capitals", "digits", "word_length", "words", "variety", "stutter", "repeats", "same_lines", "stops", "marks", "short_words", *(f"words{i}" for i in range(HASHED))]
_SYMBOL = np.isin(np.arange(256), [ord(c) for c in "#*$%&|<>"])
_MARK = np.array([chr(b).isascii() and chr(b).isprintable() and not chr(b).isalnum() and b != 32 for b in range(256)])
_LINE = np.arange(256) != 10


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of NAMES for each text; all 0 for texts without words."""

    def per_row(flags: np.ndarray) -> np.ndarray:
        total = np.concatenate(([0], np.cumsum(flags)))
        return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)

    n = len(offsets) - 1
    capital = (data >= 0x41) & (data <= 0x5A)
    if len(data) > 1:  # capitals of Latin-1 letters are C3 80..9E in UTF-8
        capital[:-1] |= (data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)
    letters = per_row((data & 0xC0) != 0x80)
    text = K.LOWER[data]
    starts, ends, first = K.word_spans(text, offsets, K.NON_SPACE)
    hashes = K.span_hashes(text, starts, ends)
    words = np.diff(first).astype(float)
    some, chars = np.maximum(words, 1), np.maximum(letters, 1)
    owner = np.repeat(np.arange(n), np.diff(first))
    again = np.zeros(len(hashes) + 1, bool)
    again[1:-1] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    grams = K.shingle_hashes(hashes, 5)
    ls, le, lf = K.word_spans(data, offsets, _LINE)
    lines = K.span_hashes(data, ls, le)
    variety, repeats, same = np.zeros(n), np.zeros(n), np.zeros(n)
    for i in range(n):
        a, b = first[i], first[i + 1]
        if b - a > 1:
            variety[i] = np.log(len(np.unique(hashes[a:b]))) / np.log(b - a)
        if b - a > 5:
            repeats[i] = 1 - len(np.unique(grams[a : b - 4])) / (b - a - 4)
        if lf[i + 1] - lf[i] > 1:
            same[i] = 1 - len(np.unique(lines[lf[i] : lf[i + 1]])) / (lf[i + 1] - lf[i])
    short = np.concatenate(([0], np.cumsum(ends - starts <= 3)))
    stutter = np.concatenate(([0], np.cumsum(again[:-1])))
    shares = np.zeros((n, HASHED))
    np.add.at(shares, (owner, (hashes >> K.U64(40)).astype(np.int64) % HASHED), 1.0)
    out = np.concatenate([np.stack([
        per_row(_SYMBOL[data]) / some, per_row(data == 0x21) / some, per_row(capital) / chars, per_row((data >= 0x30) & (data <= 0x39)) / chars,
        letters / some / 10, np.log1p(words) / 10, np.where(words > 1, variety, 1.0), (stutter[first[1:]] - stutter[first[:-1]]) / some, repeats, same,
        per_row(data == 0x2E) / some, per_row(_MARK[data]) / some, (short[first[1:]] - short[first[:-1]]) / some,
    ], axis=1), shares / some[:, None]], axis=1)
    out[words == 0] = 0
    return out


def expand(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """Standardised statistics, clipped, with the distances above and below the usual and an intercept."""
    z = np.clip((x - centre) / scale, -8, 8)
    far = np.maximum(np.abs(z) - 3, 0)
    return np.concatenate([z, far, np.ones((len(z), 1))], axis=1)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: Of weights, over unlabelled rows: how many there are, summed loss l(-f), its gradient and its curvature.
Sums = Callable[[np.ndarray], tuple[int, float, np.ndarray, np.ndarray]]


def sums_of(u: np.ndarray, b: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    s = sigmoid(u @ b)
    return len(u), float(np.logaddexp(0, u @ b).sum()), u.T @ s, (u * (s * (1 - s))[:, None]).T @ u


def risk(p: np.ndarray, sums: tuple, b: np.ndarray, share: float, taken: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Value, gradient and curvature of share * E_P[l(f)] + max(0, E_U[l(-f)] - taken * E_P[l(-f)]) with a ridge."""
    n, loss, slope, bend = sums
    s = sigmoid(p @ b)
    own = (p * (s * (1 - s))[:, None]).T @ p / len(p)
    value, gradient, curvature = share * np.mean(np.logaddexp(0, -(p @ b))), share * (p.T @ (s - 1)) / len(p), share * own
    rest = loss / n - taken * np.mean(np.logaddexp(0, p @ b))
    if rest > 0:
        value, gradient, curvature = value + rest, gradient + slope / n - taken * (p.T @ s) / len(p), curvature + bend / n - taken * own
    return value + RIDGE / 2 * (b @ b), gradient + RIDGE * b, curvature + RIDGE * np.eye(len(b))


def minimise(p: np.ndarray, sums: Sums, share: float, taken: float, start: np.ndarray | None = None) -> np.ndarray:
    """Weights of the least risk by Newton steps from ``start``, cut down where they would raise it."""
    b = best = np.zeros(p.shape[1]) if start is None else start
    least, step, part = np.inf, np.zeros(p.shape[1]), 1.0
    for _ in range(ROUNDS):
        value, gradient, curvature = risk(p, sums(b), b, share, taken)
        if value <= least:
            gained, least, best, part = least - value, value, b, 1.0
            step = np.linalg.solve(curvature, gradient)
            step *= min(1.0, REACH / max(1e-12, np.abs(step).max()))
            if gained < 1e-7 or np.abs(step).max() < 1e-4:
                break
        elif (part := part / 4) < 1e-3:
            break
        b = best - part * step
    return best


def tail_cuts(p: np.ndarray) -> np.ndarray:
    """Scores above which shares are compared, ascending."""
    return np.quantile(p, np.linspace(0, 0.9, 91))


def counts_from(u: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of u reach each of the ascending cuts."""
    reached = np.bincount(np.searchsorted(cuts, u, side="right"), minlength=len(cuts) + 1)
    return reached[::-1].cumsum()[::-1][1:]


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Share of positives among unlabelled scores u, given scores p of positives that the scores were not fitted on."""
    return prior_of([p], [counts_from(u, tail_cuts(p))], len(u))


def prior_of(folds: list[np.ndarray], reached: list[np.ndarray], n: int) -> float:
    """The same over folds, given how many of n unlabelled scores reach each cut of each fold."""
    tail_p = np.mean([counts_from(p, tail_cuts(p)) / len(p) for p in folds], axis=0)
    tail_u = np.mean(reached, axis=0) / n
    margin = np.sqrt(np.log(4 / 0.1) / 2) * (1 / np.sqrt(sum(map(len, folds))) + 1 / np.sqrt(n))
    best = np.argmin((tail_u + margin) / tail_p)
    return float(np.clip(tail_u[best] / tail_p[best], 0.05, 0.99))


class PositiveUnlabelled:
    """The fitted model: ``score`` of statistics, and the estimated prior.

    ``quantiles`` (the 0.1, 0.5 and 0.9 quantile of each statistic), ``tails`` (of weights and cuts:
    how many documents reach each cut, and how many there are) and ``sums`` are of the whole corpus.
    """

    def __init__(self, positive: np.ndarray, quantiles: np.ndarray, sums: Callable[[PositiveUnlabelled, np.ndarray], tuple], tails: Callable[[PositiveUnlabelled, np.ndarray, np.ndarray], tuple[np.ndarray, int]]):
        low, self.centre, high = quantiles
        self.scale = np.maximum((high - low) / 2, 0.01)
        p, over = expand(positive, self.centre, self.scale), partial(sums, self)
        first = minimise(p, over, 1.0, 0.0)
        part = np.arange(len(p)) % min(CROSS, len(p))
        held, reached, n = [], [], 0
        for f in range(part.max() + 1):
            own = minimise(p[part != f], over, 1.0, 0.0, first) if part.max() else first  # one positive alone has no others
            held.append(p[part == f] @ own)
            counts, n = tails(self, own, tail_cuts(held[-1]))
            reached.append(counts)
        self.prior = prior_of(held, reached, n)
        self.weights = minimise(p, over, self.prior, self.prior)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(expand(x, self.centre, self.scale) @ self.weights)


def fold(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4, F.lit(0))


def text_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns) and ``x``, the statistics of every whole text."""

    def fn(batch):
        for row, data, offsets in K.slices(batch.column("text")):
            yield row, len(offsets) - 1, {"x": pa.array(list(statistics(data, offsets).astype(np.float32)), pa.list_(pa.float32()))}

    return append(with_row(docs, {"text": text_col}, keep), fn, [StructField("x", ArrayType(FloatType()))])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), len(NAMES))


def corpus_quantiles(stats: DataFrame) -> np.ndarray:
    """The 0.1, 0.5 and 0.9 quantile of each statistic over all rows, to 1/10,000 of the rows."""
    row = stats.select(*(F.percentile_approx(F.col("x")[i], [0.1, 0.5, 0.9], 10_000) for i in range(len(NAMES)))).first()
    return np.array(row, dtype=float).T


def corpus_tails(stats: DataFrame, model: PositiveUnlabelled, weights: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """How many rows' scores by the weights reach each cut, and how many rows there are."""
    centre, scale = model.centre, model.scale

    def run(batches):
        reached, n = np.zeros(len(cuts), np.int64), 0
        for batch in batches:
            reached += counts_from(expand(_matrix(batch.column("x")), centre, scale) @ weights, cuts)
            n += batch.num_rows
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(cuts) + 1)), pa.array([*reached.tolist(), n], pa.int64())], ["cut", "n"])

    counted = stats.select("x").mapInArrow(run, "cut bigint, n bigint").groupBy("cut").agg(F.sum("n").alias("n"))
    counts = dict(tuple(r) for r in counted.collect())
    return np.array([counts[i] for i in range(len(cuts))]), counts[len(cuts)]


def corpus_sums(stats: DataFrame, model: PositiveUnlabelled, weights: np.ndarray) -> tuple[int, float, np.ndarray, np.ndarray]:
    """``sums_of`` over all rows: partial sums in the tasks, then sums by cell."""
    centre, scale, size = model.centre, model.scale, len(weights)

    def run(batches):
        total = np.zeros(2 + size + size * size)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                n, loss, slope, bend = sums_of(expand(_matrix(batch.column("x").slice(at, 4096)), centre, scale), weights)
                total += np.concatenate([[n, loss], slope, bend.ravel()])
        if total[0]:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], ["cell", "v"])

    got = stats.select("x").mapInArrow(run, "cell bigint, v double").groupBy("cell").agg(F.sum("v").alias("v")).toArrow().sort_by("cell").column("v").to_numpy()
    return int(got[0]), float(got[1]), got[2 : 2 + size], got[2 + size :].reshape(size, size)


def score_quality(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score and predicted of every document.

    Labels are learnt from documents outside the held-out remainder only, and only the
    value 1 is used, of at most ``sample`` documents; unlabelled text is every document outside it.
    Null and empty texts have statistics of 0 and get a score like all others; very long texts are
    read whole; a null doc_id is not held out and not learnt from; documents that repeat are scored
    one by one; a document labelled more than once is positive if all its labels are 1; without
    positives every score is 0; an empty table gives no rows. Centre and scale of the statistics and
    the tail shares of the prior, which need no labels, are of all documents. Other columns are not
    looked at, whatever their names.
    """
    stats = materialize(text_statistics(docs, keep=["doc_id"]).select(F.col(f"{ROW}.doc_id").alias("doc_id"), "x"), "statistics")
    learn = stats.where(F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != HELD_OUT))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("q")).where("q = 1").select("doc_id")
    chosen = good.where(fold(F.col("doc_id")) != HELD_OUT).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    positive = learn.join(F.broadcast(chosen), "doc_id").select("x").toArrow().column("x")
    model = None
    if len(positive):
        model = PositiveUnlabelled(_matrix(positive.combine_chunks()), corpus_quantiles(stats), partial(corpus_sums, learn), partial(corpus_tails, stats))

    def run(batches):
        for batch in batches:
            x = _matrix(batch.column("x"))
            score = model.score(x) if model else np.zeros(len(x))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(score)], ["doc_id", "score"])

    scored = stats.mapInArrow(run, StructType([stats.schema["doc_id"], StructField("score", DoubleType())]))
    return scored.select("doc_id", (fold(F.col("doc_id")) == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
