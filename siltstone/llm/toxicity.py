"""Toxicity by a classifier chain over sparse word features.

The chain predicts categories one after another with logistic models. Each model sees
how often selected features (words and word beginnings of 4, 5 and 6 bytes) occur, and the
probabilities of the categories before it; in training these are out-of-fold, from models whose
features were selected without the fold as well, so that a later model meets probabilities as
honest as at prediction. Labels give one verdict, ``toxic``, the chain's last link. The
categories before it come from the labelled rows: features that tell toxic rows apart are put
in CATEGORIES groups by the rows they stand in together, and a toxic row is of every category of
which it has a feature. So each language, and each way of being toxic, finds a group of its own.

Features are selected from, and models are fitted on, at most SAMPLE labelled documents
(those whose id hashes lowest); every document is scored on its whole text, in one pass
without a shuffle. The models of a category are fitted in tasks, one for each fold and one for
all rows; the driver holds only places and counts of the sample's features.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from siltstone.llm import kernel as K
from siltstone.llm.rows import ROW, append, with_row
from siltstone.llm.scratch import discard, materialize

#: Labelled documents that models are fitted on at most.
SAMPLE = 20_000
#: Features of the models, and toxic documents that a feature must occur in.
FEATURES, SUPPORT = 512, 4
PREFIXES = (4, 5, 6)
FOLDS, RIDGE = 5, 0.1
#: Rows that a Newton step takes at a time.
BLOCK = 2_048
#: Probability of ``toxic`` from which a document is rejected.
THRESHOLD = 0.5
#: Groups of features before ``toxic``.
CATEGORIES = 4
CHAIN = [*(f"group{i + 1}" for i in range(CATEGORIES)), "toxic"]


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, feature) of every word and word beginning of the rows, repeated as they occur."""
    text = K.LOWER[data]
    starts, ends, first = K.word_spans(text, offsets, K.ALNUM)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    rows, found = [owner], [K.span_hashes(text, starts, ends)]
    for i, size in enumerate(PREFIXES):
        long = ends - starts > size
        rows.append(owner[long])
        found.append(K.mix(K.span_hashes(text, starts[long], starts[long] + size) + K.U64(i + 1)))
    return np.concatenate(rows), np.concatenate(found)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 12) -> np.ndarray:
    """Ridge logistic regression by Newton steps; the last coefficient is the intercept."""
    penalty = np.full(x.shape[1] + 1, RIDGE)
    penalty[-1] = 1e-6
    b = np.zeros(len(penalty))
    for _ in range(rounds):
        gradient, hessian = penalty * b, np.diag(penalty)
        for i in range(0, len(x), BLOCK):
            x1, w = np.concatenate([x[i : i + BLOCK], np.ones((len(x[i : i + BLOCK]), 1))], axis=1), weight[i : i + BLOCK]
            p = sigmoid(x1 @ b)
            gradient += x1.T @ (w * (p - y[i : i + BLOCK]))
            hessian += (x1 * (w * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x1
        step = np.linalg.solve(hessian, gradient)
        b = b - step * min(1.0, 4.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    return b


@dataclass
class Occurrences:
    """Places of the features that each row has, and how often, all rows end to end."""

    lengths: np.ndarray
    at: np.ndarray
    times: np.ndarray

    def dense(self, rows: np.ndarray, columns: np.ndarray) -> np.ndarray:
        """log(1 + times) of the chosen rows (flags) and features (places)."""
        place = np.full(max(self.at.max(initial=0), columns.max(initial=0)) + 1, -1)
        place[columns] = np.arange(len(columns))
        hit = np.flatnonzero(np.repeat(rows, self.lengths) & (place[self.at] >= 0))
        out = np.zeros((np.count_nonzero(rows), len(columns)))
        out[np.repeat(np.cumsum(rows) - 1, self.lengths)[hit], place[self.at[hit]]] = np.log1p(self.times[hit])
        return out


def link(x: np.ndarray | Occurrences, fold: np.ndarray, weight: np.ndarray, columns: list[np.ndarray], y: np.ndarray, before: np.ndarray, f: int) -> tuple[np.ndarray, np.ndarray] | None:
    """The model of y without fold f and its probabilities of that fold's rows (None without such rows); for FOLDS, that of all rows."""
    out = fold == f
    if f < FOLDS and not out.any():
        return None

    def own(rows: np.ndarray) -> np.ndarray:
        found = x.dense(rows, columns[f]) if isinstance(x, Occurrences) else x[np.ix_(rows, columns[f])]
        return np.concatenate([found, before[rows]], axis=1)

    rest = ~out if (~out).any() else out
    b = logistic(own(rest), y[rest], weight[rest])
    return b, sigmoid(own(out) @ b[:-1] + b[-1])


#: Of a category's verdicts and the probabilities before it: what ``link`` gives for each fold and for FOLDS.
Links = Callable[[np.ndarray, np.ndarray], list]


@contextmanager
def links_in_tasks(spark: SparkSession, x: Occurrences, fold: np.ndarray, weight: np.ndarray, columns: list[np.ndarray]) -> Iterator[Links]:
    """Each of a category's models is fitted in a task of its own."""
    sent = spark.sparkContext.broadcast((x, fold, weight, columns))

    def links(y: np.ndarray, before: np.ndarray) -> list:
        return spark.sparkContext.parallelize(range(FOLDS + 1), FOLDS + 1).map(lambda f: link(*sent.value, y, before, f)).collect()

    try:
        yield links
    finally:
        sent.destroy()


@dataclass
class Chain:
    """Features (sorted hashes) and the models of a fitted chain."""

    features: np.ndarray
    models: list[np.ndarray]

    def predict(self, x: np.ndarray) -> np.ndarray:
        """A column of probabilities for each category."""
        out = np.zeros((len(x), 0))
        for b in self.models:
            z = np.concatenate([x, out], axis=1) @ b[:-1] + b[-1]
            out = np.concatenate([out, sigmoid(z)[:, None]], axis=1)
        return out

    @classmethod
    def fit(cls, names: np.ndarray, x: np.ndarray | Occurrences, y: np.ndarray, fold: np.ndarray, weight: np.ndarray, columns: list[np.ndarray], links: Links | None = None) -> Chain:
        """x: features (of sorted ``names``), y: a column for each category; a row stands for ``weight`` documents.

        ``columns`` are the features that may be used without fold 0, 1, ..., and those of the final models.
        ``links`` fits a category's models; by default they are fitted here.
        """
        links = links or (lambda y, before: [link(x, fold, weight, columns, y, before, f) for f in range(FOLDS + 1)])
        models, before = [], np.zeros((len(fold), 0))
        for j in range(y.shape[1]):
            held = np.zeros(len(fold))
            *parts, (model, _) = links(y[:, j], before)
            for f, part in enumerate(parts):
                if part:
                    held[fold == f] = part[1]
            models.append(model)
            before = np.concatenate([before, held[:, None]], axis=1)
        return cls(names[columns[-1]], models)


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def groups(present: np.ndarray, k: int, rounds: int = 20) -> np.ndarray:
    """The group of each feature (column) by the rows in which it is present: k-means by cosine.

    The first centres are frequent features that stand together with none of the centres before them.
    """
    norm = np.linalg.norm(present, axis=0)
    v = (present / np.maximum(norm, 1e-12)).T
    if not len(v):
        return np.zeros(0, dtype=np.int64)
    centres, near = [], np.zeros(len(v))
    for _ in range(min(k, len(v))):
        centres.append(v[np.argmax((1 - near) * norm)])
        near = np.maximum(near, v @ centres[-1])
    c = np.array(centres)
    own = np.zeros(len(v), dtype=np.int64)
    for _ in range(rounds):
        now = np.argmax(v @ c.T, axis=1)
        if (now == own).all() and _:
            break
        own = now
        for g in range(len(c)):
            if (own == g).any():
                mean = v[own == g].sum(axis=0)
                c[g] = mean / max(np.linalg.norm(mean), 1e-12)
    return own


def sample_texts(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, sample: int) -> DataFrame:
    """(id, label, text) of the sampled labelled documents; the sample's ids are sent to the documents."""
    known = labels.where(f"{id_col} is not null and {label_col} is not null").groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    chosen = known.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(F.col(id_col).alias("id"), "label")
    return docs.select(docs[f"`{id_col}`"].alias("id"), docs[f"`{text_col}`"].alias("text")).join(F.broadcast(chosen), "id")


def fit_chain(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample: int = SAMPLE) -> Chain | None:
    """The chain, or None if there is no toxic or no other labelled document."""
    texts = sample_texts(docs, labels, id_col, text_col, label_col, sample)
    counts = StructType([StructField("feature", LongType()), StructField("fold", IntegerType()), StructField("pos", LongType()), StructField("neg", LongType())])

    def fold_of(ids):
        return np.array([zlib.crc32(str(i).encode()) % FOLDS for i in ids.to_pylist()], dtype=np.int32)

    def count(batches):
        for batch in batches:
            toxic, fold = batch.column("label").to_numpy() == 1, fold_of(batch.column("id"))
            for row, data, offsets in K.slices(batch.column("text")):
                owner, feature = features(data, offsets)
                n = len(offsets) - 1
                # feature 0 counts the documents
                owner, feature = np.concatenate([owner, np.arange(n)]), np.concatenate([feature, np.zeros(n, np.uint64)])
                order = np.lexsort((feature, owner))
                owner, feature = owner[order] + row, feature[order]
                new = np.concatenate(([True], (owner[1:] != owner[:-1]) | (feature[1:] != feature[:-1])))
                owner, feature = owner[new], feature[new]
                order = np.lexsort((fold[owner], feature))
                owner, feature = owner[order], feature[order]
                start = np.flatnonzero(np.concatenate(([True], (feature[1:] != feature[:-1]) | (fold[owner[1:]] != fold[owner[:-1]]))))
                pos = np.add.reduceat(toxic[owner].astype(np.int64), start)
                every = np.diff(np.append(start, len(owner)))
                yield pa.RecordBatch.from_arrays([pa.array(feature[start].view(np.int64)), pa.array(fold[owner[start]]), pa.array(pos), pa.array(every - pos)], counts.names)

    by_fold = [F.sum(F.when(F.col("fold") == f, F.col(c))) for f in range(FOLDS) for c in ("pos", "neg")]
    sums = [F.coalesce(s, F.lit(0)).alias(f"{c}{f}") for s, (f, c) in zip(by_fold, [(f, c) for f in range(FOLDS) for c in ("pos", "neg")], strict=True)]
    summed = materialize(texts.mapInArrow(count, counts).groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), *sums).where(f"feature = 0 or pos >= {SUPPORT}"), "features")
    total = summed.where("feature = 0").first()
    if not total or not total["pos"] or not total["neg"]:
        return None
    # how far the shares of toxic and other documents with the feature are apart, in standard errors
    tops = []
    for f in range(FOLDS + 1):
        less = lambda c: f"({c} - {c}{f})" if f < FOLDS else c  # noqa: B023, E731
        p, n = (max(total[c] - (total[f"{c}{f}"] if f < FOLDS else 0), 1) for c in ("pos", "neg"))
        share = f"({less('pos')} + {less('neg')}) / {p + n}"
        z = F.expr(f"({less('pos')} / {p} - {less('neg')} / {n}) / sqrt(greatest({share} * (1 - {share}), 1e-12) * (1 / {p} + 1 / {n}))")
        best = summed.where(f"feature <> 0 and {less('pos')} >= {SUPPORT}").withColumn("z", z).where("z > 3").orderBy(F.desc("z"), "feature").limit(FEATURES)
        tops.append(best.select(F.lit(f).alias("without"), "feature"))
    chosen = reduce(DataFrame.union, tops).collect()  # a bounded number of features for each fold
    discard(summed)
    names = np.unique(np.array([r["feature"] for r in chosen], dtype=np.int64).view(np.uint64))
    columns = [np.searchsorted(names, np.sort(np.array([r["feature"] for r in chosen if r["without"] == f], dtype=np.int64).view(np.uint64))) for f in range(FOLDS + 1)]
    if not len(columns[-1]):
        return None
    rows = StructType([StructField("fold", IntegerType()), StructField("label", IntegerType()), StructField("at", ArrayType(IntegerType())), StructField("times", ArrayType(IntegerType()))])

    def occurrences(batches):
        for batch in batches:
            fold, label = fold_of(batch.column("id")), batch.column("label")
            for row, data, offsets in K.slices(batch.column("text")):
                n = len(offsets) - 1
                at, times = matches(names, *features(data, offsets), n)
                yield pa.RecordBatch.from_arrays([pa.array(fold[row : row + n]), label.slice(row, n), pa.array(at, pa.list_(pa.int32())), pa.array(times, pa.list_(pa.int32()))], rows.names)

    # at most the sample; as Arrow, since rows of lists fill the driver's heap with an object for each number
    got = texts.mapInArrow(occurrences, rows).groupBy(*rows.names).agg(F.count(F.lit(1)).alias("c")).toArrow().combine_chunks()
    x = Occurrences(pc.list_value_length(got["at"]).to_numpy(), *(pc.list_flatten(got[c]).to_numpy() for c in ("at", "times")))
    fold, label, weight = (got[c].to_numpy() for c in ("fold", "label", "c"))
    toxic = label == 1
    final = x.dense(toxic, columns[-1]) > 0
    group = groups(final * np.sqrt(weight[toxic])[:, None], CATEGORIES)
    y = np.zeros((len(label), CATEGORIES + 1), dtype=int)
    y[:, -1] = label
    y[toxic, :-1] = np.stack([final[:, group == g].any(axis=1) for g in range(CATEGORIES)], axis=1)
    with links_in_tasks(docs.sparkSession, x, fold, weight, columns) as links:
        return Chain.fit(names, x, y, fold, weight, columns, links)


def matches(selected: np.ndarray, owner: np.ndarray, feature: np.ndarray, n: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Places among the sorted selected features that each row has, ascending, and how often."""
    if not len(selected):
        return [np.zeros(0, np.int32)] * n, [np.zeros(0, np.int32)] * n
    at = np.minimum(np.searchsorted(selected, feature), len(selected) - 1)
    hit = selected[at] == feature
    pairs, times = np.unique(owner[hit].astype(np.int64) * len(selected) + at[hit], return_counts=True)
    rows = pairs // len(selected)
    cuts = np.searchsorted(rows, np.arange(n + 1))
    places, times = (pairs % len(selected)).astype(np.int32), times.astype(np.int32)
    return [places[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], [times[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def score_toxicity(docs: DataFrame, chain: Chain | None, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns) and a probability column for each category.

    Null and empty texts, and texts without a selected feature, get the chain's base
    probabilities; repeated rows are scored one by one, very long texts whole; an empty table
    gives no rows, and the caller's columns may have any names. Without a chain (no labels of
    both kinds, or no feature that tells them apart) every probability is 0. Features that tell
    equally well are taken in order of their hashes.
    """

    def fn(batch):
        for row, data, offsets in K.slices(batch.column("text")):
            n = len(offsets) - 1
            if chain is None:
                p = np.zeros((n, len(CHAIN)))
            else:
                at, times = matches(chain.features, *features(data, offsets), n)
                base = chain.predict(np.zeros((1, len(chain.features))))
                p = np.repeat(base, n, axis=0)
                some = [i for i, a in enumerate(at) if len(a)]
                if some:
                    x = np.zeros((len(some), len(chain.features)))
                    for k, i in enumerate(some):
                        x[k, at[i]] = np.log1p(times[i])
                    p[some] = chain.predict(x)
            yield row, n, {f"p_{c}": pa.array(p[:, j].copy()) for j, c in enumerate(CHAIN)}

    return append(with_row(docs, {"text": text_col}, keep), fn, [StructField(f"p_{c}", DoubleType()) for c in CHAIN])


def toxicity_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, the probability of each category and ``toxic`` (rejected) of every document."""
    scored = score_toxicity(docs, fit_chain(docs, labels), keep=["doc_id"])
    return scored.select(F.col(f"{ROW}.doc_id").alias("doc_id"), *[f"p_{c}" for c in CHAIN], (F.col("p_toxic") >= THRESHOLD).alias("toxic"))


def civil_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, with their own columns."""
    return score_toxicity(docs, fit_chain(docs, labels)).where(F.col("p_toxic") < THRESHOLD).select(f"{ROW}.*")
