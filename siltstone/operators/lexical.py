"""BM25 of a batch of queries, and its mixture with vector scores."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from siltstone.operators.search import DIGITS, Best, ranked
from siltstone.sources.store import staged

K1, B = 1.2, 0.75
#: Cells of the matrix of terms and queries that is sent to all tasks at once; more queries go in blocks.
BLOCK_CELLS = 4 << 20
#: Documents whose scores are held at once.
TILE = 256


def terms(text):
    return F.filter(F.split(F.lower(text), r"[^0-9\p{L}]+"), lambda t: t != "")


def query_terms(queries: DataFrame, query_id: str = "query_id") -> DataFrame:
    """(query_id, term, weight): the distinct terms of each query, all of weight 1."""
    return queries.select(query_id, F.explode(F.array_distinct(terms("text"))).alias("term"), F.lit(1.0).alias("weight"))


def tokenised(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, t): the terms of each document; documents that are so already stay."""
    return docs if "t" in docs.columns else docs.select(doc_id, terms("text").alias("t"))


def bm25(queries: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """(query_id, doc_id, score, rank) of the best k documents of each query (columns: id, text), ties by id."""
    return bm25_terms(query_terms(queries, query_id), docs, k, query_id, doc_id)


def bm25_terms(asked: DataFrame, docs: DataFrame, k: int, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The same for weighted terms (query_id, term, weight), whose scores are multiplied by their weights.

    Document frequencies of the queries' terms are counted with partial sums. Then each task
    multiplies the terms of each of its documents with a block of queries and keeps its own best
    k, so no postings are shuffled and a frequent term is no hot key. Scores are rounded before
    they are ranked. Null texts have no terms; a query without a known term has no hits.
    """
    schema = StructType([asked.schema[query_id], docs.schema[doc_id], StructField("score", DoubleType())])
    spark = docs.sparkSession
    sized = tokenised(docs, doc_id)
    total = sized.agg(F.count(F.lit(1)).alias("docs"), F.avg(F.greatest(F.size("t"), F.lit(0))).alias("mean")).first()
    seen = sized.select(F.explode(F.array_distinct("t")).alias("term")).join(asked.select("term").distinct(), "term", "left_semi")
    found = asked.join(seen.groupBy("term").agg(F.count(F.lit(1)).alias("df")), "term").groupBy(query_id).agg(F.collect_list(F.struct("term", "df", "weight")).alias("terms"))

    def scored(block):
        vocabulary = sorted({t for _, own in block for t, _, _ in own})
        at = {t: i for i, t in enumerate(vocabulary)}
        weights = np.zeros((len(vocabulary), len(block)))
        for j, (_, own) in enumerate(block):
            for t, df, weight in own:
                weights[at[t], j] = weight * np.log(1 + (total["docs"] - df + 0.5) / (df + 0.5))
        ids = pa.array([q for q, _ in block])
        held = spark.sparkContext.broadcast((ids, pa.array(vocabulary), weights))  # BLOCK_CELLS cells at most, or one query

        def run(batches):
            ids, known, weights = held.value
            best = Best(ids, k)
            for batch in batches:
                own, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
                for start in range(0, batch.num_rows, TILE):
                    tile = lists.slice(start, TILE)
                    n = pc.fill_null(pc.list_value_length(tile), 0).to_numpy()
                    term = pc.index_in(tile.flatten(), value_set=known)
                    met = term.is_valid().to_numpy(zero_copy_only=False)
                    ends = np.concatenate(([0], np.cumsum(np.bincount(np.repeat(np.arange(len(tile)), n)[met], minlength=len(tile)))))
                    term = term.drop_null().to_numpy()
                    scores = np.zeros((weights.shape[1], len(tile)))
                    for i in np.flatnonzero(np.diff(ends)):  # only a document's own terms meet the queries
                        cell, tf = np.unique(term[ends[i] : ends[i + 1]], return_counts=True)
                        scores[:, i] = (tf * (K1 + 1) / (tf + K1 * (1 - B + B * n[i] / total["mean"]))) @ weights[cell]
                    scores = np.round(scores, DIGITS)
                    best.add(0, scores, own[start : start + TILE], scores > 0)
            yield from best.rows(schema.names)

        return sized.mapInArrow(run, schema)

    parts, block, names = [], [], set()
    for q, own in found.toLocalIterator():
        own = [(t, df, weight) for t, df, weight in own]
        if block and len(names | {t for t, _, _ in own}) * (len(block) + 1) > BLOCK_CELLS:
            parts, block, names = [*parts, scored(block)], [], set()
        block.append((q, own))
        names |= {t for t, _, _ in own}
    if block:
        parts.append(scored(block))
    return ranked(reduce(DataFrame.union, parts) if parts else spark.createDataFrame([], schema), k)


def expanded_terms(asked: DataFrame, docs: DataFrame, found: DataFrame, feedback: int = 3, count: int = 10, mix: float = 0.4, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """(query_id, term, weight): the query's terms, and those that its best documents' language models make likely.

    Of the first ``feedback`` results of a query, each with its share of their scores, the likelihood of
    a term is the weighted mean of its share of the documents' words; the ``count`` likeliest terms that the query
    has not itself (ties in order of the terms) share the weight ``mix``, the query's own share the rest.
    """
    own = asked.select(query_id, "term", (F.lit(1 - mix) * F.col("weight") / F.sum("weight").over(Window.partitionBy(query_id))).alias("weight"))
    best = found.where(F.col("rank") <= feedback).select(query_id, doc_id, (F.col("score") / F.sum("score").over(Window.partitionBy(query_id))).alias("share"))
    words = tokenised(docs, doc_id).join(best, doc_id).select(query_id, doc_id, "share", F.size("t").alias("n"), F.explode("t").alias("term"))
    counted = words.groupBy(query_id, doc_id, "share", "n", "term").agg(F.count(F.lit(1)).alias("tf"))
    likely = counted.groupBy(query_id, "term").agg(F.round(F.sum(F.col("share") * F.col("tf") / F.col("n")), DIGITS).alias("p")).join(asked.select(query_id, "term"), [query_id, "term"], "left_anti")
    order = Window.partitionBy(query_id).orderBy(F.desc("p"), "term")
    new = likely.withColumn("n", F.row_number().over(order)).where((F.col("n") <= count) & (F.col("p") > 0))
    return own.union(new.select(query_id, "term", F.lit(mix) * F.col("p") / F.sum("p").over(Window.partitionBy(query_id))))


def fused(lists: list[DataFrame], k: int, constant: int = 60, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """The best k of several result lists by the sum of 1 / (constant + rank), ties by id."""
    votes = reduce(DataFrame.union, [x.select(query_id, doc_id, (1 / (constant + F.col("rank"))).alias("v")) for x in lists])
    score = votes.groupBy(query_id, doc_id).agg(F.round(F.sum("v"), DIGITS).alias("score"))
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return score.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def expanded_search(queries: DataFrame, docs: DataFrame, k: int, pool: int = 20, query_id: str = "query_id", doc_id: str = "doc_id", **settings) -> DataFrame:
    """BM25 of the queries and of the queries with feedback terms, the two result lists merged."""
    asked, docs = query_terms(queries, query_id), staged(tokenised(docs, doc_id), "terms")  # texts are taken apart once
    first = staged(bm25_terms(asked, docs, pool, query_id, doc_id), "first")
    more = staged(expanded_terms(asked, docs, first, query_id=query_id, doc_id=doc_id, **settings), "expanded")
    return fused([first, bm25_terms(more, docs, pool, query_id, doc_id)], k, query_id=query_id, doc_id=doc_id)


def hybrid(lexical: DataFrame, semantic: DataFrame, k: int, weight: float = 0.7, query_id: str = "query_id", doc_id: str = "doc_id") -> DataFrame:
    """Best k of ``weight`` x semantic + the rest x lexical score, the latter over the query's best; ties, after rounding, by id."""
    best = F.max("score").over(Window.partitionBy(query_id))
    left = lexical.select(query_id, doc_id, (F.col("score") / best).alias("lex"))
    joined = left.join(semantic.select(query_id, doc_id, F.col("score").alias("sem")), [query_id, doc_id], "full_outer")
    score = F.round(weight * F.coalesce("sem", F.lit(0.0)) + (1 - weight) * F.coalesce("lex", F.lit(0.0)), DIGITS)
    order = Window.partitionBy(query_id).orderBy(F.desc("score"), doc_id)
    return joined.select(query_id, doc_id, score.alias("score")).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
