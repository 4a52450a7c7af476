"""Quality rules with risk-controlled cutoffs, as DataFrame expressions only.

Each rule rejects a document whose feature exceeds a cutoff. For every stratum and rule
the cutoff is the strictest of a fixed grid for which an exact binomial test on the
labelled holdout shows that at most ``risk / rules`` of the good documents are
rejected, at the level ``error / (strata x rules)`` (Bonferroni; within a grid the tests
run from the most lenient cutoff on and stop at the first failure, which needs no
correction). So with probability 1 - error no stratum loses more than ``risk`` of its good
documents to the rules. A stratum with too few labels gets no cutoff and rejects nothing.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.llm.scratch import materialize

#: White space between words: ``[\x20\x09-\x0D]``.
SPACES = " \t\n\x0b\f\r"
SPLIT = r"[\x20\x09-\x0D]+"
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"
#: Words in the windows that are looked for twice in a text.
REPEAT_WINDOW = 5
#: Most good documents that the rules may reject in a stratum, and the chance that they do so more.
RISK, ERROR = 0.05, 0.05
#: Rules: feature and the cutoffs tried, strictest first.
GRID = {
    "symbol_rate": [0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
    "dup_line_rate": [0.02, 0.05, 0.1, 0.2, 0.3, 0.5],
    "repeat_rate": [0.02, 0.05, 0.1, 0.15],
    "word_length": [8.0, 9.0, 10.0, 12.0, 16.0, 24.0],
    "shout_rate": [0.02, 0.05, 0.1, 0.2, 0.4, 0.8],
}


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: higher-order functions would repeat it."""
    return F.transform(F.array(value), body)[0]


def removed(text: Column, characters: str) -> Column:
    return F.translate(text, characters, "")


def repeated_words(words: Column) -> Column:
    """Words in windows of REPEAT_WINDOW words that occur twice or more in the text, the first included."""
    k = REPEAT_WINDOW

    def covered(at: Column) -> Column:  # sorted window starts -> words in their union
        gaps = F.aggregate(F.sequence(F.lit(0), F.size(at) - 2), F.lit(0), lambda acc, j: acc + F.least(F.lit(k), at[j + 1] - at[j]))
        return F.when(F.size(at) > 1, gaps + k).otherwise(F.lit(k))

    def twice(grams: Column) -> Column:
        pairs = F.array_sort(F.transform(grams, lambda g, i: F.struct(g.alias("g"), i.alias("i"))))
        same = lambda s, x, j: ((j > 0) & (s[F.greatest(j - 1, F.lit(0))]["g"] == x["g"])) | ((j < F.size(s) - 1) & (s[F.least(j + 1, F.size(s) - 1)]["g"] == x["g"]))
        starts = let(pairs, lambda s: F.array_sort(F.transform(F.filter(s, lambda x, j: same(s, x, j)), lambda x: x["i"])))
        return let(starts, covered)

    def of(hashes: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(0), F.size(hashes) - k), lambda i: F.xxhash64(*[hashes[i + j] for j in range(k)]))
        return let(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), F.lit(0)).otherwise(twice(g)))

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    return F.when(F.size(words) > k, let(hashes, of)).otherwise(F.lit(0))


def base_features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``row`` (struct of the kept columns) and the base counts of every whole text; no shuffle."""
    kept = docs.columns if keep is None else keep
    text = F.coalesce(docs[f"`{text_col}`"], F.lit(""))
    one = docs.select(F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), text.alias("_text"))
    t = F.col("_text")
    words = F.filter(F.split(t, SPLIT), lambda w: w != "")
    lines = F.filter(F.split(t, "\n"), lambda x: removed(x, SPACES) != "")
    counts = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    line_counts = let(lines, lambda x: F.struct(F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    return one.select(
        "row", counts.alias("c"), line_counts.alias("l"), F.length(removed(t, SPACES)).alias("word_chars"),
        (F.length(t) - F.length(removed(t, SYMBOLS))).alias("n_symbols"), (F.length(t) - F.length(removed(t, "!"))).alias("n_shouts"),
    ).select(
        "row", *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in ("c.n_words", "word_chars", "n_symbols", "l.n_dup_lines", "c.n_repeat_words", "l.n_lines", "n_shouts")]
    )


def rule_features() -> dict[str, Column]:
    per_word = lambda c: F.col(c) / F.greatest(F.col("n_words"), F.lit(1))
    return {
        "symbol_rate": per_word("n_symbols"), "dup_line_rate": F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)),
        "repeat_rate": per_word("n_repeat_words"), "word_length": per_word("word_chars"), "shout_rate": per_word("n_shouts"),
    }


def log_binomial_tail(k: Column, n: Column, p: float) -> Column:
    """ln P(Bin(n, p) <= k), exact up to rounding; 0 (no evidence) from k >= p n on."""
    start = n.cast("double") * F.lit(math.log1p(-p))

    def step(acc: Column, i: Column) -> Column:
        term = acc["term"] + F.log((n - i + 1).cast("double") / i.cast("double")) + F.lit(math.log(p) - math.log1p(-p))
        top = F.greatest(acc["total"], term)
        total = top + F.log1p(F.exp(-F.abs(acc["total"] - term)))
        return F.struct(term.alias("term"), total.alias("total"))

    tail = F.aggregate(F.sequence(F.lit(1).cast("long"), k.cast("long")), F.struct(start.alias("term"), start.alias("total")), step, lambda acc: acc["total"])
    return F.when(k.cast("double") >= n.cast("double") * p, F.lit(0.0)).when(k > 0, tail).otherwise(start)


def select_cutoffs(labelled: DataFrame, risk: float = RISK, error: float = ERROR, grid: dict[str, list[float]] | None = None) -> DataFrame:
    """(stratum, one cutoff column per rule, n_good) from rows (stratum, good, one column per rule)."""
    grid = grid or GRID
    tries = [(rule, i, c) for rule, cuts in grid.items() for i, c in enumerate(cuts)]
    counted = labelled.where("good = 1").groupBy("stratum").agg(F.count(F.lit(1)).alias("n_good"), *[F.sum((F.col(rule) > c).cast("long")).alias(f"k_{rule}_{i}") for rule, i, c in tries])
    level = F.lit(math.log(error / len(grid))) - F.log(F.count(F.lit(1)).over(_all()).cast("double"))
    held = counted.withColumn("level", level)
    passes = {(rule, i): log_binomial_tail(F.col(f"k_{rule}_{i}"), F.col("n_good"), risk / len(grid)) <= F.col("level") for rule, i, _ in tries}
    # k falls as cutoffs grow, so the strictest cutoff that passes is where the run from the lenient end stops
    return held.select("stratum", "n_good", *[F.coalesce(*[F.when(passes[rule, i], F.lit(c)) for i, c in enumerate(cuts)]).alias(f"cut_{rule}") for rule, cuts in grid.items()])


def _all():
    from pyspark.sql import Window

    return Window.partitionBy(F.lit(0))  # over strata, not documents


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", stratum_col: str = "lang", risk: float = RISK, error: float = ERROR, trial_col: str | None = None) -> DataFrame:
    """Base counts, ``base_failed`` and ``kept`` for every document.

    A null text has no words and fails the base rule, like an empty one; a null stratum is a
    stratum of its own; a document that is labelled more than once is good if all labels
    are 1; null labels and labels without a document are not used; repeated documents are
    judged row by row, but equal texts of a stratum count once in the holdout, as trials have to be
    independent. Near copies do so too if ``trial_col`` names what they share, such as the component that a
    similarity join has found: of each of its values in a stratum the document whose id hashes lowest, which no
    feature can sway, is the trial, and the guarantee is about such groups; a document without a value is a trial of its own. Without labels only the base rule rejects; an empty table gives no rows; very
    long texts are read whole, and columns that are not named are not looked at.
    """
    more = [] if trial_col is None else [docs[f"`{trial_col}`"].alias("trial")]
    own = ["doc_id", "stratum", "th", *(["trial"] if more else [])]
    known = docs.select(docs[f"`{id_col}`"].alias("doc_id"), docs[f"`{stratum_col}`"].alias("stratum"), "text", F.xxhash64("text").alias("th"), *more)
    feats = materialize(base_features(known, keep=own), "features")
    feats = feats.select("row.doc_id", F.coalesce(F.col("row.stratum"), F.lit("")).alias("stratum"), *[F.col(f"row.{c}").alias(c) for c in own[2:]], *feats.columns[1:])
    feats = feats.withColumns(rule_features()).withColumn("base_failed", (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")))
    good = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("good"))
    held = feats.where(~F.col("base_failed")).join(good.where("good = 1"), "doc_id").dropDuplicates(["stratum", "th"])
    if more:
        apart = F.when(F.col("trial").isNotNull(), F.struct(F.lit(True).alias("in"), F.xxhash64("trial").alias("of"))).otherwise(F.struct(F.lit(False).alias("in"), F.col("th").alias("of")))
        one = F.min_by(F.struct("good", *GRID), F.struct(F.xxhash64("doc_id"), F.col("th"))).alias("one")
        held = held.groupBy("stratum", apart.alias("apart")).agg(one).select("stratum", "one.*")
    cutoffs = materialize(select_cutoffs(held, risk, error), "cutoffs")
    hit = F.lit(False)
    for rule in GRID:
        hit = hit | F.coalesce(F.col(rule) > F.col(f"cut_{rule}"), F.lit(False))
    # a row per stratum: small enough to be sent to all tasks by the session's own threshold, else shuffled
    return feats.join(cutoffs, "stratum", "left").withColumn("kept", ~F.col("base_failed") & ~hit)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept."""
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def report_sql() -> str:
    """DuckDB SQL for ``quality_report``."""
    rules = {
        "symbol_rate": "n_symbols / greatest(n_words, 1)", "dup_line_rate": "n_dup_lines / greatest(n_lines, 1)", "repeat_rate": "n_repeat_words / greatest(n_words, 1)",
        "word_length": "word_chars / greatest(n_words, 1)", "shout_rate": "n_shouts / greatest(n_words, 1)",
    }
    p = RISK / len(GRID)
    tries = "\n  union all ".join(f"select '{rule}' as rule, {c}::double as cut, stratum, count(*) filter (where {rule} > {c}) as k, count(*) as n from held group by stratum" for rule, cuts in GRID.items() for c in cuts)
    tail = f"(select coalesce(sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln({1 - p}))), 0) from (select unnest(range(0, k + 1)) as i))"
    return rf"""
with split as (
  select doc_id, coalesce(lang, '') as stratum, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from documents
), windows as (
  select doc_id, i, array_to_string(words[i : i + {REPEAT_WINDOW - 1}], ' ') as gram
  from (select doc_id, words, unnest(range(1, len(words) - {REPEAT_WINDOW - 2})) as i from split where len(words) >= {REPEAT_WINDOW})
), twice as (
  select doc_id, i from windows where (doc_id, gram) in (select doc_id, gram from windows group by doc_id, gram having count(*) > 1)
), repeated as (
  select doc_id, count(distinct i + j) as n from twice, (select unnest(range(0, {REPEAT_WINDOW})) as j) group by doc_id
), feats as (
  select doc_id, stratum, text, len(words)::bigint as n_words, length(array_to_string(words, ''))::bigint as word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols, (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
    coalesce(n, 0)::bigint as n_repeat_words, len(lines) as n_lines, length(regexp_replace(text, '[^!]', '', 'g')) as n_shouts
  from split left join repeated using (doc_id)
), rated as (
  select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, {", ".join(f"{e} as {r}" for r, e in rules.items())} from feats
), held as (
  select distinct on (stratum, text) rated.* from rated join (select doc_id from labels where quality is not null group by doc_id having min(quality) = 1) using (doc_id) where not base_failed
), tries as (
  {tries}
), tested as (
  select *, case when k >= n * {p} then 1 else {tail} end as p_value from tries
), cuts as (
  select stratum, rule, min(cut) as cut from tested where p_value <= {ERROR} / ({len(GRID)} * (select count(distinct stratum) from held)) group by stratum, rule
)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  not base_failed and not ({" or ".join(f"coalesce({r} > (select max(cut) from cuts where cuts.stratum = rated.stratum and rule = '{r}'), false)" for r in GRID)}) as kept
from rated
"""
