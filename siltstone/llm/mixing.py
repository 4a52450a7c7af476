"""Mixing sources to target weights by hierarchical budgets, as DataFrame operations only.

The tree is domain > language > source. Budgets go down from the root: siblings share
their parent's budget by weight, no child gets more than its subtree can give
(``epochs`` times its tokens), and what a short child leaves goes to its siblings before
it is missed one level up, because a parent's own capacity is what its subtree can give.

A leaf passes over its documents in a seeded order of each epoch and takes the first
tokens of that sequence up to its budget: whole epochs, then a prefix of the next. Where
the prefix ends is found from token sums of 4,096 ranges of the order, then inside the
one range that holds the end; no leaf is ever ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.quality_rules import SPLIT
from siltstone.llm.scratch import materialize

#: Integer weights by name; names that are not listed get OTHER.
DOMAIN_WEIGHTS = {"web": 50, "books": 30, "forum": 20}
LANG_WEIGHTS = {"en": 55, "fr": 15, "de": 15, "es": 15}
OTHER = 1
#: Budget as parts of 100 of all tokens, passes over a leaf at most, seed of the orders.
BUDGET_PERCENT, EPOCHS, SEED = 60, 2, 7
LEVELS = ["domain", "lang", "source"]
#: SQL (Spark's and DuckDB's) of the domain of a source: the first ten, the next five, the rest.
DOMAIN_SQL = "case when source rlike_ '^src[0-9]$' then 'web' when source rlike_ '^src1[0-4]$' then 'books' else 'forum' end"


def domain_of(source: Column) -> Column:
    return F.when(source.rlike("^src[0-9]$"), "web").when(source.rlike("^src1[0-4]$"), "books").otherwise("forum")


def count_words(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), SPLIT), lambda w: w != "")).cast("long")


def weight(name: Column, weights: dict[str, int]) -> Column:
    out = F.lit(None).cast("long")
    for k, v in weights.items():
        out = F.when(name == k, F.lit(v).cast("long")).otherwise(out)
    return F.coalesce(out, F.lit(OTHER).cast("long"))


def share(nodes: DataFrame, parents: list[str], name: str) -> DataFrame:
    """Add ``budget`` to siblings (columns: capacity, weight, total = the parent's budget).

    Siblings in the order of capacity / weight: those that reach their capacity come first,
    the rest split what remains by weight. Whole tokens that rounding down leaves over go one
    each to the siblings that lost most by it, ties by name; a sibling that lost anything has
    room for one more, so budgets sum to the parent's.
    """
    group = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = group.orderBy(F.col("capacity") / F.col("weight"), name)
    before = F.coalesce(F.sum("capacity").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rest = F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing))
    full = F.col("capacity") * F.col("rest") <= (F.col("total") - F.col("before")) * F.col("weight")
    marked = nodes.where("weight > 0").withColumns({"before": before, "rest": rest}).withColumn("full", full)
    used = F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(group), F.lit(0))
    open_weight = F.sum(F.when(~F.col("full"), F.col("weight"))).over(group)
    marked = marked.withColumns({"used": used, "open_weight": open_weight})
    marked = marked.withColumns({"fair": F.expr("if(full, 0, (total - used) * weight div open_weight)"), "lost": F.expr("if(full, 0, (total - used) * weight % open_weight)")})
    over = F.col("total") - F.col("used") - F.sum("fair").over(group)
    turn = F.row_number().over(group.orderBy("full", F.desc("lost"), name))
    budget = F.when(F.col("full"), F.col("capacity")).otherwise(F.col("fair") + F.when(turn <= over, 1).otherwise(0))
    return marked.withColumn("budget", budget).drop("before", "rest", "full", "used", "open_weight", "fair", "lost", "total")


def leaf_budgets(leaves: DataFrame, budget: Column, epochs: int) -> DataFrame:
    """(domain, lang, source, tokens, budget) from (domain, lang, source, tokens); a row per leaf."""
    weights = {"domain": DOMAIN_WEIGHTS, "lang": LANG_WEIGHTS, "source": {}}
    parents = leaves.agg(budget.cast("long").alias("total"))
    for depth, level in enumerate(LEVELS):
        above, path = LEVELS[:depth], LEVELS[: depth + 1]
        nodes = leaves.groupBy(*path).agg((F.sum("tokens") * epochs).alias("capacity")).withColumn("weight", weight(F.col(level), weights[level]))
        nodes = nodes.join(parents, above) if above else nodes.crossJoin(parents)  # one row: the root
        parents = share(nodes, above, level).select(*path, F.col("budget").alias("total"))
    return leaves.join(parents.withColumnRenamed("total", "budget"), LEVELS)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, budget_percent: int = BUDGET_PERCENT, epochs: int = EPOCHS, seed: int = SEED) -> DataFrame:
    """What the mix takes of every document.

    Columns: ``row`` (struct of the kept input columns), id, domain, lang, source, n_tokens
    (words), full (whole passes) and taken (tokens over all passes, ``full * n_tokens`` and
    the document's part of the last prefix). Null texts have no tokens and are never taken;
    a null lang or source is the name ``''``; rows of equal id, and equal order keys, follow
    by id and length; an empty table gives no rows; very long texts count whole, and other
    columns may have any names.
    """
    kept = docs.columns if keep is None else keep
    base = docs.select(
        F.struct(*[docs[f"`{c}`"] for c in kept]).alias("row"), docs[f"`{id_col}`"].alias("id"), F.coalesce("lang", F.lit("")).alias("lang"),
        F.coalesce("source", F.lit("")).alias("source"), count_words(docs[f"`{text_col}`"]).alias("n_tokens"),
    ).withColumn("domain", domain_of(F.col("source")))
    base = materialize(base, "mix-rows")
    leaves = base.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    leaves = leaf_budgets(materialize(leaves, "mix-leaves"), F.expr(f"coalesce(sum(tokens), 0) * {budget_percent} div 100"), epochs)
    leaves = leaves.select(*LEVELS, F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(0).alias("full"), F.when(F.col("tokens") > 0, F.expr("budget % tokens")).otherwise(0).alias("part"))
    leaves = materialize(leaves, "mix-budgets")
    key = F.md5(F.concat_ws(":", F.lit(seed), F.col("full"), F.coalesce(F.col("id").cast("string"), F.lit("-"))).cast("binary"))
    # a row per leaf: sent to all tasks below the session's threshold, else shuffled
    rows = base.join(leaves, LEVELS, "left").withColumns({"full": F.coalesce("full", F.lit(0)), "part": F.coalesce("part", F.lit(0))}).withColumn("key", key).withColumn("bucket", F.substring("key", 1, 3))
    sums = rows.groupBy(*LEVELS, "bucket").agg(F.sum("n_tokens").alias("s"), F.max("part").alias("part"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*LEVELS).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumn("before", before)
    # the bucket in which a leaf's prefix ends: one for each leaf
    ends = materialize(sums.where("before < part and part <= before + s").select(*LEVELS, F.col("bucket").alias("end_bucket"), "before"), "mix-ends")
    placed = rows.join(ends, LEVELS, "left")
    whole = F.when(F.col("bucket") < F.col("end_bucket"), F.col("n_tokens")).otherwise(F.lit(0))
    inside = placed.where(F.col("bucket") == F.col("end_bucket"))
    at = Window.partitionBy(*LEVELS).orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    left = F.col("part") - F.col("before") - F.coalesce(F.sum("n_tokens").over(at), F.lit(0))
    inside = inside.withColumn("last", F.greatest(F.lit(0), F.least(F.col("n_tokens"), left)))
    others = placed.where(F.col("end_bucket").isNull() | (F.col("bucket") != F.col("end_bucket"))).withColumn("last", F.coalesce(whole, F.lit(0)))
    return inside.unionByName(others).select("row", "id", *LEVELS, "n_tokens", "full", (F.col("full") * F.col("n_tokens") + F.col("last")).alias("taken"))


def mix_report(docs: DataFrame) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens, full_passes and tokens_taken for every document."""
    return mix(docs, keep=["doc_id"]).select(F.col("id").alias("doc_id"), *LEVELS, "n_tokens", F.col("full").cast("long").alias("full_passes"), F.col("taken").cast("long").alias("tokens_taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix with their own columns: a row for each pass.

    A document that is taken in part keeps its first words, joined by single spaces, and
    ``n_chars`` (if there is such a column) their length.
    """
    got = mix(docs, **options).where("taken > 0").withColumn("part", F.col("taken") - F.col("full") * F.col("n_tokens"))
    passes = F.concat(F.array_repeat(F.col("n_tokens"), F.col("full").cast("int")), F.when(F.col("part") > 0, F.array(F.col("part"))).otherwise(F.array().cast("array<bigint>")))
    rows = got.select("row", F.explode(passes).alias("words"), "n_tokens")
    words = F.filter(F.split(F.col("row.text"), SPLIT), lambda w: w != "")
    cut = F.col("words") < F.col("n_tokens")
    text = F.when(cut, F.array_join(F.slice(words, 1, F.col("words").cast("int")), " ")).otherwise(F.col("row.text"))
    rows = rows.select("row", text.alias("text"), cut.alias("cut"))
    changed = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars"))
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def report_sql() -> str:
    """DuckDB SQL for ``mix_report``."""
    domain = DOMAIN_SQL.replace("source rlike_ ", "regexp_matches(source, ").replace("' then", "') then")
    case = lambda name, w: f"case {name} " + " ".join(f"when '{k}' then {v}" for k, v in w.items()) + f" else {OTHER} end" if w else str(OTHER)

    def level(out: str, path: str, above: str, name: str, weights: str, parent: str) -> str:
        by = f"partition by {above}" if above else ""
        join = f"join {parent} using ({above})" if above else f"cross join {parent}"
        return f"""{out}_n as (
  select {path}, sum(tokens) * {EPOCHS} as capacity, any_value({weights}) as weight from leaves group by {path}
), {out}_o as (
  select *, coalesce(sum(capacity) over (w rows between unbounded preceding and 1 preceding), 0) as before, sum(weight) over (w rows between current row and unbounded following) as rest
  from {out}_n {join} window w as ({by} order by capacity / weight, {name})
), {out}_f as (select *, capacity * rest <= (total - before) * weight as is_full from {out}_o
), {out}_l as (
  select *, total - coalesce(sum(capacity) filter (where is_full) over ({by}), 0) as remaining, sum(weight) filter (where not is_full) over ({by}) as open_weight from {out}_f
), {out}_r as (
  select *, case when is_full then 0 else remaining * weight // open_weight end as fair, case when is_full then 0 else remaining * weight % open_weight end as lost from {out}_l
), {out} as (
  select {path}, case when is_full then capacity else fair + case when row_number() over ({by} order by is_full, lost desc, {name}) <= remaining - sum(fair) over ({by}) then 1 else 0 end end as total from {out}_r
)"""

    return rf"""
with rows_ as (
  select doc_id, source, lang, {domain} as domain, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::bigint as n_tokens
  from (select doc_id, coalesce(source, '') as source, coalesce(lang, '') as lang, coalesce(text, '') as text from documents)
), leaves as (select domain, lang, source, sum(n_tokens) as tokens from rows_ group by all
), root as (select coalesce(sum(tokens), 0) * {BUDGET_PERCENT} // 100 as total from leaves
), {level("d", "domain", "", "domain", case("domain", DOMAIN_WEIGHTS), "root")}, {level("l", "domain, lang", "domain", "lang", case("lang", LANG_WEIGHTS), "d")}, {level("s", "domain, lang, source", "domain, lang", "source", case("source", {}), "l")}, placed as (
  select rows_.*, case when tokens > 0 then total // tokens else 0 end as full_, case when tokens > 0 then total % tokens else 0 end as part
  from rows_ join leaves using (domain, lang, source) join s using (domain, lang, source)
), ordered as (
  select *, coalesce(sum(n_tokens) over (partition by domain, lang, source order by md5('{SEED}:' || full_ || ':' || doc_id), doc_id, n_tokens rows between unbounded preceding and 1 preceding), 0) as before from placed
)
select doc_id, domain, lang, source, n_tokens, full_::bigint as full_passes, (full_ * n_tokens + greatest(0, least(n_tokens, part - before)))::bigint as tokens_taken from ordered
"""
