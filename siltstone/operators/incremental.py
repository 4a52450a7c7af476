"""What changed between two loads, URL identity, and cached answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Scheme and host of a URL.
HEAD = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def with_hash(docs: DataFrame, text_col: str = "text") -> DataFrame:
    return docs.withColumn("content_hash", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def duplicates(hashed: DataFrame, key: str) -> DataFrame:
    """(content_hash, copies, first) of texts that occur more than once; counts are combined before the shuffle."""
    return hashed.groupBy("content_hash").agg(F.count(F.lit(1)).alias("copies"), F.min(key).alias("first")).where("copies > 1")


def plan_load(stored: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """(key, action): insert, replace, skip or gone, by key and content_hash; only the first two need embedding."""
    old, new = stored.select(key, F.col("content_hash").alias("_old")), found.select(key, F.col("content_hash").alias("_new"))
    action = F.when(F.col("_old").isNull(), "insert").when(F.col("_new").isNull(), "gone").when(F.col("_old") == F.col("_new"), "skip").otherwise("replace")
    return old.join(new, key, "full_outer").select(key, action.alias("action"))


def merge_versions(stored: DataFrame, found: DataFrame, key: str, seen_at: Column) -> DataFrame:
    """(key, content_hash, first_indexed, last_seen, last_changed, status) after a load that saw ``found`` (key, content_hash).

    What was not found again is ``gone`` and keeps its dates; what comes back is ``live`` again.
    """
    old = stored.select(key, *[F.col(c).alias(f"_{c}") for c in ("content_hash", "first_indexed", "last_seen", "last_changed")])
    joined = old.join(found.select(key, F.col("content_hash").alias("_new")), key, "full_outer")
    live, same = F.col("_new").isNotNull(), F.coalesce(F.col("_new") == F.col("_content_hash"), F.lit(False))
    return joined.select(
        key, F.coalesce("_new", "_content_hash").alias("content_hash"), F.coalesce(F.col("_first_indexed"), seen_at).alias("first_indexed"),
        F.when(live, seen_at).otherwise(F.col("_last_seen")).alias("last_seen"), F.when(live & ~same, seen_at).otherwise(F.col("_last_changed")).alias("last_changed"),
        F.when(live, "live").otherwise("gone").alias("status"),
    )


def bound(value: Column, fn: Callable[[Column], Column]) -> Column:
    """``fn`` of a value that stands in the plan, and is computed, once, however often ``fn`` names it."""
    return F.get(F.transform(F.array(value), fn), F.lit(0))


def normalise_url(url: Column) -> Column:
    """Scheme and host in lower case, without its scheme's own port, fragment or final slash; parameters in order."""

    def without_port(head):
        return F.when(head.startswith("http://"), F.regexp_replace(head, ":80$", "")).when(head.startswith("https://"), F.regexp_replace(head, ":443$", "")).otherwise(head)

    def whole(bare):
        head = bound(F.lower(F.regexp_extract(bare, HEAD, 0)), without_port)
        return bound(F.regexp_replace(bare, HEAD, ""), lambda rest: F.concat(head, F.regexp_replace(F.regexp_extract(rest, r"^[^?]*", 0), "/+$", ""), parameters(rest)))

    def parameters(rest):
        asked = F.regexp_extract(rest, r"^[^?]*\?(.*)$", 1)
        ordered = F.array_join(F.array_sort(F.filter(F.split(asked, "&"), lambda x: x != "")), "&")
        return bound(ordered, lambda o: F.when(o != "", F.concat(F.lit("?"), o)).otherwise(""))

    return bound(F.regexp_replace(F.trim(url), "#.*$", ""), whole)


def resolve_url(base: Column, href: Column) -> Column:
    """The absolute form of a link of the page ``base``; null for links that are no pages (mailto:, javascript:, only a fragment)."""
    root = F.regexp_extract(base, HEAD, 0)
    path = F.regexp_extract(F.regexp_replace(base, HEAD, ""), r"^[^?#]*", 0)
    folder = F.concat(root, F.coalesce(F.nullif(F.regexp_extract(path, r"^(.*/)", 1), F.lit("")), F.lit("/")))

    def absolute(link):
        return (
            F.when(link.rlike(r"^(?i)https?://"), link).when(link.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:") | (link == ""), None)
            .when(link.startswith("//"), F.concat(F.regexp_extract(root, r"^[A-Za-z][A-Za-z0-9+.-]*:", 0), link)).when(link.startswith("/"), F.concat(root, link))
            .when(link.startswith("?"), F.concat(root, path, link)).otherwise(F.concat(folder, link))
        )

    def up(a):
        return F.when(F.size(a) > 1, F.slice(a, F.lit(1), F.size(a) - 1)).otherwise(a)

    def walked(steps):
        passed = F.aggregate(steps, F.lit([]).cast("array<string>"), lambda a, s: F.when(s == ".", a).when(s == "..", up(a)).otherwise(F.concat(a, F.array(s))))
        return F.concat(passed, F.when(F.element_at(steps, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(F.lit([]).cast("array<string>")))

    def straight(whole):
        asked = lambda tail: F.concat(F.array_join(bound(F.split(F.regexp_extract(tail, r"^[^?]*", 0), "/"), walked), "/"), F.regexp_extract(tail, r"(\?.*)$", 1))
        return F.when(whole.isNotNull(), F.concat(F.regexp_extract(whole, HEAD, 0), bound(F.regexp_replace(whole, HEAD, ""), asked)))

    return bound(bound(F.regexp_replace(F.trim(href), "#.*$", ""), absolute), straight)


def cached_answers(questions: DataFrame, cache: DataFrame, ttl: str = "1 hour", changed: DataFrame | None = None) -> DataFrame:
    """Questions with the answer of an equal question (case and space apart) that has not expired; cache: (query, answer, stored_at).

    ``changed`` (source, changed_at) invalidates what a new load of a source has made old: with it the cache
    has a column ``sources``, and an answer with a source that changed after it was stored is not used.
    """
    key = lambda c: F.sha2(F.lower(F.trim(F.regexp_replace(c, r"\s+", " "))), 256)
    fresh = cache.where(F.col("stored_at") >= F.current_timestamp() - F.expr(f"interval {ttl}"))
    if changed is not None:
        latest = changed.groupBy("source").agg(F.max("changed_at").alias("changed_at"))
        used = fresh.select("query", "stored_at", F.explode("sources").alias("source")).join(latest, "source").where("changed_at > stored_at")
        fresh = fresh.join(used.select("query", "stored_at"), ["query", "stored_at"], "left_anti")
    newest = fresh.groupBy(key("query").alias("_k")).agg(F.max_by("answer", "stored_at").alias("cached_answer"))
    return questions.withColumn("_k", key("query")).join(newest, "_k", "left").drop("_k")
