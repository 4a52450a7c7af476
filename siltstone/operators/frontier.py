"""Crawling by links: the link graph of pages, robots rules, and a breadth-first frontier with budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions.html import SIMPLE
from siltstone.operators.incremental import HEAD, normalise_url, resolve_url
from siltstone.sources.store import staged

#: The link of an ``a`` element: in double quotes, in single ones, or bare.
HREF = r"""(?i)<a\s(?:[^>"']|"[^"]*"|'[^']*')*?\bhref\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def host_of(url: Column) -> Column:
    """Host of a normalised URL, with its port."""
    return F.regexp_extract(url, r"^[a-z][a-z0-9+.-]*://([^/?#]*)", 1)


def path_of(url: Column) -> Column:
    """Path and query of a normalised URL; a site's root is ``/``."""
    rest = F.regexp_replace(url, HEAD, "")
    return F.when(rest.startswith("/"), rest).otherwise(F.concat(F.lit("/"), rest))


def page_links(pages: DataFrame, same_host: bool = True, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(url, target), both normalised and distinct: the links of each page, by default to its own host only.

    Links are found by a pattern outside comments, resolved against the page's URL and normalised; what
    is no page (mail, scripts, fragments) is none. Null URLs and pages have no links.
    """
    html = F.regexp_replace(html_col, r"(?s)<!--.*?(?:-->|\z)", "")
    href = F.explode(F.array_distinct(F.transform(F.regexp_extract_all(html, F.lit(HREF), F.lit(1)), lambda h: F.regexp_replace(h, "^[\"']|[\"']$", ""))))
    found = pages.where(F.col(url_col).isNotNull()).select(F.col(url_col).alias("_page"), href.alias("_href"))
    link = F.col("_href")
    for name, char in SIMPLE.items():
        link = F.replace(link, F.lit(f"&{name};"), F.lit(char))
    links = found.select(normalise_url(F.col("_page")).alias("url"), normalise_url(resolve_url(F.col("_page"), link)).alias("target")).where("target is not null")
    if same_host:
        links = links.where(host_of(F.col("url")) == host_of(F.col("target")))
    return links.distinct()


def robots_rules(files: DataFrame, agent: str) -> DataFrame:
    """(host, prefix, allow) that hold for an agent, from (host, robots): the text of each host's robots.txt.

    The groups whose agent names are part of ``agent`` hold, or else those for ``*``. A rule without a path says nothing.
    """
    lines = files.select("host", F.posexplode(F.split("robots", r"\r\n|\r|\n")).alias("n", "line"))
    parts = F.regexp_extract_all(F.regexp_replace("line", "#.*$", ""), F.lit(r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$"), F.lit(0))
    field = lambda i: F.regexp_extract(F.get(parts, F.lit(0)), r"^\s*([A-Za-z-]+)\s*:\s*(.*?)\s*$", i)
    rows = lines.select("host", "n", F.lower(field(1)).alias("key"), field(2).alias("value")).where(F.col("key").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy("host").orderBy("n")
    begins = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    rows = rows.withColumn("block", F.sum(F.when(begins, 1).otherwise(0)).over(order))
    named = F.lower("value")
    agents = rows.where("key = 'user-agent'").select("host", "block", F.when(named == "*", 0).when((named != "") & F.contains(F.lit(agent.lower()), named), 1).alias("match")).where("match is not null")
    agents = agents.withColumn("best", F.max("match").over(Window.partitionBy("host"))).where("match = best").select("host", "block").distinct()
    return rows.where("key <> 'user-agent' and value <> ''").join(agents, ["host", "block"]).select("host", F.col("value").alias("prefix"), (F.col("key") == "allow").alias("allow")).distinct()


def allowed(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """The rows whose longest matching rule (host, prefix, allow) allows them, or that no rule matches; allow wins a tie.

    A longest-prefix join: each distinct URL meets the rules of its host by the prefixes of its path, of those lengths that
    the host's rules have, so a host with many pages is no cross join.
    """
    lengths = rules.groupBy("host").agg(F.collect_set(F.length("prefix")).alias("lengths"))
    seen = urls.select(F.col(url_col).alias("_url")).distinct().select("_url", host_of(F.col("_url")).alias("host"), path_of(F.col("_url")).alias("path"))
    starts = seen.join(lengths, "host").select("_url", "host", F.explode(F.transform(F.filter("lengths", lambda n: n <= F.length("path")), lambda n: F.substring("path", F.lit(1), n))).alias("prefix"))
    ruled = starts.join(rules, ["host", "prefix"]).groupBy("_url").agg(F.max(F.struct(F.length("prefix"), F.col("allow"))).alias("r")).where("not r.allow")
    return urls.join(ruled.select(F.col("_url").alias(url_col)), url_col, "left_anti")


def crawl_plan(seeds: DataFrame, links: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """(source, url, depth) of the pages that a crawl fetches.

    ``seeds``: source, url (normalised), max_depth, max_pages. Breadth first: each round joins the last round's pages with
    their links, drops what was met before and, in the order of URLs, what is beyond the source's budget; what the rules
    forbid is dropped from the links beforehand; the budget's window keeps as many rows a task before it shuffles. Each round is staged, so lineage stays
    short; there are as many rounds as the deepest source needs.
    """
    limits = staged(seeds.groupBy("source").agg(F.max("max_depth").alias("max_depth"), F.max("max_pages").alias("max_pages")), "limits")
    starts = seeds.select("source", "url").where("url is not null").distinct()
    if rules is not None:
        links, starts = allowed(links, rules, "target"), allowed(starts, rules)
    links = staged(links.select("url", "target"), "links")  # read in every round
    order = Window.partitionBy("source").orderBy("url")

    def within(found: DataFrame, met: DataFrame | None, depth: int) -> DataFrame:
        if met is not None:
            found = found.join(met, ["source", "url"], "left_anti")
            used = met.groupBy("source").agg(F.count(F.lit(1)).alias("used"))
            found = found.join(limits, "source").join(used, "source", "left")
        else:
            found = found.join(limits, "source").withColumn("used", F.lit(0))
        most = F.col("max_pages") - F.coalesce("used", F.lit(0))
        return found.where(F.col("max_depth") >= depth).withColumn("n", F.row_number().over(order)).where(F.col("n") <= most).select("source", "url", F.lit(depth).alias("depth"))

    last = staged(within(starts, None, 0), "frontier")
    met, depth = last, 0
    deepest = limits.agg(F.max("max_depth")).first()[0] or 0
    while depth < deepest and not last.isEmpty():
        depth += 1
        found = last.select("source", "url").join(links, "url").select("source", F.col("target").alias("url")).distinct()
        last = staged(within(found, met.select("source", "url"), depth), "frontier")
        met = met.union(last)
    return met


def to_fetch(plan: DataFrame, documents: DataFrame, fresh_since: Column) -> DataFrame:
    """The pages of a plan that were not seen since; documents: (url, last_seen)."""
    return plan.join(documents.where(F.col("last_seen") >= fresh_since).select("url"), "url", "left_anti")
