"""The link graph, robots rules and the crawl's frontier against plain versions."""

import random
from urllib.robotparser import RobotFileParser

from pyspark.sql import functions as F

from siltstone.operators import frontier


def test_page_links(spark):
    html = """<a class="x>y" href='/a?b=2&amp;a=1'>1</a><A HREF=c.html>2</A><a href="#top">3</a><a href="mailto:x@y.example">4</a>
    <!-- <a href="/hidden">5</a> --><a href="http://other.example/z">6</a><a href="/a?a=1&b=2#f">7</a><link href="/css"><a name="n">8</a>"""
    pages = spark.createDataFrame([("HTTP://h.example/d/p.html", html), (None, html), ("http://h.example/e", None)], "url string, html string")
    got = {tuple(r) for r in frontier.page_links(pages).collect()}
    assert got == {("http://h.example/d/p.html", "http://h.example/a?a=1&b=2"), ("http://h.example/d/p.html", "http://h.example/d/c.html")}
    assert {r.target for r in frontier.page_links(pages, same_host=False).collect()} - {t for _, t in got} == {"http://other.example/z"}


ROBOTS = """# rules
User-agent: other
Disallow: /

User-agent: silt
User-agent: second
Disallow: /private
Allow: /private/open
Disallow:
Disallow: /p?

User-agent: *
Disallow: /none
"""


def test_robots_rules_are_the_longest_prefix(spark):
    files = spark.createDataFrame([("a.example", ROBOTS), ("b.example", "user-agent: *\r\ndisallow: /x # all\r\n"), ("c.example", ""), ("d.example", None)], "host string, robots string")
    rules = frontier.robots_rules(files, "Silt/2.0")
    assert {tuple(r) for r in rules.collect()} == {("a.example", "/private", False), ("a.example", "/private/open", True), ("a.example", "/p?", False), ("b.example", "/x", False)}
    paths = ["/", "", "/private", "/private/x", "/private/open/y", "/p?q", "/p", "/none", "/xy"]
    urls = spark.createDataFrame([(f"http://{h}.example{p}",) for h in "abcd" for p in paths], "url string")
    got = {r.url for r in frontier.allowed(urls, rules).collect()}
    want = set()
    for h in "abcd":
        parser = RobotFileParser()
        parser.parse({"a": ROBOTS, "b": "user-agent: *\ndisallow: /x # all\n"}.get(h, "").splitlines())
        for p in paths:
            ok = parser.can_fetch("silt", f"http://{h}.example{p}")
            if h == "a" and p.startswith("/private/open"):
                ok = True  # the longest rule, not the first
            if h == "a" and p == "/p?q":
                ok = False  # as it is written, without quoting
            want |= {f"http://{h}.example{p}"} if ok else set()
    assert got == want


def _plain(seeds, links, forbidden):
    out = {}
    for source in {s for s, *_ in seeds}:
        depth_of, last = {}, sorted({u for s, u, *_ in seeds if s == source and u not in forbidden})
        max_depth, most = max(d for s, _, d, _ in seeds if s == source), max(m for s, _, _, m in seeds if s == source)
        for depth in range(max_depth + 1):
            last = [u for u in last if u not in depth_of][: most - len(depth_of)]
            depth_of |= {u: depth for u in last}
            last = sorted({t for u in last for t in links.get(u, ()) if t not in forbidden})
        out |= {(source, u): d for u, d in depth_of.items()}
    return out


def test_crawl_is_breadth_first_within_budgets(spark):
    rng = random.Random(2)
    node = lambda i: f"http://h.example/n{i:03d}"
    edges = {(node(i), node(rng.randrange(120))) for i in range(120) for _ in range(rng.choice([0, 1, 2, 5]))} | {(node(0), node(i)) for i in range(60, 90)}
    links: dict[str, set[str]] = {}
    for u, t in edges:
        links.setdefault(u, set()).add(t)
    seeds = [("s", node(0), 3, 40), ("s", node(5), 3, 40), ("t", node(7), 9, 1000), ("u", node(0), 0, 10), ("v", node(0), 5, 0), ("w", None, 2, 5)]
    rules = spark.createDataFrame([("h.example", "/n01", False), ("h.example", "/n015", True)], "host string, prefix string, allow boolean")
    forbidden = {node(i) for i in range(10, 20) if i != 15}
    got = frontier.crawl_plan(spark.createDataFrame(seeds, "source string, url string, max_depth int, max_pages int"), spark.createDataFrame(sorted(edges), "url string, target string"), rules)
    assert {(r.source, r.url): r.depth for r in got.collect()} == _plain([s for s in seeds if s[1]], links, forbidden)
    none = frontier.crawl_plan(spark.createDataFrame([], "source string, url string, max_depth int, max_pages int"), spark.createDataFrame([], "url string, target string"))
    assert none.count() == 0
    seen = spark.createDataFrame([(node(0), "2024-01-02"), (node(5), "2023-01-01")], "url string, last_seen string")
    left = frontier.to_fetch(got, seen, F.lit("2024-01-01"))
    assert left.where(F.col("url") == node(0)).isEmpty() and not left.where(F.col("url") == node(5)).isEmpty()


def test_plans_of_links_stay_small(spark):
    """What a URL's rules name many times stands in the plan once."""
    pages = spark.createDataFrame([("http://a.example/x/", '<a href="../y?b=2&amp;a=1#z">y</a>')], "url string, html string")
    links = frontier.page_links(pages)
    assert [tuple(r) for r in links.collect()] == [("http://a.example/x", "http://a.example/y?a=1&b=2")]
    assert len(links._jdf.queryExecution().optimizedPlan().toString()) < 40_000
