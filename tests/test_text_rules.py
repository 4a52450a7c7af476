"""HTML, URL and personal-data rules on hand-made strings, and chunks by headings."""

import random
import re

import pytest

from pyspark.sql import functions as F
from pyspark.util import PythonEvalType

from siltstone.config import ChunkConfig, TransformConfig
from siltstone.functions.html import clean_html, clean_html_strict, read_html
from siltstone.operators import incremental, safety, sections
from siltstone.plans.oracle import SQL
from siltstone.plans.queries import QUERIES

TAGS = ("script", "style", "noscript", "header", "footer", "nav")


def _column(spark, rows, make):
    return [r[0] for r in spark.createDataFrame([(r,) for r in rows], "t string").select(make(F.col("t"))).collect()]


HARD = [
    "&ccaron;&cacute;&zcaron;&dstrok; &check; x", "caf&eacute x", "a&#150;b &#x41;", "<p title='a>b'>c</p>", '<p title="a<b">c', "<nav>a<nav>b</nav>c</nav>d", "<div><nav>a</div>b", "a</nav>b", "<nav>never closed", "<!-- open <p>x",
    "<script>if (a<b) '</nav>'</script>x", "<title>a <b</title>c", "&amp;lt; &lt;p&gt; &nbsp;x&quot;", "<p>a<br>b</p><!-- c --><p>d", "<textarea><p>x</textarea>y", None, "", "1 < 2 & 3 > 2", "<style>p>a{}</style>y", "x<br/>y<", "a<!doctype x>b", "<NAV>a</NAV >b",
]


@pytest.mark.parametrize("tags", [TAGS, ()])
def test_default_cleaner_reads_as_a_parser_does(spark, tags):
    got = _column(spark, HARD, lambda c: clean_html(c, tags))
    assert got == [read_html(h, tags) for h in HARD]


def test_urls_keep_their_query(spark):
    given = ["HTTP://A.Example:80/x/?b=2&a=1#top", "https://a.example:80/x", "https://a.example:443", "http://a.example/x?id=1", "http://a.example/x?id=2", "http://a.example/X//", "http://a.example?q=1&&", None]
    want = ["http://a.example/x?a=1&b=2", "https://a.example:80/x", "https://a.example", "http://a.example/x?id=1", "http://a.example/x?id=2", "http://a.example/X", "http://a.example?q=1", None]
    assert _column(spark, given, incremental.normalise_url) == want


def test_links_are_resolved(spark):
    base = "https://a.example/p/q/r.html?x=1#y"
    cases = {
        "s.html": "https://a.example/p/q/s.html", "/s": "https://a.example/s", "../s?a=../b": "https://a.example/p/s?a=../b", "//b.example/z": "https://b.example/z", "?k=1": "https://a.example/p/q/r.html?k=1", "#top": None, "": None,
        "mailto:x@y": None, "javascript:void(0)": None, "HTTP://B.example": "HTTP://B.example", "./": "https://a.example/p/q/", "../../../../t": "https://a.example/t", ".": "https://a.example/p/q/",
    }
    got = _column(spark, list(cases), lambda c: incremental.resolve_url(F.lit(base), c))
    assert got == list(cases.values())
    assert _column(spark, ["s"], lambda c: incremental.resolve_url(F.lit("https://a.example"), c)) == ["https://a.example/s"]


def test_personal_data_beside_each_other(spark):
    cases = {
        "1234567890123 1234567890124": "[national_id] [national_id]", "x0101990710006y": "x[national_id]y", "12345678901234": "12345678901234",
        "4111 1111 1111 1111": "[card]", "4111111111111111 5500000000000004": "[card] [card]", "1234 4111 1111 1111 1111": "1234 [card]", "4111111111111112": "4111111111111112", "3782 822463 10005.": "[card].",
        "+385 (0)1 4877 123": "[phone]", "+381 (21) 485 2030, +381 21 485 2031": "[phone], [phone]", "021 485 203": "[phone]", "2024-01-05": "2024-01-05", "a.b@c.example,d@e.example": "[email],[email]", None: None, "": "", "plain": "plain",
    }
    assert _column(spark, list(cases), safety.redact) == list(cases.values())


def test_counts_and_check_digits(spark):
    texts = ["0101990710008 0101990710007 3113990710000", "mail a@b.example 4111 1111 1111 1111 [email]", None]
    got = [tuple(r) for r in _column(spark, texts, safety.personal_counts)]
    assert got == [(0, 0, 3, 0, 1), (1, 1, 0, 0, 0), (0, 0, 0, 0, 0)]


PAGE = """<html><head><title>The &amp; page</title></head><body><nav><h1>menu</h1></nav><p>before all</p>
<h1>One</h1><p>a <b>bold</b> word<br>and more</p><h3>Deep</h3><ul><li>x</li><li>y</li></ul><h2>Two</h2>text of two<div>more</div><h1></h1><h1>Three</h1></body></html>"""


def test_sections_have_their_heading_paths():
    title, found = sections.read_sections(PAGE, TAGS)
    assert title == "The & page"
    assert [([t for _, t in stack], blocks) for stack, blocks in found] == [
        ([], ["before all"]), (["One"], ["a bold word and more"]), (["One", "Deep"], ["x", "y"]), (["One", "Two"], ["text of two", "more"]), (["Three"], []),
    ]
    assert sections.read_sections("<h2>A</h2>b<h1>C</h1>d", ())[0] == "A"
    assert sections.read_sections(None, ()) == (None, [])


def test_chunks_never_cross_a_section(spark):
    long = "<h1>A</h1><p>" + "word " * 60 + "</p><h2>B</h2><p>" + "other " * 30 + "</p><h1>C</h1><p>s</p>"
    pages = spark.createDataFrame([(1, long, "u1"), (2, PAGE, "u2"), (3, None, "u3"), (4, "", "u4")], "page_id int, html string, url string")
    rows = sections.section_chunks(pages, TransformConfig(), ChunkConfig(100, 20, 3)).orderBy("page_id", "chunk_index").collect()
    first = [r for r in rows if r.page_id == 1]
    assert [r.chunk_index for r in first] == list(range(len(first)))
    assert {r.heading_path for r in first} == {"A", "A > B"}  # the text under C is too short
    assert all(("word" in r.text) == (r.heading_path == "A") and r.chunk_length == len(r.text) <= 100 for r in first)
    assert {(r.section_title, r.level) for r in rows if r.page_id == 2} == {(None, 0), ("One", 1), ("Deep", 3), ("Two", 2)}
    assert {r.page_id for r in rows} == {1, 2}
    assert rows[0].page_title == "A" and _column(spark, ["t"], lambda c: sections.with_context(F.lit("A > B"), c)) == ["A > B\nt"]


def test_redaction_is_that_of_its_sql(spark, tmp_path):
    """Phones one character apart, cards in groups and mixtures of them, by q35 and q36 and by DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(5)
    parts = ["+1 (784) 555-8120", "+381 21 485 2031", "021 485 203", "4111111111111111", "4111 1111 1111 1111", "3782 822463 10005", "0101990710006", "4111111111111112", "a@b.example", "12", "345", "6789", "+", "(", "[phone]", "é", "x", "99999"]
    texts = ["+1 (784) 555-8120 +1 (208) 555-1177", None, ""] + ["".join(rng.choice(parts) + rng.choice(" ,-\n/  ") * rng.choice((0, 1, 1, 1, 2)) for _ in range(rng.randint(1, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(i, "en", f"s{i % 50}", t) for i, t in enumerate(texts)], "doc_id bigint, lang string, source string, text string")
    rows.coalesce(1).write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    for name in ("q35_personal_data", "q36_redacted"):
        got = QUERIES[name](spark, f"file://{tmp_path}")
        want = con.sql(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
        assert sorted(map(tuple, got.collect())) == sorted(want)


def test_few_pages_are_strings_at_once(spark):
    """The parser's function takes Arrow arrays as they are, over more pages than it reads at a time; nulls stay."""
    pages = [None if i % 5 == 0 else f"<nav>m</nav><p>caf&eacute; {i}" for i in range(300)]
    got = _column(spark, pages, lambda c: clean_html_strict(TAGS)(c))
    assert got == [None if p is None else f"caf\u00e9 {i}" for i, p in enumerate(pages)]
    assert clean_html_strict(TAGS).evalType == PythonEvalType.SQL_SCALAR_ARROW_ITER_UDF


ODD = HARD + [
    "token = &quot Oneastes", "a &lt b &gt c &copy d &nbsp e &#39 f &amp g &ampx", "&amp;amp; &amp;lt; &amp;quot", "x&#160;y&reg;z&deg;", "&ltb&gt;c", "<ſcript>a</script>b", "<scrıpt>a</scrıpt>b", "<SCRIPT\n>a</Script\t>b", "<nav/>a</nav\x0b>b",
    "<header>a<nav>b</header>c</nav>d", "<!-- a <!-- b --> c --> d", "<!-->a-->b", "<script>a", "  a  b 　", " a ", "a\x85b\x0bc\x1cd", "<p title='\U0001f600>'>é</p>", "<![CDATA[x]]>y", "<?php a ?>b", "a<b", "<navx>a</navx>b", "<>a</>b",
]


def _odd_pages(spark, folder):
    """ODD and mixtures of what is in them, as a table of pages and in DuckDB."""
    duckdb = pytest.importorskip("duckdb")
    rng = random.Random(7)
    parts = [p for h in ODD if h for p in re.findall(r"<[^<>]*>?|&[#\w]+;?|\w+|\s+|[^\w\s<&]", h)] + ["<!--", "-->", "<h1>", "</h1>", "<h2>", "<h2 id=x>", "<h3>", "<p>", "<p><b>", "<br>", "</p>", "<div class=a>", "<li>", "<title>", "</title>", "word " * 70, "word " * 90]
    rows = [(i, f"u{i}", h) for i, h in enumerate(ODD + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))) for _ in range(3000)])]
    spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1).write.parquet(f"file://{folder}/pages.parquet")
    con = duckdb.connect()
    con.sql(f"create view pages as select * from '{folder}/pages.parquet/*.parquet'")
    return con


def _same_as_sql(spark, folder, con, name):
    got = QUERIES[name](spark, f"file://{folder}")
    want = con.sql(f"select {', '.join(got.columns)} from ({SQL[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want))


@pytest.mark.parametrize("name", ["q02_html_clean", "q03_min_length", "q32_document_table", "q40_section_chunks"])
def test_odd_pages_are_read_as_by_the_sql(spark, tmp_path, name):
    """References without their semicolon, unclosed and nested elements, odd white space and mixtures of them, by query and by DuckDB."""
    _same_as_sql(spark, tmp_path, _odd_pages(spark, tmp_path), name)
