"""Main text of pages that hosts mix, nest and mark in other ways than the test tables do."""

import collections
import random
import re

import pyarrow.parquet as pq
import pytest

from siltstone.llm import html_wrapper


@pytest.fixture
def text_of(spark):
    """Texts of pages, all of one host unless they come with a url."""

    def run(*pages):
        rows = [(i, *(p if isinstance(p, tuple) else ("http://h.example/", p))) for i, p in enumerate(pages)]
        got = html_wrapper.main_text_report(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()
        return [r.text for r in sorted(got, key=lambda r: r.page_id)]

    return run


def test_host_that_mixes_layouts(text_of):
    marked, old = "<body><nav>m</nav><article><p>new</p></article><p>beside</p></body>", "<body><nav>m</nav><div class=content><p>old</p></div></body>"
    empty = "<body><article> </article><p>only</p></body>"
    assert text_of(marked, old, empty) == ["new", "old", "only"]
    assert text_of((None, marked), (None, old), ("x", old)) == ["new", "old", "old"]


def test_deep_nesting(text_of):
    deep = lambda inner, n=70, tag="div": f"<{tag}>" * n + inner + f"</{tag}>" * n
    article = f"<html><body><div><article><p>a</p>{deep('<p>b</p>')}<p>c</p></article></div><p>out</p></body></html>"
    skipped = f"<body><article><p>a</p>{deep('<nav>m</nav><form><p>f</p></form><div class=comments><p>x</p></div><p>b</p>', 300)}<p>c</p></article></body>"
    inside = f"<body><p>out</p>{deep('<nav>m</nav><article><p>a</p><nav>m</nav></article><p>out</p>')}</body>"
    quotes = deep("<p>q</p>", 5000, "blockquote") + "<p>end</p>"
    assert text_of(article, skipped, inside, quotes) == ["a\nb\nc", "a\nb\nc", "a", "q\nend"]


def test_class_names(text_of):
    kept = (
        '<body class="single has-sidebar"><p>t</p></body>', '<body><div class="content no-sidebar"><p>t</p></div></body>', '<body><article class="post comment-open"><p>t</p></article></body>',
        '<body><main id="content" class="widget"><p>t</p></main></body>', '<html class="menu" id="form" aria-hidden="true"><body id="search"><p>t</p></body></html>', '<body><div class="x" data-id="comments"><p>t</p></div></body>',
    )
    lost = ('<div class="box" id="comments">', f'<div class="{"x" * 90} menu">', '<div class="cookie-notice">', '<div class="Ad">', '<div id="sidebar2">', "<div hidden=hidden>", '<div id="comment-list" class="wide">')
    assert text_of(*kept) == ["t"] * len(kept)
    assert text_of(*(f"<body>{x}<p>m</p></div><p>t</p></body>" for x in lost)) == ["t"] * len(lost)


def test_text_in_svg_math_object_and_canvas(text_of):
    pages = {
        "<p>x is <math><mrow><mi>a</mi><mo>=</mo><mn>2</mn></mrow></math> here</p>": "x is a=2 here",
        "<p>a</p><svg width=1 /><math/><p>b</p>": "a\nb",
        "<p>a</p><svg><title/><style/><path d='M0'/><circle r='1'/><text>label</text></svg><p>b</p>": "a\nlabel\nb",
        "<object data=x><p>instead</p></object><canvas>drawn</canvas><p>b</p>": "instead\ndrawn\nb",
        "<p>a</p><svg><p>b</p><object><p>c</p><canvas><p>d</p>": "a\nb\nc\nd",
        "<p>a</p><template><p>b</p>": "a\nb",
        "<p>a</p><noscript>n</noscript><script>s</script><template><p>t</p></template><iframe>i</iframe><textarea>t</textarea><p>b</p><style>all": "a\nb",
    }
    assert text_of(*(f"<body><nav>m</nav><article>{p}</article></body>" for p in pages)) == list(pages.values())


def _plain_pages(n):
    """Pages of a host that marks nothing: neutral elements, the same labels for menu, text and foot."""
    pages, expected = [], []
    for i in range(n):
        own = [f"Paragraph {j} of page {i}." for j in range(1 + i % 4)]
        links = "".join(f"<div><a href=/{k}>Other story {i * 7 + k}</a></div>" for k in range(2 + i % 3))
        pages.append(
            "<body><div><div>Home</div><div>About us</div></div><div><h2>" + f"Title {i}</h2>" + "".join(f"<div>{t}</div>" for t in own) + "<div>Written for everyone by us.</div></div>"
            f"<section>{links}</section><div><div>All rights reserved</div></div></body>"
        )
        expected.append("\n".join([f"Title {i}", *own]))
    return pages, expected


def test_unmarked_hosts_keep_what_fills_slots(text_of):
    pages, expected = _plain_pages(12)
    assert text_of(*pages) == expected


def test_without_alignment_the_template_stays(text_of, monkeypatch):
    """Each page on its own, or a filter of paths, cannot tell the template from the text."""
    pages, expected = _plain_pages(6)
    alone = [html_wrapper.main_text(p, html_wrapper.parse(p)[0], 1) for p in pages]
    assert all("Home" in t and "All rights reserved" in t for t in alone) and all(a != e for a, e in zip(alone, expected, strict=True))
    paths = {path: any(path == other for other, t in html_wrapper.parse(pages[0])[1] if "Paragraph" in t) for path, t in html_wrapper.parse(pages[0])[1]}
    assert paths[next(path for path, t in html_wrapper.parse(pages[0])[1] if t == "Home")]  # one path for both


def test_copies_keep_their_text(text_of):
    pages, _ = _plain_pages(1)
    assert text_of(*pages * 5) == ["Home\nAbout us\nTitle 0\nParagraph 0 of page 0.\nWritten for everyone by us.\nOther story 0\nOther story 1\nAll rights reserved"] * 5


def test_hosts_are_told_apart_and_other_columns_may_clash(spark):
    pages, expected = _plain_pages(9)
    rows = [(i, f"http://{'a' if i < 9 else 'b'}.example/{i}", (pages * 2)[i], "x", "y", "z") for i in range(18)]
    df = spark.createDataFrame(rows, "page_id int, url string, html string, _host string, host string, wrapper string").repartition(7)
    got = html_wrapper.extract_main_text(df)
    assert [r.text for r in sorted(got.collect(), key=lambda r: r["row"].page_id)] == expected * 2
    assert got.schema["row"].dataType.names == df.columns


def _unmarked(page):
    """The page with neutral elements in place of those that say what they hold, and without classes, ids and roles."""
    page = re.sub(r"(</?)(article|nav|footer|header|aside|main|form|section)\b", r"\1div", page)
    return re.sub(r"""\s(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", "", page)


def _compared(got, expected):
    """Precision and recall of blocks, and pages that are equal."""
    same = wrong = missing = equal = 0
    for g, e in zip(got, expected, strict=True):
        g, e = collections.Counter(g.split("\n")), collections.Counter(e.split("\n"))
        same, wrong, missing, equal = same + (g & e).total(), wrong + (g - e).total(), missing + (e - g).total(), equal + (g == e)
    return same / (same + wrong), same / (same + missing), equal


def test_given_pages_without_their_marks(spark, text_of):
    """The wrapper alone finds the articles of the given pages; pages read on their own do not show them."""
    rows = pq.read_table("/root/testdata/sf0.01/pages.parquet").to_pylist()
    marked = [(r["url"], r["html"]) for r in rows]
    plain = [(url, _unmarked(html or "")) for url, html in marked]
    expected = text_of(*marked)
    precision, recall, equal = _compared(text_of(*plain), expected)
    assert precision >= 0.95 and recall >= 0.99 and equal >= 0.85 * len(rows)
    alone = [html_wrapper.main_text(p, html_wrapper.parse(p)[0], 1) for _, p in plain]
    precision, _, equal = _compared(alone, expected)
    assert precision < 0.9 and equal == 0


def _sequence(seed, n, kinds=("p", "h2", "ul", "pre")):
    r = random.Random(seed)
    return html_wrapper.parse("<body>" + "".join(f"<{t}>{r.randrange(40)}</{t}>" for t in r.choices(kinds, k=n)) + "</body>")[0][3][0][3]


def _best(xs, ys):
    """The greatest weight of an alignment, by the whole table of scores."""
    kind = lambda n: (html_wrapper.signature(n), html_wrapper.strings(n))
    best = [[0] * (len(ys) + 1) for _ in range(len(xs) + 1)]
    for i in reversed(range(len(xs))):
        for j in reversed(range(len(ys))):
            (a, s), (b, t) = kind(xs[i]), kind(ys[j])
            pair = best[i + 1][j + 1] + html_wrapper.PAIR + html_wrapper.BELOW + html_wrapper.COMMON * len(s & t) if a == b else 0
            best[i][j] = max(best[i + 1][j], best[i][j + 1], pair)
    return best[0][0]


@pytest.mark.parametrize("n, m", [(1, 9), (7, 5), (40, 33), (90, 120)])
def test_alignments_are_the_best_and_one_at_every_size(n, m, monkeypatch):
    xs, ys = _sequence(n, n), _sequence(m + 1, m)
    found = html_wrapper.pairs(xs, ys)
    assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(found, found[1:], strict=False))
    weight = sum(html_wrapper.PAIR + html_wrapper.BELOW + html_wrapper.COMMON * len(html_wrapper.strings(xs[i]) & html_wrapper.strings(ys[j])) for i, j in found)
    assert weight == _best(xs, ys)
    for rows in (1, 3, 10_000):
        monkeypatch.setattr(html_wrapper, "ROWS", rows)
        assert html_wrapper.pairs(xs, ys) == found


def test_long_and_deep_pages_of_one_host(text_of):
    wide = ["<body><div>Home</div><div>" + "".join(f"<p>{k} {i}</p>" for i in range(3000)) + "</div></body>" for k in range(3)]
    deep = ["<body>" + "".join(f"<div>{k} {i}" for i in range(3000)) for k in range(3)]
    assert text_of(*wide) == ["\n".join(f"{k} {i}" for i in range(3000)) for k in range(3)]
    assert text_of(*deep) == ["\n".join(f"{k} {i}" for i in range(3000)) for k in range(3)]


def test_wrappers_are_stored_whole():
    tree = html_wrapper.merge(*(html_wrapper.parse("<body>" + "<div>" * n + "<p>a</p><dl><dt>b<dd>c<dt>d<dd>e</dl>")[0] for n in (2, 2000)))
    assert html_wrapper.pack(html_wrapper.unpack(html_wrapper.pack(tree))) == html_wrapper.pack(tree)


def test_pages_without_a_host_and_repeated_rows(text_of):
    page = lambda i: f"<body><div><a href=/>Home</a></div><div><h2>T{i}</h2><p>The own paragraph of page {i}</p></div><div>foot {i}</div></body>"
    assert text_of(*((None, page(i)) for i in range(4)), (None, page(0)), ("nothing", page(9)), (None, None)) == [f"T{i}\nThe own paragraph of page {i}" for i in (0, 1, 2, 3, 0, 9)] + [""]
