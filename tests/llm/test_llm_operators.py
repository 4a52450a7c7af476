"""Operators against brute force, on hand-made tables with nulls, copies, ties and clashing names."""

import base64
import collections
import hashlib
import io
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from siltstone.llm import decontaminate, html_wrapper, jaccard, kernel, mixing, quality_pu, quality_rules, suffix_dedup, tokens, toxicity, warc
from siltstone.llm.components import connected_components

DOC = "doc_id bigint, text string, lang string, source string, n_words int, row string"


def _documents(rng, n=60):
    words = [f"w{i}" for i in range(300)] + ["É", "Straße", "#", "!"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 3, 12, 60, 150]))) for _ in range(n)]
    base = " ".join(rng.choices(words, k=200))
    for i in range(12):  # near copies of one text, each with a few other words
        own = base.split()
        for _ in range(i % 4):
            own[rng.randrange(len(own))] = f"x{i}"
        texts.append(" ".join(own))
    texts += [base, base, None, None, "", " \n\t", "a\x0bb c", "Tab\tWORD", "z " * 3000]
    return [(i, t, rng.choice(["en", "fr", None]), rng.choice(["src1", "src12", "src19", None]), 7, "clash") for i, t in enumerate(texts)] + [(None, "no id at all", "en", "src1", 7, "clash"), (3, texts[3], "en", "src1", 7, "clash")]


@pytest.fixture(scope="module")
def docs(spark):
    rows = _documents(random.Random(5))
    return rows, spark.createDataFrame(rows, DOC).repartition(5).cache()


def _words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def _lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def test_connected_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(120)] + [(5, 5)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def _sets(rows, k):
    out = []
    for r in rows:
        w = _words(_lower(r[1]))
        out.append(frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset())
    return out


def _links(sets, num, den):
    return [(i, j) for i in range(len(sets)) for j in range(i) if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j])]


@pytest.mark.parametrize(("k", "num", "leaf"), [(4, 85, 2048), (5, 80, 4)])
def test_jaccard_components(docs, k, num, leaf, monkeypatch):
    monkeypatch.setattr(jaccard, "LEAF_ROWS", leaf)
    rows, df = docs
    sets = _sets(rows, k)
    group = list(range(len(rows)))
    for i, j in _links(sets, num, 100):
        a, b = group[i], group[j]
        group = [min(a, b) if g in (a, b) else g for g in group]
    low = {g: min((rows[i][0] for i in range(len(rows)) if group[i] == g and rows[i][0] is not None), default=None) for g in set(group)}
    expected = collections.Counter((rows[i][0], len(sets[i]), low[group[i]]) for i in range(len(rows)))
    got = jaccard.jaccard_components(df, k=k, num=num).collect()
    assert collections.Counter((r.id, r.n_shingles, r.component_id) for r in got) == expected


def test_distinct_documents_keeps_columns_and_one_of_each_group(docs):
    rows, df = docs
    got = jaccard.distinct_documents(df)
    assert got.columns == df.columns
    sets = _sets(rows, 5)
    kept = [r.doc_id for r in got.collect()]
    empty = [r[0] for r, s in zip(rows, sets, strict=True) if not s]
    assert set(empty) <= set(kept)
    left = [s for s, r in zip(sets, rows, strict=True) if r[0] in kept and s and r[0] is not None]
    assert not [1 for i, j in _links(left, 80, 100) if left[i] != left[j]]
    assert jaccard.distinct_documents(df.limit(0)).count() == 0


def test_rtree_finds_all_that_may_link():
    rng = np.random.default_rng(2)
    sets = [rng.choice(5000, rng.integers(30, 80), replace=False) for _ in range(300)]
    sets += [np.concatenate([s[: len(s) - 2], rng.choice(5000, 2)]) for s in sets[:100]]
    hashed = [np.unique(kernel.mix(s.astype(np.uint64))) for s in sets]
    sizes = np.array([len(h) for h in hashed])
    points = jaccard.vectors(pa.array([jaccard.count_vector(h) for h in hashed], pa.binary()))
    tree = jaccard.RTree(points, sizes)
    q, i, _ = tree.search(points, sizes, 85, 100)
    found = set(zip(q.tolist(), i.tolist(), strict=True))
    for a in range(len(hashed)):
        for b in range(len(hashed)):
            same = len(np.intersect1d(hashed[a], hashed[b]))
            if 100 * same >= 85 * (sizes[a] + sizes[b] - same):
                assert (a, b) in found
    assert len(found) < len(hashed) ** 2 / 10


def test_frequent_shingles_are_split_without_loss(docs, monkeypatch):
    rows, df = docs
    whole = sorted(map(repr, jaccard.jaccard_components(df).collect()))
    monkeypatch.setattr(jaccard, "SPLIT_BITS", 0)
    monkeypatch.setattr(jaccard, "SPLIT_OVER", -20)
    monkeypatch.setattr(jaccard, "LEAF_ROWS", 3)
    assert sorted(map(repr, jaccard.jaccard_components(df).collect())) == whole


def test_a_family_that_shares_passages_gives_few_candidates(spark, monkeypatch):
    """5,000 texts share two thirds of their words and do not link; some have a near copy."""
    rng = random.Random(1)
    shared = " ".join(f"s{i}" for i in range(80))
    texts = [shared + " " + " ".join(f"u{i}x{rng.randrange(10**9)}" for _ in range(40)) for i in range(4950)]
    texts += [t + " more" for t in texts[:50]]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(8)
    out = []
    search = jaccard.open_pairs
    monkeypatch.setattr(jaccard, "open_pairs", lambda *a: out.append(search(*a)) or out[-1])
    counts = []
    drop = jaccard.discard
    monkeypatch.setattr(jaccard, "discard", lambda *t: (counts.extend(x.count() for x in t if any(x is o for o in out)), drop(*t)))
    got = {r.id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == {i: i if i < 4950 else i - 4950 for i in range(5000)}
    assert len(counts) == 2 and sum(counts) < 5000


def test_count_vectors_beyond_eight_bits():
    grams = kernel.mix(np.arange(120_000, dtype=np.uint64))
    a, b = np.unique(grams[:100_000]), np.unique(grams[20_000:])
    va, vb = jaccard.vectors(pa.array([jaccard.count_vector(a), jaccard.count_vector(b)], pa.binary()))
    assert va.sum() == 100_000 and 80_000 <= jaccard.bound(va, vb) < 100_000
    small = jaccard.vectors(pa.array([jaccard.count_vector(a), jaccard.count_vector(a[:9])], pa.binary()))
    assert small[1].sum() == 9 and jaccard.vectors(pa.array([], pa.binary())).shape == (0, jaccard.DIMENSIONS)


def test_distinct_documents_with_clashing_names(spark):
    names = ["doc_id", "text", "_h", "_id", "_th", "_one", "empty", "row", "id", "th", "one", "kept_id"]
    rows = [(i, t, *range(10)) for i, t in enumerate(["a b c d e f g", "a b c d e f g", "other words stand here now", None, ""])]
    got = jaccard.distinct_documents(spark.createDataFrame(rows, ", ".join(f"{n} {'string' if n == 'text' else 'bigint'}" for n in names)))
    assert got.columns == names and sorted(tuple(r) for r in got.collect()) == [r for r in rows if r[0] != 1]


@pytest.mark.parametrize(("group", "length"), [(2048, 60), (1, 60), (2048, 200), (2048, 280), (1, 400), (2048, 400)])
def test_suffix_repeats(docs, group, length, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP_REGIONS", group)
    rows, df = docs
    count = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        count.update(b[i : i + length] for i in range(len(b) - length + 1))
    expected = collections.Counter()
    for r in rows:
        b = (r[1] or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - length + 1):
            if count[b[i : i + length]] > 1:
                gone[i : i + length] = True
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        left = np.frombuffer(b, np.uint8)[~gone].tobytes()
        expected[(r[0], len(b), int(gone.sum()), spans, hashlib.sha256(left).hexdigest(), left.decode("utf-8", "replace") if gone.any() else None)] += 1
    got = suffix_dedup.remove_repeats(df, length=length, q=20, with_text=True).collect()
    assert collections.Counter((r.id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256, r.kept if r.n_removed else None) for r in got) == expected
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(df, length=1 << 16)


def test_decontamination(spark, docs):
    rows, df = docs
    rng = random.Random(8)
    plain = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", _lower(t))
    items = [("b", None), ("c", ""), (None, "w5 W9"), ("d", "Straße"), ("e", "nothing of this kind is in any document at all, surely")]
    for n, r in enumerate(rng.sample([r for r in rows if len(_words(r[1])) > 40], 6)):
        w = _words(r[1])
        items.append((f"i{n}", " ... ".join(w[7 : 7 + rng.choice([3, 10, 25])])))
    bench = spark.createDataFrame(items, "item_id string, text string")
    patterns = collections.defaultdict(set)
    for item, text in items:
        w = plain(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            patterns[tuple(w[i : i + n])].add(item or "")
    expected = collections.Counter()
    for r in rows:
        w, hit, found = plain(r[1]), set(), set()
        for p, names in patterns.items():
            for i in range(len(w) - len(p) + 1):
                if tuple(w[i : i + len(p)]) == p:
                    hit |= set(range(i, i + len(p)))
                    found |= names
        expected[(r[0], len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))] += 1
    assert collections.Counter(tuple(r) for r in decontaminate.contamination_report(df, bench).collect()) == expected
    blocks = decontaminate.find_contamination(df, bench, block_bytes=30)
    assert sorted((r.n_hit, r["items"]) for r in blocks.collect()) == sorted((r.n_hit, r["items"]) for r in decontaminate.find_contamination(df, bench).collect())
    clean = decontaminate.clean_documents(df, bench)
    assert clean.columns == df.columns and clean.count() == sum(n for e, n in expected.items() if not e[5])
    assert decontaminate.contamination_report(df, bench.limit(0)).where("contaminated").count() == 0


def test_blocks_are_compiled_once_each_on_the_driver(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"x{i % 3} " + " ".join(f"item{i % 3}word{j}" for j in range(15))) for i in range(300)], "doc_id bigint, text string").repartition(6)
    bench = spark.createDataFrame([(f"i{i}", " ".join(f"item{i}word{j}" for j in range(12))) for i in range(3)], "item_id string, text string")
    calls, compile_ = [], decontaminate.compile_patterns
    monkeypatch.setattr(decontaminate, "compile_patterns", lambda *a: calls.append(1) or compile_(*a))
    for held in (384 << 20, 0):  # kept in the workers, or read again for each batch
        monkeypatch.setattr(decontaminate, "HELD_BYTES", held)
        calls.clear()
        found = decontaminate.find_contamination(docs, bench, keep=["doc_id"], block_bytes=100)
        assert [(r["row"].doc_id, r["items"], r.n_hit) for r in found.orderBy("row.doc_id").collect()] == [(i, [f"i{i % 3}"], 12) for i in range(300)]
        assert len(calls) == 3


def test_tokens_round_trip(spark, docs, monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("word_bpe_49k.json")
    rows, df = docs
    odd = [(900, "don't I'll <|endoftext|>x İstanbul ΣΑΣ \x85 a b ½ Ünï'sÀÉ 12.5$ \x00 ŉ'd ''s"), (901, "日本 语。 ÿŸ")]
    rows = [(r[0], r[1]) for r in rows if r[0] is not None] + odd
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    monkeypatch.setattr(tokens, "RANGE_BYTES", 4000)
    whole = Tokenizer.from_file(path)
    ids = [[*whole.encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows]
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0], np.array(ids[i], "<u2").tobytes()))
    expected, start = [], 0
    for i in order:
        expected.append((rows[i][0], start, len(ids[i]), zlib.crc32(np.array(ids[i], "<u4").tobytes())))
        start += len(ids[i])
    manifest = tokens.write_token_shards(df, path, sequence=64)
    assert manifest.count() > 1
    assert sorted(tuple(r) for r in tokens.read_token_shards(manifest).collect()) == sorted(expected)
    fs, place = tokens.open_fs(manifest.orderBy("first_token").first()["path"])
    with fs.open_input_file(place) as f:
        table = pa.ipc.open_file(f).read_all()
    assert table.column("input_ids").type.list_size == 64 and len(table.column("mask")) == len(table)
    assert tokens.read_token_shards(tokens.write_token_shards(df.limit(0), path)).count() == 0


def test_random_access_to_sequences_copies_nothing(spark, docs, tmp_path):
    public = pytest.importorskip("public_tokenizers")
    manifest = tokens.write_token_shards(docs[1], public.path("word_bpe_49k.json"), f"file://{tmp_path}", sequence=64)
    for r in manifest.collect():
        shard = tokens.open_shard(r.path)
        fs, path = tokens.open_fs(r.path)
        stream = np.concatenate([ids for _, _, ids in tokens.read_shard(fs, path)])
        assert len(shard) == -(-r.n_tokens // 64) and len(stream) == r.n_tokens
        before = pa.total_allocated_bytes()
        views = [shard[i] for i in range(len(shard))]
        assert pa.total_allocated_bytes() == before and not any(ids.flags.owndata or ids.flags.writeable for ids, _ in views)
        for i in (len(shard) - 1, 0, len(shard) // 2):
            ids, mask = shard[i]
            real = min(64, r.n_tokens - i * 64)
            assert len(ids) == len(mask) == 64 and (ids[:real] == stream[i * 64 : i * 64 + real]).all() and mask.to_pylist() == [j < real for j in range(64)]
        with pytest.raises(IndexError):
            shard[len(shard)]


def test_token_shards_with_null_and_repeated_ids(spark):
    public = pytest.importorskip("public_tokenizers")
    rows = [(None, "one"), (3, "two words"), (3, "two words"), (3, "a"), (None, None), (1, "")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id bigint, text string, ids int, row string").repartition(3)
    got = sorted(tokens.read_token_shards(tokens.write_token_shards(df, public.path("word_bpe_49k.json"))).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == [None, None, 1, 3, 3, 3]
    assert all(b.start == a.start + a.n_tokens for a, b in zip(got, got[1:], strict=False)) and got[0].start == 0
    assert tokens.read_token_shards(tokens.write_token_shards(df.limit(0), public.path("word_bpe_49k.json"))).count() == 0


def test_existing_arc_files(spark, tmp_path):
    import gzip
    from pathlib import Path

    records = [(f"http://x.example/{i}", f"2001020{i + 1}030405", "text/html", warc.http_block({"Content-Type": "text/html"}, f"<p>{i}".encode())) for i in range(3)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.arc").write_bytes(warc.write_arc(records[:2], 1))
    whole = warc.write_arc(records[2:], 2)
    at = whole.index(b"http://x.example/2")
    (tmp_path / "in" / "b.arc.gz").write_bytes(gzip.compress(whole[:at]) + gzip.compress(whole[at:]))  # a member for each record
    got = sorted(warc.read_arc_files(spark, f"file://{tmp_path}/in/*").collect(), key=lambda r: r.url)
    assert [(r.url, r.date, r.version, bytes(r.block)) for r in got] == [(u, d, 1 if i < 2 else 2, b) for i, (u, d, _, b) in enumerate(records)]
    manifest = warc.convert_arc_files(spark, f"file://{tmp_path}/in/*", f"file://{tmp_path}/out").collect()
    assert sum(r.n_records for r in manifest) == 3
    found = [x for r in manifest for x in warc.read_warc(open(r.path.removeprefix("file://"), "rb")) if x.headers["WARC-Type"] == "response"]
    assert sorted((x.headers["WARC-Target-URI"], x.block) for x in found) == [(u, b) for u, _, _, b in records]
    assert len({x.headers["WARC-Record-ID"] for x in found}) == 3
    for name, bad in (("cut.arc", whole[:-20]), ("none.arc", b"http://x 0.0.0.0 20010101000000 text/html 3\nabc\n"), ("version.arc", whole.replace(b"2 0 siltstone", b"7 0 siltstone"))):
        Path(tmp_path / name).write_bytes(bad)
        with pytest.raises(Exception, match="ArchiveError"):
            warc.read_arc_files(spark, f"file://{tmp_path}/{name}").collect()


def test_arc_versions_and_conversion():
    body = warc.http_block({"Content-Type": "text/html", "X-Page-Id": 4}, b"caf\xc3\xa9\nURL 1 2 3 4\n")
    records = [("http://a.example/x y", "20240102030405", "text/html", body), ("dns:a.example", "2024", "text/dns", b"\n\n1.2.3.4\n"), ("http://a.example/empty", "bad", "text/html", b"")]
    for version in (1, 2):
        data = warc.write_arc(records, version)
        got = list(warc.read_arc(io.BytesIO(data)))
        assert [r.block for r in got[1:]] == [r[3] for r in records] and {r.version for r in got} == {version}
        out = list(warc.convert(got))
        assert [r.headers["WARC-Type"] for r in out] == ["warcinfo", "response", "resource", "response"]
        assert [r.headers["WARC-Date"] for r in out[1:]] == ["2024-01-02T03:04:05Z", "2024-01-01T00:00:00Z", "1970-01-01T00:00:00Z"]
        back = list(warc.read_warc(io.BytesIO(b"".join(map(warc.write_warc, out)))))
        assert [(r.headers, r.block) for r in back] == [(r.headers, r.block) for r in out]
        with pytest.raises(warc.ArchiveError):
            list(warc.read_arc(io.BytesIO(data[:-8])))
    with pytest.raises(warc.ArchiveError):
        list(warc.read_arc(io.BytesIO(b"http://x 0 0 0 0\n")))
    assert list(warc.read_arc(io.BytesIO(b""))) == []


@pytest.mark.parametrize("least", [0, 6])
def test_archive_round_trip(spark, least):
    rows = [(5, "http://a/1", "<p>same</p>", 1), (2, "https://a/2", "<p>same</p>", 1), (9, None, None, 1), (8, "ftp://q", "", 1), (7, "http://é/ x", "ß", 1), (3, "http://u", "ß", 1), (None, "http://n", "<p>same</p>", 1), (2, "http://twice", "<p>same</p>", 1)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, first int")
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    expected = collections.Counter()
    for i, _, h, _ in rows:
        b = (h or "").encode()
        again = len(b) >= least and first.get(h or "") not in (None, i)
        expected[(i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if again else "response", first[h or ""] if again else None)] += 1
    got = warc.read_archives(warc.archive_pages(pages, min_bytes=least)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert collections.Counter(tuple(r) for r in got.collect()) == expected
    assert warc.read_archives(warc.archive_pages(pages.limit(0))).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>no</title><script>if(a<b){"</p>"}</script><style>p{}</style></head><body><header>top</header><nav><ul><li>m1<li>m2</ul></nav>
<div class="cookie-notice">we use</div><article class=post><h1>Big &amp; small</h1><p>One<b> two</b>&nbsp;
three<br>four<p>Unclosed <i>para<div class="ad-banner">buy</div><form><p>name</p></form><ul><li>x</li><li>y</li></ul><!-- <p>no</p> --><section id="comments"><p>first!</p></section>
<p>last 5 &lt; 6 &copy</article><aside>side</aside><footer>foot</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "http://h.example/1", PAGE, "a", 3), (2, "HTTP://H.example:80/2", PAGE.replace("<h1>Big &amp; small</h1>", ""), "a", 3), (3, None, None, "a", 3), (4, "x", "", "a", 3), (5, "http://t/", "just text <", "a", 3), (1, "http://h.example/1", PAGE, "a", 3)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string, host int")
    text = "Big & small\nOne two three four\nUnclosed para\nx\ny\nlast 5 < 6 ©"
    got = collections.Counter((r.page_id, r.text, r.n_chars) for r in html_wrapper.main_text_report(pages).collect())
    assert got == collections.Counter([(1, text, len(text)), (1, text, len(text)), (2, text[12:], len(text) - 12), (3, "", 0), (4, "", 0), (5, "just text <", 11)])
    assert html_wrapper.main_text_report(pages.limit(0)).count() == 0


def test_wrapper_inference_is_union_free():
    tree = lambda page: html_wrapper.parse(page)[0]
    a = tree("<body><h1>t</h1><p>a</p><p>b</p><hr></body>")
    b = tree("<body><p>a</p><table><tr><td>1<td>2<tr><td>3</table></body>")
    assert html_wrapper.render(html_wrapper.merge(a, b)) == "(body(h1(#)? p(#) p(#)? table(tr(td(#) td(#)) tr(td(#)))?))"
    c = tree("<body><p>x</p><p>y</p></body>")
    assert html_wrapper.render(html_wrapper.merge(html_wrapper.merge(a, c), tree("<body><p>1</p><p>2</p><p>3</p><p>4</p></body>"))) == "(body(h1(#)? p(#)*))"
    d, e = (tree("<dl>" + "".join(f"<dt>{k}{i}<dd>{k}{i}" for i in range(n)) + "</dl>") for k, n in (("u", 2), ("v", 3)))
    assert html_wrapper.render(html_wrapper.merge(d, e)) == "(dl((dt(#)? dd(#)?)+))"


def test_only_committed_files_get_their_names(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"http://x.example/{i}", f"<p>{i % 3}") for i in range(12)], "page_id bigint, url string, html string").repartition(3)
    out = f"file://{tmp_path}/warc"
    first = warc.archive_pages(pages, out).collect()
    (tmp_path / "warc" / ".pages-other-000000-0000.warc.gz.1").write_bytes(b"of an attempt that was lost")
    again = warc.archive_pages(pages, out).collect()
    named = sorted(p.name for p in (tmp_path / "warc").iterdir() if not p.name.startswith("."))
    assert named == sorted(r.path.rpartition("/")[2] for r in first + again) and len(set(named)) == len(first) + len(again)
    assert sum(r.n_records for r in first) == 12
    written = spark.createDataFrame([(*first[0], ".gone")], warc.WRITTEN)
    assert warc.publish(written, out).collect() == [first[0]]  # named by an attempt before
    with pytest.raises(Exception, match="nowhere"):
        warc.publish(spark.createDataFrame([(f"{out}/nowhere", 0, 0, ".gone")], warc.WRITTEN), out).collect()


def test_quality_rules_are_exact(spark):
    from math import comb

    rows = [(k, n) for n in (5, 60, 400, 3000) for k in (0, 1, 3, 9)]
    got = spark.createDataFrame(rows, "k bigint, n bigint").select("k", "n", quality_rules.log_binomial_tail(__import__("pyspark").sql.functions.col("k"), __import__("pyspark").sql.functions.col("n"), 0.01).alias("p")).collect()
    for r in got:
        exact = sum(comb(r.n, i) * 0.01**i * 0.99 ** (r.n - i) for i in range(r.k + 1)) if r.k < 0.01 * r.n else 1.0
        assert abs(np.exp(r.p) - exact) < 1e-9


def test_near_copies_are_one_trial(spark):
    """Enough different texts give a cutoff for shouts; near copies of one text do not, if their group is named."""
    text = lambda i: f"a plain sentence of some dozen words about number {i} and about nothing else that matters"
    rows = [(i, text(i), "en", i) for i in range(900)] + [(1000 + i, text(1000 + i), "de", 5) for i in range(900)] + [(5000, text(7), "fr", None), (5001, "wow! " * 3 + text(8), "en", None), (5002, "wow! " * 3 + text(9), "de", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, trial bigint")
    labels = spark.createDataFrame([(r[0], 1) for r in rows if r[0] < 5000], "doc_id bigint, quality int")
    kept = lambda **k: {r.doc_id: r.kept for r in quality_rules.judge(df, labels, **k).collect()}
    alone, grouped = kept(), kept(trial_col="trial")
    assert not alone[5001] and not alone[5002] and not grouped[5001]
    assert grouped[5002]  # 900 near copies are one trial, which proves nothing
    assert all(v for i, v in grouped.items() if i < 5001) and len(grouped) == len(rows)


def test_quality_counts(spark, docs):
    rows, df = docs
    extra = [(500 + i, t, "en", "s", 1, "") for i, t in enumerate(["a b c d e f a b c d e g", "l one\nl one\n \nl one\n", "### $$ x <y>", "a " * 40 + "é!"])]
    rows = rows + extra
    df = df.union(spark.createDataFrame(extra, DOC))
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (9999, 1), (500, 1)], "doc_id bigint, quality int")
    expected = collections.Counter()
    for r in rows:
        t = r[1] or ""
        w = _words(t)
        lines = [x for x in t.split("\n") if _words(x)]
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        count = collections.Counter(grams)
        hit = {i + j for i, g in enumerate(grams) if count[g] > 1 for j in range(5)}
        failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
        expected[(r[0], len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed, not failed)] += 1
    assert collections.Counter(tuple(r) for r in quality_rules.quality_report(df, labels).collect()) == expected


def test_cutoffs_keep_the_risk(spark):
    rows = [("a", 1, float(i % 1000 < 3), 0.0, 0.0, 5.0, 0.0) for i in range(4000)] + [("b", 1, 0.9, 0.0, 0.0, 5.0, 0.0) for _ in range(30)] + [("a", 0, 0.9, 0.9, 0.9, 50.0, 0.9)]
    got = {r.stratum: r for r in quality_rules.select_cutoffs(spark.createDataFrame(rows, "stratum string, good int, symbol_rate double, dup_line_rate double, repeat_rate double, word_length double, shout_rate double")).collect()}
    assert got["a"].cut_symbol_rate == 0.02 and got["a"].cut_word_length == 8.0 and got["b"].cut_symbol_rate is None


def test_equal_texts_count_once_in_the_holdout(spark):
    text = "word " * 9 + "# last"
    rows = [(i, text if i < 500 else f"{i} plain words that differ from all other rows of it here", "en") for i in range(900)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, row string, th int")
    labels = spark.createDataFrame([(i, 1) for i in range(900)], "doc_id bigint, quality int")
    got = {r.doc_id: r.kept for r in quality_rules.quality_report(df, labels).collect()}
    assert len(got) == 900 and not got[0] and got[600]  # one text in 401 may be lost, 500 rows of 900 may not
    assert quality_rules.quality_report(df.limit(0), labels).count() == 0 and quality_rules.quality_report(df, labels.limit(0)).where("kept").count() == 400 + 0 * 500


def test_mixed_documents_with_clashing_names(docs):
    _, df = docs
    more = df.select("doc_id", "text", "lang", "source", F.lit(1).alias("_words"), F.lit(2).alias("_all"), F.lit(3).alias("words"), F.lit(4).alias("cut"), F.lit(5).alias("row"), F.lit(6).alias("n_chars"))
    got, plain = mixing.mixed_documents(more), mixing.mixed_documents(df)
    assert got.columns == more.columns and got.where("_words = 1 and _all = 2 and words = 3 and cut = 4 and row = 5").count() == plain.count()
    assert sorted(r.text for r in got.collect()) == sorted(r.text for r in plain.collect())


def _fill(children, total):
    """Budgets of (name, capacity, weight): raise the level until all is given or all are full, then largest remainders."""
    out, open_ = {}, list(children)
    while open_:
        left, weights = total - sum(out.values()), sum(w for _, _, w in open_)
        full = [c for c in open_ if c[1] * weights <= left * c[2]]
        if not full:
            floors = {n: left * w // weights for n, _, w in open_}
            late = sorted(open_, key=lambda c: (-(left * c[2] % weights), c[0]))
            return out | floors | {n: floors[n] + 1 for n, _, _ in late[: left - sum(floors.values())]}
        out |= {n: c for n, c, _ in full}
        open_ = [c for c in open_ if c not in full]
    return out


def _budgets(leaves, total, epochs, depth=0):
    weights = [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}]
    if depth == len(mixing.LEVELS):
        return {leaves[0][:3]: total}
    kinds = {name: [x for x in leaves if x[depth] == name] for name in {x[depth] for x in leaves}}
    given = _fill([(n, epochs * sum(x[3] for x in own), weights[depth].get(n, mixing.OTHER)) for n, own in kinds.items()], total)
    return {k: v for n, own in kinds.items() for k, v in _budgets(own, given[n], epochs, depth + 1).items()}


@pytest.mark.parametrize("percent", [0, 7, 60, 133, 200])
def test_budgets_are_given_whole(spark, percent):
    """Equal to filling by hand, and no token of the budget is lost at any level."""
    rng = random.Random(percent)
    leaves = [(d, g, f"s{i}", rng.choice([0, 1, 7, 50, 1234])) for d in ("web", "books", "forum", "other") for g in ("en", "fr", "de", "es", "", "xx") for i in range(rng.randrange(1, 8))]
    total = sum(x[3] for x in leaves) * percent // 100
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens bigint")
    got = {tuple(r)[:3]: r.budget for r in mixing.leaf_budgets(df, F.lit(total), 2).collect()}
    assert got == _budgets(leaves, total, 2)
    assert sum(got.values()) == total and all(got[x[:3]] <= 2 * x[3] for x in leaves)


def test_mixing(docs):
    rows, df = docs
    got = mixing.mix_report(df).collect()
    assert len(got) == len(rows)
    total = sum(len(_words(r[1])) for r in rows)
    capacity = sum(mixing.EPOCHS * r.n_tokens for r in got)
    budget = total * mixing.BUDGET_PERCENT // 100
    taken = sum(r.tokens_taken for r in got)
    assert taken == min(budget, capacity)
    assert all(r.full_passes * r.n_tokens <= r.tokens_taken <= min(mixing.EPOCHS, r.full_passes + 1) * r.n_tokens for r in got)
    partial = collections.Counter((r.domain, r.lang, r.source) for r in got if r.full_passes * r.n_tokens < r.tokens_taken < (r.full_passes + 1) * r.n_tokens)
    assert all(n <= 1 for n in partial.values())
    out = mixing.mixed_documents(df)
    assert out.columns == df.columns and sum(len(_words(r.text)) for r in out.collect()) == taken
    assert mixing.mix_report(df.limit(0)).count() == 0


def _learnable(n=400):
    rng = random.Random(4)
    words = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(n):
        t = [rng.choice(words) for _ in range(rng.randrange(12, 80))]
        toxic, good = i % 5 == 0, i % 4 != 0
        if toxic:
            t[rng.randrange(len(t))] = rng.choice(["Idiot,", "worthless", "scum.", "grobianer", "grobianisch"])
        if not good:
            t = [w + rng.choice(["###", "$$$"]) for w in t]
        rows.append((i, " ".join(t), 1.5))
        labels.append((i, int(good), int(toxic)))
    return rows, labels


def test_toxicity(spark):
    rows, labels = _learnable()
    df = spark.createDataFrame([*rows, (None, None, 0.0), (1000, "", 0.0), (7, rows[7][1], 0.0)], "doc_id bigint, text string, p_toxic double")
    table = spark.createDataFrame([(d, t) for d, _, t in labels[:300]] + [(None, 1), (3, None)], "doc_id bigint, toxic int")
    got = {r.doc_id: r.toxic for r in toxicity.toxicity_report(df, table).collect()}
    held = labels[300:]
    assert sum(got[d] == bool(t) for d, _, t in held) >= 0.97 * len(held) and not got[None] and not got[1000]
    kept = toxicity.civil_documents(df, table)
    assert kept.columns == df.columns and kept.count() == df.count() - sum(r.toxic for r in toxicity.toxicity_report(df, table).collect())
    assert toxicity.toxicity_report(df, table.limit(0)).where("toxic").count() == 0
    assert toxicity.toxicity_report(df.limit(0), table).count() == 0


def test_chain_arithmetic():
    """Models and probabilities of a chain against plain loops over folds, features and categories."""
    rng = np.random.default_rng(4)
    x = np.log1p(rng.poisson(0.7, (120, 6)))
    y = np.stack([(x[:, 0] + rng.normal(0, 0.3, 120) > 0.8), (x[:, 1] + x[:, 0] > 1.2)], axis=1).astype(int)
    fold, weight = rng.integers(0, toxicity.FOLDS, 120), rng.integers(1, 4, 120)
    columns = [np.sort(rng.choice(6, 4, replace=False)) for _ in range(toxicity.FOLDS)] + [np.arange(1, 6)]
    chain = toxicity.Chain.fit(np.arange(6).astype(np.uint64), x, y, fold, weight, columns)
    assert chain.features.tolist() == [1, 2, 3, 4, 5]
    earlier = [[] for _ in range(120)]
    for j in range(2):
        held = {}
        for f in range(toxicity.FOLDS):
            rest = [i for i in range(120) if fold[i] != f]
            b = toxicity.logistic(np.array([[*x[i, columns[f]], *earlier[i]] for i in rest]), y[rest, j], weight[rest])
            for i in range(120):
                if fold[i] == f:
                    held[i] = 1 / (1 + np.exp(-(sum(v * w for v, w in zip([*x[i, columns[f]], *earlier[i]], b[:-1], strict=True)) + b[-1])))
        assert chain.models[j] == pytest.approx(toxicity.logistic(np.array([[*x[i, 1:], *earlier[i]] for i in range(120)]), y[:, j], weight), abs=1e-6)
        earlier = [[*earlier[i], held[i]] for i in range(120)]
    p = chain.predict(x[:, 1:])
    for i in range(0, 120, 7):
        got = []
        for b in chain.models:
            got.append(1 / (1 + np.exp(-(sum(v * w for v, w in zip([*x[i, 1:], *got], b[:-1], strict=True)) + b[-1]))))
        assert p[i] == pytest.approx(got)


def test_chain_is_fitted_in_tasks(spark, monkeypatch):
    """The driver fits no model and makes no row of the sample an object; what the tasks fit is what a fit in one place gives."""
    rows, labels = _learnable()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, p_toxic double")
    table = spark.createDataFrame([(d, t) for d, _, t in labels], "doc_id bigint, toxic int")
    seen, fit, collect = [], toxicity.Chain.fit, type(df).collect
    monkeypatch.setattr(toxicity.Chain, "fit", lambda *a: seen.append(a) or fit(*a))
    with monkeypatch.context() as m:
        m.setattr(toxicity, "logistic", None)
        m.setattr(type(df), "collect", lambda self: collect(self) if "times" not in self.columns else pytest.fail("rows of lists"))
        chain = toxicity.fit_chain(df, table)
    names, x, y, fold, weight, columns, _ = seen[0]
    here = fit(names, x.dense(np.ones(len(fold), bool), np.arange(len(names))), y, fold, weight, columns)
    assert chain.features.tolist() == here.features.tolist() and weight.sum() == len(labels)
    assert all(a == pytest.approx(b, abs=1e-6) for a, b in zip(chain.models, here.models, strict=True))
    assert x.dense(np.arange(len(fold)) == 3, np.array([2, 0])).tolist() == [x.dense(np.ones(len(fold), bool), np.arange(len(names)))[3, [2, 0]].tolist()]


def test_groups_follow_the_rows_features_share():
    present = np.zeros((40, 9))
    for row in range(40):
        present[row, (row % 3) * 3 + np.array([row // 3 % 3, (row // 3 + 1) % 3])] = 1
    own = toxicity.groups(present, 3)
    assert len(set(own)) == 3 and all(len(set(own[g * 3 : g * 3 + 3])) == 1 for g in range(3))
    assert toxicity.groups(np.zeros((3, 0)), 3).tolist() == []


def test_positive_unlabelled_quality(spark):
    rows, labels = _learnable()
    df = spark.createDataFrame([*rows, (None, None, 0.0), (1000, "", 0.0)], "doc_id bigint, text string, score double")
    table = spark.createDataFrame([(d, q) for d, q, _ in labels], "doc_id bigint, quality int")
    got = {r.doc_id: r for r in quality_pu.score_quality(df, table).collect()}
    assert len(got) == 402 and all(0 <= r.score <= 1 for r in got.values())
    for d, q, _ in labels:
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)
    held = [(d, q) for d, q, _ in labels if got[d].held_out]
    assert sum(got[d].predicted == q for d, q in held) >= 0.95 * len(held)
    assert {r.score for r in quality_pu.score_quality(df, table.limit(0)).collect()} == {0.0}


def test_prior_estimate():
    rng = np.random.default_rng(0)
    p = rng.normal(2, 1, 5000)
    u = np.concatenate([rng.normal(2, 1, 3500), rng.normal(-2, 1, 1500)])
    assert abs(quality_pu.estimate_prior(p, u) - 0.7) < 0.06


def test_hashes_tell_word_orders_apart():
    a, b = kernel.mix(np.array([1], np.uint64))[0], kernel.mix(np.array([2], np.uint64))[0]
    grams = kernel.shingle_hashes(np.array([a, b, b, a, a, b], np.uint64), 4)
    assert len(set(grams.tolist())) == 3
