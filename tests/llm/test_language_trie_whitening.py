"""Language identification, the prefix trie and whitening against plain versions of them."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

from pyspark.sql import functions as F

from siltstone.llm import language, prefix_trie, whitening

DATA = "/root/testdata/sf0.01"


# language


def _plain_grams(text):
    """n-grams of one text, counted one by one."""
    framed = re.sub(" +", " ", "".join([" ", *(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text), " "]))
    return collections.Counter(g for n in range(1, language.SIZES + 1) for i in range(len(framed) - n + 1) if (g := framed[i : i + n]).strip(" ") or n > 2)


TEXTS = ["Ab c, d É!" * 50, "", "x", "  --", "Straße über 12 " * 40, "a" * 64, "b," * 32, "ﬃ Ǆ", "你好 世界", "Да, нет"]


def test_ngram_counts_are_plain_counts():
    for text, (_, counts, lettered) in zip(TEXTS, language.ngram_counts(TEXTS), strict=True):
        want = _plain_grams(text)
        assert counts.sum() == sum(n for g, n in want.items() if g != " ")
        assert sorted(counts[counts > 0]) == sorted(collections.Counter(n for g, n in want.items() if g != " ").elements()) or len(want) > (counts > 0).sum()
        assert lettered == any(c.isalpha() for c in text)


@pytest.mark.parametrize("piece", [1, 2, 3, 5, 7, 16, 64, 100])
def test_long_texts_go_in_pieces(monkeypatch, piece):
    want = [(i, c.copy(), x) for i, c, x in language.ngram_counts(TEXTS)]
    monkeypatch.setattr(language, "PIECE", piece)
    got = list(language.ngram_counts(TEXTS))
    assert len(got) == len(want)
    for (i, c, x), (j, d, y) in zip(want, got, strict=True):
        assert i == j and x == y and (c == d).all()


def _plain_model(rows):
    """Log-probabilities by plain counting, in the groups of the operator."""
    totals, documents = {}, collections.Counter()
    for lang, text in rows:
        counts = next(language.ngram_counts([text or ""]))[1]
        totals[lang] = totals.get(lang, 0) + counts
        documents[lang] += 1
    logs = {x: np.log((c + language.SMOOTHING) / (c.sum() + language.SMOOTHING * language.BUCKETS)) for x, c in totals.items()}

    def predict(text):
        _, counts, lettered = next(language.ngram_counts([text or ""]))
        if not lettered:
            return "und", 0.0
        z = {x: math.log(documents[x] / sum(documents.values())) + float(counts @ logs[x]) / language.SIZES for x in sorted(logs)}
        best = max(z, key=lambda x: (z[x], [-ord(c) for c in x]))
        return best, 1 / sum(math.exp(v - z[best]) for v in z.values())

    return predict


def test_predictions_are_those_of_a_plain_model(spark):
    rng = random.Random(4)
    words = {"aa": ["ba", "bab", "abba", "bob"], "zz": ["zig", "zag", "quiz", "fizz"]}
    rows = [(i, " ".join(rng.choices(words[x := rng.choice(["aa", "zz"])], k=rng.randrange(1, 30))), x if rng.random() < 0.8 else None, "clash", 0.5) for i in range(150)]
    rows += [(200, None, "aa", "clash", 0.5), (201, "", "zz", "clash", 0.5), (202, "12 -- !", None, "clash", 0.5), (None, "zig zag", "zz", "clash", 0.5), (3, rows[3][1], rows[3][2], "clash", 0.5), (203, "zag " * 3000, None, "clash", 0.5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, lang_pred string, score double")
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1
    predict = _plain_model([(r[2], r[1]) for r in rows if r[2] is not None and not out(r[0])])
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.held_out, r.lang_pred, round(r.score, 4)) for r in language.language_report(docs).collect())
    want = sorted(((r[0] is None, r[0] or 0), out(r[0]), predict(r[1])[0], round(predict(r[1])[1], 4)) for r in rows)
    assert [g[:3] for g in got] == [w[:3] for w in want]
    assert np.allclose([g[3] for g in got], [w[3] for w in want], atol=2e-4)


def test_language_of_given_tables_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) >= 0.99 * len(rows)


def test_language_without_anything_to_learn(spark):
    kind = "doc_id bigint, text string, lang string"
    assert language.language_report(spark.createDataFrame([], kind)).count() == 0
    got = language.language_report(spark.createDataFrame([(1, "some words", None), (2, None, None)], kind)).collect()
    assert {(r.lang_pred, r.score) for r in got} == {("und", 0.0)}


def test_too_many_languages_are_an_error(spark):
    docs = spark.range(language.LANGUAGES + 1).select(F.col("id").alias("doc_id"), F.lit("a").alias("text"), F.col("id").cast("string").alias("lang"))
    with pytest.raises(ValueError, match="languages"):
        language.learn_languages(docs)


# prefix trie


def _plain_trie(rows):
    own = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append((turn is not None, turn or 0, role or "", hashlib.md5((text or "").encode()).hexdigest(), text or ""))
    own = {c: [(r, t) for _, _, r, _, t in sorted(x)] for c, x in own.items()}
    nodes, ends = collections.defaultdict(set), collections.defaultdict(list)
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - int(math.fmod(c, 20))
        path = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            nodes[path[:d]].add(c)
        ends[path].append(c)
    children = collections.Counter(p[:-1] for p in nodes if p)
    out = []
    for p, members in nodes.items():
        below = [q for q in nodes if q[: len(p)] == p]
        saved = sum((len(nodes[q]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", q[-1][1])) for q in below if q)
        ids = ",".join(map(str, sorted(ends.get(p, []))))
        out.append((min(members), len(p), min(nodes[p[:-1]]) if p else None, len(members), children[p], sum(not children[q] for q in below), saved, hashlib.sha256(ids.encode()).hexdigest()))
    return sorted(out, key=repr)


TRIE = "conv_id bigint, turn bigint, role string, text string, depth int, a string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def _conversations(rng):
    rows, texts = [], ["hi", "how are you", "", None, "a  b\tc", "fine\n\nthanks", "ok " * 400]
    for c in [*range(0, 45), *range(-25, -18), 60, 100, 119, 121]:
        if c in (20, 7):
            continue  # a family without its base, a conversation that is not there
        for t in range(rng.choice([1, 2, 3, 3, 4, 6, 9])):
            rows.append((c, rng.choice([t, t, t, None, 2]), rng.choice(["user", "assistant", None]), rng.choice(texts)))
    first = [r[1:] for r in rows if r[0] == 5]
    rows += [(c, *r) for c in range(200, 230) for r in first]  # copies of one conversation
    rows += [rows[3], rows[3], rows[40], (None, 1, "user", "nobody's")]
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_trie_is_the_plain_trie(spark, seed):
    rng = random.Random(seed)
    rows = _conversations(rng)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], TRIE).repartition(5)
    got = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie_report(df).collect()), key=repr)
    assert got == _plain_trie(rows)


def test_one_conversation_over_many_ranges(spark):
    """A conversation with most of the rows is dealt out in pieces; so are its copies."""
    rows = [(c, t, "user", f"turn {t % 7} of many") for c in (40, 41, 42) for t in range(60)] + [(60, 0, "user", "x")]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "17")
    try:
        df = spark.createDataFrame([(*r, 7, "clash") for r in rows], TRIE).repartition(3)
        got = sorted((tuple(r[c] for c in COLUMNS) for r in prefix_trie.trie_report(df).collect()), key=repr)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert got == _plain_trie(rows)


def test_nodes_have_their_turns(spark):
    rows = [(0, 0, "user", "one"), (0, 1, None, "two"), (1, 0, "user", "one"), (1, 1, "bot", None)]
    df = spark.createDataFrame([(*r, 7, "clash") for r in rows], TRIE)
    got = {(r.depth, r.role, r.text) for r in prefix_trie.with_turns(prefix_trie.prefix_trie(df), df).collect()}
    want = {(0, None, None)}
    for c in (0, 1):
        own = [(r[2] or "", r[3] or "") for r in rows if r[0] == c]
        h = zlib.crc32(str(c).encode()) % 4
        want |= {(i + 1, *t) for i, t in enumerate([(r[2] or "", r[3] or "") for r in rows if r[0] == 0][:h] + own[h:])}
    assert got == want


def test_trie_of_nothing_and_of_turnless_conversations(spark):
    assert prefix_trie.trie_report(spark.createDataFrame([], TRIE)).count() == 0
    c = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4 == 3)  # no base, one turn, three of them shared
    got = prefix_trie.trie_report(spark.createDataFrame([(c, 0, "user", "x", 1, "")], TRIE)).collect()
    assert [tuple(r[x] for x in COLUMNS) for r in got] == _plain_trie([(c, 0, "user", "x")])


# whitening


def test_lobpcg_finds_the_largest_eigenvectors():
    rng = np.random.default_rng(3)
    for size, wanted in ((1, 1), (3, 2), (40, 32), (150, 20)):
        a = rng.standard_normal((3 * size, size)) * np.linspace(1, 3, size)
        m = a.T @ a
        products = []
        values, vectors = whitening.lobpcg(lambda b: products.append(b.shape[1]) or m @ b, size, wanted)  # noqa: B023
        assert np.allclose(values, np.linalg.eigvalsh(m)[::-1][:wanted], rtol=1e-10)
        assert np.linalg.norm(m @ vectors - vectors * values, axis=0).max() <= 1e-11 * values[0] and np.allclose(vectors.T @ vectors, np.eye(wanted), atol=1e-10)
        assert size < 100 or len(products) > 5  # by steps, not at once


def _check_whitening(spark, vectors, rows):
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, v string").repartition(3)
    got = whitening.whitening_report(df).toPandas()
    n = len(vectors)
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in vectors]
    sums = [sum(c) for c in zip(*x, strict=True)]
    exact = [[n * a - s for a, s in zip(r, sums, strict=True)] for r in x]
    centred = np.array([[a / n for a in r] for r in exact])
    cov = centred.T @ centred / n
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    k = min(32, int((values > 1e-11 * values[0]).sum()))
    assert len(got) == n * k and set(got.n) == {n} and got.identity_error.max() <= 1e-4
    deviation = collections.Counter((i, sum(a * a for a in r)) for (i, _), r in zip(vectors, exact, strict=True))
    assert collections.Counter(zip(got[got.component == 1].vec_id, got[got.component == 1].deviation, strict=True)) == deviation
    assert np.allclose(got.groupby("component").explained.first(), values[:k] / values.sum(), rtol=1e-6)
    mine = got.sort_values(["vec_id", "component"], kind="stable").whitened.to_numpy().reshape(-1, k) if len({i for i, _ in vectors}) == n else None
    if mine is not None:
        want = (centred @ axes[:, :k] / np.sqrt(values[:k]))[np.argsort([i for i, _ in vectors], kind="stable")]
        sign = np.sign((mine * want).sum(axis=0))
        assert np.allclose(mine * sign, want, atol=1e-6)


def test_whitening_is_that_of_the_whole_covariance(spark):
    rng = np.random.default_rng(8)
    vectors = [(i, [float(c) for c in rng.standard_normal(40) * np.linspace(0.5, 3, 40)]) for i in range(200)]
    odd = [(900, None, ""), (901, [None, *[0.1] * 39], ""), (902, [float("nan"), *[0.1] * 39], ""), (903, [float("inf"), *[0.1] * 39], ""), (904, [float("-inf"), *[0.1] * 39], "")]
    _check_whitening(spark, vectors, [(i, v, "clash") for i, v in vectors] + odd)


def test_whitening_of_few_dimensions_and_copies(spark):
    rng = np.random.default_rng(9)
    vectors = [(i % 20, [float(a), float(b), float(a), -0.5]) for i, (a, b) in enumerate(rng.standard_normal((30, 2)))]  # rank 2
    _check_whitening(spark, vectors, [(i, v, "clash") for i, v in vectors])


def test_whitening_of_tables_without_spread(spark):
    kind = "vec_id bigint, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])], [(1, [0.5, 2.0])], [(1, [0.5, 2.0]), (2, [0.5, 2.0])]):
        assert whitening.whitening_report(spark.createDataFrame(rows, kind)).count() == 0


def test_sums_beyond_64_bits_are_exact():
    centre = whitening.Centre(3, [2**60, 0], 2**60)
    exact = centre.exact(np.array([[2**59, 1], [0, 5]]))
    assert exact.tolist() == [[3 * 2**59 - 2**60, 3], [-(2**60), 15]] and centre.deviation(exact).to_pylist() == [None, None]
    small = whitening.Centre(2, [4, 6], 5)
    assert small.deviation(small.exact(np.array([[1, 2], [3, 4]]))).to_pylist() == [8, 8]
