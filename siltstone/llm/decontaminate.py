"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The patterns are all windows of ``n`` consecutive words of the benchmark items (an
item of fewer words is one pattern). Patterns of equal length share a *shift
table* over blocks of two words: the value says how far the search window may
move on without passing a pattern. Where it is 0, the window's last block picks a
bucket of patterns, and the words' bytes are compared before a match counts.

Documents are scanned once and never shuffled. The benchmark reaches the tasks in blocks of
at most ``block_bytes`` of text each (one larger item is a block of its own). A block's
tables are built once, on the driver, as flat arrays (about 12 bytes for each byte of text, and 8
to 16 entries of a shift table for each pattern) and broadcast; workers read them back
block by block and keep as many as HELD_BYTES allows, so a benchmark of any size works.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

from siltstone.llm import kernel as K
from siltstone.llm.rows import ROW, append, with_row

#: Words in a pattern.
WINDOW = 10
#: Benchmark text that one broadcast block holds at most, and tables that a worker keeps from batch to batch.
BLOCK_BYTES, HELD_BYTES = 4 << 20, 384 << 20
#: log2 of the entries of a shift table for each pattern; least and most of them.
SPARE_BITS, LEAST_BITS, MOST_BITS = 3, 12, 26
#: Window starts that one search lane covers.
LANE = 256


class Words:
    """The lower-cased words of texts: hashes, and their letters without what stands between them."""

    def __init__(self, text: np.ndarray, offsets: np.ndarray):
        self.starts, self.ends, self.first = K.word_spans(text, offsets, K.ALNUM)
        self.hashes = K.span_hashes(text, self.starts, self.ends)
        self.text = text

    def pack(self) -> Words:
        """Letters in one run of bytes, for comparison; word i is letters[at[i]:at[i + 1]]."""
        self.letters = self.text[K.ALNUM[self.text]].tobytes()
        self.at = np.concatenate(([0], np.cumsum(self.ends - self.starts)))
        return self

    def equal(self, i: int, other: Words, j: int, n: int) -> bool:
        """Whether n words from the i-th are byte by byte those of the other from its j-th on."""
        a, b = self.at[i : i + n + 1], other.at[j : j + n + 1]
        return self.letters[a[0] : a[-1]] == other.letters[b[0] : b[-1]] and np.array_equal(a - a[0], b - b[0])


def _block_index(first: np.ndarray, last: np.ndarray, bits: int) -> np.ndarray:
    """Table index of a block of two words (of one word: the same hash twice)."""
    return (K.mix(first * K.U64(0x9E3779B97F4A7C15) + last) >> K.U64(64 - bits)).astype(np.int64)


class PatternGroup:
    """Patterns of one length, sorted by suffix bucket, with their shift table.

    ``begin`` is where a pattern's words stand first in ``words``, ``items[own[p]:own[p + 1]]`` the
    items of pattern p.
    """

    def __init__(self, length: int, words: Words, begin: np.ndarray, item: np.ndarray):
        self.length, self.words = length, words
        size = min(2, length)
        self.bits = int(np.clip(np.ceil(np.log2(len(begin) + 1)) + SPARE_BITS, LEAST_BITS, MOST_BITS))
        at = lambda k: words.hashes[begin + k]
        self.shift = np.full(1 << self.bits, length - size + 1, dtype=np.uint8 if length < 255 else np.int32)
        for end in range(size - 1, length):
            np.minimum.at(self.shift, _block_index(at(end - size + 1), at(end), self.bits), length - 1 - end)
        whole = K.shingle_hashes(words.hashes, length)[begin]
        keys = self.bucket_keys(at(length - size), at(length - 1), whole)
        order = np.lexsort((item, whole, keys))
        begin, item, keys, whole = begin[order], item[order], keys[order], whole[order]
        new = np.concatenate(([True], (keys[1:] != keys[:-1]) | (whole[1:] != whole[:-1])))
        once = new | np.concatenate(([True], item[1:] != item[:-1]))
        self.begin, self.keys = begin[new].astype(np.int32), keys[new]
        self.items = item[once].astype(np.int32)
        self.own = np.append(np.flatnonzero(new[once]), len(self.items)).astype(np.int32)

    def bucket_keys(self, first: np.ndarray, last: np.ndarray, window: np.ndarray) -> np.ndarray:
        """The suffix bucket in the high bits, the window's hash orders a bucket's patterns."""
        return (_block_index(first, last, self.bits).astype(np.uint64) << K.U64(64 - self.bits)) | (window >> K.U64(self.bits))

    def search(self, words: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window start, pattern) of windows whose word hashes agree with a pattern."""
        n, size = self.length, min(2, self.length)
        counts = np.maximum(np.diff(firsts) - n + 1, 0)
        lanes = -(-counts // LANE)
        pos = K.ragged(np.zeros(len(lanes), np.int64), lanes) * LANE + np.repeat(firsts[:-1], lanes)
        stop = np.minimum(pos + LANE, np.repeat(firsts[:-1] + counts, lanes))
        found = []
        while len(pos):
            step = self.shift[_block_index(words[pos + n - size], words[pos + n - 1], self.bits)]
            if len(hits := pos[step == 0]):
                found.append(hits)
            pos = pos + np.maximum(step, 1)
            live = pos < stop
            pos, stop = pos[live], stop[live]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.concatenate(found)
        window = words[at[:, None] + np.arange(n)]
        keys = self.bucket_keys(window[:, -size], window[:, -1], K.shingle_hashes(window.ravel(), n)[::n])
        lo = np.searchsorted(self.keys, keys, "left")
        many = np.searchsorted(self.keys, keys, "right") - lo
        pattern = K.ragged(lo, many)
        at, window = np.repeat(at, many), np.repeat(window, many, axis=0)
        same = (self.words.hashes[self.begin[pattern][:, None] + np.arange(n)] == window).all(axis=1)
        return at[same], pattern[same]


@dataclass
class Block:
    """The compiled patterns of some items."""

    names: list[str]
    groups: list[PatternGroup]

    @property
    def size(self) -> int:
        """Bytes of its arrays, roughly."""
        words = sum(x.nbytes for x in (self.groups[0].words.hashes, self.groups[0].words.at)) if self.groups else 0
        return words + sum(x.nbytes for g in self.groups for x in (g.shift, g.begin, g.keys, g.items, g.own))


def compile_patterns(items: list[tuple[str, str | None]], n: int = WINDOW) -> Block:
    """Pattern groups by length from (item id, text) pairs; items of equal ids are one."""
    raw = [(t or "").encode() for _, t in items]
    offsets = np.concatenate(([0], np.cumsum([len(r) for r in raw], dtype=np.int64)))
    words = Words(K.LOWER[np.frombuffer(b"".join(raw), dtype=np.uint8)], offsets).pack()
    names = sorted({i for i, _ in items})
    place = {name: i for i, name in enumerate(names)}
    item = np.array([place[i] for i, _ in items], dtype=np.int64)
    count = np.diff(words.first)
    length = np.minimum(count, n)
    groups = []
    for size in np.unique(length[length > 0]).tolist():
        own = np.flatnonzero(length == size)
        many = count[own] - size + 1
        groups.append(PatternGroup(size, words, K.ragged(words.first[own], many), np.repeat(item[own], many)))
    del words.text, words.starts, words.ends, words.first
    return Block(names, groups)


def scan(column: pa.Array, blocks) -> "list[tuple]":
    """Per run of rows: (first row, words per row, hit words per row, runs of hit words, item ids)."""
    parts = []
    for row, data, offsets in K.slices(column):
        words = Words(K.LOWER[data], offsets)
        parts.append((row, words, np.zeros(len(words.starts) + 1, np.int64), [set() for _ in range(len(offsets) - 1)]))
    for block in blocks():
        for _, words, delta, items in parts:
            for g in block.groups:
                at, pattern = g.search(words.hashes, words.first)
                if not len(at):
                    continue
                if not hasattr(words, "letters"):
                    words.pack()
                owner = np.searchsorted(words.first, at, "right") - 1
                for s, p, d in zip(at.tolist(), pattern.tolist(), owner.tolist(), strict=True):
                    if words.equal(s, g.words, int(g.begin[p]), g.length):  # the direct comparison
                        delta[s] += 1
                        delta[s + g.length] -= 1
                        items[d].update(block.names[i] for i in g.items[g.own[p] : g.own[p + 1]])
    for row, words, delta, items in parts:
        first = words.first
        hit = np.cumsum(delta[:-1]) > 0
        total = np.concatenate(([0], np.cumsum(hit)))
        spans = []
        for d, found in enumerate(items):
            a, b = first[d], first[d + 1]
            if found:
                edge = np.flatnonzero(np.diff(np.concatenate(([0], hit[a:b].astype(np.int8), [0]))))
                spans.append([{"start": int(s), "end": int(e)} for s, e in edge.reshape(-1, 2)])
            else:
                spans.append([])
        yield row, np.diff(first), total[first[1:]] - total[first[:-1]], spans, [sorted(s) for s in items]


SPAN = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))


def find_contamination(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text",
    n: int = WINDOW, keep: list[str] | None = None, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Occurrences of benchmark windows in documents.

    Result, one row per input row: ``row`` (struct of the kept input columns, so that no
    name can clash), ``n_words``, ``n_hit``, ``spans`` (runs of hit words, end exclusive)
    and ``items`` (sorted ids of the items with a window in the document).

    Null or empty texts have no words and hit nothing, as documents and as items; a null
    item id takes part as ``''``; repeated rows are scanned and returned one by one; an
    empty benchmark hits nothing; very long texts are searched in lanes, in full.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(benchmark[f"`{item_col}`"].cast("string"), F.lit("")).alias("item"), benchmark[f"`{item_text_col}`"].alias("text"))
    held: list = []
    block: list[tuple[str, str]] = []
    size = 0
    room = HELD_BYTES

    def send():
        nonlocal room
        compiled = compile_patterns(block, n)
        room -= compiled.size
        held.append((spark.sparkContext.broadcast(compiled), room >= 0))

    for r in items.toLocalIterator():  # one partition at a time; what the driver's Python holds is one block
        if block and size + len(r["text"] or "") > block_bytes:
            send()
            block, size = [], 0
        block.append((r["item"], r["text"] or ""))
        size += len(r["text"] or "")
    send()

    def blocks():
        for b, stays in held:
            yield b.value
            if not stays:
                b.__dict__.pop("_value", None)  # the worker reads it again from its local copy

    def fn(batch):
        for row, n_words, n_hit, spans, found in scan(batch.column("text"), blocks):
            yield row, len(n_words), {
                "n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()),
                "spans": pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
                "items": pa.array(found, pa.list_(pa.string())),
            }

    fields = [StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("spans", SPAN), StructField("items", ArrayType(StringType()))]
    return append(with_row(docs, {"text": text_col}, keep), fn, fields)


def contamination_report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated (n_hit > 0) for every document."""
    found = find_contamination(docs, benchmark, keep=["doc_id"])
    return found.select(
        F.col(f"{ROW}.doc_id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without any benchmark window, with their own columns."""
    return find_contamination(docs, benchmark).where("n_hit = 0").select(f"{ROW}.*")
