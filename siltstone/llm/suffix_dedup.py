"""Removal of byte strings that occur twice, by refining q-gram buckets of suffixes.

Two suffixes share their first ``length`` bytes if they stay in one bucket while buckets
are refined: a bucket's suffixes get the bucket identifiers of later offsets as sort keys,
and each refinement reuses the identifiers that the last one made, which doubles the
depth (25, 50, 100, 200 bytes). Identifiers here are hashes of content rather than
ranks, so that they agree across tasks.

Three rounds of buckets, each of which drops what is alone:

1. *q-grams.* Every window of ``length`` bytes belongs to its smallest q-gram (the
   leftmost of equals), the *anchor*. Equal windows have equal anchors at equal places, so
   only windows under an anchor q-gram that occurs twice can be repeated. Consecutive
   windows with one anchor form a *region*: about two anchors in 177 bytes are all
   that is sorted of the corpus.
2. *Regions.* Under a repeated anchor, regions of equal bytes are removed as a whole.
   Equal regions of one batch are combined before the shuffle.
3. *Windows.* Anchors with different regions compare the windows of one region for each
   content, by identifiers refined to the full length. Regions of an anchor meet in one
   task up to GROUP_REGIONS of them; for more, each window is a row of its own.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, BooleanType, LongType, StringType, StructField, StructType

from siltstone.llm import kernel as K
from siltstone.llm.scratch import discard, materialize
from siltstone.llm.texts import packed, plain, unpack

#: Bytes of a string that must not start twice; bytes of an anchor.
LENGTH, GRAM = 200, 25
#: Different regions of an anchor that one task compares by their bytes.
GROUP_REGIONS = 2048
#: Bytes of regions that one vectorised comparison takes.
CHUNK = 1 << 20

#: Bits of ``at`` that hold a number of windows.
BITS = 16
MOST = (1 << BITS) - 1

U64 = K.U64


def sliding_min(v: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each run of w values, from minima of aligned blocks."""
    m = len(v) - w + 1
    if m <= 0:
        return v[:0]
    x = np.concatenate([v, np.full(-len(v) % w, 2**64 - 1, dtype=np.uint64)]).reshape(-1, w)
    forward = np.minimum.accumulate(x, axis=1).ravel()
    back = np.minimum.accumulate(x[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:m], forward[w - 1 : w - 1 + m])


def gram_ids(data: np.ndarray, q: int) -> np.ndarray:
    """Bucket identifiers of all q-grams."""
    if len(data) < q:
        return np.zeros(0, np.uint64)
    up, down = K.powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(K._BYTE_CODE[data] * up[: len(data)], out=sums[1:])
    return K.mix((sums[q:] - sums[:-q]) * down[: len(data) - q + 1])


def refine(ids: np.ndarray, depth: int, length: int) -> np.ndarray:
    """Identifiers of ``length`` bytes from identifiers of ``depth`` bytes, doubling the depth."""
    while depth < length:
        step = min(depth, length - depth)
        ids = K.mix(ids[: len(ids) - step] * U64(0x9E3779B97F4A7C15) + ids[step:]) + U64(step)
        depth += step
    return ids


def regions(data: np.ndarray, offsets: np.ndarray, length: int, q: int):
    """(row, anchor id, first window, windows, content id) of the regions of some rows."""
    ids = gram_ids(data, q)
    low = sliding_min(((ids >> U64(32)) << U64(32)) | np.arange(len(ids), dtype=np.uint64), length - q + 1)
    if not len(low):
        z = np.zeros(0, np.int64)
        return z, z.astype(np.uint64), z, z, z.astype(np.uint64)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.flatnonzero(row[: len(low)] == row[length - 1 : length - 1 + len(low)])
    anchor, owner = (low[at] & U64(0xFFFFFFFF)).astype(np.int64), row[at]
    if not len(at):
        return at, at.astype(np.uint64), at, at, at.astype(np.uint64)
    first = np.flatnonzero(np.concatenate(([True], (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1]))))
    start, count = at[first], np.diff(np.append(first, len(at)))
    content = K.mix(K.span_hashes(data, start, start + count - 1 + length) + (anchor[first] - start).astype(np.uint64) * U64(0xD1342543DE82EF95))
    return owner[first], ids[anchor[first]], start - offsets[owner[first]], count, content


SCAN = StructType([
    StructField("docref", LongType()), StructField("id", LongType()), StructField("th", LongType()), StructField("n_bytes", LongType()), StructField("sha", StringType()),
    StructField("gram", LongType()), StructField("region", LongType()), StructField("at", LongType()), StructField("multi", BooleanType()),
])


def scan(texts: DataFrame, length: int, q: int) -> DataFrame:
    """Rows of three kinds: documents (sha), anchors (gram) and runs that are known to be repeated.

    ``at`` holds the first window above BITS bits of the number of windows.
    """

    def table(n, **columns):
        return pa.RecordBatch.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, {"long": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}[f.dataType.typeName()]) for f in SCAN.fields], SCAN.names)

    def run(batches):
        ref = TaskContext.get().partitionId() << 33
        for batch in batches:
            found = []
            for row, data, offsets in K.slices(batch.column("text")):
                n = len(offsets) - 1
                raw = memoryview(data)
                sha = [hashlib.sha256(raw[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield table(n, docref=pa.array(np.arange(ref + row, ref + row + n)), id=batch.column("id").slice(row, n), th=batch.column("th").slice(row, n), n_bytes=pa.array(np.diff(offsets)), sha=pa.array(sha))
                owner, gram, start, count, content = regions(data, offsets, length, q)
                found.append((owner + ref + row, gram, content, (start << BITS) + count))
            ref += batch.num_rows
            if not found:
                continue
            doc, gram, content, at = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((content, gram))
            doc, gram, content, at = doc[order], gram[order], content[order], at[order]
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (content[1:] != content[:-1]))) if len(gram) else np.zeros(0, bool)
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(gram)))
            again = np.repeat(count > 1, count)
            if again.any():
                yield table(int(again.sum()), docref=pa.array(doc[again]), at=pa.array(at[again]))
            if len(first):
                yield table(len(first), docref=pa.array(doc[first]), gram=pa.array(gram[first].view(np.int64)), region=pa.array(content[first].view(np.int64)), at=pa.array(at[first]), multi=pa.array(count > 1))

    return texts.mapInArrow(run, SCAN)


RUN = StructType([StructField("docref", LongType()), StructField("at", LongType())])


def runs_of(doc: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs (at most MOST long) of window positions that are sorted within each document."""
    if not len(pos):
        return doc, pos
    new = np.concatenate(([True], (doc[1:] != doc[:-1]) | (pos[1:] != pos[:-1] + 1)))
    index = np.arange(len(pos))
    begin = np.maximum.accumulate(np.where(new, index, 0))
    new |= (index - begin) % MOST == 0
    first = np.flatnonzero(new)
    return doc[first], (pos[first] << BITS) + np.diff(np.append(first, len(pos)))


def compare(rows: DataFrame, length: int, q: int) -> DataFrame:
    """Windows that occur in two regions of an anchor, from rows (gram, docref, at, multi, bytes)."""

    def repeated(held):
        gram, doc, at, multi, raw = zip(*held, strict=True)
        data = np.frombuffer(b"".join(raw), dtype=np.uint8)
        ends = np.cumsum([len(r) for r in raw])
        ids = refine(gram_ids(data, q), q, length)
        counts = ends - np.concatenate(([0], ends[:-1])) - length + 1
        where = K.ragged(ends - counts - length + 1, counts)
        gram, doc, at, multi = np.array(gram, np.int64), np.array(doc, np.int64), np.array(at, np.int64), np.array(multi, bool)
        window, bucket = ids[where], np.repeat(gram, counts)
        order = np.lexsort((bucket, window))
        w, b = window[order], bucket[order]
        same = (w[1:] == w[:-1]) & (b[1:] == b[:-1])
        twice = np.zeros(len(order), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        twice &= ~np.repeat(multi, counts)
        pos = np.repeat(at >> BITS, counts) + K.ragged(np.zeros(len(counts), np.int64), counts)
        return runs_of(np.repeat(doc, counts)[twice], pos[twice])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("gram", "docref", "at", "multi", "bytes")]
            for r in zip(*columns, strict=True):
                if size >= CHUNK and r[0] != held[-1][0]:  # whole anchors only
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in repeated(held)], RUN.names)
                    held, size = [], 0
                held.append(r)
                size += len(r[4])
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in repeated(held)], RUN.names)

    return rows.select("gram", "docref", "at", "multi", "bytes").repartition("gram").sortWithinPartitions("gram").mapInArrow(run, RUN)


CUT = StructType([
    StructField("gram", LongType()), StructField("docref", LongType()), StructField("at", LongType()), StructField("multi", BooleanType()),
    StructField("bytes", BinaryType()), StructField("window", LongType()),
])


def cut_regions(rows: DataFrame, length: int, q: int) -> DataFrame:
    """The bytes of open regions; for anchors with many regions (``hot``) a row for each window."""

    def run(batches):
        for batch in batches:
            texts = unpack(batch.column("z"))
            for i, (doc, found) in enumerate(zip(batch.column("docref").to_pylist(), batch.column("open").to_pylist(), strict=True)):
                raw = texts[i].as_buffer()
                data = np.frombuffer(raw, dtype=np.uint8) if raw is not None and raw.size else np.zeros(0, np.uint8)
                out = [[], [], [], [], []]
                for r in found:
                    start, count = r["at"] >> BITS, r["at"] & MOST
                    piece = data[start : start + count - 1 + length]
                    if r["hot"]:
                        ids = refine(gram_ids(piece, q), q, length).view(np.int64)
                        yield pa.RecordBatch.from_arrays([
                            pa.array(np.full(count, r["gram"])), pa.array(np.full(count, doc)), pa.array((np.arange(start, start + count) << BITS) + 1),
                            pa.array(np.full(count, r["multi"])), pa.nulls(count, pa.binary()), pa.array(ids),
                        ], CUT.names)
                    else:
                        for column, value in zip(out, (r["gram"], doc, r["at"], r["multi"], piece.tobytes()), strict=True):
                            column.append(value)
                if out[0]:
                    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(out, kinds, strict=True)), pa.nulls(len(out[0]), pa.int64())], CUT.names)

    return rows.select("docref", "open", "z").mapInArrow(run, CUT)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = GRAM) -> tuple[DataFrame, DataFrame]:
    """(documents, runs): a row per document (docref, id, th, n_bytes, sha), and the runs of
    repeated windows (docref, runs: as in ``scan``) of those that have any."""
    if not 1 <= q <= length <= MOST:
        raise ValueError(f"a string of {length} bytes with anchors of {q}: 1 <= anchor <= string <= {MOST} is what counts of windows can hold")
    scanned = materialize(scan(plain(docs, id_col, text_col), length, q), "scan")
    documents = scanned.where("sha is not null").select("docref", "id", "th", "n_bytes", "sha")
    anchors = scanned.where("gram is not null").select("docref", "gram", "region", "at", "multi")
    grams = materialize(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram"), "grams")
    met = materialize(anchors.join(grams, "gram"), "met")
    contents = materialize(met.groupBy("gram", "region").agg(F.count(F.lit(1)).alias("n"), F.max("multi").alias("m"), F.min(F.struct("docref", "at")).alias("f")), "contents")
    whole = met.join(contents.where("n > 1").select("gram", "region"), ["gram", "region"]).select("docref", "at")
    whole = materialize(whole.union(scanned.where("sha is null and gram is null").select("docref", "at")), "whole")
    open_grams = materialize(contents.groupBy("gram").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "open-grams")
    discard(met)
    opened = contents.join(open_grams, "gram").select("f.docref", F.struct("gram", "f.at", (F.col("m") | (F.col("n") > 1)).alias("multi"), (F.col("k") > GROUP_REGIONS).alias("hot")).alias("r"))
    by_doc = materialize(opened.groupBy("docref").agg(F.collect_list("r").alias("open")), "opened")
    cut = materialize(cut_regions(fetch(by_doc, documents, packed(docs, id_col, text_col)), length, q), "cut")
    discard(contents, open_grams, by_doc)
    cold = compare(cut.where("bytes is not null"), length, q)
    windows = cut.where("window is not null").select("gram", "window", "docref", "at", "multi")
    shared = materialize(windows.groupBy("gram", "window").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram", "window"), "shared")
    hot = windows.join(shared, ["gram", "window"]).where("not multi").select("docref", "at")
    runs = materialize(whole.union(cold).union(hot).groupBy("docref").agg(F.collect_list("at").alias("runs")), "runs")
    discard(cut, whole, shared, grams)
    return documents, runs


def fetch(rows: DataFrame, documents: DataFrame, texts: DataFrame) -> DataFrame:
    """Rows with docref and the packed text of their document (texts are dealt out once, by id and hash)."""
    key = F.coalesce("id", F.lit(-(2**63)))
    named = rows.join(documents.select("docref", key.alias("idk"), "th"), "docref")
    unique = texts.select(key.alias("idk"), "th", "z").groupBy("idk", "th").agg(F.first("z").alias("z"))
    return named.join(unique, ["idk", "th"])


RESULT = StructType([StructField("docref", LongType()), StructField("id", LongType()), StructField("n_removed", LongType()), StructField("n_spans", LongType()), StructField("kept", StringType()), StructField("kept_sha256", StringType())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, q: int = GRAM, with_text: bool = False) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 (and the kept text) of every document.

    A byte is removed if a string of ``length`` bytes that covers it also starts anywhere
    else, in the same document or another; strings are judged on the input. Null and empty
    texts, and texts shorter than ``length``, lose nothing; repeated rows are copies of each
    other and lose all strings long enough; null ids are kept as they are; an empty table gives no
    rows; very long texts are read whole. Kept text that a cut through a character has broken is
    decoded with replacement. Other columns are not looked at, whatever their names.
    """
    documents, runs = find_repeats(docs, id_col, text_col, length, q)

    def run(batches):
        for batch in batches:
            rows = []
            for doc, at, text in zip(batch.column("docref").to_pylist(), batch.column("runs").to_pylist(), unpack(batch.column("z")), strict=True):
                raw = text.as_buffer()
                data = np.frombuffer(raw, dtype=np.uint8)
                at = np.array(at, dtype=np.int64)
                edge = np.zeros(len(data) + 1, dtype=np.int64)
                np.add.at(edge, at >> BITS, 1)
                np.add.at(edge, (at >> BITS) + (at & MOST) - 1 + length, -1)
                gone = np.cumsum(edge[:-1]) > 0
                left = data[~gone].tobytes()
                spans = int(np.count_nonzero(gone[1:] & ~gone[:-1]) + gone[0])
                rows.append((doc, None, int(gone.sum()), spans, left.decode("utf-8", "replace") if with_text else None, hashlib.sha256(left).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], RESULT.names)

    changed = materialize(fetch(runs, documents, packed(docs, id_col, text_col)).select("docref", "runs", "z").mapInArrow(run, RESULT).drop("id"), "changed")
    discard(runs)
    out = documents.join(changed, "docref", "left")
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return out.select("id", "th", "n_bytes", zero("n_removed"), zero("n_spans"), F.coalesce("kept_sha256", "sha").alias("kept_sha256"), *(["kept"] if with_text else []))


def repeats_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document: strings of 200 bytes."""
    return remove_repeats(docs).select(F.col("id").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")
