"""Exact Jaccard join of documents on word shingles, with a count-vector R-tree.

Documents are hashed to sets of k-word shingles; equal sets are one *class* from then
on. A class is a point: its shingles are hashed into DIMENSIONS groups and the groups are
counted. The sum over groups of the smaller counts bounds an overlap from above, for two
points and for a point and the upper corner of an R-tree node.

The index is spread over tasks by shared shingles: two sets of a Jaccard similarity of t at least
share one of the first ``n - ceil(t n) + 1`` shingles of either, in any common order.
The order puts shingles that are rare in the corpus first (counted in one pass, in a
table of fixed size), so common passages build no large blocks. A *block* is all
classes with one shingle in their prefix.

1. In each block, a stream over its rows in order of size pairs every class with the first
   of its size band (a star, never all pairs). Pairs that pass the bound are verified on
   the whole sets; links give components. Blocks of very frequent shingles are streamed in
   several parts; what the parts leave apart is left to step 2.
2. Blocks of three rows or more that still hold several components are searched: points go
   into R-trees of about LEAF_ROWS rows, and the rows outside the block's largest component
   are the queries, dealt out in runs of LEAF_ROWS as well. A pair comes out if sizes, the
   places of the block's shingle in the two orders and the count vectors all allow a link,
   and once in a task, however many blocks it shares there. First each query verifies its
   NEAREST candidates of other components, which joins most of what belongs together; then
   all candidates of different components that are left are verified. Any link between
   components that step 1 left apart is found here: its two ends share a block, and in
   that of their first common shingle its places allow the link.

Texts that are only parts of each other's family share passages, which are frequent and so
come last in the order; where they still share a block, bounds keep them from coming out.
The texts of the classes are written once, compressed, and read again for each verification.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from siltstone.llm import kernel as K
from siltstone.llm.components import connected_components
from siltstone.llm.scratch import discard, materialize
from siltstone.llm.texts import named, packed, plain, unpack

#: Groups of a count vector; counts are held in 8 bits, or in 16 if one of them needs more.
DIMENSIONS = 256
#: Candidates that a query verifies before the full search.
NEAREST = 3
#: log2 of the counters that order shingles by frequency, and the parts they are summed in.
COUNTER_BITS, COUNTER_PARTS = 19, 64
#: Points of one R-tree and queries of one task, and children of a node.
LEAF_ROWS, FAN = 1024, 16
#: log2 of the rows from which a block is streamed in parts, and of the times that it must exceed the mean counter.
SPLIT_BITS, SPLIT_OVER = 12, 3
#: Pairs that a task remembers so as not to repeat them; then it starts anew.
REMEMBERED = 1 << 20
#: Classes of which verification sends the identifiers to the texts; of more, both are dealt out.
SENT_IDS = 1 << 20

PRINT = StructType([
    StructField("id", LongType()), StructField("th", LongType()), StructField("n", LongType()), StructField("sa", LongType()), StructField("sb", LongType()),
    StructField("vec", BinaryType()), StructField("part", IntegerType()), StructField("counts", BinaryType()),
])


def needed(na, nb, num: int, den: int):
    """Smallest overlap of sets of these sizes with den * overlap >= num * union."""
    return -(-num * (na + nb) // (num + den))


def count_vector(grams: np.ndarray) -> bytes:
    counts = np.bincount((grams & K.U64(DIMENSIONS - 1)).astype(np.int64), minlength=DIMENSIONS)
    return (counts.astype(np.uint8) if counts.max() < 256 else np.minimum(counts, 65535).astype("<u2")).tobytes()


def vectors(column: pa.Array) -> np.ndarray:
    """Count vectors as rows; a set with a count that is cut off at 16 bits bounds nothing."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    raw = column.to_pylist()
    wide = np.array([len(r) > DIMENSIONS for r in raw], dtype=bool)
    out = np.empty((len(raw), DIMENSIONS), dtype=np.int32)
    for rows, kind in ((~wide, np.uint8), (wide, "<u2")):
        out[rows] = np.frombuffer(b"".join(r for r, own in zip(raw, rows, strict=True) if own), dtype=kind).reshape(-1, DIMENSIONS)
    out[(out == 65535).any(axis=1)] = 1 << 22
    return out


def bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima of rows of a and b: no smaller than the overlaps."""
    return np.minimum(a, b).sum(axis=-1)


class RTree:
    """Packed R-tree over count vectors: sort-tile on the widest coordinates, upper corners in the nodes."""

    def __init__(self, points: np.ndarray, sizes: np.ndarray):
        order = np.lexsort((*(points[:, d] for d in np.argsort(points.std(axis=0))[-3:]), sizes))
        self.order, self.points, self.sizes = order, points[order], sizes[order]
        self.levels = []  # from the leaves up: (upper corners, smallest and largest set of a node)
        top, low, high = self.points, self.sizes, self.sizes
        while len(top) > FAN:
            at = np.arange(0, len(top), FAN)
            top, low, high = np.maximum.reduceat(top, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at)
            self.levels.append((top, low, high))

    def search(self, points: np.ndarray, sizes: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, indexed point, bound) of pairs whose sizes and bound allow the similarity."""
        query = np.arange(len(points))
        top = len(self.levels[-1][0]) if self.levels else len(self.points)
        q, node = np.repeat(query, top), np.tile(np.arange(top), len(query))
        for level in range(len(self.levels), -1, -1):
            if level:
                corner, low, high = self.levels[level - 1]
            else:
                corner, low, high = self.points, self.sizes, self.sizes
            fits = (den * high[node] >= num * sizes[q]) & (num * low[node] <= den * sizes[q])
            q, node = q[fits], node[fits]
            most = np.zeros(len(q), dtype=np.int64)
            for at in range(0, len(q), 1 << 13):  # bounded memory
                most[at : at + (1 << 13)] = bound(points[q[at : at + (1 << 13)]], corner[node[at : at + (1 << 13)]])
            keep = most >= needed(sizes[q], np.maximum(low[node], -(-num * sizes[q] // den)), num, den)
            q, node, most = q[keep], node[keep], most[keep]
            if level:
                below = len(self.levels[level - 2][0]) if level > 1 else len(self.points)
                q, node = np.repeat(q, FAN), (node[:, None] * FAN + np.arange(FAN)).ravel()
                q, node = q[node < below], node[node < below]
        return q, self.order[node], most


def fingerprints(docs: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """A row per document (id, text hash, set size, set signature, count vector), and the
    frequency counters of each task in rows with ``part``."""

    def run(batches):
        counters = np.zeros(1 << COUNTER_BITS, dtype=np.int64)
        for batch in batches:
            for row, data, offsets in K.slices(batch.column("text"), K.SLICE_BYTES):
                out = []
                for grams in K.shingle_sets(data, offsets, k):
                    mixed = K.mix(grams * K.U64(0x2545F4914F6CDD1D) + K.U64(7))
                    out.append((len(grams), int(mixed.sum(dtype=np.uint64).astype(np.int64)), int(np.bitwise_xor.reduce(K.mix(mixed + K.U64(3)), initial=K.U64(0)).astype(np.int64)), count_vector(grams)))
                    np.add.at(counters, (grams >> K.U64(64 - COUNTER_BITS)).astype(np.int64), 1)
                n = len(out)
                sizes, sa, sb, vec = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays([
                    batch.column("id").slice(row, n), batch.column("th").slice(row, n), pa.array(sizes, pa.int64()), pa.array(sa, pa.int64()), pa.array(sb, pa.int64()),
                    K.as_binary(list(vec)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()),
                ], PRINT.names)
        if counters.any():
            parts = np.minimum(counters, 65535).astype("<u2").reshape(COUNTER_PARTS, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(COUNTER_PARTS, f) for f in (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary())] + [pa.array(range(COUNTER_PARTS), pa.int32()), K.as_binary([p.tobytes() for p in parts])], PRINT.names
            )

    return plain(docs, id_col, text_col).mapInArrow(run, PRINT)


def frequency_levels(prints: DataFrame) -> np.ndarray:
    """log2 of each counter's sum over all tasks; its size is fixed, whatever the corpus."""
    schema = StructType([StructField("part", IntegerType()), StructField("counts", BinaryType())])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, counts in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                sums[part] = sums.get(part, 0) + np.frombuffer(counts, dtype="<u2").astype(np.int64)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), K.as_binary([np.log2(s + 1).astype(np.uint8).tobytes() for s in sums.values()])], schema.names)

    rows = prints.where("part is not null").select("part", "counts").repartition("part").mapInArrow(add, schema).collect()
    out = np.zeros((COUNTER_PARTS, (1 << COUNTER_BITS) // COUNTER_PARTS), dtype=np.uint8)
    for r in rows:
        out[r["part"]] = np.frombuffer(r["counts"], dtype=np.uint8)
    return out.ravel()


def prefixes(texts: DataFrame, levels: np.ndarray, k: int, num: int, den: int) -> DataFrame:
    """(gram, salt, class_id, size): the rarest shingles of each class, enough to meet any partner.

    ``size`` is the set's size and the shingle's place in the order; ``salt`` deals out a very
    frequent shingle and is -1 for all others.
    """
    schema = StructType([StructField("gram", LongType()), StructField("salt", IntegerType()), StructField("class_id", LongType()), StructField("size", LongType())])
    held = texts.sparkSession.sparkContext.broadcast(levels)
    base = max(SPLIT_BITS, int(np.log2(np.mean(2.0**levels))) + SPLIT_OVER)

    def run(batches):
        for batch in batches:
            ids = batch.column("class_id").to_numpy()
            for row, data, offsets in K.slices(unpack(batch.column("z"))):
                grams, sizes, counts = [], [], []
                for own in K.shingle_sets(data, offsets, k):
                    n = len(own)
                    take = n - -(-num * n // den) + 1 if n else 0
                    # ascending (level, gram): the level goes above the gram's high bits
                    rank = (held.value[(own >> K.U64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.uint64) << K.U64(58)) | (own >> K.U64(6))
                    first = np.argpartition(rank, take - 1)[:take] if 0 < take < n else np.arange(n)
                    grams.append(own[first[np.argsort(rank[first], kind="stable")]])
                    sizes.append((n << 32) + np.arange(take))
                    counts.append(take)
                gram, own_ids = np.concatenate(grams), np.repeat(ids[row : row + len(counts)], counts)
                over = np.maximum(held.value[(gram >> K.U64(64 - COUNTER_BITS)).astype(np.int64)].astype(np.int64) - base, 0)
                salt = np.where(over > 0, (K.mix(own_ids.view(np.uint64)) >> K.U64(20)).astype(np.int64) & ((1 << np.minimum(over, 30)) - 1), -1)
                yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64)), pa.array(salt.astype(np.int32)), pa.array(own_ids), pa.array(np.concatenate(sizes).astype(np.int64))], schema.names)

    return texts.select("class_id", "z").mapInArrow(run, schema)


BLOCK = StructType([StructField("gram", LongType()), StructField("a", LongType()), StructField("b", LongType())])


def stars(rows: DataFrame, num: int, den: int) -> DataFrame:
    """From sorted blocks: pairs (gram null, a, b) and the rows (gram, class, size) of blocks of three or more, or in parts."""
    log = np.log(den / num) if den > num else np.log(2)

    def run(batches):
        # of the last block so far: its key, rows, its first two rows, first of the last band, last row
        key, seen, first2, rep, band, last = None, 0, [], None, None, None
        for batch in batches:
            g, salt, c, size = (batch.column(i).to_numpy() for i in range(4))
            if not len(g):
                continue
            n = size >> 32
            bands = np.floor(np.log(n) / log).astype(np.int64)
            joined = (g[0], salt[0]) == key
            new_block = np.concatenate(([not joined], (g[1:] != g[:-1]) | (salt[1:] != salt[:-1])))
            new_band = new_block | np.concatenate(([not joined or bands[0] != band], bands[1:] != bands[:-1]))
            at = np.arange(len(g))
            rep_at = np.maximum.accumulate(np.where(new_band, at, -1))
            reps = np.where(rep_at >= 0, c[np.maximum(rep_at, 0)], rep if rep is not None else 0)
            star = ~new_band
            prev_c = np.concatenate(([last[0] if last else 0], c[:-1]))
            prev_n = np.concatenate(([last[1] if last else 0], n[:-1]))
            bridge = new_band & ~new_block & (den * prev_n >= num * n)
            a, b = np.concatenate([reps[star], prev_c[bridge]]), np.concatenate([c[star], c[bridge]])
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.nulls(len(a), pa.int64()), pa.array(a), pa.array(b)], BLOCK.names)
            # blocks: their sizes so far, the first one's with what came before
            begin = np.flatnonzero(new_block)
            starts = begin if len(begin) and begin[0] == 0 else np.concatenate(([0], begin))
            counts = np.diff(np.concatenate((starts, [len(g)])))
            total = counts + np.where((starts == 0) & joined, seen, 0)
            wide = np.repeat(total >= 3, counts) | (salt >= 0)
            og, oc, on = g[wide], c[wide], size[wide]
            if joined and total[0] >= 3 and seen < 3 and salt[0] < 0:  # its rows from earlier batches, held back
                og, oc, on = np.concatenate([[key[0]] * len(first2), og]), np.concatenate([[x[0] for x in first2], oc]), np.concatenate([[x[1] for x in first2], on])
            if len(og):
                yield pa.RecordBatch.from_arrays([pa.array(og.astype(np.int64)), pa.array(oc.astype(np.int64)), pa.array(on.astype(np.int64))], BLOCK.names)
            s = starts[-1]
            keep = first2 if s == 0 and joined else []
            first2 = (keep + [(int(c[i]), int(size[i])) for i in range(s, min(len(g), s + 2))])[:2]
            key, seen, rep, band, last = (g[-1], salt[-1]), int(total[-1]), reps[-1], bands[-1], (c[-1], n[-1])

    return rows.repartition("gram", "salt").sortWithinPartitions("gram", "salt", "size", "class_id").mapInArrow(run, BLOCK)


def verify(pairs: DataFrame, classes: DataFrame, texts: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) of classes that link: first by the bound, then on the whole sets."""
    pair = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def bounded(batches):
        for batch in batches:
            na, nb = batch.column("na").to_numpy(), batch.column("nb").to_numpy()
            ok = (np.minimum(na, nb) * den >= num * np.maximum(na, nb)) & (bound(vectors(batch.column("va")), vectors(batch.column("vb"))) >= needed(na, nb, num, den)) if len(na) else na > 0
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(pa.array(ok)), batch.column("b").filter(pa.array(ok))], pair.names)

    def side(c):
        return classes.select(F.col("class_id").alias(c), F.col("n").alias("n" + c), F.col("vec").alias("v" + c))

    left = materialize(pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(bounded, pair), "bounded")
    wanted = materialize(left.select(F.col("a").alias("class_id")).union(left.select("b")).distinct(), "wanted")
    if wanted.count() <= SENT_IDS:
        wanted = F.broadcast(wanted)
    schema = StructType([StructField("class_id", LongType()), StructField("grams", BinaryType())])

    def whole(batches):
        for batch in batches:
            for row, data, offsets in K.slices(unpack(batch.column("z"))):
                sets = [s.tobytes() for s in K.shingle_sets(data, offsets, k)]
                yield pa.RecordBatch.from_arrays([batch.column("class_id").slice(row, len(sets)), K.as_binary(sets)], schema.names)

    sets = materialize(texts.join(wanted, "class_id").select("class_id", "z").mapInArrow(whole, schema), "sets")

    def exact(batches):
        for batch in batches:
            hit = []
            for x, y in zip(batch.column("sa"), batch.column("sb"), strict=True):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                same = len(x) + len(y) - len(np.union1d(x, y)) if len(x) * len(y) else 0
                hit.append(den * same >= num * (len(x) + len(y) - same))
            keep = pa.array(hit, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(keep), batch.column("b").filter(keep)], pair.names)

    set_of = lambda c: sets.select(F.col("class_id").alias(c), F.col("grams").alias("s" + c))
    links = materialize(left.join(set_of("a"), "a").join(set_of("b"), "b").select("a", "b", "sa", "sb").mapInArrow(exact, pair), "links")
    discard(left, sets, wanted)
    return links


def search_blocks(rows: DataFrame, num: int, den: int, nearest: int | None) -> DataFrame:
    """Candidate pairs of different components from rows (gram, leaf, run, query, class_id, component, size, vec).

    Rows of a (gram, leaf, run) with query = false are indexed, then its queries stream through;
    with ``nearest`` only that many candidates of a query come out, those of the highest bounds.
    """
    pair = StructType([StructField("a", LongType()), StructField("b", LongType())])

    def run(batches):
        key, tree, held, seen = None, None, [], set()

        def points(parts):
            return tuple(np.concatenate(x) for x in zip(*parts, strict=True))

        for batch in batches:
            block = [batch.column(x).to_numpy() for x in ("gram", "leaf", "run")]
            query = batch.column("query").to_numpy(zero_copy_only=False)
            c, comp, size = (batch.column(x).to_numpy() for x in ("class_id", "component", "size"))
            n, place = size >> 32, size & 0xFFFFFFFF
            v = vectors(batch.column("vec")) if len(n) else None
            edge = np.flatnonzero(np.logical_or.reduce([x[1:] != x[:-1] for x in (*block, query)])) + 1
            bounds = [0, *edge.tolist(), len(n)]
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if s == e:
                    continue
                if (own := tuple(x[s] for x in block)) != key:
                    key, tree, held = own, None, []
                if not query[s]:
                    held.append((c[s:e], comp[s:e], n[s:e], place[s:e], v[s:e]))
                    continue
                if not held:
                    continue
                if tree is None:
                    ic, icomp, isize, iplace, ivec = points(held)
                    tree = RTree(ivec, isize)
                q, i, most = tree.search(v[s:e], n[s:e], num, den)
                # what stands from the block's shingle on must suffice, else a pair that links has an earlier one in common
                rest = np.minimum(n[s:e][q] - place[s:e][q], isize[i] - iplace[i])
                differ = (comp[s:e][q] != icomp[i]) & (rest >= needed(n[s:e][q], isize[i], num, den))
                q, i, most = q[differ], i[differ], most[differ]
                if nearest and len(q):
                    order = np.lexsort((ic[i], -most / (n[s:e][q] + isize[i]), q))
                    q, i = q[order], i[order]
                    start = np.flatnonzero(np.concatenate(([True], q[1:] != q[:-1])))
                    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
                    q, i = q[rank < nearest], i[rank < nearest]
                x, y = c[s:e][q], ic[i]
                found = set(zip(np.minimum(x, y).tolist(), np.maximum(x, y).tolist(), strict=True)) - seen
                if found:
                    if len(seen) > REMEMBERED:
                        seen.clear()
                    seen |= found
                    a, b = zip(*found, strict=True)
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], pair.names)

    return rows.repartition("gram", "leaf", "run").sortWithinPartitions("gram", "leaf", "run", "query").mapInArrow(run, pair)


def open_pairs(wide: DataFrame, joined: DataFrame, classes: DataFrame, num: int, den: int, nearest: int | None) -> DataFrame:
    """Candidates between components that share a block, from the blocks (gram, class_id, size).

    A block beyond LEAF_ROWS is split into several trees, and its rows outside the largest
    component, the queries, into runs: each run meets each tree in a task of its own.
    """
    rows = materialize(wide.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").select("gram", "class_id", "size", F.coalesce("component", "class_id").alias("component")), "wide")
    counts = rows.groupBy("gram", "component").agg(F.count(F.lit(1)).alias("c"))
    sizes = counts.groupBy("gram").agg(F.sum("c").alias("rows"), F.count(F.lit(1)).alias("components"), F.max_by("component", "c").alias("major"), F.max("c").alias("most"))
    parts = lambda n: F.ceil(n / LEAF_ROWS).cast("int")
    mixed = materialize(sizes.where("components > 1").select("gram", "major", parts(F.col("rows")).alias("leaves"), parts(F.col("rows") - F.col("most")).alias("runs")), "mixed")
    own = lambda n: F.pmod(F.xxhash64("class_id"), F.col(n).cast("long")).cast("int")
    each = lambda n, make: F.transform(F.sequence(F.lit(0), F.col(n) - 1), make)
    place = lambda leaf, run, query: F.struct(leaf.alias("leaf"), run.alias("run"), F.lit(query).alias("query"))
    indexed = each("runs", lambda i: place(own("leaves"), i, False))
    asked = each("leaves", lambda i: place(i, own("runs"), True))
    placed = rows.join(mixed, "gram").withColumn("at", F.explode(F.when(F.col("component") == F.col("major"), indexed).otherwise(F.concat(indexed, asked))))
    placed = materialize(placed.select("gram", "at.leaf", "at.run", "at.query", "class_id", "component", "size"), "placed")
    points = placed.join(classes.select("class_id", "vec"), "class_id").select("gram", "leaf", "run", "query", "class_id", "component", "size", "vec")
    found = materialize(search_blocks(points, num, den, nearest).distinct(), "candidates")
    discard(rows, mixed, placed)
    return found


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """A row per document: id, th (hash of the text), n_shingles and component_id.

    Two documents link if ``den * |intersection| >= num * |union|`` of their sets of k-word
    shingles; component_id is the smallest id that links reach, the document included.

    Null and empty texts, and texts of white space, have an empty set, link with nothing
    and are their own component; a text of fewer than k words is one shingle; repeated rows
    and equal texts are one class; a null id gives way to any other id; an empty table
    gives no rows. Very long texts go through whole, one at a time; equally rare shingles are
    taken in order of their hashes. Other columns of ``docs`` are not looked at, whatever their names.
    """
    prints = materialize(fingerprints(docs, id_col, text_col, k), "prints")
    grouped = prints.where("part is null and n > 0").groupBy("n", "sa", "sb").agg(F.min(F.struct("id", "th", "vec")).alias("f"), F.min("id").alias("low"))
    classes = materialize(grouped.select(F.monotonically_increasing_id().alias("class_id"), "n", "sa", "sb", "f.id", "f.th", "f.vec", "low"), "classes")
    levels = frequency_levels(prints)
    texts = materialize(named(packed(docs, id_col, text_col), classes, "class_id"), "texts")
    blocks = materialize(stars(prefixes(texts, levels, k, num, den), num, den), "blocks")
    pairs = blocks.where("gram is null").select("a", "b").where("a <> b").distinct()
    links = verify(pairs, classes, texts, k, num, den)
    joined = connected_components(links)
    done = [blocks, texts, classes, links, joined]
    wide = blocks.where("gram is not null").select("gram", F.col("a").alias("class_id"), F.col("b").alias("size"))
    for nearest in (NEAREST, None):  # what the stars have left: the likely links first, then all
        more = open_pairs(wide, joined, classes, num, den, nearest)
        if not more.isEmpty():
            new = verify(more, classes, texts, k, num, den)
            links = links.union(new)
            joined = connected_components(links)
            done += [new, joined]
        discard(more)
    named_classes = classes.join(joined.withColumnRenamed("node", "class_id"), "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    lows = materialize(named_classes.groupBy("component").agg(F.min("low").alias("component_id")), "lows")
    final = materialize(named_classes.join(lows, "component").select("n", "sa", "sb", "component_id"), "final")
    discard(*done, lows)
    out = prints.where("part is null").select("id", "th", "n", "sa", "sb").join(final, ["n", "sa", "sb"], "left")
    return out.select("id", "th", F.col("n").alias("n_shingles"), F.coalesce("component_id", "id").alias("component_id"))


def jaccard_report(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every document: 4 words, similarity 0.85."""
    return jaccard_components(docs).select(F.col("id").alias("doc_id"), "n_shingles", "component_id")


def distinct_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents without near copies: of each component the row with the smallest id stays.

    Documents with an empty set all stay; of rows that repeat id and text one stays. Columns
    may have any names.
    """
    found = materialize(jaccard_components(docs, id_col, text_col, k, num, den), "components")
    keep = found.where("n_shingles > 0").groupBy("component_id").agg(F.min(F.struct("id", "th")).alias("f")).select("f.id", "f.th", F.lit(False).alias("empty"))
    empty = found.where("n_shingles = 0").select("id", "th", F.lit(True).alias("empty")).distinct()
    keep = materialize(keep.union(empty).select(F.col("id").alias("kept_id"), F.col("th").alias("kept_th"), "empty"), "kept")
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"), docs[f"`{id_col}`"].cast("long").alias("id"), F.xxhash64(docs[f"`{text_col}`"]).alias("th"))
    joined = rows.join(keep.hint("shuffle_hash"), F.col("id").eqNullSafe(F.col("kept_id")) & (F.col("th") == F.col("kept_th")))
    one = F.row_number().over(Window.partitionBy("id", "th").orderBy(F.lit(1)))
    return joined.withColumn("one", one).where("one = 1 or empty").select("row.*")
