"""Prefix trie of conversations, merged family by family.

Conversations of one family (equal ``conv_id - conv_id % FAMILY``) may share their first
turns: conversation c takes the first h turns of its family's base, h = crc32(c) % SHARED, and
then its own turns after its first h. A node of the trie is a sequence of turns, known by
its depth and 128 bits: the exclusive or of the hashes of its turns with their places. Any
part of a conversation can be summed up alone, so no conversation has to lie in one task.

* Texts are read once; what is dealt out are two hashes and a word count of each turn.
* The bases' first turns are cogrouped with their families. Turns are dealt out in ranges of
  (family, conversation, turn); what one range holds of a family is a piece, of bounded size.
* Inside a piece running windows give each turn its place and its node, and the family's
  nodes are combined; only these combined nodes are shuffled and merged over all families.
* Of the conversations that share a node, that with the smallest id owns it. A conversation
  saves the words of those nodes on its path that it does not own, and a childless node counts
  for its owner's path, so sums over subtrees are sums over paths: no walk over the trie.

Lists of members are made in blocks; the blocks of a node, in order, go through
SHA-256 as a stream.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.scratch import discard, materialize

#: Conversations of a family, and the number that the shared turns stay below.
FAMILY, SHARED = 20, 4
#: A block of a list of members has the ids that agree in all but so many low bits.
BLOCK_BITS = 9
WORD = r"[^\x20\x09-\x0D]+"
NODE = ["depth", "a", "b"]


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from its family's base."""
    return (F.crc32(conv_id.cast("string").cast("binary")) % SHARED).cast("int")


def turn_digests(conversations: DataFrame) -> DataFrame:
    """(conv_id, family, turn, role, text_key, x, y, words) of each turn; the text itself stays behind.

    Null roles and texts are empty; ``text_key`` orders turns of one number and role.
    """
    c = lambda name, kind: conversations[f"`{name}`"].cast(kind)
    rows = conversations.select(c("conv_id", "bigint").alias("conv_id"), c("turn", "bigint").alias("turn"), F.coalesce(c("role", "string"), F.lit("")).alias("role"), F.coalesce(c("text", "string"), F.lit("")).alias("text"))
    return rows.where("conv_id is not null").select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % FAMILY).alias("family"), "turn", "role", F.unhex(F.md5(F.col("text").cast("binary"))).alias("text_key"),
        F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(FAMILY), "text", "role").alias("y"), F.regexp_count("text", F.lit(WORD)).cast("bigint").alias("words"),
    )


def _placed(x: Column, place: Column) -> Column:
    """The hash of a turn at a place."""
    return F.xxhash64(place.cast("bigint"), x)


def _xor(*columns: Column) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), columns)


def _over(turns: Column, f) -> Column:
    """The exclusive or of f over an array of turns."""
    return F.aggregate(turns, F.lit(0).cast("bigint"), lambda s, t: s.bitwiseXOR(f(t)))


def _families(digests: DataFrame) -> DataFrame:
    """(conv_id, family, h, head, taken, hx, hy, hw) of each conversation: the families' first turns cogrouped with their members."""
    order = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text_key")
    first = digests.where("conv_id = family").withColumn("p", F.row_number().over(order).cast("bigint")).where(F.col("p") < SHARED)  # the limit is taken before the shuffle, too
    bases = first.groupBy("family").agg(F.array_sort(F.collect_list(F.struct("p", "x", "y", "words"))).alias("base"))
    convs = digests.groupBy("family", "conv_id").agg(shared_turns(F.first("conv_id")).alias("h")).join(bases, "family", "left")
    none = F.lit([]).cast("array<struct<p:bigint,x:bigint,y:bigint,words:bigint>>")
    convs = convs.withColumn("head", F.slice(F.coalesce("base", none), F.lit(1), F.col("h"))).drop("base")
    return convs.withColumns({
        "taken": F.size("head").cast("bigint"), "hx": _over(F.col("head"), lambda t: _placed(t.x, t.p)), "hy": _over(F.col("head"), lambda t: _placed(t.y, t.p)),
        "hw": F.aggregate("head", F.lit(0).cast("bigint"), lambda s, t: s + t.words),
    })


def rebuilt_paths(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(paths, ends), both materialized.

    paths: a row for each turn of each rebuilt conversation: conv_id, depth, the node (a, b), the
    turn's hashes (x, y), its words, and ``before``, the words of the turns before it.
    ends: a row for each conversation: conv_id and the node (depth, a, b) where it ends.
    """
    digests = materialize(turn_digests(conversations), "turns")
    order = [F.asc_nulls_first("turn"), "role", "text_key"]
    rows = digests.withColumn("uid", F.monotonically_increasing_id())
    ranged = materialize(rows.repartitionByRange("family", "conv_id", *order, "uid").drop("uid").withColumn("piece", F.spark_partition_id()), "ranges")
    convs = materialize(_families(digests), "families")

    # what a conversation has in its earlier pieces; only conversations across a border have any
    mine = ["conv_id", "piece"]
    earlier = Window.partitionBy("conv_id").orderBy("piece").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy(*mine).agg(F.count(F.lit(1)).alias("n"))
    skipped = counts.withColumn("skipped", F.sum("n").over(earlier)).where("skipped is not null").select(*mine, "skipped")

    piece = Window.partitionBy("family", "piece", "conv_id")
    turns = ranged.join(convs.drop("family", "head"), "conv_id").join(skipped, mine, "left").repartition("family", "piece")
    turns = turns.withColumn("p", F.row_number().over(piece.orderBy(*order)) + F.coalesce("skipped", F.lit(0))).where("p > h")
    turns = turns.withColumn("depth", F.col("p") - F.col("h") + F.col("taken"))
    upto = piece.orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    own = turns.select(
        *mine, "family", "depth", "x", "y", "words", _xor(F.bit_xor(_placed(F.col("x"), F.col("depth"))).over(upto), F.col("hx")).alias("a"),
        _xor(F.bit_xor(_placed(F.col("y"), F.col("depth"))).over(upto), F.col("hy")).alias("b"), (F.sum("words").over(upto) - F.col("words") + F.col("hw")).alias("before"),
    )
    own = materialize(own, "own")
    discard(digests, ranged)

    totals = own.groupBy(*mine).agg(F.bit_xor(_placed(F.col("x"), F.col("depth"))).alias("tx"), F.bit_xor(_placed(F.col("y"), F.col("depth"))).alias("ty"), F.sum("words").alias("tw"), F.count(F.lit(1)).alias("n"))
    totals = materialize(totals, "totals")
    carried = totals.select(*mine, F.bit_xor("tx").over(earlier).alias("cx"), F.bit_xor("ty").over(earlier).alias("cy"), F.sum("tw").over(earlier).alias("cw")).where("cw is not null")
    own = own.join(carried, mine, "left").select(
        "conv_id", "depth", _xor(F.col("a"), F.coalesce("cx", F.lit(0))).alias("a"), _xor(F.col("b"), F.coalesce("cy", F.lit(0))).alias("b"), "x", "y", "words",
        (F.col("before") + F.coalesce("cw", F.lit(0))).alias("before"),
    )
    upto = F.slice("head", F.lit(1), F.col("t.p").cast("int"))
    heads = convs.select("conv_id", "head", F.explode("head").alias("t")).select(
        "conv_id", F.col("t.p").alias("depth"), _over(upto, lambda t: _placed(t.x, t.p)).alias("a"), _over(upto, lambda t: _placed(t.y, t.p)).alias("b"), "t.x", "t.y", "t.words",
        (F.aggregate(upto, F.lit(0).cast("bigint"), lambda s, t: s + t.words) - F.col("t.words")).alias("before"),
    )
    whole = totals.groupBy("conv_id").agg(F.bit_xor("tx").alias("tx"), F.bit_xor("ty").alias("ty"), F.sum("n").alias("n"))
    none = F.lit(0).cast("bigint")
    ends = convs.join(whole, "conv_id", "left").select(
        "conv_id", (F.col("taken") + F.coalesce("n", none)).alias("depth"), _xor(F.col("hx"), F.coalesce("tx", none)).alias("a"), _xor(F.col("hy"), F.coalesce("ty", none)).alias("b")
    )
    return materialize(own.unionByName(heads), "paths"), materialize(ends, "ends")


def _member_hashes(ends: DataFrame) -> DataFrame:
    """(depth, a, b, ends_sha256) of the nodes where conversations end.

    A hash over a list is one stream by its nature; it gets the list in blocks, in order, and holds one of them.
    """
    blocks = ends.groupBy(*NODE, F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"))

    def run(batches):
        node, state = None, None
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in [*NODE, "ids"]), strict=True):
                if key != node:
                    if node:
                        out.append((*node, state.hexdigest()))
                    node, state = key, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], [*NODE, "ends_sha256"])
        if node:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*node, state.hexdigest())], [*NODE, "ends_sha256"])

    ordered = blocks.repartition(*NODE).sortWithinPartitions(*NODE, "block").select(*NODE, "ids")
    return ordered.mapInArrow(run, "depth bigint, a bigint, b bigint, ends_sha256 string")


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of all rebuilt conversations.

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256, and the hashes (x, y) of the node's last turn, which ``with_turns`` turns into
    its role and text. The root has no parent and no last turn.

    Turns are ordered by turn (null first), then by role, then by the MD5 of the text; rows that
    repeat are turns like any other. Null roles and texts are empty. Rows without a conv_id belong
    to no conversation. A conversation that keeps no turn is a member of the root. An empty
    table has no nodes. Other columns are not looked at, whatever their names.
    """
    paths, ends = rebuilt_paths(conversations)
    up = F.col("depth") - 1
    merged = paths.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in ("x", "y", "words", "before")])
    merged = merged.withColumns({"pa": _xor(F.col("a"), _placed(F.col("x"), F.col("depth"))), "pb": _xor(F.col("b"), _placed(F.col("y"), F.col("depth")))})
    nodes = materialize(merged, "nodes")
    parents = nodes.select(up.alias("depth"), F.col("pa").alias("a"), F.col("pb").alias("b"))
    kids = materialize(parents.groupBy(*NODE).agg(F.count(F.lit(1)).alias("n_children")), "kids")

    shared = nodes.where("n_convs > 1").select(*NODE, F.col("conv_id").alias("owner"))
    spared = paths.select("conv_id", *NODE, "words").join(shared, NODE).where("owner <> conv_id").groupBy("conv_id").agg(F.sum("words").alias("spared"))
    leaves = nodes.join(kids, NODE, "left_anti").select("conv_id", F.lit(1).cast("bigint").alias("leaf"))
    zero = F.lit(0).cast("bigint")
    gains = materialize(spared.join(leaves, "conv_id", "full").select("conv_id", F.coalesce("spared", zero).alias("spared"), F.coalesce("leaf", zero).alias("leaf")), "gains")
    sums = paths.select("conv_id", *NODE, "before").join(gains, "conv_id").groupBy(*NODE).agg(F.sum("leaf").alias("n_leaves"), F.sum(F.greatest(F.col("spared") - F.col("before"), zero)).alias("saved_tokens"))

    top = ends.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"))
    below = gains.agg(F.coalesce(F.sum("leaf"), F.lit(1).cast("bigint")).alias("n_leaves"), F.coalesce(F.sum("spared"), zero).alias("saved_tokens"))
    root = top.join(below).where("n_convs > 0").select(  # one row each
        zero.alias("depth"), zero.alias("a"), zero.alias("b"), "conv_id", F.lit(None).cast("bigint").alias("parent_conv_id"), "n_convs", *[F.lit(None).cast("bigint").alias(c) for c in "xy"], "n_leaves", "saved_tokens"
    )
    named = nodes.select(F.col("depth").alias("_depth"), F.col("a").alias("pa"), F.col("b").alias("pb"), F.col("conv_id").alias("parent_conv_id")).union(root.select("depth", "a", "b", "conv_id"))
    kin = nodes.withColumn("_depth", up).join(named, ["_depth", "pa", "pb"]).join(sums, NODE).select(*root.columns)
    out = kin.union(root).join(kids, NODE, "left").join(_member_hashes(ends), NODE, "left")
    nobody = hashlib.sha256(b"").hexdigest()
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", zero).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(nobody)).alias("ends_sha256"), "x", "y")


def with_turns(nodes: DataFrame, conversations: DataFrame) -> DataFrame:
    """The nodes with ``role`` and ``text`` of their last turns (null at the root)."""
    c = lambda name: F.coalesce(conversations[f"`{name}`"].cast("string"), F.lit(""))
    turns = conversations.where(conversations["`conv_id`"].isNotNull()).select(c("role").alias("role"), c("text").alias("text"))
    turns = turns.groupBy(F.xxhash64("role", "text").alias("x"), F.xxhash64(F.lit(FAMILY), "text", "role").alias("y")).agg(F.first("role").alias("role"), F.first("text").alias("text"))
    return nodes.join(turns, ["x", "y"], "left")


def trie_report(conversations: DataFrame) -> DataFrame:
    return prefix_trie(conversations).drop("x", "y")


#: DuckDB SQL of ``trie_report`` (CRC-32 is spelt out bit by bit).
REPORT_SQL = rf"""
with turns as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), md5(coalesce(text, ''))) as p, {{'r': coalesce(role, ''), 't': coalesce(text, '')}} as item
  from conversations where conv_id is not null
), convs as (select conv_id, list(item order by p) as items from turns group by conv_id),
crc as (
  select conv_id, items, list_reduce(list_prepend(4294967295::bigint, flatten(list_transform(string_split(conv_id::varchar, ''), lambda c: list_prepend(ascii(c)::bigint, list_transform(range(8), lambda i: -1::bigint))))),
    lambda s, x: case when x >= 0 then xor(s, x) else xor(s >> 1, 3988292384 * (s & 1)) end) as s
  from convs
), cut as (select conv_id, conv_id - conv_id % {FAMILY} as family, items, (xor(s, 4294967295) % {SHARED})::int as h from crc),
rebuilt as (select c.conv_id, list_concat(coalesce(b.items[1 : h], []), c.items[h + 1 :]) as items from cut c left join convs b on b.conv_id = c.family),
paths as (select conv_id, d, items[1 : d] as path, len(items) = d as ends from (select conv_id, items, unnest(range(0, len(items) + 1)) as d from rebuilt)),
nodes as (
  select path, d, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(conv_id::varchar, ',' order by conv_id) filter (where ends), '')) as ends_sha256,
    case when d > 0 then (count(*) - 1) * len(regexp_extract_all(path[d]['t'], '[^\x20\x09-\x0D]+')) else 0 end as saved
  from paths group by path, d
), kids as (select path[1 : d - 1] as path, d - 1 as d, count(*) as n_children from nodes where d > 0 group by 1, 2),
full_ as (select nodes.*, coalesce(n_children, 0) as n_children from nodes left join kids using (path, d)),
above as (select path[1 : i] as path, i as d, saved, n_children = 0 as leaf from (select *, unnest(range(0, d + 1)) as i from full_)),
sums as (select path, d, sum(saved)::bigint as saved_tokens, count(*) filter (where leaf) as n_leaves from above group by path, d)
select f.conv_id, f.d::bigint as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, n_leaves, saved_tokens, f.ends_sha256
from full_ f join sums using (path, d) left join nodes p on f.d > 0 and p.d = f.d - 1 and p.path = f.path[1 : f.d - 1]
"""
