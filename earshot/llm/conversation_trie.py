"""Prefix trie of conversations, by smallest-member ownership.

A node is a sequence of first turns; its members are the conversations that start with it, and its smallest member owns
it. What a conversation owns is a suffix of its path, so a node is named by (owner, depth) and sums over subtrees need no
walk:

1. Turns are hashed (SHA-256 of role and text, with lengths) in the map stage; texts are never shuffled. Turns are counted
   by ranges of (conversation, turn), not in a window per conversation.
2. Conversations are rebuilt by joins of turn hashes: the beginning of another conversation, then their own turns.
3. A prefix is named by its depth and two 64-bit sums modulo 2 (exclusive or) of hashes of (depth, turn), so that prefixes
   are running aggregates over buckets of ``BUCKET`` depths, with the buckets before carried over.
4. A window marks the owner of each prefix: the first row by conversation. Spark limits groups to that row before the
   shuffle, so a prefix that a third of all conversations share is one row a task.
5. Of each conversation: the bytes that stand before what it owns, and whether its last node is a leaf (it owns it and no
   prefix goes on from it).
6. One group-by on prefixes: members, the bytes of all occurrences less those of owned nodes (what an occurrence at or
   below the node repeats), leaves. With partial sums, as children are counted.
7. Ids of the conversations that end at a node are put into pieces of a ``PIECE`` of numbers; a node of several pieces is hashed
   as a stream, piece by piece in order, with one piece in memory.

Edge cases: a null role or text is empty; a null turn is before all others; turns of equal number are ordered by their
hash, equal turns each count; rows without conv_id belong to no conversation; a conversation without turns ends at the
root; a conversation of any length is cut into ranges and buckets; an empty table has no node, not even a root; other
columns are not read.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import give_back, stage, table
from .quotes import numbered

SPAN, MOST_SHARED = 5, 9
BUCKET, PIECE = 1024, 512
NODE = ["depth", "p1", "p2"]


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, hash, n_bytes) of each turn."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = F.concat_ws(" ", F.octet_length(role).cast("string"), role, text)
    rows = conversations.where("conv_id is not null")
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.unhex(F.sha2(named, 256)).alias("hash"), F.octet_length(text).cast("long").alias("n_bytes"))


def shared_turns(conv_id) -> F.Column:
    """How many first turns a rebuilt conversation takes from the first of its five."""
    return F.pmod(F.crc32(conv_id.cast("string").cast("binary")), F.lit(MOST_SHARED)).cast("long")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, hash, n_bytes) of the rebuilt conversations, and all conversations (conv_id, n_turns)."""
    turns = stage(numbered(stage(turns_of(conversations), "turns"), ["conv_id", "turn", "hash"]), "numbered")
    own = turns.groupBy("conv_id").agg(F.count("*").alias("n_own"), F.min("number").alias("first"))
    own = stage(own.withColumn("from", F.expr(f"conv_id - conv_id % {SPAN}")).withColumn("h", shared_turns(F.col("conv_id"))), "own")
    base = own.where("conv_id = from").select(F.col("conv_id").alias("from"), F.col("n_own").alias("n_base"))
    all_ = own.join(base, "from", "left").withColumn("taken", F.least("h", F.coalesce("n_base", F.lit(0).cast("long"))))
    all_ = stage(all_.withColumn("n_turns", F.col("taken") + F.greatest(F.col("n_own") - F.col("h"), F.lit(0))).select("conv_id", "first", "from", "h", "taken", "n_turns"), "all")
    at = turns.join(all_.select("conv_id", "first", "h", "taken"), "conv_id").withColumn("at", F.col("number") - F.col("first"))
    kept = at.where("at >= h").select("conv_id", (F.col("at") - F.col("h") + F.col("taken") + 1).alias("depth"), "hash", "n_bytes")
    begins = at.where(f"at < {MOST_SHARED - 1} and conv_id % {SPAN} = 0").select(F.col("conv_id").alias("from"), "at", "hash", "n_bytes")
    lent = begins.join(all_.select("conv_id", "from", "h"), "from").where("at < h").select("conv_id", (F.col("at") + 1).alias("depth"), "hash", "n_bytes")
    return kept.unionByName(lent), all_.select("conv_id", "n_turns")


def prefixes(turns: DataFrame, all_: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, upto, n_bytes) of every conversation and depth, the root's depth 0 included.

    p names the prefix, q the one before; ``upto`` is the bytes of its turns.
    """
    rows = turns.withColumn("x1", F.xxhash64(F.lit(1), "depth", "hash")).withColumn("x2", F.xxhash64(F.lit(2), "hash", "depth")).withColumn("b", F.expr(f"depth div {BUCKET}")).drop("hash")
    rows = stage(rows, "rebuilt")
    ends = rows.groupBy("conv_id", "b").agg(F.bit_xor("x1").alias("c1"), F.bit_xor("x2").alias("c2"), F.sum("n_bytes").alias("c"))
    before = Window.partitionBy("conv_id").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("conv_id", "b", F.bit_xor("c1").over(before).alias("c1"), F.bit_xor("c2").over(before).alias("c2"), F.sum("c").over(before).alias("c")).where("c is not null")
    inside = Window.partitionBy("conv_id", "b").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.select("conv_id", "b", "depth", "x1", "x2", "n_bytes", F.bit_xor("x1").over(inside).alias("p1"), F.bit_xor("x2").over(inside).alias("p2"), F.sum("n_bytes").over(inside).alias("upto"))
    run = run.join(carried, ["conv_id", "b"], "left")
    zero = F.lit(0).cast("long")
    p1, p2 = (F.col(p).bitwiseXOR(F.coalesce(c, zero)) for p, c in (("p1", "c1"), ("p2", "c2")))
    run = run.select("conv_id", "depth", p1.alias("p1"), p2.alias("p2"), p1.bitwiseXOR(F.col("x1")).alias("q1"), p2.bitwiseXOR(F.col("x2")).alias("q2"), (F.col("upto") + F.coalesce("c", zero)).alias("upto"), "n_bytes")
    root = all_.select("conv_id", *(zero.alias(c) for c in ("depth", "p1", "p2", "q1", "q2", "upto", "n_bytes")))
    return stage(run.unionByName(root), "prefixes")


def _ends(rows: DataFrame, all_: DataFrame) -> DataFrame:
    """(depth, p1, p2, ends_sha256) of nodes at which conversations end."""
    last = rows.join(all_.select("conv_id", F.col("n_turns").alias("depth")), ["conv_id", "depth"]).select(*NODE, "conv_id", F.expr(f"conv_id div {PIECE}").alias("piece"))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda x: x.cast("string")), ",")
    pieces = stage(last.groupBy(*NODE, "piece").agg(ids.alias("ids")), "pieces")
    few = pieces.groupBy(*NODE).agg(F.count("*").alias("n"), F.min("piece").alias("piece"))
    one = pieces.join(few.where("n = 1").drop("n"), [*NODE, "piece"]).select(*NODE, F.sha2("ids", 256).alias("ends_sha256"))
    many = pieces.join(few.where("n > 1").select(*NODE), NODE)
    streamed = many.repartition(*NODE).sortWithinPartitions(*NODE, "piece").select(*NODE, "ids").mapInArrow(_hashed, "depth long, p1 long, p2 long, ends_sha256 string")
    return one.unionByName(streamed)


def _hashed(batches):
    """Rows in order of node and piece: one digest per node, piece by piece."""
    names = [*NODE, "ends_sha256"]

    def row(key, h):
        return pa.RecordBatch.from_arrays([*(pa.array([k], pa.int64()) for k in key), pa.array([h.hexdigest()])], names=names)

    key = h = None
    for b in batches:
        for i in range(b.num_rows):
            now = tuple(b.column(c)[i].as_py() for c in range(3))
            if now != key:
                if h:
                    yield row(key, h)
                key, h = now, hashlib.sha256()
            else:
                h.update(b",")
            h.update(b.column(3)[i].as_py().encode())
    if h:
        yield row(key, h)
    give_back()


def trie(conversations: DataFrame) -> DataFrame:
    """One row per node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)."""
    turns, all_ = rebuilt(conversations)
    rows = prefixes(turns, all_)
    # the first conversation of each prefix owns its node; Spark limits the groups to it before the shuffle
    first = Window.partitionBy(*NODE).orderBy("conv_id")
    nodes = rows.withColumn("place", F.row_number().over(first)).where("place = 1").drop("place")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("p1"), F.col("q2").alias("p2")).agg(F.count("*").alias("n_children"))
    nodes = stage(nodes, "owners")
    nodes = stage(nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))), "nodes")
    # per conversation: the bytes before what it owns, and whether it owns a leaf
    owned = nodes.groupBy("conv_id").agg(F.min(F.col("upto") - F.col("n_bytes")).alias("free"), F.max((F.col("n_children") == 0).cast("int")).alias("leaf"))
    repeated = F.greatest(F.coalesce("free", F.lit((1 << 63) - 1)), F.lit(0).cast("long"))
    total = rows.groupBy("conv_id").agg(F.max("upto").alias("total"))
    known = stage(total.join(owned, "conv_id", "left").select("conv_id", F.least(repeated, "total").alias("free"), F.coalesce("leaf", F.lit(0)).alias("leaf")), "known")
    each = rows.join(known, "conv_id").select(*NODE, F.greatest(F.col("free") - (F.col("upto") - F.col("n_bytes")), F.lit(0).cast("long")).alias("saved"), "leaf")
    sums = each.groupBy(*NODE).agg(F.count("*").alias("n_convs"), F.sum("saved").alias("saved_tokens"), F.sum("leaf").cast("long").alias("n_leaves"))
    # a node's parent has the same owner but for the first node that a conversation owns
    top = nodes.groupBy("conv_id").agg(F.min("depth").alias("depth")).where("depth > 0")
    tops = nodes.join(top, ["conv_id", "depth"]).select("conv_id", "depth", (F.col("depth") - 1).alias("d"), "q1", "q2")
    above = nodes.select(F.col("depth").alias("d"), F.col("p1").alias("q1"), F.col("p2").alias("q2"), F.col("conv_id").alias("parent"))
    tops = stage(tops.join(above, ["d", "q1", "q2"]).select("conv_id", "depth", "parent"), "tops")
    out = nodes.join(sums, NODE).join(_ends(rows, all_), NODE, "left").join(tops, ["conv_id", "depth"], "left")
    parent = F.when(F.col("depth") > 0, F.coalesce("parent", "conv_id"))
    return out.select("conv_id", "depth", parent.alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(table(spark, sf_dir, "conversations"))


_CRC = "xor(list_reduce(flatten(list_transform(string_split(c::VARCHAR, ''), lambda s: [ascii(s)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])), lambda a, o: CASE WHEN o >= 0 THEN xor(a, o) WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END, 4294967295::BIGINT), 4294967295::BIGINT)"

#: By lists of turns and sums over every node's ancestors.
ORACLE = f"""
WITH plain AS (
  SELECT conv_id AS c, coalesce(turn, -9223372036854775808) AS turn, turn IS NOT NULL AS has, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
), lists AS (
  SELECT c, list(struct_pack(r := role, t := text) ORDER BY has, turn, role, text) AS own FROM plain GROUP BY c
), h AS (SELECT c, own, {_CRC} % {MOST_SHARED} AS h FROM lists
), built AS (
  SELECT a.c, list_concat(list_slice(coalesce(b.own, []), 1, a.h), list_slice(a.own, a.h + 1, len(a.own))) AS turns
  FROM h a LEFT JOIN lists b ON b.c = a.c - a.c % {SPAN}
), rows AS MATERIALIZED (
  SELECT c, d, sha256(to_json(list_slice(turns, 1, d))::VARCHAR) AS p, CASE WHEN d > 0 THEN sha256(to_json(list_slice(turns, 1, d - 1))::VARCHAR) END AS q,
    CASE WHEN d > 0 THEN strlen(turns[d].t) ELSE 0 END AS n_bytes, d = len(turns) AS ends FROM (SELECT *, unnest(range(len(turns) + 1)) AS d FROM built)
), nodes AS MATERIALIZED (
  SELECT p, d, min(c) AS owner, any_value(q) AS q, count(*) AS n, any_value(n_bytes) AS n_bytes,
    coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '') AS ids FROM rows GROUP BY p, d
), children AS (SELECT q AS p, d - 1 AS d, count(*) AS k FROM nodes WHERE d > 0 GROUP BY ALL
), below AS (
  SELECT r.p, r.d, sum((x.n - 1) * x.n_bytes) AS saved, count(*) FILTER (WHERE k IS NULL) AS leaves
  FROM nodes x LEFT JOIN children k ON k.p = x.p AND k.d = x.d JOIN rows r ON r.c = x.owner AND r.d <= x.d GROUP BY ALL
)
SELECT n.owner AS conv_id, n.d AS depth, u.owner AS parent_conv_id, n.n AS n_convs, coalesce(k, 0) AS n_children, leaves AS n_leaves,
  saved::BIGINT AS saved_tokens, sha256(n.ids) AS ends_sha256
FROM nodes n JOIN below b ON b.p = n.p AND b.d = n.d LEFT JOIN children k ON k.p = n.p AND k.d = n.d LEFT JOIN nodes u ON u.p = n.q AND u.d = n.d - 1
"""
