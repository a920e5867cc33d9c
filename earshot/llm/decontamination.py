"""Benchmark decontamination, in DataFrame and SQL functions alone.

1. Windows have the number of words of an item. Of each item's word shingles the rarest are taken until what is left
   weighs less than the threshold: a window that reaches the threshold holds one of them, wherever words were put in, left
   out, changed or moved. So where a document holds such a shingle, windows are laid at every start that has the shingle
   inside, each start once. The rarest pair of adjacent words of a shingle is its key for the look-up; the whole shingle is
   compared (by a 64-bit hash) before a window is laid. Equal windows, of whatever documents, are looked at once.
2. Fingerprints. Each window and each item gets a 64-bit SimHash of its words. Fingerprints are cut into blocks
   (``_blocks``), so that any two within the radius differ by ``FLIPS`` bits at most in one of them; an item stands under all
   such values of each block, a window under its own, and they meet in an equi-join on (words, block, value). All pairs
   within the radius are found. The radius follows from the threshold (``radius_for``) by an estimate; the tests measure
   what it loses on edited copies, short items, repeated words and shingles of unequal weight (see README).
3. Verification. The weighted Jaccard similarity of the two sets of word shingles, rare shingles of the benchmark
   weighing more, has to reach the threshold.

The documents are read word by word in generated code, without a shuffle of texts, once for each ``BROADCAST_KEYS`` keys
(about 60 bytes each) of the benchmark; only the words around hits are shuffled.

Edge cases: null or empty texts and items without words match nothing; items shorter than a shingle are one shingle of
all their words, an item of one word is found wherever the word stands; equal items each give their hits; a document
shorter than an item is one window; rows that repeat a doc_id, with equal or different texts, give the best hit of any of
them; rows without doc_id give hits without doc_id, the best of all such rows; of equally similar windows the nearest
fingerprint, then the first place counts; a very long text is read like any other (a row holds its words once); an empty
documents or benchmark table gives no hit; other columns are not read.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stage, table

#: Most keys that are sent to every executor at a time.
BROADCAST_KEYS = 200_000
#: Most rows of flipped block values (some thousand per item) that are sent to every executor; more are shuffled.
BROADCAST_FLIPPED = 2_000_000
#: Bits that may differ inside the one block that two near fingerprints share.
FLIPS = 3
GAP = r"[^\p{L}\p{N}]+"


def words_of(text) -> F.Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), GAP), lambda w: w != "")


def shingles_of(words, k: int) -> F.Column:
    """All runs of ``k`` words as texts, in order; fewer words are one run."""
    n = F.greatest(F.size(words) - F.lit(k) + 1, F.lit(1))
    runs = bound(words, lambda x: F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(x, i, k), " ")))
    return F.when(F.size(words) > 0, runs).otherwise(F.array().cast("array<string>"))


def bound(value, f) -> F.Column:
    """``f`` of a column expression that is evaluated once per row, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def simhash(words) -> F.Column:
    """64 bits: where most of the words' hashes have a one."""
    one = F.lit(1).cast("long")

    def of(hashes):
        def ones(i):
            return F.aggregate(hashes, F.lit(0).cast("long"), lambda a, h: a + F.call_function("shiftrightunsigned", h, i).bitwiseAND(one))

        def bit(i):
            return F.when(ones(i) * 2 > F.size(hashes), F.call_function("shiftleft", one, i)).otherwise(F.lit(0).cast("long"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda a, i: a.bitwiseOR(bit(i)))

    return bound(F.transform(words, lambda w: F.xxhash64(w)), of)


def radius_for(threshold: float, loss: float = 1e-6) -> int:
    """The least radius beyond which less than ``loss`` of the windows just at the threshold lie.

    A window at the threshold may differ in a share (1 - t) / (1 + t) of its words; a bit, the majority of the words'
    bits, then differs with probability arccos(1 - share) / pi.
    """
    p = math.acos(1 - (1 - threshold) / (1 + threshold)) / math.pi
    beyond = 1.0
    for r in range(64):
        beyond -= math.comb(64, r) * p**r * (1 - p) ** (64 - r)
        if beyond < loss:
            return r
    return 63


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("long").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0).withColumn("n_words", F.size("words"))


def _weights(items: DataFrame, k: int) -> DataFrame:
    """(item_id, shingle, weight) of each item's distinct shingles: ln(1 + items / items that hold it)."""
    rows = items.select("item_id", F.explode(F.array_distinct(shingles_of(F.col("words"), k))).alias("shingle"))
    held = rows.groupBy("shingle").agg(F.count("*").alias("df"))
    total = items.agg(F.count("*").alias("items"))
    return rows.join(held, "shingle").join(F.broadcast(total)).select("item_id", "shingle", F.log1p(F.col("items") / F.col("df")).alias("weight"))


def _rare(items: DataFrame, weights: DataFrame, k: int, threshold: float) -> DataFrame:
    """(item_id, shingle, at, words, n_words): the rarest shingles, one of which a window at the threshold holds."""
    rows = items.select("item_id", "words", "n_words", F.posexplode(shingles_of(F.col("words"), k)).alias("at", "shingle"))
    first = rows.groupBy("item_id", "shingle").agg(F.min("at").alias("at"), F.first("words").alias("words"), F.first("n_words").alias("n_words"))
    rare = Window.partitionBy("item_id").orderBy(F.col("weight").desc(), F.xxhash64("shingle"))
    first = first.join(weights, ["item_id", "shingle"]).withColumn("before", F.coalesce(F.sum("weight").over(rare.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    whole = weights.groupBy("item_id").agg(F.sum("weight").alias("whole"))
    return first.join(whole, "item_id").where(F.col("before") <= (1 - threshold) * F.col("whole") + 1e-9).select("item_id", "shingle", "at", "words", "n_words")


def _keys(items: DataFrame, rare: DataFrame, k: int) -> DataFrame:
    """(word, next, back, size, hash, n_words): adjacent words, how far before them their shingle begins, its words and hash."""
    size = F.least(F.lit(k), F.col("n_words"))
    pairs = rare.where("n_words > 1").select("item_id", "at", "n_words", "words", F.explode(F.sequence(F.lit(0), size - 2)).alias("back"))
    pairs = pairs.select("item_id", "at", "n_words", "back", size.alias("size"), _hash(F.slice("words", F.col("at") + 1, size)).alias("hash"), F.get("words", F.col("at") + F.col("back")).alias("word"), F.get("words", F.col("at") + F.col("back") + 1).alias("next"))
    spread = items.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    pairs = pairs.join(spread, "word").join(spread.toDF("next", "df2"), "next")
    best = pairs.groupBy("item_id", "at").agg(F.min_by(F.struct("word", "next", "back", "size", "hash", "n_words"), F.struct(F.col("df") + F.col("df2"), -F.length(F.concat("word", "next")), F.col("back"))).alias("k"))
    return best.select("k.*").distinct()


def _hash(words) -> F.Column:
    return F.xxhash64(F.array_join(words, " "))


def _hits(docs: DataFrame, keys: DataFrame, singles: DataFrame) -> DataFrame:
    """(doc_id, n_words, low, r, f, h, around): where windows of ``n_words`` words have a rare shingle inside.

    ``around`` are the words from ``low`` on that these windows can have, ``r`` names them; windows begin at ``low`` + f to
    ``low`` + h. The documents are read once for each ``BROADCAST_KEYS`` keys, which are sent to every executor; the hit
    before, in the same text, tells which starts are taken already.
    """
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text"), F.split(F.lower("text"), GAP).alias("words"))
    words = words.withColumn("words", F.filter("words", lambda x: x != ""))
    rows = words.select("doc_id", "text", "words", F.posexplode("words").alias("at", "word")).withColumn("next", F.get("words", F.col("at") + 1))
    met = []
    for keys_, on in ((keys, ["word", "next"]), (singles, ["word"])):
        parts = -(-keys_.count() // BROADCAST_KEYS)
        for i in range(parts):
            some = keys_.where(F.pmod(F.xxhash64(*on), F.lit(parts)) == i) if parts > 1 else keys_
            met.append(rows.join(F.broadcast(some), on).select("doc_id", "text", "words", "at", F.explode("places").alias("p")))
    if not met:
        return words.where("false").select("doc_id", F.lit(0).alias("n_words"), F.lit(0).alias("low"), F.lit("").alias("r"), F.lit(0).alias("f"), F.lit(0).alias("h"), F.col("words").alias("around"))
    n, size, at = F.col("p.n_words"), F.col("p.size"), F.col("at") - F.col("p.back")
    hits = reduce(DataFrame.unionByName, met).where((at >= 0) & (_hash(F.slice("words", F.greatest(at, F.lit(0)) + 1, size)) == F.col("p.hash")))
    low = F.greatest(at - (n - size), F.lit(0))
    high = F.least(at, F.greatest(F.size("words") - n, F.lit(0)))
    hits = hits.select("doc_id", "text", n.alias("n_words"), at.alias("at"), low.alias("low"), high.alias("high"), F.slice("words", low + 1, high - low + n).alias("around"))
    hits = hits.groupBy("doc_id", "text", "n_words", "at").agg(F.first("low").alias("low"), F.first("high").alias("high"), F.first("around").alias("around"))
    before = F.lag("at").over(Window.partitionBy("doc_id", "text", "n_words").orderBy("at"))
    hits = hits.withColumn("first", F.greatest("low", F.coalesce(before + 1, F.lit(0)))).where("first <= high")
    return hits.select("doc_id", "n_words", "low", F.md5(F.array_join("around", " ")).alias("r"), (F.col("first") - F.col("low")).alias("f"), (F.col("high") - F.col("low")).alias("h"), "around")


def _blocks(print_, radius: int) -> tuple[F.Column, F.Column]:
    """Of fingerprints: the values of their blocks, and masks of up to ``FLIPS`` flipped bits in a block.

    Two fingerprints within the radius differ by ``FLIPS`` bits at most in one of radius // (FLIPS + 1) + 1 blocks or more.
    """
    n = max(radius // (FLIPS + 1) + 1, 5)
    width = -(-64 // n)
    values = F.array(*[F.shiftrightunsigned(print_, i * width).bitwiseAND(F.lit((1 << width) - 1)) for i in range(-(-64 // width))])
    return values, F.expr(f"filter(sequence(0L, {(1 << width) - 1}L), x -> bit_count(x) <= {FLIPS})")


def find_leaks(docs: DataFrame, benchmark: DataFrame, k: int = 5, threshold: float = 0.8, radius: int | None = None) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, hamming, similarity): for each document and item, its most similar window.

    Without a ``radius`` that of the threshold is taken.
    """
    radius = radius_for(threshold) if radius is None else radius
    items = stage(_items(benchmark), "items")
    weights = stage(_weights(items, k), "weights")
    rare = stage(_rare(items, weights, k, threshold), "rare")
    keys = _keys(items, rare, k).groupBy("word", "next").agg(F.collect_set(F.struct("back", "size", "hash", "n_words")).alias("places"))
    one = F.array(F.struct(F.lit(0).alias("back"), F.lit(1).alias("size"), _hash(F.array("word")).alias("hash"), F.lit(1).alias("n_words")))
    singles = items.where("n_words = 1").select(F.get("words", F.lit(0)).alias("word")).distinct().withColumn("places", one)
    hits = stage(_hits(docs, stage(keys, "keys"), stage(singles, "singles")), "hits")
    # equal words around hits are looked at once, however many documents hold them
    regions = hits.groupBy("r", "n_words", "f", "h").agg(F.first("around").alias("around"))
    regions = stage(regions, "regions")
    place = ["r", "n_words", "f", "h", "off"]
    own = F.slice("around", F.col("off") + 1, F.col("n_words"))
    windows = regions.withColumn("off", F.explode(F.sequence("f", "h")))
    prints = stage(windows.select(*place, simhash(own).alias("print")), "prints")
    # all fingerprints within the radius share a block up to few flipped bits
    known = items.select("item_id", "n_words", simhash(F.col("words")).alias("print2"))
    values, _ = _blocks(F.col("print"), radius)
    values2, masks = _blocks(F.col("print2"), radius)
    flipped = known.select("item_id", "n_words", "print2", F.posexplode(values2).alias("block", "v")).withColumn("mask", F.explode(masks)).select("item_id", "n_words", "print2", "block", F.col("v").bitwiseXOR(F.col("mask")).alias("value"))
    flipped = stage(flipped, "flipped")
    flipped = F.broadcast(flipped) if flipped.count() <= BROADCAST_FLIPPED else flipped
    left = prints.select(*place, "print", F.posexplode(values).alias("block", "value"))
    hamming = F.bit_count(F.col("print").bitwiseXOR(F.col("print2")))
    near = left.join(flipped, ["n_words", "block", "value"]).where(hamming <= radius).groupBy(*place, "item_id").agg(F.min(hamming).alias("hamming"))
    # what a window shares with the item has to weigh the threshold's part of the item; few pairs are left by that
    of_item = weights.groupBy("item_id").agg(F.collect_list(F.struct("shingle", "weight")).alias("all"), F.sum("weight").alias("whole"))
    add = lambda x, y: x + y
    found = near.join(regions, ["r", "n_words", "f", "h"]).join(of_item, "item_id")
    shared = lambda own_: F.aggregate(F.transform(F.filter("all", lambda x: F.array_contains(own_, x.shingle)), lambda x: x.weight), F.lit(0.0), add)
    of_window = bound(F.array_distinct(shingles_of(own, k)), lambda x: F.struct(x.alias("shingles"), shared(x).alias("both")))
    found = found.select(*place, "item_id", "hamming", "whole", of_window.alias("m")).select(*place, "item_id", "hamming", "whole", "m.*")
    found = stage(found.where(F.col("both") >= threshold * F.col("whole") - 1e-9), "found")
    # exact weighted similarity
    anywhere = weights.select("shingle", "weight").distinct()
    unseen = items.agg(F.log1p(F.count("*").cast("double")).alias("unseen"))
    each = found.select(*place, F.explode("shingles").alias("shingle")).distinct()
    weighed = each.join(anywhere, "shingle", "left").join(F.broadcast(unseen)).groupBy(*place).agg(F.sum(F.coalesce("weight", "unseen")).alias("window"))
    scored = found.drop("shingles").join(weighed, place).withColumn("similarity", F.col("both") / (F.col("window") + F.col("whole") - F.col("both"))).where(F.col("similarity") >= threshold - 1e-9)
    # of a region's windows the best of each item, then of a document's regions
    order = ["similarity", "less", "early"]
    top = scored.groupBy("r", "n_words", "f", "h", "item_id").agg(F.max(F.struct("similarity", (-F.col("hamming")).alias("less"), (-F.col("off")).alias("early"))).alias("m"))
    top = stage(top.select("r", "n_words", "f", "h", "item_id", "m.*"), "scored")
    ends = hits.select("doc_id", "low", "r", "n_words", "f", "h").join(top, ["r", "n_words", "f", "h"]).withColumn("early", F.col("early") - F.col("low"))
    best = ends.groupBy("doc_id", "item_id").agg(F.max(F.struct(*order, "n_words")).alias("m"))
    return best.select("doc_id", "item_id", (-F.col("m.early")).alias("start_word"), F.col("m.n_words").alias("n_words"), (-F.col("m.less")).cast("int").alias("hamming"), F.round("m.similarity", 6).alias("similarity"))


def op10_simhash_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
