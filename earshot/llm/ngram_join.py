"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Two documents link when 100 * |A and B| >= percent * |A or B|, A and B their sets of word shingles.

1. One pass gives each document's set size and the name of its set; documents of equal sets are one class.
2. ``rare_shingles`` counts all shingles exactly and gives each class its shared shingles, rare first. What no other
   document holds stands before them, so a class with too few shared shingles for any link is gone here.
3. Prefixes: in the global order (frequency, hash) any linked pair has a common shingle among the first
   n - ceil(percent * n / 100) + 1 of both sets. Keys of one class alone are dropped.
4. Candidates meet on a key within neighbouring bands of set sizes (length filter). The positional filter bounds the
   overlap by what follows in both sets; the suffix filter bounds it by the counts of both sets in 32 ranges of hashes.
   What is left is verified once per pair on the shared shingles.
5. Links are followed in rounds. In star rounds a class meets one class of another group on one of its keys; what is
   linked then counts as one group. After a star round that finds few new links, or ``STAR_ROUNDS`` of them, the last round
   takes every pair of a key whose members are still apart. A group of n near copies so costs about n verifications a
   round, not n^2, and no link between groups is lost.

Shingles are compared by hashes (see ``rare_shingles``); names of sets have 64 bits and are drawn anew where two
different sets have one name. Memory: a task holds a batch of texts and a block or bucket of some million hashes; no group
is gathered as a whole (lists are cut into 512 members).

Edge cases: without words or text the set is empty and links with nothing; rows of equal doc_id share their links, so
different texts of one doc_id are one component; rows without doc_id link with nothing and get a null component; rows that
repeat are one class; ties of frequency are ordered by hash; a very long text is a set like any other (a block of its own);
an empty table gives no row; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, dropped, small, stage, table, texts_of
from .hashing import mix, shingle_sets
from .rare_shingles import RANGES, set_class, shared_sets

LIST, LARGE = 512, 32
STAR_ROUNDS, LITTLE = 5, 0.05


def _named(k: int, seed: int):
    """(doc_id, n, cls, print): size and name of each text's set, and another 64 bits to tell equal names apart."""
    names = ["doc_id", "n", "cls", "print"]

    def rows(batches):
        for b in small(batches):
            n, cls, prints = [], [], []
            for h in shingle_sets(b.column(1).to_pylist(), k):
                n.append(len(h))
                cls.append(set_class(h, seed) if len(h) else None)
                with np.errstate(over="ignore"):
                    prints.append(int(mix(h ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).view(np.int64)) if len(h) else None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(prints, pa.int64())], names=names)

    return rows


def _least(n, percent: int):
    """Smallest overlap that two sets of n and m >= n elements need, at m = n: ceil(percent * n / 100)."""
    return (percent * n + 99) // 100


def _prefixes(percent: int):
    """(key, doc, n, pos) of the shared shingles in each set's prefix; pos counts what is not shared, too."""

    def rows(batches):
        for b in batches:
            n, cls = b.column(1).to_numpy(), b.column(0).to_numpy()
            ids = [np.frombuffer(x.as_buffer(), "<i8") for x in b.column(2)]
            alone = n - np.array([len(x) for x in ids], np.int64)
            take = np.maximum(n - _least(n.astype(np.int64), percent) + 1 - alone, 0)
            few = [x[:m] for x, m in zip(ids, take, strict=True)]
            size = [len(x) for x in few]
            pos = [np.arange(a, a + s, dtype=np.int32) for a, s in zip(alone, size, strict=True)]
            if sum(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(few)), pa.array(np.repeat(cls, size)), pa.array(np.repeat(n, size), pa.int32()), pa.array(np.concatenate(pos))], names=["key", "doc", "n", "pos"])

    return rows


def _suffix_filter(percent: int):
    def rows(batches):
        for b in batches:
            x = [np.frombuffer(b"".join(b.column(c).to_pylist()), "<u4").reshape(-1, RANGES).astype(np.int64) for c in (2, 3)]
            most = np.minimum(*x).sum(axis=1)
            n, m = (b.column(c).to_numpy().astype(np.int64) for c in (4, 5))
            yield b.select(["a", "b"]).filter(pa.array((most > 0) & (100 * most >= percent * (n + m - most))))

    return rows


def _verify(percent: int):
    def rows(batches):
        for b in batches:
            keep = []
            for x, y, n, m in zip(b.column(2), b.column(3), b.column(4).to_pylist(), b.column(5).to_pylist(), strict=True):
                x, y = (np.frombuffer(z.as_buffer(), "<u8") for z in (x, y))
                same = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(same > 0 and 100 * same >= percent * (n + m - same))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows


def _links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b), those that link."""
    few = sets.select("cls", "ranges", "n")
    near = pairs.join(few.toDF("a", "x", "n"), "a").join(few.toDF("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m").mapInArrow(_suffix_filter(percent), "a long, b long")
    full = sets.select("cls", "ids", "n")
    both = near.join(full.toDF("a", "x", "n"), "a").join(full.toDF("b", "y", "m"), "b").select("a", "b", "x", "y", "n", "m")
    return both.mapInArrow(_verify(percent), "a long, b long")


def _classes(texts: DataFrame, k: int) -> tuple[DataFrame, int]:
    """(doc_id, n, cls) of every row, and the seed of the names."""
    for seed in range(16):
        named = stage(texts.mapInArrow(_named(k, seed), "doc_id long, n long, cls long, print long"), "named")
        same = named.where("cls is not null").groupBy("cls").agg(F.min("print").alias("low"), F.max("print").alias("high"), F.min("n").alias("few"), F.max("n").alias("many"))
        if same.where("low <> high or few <> many").isEmpty():
            return named.select("doc_id", "n", "cls"), seed
    raise RuntimeError("different sets keep getting equal names")


def jaccard_components(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs``."""
    if not 0 < percent <= 100:
        raise ValueError("percent must be above 0 and at most 100")
    texts = texts_of(docs)
    classes, seed = _classes(texts, k)
    some = classes.where("cls is not null and doc_id is not null")
    sets = shared_sets(texts, k, percent, classes.agg(F.sum("n").alias("n")).first().n or 0, seed)
    sets = stage(sets, "shared").dropDuplicates(["cls"])
    sets = stage(sets, "sets")
    # prefix rows on keys of two classes at least; sizes that may link are in the same band or the next
    rows = stage(sets.select("cls", "n", "ids").mapInArrow(_prefixes(percent), "key long, doc long, n int, pos int"), "prefix")
    several = rows.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(100 / percent) * (1 + 1e-9)) + 1e-7) if percent < 100 else F.col("n")
    rows = stage(rows.join(several, "key", "left_semi").withColumn("band", band.cast("int")), "prefix")
    # different texts of one doc_id are linked by it
    more = some.groupBy("doc_id").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a < z").select("doc_id", "a")
    links = stage(some.join(more, "doc_id").where("cls <> a").select("a", F.col("cls").alias("b")).distinct(), "links")
    tried, group = None, None if links.isEmpty() else components(links)
    step = most = 0
    while step <= STAR_ROUNDS:
        now = rows.withColumn("group", F.col("doc")) if group is None else rows.join(group, F.col("doc") == F.col("node"), "left").select("key", "doc", "n", "pos", "band", F.coalesce("component", "doc").alias("group"))
        apart = now.groupBy("key").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low < high").select("key")
        now = stage(now.join(apart, "key", "left_semi"), "apart")
        pairs = _star(now, step, percent) if step < STAR_ROUNDS else _across(now, percent)
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = stage(pairs.distinct(), "pairs")
        found = stage(_links(pairs, sets, percent), "links")
        dropped(now)
        tried = pairs if tried is None else tried.unionByName(pairs)
        n = found.count()
        if n:
            links = links.unionByName(found)
            group = components(links)
        # a star round that finds little is the last of its kind; the round after it takes every pair
        most = max(most, n)
        step = STAR_ROUNDS if step < STAR_ROUNDS and n <= most * LITTLE else step + 1
    labels = classes.withColumn("label", F.col("cls"))
    if group is not None:
        labels = classes.join(group, F.col("cls") == F.col("node"), "left").withColumn("label", F.coalesce("component", "cls"))
    least = labels.where("label is not null").groupBy("label").agg(F.min("doc_id").alias("least"))
    out = labels.join(least, "label", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("least", "doc_id")).alias("component_id"))


def _star(rows: DataFrame, step: int, percent: int) -> DataFrame:
    """Each class picks three of its keys and meets, where it may link, the one class drawn for the key and its band.

    Picked are the class's rarest key and two drawn by a hash of the round; the partner is, of the classes with the key at
    the earliest place (the positional filter passes these most), the smallest, in later rounds one drawn by the hash. So
    what is still apart tries other keys and others on every key that it shares.
    """
    drawn = F.xxhash64("key", "doc", F.lit(step)) if step else F.col("n").cast("long")
    centre = rows.groupBy("key", "band").agg(F.min(F.struct(F.col("pos").alias("first"), drawn.alias("drawn"), "doc", "n", "group")).alias("c"))
    what = F.struct("key", "band", "n", "pos", "group")
    picks = [F.min_by(what, F.struct(F.col("pos").cast("long"), "key")), *(F.min_by(what, F.struct(F.xxhash64("key", F.lit(step), F.lit(i)), "key")) for i in range(2))]
    own = rows.groupBy("doc").agg(F.array_distinct(F.array(*picks)).alias("p")).select("doc", F.explode("p").alias("p")).select("doc", "p.*")
    both = own.join(centre, ["key", "band"]).where((F.col("group") != F.col("c.group")) & _passes(F.col("n"), F.col("pos"), F.col("c.n"), F.col("c.first"), percent))
    return both.select(F.least("doc", "c.doc").alias("a"), F.greatest("doc", "c.doc").alias("b"))


def _met(percent: int):
    """Of two lists, the pairs of different groups that pass the length and positional filters: (a, b)."""

    def rows(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                same = batch.column(0)[i].as_py()
                (d, n, p, g), (e, m, q, h) = ([x.values.field(f).to_numpy(zero_copy_only=False) for f in range(4)] for x in (batch.column(1)[i], batch.column(2)[i]))
                n, p, m, q = (x.astype(np.int64) for x in (n, p, m, q))
                big, small = np.maximum.outer(n, m), np.minimum.outer(n, m)
                needed = -(-(big + small) * percent // (100 + percent))
                fit = (big * percent <= small * 100) & (needed <= np.minimum.outer(n - p, m - q)) & np.not_equal.outer(g, h)
                if same:
                    fit &= np.less.outer(d, e)
                x, y = np.nonzero(fit)
                if len(x):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(d[x], e[y])), pa.array(np.maximum(d[x], e[y]))], names=["a", "b"])

    return rows


def _across(rows: DataFrame, percent: int) -> DataFrame:
    """Every pair of a key whose classes are in different groups and pass the length and positional filters.

    Members of a key and band form lists of about ``LIST``: large groups lists of their own, small groups common ones.
    Lists meet lists, and the filters are applied while two lists are compared, so that only candidates become rows.
    """
    at = ["key", "band"]
    size = rows.groupBy(*at, "group").agg(F.count("*").alias("m")).withColumn("own", F.col("m") >= LARGE)
    small = size.where("not own").groupBy(*at).agg(F.sum("m").alias("all_small"))
    cut = rows.join(size, [*at, "group"]).join(small, at, "left")
    part = F.when(F.col("own"), F.pmod(F.xxhash64("doc"), F.ceil(F.col("m") / LIST))).otherwise(F.pmod(F.xxhash64("group"), F.ceil(F.col("all_small") / LIST)))
    cut = cut.withColumn("name", F.struct(F.when(F.col("own"), F.col("group")).otherwise(F.lit(-1).cast("long")).alias("g"), F.col("own").cast("int").alias("own"), part.alias("part")))
    lists = stage(cut.groupBy(*at, "name").agg(F.collect_list(F.struct("doc", "n", "pos", "group")).alias("of")), "lists")
    left = lists.withColumn("at", F.explode(F.array(F.col("band"), F.col("band") + 1)))
    right = lists.select("key", F.col("band").alias("at"), F.col("name").alias("name2"), F.col("of").alias("of2"))
    same = (F.col("at") == F.col("band")) & (F.col("name") == F.col("name2"))
    met = left.join(right, ["key", "at"]).where((F.col("at") > F.col("band")) | (F.col("name") < F.col("name2")) | (same & (F.col("name.own") == 0)))
    # a list alone in its key and band, of one member, has no pair
    met = met.where(~same | (F.size("of") > 1))
    return met.select(same.alias("same"), "of", "of2").mapInArrow(_met(percent), "a long, b long")


def _passes(n, pos, n2, pos2, percent: int) -> F.Column:
    """Length filter, and positional filter: what both sets hold from the common key on has to suffice."""
    needed = F.ceil((n + n2) * F.lit(percent) / F.lit(100 + percent))
    return (F.greatest(n, n2) * percent <= F.least(n, n2) * 100) & (needed <= F.least(n - pos, n2 - pos2))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"), k=4, percent=85)
