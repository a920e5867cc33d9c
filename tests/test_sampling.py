"""Samples per key against brute force, over partitions, merged, and over many seeds."""

import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from earshot.operators import sampling


def test_equal_however_rows_lie_and_merge(spark):
    df = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise((F.col("id") % 7).cast("string")).alias("key"), F.lit("r").alias("row"), F.lit(1).alias("draw"))
    want = defaultdict(list)
    for r in df.collect():
        want[r.key].append((hashlib.md5(f"s:{r.id}".encode()).hexdigest(), r.id))
    want = {(k, i, n) for k, x in want.items() for n, (_, i) in enumerate(sorted(x)[:20], 1)}

    def rows(sample):
        return {(r.key, r.id, r.place) for r in sample.collect()}

    whole = sampling.reservoirs(df, ["key"], 20, "s")
    assert rows(whole) == want and whole.first().row.row == "r"
    assert rows(sampling.reservoirs(df.repartition(13), ["key"], 20, "s", parts=3)) == want
    one, other = (sampling.reservoirs(df.where(F.col("id") % 4 == 0 if x else F.col("id") % 4 != 0), ["key"], 20 + 5 * x, "s") for x in (0, 1))
    assert rows(sampling.merged(one, other, ["key"], 20)) == want


def test_repeated_ids_nulls_and_none(spark):
    df = spark.createDataFrame([(1, "a", "x"), (1, "a", "x"), (1, "a", "y"), (None, "a", "z"), (2, None, None)], "id long, key string, v string")
    got = sampling.reservoirs(df, ["key"], 3).collect()
    assert Counter((r.key, r.id, r.row.v) for r in got) == Counter({("a", 1, "x"): 2, ("a", 1, "y"): 1, (None, 2, None): 1})
    assert sorted(r.place for r in got) == [1, 1, 2, 3]
    assert sampling.reservoirs(df.where("id < 0"), ["key"], 3).count() == 0


def test_all_rows_are_equally_likely(spark):
    seeds = spark.range(400).withColumnRenamed("id", "key")
    rows = seeds.crossJoin(spark.range(10)).select("key", "id", F.concat_ws("/", "key", "id").alias("name"))
    drawn = Counter(r.i for r in sampling.reservoirs(rows, ["key"], 3, id_column="name").select(F.col("row.id").alias("i")).collect())
    assert sum(drawn.values()) == 1200 and all(80 <= drawn[i] <= 160 for i in range(10))  # 120 each, within four deviations
