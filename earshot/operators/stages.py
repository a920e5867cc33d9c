"""Intermediate tables in the folder that driver and executors share, and connected components over them.

The folder is that of ``spark.checkpoint.dir``. Where the setting is absent, a temporary folder is taken on a local master;
on a cluster it would be another folder on each machine, so there it is an error.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    conf = spark.sparkContext.getConf()
    named = spark.conf.get("spark.checkpoint.dir", None) or conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not conf.get("spark.master", "local").startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="spark-")
    return _OWN[app]


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(links: DataFrame, a: str = "a", b: str = "b", limit: int = 60) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` reaches.

    Alternating large-star and small-star rounds: each round joins every link with the least neighbour of its end, as
    two aggregations and two joins without a window, so that a node with a third of all links is no single task. A
    round's links are written to the shared folder; the rounds grow with the logarithm of the longest path.
    """
    ends = links.where((F.col(a) != F.col(b)) & F.col(a).isNotNull() & F.col(b).isNotNull())
    e = stage(ends.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(), "links")
    seen = None
    for _ in range(limit):
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        moved = small.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        e = stage(moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = e.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if seen == tuple(now):
            break
        seen = tuple(now)
    else:
        raise RuntimeError("links didn't settle")
    roots = e.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
