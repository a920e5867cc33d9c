"""A key's rows in order of time, without one task per key.

Each operator cuts the timeline into buckets of time and works inside (key, bucket); what a bucket needs of those before
it is one small row per key and bucket, carried over and joined back. So a key with a third of all rows is as many groups
as it has buckets, and only the table of buckets is ordered by key alone.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000


def _carried(ends: DataFrame, keys: list[str], value) -> DataFrame:
    """(keys, _b, _c): of each bucket, ``value`` over the rows of the key's buckets before it."""
    before = Window.partitionBy(*[F.col(k) for k in keys]).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(*keys, "_b", value.over(before).alias("_c"))


def _joined(rows: DataFrame, carried: DataFrame, keys: list[str]) -> DataFrame:
    right = carried.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_b").alias("_b2"), "_c")
    on = F.col("_b") == F.col("_b2")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    return rows.join(right, on, "left").drop("_b2", *[f"_k{i}" for i in range(len(keys))])


def previous(df: DataFrame, keys: list[str], order: list[str], columns: list[str], out: str = "before", bucket: int = DAY_NS) -> DataFrame:
    """``df`` with ``out``: a struct of ``columns`` of the key's row before, by ``order`` (its first column is the time);
    null for the first row."""
    rows = df.withColumn("_b", F.floor(F.col(order[0]) / F.lit(bucket))).withColumn("_v", F.struct(*columns))
    ends = rows.groupBy(*keys, "_b").agg(F.max_by("_v", F.struct(*order)).alias("_e"))
    rows = _joined(rows, _carried(ends, keys, F.last("_e")), keys)
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    return rows.withColumn(out, F.coalesce(F.lag("_v").over(inside), F.col("_c"))).drop("_b", "_v", "_c")


def running(df: DataFrame, keys: list[str], order: list[str], value, out: str, kind: str = "sum", bucket: int = DAY_NS, own: bool = True) -> DataFrame:
    """``df`` with ``out``: the sum or maximum (``kind``) of ``value`` over the key's rows up to this one; without ``own``, up to
    the one before (null or 0 for the first)."""
    total = {"sum": F.sum, "max": F.max}[kind]
    rows = df.withColumn("_b", F.floor(F.col(order[0]) / F.lit(bucket))).withColumn("_v", value)
    ends = rows.groupBy(*keys, "_b").agg(total("_v").alias("_e"))
    rows = _joined(rows, _carried(ends, keys, total("_e")), keys)
    inside = total("_v").over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if own else -1))
    found = F.coalesce(F.col("_c"), F.lit(0)) + F.coalesce(inside, F.lit(0)) if kind == "sum" else F.greatest("_c", inside)
    return rows.withColumn(out, found).drop("_b", "_v", "_c")


def trailing(df: DataFrame, keys: list[str], ts: str, value: str, span: int, out: str) -> DataFrame:
    """``df`` with ``out``: the maximum of ``value`` over the key's rows of the last ``span``, this one's time included.

    Buckets are as wide as the span; a row is a guest in the bucket after its own.
    """
    rows = df.withColumn("_at", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("_b", F.expr(f"{ts} div {span}") + F.col("_at"))
    back = Window.partitionBy(*keys, "_b").orderBy(ts).rangeBetween(-span, Window.currentRow)
    return rows.withColumn(out, F.max(value).over(back)).where("_at = 0").drop("_at", "_b")
