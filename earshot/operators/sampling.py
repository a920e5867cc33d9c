"""Uniform samples of bounded size per key, that merge and repeat.

A row's draw is a digest of a seed and its id; a key's sample are the rows with the smallest draws. So the sample is the same
however the rows lie in partitions, in a batch or in pieces that are merged, and each set of rows is equally likely over seeds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _least(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    order = Window.partitionBy(*keys).orderBy("draw", "id", "tie")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= size)


def reservoirs(rows: DataFrame, keys: list[str], size: int, seed: str = "0", id_column: str = "id", parts: int = 64) -> DataFrame:
    """Per key at most ``size`` rows: the keys, id, draw, place (from 1), and ``row``, the row as it was.

    Rows of a key are cut down within each partition, then within ``parts`` parts of the key, then as a whole, so the last
    task of a hot key reads ``size * parts`` rows at most. Rows without id are left out; rows that repeat an id have one draw
    and count each, in the order of a hash of their columns (maps left out); null keys are a key; an empty table gives no row.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row")
    tie = F.xxhash64(*[F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString()]).alias("tie")
    draw = F.md5(F.concat_ws(":", F.lit(seed), F.col(id_column).cast("string"))).alias("draw")
    drawn = rows.where(F.col(id_column).isNotNull()).select(*keys, F.col(id_column).alias("id"), draw, tie, whole)
    part = F.pmod(F.xxhash64("draw", "tie"), F.lit(parts)).alias("part")
    first = _least(drawn.select("*", part), [*keys, "part"], size)
    return _least(first.drop("place", "part"), keys, size)


def merged(one: DataFrame, other: DataFrame, keys: list[str], size: int) -> DataFrame:
    """The sample of all rows from the samples of two disjoint parts of them, drawn with the same seed and of ``size`` or more."""
    return _least(one.drop("place").unionByName(other.drop("place")), keys, size)
