"""Points and boxes that meet on cells as wide as the box.

A box covers at most four cells of the grid of its own level (the power of two that isn't below its longer side), whatever
its size; a point stands in one cell of each level that a box has. So neither a country nor a field makes many rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import stage


def by_cells(points: DataFrame, boxes: DataFrame, at: tuple[str, str], bounds: tuple[str, str, str, str]) -> DataFrame:
    """Rows of ``points`` with those of ``boxes`` whose bounds hold them, ends included; ``bounds`` are least and most of each axis."""
    y0, y1, x0, x1 = (F.col(c) for c in bounds)
    level = F.greatest(F.ceil(F.log2(F.greatest(y1 - y0, x1 - x0, F.lit(1e-9)))), F.lit(-30)).cast("int")
    some = boxes.where(y0.isNotNull() & y1.isNotNull() & x0.isNotNull() & x1.isNotNull()).withColumn("_l", level)
    cell = F.pow(F.lit(2.0), F.col("_l"))
    cells = some.withColumn("_i", F.explode(F.sequence(F.floor(y0 / cell), F.floor(y1 / cell)))).withColumn("_j", F.explode(F.sequence(F.floor(x0 / cell), F.floor(x1 / cell))))
    levels = stage(some.agg(F.collect_set("_l").alias("_ls")), "levels")  # a number per doubling of size
    rows = points.crossJoin(levels).withColumn("_l", F.explode("_ls")).drop("_ls")  # a single row
    y, x = F.col(at[0]), F.col(at[1])
    rows = rows.withColumn("_i", F.floor(y / cell)).withColumn("_j", F.floor(x / cell))
    return rows.join(cells, ["_l", "_i", "_j"]).where((y >= y0) & (y <= y1) & (x >= x0) & (x <= x1)).drop("_l", "_i", "_j")
