"""Gated one-to-one assignment of two sets of points, e.g. tracks of two sites.

Pairs within the gate (Mahalanobis distance under the sum of both covariances) are found on grids whose cells fit the reach
of the wider point of a pair, so that one point with a huge covariance doesn't widen all cells. The pairs are the edges of a
graph; its connected components are found by Spark and assigned one by one. A pair out of the gate counts ``gate + 1``,
whichever it is, so the assignment of least total distance falls into the components'; no task holds more than one.

Edge cases: points without position or key meet nothing; of equally good assignments one with the smaller left ids first is
taken; rows that repeat an id are one point each only if they are equal (the first is taken); empty sides give no pair.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import components, stage


def gated_pairs(left: DataFrame, right: DataFrame, keys: list[str], gate: float) -> DataFrame:
    """(keys, l, r, d) of pairs within the gate. ``left``: keys, l, x, y, cxx, cxy, cyy; ``right``: the same with r."""
    least = F.lit(1e-6)

    def with_level(df: DataFrame) -> DataFrame:
        wide = (F.col("cxx") + F.col("cyy")) / 2 + F.hypot((F.col("cxx") - F.col("cyy")) / 2, F.col("cxy"))
        reach = gate * F.sqrt(2 * F.greatest(wide, least) + least)
        return df.where("x is not null and y is not null").withColumn("lv", F.greatest(F.ceil(F.log2(reach)), F.lit(-20)).cast("int"))

    a, b = with_level(left), with_level(right)
    levels = a.select("lv").union(b.select("lv")).distinct()  # a row per doubling of the reach
    every = F.array_sort(F.collect_set("lv"))
    names = stage(levels.agg(every.alias("levels")), "levels")
    cell = F.pow(F.lit(2.0), F.col("at"))

    def placed(df: DataFrame, around: bool) -> DataFrame:
        df = df.crossJoin(names).withColumn("at", F.explode(F.filter("levels", lambda x: x >= F.col("lv")))).drop("levels")  # a single row
        df = df.withColumn("i", F.floor(F.col("x") / cell)).withColumn("j", F.floor(F.col("y") / cell))
        if around:
            df = df.withColumn("di", F.explode(F.sequence(F.lit(-1), F.lit(1)))).withColumn("dj", F.explode(F.sequence(F.lit(-1), F.lit(1))))
            df = df.withColumn("i", F.col("i") + F.col("di")).withColumn("j", F.col("j") + F.col("dj")).drop("di", "dj")
        return df

    two = placed(b, False).select(*keys, "at", "i", "j", "r", F.col("x").alias("x2"), F.col("y").alias("y2"), *[F.col(c).alias(c + "2") for c in ("cxx", "cxy", "cyy", "lv")])
    met = placed(a, True).join(two, [*keys, "at", "i", "j"]).where(F.col("at") == F.greatest("lv", "lv2"))
    dx, dy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    xx, xy, yy = F.greatest("cxx", least) + F.greatest("cxx2", least) + least, F.col("cxy") + F.col("cxy2"), F.greatest("cyy", least) + F.greatest("cyy2", least) + least
    d2 = (yy * dx * dx - 2 * xy * dx * dy + xx * dy * dy) / F.greatest(xx * yy - xy * xy, F.lit(1e-12))
    return met.withColumn("d", F.sqrt(F.greatest(d2, F.lit(0.0)))).where(F.col("d") <= gate).select(*keys, "l", "r", "d").dropDuplicates([*keys, "l", "r"])


def least_assignment(cost: np.ndarray) -> list[int]:
    """Of each row (not more than columns) the column in an assignment of least total cost; shortest augmenting paths."""
    n, m = cost.shape
    u, v, owner = np.zeros(n + 1), np.zeros(m + 1), np.full(m + 1, n)
    for i in range(n):
        owner[m] = i
        at, best, back, done = m, np.full(m, math.inf), np.full(m, m), np.zeros(m + 1, bool)
        while owner[at] != n:
            done[at] = True
            own = owner[at]
            reduced = cost[own] - u[own] - v[:m]
            better = ~done[:m] & (reduced < best)
            best[better], back[better] = reduced[better], at
            free = np.where(done[:m], math.inf, best)
            step = int(free.argmin())
            by = free[step]
            u[owner[done]] += by
            v[done] -= by
            best[~done[:m]] -= by
            at = step
        while at != m:
            owner[at] = owner[back[at]]
            at = back[at]
    out = [-1] * n
    for j in range(m):
        if owner[j] < n:
            out[owner[j]] = j
    return out


def assigned(pairs: DataFrame, keys: list[str], gate: float) -> DataFrame:
    """(keys, l, r, d): the one-to-one pairs of least total, from pairs within the gate."""
    left, right = F.concat_ws("|", *keys, F.lit("l"), F.col("l")), F.concat_ws("|", *keys, F.lit("r"), F.col("r"))
    edges = stage(pairs.withColumn("a", left).withColumn("b", right), "gated")
    of = components(edges.select("a", "b"))
    rows = edges.join(of, F.col("a") == F.col("node")).select("component", *keys, "l", "r", "d")

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        ls, rs = np.unique(part["l"]), np.unique(part["r"])
        i, j = np.searchsorted(ls, part["l"]), np.searchsorted(rs, part["r"])
        cost = np.full((len(ls), len(rs)), gate + 1.0)
        cost[i, j] = part["d"]
        turned = len(ls) > len(rs)
        chosen = least_assignment(cost.T if turned else cost)
        pick = {(c, r) if turned else (r, c) for r, c in enumerate(chosen)}
        keep = [(a, b) in pick for a, b in zip(i, j, strict=True)]
        return part[keep][[*keys, "l", "r", "d"]]

    kinds = dict(pairs.dtypes)
    return rows.groupBy("component").applyInPandas(solve, ", ".join(f"`{c}` {kinds[c]}" for c in [*keys, "l", "r", "d"]))
