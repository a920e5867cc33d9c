"""Nearest detections and matches in turn, against plain loops: dense and sparse times, coinciding places, borders, odd rows."""

import math
import random

import numpy as np
import pytest

from earshot.operators.nearest import SPANS, greedy, nearest, nearest_of
from earshot.plans.evaluation import greedy_matches

DDL = "id long, label string, timestamp_ns long, x double, y double"
SPAN = 10


def scene(seed, n, long, lattice):
    rng = random.Random(seed)
    place = (lambda: float(rng.randrange(lattice) * 10)) if lattice else (lambda: rng.uniform(-50, 50) if rng.random() < 0.9 else rng.uniform(-5000, 5000))
    rows = [(i, rng.choice(["a", "b", None]), rng.randrange(-long, long), place(), place()) for i in range(n)]
    return [r for r in rows if r[0] % 4 == 0], [r for r in rows if r[0] % 4]


@pytest.mark.parametrize(("n", "long", "lattice"), [(400, 60, 0), (400, 3000, 0), (500, 40, 3), (300, 0, 1)])
def test_nearest_is_the_plain_one(n, long, lattice):
    truth, found = scene(n + lattice, n, long or 1, lattice)
    found = sorted(found + truth, key=lambda r: r[2])  # an event is never its own neighbour
    found[5], found[9] = (*found[5][:3], math.nan, 1.0), (*found[9][:3], 1.0, math.nan)
    found.sort(key=lambda r: r[2])
    t, d = (list(map(np.array, zip(*[(r[2], r[3], r[4], r[0]) for r in rows], strict=True))) for rows in (truth, found))
    pick, m = nearest_of(*t, *d, SPAN)
    for k, e in enumerate(truth):
        far = [(x if math.isfinite(x := math.sqrt((f[3] - e[3]) * (f[3] - e[3]) + (f[4] - e[4]) * (f[4] - e[4]))) else math.inf, f[0]) for f in found if abs(f[2] - e[2]) <= SPAN and f[0] != e[0]]
        best = min(far, default=(math.inf, None))
        assert (m[k], int(d[3][pick[k]]) if pick[k] >= 0 else None) == best


def in_turn(truth, found, reach):
    free, hits = sorted((r for r in found if r[2] is not None), key=lambda r: (r[2], r[0])), []
    for e in sorted((r for r in truth if r[2] is not None), key=lambda r: (r[2], r[0])):
        far = [((f[3] - e[3]) * (f[3] - e[3]) + (f[4] - e[4]) * (f[4] - e[4]), k) for k, f in enumerate(free) if abs(f[2] - e[2]) <= SPAN]
        if far and min(far)[0] <= reach * reach:
            hits.append((e[0], free.pop(min(far)[1])))
    return hits


@pytest.mark.parametrize(("n", "long", "lattice"), [(600, 300, 0), (600, 2000, 0), (800, 400, 2), (300, 20, 1)])
def test_matches_in_turn(spark, n, long, lattice):
    truth, found = scene(n, n, long, lattice)
    hits = in_turn(truth, found, 40.0)
    label = {r[0]: r[1] for r in truth}
    confused = sum(f[1] is None or f[1] != label[t] for t, f in hits)
    odd = [(10**6, "a", None, 0.0, 0.0)]
    r = greedy_matches(spark.createDataFrame(truth + odd, DDL), spark.createDataFrame(found + odd, DDL), SPAN, 40.0).first()
    assert (r.matched, r.missed, r.extra, r.confused) == (len(hits), len(truth) + 1 - len(hits), len(found) + 1 - len(hits), confused)


def test_a_chain_through_all_borders(spark):
    """Each event finds its own detection taken by the one before it, over many blocks; in pairs that is a round an event."""
    truth = [(k, "a", 10 * k, 0.0, 0.0) for k in range(6 * SPANS)]
    found = [(1000 + k, "a", 10 * k + 10, 0.0, 0.0) for k in range(-1, 6 * SPANS)]
    r = greedy(spark.createDataFrame(truth, DDL), spark.createDataFrame(found, DDL), SPAN, 1.0).collect()
    assert len(r) == 6 and sum(x.matched for x in r) == len(truth)


def test_dense_times_make_no_pairs(spark):
    """40,000 rows at one time, 300 million pairs in reach of time: rows alone are shuffled, and equal places go by id."""
    rows = spark.range(40_000).selectExpr("id", "'a' AS label", "1000L AS timestamp_ns", "cast(id % 50 AS double) AS x", "0D AS y")
    truth, found = rows.where("id % 4 = 0"), rows.where("id % 4 <> 0")
    r = greedy_matches(truth, found, SPAN, 0.5).first()
    assert (r.matched, r.missed, r.extra, r.confused) == (10_000, 0, 20_000, 0)
    got = nearest(truth, rows, SPAN)
    assert got.count() == 10_000 and got.where("m = 0 and near_id < 150").count() == 10_000
    assert nearest(truth.where("false"), rows, SPAN).count() == 0 and nearest(truth, rows.where("false"), SPAN).where("m is null").count() == 10_000
