"""Gated assignment against permutations, hot cells and one wide point."""

import itertools

import numpy as np
import pytest

from earshot.operators.assignment import assigned, gated_pairs, least_assignment

DDL = "tick long, {0} long, x double, y double, cxx double, cxy double, cyy double"


@pytest.mark.parametrize("shape", [(1, 1), (3, 3), (4, 6), (6, 6), (2, 7)])
def test_least_total(shape):
    rng = np.random.default_rng(shape[0])
    for _ in range(20):
        cost = rng.random(shape) if rng.random() < 0.5 else rng.integers(0, 3, shape).astype(float)
        got = least_assignment(cost)
        assert len(set(got)) == shape[0] and sum(cost[i, j] for i, j in enumerate(got)) == pytest.approx(min(sum(cost[i, j] for i, j in enumerate(p)) for p in itertools.permutations(range(shape[1]), shape[0])))


def test_ticks_by_permutations(spark):
    rng, gate, left, right = np.random.default_rng(5), 3.0, [], []
    for tick in range(12):
        for k in range(6):
            left.append((tick, k, *map(float, rng.uniform(0, 25, 2)), float(rng.uniform(0.5, 9)), float(rng.uniform(-0.3, 0.3)), float(rng.uniform(0.5, 9))))
        for k in range(5):
            right.append((tick, k + 100, *map(float, rng.uniform(0, 25, 2)), float(rng.uniform(0.5, 9)), 0.0, float(rng.uniform(0.5, 9) if k else 900)))
    a, b = spark.createDataFrame(left, DDL.format("l")), spark.createDataFrame(right, DDL.format("r"))
    pairs = gated_pairs(a, b, ["tick"], gate)

    def d(p, q):
        joint = np.array([[p[4] + q[4], p[5] + q[5]], [p[5] + q[5], p[6] + q[6]]]) + np.eye(2) * 1e-6
        gap = np.array([q[2] - p[2], q[3] - p[3]])
        return float(np.sqrt(gap @ np.linalg.inv(joint) @ gap))

    near = {(p[0], p[1], q[1]): d(p, q) for p in left for q in right if p[0] == q[0] and d(p, q) <= gate}
    assert {(r.tick, r.l, r.r): pytest.approx(r.d) for r in pairs.collect()} == near
    got = assigned(pairs, ["tick"], gate).collect()
    for tick in range(12):
        own = [(r.l, r.r) for r in got if r.tick == tick]
        assert len({x for x, _ in own}) == len({y for _, y in own}) == len(own)
        total = sum(near[tick, x, y] for x, y in own) + (5 - len(own)) * (gate + 1)
        best = min(sum(near.get((tick, p[k], 100 + k), gate + 1) for k in range(5)) for p in itertools.permutations(range(6), 5))
        assert total == pytest.approx(best)


def test_empty_and_missing_places(spark):
    a = spark.createDataFrame([(1, 1, None, 0.0, 1.0, 0.0, 1.0), (None, 2, 0.0, 0.0, 1.0, 0.0, 1.0), (1, 3, 0.0, 0.0, 1.0, 0.0, 1.0), (1, 3, 0.0, 0.0, 1.0, 0.0, 1.0)], DDL.format("l"))
    b = spark.createDataFrame([(1, 9, 0.5, 0.0, 1.0, 0.0, 1.0)], DDL.format("r"))
    assert [(r.l, r.r) for r in assigned(gated_pairs(a, b, ["tick"], 3.0), ["tick"], 3.0).collect()] == [(3, 9)]
    assert assigned(gated_pairs(a, b.where("false"), ["tick"], 3.0), ["tick"], 3.0).count() == 0
