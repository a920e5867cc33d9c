"""Places from differences of arrival times: exact and noisy data, plane sensors, far sources, odd rows."""

import itertools

import numpy as np
import pytest

from earshot.operators.tdoa import NAMES, solve_rows

C = 343.0
DDL = "event long, pairs array<struct<ax:double,ay:double,az:double,bx:double,by:double,bz:double,tau_s:double,weight:double,peak:double>>, speed double, z double"


def pairs(sensors, at, noise=0.0, rng=None, weight=1.0, outlier=None):
    out = []
    for k, (a, b) in enumerate(itertools.combinations(sensors, 2)):
        tau = (np.linalg.norm(at - a) - np.linalg.norm(at - b)) / C + (rng.normal(0, noise) if noise else 0.0)
        if k == outlier:
            tau += 0.02
        out.append((*map(float, a), *map(float, b), float(tau), weight, 0.9))
    return out


def solved(spark, rows, **more):
    return {r.event: r.asDict() for r in solve_rows(spark.createDataFrame(rows, DDL), "event", **more).collect()}


SITE = np.array([[0, 0, 0], [20, 0, 1], [0, 20, 2], [20, 20, 4], [10, 10, 9]], float)


def test_exact_noisy_and_outliers(spark):
    rng, rows, truth = np.random.default_rng(1), [], {}
    for i in range(300):
        at = rng.uniform([-5, -5, 0], [25, 25, 12])
        truth[i] = at
        rows.append((i, pairs(SITE, at, [0, 2e-5, 2e-5][i % 3], rng, outlier=2 if i % 3 == 2 else None), C, None))
    got = solved(spark, rows)
    miss = {k: np.linalg.norm([got[k][c] - t for c, t in zip("xyz", truth[k], strict=True)]) for k in truth}
    by = [np.array([miss[k] for k in truth if k % 3 == j]) for j in range(3)]
    assert np.quantile(by[0], 0.95) < 0.01 and np.median(by[1]) < 0.1 and np.quantile(by[1], 0.9) < 0.45 and np.median(by[2]) < 0.45
    assert sum(got[k]["mode"] == "refined" for k in truth) > 280
    # deviations tell how wrong the noisy ones are
    sigma = np.array([np.sqrt(got[k]["cxx"] + got[k]["cyy"] + got[k]["czz"]) for k in truth if k % 3 == 1])
    assert np.mean(by[1] <= 4 * sigma) > 0.95 and all(got[k]["gdop"] > 0 for k in truth)


def test_fixed_height_and_half_space(spark):
    rng, rows, truth = np.random.default_rng(2), [], {}
    flat = SITE * [1, 1, 0]
    for i in range(60):
        at = np.append(rng.uniform(-5, 25, 2), 1.5 if i < 30 else float(rng.uniform(2, 8)))
        truth[i] = at
        rows.append((i, pairs(flat, at), C, 1.5 if i < 30 else None))
    got = solved(spark, rows, half_space="upper")
    for i, at in truth.items():
        assert np.linalg.norm([got[i][c] - t for c, t in zip("xyz", at, strict=True)]) < (0.01 if i < 30 else 0.3), i
    assert all(got[i]["z"] == 1.5 and got[i]["czz"] == 0 for i in range(30))
    assert all(r["z"] <= 1e-6 for i, r in solved(spark, rows[30:], half_space="lower").items())


def test_far_source_of_a_small_array_is_a_bearing(spark):
    small, rng = SITE / 100, np.random.default_rng(3)
    at = np.array([300.0, 200.0, 40.0])
    rows = [(i, pairs(small, at, 1e-6, rng), C, None) for i in range(20)]
    got = solved(spark, rows)
    for r in got.values():
        assert r["mode"] in ("bearing_projected", "asymptotic") and r["confidence"] <= 0.6 and r["observability"] < 0.2
        u = np.array([r[c] for c in "xyz"]) - small.mean(axis=0)
        assert u @ at / np.linalg.norm(u) / np.linalg.norm(at) > 0.98


def test_odd_rows(spark):
    good = pairs(SITE, np.array([5.0, 6.0, 3.0]))
    bad = [(*good[0][:6], None, 1.0, 0.9), (*good[0][:6], float("nan"), 1.0, 0.9), (*good[1][:6], 0.1, 0.0, 0.9)]
    rows = [(1, good + bad, None, None), (2, [], C, None), (3, None, C, None), (4, good[:2], C, None), (5, [(0.0,) * 6 + (0.0, 1.0, 1.0)] * 4, C, None), (None, good + good, C, None)]
    got = solved(spark, rows)
    assert {k: (r["mode"], r["n_pairs"]) for k, r in got.items()} == {1: ("refined", 10), 2: ("insufficient", 0), 3: ("insufficient", 0), 4: ("insufficient", 2), 5: ("insufficient", 4), None: ("refined", 20)}
    assert all(got[2][n] is None for n in NAMES) and got[1]["x"] == pytest.approx(5, abs=1e-3)
    assert solve_rows(spark.createDataFrame([], DDL), "event").count() == 0


def test_settled_starts_leave_and_ties_go_to_the_first():
    """A batch's work follows what its starts need; an event's place depends neither on its batch nor, with two exact places, on rounding."""
    from earshot.operators import tdoa

    rng = np.random.default_rng(7)
    flat = SITE * [1, 1, 0]  # mirrored places fit equally well
    rows = [pairs(SITE if i % 2 else flat, rng.uniform([-5, -5, 1], [25, 25, 12])) for i in range(200)]
    data = np.array(rows)
    seen, at = [], tdoa._Lanes.at

    def counted(self, p):
        seen.append(p.shape[1])
        return at(self, p)

    def solved_alone(part):
        e = tdoa.Events(part[:, :, :3], part[:, :, 3:6], part[:, :, 6], part[:, :, 7], np.full(len(part), C), 1e-3)
        return tdoa.solve(e, np.full(len(part), 0.9), 1 / 48_000)[1][:, :3]

    tdoa._Lanes.at = counted
    try:
        together = solved_alone(data)
    finally:
        tdoa._Lanes.at = at
    assert sum(seen) < 40 * 6 * len(data)  # 81 each before
    turned = solved_alone(data[:, ::-1])  # other roundings
    alone = np.concatenate([solved_alone(data[i : i + 1]) for i in range(len(data))])
    assert np.abs(together - alone).max() < 1e-6 and np.abs(together - turned)[1::2].max() < 1e-3


def test_spherical_starts_are_the_plain_ones():
    from earshot.operators.tdoa import Events

    rng = np.random.default_rng(8)
    data = np.array([pairs(SITE, rng.uniform([-5, -5, 0], [25, 25, 12]), 2e-5, rng) for _ in range(50)])
    data[:, 3, 7] = 0.0
    e = Events(data[:, :, :3], data[:, :, 3:6], data[:, :, 6], data[:, :, 7], np.full(50, C), 1e-3)
    for i, got in enumerate(e.linear()):
        used = e.w[i] > 0
        a, b, d = e.a[i, used], e.b[i, used], e.tau[i, used] * C
        places, times = np.unique(np.concatenate([a, b]), axis=0, return_counts=True)
        ref = places[times.argmax()]
        first, second = (b == ref).all(axis=1), (a == ref).all(axis=1)
        at, diff = np.concatenate([a[first], b[second]]), np.concatenate([d[first], -d[second]])
        want = np.linalg.lstsq(np.column_stack([2 * (at - ref), 2 * diff]), (at * at).sum(axis=1) - ref @ ref - diff**2, rcond=None)[0][:3]
        assert len(at) == 4 and got == pytest.approx(want, abs=1e-6)
