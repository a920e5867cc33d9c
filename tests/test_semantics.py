"""Hand-made cases and brute force for what SQL on the test tables can't show."""

import math
import random
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from earshot.functions.geo import in_polygon, metres_per_degree
from earshot.operators.cooldown import with_cooldown
from earshot.operators.timeline import DAY_NS, previous, running, trailing
from earshot.plans import areas, evaluation, fusion, site, store, windows

S = 1_000_000_000


def test_report_decisions(spark):
    rows = [
        (1, 1, "owl", "omni", 0, "insert"), (2, 1, "owl", "omni", 1, "suppress"), (3, 1, "owl", "localized", 2, "upgrade_existing"), (4, 1, "owl", "omni", 3, "enrich_existing"), (5, 1, "owl", "localized", 4, "suppress"),
        (6, 2, "owl", "omni", 5, "enrich_existing"), (7, 2, "owl", "localized", 6, "insert"), (8, 3, "Owl", "omni", 7, "insert"), (9, 4, "owl", "omni", 1, "insert"), (10, 4, "owl", "omni", 8, "suppress"),
    ]
    df = spark.createDataFrame([(i, n, lab, m, t * S, 0) for i, n, lab, m, t, _ in rows], "id long, node_id long, label string, reporting_modality string, timestamp_ns long, report_window_start_ns long")
    assert {r.id: r.decision for r in windows.report_decisions(df).collect()} == {r[0]: r[-1] for r in rows}
    found = {r.label: r for r in windows.window_lookup(df, 2).collect()}
    assert (found["owl"].any_node, found["owl"].of_node, found["owl"].of_none, found["Owl"].any_node) == (7, 7, None, 8)


@pytest.fixture(scope="module")
def hot(spark):
    """One key with nearly all rows over many days, a few rows of another and of none."""
    rng = random.Random(6)
    rows = [("hot", rng.randrange(40 * DAY_NS), i, rng.randrange(100)) for i in range(3000)] + [("rare", rng.randrange(9 * DAY_NS), 5000 + i, i) for i in range(5)] + [(None, i * DAY_NS, 6000 + i, i) for i in range(4)]
    return rows, spark.createDataFrame(rows, "k string, ts long, id long, v long")


def test_timeline_against_brute_force(hot):
    rows, df = hot
    want_before, want_sum, want_max, last, total, high = {}, {}, {}, {}, {}, {}
    for k, ts, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        want_before[i] = last.get(k)
        total[k] = want_sum[i] = total.get(k, 0) + v
        high[k] = want_max[i] = max(high.get(k, v), v)
        last[k] = i
    got = previous(df, ["k"], ["ts", "id"], ["id"])
    assert {r.id: r.before.id if r.before else None for r in got.collect()} == want_before
    assert {r.id: r.s for r in running(df, ["k"], ["ts", "id"], F.col("v"), "s").collect()} == want_sum
    assert {r.id: r.s for r in running(df, ["k"], ["ts", "id"], F.col("v"), "s", "max").collect()} == want_max
    want = {i: max(b[3] for b in rows if b[0] == k and ts - DAY_NS <= b[1] <= ts) for k, ts, i, v in rows if k}
    assert {r.id: r.s for r in trailing(df.where("k is not null"), ["k"], "ts", "v", DAY_NS, "s").collect()} == want


def test_timeline_has_no_task_per_key(hot):
    plan = previous(hot[1], ["k"], ["ts", "id"], ["id"])._jdf.queryExecution().executedPlan().toString()
    windows_ = [line for line in plan.split("\n") if "Window [lag" in line]
    assert windows_ and all("_b#" in line for line in windows_)


def test_cooldowns_of_a_hot_key(hot):
    rows, df = hot
    cool, want, last = 3 * 3600 * S, set(), {}
    for k, ts, i, _ in sorted((r for r in rows if r[0]), key=lambda r: (r[1], r[2])):
        if k not in last or ts - last[k] >= cool:
            want.add(i)
            last[k] = ts
    assert {r.id for r in with_cooldown(df.where("k is not null"), "k", "ts", "id", cool).where("fired").collect()} == want


@pytest.mark.parametrize(("date", "hours"), [("2024-03-31", 23), ("2024-10-27", 25), ("2024-06-01", 24)])
def test_days_with_a_change_of_clocks(date, hours):
    start, end = site.day_bounds("Europe/Berlin", date)
    assert end - start == hours * 3600 * S
    assert datetime.fromtimestamp(start / S, ZoneInfo("Europe/Berlin")).hour == 0


def test_rolling_bounds_and_windows():
    now = int(datetime(2024, 5, 1, 10, 20, tzinfo=ZoneInfo("UTC")).timestamp()) * S
    start, end = site.day_bounds("UTC", end_ns=now, hours=6)
    assert (end - now, end - start) == (40 * 60 * S, 6 * 3600 * S)
    assert [site.window_ns(x) for x in ("24h", "7d", "30m", "1y", "2w", "90")] == [24 * 3600 * S, 7 * 86400 * S, 1800 * S, 365 * 86400 * S, 14 * 86400 * S, 90 * S]
    for bad in ("", "5x", "h"):
        with pytest.raises(ValueError):
            site.window_ns(bad)


def test_polygons(spark):
    ring = [[0.0, 0.0], [0.0, 4.0], [4.0, 4.0], [2.0, 2.0], [4.0, 0.0]]
    points = [(1, 1.0, 1.0), (2, 3.0, 2.0), (3, 3.5, 0.2), (4, 5.0, 5.0), (5, -0.1, 2.0), (6, 1.9, 2.0)]
    df = spark.createDataFrame(points, "id long, lat double, lon double")
    got = {r.id for r in df.where(in_polygon(F.col("lat"), F.col("lon"), F.lit(ring))).collect()}
    assert got == {1, 3, 6}
    a = spark.createDataFrame([(9, ring)], "zone_id long, polygon array<array<double>>")
    assert {r.id for r in areas.inside(df, a).collect()} == got


def test_flat_positions_follow_the_series():
    north, east = metres_per_degree(45.0)
    assert abs(north - 111131.745) < 0.01 and abs(east - 78846.8) < 0.1


def test_node_health(spark):
    now = 10**18
    nodes = spark.createDataFrame([(i, now - s * S) for i, s in ((1, 1), (2, 1), (3, 1), (4, 100), (5, 1), (6, 20))], "id long, last_seen_ns long")
    reports = [(1, 1, "PBIT", now - 9, "FAIL"), (2, 1, "PBIT", now - 5, "PASS"), (3, 2, "IBIT", now, "FAIL"), (4, 3, "CBIT", now - 1000 * S, "PASS"), (5, 4, "PBIT", now, "FAIL"), (6, 6, "PBIT", now, "DEGRADED")]
    df = spark.createDataFrame(reports, "id long, node_id long, report_type string, timestamp_ns long, status string")
    health = lambda f: {r.id: r.health for r in site.node_health(nodes, df, now, 300, f).collect()}
    assert health(True) == {1: "online", 2: "bit_fail", 3: "degraded", 4: "bit_fail", 5: "online", 6: "degraded"}
    assert health(False)[4] == "offline"


def test_guarded_upsert_and_unique_insert(spark):
    stored = spark.createDataFrame([(1, "a", 10, "x"), (2, "b", 10, "y")], "id long, name string, seen long, note string")
    new = spark.createDataFrame([(1, "late", 9, None), (2, "newer", 11, None), (3, "c", 1, "z")], stored.schema)
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    assert rows(store.upsert(stored, new, "id", "seen", ("note",))) == [(1, "a", 10, "x"), (2, "newer", 11, "y"), (3, "c", 1, "z")]
    more = spark.createDataFrame([(7, None, 5, "p"), (8, None, 4, "q"), (9, "A", 1, "r")], stored.schema)
    got = store.insert_unique(stored, more, [F.lower("name")], ["seen"])
    assert {r.id for r in got.collect()} == {1, 2, 8}
    kept = store.retained(spark.createDataFrame([(1, "short", 10), (2, "short", 11), (3, "permanent", 0), (4, "long", 0), (5, None, 0)], "id long, tier string, ts long"), "tier", "ts", {"short": 0, "permanent": 0, "long": -1}, 10)
    assert {r.id for r in kept.collect()} == {2, 3, 4, 5}


def test_bearings_cross(spark):
    rays = [(e, n, ox, oy, dx / math.hypot(dx, dy), dy / math.hypot(dx, dy), 0.8, 2.0) for e, n, ox, oy, dx, dy in (
        (1, 1, 0.0, 0.0, 100.0, 50.0), (1, 2, 100.0, 0.0, 0.0, 50.0), (1, 3, 0.0, 100.0, 100.0, -50.0),
        (2, 1, 0.0, 0.0, 1.0, 1.0), (3, 1, 0.0, 0.0, 1.0, 0.0), (3, 2, 0.0, 50.0, 1.0, 0.01), (4, 1, 0.0, 0.0, 1.0, 0.0), (4, 2, 0.0, 500.0, 1.0, -0.1))]
    got = {r.e: r for r in fusion.bearing_fixes(spark.createDataFrame(rays, "e long, node_id long, ox double, oy double, dx double, dy double, confidence double, std double"), "e").collect()}
    assert (got[1].x, got[1].y, got[1].confidence) == (100.0, 50.0, 0.95)
    assert [got[i].reason for i in (1, 2, 3, 4)] == ["", "insufficient_nodes", "near_parallel", "out_of_range"]


def test_multilateration(spark):
    anchors = [(0.0, 0.0), (40.0, 0.0), (0.0, 40.0), (40.0, 40.0)]
    rows = [(1, *a, math.dist(a, (12.0, 25.0))) for a in anchors] + [(2, *a, 10.0) for a in anchors[:2]] + [(3, 10.0 * i, 0.0, 5.0) for i in range(4)]
    got = fusion.multilaterate(spark.createDataFrame(rows, "d long, x double, y double, range_m double"), "d").collect()
    assert len(got) == 1 and got[0].residual_m < 0.1 and math.dist((got[0].x, got[0].y), (12, 25)) < 0.1 and got[0].receivers == 4


def test_greedy_matches(spark):
    rng = random.Random(3)
    truth = [(i, rng.choice("ab"), rng.randrange(2000) * S, rng.uniform(0, 300), rng.uniform(0, 300)) for i in range(120)]
    found = [(1000 + i, rng.choice("ab"), t + rng.randrange(-8, 9) * S, x + rng.gauss(0, 30), y + rng.gauss(0, 30)) for i, (_, _, t, x, y) in enumerate(truth)]
    free, matched, confused = dict.fromkeys(sorted(range(120), key=lambda i: (found[i][2], found[i][0]))), 0, 0
    for e in sorted(truth, key=lambda r: (r[2], r[0])):
        near = min(((math.dist(e[3:], found[i][3:]), k, i) for k, i in enumerate(free) if abs(found[i][2] - e[2]) <= 5 * S), default=None)
        if near and near[0] <= 60:
            del free[near[2]]
            matched += 1
            confused += found[near[2]][1] != e[1]
    schema = "id long, label string, timestamp_ns long, x double, y double"
    r = evaluation.greedy_matches(spark.createDataFrame(truth, schema), spark.createDataFrame(found, schema), 5 * S, 60.0).first()
    assert (r.matched, r.missed, r.extra, r.confused) == (matched, 120 - matched, len(free), confused)
