"""Sample buffers against a plain buffer: late, repeated and overlapping frames, holes, corrected clocks."""

import numpy as np

from earshot.operators import buffers as B

DDL = "sensor long, received_ns long, start_ns long, start_index long, samples array<float>"
RATE = 1000


def frame(sensor, received, index, n, value, by_time=False, shift_s=0):
    return (sensor, received, int((index / RATE + shift_s) * 1e9), None if by_time else index, [float(value)] * n)


def test_windows_are_those_of_a_plain_buffer(spark):
    rng, rows = np.random.default_rng(3), []
    line = {s: {} for s in range(4)}
    for k in range(400):
        s, at, n = int(rng.integers(4)), int(rng.integers(0, 5000)), int(rng.integers(1, 60))
        rows.append(frame(s, k, at, n, k))
        line[s].update({at + i: k for i in range(n)})
    df = spark.createDataFrame(rows + rows[:20], DDL)
    placed = B.placed_frames(df, RATE)
    got = {(r.sensor, r.first, r.end) for r in B.coverage(placed, bucket=100).collect()}
    want = set()
    for s, of in line.items():
        at = sorted(of)
        cuts = [0, *[i for i in range(1, len(at)) if at[i] != at[i - 1] + 1], len(at)]
        want |= {(s, at[a], at[b - 1] + 1) for a, b in zip(cuts, cuts[1:])}
    assert got == want
    asked = spark.createDataFrame([(w, s, 1, w * 130 - 40, w * 130 + 217) for w in range(42) for s in range(5)], "window long, sensor long, epoch long, first long, end long")
    filled = B.windows(placed, asked, bucket=50)
    for r in filled.collect():
        at = range(r.window * 130 - 40, r.window * 130 + 217)
        own = line.get(r.sensor, {})
        assert r.samples == [float(own.get(i, 0)) for i in at] and r.covered == sum(i in own for i in at)
    full = {(r.window, r.sensor) for r in B.synchronized(filled, 2, 0.5).collect()}
    assert full and all(sum((w, s) in full for s in range(4)) >= 2 for w, _ in full)


def test_epochs_and_frames_placed_by_time(spark):
    rows = [frame(1, 1, 0, 100, 1), frame(1, 2, 100, 100, 2), frame(1, 3, 200, 100, 3, shift_s=500), frame(1, 4, 300, 100, 4, shift_s=500), frame(1, 5, 90_000, 10, 5, shift_s=500)]
    rows += [frame(2, 1, 1000, 100, 1, True), frame(2, 2, 1103, 100, 2, True), frame(2, 3, 1290, 100, 3, True), frame(2, 4, 1600, 100, 4, True)]
    rows += [(3, 1, None, 0, [1.0]), (None, 1, 1, 0, [1.0]), (4, 1, 1, 0, None), (4, 1, 1, 0, []), (5, 1, 0, 0, [None, 2.0])]
    placed = B.placed_frames(spark.createDataFrame(rows, DDL), RATE, most_s=60)
    got = sorted((r.sensor, r.epoch, r.first, r.end) for r in placed.collect())
    assert got == [(1, 1, 0, 100), (1, 1, 100, 200), (1, 2, 200, 300), (1, 2, 300, 400), (1, 3, 90_000, 90_010), (2, 1, 1000, 1100), (2, 1, 1100, 1200), (2, 1, 1290, 1390), (2, 1, 1600, 1700), (5, 1, 0, 2)]
    assert sorted((r.epoch, r.first, r.end) for r in B.coverage(placed).where("sensor = 2").collect()) == [(1, 1000, 1200), (1, 1290, 1390), (1, 1600, 1700)]
    assert B.coverage(B.placed_frames(spark.createDataFrame([], DDL), RATE)).count() == 0
