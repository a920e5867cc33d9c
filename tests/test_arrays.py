"""Bearings and beams of arrays against plain loops over single rows and against known directions."""

import math

import numpy as np
import pytest

from earshot.operators import arrays

PLACES = np.array([(-0.016, 0.025, -0.010), (0.027, 0.0, -0.010), (-0.016, -0.025, -0.010), (0.005, 0.0, 0.031)])
RATE, SPEED = 16_000, 343.2
SCHEMA = f"id long, rate int, speed double, sensors {arrays.SENSORS}, sx double, sy double, sz double, text string"


def heard(direction, tones, n=4096, noise=0.0, seed=0):
    """Windows of a plane wave of (Hz, level) from ``direction``."""
    d = np.array(direction) / np.linalg.norm(direction)
    t = np.arange(n)[None] / RATE + (PLACES @ d)[:, None] / SPEED
    return sum(level * np.sin(2 * np.pi * hz * t) for hz, level in tones) + noise * np.random.default_rng(seed).normal(size=(4, n))


def sensors(windows, places=PLACES):
    return [(*map(float, p), [float(x) for x in w]) for p, w in zip(places, windows, strict=True)]


def table(spark, rows):
    return spark.createDataFrame([(k, RATE, SPEED, s, *map(float, aim), "x") for k, (s, aim) in enumerate(rows)], SCHEMA)


DIRECTIONS = [(1, 0.2, 0.1), (-0.2, 0.9, 0.15), (-0.7, -0.6, 0.4), (0.1, -1, -0.3)]


@pytest.mark.parametrize("method", ["subspace", "phase"])
def test_bearings_find_the_direction(spark, method):
    df = table(spark, [(sensors(heard(d, [(1500, 1.0)], noise=0.01, seed=k)), (0, 0, 0)) for k, d in enumerate(DIRECTIONS)])
    got = {r.id: r for r in arrays.bearings(df, method, azimuth_step=3, elevation_step=3).collect()}
    for k, d in enumerate(DIRECTIONS):
        found, true = np.array([got[k].dx, got[k].dy, got[k].dz]), np.array(d) / np.linalg.norm(d)
        assert math.degrees(math.acos(min(1, found @ true))) < 4
        assert got[k].frequency_hz == 1500 and 1 <= got[k].sources <= 3 and 0.3 < got[k].quality <= 1 and got[k].reason is None


@pytest.mark.parametrize("method", ["subspace", "phase"])
def test_the_band_tells_sources_apart(spark, method):
    both = heard(DIRECTIONS[0], [(500, 1.0)]) + heard(DIRECTIONS[1], [(2500, 0.9)])
    df = table(spark, [(sensors(both), (0, 0, 0))])
    for (low, high), d in zip([(400, 700), (2200, 2800)], DIRECTIONS, strict=False):
        r = arrays.bearings(df, method, low, high, 3, 3).first()
        assert np.array([r.dx, r.dy, r.dz]) @ np.array(d) / np.linalg.norm(d) > math.cos(math.radians(5))


def plain_subspace(places, windows, low, high, step, sources):
    """One row, angle by angle."""
    x = windows[0] - windows[0].mean()
    hz = np.fft.rfftfreq(x.size, 1 / RATE)
    inside = (hz >= low) & (hz <= high)
    f = hz[inside][np.abs(np.fft.rfft(x * np.hanning(x.size)))[inside].argmax()]
    frame = min(1024, x.size)
    shots = [np.fft.rfft(windows[:, s : s + frame] * np.hanning(frame), axis=1)[:, round(f * frame / RATE)] for s in range(0, x.size - frame + 1, frame // 2)]
    r = sum(np.outer(s, s.conj()) / np.vdot(s, s).real for s in shots) / len(shots)
    noise = np.linalg.eigh(r)[1][:, ::-1][:, sources:]
    best, at = -1.0, None
    for e in np.arange(-65, 65.01, step):
        for a in np.arange(-180.0, 180.0, step):
            d = np.array([math.cos(math.radians(e)) * math.cos(math.radians(a)), math.cos(math.radians(e)) * math.sin(math.radians(a)), math.sin(math.radians(e))])
            steer = np.exp(2j * np.pi * f * ((places - places.mean(0)) @ d) / SPEED)
            score = 1 / max(np.linalg.norm(noise.conj().T @ steer) ** 2, 1e-12)
            if score > best * (1 + 1e-9):
                best, at = score, d
    return f, at


def test_subspace_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    windows = [heard(rng.normal(size=3), [(700, 1.0), (1900, 0.8)], n=n, noise=0.3, seed=n + k) for n in (3000, 6000) for k in range(4)]
    for sources in (1, 2, 3):
        got = {r.id: r for r in arrays.bearings(table(spark, [(sensors(w), (0, 0, 0)) for w in windows]), "subspace", 300, 4000, 10, 10, sources).collect()}
        for k, w in enumerate(windows):
            f, d = plain_subspace(PLACES, w, 300, 4000, 10, sources)
            assert got[k].frequency_hz == pytest.approx(f) and got[k].sources == sources
            assert np.allclose([got[k].dx, got[k].dy, got[k].dz], d)


def test_source_counts():
    two = arrays.source_counts(np.array([[5.0, 4.0, 0.1, 0.1], [9.0, 0.1, 0.1, 0.1], [1.0, 1.0, 1.0, 1.0]]), 200)
    assert two.tolist() == [2, 1, 1]
    assert arrays.source_counts(np.array([[5.0, 4.0, 0.1, 0.1]]), 4).tolist() == [1]


def plain_beam(method, places, windows, aim):
    """One row, frequency by frequency, with the covariance solved."""
    far = np.linalg.norm(places - aim, axis=1) / SPEED
    lag, n = far - far.min(), windows.shape[1]
    if method == "delay_sum":
        t = np.arange(n) / RATE
        return np.mean([np.interp(t + d, t, w, right=0.0) for d, w in zip(lag, windows, strict=True)], axis=0)
    x, hz = np.fft.rfft(windows, axis=1), np.fft.rfftfreq(n, 1 / RATE)
    y = x.mean(0)
    for k, f in enumerate(hz):
        a = np.exp(-2j * np.pi * f * lag)
        if method == "delay_sum_spectrum":
            y[k] = (a.conj() * x[:, k]).mean()
        elif 200 <= f <= 5000:
            if method == "least_variance":
                r = np.outer(x[:, k], x[:, k].conj()) + 1e-3 * np.eye(len(a))
            else:
                r = np.sinc(2 * f * np.linalg.norm(places[:, None] - places, axis=2) / SPEED) + 1e-2 * np.eye(len(a))
            w = np.linalg.solve(r, a)
            y[k] = (w / np.vdot(a, w)).conj() @ x[:, k]
    return np.fft.irfft(y, n)


@pytest.mark.parametrize("method", list(arrays.BEAMS))
def test_beams_equal_plain_loops(spark, method):
    rng = np.random.default_rng(5)
    cases = [(heard(rng.normal(size=3), [(900, 1.0), (3100, 0.5)], n=n, noise=0.2, seed=n), rng.normal(size=3) * 5) for n in (2, 255, 256, 600)]
    got = {r.id: r for r in arrays.beams(table(spark, [(sensors(w), aim) for w, aim in cases]), method).collect()}
    for k, (w, aim) in enumerate(cases):
        want = plain_beam(method, PLACES, w, aim)
        assert np.allclose(got[k].samples, want, atol=2e-4)
        assert got[k].rms == pytest.approx(math.sqrt((want**2).mean()), abs=2e-4)


def test_beam_towards_the_source_is_louder(spark):
    d = np.array([1.0, 0, 0])
    w = heard(d, [(3000, 1.0)], n=1024)
    for method in ("delay_sum", "delay_sum_spectrum"):
        at, away = (r.rms for r in arrays.beams(table(spark, [(sensors(w), d * 50), (sensors(w), -d * 50)]), method).orderBy("id").collect())
        assert at > 0.68 and away < 0.5


def test_odd_rows(spark):
    w = heard((1, 0, 0), [(1000, 1.0)], n=128)
    holes = sensors(w)
    holes[1][3][5] = None
    holes[2][3][7] = float("nan")
    odd = [None, [], [None], sensors(w)[:1], [*sensors(w)[:3], (0.0, None, 0.0, [1.0] * 128)], [*sensors(w)[:3], (0.0, 0.0, 0.0, [1.0] * 127)], [(0.0, 0.0, 0.0, [])], sensors(w * 0), holes, sensors(w), sensors(w), sensors(heard((1, 0, 0), [(1000, 1.0)], n=80_000))]
    df = table(spark, [(s, (1, 1, 1)) for s in odd])
    for method in ("subspace", "phase"):
        got = {r.id: r for r in arrays.bearings(df, method, azimuth_step=10, elevation_step=10).collect()}
        assert [got[k].reason for k in range(len(odd))] == ["no windows"] * 3 + ["too few sensors", "no place", "uneven windows", "no windows", "no energy in band"] + [None] * 4
        assert got[9][1:] == got[10][1:] and got[11].dx > 0.9
        assert arrays.bearings(df, method, 9000, 9500).first().reason in ("no windows", "no bins in band")
        assert arrays.bearings(df.where("id < 0"), method).count() == 0
    for method in arrays.BEAMS:
        got = {r.id: r for r in arrays.beams(df, method).collect()}
        assert [got[k].reason for k in range(len(odd))] == ["no windows"] * 3 + [None, "no place", "uneven windows", "no windows"] + [None] * 5
        assert np.allclose(got[3].samples, w[0]) and len(got[11].samples) == 80_000
        assert arrays.beams(df.where("id < 0"), method).count() == 0
    late = df.where("id = 9").withColumns({"sx": df.sx * float("nan")}).unionByName(df.where("id = 9").selectExpr("id", "0 rate", "speed", "sensors", "sx", "sy", "sz", "text"))
    assert {r.reason for r in arrays.beams(late).collect()} == {"no rate, speed or point"}
