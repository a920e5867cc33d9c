"""Bearings and beams of small microphone arrays.

A row is one event at one array: its sensors (place in metres, window of samples), the rate and, for beams, the point that is
listened to. Rows are independent, so nothing is shuffled; a batch's rows with equally many sensors and samples are worked on
together as numpy arrays, in blocks whose size doesn't depend on the batch.

* ``bearings(method="subspace")``: covariance of normalised snapshots at the strongest frequency of a band, number of sources
  by the minimum description length, direction where the noise subspace answers least, over a grid of angles.
* ``bearings(method="phase")``: least squares over the sensors' phases against the first one's.
* ``beams``: ``delay_sum`` in time, ``delay_sum_spectrum`` by phases, ``least_variance`` (weights from the window's own loaded
  covariance; as that is one product plus a diagonal, its inverse is written down, not solved) and ``diffuse`` (weights
  against noise from everywhere).

Edge cases: null or empty sensors, a sensor without place or window, and windows of unequal length give null results and a
``reason``; null and non-finite samples are 0; a single sensor gives no bearing and itself as beam; of equal scores the first
angle counts (by elevation, then azimuth); repeated rows are worked on each for itself; other columns are not read; an empty
table gives no row. Speeds below 1 m/s count as 1 in beams.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

_TINY = 1e-12
#: Numbers in one block of work.
_BLOCK = 1 << 20

SENSORS = "array<struct<x:double,y:double,z:double,samples:array<double>>>"


class Unfit(ValueError):
    """Why a row has no result."""


def _row(sensors: list | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (n, 3) and windows (n, samples) of a row's sensors."""
    if not sensors or any(s is None or s["samples"] is None or len(s["samples"]) == 0 for s in sensors):
        raise Unfit("no windows")
    if any(s[c] is None for s in sensors for c in "xyz"):
        raise Unfit("no place")
    if len({len(s["samples"]) for s in sensors}) > 1:
        raise Unfit("uneven windows")
    windows = np.array([s["samples"] for s in sensors], dtype=float)  # None becomes nan
    return np.array([[s[c] for c in "xyz"] for s in sensors], float), np.where(np.isfinite(windows), windows, 0.0)


def _blocks(sensors: list, most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray] | tuple[int, str]]:
    """Blocks of rows of one shape, as (numbers, places, windows); a row that doesn't fit as (number, reason). ``most``: numbers
    that a sensor's work takes beside its window."""
    shapes: dict[tuple, list] = {}
    for k, s in enumerate(sensors):
        try:
            places, windows = _row(s)
        except Unfit as e:
            yield k, str(e)
            continue
        block = shapes.setdefault(windows.shape, [])
        block.append((k, places, windows))
        if len(block) * max(windows.size, most * len(windows)) >= _BLOCK:
            yield tuple(map(np.array, zip(*shapes.pop(windows.shape), strict=True)))
    for block in shapes.values():
        yield tuple(map(np.array, zip(*block, strict=True)))


# ---- bearings -------------------------------------------------------------------------------------------------------


def strongest(windows: np.ndarray, rate: np.ndarray, low_hz: float, high_hz: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the first sensors (rows, samples): the strongest frequency within the band, and its magnitude (-1: no bin there)."""
    n = windows.shape[1]
    tapered = (windows - windows.mean(1, keepdims=True)) * np.hanning(n)
    size = np.abs(np.fft.rfft(tapered, axis=1))
    hz = np.arange(size.shape[1]) * rate[:, None] / n
    size = np.where((hz >= low_hz) & (hz <= high_hz), size, -1.0)
    at = size.argmax(1)
    rows = np.arange(len(windows))
    return hz[rows, at], size[rows, at]


def alias_quality(places: np.ndarray, speed: np.ndarray, hz: np.ndarray) -> np.ndarray:
    """How far a frequency is from being ambiguous for an array this wide."""
    wide = 2 * np.linalg.norm(places - places.mean(1, keepdims=True), axis=2).max(1)
    cutoff = speed / np.maximum(2 * wide, _TINY)
    return np.clip(cutoff / np.maximum(hz, cutoff), 0.02, 1.0)


def source_counts(values: np.ndarray, snapshots: int) -> np.ndarray:
    """Sources by minimum description length from eigenvalues (rows, n), largest first."""
    n = values.shape[1]
    if n <= 2 or snapshots <= n:
        return np.ones(len(values), int)
    values = np.maximum(values, _TINY)
    score = []
    for k in range(n):
        noise = values[:, k:]
        ratio = np.exp(np.log(noise).mean(1)) / noise.mean(1)
        score.append(-snapshots * (n - k) * np.log(np.maximum(ratio, _TINY)) + 0.5 * k * (2 * n - k) * np.log(snapshots))
    return np.clip(np.argmin(score, axis=0), 1, n - 1)


def angle_grid(azimuth_step: float, elevation_step: float) -> np.ndarray:
    """Unit vectors (angles, 3), by elevation from -65 to 65 degrees, then by azimuth. Steps below a degree count as one."""
    up, round_ = max(elevation_step, 1.0), max(azimuth_step, 1.0)
    e, a = np.meshgrid(np.radians(np.arange(-65.0, 65.0 + up / 2, up)), np.radians(np.arange(-180.0, 180.0, round_)), indexing="ij")
    return np.stack([np.cos(e) * np.cos(a), np.cos(e) * np.sin(a), np.sin(e)], axis=-1).reshape(-1, 3)


def _subspace(places, windows, speed, rate, hz, grid, sources):
    n, length = windows.shape[1:]
    frame = min(1024, length)
    framed = np.lib.stride_tricks.sliding_window_view(windows, frame, axis=2)[:, :, :: max(frame // 2, 1)]
    bins = np.rint(hz * frame / rate)
    wave = np.hanning(frame) * np.exp(-2j * np.pi * bins[:, None] * np.arange(frame) / frame)
    shots = np.einsum("rnsf,rf->rsn", framed, wave, optimize=True)
    norm = np.linalg.norm(shots, axis=2, keepdims=True)
    shots = np.where(norm > _TINY, shots / np.maximum(norm, _TINY), 0)
    values, vectors = np.linalg.eigh(np.einsum("rsi,rsj->rij", shots, shots.conj()) / shots.shape[1])
    values, vectors = values[:, ::-1], vectors[:, :, ::-1]
    count = source_counts(values, shots.shape[1]) if sources is None else np.full(len(values), min(max(sources, 1), n - 1))
    delay = np.einsum("rnc,gc->rgn", places - places.mean(1, keepdims=True), grid) / speed[:, None, None]
    steer = np.exp(2j * np.pi * hz[:, None, None] * delay)
    answer = np.abs(np.einsum("rgn,rnk->rgk", steer, vectors.conj(), optimize=True)) ** 2
    noise = np.arange(n) >= count[:, None]
    score = 1 / np.maximum((answer * noise[:, None]).sum(2), _TINY)
    best = score.argmax(1)
    top = score[np.arange(len(score)), best]
    contrast = np.clip((top - np.median(score, axis=1)) / np.maximum(top, _TINY), 0, 1)
    return grid[best], contrast, count


def _phase(places, windows, speed, rate, hz):
    n, length = windows.shape[1:]
    bins = np.rint(hz * length / rate)
    wave = np.hanning(length) * np.exp(-2j * np.pi * bins[:, None] * np.arange(length) / length)
    at = np.einsum("rnt,rt->rn", windows - windows.mean(2, keepdims=True), wave)
    lag = np.angle(at[:, 1:] * at[:, :1].conj()) / (2 * np.pi * np.maximum(hz, _TINY)[:, None]) * speed[:, None]
    base = places[:, 1:] - places[:, :1]
    raw = (np.linalg.pinv(base, rcond=np.finfo(float).eps * max(n - 1, 3)) @ lag[:, :, None])[:, :, 0]
    norm = np.linalg.norm(raw, axis=1, keepdims=True)
    direction = np.where(norm < _TINY, np.nan, raw / np.maximum(norm, _TINY))
    miss = np.linalg.norm((base @ direction[:, :, None])[:, :, 0] - lag, axis=1) / np.maximum(np.linalg.norm(lag, axis=1), _TINY)
    return direction, np.maximum(0, 1 - miss), np.ones(len(places), int)


def bearings(rows: DataFrame, method: str = "subspace", low_hz: float = 200.0, high_hz: float = 5000.0, azimuth_step: float = 5.0, elevation_step: float = 5.0, sources: int | None = None) -> DataFrame:
    """One row for each of ``rows`` (id, rate, speed, sensors): where the sound comes from."""
    if method not in ("subspace", "phase"):
        raise ValueError(f"no method {method}")
    grid = angle_grid(azimuth_step, elevation_step)

    def solve(ids, rate, speed, sensors):
        out: list = [None] * len(ids)
        for block in _blocks(sensors, len(grid) if method == "subspace" else 1):
            if len(block) == 2:
                out[block[0]] = (None,) * 8 + (block[1],)
                continue
            numbers, places, windows = block
            r, c = rate[numbers], speed[numbers]
            hz, size = strongest(windows[:, 0], r, low_hz, high_hz)
            reason = np.where(windows.shape[1] < 2, "too few sensors", np.where(~(r > 0) | ~(c > 0), "no rate or speed", np.where(size < 0, "no bins in band", np.where(size <= _TINY, "no energy in band", ""))))
            for k, why in zip(numbers[reason != ""], reason[reason != ""], strict=True):
                out[k] = (None,) * 8 + (str(why),)
            fit = reason == ""
            if not fit.any():
                continue
            numbers, places, windows, r, c, hz = (x[fit] for x in (numbers, places, windows, r, c, hz))
            found = _subspace(places, windows, c, r, hz, grid, sources) if method == "subspace" else _phase(places, windows, c, r, hz)
            direction, quality, count = found
            quality = quality * alias_quality(places, c, hz)
            for i, k in enumerate(numbers):
                if np.isnan(direction[i]).any():
                    out[k] = (None,) * 8 + ("no direction",)
                    continue
                x, y, z = direction[i].tolist()
                out[k] = (float(hz[i]), int(count[i]), x, y, z, float(np.degrees(np.arctan2(y, x))), float(quality[i]), float(np.clip(quality[i], 0.01, 1)), None)
        return out

    return _apply(rows, solve, "frequency_hz double, sources int, dx double, dy double, dz double, azimuth_deg double, quality double, strength double, reason string", ())


# ---- beams ----------------------------------------------------------------------------------------------------------


def _in_time(windows, delays, rate):
    length = windows.shape[2]
    at = np.arange(length) + (delays * rate[:, None])[:, :, None]
    low = np.minimum(np.floor(at).astype(int), length - 1)
    part = at - low
    a = np.take_along_axis(windows, low, 2)
    b = np.take_along_axis(windows, np.minimum(low + 1, length - 1), 2)
    return np.where(at <= length - 1, a + part * (b - a), 0).mean(1)


def _weighed(weight: Callable) -> Callable:
    """A beam by weights within a band; beyond it the sensors' mean."""

    def beam(windows, delays, rate, places, speed, low_hz, high_hz, loading):
        n, length = windows.shape[1:]
        x = np.fft.rfft(windows, axis=2).transpose(0, 2, 1)  # rows, frequencies, sensors
        hz = np.arange(x.shape[1]) * rate[:, None] / length
        steer = np.exp(-2j * np.pi * hz[:, :, None] * delays[:, None])
        w = weight(x, steer, hz, places, speed, max(loading, 1e-9))
        gain = (steer.conj() * w).sum(2, keepdims=True)
        safe = np.abs(gain) >= _TINY
        w = np.where(safe, w / np.where(safe, gain, 1), 1 / n)
        band = (hz > 0) & (hz >= low_hz) & (hz <= high_hz)
        return np.fft.irfft(np.where(band, (w.conj() * x).sum(2), x.mean(2)), n=length, axis=1)

    return beam


def _least_variance(x, steer, hz, places, speed, loading):
    """The inverse of x x* + loading, times ``steer``."""
    share = (x.conj() * steer).sum(2, keepdims=True) / (loading + (np.abs(x) ** 2).sum(2, keepdims=True))
    return (steer - x * share) / loading


def _diffuse(x, steer, hz, places, speed, loading):
    far = np.linalg.norm(places[:, :, None] - places[:, None], axis=3)
    noise = np.sinc(2 * hz[:, :, None, None] * far[:, None] / speed[:, None, None, None])
    return np.linalg.solve(noise + loading * np.eye(far.shape[1]), steer[..., None])[..., 0]


def _by_phase(windows, delays, rate, *_):
    length = windows.shape[2]
    hz = np.arange(length // 2 + 1) * rate[:, None] / length
    turned = np.fft.rfft(windows, axis=2) * np.exp(2j * np.pi * hz[:, None] * delays[:, :, None])
    return np.fft.irfft(turned.mean(1), n=length, axis=1)


BEAMS: dict[str, Callable] = {
    "delay_sum": lambda windows, delays, rate, *_: _in_time(windows, delays, rate),
    "delay_sum_spectrum": _by_phase,
    "least_variance": _weighed(_least_variance),
    "diffuse": _weighed(_diffuse),
}
#: Loading of the diagonal.
LOADING = {"least_variance": 1e-3, "diffuse": 1e-2}


def beams(rows: DataFrame, method: str = "delay_sum_spectrum", low_hz: float = 200.0, high_hz: float = 5000.0, loading: float | None = None) -> DataFrame:
    """One row for each of ``rows`` (id, rate, speed, sensors, sx, sy, sz): the samples heard from the point (sx, sy, sz), and their root mean square."""
    form, load = BEAMS[method], LOADING.get(method, 0.0) if loading is None else loading

    def solve(ids, rate, speed, sensors, *point):
        out: list = [None] * len(ids)
        aim = np.stack(point, axis=1)
        for block in _blocks(sensors, 1):
            if len(block) == 2:
                out[block[0]] = (None, None, block[1])
                continue
            numbers, places, windows = block
            r, c, at = rate[numbers], np.maximum(speed[numbers], 1.0), aim[numbers]
            fit = (r > 0) & np.isfinite(c) & np.isfinite(at).all(1)
            for k in numbers[~fit]:
                out[k] = (None, None, "no rate, speed or point")
            if not fit.any():
                continue
            numbers, places, windows, r, c, at = (x[fit] for x in (numbers, places, windows, r, c, at))
            far = np.linalg.norm(places - at[:, None], axis=2) / c[:, None]
            heard = windows[:, 0] if windows.shape[1] == 1 else form(windows, far - far.min(1, keepdims=True), r, places, c, low_hz, high_hz, load)
            for k, y in zip(numbers, heard, strict=True):
                out[k] = (y.astype(np.float32), float(np.sqrt((y * y).mean())), None)
        return out

    return _apply(rows, solve, "samples array<float>, rms double, reason string", ("sx", "sy", "sz"))


# ---- Spark ----------------------------------------------------------------------------------------------------------


def _apply(rows: DataFrame, solve: Callable, columns: str, numbers: tuple[str, ...]) -> DataFrame:
    """``solve`` over batches of id, rate, speed, sensors and the columns ``numbers``."""
    kinds = {"double": pa.float64(), "int": pa.int32(), "string": pa.string(), "array<float>": pa.list_(pa.float32())}
    named = [x.split(" ", 1) for x in columns.split(", ")]

    def run(batches):
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                b = whole.slice(start, 256)
                of = [np.array(b.column(k).to_pylist(), float) for k in (1, 2, *range(4, 4 + len(numbers)))]
                found = solve(b.column(0), of[0], of[1], b.column(3).to_pylist(), *of[2:])
                data = [pa.array(c, kinds[kind]) for c, (_, kind) in zip(zip(*found, strict=True), named, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *data], names=["id", *(n for n, _ in named)])

    taken = rows.selectExpr("cast(id as long) id", "cast(rate as double) rate", "cast(speed as double) speed", f"cast(sensors as {SENSORS}) sensors", *[f"cast({c} as double) {c}" for c in numbers])
    return taken.mapInArrow(run, f"id long, {columns}")
