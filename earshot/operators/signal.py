"""Sample vectors: level, spectral features, delays between two channels. Arrow batches, vectorised over rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def rms(samples) -> F.Column:
    squares = F.aggregate(F.transform(samples, lambda x: x.cast("double") * x.cast("double")), F.lit(0.0), lambda a, b: a + b)
    return F.sqrt(squares / F.size(samples) + 1e-12)


def _vectors(column) -> list[np.ndarray]:
    return [np.zeros(0) if x is None else np.asarray([0.0 if y is None else y for y in x], float) for x in column.to_pylist()]


def features_of(x: np.ndarray, rate: int) -> tuple[float, float, float, float, float, float]:
    """rms, zero-crossing rate, crest factor, spectral centroid, flatness and bandwidth (Hann window)."""
    if not len(x):
        return (0.0,) * 6
    level = float(np.sqrt(np.mean(x * x) + 1e-12))
    crossings = float(np.mean(np.abs(np.diff(np.signbit(x).astype(int))))) if len(x) > 1 else 0.0
    power = np.abs(np.fft.rfft(x * np.hanning(len(x)))) ** 2 + 1e-12
    hz = np.fft.rfftfreq(len(x), 1 / rate)
    centroid = float((hz * power).sum() / power.sum())
    flatness = float(np.exp(np.log(power).mean()) / power.mean())
    width = float(np.sqrt((((hz - centroid) ** 2) * power).sum() / power.sum()))
    return level, crossings, float(np.abs(x).max() / level), centroid, flatness, width


def spectral_features(rows: DataFrame, sample_rate_hz: int) -> DataFrame:
    """``rows``: id, samples. Null or empty samples give zeros."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.array([features_of(x, sample_rate_hz) for x in _vectors(b.column(1))]).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[:, k]) for k in range(6)]], names=["id", "rms", "zcr", "crest", "centroid_hz", "flatness", "bandwidth_hz"])

    return rows.select(F.col("id").cast("long").alias("id"), "samples").mapInArrow(run, "id long, rms double, zcr double, crest double, centroid_hz double, flatness double, bandwidth_hz double")


def delay_of(a: np.ndarray, b: np.ndarray, rate: int, max_tau_s: float, interp: int = 4) -> tuple[float, float]:
    """Whitened cross-correlation: by how many seconds ``b`` is ahead of ``a``, and the peak's share of a perfect one."""
    if not len(a) or not len(b):
        return 0.0, 0.0
    n = len(a) + len(b)
    cross = np.fft.rfft(a, n) * np.conj(np.fft.rfft(b, n))
    r = np.fft.irfft(cross / np.maximum(np.abs(cross), 1e-12), n * interp)
    most = max(1, min(int(interp * rate * max_tau_s), interp * n // 2 - 1))
    r = np.concatenate([r[-most:], r[: most + 1]])
    k = int(np.argmax(np.abs(r)))
    shift = 0.0
    if 0 < k < len(r) - 1:
        p, q, s = (abs(r[k + d]) for d in (-1, 0, 1))
        bend = p - 2 * q + s
        shift = 0.5 * (p - s) / bend if abs(bend) > 1e-12 else 0.0
    return (k - most + shift) / (interp * rate), float(abs(r[k]) * interp)


def gcc_phat(rows: DataFrame, sample_rate_hz: int, max_tau_s: float) -> DataFrame:
    """``rows``: id, a, b (two channels)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [delay_of(x, y, sample_rate_hz, max_tau_s) for x, y in zip(_vectors(b.column(1)), _vectors(b.column(2)), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([t for t, _ in found], pa.float64()), pa.array([p for _, p in found], pa.float64())], names=["id", "tau_s", "peak"])

    return rows.select(F.col("id").cast("long").alias("id"), "a", "b").mapInArrow(run, "id long, tau_s double, peak double")
