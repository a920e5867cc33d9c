"""Tracks: constant-velocity Kalman filter over sorted streams, density modes of positions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Kalman:
    """Position and speed in the plane, with a constant-velocity model; ``step`` gives (x, y, vx, vy). Joseph form."""

    def __init__(self, z: np.ndarray, noise_m: float, accel: float):
        self.state, self.cov = np.array([*z, 0.0, 0.0]), np.diag([noise_m**2, noise_m**2, 25.0, 25.0])
        self.r, self.accel = np.eye(2) * noise_m**2, accel

    def step(self, dt: float, z: np.ndarray) -> np.ndarray:
        f, h = np.eye(4), np.eye(2, 4)
        f[0, 2] = f[1, 3] = dt = max(dt, 0.0)
        g = np.array([dt * dt / 2, dt * dt / 2, dt, dt])
        state, cov = f @ self.state, f @ self.cov @ f.T + np.diag(g * g) * self.accel**2
        gain = cov @ h.T @ np.linalg.inv(h @ cov @ h.T + self.r)
        left = np.eye(4) - gain @ h
        self.state, self.cov = state + gain @ (z - h @ state), left @ cov @ left.T + gain @ self.r @ gain.T
        return self.state


def kalman_smooth(rows: DataFrame, noise_m: float = 20.0, accel: float = 0.01) -> DataFrame:
    """``rows``: track_id, id, timestamp_ns, x, y. A track's updates are in order of time, then id. Partitions are sorted
    and read as streams with one filter's state, so a track of any length takes a batch's memory."""

    def run(batches):
        key = at = own = None
        for b in batches:
            track, ids, ns, x, y = (c.to_pylist() for c in b.columns)
            out = np.zeros((len(ids), 4))
            for k in range(len(ids)):
                z = np.array([x[k], y[k]])
                if own is None or track[k] != key:
                    key, own = track[k], Kalman(z, noise_m, accel)
                    out[k] = own.state
                else:
                    out[k] = own.step((ns[k] - at) / 1e9, z)
                at = ns[k]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *[pa.array(out[:, i]) for i in range(4)]], names=["track_id", "id", "x", "y", "vx", "vy"])

    some = rows.select(F.col("track_id").cast("long").alias("track_id"), F.col("id").cast("long").alias("id"), F.col("timestamp_ns").cast("long").alias("timestamp_ns"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    streams = some.where("x is not null and y is not null and timestamp_ns is not null").repartition("track_id").sortWithinPartitions("track_id", "timestamp_ns", "id")
    return streams.mapInArrow(run, "track_id long, id long, x double, y double, vx double, vy double")


def kde_mode(rows: DataFrame, bandwidth_m: float) -> DataFrame:
    """``rows``: node_id, x, y. The densest place of each node's positions (weighted mean around the densest cell), the
    radius about it that holds 68 % of the positions within three bandwidths of the densest cell, and the node's number
    of positions. Positions are first counted by cells of half the bandwidth, so that a node costs pairs of neighbouring
    cells, not pairs of positions. Distances count by millimetre, so that a node's percentile is over a bounded number
    of values."""
    cell = bandwidth_m / 2
    cells = rows.groupBy("node_id", F.floor(F.col("x") / cell).alias("i"), F.floor(F.col("y") / cell).alias("j")).agg(F.count("*").alias("n"), F.avg("x").alias("x"), F.avg("y").alias("y"))
    steps = F.array(*[F.lit(k) for k in range(-6, 7)])
    near = cells.select("node_id", F.col("x").alias("x0"), F.col("y").alias("y0"), F.col("i").alias("i0"), F.col("j").alias("j0"), F.explode(F.transform(steps, lambda d: F.col("i") + d)).alias("i"))
    near = near.withColumn("j", F.explode(F.transform(steps, lambda d: F.col("j0") + d)))
    met = near.join(cells, ["node_id", "i", "j"])
    w = F.col("n") * F.exp(-((F.col("x") - F.col("x0")) ** 2 + (F.col("y") - F.col("y0")) ** 2) / (2 * bandwidth_m**2))
    dense = met.groupBy("node_id", "i0", "j0", "x0", "y0").agg(F.sum(w).alias("density"), (F.sum(w * F.col("x")) / F.sum(w)).alias("x"), (F.sum(w * F.col("y")) / F.sum(w)).alias("y"))
    best = dense.groupBy("node_id").agg(F.max(F.struct(F.round("density", 9).alias("d"), "i0", "j0", "x", "y", "x0", "y0")).alias("m"))
    places = rows.join(best, "node_id")
    local = F.hypot(F.col("x") - F.col("m.x0"), F.col("y") - F.col("m.y0")) <= 3 * bandwidth_m
    away = F.round(F.hypot(F.col("x") - F.col("m.x"), F.col("y") - F.col("m.y")), 3)
    spread = places.groupBy("node_id").agg(F.percentile(F.when(local, away), F.lit(0.68)).alias("radius_m"), F.count("*").alias("n"))
    return best.join(spread, "node_id").select("node_id", F.col("m.x").alias("x"), F.col("m.y").alias("y"), F.col("m.d").alias("density"), "radius_m", "n")
