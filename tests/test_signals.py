"""Array and position operators against brute force over all rows."""

import os
from collections import defaultdict

import numpy as np

from earshot import catalog

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_node_positions_take_all_detections(spark):
    events = spark.read.parquet(f"{SF}/events.parquet").selectExpr("event_id", "user_id % 16").collect()
    places = defaultdict(list)
    for i, node in events:
        places[node].append((((-9325800 + i * 104729 % 400) / 100000.0 + 93.2565) * 78700.0, ((4498000 + i * 7919 % 400) / 100000.0 - 44.98) * 111320.0))
    got = {r.node_id: r for r in catalog.QUERIES["node_positions_kde"](spark, SF).collect()}
    assert {k: r.n for k, r in got.items()} == {k: len(v) for k, v in places.items()}
    for k, r in got.items():
        xy = np.array(places[k])
        weights = np.exp(-((xy[:, None] - xy[None]) ** 2).sum(2) / (2 * 25.0**2))
        assert 0.75 * weights.sum(1).max() <= r.density <= 1.1 * weights.sum(1).max()
        cell = np.floor(xy / 12.5)
        means = np.array([xy[(cell == c).all(1)].mean(0) for c in np.unique(cell, axis=0)])
        # the mean of one of the cells is the centre of the local positions
        radii = [np.quantile(np.hypot(*(xy[np.hypot(*(xy - c).T) <= 75] - (r.x, r.y)).T), 0.68) for c in means if np.hypot(*(c - (r.x, r.y))) < 25]
        assert min(abs(x - r.radius_m) for x in radii) < 0.001


def test_pair_delays_take_all_vectors(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id").collect()}
    assert {r.id for r in catalog.QUERIES["pair_delays"](spark, SF).collect()} == ids
