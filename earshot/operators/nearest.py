"""The nearest detection of each true event within a span of time, without a row for each pair in reach.

Time is cut into blocks several spans wide. A true event stands in its own block, a detection in each block that it may be
in reach of, and a block is one group of Arrow columns: it is as large as its time is busy, and holds rows, never pairs.
What is shuffled and kept grows with the rows.

``nearest`` finds the nearest detection by cells: they begin as wide as a few detections stand apart and double for the
events that found none within a cell's width, so most events see few others, however many are in reach of their time.

``greedy`` lets each true event take its detection in turn. A block depends on the one before it only by what that took near
their border, so all blocks run at first as if nothing had been taken, and then those run again whose border has changed,
until none has: what the blocks then agree on is the one order-dependent result. Events far from a border seldom depend on
it; at worst a change walks from block to block, and there are as many rounds as blocks.

Edge cases: rows without time meet nothing; a place that is null or no number is farther than all others for ``nearest`` and out
of reach for ``greedy``; rows that repeat a time and an id are one event to ``greedy``; empty tables give no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .stages import stage

#: Spans in a block, pairs that are compared at once, detections hoped for in a cell.
SPANS, PAIRS_AT_ONCE, IN_A_CELL = 8, 1 << 20, 2.0


def _blocks(truth: DataFrame, found: DataFrame, span_ns: int) -> DataFrame:
    """(block, kind, ns, id, label, x, y): kind 0 are true events, kind 1 detections. Both sides: id, label, timestamp_ns, x, y."""
    width = F.lit(SPANS * span_ns)
    ns = F.col("timestamp_ns")
    columns = [ns.cast("long").alias("ns"), F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")]
    block = lambda at: F.call_function("div", at - F.pmod(at, width), width)
    own = truth.where(ns.isNotNull()).select(block(ns).alias("block"), F.lit(0).alias("kind"), *columns)
    seen = found.where(ns.isNotNull()).select(F.explode(F.sequence(block(ns - F.lit(span_ns)), block(ns + F.lit(span_ns)))).alias("block"), F.lit(1).alias("kind"), *columns)
    return own.unionByName(seen)


def _column(t: pa.Table, name: str) -> np.ndarray:
    return t.column(name).to_numpy()


def _sorted(t: pa.Table, kind: int) -> pa.Table:
    part = t.filter(pc.equal(t.column("kind"), kind))
    return part.take(pa.array(np.lexsort((_column(part, "id"), _column(part, "ns"))))).combine_chunks()


def _least(first: np.ndarray, count: np.ndarray, order: np.ndarray, of: np.ndarray, t: tuple, d: tuple) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(event, distance, detection) of least distance, then id, over ranges ``order[first : first + count]`` of events ``of``
    (ascending); ranges of one event are compared together, about ``PAIRS_AT_ONCE`` pairs at once."""
    some = count > 0
    first, count, of = first[some], count[some], of[some]
    out = []
    starts = np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, int)
    total = np.cumsum(count)
    at = 0
    while at < len(starts):
        before = total[starts[at] - 1] if starts[at] else 0
        end = np.searchsorted(total[np.r_[starts[at + 1 :], len(of)] - 1], before + PAIRS_AT_ONCE, "right") + at
        end = max(end, at + 1)
        a, b = starts[at], starts[end] if end < len(starts) else len(of)
        n = count[a:b]
        flat = np.arange(n.sum()) + np.repeat(first[a:b] - (np.cumsum(n) - n), n)
        i, j = np.repeat(of[a:b], n), order[flat]
        gx, gy = d[0][j] - t[0][i], d[1][j] - t[1][i]
        far = np.sqrt(gx * gx + gy * gy)
        far[d[2][j] == t[2][i]] = np.inf
        cuts = np.flatnonzero(np.r_[True, i[1:] != i[:-1]])
        size = np.diff(np.r_[cuts, len(i)])
        best = np.minimum.reduceat(far, cuts)
        ids = np.where((far == np.repeat(best, size)) & np.isfinite(far), d[2][j], np.iinfo(np.int64).max)
        least = np.minimum.reduceat(ids, cuts)
        hit = np.flatnonzero((ids == np.repeat(least, size)) & np.isfinite(far))
        _, once = np.unique(i[hit], return_index=True)
        hit = hit[once]
        out.append((i[hit], far[hit], j[hit]))
        at = end
    empty = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (empty, np.zeros(0), empty)


def nearest_of(tns, tx, ty, tid, dns, dx, dy, did, span_ns: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each event the place of its nearest detection within the span (-1: none) and the distance; of equally near ones the
    least id, never one with the event's own id. ``dns`` ascends. Where no place is known the distance is infinite."""
    pick, metres = np.full(len(tns), -1), np.full(len(tns), np.inf)
    t, d = (tx, ty, tid), (dx, dy, did)
    low, high = np.searchsorted(dns, tns - span_ns, "left"), np.searchsorted(dns, tns + span_ns, "right")
    placed = np.flatnonzero(np.isfinite(dx) & np.isfinite(dy))
    open_ = np.flatnonzero((high > low) & np.isfinite(tx) & np.isfinite(ty))
    if len(placed) and len(open_):
        x0, y0 = min(dx[placed].min(), tx[open_].min()), min(dy[placed].min(), ty[open_].min())
        extent = max(dx[placed].max() - x0, dy[placed].max() - y0, tx[open_].max() - x0, ty[open_].max() - y0)
        t0 = min(dns[0], tns.min()) - span_ns
        long = int(max(dns[-1], tns.max()) + span_ns - t0 + 1)
        # cells of the first level, by the detections in a window; their number times the length of time fits 62 bits
        across = int(np.clip(np.sqrt(np.median((high - low)[open_]) / IN_A_CELL), 1, min(1024, max(1.0, np.sqrt(2.0**61 / long) - 4))))
        while len(open_):
            side = extent / across if extent > 0 else 1.0
            wide = across + 3  # a row of cells has one more on each side, so that neighbours of the edge are cells, too
            cell = lambda x, y, side=side, wide=wide: (np.floor((x - x0) / side).astype(np.int64) + 1) * wide + np.floor((y - y0) / side).astype(np.int64) + 1
            key = cell(dx[placed], dy[placed]) * long + (dns[placed] - t0)
            by = np.argsort(key, kind="stable")
            key, order = key[by], placed[by]
            own = cell(tx[open_], ty[open_])
            shifts = np.array([a * wide + b for a in (-1, 0, 1) for b in (-1, 0, 1)])
            around = (own[:, None] + shifts).ravel() * long
            of = np.repeat(open_, 9)
            first = np.searchsorted(key, around + (tns[of] - span_ns - t0).clip(0), "left")
            count = np.searchsorted(key, around + (tns[of] + span_ns - t0).clip(0, long - 1), "right") - first
            i, far, j = _least(first, count, order, of, t, d)
            # nothing outside the nine cells is as near as a cell is wide
            done = (far < side * (1 - 1e-9)) | (across == 1)
            pick[i[done]], metres[i[done]] = j[done], far[done]
            if across == 1:
                break
            open_ = np.setdiff1d(open_, i[done], assume_unique=True)
            across = max(1, across // 2)
    rest = np.flatnonzero((pick < 0) & (high > low))
    for i in rest[(~np.isfinite(tx[rest])) | (~np.isfinite(ty[rest])) | (len(placed) < len(dns))]:
        j = np.arange(low[i], high[i])
        j = j[did[j] != tid[i]]
        if len(j):
            pick[i] = j[did[j].argmin()]
    return pick, metres


def nearest(truth: DataFrame, found: DataFrame, span_ns: int) -> DataFrame:
    """(truth_label, near_label, near_id, m), a row for each true event with a time: its nearest detection but itself within
    the span, the least id of equally near ones; null without one, ``m`` also where no place is known."""

    def run(t: pa.Table) -> pa.Table:
        events, d = _sorted(t, 0), _sorted(t, 1)
        pick, m = nearest_of(*(_column(events, c) for c in ("ns", "x", "y", "id")), *(_column(d, c) for c in ("ns", "x", "y", "id")), span_ns)
        at = pa.array(pick, pa.int64(), mask=pick < 0)
        return pa.table({"truth_label": events.column("label"), "near_label": d.column("label").take(at), "near_id": d.column("id").take(at), "m": pa.array(m, pa.float64(), mask=~np.isfinite(m))})

    return _blocks(truth, found, span_ns).groupBy("block").applyInArrow(run, "truth_label string, near_label string, near_id long, m double")


def take_in_turn(tns, tid, tx, ty, dns, did, dx, dy, gone: np.ndarray, span_ns: int, most_m: float) -> tuple[np.ndarray, np.ndarray]:
    """(events, detections): in order of (time, id) each event takes the nearest detection in reach that none before it took.
    Both sides ascend by (time, id), and so the first of equally near detections is taken; ``gone``: taken before."""
    x = np.where(gone | ~np.isfinite(dx) | ~np.isfinite(dy), np.inf, dx)
    y = np.where(np.isfinite(dy), dy, 0.0)
    low, high = np.searchsorted(dns, tns - span_ns, "left").tolist(), np.searchsorted(dns, tns + span_ns, "right").tolist()
    again = np.zeros(len(dns) + 1, bool)  # repeats the detection before it
    again[1:-1] = (dns[1:] == dns[:-1]) & (did[1:] == did[:-1])
    reach, events, taken, last = most_m * most_m, [], [], None
    for i, (key, px, py, a, b) in enumerate(zip(zip(tns.tolist(), tid.tolist(), strict=True), tx.tolist(), ty.tolist(), low, high, strict=True)):
        if a == b or key == last:
            continue
        gx, gy = x[a:b] - px, y[a:b] - py
        far = gx * gx + gy * gy
        k = int(far.argmin())
        if not far[k] <= reach:  # no number, neither
            continue
        k, last = a + k, key
        events.append(i)
        taken.append(k)
        x[k] = np.inf
        j = k
        while again[j]:
            j -= 1
            x[j] = np.inf
        j = k + 1
        while again[j]:
            x[j] = np.inf
            j += 1
    return np.array(events, np.int64), np.array(taken, np.int64)


def greedy(truth: DataFrame, found: DataFrame, span_ns: int, most_m: float) -> DataFrame:
    """(matched, confused), a row for each block with matches: events that took a detection, and those of another (or no) label."""
    rows = stage(_blocks(truth, found, span_ns), "blocks")
    width = SPANS * span_ns

    def run(t: pa.Table) -> pa.Table:
        block = t.column("block")[0].as_py()
        events, d, gone = _sorted(t, 0), _sorted(t, 1), _sorted(t, 2)
        left = set(zip(_column(gone, "ns").tolist(), _column(gone, "id").tolist(), strict=True))
        ns, ids = _column(d, "ns"), _column(d, "id")
        before = np.array([k in left for k in zip(ns.tolist(), ids.tolist(), strict=True)], bool) if left else np.zeros(len(ns), bool)
        i, j = take_in_turn(*(_column(events, c) for c in ("ns", "id", "x", "y")), ns, ids, *(_column(d, c) for c in ("x", "y")), before, span_ns, most_m)
        same = pc.equal(events.column("label").take(pa.array(i)), d.column("label").take(pa.array(j)))
        confused = len(i) - (pc.sum(same).as_py() or 0)
        border = j[ns[j] >= (block + 1) * width - span_ns]  # what the next block may want
        n = len(border) + 1
        return pa.table({"block": pa.array([block] * n, pa.int64()), "ns": pa.array([None, *ns[border].tolist()], pa.int64()), "id": pa.array([None, *ids[border].tolist()], pa.int64()), "matched": pa.array([len(i)] + [None] * (n - 1), pa.int64()), "confused": pa.array([confused] + [None] * (n - 1), pa.int64())})

    schema = "block long, ns long, id long, matched long, confused long"

    def borders(taken: DataFrame) -> DataFrame:
        return taken.where("ns is not null").select((F.col("block") + 1).alias("block"), "ns", "id")

    def marks(gone: DataFrame) -> DataFrame:
        return gone.groupBy("block").agg(F.count("*").alias("n"), F.sum(F.xxhash64("ns", "id").cast("decimal(38,0)")).alias("h"), F.bit_xor(F.xxhash64("id", "ns")).alias("g"))

    busy = rows.where("kind = 0").select("block").distinct()  # a block without events takes nothing
    taken = stage(rows.join(busy, "block", "left_semi").groupBy("block").applyInArrow(run, schema), "taken")
    used, gone = None, borders(taken)
    while True:
        now = stage(marks(gone), "borders")
        changed = now if used is None else now.join(used.withColumnsRenamed({"n": "n2", "h": "h2", "g": "g2"}), "block", "full").where("not (n <=> n2 and h <=> h2 and g <=> g2)")
        changed = stage(changed.select("block"), "changed")
        if changed.isEmpty():
            break
        nothing = F.lit(None)
        blocked = gone.select("block", F.lit(2).alias("kind"), "ns", "id", nothing.cast("string").alias("label"), nothing.cast("double").alias("x"), nothing.cast("double").alias("y"))
        again = rows.unionByName(blocked).join(changed.join(busy, "block", "left_semi"), "block", "left_semi").groupBy("block").applyInArrow(run, schema)
        taken = stage(taken.join(changed, "block", "left_anti").unionByName(again), "taken")
        used, gone = now, borders(taken)
    return taken.where("matched is not null").select("matched", "confused")
