"""Tracks from localized detections: an order-dependent fold with creation, association, coasting, drop and revival.

``fold_batch`` sends each stretch of a site's timeline (a pause longer than any memory of a track ends a stretch) to one
partition, sorted by time, and runs through it with the live and dormant tracks as the only state; a partition is a stream
of Arrow batches, so a busy site needs the memory of its tracks, not of its detections. ``fold_stream`` is the same fold in
Structured Streaming: detections wait in the state until the watermark has passed them, so that late ones take their place,
and a site's state is dropped when it has outlived all its tracks.

A step looks at the tracks that it may concern alone: those with a deadline behind them (a heap), and of the live ones those
of a category that it may meet and nearer than any gate reaches. A track whose detections brought no covariance has the same
one on all axes, three numbers; else it has a full matrix.

A track is named by the id of the detection that began it. A detection joins the track of least score among those whose
gate it passes (nearer than ``near_m``, or within the chi-square gate of both covariances), categories that are known and
different never meet, and unlike class scores add to the score. Without one it revives a dormant track nearby of a
compatible class, else it begins a new track.

Edge cases: rows without site, time or position are left out; a null label, category or confidence is "unknown" or 0; of
equal times the smaller id comes first; repeated rows are detections of their own; an empty table gives no row.
"""

from __future__ import annotations

import heapq
import math
import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import previous, running

SECOND = 1_000_000_000


@dataclass(frozen=True)
class Settings:
    """The defaults of gates, lifetimes, filter and quality weights."""

    near_m: float = 8.0
    most_m: float = 32.0
    chi2: float = 9.0
    stale_s: float = 20.0
    stale_s_of: dict = field(default_factory=lambda: {"wildlife": 120.0, "vehicle": 60.0, "human": 60.0, "security": 20.0})
    drop_times: float = 3.0
    reap_times: float = 5.0
    noise: float = 2.0
    noise_of: dict = field(default_factory=lambda: {"wildlife": 0.5, "vehicle": 4.0, "human": 1.0, "security": 2.0})
    measured_m2: float = 1.5
    first_m2: float = 4.0
    first_speed_m2: float = 16.0
    coast_noise_s: float = 10.0
    coast_half_s: float = 10.0
    category_gate: bool = True
    unlike_weight: float = 3.0
    score_share: float = 0.3
    most_scores: int = 8
    dormant: bool = True
    dormant_s: float = 1800.0
    dormant_m: float = 20.0
    least_alike: float = 0.4
    dormant_half_s: float = 300.0
    most_dormant: int = 64
    confirm_at: int = 2
    most_nodes: int = 16
    quality: tuple = (0.3, 0.3, 0.2, 0.2)

    def stale_ns(self, category: str) -> int:
        own = self.stale_s_of.get((category or "unknown").strip().lower(), 0.0)
        return int((own if own > 0 else self.stale_s) * SECOND)

    def noise_for(self, category: str) -> float:
        own = self.noise_of.get((category or "unknown").strip().lower(), 0.0)
        return own if own > 0 else self.noise

    def memory_ns(self) -> int:
        """After a pause longer than this no detection can meet an older one."""
        stale = max([self.stale_s, *self.stale_s_of.values()])
        return int((stale * max(self.drop_times, self.reap_times) + self.dormant_s * self.dormant) * SECOND)


def _known(category: str | None) -> str | None:
    name = (category or "").strip().lower()
    return None if name in ("", "unknown") else name


def _alike(a: dict, b: dict) -> float:
    dot = sum(x * b.get(k, 0.0) for k, x in a.items())
    size = math.sqrt(sum(x * x for x in a.values()) * sum(x * x for x in b.values()))
    return min(1.0, dot / size) if dot > 0 and size > 0 else 0.0


def _sound(cov: np.ndarray, least: float) -> np.ndarray:
    """The symmetric matrix with eigenvalues raised to ``least``."""
    w, v = np.linalg.eigh((cov + cov.T) / 2)
    return (v * np.maximum(w, least)) @ v.T


def _motion(dt: float, s: Settings) -> tuple[float, float]:
    """How many seconds of its speed a track moves, and what it keeps of it: after half of the coasting half-life speeds fade."""
    if s.coast_half_s > 0 and dt > s.coast_half_s / 2:
        keep = 0.5 ** (dt / s.coast_half_s)
        return s.coast_half_s / math.log(2) * (1 - keep), keep
    return dt, 1.0


def _noise(dt: float, s: Settings, noise: float) -> tuple[float, float, float]:
    """Process noise of an axis (place, both, speed); it stops growing."""
    t = min(dt, s.coast_noise_s) if s.coast_noise_s > 0 else dt
    return t**4 / 4 * noise, t**3 / 2 * noise, t**2 * noise


def _ahead(iso: tuple, move: float, keep: float, q: tuple) -> tuple[float, float, float]:
    """An axis's covariance (place, both, speed) after a step."""
    a, b, c = iso
    return a + 2 * move * b + move * move * c + q[0], (b + move * c) * keep + q[1], keep * keep * c + q[2]


def _full(iso: tuple) -> np.ndarray:
    return np.kron(np.array([[iso[0], iso[1]], [iso[1], iso[2]]]), np.eye(3))


class Fold:
    """Live and dormant tracks of one site. ``step`` takes detections in order of time."""

    def __init__(self, settings: Settings):
        self.s, self.live, self.dormant, self.now = settings, {}, {}, None
        self.open, self.due, self.count, self.oldest = {}, [], 0, math.inf  # open: by known category, tracks not dropped
        self.stale, self.noise = {}, {}

    def _stale(self, category: str) -> int:
        if category not in self.stale:
            self.stale[category] = self.s.stale_ns(category)
        return self.stale[category]

    def _noise_for(self, category: str) -> float:
        if category not in self.noise:
            self.noise[category] = self.s.noise_for(category)
        return self.noise[category]

    def _deadline(self, t: dict) -> int:
        """After it the status changes, unless the track is seen again."""
        stale = self._stale(t["category"])
        if t["status"] == "dropped":
            return t["last"] + int(stale * self.s.reap_times)
        drop = int(stale * self.s.drop_times)
        return t["last"] + (drop if t["status"] == "coasting" else min(stale, drop))

    def _watch(self, t: dict, due: int) -> None:
        t["due"] = due
        heapq.heappush(self.due, (due, t["order"], t["track"]))

    def _enter(self, t: dict) -> None:
        t["known"] = _known(t["category"])
        self.open.setdefault(t["known"], {})[t["track"]] = t

    def _leave(self, t: dict) -> None:
        self.open.get(t["known"], {}).pop(t["track"], None)

    def age(self, now: int) -> None:
        late = []
        while self.due and self.due[0][0] < now:
            due, order, name = heapq.heappop(self.due)
            t = self.live.get(name)
            if t is not None and (t["due"], t["order"]) == (due, order):
                t["due"] = None  # the same deadline may have been set twice
                late.append((order, t))
        for _, t in sorted(late, key=lambda x: x[0]):
            gap, stale = now - t["last"], self._stale(t["category"])
            if t["status"] == "dropped":
                if gap > int(stale * self.s.reap_times):
                    del self.live[t["track"]]
                    continue
            elif gap > int(stale * self.s.drop_times):
                t["status"] = "dropped"
                self._leave(t)
                self._park(t)
            elif gap > stale:
                t["status"] = "coasting"
            self._watch(t, self._deadline(t))
        ttl = int(self.s.dormant_s * SECOND)
        if now - self.oldest > ttl:
            self.dormant = {k: d for k, d in self.dormant.items() if now - d["last"] <= ttl}
            self.oldest = min((d["last"] for d in self.dormant.values()), default=math.inf)

    def _park(self, t: dict) -> None:
        if self.s.dormant and t["updates"] >= self.s.confirm_at:
            self.dormant[t["track"]] = dict(t)
            self.oldest = min(self.oldest, t["last"])
            while len(self.dormant) > self.s.most_dormant:
                del self.dormant[min(self.dormant.values(), key=lambda d: d["last"])["track"]]

    def _unlike(self, scores: dict | None, seen: dict | None) -> float:
        return self.s.unlike_weight * (1 - _alike(scores, seen)) if scores and seen else 0.0

    def _associate(self, d: dict, at: tuple, cov: np.ndarray | None) -> dict | None:
        best, least, own, s = None, math.inf, _known(d["category"]), self.s
        names = (own, None) if s.category_gate and own else tuple(self.open)
        near, most = s.near_m, max(s.most_m, s.near_m)
        for t in (t for name in names for t in self.open.get(name, {}).values()):
            dt = max((d["ns"] - t["last"]) / SECOND, 1e-3)
            move, keep = _motion(dt, s)
            m = t["mean"]
            x, y, z = at[0] - (m[0] + move * m[3]), at[1] - (m[1] + move * m[4]), at[2] - (m[2] + move * m[5])
            far = math.sqrt(x * x + y * y + z * z)
            if far < near:
                score = far * far * s.chi2 / near**2
            elif far > most:
                continue
            else:
                reach, score = self._gate(t, np.array([x, y, z]), far, cov, _noise(dt, s, t["noise"]), move, keep)
                if far > min(max(reach, near), most) or score > s.chi2:
                    continue
            score += self._unlike(d["scores"], t["scores"])
            if score < least or (score == least and best is not None and t["order"] < best["order"]):
                best, least = t, score
        return best

    def _gate(self, t: dict, gap: np.ndarray, far: float, cov: np.ndarray | None, q: tuple, move: float, keep: float) -> tuple[float, float]:
        """Three deviations of both covariances on the widest axis, and the squared distance in them."""
        if t["iso"] is not None and cov is None:
            wide = max(_ahead(t["iso"], move, keep, q)[0], 1e-6)
            return 3 * math.sqrt(wide), far * far / wide
        both = _sound(self._prior(t, move, keep, q)[:3, :3], 1e-6) + (_sound(cov, 1e-6) if cov is not None else 0)
        both = _sound(both, 1e-6)
        return 3 * math.sqrt(np.linalg.eigvalsh(both)[-1]), float(gap @ np.linalg.solve(both, gap))

    def _prior(self, t: dict, move: float, keep: float, q: tuple) -> np.ndarray:
        if t["iso"] is not None:
            return _full(_ahead(t["iso"], move, keep, q))
        f = np.eye(6)
        f[:3, 3:], f[3:, 3:] = np.eye(3) * move, np.eye(3) * keep
        return f @ t["cov"] @ f.T + _full(q)

    def _revivable(self, d: dict, at: tuple) -> dict | None:
        best, least, own, reach = None, math.inf, _known(d["category"]), self.s.dormant_m
        for t in self.dormant.values() if self.s.dormant and reach > 0 else ():
            if own and t["known"] and own != t["known"]:
                continue
            m = t["mean"]
            x, y, z = at[0] - m[0], at[1] - m[1], at[2] - m[2]
            far = math.sqrt(x * x + y * y + z * z)
            if far > reach or d["ns"] < t["last"]:
                continue
            same = bool(d["label"]) and d["label"] == t["label"]
            alike = _alike(d["scores"], t["scores"]) if d["scores"] and t["scores"] else float(same)
            if not same and alike < self.s.least_alike:
                continue
            score = far / self.s.dormant_m + (1 - alike) / 2
            if score < least:
                best, least = t, score
        return best

    def _merged(self, old: dict | None, new: dict | None) -> dict | None:
        """Class scores blended, the highest kept (ties by name), at length one."""
        if not new:
            return old
        share, old = self.s.score_share, old or {}
        both = {k: share * new.get(k, 0.0) + (1 - share) * old.get(k, 0.0) for k in {*old, *new}}
        top = sorted(((x, k) for k, x in both.items() if x > 0), key=lambda p: (-p[0], p[1]))[: self.s.most_scores]
        size = math.sqrt(sum(x * x for x, _ in top))
        return {k: x / size for x, k in top} if size > 0 else None

    def _begin(self, t: dict, at: tuple) -> None:
        t["mean"] = [*at, 0.0, 0.0, 0.0]
        t["iso"], t["cov"] = (self.s.first_m2, 0.0, self.s.first_speed_m2), None
        t["noise"] = self._noise_for(t["category"])

    def _measured(self, t: dict, at: tuple, dt: float, cov: np.ndarray | None) -> None:
        """Prediction and update of position and speed, in Joseph's form."""
        (move, keep), q = _motion(dt, self.s), _noise(dt, self.s, t["noise"])
        m = t["mean"]
        mean = [m[0] + move * m[3], m[1] + move * m[4], m[2] + move * m[5], m[3] * keep, m[4] * keep, m[5] * keep]
        if t["iso"] is not None and cov is None:
            a, b, c = _ahead(t["iso"], move, keep, q)
            r = self.s.measured_m2
            g, h = a / (a + r), b / (a + r)
            t["iso"] = ((1 - g) * (1 - g) * a + g * g * r, (1 - g) * (b - h * a) + g * h * r, c - 2 * h * b + h * h * a + h * h * r)
            gaps = [at[k] - mean[k] for k in range(3)]
            t["mean"] = [mean[k] + g * gaps[k] for k in range(3)] + [mean[3 + k] + h * gaps[k] for k in range(3)]
            return
        prior = self._prior(t, move, keep, q)
        r = np.eye(3) * self.s.measured_m2 if cov is None else _sound(cov, max(self.s.measured_m2, 1e-6)) + np.eye(3) * 1e-9
        gain = np.linalg.solve(prior[:3, :3] + r, prior[:3]).T
        left = np.eye(6) - gain @ np.eye(3, 6)
        post = left @ prior @ left.T + gain @ r @ gain.T
        t["mean"] = (np.array(mean) + gain @ (np.array(at) - mean[:3])).tolist()
        t["iso"], t["cov"] = None, (post + post.T) / 2

    def _quality(self, t: dict, since_s: float, sensors: int) -> float:
        joined = max(min(1.0, t["updates"] / 5), min(1.0, max(len(t["nodes"]), 1) - 1))
        parts = (t["confidence"], joined, 1 / (1 + since_s / 30), min(1.0, sensors / 4))
        return min(1.0, max(0.0, sum(w * x for w, x in zip(self.s.quality, parts, strict=True)) / sum(self.s.quality)))

    def step(self, d: dict) -> tuple:
        """``d``: id, ns, at, cov, label, category, confidence, sensors, node, scores, located. Gives the row of the track."""
        now, at, cov = d["ns"], tuple(map(float, d["at"])), d["cov"]
        self.age(now)
        self.now = now
        t, what, since = self._associate(d, at, cov), "updated", 0.0
        if t is None and (old := self._revivable(d, at)) is not None:
            what, t = "revived", self.live.get(old["track"]) or dict(old)
            half = self.s.dormant_half_s
            faded = old["confidence"] * 0.5 ** ((now - old["last"]) / SECOND / half) if half > 0 else 0.0
            t |= {"scores": old["scores"], "nodes": list(old["nodes"]), "updates": old["updates"] + 1, "confidence": max(d["confidence"], faded), "status": "confirmed" if d["located"] else "tentative", "label": d["label"], "category": d["category"]}
            if t["track"] not in self.live:
                t["order"], self.count = self.count, self.count + 1
            self._leave(t)
            self.live[t["track"]] = t
            del self.dormant[t["track"]]
            self._enter(t)
            self._begin(t, at)
        elif t is None:
            what, t = "created", {"track": d["id"], "first": now, "updates": 1, "confidence": d["confidence"], "status": "tentative", "nodes": [], "scores": None, "label": d["label"], "category": d["category"]}
            t["order"], self.count = self.count, self.count + 1
            if (same := self.live.get(d["id"])) is not None:  # a repeated id takes the place of the track before
                self._leave(same)
                t["order"] = same["order"]
            self.live[d["id"]] = t
            self._enter(t)
            self._begin(t, at)
        else:
            since = max((now - t["last"]) / SECOND, 1e-3)
            self._measured(t, at, since, cov)
            t["confidence"] = d["confidence"] if d["label"] != t["label"] else max(t["confidence"], d["confidence"])
            other = d["category"] != t["category"]
            t |= {"label": d["label"], "category": d["category"], "updates": t["updates"] + 1}
            if other:
                t["noise"] = self._noise_for(d["category"])
                self._leave(t)
                self._enter(t)
            if t["status"] == "coasting":
                t["status"] = "confirmed" if d["located"] else "tentative"
            elif d["located"] and (t["status"] != "tentative" or t["updates"] >= self.s.confirm_at):
                t["status"] = "confirmed"
        t["last"] = now
        due = self._deadline(t)
        if what != "updated" or due < t["due"]:
            self._watch(t, due)
        if d["node"] is not None and d["node"] not in t["nodes"]:
            t["nodes"] = [*t["nodes"], d["node"]][-self.s.most_nodes :]
        t["scores"] = self._merged(t["scores"], d["scores"])
        m = t["mean"]
        return (d["site"], d["id"], now, t["track"], what, t["status"], *m, t["confidence"], t["updates"], len(t["nodes"]), self._quality(t, since, d["sensors"]))


COLUMNS = ["site", "id", "timestamp_ns", "x", "y", "z", "covariance", "label", "category", "confidence", "sensors", "node_id", "scores", "located"]
NAMES = ["site", "id", "timestamp_ns", "track", "event", "status", "x", "y", "z", "vx", "vy", "vz", "confidence", "updates", "nodes", "quality"]
_KINDS = {"site": "long", "id": "long", "timestamp_ns": "long", "track": "long", "event": "string", "status": "string", "updates": "long", "nodes": "long"}
SCHEMA = ", ".join(f"{n} {_KINDS.get(n, 'double')}" for n in NAMES)


def prepared(rows: DataFrame, *more: str) -> DataFrame:
    """The columns of the fold; those that ``rows`` hasn't are null: covariance (9 numbers), scores (a map), located, ..."""
    kinds = {"covariance": "array<double>", "scores": "map<string,double>", "located": "boolean", "sensors": "long", "node_id": "long", "z": "double", "label": "string", "category": "string", "confidence": "double"}
    missing = {c: F.lit(None).cast(k) for c, k in kinds.items() if c not in rows.columns}
    out = rows.withColumns(missing) if missing else rows
    return out.where("site is not null and timestamp_ns is not null and x is not null and y is not null").select(*[F.col(c).cast(kinds[c]).alias(c) if c in kinds else F.col(c) for c in COLUMNS], *more)


def _detection(site, id_, ns, x, y, z, cov, label, category, confidence, sensors, node, scores, located) -> dict:
    cov = np.array(cov, float).reshape(3, 3) if cov is not None and len(cov) == 9 and None not in cov and np.isfinite(np.array(cov, float)).all() else None
    scores = {k: float(v) for k, v in (dict(scores).items() if scores is not None else ()) if v is not None}
    return {"site": site, "id": id_, "ns": ns, "at": (x, y, z or 0.0), "cov": cov, "label": label or "unknown", "category": category or "unknown", "confidence": confidence or 0.0, "sensors": 1 if sensors is None else sensors, "node": node, "scores": scores or None, "located": located is not False}


def _table(out: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}
    columns = list(zip(*out, strict=True)) if out else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[_KINDS.get(n, "double")]) for c, n in zip(columns, NAMES, strict=True)], names=NAMES)


def fold_batch(rows: DataFrame, settings: Settings | None = None) -> DataFrame:
    """(site, id, timestamp_ns, track, event, status, position, speed, confidence, updates, nodes, quality), a row a detection."""
    settings = settings or Settings()
    # a pause longer than any memory begins a stretch, which is named by the time of its first detection
    at = previous(prepared(rows), ["site"], ["timestamp_ns", "id"], ["timestamp_ns"])
    cut = F.col("before").isNull() | (F.col("timestamp_ns") - F.col("before.timestamp_ns") > settings.memory_ns())
    at = running(at, ["site"], ["timestamp_ns", "id"], F.when(cut, F.col("timestamp_ns")), "stretch", kind="max").select("stretch", *COLUMNS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fold = None, None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            out = []
            for stretch, *values in zip(*columns, strict=True):
                if (values[0], stretch) != key:
                    key, fold = (values[0], stretch), Fold(settings)
                out.append(fold.step(_detection(*values)))
            yield _table(out)

    return at.repartition("site", "stretch").sortWithinPartitions("site", "stretch", "timestamp_ns", "id").mapInArrow(run, SCHEMA)


def fold_stream(stream: DataFrame, ts: str, late: str, settings: Settings | None = None) -> DataFrame:
    """The same rows from a stream with event time ``ts``, of which timestamp_ns has the nanoseconds. A detection comes out when the watermark has passed it."""
    from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

    settings = settings or Settings()
    rows = prepared(stream, ts).withWatermark(ts, late)

    def step(key, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        fold, waiting = pickle.loads(state.get[0]) if state.exists else (Fold(settings), [])
        for part in parts:
            waiting += [tuple(v) for v in part[COLUMNS].astype(object).where(part[COLUMNS].notna(), None).itertuples(index=False)]
        mark = state.getCurrentWatermarkMs() * 1_000_000
        waiting.sort(key=lambda v: (v[2], v[1]))
        ready = [v for v in waiting if v[2] < mark]
        waiting = waiting[len(ready) :]
        out = []
        for v in ready:
            if fold.now is not None and v[2] - fold.now > settings.memory_ns():
                fold = Fold(settings)
            out.append(fold.step(_detection(*v)))
        end = (waiting[0][2] if waiting else (fold.now or 0) + settings.memory_ns()) // 1_000_000 + 1
        if not waiting and end * 1_000_000 <= mark:
            state.remove()
        else:
            state.update((pickle.dumps((fold, waiting)),))
            state.setTimeoutTimestamp(max(end, state.getCurrentWatermarkMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=NAMES)

    return rows.groupBy("site").applyInPandasWithState(step, SCHEMA, "state binary", "append", GroupStateTimeout.EventTimeTimeout)
