"""Places from differences in time of arrival, solved for a whole Arrow batch of events at once.

An event's measurements are one row with arrays (pairs of its sensors, so the row is as long as the site is wide); no event
is a group of its own in Python. All events and starts of a batch go through the same damped least-squares steps with a
soft-L1 loss, as numpy arrays padded to the longest event.

1. Starts: the linear solution against a reference sensor, the sensors' centre, and places near and far along the direction
   of a plane wave.
2. Of the starts the one of least cost, of equally good ones (mirrored places, rings) the first; where the range is badly seen, a bracketed search along the direction from the
   centre follows, in the logarithm of the range.
3. Covariance from the singular values of the weighted Jacobian, with a floor for well seen and the range for unseen axes;
   dilution, condition number, how well the range is observed, and a mode: "refined", "asymptotic" (the cost has no
   minimum in range) or "bearing_projected" (range unknown, bearing sound: a cone).

Edge cases: null or non-finite measurements are left out; an event with fewer than three pairs (two, if its height is
given) or whose sensors are all at one place has the mode "insufficient" and no position; repeated pairs count each; an
empty table gives no row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: When a range counts as unseen, and how sure such a solution may be.
FAR_APERTURES, ASYMPTOTIC_SHARE, WORST_CONDITION = 2.0, 5.0, 1e6
UNSEEN_CONFIDENCE, PROJECTED_CONFIDENCE, LEAST_CONE_M = 0.35, 0.6, 200.0
NAMES = ["x", "y", "z", "cxx", "cxy", "cxz", "cyy", "cyz", "czz", "gdop", "condition", "residual_s", "observability", "confidence"]
_TINY = 1e-9
#: A start has settled when a step is shorter than this share of its place; pairs of places compared at once.
_SETTLED, _COMPARED = 1e-10, 1 << 22
#: Residuals that are nothing but rounding: places with such costs, or within a billionth of the least, are equally good.
_EXACT_S = 1e-11


def _lengths(p: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Distances of places (n, s, 3) to sensors (n, m, 3): (n, s, m)."""
    d = p[:, :, None, :] - at[:, None, :, :]
    return np.sqrt((d * d).sum(axis=3))


class Events:
    """Measurements of events: sensor places a and b (n, m, 3), differences tau of a's arrival after b's, weights (0: none)."""

    def __init__(self, a: np.ndarray, b: np.ndarray, tau: np.ndarray, weight: np.ndarray, speed: np.ndarray, loss_s: float):
        self.a, self.b, self.tau, self.w, self.c, self.loss = a, b, tau, weight, speed, loss_s
        used = (weight > 0)[:, :, None]
        both = np.concatenate([np.where(used, a, np.nan), np.where(used, b, np.nan)], axis=1)
        with np.errstate(invalid="ignore"):
            self.centre = np.nan_to_num(np.nanmean(both, axis=1))
        gap = np.nan_to_num(np.linalg.norm(both - self.centre[:, None], axis=2))
        base = np.linalg.norm(np.where(used, a - b, 0.0), axis=2).max(axis=1, initial=0.0)
        self.aperture = np.maximum(base, gap.max(axis=1, initial=0.0))

    def residual(self, p: np.ndarray) -> np.ndarray:
        return self.w[:, None] * ((_lengths(p, self.a) - _lengths(p, self.b)) / self.c[:, None, None] - self.tau[:, None])

    def cost(self, p: np.ndarray) -> np.ndarray:
        z = (self.residual(p) / self.loss) ** 2
        return (2 * (np.sqrt(1 + z) - 1)).sum(axis=2) * self.loss**2

    def jacobian(self, p: np.ndarray) -> np.ndarray:
        unit = lambda at: (p[:, :, None, :] - at[:, None, :, :]) / (_lengths(p, at) + _TINY)[..., None]
        return (self.w[:, None, :, None] * (unit(self.a) - unit(self.b))) / self.c[:, None, None, None]

    def direction(self) -> np.ndarray:
        """Of a plane wave: the least-squares solution of (b - a) u = c tau, at length one."""
        m = self.w[..., None] * (self.b - self.a)
        u = np.einsum("nij,nj->ni", np.linalg.pinv(m, rcond=1e-6), self.w * self.tau * self.c[:, None])
        size = np.linalg.norm(u, axis=1, keepdims=True)
        return np.where(size > _TINY, u / np.maximum(size, _TINY), np.array([1.0, 0, 0]))

    def linear(self) -> np.ndarray:
        """Spherical intersection: place and range of the reference, linear in both, from pairs with the most frequent sensor."""
        n, m = self.tau.shape
        out, step = np.full((n, 3), np.nan), max(1, _COMPARED // (4 * m * m))
        for i in range(0, n, step):
            out[i : i + step] = self._linear(slice(i, i + step))
        return out

    def _linear(self, part: slice) -> np.ndarray:
        a, b, used, d = self.a[part], self.b[part], self.w[part] > 0, self.tau[part] * self.c[part, None]
        every, some = np.concatenate([a, b], axis=1), np.concatenate([used, used], axis=1)
        same = (every[:, :, None] == every[:, None]).all(axis=3) & some[:, :, None] & some[:, None]
        times = same.sum(axis=2)
        often = some & (times == times.max(axis=1, keepdims=True))
        for k in range(3):  # of equally frequent places the smallest
            x = np.where(often, every[:, :, k], np.inf)
            often &= x == x.min(axis=1, keepdims=True)
        ref = every[np.arange(len(every)), often.argmax(axis=1)]
        first, second = (b == ref[:, None]).all(axis=2) & used, (a == ref[:, None]).all(axis=2) & used
        at, diff, given = np.concatenate([a, b], axis=1), np.concatenate([d, -d], axis=1), np.concatenate([first, second], axis=1)
        out = np.full((len(every), 3), np.nan)
        k = np.flatnonzero((used.sum(axis=1) >= 4) & (given.sum(axis=1) >= 4))
        if len(k):
            at, diff, given, ref = at[k], diff[k], given[k], ref[k]
            rows = np.where(given[..., None], np.concatenate([2 * (at - ref[:, None]), 2 * diff[..., None]], axis=2), 0.0)
            right = np.where(given, (at * at).sum(axis=2) - (ref * ref).sum(axis=1)[:, None] - diff**2, 0.0)
            out[k] = np.einsum("nij,nj->ni", np.linalg.pinv(rows, rcond=np.finfo(float).eps * max(rows.shape[1:])), right)[:, :3]
        return out

    def take(self, k: np.ndarray) -> Events:
        out = object.__new__(Events)
        for name, x in vars(self).items():
            setattr(out, name, x if name == "loss" else x[k])
        return out


class _Lanes:
    """Starts of events, one a lane: arrays by axis, pair and lane, so that the long axis is the last one."""

    def __init__(self, e: Events, event: np.ndarray):
        self.a, self.b = (np.ascontiguousarray(x[event].transpose(2, 1, 0)) for x in (e.a, e.b))
        self.tau, self.w, self.c, self.loss = np.ascontiguousarray(e.tau[event].T), np.ascontiguousarray(e.w[event].T), e.c[event], e.loss

    def keep(self, on: np.ndarray) -> None:
        self.a, self.b, self.tau, self.w, self.c = self.a[..., on], self.b[..., on], self.tau[:, on], self.w[:, on], self.c[on]

    def at(self, p: np.ndarray) -> tuple:
        """Differences and distances to both sensors, residuals, cost of places (3, lanes)."""
        da, db = p[:, None] - self.a, p[:, None] - self.b
        la, lb = (np.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2]) for d in (da, db))
        r = self.w * ((la - lb) / self.c - self.tau)
        z = (r / self.loss) ** 2
        return da, db, la, lb, r, (2 * (np.sqrt(1 + z) - 1)).sum(axis=0) * self.loss**2


def _solved(h: list, g: np.ndarray) -> np.ndarray:
    """x of h x = g for symmetric positive matrices (xx, xy, xz, yy, yz, zz), by their triangular factors."""
    xx, xy, xz, yy, yz, zz = h
    u, v = xy / xx, xz / xx
    d2 = np.maximum(yy - u * xy, 1e-300)
    t = (yz - v * xy) / d2
    d3 = np.maximum(zz - v * xz - t * t * d2, 1e-300)
    y1 = g[1] - u * g[0]
    z = (g[2] - v * g[0] - t * y1) / d3
    y = y1 / d2 - t * z
    return np.stack([g[0] / xx - u * y - v * z, y, z])


def _descend(e: Events, p: np.ndarray, free: np.ndarray, steps: int) -> np.ndarray:
    """Damped Gauss-Newton on all starts of all events; a step is kept where it lowers the cost. A start that has settled
    leaves the arrays, so a batch takes the steps that its starts need, not as many as its slowest."""
    n, s, _ = p.shape
    out = p.reshape(-1, 3).T.copy()
    lane, loose = np.arange(n * s), np.broadcast_to(free, p.shape).reshape(-1, 3).T.copy()
    lanes, x, damp = _Lanes(e, np.repeat(np.arange(n), s)), out.copy(), np.full(n * s, 1e-3)
    da, db, la, lb, r, cost = lanes.at(x)
    for _ in range(steps):
        j = lanes.w * (da / (la + _TINY) - db / (lb + _TINY)) / lanes.c * loose[:, None]
        w = 1 / np.sqrt(1 + (r / e.loss) ** 2)
        wj, wr = w * j, w * r
        h = [(wj[i] * j[k]).sum(axis=0) for i, k in ((0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2))]
        more = damp * np.maximum(h[0] + h[3] + h[5], 1e-18)
        h[0], h[3], h[5] = h[0] + more, h[3] + more, h[5] + more
        step = _solved(h, (j * wr).sum(axis=1)) * loose
        tried = x - step
        there = lanes.at(tried)
        better = there[5] < cost
        x = np.where(better, tried, x)
        damp = np.clip(np.where(better, damp / 5, damp * 4), 1e-12, 1e6)
        small = np.sqrt((step * step).sum(axis=0)) <= _SETTLED * (1 + np.sqrt((x * x).sum(axis=0)))
        on = ~((small & (damp < 1)) | (~better & (damp > 1e3)))
        da, db, la, lb, r, cost = (np.where(better, new, old) for new, old in zip(there, (da, db, la, lb, r, cost), strict=True))
        if not on.all():
            out[:, lane[~on]] = x[:, ~on]
            lane, x, damp, loose, cost = lane[on], x[:, on], damp[on], loose[:, on], cost[on]
            da, db, la, lb, r = da[..., on], db[..., on], la[:, on], lb[:, on], r[:, on]
            lanes.keep(on)
            if not len(lane):
                break
    out[:, lane] = x
    return out.T.reshape(n, s, 3)


def _radial(e: Events, p: np.ndarray, least: np.ndarray, first: float) -> tuple[np.ndarray, np.ndarray]:
    """The range of least cost along each event's direction, by doubling a bracket and golden sections; and whether it has one."""
    away = p - e.centre
    unit = away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), _TINY)
    f = lambda s: np.square(e.residual((e.centre + unit * np.exp(s)[:, None])[:, None]))[:, 0].sum(axis=1)
    low = np.log(np.maximum(e.aperture / 2, least))
    mid = np.maximum(np.log(np.maximum(np.linalg.norm(away, axis=1), np.maximum(first, e.aperture))), low + np.log(2))
    high = mid + np.log(2)
    grown = np.zeros(len(p), int)
    for _ in range(20):
        more = f(high) < f(mid)
        low, mid, high = np.where(more, mid, low), np.where(more, high, mid), np.where(more, high + np.log(2), high)
        grown += more
    bounded = ~(f(high) < f(mid))
    low = np.where(grown == 0, np.log(np.maximum(e.aperture / 2, least)), low)
    k = (np.sqrt(5) - 1) / 2
    for _ in range(90):
        x, y = high - k * (high - low), low + k * (high - low)
        left = f(x) <= f(y)
        low, high = np.where(left, low, x), np.where(left, y, high)
    return e.centre + unit * np.exp((low + high) / 2)[:, None], bounded


def solve(e: Events, quality: np.ndarray, sample_std_s: float, fixed_z: np.ndarray | None = None, first_range_m: float = 50.0, steps: int = 80) -> tuple[list[str], np.ndarray]:
    """Mode of each event, and its numbers by ``NAMES``."""
    n = len(e.tau)
    floor_m = np.maximum(e.c * sample_std_s, 0.05)
    flat = np.zeros(n, bool) if fixed_z is None else np.isfinite(fixed_z)
    free = np.ones((n, 1, 3))
    free[flat, :, 2] = 0.0
    out, mode = np.full((n, len(NAMES)), np.nan), np.full(n, "insufficient", object)
    seen = ((e.w > 0).sum(axis=1) >= np.where(flat, 2, 3)) & (e.aperture > _TINY)
    if not n or not seen.any():
        return mode.tolist(), out
    u = e.direction()
    reach = np.maximum(e.aperture, floor_m)[:, None]
    starts = [e.linear(), e.centre, e.centre + u * reach, e.centre + u * np.maximum(10 * reach, 1.0), e.centre - u * reach, e.centre + np.array([0, 0, 1.0]) * reach]
    p = np.stack([np.where(np.isfinite(s), s, e.centre) for s in starts], axis=1)
    if fixed_z is not None:
        p[flat, :, 2] = fixed_z[flat, None]
    p = _descend(e, p, free, steps)
    cost = e.cost(p)
    least = cost.min(axis=1, keepdims=True)
    best = p[np.arange(n), (cost <= least * (1 + 1e-9) + e.tau.shape[1] * _EXACT_S**2).argmax(axis=1)]

    def fit(at):
        r = e.residual(at[:, None])[:, 0]
        return np.sqrt((r * r).sum(axis=1) / np.maximum((e.w > 0).sum(axis=1), 1))

    rms = fit(best)
    std = np.maximum(rms, sample_std_s)

    def radial_std(at):
        away = at - e.centre
        unit = away / np.maximum(np.linalg.norm(away, axis=1, keepdims=True), _TINY)
        seen_ = np.linalg.norm(np.einsum("nmi,ni->nm", e.jacobian(at[:, None])[:, 0], unit), axis=1)
        return std / np.maximum(seen_, 1e-15)

    far = np.linalg.norm(best - e.centre, axis=1)
    weak = ~flat & ((radial_std(best) >= np.maximum(np.maximum(far, e.aperture), floor_m)) | (far >= FAR_APERTURES * e.aperture))
    asymptotic, extra = np.zeros(n, bool), np.zeros(n)
    if weak.any():
        moved, bounded, k = best.copy(), np.ones(n, bool), np.flatnonzero(weak)
        moved[k], bounded[k] = _radial(e.take(k), best[k], floor_m[k], first_range_m)
        take = weak & (fit(moved) < rms * (1 - 1e-4))
        best = np.where(take[:, None], moved, best)
        rms = fit(best)
        std = np.maximum(rms, sample_std_s)
        far = np.linalg.norm(best - e.centre, axis=1)
        extra = np.where(weak, np.minimum(radial_std(best), 1e9), 0.0)
        asymptotic = weak & (~bounded | (extra >= ASYMPTOTIC_SHARE * far))
    j = e.jacobian(best[:, None])[:, 0] * free
    _, sv, vt = np.linalg.svd(j, full_matrices=False)
    dims = np.where(flat, 2, 3)
    last = sv[np.arange(n), dims - 1]
    condition = sv[:, 0] / np.maximum(last, 1e-15)
    asymptotic |= ~flat & (condition > WORST_CONDITION)
    unseen = np.maximum(np.maximum(extra, far), np.maximum(e.aperture, floor_m))
    var = np.where(sv > 1e-12, np.maximum((std[:, None] / np.maximum(sv, 1e-12)) ** 2, floor_m[:, None] ** 2), unseen[:, None] ** 2)
    cov = np.einsum("nki,nk,nkj->nij", vt, var, vt)
    cov[flat, 2, :] = cov[flat, :, 2] = 0.0
    axis = (best - e.centre) / np.maximum(far, _TINY)[:, None]
    outer = axis[:, :, None] * axis[:, None, :]
    cov += (np.maximum(extra**2 - np.einsum("ni,nij,nj->n", axis, cov, axis), 0.0))[:, None, None] * outer
    radial = np.einsum("ni,nij,nj->n", axis, cov, axis)
    lateral = np.maximum((np.trace(cov, axis1=1, axis2=2) - radial) / np.maximum(dims - 1, 1), floor_m**2)
    projected = asymptotic & (condition < 1e8)
    cone = np.maximum(np.maximum(4 * far, first_range_m), LEAST_CONE_M) ** 2
    cov = np.where(projected[:, None, None], lateral[:, None, None] * (np.eye(3) - outer) + cone[:, None, None] * outer, cov)
    radial = np.where(projected, cone, radial)
    values = np.linalg.eigvalsh(cov)
    shape = np.sqrt(np.maximum(values[np.arange(n), 3 - dims], 1e-12) / np.maximum(values[:, 2], 1e-12)).clip(0, 1)
    observed = np.minimum(np.sqrt(lateral / np.maximum(radial, lateral)).clip(0, 1), shape)
    factor = np.where(projected, 1.0, np.sqrt(np.maximum(shape, observed / 4)))
    sure = (quality * np.exp(-rms / max(4 * sample_std_s, 1e-12)) * factor).clip(0, 1)
    sure = np.where(projected, np.minimum(sure, PROJECTED_CONFIDENCE), np.where(asymptotic, np.minimum(sure, UNSEEN_CONFIDENCE), sure))
    inverse = np.where(np.arange(3)[None] < dims[:, None], 1 / np.maximum(sv, 1e-15) ** 2, 0.0)
    gdop = np.where(last > 1e-12, np.sqrt(inverse.sum(axis=1)), np.inf)
    ij = [(0, 0), (0, 1), (0, 2), (1, 1), (1, 2), (2, 2)]
    numbers = np.column_stack([best, *[cov[:, i, k] for i, k in ij], gdop, condition, rms, observed, sure])
    mode[seen] = np.where(projected, "bearing_projected", np.where(asymptotic, "asymptotic", "refined"))[seen]
    out[seen] = numbers[seen]
    return mode.tolist(), out


def solve_rows(rows: DataFrame, event: str, sample_rate_hz: float = 48_000.0, loss_s: float = 1e-3, half_space: str | None = None) -> DataFrame:
    """(event, pairs, mode, position, covariance, gdop, ...) from (event, pairs, speed, z): ``pairs`` is an array of
    (ax, ay, az, bx, by, bz, tau_s, weight, peak), ``speed`` metres a second, ``z`` a fixed height or null.

    ``half_space`` "upper" or "lower" mirrors a position at the sensors' mean height into that half.
    """
    kind = dict(rows.dtypes)[event]
    fields = ["ax", "ay", "az", "bx", "by", "bz", "tau_s", "weight", "peak"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 512):
                b = whole.slice(first, 512)
                pairs, n = b.column(1), b.num_rows
                ends = np.concatenate([[0], np.cumsum([0 if not x.is_valid else len(x) for x in pairs])])
                flat = pairs.flatten()
                data = np.column_stack([np.asarray(flat.field(k).to_numpy(zero_copy_only=False), float) for k in range(9)]) if len(flat) else np.zeros((0, 9))
                sound = np.isfinite(data).all(axis=1) & (data[:, 7] > 0)
                most = max(int(np.diff(ends).max(initial=1)), 3)
                full = np.zeros((n, most, 9))
                row = np.repeat(np.arange(n), np.diff(ends))
                full[row[sound], (np.arange(len(row)) - ends[row])[sound]] = data[sound]
                speed, z = (np.array([np.nan if v is None else v for v in b.column(k).to_pylist()], float) for k in (2, 3))
                e = Events(full[:, :, :3], full[:, :, 3:6], full[:, :, 6], full[:, :, 7], np.where(np.isfinite(speed), speed, 343.0), loss_s)
                used = e.w > 0
                quality = (full[:, :, 8].clip(0, 1) * used).sum(axis=1) / np.maximum(used.sum(axis=1), 1)
                mode, got = solve(e, quality, 1 / sample_rate_hz, z if np.isfinite(z).any() else None)
                if half_space:
                    sign = 1 if half_space == "upper" else -1
                    turn = sign * (got[:, 2] - e.centre[:, 2]) < 0
                    got[turn, 2] = 2 * e.centre[turn, 2] - got[turn, 2]
                    got[np.ix_(turn, [5, 7])] *= -1
                columns = [pa.array(got[:, k], from_pandas=True) for k in range(len(NAMES))]
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(used.sum(axis=1)), pa.array(mode, pa.string()), *columns], names=[event, "n_pairs", "mode", *NAMES])

    plain = rows.select(event, F.transform("pairs", lambda x: F.struct(*[x[f].cast("double").alias(f) for f in fields])).alias("pairs"), F.col("speed").cast("double").alias("speed"), F.col("z").cast("double").alias("z"))
    return plain.mapInArrow(run, f"`{event}` {kind}, n_pairs long, mode string, " + ", ".join(f"{x} double" for x in NAMES))
