"""Several nodes together: where bearings cross, how good a geometry is, which tracks of two sites are one, who owns them.

Sums over the nodes of an event are grouped aggregations; small systems are solved in closed form by column expressions.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import physics, scoring
from ..sources.views import DAY, NOW_NS, SECOND, WINDOW_NS
from . import query
from .joins import near_in_time
from .measures import placed

ONE = F.lit


def bearing_fixes(rays: DataFrame, event: str, min_separation_deg: float = 5.0, max_range_m: float = 1200.0, max_condition: float = 1e4) -> DataFrame:
    """(event, nodes, reason, x, y, range_m, confidence): where the level bearings of an event's nodes cross.

    ``rays``: event, node_id, ox, oy (origin), dx, dy (unit direction), confidence, std (metres across). Of a node the most
    confident ray counts. The place minimises the weighted squared distances to all rays; a reason says why there is none.
    """
    best = rays.groupBy(event, "node_id").agg(F.max(F.struct("confidence", "ox", "oy", "dx", "dy", "std")).alias("m")).select(event, "node_id", "m.*")
    w = F.greatest("confidence", F.lit(0.05)) / F.greatest(F.col("std") * F.col("std"), F.lit(1e-4))
    xx, xy, yy = w * (1 - F.col("dx") * F.col("dx")), -w * F.col("dx") * F.col("dy"), w * (1 - F.col("dy") * F.col("dy"))
    two = best.select(event, F.col("node_id").alias("n2"), F.col("dx").alias("dx2"), F.col("dy").alias("dy2"))
    apart = F.degrees(F.acos(F.least(F.greatest(F.col("dx") * F.col("dx2") + F.col("dy") * F.col("dy2"), F.lit(-1.0)), F.lit(1.0))))
    least = best.join(two, event).where("node_id < n2").groupBy(event).agg(F.min(F.least(apart, 180 - apart)).alias("separation"))
    left = F.exp(F.sum(F.log(1 - F.least("confidence", F.lit(0.99)))))
    sums = best.groupBy(event).agg(
        F.count("*").alias("nodes"), F.sum(xx).alias("a"), F.sum(xy).alias("b"), F.sum(yy).alias("c"), F.sum(xx * F.col("ox") + xy * F.col("oy")).alias("p"), F.sum(xy * F.col("ox") + yy * F.col("oy")).alias("q"),
        F.avg("ox").alias("mx"), F.avg("oy").alias("my"), F.least(F.lit(0.95), 1 - left).alias("sure"),
    )
    det = F.col("a") * F.col("c") - F.col("b") * F.col("b")
    mean, half = (F.col("a") + F.col("c")) / 2, F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    rows = sums.join(least, event, "left").withColumn("x", F.try_divide(F.col("c") * F.col("p") - F.col("b") * F.col("q"), det)).withColumn("y", F.try_divide(F.col("a") * F.col("q") - F.col("b") * F.col("p"), det))
    rows = rows.withColumn("range_m", F.sqrt((F.col("x") - F.col("mx")) * (F.col("x") - F.col("mx")) + (F.col("y") - F.col("my")) * (F.col("y") - F.col("my"))))
    bad = (mean - half <= 1e-9) | (mean + half > (mean - half) * max_condition)
    reason = F.when(F.col("nodes") < 2, "insufficient_nodes").when(F.col("separation") < min_separation_deg, "near_parallel").when(bad, "degenerate").when(F.col("range_m") > max_range_m, "out_of_range").otherwise("")
    rows = rows.withColumn("reason", reason)
    shown = [F.when(F.col("reason") == "", F.round(c, 4)).alias(c) for c in ("x", "y", "range_m")]
    return rows.select(event, "nodes", "reason", *shown, F.when(F.col("reason") == "", F.round("sure", 6)).alias("confidence"))


_RAYS_SQL = "SELECT o.detection_id, o.node_id, n.x AS ox, n.y AS oy, cos(radians(o.observation_id * 37 % 360)) AS dx, sin(radians(o.observation_id * 37 % 360)) AS dy, 0.1::DOUBLE + (o.observation_id % 9) / 10.0::DOUBLE AS confidence, 2.0::DOUBLE + (o.observation_id % 4)::DOUBLE AS std FROM {observations} o JOIN {nodes} n ON n.id = o.node_id"


@query(
    "bearing_fixes",
    f"""WITH rays AS ({_RAYS_SQL}), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY detection_id, node_id ORDER BY confidence DESC, ox DESC, oy DESC, dx DESC, dy DESC, std DESC) AS r, greatest(confidence, 0.05) / greatest(std * std, 1e-4) AS w FROM rays) WHERE r = 1),
    sep AS (SELECT detection_id, min(least(d, 180 - d)) AS separation FROM (SELECT a.detection_id, degrees(acos(least(greatest(a.dx * b.dx + a.dy * b.dy, -1), 1))) AS d FROM best a JOIN best b ON a.detection_id = b.detection_id AND a.node_id < b.node_id) GROUP BY 1),
    sums AS (SELECT detection_id, count(*) AS nodes, sum(w * (1 - dx * dx)) AS a, sum(-w * dx * dy) AS b, sum(w * (1 - dy * dy)) AS c, sum(w * (1 - dx * dx) * ox - w * dx * dy * oy) AS p, sum(w * (1 - dy * dy) * oy - w * dx * dy * ox) AS q, avg(ox) AS mx, avg(oy) AS my, least(0.95, 1 - exp(sum(ln(1 - least(confidence, 0.99))))) AS sure FROM best GROUP BY 1),
    s AS (SELECT *, (a + c) / 2 - sqrt((a - c) * (a - c) / 4 + b * b) AS low, (a + c) / 2 + sqrt((a - c) * (a - c) / 4 + b * b) AS high, (c * p - b * q) / nullif(a * c - b * b, 0) AS x, (a * q - b * p) / nullif(a * c - b * b, 0) AS y FROM sums LEFT JOIN sep USING (detection_id)),
    t AS (SELECT *, sqrt((x - mx) * (x - mx) + (y - my) * (y - my)) AS far FROM s),
    u AS (SELECT *, CASE WHEN nodes < 2 THEN 'insufficient_nodes' WHEN separation < 5 THEN 'near_parallel' WHEN low <= 1e-9 OR high > low * 1e4 THEN 'degenerate' WHEN far > 1200 THEN 'out_of_range' ELSE '' END AS reason FROM t)
    SELECT detection_id, nodes, reason, CASE WHEN reason = '' THEN round(x, 4) END AS x, CASE WHEN reason = '' THEN round(y, 4) END AS y, CASE WHEN reason = '' THEN round(far, 4) END AS range_m, CASE WHEN reason = '' THEN round(sure, 6) END AS confidence FROM u""",
)
def _(v):
    i = F.col("observation_id")
    nodes = v.nodes.select(F.col("id").alias("node_id"), F.col("x").alias("ox"), F.col("y").alias("oy"))
    rays = v.observations.join(nodes, "node_id")
    turn = F.radians((i * 37 % 360).cast("double"))
    return bearing_fixes(rays.select("detection_id", "node_id", "ox", "oy", F.cos(turn).alias("dx"), F.sin(turn).alias("dy"), (0.1 + (i % 9) / F.lit(10.0)).alias("confidence"), (2.0 + (i % 4).cast("double")).alias("std")), "detection_id")


def dilution(pairs: DataFrame, event: str, speed: float = 343.0, worst: float = 1e12) -> DataFrame:
    """(event, gdop) in the plane from (x, y, nx, ny, rx, ry): place, sensor, reference sensor; infinite if ill-conditioned."""
    far = lambda a, b: F.sqrt((F.col("x") - F.col(a)) * (F.col("x") - F.col(a)) + (F.col("y") - F.col(b)) * (F.col("y") - F.col(b))) + 1e-9
    gx = (F.col("x") - F.col("nx")) / (far("nx", "ny") * speed) - (F.col("x") - F.col("rx")) / (far("rx", "ry") * speed)
    gy = (F.col("y") - F.col("ny")) / (far("nx", "ny") * speed) - (F.col("y") - F.col("ry")) / (far("rx", "ry") * speed)
    s = pairs.withColumn("gx", gx).withColumn("gy", gy).groupBy(event).agg(F.sum(F.col("gx") * F.col("gx")).alias("a"), F.sum(F.col("gx") * F.col("gy")).alias("b"), F.sum(F.col("gy") * F.col("gy")).alias("c"))
    mean, half = (F.col("a") + F.col("c")) / 2, F.sqrt((F.col("a") - F.col("c")) * (F.col("a") - F.col("c")) / 4 + F.col("b") * F.col("b"))
    sound = mean + half <= (mean - half) * worst
    return s.select(event, F.when(sound, F.sqrt(F.try_divide(F.col("a") + F.col("c"), F.col("a") * F.col("c") - F.col("b") * F.col("b")))).otherwise(F.lit(float("inf"))).alias("gdop"))


_FAR = "(sqrt((x - {0}) * (x - {0}) + (y - {1}) * (y - {1})) + 1e-9) * 343.0"


@query(
    "dilutions",
    f"""WITH p AS (SELECT id, (lon + 93.2565) * 78846.0 AS x, (lat - 44.98) * 111131.0 AS y FROM {{detections}} WHERE reporting_modality = 'localized'), o AS (SELECT detection_id AS id, channel, n.x AS nx, n.y AS ny FROM {{observations}} JOIN {{nodes}} n ON n.id = node_id),
    g AS (SELECT p.id, (x - s.nx) / ({_FAR.format('s.nx', 's.ny')}) - (x - r.nx) / ({_FAR.format('r.nx', 'r.ny')}) AS gx, (y - s.ny) / ({_FAR.format('s.nx', 's.ny')}) - (y - r.ny) / ({_FAR.format('r.nx', 'r.ny')}) AS gy FROM p JOIN o s ON s.id = p.id AND s.channel > 0 JOIN o r ON r.id = p.id AND r.channel = 0),
    s AS (SELECT id, sum(gx * gx) AS a, sum(gx * gy) AS b, sum(gy * gy) AS c FROM g GROUP BY 1), e AS (SELECT *, (a + c) / 2 AS m, sqrt((a - c) * (a - c) / 4 + b * b) AS h FROM s)
    SELECT id, round(ln(sqrt((a + c) / (a * c - b * b))), 3) AS log_gdop FROM e WHERE m + h <= (m - h) * 1e6""",
)
def _(v):
    """By each event's own sensors, the first as the reference; events whose geometry is worse than 1e6 are left out."""
    at = v.nodes.select(F.col("id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    o = v.observations.select(F.col("detection_id").alias("id"), "node_id", "channel").join(at, "node_id")
    reference = o.where("channel = 0").select("id", F.col("nx").alias("rx"), F.col("ny").alias("ry"))
    pairs = placed(v).where("reporting_modality = 'localized'").select("id", "x", "y").join(o.where("channel > 0").drop("channel", "node_id"), "id").join(reference, "id")
    return dilution(pairs, "id", worst=1e6).where("gdop < double('infinity')").select("id", F.round(F.log("gdop"), 3).alias("log_gdop"))


def multilaterate(ranges: DataFrame, device: str, steps: int = 25) -> DataFrame:
    """(device, x, y, residual_m, receivers, confidence) from (device, x, y, range_m, node): weighted Gauss-Newton steps.

    A device's rows are one per node, so a group is as small as the site. Fewer than three nodes, nodes on a line or an
    ill-conditioned step give no row.
    """

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({device: part[device].iloc[:0], "x": [], "y": [], "residual_m": [], "receivers": pd.Series([], dtype="int64"), "confidence": []})
        at, r = part[["x", "y"]].to_numpy(float), part["range_m"].to_numpy(float)
        if len(r) < 3 or np.linalg.matrix_rank(at - at.mean(axis=0), tol=1e-6) < 2:
            return none
        w = 1 / np.maximum(r, 1)
        p = (at * w[:, None]).sum(axis=0) / w.sum()
        for _ in range(steps):
            far = p - at
            d = np.hypot(*far.T)
            use = d > 1e-9
            j = far[use] / d[use, None]
            n = (j * w[use, None]).T @ j
            if not np.isfinite(n).all() or np.linalg.cond(n) > 1e5:
                return none
            step = np.linalg.solve(n, (j * (w * (r - d))[use, None]).sum(axis=0))
            p = p + step
            if np.hypot(*step) < 1e-3:
                break
        rms = float(np.sqrt(np.mean((np.hypot(*(p - at).T) - r) ** 2)))
        return pd.DataFrame({device: part[device].iloc[:1], "x": p[0], "y": p[1], "residual_m": rms, "receivers": len(r), "confidence": round(min(1, len(r) / 5) / (1 + rms), 4)})

    kind = dict(ranges.dtypes)[device]
    return ranges.groupBy(device).applyInPandas(solve, f"`{device}` {kind}, x double, y double, residual_m double, receivers long, confidence double")


@query("device_positions")
def _(v):
    last = v.ble.groupBy("mac", "node_id").agg(F.max_by("rssi", F.struct("recv_ns", "id")).alias("rssi"))
    nodes = v.nodes.select(F.col("id").alias("node_id"), "x", "y")
    return multilaterate(last.join(nodes, "node_id").select("mac", "x", "y", physics.rssi_to_range(F.col("rssi"), exponent=2.7).alias("range_m")), "mac")


def associated(points: DataFrame, tracks: DataFrame, near_m: float = 8.0, most_m: float = 32.0, chi2: float = 9.0, unlike: float = 3.0) -> DataFrame:
    """(id, track_id, score): each point's best track of those whose gate it passes, of the same category (unknown fits all).

    Within ``near_m`` the squared distance counts in units that reach ``chi2`` there; beyond, up to three deviations of both
    positions together (``near_m`` at least, ``most_m`` at most), the squared Mahalanobis distance. Unlike class scores add
    up to ``unlike`` to the score of what has passed. ``points``: id, x, y, variance, category, scores; ``tracks``: track_id,
    tx, ty, t_variance, t_category, t_scores, status; dropped ones don't take part. They meet on cells of ``most_m``.
    """
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    t = tracks.where("status <> 'dropped'").withColumn("_i", F.floor(F.col("tx") / most_m)).withColumn("_j", F.floor(F.col("ty") / most_m))
    p = points.withColumn("_di", around).withColumn("_dj", around).withColumn("_i", F.floor(F.col("x") / most_m) + F.col("_di")).withColumn("_j", F.floor(F.col("y") / most_m) + F.col("_dj"))
    d2 = (F.col("x") - F.col("tx")) * (F.col("x") - F.col("tx")) + (F.col("y") - F.col("ty")) * (F.col("y") - F.col("ty"))
    both = F.col("variance") + F.col("t_variance")
    reach2 = F.least(F.greatest(9 * both, F.lit(near_m * near_m)), F.lit(most_m * most_m))
    gate = F.when(d2 < near_m * near_m, d2 * chi2 / (near_m * near_m)).when((d2 <= reach2) & (d2 / both <= chi2), d2 / both)
    fits = (F.col("category") == F.col("t_category")) | (F.col("category") == "unknown") | (F.col("t_category") == "unknown")
    met = p.join(t, ["_i", "_j"]).where(fits).withColumn("gate", gate).where("gate is not null")
    met = met.withColumn("score", F.col("gate") + F.coalesce(unlike * (1 - scoring.alike(F.col("scores"), F.col("t_scores"))), F.lit(0.0)))
    best = met.groupBy("id").agg(F.min(F.struct("score", "track_id")).alias("m"))
    return best.select("id", "m.track_id", F.round("m.score", 6).alias("score"))


@query(
    "associations",
    f"""WITH p AS (SELECT id, (lon + 93.2565) * 78846.0 AS x, (lat - 44.98) * 111131.0 AS y, label, label_category AS category, (1 + id % 20)::DOUBLE AS variance FROM {{detections}} WHERE reporting_modality = 'omni'),
    t AS (SELECT d.track_id, (max_by(lon, (timestamp_ns, id)) + 93.2565) * 78846.0 AS tx, (max_by(lat, (timestamp_ns, id)) - 44.98) * 111131.0 AS ty, max_by(d.label, (timestamp_ns, id)) AS t_label, CASE WHEN d.track_id % 4 = 0 THEN 'unknown' ELSE max_by(label_category, (timestamp_ns, id)) END AS t_category, (1 + d.track_id % 150)::DOUBLE AS t_variance FROM {{detections}} d JOIN {{tracks}} s ON s.track_id = d.track_id AND s.status <> 'dropped' GROUP BY d.track_id),
    m AS (SELECT id, track_id, g + CASE WHEN label = t_label THEN 0 ELSE 3 END AS score FROM (SELECT *, CASE WHEN d2 < 64 THEN d2 * 9 / 64 WHEN d2 <= least(greatest(9 * (variance + t_variance), 64), 1024) AND d2 / (variance + t_variance) <= 9 THEN d2 / (variance + t_variance) END AS g FROM (SELECT *, (x - tx) * (x - tx) + (y - ty) * (y - ty) AS d2 FROM p JOIN t ON category = t_category OR t_category = 'unknown')) WHERE g IS NOT NULL)
    SELECT id, track_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score, track_id) AS r FROM m) WHERE r = 1""",
)
def _(v):
    one = F.lit(1.0)
    p = placed(v).where("reporting_modality = 'omni'").select("id", "x", "y", F.col("label_category").alias("category"), (1 + F.col("id") % 20).cast("double").alias("variance"), F.create_map("label", one).alias("scores"))
    last = placed(v).where("track_id is not null").groupBy("track_id").agg(F.max(F.struct("timestamp_ns", "id", "x", "y", "label_category", "label")).alias("m"))
    last = last.join(v.tracks.select("track_id", "status"), "track_id")
    t = last.select("track_id", "status", F.col("m.x").alias("tx"), F.col("m.y").alias("ty"), F.when(F.col("track_id") % 4 == 0, "unknown").otherwise(F.col("m.label_category")).alias("t_category"), (1 + F.col("track_id") % 150).cast("double").alias("t_variance"), F.create_map("m.label", one).alias("t_scores"))
    return associated(p, t)


_PEERS_SQL = f"SELECT track_id + 1000 AS peer_id, track_id % 100 AS pair, (track_id * 13 % 100) / 100.0::DOUBLE AS peer_tqi, {NOW_NS} - track_id * {SECOND} AS seen FROM {{tracks}} WHERE track_id >= 100"


@query(
    "track_owners",
    f"SELECT t.track_id, p.peer_id, CASE WHEN peer_tqi > tqi + 0.1 THEN 'peer' WHEN tqi > peer_tqi + 0.1 THEN 'local' WHEN t.track_id % 3 = 0 THEN 'peer' ELSE 'local' END AS owner, CASE WHEN peer_tqi > tqi + 0.1 THEN 'peer_higher_tqi' WHEN tqi > peer_tqi + 0.1 THEN 'local_higher_tqi' WHEN t.track_id % 3 = 0 THEN 'hysteresis_hold' ELSE 'hysteresis_default_local' END AS reason FROM (SELECT *, (track_id * 37 % 100) / 100.0::DOUBLE AS tqi FROM {{tracks}}) t JOIN ({_PEERS_SQL}) p ON p.pair = t.track_id WHERE p.seen >= {NOW_NS - 160 * SECOND}",
)
def _(v):
    local, peers = _sites(v)
    pairs = local.join(peers.where(F.col("seen") >= NOW_NS - 160 * SECOND), F.col("pair") == F.col("track_id"))
    return owners(pairs.withColumn("before", F.when(F.col("track_id") % 3 == 0, "peer"))).select("track_id", "peer_id", "owner", "reason")


def _sites(v):
    local = v.tracks.select("track_id", "last_seen_ns", ((F.col("track_id") * 37 % 100) / F.lit(100.0)).alias("tqi"))
    peers = v.tracks.where("track_id >= 100").select((F.col("track_id") + 1000).alias("peer_id"), (F.col("track_id") % 100).alias("pair"), ((F.col("track_id") * 13 % 100) / F.lit(100.0)).alias("peer_tqi"), (F.lit(NOW_NS) - F.col("track_id") * SECOND).alias("seen"))
    return local, peers


def owners(pairs: DataFrame, hysteresis: float = 0.1) -> DataFrame:
    """Who shows the track that two sites see: the clearly better one, else who did ``before``, else this site."""
    peer, local = F.col("peer_tqi") > F.col("tqi") + hysteresis, F.col("tqi") > F.col("peer_tqi") + hysteresis
    rows = pairs.withColumn("owner", F.when(peer, "peer").when(local, "local").otherwise(F.coalesce("before", F.lit("local"))))
    return rows.withColumn("reason", F.when(peer, "peer_higher_tqi").when(local, "local_higher_tqi").when(F.col("before").isNotNull(), "hysteresis_hold").otherwise("hysteresis_default_local"))


_OWNED_SQL = f"SELECT t.track_id, p.peer_id, CASE WHEN peer_tqi > tqi + 0.1 THEN 'peer' WHEN tqi > peer_tqi + 0.1 THEN 'local' WHEN t.track_id % 3 = 0 THEN 'peer' ELSE 'local' END AS owner FROM (SELECT *, (track_id * 37 % 100) / 100.0::DOUBLE AS tqi FROM {{tracks}}) t JOIN ({_PEERS_SQL}) p ON p.pair = t.track_id WHERE p.seen >= {NOW_NS - 160 * SECOND}"


@query("merged_tracks", f"WITH o AS ({_OWNED_SQL}) SELECT track_id AS id, 'local' AS site, last_seen_ns AS seen, 'owner' AS role FROM {{tracks}} WHERE track_id NOT IN (SELECT track_id FROM o WHERE owner = 'peer') UNION ALL SELECT peer_id, 'peer', seen, 'owner' FROM ({_PEERS_SQL}) WHERE seen >= {NOW_NS - 160 * SECOND} AND peer_id NOT IN (SELECT peer_id FROM o WHERE owner = 'local')")
def _(v):
    return merged(*_merge_inputs(v))


@query("merged_tracks_with_standby", f"WITH o AS ({_OWNED_SQL}) SELECT track_id AS id, 'local' AS site, last_seen_ns AS seen, CASE WHEN track_id IN (SELECT track_id FROM o WHERE owner = 'peer') THEN 'standby' ELSE 'owner' END AS role FROM {{tracks}} UNION ALL SELECT peer_id, 'peer', seen, CASE WHEN peer_id IN (SELECT peer_id FROM o WHERE owner = 'local') THEN 'standby' ELSE 'owner' END FROM ({_PEERS_SQL}) WHERE seen >= {NOW_NS - 160 * SECOND}")
def _(v):
    return merged(*_merge_inputs(v), include_standby=True)


def _merge_inputs(v):
    local, peers = _sites(v)
    peers = peers.where(F.col("seen") >= NOW_NS - 160 * SECOND)
    pairs = owners(local.join(peers, F.col("pair") == F.col("track_id")).withColumn("before", F.when(F.col("track_id") % 3 == 0, "peer")))
    return local.select(F.col("track_id").alias("id"), F.col("last_seen_ns").alias("seen")), peers.select(F.col("peer_id").alias("id"), "seen"), pairs.select("track_id", "peer_id", "owner")


def merged(local: DataFrame, peers: DataFrame, owned: DataFrame, include_standby: bool = False) -> DataFrame:
    """(id, site, seen, role) of two sites' tracks. Of a track that both see (a row of ``owned``: track_id, peer_id, owner) the
    form of the site that doesn't own it is on standby, and left out unless asked for."""
    behind = owned.where("owner = 'peer'").select(F.col("track_id").alias("id"), F.lit("local").alias("site")).unionByName(owned.where("owner = 'local'").select(F.col("peer_id").alias("id"), F.lit("peer").alias("site")))
    both = local.select("id", F.lit("local").alias("site"), "seen").unionByName(peers.select("id", F.lit("peer").alias("site"), "seen"))
    rows = both.join(behind.distinct().withColumn("role", F.lit("standby")), ["id", "site"], "left").select("id", "site", "seen", F.coalesce("role", F.lit("owner")).alias("role"))
    return rows if include_standby else rows.where("role = 'owner'")


@query("window_saturation", f"SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY node_id, report_window_start_ns ORDER BY timestamp_ns, id) AS r FROM {{detections}} WHERE reporting_modality = 'localized') WHERE r <= 1")
def _(v):
    """At most one localized report of a node and window: the first."""
    rows = v.detections.where("reporting_modality = 'localized'").groupBy("node_id", "report_window_start_ns").agg(F.min_by("id", F.struct("timestamp_ns", "id")).alias("id"))
    return rows.select("id")


@query("chunk_dispatch", f"SELECT node_id, timestamp_ns // {4 * WINDOW_NS} AS chunk, min_by(id, (timestamp_ns, id)) AS id, count(*) AS asked FROM {{detections}} GROUP BY 1, 2")
def _(v):
    return v.detections.groupBy("node_id", F.expr(f"timestamp_ns div {4 * WINDOW_NS}").alias("chunk")).agg(F.min_by("id", F.struct("timestamp_ns", "id")).alias("id"), F.count("*").alias("asked"))


@query("slot_assignments", "WITH t AS (SELECT track_id, (track_id * 37 % 100) / 100.0::DOUBLE AS tqi, CASE WHEN track_id % 40 = 7 THEN track_id // 40 END AS held FROM {tracks}), free AS (SELECT s, row_number() OVER (ORDER BY s) AS r FROM (SELECT unnest(range(12)) AS s) WHERE s NOT IN (SELECT held FROM t WHERE held IS NOT NULL)), new AS (SELECT track_id, row_number() OVER (ORDER BY tqi DESC, track_id) AS r FROM t WHERE held IS NULL) SELECT held::INT AS slot, track_id FROM t WHERE held IS NOT NULL UNION ALL SELECT free.s::INT, new.track_id FROM free JOIN new USING (r)")
def _(v):
    t = v.tracks.select("track_id", ((F.col("track_id") * 37 % 100) / F.lit(100.0)).alias("tqi"), F.when(F.col("track_id") % 40 == 7, F.expr("track_id div 40")).alias("held"))
    return slots(t, 12)


def slots(tracks: DataFrame, n: int) -> DataFrame:
    """(slot, track_id): who holds a slot keeps it; the best of the others, at most ``n``, take the free ones in order."""
    held = tracks.where("held is not null").select(F.col("held").cast("int").alias("slot"), "track_id")
    best = tracks.where("held is null").orderBy(F.desc("tqi"), "track_id").limit(n).agg(F.collect_list(F.struct((-F.col("tqi")).alias("o"), "track_id")).alias("l")).select(F.array_sort("l").alias("l"))
    taken = held.agg(F.collect_set("slot").alias("taken"))  # n slots at most
    free = F.array_except(F.sequence(F.lit(0), F.lit(n - 1)), F.col("taken"))
    rows = best.crossJoin(taken).select(F.explode(F.arrays_zip(free.alias("slot"), F.col("l").alias("t"))).alias("z"))  # two single rows
    return held.unionByName(rows.where("z.slot is not null and z.t is not null").select("z.slot", "z.t.track_id"))


#: Labels by which a classifier says that it can't tell.
ABSTENTIONS = ("unknown", "")


def ensemble_winner(members, priority=()) -> F.Column:
    """(label, confidence, member) of an array of members (member, label, confidence, weight, ranks, scores).

    The best label of ``priority`` wins at any confidence. Else the highest confidence times weight among those that don't
    abstain (the first of equals). If all abstain, the highest score, other than an abstention or of a stage ("stage:label"),
    of members that rank all sounds; else what the first said. Members that failed are null.
    """
    members = F.filter(members, lambda m: m.isNotNull())
    abstains = lambda m: F.lower(F.trim(m.label)).isin(*ABSTENTIONS)
    place = lambda m: F.array_position(F.transform(members, lambda x: x.member), m.member)

    def best(some, value):
        return F.array_max(F.transform(some, lambda m: F.struct(value(m).alias("by"), (-place(m)).alias("first"), m.label.alias("label"), value(m).alias("confidence"), m.member.alias("member"))))

    urgent = best(F.filter(members, lambda m: m.label.isin(*priority) if priority else F.lit(False)), lambda m: m.confidence)
    sure = best(F.filter(members, lambda m: ~abstains(m)), lambda m: m.confidence * m.weight)
    ranked = F.flatten(F.transform(F.filter(members, lambda m: abstains(m) & m.ranks), lambda m: F.transform(F.filter(F.map_entries(m.scores), lambda e: ~F.lower(F.trim(e.key)).isin(*ABSTENTIONS) & ~e.key.contains(":")), lambda e: F.struct(e.value.alias("by"), (-place(m)).alias("first"), e.key.alias("label"), e.value.alias("confidence"), m.member.alias("member")))))
    first = F.get(members, F.lit(0))
    said = F.when(first.isNotNull(), F.struct(first.label.alias("label"), first.confidence.alias("confidence"), first.member.alias("member")))
    pick = lambda s: F.when(s.isNotNull(), F.struct(s.label.alias("label"), F.least(F.greatest(s.confidence, F.lit(0.0)), F.lit(1.0)).alias("confidence"), s.member.alias("member")))
    return F.coalesce(pick(urgent), pick(sure), pick(F.array_max(ranked)), said)


@query("ensemble_winners", "SELECT id, CASE WHEN alarm >= 0.9 THEN 'alarm' WHEN a >= 0.3 AND (b < 0.4 OR a >= b * 0.8) THEN label WHEN b >= 0.4 THEN 'drone' ELSE label END AS winner, round(CASE WHEN alarm >= 0.9 THEN alarm * 0.1 WHEN a >= 0.3 AND (b < 0.4 OR a >= b * 0.8) THEN a WHEN b >= 0.4 THEN b * 0.8 ELSE a / 2 END, 6) AS confidence, CASE WHEN alarm >= 0.9 THEN 'alarm' WHEN a >= 0.3 AND (b < 0.4 OR a >= b * 0.8) THEN 'base' WHEN b >= 0.4 THEN 'drone' ELSE 'base' END AS member FROM (SELECT id, label, label_confidence AS a, (id * 53 % 100) / 100.0::DOUBLE AS b, (id * 71 % 100) / 100.0::DOUBLE AS alarm FROM {detections})")
def _(v):
    """Three members; an alarm has priority though its confidence is low; unsure members abstain."""
    a, b, alarm = F.col("label_confidence"), (F.col("id") * 53 % 100) / F.lit(100.0), (F.col("id") * 71 % 100) / F.lit(100.0)
    none = F.lit(None).cast("map<string,double>")

    def member(name, label, confidence, weight, ranks, scores):
        return F.struct(F.lit(name).alias("member"), label.alias("label"), confidence.alias("confidence"), F.lit(weight).alias("weight"), F.lit(ranks).alias("ranks"), scores.alias("scores"))

    scores = F.create_map(F.col("label"), a / 2, F.lit("unknown"), F.lit(0.9), F.lit("stage:ambient"), F.lit(0.95))
    members = F.array(member("base", F.when(a >= 0.3, F.col("label")).otherwise("unknown"), a, 1.0, True, scores), member("drone", F.when(b >= 0.4, "drone").otherwise("unknown"), b, 0.8, False, none), member("alarm", F.when(alarm >= 0.9, "alarm").otherwise("unknown"), alarm * 0.1, 1.0, False, none))
    w = ensemble_winner(members, ("alarm",))
    return v.detections.withColumn("w", w).select("id", F.col("w.label").alias("winner"), F.round("w.confidence", 6).alias("confidence"), F.col("w.member").alias("member"))


@query("speech_triggers", "SELECT id, node_id FROM {detections} WHERE label_category = 'human' AND label_confidence >= 0.35")
def _(v):
    return v.detections.where("label_category = 'human' and label_confidence >= 0.35").select("id", "node_id")


@query("observation_merges", "SELECT track_id, count(DISTINCT o.observation_id) AS observations, count(DISTINCT d.node_id) AS nodes FROM {detections} d JOIN {observations} o ON o.detection_id = d.id WHERE d.track_id IS NOT NULL GROUP BY track_id HAVING count(DISTINCT d.node_id) >= 2")
def _(v):
    rows = v.observations.select("observation_id", F.col("detection_id").alias("id")).join(v.detections.where("track_id is not null").select("id", "track_id", "node_id"), "id")
    return rows.groupBy("track_id").agg(F.countDistinct("observation_id").alias("observations"), F.countDistinct("node_id").alias("nodes")).where("nodes >= 2")
