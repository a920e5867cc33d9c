"""Array operators over sample vectors and fingerprints."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import arrays, assignment, buffers, sampling, signal, tdoa, trackfold, tracking
from . import query
from .measures import placed


@query("fingerprint_norms", "SELECT vec_id, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 5) AS norm, round(list_sum(list_transform(embedding, lambda x: x::DOUBLE)), 5) AS total FROM embeddings")
def _(v):
    x = F.transform("embedding", lambda e: e.cast("double"))
    add = lambda a, b: a + b
    return v.raw("embeddings").select("vec_id", F.round(F.sqrt(F.aggregate(F.transform(x, lambda e: e * e), F.lit(0.0), add)), 5).alias("norm"), F.round(F.aggregate(x, F.lit(0.0), add), 5).alias("total"))


@query(
    "fingerprint_similarity",
    "WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings), c AS (SELECT label, i, avg(x) AS m FROM e GROUP BY ALL), p AS (SELECT a.label AS a, b.label AS b, sum(a.m * b.m) AS dot FROM c a JOIN c b ON a.i = b.i GROUP BY ALL) SELECT p.a, p.b, round(p.dot / sqrt(x.dot * y.dot), 5) AS cosine FROM p JOIN p x ON x.a = p.a AND x.b = p.a JOIN p y ON y.a = p.b AND y.b = p.b WHERE p.a < p.b",
)
def _(v):
    parts = v.raw("embeddings").select("label", F.posexplode("embedding").alias("i", "x")).groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    dots = parts.select(F.col("label").alias("a"), "i", F.col("m").alias("ma")).join(parts.select(F.col("label").alias("b"), "i", F.col("m").alias("mb")), "i").groupBy("a", "b").agg(F.sum(F.col("ma") * F.col("mb")).alias("dot"))
    own = dots.where("a = b").select("a", F.col("dot").alias("own"))
    rows = dots.where("a < b").join(own, "a").join(own.toDF("b", "other"), "b")
    return rows.select("a", "b", F.round(F.col("dot") / F.sqrt(F.col("own") * F.col("other")), 5).alias("cosine"))


@query("vector_rms", "SELECT vec_id, round(sqrt(list_avg(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE)) + 1e-12), 6) AS rms, list_max(list_transform(embedding, lambda x: abs(x)))::DOUBLE AS peak FROM embeddings")
def _(v):
    return v.raw("embeddings").select("vec_id", F.round(signal.rms(F.col("embedding")), 6).alias("rms"), F.array_max(F.transform("embedding", lambda x: F.abs(x))).cast("double").alias("peak"))


@query("spectral_features")
def _(v):
    return signal.spectral_features(v.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("samples")), sample_rate_hz=16_000)


@query("pair_delays")
def _(v):
    rows = v.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("a"), F.concat(F.slice("embedding", 4, 61), F.slice("embedding", 1, 3)).alias("b"))
    return signal.gcc_phat(rows, sample_rate_hz=16_000, max_tau_s=0.001)


@query("kalman_tracks")
def _(v):
    rows = v.detections.where("track_id is not null and reporting_modality = 'localized'").select("track_id", "id", "timestamp_ns", ((F.col("lon") + 93.2565) * 78700.0).alias("x"), ((F.col("lat") - 44.98) * 111320.0).alias("y"))
    return tracking.kalman_smooth(rows)


@query("tdoa_fixes")
def _(v):
    """Places of localized detections from the arrival times at their sensors, which their own places and some microseconds of
    jitter give."""
    at = v.nodes.select(F.col("id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"), (F.col("z") * 3).alias("nz"))
    true = placed(v).where("reporting_modality = 'localized'").select(F.col("id").alias("detection_id"), "x", "y", "z")
    heard = v.observations.join(at, "node_id").join(true, "detection_id")
    far = F.sqrt((F.col("x") - F.col("nx")) ** 2 + (F.col("y") - F.col("ny")) ** 2 + (F.col("z") - F.col("nz")) ** 2)
    sensor = F.struct("channel", "nx", "ny", "nz", (far / 343.0 + (F.col("observation_id") * 37 % 100 - 50) * 1e-7).alias("t"))
    listed = heard.groupBy("detection_id").agg(F.array_sort(F.collect_list(sensor)).alias("s"))
    pair = lambda a, b: F.struct(a["nx"].alias("ax"), a["ny"].alias("ay"), a["nz"].alias("az"), b["nx"].alias("bx"), b["ny"].alias("by"), b["nz"].alias("bz"), (a["t"] - b["t"]).alias("tau_s"), F.lit(1.0).alias("weight"), F.lit(0.9).alias("peak"))
    every = F.flatten(F.transform("s", lambda a: F.transform(F.filter("s", lambda b: a["channel"] < b["channel"]), lambda b: pair(a, b))))  # six pairs of an event's four channels
    rows = listed.select("detection_id", every.alias("pairs")).where(F.size("pairs") > 0)
    return tdoa.solve_rows(rows.select("detection_id", "pairs", F.lit(343.0).alias("speed"), F.lit(None).cast("double").alias("z")), "detection_id")


@query("site_tracks")
def _(v):
    """Tracks of each site (a cluster of nodes) from its localized detections."""
    sites = v.nodes.select(F.col("id").alias("node_id"), F.col("cluster_id").alias("site"))
    rows = placed(v).where("reporting_modality = 'localized'").join(sites, "node_id")
    scores = F.create_map(F.col("label"), F.col("label_confidence"))
    return trackfold.fold_batch(rows.select("site", "id", "timestamp_ns", "x", "y", "label", F.col("label_category").alias("category"), F.col("label_confidence").alias("confidence"), "node_id", scores.alias("scores")))


@query("peer_assignments")
def _(v):
    """One-to-one pairs of the tracks of two sites, by the last place of each: localized reports are ours, omni reports the peer's."""
    rows = placed(v).where("track_id is not null")
    last = rows.groupBy("track_id", "reporting_modality").agg(F.max(F.struct("timestamp_ns", "id", "x", "y")).alias("m"))
    last = last.select(F.lit(0).alias("tick"), "track_id", "reporting_modality", F.col("m.x").alias("x"), F.col("m.y").alias("y"), (1 + F.col("m.id") % 20).cast("double").alias("cxx"), F.lit(0.0).alias("cxy"), (1 + F.col("m.id") % 30).cast("double").alias("cyy"))
    ours = last.where("reporting_modality = 'localized'").withColumnRenamed("track_id", "l").drop("reporting_modality")
    theirs = last.where("reporting_modality = 'omni'").withColumnRenamed("track_id", "r").drop("reporting_modality")
    return assignment.assigned(assignment.gated_pairs(ours, theirs, ["tick"], 3.0), ["tick"], 3.0)


@query("node_positions_kde")
def _(v):
    rows = v.detections.select("node_id", ((F.col("lon") + 93.2565) * 78700.0).alias("x"), ((F.col("lat") - 44.98) * 111320.0).alias("y"))
    return tracking.kde_mode(rows, bandwidth_m=25.0)


#: Frames of 64 samples from eight sensors: every eleventh is lost, every seventh overlaps the one before by 16 samples, some
#: come late, and sensor 3 begins a new epoch far ahead.
_SENSOR_FRAMES_SQL = "SELECT vec_id % 8 AS sensor, vec_id // 8 AS k, CASE WHEN vec_id % 5 = 0 AND NOT (vec_id % 8 = 3 AND vec_id // 8 BETWEEN 30 AND 45) THEN vec_id + 20 ELSE vec_id END * 1000 + vec_id AS received_ns, (vec_id // 8) * 64 - CASE WHEN (vec_id // 8) % 7 = 3 THEN 16 ELSE 0 END + CASE WHEN vec_id % 8 = 3 AND vec_id // 8 >= 40 THEN 100000 ELSE 0 END AS first, embedding FROM embeddings WHERE (vec_id // 8) % 11 <> 5"
_EPOCH_SQL = "CASE WHEN sensor = 3 AND first >= 100000 THEN 2 ELSE 1 END"


def _sensor_frames(v):
    i, k = F.col("vec_id"), F.expr("vec_id div 8")
    first = k * 64 - F.when(k % 7 == 3, 16).otherwise(0) + F.when((i % 8 == 3) & (k >= 40), 100000).otherwise(0)
    late = F.when((i % 5 == 0) & ~((i % 8 == 3) & k.between(30, 45)), i + 20).otherwise(i) * 1000 + i
    rows = v.raw("embeddings").where(k % 11 != 5).select((i % 8).alias("sensor"), late.alias("received_ns"), (first * 62500).alias("start_ns"), first.alias("start_index"), F.col("embedding").alias("samples"))
    return buffers.placed_frames(rows, rate=16_000, most_s=2.0)


@query("buffer_coverage", f"WITH f AS ({_SENSOR_FRAMES_SQL}), e AS (SELECT sensor, {_EPOCH_SQL} AS epoch, first, first + len(embedding) AS stop FROM f), g AS (SELECT *, CASE WHEN first <= max(stop) OVER (PARTITION BY sensor, epoch ORDER BY first, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM e), h AS (SELECT *, sum(fresh) OVER (PARTITION BY sensor, epoch ORDER BY first, stop) AS island FROM g) SELECT sensor, epoch::BIGINT AS epoch, min(first) AS first, max(stop) AS end FROM h GROUP BY sensor, epoch, island")
def _(v):
    return buffers.coverage(_sensor_frames(v), bucket=512)


_WINDOWS_SQL = f"WITH f AS ({_SENSOR_FRAMES_SQL}), r AS (SELECT sensor, {_EPOCH_SQL} AS epoch, received_ns, unnest(embedding)::DOUBLE AS x, first + generate_subscripts(embedding, 1) - 1 AS pos FROM f), s AS (SELECT sensor, epoch, pos, arg_max(x, received_ns) AS x FROM r GROUP BY ALL)"


@query("buffer_windows", f"{_WINDOWS_SQL} SELECT sensor, epoch::BIGINT AS epoch, pos // 100 AS window, count(*) AS covered, round(sum(x * x), 5) AS energy FROM s GROUP BY ALL")
def _(v):
    """Windows of 100 samples over all that is covered."""
    filled = _filled(v)
    energy = F.aggregate(F.transform("samples", lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    return filled.select("sensor", "epoch", "window", "covered", F.round(energy, 5).alias("energy"))


def _filled(v):
    placed = _sensor_frames(v)
    wanted = placed.select("sensor", "epoch", F.explode(F.sequence(F.floor(F.col("first") / 100), F.floor((F.col("end") - 1) / 100))).alias("window")).distinct()
    return buffers.windows(placed, wanted.withColumn("first", F.col("window") * 100).withColumn("end", F.col("first") + 100), bucket=256)


@query("synchronized_windows", f"{_WINDOWS_SQL} SELECT w AS \"window\", count(*) AS sensors FROM (SELECT sensor, epoch, pos // 100 AS w, count(*) AS n FROM s GROUP BY ALL) WHERE n >= 90 GROUP BY w HAVING count(DISTINCT sensor) >= 6")
def _(v):
    return buffers.synchronized(_filled(v), 6, 0.9).groupBy("window").agg(F.count("*").alias("sensors"))


@query("sensor_summaries", f"WITH f AS ({_SENSOR_FRAMES_SQL}), e AS (SELECT sensor, {_EPOCH_SQL} AS epoch, first, first + len(embedding) AS stop, received_ns FROM f), g AS (SELECT *, CASE WHEN first <= max(stop) OVER (PARTITION BY sensor, epoch ORDER BY first, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 0 ELSE 1 END AS fresh FROM e), h AS (SELECT *, sum(fresh) OVER (PARTITION BY sensor, epoch ORDER BY first, stop) AS island FROM g), i AS (SELECT sensor, epoch, min(first) AS a, max(stop) AS b FROM h GROUP BY sensor, epoch, island), c AS (SELECT sensor, epoch, sum(b - a) AS covered, count(*) - 1 AS holes, max(b) - min(a) AS span FROM i GROUP BY ALL) SELECT sensor, count(*) AS epochs, (SELECT count(*) FROM f WHERE f.sensor = c.sensor) AS frames, sum(covered)::BIGINT AS covered, sum(holes)::BIGINT AS holes, sum(span)::BIGINT AS span FROM c GROUP BY sensor")
def _(v):
    return buffers.sensor_summaries(_sensor_frames(v), _filled(v)).select("sensor", "epochs", "frames", "covered", "holes", "span")


#: Four sensors in a small array (metres), the point that is listened to, and their windows: a vector shifted by a sample each.
_PLACES = ((-0.02, 0.03, 0.0), (0.03, 0.0, 0.0), (-0.02, -0.03, 0.0), (0.0, 0.0, 0.04))
_AIM = (3.0, 4.0, 1.0)


def _array_rows(v):
    sensors = [F.struct(*[F.lit(c).alias(n) for c, n in zip(p, "xyz", strict=True)], F.slice("embedding", k + 1, 60).alias("samples")) for k, p in enumerate(_PLACES)]
    point = [F.lit(c).alias(n) for c, n in zip(_AIM, ("sx", "sy", "sz"), strict=True)]
    return v.raw("embeddings").select(F.col("vec_id").alias("id"), F.lit(16_000).alias("rate"), F.lit(343.2).alias("speed"), F.array(*sensors).alias("sensors"), *point)


@query("array_bearings")
def _(v):
    return arrays.bearings(_array_rows(v), "subspace")


@query("array_phase_bearings")
def _(v):
    return arrays.bearings(_array_rows(v), "phase")


_BEAM_SQL = f"""WITH s(c, x, y, z) AS (VALUES {", ".join(f"({k}, {x}::DOUBLE, {y}::DOUBLE, {z}::DOUBLE)" for k, (x, y, z) in enumerate(_PLACES))}),
    d AS (SELECT c, sqrt((x - {_AIM[0]}) ** 2 + (y - {_AIM[1]}) ** 2 + (z - {_AIM[2]}) ** 2) / 343.2::DOUBLE * 16000 AS far FROM s),
    l AS (SELECT c, far - (SELECT min(far) FROM d) AS lag FROM d),
    p AS (SELECT c, j, j + lag AS pos, floor(j + lag)::INT AS low FROM l, (SELECT unnest(range(60)) AS j)),
    y AS (SELECT vec_id, j, sum(CASE WHEN pos > 59 THEN 0 ELSE embedding[c + 1 + low]::DOUBLE + (pos - low) * (embedding[c + 1 + least(low + 1, 59)]::DOUBLE - embedding[c + 1 + low]::DOUBLE) END) / 4 AS y FROM embeddings, p GROUP BY ALL)
    SELECT vec_id AS id, round(sqrt(avg(y * y)), 6) AS rms FROM y GROUP BY vec_id"""


@query("array_beams", _BEAM_SQL)
def _(v):
    return arrays.beams(_array_rows(v), "delay_sum").select("id", F.round("rms", 6).alias("rms"))


@query("array_beam_levels")
def _(v):
    """Levels of the beams of each form."""
    rows = _array_rows(v)
    forms = [arrays.beams(rows, m).select("id", F.lit(m).alias("form"), F.round("rms", 6).alias("rms")) for m in arrays.BEAMS]
    return forms[0].unionByName(forms[1]).unionByName(forms[2]).unionByName(forms[3])


@query("node_reservoirs", "SELECT node_id, id, n AS place, lat, lon FROM (SELECT node_id, id, lat, lon, row_number() OVER (PARTITION BY node_id ORDER BY md5(concat('site:', id)), id) AS n FROM {detections}) WHERE n <= 32")
def _(v):
    rows = v.detections.select("id", "node_id", "lat", "lon")
    return sampling.reservoirs(rows, ["node_id"], 32, seed="site").select("node_id", "id", "place", "row.lat", "row.lon")
