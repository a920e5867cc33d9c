"""Derived values of single rows: places and angles, levels and ranges, scores, gates, names."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo, physics, scoring, text
from ..operators.timeline import running
from ..sources.views import NOW_NS, SECOND
from . import query

#: Metres east and north of the middle of the site, and up, of a detection; the same in SQL.
EAST, NORTH, UP = ("(lon + 93.2565) * 78846.0", "(lat - 44.98) * 111131.0", "(id % 40) / 10.0")
_XYZ_SQL = f"SELECT *, {EAST} AS x, {NORTH} AS y, (id % 40) / 10.0::DOUBLE AS z FROM {{detections}}"


def placed(v):
    return v.detections.withColumn("x", (F.col("lon") + 93.2565) * 78846.0).withColumn("y", (F.col("lat") - 44.98) * 111131.0).withColumn("z", (F.col("id") % 40) / F.lit(10.0))


@query("geo_positions", "SELECT id, round(44.98 + y / (111132.92 - 559.82 * cos(2 * radians(44.98)) + 1.175 * cos(4 * radians(44.98))), 8) AS lat, round(-93.2565 + x / (111412.84 * cos(radians(44.98)) - 93.5 * cos(3 * radians(44.98))), 8) AS lon FROM (" + _XYZ_SQL + ")")
def _(v):
    lat, lon = geo.to_geo_flat(F.col("x"), F.col("y"), 44.98, -93.2565)
    return placed(v).select("id", F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"))


@query("lla_round_trip", "SELECT id, round(lat, 7) AS lat, round(lon, 7) AS lon, round((id % 90)::DOUBLE, 3) AS alt FROM {detections}")
def _(v):
    alt = (F.col("id") % 90).cast("double")
    rows = v.detections.select("id", *[c.alias(n) for c, n in zip(geo.to_ecef(F.col("lat"), F.col("lon"), alt), "xyz", strict=True)])
    lat, lon, up = geo.to_lla(F.col("x"), F.col("y"), F.col("z"))
    return rows.select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"), (F.round(up, 3) + 0.0).alias("alt"))


@query("error_ellipses", "SELECT id, round(sqrt(m + h), 6) AS major, round(sqrt(greatest(m - h, 0)), 6) AS minor, round(degrees(atan2(xy, m + h - xx)), 4) AS bearing FROM (SELECT *, (xx + yy) / 2 AS m, sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS h FROM (SELECT id, 1 + (id % 7)::DOUBLE AS xx, 1 + (id % 5)::DOUBLE AS yy, 0.3::DOUBLE + (id % 3)::DOUBLE / 10 AS xy FROM {detections}))")
def _(v):
    i = F.col("id")
    major, minor, bearing = geo.ellipse(1 + (i % 7).cast("double"), F.lit(0.3) + (i % 3).cast("double") / 10, 1 + (i % 5).cast("double"))
    return v.detections.select("id", F.round(major, 6).alias("major"), F.round(minor, 6).alias("minor"), F.round(bearing, 4).alias("bearing"))


_WRAP = "(((({}) + 180) % 360 + 360) % 360 - 180)"


@query(
    "camera_aims",
    f"SELECT id, round({_WRAP.format('degrees(atan2(dx, dy)) - 30')}, 5) AS pan, round(greatest(least(degrees(atan2(dz, sqrt(dx * dx + dy * dy))) - 5, 90), -90), 5) AS tilt, round(degrees(atan2(dy, dx)), 5) AS azimuth, round(degrees(asin(dz / sqrt(dx * dx + dy * dy + dz * dz))), 5) AS elevation, round(sqrt(dx * dx + dy * dy + dz * dz), 5) AS distance FROM (SELECT id, x - 10.5 AS dx, y - 20.25 AS dy, z - 3.05 AS dz FROM ({_XYZ_SQL}))",
)
def _(v):
    dx, dy, dz = F.col("x") - 10.5, F.col("y") - 20.25, F.col("z") - 3.05
    pan, tilt = geo.pan_tilt(dx, dy, dz, 30.0, 5.0)
    values = zip((pan, tilt, *geo.spherical(dx, dy, dz)), ("pan", "tilt", "azimuth", "elevation", "distance"), strict=True)
    return placed(v).select("id", *[F.round(c, 5).alias(n) for c, n in values])


@query("bearing_differences", "SELECT id, abs(((a - b + 180) % 360 + 360) % 360 - 180) AS difference FROM (SELECT id, (id * 37 % 360)::DOUBLE AS a, (id * 91 % 720)::DOUBLE AS b FROM {detections})")
def _(v):
    return v.detections.select("id", geo.angle_difference((F.col("id") * 37 % 360).cast("double"), (F.col("id") * 91 % 720).cast("double")).alias("difference"))


@query("received_levels", "SELECT id, round(level, 6) AS level, round(least(greatest(power(10.0, (94.0 - level) / 20.0), 1.0), 800.0), 6) AS range_m, (power(10.0, (94.0 - level) / 20.0) < 1.0 OR power(10.0, (94.0 - level) / 20.0) > 800.0) AS clamped FROM (SELECT id, 20.0 * log10(greatest(value / 1000.0, 1e-9)) + 70.0 AS level FROM {detections})")
def _(v):
    level = physics.level_db(F.col("value") / 1000.0, 70.0)
    range_m, clamped = physics.amplitude_range(F.col("level"), 94.0, 1.0, 800.0)
    return v.detections.select("id", level.alias("level")).select("id", F.round("level", 6).alias("level"), F.round(range_m, 6).alias("range_m"), clamped.alias("clamped"))


_MODE = "CASE id % 6 WHEN 0 THEN 'range_refined' WHEN 1 THEN 'range_asymptotic' WHEN 2 THEN 'bounded_grid_boundary' WHEN 3 THEN 'range_bearing_projected' WHEN 4 THEN 'prior_projected' END"
_OBSERVED = "CASE WHEN id % 4 = 0 THEN NULL ELSE (id % 30) / 100.0 END"


@query("range_haircuts", f"SELECT id, coalesce(m, '') AS mode, round(CASE WHEN m IN ('range_asymptotic', 'range_boundary') THEN least(label_confidence, 0.2) WHEN m = 'range_bearing_projected' THEN least(label_confidence, 0.85) ELSE label_confidence END, 6) AS confidence, round(CASE WHEN o IS NULL THEN NULL WHEN m IN ('range_asymptotic', 'range_boundary', 'range_bearing_projected') THEN least(o, 0.05) ELSE o END, 6)::DOUBLE AS observability FROM (SELECT id, label_confidence, {_OBSERVED.replace('100.0', '100.0::DOUBLE')} AS o, CASE id % 6 WHEN 0 THEN 'range_refined' WHEN 1 THEN 'range_asymptotic' WHEN 2 THEN 'range_boundary' WHEN 3 THEN 'range_bearing_projected' WHEN 4 THEN 'range_asymptotic' END AS m FROM {{detections}})")
def _(v):
    rows = v.detections.withColumn("m", F.expr(_MODE)).withColumn("o", F.when(F.col("id") % 4 != 0, (F.col("id") % 30) / F.lit(100.0)))
    confidence, observed = scoring.haircut(F.col("m"), F.col("label_confidence"), F.col("o"))
    return rows.select("id", F.coalesce(scoring.range_mode(F.col("m")), F.lit("")).alias("mode"), F.round(confidence, 6).alias("confidence"), F.round(observed, 6).alias("observability"))


@query("spatial_modes", f"SELECT id, CASE WHEN reporting_modality = 'omni' THEN 'node_only' WHEN m IN ('range_asymptotic', 'range_boundary') THEN 'bearing_only' WHEN m = 'range_bearing_projected' THEN 'localized' WHEN o <= 0.1 THEN 'bearing_only' ELSE 'localized' END AS mode FROM (SELECT id, reporting_modality, {_MODE} AS m, {_OBSERVED} AS o FROM {{detections}})")
def _(v):
    rows = v.detections.withColumn("m", F.expr(_MODE)).withColumn("o", F.when(F.col("id") % 4 != 0, (F.col("id") % 30) / F.lit(100.0)))
    return rows.select("id", scoring.display_mode(F.col("reporting_modality"), F.col("m"), F.col("o")).alias("mode"))


@query("detection_tiers", "SELECT id, CASE WHEN id % 11 = 0 THEN 'ephemeral' WHEN lower(trim(label)) IN ('purchase') THEN 'permanent' WHEN label_category = 'security' AND label_confidence >= 0.8 THEN 'long' ELSE 'short' END AS tier FROM {detections}")
def _(v):
    tier = scoring.retention_tier(F.col("label"), F.col("label_category"), F.col("label_confidence"), F.col("id") % 11 == 0, ("purchase",), 0.8)
    return v.detections.select("id", tier.alias("tier"))


@query("unknown_dropped", "SELECT id FROM (SELECT id, CASE WHEN id % 4 = 0 THEN 'unknown' ELSE label END AS label, CASE WHEN id % 8 = 0 THEN 0.0::DOUBLE ELSE label_confidence END AS c FROM {detections}) WHERE NOT (label = 'unknown' AND c = 0)")
def _(v):
    rows = v.detections.select("id", F.when(F.col("id") % 4 == 0, "unknown").otherwise(F.col("label")).alias("label"), F.when(F.col("id") % 8 == 0, 0.0).otherwise(F.col("label_confidence")).alias("c"))
    return rows.where(~((F.col("label") == "unknown") & (F.col("c") == 0))).select("id")


_DISTANCE = "sqrt(x * x + y * y + z * z)"
_TIER = "CASE id % 5 WHEN 0 THEN 'full_3d' WHEN 1 THEN '2d' WHEN 2 THEN 'Classification_Only' WHEN 3 THEN 'alerting_only' END"


@query(
    "significance",
    f"""SELECT id, round(s, 6) AS significance, round_even(s * 10.0, 0)::INT AS bucket, dense_rank() OVER (ORDER BY round_even(s * 10.0, 0) DESC) AS rank FROM (SELECT id, least(greatest(CASE WHEN id % 9 = 0 THEN 0.5 * t ELSE t END, 0), 1) AS s FROM (
    SELECT id, 0.35::DOUBLE * least(greatest(1.0::DOUBLE - {_DISTANCE} / 250.0::DOUBLE, 0), 1) + 0.25::DOUBLE * least(greatest(label_confidence, 0), 1) + 0.15::DOUBLE * CASE id % 5 WHEN 0 THEN 1.0::DOUBLE WHEN 1 THEN 0.6::DOUBLE WHEN 2 THEN 0.3::DOUBLE WHEN 3 THEN 0.1::DOUBLE ELSE 0.3::DOUBLE END
    + 0.15::DOUBLE * least(greatest(20.0::DOUBLE * log10(greatest(value, 1e-9) / 20.0::DOUBLE) / 18.0::DOUBLE, 0), 1) + 0.1::DOUBLE * least(greatest((id % 6 - 1) / 3.0::DOUBLE, 0), 1) AS t FROM ({_XYZ_SQL})))""",
)
def _(v):
    i, far = F.col("id"), F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    score = scoring.significance(far, F.col("label_confidence"), F.expr(_TIER), F.col("value"), F.lit(20.0), i % 6, i % 9 == 0, 250.0)
    rows = placed(v).select("id", score.alias("s")).withColumn("bucket", scoring.priority_bucket(F.col("s")))
    # eleven buckets at most: ranked by a table of their own
    rank = rows.select("bucket").distinct()
    above = rank.join(rank.withColumnRenamed("bucket", "b"), F.col("b") > F.col("bucket"), "left").groupBy("bucket").agg((F.count("b") + 1).alias("rank"))
    return rows.join(above, "bucket").select("id", F.round("s", 6).alias("significance"), "bucket", "rank")


@query("track_qualities", f"SELECT track_id, round(least(greatest(0.3::DOUBLE * 0.5 + 0.3::DOUBLE * greatest(least(update_count / 5.0::DOUBLE, 1), least(greatest(track_id % 3 - 1, 0) / 1.0::DOUBLE, 1)) + 0.2::DOUBLE / (1 + ({NOW_NS} - last_seen_ns) / 1e9 / 30.0) + 0.2::DOUBLE * least(track_id % 6 / 4.0::DOUBLE, 1), 0), 1), 6) AS tqi FROM {{tracks}}")
def _(v):
    idle = (F.lit(NOW_NS) - F.col("last_seen_ns")) / F.lit(1e9)
    return v.tracks.select("track_id", F.round(scoring.track_quality(F.lit(0.5), F.col("update_count"), idle, F.col("track_id") % 6, F.col("track_id") % 3), 6).alias("tqi"))


@query("sync_weights", "SELECT id, CASE id % 5 WHEN 0 THEN 'gps_pps' WHEN 1 THEN 'gps_pps' WHEN 2 THEN 'ntp' WHEN 3 THEN 'ntp' ELSE 'free' END AS grade, CASE id % 5 WHEN 0 THEN 1.0 WHEN 1 THEN 1.0 WHEN 2 THEN 0.25 WHEN 3 THEN 0.25 ELSE 0.05 END::DOUBLE AS weight FROM {nodes}")
def _(v):
    quality = F.expr("CASE id % 5 WHEN 0 THEN 'gps_locked' WHEN 1 THEN 'gps_holdover' WHEN 2 THEN 'ntp_disciplined' WHEN 3 THEN 'ntp_sync' ELSE 'free_running' END")
    grade = scoring.looked_up(quality, scoring.SYNC_GRADES, "free")
    return v.nodes.select("id", grade.alias("grade"), scoring.looked_up(grade, scoring.SYNC_WEIGHTS, 0.05).alias("weight"))


@query("reportable_positions", f"SELECT id FROM ({_XYZ_SQL}) WHERE {_DISTANCE} <= 600 AND sqrt((x - 50) * (x - 50) + (y - 50) * (y - 50) + z * z) <= 300")
def _(v):
    ok = scoring.reportable(F.col("x"), F.col("y"), F.col("z"), F.lit(50.0), F.lit(50.0), F.lit(0.0), 300.0, 600.0)
    return placed(v).where(ok).select("id")


@query("quality_gates", "SELECT id, CASE WHEN id % 13 = 0 OR id % 50 > 20 THEN 'gdop_above_ceiling' WHEN label_confidence < 0.15 THEN 'low_localization_confidence' ELSE '' END AS reason FROM {detections}")
def _(v):
    gdop = F.when(F.col("id") % 13 == 0, float("inf")).otherwise((F.col("id") % 50).cast("double"))
    reason = F.when(~(gdop <= 20.0), "gdop_above_ceiling").when(F.col("label_confidence") < 0.15, "low_localization_confidence").otherwise("")
    return v.detections.select("id", reason.alias("reason"))


@query(
    "ingest_verdicts",
    "SELECT l_orderkey AS id, l_linenumber::BIGINT AS line, CASE WHEN l_linenumber = 7 AND l_linestatus = 'O' THEN 'NODE_RESTARTED' WHEN l_orderkey % 17 = 0 OR l_quantity >= 47 THEN 'LOSSY_RATE_LIMITED' WHEN l_orderkey % 19 = 0 OR -40 - l_quantity <= -75 THEN 'LOSSY_WIFI' WHEN l_partkey % 5 = 0 THEN 'SERVER_GAP_ONLY' ELSE 'HEALTHY' END AS verdict FROM lineitem",
)
def _(v):
    r = v.raw("lineitem")
    verdict = scoring.ingest_verdict((F.col("l_linenumber") == 7) & (F.col("l_linestatus") == "O"), F.when(F.col("l_orderkey") % 17 == 0, 1).otherwise(0), F.col("l_quantity"), F.lit(50), F.when(F.col("l_orderkey") % 19 == 0, 2).otherwise(0), F.lit(-40) - F.col("l_quantity"), F.when(F.col("l_partkey") % 5 == 0, 3).otherwise(0))
    return r.select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").cast("long").alias("line"), verdict.alias("verdict"))


@query("peer_links", f"SELECT id, CASE WHEN id % 7 = 0 THEN 'offline' WHEN age <= 30 AND id % 3 <= 1 THEN 'active' WHEN age <= 60 THEN 'degraded' ELSE 'offline' END AS state FROM (SELECT id, ({NOW_NS} - last_seen_ns) / 1e9 AS age FROM {{nodes}})")
def _(v):
    age = F.when(F.col("id") % 7 != 0, (F.lit(NOW_NS) - F.col("last_seen_ns")) / F.lit(1e9))
    return v.nodes.select("id", scoring.link_state(age, F.col("id") % 3, 30.0).alias("state"))


@query(
    "heuristic_labels",
    """SELECT id, CASE WHEN quiet THEN 'ambient' WHEN best = 0 THEN 'unknown' WHEN bird = best THEN 'bird_like' WHEN speech = best THEN 'speech_like' WHEN impulse = best THEN 'impulse' WHEN hum = best THEN 'machine_hum' ELSE 'unknown' END AS label, round(CASE WHEN quiet THEN 0.95::DOUBLE WHEN best < 0.2 THEN 0.6::DOUBLE ELSE best END, 6) AS confidence FROM (SELECT *, greatest(impulse, bird, speech, hum) AS best FROM (SELECT id, rms < 0.01 AS quiet,
    CASE WHEN crest > 10 AND bw > 1200 THEN least(0.95::DOUBLE, 0.35::DOUBLE + crest / 25.0::DOUBLE) ELSE 0 END AS impulse, CASE WHEN centroid > 2200 AND zcr > 0.12::DOUBLE THEN least(0.95::DOUBLE, 0.25::DOUBLE + centroid / 8000.0::DOUBLE) ELSE 0 END AS bird,
    CASE WHEN centroid > 200 AND centroid < 2200 AND zcr > 0.04::DOUBLE AND zcr < 0.2::DOUBLE AND flat < 0.75::DOUBLE THEN least(0.9::DOUBLE, 0.25::DOUBLE + (1 - abs(centroid - 1000) / 1200.0::DOUBLE)) ELSE 0 END AS speech, CASE WHEN centroid < 450 AND flat < 0.55::DOUBLE THEN least(0.9::DOUBLE, 0.3::DOUBLE + (450 - centroid) / 700.0::DOUBLE) ELSE 0 END AS hum
    FROM (SELECT id, value / 5000.0 AS rms, (id * 31 % 4000)::DOUBLE AS centroid, (id % 16)::DOUBLE AS crest, (id % 30) / 100.0::DOUBLE AS zcr, (id % 90) / 100.0::DOUBLE AS flat, (id * 13 % 3000)::DOUBLE AS bw FROM {detections})))""",
)
def _(v):
    i = F.col("id")
    scores = scoring.heuristic_scores(F.col("value") / 5000.0, (i * 31 % 4000).cast("double"), (i % 16).cast("double"), (i % 30) / F.lit(100.0), (i % 90) / F.lit(100.0), (i * 13 % 3000).cast("double"))
    names = ("ambient", "bird_like", "speech_like", "impulse", "machine_hum", "unknown")
    rows = v.detections.select("id", scores.alias("s")).select("id", *[F.col("s")[n].alias(n) for n in names])
    best = F.greatest(*names)
    label = F.lit(names[-1])
    for n in reversed(names[:-1]):
        label = F.when(F.col(n) == best, n).otherwise(label)
    return rows.select("id", label.alias("label"), F.round(best, 6).alias("confidence"))


@query("topic_slugs", "SELECT p_partkey AS id, CASE WHEN s = '' THEN 'x_' || h WHEN length(s) <= 12 THEN s ELSE rtrim(left(s, 5), '_') || '_' || h END AS slug FROM (SELECT p_partkey, trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9_]+', '_', 'g'), '_') AS s, left(sha1(p_name), 6) AS h FROM part)")
def _(v):
    return v.raw("part").select(F.col("p_partkey").alias("id"), text.topic_slug(F.col("p_name"), most=12).alias("slug"))


@query("device_addresses", "SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN lower(trim(c_name)) ELSE array_to_string([substr(lpad(hex(c_custkey * 7919), 12, '0').lower(), i, 2) FOR i IN [1, 3, 5, 7, 9, 11]], ':') END AS mac FROM customer")
def _(v):
    c = F.col("c_custkey")
    raw = F.when(c % 3 == 0, F.col("c_name")).when(c % 3 == 1, F.lpad(F.hex(c * 7919), 12, "0")).otherwise(F.regexp_replace(F.lpad(F.hex(c * 7919), 12, "0"), "(..)", "$1-"))
    return v.raw("customer").select(c.alias("id"), text.mac(raw).alias("mac"))


@query("common_names", "SELECT p_partkey AS id, lower(trim(CASE WHEN p_partkey % 4 = 0 THEN p_name ELSE p_type || '_x' END)) AS name FROM part")
def _(v):
    raw = F.when(F.col("p_partkey") % 4 == 0, F.col("p_name")).otherwise(F.concat(F.lit("Genus species_"), F.col("p_type"), F.lit("_x ")))
    return v.raw("part").select(F.col("p_partkey").alias("id"), text.common_name(raw).alias("name"))


_WORDS_SQL = "CASE " + " ".join(f"WHEN regexp_matches(n, '{'|'.join(words)}') THEN '{name}'" for name, words in text.CATEGORY_WORDS.items()) + " ELSE 'unknown' END"


@query("label_categories", f"SELECT id, canonical, coalesce(m, {_WORDS_SQL}) AS category, CASE coalesce(m, {_WORDS_SQL}) WHEN 'human' THEN 'neutral' WHEN 'vehicle' THEN 'suspect' ELSE 'unknown' END AS iff FROM (SELECT doc_id AS id, lower(trim(text)) AS n, CASE lang WHEN 'en' THEN 'english' ELSE lang END AS canonical, CASE WHEN lang = 'de' THEN 'vehicle' END AS m FROM documents)")
def _(v):
    """Aliases, then a map, then the words of the name; the category's side."""
    rows = v.raw("documents").select(F.col("doc_id").alias("id"), F.trim("text").alias("n"), scoring.looked_up(F.col("lang"), {"en": "english"}, None).cast("string").alias("alias"), "lang")
    category = F.coalesce(scoring.looked_up(F.col("lang"), {"de": "vehicle"}, None).cast("string"), text.category_of(F.col("n")))
    return rows.select("id", F.coalesce("alias", "lang").alias("canonical"), category.alias("category"), scoring.looked_up(category, {"human": "neutral", "vehicle": "suspect"}, "unknown").alias("iff"))


@query("decoded_props", "SELECT event_id AS id, CASE WHEN event_id % 10 = 0 THEN -1 ELSE coalesce(try_cast(json_extract_string(props, '$.k') AS BIGINT), -1) END AS k FROM events")
def _(v):
    raw = F.when(F.col("event_id") % 10 == 0, F.lit("{broken")).otherwise(F.col("props"))
    return v.raw("events").select(F.col("event_id").alias("id"), F.coalesce(F.from_json(raw, "k long")["k"], F.lit(-1)).alias("k"))


@query("stage_lags", f"SELECT node_id, round(greatest({NOW_NS} - min(timestamp_ns), 0) / 1e9, 3) AS seconds_behind FROM {{detections}} WHERE review_state = 'unreviewed' GROUP BY node_id")
def _(v):
    open_ = v.detections.where("review_state = 'unreviewed'").groupBy("node_id").agg(F.min("timestamp_ns").alias("oldest"))
    return open_.select("node_id", F.round(F.greatest(F.lit(NOW_NS) - F.col("oldest"), F.lit(0)) / F.lit(1e9), 3).alias("seconds_behind"))


@query("trusted_nodes", "SELECT id, round(avg(x) OVER (), 6) AS mean_x FROM {nodes} WHERE id % 4 IN (0, 3)")
def _(v):
    """Nodes whose position comes from a fix, and the middle of these."""
    source = F.expr("CASE id % 4 WHEN 0 THEN 'gps' WHEN 1 THEN 'gps_fallback' WHEN 2 THEN 'static' ELSE 'gps_2d' END")
    nodes = v.nodes.where(source.startswith("gps") & (source != "gps_fallback"))
    return nodes.select("id").crossJoin(nodes.agg(F.round(F.avg("x"), 6).alias("mean_x")))  # a single row


@query("cleanup_matches", "SELECT count(*) AS n FROM {detections} WHERE label = 'view' AND retention_tier = 'short' AND review_state = 'unreviewed' AND label_confidence >= 0.2 AND label_confidence <= 0.7 AND winner_member = 'birdnet'")
def _(v):
    tests = {"label": "view", "retention_tier": "short", "review_state": "unreviewed", "winner_member": "birdnet"}
    rows = v.detections
    for name, value in tests.items():
        rows = rows.where(F.coalesce(F.lower(F.trim(name)) == value, F.lit(False)))
    return rows.where(F.coalesce(F.col("label_confidence").between(0.2, 0.7), F.lit(False))).agg(F.count("*").alias("n"))


def energy_selected(rows: DataFrame, event: str, threshold: float, least: int) -> DataFrame:
    """(event, sensors): those over the threshold if they are ``least``; else, if the event has that many sensors, the
    strongest ``least``; an event with fewer keeps those over the threshold. ``rows``: event, sensor, energy."""
    e = rows.groupBy(event).agg(F.array_sort(F.collect_list(F.struct((-F.col("energy")).alias("e"), "sensor"))).alias("all"))  # an event's channels
    strong = F.filter("all", lambda x: -x.e > threshold)
    chosen = F.when((F.size(strong) >= least) | (F.size("all") < least), strong).otherwise(F.slice("all", 1, least))
    return e.select(event, F.transform(chosen, lambda x: x.sensor).alias("sensors"))


@query("energy_selected", "SELECT detection_id, count(*) AS selected FROM (SELECT detection_id, e, row_number() OVER (PARTITION BY detection_id ORDER BY e DESC, channel) AS r, count(*) OVER (PARTITION BY detection_id) AS n, count(*) FILTER (e > 60) OVER (PARTITION BY detection_id) AS strong FROM (SELECT detection_id, channel, (observation_id * 37 % 100) AS e FROM {observations} WHERE detection_id % 9 <> 0 OR channel = 0)) WHERE ((strong >= 2 OR n < 2) AND e > 60) OR (strong < 2 AND n >= 2 AND r <= 2) GROUP BY detection_id")
def _(v):
    """Some events have one sensor."""
    rows = v.observations.where("detection_id % 9 <> 0 or channel = 0").select("detection_id", F.col("channel").alias("sensor"), (F.col("observation_id") * 37 % 100).alias("energy"))
    return energy_selected(rows, "detection_id", 60, 2).where(F.size("sensors") > 0).select("detection_id", F.size("sensors").cast("long").alias("selected"))


def nearest_nodes(points: DataFrame, nodes: DataFrame, reach_m: float, most: int) -> DataFrame:
    """(id, node_id, rank): of ``nodes`` (node_id, nx, ny) within reach the nearest ``most`` of each point (id, x, y).

    They meet on cells of the reach; what a point meets is bounded by the nodes around it."""
    around = F.explode(F.sequence(F.lit(-1), F.lit(1)))
    n = nodes.withColumn("_di", around).withColumn("_dj", around).withColumn("_i", F.floor(F.col("nx") / reach_m) + F.col("_di")).withColumn("_j", F.floor(F.col("ny") / reach_m) + F.col("_dj"))
    p = points.withColumn("_i", F.floor(F.col("x") / reach_m)).withColumn("_j", F.floor(F.col("y") / reach_m))
    far = F.sqrt((F.col("x") - F.col("nx")) * (F.col("x") - F.col("nx")) + (F.col("y") - F.col("ny")) * (F.col("y") - F.col("ny")))
    met = p.join(n.drop("_di", "_dj"), ["_i", "_j"]).select("id", "node_id", far.alias("m")).where(F.col("m") <= reach_m)
    rank = F.row_number().over(Window.partitionBy("id").orderBy("m", "node_id"))
    return met.withColumn("rank", rank.cast("long")).where(F.col("rank") <= most).select("id", "node_id", "rank")


@query("selected_nodes", "SELECT id, node_id, r::BIGINT AS rank FROM (SELECT d.id, n.id AS node_id, row_number() OVER (PARTITION BY d.id ORDER BY sqrt((d.x - n.x) * (d.x - n.x) + (d.y - n.y) * (d.y - n.y)), n.id) AS r FROM (" + _XYZ_SQL + f") d JOIN {{nodes}} n ON n.last_seen_ns >= {NOW_NS - 60 * SECOND} AND sqrt((d.x - n.x) * (d.x - n.x) + (d.y - n.y) * (d.y - n.y)) <= 150) WHERE r <= 3")
def _(v):
    """Of nodes seen in the last minute and within reach, the three nearest to each event."""
    nodes = v.nodes.where(F.col("last_seen_ns") >= NOW_NS - 60 * SECOND).select(F.col("id").alias("node_id"), F.col("x").alias("nx"), F.col("y").alias("ny"))
    return nearest_nodes(placed(v).select("id", "x", "y"), nodes, 150.0, 3)


@query("store_forward_order", "SELECT node_id, sequence, line, part, row_number() OVER (PARTITION BY node_id ORDER BY received_ns, sequence, line, part) AS rank FROM {frames} WHERE boot_session = 'O'")
def _(v):
    """The place of each frame of a session in its node's order, counted by days so that no node is one task."""
    rows = v.frames.where("boot_session = 'O'")
    return running(rows, ["node_id"], ["received_ns", "sequence", "line", "part"], F.lit(1).cast("long"), "rank").select("node_id", "sequence", "line", "part", F.col("rank").cast("long").alias("rank"))


@query("ready_expired", f"SELECT id, created_ns < {NOW_NS} - 60 * {SECOND}::BIGINT AS expired FROM {{transcripts}}")
def _(v):
    return v.transcripts.select("id", (F.lit(NOW_NS) - F.col("created_ns") > 60 * SECOND).alias("expired"))
