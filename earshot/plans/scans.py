"""Scans and projections: optional predicates, newest-first top-k with a tiebreak, derived columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo, physics, text
from ..sources.views import DAY, HOUR, NOW_NS
from . import query


def newest(df: DataFrame, limit: int, ts: str = "timestamp_ns", key: str = "id") -> DataFrame:
    return df.orderBy(F.col(ts).desc(), F.col(key).desc()).limit(limit)


def detection_scan(df: DataFrame, limit: int, since_ns=None, until_ns=None, min_confidence=None, review_state=None) -> DataFrame:
    """All given predicates hold; both ends of the time range belong to it."""
    tests = [(F.col("timestamp_ns") >= since_ns) if since_ns is not None else None, (F.col("timestamp_ns") <= until_ns) if until_ns is not None else None, (F.col("label_confidence") >= min_confidence) if min_confidence is not None else None, (F.col("review_state") == review_state) if review_state is not None else None]
    return newest(reduce(lambda x, y: x.where(y), [t for t in tests if t is not None], df), limit)


@query("detection_scan", f"SELECT id, timestamp_ns, node_id, label, label_confidence FROM {{detections}} WHERE timestamp_ns BETWEEN {NOW_NS - 20 * DAY} AND {NOW_NS - 5 * DAY} AND label_confidence >= 0.4 AND review_state = 'confirmed' ORDER BY timestamp_ns DESC, id DESC LIMIT 200")
def _(v):
    return detection_scan(v.detections, 200, NOW_NS - 20 * DAY, NOW_NS - 5 * DAY, 0.4, "confirmed").select("id", "timestamp_ns", "node_id", "label", "label_confidence")


@query("track_scan", f"SELECT track_id, last_seen_ns, status FROM {{tracks}} WHERE last_seen_ns >= {NOW_NS - 9 * DAY} AND status IN ('confirmed', 'tentative') ORDER BY last_seen_ns DESC, track_id DESC LIMIT 50")
def _(v):
    return newest(v.tracks.where((F.col("last_seen_ns") >= NOW_NS - 9 * DAY) & F.col("status").isin("confirmed", "tentative")), 50, "last_seen_ns", "track_id").select("track_id", "last_seen_ns", "status")


@query("track_update_scan", "SELECT id, track_id, timestamp_ns FROM {detections} WHERE track_id = 42 ORDER BY timestamp_ns DESC, id DESC LIMIT 25")
def _(v):
    return newest(v.detections.where("track_id = 42"), 25).select("id", "track_id", "timestamp_ns")


@query("alert_scan_any", "SELECT id, track_id, timestamp_ns FROM {detections} WHERE label_category = 'security' AND label_confidence >= 0.9 AND (id = 17 OR track_id = 16 OR track_id = 143) ORDER BY timestamp_ns DESC, id DESC LIMIT 100")
def _(v):
    alerts = v.detections.where("label_category = 'security' and label_confidence >= 0.9")
    return newest(alerts.where((F.col("id") == 17) | F.col("track_id").isin(16, 143)), 100).select("id", "track_id", "timestamp_ns")


@query("observations_by_ids", "SELECT r.pos::BIGINT AS pos, o.observation_id, o.sensor_id, o.toa_ns FROM (SELECT unnest([401, 8, 77777777, 15, 3]) AS wanted, unnest([0, 1, 2, 3, 4]) AS pos) r JOIN {observations} o ON o.observation_id = r.wanted ORDER BY pos")
def _(v):
    wanted = v.spark.range(1).select(F.posexplode(F.array(*[F.lit(x).cast("long") for x in (401, 8, 77777777, 15, 3)])).alias("pos", "observation_id"))
    return v.observations.join(F.broadcast(wanted), "observation_id").select(F.col("pos").cast("long").alias("pos"), "observation_id", "sensor_id", "toa_ns").orderBy("pos")


@query("environment_history", "SELECT e.id, e.node_id, e.timestamp_ns, e.temperature_k, n.x, n.y FROM {environment} e LEFT JOIN {nodes} n ON n.id = e.node_id WHERE e.node_id IN (3, 7) ORDER BY e.timestamp_ns DESC, e.id DESC LIMIT 100")
def _(v):
    rows = newest(v.environment.where(F.col("node_id").isin(3, 7)), 100)
    return rows.join(v.nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id", "left").select("id", "node_id", "timestamp_ns", "temperature_k", "x", "y")


@query("transcript_scan", f"SELECT id, node_id, created_ns, length(text)::BIGINT AS n_chars FROM {{transcripts}} WHERE created_ns >= {NOW_NS - HOUR} ORDER BY created_ns DESC, id DESC LIMIT 100")
def _(v):
    return newest(v.transcripts.where(F.col("created_ns") >= NOW_NS - HOUR), 100, "created_ns").select("id", "node_id", "created_ns", F.length("text").cast("long").alias("n_chars"))


@query("bit_report_scan", "SELECT id, node_id, report_type, status, timestamp_ns FROM {bit_reports} WHERE node_id = 4 AND report_type = 'CBIT' ORDER BY timestamp_ns DESC, id DESC LIMIT 50")
def _(v):
    return newest(v.bit_reports.where("node_id = 4 and report_type = 'CBIT'"), 50).select("id", "node_id", "report_type", "status", "timestamp_ns")


@query("label_vocabulary", "SELECT DISTINCT label AS name FROM {detections} ORDER BY name")
def _(v):
    return v.detections.select(F.col("label").alias("name")).distinct().orderBy("name")


@query("node_scan", "SELECT id, name, x, y, z FROM {nodes} ORDER BY id")
def _(v):
    return v.nodes.select("id", "name", "x", "y", "z").orderBy("id")


@query("zone_scan", "SELECT zone_id, name, lat_min, lat_max FROM {zones} ORDER BY zone_id")
def _(v):
    return v.zones.select("zone_id", "name", "lat_min", "lat_max").orderBy("zone_id")


@query("detection_lookup", "SELECT id, label, timestamp_ns FROM {detections} WHERE id = 123")
def _(v):
    return v.detections.where("id = 123").select("id", "label", "timestamp_ns")


@query("confirmed_birds", f"SELECT id, label, timestamp_ns FROM (SELECT * FROM {{detections}} WHERE timestamp_ns >= {NOW_NS - 20 * DAY} ORDER BY timestamp_ns DESC, id DESC LIMIT 500) WHERE review_state = 'confirmed' AND label_category = 'bird'")
def _(v):
    return newest(v.detections.where(F.col("timestamp_ns") >= NOW_NS - 20 * DAY), 500).where("review_state = 'confirmed' and label_category = 'bird'").select("id", "label", "timestamp_ns")


@query("geo_admission", "SELECT node_id, count(*) AS kept FROM {detections} WHERE NOT (lat >= 44.981 AND lat < 44.982 AND lon > -93.257 AND lon <= -93.256) GROUP BY node_id")
def _(v):
    inside = (F.col("lat") >= 44.981) & (F.col("lat") < 44.982) & (F.col("lon") > -93.257) & (F.col("lon") <= -93.256)
    return v.detections.where(~inside).groupBy("node_id").agg(F.count("*").alias("kept"))


@query("iso_times", "SELECT id, strftime(make_timestamp(timestamp_ns // 1000), '%Y-%m-%dT%H:%M:%SZ') AS iso FROM {detections}")
def _(v):
    return v.detections.select("id", F.date_format(F.timestamp_micros(F.expr("timestamp_ns div 1000")), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("iso"))


@query("slugs", "SELECT p_partkey AS id, coalesce(nullif(trim(regexp_replace(lower(trim(p_name)), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'unknown') AS slug FROM part")
def _(v):
    return v.raw("part").select(F.col("p_partkey").alias("id"), text.slug(F.col("p_name")).alias("slug"))


@query("category_heuristic", """SELECT p_partkey AS id, CASE WHEN regexp_matches(lower(p_type), 'tin|copper') THEN 'wildlife' WHEN regexp_matches(lower(p_type), 'steel') THEN 'human' WHEN regexp_matches(lower(p_type), 'brass|nickel') THEN 'vehicle' ELSE 'unknown' END AS category FROM part""")
def _(v):
    return v.raw("part").select(F.col("p_partkey").alias("id"), text.first_containing(F.lower("p_type"), {"wildlife": ("tin", "copper"), "human": ("steel",), "vehicle": ("brass", "nickel")}, "unknown").alias("category"))


@query("payload_digests", "SELECT doc_id AS id, sha256(text) AS digest FROM documents")
def _(v):
    return v.raw("documents").select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"))


@query("speed_of_sound", "SELECT id, round(331.3 + 0.606 * (temperature_k - 273.15) + 0.0124 * (id % 100), 6) AS mps FROM {environment}")
def _(v):
    return v.environment.select("id", F.round(physics.speed_of_sound(F.col("temperature_k") - 273.15, (F.col("id") % 100) / 100.0), 6).alias("mps"))


@query("rssi_ranges", "SELECT id, round(least(greatest(power(10.0, (-59.0 - rssi) / (10.0 * 2.0)), 0.25), 1000.0), 6) AS range_m FROM {ble}")
def _(v):
    return v.ble.select("id", F.round(physics.rssi_to_range(F.col("rssi")), 6).alias("range_m"))


@query("local_positions", "SELECT id, round((lat - 44.98) * (111132.92 - 559.82 * cos(2 * radians(44.98)) + 1.175 * cos(4 * radians(44.98))), 4) AS y, round((lon + 93.2565) * (111412.84 * cos(radians(44.98)) - 93.5 * cos(3 * radians(44.98))), 4) AS x FROM {detections}")
def _(v):
    x, y = geo.to_local_flat(F.col("lat"), F.col("lon"), 44.98, -93.2565)
    return v.detections.select("id", F.round(y, 4).alias("y"), F.round(x, 4).alias("x"))


@query("ecef_positions", """SELECT id, round(n * cos(radians(lat)) * cos(radians(lon)), 3) AS x, round(n * cos(radians(lat)) * sin(radians(lon)), 3) AS y, round(n * (1 - 6.69437999014e-3) * sin(radians(lat)), 3) AS z
    FROM (SELECT *, 6378137.0 / sqrt(1 - 6.69437999014e-3 * power(sin(radians(lat)), 2)) AS n FROM {detections})""")
def _(v):
    x, y, z = geo.to_ecef(F.col("lat"), F.col("lon"), F.lit(0.0))
    return v.detections.select("id", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(z, 3).alias("z"))


@query("capability_tiers", "SELECT id, CASE WHEN id % 6 >= 4 THEN 'full_3d' WHEN id % 6 >= 3 THEN 'bearing_2d' WHEN id % 6 >= 1 THEN 'class_only' ELSE 'alert_only' END AS tier FROM {detections}")
def _(v):
    return v.detections.select("id", physics.capability_tier(F.col("id") % 6).alias("tier"))


@query("finite_values", "SELECT id, CASE WHEN isnan(x) OR isinf(x) THEN NULL ELSE x END AS x FROM (SELECT id, CASE id % 4 WHEN 0 THEN 'nan'::DOUBLE WHEN 1 THEN 'inf'::DOUBLE ELSE label_confidence END AS x FROM {detections})")
def _(v):
    x = F.when(F.col("id") % 4 == 0, F.lit(float("nan"))).when(F.col("id") % 4 == 1, F.lit(float("inf"))).otherwise(F.col("label_confidence"))
    return v.detections.select("id", physics.finite(x).alias("x"))
