"""Joins: latest per group, as-of, intervals, zones, contributors, matches with ground truth.

Interval joins meet on a time bucket as wide as the tolerance and its two neighbours, so that they are equi-joins;
tables of nodes and zones carry no hint: Spark broadcasts them by their size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cells import by_cells
from ..sources.views import DAY, HOUR, NOW_NS, SECOND
from . import query
from .aggregates import bit_rollup


@query("latest_observation_per_node", "SELECT node_id, observation_id, sensor_id, toa_ns FROM (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY toa_ns DESC, observation_id DESC) AS r FROM {observations}) WHERE r = 1")
def _(v):
    return v.observations.groupBy("node_id").agg(F.max(F.struct("toa_ns", "observation_id", "sensor_id")).alias("m")).select("node_id", "m.observation_id", "m.sensor_id", "m.toa_ns")


@query("latest_environment_per_node", "SELECT e.id, e.node_id, e.timestamp_ns, e.temperature_k, n.x, n.y FROM (SELECT *, rank() OVER (PARTITION BY node_id ORDER BY timestamp_ns DESC) AS r FROM {environment}) e LEFT JOIN {nodes} n ON n.id = e.node_id WHERE r = 1")
def _(v):
    last = v.environment.groupBy("node_id").agg(F.max("timestamp_ns").alias("timestamp_ns"))
    return v.environment.join(last, ["node_id", "timestamp_ns"]).join(v.nodes.select(F.col("id").alias("node_id"), "x", "y"), "node_id", "left").select("id", "node_id", "timestamp_ns", "temperature_k", "x", "y")


@query(
    "contributor_summaries",
    "SELECT detection_id, count(DISTINCT node_id) AS nodes, count(*) AS observations, max(toa_ns) AS last_ns, string_agg(role || ':' || node_id, ',' ORDER BY rank, node_id) AS contributors FROM (SELECT detection_id, node_id, max(toa_ns) AS toa_ns, min(rank) AS rank, CASE min(rank) WHEN 0 THEN 'source' WHEN 1 THEN 'reference' ELSE 'tdoa' END AS role FROM (SELECT *, CASE channel WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 2 END AS rank FROM {observations}) GROUP BY detection_id, node_id) GROUP BY detection_id",
)
def _(v):
    rank = F.when(F.col("channel") == 0, 0).when(F.col("channel") == 1, 1).otherwise(2)
    per = v.observations.groupBy("detection_id", "node_id").agg(F.max("toa_ns").alias("toa_ns"), F.min(rank).alias("rank"))
    roles = F.array(F.lit("source"), F.lit("reference"), F.lit("tdoa"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "node_id"))), lambda x: F.concat_ws(":", F.get(roles, x.rank), x.node_id))
    return per.groupBy("detection_id").agg(F.countDistinct("node_id").alias("nodes"), F.count("*").alias("observations"), F.max("toa_ns").alias("last_ns"), F.array_join(listed, ",").alias("contributors"))


@query(
    "tracks_in_window",
    f"SELECT track_id, first_seen_ns, last_seen_ns FROM {{tracks}} t WHERE (first_seen_ns <= {NOW_NS - 20 * DAY} AND last_seen_ns >= {NOW_NS - 21 * DAY}) OR EXISTS (SELECT 1 FROM {{detections}} d WHERE d.track_id = t.track_id AND d.report_window_start_ns <= {NOW_NS - 20 * DAY} AND d.report_window_start_ns + {30 * SECOND} >= {NOW_NS - 21 * DAY})",
)
def _(v):
    start, end = NOW_NS - 21 * DAY, NOW_NS - 20 * DAY
    seen = v.detections.where(F.col("track_id").isNotNull() & (F.col("report_window_start_ns") <= end) & (F.col("report_window_start_ns") + 30 * SECOND >= start)).select("track_id").distinct().withColumn("seen", F.lit(True))
    near = (F.col("first_seen_ns") <= end) & (F.col("last_seen_ns") >= start)
    return v.tracks.join(seen, "track_id", "left").where(near | F.col("seen")).select("track_id", "first_seen_ns", "last_seen_ns")


@query(
    "bracketing_detections",
    f"SELECT track_id, count(*) FILTER (timestamp_ns BETWEEN {NOW_NS - 15 * DAY} AND {NOW_NS - 14 * DAY}) AS inside, max(timestamp_ns) FILTER (timestamp_ns < {NOW_NS - 15 * DAY}) AS before_ns, min(timestamp_ns) FILTER (timestamp_ns > {NOW_NS - 14 * DAY}) AS after_ns FROM {{detections}} WHERE track_id IS NOT NULL GROUP BY track_id",
)
def _(v):
    t, start, end = F.col("timestamp_ns"), NOW_NS - 15 * DAY, NOW_NS - 14 * DAY
    return v.detections.where("track_id is not null").groupBy("track_id").agg(F.count_if(t.between(start, end)).alias("inside"), F.max(F.when(t < start, t)).alias("before_ns"), F.min(F.when(t > end, t)).alias("after_ns"))


def asof(left: DataFrame, right: DataFrame, key: str, ts: str, value: str, bucket_ns: int = DAY) -> DataFrame:
    """``left`` with the last ``value`` of ``right`` at or before each row's time: (value, its time).

    Both sides are one timeline per key and bucket of time, so that a key with a third of all rows is spread over its
    buckets; each bucket starts with the last value of the buckets before it, which come as one row per key and bucket.
    """
    b = F.expr(f"{ts} div {bucket_ns}")
    l = left.withColumn("_b", b).withColumn("_side", F.lit(1)).withColumn("_v", F.lit(None).cast(dict(right.dtypes)[value])).withColumn("_t", F.lit(None).cast("long"))
    r = right.select(key, ts, F.col(value).alias("_v")).withColumn("_b", b).withColumn("_side", F.lit(0)).withColumn("_t", F.col(ts))
    ends = r.groupBy(key, "_b").agg(F.max(F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))).alias("end"))
    buckets = l.select(key, "_b").unionByName(r.select(key, "_b")).distinct().join(ends, [key, "_b"], "left")
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select(key, "_b", F.last("end", ignorenulls=True).over(before).alias("_c"))
    line = l.unionByName(r, allowMissingColumns=True)
    upto = Window.partitionBy(key, "_b").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = F.last(F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_v").alias("v"))), ignorenulls=True).over(upto)
    rows = line.withColumn("_own", last).where("_side = 1").join(carried, [key, "_b"], "left")
    found = F.coalesce("_own", "_c")
    return rows.select(*left.columns, found["v"].alias(value), found["t"].alias(f"{value}_ns"))


@query("environment_asof", "SELECT d.id, d.node_id, e.temperature_k, e.timestamp_ns AS temperature_k_ns FROM {detections} d ASOF LEFT JOIN (SELECT node_id, timestamp_ns, max(temperature_k) AS temperature_k FROM {environment} GROUP BY ALL) e ON d.node_id = e.node_id AND d.timestamp_ns >= e.timestamp_ns")
def _(v):
    env = v.environment.groupBy("node_id", "timestamp_ns").agg(F.max("temperature_k").alias("temperature_k"))
    return asof(v.detections.select("id", "node_id", "timestamp_ns"), env, "node_id", "timestamp_ns", "temperature_k").drop("timestamp_ns")


_INSIDE_SQL = "d.lat >= z.lat_min AND d.lat < z.lat_max AND d.lon >= z.lon_min AND d.lon < z.lon_max"


def in_zone():
    return (F.col("lat") >= F.col("lat_min")) & (F.col("lat") < F.col("lat_max")) & (F.col("lon") >= F.col("lon_min")) & (F.col("lon") < F.col("lon_max"))


@query("zone_detections", f"SELECT z.zone_id, d.label, count(*) AS n FROM {{zones}} z JOIN {{detections}} d ON {_INSIDE_SQL} GROUP BY 1, 2")
def _(v):
    return by_cells(v.detections, v.zones.drop("name"), ("lat", "lon"), ("lat_min", "lat_max", "lon_min", "lon_max")).where(in_zone()).groupBy("zone_id", "label").agg(F.count("*").alias("n"))


@query("zone_occupancy", f"SELECT z.zone_id, count(DISTINCT d.track_id) AS tracks, count(d.track_id) > 0 AS occupied FROM {{zones}} z LEFT JOIN {{detections}} d ON {_INSIDE_SQL} AND d.track_id IS NOT NULL AND d.timestamp_ns >= {NOW_NS - 4 * DAY} GROUP BY z.zone_id")
def _(v):
    recent = v.detections.where(F.col("track_id").isNotNull() & (F.col("timestamp_ns") >= NOW_NS - 4 * DAY))
    inside = by_cells(recent, v.zones.drop("name"), ("lat", "lon"), ("lat_min", "lat_max", "lon_min", "lon_max")).where(in_zone()).groupBy("zone_id").agg(F.countDistinct("track_id").alias("tracks"))
    return v.zones.select("zone_id").join(inside, "zone_id", "left").select("zone_id", F.coalesce("tracks", F.lit(0)).cast("long").alias("tracks"), F.col("tracks").isNotNull().alias("occupied"))


def near_in_time(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, tolerance_ns: int, key: str | None = None) -> DataFrame:
    """Pairs whose times differ by at most the tolerance, as an equi-join on buckets of the tolerance's width."""
    l = left.withColumn("_w", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.expr(f"{left_ts} div {tolerance_ns}") + d)))
    r = right.withColumn("_w", F.expr(f"{right_ts} div {tolerance_ns}"))
    on = ["_w"] if key is None else ["_w", key]
    return l.join(r, on).where(F.abs(F.col(left_ts) - F.col(right_ts)) <= tolerance_ns).drop("_w")


@query("corroborators", f"SELECT a.id, count(*) AS n, min(abs(a.timestamp_ns - b.timestamp_ns)) AS nearest_ns FROM {{detections}} a JOIN {{detections}} b ON a.label = b.label AND a.node_id <> b.node_id AND abs(a.timestamp_ns - b.timestamp_ns) <= {60 * SECOND} WHERE a.reporting_modality = 'localized' GROUP BY a.id")
def _(v):
    a = v.detections.where("reporting_modality = 'localized'").select("id", "label", F.col("node_id").alias("node_a"), F.col("timestamp_ns").alias("ts_a"))
    b = v.detections.select("label", "node_id", "timestamp_ns")
    pairs = near_in_time(a, b, "ts_a", "timestamp_ns", 60 * SECOND, "label").where("node_a <> node_id")
    return pairs.groupBy("id").agg(F.count("*").alias("n"), F.min(F.abs(F.col("ts_a") - F.col("timestamp_ns"))).alias("nearest_ns"))


@query("ground_truth_matches", f"SELECT t.id, count(d.id) AS n, min(round(111320.0 * sqrt(power(d.lat - t.lat, 2) + power(d.lon - t.lon, 2)), 3)) AS best_m FROM (SELECT * FROM {{detections}} WHERE review_state = 'confirmed') t LEFT JOIN {{detections}} d ON d.id <> t.id AND d.label = t.label AND abs(d.timestamp_ns - t.timestamp_ns) <= {120 * SECOND} GROUP BY t.id")
def _(v):
    truth = v.detections.where("review_state = 'confirmed'").select(F.col("id").alias("truth_id"), "label", F.col("timestamp_ns").alias("truth_ns"), F.col("lat").alias("lat_t"), F.col("lon").alias("lon_t"))
    pairs = near_in_time(truth, v.detections.select("id", "label", "timestamp_ns", "lat", "lon"), "truth_ns", "timestamp_ns", 120 * SECOND, "label").where("id <> truth_id")
    metres = F.round(F.lit(111320.0) * F.sqrt(F.pow(F.col("lat") - F.col("lat_t"), F.lit(2.0)) + F.pow(F.col("lon") - F.col("lon_t"), F.lit(2.0))), 3)
    best = pairs.groupBy("truth_id").agg(F.count("*").alias("n"), F.min(metres).alias("best_m"))
    return truth.select("truth_id").join(best, "truth_id", "left").select(F.col("truth_id").alias("id"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "best_m")


@query("node_overview", "SELECT n.id, n.name, e.last_env_ns, CASE b.worst WHEN 2 THEN 'FAIL' WHEN 1 THEN 'DEGRADED' WHEN 0 THEN 'PASS' END AS worst, coalesce(d.n, 0)::BIGINT AS detections FROM {nodes} n LEFT JOIN (SELECT node_id, max(timestamp_ns) AS last_env_ns FROM {environment} GROUP BY 1) e ON e.node_id = n.id LEFT JOIN (SELECT node_id, max(CASE status WHEN 'FAIL' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) AS worst FROM (SELECT *, row_number() OVER (PARTITION BY node_id, report_type ORDER BY timestamp_ns DESC, id DESC) AS r FROM {bit_reports}) WHERE r = 1 GROUP BY 1) b ON b.node_id = n.id LEFT JOIN (SELECT node_id, count(*) AS n FROM {detections} GROUP BY 1) d ON d.node_id = n.id")
def _(v):
    env = v.environment.groupBy("node_id").agg(F.max("timestamp_ns").alias("last_env_ns"))
    bit = bit_rollup(v.bit_reports).select("node_id", "worst")
    heard = v.detections.groupBy("node_id").agg(F.count("*").alias("n"))
    rows = v.nodes.withColumnRenamed("id", "node_id").join(env, "node_id", "left").join(bit, "node_id", "left").join(heard, "node_id", "left")
    return rows.select(F.col("node_id").alias("id"), "name", "last_env_ns", "worst", F.coalesce("n", F.lit(0)).cast("long").alias("detections"))


@query("sensor_pairs", "SELECT a.id AS a, b.id AS b, round(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2) + power(a.z - b.z, 2)), 6) AS baseline_m FROM {nodes} a JOIN {nodes} b ON a.cluster_id = b.cluster_id AND a.id < b.id")
def _(v):
    a = v.nodes.select("cluster_id", F.col("id").alias("a"), F.col("x").alias("xa"), F.col("y").alias("ya"), F.col("z").alias("za"))
    b = v.nodes.select("cluster_id", F.col("id").alias("b"), "x", "y", "z")
    two = F.lit(2.0)
    return a.join(b, "cluster_id").where("a < b").select("a", "b", F.round(F.sqrt(F.pow(F.col("xa") - F.col("x"), two) + F.pow(F.col("ya") - F.col("y"), two) + F.pow(F.col("za") - F.col("z"), two)), 6).alias("baseline_m"))


@query("uncovered_windows", "SELECT DISTINCT report_window_start_ns FROM {detections} d WHERE reporting_modality = 'omni' AND NOT EXISTS (SELECT 1 FROM {detections} l WHERE l.reporting_modality = 'localized' AND l.report_window_start_ns = d.report_window_start_ns)")
def _(v):
    omni = v.detections.where("reporting_modality = 'omni'").select("report_window_start_ns").distinct()
    return omni.join(v.detections.where("reporting_modality = 'localized'").select("report_window_start_ns"), "report_window_start_ns", "left_anti")


@query("intervals_overlap", f"SELECT count(*) AS n, count(DISTINCT o.o_custkey) AS customers FROM orders o JOIN (SELECT l_orderkey, max(l_shipdate) AS until_ts FROM lineitem GROUP BY 1) l ON l.l_orderkey = o.o_orderkey WHERE epoch_ns(o.o_orderdate) <= {NOW_NS} AND epoch_ns(l.until_ts) >= {NOW_NS - 60 * DAY}")
def _(v):
    until = v.raw("lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.max("l_shipdate").alias("until_ts"))
    ns = lambda c: F.unix_micros(F.col(c).cast("timestamp")) * 1000
    rows = v.raw("orders").where(ns("o_orderdate") <= NOW_NS).join(until, "o_orderkey").where(ns("until_ts") >= NOW_NS - 60 * DAY)
    return rows.agg(F.count("*").alias("n"), F.countDistinct("o_custkey").alias("customers"))


@query("stale_nodes", f"SELECT n.id FROM {{nodes}} n WHERE NOT EXISTS (SELECT 1 FROM {{detections}} d WHERE d.node_id = n.id AND d.timestamp_ns >= {NOW_NS - HOUR})")
def _(v):
    seen = v.detections.where(F.col("timestamp_ns") >= NOW_NS - HOUR).select(F.col("node_id").alias("id"))
    return v.nodes.select("id").join(seen, "id", "left_anti")
