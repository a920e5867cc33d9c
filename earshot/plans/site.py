"""The state of a site: daily matrix in local time, enrichment of tracks and artifacts, health of nodes, snapshots."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.views import DAY, HOUR, NOW_NS, SECOND
from . import query
from .aggregates import activity_matrix, bit_rollup
from .joins import asof
from .scans import newest

#: Units of a window text, in seconds.
UNITS = {"s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800, "y": 31536000}


def window_ns(text: str) -> int:
    """Nanoseconds of "24h", "7d", "30m", "2w", "1y" or bare seconds."""
    text = text.strip()
    if not text:
        raise ValueError("empty window")
    number, unit = (text, "s") if text[-1].isdigit() else (text[:-1], text[-1].lower())
    if unit not in UNITS:
        raise ValueError(f"unknown unit in {text!r}")
    return int(number) * UNITS[unit] * SECOND


def day_bounds(zone: str, date: str | None = None, end_ns: int | None = None, hours: int = 24) -> tuple[int, int]:
    """Start and end of a calendar day in a time zone (the wall clock runs 24 hours, so a day with a change of clocks is 23 or
    25 hours of time), or of the last ``hours`` up to the next full hour after ``end_ns``."""
    tz = ZoneInfo(zone)
    if date is not None:
        start = datetime.strptime(date, "%Y-%m-%d").replace(tzinfo=tz)
        end = start + timedelta(hours=24)
    else:
        end = datetime.fromtimestamp(end_ns / SECOND, tz).replace(minute=0, second=0, microsecond=0) + timedelta(hours=1)
        start = end - timedelta(hours=hours)
    return tuple(int(x.astimezone(timezone.utc).timestamp()) * SECOND for x in (start, end))


def daily_matrix(detections: DataFrame, zone: str, date: str | None = None, end_ns: int | None = None, hours: int = 24, min_confidence: float = 0.4, top: int = 4) -> DataFrame:
    """(label, bucket, bucket_start, n): hourly counts of the most frequent labels, starts as local time."""
    start, end = day_bounds(zone, date, end_ns, hours)
    local = F.date_format(F.from_utc_timestamp(F.timestamp_micros(F.lit(start // 1000) + F.col("bucket") * (HOUR // 1000)), zone), "yyyy-MM-dd HH:mm")
    return activity_matrix(detections, start, end, HOUR, min_confidence, top).withColumn("bucket_start", local)


_BERLIN = day_bounds("Europe/Berlin", "2024-01-20")


@query(
    "daily_matrix",
    f"""WITH cells AS (SELECT label, (timestamp_ns - {_BERLIN[0]}) // {HOUR} AS bucket, count(*) AS n FROM {{detections}} WHERE timestamp_ns >= {_BERLIN[0]} AND timestamp_ns < {_BERLIN[1]} AND label_confidence >= 0.4 GROUP BY ALL),
    top AS (SELECT label FROM cells GROUP BY label ORDER BY sum(n) DESC, label LIMIT 4)
    SELECT t.label, b.bucket, strftime(TIMESTAMP '2024-01-20 00:00:00' + to_hours(b.bucket), '%Y-%m-%d %H:%M') AS bucket_start, coalesce(c.n, 0)::BIGINT AS n FROM top t CROSS JOIN (SELECT unnest(range(24))::BIGINT AS bucket) b LEFT JOIN cells c ON c.label = t.label AND c.bucket = b.bucket""",
)
def _(v):
    return daily_matrix(v.detections, "Europe/Berlin", "2024-01-20")


@query("window_label_counts", f"SELECT label, count(*) AS n FROM {{detections}} WHERE timestamp_ns >= {NOW_NS - 2 * 7 * DAY} GROUP BY label")
def _(v):
    return v.detections.where(F.col("timestamp_ns") >= NOW_NS - window_ns("2w")).groupBy("label").agg(F.count("*").alias("n"))


@query("latest_metadata_per_node", "SELECT node_id, max_by(concat(sensor_id, '/', channel), (toa_ns, observation_id)) AS metadata FROM {observations} GROUP BY node_id")
def _(v):
    return v.observations.groupBy("node_id").agg(F.max_by(F.concat_ws("/", "sensor_id", "channel"), F.struct("toa_ns", "observation_id")).alias("metadata"))


@query("latest_bit_per_type", "SELECT node_id, report_type, arg_max(id, (timestamp_ns, id)) AS id, arg_max(status, (timestamp_ns, id)) AS status, max(timestamp_ns) AS timestamp_ns FROM {bit_reports} GROUP BY 1, 2")
def _(v):
    last = v.bit_reports.groupBy("node_id", "report_type").agg(F.max(F.struct("timestamp_ns", "id", "status")).alias("m"))
    return last.select("node_id", "report_type", "m.id", "m.status", "m.timestamp_ns")


@query("bit_failures", "SELECT node_id, string_agg(report_type, ',' ORDER BY report_type) AS failing FROM (SELECT node_id, report_type, arg_max(status, (timestamp_ns, id)) AS status FROM {bit_reports} GROUP BY 1, 2) WHERE status = 'FAIL' GROUP BY node_id")
def _(v):
    last = v.bit_reports.groupBy("node_id", "report_type").agg(F.max_by("status", F.struct("timestamp_ns", "id")).alias("status"))
    return last.where("status = 'FAIL'").groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("report_type")), ",").alias("failing"))


def heartbeat(age_ns) -> F.Column:
    return F.when(age_ns < 15 * SECOND, "online").when(age_ns < 45 * SECOND, "degraded").otherwise("offline")


def node_health(nodes: DataFrame, reports: DataFrame, now_ns: int, stale_seconds: int, fail_overrides: bool = True) -> DataFrame:
    """(id, heartbeat, health): the heartbeat, unless the node's tests say worse. A node without reports has its heartbeat."""
    cbit = reports.where("report_type = 'CBIT'").groupBy("node_id").agg((F.max("timestamp_ns") < now_ns - stale_seconds * SECOND).alias("stale"))
    rows = nodes.select("id", heartbeat(F.lit(now_ns) - F.col("last_seen_ns")).alias("heartbeat"))
    rows = rows.join(bit_rollup(reports).withColumnRenamed("node_id", "id"), "id", "left").join(cbit.withColumnRenamed("node_id", "id"), "id", "left")
    failed = F.when(F.lit(not fail_overrides) & (F.col("heartbeat") == "offline"), "offline").otherwise("bit_fail")
    worse = (F.col("worst") == "DEGRADED") | F.coalesce("stale", F.lit(False))
    health = F.when(F.col("worst") == "FAIL", failed).when(worse & (F.col("heartbeat") == "online"), "degraded").otherwise(F.col("heartbeat"))
    return rows.select("id", "heartbeat", health.alias("health"))


_HEARTBEAT_SQL = f"CASE WHEN {NOW_NS} - last_seen_ns < {15 * SECOND} THEN 'online' WHEN {NOW_NS} - last_seen_ns < {45 * SECOND} THEN 'degraded' ELSE 'offline' END"


@query(
    "node_health",
    f"""WITH latest AS (SELECT node_id, report_type, arg_max(status, (timestamp_ns, id)) AS status, max(timestamp_ns) AS ts FROM {{bit_reports}} GROUP BY 1, 2),
    b AS (SELECT node_id, max(CASE status WHEN 'FAIL' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) AS worst, coalesce(max(ts) FILTER (report_type = 'CBIT') < {NOW_NS - 86400 * 400 * SECOND}, false) AS stale FROM latest GROUP BY 1),
    n AS (SELECT id, {_HEARTBEAT_SQL} AS heartbeat FROM {{nodes}})
    SELECT n.id, heartbeat, CASE WHEN b.worst = 2 AND heartbeat = 'offline' THEN 'offline' WHEN b.worst = 2 THEN 'bit_fail' WHEN (b.worst = 1 OR b.stale) AND heartbeat = 'online' THEN 'degraded' ELSE heartbeat END AS health FROM n LEFT JOIN b ON b.node_id = n.id""",
)
def _(v):
    return node_health(v.nodes, v.bit_reports, NOW_NS, 86400 * 400, fail_overrides=False)


@query(
    "artifact_overview",
    "SELECT a.id, a.node_id, coalesce(d.label, t.label) AS label, d.id IS NOT NULL AS has_detection, EXISTS (SELECT 1 FROM {detections} x WHERE x.id = a.detection_id AND x.label_category = 'security' AND x.label_confidence >= 0.9) AS has_alert FROM {artifacts} a LEFT JOIN {detections} d ON d.id = a.detection_id LEFT JOIN {tracks} t ON t.track_id = a.track_id",
)
def _(v):
    d = v.detections.select(F.col("id").alias("detection_id"), F.col("label").alias("d_label"), F.lit(True).alias("found"), ((F.col("label_category") == "security") & (F.col("label_confidence") >= 0.9)).alias("alert"))
    rows = v.artifacts.join(d, "detection_id", "left").join(v.tracks.select("track_id", F.col("label").alias("t_label")), "track_id", "left")
    no = F.lit(False)
    return rows.select("id", "node_id", F.coalesce("d_label", "t_label").alias("label"), F.coalesce("found", no).alias("has_detection"), F.coalesce("alert", no).alias("has_alert"))


@query(
    "track_contributors",
    "WITH last AS (SELECT track_id, arg_max(id, (timestamp_ns, id)) AS detection_id FROM {detections} WHERE track_id IS NOT NULL GROUP BY 1), n AS (SELECT l.track_id, o.node_id, min(o.channel) AS role, max(o.toa_ns) AS last_ns, count(*) AS k FROM last l JOIN {observations} o ON o.detection_id = l.detection_id GROUP BY 1, 2) SELECT track_id, string_agg(CASE role WHEN 0 THEN 'source' WHEN 1 THEN 'reference' ELSE 'tdoa' END || ':' || node_id, ',' ORDER BY least(role, 2), last_ns DESC, k DESC, node_id) AS contributors, count(*) AS nodes FROM n GROUP BY track_id",
)
def _(v):
    return track_contributors(v.detections, v.observations)


def track_contributors(detections: DataFrame, observations: DataFrame) -> DataFrame:
    """Of each track the nodes behind its latest detection: by role, then the newest, the most frequent, the smallest."""
    last = detections.where("track_id is not null").groupBy("track_id").agg(F.max_by("id", F.struct("timestamp_ns", "id")).alias("detection_id"))
    n = observations.join(last, "detection_id").groupBy("track_id", "node_id").agg(F.least(F.min("channel"), F.lit(2)).alias("role"), F.max("toa_ns").alias("last_ns"), F.count("*").alias("k"))
    names = F.array(F.lit("source"), F.lit("reference"), F.lit("tdoa"))
    each = F.struct("role", (-F.col("last_ns")).alias("a"), (-F.col("k")).alias("b"), "node_id")
    listed = F.transform(F.array_sort(F.collect_list(each)), lambda x: F.concat_ws(":", F.get(names, x.role.cast("int")), x.node_id))
    return n.groupBy("track_id").agg(F.array_join(listed, ",").alias("contributors"), F.count("*").alias("nodes"))


@query(
    "context_snapshot",
    f"""SELECT (SELECT count(*) FROM {{tracks}} WHERE status <> 'dropped') AS tracks, (SELECT count(*) FROM {{zones}}) AS zones, (SELECT count(*) FROM {{detections}} WHERE label_category = 'security' AND label_confidence >= 0.9 AND timestamp_ns >= {NOW_NS - 5 * DAY}) AS alerts,
    (SELECT CASE WHEN count(*) FILTER (h <> 'offline') = 0 THEN 'error' WHEN count(*) FILTER (h <> 'online') > 0 THEN 'degraded' ELSE 'ok' END FROM (SELECT {_HEARTBEAT_SQL} AS h FROM {{nodes}})) AS health""",
)
def _(v):
    h = heartbeat(F.lit(NOW_NS) - F.col("last_seen_ns"))
    health = F.when(F.count_if(h != "offline") == 0, "error").when(F.count_if(h != "online") > 0, "degraded").otherwise("ok")
    one = v.nodes.agg(health.alias("health"))
    for rows, name in ((v.tracks.where("status <> 'dropped'"), "tracks"), (v.zones, "zones"), (v.detections.where((F.col("label_category") == "security") & (F.col("label_confidence") >= 0.9) & (F.col("timestamp_ns") >= NOW_NS - 5 * DAY)), "alerts")):
        one = one.crossJoin(rows.agg(F.count("*").alias(name)))  # single rows
    return one


@query("event_snapshot", "SELECT * FROM (SELECT 'detection' AS part, id, timestamp_ns FROM {detections} WHERE id = 123 UNION ALL SELECT 'observation', observation_id, toa_ns FROM {observations} WHERE detection_id = 123 UNION ALL SELECT * FROM (SELECT 'update', d.id, d.timestamp_ns FROM {detections} d WHERE d.track_id = (SELECT track_id FROM {detections} WHERE id = 123) ORDER BY d.timestamp_ns DESC, d.id DESC LIMIT 10))")
def _(v):
    own = v.detections.where("id = 123")
    updates = newest(v.detections.join(own.select("track_id"), "track_id", "left_semi"), 10)
    parts = [(own, "detection", "id", "timestamp_ns"), (v.observations.where("detection_id = 123"), "observation", "observation_id", "toa_ns"), (updates, "update", "id", "timestamp_ns")]
    out = None
    for rows, name, key, ts in parts:
        rows = rows.select(F.lit(name).alias("part"), F.col(key).alias("id"), F.col(ts).alias("timestamp_ns"))
        out = rows if out is None else out.unionByName(rows)
    return out


@query("cluster_members", "SELECT n.cluster_id, n.id AS node_id, o.sensor_id FROM {nodes} n JOIN (SELECT DISTINCT node_id, sensor_id FROM {observations}) o ON o.node_id = n.id WHERE n.cluster_id = 2")
def _(v):
    sensors = v.observations.select("node_id", "sensor_id").distinct()
    return v.nodes.where("cluster_id = 2").select("cluster_id", F.col("id").alias("node_id")).join(sensors, "node_id").select("cluster_id", "node_id", "sensor_id")


_ENV_SQL = "(SELECT node_id, timestamp_ns, max(temperature_k) AS temperature_k FROM {environment} GROUP BY ALL)"


@query(
    "environment_interpolated",
    f"""SELECT id, round(CASE WHEN t0 IS NULL THEN k1 WHEN t1 IS NULL OR t1 = t0 THEN k0 ELSE k0 + (k1 - k0) * ((timestamp_ns - t0)::DOUBLE / (t1 - t0)::DOUBLE) END, 6) AS temperature_k FROM (
    SELECT p.id, p.timestamp_ns, p.t0, p.k0, n.timestamp_ns AS t1, n.temperature_k AS k1 FROM (SELECT d.id, d.node_id, d.timestamp_ns, e.timestamp_ns AS t0, e.temperature_k AS k0 FROM {{detections}} d ASOF LEFT JOIN {_ENV_SQL} e ON e.node_id = d.node_id AND d.timestamp_ns >= e.timestamp_ns) p ASOF LEFT JOIN {_ENV_SQL} n ON n.node_id = p.node_id AND p.timestamp_ns <= n.timestamp_ns)""",
)
def _(v):
    env = v.environment.groupBy("node_id", "timestamp_ns").agg(F.max("temperature_k").alias("temperature_k"))
    return interpolated(v.detections.select("id", "node_id", "timestamp_ns"), env, "node_id", "timestamp_ns", "temperature_k").select("id", F.round("temperature_k", 6).alias("temperature_k"))


def interpolated(left: DataFrame, right: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """``left`` with ``value`` between the samples before and after each row's time, clamped at the ends."""
    low = asof(left, right, key, ts, value).withColumnsRenamed({value: "_k0", f"{value}_ns": "_t0"})
    back = low.withColumn("_back", -F.col(ts))
    mirrored = right.select(key, (-F.col(ts)).alias("_back"), value)
    both = asof(back, mirrored, key, "_back", value).withColumn("_t1", -F.col(f"{value}_ns")).withColumnRenamed(value, "_k1")
    share = (F.col(ts) - F.col("_t0")).cast("double") / (F.col("_t1") - F.col("_t0")).cast("double")
    between = F.col("_k0") + (F.col("_k1") - F.col("_k0")) * share
    found = F.when(F.col("_t0").isNull(), F.col("_k1")).when(F.col("_t1").isNull() | (F.col("_t1") == F.col("_t0")), F.col("_k0")).otherwise(between)
    return both.select(*left.columns, found.alias(value))


@query("environment_fresh", f"SELECT d.id, CASE WHEN d.timestamp_ns - e.timestamp_ns <= {6 * HOUR} THEN e.temperature_k END AS temperature_k FROM {{detections}} d ASOF LEFT JOIN {_ENV_SQL} e ON e.node_id = d.node_id AND d.timestamp_ns >= e.timestamp_ns")
def _(v):
    env = v.environment.groupBy("node_id", "timestamp_ns").agg(F.max("temperature_k").alias("temperature_k"))
    rows = asof(v.detections.select("id", "node_id", "timestamp_ns"), env, "node_id", "timestamp_ns", "temperature_k")
    return rows.select("id", F.when(F.col("timestamp_ns") - F.col("temperature_k_ns") <= 6 * HOUR, F.col("temperature_k")).alias("temperature_k"))


def lookup(df: DataFrame, key: str, value) -> DataFrame:
    """The row of one key."""
    return df.where(F.col(key) == F.lit(value))


for _name, _view, _key, _value, _columns in (("node_lookup", "nodes", "id", 7, ["id", "name", "cluster_id"]), ("transcript_lookup", "transcripts", "id", 11, ["id", "node_id", "created_ns"]), ("artifact_lookup", "artifacts", "id", 32, ["id", "node_id", "track_id"]), ("area_lookup", "areas", "zone_id", 3, ["zone_id", "name", "kind"])):
    query(_name, f"SELECT {', '.join(_columns)} FROM {{{_view}}} WHERE {_key} = {_value}")(lambda v, a=(_view, _key, _value, _columns): lookup(getattr(v, a[0]), a[1], a[2]).select(*a[3]))

for _name, _view, _test, _ts, _columns in (("artifact_scan", "artifacts", "node_id = 5", "created_ns", ["id", "node_id", "track_id", "created_ns"]), ("ping_scan", "detections", "label = 'click'", "timestamp_ns", ["id", "label", "timestamp_ns"]), ("ground_truth_scan", "detections", "review_state = 'confirmed' AND track_id = 7", "timestamp_ns", ["id", "label", "timestamp_ns"]), ("capture_session_scan", "artifacts", "bytes > 100000", "created_ns", ["id", "bytes", "created_ns"])):
    query(_name, f"SELECT {', '.join(_columns)} FROM {{{_view}}} WHERE {_test} ORDER BY {_ts} DESC, id DESC LIMIT 100")(lambda v, a=(_view, _test, _ts, _columns): newest(getattr(v, a[0]).where(a[1]), 100, a[2]).select(*a[3]))
