"""Aggregations: activity matrix, histograms, heatmap, summaries, health, classifier scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.timeline import running
from ..sources.views import DAY, HOUR, NOW_NS, SECOND
from . import query

DAY_START = NOW_NS - 29 * DAY


def activity_matrix(detections, start_ns: int, end_ns: int, bucket_ns: int, min_confidence: float, top: int):
    """(label, bucket, n) for the most frequent labels; whole buckets only, zeros filled in."""
    n = (end_ns - start_ns) // bucket_ns
    rows = detections.where((F.col("timestamp_ns") >= start_ns) & (F.col("timestamp_ns") < start_ns + n * bucket_ns) & (F.col("label_confidence") >= min_confidence))
    cells = rows.groupBy("label", F.expr(f"(timestamp_ns - {start_ns}) div {bucket_ns}").alias("bucket")).agg(F.count("*").alias("n"))
    labels = cells.groupBy("label").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "label").limit(top)
    grid = labels.select("label", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("bucket"))
    return grid.join(cells, ["label", "bucket"], "left").select("label", "bucket", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


@query(
    "activity_matrix",
    f"""WITH cells AS (SELECT label, (timestamp_ns - {DAY_START}) // {HOUR} AS bucket, count(*) AS n FROM {{detections}} WHERE timestamp_ns >= {DAY_START} AND timestamp_ns < {DAY_START + DAY} AND label_confidence >= 0.4 GROUP BY ALL),
    top AS (SELECT label FROM cells GROUP BY label ORDER BY sum(n) DESC, label LIMIT 4)
    SELECT t.label, b.bucket, coalesce(c.n, 0)::BIGINT AS n FROM top t CROSS JOIN (SELECT unnest(range(24))::BIGINT AS bucket) b LEFT JOIN cells c ON c.label = t.label AND c.bucket = b.bucket""",
)
def _(v):
    return activity_matrix(v.detections, DAY_START, DAY_START + DAY, HOUR, 0.4, 4)


@query("label_summaries", f"SELECT label, count(*) AS n, min(timestamp_ns) AS first_ns, max(timestamp_ns) AS last_ns, count(DISTINCT node_id) AS nodes, max_by(label_category, (timestamp_ns, id)) AS category FROM {{detections}} WHERE timestamp_ns >= {NOW_NS - 21 * DAY} AND label_confidence >= 0.4 GROUP BY label")
def _(v):
    rows = v.detections.where((F.col("timestamp_ns") >= NOW_NS - 21 * DAY) & (F.col("label_confidence") >= 0.4))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("first_ns"), F.max("timestamp_ns").alias("last_ns"), F.countDistinct("node_id").alias("nodes"), F.max_by("label_category", F.struct("timestamp_ns", "id")).alias("category"))


def _histogram(v, part, size: int, first: int = 0):
    at = F.timestamp_micros(F.expr("timestamp_ns div 1000"))
    rows = v.detections.where("label = 'click' and label_confidence >= 0.4").groupBy(part(at).cast("long").alias("bin")).agg(F.count("*").alias("n"))
    bins = v.spark.range(first, first + size).withColumnRenamed("id", "bin")
    return bins.join(rows, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _histogram_sql(part: str, size: int, first: int = 0) -> str:
    return f"SELECT b.bin, coalesce(c.n, 0)::BIGINT AS n FROM (SELECT unnest(range({first}, {first + size}))::BIGINT AS bin) b LEFT JOIN (SELECT date_part('{part}', make_timestamp(timestamp_ns // 1000))::BIGINT AS bin, count(*) AS n FROM {{detections}} WHERE label = 'click' AND label_confidence >= 0.4 GROUP BY 1) c ON c.bin = b.bin"


@query("label_hours", _histogram_sql("hour", 24))
def _(v):
    return _histogram(v, F.hour, 24)


@query("label_weekdays", _histogram_sql("dow", 7))
def _(v):
    return _histogram(v, lambda t: F.dayofweek(t) - 1, 7)


@query("label_months", _histogram_sql("month", 12, 1))
def _(v):
    return _histogram(v, F.month, 12, 1)


@query("heatmap_bins", "SELECT floor(lat * 1000 + 0.5) / 1000 AS lat_bin, floor(lon * 1000 + 0.5) / 1000 AS lon_bin, count(*) AS n FROM {detections} WHERE label IN ('view', 'purchase') AND label_confidence >= 0.4 GROUP BY 1, 2 ORDER BY n DESC, lat_bin, lon_bin LIMIT 20")
def _(v):
    rows = v.detections.where(F.col("label").isin("view", "purchase") & (F.col("label_confidence") >= 0.4))
    return rows.groupBy((F.floor(F.col("lat") * 1000 + 0.5) / 1000).alias("lat_bin"), (F.floor(F.col("lon") * 1000 + 0.5) / 1000).alias("lon_bin")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lat_bin", "lon_bin").limit(20)


@query("classifier_counts", "SELECT coalesce(winner_member, 'yamnet') AS classifier, count(*) AS n FROM {detections} GROUP BY 1")
def _(v):
    return v.detections.groupBy(F.coalesce("winner_member", F.lit("yamnet")).alias("classifier")).agg(F.count("*").alias("n"))


@query(
    "omni_node_summary",
    f"""WITH recent AS (SELECT * FROM {{detections}} WHERE reporting_modality = 'omni' AND label_confidence >= 0.4 AND timestamp_ns >= {NOW_NS - 10 * DAY}),
    per AS (SELECT node_id, label, count(*) AS n, row_number() OVER (PARTITION BY node_id ORDER BY count(*) DESC, label) AS r FROM recent GROUP BY node_id, label)
    SELECT a.node_id, a.n, a.active, a.last_ns, a.confidence, t.labels FROM (SELECT node_id, count(*) AS n, count(*) FILTER (timestamp_ns >= {NOW_NS - 3 * DAY}) AS active, max(timestamp_ns) AS last_ns, max(label_confidence) AS confidence FROM recent GROUP BY node_id) a
    JOIN (SELECT node_id, string_agg(label, ',' ORDER BY r) AS labels FROM per WHERE r <= 3 GROUP BY node_id) t ON t.node_id = a.node_id""",
)
def _(v):
    recent = v.detections.where((F.col("reporting_modality") == "omni") & (F.col("label_confidence") >= 0.4) & (F.col("timestamp_ns") >= NOW_NS - 10 * DAY))
    whole = recent.groupBy("node_id").agg(F.count("*").alias("n"), F.count_if(F.col("timestamp_ns") >= NOW_NS - 3 * DAY).alias("active"), F.max("timestamp_ns").alias("last_ns"), F.max("label_confidence").alias("confidence"))
    per = recent.groupBy("node_id", "label").agg(F.count("*").alias("m"))
    top = per.groupBy("node_id").agg(F.array_join(F.transform(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("m")).alias("less"), "label"))), 1, 3), lambda x: x.label), ",").alias("labels"))
    return whole.join(top, "node_id").select("node_id", "n", "active", "last_ns", "confidence", "labels")


@query("node_status_counts", f"SELECT count(*) FILTER (age < {15 * SECOND}) AS online, count(*) FILTER (age >= {15 * SECOND} AND age < {45 * SECOND}) AS degraded, count(*) FILTER (age >= {45 * SECOND}) AS offline FROM (SELECT {NOW_NS} - last_seen_ns AS age FROM {{nodes}})")
def _(v):
    age = F.lit(NOW_NS) - F.col("last_seen_ns")
    return v.nodes.agg(F.count_if(age < 15 * SECOND).alias("online"), F.count_if((age >= 15 * SECOND) & (age < 45 * SECOND)).alias("degraded"), F.count_if(age >= 45 * SECOND).alias("offline"))


@query(
    "operating_picture",
    f"""SELECT (SELECT count(*) FROM {{tracks}} WHERE status = 'confirmed' AND last_seen_ns >= {NOW_NS - 5 * DAY}) AS active_tracks,
    (SELECT count(*) FROM {{detections}} WHERE label_category = 'security' AND label_confidence >= 0.9 AND timestamp_ns >= {NOW_NS - 5 * DAY}) AS recent_alerts, (SELECT count(*) FROM {{nodes}}) AS nodes""",
)
def _(v):
    tracks = v.tracks.agg(F.count_if((F.col("status") == "confirmed") & (F.col("last_seen_ns") >= NOW_NS - 5 * DAY)).alias("active_tracks"))
    alerts = v.detections.where(F.col("timestamp_ns") >= NOW_NS - 5 * DAY).agg(F.count_if((F.col("label_category") == "security") & (F.col("label_confidence") >= 0.9)).alias("recent_alerts"))
    return tracks.crossJoin(alerts).crossJoin(v.nodes.agg(F.count("*").alias("nodes")))  # three single rows


@query("bit_rollup", "SELECT node_id, CASE max(CASE status WHEN 'FAIL' THEN 2 WHEN 'DEGRADED' THEN 1 ELSE 0 END) WHEN 2 THEN 'FAIL' WHEN 1 THEN 'DEGRADED' ELSE 'PASS' END AS worst, count(*) FILTER (status = 'FAIL') AS failures FROM (SELECT *, row_number() OVER (PARTITION BY node_id, report_type ORDER BY timestamp_ns DESC, id DESC) AS r FROM {bit_reports}) WHERE r = 1 GROUP BY node_id")
def _(v):
    return bit_rollup(v.bit_reports)


def bit_rollup(reports: DataFrame) -> DataFrame:
    """(node_id, worst, failures) over the latest report of each type."""
    latest = reports.groupBy("node_id", "report_type").agg(F.max_by("status", F.struct("timestamp_ns", "id")).alias("status"))
    rank = F.when(F.col("status") == "FAIL", 2).when(F.col("status") == "DEGRADED", 1).otherwise(0)
    worst = F.element_at(F.array(F.lit("PASS"), F.lit("DEGRADED"), F.lit("FAIL")), F.max(rank) + 1)
    return latest.groupBy("node_id").agg(worst.alias("worst"), F.count_if(F.col("status") == "FAIL").alias("failures"))


@query("fused_label_scores", "SELECT bucket, max_by(label, (score, label)) AS winner, round(max(score), 6) AS score, count(*) AS labels FROM (SELECT timestamp_ns // 3600000000000 AS bucket, label, max(label_confidence) AS score FROM {detections} GROUP BY ALL) GROUP BY bucket")
def _(v):
    each = v.detections.groupBy(F.expr(f"timestamp_ns div {HOUR}").alias("bucket"), "label").agg(F.max("label_confidence").alias("score"))
    return each.groupBy("bucket").agg(F.max_by("label", F.struct("score", "label")).alias("winner"), F.round(F.max("score"), 6).alias("score"), F.count("*").alias("labels"))


@query("site_midpoint", "SELECT round(avg(x), 6) AS x, round(avg(y), 6) AS y, round(avg(z) FILTER (z > 0), 6) AS z, count(*) AS n FROM {nodes}")
def _(v):
    return v.nodes.agg(F.round(F.avg("x"), 6).alias("x"), F.round(F.avg("y"), 6).alias("y"), F.round(F.avg(F.when(F.col("z") > 0, F.col("z"))), 6).alias("z"), F.count("*").alias("n"))


def _scored(v):
    return v.raw("documents").join(v.raw("labels"), "doc_id").select("doc_id", F.col("n_chars").cast("double").alias("score"), (F.col("quality") == 1).alias("truth"))


_SCORED_SQL = "SELECT d.doc_id, d.n_chars::DOUBLE AS score, l.quality = 1 AS truth FROM documents d JOIN labels l ON l.doc_id = d.doc_id"


@query("rank_auc", f"WITH s AS ({_SCORED_SQL}), c AS (SELECT score, count(*) AS n, count(*) FILTER (truth) AS up FROM s GROUP BY score), r AS (SELECT *, sum(n) OVER (ORDER BY score) - n + (n + 1) / 2.0 AS rank FROM c), t AS (SELECT sum(up) AS p, sum(n) - sum(up) AS q, sum(rank * up) AS ranks FROM r) SELECT round((ranks - p * (p + 1) / 2.0) / (p * q), 9)::DOUBLE AS auc FROM t")
def _(v):
    counts = _scored(v).groupBy("score").agg(F.count("*").alias("n"), F.count_if("truth").alias("up"))  # one row per distinct score
    # ranks are counted by ranges of scores, with what lies below a range added
    counts = running(counts.withColumn("one", F.lit(1)), ["one"], ["score"], F.col("n"), "upto", bucket=500)
    total = counts.withColumn("rank", F.col("upto") - F.col("n") + (F.col("n") + 1) / 2.0).agg(F.sum("up").alias("p"), (F.sum("n") - F.sum("up")).alias("q"), F.sum(F.col("rank") * F.col("up")).alias("ranks"))
    return total.select(F.round((F.col("ranks") - F.col("p") * (F.col("p") + 1) / 2.0) / (F.col("p") * F.col("q")), 9).alias("auc"))


_METRICS_SQL = "count(*) FILTER (truth AND score >= th) AS tp, count(*) FILTER (NOT truth AND score >= th) AS fp, count(*) FILTER (truth AND score < th) AS fn, count(*) FILTER (NOT truth AND score < th) AS tn"


@query("threshold_sweep", f"SELECT th, tp, fp, fn, tn, round(tp / greatest(tp + fp, 1), 6)::DOUBLE AS precision, round(tp / greatest(tp + fn, 1), 6)::DOUBLE AS recall FROM (SELECT th, {_METRICS_SQL} FROM ({_SCORED_SQL}), (SELECT unnest(range(1, 20)) * 250.0::DOUBLE AS th) GROUP BY th)")
def _(v):
    # one pass: a row adds to all 19 thresholds by conditional sums, nothing is multiplied
    th = [250.0 * k for k in range(1, 20)]
    truth, score = F.col("truth"), F.col("score")
    sums = _scored(v).agg(*[F.struct(F.lit(t).alias("th"), F.count_if(truth & (score >= t)).alias("tp"), F.count_if(~truth & (score >= t)).alias("fp"), F.count_if(truth & (score < t)).alias("fn"), F.count_if(~truth & (score < t)).alias("tn")).alias(f"t{i}") for i, t in enumerate(th)])
    rows = sums.select(F.explode(F.array(*sums.columns)).alias("m")).select("m.*")
    one = F.lit(1).cast("long")
    return rows.select("th", "tp", "fp", "fn", "tn", F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), one), 6).alias("precision"), F.round(F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), one), 6).alias("recall"))


@query("level_statistics", "SELECT node_id, round(sqrt(avg(value * value)), 6) AS rms, round(max(value), 6) AS peak, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.95), 6) AS p95 FROM {detections} GROUP BY node_id")
def _(v):
    return v.detections.groupBy("node_id").agg(F.round(F.sqrt(F.avg(F.col("value") * F.col("value"))), 6).alias("rms"), F.round(F.max("value"), 6).alias("peak"), F.round(F.percentile("value", F.lit(0.5)), 6).alias("p50"), F.round(F.percentile("value", F.lit(0.95)), 6).alias("p95"))


@query("ble_latest", f"SELECT mac, node_id, max_by(rssi, (recv_ns, id)) AS rssi, max(recv_ns) AS recv_ns, count(*) AS n FROM {{ble}} WHERE recv_ns >= {NOW_NS - 1800 * SECOND} GROUP BY mac, node_id")
def _(v):
    return v.ble.where(F.col("recv_ns") >= NOW_NS - 1800 * SECOND).groupBy("mac", "node_id").agg(F.max_by("rssi", F.struct("recv_ns", "id")).alias("rssi"), F.max("recv_ns").alias("recv_ns"), F.count("*").alias("n"))


@query("retention_storage", "SELECT retention_tier, label_category, count(*) AS n, min(timestamp_ns) AS oldest_ns FROM {detections} GROUP BY 1, 2")
def _(v):
    return v.detections.groupBy("retention_tier", "label_category").agg(F.count("*").alias("n"), F.min("timestamp_ns").alias("oldest_ns"))
