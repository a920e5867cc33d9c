"""Areas with polygons: which points lie in which, what an area forbids, who is in it.

Points and areas meet on cells of a grid as wide as the area's bounding box (an equi-join, whatever the number and size of
areas); the even-odd rule decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.geo import in_polygon
from ..functions.text import normal_set
from ..operators.cells import by_cells
from ..sources.views import DAY, NOW_NS
from . import query

INSIDE_SQL = "len(list_filter(range(1, len(a.polygon) + 1), lambda i: ((a.polygon[i][1] > d.lat) <> (a.polygon[i % len(a.polygon) + 1][1] > d.lat)) AND d.lon < (a.polygon[i % len(a.polygon) + 1][2] - a.polygon[i][2]) * (d.lat - a.polygon[i][1]) / (a.polygon[i % len(a.polygon) + 1][1] - a.polygon[i][1] + 1e-12) + a.polygon[i][2])) % 2 = 1"


def inside(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Rows of ``points`` (lat, lon) with each of the ``areas`` (polygon) that they lie in."""
    lat, lon = F.transform("polygon", lambda p: p[0]), F.transform("polygon", lambda p: p[1])
    boxes = areas.withColumn("_y0", F.array_min(lat)).withColumn("_y1", F.array_max(lat)).withColumn("_x0", F.array_min(lon)).withColumn("_x1", F.array_max(lon))
    met = by_cells(points, boxes, ("lat", "lon"), ("_y0", "_y1", "_x0", "_x1"))
    return met.where(in_polygon(F.col("lat"), F.col("lon"), F.col("polygon"))).drop("_y0", "_y1", "_x0", "_x1")


@query("area_scan", "SELECT zone_id, name, kind, array_to_string(only_labels, ',') AS only_labels, len(polygon)::BIGINT AS vertices FROM {areas} ORDER BY zone_id")
def _(v):
    return v.areas.select("zone_id", "name", "kind", F.array_join("only_labels", ",").alias("only_labels"), F.size("polygon").cast("long").alias("vertices")).orderBy("zone_id")


@query("area_detections", f"SELECT a.zone_id, d.label, count(*) AS n FROM {{detections}} d JOIN {{areas}} a ON {INSIDE_SQL} GROUP BY 1, 2")
def _(v):
    return inside(v.detections, v.areas).groupBy("zone_id", "label").agg(F.count("*").alias("n"))


@query("area_occupancy", f"SELECT a.zone_id, count(DISTINCT d.track_id) AS tracks, coalesce(string_agg(DISTINCT d.label, ',' ORDER BY d.label), '') AS labels, count(d.track_id) > 0 AS occupied FROM {{areas}} a LEFT JOIN {{detections}} d ON d.track_id IS NOT NULL AND d.timestamp_ns >= {NOW_NS - 4 * DAY} AND {INSIDE_SQL} GROUP BY a.zone_id")
def _(v):
    return occupancy(v.detections.where(F.col("track_id").isNotNull() & (F.col("timestamp_ns") >= NOW_NS - 4 * DAY)), v.areas)


def occupancy(points: DataFrame, areas: DataFrame) -> DataFrame:
    """Every area with the tracks and labels inside."""
    found = inside(points, areas).groupBy("zone_id").agg(F.countDistinct("track_id").alias("tracks"), F.array_join(F.array_sort(F.collect_set("label")), ",").alias("labels"))
    rows = areas.select("zone_id").join(found, "zone_id", "left")
    return rows.select("zone_id", F.coalesce("tracks", F.lit(0)).cast("long").alias("tracks"), F.coalesce("labels", F.lit("")).alias("labels"), F.col("tracks").isNotNull().alias("occupied"))


_KEYS_SQL = "SELECT *, list_transform({0}, lambda x: lower(trim(x))) AS l, list_transform({1}, lambda x: lower(trim(x))) AS c FROM {{areas}}"


@query(
    "area_policies",
    f"""WITH s AS ({_KEYS_SQL.format('suppress_labels', 'suppress_categories')}), o AS ({_KEYS_SQL.format('only_labels', 'only_categories')}), r AS (
    SELECT d.id, unnest([CASE WHEN a.kind = 'exclusion' AND len(l) + len(c) = 0 THEN 'suppressed_by_exclusion_zone:' || a.zone_id END, CASE WHEN list_contains(l, lower(d.label)) OR list_contains(c, lower(d.label_category)) THEN 'suppressed_by_zone_rule:' || a.zone_id END]) AS reason FROM {{detections}} d JOIN s a ON {INSIDE_SQL}
    UNION ALL SELECT d.id, 'outside_required_zone:' || a.zone_id FROM {{detections}} d JOIN o a ON (list_contains(l, lower(d.label)) OR list_contains(c, lower(d.label_category))) AND NOT ({INSIDE_SQL}))
    SELECT d.id, coalesce(string_agg(DISTINCT r.reason, ',' ORDER BY r.reason), '') AS reasons, count(r.reason) > 0 AS suppressed FROM {{detections}} d LEFT JOIN r ON r.id = d.id GROUP BY d.id""",
)
def _(v):
    return policies(v.detections, v.areas)


def policies(points: DataFrame, areas: DataFrame) -> DataFrame:
    """(id, reasons, suppressed) of every point (id, label, label_category, lat, lon).

    It is suppressed by each area that it lies in and that excludes all (an exclusion without lists) or lists its label or
    category, and by each area that it doesn't lie in and that requires its label or category. Reasons carry the area's
    id. ``areas`` have their lists in suppress_labels, suppress_categories, only_labels and only_categories (null: empty).
    """
    label, category = F.lower(F.trim("label")), F.lower(F.trim("label_category"))
    rows = points.select("id", "lat", "lon", label.alias("label"), category.alias("label_category"))
    listed = areas.select("zone_id", "kind", "polygon", *[normal_set(F.coalesce(c, F.array().cast("array<string>"))).alias(c) for c in ("suppress_labels", "suppress_categories", "only_labels", "only_categories")])
    met = inside(rows, listed)
    rule = F.array_contains("suppress_labels", F.col("label")) | F.array_contains("suppress_categories", F.col("label_category"))
    everything = (F.col("kind") == "exclusion") & (F.size("suppress_labels") + F.size("suppress_categories") == 0)
    reason = F.when(everything, F.concat(F.lit("suppressed_by_exclusion_zone:"), "zone_id")).when(rule, F.concat(F.lit("suppressed_by_zone_rule:"), "zone_id"))
    by_area = met.select("id", reason.alias("reason")).where("reason is not null")
    required = [rows.join(listed.select("zone_id", F.explode(c).alias(own)), own).select("id", "zone_id") for c, own in (("only_labels", "label"), ("only_categories", "label_category"))]
    outside = required[0].unionByName(required[1]).distinct().join(met.select("id", "zone_id"), ["id", "zone_id"], "left_anti")
    reasons = by_area.unionByName(outside.select("id", F.concat(F.lit("outside_required_zone:"), "zone_id").alias("reason")))
    of = reasons.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons"))  # an area's reason each
    return points.select("id").join(of, "id", "left").select("id", F.coalesce("reasons", F.lit("")).alias("reasons")).withColumn("suppressed", F.col("reasons") != "")


@query("area_admission", f"SELECT d.node_id, count(*) AS kept FROM {{detections}} d WHERE NOT EXISTS (SELECT 1 FROM {{areas}} a WHERE a.kind = 'exclusion' AND {INSIDE_SQL}) GROUP BY d.node_id")
def _(v):
    out = inside(v.detections.select("id", "lat", "lon"), v.areas.where("kind = 'exclusion'")).select("id")
    return v.detections.join(out, "id", "left_anti").groupBy("node_id").agg(F.count("*").alias("kept"))


def live_filter(df: DataFrame, areas: DataFrame | None = None, categories=(), labels=(), min_confidence: float | None = None, statuses=()) -> DataFrame:
    """What a subscriber with these filters gets; an empty filter lets all pass.

    Rows that are neither a detection nor a track (``label``, ``track_status`` and ``label_category`` are null: states of nodes)
    always pass; a missing category is "unknown", a missing confidence 0.
    """
    status = F.lower(F.trim("track_status")) if "track_status" in df.columns else F.lit(None).cast("string")
    system = F.col("label").isNull() & F.col("label_category").isNull() & status.isNull()
    keep = F.lit(True)
    if categories:
        keep = keep & F.lower(F.trim(F.coalesce("label_category", F.lit("unknown")))).isin(*[x.strip().lower() for x in categories])
    if labels:
        keep = keep & F.coalesce(F.lower(F.trim("label")).isin(*[x.strip().lower() for x in labels]), F.lit(False))
    if statuses:
        keep = keep & F.coalesce(status.isin(*[x.strip().lower() for x in statuses]), F.lit(False))
    if min_confidence is not None:
        keep = keep & (F.coalesce("label_confidence", F.lit(0.0)) >= min_confidence)
    out = df.where(system | keep)
    if areas is None:
        return out
    near = inside(out.select("id", "lat", "lon"), areas).select("id")
    return out.where(~system).join(near, "id", "left_semi").unionByName(out.where(system))


@query("live_subscription", f"SELECT d.id, d.label, d.label_confidence FROM {{detections}} d LEFT JOIN {{tracks}} t ON t.track_id = d.track_id WHERE d.label_category IN ('bird', 'human') AND lower(d.label) IN ('view', 'click') AND d.label_confidence >= 0.3 AND t.status IN ('confirmed', 'dropped') AND EXISTS (SELECT 1 FROM {{areas}} a WHERE a.zone_id IN (1, 2) AND {INSIDE_SQL})")
def _(v):
    rows = v.detections.join(v.tracks.select("track_id", F.col("status").alias("track_status")), "track_id", "left")
    return live_filter(rows, v.areas.where("zone_id in (1, 2)"), ("bird", "human"), ("View", "click"), 0.3, ("Confirmed", "dropped")).select("id", "label", "label_confidence")
