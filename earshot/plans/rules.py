"""Rules, retention and zone policies: ordered predicates with reasons, folds over policies, cooldowns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.cells import by_cells
from ..operators.cooldown import with_cooldown
from ..sources.views import DAY, NOW_NS, SECOND
from . import query
from .joins import in_zone

#: Id, categories, modality, least confidence, cooldown in seconds.
RULES = [("security", ("security",), None, 0.5, 300), ("vehicle_located", ("vehicle",), "localized", 0.4, 60), ("wildlife", ("wildlife", "bird"), "omni", 0.8, 600)]


def first_failing(rule) -> F.Column:
    """Why a detection doesn't match, by the first test that fails in order; null: it matches."""
    _, categories, modality, least, _ = rule
    reason = F.when(~F.col("label_category").isin(*categories), "category")
    if modality:
        reason = reason.when(F.col("reporting_modality") != modality, "modality")
    return reason.when(F.col("label_confidence") < least, "confidence")


def _reason_sql(rule) -> str:
    _, categories, modality, least, _ = rule
    names = ", ".join(f"'{c}'" for c in categories)
    return f"CASE WHEN label_category NOT IN ({names}) THEN 'category'" + (f" WHEN reporting_modality <> '{modality}' THEN 'modality'" if modality else "") + f" WHEN label_confidence < {least} THEN 'confidence' END"


@query("rule_reasons", "SELECT rule_id, coalesce(reason, 'matched') AS reason, count(*) AS n FROM (" + " UNION ALL ".join(f"SELECT '{r[0]}' AS rule_id, {_reason_sql(r)} AS reason FROM {{detections}}" for r in RULES) + ") GROUP BY 1, 2")
def _(v):
    each = F.explode(F.array(*[F.struct(F.lit(r[0]).alias("rule_id"), F.coalesce(first_failing(r), F.lit("matched")).alias("reason")) for r in RULES]))
    return v.detections.select(each.alias("r")).groupBy("r.rule_id", "r.reason").agg(F.count("*").alias("n"))


@query("rule_actions")
def _(v):
    """Matches that fire: per rule, at least its cooldown after the last that fired."""
    out = None
    for rule in RULES:
        rows = v.detections.where(first_failing(rule).isNull()).select(F.lit(rule[0]).alias("rule_id"), "id", "timestamp_ns")
        fired = with_cooldown(rows, "rule_id", "timestamp_ns", "id", rule[4] * SECOND).where("fired").drop("fired")
        out = fired if out is None else out.unionByName(fired)
    return out


@query("transcript_rules", "SELECT id, node_id FROM {transcripts} WHERE contains(lower(text), 'licensed under') OR contains(lower(text), 'all rights')")
def _(v):
    text = F.lower("text")
    return v.transcripts.where(text.contains("licensed under") | text.contains("all rights")).select("id", "node_id")


@query("zone_policies", "SELECT d.id, count(*) FILTER (suppressed) > 0 AS suppressed, coalesce(string_agg(DISTINCT CASE WHEN suppressed THEN reason END, ',' ORDER BY CASE WHEN suppressed THEN reason END), '') AS reasons FROM (SELECT d.id, z.zone_id % 2 = 0 AND d.label = 'view' AS suppressed, 'suppress_label:' || z.zone_id AS reason FROM {detections} d LEFT JOIN {zones} z ON d.lat >= z.lat_min AND d.lat < z.lat_max AND d.lon >= z.lon_min AND d.lon < z.lon_max) d GROUP BY d.id")
def _(v):
    bad = v.zones.where("zone_id % 2 = 0").select("zone_id", "lat_min", "lat_max", "lon_min", "lon_max")
    met = by_cells(v.detections.where("label = 'view'").select("id", "lat", "lon"), bad, ("lat", "lon"), ("lat_min", "lat_max", "lon_min", "lon_max")).where(in_zone())
    of = met.groupBy("id").agg(F.array_join(F.array_sort(F.collect_set(F.concat(F.lit("suppress_label:"), F.col("zone_id")))), ",").alias("reasons"))
    return v.detections.select("id").join(of, "id", "left").select("id", F.col("reasons").isNotNull().alias("suppressed"), F.coalesce("reasons", F.lit("")).alias("reasons"))


@query("retention_tiers", "SELECT id, CASE WHEN id % 11 = 0 THEN 'ephemeral' WHEN label IN ('purchase') THEN 'permanent' WHEN label_category = 'security' AND label_confidence >= 0.8 THEN 'long' ELSE 'short' END AS tier FROM {detections}")
def _(v):
    tier = F.when(F.col("id") % 11 == 0, "ephemeral").when(F.col("label").isin("purchase"), "permanent").when((F.col("label_category") == "security") & (F.col("label_confidence") >= 0.8), "long").otherwise("short")
    return v.detections.select("id", tier.alias("tier"))


#: Priority, tier or null, category or null, days to keep; null: keep.
POLICIES = [(10, "ephemeral", None, 1), (20, None, "bird", 7), (30, "long", None, 25), (40, "permanent", None, None)]


@query("retention_expired", f"SELECT id, timestamp_ns FROM (SELECT *, CASE WHEN retention_tier = 'permanent' THEN NULL WHEN retention_tier = 'long' THEN 25 WHEN label_category = 'bird' THEN 7 WHEN retention_tier = 'ephemeral' THEN 1 ELSE 14 END AS days FROM {{detections}}) WHERE timestamp_ns < {NOW_NS} - days * {DAY}")
def _(v):
    # the last matching policy in order of priority decides
    days = F.lit(14)
    for _, tier, category, keep in sorted(POLICIES, key=lambda p: p[0]):
        test = F.lit(True)
        if tier:
            test = test & (F.col("retention_tier") == tier)
        if category:
            test = test & (F.col("label_category") == category)
        days = F.when(test, F.lit(keep).cast("int")).otherwise(days)
    return v.detections.withColumn("days", days).where(F.col("timestamp_ns") < F.lit(NOW_NS) - F.col("days") * F.lit(DAY)).select("id", "timestamp_ns")


@query("unknown_suppression", "SELECT label, count(*) AS shown FROM {detections} WHERE NOT (label = 'error' AND label_confidence < 0.05) GROUP BY label")
def _(v):
    return v.detections.where(~((F.col("label") == "error") & (F.col("label_confidence") < 0.05))).groupBy("label").agg(F.count("*").alias("shown"))


@query("display_modes", "SELECT CASE WHEN reporting_modality <> 'localized' THEN 'node_only' WHEN id % 10 = 0 THEN 'bearing_only' ELSE 'localized' END AS mode, count(*) AS n FROM {detections} GROUP BY 1")
def _(v):
    mode = F.when(F.col("reporting_modality") != "localized", "node_only").when(F.col("id") % 10 == 0, "bearing_only").otherwise("localized")
    return v.detections.groupBy(mode.alias("mode")).agg(F.count("*").alias("n"))
