"""Event-time operators in their batch form: report windows, gaps, sessions, cooldowns, rolling levels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.cooldown import with_cooldown
from ..operators.timeline import previous, running, trailing
from ..sources.views import DAY, HOUR, SECOND, WINDOW_NS
from . import query


@query(
    "canonical_windows",
    "SELECT id, node_id, label, report_window_start_ns, reporting_modality FROM (SELECT *, row_number() OVER (PARTITION BY node_id, lower(label), report_window_start_ns ORDER BY CASE reporting_modality WHEN 'localized' THEN 0 ELSE 1 END, timestamp_ns DESC, id DESC) AS r FROM {detections}) WHERE r = 1",
)
def _(v):
    # one row per key by aggregation, with partial maxima before the shuffle (structs with texts are aggregated by sorting)
    best = F.max(F.struct((F.col("reporting_modality") == "localized").alias("located"), "timestamp_ns", "id", "node_id", "label", "reporting_modality"))
    rows = v.detections.groupBy(F.coalesce(F.col("node_id").cast("string"), F.lit("__none__")).alias("k"), F.lower("label").alias("l"), "report_window_start_ns").agg(best.alias("m"))
    return rows.select("m.id", "m.node_id", "m.label", "report_window_start_ns", "m.reporting_modality")


_EARLIER = "(PARTITION BY {keys} ORDER BY timestamp_ns, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_OWN, _SITE = (_EARLIER.replace("{keys}", k) for k in ("node_id, label, report_window_start_ns", "label, report_window_start_ns"))


def report_decisions(df: DataFrame) -> DataFrame:
    """(id, decision) of detections in order of time: what each does to the report of its node, label and window.

    The first of a node, label and window is inserted, unless it is omni and a localized one of any node came before: then
    it enriches that. Later ones meet the node's own report: localized upgrades omni, omni enriches localized, a repeat of
    the same kind is suppressed.
    """
    located = F.col("reporting_modality") == "localized"
    own, site = (Window.partitionBy(*k, "label", "report_window_start_ns").orderBy("timestamp_ns", "id").rowsBetween(Window.unboundedPreceding, -1) for k in (["node_id"], []))
    rows = df.withColumn("own_located", F.count_if(located).over(own) > 0).withColumn("site_located", F.count_if(located).over(site) > 0)
    rows = rows.withColumn("own_omni", F.count_if(~located & ~F.col("site_located")).over(own) > 0)
    first = F.when(located, F.when(F.col("own_located"), "suppress").when(F.col("own_omni"), "upgrade_existing").otherwise("insert"))
    return rows.select("id", first.when(F.col("own_located"), "enrich_existing").when(F.col("own_omni"), "suppress").when(F.col("site_located"), "enrich_existing").otherwise("insert").alias("decision"))


@query(
    "report_decisions",
    f"""WITH a AS (SELECT *, reporting_modality = 'localized' AS located, count(*) FILTER (reporting_modality = 'localized') OVER {_OWN} > 0 AS own_located, count(*) FILTER (reporting_modality = 'localized') OVER {_SITE} > 0 AS site_located FROM {{detections}}),
    b AS (SELECT *, count(*) FILTER (NOT located AND NOT site_located) OVER {_OWN} > 0 AS own_omni FROM a)
    SELECT id, CASE WHEN located AND own_located THEN 'suppress' WHEN located AND own_omni THEN 'upgrade_existing' WHEN located THEN 'insert' WHEN own_located THEN 'enrich_existing' WHEN own_omni THEN 'suppress' WHEN site_located THEN 'enrich_existing' ELSE 'insert' END AS decision FROM b""",
)
def _(v):
    return report_decisions(v.detections)


@query(
    "window_lookup",
    "SELECT label, report_window_start_ns, arg_max(id, (CASE reporting_modality WHEN 'localized' THEN 1 ELSE 0 END, timestamp_ns, id)) AS any_node, arg_max(id, (timestamp_ns, id)) FILTER (node_id = 3) AS of_node, arg_max(id, (timestamp_ns, id)) FILTER (node_id IS NULL) AS of_none FROM {detections} GROUP BY 1, 2",
)
def _(v):
    return window_lookup(v.detections, 3)


def window_lookup(df: DataFrame, node_id) -> DataFrame:
    """Per label (as written) and report window the id of its report: of any node (localized ones first), of one node, and
    of detections without a node; the newest each."""
    newest = F.struct("timestamp_ns", "id")
    of_node = F.when(F.col("node_id") == F.lit(node_id), newest)
    of_none = F.when(F.col("node_id").isNull(), newest)
    preferred = F.struct((F.col("reporting_modality") == "localized").alias("located"), "timestamp_ns", "id")
    return df.groupBy("label", "report_window_start_ns").agg(F.max(preferred)["id"].alias("any_node"), F.max(of_node)["id"].alias("of_node"), F.max(of_none)["id"].alias("of_none"))


@query(
    "sequence_gaps",
    "SELECT node_id, boot_session, count(*) AS frames, sum(gap)::BIGINT AS missing, count(*) FILTER (gap > 0) AS gaps FROM (SELECT node_id, boot_session, greatest(sequence - (high + 1), 0) AS gap FROM (SELECT *, coalesce(max(sequence) OVER (PARTITION BY node_id, boot_session ORDER BY received_ns, sequence, line, part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), sequence - 1) AS high FROM {frames})) GROUP BY ALL",
)
def _(v):
    order = ["received_ns", "sequence", "line", "part"]
    rows = running(v.frames, ["node_id", "boot_session"], order, F.col("sequence"), "high", "max", 30 * DAY, own=False)
    gap = F.greatest(F.col("sequence") - (F.coalesce(F.col("high"), F.col("sequence") - 1) + 1), F.lit(0))
    return rows.select("node_id", "boot_session", gap.alias("gap")).groupBy("node_id", "boot_session").agg(F.count("*").alias("frames"), F.sum("gap").cast("long").alias("missing"), F.count_if(F.col("gap") > 0).alias("gaps"))


@query("counter_deltas", "SELECT id, node_id, delta, CASE WHEN delta IS NULL THEN 'first' WHEN delta = 0 THEN 'steady' WHEN delta < 50 THEN 'slow' ELSE 'fast' END AS verdict FROM (SELECT id, node_id, CASE WHEN earlier IS NOT NULL THEN greatest(id - earlier, 0) END AS delta FROM (SELECT id, node_id, lag(id) OVER (PARTITION BY node_id ORDER BY timestamp_ns, id) AS earlier FROM {environment}))")
def _(v):
    rows = previous(v.environment, ["node_id"], ["timestamp_ns", "id"], ["id"])
    delta = F.col("id") - F.col("before.id")
    rows = rows.select("id", "node_id", F.when(delta.isNotNull(), F.greatest(delta, F.lit(0))).cast("long").alias("delta"))
    return rows.withColumn("verdict", F.when(F.col("delta").isNull(), "first").when(F.col("delta") == 0, "steady").when(F.col("delta") < 50, "slow").otherwise("fast"))


def sessions(df: DataFrame, keys: list[str], order: list[str], pause: int) -> DataFrame:
    """``df`` with ``session``: numbered from 1 per key; a row later than ``pause`` after the one before begins one."""
    rows = previous(df, keys, order, [order[0]])
    fresh = F.when(F.col(order[0]) - F.col(f"before.{order[0]}") <= pause, 0).otherwise(1)
    return running(rows, keys, order, fresh, "session").drop("before")


@query("sessions", f"WITH m AS (SELECT *, CASE WHEN timestamp_ns - lag(timestamp_ns) OVER (PARTITION BY node_id ORDER BY timestamp_ns, id) <= {HOUR} THEN 0 ELSE 1 END AS fresh FROM {{detections}}), s AS (SELECT *, sum(fresh) OVER (PARTITION BY node_id ORDER BY timestamp_ns, id) AS session FROM m) SELECT node_id, session::BIGINT AS session, min(timestamp_ns) AS start_ns, max(timestamp_ns) AS end_ns, count(*) AS n FROM s GROUP BY node_id, session")
def _(v):
    rows = sessions(v.detections.select("node_id", "timestamp_ns", "id"), ["node_id"], ["timestamp_ns", "id"], HOUR)
    return rows.groupBy("node_id", F.col("session").cast("long").alias("session")).agg(F.min("timestamp_ns").alias("start_ns"), F.max("timestamp_ns").alias("end_ns"), F.count("*").alias("n"))


@query("zone_levels", f"SELECT id, node_id, max(value) OVER (PARTITION BY node_id ORDER BY timestamp_ns RANGE BETWEEN {HOUR} PRECEDING AND CURRENT ROW) AS level FROM {{detections}}")
def _(v):
    return trailing(v.detections.select("id", "node_id", "timestamp_ns", "value"), ["node_id"], "timestamp_ns", "value", HOUR, "level").select("id", "node_id", "level")


@query("coverage_gaps", f"WITH h AS (SELECT DISTINCT node_id, timestamp_ns // {HOUR} AS hour FROM {{detections}}), g AS (SELECT node_id, hour - lag(hour) OVER (PARTITION BY node_id ORDER BY hour) - 1 AS gap FROM h) SELECT node_id, count(*) AS covered, coalesce(sum(gap), 0)::BIGINT AS missing, coalesce(max(gap), 0)::BIGINT AS longest FROM g GROUP BY node_id")
def _(v):
    hours = v.detections.select("node_id", F.expr(f"timestamp_ns div {HOUR}").alias("hour")).distinct()
    gap = F.col("hour") - F.lag("hour").over(Window.partitionBy("node_id").orderBy("hour")) - 1
    return hours.select("node_id", gap.alias("gap")).groupBy("node_id").agg(F.count("*").alias("covered"), F.coalesce(F.sum("gap"), F.lit(0)).cast("long").alias("missing"), F.coalesce(F.max("gap"), F.lit(0)).cast("long").alias("longest"))


@query("label_runs", "WITH r AS (SELECT node_id, label, row_number() OVER (PARTITION BY node_id ORDER BY timestamp_ns, id) - row_number() OVER (PARTITION BY node_id, label ORDER BY timestamp_ns, id) AS run, timestamp_ns FROM {detections}) SELECT node_id, label, min(timestamp_ns) AS start_ns, count(*) AS n FROM r GROUP BY node_id, label, run HAVING count(*) >= 4")
def _(v):
    order = ["timestamp_ns", "id"]
    rows = previous(v.detections.select("node_id", "label", *order), ["node_id"], order, ["label"])
    rows = running(rows, ["node_id"], order, F.when(F.col("before.label") == F.col("label"), 0).otherwise(1), "run")
    return rows.groupBy("node_id", "label", "run").agg(F.min("timestamp_ns").alias("start_ns"), F.count("*").alias("n")).where("n >= 4").drop("run")


@query("window_bounds", f"SELECT report_window_start_ns AS start_ns, report_window_start_ns + {WINDOW_NS} AS end_ns, count(*) AS n FROM {{detections}} GROUP BY 1, 2")
def _(v):
    return v.detections.groupBy(F.col("report_window_start_ns").alias("start_ns"), (F.col("report_window_start_ns") + WINDOW_NS).alias("end_ns")).agg(F.count("*").alias("n"))


@query("frame_identities", "SELECT node_id, boot_session, sequence, count(*) - 1 AS repeats FROM {frames} GROUP BY 1, 2, 3 HAVING count(*) > 1")
def _(v):
    return v.frames.groupBy("node_id", "boot_session", "sequence").agg((F.count("*") - 1).alias("repeats")).where("repeats > 0")


@query("energy_triggers")
def _(v):
    """Events of at least the threshold, at least the cooldown after the last one that fired, per node."""
    loud = v.detections.where("value >= 50").select("node_id", "id", "timestamp_ns", "value")
    return with_cooldown(loud, "node_id", "timestamp_ns", "id", 600 * SECOND).where("fired").drop("fired")
