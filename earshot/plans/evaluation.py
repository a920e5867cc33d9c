"""How well detections fit a known truth, and training rows: matches, calibration reports, thresholds, splits, balance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.nearest import greedy, nearest
from ..sources.views import SECOND
from . import query
from .aggregates import _METRICS_SQL, _SCORED_SQL, _scored
from .measures import placed

_PLACED_SQL = "SELECT *, (lon + 93.2565) * 78846.0 AS x, (lat - 44.98) * 111131.0 AS y FROM {detections}"
SLOP = 600 * SECOND


def calibration_report(truth: DataFrame, found: DataFrame, slop_ns: int) -> DataFrame:
    """Per label of ``truth`` (truth_id, truth_label, truth_ns, tx, ty): events, recall, share of nearest detections with the
    label, median and 90th percentile (interpolated) of the nearest detection's distance."""
    events = truth.select(F.col("truth_id").alias("id"), F.col("truth_label").alias("label"), F.col("truth_ns").alias("timestamp_ns"), F.col("tx").alias("x"), F.col("ty").alias("y"))
    timeless = events.where("timestamp_ns is null").selectExpr("label AS truth_label", "cast(null AS string) AS near_label", "cast(null AS long) AS near_id", "cast(null AS double) AS m")
    rows = nearest(events, found, slop_ns).unionByName(timeless)
    m = F.col("m")
    return rows.groupBy("truth_label").agg(F.count("*").alias("events"), F.round(F.avg(m.isNotNull().cast("double")), 6).alias("recall"), F.round(F.avg((F.col("near_label") == F.col("truth_label")).cast("double")), 6).alias("accuracy"), F.round(F.percentile(m, F.lit(0.5)), 4).alias("median_m"), F.round(F.percentile(m, F.lit(0.9)), 4).alias("p90_m"))


@query(
    "calibration_report",
    f"""WITH p AS ({_PLACED_SQL}), t AS (SELECT * FROM p WHERE review_state = 'confirmed'), b AS (SELECT t.id, t.label AS truth_label, d.label, row_number() OVER (PARTITION BY t.id ORDER BY sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)), d.id) AS r, sqrt((d.x - t.x) * (d.x - t.x) + (d.y - t.y) * (d.y - t.y)) AS m FROM t LEFT JOIN p d ON d.id <> t.id AND abs(d.timestamp_ns - t.timestamp_ns) <= {SLOP})
    SELECT truth_label, count(*) AS events, round(avg(CASE WHEN m IS NOT NULL THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS recall, round(avg(CASE WHEN label IS NULL THEN NULL WHEN label = truth_label THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS accuracy, round(quantile_cont(m, 0.5), 4) AS median_m, round(quantile_cont(m, 0.9), 4) AS p90_m FROM b WHERE r = 1 GROUP BY 1""",
)
def _(v):
    rows = placed(v).select("id", "label", "timestamp_ns", "x", "y", "review_state")
    truth = rows.where("review_state = 'confirmed'").select(F.col("id").alias("truth_id"), F.col("label").alias("truth_label"), F.col("timestamp_ns").alias("truth_ns"), F.col("x").alias("tx"), F.col("y").alias("ty"))
    return calibration_report(truth, rows.drop("review_state"), SLOP)


def greedy_matches(truth: DataFrame, found: DataFrame, max_ns: int, max_m: float) -> DataFrame:
    """(matched, missed, extra, confused): in order of (time, id) each true event takes the nearest detection in reach that no
    earlier one took (of equally near ones the first by time, then id).

    Blocks of time take side by side, and again where what was taken near their border has changed (see ``nearest.greedy``).
    ``truth`` and ``found``: id, label, timestamp_ns, x, y.
    """
    t, d = (df.withColumn("label", F.lower(F.trim("label"))) for df in (truth, found))
    hits = greedy(t, d, max_ns, max_m).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "confused")])
    counts = truth.agg(F.count("*").alias("n")).crossJoin(found.agg(F.count("*").alias("m"))).crossJoin(hits)  # single rows
    return counts.select("matched", (F.col("n") - F.col("matched")).alias("missed"), (F.col("m") - F.col("matched")).alias("extra"), "confused")


@query("event_matches")
def _(v):
    rows = placed(v)
    columns = ["id", "label", "timestamp_ns", "x", "y"]
    return greedy_matches(rows.where("review_state = 'confirmed'").select(*columns), rows.where("review_state <> 'confirmed'").select(*columns), 300 * SECOND, 200.0)


@query("best_threshold", f"SELECT th, round(f1, 6)::DOUBLE AS f1 FROM (SELECT th, 2.0 * tp / greatest(2 * tp + fp + fn, 1) AS f1 FROM (SELECT th, {_METRICS_SQL} FROM ({_SCORED_SQL}), (SELECT unnest(range(1, 20)) * 250.0::DOUBLE AS th) GROUP BY th)) ORDER BY f1 DESC, th LIMIT 1")
def _(v):
    th = F.explode(F.array(*[F.struct(F.lit(250.0 * k).alias("th"), (F.col("score") >= 250.0 * k).alias("said")) for k in range(1, 20)]))
    rows = _scored(v).select("truth", th.alias("t")).groupBy("t.th").agg(F.count_if(F.col("truth") & F.col("t.said")).alias("tp"), F.count_if(~F.col("truth") & F.col("t.said")).alias("fp"), F.count_if(F.col("truth") & ~F.col("t.said")).alias("fn"))
    f1 = 2.0 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))
    return rows.select("th", f1.alias("f1")).orderBy(F.desc("f1"), "th").limit(1).select("th", F.round("f1", 6).alias("f1"))


@query("clip_scores", "SELECT track_id AS clip, round(avg(label_confidence), 6) AS score, max(CASE WHEN review_state = 'confirmed' THEN 1 ELSE 0 END) = 1 AS positive, round(avg(CASE WHEN label_confidence >= 0.5 THEN 1.0 ELSE 0.0 END), 6)::DOUBLE AS vote FROM {detections} WHERE track_id IS NOT NULL GROUP BY 1")
def _(v):
    rows = v.detections.where("track_id is not null").groupBy(F.col("track_id").alias("clip"))
    return rows.agg(F.round(F.avg("label_confidence"), 6).alias("score"), F.max(F.col("review_state") == "confirmed").alias("positive"), F.round(F.avg((F.col("label_confidence") >= 0.5).cast("double")), 6).alias("vote"))


@query("group_split", "SELECT id, fold FROM (SELECT d.id, CASE WHEN d.id % 5 <> 0 THEN g.fold WHEN coalesce(g.fold, 'train') = 'train' THEN 'train' END AS fold FROM {detections} d LEFT JOIN (SELECT label, node_id, CASE WHEN r <= greatest(1, round_even(n * 0.1, 0)) AND n > 2 THEN 'test' WHEN r <= 2 * greatest(1, round_even(n * 0.1, 0)) AND n > 2 THEN 'val' WHEN n = 2 AND r = 1 THEN 'test' ELSE 'train' END AS fold FROM (SELECT label, node_id, row_number() OVER (PARTITION BY label ORDER BY sha256(concat(label, '/', node_id))) AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT label, node_id FROM {detections} WHERE id % 5 <> 0))) g ON g.label = d.label AND g.node_id = d.node_id) WHERE fold IS NOT NULL")
def _(v):
    return group_split(v.detections.select("id", "label", F.col("node_id").alias("group"), (F.col("id") % 5 == 0).alias("copy"))).select("id", "fold")


def group_split(rows: DataFrame, test: float = 0.1, val: float = 0.1) -> DataFrame:
    """Rows (label, group, copy) with a fold: per label whole groups of real rows go to test and val, by a hash; copies of
    groups outside train are left out. One group alone is train, of two one is test."""
    groups = rows.where("not copy").select("label", "group").distinct().withColumn("h", F.sha2(F.concat_ws("/", "label", "group"), 256))
    listed = groups.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("h", "group"))).alias("g")).withColumn("n", F.size("g"))  # a row per source
    ranked = listed.select("label", "n", F.posexplode("g").alias("r", "g")).select("label", "n", "r", "g.group")
    first = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(test), 0).cast("int"))
    second = first + F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(val), 0).cast("int"))
    fold = F.when((F.col("n") > 2) & (F.col("r") < first), "test").when((F.col("n") > 2) & (F.col("r") < second), "val").when((F.col("n") == 2) & (F.col("r") == 0), "test").otherwise("train")
    out = rows.join(ranked.select("label", "group", fold.alias("own")), ["label", "group"], "left")
    return out.withColumn("fold", F.when(~F.col("copy"), F.col("own")).when(F.coalesce("own", F.lit("train")) == "train", "train")).where("fold is not null").drop("own")


def balance_copies(weights: DataFrame, ratio: float, floor: dict[str, int] | None = None, base: int = 0) -> DataFrame:
    """(label, copies): how often each label's rows are repeated so that none weighs less than the largest one / ``ratio``.

    ``weights``: label, weight. ``floor`` has copies by label that are never lowered, ``base`` those of other labels; labels
    of weight 0 and a ratio of 0 or less change nothing.
    """
    own = F.lit(base)
    for label, copies in (floor or {}).items():
        own = F.when(F.col("label") == label, copies).otherwise(own)
    rows = weights.crossJoin(weights.agg(F.max("weight").alias("most"))).withColumn("own", own)  # a single row
    target = F.col("most") / F.lit(float(ratio)) if ratio > 0 else F.lit(0.0)
    short = (F.col("weight") > 0) & (F.col("weight") * (1 + F.col("own")) < target)
    needed = F.greatest(F.col("own"), F.ceil(F.try_divide(target, F.col("weight"))) - 1)
    return rows.select("label", F.when(short, needed).otherwise(F.col("own")).cast("long").alias("copies"))


@query("balance_copies", "WITH w AS (SELECT label_category || '-' || node_id AS label, sum(label_confidence) AS weight FROM {detections} WHERE node_id <> 2 OR id % 40 = 0 GROUP BY 1) SELECT label, CASE WHEN weight > 0 AND weight * (1 + own) < most / 1.25 THEN greatest(own, ceil(most / 1.25 / weight) - 1) ELSE own END::BIGINT AS copies FROM (SELECT *, max(weight) OVER () AS most, CASE label WHEN 'bird-3' THEN 2 ELSE 0 END AS own FROM w)")
def _(v):
    """One node has a fortieth of its rows left, so that its labels need many copies."""
    w = v.detections.where("node_id <> 2 or id % 40 = 0").groupBy(F.concat_ws("-", "label_category", "node_id").alias("label")).agg(F.sum("label_confidence").alias("weight"))
    return balance_copies(w, 1.25, {"bird-3": 2})
