"""Sample buffers of sensors: frames on one sample index, what is covered, and aligned windows.

Frames come late, twice, overlapping and with holes; a clock that is corrected begins a new epoch. Nothing is appended to a
buffer in memory: a frame's place on the index is a column, coverage is a union of intervals by running maxima over buckets
of the index, and a window meets the frames that reach into it on buckets of the index. Where frames overlap, the one
received last counts; what no frame covers is 0.

Frames: sensor, received_ns, start_ns, start_index (null: by time), samples. Edge cases: frames without sensor, time or
samples are left out; null samples are 0 and covered; repeated frames count once; an empty table gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .timeline import previous, running

SECOND = 1_000_000_000


def placed_frames(frames: DataFrame, rate: int, most_s: float = 60.0) -> DataFrame:
    """``frames`` with ``epoch``, ``first`` and ``end`` (sample indices, the end excluded).

    In order of receipt, an epoch ends where a frame's index jumps by more than ``most_s`` beyond the frame before it, or
    where its time and index disagree with that frame's by more than that. Frames without an index are placed by their
    time; one that misses the end of the frame before by less than half of its length continues there.
    """
    rows = frames.where("sensor is not null and received_ns is not null and start_ns is not null and size(samples) > 0").dropDuplicates(["sensor", "received_ns", "start_ns", "start_index"])
    n = F.size("samples").cast("long")
    by_time = F.expr(f"CAST(floor((start_ns div 1000) * {rate} / 1000000D + 0.5D) AS BIGINT)")
    rows = rows.withColumn("_given", F.col("start_index").isNotNull()).withColumn("_at", F.coalesce(F.col("start_index").cast("long"), by_time)).withColumn("_end", F.col("_at") + n)
    rows = rows.withColumn("_shift", F.col("start_ns") - F.when(F.col("_given"), F.expr(f"CAST(_at * {SECOND}D / {rate} AS BIGINT)")).otherwise(F.col("start_ns")))
    rows = previous(rows, ["sensor"], ["received_ns", "_at"], ["_at", "_end", "_shift", "_given"])
    jump = (F.col("_at") > F.col("before._end") + int(most_s * rate)) | (F.col("_at") < F.col("before._at") - int(most_s * rate))
    corrected = F.col("_given") & F.col("before._given") & (F.abs(F.col("_shift") - F.col("before._shift")) > int(most_s * SECOND))
    cut = F.col("before").isNull() | jump | corrected
    miss = F.col("_at") - F.col("before._end")
    snapped = ~F.col("_given") & ~F.coalesce(cut, F.lit(True)) & (F.abs(miss) < F.greatest(F.expr("size(samples) div 2"), F.lit(1)))
    rows = running(rows.withColumn("_cut", F.coalesce(cut, F.lit(True)).cast("long")), ["sensor"], ["received_ns", "_at"], F.col("_cut"), "epoch")
    first = F.when(snapped, F.col("before._end")).otherwise(F.col("_at"))
    return rows.select("sensor", F.col("epoch").cast("long").alias("epoch"), "received_ns", first.alias("first"), (first + n).alias("end"), "samples")


def coverage(placed: DataFrame, bucket: int = 1 << 20) -> DataFrame:
    """(sensor, epoch, first, end) of the stretches without a hole."""
    keys = ["sensor", "epoch"]
    rows = running(placed.select(*keys, "first", "end").distinct(), keys, ["first", "end"], F.col("end"), "_upto", kind="max", bucket=bucket, own=False)
    rows = rows.withColumn("_new", (F.col("_upto").isNull() | (F.col("first") > F.col("_upto"))).cast("long"))
    rows = running(rows, keys, ["first", "end"], F.when(F.col("_new") == 1, F.col("first")), "_begin", kind="max", bucket=bucket)
    return rows.groupBy(*keys, F.col("_begin").alias("first")).agg(F.max("end").alias("end")).select(*keys, "first", "end")


def windows(placed: DataFrame, wanted: DataFrame, bucket: int = 1 << 16) -> DataFrame:
    """(window, sensor, epoch, covered, samples) of ``wanted`` (window, sensor, epoch, first, end).

    Windows and frames meet on buckets of the index; a window has as many pieces as frames reach into it. Windows that no
    frame reaches come with zeros.
    """
    spread = lambda a, b: F.explode(F.sequence(F.floor(a / bucket), F.floor((b - 1) / bucket)))
    keys = ["sensor", "epoch", "_b"]
    w = wanted.where(F.col("end") > F.col("first")).select("window", "sensor", "epoch", F.col("first").alias("_f"), F.col("end").alias("_e"))
    p = placed.withColumn("_b", spread(F.col("first"), F.col("end")))
    met = w.withColumn("_b", spread(F.col("_f"), F.col("_e"))).join(p, keys).where((F.col("first") < F.col("_e")) & (F.col("end") > F.col("_f")))
    # a frame and a window that share several buckets meet in the first of them
    met = met.where(F.col("_b") == F.floor(F.greatest("first", "_f") / bucket))
    low, high = F.greatest("first", "_f"), F.least("end", "_e")
    piece = F.struct("received_ns", (low - F.col("_f")).cast("int").alias("at"), F.slice("samples", (low - F.col("first") + 1).cast("int"), (high - low).cast("int")).alias("x"))
    of = met.groupBy("window", "sensor", "epoch").agg(F.array_sort(F.collect_list(piece)).alias("pieces"))
    rows = w.join(of, ["window", "sensor", "epoch"], "left")
    size = (F.col("_e") - F.col("_f")).cast("int")
    blank = F.array_repeat(F.lit(None).cast("double"), size)

    def over(line, p):
        x = F.transform(p.x, lambda v: F.coalesce(v.cast("double"), F.lit(0.0)))
        return F.concat(F.slice(line, 1, p.at), x, F.slice(line, p.at + F.size(x) + 1, size))

    line = F.coalesce(F.aggregate("pieces", blank, over), blank)
    rows = rows.withColumn("_line", line)
    return rows.select("window", "sensor", "epoch", F.size(F.filter("_line", lambda v: v.isNotNull())).cast("long").alias("covered"), F.transform("_line", lambda v: F.coalesce(v, F.lit(0.0))).alias("samples"))


def synchronized(filled: DataFrame, sensors: int, least: float) -> DataFrame:
    """Windows of which ``sensors`` sensors at least are covered by the share ``least``."""
    good = filled.where(F.col("covered") >= least * F.size("samples"))
    ready = good.groupBy("window").agg(F.countDistinct("sensor").alias("n")).where(F.col("n") >= sensors).select("window")
    return good.join(ready, "window", "left_semi")


def level_db(samples) -> F.Column:
    total = F.aggregate(F.transform(samples, lambda x: x * x), F.lit(0.0), lambda a, b: a + b)
    return 20 * F.log10(F.sqrt(total / F.size(samples)) + 1e-9)


def sensor_summaries(placed: DataFrame, filled: DataFrame) -> DataFrame:
    """(sensor, epochs, frames, covered, holes, span, last_received_ns, level_db): of all epochs; the level is of the last window."""
    frames = placed.groupBy("sensor").agg(F.count("*").alias("frames"), F.max("received_ns").alias("last_received_ns"))
    each = coverage(placed).groupBy("sensor", "epoch").agg(F.sum(F.col("end") - F.col("first")).alias("covered"), F.count("*").alias("n"), (F.max("end") - F.min("first")).alias("span"))
    each = each.groupBy("sensor").agg(F.count("*").alias("epochs"), F.sum("covered").alias("covered"), F.sum(F.col("n") - 1).alias("holes"), F.sum("span").alias("span"))
    last = filled.groupBy("sensor").agg(F.max_by(level_db(F.col("samples")), F.struct("epoch", "window")).alias("level_db"))
    return frames.join(each, "sensor").join(last, "sensor", "left").select("sensor", "epochs", "frames", "covered", "holes", "span", "last_received_ns", "level_db")
