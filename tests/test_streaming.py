"""Streaming forms against their batch forms."""

import uuid

from pyspark.sql import functions as F

from earshot.operators.cooldown import with_cooldown
from earshot.sources.views import SECOND, Views
from earshot.streaming.events import report_windows, triggers

SF = "/root/testdata/sf0.001"


def run(spark, df, mode="append"):
    name = "q" + uuid.uuid4().hex
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None
    return spark.table(name).collect()


def test_triggers_equal_batch(spark, tmp_path):
    rows = Views(spark, SF).detections.where("value >= 50").select("node_id", "id", "timestamp_ns")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    schema = "node_id long, id long, timestamp_ns long"
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    got = {r.id for r in run(spark, triggers(stream, "node_id", "timestamp_ns", 600 * SECOND, schema))}
    want = {r.id for r in with_cooldown(rows, "node_id", "timestamp_ns", "id", 600 * SECOND).where("fired").collect()}
    assert got == want and want


def test_report_windows_close_in_order(spark, tmp_path):
    d = Views(spark, SF).detections.select("id", "node_id", "label", "reporting_modality", F.timestamp_micros(F.expr("timestamp_ns div 1000")).alias("ts"), "report_window_start_ns")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(d.schema).parquet(str(tmp_path / "in"))
    got = run(spark, report_windows(stream), "complete")
    assert len(got) == d.select("node_id", "label", "report_window_start_ns").distinct().count()


def test_cooldown_boundary(spark):
    rows = spark.createDataFrame([("a", 1, 0), ("a", 2, 9), ("a", 3, 10), ("a", 4, 19), ("b", 5, 19), ("a", 6, 20)], "k string, id long, t long")
    got = {r.id for r in with_cooldown(rows, "k", "t", "id", 10).where("fired").collect()}
    assert got == {1, 3, 5, 6}
    assert with_cooldown(rows.where("false"), "k", "t", "id", 10).count() == 0
