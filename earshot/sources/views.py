"""Canonical views of the event store, bound to the driver's tables, in Spark and (for the checks) in DuckDB SQL.

A deployment with real tables of these names and columns replaces ``Views`` by one that reads them; all queries take
their inputs from here.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: "Now" of all relative time ranges: 2024-01-31 00:00 UTC.
NOW_NS = 1_706_659_200_000_000_000
SECOND, HOUR, DAY = 1_000_000_000, 3_600_000_000_000, 86_400_000_000_000
WINDOW_NS = 30 * SECOND


def ns_of(column: str) -> F.Column:
    return (F.unix_micros(F.col(column).cast("timestamp")) * 1000).cast("long")


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def detections(self) -> DataFrame:
        k = F.get_json_object("props", "$.k").try_cast("int")
        i = F.col("event_id")
        category = F.expr("CASE event_type WHEN 'view' THEN 'bird' WHEN 'click' THEN 'human' WHEN 'purchase' THEN 'vehicle' WHEN 'signup' THEN 'wildlife' ELSE 'security' END")
        return self.raw("events").select(
            i.alias("id"),
            ns_of("ts").alias("timestamp_ns"),
            (F.col("user_id") % 16).alias("node_id"),
            F.col("event_type").alias("label"),
            category.alias("label_category"),
            ((i * 37 % 100) / F.lit(100.0)).alias("label_confidence"),
            F.when(i % 3 == 0, "localized").otherwise("omni").alias("reporting_modality"),
            F.when(k < 10, None).when(k < 55, "birdnet").otherwise("drone_head").alias("winner_member"),
            ((F.lit(4498000) + i * 7919 % 400) / F.lit(100000.0)).alias("lat"),
            ((F.lit(-9325800) + i * 104729 % 400) / F.lit(100000.0)).alias("lon"),
            F.when((i % 3 != 0) & (i % 5 == 0), None).otherwise(i % 200).alias("track_id"),
            F.expr("CASE event_id % 10 WHEN 0 THEN 'long' WHEN 1 THEN 'ephemeral' WHEN 2 THEN 'permanent' ELSE 'short' END").alias("retention_tier"),
            F.expr("CASE event_id % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'unreviewed' END").alias("review_state"),
            F.expr(f"(unix_micros(cast(ts as timestamp)) * 1000 div {WINDOW_NS}) * {WINDOW_NS}").alias("report_window_start_ns"),
            F.col("value"),
        )

    @cached_property
    def nodes(self) -> DataFrame:
        n = F.col("n_nationkey").cast("long")
        return self.raw("nation").where("n_nationkey < 16").select(
            n.alias("id"), F.col("n_name").alias("name"), ((n % 4) * 50.0).alias("x"), F.expr("(n_nationkey div 4) * 50.0D").alias("y"), (n % 3).cast("double").alias("z"), F.col("n_regionkey").cast("long").alias("cluster_id"), (F.lit(NOW_NS) - n * 5 * SECOND).alias("last_seen_ns")
        )

    @cached_property
    def zones(self) -> DataFrame:
        r = F.col("r_regionkey").cast("double")
        return self.raw("region").select(F.col("r_regionkey").cast("long").alias("zone_id"), F.col("r_name").alias("name"), (F.lit(44.98) + r * 0.0008).alias("lat_min"), (F.lit(44.9812) + r * 0.0008).alias("lat_max"), F.lit(-93.258).alias("lon_min"), F.lit(-93.2555).alias("lon_max"))

    @cached_property
    def areas(self) -> DataFrame:
        """Zones with a polygon of [lat, lon] vertices, not convex, and what they do."""
        z = self.zones
        point = lambda a, b: F.array(a, b)
        lat0, lat1, lon0, lon1 = (F.col(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max"))
        ring = F.array(point(lat0, lon0), point(lat1, lon0), point((lat0 + lat1) / 2, (lon0 + lon1) / 2), point(lat1, lon1), point(lat0, lon1))
        lists = {"suppress_labels": {1: ["view"], 3: ["Purchase"]}, "suppress_categories": {1: ["security"]}, "only_labels": {2: ["signup"], 4: ["signup"]}, "only_categories": {4: ["human"]}}
        columns = [F.coalesce(*[F.when(F.col("zone_id") == k, F.array(*map(F.lit, x))) for k, x in of.items()], F.array().cast("array<string>")).alias(c) for c, of in lists.items()]
        return z.select("zone_id", "name", F.expr("CASE zone_id % 3 WHEN 0 THEN 'exclusion' ELSE 'monitor' END").alias("kind"), *columns, ring.alias("polygon"))

    @cached_property
    def artifacts(self) -> DataFrame:
        i = F.col("o_orderkey")
        return self.raw("orders").select(i.alias("id"), (F.col("o_custkey") % 16).alias("node_id"), i.alias("detection_id"), (F.col("o_custkey") % 250).alias("track_id"), ns_of("o_orderdate").alias("created_ns"), F.col("o_totalprice").alias("bytes"))

    @cached_property
    def frames(self) -> DataFrame:
        return self.raw("lineitem").select((F.col("l_suppkey") % 16).alias("node_id"), F.col("l_linestatus").alias("boot_session"), F.col("l_orderkey").alias("sequence"), ns_of("l_shipdate").alias("received_ns"), F.col("l_linenumber").cast("long").alias("line"), F.col("l_partkey").alias("part"))

    @cached_property
    def tracks(self) -> DataFrame:
        return self.detections.where("track_id is not null").groupBy("track_id").agg(F.min("timestamp_ns").alias("first_seen_ns"), F.max("timestamp_ns").alias("last_seen_ns"), F.count("*").alias("update_count"), F.max_by("label", F.struct("timestamp_ns", "id")).alias("label")).withColumn(
            "status", F.when(F.col("update_count") < 2, "tentative").when(F.col("last_seen_ns") < NOW_NS - 10 * DAY, "dropped").otherwise("confirmed")
        )

    @cached_property
    def environment(self) -> DataFrame:
        return self.raw("events").where("event_type = 'view'").select(F.col("event_id").alias("id"), (F.col("user_id") % 16).alias("node_id"), ns_of("ts").alias("timestamp_ns"), (F.lit(273.15) + (F.col("event_id") * 13 % 400) / F.lit(10.0)).alias("temperature_k"))

    @cached_property
    def observations(self) -> DataFrame:
        channel = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long")))
        return self.detections.select("id", "node_id", "timestamp_ns", channel.alias("channel")).select((F.col("id") * 4 + F.col("channel")).alias("observation_id"), F.col("id").alias("detection_id"), F.concat_ws(":", "node_id", "channel").alias("sensor_id"), ((F.col("node_id") + F.col("channel") * 3) % 16).alias("node_id"), (F.col("timestamp_ns") + F.col("channel") * 1000).alias("toa_ns"), "channel")

    @cached_property
    def bit_reports(self) -> DataFrame:
        i = F.col("o_orderkey")
        return self.raw("orders").select(i.alias("id"), (F.col("o_custkey") % 16).alias("node_id"), F.when(i % 3 == 0, "PBIT").when(i % 3 == 1, "CBIT").otherwise("IBIT").alias("report_type"), ns_of("o_orderdate").alias("timestamp_ns"), F.when(F.col("o_orderpriority").startswith("1"), "FAIL").when(F.col("o_orderpriority").startswith("2"), "DEGRADED").otherwise("PASS").alias("status"))

    @cached_property
    def transcripts(self) -> DataFrame:
        return self.raw("documents").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 16).alias("node_id"), "text", (F.lit(NOW_NS) - F.col("doc_id") * SECOND).alias("created_ns"))

    @cached_property
    def ble(self) -> DataFrame:
        c = F.col("c_custkey")
        return self.raw("customer").select(c.alias("id"), (c % 50).alias("mac"), (F.col("c_nationkey") % 16).cast("long").alias("node_id"), (F.lit(-40) - c % 50).alias("rssi"), (F.lit(NOW_NS) - c * SECOND).alias("recv_ns"))


#: The same views for DuckDB.
DUCKDB_VIEWS = {
    "detections": f"""SELECT event_id AS id, epoch_ns(ts) AS timestamp_ns, user_id % 16 AS node_id, event_type AS label,
        CASE event_type WHEN 'view' THEN 'bird' WHEN 'click' THEN 'human' WHEN 'purchase' THEN 'vehicle' WHEN 'signup' THEN 'wildlife' ELSE 'security' END AS label_category,
        (event_id * 37 % 100) / 100.0::DOUBLE AS label_confidence,
        CASE WHEN event_id % 3 = 0 THEN 'localized' ELSE 'omni' END AS reporting_modality,
        CASE WHEN try_cast(json_extract_string(props,'$.k') AS int) < 10 THEN NULL WHEN try_cast(json_extract_string(props,'$.k') AS int) < 55 THEN 'birdnet' ELSE 'drone_head' END AS winner_member,
        (4498000 + event_id * 7919 % 400) / 100000.0::DOUBLE AS lat, (-9325800 + event_id * 104729 % 400) / 100000.0::DOUBLE AS lon,
        CASE WHEN event_id % 3 <> 0 AND event_id % 5 = 0 THEN NULL ELSE event_id % 200 END AS track_id,
        CASE event_id % 10 WHEN 0 THEN 'long' WHEN 1 THEN 'ephemeral' WHEN 2 THEN 'permanent' ELSE 'short' END AS retention_tier,
        CASE event_id % 7 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'rejected' ELSE 'unreviewed' END AS review_state,
        (epoch_ns(ts) // {WINDOW_NS}) * {WINDOW_NS} AS report_window_start_ns, value FROM events""",
    "nodes": f"""SELECT n_nationkey::BIGINT AS id, n_name AS name, (n_nationkey % 4) * 50.0::DOUBLE AS x, (n_nationkey // 4) * 50.0::DOUBLE AS y, (n_nationkey % 3)::DOUBLE AS z,
        n_regionkey::BIGINT AS cluster_id, {NOW_NS} - n_nationkey::BIGINT * {5 * SECOND} AS last_seen_ns FROM nation WHERE n_nationkey < 16""",
    "zones": """SELECT r_regionkey::BIGINT AS zone_id, r_name AS name, 44.98::DOUBLE + r_regionkey::DOUBLE * 0.0008::DOUBLE AS lat_min, 44.9812::DOUBLE + r_regionkey::DOUBLE * 0.0008::DOUBLE AS lat_max,
        -93.258::DOUBLE AS lon_min, -93.2555::DOUBLE AS lon_max FROM region""",
    "areas": """SELECT zone_id, name, CASE zone_id % 3 WHEN 0 THEN 'exclusion' ELSE 'monitor' END AS kind, CASE zone_id WHEN 1 THEN ['view'] WHEN 3 THEN ['Purchase'] ELSE [] END AS suppress_labels, CASE zone_id WHEN 1 THEN ['security'] ELSE [] END AS suppress_categories,
        CASE WHEN zone_id IN (2, 4) THEN ['signup'] ELSE [] END AS only_labels, CASE zone_id WHEN 4 THEN ['human'] ELSE [] END AS only_categories,
        [[lat_min, lon_min], [lat_max, lon_min], [(lat_min + lat_max) / 2, (lon_min + lon_max) / 2], [lat_max, lon_max], [lat_min, lon_max]] AS polygon FROM zones""",
    "artifacts": "SELECT o_orderkey AS id, o_custkey % 16 AS node_id, o_orderkey AS detection_id, o_custkey % 250 AS track_id, epoch_ns(o_orderdate) AS created_ns, o_totalprice AS bytes FROM orders",
    "frames": "SELECT l_suppkey % 16 AS node_id, l_linestatus AS boot_session, l_orderkey AS sequence, epoch_ns(l_shipdate) AS received_ns, l_linenumber::BIGINT AS line, l_partkey AS part FROM lineitem",
    "tracks": f"""SELECT *, CASE WHEN update_count < 2 THEN 'tentative' WHEN last_seen_ns < {NOW_NS - 10 * DAY} THEN 'dropped' ELSE 'confirmed' END AS status FROM (
        SELECT track_id, min(timestamp_ns) AS first_seen_ns, max(timestamp_ns) AS last_seen_ns, count(*) AS update_count, max_by(label, (timestamp_ns, id)) AS label FROM detections WHERE track_id IS NOT NULL GROUP BY track_id)""",
    "environment": "SELECT event_id AS id, user_id % 16 AS node_id, epoch_ns(ts) AS timestamp_ns, 273.15::DOUBLE + (event_id * 13 % 400) / 10.0::DOUBLE AS temperature_k FROM events WHERE event_type = 'view'",
    "observations": """SELECT id * 4 + c AS observation_id, id AS detection_id, concat(node_id, ':', c) AS sensor_id, (node_id + c * 3) % 16 AS node_id, timestamp_ns + c * 1000 AS toa_ns, c AS channel
        FROM detections, (SELECT unnest([0, 1, 2, 3])::BIGINT AS c)""",
    "bit_reports": """SELECT o_orderkey AS id, o_custkey % 16 AS node_id, CASE o_orderkey % 3 WHEN 0 THEN 'PBIT' WHEN 1 THEN 'CBIT' ELSE 'IBIT' END AS report_type, epoch_ns(o_orderdate) AS timestamp_ns,
        CASE WHEN o_orderpriority LIKE '1%' THEN 'FAIL' WHEN o_orderpriority LIKE '2%' THEN 'DEGRADED' ELSE 'PASS' END AS status FROM orders""",
    "transcripts": f"SELECT doc_id AS id, doc_id % 16 AS node_id, text, {NOW_NS} - doc_id * {SECOND} AS created_ns FROM documents",
    "ble": f"SELECT c_custkey AS id, c_custkey % 50 AS mac, (c_nationkey % 16)::BIGINT AS node_id, -40 - c_custkey % 50 AS rssi, {NOW_NS} - c_custkey * {SECOND} AS recv_ns FROM customer",
}
_NEEDS = {"tracks": ["detections"], "observations": ["detections"], "areas": ["zones"]}


def with_views(sql: str) -> str:
    """``sql`` with the definitions of the views that it names in braces."""
    used: list[str] = []
    for name in DUCKDB_VIEWS:
        if "{" + name + "}" in sql:
            used += [x for x in [*_NEEDS.get(name, []), name] if x not in used]
            sql = sql.replace("{" + name + "}", name)
    sql = sql.strip()
    if not used:
        return sql
    head = ",\n".join(f"{x} AS ({DUCKDB_VIEWS[x]})" for x in used)
    return f"WITH {head}, {sql[5:]}" if sql.upper().startswith("WITH ") else f"WITH {head}\n{sql}"
