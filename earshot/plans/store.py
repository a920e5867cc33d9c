"""Changes to stored tables, as tables in and a table out: inserts with a unique key, guarded upserts, updates, retention.

A stored table is replaced as a whole or by partition with what these return. Each is one join or aggregation on the key;
no row is looked up on its own.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import slug
from ..sources.views import DAY, HOUR, NOW_NS, SECOND
from . import query


def insert_unique(stored: DataFrame, new: DataFrame, keys: list, order: list[str]) -> DataFrame:
    """``stored`` and those rows of ``new`` whose key it doesn't have; of new rows with one key the first by ``order``.
    A null in a key is a value like any other."""
    names = [f"_k{i}" for i in range(len(keys))]
    keyed = new.select("*", *[F.coalesce(k.cast("string"), F.lit("__none__")).alias(n) for k, n in zip(keys, names, strict=True)])
    held = stored.select(*[F.coalesce(k.cast("string"), F.lit("__none__")).alias(n) for k, n in zip(keys, names, strict=True)]).distinct()
    first = keyed.join(held, names, "left_anti").groupBy(*names).agg(F.min_by(F.struct(*new.columns), F.struct(*order)).alias("r"))
    return stored.unionByName(first.select("r.*"))


def upsert(stored: DataFrame, new: DataFrame, key: str, newer: str | None = None, keep: tuple[str, ...] = (), once: tuple[str, ...] = ()) -> DataFrame:
    """``stored`` with the rows of ``new`` by ``key``, the column on which they conflict. With ``newer`` a row only replaces one
    whose ``newer`` is not above its own (late rows change nothing); a null in a column of ``keep`` leaves what is stored;
    columns of ``once`` are written with a new row and never changed. ``new`` has one row per key."""
    n = new.select(F.col(key), F.struct(*new.columns).alias("_n"))
    both = stored.select(F.col(key), F.struct(*stored.columns).alias("_s")).join(n, key, "full")
    takes = F.col("_n").isNotNull()
    if newer:
        takes = takes & (F.col("_s").isNull() | (F.col("_n")[newer] >= F.col("_s")[newer]))
    columns = []
    for c in stored.columns:
        own = F.coalesce(F.col("_n")[c], F.col("_s")[c]) if c in keep else F.col("_n")[c]
        if c in once:
            own = F.when(F.col("_s").isNotNull(), F.col("_s")[c]).otherwise(own)
        columns.append((F.col(key) if c == key else F.when(takes, own).otherwise(F.col("_s")[c])).alias(c))
    return both.select(*columns)


def update(stored: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``stored`` with the columns of ``changes`` where it has the key (nulls are written, too); no row is added."""
    c = changes.select(F.col(key), F.struct(*[x for x in changes.columns if x != key]).alias("_c"))
    rows = stored.join(c, key, "left")
    return rows.select(*[F.when(F.col("_c").isNotNull(), F.col("_c")[x]).otherwise(F.col(x)).alias(x) if x in changes.columns and x != key else F.col(x) for x in stored.columns])


def retained(df: DataFrame, tier: str, ts: str, ttl_seconds: dict[str, int], now_ns: int, protected: tuple[str, ...] = ("config", "permanent")) -> DataFrame:
    """Rows that stay: of a tier with a time to live of 0 or more, those younger than that; of others all."""
    limit = F.lit(None).cast("long")
    for name, seconds in ttl_seconds.items():
        if name not in protected and seconds >= 0:
            limit = F.when(F.col(tier) == name, F.lit(now_ns - seconds * SECOND)).otherwise(limit)
    return df.withColumn("_limit", limit).where(F.col("_limit").isNull() | (F.col(ts) > F.col("_limit"))).drop("_limit")


_KEY = "coalesce(node_id::VARCHAR, '__none__'), lower(label), report_window_start_ns"
_NEW_SQL = "SELECT id + 100000000 AS id, node_id, upper(label) AS label, report_window_start_ns - (id % 2) * 30000000000 AS report_window_start_ns, timestamp_ns FROM {detections}"


@query("insert_detections", f"WITH n AS ({_NEW_SQL}) SELECT id, node_id, label, report_window_start_ns FROM {{detections}} UNION ALL SELECT id, node_id, label, report_window_start_ns FROM (SELECT *, row_number() OVER (PARTITION BY {_KEY} ORDER BY timestamp_ns, id) AS r FROM n WHERE ({_KEY}) NOT IN (SELECT ({_KEY}) FROM {{detections}})) WHERE r = 1")
def _(v):
    stored = v.detections.select("id", "node_id", "label", "report_window_start_ns", "timestamp_ns")
    new = stored.select((F.col("id") + 100000000).alias("id"), "node_id", F.upper("label").alias("label"), (F.col("report_window_start_ns") - (F.col("id") % 2) * 30000000000).alias("report_window_start_ns"), "timestamp_ns")
    return insert_unique(stored, new, [F.col("node_id"), F.lower("label"), F.col("report_window_start_ns")], ["timestamp_ns", "id"]).drop("timestamp_ns")


@query("update_reviews", "SELECT d.id, d.label, CASE WHEN l.doc_id IS NOT NULL THEN CASE WHEN l.quality = 1 THEN 'confirmed' ELSE 'rejected' END ELSE d.review_state END AS review_state FROM {detections} d LEFT JOIN labels l ON l.doc_id = d.id")
def _(v):
    changes = v.raw("labels").select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("review_state"))
    return update(v.detections.select("id", "label", "review_state"), changes, "id")


_NODES_NEW_SQL = f"SELECT c_nationkey::BIGINT AS id, max_by(c_name, c_custkey) AS name, max({NOW_NS} - 200000000000 + c_custkey * 1000000000) AS last_seen_ns FROM customer GROUP BY 1"


@query("upsert_nodes", f"SELECT coalesce(n.id, s.id) AS id, CASE WHEN n.id IS NOT NULL AND (s.id IS NULL OR n.last_seen_ns >= s.last_seen_ns) THEN n.name ELSE s.name END AS name, CASE WHEN n.id IS NOT NULL AND (s.id IS NULL OR n.last_seen_ns >= s.last_seen_ns) THEN n.last_seen_ns ELSE s.last_seen_ns END AS last_seen_ns FROM {{nodes}} s FULL JOIN ({_NODES_NEW_SQL}) n ON n.id = s.id")
def _(v):
    new = v.raw("customer").groupBy(F.col("c_nationkey").cast("long").alias("id")).agg(F.max_by("c_name", "c_custkey").alias("name"), F.max(F.lit(NOW_NS - 200 * SECOND) + F.col("c_custkey") * SECOND).alias("last_seen_ns"))
    return upsert(v.nodes.select("id", "name", "last_seen_ns"), new, "id", "last_seen_ns")


_NEW_LABELS_SQL = "SELECT 'lbl-' || left(trim(regexp_replace(lower(c_mktsegment), '[^a-z0-9]+', '-', 'g'), '-'), 48) AS id, lower(c_mktsegment) AS name, 'market' AS category, 'customer' AS source, 'seg-' || lower(c_mktsegment) AS external_id FROM customer GROUP BY c_mktsegment UNION ALL SELECT 'lbl-other', 'view', 'seen', 'manual', NULL UNION ALL SELECT 'lbl-click', 'click', 'heard', 'manual', 'x1'"


@query("upsert_labels", f"WITH s AS (SELECT 'lbl-' || label AS id, label AS name, max(label_category) AS category, 'runtime' AS source, 'ext-' || label AS external_id FROM {{detections}} GROUP BY label), n AS ({_NEW_LABELS_SQL}) SELECT coalesce(s.id, n.id) AS id, coalesce(n.name, s.name) AS name, CASE WHEN n.name IS NULL THEN s.category ELSE n.category END AS category, CASE WHEN n.name IS NULL THEN s.source ELSE n.source END AS source, coalesce(n.external_id, s.external_id) AS external_id FROM s FULL JOIN n ON n.name = s.name")
def _(v):
    """Labels conflict by name: category and source are overwritten, the id stays, and an outside id where the new row has none."""
    name, stored = F.lower("c_mktsegment"), v.detections.groupBy("label").agg(F.max("label_category").alias("category"))
    stored = stored.select(F.concat(F.lit("lbl-"), "label").alias("id"), F.col("label").alias("name"), "category", F.lit("runtime").alias("source"), F.concat(F.lit("ext-"), "label").alias("external_id"))
    new = v.raw("customer").select("c_mktsegment").distinct().select(F.concat(F.lit("lbl-"), F.substring(slug(F.col("c_mktsegment")), 1, 48)).alias("id"), name.alias("name"), F.lit("market").alias("category"), F.lit("customer").alias("source"), F.concat(F.lit("seg-"), name).alias("external_id"))
    by_hand = v.spark.createDataFrame([("lbl-other", "view", "seen", "manual", None), ("lbl-click", "click", "heard", "manual", "x1")], new.schema)
    return upsert(stored, new.unionByName(by_hand), "name", keep=("external_id",), once=("id",))


@query("upsert_tracks", f"SELECT coalesce(n.track_id, s.track_id) AS track_id, CASE WHEN n.track_id IS NOT NULL THEN n.status ELSE s.status END AS status, CASE WHEN n.track_id IS NOT NULL THEN n.last_seen_ns ELSE s.last_seen_ns END AS last_seen_ns, coalesce(s.first_seen_ns, n.first_seen_ns) AS first_seen_ns FROM {{tracks}} s FULL JOIN (SELECT c_custkey AS track_id, 'coasting' AS status, {NOW_NS} AS last_seen_ns, {NOW_NS - SECOND} AS first_seen_ns FROM customer) n ON n.track_id = s.track_id")
def _(v):
    new = v.raw("customer").select(F.col("c_custkey").alias("track_id"), F.lit("coasting").alias("status"), F.lit(NOW_NS).alias("last_seen_ns"), F.lit(NOW_NS - SECOND).alias("first_seen_ns"))
    return upsert(v.tracks.select("track_id", "status", "last_seen_ns", "first_seen_ns"), new, "track_id", once=("first_seen_ns",))


_TTL = {"ephemeral": 6 * 86400, "short": 14 * 86400, "long": -1, "permanent": 0}
_KEPT_SQL = " ".join(f"WHEN retention_tier = '{t}' THEN timestamp_ns > {NOW_NS - s * SECOND}" for t, s in _TTL.items() if s >= 0 and t != "permanent")


@query("retention_delete", f"SELECT retention_tier, count(*) AS before, count(*) FILTER (CASE {_KEPT_SQL} ELSE true END) AS kept FROM {{detections}} GROUP BY 1")
def _(v):
    kept = retained(v.detections, "retention_tier", "timestamp_ns", _TTL, NOW_NS).groupBy("retention_tier").agg(F.count("*").alias("kept"))
    before = v.detections.groupBy("retention_tier").agg(F.count("*").alias("before"))
    return before.join(kept, "retention_tier", "left").select("retention_tier", "before", F.coalesce("kept", F.lit(0)).cast("long").alias("kept"))


@query("stale_tracks_dropped", f"SELECT track_id, last_seen_ns, CASE WHEN status = 'confirmed' AND last_seen_ns < {NOW_NS - 3 * DAY} THEN 'dropped' ELSE status END AS status FROM {{tracks}}")
def _(v):
    return drop_stale(v.tracks, NOW_NS - 3 * DAY).select("track_id", "last_seen_ns", "status")


def drop_stale(tracks: DataFrame, cutoff_ns: int, active: tuple[str, ...] = ("confirmed",)) -> DataFrame:
    return tracks.withColumn("status", F.when(F.col("status").isin(*active) & (F.col("last_seen_ns") < cutoff_ns), "dropped").otherwise(F.col("status")))


@query("retention_tables", f"SELECT 'detections' AS part, count(*) FILTER (CASE {_KEPT_SQL} ELSE true END) AS kept FROM {{detections}} UNION ALL SELECT 'observations', count(*) FILTER (CASE {_KEPT_SQL} ELSE true END) FROM (SELECT o.toa_ns AS timestamp_ns, d.retention_tier FROM {{observations}} o JOIN {{detections}} d ON d.id = o.detection_id) UNION ALL SELECT 'bit_reports', count(*) FILTER (timestamp_ns > {NOW_NS - 9000 * DAY}) FROM {{bit_reports}} UNION ALL SELECT 'environment', count(*) FILTER (timestamp_ns > {NOW_NS - 10 * DAY}) FROM {{environment}} UNION ALL SELECT 'tracks', count(*) FILTER (NOT (status = 'dropped' AND last_seen_ns <= {NOW_NS - 12 * DAY})) FROM {{tracks}}")
def _(v):
    of_detection = v.detections.select(F.col("id").alias("detection_id"), "retention_tier")
    tables = {"detections": (v.detections, "timestamp_ns"), "observations": (v.observations.join(of_detection, "detection_id"), "toa_ns")}
    kept = cleaned(tables, {"bit_reports": (v.bit_reports, "timestamp_ns"), "environment": (v.environment, "timestamp_ns")}, v.tracks, _TTL, {"bit_reports": 9000 * 86400, "environment": 10 * 86400, "dropped_tracks": 12 * 86400}, NOW_NS)
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("kept")).select(F.lit(name).alias("part"), "kept") for name, df in kept.items()])


def cleaned(tiered: dict, operational: dict, tracks: DataFrame, tiers: dict[str, int], ttls: dict[str, int], now_ns: int) -> dict[str, DataFrame]:
    """The tables after retention: those with a ``retention_tier`` by tier, others by a time to live of their own (without one
    they stay), and dropped tracks by theirs. ``tiered`` and ``operational``: name -> (table, its time)."""
    out = {name: retained(df, "retention_tier", ts, tiers, now_ns) for name, (df, ts) in tiered.items()}
    for name, (df, ts) in operational.items():
        own = ttls.get(name, -1)
        out[name] = df.where(F.col(ts) > now_ns - own * SECOND) if own >= 0 else df
    own = ttls.get("dropped_tracks", -1)
    out["tracks"] = tracks.where(~((F.col("status") == "dropped") & (F.col("last_seen_ns") <= now_ns - own * SECOND))) if own >= 0 else tracks
    return out


@query("node_delete", "SELECT 'nodes' AS part, count(*) AS n FROM {nodes} WHERE id <> 3 UNION ALL SELECT 'observations', count(*) FROM {observations} WHERE node_id <> 3 UNION ALL SELECT 'environment', count(*) FROM {environment} WHERE node_id <> 3 UNION ALL SELECT 'bit_reports', count(*) FROM {bit_reports} WHERE node_id <> 3 UNION ALL SELECT 'detections', count(*) FROM {detections} UNION ALL SELECT 'detections with a node', count(*) FROM {detections} WHERE node_id <> 3")
def _(v):
    rows = delete_node({"nodes": v.nodes, "observations": v.observations, "environment": v.environment, "bit_reports": v.bit_reports}, 3, {"detections": v.detections})
    rows["detections with a node"] = rows["detections"].where("node_id is not null")
    return reduce(DataFrame.unionByName, [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n") for name, df in rows.items()])


def delete_node(tables: dict[str, DataFrame], node_id, cleared: dict[str, DataFrame] | None = None) -> dict[str, DataFrame]:
    """The tables without a node and what belongs to it, and those of ``cleared`` with its id set to null; rows without a node stay."""
    out = {name: df.where(~F.col("id" if name == "nodes" else "node_id").eqNullSafe(F.lit(node_id))) for name, df in tables.items()}
    return out | {name: df.withColumn("node_id", F.when(~F.col("node_id").eqNullSafe(F.lit(node_id)), F.col("node_id"))) for name, df in (cleared or {}).items()}


@query("insert_observations", "SELECT observation_id, node_id, toa_ns FROM {observations} UNION ALL SELECT observation_id + 1000000000, node_id, toa_ns FROM {observations} WHERE channel = 1")
def _(v):
    """Appended observations: of batches that were sent again only ids not stored yet."""
    stored = v.observations.select("observation_id", "node_id", "toa_ns")
    fresh = v.observations.where("channel = 1").select((F.col("observation_id") + 1000000000).alias("observation_id"), "node_id", "toa_ns")
    return insert_unique(stored, stored.unionByName(fresh).unionByName(fresh), [F.col("observation_id")], ["toa_ns"])


@query("insert_transcripts", "SELECT id, node_id, created_ns FROM {transcripts} UNION ALL SELECT id + 100000000, node_id, created_ns FROM {transcripts}")
def _(v):
    stored = v.transcripts.select("id", "node_id", "created_ns")
    fresh = stored.withColumn("id", F.col("id") + 100000000)
    return insert_unique(stored, fresh.unionByName(stored), [F.col("id")], ["created_ns"])


@query("insert_bit_reports", "SELECT id, node_id, report_type, status FROM {bit_reports} UNION ALL SELECT id + 100000000, node_id, 'CBIT', status FROM {bit_reports} WHERE status = 'FAIL'")
def _(v):
    stored = v.bit_reports.select("id", "node_id", "report_type", "status")
    fresh = stored.where("status = 'FAIL'").select((F.col("id") + 100000000).alias("id"), "node_id", F.lit("CBIT").alias("report_type"), "status")
    return insert_unique(stored, fresh.unionByName(stored), [F.col("id")], ["report_type"])


@query("insert_track_updates", "SELECT track_id, timestamp_ns, min(id) AS id FROM {detections} WHERE track_id IS NOT NULL GROUP BY 1, 2")
def _(v):
    """Updates of tracks: one of each track and time, the first detection's."""
    updates = v.detections.where("track_id is not null").select("track_id", "timestamp_ns", "id")
    return insert_unique(updates.where("false"), updates, [F.col("track_id"), F.col("timestamp_ns")], ["id"])


@query("snippets_expired", f"SELECT id, CASE WHEN created_ns + {30 * DAY} <= {NOW_NS} THEN NULL ELSE 'snippet-' || id || '.wav' END AS path FROM {{artifacts}}")
def _(v):
    expires = F.col("created_ns") + 30 * DAY
    return v.artifacts.select("id", F.when(expires > NOW_NS, F.concat(F.lit("snippet-"), "id", F.lit(".wav"))).alias("path"))


@query("transcripts_kept", f"SELECT id FROM {{transcripts}} WHERE NOT (created_ns < {NOW_NS - 100 * SECOND})")
def _(v):
    return v.transcripts.where(F.col("created_ns") >= NOW_NS - 100 * SECOND).select("id")


@query("session_artifacts_deleted", "SELECT event_id AS id FROM events WHERE NOT (props LIKE '%\"k\": 4%')")
def _(v):
    return v.raw("events").where(~F.col("props").like('%"k": 4%')).select(F.col("event_id").alias("id"))


@query("environment_rows", "SELECT id, round((temperature_k - 273.15) + 273.15, 4) AS temperature_k, least(greatest((id % 150) / 100.0::DOUBLE - 0.2::DOUBLE, 0), 1)::DOUBLE AS humidity FROM {environment}")
def _(v):
    rows = v.environment.select("id", (F.col("temperature_k") - 273.15).alias("temperature_c"), ((F.col("id") % 150) / F.lit(100.0) - 0.2).alias("humidity_fraction"))
    return environment_rows(rows).select("id", F.round("temperature_k", 4).alias("temperature_k"), "humidity")


def environment_rows(samples: DataFrame) -> DataFrame:
    """Samples as they are stored: kelvin, humidity between 0 and 1."""
    one = F.lit(1.0)
    return samples.withColumn("temperature_k", F.col("temperature_c") + 273.15).withColumn("humidity", F.least(F.greatest("humidity_fraction", F.lit(0.0)), one)).drop("temperature_c", "humidity_fraction")


#: Id, priority, label, tier, review state, least and most confidence (null: any), keep, seconds (null: as it was).
FOLD = [("a", 10, None, None, None, None, 0.3, False, 3600), ("b", 20, "view", None, None, 0.5, None, False, 86400 * 9), ("c", 20, None, None, "confirmed", None, None, True, None), ("d", 30, None, "ephemeral", None, None, None, False, 600)]


def matches(rule) -> F.Column:
    """Every given criterion holds; a null value fails a criterion."""
    _, _, label, tier, review, least, most, _, _ = rule
    tests = [F.col(c) == x for c, x in (("label", label), ("retention_tier", tier), ("review_state", review)) if x is not None]
    tests += [F.col("label_confidence") >= least] if least is not None else []
    tests += [F.col("label_confidence") <= most] if most is not None else []
    return F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False)) if tests else F.lit(True)


def folded(rules, default_seconds: int) -> F.Column:
    """Seconds to keep: rules in order of (priority, id), the last that says something decides; null: for ever."""
    out = F.lit(default_seconds).cast("long")
    for rule in sorted(rules, key=lambda r: (r[1], r[0])):
        if rule[7] or rule[8] is not None:
            out = F.when(matches(rule), F.lit(None if rule[7] else rule[8]).cast("long")).otherwise(out)
    return out


@query("policy_cleanup", f"SELECT expired, count(*) AS n FROM (SELECT coalesce(timestamp_ns + s::BIGINT * {SECOND} <= {NOW_NS}, false) AS expired FROM (SELECT *, CASE WHEN retention_tier = 'ephemeral' THEN 600 WHEN review_state = 'confirmed' THEN NULL WHEN label = 'view' AND label_confidence >= 0.5 THEN {86400 * 9} WHEN label_confidence <= 0.3 THEN 3600 ELSE {86400 * 20} END AS s FROM {{detections}})) GROUP BY 1")
def _(v):
    expired = F.coalesce(F.col("timestamp_ns") + folded(FOLD, 86400 * 20) * SECOND <= NOW_NS, F.lit(False))
    return v.detections.groupBy(expired.alias("expired")).agg(F.count("*").alias("n"))


@query("discovery_reconcile", "WITH want AS (SELECT id AS topic, sha256(name) AS hash FROM {nodes}), held AS (SELECT s_suppkey AS topic, CASE WHEN s_suppkey % 3 = 0 THEN 'old' ELSE coalesce((SELECT hash FROM want w WHERE w.topic = s_suppkey), 'gone') END AS hash FROM supplier) SELECT coalesce(w.topic, h.topic) AS topic, CASE WHEN h.topic IS NULL THEN 'add' WHEN w.topic IS NULL THEN 'remove' ELSE 'change' END AS action FROM want w FULL JOIN held h ON h.topic = w.topic WHERE w.hash IS DISTINCT FROM h.hash")
def _(v):
    want = v.nodes.select(F.col("id").alias("topic"), F.sha2("name", 256).alias("hash"))
    held = v.raw("supplier").select(F.col("s_suppkey").alias("topic")).join(want, "topic", "left").select("topic", F.when(F.col("topic") % 3 == 0, "old").otherwise(F.coalesce("hash", F.lit("gone"))).alias("hash"))
    return reconcile(want, held, "topic", "hash")


def reconcile(wanted: DataFrame, held: DataFrame, key: str, hash_: str) -> DataFrame:
    """(key, action) to get from what is held to what is wanted: add, change or remove; equal ones are left out."""
    both = wanted.select(F.col(key), F.col(hash_).alias("_w")).join(held.select(F.col(key), F.col(hash_).alias("_h")), key, "full")
    action = F.when(F.col("_h").isNull(), "add").when(F.col("_w").isNull(), "remove").when(F.col("_w") != F.col("_h"), "change")
    return both.select(key, action.alias("action")).where("action is not null")


@query("outbound_coalesced", f"SELECT node_id, slot, label FROM (SELECT *, lag(label) OVER (PARTITION BY node_id ORDER BY slot) AS sent FROM (SELECT node_id, timestamp_ns // {HOUR} AS slot, max_by(label, (timestamp_ns, id)) AS label FROM {{detections}} GROUP BY 1, 2)) WHERE label IS DISTINCT FROM sent")
def _(v):
    return coalesced(v.detections, "node_id", "label", HOUR)


def coalesced(df: DataFrame, topic: str, payload: str, interval_ns: int) -> DataFrame:
    """Of each topic and interval the last payload, where it differs from that of the interval before with one."""
    from ..operators.timeline import previous

    last = df.groupBy(topic, F.expr(f"timestamp_ns div {interval_ns}").alias("slot")).agg(F.max_by(payload, F.struct("timestamp_ns", "id")).alias(payload))
    rows = previous(last, [topic], ["slot"], [payload], bucket=168)
    return rows.where(~F.col(payload).eqNullSafe(F.col(f"before.{payload}"))).select(topic, "slot", payload)


@query("ble_table", f"SELECT mac, node_id, rssi, recv_ns FROM (SELECT *, row_number() OVER (ORDER BY recv_ns DESC, mac, node_id) AS r FROM (SELECT mac, node_id, max_by(rssi, (recv_ns, id)) AS rssi, max(recv_ns) AS recv_ns FROM {{ble}} WHERE recv_ns >= {NOW_NS - 1800 * SECOND} GROUP BY mac, node_id)) WHERE r <= 100")
def _(v):
    last = v.ble.where(F.col("recv_ns") >= NOW_NS - 1800 * SECOND).groupBy("mac", "node_id").agg(F.max(F.struct("recv_ns", "id", "rssi")).alias("m"))
    return last.select("mac", "node_id", "m.rssi", "m.recv_ns").orderBy(F.desc("recv_ns"), "mac", "node_id").limit(100)


@query("alert_statuses", "SELECT id, CASE WHEN id % 2 = 0 THEN 'delivered' ELSE 'pending' END AS status, CASE WHEN id % 2 = 0 THEN 3 ELSE 1 END::BIGINT AS fields FROM {detections} WHERE label_category = 'security' AND label_confidence >= 0.9")
def _(v):
    alerts = v.detections.where("label_category = 'security' and label_confidence >= 0.9").select("id", F.lit("pending").alias("status"), F.create_map(F.lit("label"), "label").alias("payload"))
    done = alerts.where("id % 2 = 0").select("id", F.lit("delivered").alias("status"), F.create_map(F.lit("by"), F.lit("mqtt"), F.lit("try"), F.lit("1")).alias("payload"))
    return merge_status(alerts, done).select("id", "status", F.size("payload").cast("long").alias("fields"))


def merge_status(alerts: DataFrame, changes: DataFrame) -> DataFrame:
    """Alerts with a new status, and the fields of its payload put over the stored ones."""
    c = changes.select("id", F.col("status").alias("_s"), F.col("payload").alias("_p"))
    rows = alerts.join(c, "id", "left")
    kept = F.map_filter("payload", lambda k, _: ~F.coalesce(F.map_contains_key(F.col("_p"), k), F.lit(False)))
    return rows.select("id", F.coalesce("_s", "status").alias("status"), F.when(F.col("_p").isNull(), F.col("payload")).otherwise(F.map_concat(kept, F.col("_p"))).alias("payload"))
