"""The track fold: its rules by hand, batch against a plain fold, stream against batch on skewed and late input."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from earshot.operators.trackfold import NAMES, SECOND, Fold, Settings, _detection, fold_batch, fold_stream

T0 = 1_700_000_000 * SECOND
OLD = Settings(stale_s_of={}, noise_of={}, coast_noise_s=0, coast_half_s=0, category_gate=False, unlike_weight=0, dormant=False)


def seen(fold, second, at, label="Northern Cardinal", category="wildlife", confidence=0.7, node=None, scores=None, located=True, cov=None):
    seen.n = getattr(seen, "n", 0) + 1
    row = fold.step(_detection(0, seen.n, T0 + int(second * SECOND), *at, cov, label, category, confidence, 1, node, scores, located))
    return dict(zip(NAMES, row, strict=True))


@pytest.mark.parametrize(("settings", "tracks"), [(Settings(), 1), (OLD, 6)])
def test_a_singer_keeps_its_track(settings, tracks):
    fold = Fold(settings)
    rows = [seen(fold, 75 * i, (12 + j, 3, 1)) for i, j in enumerate([0, 1.2, -0.8, 0.9, -1.1, 0.5])]
    assert len({r["track"] for r in rows}) == tracks
    assert tracks > 1 or (rows[-1]["status"], rows[-1]["updates"]) == ("confirmed", 6)


def test_lifetimes_by_category():
    fold = Fold(Settings())
    for k in range(2):
        seen(fold, k, (0, 0, 0), "Gunshot", "security", 0.8)
        seen(fold, k, (100, 0, 0))
    fold.age(T0 + 40 * SECOND)
    assert [t["status"] for t in fold.live.values()] == ["coasting", "confirmed"]
    assert [t["noise"] for t in fold.live.values()] == [2.0, 0.5]
    fold.age(T0 + 62 * SECOND)
    assert [t["status"] for t in fold.live.values()] == ["dropped", "confirmed"]
    fold.age(T0 + 102 * SECOND)
    assert len(fold.live) == 1 and len(fold.dormant) == 1


def test_categories_gate_and_unknown_fits_all():
    fold = Fold(Settings())
    a = seen(fold, 0, (0, 0, 0), "Car", "vehicle")
    b = seen(fold, 1, (1, 0, 0), "Voice", "human")
    c = seen(fold, 2, (0.2, 0, 0), "hum", "unknown")
    assert a["track"] != b["track"] and c["event"] == "updated"


def test_class_scores_choose_between_near_tracks():
    fold = Fold(Settings())
    a = seen(fold, 0, (0, 0, 0), "A", scores={"a": 1.0})
    b = seen(fold, 0, (12, 0, 0), "B", scores={"b": 1.0})
    assert seen(fold, 1, (6.0, 0, 0), "A", scores={"a": 0.9, "b": 0.1})["track"] == a["track"] != b["track"]


def test_revival_of_a_dropped_track():
    fold = Fold(Settings())
    first = [seen(fold, s, (5, 5, 0), node=n) for s, n in ((0, 1), (5, 2))]
    back = seen(fold, 700, (9, 5, 0), confidence=0.1, node=3)
    assert (back["event"], back["track"], back["updates"], back["nodes"], back["status"]) == ("revived", first[0]["track"], 3, 3, "confirmed")
    assert back["confidence"] == pytest.approx(0.7 * 0.5 ** (695 / 300)) and back["vx"] == 0
    for place, label, second in (((40, 5, 0), "Northern Cardinal", 1500), ((9, 5, 0), "Other", 2300), ((9, 5, 0), "Northern Cardinal", 9000)):
        fold = Fold(Settings())
        for s in (0, 5):
            seen(fold, s, (5, 5, 0))
        assert seen(fold, second, place, label)["event"] == "created"
    fold = Fold(Settings())
    seen(fold, 0, (5, 5, 0))  # seen once: nothing to come back to
    assert seen(fold, 700, (5, 5, 0))["event"] == "created"


def test_unlocated_reports_stay_tentative_and_wide_gates():
    fold = Fold(Settings())
    assert [seen(fold, s, (0, 0, 0), located=False)["status"] for s in (0, 1, 2)] == ["tentative"] * 3
    fold = Fold(Settings())
    seen(fold, 0, (0, 0, 0))
    wide = [100, 0, 0, 0, 100, 0, 0, 0, 100]
    assert seen(fold, 1, (20, 0, 0), cov=wide)["event"] == "updated"
    assert seen(fold, 2, (80, 0, 0), cov=wide)["event"] == "created"
    assert Fold(Settings(most_dormant=1)).s.memory_ns() == 2400 * SECOND


def scene(n=1500):
    """Three sites, one with most of the rows; moving and still sources, bursts, pauses longer than the memory."""
    rng, rows = np.random.default_rng(3), []
    at = {s: 0.0 for s in (1, 2, 3)}
    for i in range(n):
        site = 1 if rng.random() < 0.7 else int(rng.integers(2, 4))
        at[site] += float(rng.choice([0.5, 3, 30, 90, 400, 4000], p=[0.4, 0.3, 0.2, 0.05, 0.04, 0.01]))
        k = int(rng.integers(5))
        place = np.array([k * 30.0, 0, 0]) + np.array([0, 0.01 * at[site] % 50, 0]) * (k % 2) + rng.normal(0, 1, 3)
        label, category = [("a", "wildlife"), ("b", "vehicle"), ("c", "human"), ("d", "security"), ("e", None)][k]
        rows.append((site, i, T0 + int(at[site] * SECOND), *map(float, place), label, category, float(rng.random()), int(rng.integers(4)), {label: 0.8, "x": 0.2} if k != 3 else None))
    return rows


DDL = "site long, id long, timestamp_ns long, x double, y double, z double, label string, category string, confidence double, node_id long, scores map<string,double>"


def plain(rows):
    out = []
    for s in {r[0] for r in rows}:
        fold = Fold(Settings())
        for r in sorted((r for r in rows if r[0] == s), key=lambda r: (r[2], r[1])):
            out.append(fold.step(_detection(*r[:6], None, r[6], r[7], r[8], 1, r[9], r[10], None)))
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in out)


def got(df):
    return sorted(tuple(round(x, 6) if isinstance(x, float) else x for x in r) for r in df.select(*NAMES).collect())


def test_batch_is_the_plain_fold(spark):
    rows = scene()
    want = plain(rows)
    assert {r[4] for r in want} == {"created", "updated", "revived"}
    df = spark.createDataFrame([rows[i] for i in np.random.default_rng(1).permutation(len(rows))], DDL)
    assert got(fold_batch(df)) == want
    odd = spark.createDataFrame([(None, 1, T0, 1.0, 1.0, 0.0, "a", "b", 0.5, 1, None), (1, 2, None, 1.0, 1.0, 0.0, "a", "b", 0.5, 1, None), (1, 3, T0, None, 1.0, 0.0, "a", "b", 0.5, 1, None), (1, 4, T0, 1.0, 1.0, None, None, None, None, None, None), (1, 4, T0, 1.0, 1.0, None, None, None, None, None, None)], DDL)
    assert [r.event for r in fold_batch(odd).orderBy("updates").collect()] == ["created", "updated"]
    assert fold_batch(odd.where("false")).count() == 0


def test_stream_is_the_batch_with_late_rows(spark, tmp_path):
    rows = scene(500)
    rows.sort(key=lambda r: r[2])
    # files in order of time, but a tenth of the rows comes a file later, within the watermark's delay
    rng, files = np.random.default_rng(2), [[] for _ in range(8)]
    for i, r in enumerate(rows):
        files[min(7, i * 7 // len(rows) + (rng.random() < 0.1))].append(r)
    longest = max(r[2] for f in files for r in f) - T0
    for k, part in enumerate(files):
        spark.createDataFrame(part, DDL).withColumn("ts", F.timestamp_micros((F.col("timestamp_ns") / 1000).cast("long"))).coalesce(1).write.parquet(str(tmp_path / "in" / f"k={k}"))
    # the last file moves the watermark beyond all rows
    spark.createDataFrame([(99, 10**6, T0 + longest + 10**6 * SECOND, 0.0, 0.0, 0.0, "z", "z", 0.1, 1, None)], DDL).withColumn("ts", F.timestamp_micros((F.col("timestamp_ns") / 1000).cast("long"))).write.parquet(str(tmp_path / "in" / "k=8"))
    schema = spark.read.parquet(str(tmp_path / "in" / "k=0")).schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in" / "*"))
    late = f"{longest // SECOND + 1} seconds"
    q = fold_stream(stream, "ts", late).writeStream.format("memory").queryName("folded").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert got(spark.table("folded").where("site < 99")) == plain(rows)


def test_steps_look_at_few_tracks():
    """With 1,500 live tracks of the same category far apart a step has no matrix to make, and no track without a deadline is aged."""
    fold, rng = Fold(Settings()), np.random.default_rng(4)
    made, aged = [], []
    fold._gate = lambda *a: made.append(a) or Fold._gate(fold, *a)
    fold._deadline = lambda t: aged.append(t["track"]) or Fold._deadline(fold, t)
    for k in range(3000):
        place = (100.0 * (k % 1500), *map(float, rng.normal(0, 0.5, 2)))
        assert seen(fold, 0.03 * k, place)["event"] == ("created" if k < 1500 else "updated")
    assert len(fold.live) == 1500 and not made and len(aged) <= 4500


def test_covariances_that_come_and_go():
    """Tracks with three numbers and with a full matrix take the same steps."""
    rng = np.random.default_rng(5)
    plain, full = Fold(Settings()), Fold(Settings())
    begin = full._begin

    def as_matrix(t, at):
        begin(t, at)
        t["iso"], t["cov"] = None, np.diag([4.0] * 3 + [16.0] * 3)

    full._begin = as_matrix
    for k in range(400):
        place, cov = tuple(map(float, rng.normal(0, 12, 3))), [9.0, 1, 0, 1, 4, 0, 0, 0, 6] if k % 90 == 7 else None
        row = _detection(0, k, T0 + int(k * 2.5 * SECOND), *place, cov, "a", ["wildlife", "vehicle", None][k % 3], 0.5, 1, k % 4, None, None)
        assert plain.step(row) == pytest.approx(full.step(row), abs=1e-8)
    assert plain.live and len(plain.live) < 400
