"""The stages one after the other, each held against what it may and must drop."""

import corpus_pipeline as pipeline
from earshot.llm.common import stage

from .test_operators import ODD, SCHEMA, brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {r.doc_id: r.text for r in docs.collect()}
    for name, step in pipeline.STAGES:
        docs = stage(step(spark, docs, SF), name)
        if name == "packing":
            assert {r.doc_id for r in docs.collect()} == set(kept)
            break
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        now = {r.doc_id: r.text for r in docs.collect()}
        if name == "near_duplicates":
            assert set(now) == {root for _, root in brute_components(kept, 5, 80).values()}
        elif name == "decontamination":
            assert set(now) == {d for d, t in kept.items() if not any(x in t for x in items)}
        else:
            assert set(now) <= set(kept) and len(now) >= 0.8 * len(kept)
        kept = now


def test_odd_rows(spark):
    odd = spark.createDataFrame([(*x, len(x[1] or ""), 9, "w", "c") for x in ODD], SCHEMA)
    for df in (odd, odd.where("false")):
        for name, step in pipeline.STAGES:
            out = stage(step(spark, df, SF), name)
            assert name == "packing" or out.columns == df.columns
            df = out


def test_repeated_and_missing_ids(spark):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("extra", F.lit("kept")).where("doc_id < 60")
    first = docs.orderBy("doc_id").first()
    more = docs.where(F.col("doc_id") == first.doc_id).withColumn("text", F.concat(F.lit("zz "), "text"))
    odd = docs.unionByName(docs.where(F.col("doc_id") == first.doc_id)).unionByName(more).unionByName(more.withColumn("doc_id", F.lit(None).cast("long")))
    once = pipeline.near_duplicate_stage(spark, odd.where("doc_id is not null"), SF)
    rows = once.collect()
    assert once.columns == docs.columns and len({r.doc_id for r in rows}) == len(rows) and {r.extra for r in rows} == {"kept"}
    assert [r.text for r in rows if r.doc_id == first.doc_id] == [first.text]
    assert pipeline.language_stage(spark, odd, SF).where("doc_id is null").count() == 0
