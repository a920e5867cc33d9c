"""From raw documents to packed sequences: five stages, each over all that its predecessor kept.

1. language_id: documents whose language can't be told, or isn't one of ``LANGUAGES``, go.
2. quality: documents that the classifier predicts as label 0 go.
3. near_duplicates: of each group of linked documents (five-word shingles, Jaccard 0.8) the smallest doc_id stays.
4. decontamination: documents that hold a benchmark item go.
5. packing: token ids of what is left, in sequences of 2,048.

Stages 1 to 4 return the columns of documents, those that they don't know included. A stage writes the ids that it rejects
as a table of its own and anti-joins it.

Edge cases: rows without doc_id go in stage 1, as no later decision could name them; a null or empty text has no language,
so it goes in stage 1, too; of rows that repeat a doc_id, with equal or different texts, one stays (the smallest by text,
then by the other columns) in stage 3, and the decisions of the other stages on any of them hold for all; a score of
exactly the quality threshold stays; very long texts are read whole; null labels, sources and items are left out of what
is learnt; an empty table stays empty through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from earshot.llm import decontamination, language_id, ngram_join, packing, quality
from earshot.llm.common import stage, table

LANGUAGES = ("en", "de", "fr", "es")
LEAST_CONFIDENCE = 0.5

#: SQL can't express the stages; tests hold them against brute force.
ORACLE_SQL = None


def _without(docs: DataFrame, rejected: DataFrame) -> DataFrame:
    """``docs`` but for the doc_ids of ``rejected``. Few are broadcast by Spark's own measure, many meet in a shuffle."""
    ids = stage(rejected.where(F.col("doc_id").isNotNull()).select("doc_id").distinct(), "rejected")
    return docs.join(ids, "doc_id", "left_anti").select(*docs.columns)


def _one_of_each_id(docs: DataFrame) -> DataFrame:
    """Of rows that repeat a doc_id, the smallest; texts are shuffled of such rows alone."""
    ids = stage(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1").select("doc_id"), "repeated")
    if ids.isEmpty():
        return docs
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    least = docs.join(ids, "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("text", *rest)).alias("row"))
    return docs.join(ids, "doc_id", "left_anti").unionByName(least.select("doc_id", "row.*").select(*docs.columns))


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    told = language_id.identify_documents(docs)
    bad = (F.col("n_grams") == 0) | (F.col("confidence") < LEAST_CONFIDENCE) | ~F.col("lang").isin(*LANGUAGES)
    return _without(docs.where("doc_id is not null"), told.where(bad).select(F.col("id").alias("doc_id")))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.learn(docs, table(spark, sf_dir, "labels"))
    return _without(docs, quality.score(docs, model).where("predicted = 0"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _one_of_each_id(_without(docs, ngram_join.jaccard_components(docs, k=5, percent=80).where("component_id <> doc_id")))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _without(docs, decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, with_ids=True, cached=60_000)


STAGES = [
    ("language_id", language_stage),
    ("quality", quality_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES:
        docs = stage(step(spark, docs, sf_dir), name)
    return docs
