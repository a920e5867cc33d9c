"""Helpers that the training-data operators share.

Intermediate tables go below ``spark.checkpoint.dir`` (see ``earshot.operators.stages``).
"""

from __future__ import annotations

import contextlib
import ctypes
import os
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import stages
from ..operators.stages import components, shared_dir  # noqa: F401 (used by the operators)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Row groups of intermediate tables stay small: a task that writes one holds a group in memory.
ROW_GROUP = {"parquet.block.size": str(32 << 20)}


def stage(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes ``df`` as Parquet into the shared folder and reads it back: cuts the lineage, survives lost executors."""
    return stages.stage(df, name, **(ROW_GROUP | options))


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table of ``stage`` that is done with."""
    spark = df.sparkSession
    for top in {os.path.dirname(x) for x in df.inputFiles()}:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(top)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def small(batches, rows: int = 1000):
    """Arrow batches of ``rows`` rows at most, so that a task holds the Python objects of few texts at a time."""
    for b in batches:
        for i in range(0, b.num_rows, rows):
            yield b.slice(i, rows)
    give_back()


def give_back() -> None:
    """Returns freed memory to the system: a Python worker lives on after its task, beside the executor's JVM."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id and text alone (and the columns ``more``), a null text as the empty one; other columns are not read."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("text"), *more)


def running_offsets(totals: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """``totals`` with ``out``: the sum of ``value`` over the rows before, by ``order``.

    One task sees all rows, so ``totals`` has to be a table of segments (one row per some million ids), never of rows.
    """
    before = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return totals.withColumn(out, F.coalesce(F.sum(value).over(before), F.lit(0)).cast("long"))


def any_of(conditions: list):
    return reduce(lambda x, y: x | y, conditions)
