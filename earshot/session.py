"""Sessions for tests and benchmarks, and what a running session needs to know of this package."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
_SHIPPED: set[str] = set()


def local_session(cores: int = 8, partitions: int = 8, app: str = "earshot") -> SparkSession:
    os.environ["PYTHONPATH"] = os.pathsep.join(dict.fromkeys([ROOT, *filter(None, os.environ.get("PYTHONPATH", "").split(os.pathsep))]))
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once per application, unless their search path has it."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED or ROOT in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    path = os.path.join(tempfile.mkdtemp(prefix="spark-"), "earshot.zip")
    with zipfile.ZipFile(path, "w") as z:
        for top, _, names in os.walk(os.path.join(ROOT, "earshot")):
            for name in names:
                if name.endswith(".py"):
                    z.write(os.path.join(top, name), os.path.relpath(os.path.join(top, name), ROOT))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)
