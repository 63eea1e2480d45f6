"""Sessions with the settings the engine expects, and the library's path for Python workers."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

HOME = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))

#: AQE re-plans partition counts and skewed joins at run time; UTC makes timestamps comparable with other engines.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.ui.enabled": "false",
}


def session(master: str = "local[8]", partitions: int = 8, memory: str = "8g", **more: str) -> SparkSession:
    builder = SparkSession.builder.master(master).appName("siftstone").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    spark = builder.config(map={**SETTINGS, **more}).getOrCreate()
    ship(spark)
    return spark


def ship(spark: SparkSession) -> SparkSession:
    """Lets Python workers import the library wherever the driver was started from."""
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if HOME not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([HOME, *filter(None, paths)])
    return spark


def workspace(spark: SparkSession) -> str:
    """A new folder that driver and executors share: in spark.checkpoint.dir, or on a local session's own disk where that is unset."""
    if found := spark.conf.get("spark.checkpoint.dir", None):
        return f"{found}/siftstone/{uuid.uuid4().hex}"
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + tempfile.mkdtemp(prefix="siftstone-")


def kept(rows: DataFrame) -> DataFrame:
    """The rows, made once and read from a new folder of the workspace: for a small result of a long step that a plan reads in several places."""
    at = workspace(rows.sparkSession) + "/kept"
    rows.write.parquet(at)
    return rows.sparkSession.read.schema(rows.schema).parquet(at)


def remove(spark: SparkSession, path: str) -> bool:
    """Removes what lies at a path of any store that Spark writes to; whether there was something."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
