"""Tables for intermediate results, in a folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Folder of each application that names none.
OWN: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in spark.checkpoint.dir; where that is unset in a temporary folder on one machine, and an error on several."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = OWN.setdefault(context.applicationId, "") or tempfile.mkdtemp(prefix="spark-")
        OWN[context.applicationId] = base
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written once in the shared folder, partitioned by the columns by, and read back, for results that are used twice."""
    path = scratch(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, *paths: str) -> None:
    """Delete such paths after their use."""
    for path in paths:
        there = spark._jvm.org.apache.hadoop.fs.Path(path)
        there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)
