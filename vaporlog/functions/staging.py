"""Keep computed columns computed once."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def computed_once(df: DataFrame) -> DataFrame:
    """Stop later filters and generators from being pushed into the columns below.

    Pushing a filter through a projection replaces each column by its expression. Columns
    built in stages then grow with every stage, and are evaluated again in the filter.
    Spark does not push through a projection with a value that depends on the partition;
    the test on it is always true. Unused columns are still pruned.
    """
    return df.withColumn("_once", F.spark_partition_id()).filter("_once >= 0").drop("_once")


def compiled_apart(df: DataFrame) -> DataFrame:
    """Like ``computed_once``, and what follows is compiled as code of its own.

    Code of many expressions in one piece is too long for the JVM to compile, and then runs many times slower. Spark
    begins a new piece at a test that it interprets; this one is always true.
    """
    always = F.exists(F.array("_once"), lambda number: number >= 0)
    return df.withColumn("_once", F.spark_partition_id()).filter(always).drop("_once")


def shared_folder(spark: SparkSession) -> str:
    """The folder named in ``spark.checkpoint.dir``, or set as the session's checkpoint folder; one of the two is needed."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def written_once(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write an intermediate table that several passes read, and read it back.

    With ``partition_by``, passes that want some values of a column open only their folders.

    The expensive columns are computed once, the plan of every pass starts at a narrow
    columnar scan, and a lost executor costs a re-read instead of a re-computation.
    The table is removed when the driver's process ends.
    """
    path = new_path(df.sparkSession, "staged")
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        return
