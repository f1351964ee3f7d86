"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of a table of a few numbers, or digests, that may be broadcast: some ten megabytes.
BROADCAST_ROWS = 300_000
#: White space of the contracts: space and U+0009 to U+000D.
SPACES = " \t\n\u000b\f\r"


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where it is unset, local sessions (tests) get a new temporary one, a cluster an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("Set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, removed when the driver's process ends."""
    path = f"{shared_folder(spark)}/llm-{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, path)
    return path


def _remove(spark: SparkSession, path: str) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session may have ended already
        return


def staged(frame: DataFrame, name: str) -> DataFrame:
    """The frame, computed once and kept as Parquet in the shared folder: later steps restart from there.

    The shuffle files that it took are of no use any more; collecting the driver's garbage lets executors delete them.
    """
    spark = frame.sparkSession
    path = new_path(spark, name)
    frame.write.option("compression", "zstd").parquet(path)
    gc.collect()
    spark._jvm.System.gc()
    return spark.read.schema(frame.schema).parquet(path)


def sized(frame: DataFrame) -> DataFrame:
    """A staged table of a few narrow columns, marked for broadcast if it is counted to be small; else it is shuffled."""
    return F.broadcast(frame) if frame.count() <= BROADCAST_ROWS else frame


def with_library(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])


def text_of(frame: DataFrame, column: str) -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(frame[column].cast("string"), F.lit(""))


def apart(frame: DataFrame, docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The frame with column names that `docs` does not have, and these names in order: for joins to documents with any columns."""
    taken, names = {name.lower() for name in docs.columns}, []
    for name in frame.columns:
        name = f"_{name}"
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return frame.toDF(*names), names


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
