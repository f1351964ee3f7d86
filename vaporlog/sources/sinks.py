"""Write case logs, format metadata and training tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporlog.rules.schema import FORMAT_VERSIONS


def write_case_logs(log: DataFrame, path: str, resident: str = "resident", file_format: str = "parquet",
                    overwrite: bool = False) -> None:
    """One output folder per resident, all in one job.

    Rows are rebalanced by resident: small residents get one file each, and Spark splits a
    resident with very many cases over several tasks.
    """
    mode = "overwrite" if overwrite else "errorifexists"
    log.hint("rebalance", resident).write.mode(mode).partitionBy(resident).option("header", True).format(file_format).save(path)


def format_metadata(spark: SparkSession, format_type: str) -> DataFrame:
    """The key/value table that names the layout of an output."""
    rows = [("version", FORMAT_VERSIONS[format_type]), ("format_type", format_type)]
    generated = spark.range(1).select(
        F.lit("generated").alias("key"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX").alias("value")
    )
    return spark.createDataFrame(rows, "key string, value string").unionByName(generated)


def write_with_metadata(log: DataFrame, path: str, format_type: str, **options) -> None:
    """Write a case log and its metadata table beside it."""
    write_case_logs(log, f"{path}/data", **options)
    mode = "overwrite" if options.get("overwrite") else "errorifexists"
    format_metadata(log.sparkSession, format_type).coalesce(1).write.mode(mode).json(f"{path}/meta")


def save_table(df: DataFrame, path: str, force: bool = False) -> DataFrame:
    """Write a table (refusing to replace one unless forced) and read it back."""
    df.write.mode("overwrite" if force else "errorifexists").parquet(path)
    return df.sparkSession.read.parquet(path)
