"""Case logs of newly arriving case tables.

Annotation keeps no state, so a file stream runs the batch plan on every new file. Joins of
paired exports need both lists of a pair and stay batch jobs.
"""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from vaporlog.plans.case_log import case_log_from_table
from vaporlog.sources.columns import csv_nulls


def stream_case_logs(spark: SparkSession, schema: StructType, source: str, output: str, checkpoint: str,
                     overrides: dict[str, str] | None = None) -> StreamingQuery:
    """Annotate each new CSV case table of a folder once and append to a Parquet case log."""
    reader = spark.readStream.schema(schema).option("header", True)
    reader = reader.option("multiLine", True).option("quote", '"').option("escape", '"')
    table = csv_nulls(reader.csv(source))
    log = case_log_from_table(table, overrides)
    writer = log.writeStream.format("parquet").option("path", output).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()
