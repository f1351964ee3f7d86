"""Python workers of the few jobs that need one."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import SparkSession


def with_library(spark: SparkSession) -> None:
    """Let Python workers import this library from where the driver has it."""
    root = str(Path(__file__).resolve().parents[2])
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        environment["PYTHONPATH"] = ":".join([root, *paths])
