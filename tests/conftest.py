import os
import sys
import tempfile

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

CASE_FIELDS = (
    "date", "episode_id", "anesthesiologist", "age", "emergent", "asa", "final_anesthesia_type",
    "procedure_notes", "procedure", "services", "nerve_block_type",
)


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def case_frame(spark):
    """Build a canonical case table from dictionaries; absent fields are null."""

    def build(*rows):
        schema = "seq long, " + ", ".join(f"{name} string" for name in CASE_FIELDS)
        data = [(i, *[row.get(name) for name in CASE_FIELDS]) for i, row in enumerate(rows)]
        return spark.createDataFrame(data, schema)

    return build
