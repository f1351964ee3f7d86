"""Spark results against SQL on the same tables.

A few queries by default; VAPORLOG_ALL=1 compares all of them.
"""

import os

import duckdb
import pytest

from verification.compare import differences
from verification.oracle import ORACLE
from verification.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SHORT = (
    "j1_cases_with_technique", "p6_procedure_category", "p14_finding_contexts", "p20_warnings", "w5_review_selection",
    "w8_seen_unseen_split", "a16_override_summary", "m9_hybrid_decision", "e2_paired_case_log", "a7_json_report",
    "p24_quarantined_rows", "m6_w9_votes_and_top_classes", "s1_paired_exports",
)
NAMES = [n for n in QUERIES if n in ORACLE] if os.environ.get("VAPORLOG_ALL") else SHORT


@pytest.fixture(scope="module")
def database():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    connection = duckdb.connect()
    for name in os.listdir(FOLDER):
        connection.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{FOLDER}/{name}'")
    return connection


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, database, name):
    assert differences(QUERIES[name](spark, FOLDER).toPandas(), database.execute(ORACLE[name]).df()) == []


def test_every_sql_has_a_query():
    assert set(ORACLE) <= set(QUERIES)
