"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the cores. After one small query to warm up the
session, each query is built, planned and run to the end; its full result is discarded.
"""

from __future__ import annotations

import json
import os
import tempfile
import sys
import time

from pyspark.sql import SparkSession

from verification.queries import QUERIES

HEADLINE = (
    "w1_primary_technique",
    "j1_cases_with_technique",
    "j2_orphan_procedures",
    "p6_procedure_category",
    "p11_airway_findings",
    "p15_note_corpus_findings",
    "p17_block_sites",
    "p21_case_log",
    "e2_paired_case_log",
    "f4_standalone_routes",
    "a1_validation_summary",
    "a5_extraction_values",
    "w5_review_selection",
    "w8_seen_unseen_split",
    "a16_override_summary",
    "m9_hybrid_decision",
)


def main() -> None:
    """Run all headline queries."""
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="spark-"))
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    QUERIES["s1_unpaired_exports"](spark, folder).write.format("noop").mode("overwrite").save()
    for name in HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
