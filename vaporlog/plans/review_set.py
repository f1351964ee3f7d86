"""Paired exports to a review set."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.operators import review
from vaporlog.rules import review as R


def build_review_set(cases: DataFrame, max_cases: int = R.DEFAULT_MAX_CASES, seq: str = "seq",
                     source: str = "pair_key") -> DataFrame:
    """Score parsed cases and select at most ``max_cases`` of them for review."""
    assessed = review.assess(cases.withColumn("source_file", F.concat(source, F.lit(".CaseList.csv"))))
    return review.review_set(assessed.filter(F.size("review_targets") > 0), max_cases, seq)
