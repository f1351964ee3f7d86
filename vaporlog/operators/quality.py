"""Data-quality reports over parsed cases.

Every report is one aggregate with map-side partial results; lists are exploded, never
collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.staging import written_once
from vaporlog.functions.text import fixed_point, is_blank

LOW_CONFIDENCE = 0.7
PROBLEM_CONFIDENCE = 0.4
FAMILIES = {"airway": "airway_management", "vascular": "vascular_access", "monitoring": "monitoring"}


def _empty(name: str) -> Column:
    return F.coalesce(F.col(name) == "", F.lit(True))


MISSING = ("episode_id", "responsible_provider", "procedure", "age_category")


def problematic_cases(cases: DataFrame, min_warnings: int = 1, max_confidence: float = PROBLEM_CONFIDENCE) -> DataFrame:
    """Cases with enough warnings, or with none and very low confidence."""
    warned = F.size("parsing_warnings")
    return cases.filter((warned >= min_warnings) | ((F.col("confidence_score") < max_confidence) & (warned == 0)))


def low_confidence_cases(cases: DataFrame, threshold: float = LOW_CONFIDENCE) -> DataFrame:
    """Cases below a confidence threshold."""
    return cases.filter(F.col("confidence_score") < threshold)


def with_missing_fields(cases: DataFrame) -> DataFrame:
    """Add ``missing_fields``: names of critical fields that are null or empty."""
    return cases.withColumn(
        "missing_fields", F.array_compact(F.array(*[F.when(_empty(name), F.lit(name)) for name in MISSING]))
    )


def summary(cases: DataFrame) -> DataFrame:
    """One row: totals, cases with warnings, low-confidence cases, mean confidence."""
    return cases.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(F.size("parsing_warnings") > 0).alias("cases_with_warnings"),
        F.count_if(F.col("confidence_score") < LOW_CONFIDENCE).alias("low_confidence_cases"),
        F.coalesce(F.bround(F.avg("confidence_score"), 3), F.lit(0.0)).alias("average_confidence"),
    )


def warning_counts(cases: DataFrame, seq: str = "seq") -> DataFrame:
    """How often each warning occurs, and in which row it occurs first."""
    exploded = cases.select(seq, F.explode("parsing_warnings").alias("warning"))
    return exploded.groupBy("warning").agg(F.count(F.lit(1)).alias("occurrences"), F.min(seq).alias("first_seq"))


def top_warnings(cases: DataFrame, k: int = 10, seq: str = "seq") -> DataFrame:
    """The most frequent warnings; ties go to the one seen first."""
    counts = warning_counts(cases, seq)
    return counts.orderBy(F.desc("occurrences"), "first_seq", "warning").limit(k)


def missing_field_counts(cases: DataFrame) -> DataFrame:
    """Cases missing each critical field, one row per field."""
    counts = cases.agg(*[F.count_if(_empty(name)).alias(name) for name in MISSING])
    shown = [("provider" if name == "responsible_provider" else name, name) for name in MISSING]
    pairs = ", ".join(f"'{label}', {name}" for label, name in shown)
    return counts.selectExpr(f"stack({len(MISSING)}, {pairs}) AS (field, missing)")


def extraction_rates(cases: DataFrame) -> DataFrame:
    """Per finding family: cases with a finding, and their share of all cases."""
    counts = cases.agg(
        F.count(F.lit(1)).alias("total"), *[F.count_if(F.size(c) > 0).alias(f) for f, c in FAMILIES.items()]
    )
    pairs = ", ".join(f"'{name}', {name}" for name in FAMILIES)
    rate = F.when(F.col("total") > 0, F.bround(F.col("cases") / F.col("total"), 3)).otherwise(F.lit(0.0))
    return counts.selectExpr("total", f"stack({len(FAMILIES)}, {pairs}) AS (family, cases)").select(
        "family", "cases", rate.alias("rate")
    )


def extraction_values(cases: DataFrame) -> DataFrame:
    """How often each finding value occurs, per family. One pass over the cases."""
    tagged = ", ".join(
        f"transform({column}, v -> named_struct('family', '{family}', 'value', v))"
        for family, column in FAMILIES.items()
    )
    return (
        cases.select(F.explode(F.expr(f"concat({tagged})")).alias("found"))
        .groupBy(F.col("found.family").alias("family"), F.col("found.value").alias("value"))
        .agg(F.count(F.lit(1)).alias("occurrences"))
    )


def case_table(cases: DataFrame, keep=()) -> DataFrame:
    """One validation row per case, in the layout of the report table."""
    staged = with_missing_fields(cases)
    missing = F.array_join("missing_fields", "; ")
    return staged.select(
        *keep,
        F.coalesce("episode_id", F.lit("")).alias("Case ID"),
        F.when(F.size("parsing_warnings") > 0, "Yes").otherwise("No").alias("Has Warnings"),
        F.size("parsing_warnings").alias("Warning Count"),
        F.array_join("parsing_warnings", "; ").alias("Warnings"),
        fixed_point(F.col("confidence_score"), 3).alias("Confidence Score"),
        F.when(F.col("confidence_score") < LOW_CONFIDENCE, "Yes").otherwise("No").alias("Low Confidence"),
        F.when(missing == "", "None").otherwise(missing).alias("Missing Fields"),
    )


def first_problems(cases: DataFrame, n: int = 20, seq: str = "seq") -> DataFrame:
    """The first problematic cases, with ``more``: how many are not shown.

    The narrow problem rows are written once, so that counting them annotates nothing again.
    """
    problems = with_missing_fields(problematic_cases(cases)).select(
        seq, "episode_id", "confidence_score", "parsing_warnings", "missing_fields"
    )
    problems = written_once(problems)
    total = problems.agg(F.count(F.lit(1))).scalar()
    return problems.orderBy(seq).limit(n).withColumn("more", F.greatest(total - n, F.lit(0)))


#: Columns of a parsed case that the report needs.
REPORTED = ("episode_id", "responsible_provider", "procedure", "age_category", "parsing_warnings", "confidence_score", *FAMILIES.values())


def report_counts(cases: DataFrame) -> DataFrame:
    """All counts of the report from one pass: ``section``, ``key``, ``value``, ``hits``, ``cases`` and ``score``.

    A case gives a row for each thing that is counted, with 1 or 0 hits; tasks add them up before they are shuffled.
    A row of no case at all keeps the fixed keys in the report of an empty table.
    """
    def tag(section: str, key, hits="1", value="''") -> str:
        return f"named_struct('section', '{section}', 'key', {key}, 'value', {value}, 'hits', CAST({hits} AS INT))"

    fixed = [
        tag("summary", "'total_cases'"),
        tag("summary", "'cases_with_warnings'", "size(parsing_warnings) > 0"),
        tag("summary", "'low_confidence_cases'", f"coalesce(confidence_score < {LOW_CONFIDENCE}D, false)"),
        *[tag("missing_fields", f"'{'provider' if name == 'responsible_provider' else name}'", f"coalesce({name} = '', true)") for name in MISSING],
        *[tag("extraction_rate", f"'{family}'", f"coalesce(size({column}) > 0, false)") for family, column in FAMILIES.items()],
    ]
    listed = [f"transform(coalesce(parsing_warnings, array()), w -> {tag('warning_types', 'w')})"]
    listed += [
        f"transform(coalesce({column}, array()), v -> {tag('extraction_values', repr(family), value='v')})" for family, column in FAMILIES.items()
    ]
    tags = F.expr(f"concat(array({', '.join(fixed)}), {', '.join(listed)})")
    rows = cases.select(F.explode(tags).alias("t"), "confidence_score").select("t.*", F.lit(1).alias("cases"), "confidence_score")
    keys = [("summary", key) for key in ("total_cases", "cases_with_warnings", "low_confidence_cases")]
    keys += [("missing_fields", "provider" if name == "responsible_provider" else name) for name in MISSING]
    keys += [("extraction_rate", family) for family in FAMILIES]
    empty = cases.sparkSession.createDataFrame(
        [(section, key, "", 0, 0, None) for section, key in keys], "section string, key string, value string, hits int, cases int, confidence_score double"
    )
    return rows.unionByName(empty).groupBy("section", "key", "value").agg(
        F.sum("hits").alias("hits"), F.sum("cases").alias("cases"), F.avg("confidence_score").alias("score")
    )


def report_rows(cases: DataFrame) -> DataFrame:
    """The validation report as JSON rows: ``section``, ``payload``.

    The cases are read once: the few columns that the report needs are written, and all counts come from one aggregate
    over them. Counts are one row each; problematic cases stay one row per case, so the report of any number of
    cases is written by many tasks.
    """
    narrow = written_once(cases.select(*REPORTED))
    counts = written_once(report_counts(narrow))

    def payload(*fields) -> Column:
        return F.to_json(F.struct(*fields))

    hits, key = F.col("hits"), F.col("key")
    rate = F.coalesce(F.bround(F.try_divide("hits", "cases"), 3), F.lit(0.0))
    shapes = {
        "warning_types": payload(key.alias("warning"), hits.alias("occurrences")),
        "missing_fields": payload(key.alias("field"), hits.alias("missing")),
        "extraction_rate": payload(key.alias("family"), hits.alias("cases"), rate.alias("rate")),
        "extraction_values": payload(key.alias("family"), "value", hits.alias("occurrences")),
    }
    shaped = F.lit(None).cast("string")
    for name, shape in shapes.items():
        shaped = F.when(F.col("section") == name, shape).otherwise(shaped)
    single = counts.filter("section <> 'summary'").select("section", shaped.alias("payload"))
    totals = [F.max(F.when(key == name, hits)).alias(name) for name in ("total_cases", "cases_with_warnings", "low_confidence_cases")]
    mean = F.max(F.when(key == "total_cases", F.col("score")))
    whole = counts.filter("section = 'summary'").agg(*totals, F.coalesce(F.bround(mean, 3), F.lit(0.0)).alias("average_confidence"))
    problems = with_missing_fields(problematic_cases(narrow)).select(
        F.col("episode_id").alias("case_id"),
        (F.size("parsing_warnings") > 0).alias("has_warnings"),
        F.size("parsing_warnings").alias("warning_count"),
        F.col("parsing_warnings").alias("warnings"),
        "confidence_score",
        (F.col("confidence_score") < LOW_CONFIDENCE).alias("is_low_confidence"),
        "missing_fields",
    )
    united = single
    for name, frame in (("summary", whole), ("problematic_cases", problems)):
        united = united.unionByName(frame.select(F.lit(name).alias("section"), payload("*").alias("payload")))
    return united


def output_summary(log: DataFrame) -> DataFrame:
    """Summary of a written case log: count, date range, blank ids, missing dates."""
    date = F.try_to_timestamp(F.col("`Case Date`"), F.lit("MM/dd/yyyy"))
    shown = [F.date_format(f(date), "MM/dd/yyyy") for f in (F.min, F.max)]
    return log.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.coalesce(F.concat(shown[0], F.lit(" to "), shown[1]), F.lit("Unavailable")).alias("date_range"),
        F.count_if(is_blank(F.col("`Case ID`"))).alias("empty_cases"),
        F.count_if(F.col("`Case Date`").isNull()).alias("missing_dates"),
    )


def run_summary(cases: DataFrame, orphans: DataFrame, key: str = "pair_key") -> DataFrame:
    """Cases and orphan procedures per resident.

    Both sides are aggregated before the join, so it has one row per resident.
    """
    case_counts = cases.groupBy(key).agg(F.count(F.lit(1)).alias("cases"))
    orphan_counts = orphans.groupBy(key).agg(F.count(F.lit(1)).alias("orphans"))
    return case_counts.join(orphan_counts, key, "full").select(
        key, F.coalesce("cases", F.lit(0)).alias("cases"), F.coalesce("orphans", F.lit(0)).alias("orphans")
    )


