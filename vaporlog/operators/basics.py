"""Dates, ages, ASA status and anesthesia type of a case table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.matching import contains_any, first_value, in_list, literal
from vaporlog.functions.text import strip
from vaporlog.rules import anesthesia as A
from vaporlog.rules import procedures as P
from vaporlog.rules import schema as S

_NUMBER = r"(?i)^\s*[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?\s*$"
_SPECIAL_NUMBER = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"


def number(text: Column) -> Column:
    """The text as a double, or null when it is not a number."""
    return F.when(text.rlike(_NUMBER) | text.rlike(_SPECIAL_NUMBER), F.trim(text).try_cast("double"))


def _day(layout: str) -> str:
    """The day of a text in one layout: as written, or in UTC where the layout has a zone."""
    moment = f"try_to_timestamp(date, {literal(layout)})"
    if "XXX" in layout:  # no cast, which would take the day in the session's zone
        return f"date_from_unix_date(CAST(floor(unix_seconds({moment}) / 86400) AS INT))"
    return f"CAST({moment} AS DATE)"


def parse_dates(df: DataFrame, default_year: int = S.DEFAULT_YEAR) -> DataFrame:
    """Add ``case_date`` and ``date_warning`` from the text column ``date``.

    Each layout is tried only on texts of its shape, so a failed parse is rare.
    """
    text = F.col("date")
    parsed = first_value(*[(f"rlike(date, {literal(shape)})", _day(layout)) for shape, layout in S.DATE_LAYOUTS])
    fallback = F.make_date(F.lit(default_year), F.lit(1), F.lit(1))
    default_note = f"using default year {default_year}"
    return df.withColumn("_parsed_date", F.expr(parsed)).withColumns({
        "case_date": F.coalesce(F.col("_parsed_date"), fallback),
        "date_warning": F.when(text.isNull(), F.lit(f"Missing date value, {default_note}")).when(
            F.col("_parsed_date").isNull(),
            F.concat(F.lit("Could not parse date '"), text, F.lit(f"', {default_note}")),
        ),
    }).drop("_parsed_date")


def band_ages(df: DataFrame) -> DataFrame:
    """Add ``raw_age``, ``age_category`` and ``age_warning`` from the text column ``age``."""
    text, age = F.col("age"), F.col("raw_age")
    known = age.isNotNull() & ~F.isnan(age)
    last = literal(S.AGE_BANDS[-1][1])
    bands = first_value(
        ("isnan(raw_age) OR raw_age = double('inf')", "CAST(NULL AS STRING)"),
        *[(f"raw_age < {bound}D", literal(label)) for bound, label in S.AGE_BANDS[:-1]],
        ("raw_age IS NOT NULL", last),
    )
    return df.withColumn("raw_age", number(text)).withColumns({
        "age_category": F.expr(bands),
        "age_warning": F.when(text.isNull(), F.lit("Missing age value"))
        .when(age.isNull(), F.concat(F.lit("Invalid age value: "), text))
        .when(
            known & ((age < 0) | (age > 120)),
            F.concat(F.lit("Age "), age.cast("string"), F.lit(" is outside expected range (0-120)")),
        ),
    })


def complete_asa(df: DataFrame) -> DataFrame:
    """Add ``emergent``, ``asa_physical_status`` and ``asa_warning``."""
    asa = F.coalesce(F.col("asa"), F.lit(""))
    flag = F.coalesce(F.upper(strip(F.col("emergent"))).isin(*S.EMERGENT_FLAGS), F.lit(False))
    add_e = flag & ~F.contains(F.upper(asa), F.lit("E"))
    return df.withColumns({
        "raw_emergent": F.col("emergent"),
        "asa_physical_status": F.when(add_e, F.concat(asa, F.lit("E"))).otherwise(asa),
        "asa_warning": F.when(add_e, F.lit(A.WARN_ASA)),
        "emergent": flag,
    })


def map_anesthesia(df: DataFrame) -> DataFrame:
    """Add ``mapped_anesthesia`` and ``anesthesia_warning`` from ``final_anesthesia_type``."""
    text = F.col("final_anesthesia_type")
    mapped = first_value(*[
        (contains_any("upper(final_anesthesia_type)", (word,)), literal(kind))
        for word, kind in A.ANESTHESIA_MAPPING.items()
    ])
    return df.withColumn("mapped_anesthesia", F.expr(mapped)).withColumn(
        "anesthesia_warning",
        F.when(text.isNull(), F.lit("Missing anesthesia type")).when(
            F.col("mapped_anesthesia").isNull(), F.concat(F.lit("Unrecognized anesthesia type: "), text)
        ),
    )


def infer_anesthesia(df: DataFrame) -> DataFrame:
    """Add ``anesthesia_type`` and ``inference_warning``.

    Needs ``mapped_anesthesia``, ``airway_management``, ``procedure``,
    ``procedure_notes`` and ``procedure_category``.
    """
    notes, procedure = "upper(procedure_notes)", "upper(procedure)"
    warning = first_value(
        ("mapped_anesthesia IS NOT NULL", "CAST(NULL AS STRING)"),
        ("size(airway_management) > 0", literal(A.WARN_AIRWAY)),
        (contains_any(notes, A.MAC_NOTES), literal(A.WARN_MAC_NOTE)),
        (contains_any(notes, A.GA_NOTES), literal(A.WARN_GA_NOTE)),
        (contains_any(procedure, A.MAC_PROCEDURES), literal(A.WARN_MAC_PROCEDURE)),
        (in_list("procedure_category", (P.CESAREAN, P.VAGINAL_DELIVERY)), literal(A.WARN_OBSTETRIC)),
        otherwise=literal(A.WARN_DEFAULT_GA),
    )
    kind = first_value(
        ("mapped_anesthesia IS NOT NULL", "mapped_anesthesia"),
        (in_list("inference_warning", (A.WARN_MAC_NOTE, A.WARN_MAC_PROCEDURE)), "'MAC'"),
        (f"inference_warning = {literal(A.WARN_OBSTETRIC)}", "CAST(NULL AS STRING)"),
        otherwise="'GA'",
    )
    return df.withColumn("inference_warning", F.expr(warning)).withColumn("anesthesia_type", F.expr(kind))
