"""Output projections of parsed cases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.text import display_name, strip_phi
from vaporlog.rules import schema as S
from vaporlog.rules import techniques as T


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def _list(name: str) -> Column:
    return F.coalesce(F.array_join(name, "; "), F.lit(""))


def case_log(cases: DataFrame, keep=()) -> DataFrame:
    """The case-log layout: text columns only, blanks instead of nulls."""
    fields = (
        _text("episode_id"),
        F.date_format("case_date", "MM/dd/yyyy"),
        _text("responsible_provider"),
        _text("age_category"),
        _text("procedure"),
        _text("asa_physical_status"),
        _text("anesthesia_type"),
        _list("airway_management"),
        F.col("procedure_category"),
        _list("vascular_access"),
        _list("monitoring"),
    )
    named = [field.alias(name) for field, name in zip(fields, S.CASE_LOG_COLUMNS, strict=True)]
    return cases.select(*keep, *named)


def standalone_log(cases: DataFrame, keep=()) -> DataFrame:
    """The layout of procedures without a case, free of PHI markers."""
    fields = (
        _text("episode_id"),
        F.date_format("case_date", "MM/dd/yyyy"),
        strip_phi(_text("responsible_provider")),
        F.coalesce(F.col("age_category"), F.lit(S.ADULT_BAND)),
        strip_phi(_text("procedure")),
        _text("asa_physical_status"),
        F.col("procedure_category"),
        strip_phi(_text("raw_anesthesia_type")),
        strip_phi(_text("nerve_block_type")),
        strip_phi(_text("unmatched_block_source")),
    )
    named = [field.alias(name) for field, name in zip(fields, S.STANDALONE_COLUMNS, strict=True)]
    return cases.select(*keep, *named)


def airway_flags(cases: DataFrame) -> DataFrame:
    """Add ``has_double_lumen_tube``, ``tube_route`` and ``ga_mac``."""
    def has(name: str) -> Column:
        return F.array_contains("airway_management", name)

    return cases.withColumns({
        "has_double_lumen_tube": has(T.DOUBLE_LUMEN_NAME),
        "tube_route": F.when(has(T.NASAL_ETT_NAME), "Nasal").when(
            has(T.ORAL_ETT_NAME) | has(T.DOUBLE_LUMEN_NAME), "Oral"
        ),
        "ga_mac": F.when(F.col("anesthesia_type").isin("GA", "MAC"), F.col("anesthesia_type")),
    })


def resident_names(df: DataFrame, stem: str = "pair_key") -> DataFrame:
    """Add ``resident`` (display name) and ``resident_id`` (8 hex digits, not reversible)."""
    return df.withColumns({
        "resident": display_name(F.col(stem)),
        "resident_id": F.substring(F.sha2(F.col(stem), 256), 1, 8),
    })
