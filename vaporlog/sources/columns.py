"""Bring physical tables to the canonical, all-text case table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.text import first_attending, join_distinct, missing_to_null
from vaporlog.rules import schema as S


def _column_or_null(df: DataFrame, name: str) -> Column:
    return F.col(f"`{name}`").cast("string") if name in df.columns else F.lit(None).cast("string")


def missing_columns(df: DataFrame, overrides: dict[str, str] | None = None) -> list[str]:
    """Physical names of required columns that the table does not have."""
    names = {**S.COLUMN_MAP, **(overrides or {})}
    return [names[logical] for logical in S.REQUIRED_COLUMNS if names[logical] not in df.columns]


def map_columns(df: DataFrame, overrides: dict[str, str] | None = None, keep=()) -> DataFrame:
    """Rename physical to logical columns; absent ones become null texts."""
    names = {**S.COLUMN_MAP, **(overrides or {})}
    return df.select(
        *keep, *[_column_or_null(df, physical).alias(logical) for logical, physical in names.items()]
    )


def csv_nulls(df: DataFrame) -> DataFrame:
    """Turn the missing-value markers of a CSV read into nulls."""
    texts = [name for name, kind in df.dtypes if kind == "string" and not name.startswith("_")]
    return df.withColumns({
        name: F.when(~F.col(f"`{name}`").isin(*S.CSV_MISSING), F.col(f"`{name}`")) for name in texts
    })


def _pass_through(df: DataFrame, names: dict[str, str]) -> dict[str, Column]:
    return {logical: _column_or_null(df, physical) for physical, logical in names.items()}


def normalize_cases(joined: DataFrame, keep=()) -> DataFrame:
    """Canonical case table from joined CaseList rows.

    Notes are the technique name and its details; services are unknown (empty).
    """
    fields = _pass_through(joined, S.CASE_LIST_COLUMNS)
    attendings = "AnesAttendings" in joined.columns
    fields["anesthesiologist"] = (
        first_attending(F.col("AnesAttendings")) if attendings else F.lit(None).cast("string")
    )
    fields["procedure_notes"] = join_distinct(
        _column_or_null(joined, "Airway_Type"), _column_or_null(joined, "Airway_Details")
    )
    fields["services"] = F.lit("")
    # A CaseList has no emergency flag and no block site.
    fields["emergent"] = F.lit(None).cast("string")
    fields["nerve_block_type"] = F.lit(None).cast("string")
    return joined.select(*keep, *[fields[name].alias(name) for name in S.COLUMN_MAP])


def normalize_orphans(orphans: DataFrame, keep=()) -> DataFrame:
    """Canonical case table from ProcedureList rows that have no case."""
    fields = _pass_through(orphans, S.ORPHAN_COLUMNS)
    noted = ("ProcedureName", "Comment", "Airway_Type", "Airway_Details", "Details")
    fields["procedure_notes"] = join_distinct(*[_column_or_null(orphans, name) for name in noted])
    attendings = "AnesAttendingNames" in orphans.columns
    fields["anesthesiologist"] = (
        first_attending(F.col("AnesAttendingNames")) if attendings else F.lit(None).cast("string")
    )
    fields["age"] = F.lit(str(S.DEFAULT_ORPHAN_AGE))
    fields["services"] = F.lit("")
    return orphans.select(*keep, *[fields[name].alias(name) for name in S.COLUMN_MAP])


def service_column(df: DataFrame, requested: str | None = None) -> str | None:
    """The first known service column, or the requested one when present."""
    candidates = (requested,) if requested else S.SERVICE_CANDIDATES
    return next((name for name in candidates if name in df.columns), None)


def procedure_column(df: DataFrame) -> str:
    """The procedure-text column."""
    for name in S.PROCEDURE_CANDIDATES:
        if name in df.columns:
            return name
    raise ValueError("No procedure column found")


def label_column(df: DataFrame, requested: str | None = None) -> str | None:
    """The requested label column, or the first known one."""
    if requested:
        if requested not in df.columns:
            raise ValueError(f"Label column not found: {requested}")
        return requested
    return next((name for name in S.LABEL_CANDIDATES if name in df.columns), None)


def training_columns(df: DataFrame, label: str | None = None, keep=()) -> DataFrame:
    """What training and evaluation read of a table of one layout, by the names that this layout has.

    ``procedure``, ``service_text``, ``age``, ``asa``, ``emergency`` and ``label``; what the layout lacks is null. A
    requested label that the layout lacks is an error.
    """
    given = label_column(df, label)
    found = {
        "procedure": procedure_column(df),
        "service_text": service_column(df),
        **S.TRAINING_COLUMNS,
    }
    named = [_column_or_null(df, physical or "").alias(logical) for logical, physical in found.items()]
    truth = F.lit(None).cast("string") if given is None else F.col(f"`{given}`").cast("string")
    return df.select(*keep, *named, truth.alias("label"))


def coalesce_services(df: DataFrame, into: str = "service_text") -> DataFrame:
    """Per row, the first service alias that is not missing; else the empty text."""
    present = [name for name in S.SERVICE_CANDIDATES if name in df.columns]
    values = [missing_to_null(F.col(name)) for name in present]
    return df.withColumn(into, F.coalesce(*values, F.lit("")))
