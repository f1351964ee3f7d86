"""The annotation job: canonical case table in, parsed case table out.

A single narrow stage: no shuffle, no UDF. Columns that are not part of the case table
(pair, sequence, file) pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.staging import computed_once
from vaporlog.functions.text import provider_name, split_lines
from vaporlog.operators import basics, blocks, categorize, findings, hybrid
from vaporlog.operators.models import ProcedureModel
from vaporlog.rules import schema as S
from vaporlog.rules import training as T

CASE_FIELDS = (
    "raw_date", "episode_id", "raw_age", "raw_asa", "emergent", "raw_anesthesia_type", "services",
    "procedure", "procedure_notes", "responsible_provider", "nerve_block_type", "raw_nerve_block_type",
    "unmatched_block_source", "case_date", "age_category", "asa_physical_status", "anesthesia_type",
    "procedure_category", "airway_management", "vascular_access", "monitoring", "extraction_findings",
    "parsing_warnings", "confidence_score",
)


def assemble_warnings(df: DataFrame) -> DataFrame:
    """Add ``parsing_warnings`` in fixed order: date, age, ASA, anesthesia, category,
    inference, confidence."""
    first = F.array_compact(F.array("date_warning", "age_warning", "asa_warning", "anesthesia_warning"))
    last = F.array_compact(F.array("inference_warning", "confidence_warning"))
    return df.withColumn("parsing_warnings", F.concat(first, "category_warnings", last))


def annotate(
    cases: DataFrame,
    default_year: int = S.DEFAULT_YEAR,
    ml_threshold: float | None = None,
    where: str | Column | None = None,
) -> DataFrame:
    """Parse every row of a canonical case table.

    ``where`` is a condition on the input's columns. It is applied before anything is computed, so the scan below gets
    it; a filter on the result stays above the annotation. With ``ml_threshold`` the input also has ``ml_category`` and ``ml_confidence``,
    which are combined with the rules.
    """
    if where is not None:
        cases = cases.filter(where)
    extra = [c for c in cases.columns if c not in S.COLUMN_MAP and c not in ("ml_category", "ml_confidence")]
    typed = cases.withColumns({
        "raw_date": F.col("date"),
        "raw_asa": F.col("asa"),
        "raw_anesthesia_type": F.col("final_anesthesia_type"),
        "raw_nerve_block_type": F.col("nerve_block_type"),
        "responsible_provider": provider_name(F.col("anesthesiologist")),
        "episode_id": F.substring("episode_id", 1, S.EPISODE_ID_LENGTH),
        "services": split_lines(F.col("services")),
    })
    typed = basics.map_anesthesia(basics.complete_asa(basics.band_ages(basics.parse_dates(typed, default_year))))
    ruled = categorize.categorize(typed)
    decided = hybrid.rules_only(ruled) if ml_threshold is None else hybrid.fuse(ruled, ml_threshold)
    found = findings.all_findings(decided)
    inferred = basics.infer_anesthesia(found)
    sited = blocks.normalize_blocks(findings.score_cases(inferred))
    return computed_once(assemble_warnings(sited).select(*extra, *CASE_FIELDS))


def annotate_with_model(cases: DataFrame, model: ProcedureModel, threshold: float = T.ML_THRESHOLD,
                        default_year: int = S.DEFAULT_YEAR, where: str | Column | None = None) -> DataFrame:
    """Parse every row of a canonical case table, with categories decided by rules and a fitted model together.

    Scoring is a part of the same narrow stage. The table's columns are packed meanwhile, so that their names cannot
    meet those of features.
    """
    if where is not None:
        cases = cases.filter(where)
    packed = cases.select("procedure", F.col("services").alias("service_text"), F.struct("*").alias("_kept"))
    scored = model.score(packed).select("_kept.*", "ml_category", "ml_confidence")
    return annotate(computed_once(scored), default_year, ml_threshold=threshold)
