"""Combine rule categories with model predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.staging import computed_once
from vaporlog.functions.text import fixed_point, strip
from vaporlog.rules import procedures as P
from vaporlog.rules import training as T


def rules_only(df: DataFrame) -> DataFrame:
    """Add the decision columns when there is no model."""
    return df.withColumns({
        "procedure_category": F.col("rule_category"),
        "method": F.lit("rules"),
        "category_confidence": F.when(F.size("rule_warnings") > 0, F.lit(0.8)).otherwise(F.lit(1.0)),
        "alternative": F.lit(None).cast("string"),
        "category_warnings": F.col("rule_warnings"),
    })


def fuse(df: DataFrame, threshold: float = T.ML_THRESHOLD) -> DataFrame:
    """Add the hybrid decision from ``rule_category``, ``rule_warnings``,
    ``ml_category`` and ``ml_confidence``.

    Output columns: ``procedure_category``, ``method``, ``category_confidence``,
    ``alternative`` and ``category_warnings``.
    """
    staged = df.withColumn("_ml", strip(F.col("ml_category")))
    ml, rule, score = F.col("_ml"), F.col("rule_category"), F.col("ml_confidence")
    known = ml.isin(*P.CATEGORIES)
    confident = known & (score >= T.HIGH_CONFIDENCE)
    usable = known & (score >= threshold)
    differs = ml != rule
    decision = (
        F.when(confident, "ml_override")
        .when(usable & (rule == P.OTHER) & differs, "ml_fill_other")
        .when(usable & differs, "ml_preferred")
        .when(usable, "ml_rules_agree")
        .otherwise("rules")
    )
    staged = staged.withColumn("method", decision)
    method = F.col("method")
    shown = F.concat(F.lit("(conf="), fixed_point(score, 2), F.lit(")"))
    added = (
        F.when(~known, F.concat(F.lit("ML returned invalid category: "), ml))
        .when(
            (method == "ml_override") & differs,
            F.concat(F.lit("ML override "), shown, F.lit(": rules suggested "), rule),
        )
        .when(method == "ml_fill_other", F.concat(F.lit("ML filled uncategorized rule result "), shown))
        .when(
            method == "ml_preferred",
            F.concat(F.lit("ML preferred over rules: "), ml, F.lit(" over "), rule, F.lit(" "), shown),
        )
    )
    return computed_once(staged.withColumns({
        "procedure_category": F.when(method == "rules", rule).otherwise(ml),
        "category_confidence": F.when(method != "rules", score)
        .when(F.size("rule_warnings") > 0, F.lit(0.8))
        .otherwise(F.lit(1.0)),
        "alternative": F.when((method != "rules") & differs, rule),
        "category_warnings": F.concat("rule_warnings", F.array_compact(F.array(added))),
    }).drop("_ml"))
