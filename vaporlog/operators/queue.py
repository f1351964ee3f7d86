"""Review queues and evaluation of scored rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.text import is_blank
from vaporlog.operators.curate import normalize_label, optional_label
from vaporlog.rules import procedures as P
from vaporlog.rules import training as T


def side_by_side(scored: DataFrame, label: str | None = None) -> DataFrame:
    """Rule, model and hybrid predictions (and the label) of each row, normalized.

    All come from one scored table, so rows cannot be out of step.
    """
    columns = {
        "rule_prediction": normalize_label(F.col("rule_category")),
        "ml_prediction": normalize_label(F.col("ml_category")),
        "hybrid_prediction": normalize_label(F.col("procedure_category")),
    }
    if label is not None:
        columns["label"] = optional_label(F.col(label))
    compared = scored.withColumns(columns)
    return compared.withColumn("disagreement", F.col("ml_prediction") != F.col("rule_prediction"))


def focus_filter(rows: DataFrame, focus: str = "priority", low_confidence: float = T.MEDIUM_CONFIDENCE) -> DataFrame:
    """Rows worth a review: 'disagreement', 'low_confidence', 'priority' (either) or 'all'."""
    low = F.col("ml_confidence") < low_confidence
    tests = {
        "disagreement": F.col("disagreement"),
        "low_confidence": low,
        "priority": F.col("disagreement") | low,
        "all": F.lit(True),
    }
    return rows.filter(~is_blank(F.col("procedure"))).filter(tests[focus])


def exclude_reviewed(rows: DataFrame, reviewed: DataFrame, data_id: str, model_id: str, key: str = "seq") -> DataFrame:
    """Drop rows reviewed before with the same data and the same model."""
    same = reviewed.filter((F.col("data_id") == data_id) & (F.col("model_id") == model_id))
    return rows.join(same.select(F.col(key)).distinct(), key, "left_anti")


def review_queue(rows: DataFrame, size: int = T.REVIEW_QUEUE_SIZE, key: str = "seq") -> DataFrame:
    """The first rows to review: disagreements, then the least confident."""
    return rows.orderBy(F.desc("disagreement"), F.asc("ml_confidence"), F.asc(key)).limit(size)


def confidence_bins(rows: DataFrame) -> DataFrame:
    """One row: total, confidence bins and agreement with the rules."""
    score = F.col("ml_confidence")
    return rows.agg(
        F.count(F.lit(1)).alias("total_cases"),
        F.count_if(score >= T.HIGH_CONFIDENCE).alias("high_confidence"),
        F.count_if((score >= T.MEDIUM_CONFIDENCE) & (score < T.HIGH_CONFIDENCE)).alias("medium_confidence"),
        F.count_if(score < T.MEDIUM_CONFIDENCE).alias("low_confidence"),
        F.count_if(~F.col("disagreement")).alias("agreement_count"),
    )


def labeled_accuracy(rows: DataFrame) -> DataFrame:
    """One row: accuracy of rules, model and hybrid over labeled rows; 0 when there are none."""
    labeled = rows.filter(F.col("label") != "")
    def accuracy(name: str):
        right = (F.col(name) == F.col("label")).cast("double")
        return F.coalesce(F.avg(right), F.lit(0.0))

    return labeled.agg(
        F.count(F.lit(1)).alias("labeled_cases"),
        accuracy("rule_prediction").alias("rule_accuracy"),
        accuracy("ml_prediction").alias("ml_accuracy"),
        accuracy("hybrid_prediction").alias("hybrid_accuracy"),
    )


def disagreements(rows: DataFrame, key: str = "seq", with_label: bool = True) -> DataFrame:
    """Rows on which model and rules differ."""
    columns = [key, "procedure", "ml_prediction", "rule_prediction", F.col("ml_confidence").alias("confidence")]
    if with_label:
        columns += ["hybrid_prediction", "label"]
    return rows.filter("disagreement").select(*columns)


def confusion_matrix(rows: DataFrame, label: str = "label", prediction: str = "ml_prediction") -> DataFrame:
    """Label by prediction, one column per category."""
    counts = rows.groupBy(label).pivot(prediction, list(P.CATEGORIES)).agg(F.count(F.lit(1)))
    return counts.na.fill(0)


def classification_report(rows: DataFrame, label: str = "label", prediction: str = "ml_prediction") -> DataFrame:
    """Precision, recall, F1 and support of each class.

    Rows are first counted per (label, prediction), so everything after is tiny.
    """
    pairs = rows.groupBy(label, prediction).agg(F.count(F.lit(1)).alias("n"))
    sides = F.array(
        F.struct(F.col(label).alias("category"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted")),
        F.struct(F.col(prediction).alias("category"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted")),
    )
    hit = F.when(F.col(label) == F.col(prediction), F.col("n")).otherwise(0)
    exploded = pairs.select(hit.alias("hit"), F.posexplode(sides).alias("side", "s")).select(
        "s.*", F.when(F.col("side") == 0, F.col("hit")).otherwise(0).alias("hit")
    )
    totals = exploded.groupBy("category").agg(
        F.sum("support").alias("support"), F.sum("predicted").alias("predicted"), F.sum("hit").alias("hit")
    )
    def ratio(top, bottom):
        return F.when(bottom > 0, top / bottom).otherwise(F.lit(0.0))

    precision = ratio(F.col("hit"), F.col("predicted"))
    recall = ratio(F.col("hit"), F.col("support"))
    return totals.withColumns({"precision": precision, "recall": recall}).select(
        "category",
        "precision",
        "recall",
        ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"),
        "support",
    )
