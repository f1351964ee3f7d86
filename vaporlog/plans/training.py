"""Prepare, split, train, evaluate; and retrain with human overrides."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vaporlog.functions.staging import written_once
from vaporlog.operators import curate, hybrid, models
from vaporlog.operators import queue as review_queue
from vaporlog.rules import training as T
from vaporlog.sources import columns, exports
from vaporlog.sources.sinks import save_table


@dataclass
class Evaluation:
    """Reports of one evaluation run."""

    bins: DataFrame
    disagreements: DataFrame
    accuracy: DataFrame | None


def hybrid_scores(model: models.ProcedureModel, rows: DataFrame, threshold: float = T.ML_THRESHOLD) -> DataFrame:
    """Rule, model and hybrid category of each row in one table.

    Scoring computes the rule result as a feature; the decision uses the same columns.
    """
    return hybrid.fuse(model.score_table(rows.drop("rule_category", "rule_warnings")), threshold)


def evaluate(model: models.ProcedureModel, rows: DataFrame, label: str | None = None, key: str = "seq",
             threshold: float = T.ML_THRESHOLD) -> Evaluation:
    """Confidence bins, disagreements and, with a label, accuracies."""
    named = rows if label is None else rows.withColumn("_given", F.col(label))
    scored = written_once(hybrid_scores(model, named, threshold))
    compared = review_queue.side_by_side(scored, label=None if label is None else "_given")
    return Evaluation(
        review_queue.confidence_bins(compared),
        review_queue.disagreements(compared, key, with_label=label is not None),
        None if label is None else review_queue.labeled_accuracy(compared),
    )


def training_rows(spark: SparkSession, path: str, label: str | None = None, multi_line: bool = True) -> tuple[DataFrame, DataFrame]:
    """Rows of all CSV files of a folder, each read by the names of its own header, and the rejected ones.

    ``seq`` (file and place as text), ``file``, `columns.training_columns`. Files whose header has no procedure column
    fail the scan.
    """
    good, bad = [], []
    for layout in exports.read_layouts(spark, path, multi_line):
        rows, rejects = exports.quarantine(layout)
        place = F.col("_seq")
        seq = F.concat_ws("|", place["path"], F.lpad(place["block"].cast("string"), 16, "0"), F.lpad(place["row"].cast("string"), 20, "0"))
        keep = [seq.alias("seq"), F.substring_index("_file", "/", -1).alias("file")]
        good.append(columns.training_columns(rows, label, keep))
        bad.append(rejects)
    united, rejected = good[0], bad[0]
    for rows, rejects in zip(good[1:], bad[1:], strict=True):
        united, rejected = united.unionByName(rows), rejected.unionByName(rejects)
    return united, rejected


def evaluate_files(spark: SparkSession, model: models.ProcedureModel, path: str, label: str | None = None,
                   threshold: float = T.ML_THRESHOLD) -> Evaluation:
    """Evaluate a model on CSV files, with the labels of the requested column or of the first known one, if any."""
    rows, _ = training_rows(spark, path, label)
    rows = written_once(rows)
    labeled = not rows.filter("label IS NOT NULL").isEmpty()
    return evaluate(model, rows, label="label" if labeled else None, threshold=threshold)


def train_from_files(spark: SparkSession, path: str, output: str, sample_per_file: int | None = None,
                     size: int = T.TOTAL_SAMPLE, ratio: float = 0.2, force: bool = False,
                     config: models.TrainConfig | None = None, folds: int = 0) -> tuple[models.ProcedureModel, Evaluation]:
    """A folder of CSV files to a saved model and its evaluation.

    The files are parsed once. Beside the tables of `train_pipeline`, ``output`` gets ``file_stats`` (rows of each
    file), ``distribution`` (categories of the prepared rows) and ``rejects`` (malformed rows).
    """
    rows, rejects = training_rows(spark, path)
    save_table(rejects, f"{output}/rejects", force)
    rows = written_once(rows)
    save_table(curate.file_stats(rows), f"{output}/file_stats", force)
    if sample_per_file is not None:
        rows = curate.sample_per_file(rows, sample_per_file)
    model, evaluation = train_pipeline(rows, output, size, ratio, force, config, folds)
    prepared = spark.read.parquet(f"{output}/prepared")
    save_table(curate.category_distribution(prepared), f"{output}/distribution", force)
    return model, evaluation


def train_pipeline(rows: DataFrame, output: str, size: int = T.TOTAL_SAMPLE, ratio: float = 0.2, force: bool = False,
                   config: models.TrainConfig | None = None, folds: int = 0) -> tuple[models.ProcedureModel, Evaluation]:
    """Raw rows to a saved model and its evaluation on unseen rows.

    With ``folds``, accuracies of a cross-validation over the seen rows go into the metadata.
    """
    prepared = save_table(curate.sample_by_value(curate.prepare(rows), size), f"{output}/prepared", force)
    parts = curate.split_seen_unseen(prepared, ratio)
    seen = save_table(parts.filter("part = 'seen'").drop("part"), f"{output}/seen", force)
    unseen = save_table(parts.filter("part = 'unseen'").drop("part"), f"{output}/unseen", force)
    model = _fit(seen, config)
    if folds:
        model.metadata["cross_validation"] = models.cross_validate(seen, model, "rule_category", folds=folds, config=config)
    model.save(f"{output}/model", force)
    return model, evaluate(model, unseen, label="rule_category")


def retrain_pipeline(seen: DataFrame, unseen: DataFrame, review_labels: DataFrame, output: str, force: bool = False,
                     config: models.TrainConfig | None = None) -> tuple[models.ProcedureModel, Evaluation, DataFrame]:
    """Apply human overrides, train again and evaluate on the rows left unseen."""
    overrides = curate.override_map(review_labels)
    rows = curate.label_parts(seen, unseen)
    retrain, remaining = curate.merge_overrides(rows, overrides)
    summary = curate.merge_summary(rows, overrides)
    kept = retrain.drop("procedure_key", "overridden", "corrected", "copy", "part")
    training = save_table(kept, f"{output}/retrain", force)
    left = save_table(remaining.drop("part"), f"{output}/remaining", force)
    model = _fit(training, config)
    model.save(f"{output}/model", force)
    return model, evaluate(model, left, label="rule_category"), summary


def _fit(rows: DataFrame, config: models.TrainConfig | None) -> models.ProcedureModel:
    """Train on four fifths of the rows and validate on the rest."""
    parts = written_once(curate.split_seen_unseen(rows, 0.2))
    return models.train(parts.filter("part = 'seen'"), parts.filter("part = 'unseen'"), "rule_category", config)
