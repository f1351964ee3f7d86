"""Train, score and evaluate procedure classifiers with MLlib."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.ml import PipelineModel
from pyspark.ml.classification import (
    LogisticRegression,
    LogisticRegressionModel,
    RandomForestClassificationModel,
    RandomForestClassifier,
)
from pyspark.ml.feature import StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vaporlog.functions.staging import written_once
from vaporlog.operators.curate import normalize_label, order_hash
from vaporlog.operators.features import (
    KEY,
    different_vectors,
    feature_inputs,
    fit_different,
    meet,
    packed,
    structured_features,
    structured_names,
    with_key,
    with_text,
)
from vaporlog.rules import training as T

LOGISTIC, FOREST, ENSEMBLE = "logistic", "forest", "ensemble"


@dataclass(frozen=True)
class TrainConfig:
    """Sizes of the candidate models."""

    max_iter: int = T.LOGISTIC_MAX_ITER
    trees: int = T.FOREST_TREES
    depth: int = T.FOREST_DEPTH
    feature_version: int = 2
    seed: int = T.SEED


@dataclass
class ProcedureModel:
    """Fitted features, candidate models and the name of the best one."""

    features: PipelineModel
    labels: list[str]
    candidates: dict
    best: str
    metadata: dict = field(default_factory=dict)
    feature_version: int = 2

    def vectors(self, rows: DataFrame) -> DataFrame:
        """Rows with their ``features`` vector."""
        inputs = with_text(structured_features(feature_inputs(rows), self.feature_version))
        return self.features.transform(inputs).select(*rows.columns, *_new(rows, inputs), "features")

    def score(self, rows: DataFrame) -> DataFrame:
        """Add ``ml_category``, ``ml_confidence`` and ``ml_probabilities``."""
        return score_vectors(self.vectors(rows), self.candidates, self.best, self.labels).drop("features")

    def score_table(self, rows: DataFrame) -> DataFrame:
        """Like ``score``, for a whole table: its inputs are written, and each different vector is scored once."""
        return self.score_inputs(model_inputs(rows, version=self.feature_version)).drop("top_predictions")

    def score_inputs(self, inputs: DataFrame) -> DataFrame:
        """Score a table made by ``model_inputs``; also adds ``top_predictions``."""
        keyed = with_key(self.features, inputs)
        vectors = different_vectors(self.features, keyed, self.feature_version).select(*KEY, "features")
        scored = top_predictions(score_vectors(vectors, self.candidates, self.best, self.labels), self.labels)
        scores = ["ml_probabilities", "ml_confidence", "ml_category", "top_predictions"]
        return meet(keyed, scored.select(*KEY, *scores)).select("_row.*", *scores)

    def save(self, path: str, force: bool = False) -> None:
        """Write the model folder: features, candidates and metadata."""
        stages = {"features": self.features, **self.candidates}
        for name, stage in stages.items():
            writer = stage.write().overwrite() if force else stage.write()
            writer.save(f"{path}/{name}")
        row = {"labels": self.labels, "best": self.best, "feature_version": self.feature_version, **self.metadata}
        spark = SparkSession.getActiveSession()
        frame = spark.createDataFrame([(json.dumps(row),)], "value string")
        frame.coalesce(1).write.mode("overwrite" if force else "errorifexists").text(f"{path}/metadata")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> ProcedureModel:
        """Read a model folder."""
        row = json.loads(spark.read.text(f"{path}/metadata").first()["value"])
        candidates = {
            LOGISTIC: LogisticRegressionModel.load(f"{path}/{LOGISTIC}"),
            FOREST: RandomForestClassificationModel.load(f"{path}/{FOREST}"),
        }
        return cls(PipelineModel.load(f"{path}/features"), row["labels"], candidates, row["best"], row,
                   row["feature_version"])


def _new(rows: DataFrame, inputs: DataFrame) -> list[str]:
    added = ("rule_category", "rule_warnings", "rule_warning_count")
    return [name for name in added if name in inputs.columns and name not in rows.columns]


def _probabilities(vectors: DataFrame, model, into: str) -> DataFrame:
    drop = [model.getRawPredictionCol(), model.getPredictionCol(), model.getProbabilityCol()]
    scored = model.transform(vectors)
    return scored.withColumn(into, vector_to_array(F.col(model.getProbabilityCol()))).drop(*drop)


def score_vectors(vectors: DataFrame, candidates: dict, best: str, labels: list[str]) -> DataFrame:
    """Score feature vectors with one candidate, or with the mean of both."""
    for name in _learners(best):
        vectors = _probabilities(vectors, candidates[name], f"_p_{name}")
    return vote(vectors, best, labels)


def vote(rows: DataFrame, best: str, labels: list[str]) -> DataFrame:
    """From the class probabilities of learners (``_p_`` and their name) to ``ml_probabilities``, ``ml_confidence`` and ``ml_category``.

    The ensemble is the mean of both; of equally likely classes the first is chosen.
    """
    if best == ENSEMBLE:
        mean = F.zip_with(f"_p_{LOGISTIC}", f"_p_{FOREST}", lambda a, b: (a + b) / 2)
    else:
        mean = F.col(f"_p_{best}")
    classes = F.array(*[F.lit(label) for label in labels])
    scored = rows.withColumn("ml_probabilities", mean).withColumn("ml_confidence", F.array_max("ml_probabilities"))
    position = F.array_position("ml_probabilities", F.col("ml_confidence"))
    return scored.withColumn("ml_category", F.get(classes, (position - 1).cast("int"))).drop(*[f"_p_{n}" for n in _learners(best)])


def top_predictions(scored: DataFrame, labels: list[str], k: int = 3) -> DataFrame:
    """Add ``top_predictions``: the k most likely classes of each row."""
    classes = F.array(*[F.lit(label) for label in labels])
    pairs = F.zip_with("ml_probabilities", classes, lambda p, c: F.struct((-p).alias("minus"), c.alias("category")))
    ranked = F.slice(F.array_sort(pairs), 1, k)
    return scored.withColumn(
        "top_predictions",
        F.transform(ranked, lambda s: F.struct(s["category"].alias("category"), (-s["minus"]).alias("probability"))),
    )


def _learners(name: str) -> list[str]:
    """The classifiers a candidate is made of."""
    return [LOGISTIC, FOREST] if name == ENSEMBLE else [name]


def _fit_candidates(vectors: DataFrame, rows: int, config: TrainConfig, best: str = ENSEMBLE) -> dict:
    """The classifiers that candidate ``best`` needs.

    ``_weight`` says how many of the ``rows`` a vector stands for. The penalty 1/rows equals a unit penalty on the
    summed loss. The forest has no smallest size of a split here; two rows per leaf come closest.
    """
    logistic = LogisticRegression(
        labelCol="_label", weightCol="_weight", maxIter=config.max_iter, regParam=1.0 / rows, standardization=False, family="multinomial"
    )
    forest = RandomForestClassifier(
        labelCol="_label", weightCol="_weight", numTrees=config.trees, maxDepth=config.depth, seed=config.seed,
        minInstancesPerNode=T.FOREST_MIN_SPLIT // 2, featureSubsetStrategy="sqrt",
    )
    known = {LOGISTIC: logistic, FOREST: forest}
    return {name: known[name].fit(vectors) for name in _learners(best)}


def _accuracy(scored: DataFrame, label: str) -> float:
    """Share of right rows; ``_n`` is how many rows one stands for."""
    right = F.sum(F.when(F.col("ml_category") == F.col(label), F.col("_n")).otherwise(0)) / F.sum("_n")
    return scored.agg(F.coalesce(right, F.lit(0.0)).alias("accuracy")).first()["accuracy"]


def _distinct(vectors: DataFrame) -> DataFrame:
    """Different rows of a table of vectors, written, with how often each occurs (``_n``, which may be given for parts)."""
    many = F.sum("_n") if "_n" in vectors.columns else F.count(F.lit(1))
    return written_once(vectors.groupBy(*[name for name in vectors.columns if name != "_n"]).agg(many.alias("_n")))


def _weighted(distinct: DataFrame) -> DataFrame:
    """The rows to fit on: up to REPEATS copies of a row, each alone for a part of its occurrences.

    Texts that differ only outside the vocabulary have equal vectors, so this table grows with the different
    vectors and not with the rows. No occurrence is lost: weights add up to the rows. The summed loss is the same;
    the forest draws its samples by copy, and keeps its smallest leaf, which counts copies.
    """
    copies = F.least(F.col("_n"), F.lit(T.REPEATS))
    rows = distinct.withColumn("_weight", F.col("_n") / copies).withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies)))
    parts = max(distinct.sparkSession.sparkContext.defaultParallelism, distinct.rdd.getNumPartitions())
    return written_once(rows.drop("_copy", "_n").repartition(parts))


def model_inputs(rows: DataFrame, label: str | None = None, version: int = 2, keep: list[str] | None = None) -> DataFrame:
    """What models need of each row, written: ``text``, structured features and, with a label, ``_truth``.

    ``_row`` holds the columns to ``keep``; without them, all of the rows and the rule result.
    """
    truth = [] if label is None else [normalize_label(F.col(label)).alias("_truth")]
    inputs = with_text(structured_features(feature_inputs(rows.select("*", *truth)), version))
    if keep is None:
        keep = [*rows.columns, *_new(rows, inputs)]
    kept = [F.struct(*keep).alias("_row")] if keep else []
    names = [*(["_truth"] if truth else []), "text", *structured_names(version)]
    return written_once(packed(inputs.select(*kept, *names), version))


def train(train_rows: DataFrame, validation_rows: DataFrame, label: str, config: TrainConfig | None = None) -> ProcedureModel:
    """Fit features and candidates; keep the one with the best validation accuracy."""
    version = (config or TrainConfig()).feature_version
    return train_inputs(*[model_inputs(rows, label, version, []) for rows in (train_rows, validation_rows)], label, config)


def train_inputs(train_rows: DataFrame, validation_rows: DataFrame, label: str, config: TrainConfig | None = None) -> ProcedureModel:
    """`train` on tables made by ``model_inputs`` with the label; the learners work on the different vectors."""
    config = config or TrainConfig()
    version = config.feature_version
    columns = ["_truth", "text", *KEY[1:]]
    features, seen = fit_different(train_rows.select(*columns), version)

    def different(inputs: DataFrame) -> DataFrame:
        vectors = different_vectors(features, with_key(features, inputs), version, "_truth")
        return _distinct(vectors.select("_truth", "features", "_n"))

    distinct = different(seen)
    indexer = StringIndexer(inputCol="_truth", outputCol="_label", stringOrderType="alphabetAsc").fit(distinct)
    distinct = indexer.transform(distinct).select("_label", "_truth", "features", "_n")
    count = distinct.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    candidates = _fit_candidates(_weighted(distinct), count, config)
    checked = different(validation_rows.select(*columns))
    labels = list(indexer.labels)
    scores = {
        name: _accuracy(score_vectors(checked, candidates, name, labels), "_truth")
        for name in (LOGISTIC, FOREST, ENSEMBLE)
    }
    best = max(scores, key=scores.get)
    metadata = {"training_samples": count, "validation_accuracy": scores, "label_column": label}
    return ProcedureModel(features, labels, candidates, best, metadata, version)


def cross_validate(rows: DataFrame, model: ProcedureModel, label: str, key: str = "seq", folds: int = T.CV_FOLDS,
                   config: TrainConfig | None = None) -> list[float]:
    """Accuracy per stratified fold with fixed features; empty when a class has fewer rows than folds.

    ``rows`` is the bounded training sample. Each class is dealt out in hash order, one row to
    every fold in turn, and only the learners of the model's best candidate are fitted.
    """
    config = config or TrainConfig()
    truth = rows.withColumn("_truth", normalize_label(F.col(label)))
    smallest = truth.groupBy("_truth").count().agg(F.min("count").alias("n")).first()["n"]
    if smallest is None or smallest < folds:
        return []
    vectors = order_hash(model.vectors(truth), key, config.seed).select("_truth", "features", "_hash", F.col(key).alias("_key"))
    dealt = Window.partitionBy("_truth").orderBy("_hash", "_key")
    indexer = StringIndexer(inputCol="_truth", outputCol="_label", stringOrderType="alphabetAsc").fit(vectors)
    vectors = written_once(indexer.transform(vectors).withColumn("_fold", F.row_number().over(dealt) % folds).withColumns({"_n": F.lit(1), "_weight": F.lit(1.0)}))
    accuracies = []
    for fold in range(folds):
        part = vectors.filter(F.col("_fold") != fold)
        candidates = _fit_candidates(part, part.count(), config, model.best)
        held_out = vectors.filter(F.col("_fold") == fold)
        accuracies.append(_accuracy(score_vectors(held_out, candidates, model.best, list(indexer.labels)), "_truth"))
    return accuracies
