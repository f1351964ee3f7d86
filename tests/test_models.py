"""Training, saving, scoring and evaluating on a small table."""

import math
import re
from types import SimpleNamespace

import pytest
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.sql import functions as F

from vaporlog.functions.staging import shared_folder
from vaporlog.operators import curate, features, models
from vaporlog.plans.case_log import build_case_logs, case_log_from_table
from vaporlog.plans.review_set import build_review_set
from vaporlog.plans.training import evaluate_files, retrain_pipeline, train_from_files, train_pipeline, training_rows
from vaporlog.rules import procedures as P
from vaporlog.rules import training as T
from vaporlog.sources import columns

QUICK = models.TrainConfig(max_iter=20, trees=3, depth=4)


def test_train_and_retrain(spark, tmp_path):
    texts = ["CABG with bypass", "Craniotomy for tumor", "VATS lobectomy", "Knee arthroscopy"]
    choices = F.array(*[F.lit(t) for t in texts])
    rows = spark.range(120).select(
        F.col("id").alias("seq"),
        F.concat(F.get(choices, (F.col("id") % 4).cast("int")), F.lit(" case "), F.col("id").cast("string")).alias("procedure"),
        F.lit("").alias("service_text"),
    )
    model, evaluation = train_pipeline(rows, str(tmp_path / "run"), size=100, config=QUICK)
    assert evaluation.accuracy.first().ml_accuracy > 0.8
    assert evaluation.bins.first().total_cases == spark.read.parquet(str(tmp_path / "run/unseen")).count()
    scored = model.score(rows)
    assert scored.filter("ml_confidence < 0 OR ml_confidence > 1.000001").isEmpty()
    loaded = models.ProcedureModel.load(spark, str(tmp_path / "run/model"))
    again = loaded.score(rows).select("seq", "ml_category")
    assert again.exceptAll(scored.select("seq", "ml_category")).isEmpty()
    top = models.top_predictions(scored, model.labels).first().top_predictions
    assert len(top) == 3 and top[0].probability >= top[1].probability
    seen, unseen = (spark.read.parquet(str(tmp_path / f"run/{part}")) for part in ("seen", "unseen"))
    labels = unseen.limit(2).select("seq", "procedure", F.lit("Vaginal del").alias("human_category"))
    _model, _evaluation, summary = retrain_pipeline(seen, unseen, labels, str(tmp_path / "again"), config=QUICK)
    assert summary.first().unseen_promoted == 2


def test_cross_validation_is_stratified(spark):
    rows = spark.range(60).select(
        F.col("id").alias("seq"), F.lit("").alias("service_text"),
        F.when(F.pmod("id", F.lit(6)) == 0, "CESAREAN SECTION").otherwise("CABG").alias("procedure"),
        F.when(F.pmod("id", F.lit(6)) == 0, "one").otherwise("two").alias("label"),
    )
    model = models.train(rows, rows, "label", QUICK)
    accuracies = models.cross_validate(rows, model, "label", folds=5, config=QUICK)
    assert len(accuracies) == 5 and min(accuracies) == 1.0  # each fold has two rows of the rare class
    assert models.cross_validate(rows, model, "label", folds=11, config=QUICK) == []


def test_vocabulary_does_not_depend_on_partitions(spark):
    rows = spark.range(60).select(
        F.concat(F.lit("VALVE\n  A"), F.pmod("id", F.lit(7)).cast("string"), F.lit(" B"), F.pmod("id", F.lit(5)).cast("string")).alias("procedure"),
        F.lit("CARDIAC\nTHORACIC").alias("service_text"),
    )
    inputs = features.with_text(features.structured_features(features.feature_inputs(rows)))
    found = []
    for parts in (1, 3, 7):
        stages = features.fit_features(inputs.repartition(parts)).stages
        found.append([s.vocabulary for s in stages if isinstance(s, CountVectorizerModel)])
    assert found[0] == found[1] == found[2]
    # one line break is no run of white space and stays
    assert any("\n" in gram for gram in found[0][1]) and not any("  " in gram for gram in found[0][1])


def test_prepared_service_text_is_clean(spark):
    rows = spark.createDataFrame([(1, "CABG", " nan "), (2, "CABG", None), (3, "CABG", " Cardiac\n")], "seq long, procedure string, service_text string")
    assert [r.service_text for r in curate.prepare(rows).orderBy("seq").collect()] == ["", "", "Cardiac"]


def test_written_tables_need_a_shared_folder(spark):
    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    unset = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(getCheckpointDir=lambda: None))
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_folder(unset)


HEADERS = "MPOG_Case_ID,AIMS_Scheduled_DT,AIMS_Patient_Age_Years,ASA_Status,AIMS_Actual_Procedure_Text,AnesAttendings"


def test_csv_folder_to_fused_case_log(spark, tmp_path):
    """From files to a model, from the model to case logs whose categories are fused."""
    folder = tmp_path / "cases"
    folder.mkdir()
    texts = ["CABG with bypass", "VATS lobectomy", "Cesarean delivery", "Knee arthroscopy"]
    for k in range(2):
        lines = [f"{k}-{i},2025-01-0{1 + i % 9},45,2,{texts[i % 4]} {i}," for i in range(60)]
        (folder / f"P{k}.CaseList.csv").write_text("\n".join([HEADERS, *lines, "bad,2025-01-01,1,2,Knee,,too,many"]) + "\n")
    # a layout of its own: services under another name, the text column under its short one, empty and missing texts
    (folder / "extra.csv").write_text('procedure,Service\nVATS lobectomy,"THORACIC\nENT"\n,ORTHO\nNA,ORTHO\n')
    model, evaluation = train_from_files(spark, str(folder), str(tmp_path / "run"), sample_per_file=50, size=80, config=QUICK)
    stats = {r.file: tuple(r)[1:] for r in spark.read.parquet(str(tmp_path / "run/file_stats")).collect()}
    assert stats == {"P0.CaseList.csv": (60, 60, 0), "P1.CaseList.csv": (60, 60, 0), "extra.csv": (3, 1, 2)}
    assert spark.read.parquet(str(tmp_path / "run/rejects")).count() == 2
    prepared = spark.read.parquet(str(tmp_path / "run/prepared"))
    assert prepared.groupBy("file").count().agg(F.max("count")).first()[0] <= 50 and prepared.count() <= 80
    assert spark.read.parquet(str(tmp_path / "run/distribution")).agg(F.sum("rows")).first()[0] == prepared.count()
    assert evaluation.accuracy.first().rule_accuracy == 1.0

    rows, _ = training_rows(spark, str(folder))
    assert {r.service_text for r in rows.filter("file = 'extra.csv'").collect()} == {"THORACIC\nENT", "ORTHO"}

    # a model that calls every text vaginal delivery and is sure of it overrides the rules everywhere
    sure = SimpleNamespace(score=lambda frame: frame.withColumns({"ml_category": F.lit(P.VAGINAL_DELIVERY), "ml_confidence": F.lit(0.9)}))
    (folder / "P0.ProcedureList.csv").write_text("MPOG_Case_ID,ProcedureName,Comment,Details\n0-1,LMA,,\nno case,Labor Epidural,,\n")
    for fitted, threshold, categories in ((model, 0.0, None), (sure, 0.95, {P.VAGINAL_DELIVERY})):
        out = str(tmp_path / f"log{threshold}{categories is None}")
        result = build_case_logs(spark, str(folder), out, model=fitted, threshold=threshold)
        log = spark.read.parquet(f"{out}/case_log/data")
        found = {r["Case ID"]: r["Procedure Category"] for r in log.collect()}
        assert len(found) == 60
        if categories:
            assert set(found.values()) == categories
            assert result.standalone.select("procedure_category").distinct().first()[0] == P.VAGINAL_DELIVERY
        else:
            table = columns.map_columns(spark.read.option("header", True).csv(f"{folder}/P0.CaseList.csv").select(
                F.col("MPOG_Case_ID").alias("Episode ID"), F.col("AIMS_Actual_Procedure_Text").alias("Procedure")).filter("`Episode ID` <> 'bad'"))
            rows = table.select(F.col("episode_id").alias("seq"), "procedure", F.lit("").alias("service_text"))
            want = {r.seq: r.ml_category for r in model.score(rows).collect()}
            assert found == want  # from threshold 0 on every known answer of the model counts
    table = spark.createDataFrame([("1", "Knee arthroscopy", "x", 1)], "`Episode ID` string, Procedure string, text string, features int")
    assert case_log_from_table(table, model=sure).first()["Procedure Category"] == P.VAGINAL_DELIVERY
    assert case_log_from_table(table).first()["Procedure Category"] == P.OTHER
    parsed = result.cases.withColumn("_x", F.lit(1))
    assert build_review_set(parsed, max_cases=5).count() <= 5


def test_evaluation_finds_its_label_column(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("seq"), F.lit("").alias("service_text"), F.when(F.col("id") % 2 == 0, "CABG").otherwise("Cesarean delivery").alias("procedure"))
    model, _ = train_pipeline(rows, str(tmp_path / "run"), size=40, config=QUICK)
    (tmp_path / "a.csv").write_text("procedure,label,human_category\nCesarean delivery,x,ProcedureCategory.CESAREAN\nCABG,x,NA\nCABG,x,Other (procedure cat)\n")
    found = evaluate_files(spark, model, f"{tmp_path}/a.csv").accuracy.first()
    assert (found.labeled_cases, found.rule_accuracy) == (2, 0.5)  # human_category comes first
    assert evaluate_files(spark, model, f"{tmp_path}/a.csv", label="label").accuracy.first().rule_accuracy == 0.0
    with pytest.raises(ValueError, match="Label column not found"):
        evaluate_files(spark, model, f"{tmp_path}/a.csv", label="truth")
    (tmp_path / "b.csv").write_text("procedure\nCABG\n")
    plain = evaluate_files(spark, model, f"{tmp_path}/b.csv")
    assert plain.accuracy is None and plain.bins.first().total_cases == 1
    (tmp_path / "c.csv").write_text("id\n1\n")
    with pytest.raises(ValueError, match="No procedure column"):
        evaluate_files(spark, model, f"{tmp_path}/c.csv")


def test_repeated_vectors_are_weighted(spark):
    """Training grows with different vectors: repeats become weights, none is lost."""
    rows = spark.range(1000).select(F.when(F.col("id") < 2, "rare").otherwise("common").alias("_truth"), F.when(F.col("id") < 2, F.col("id")).otherwise(2).alias("features"))
    distinct = models._distinct(rows)
    assert distinct.count() == 3 and distinct.agg(F.sum("_n")).first()[0] == 1000
    weighted = models._weighted(distinct)
    assert weighted.columns == ["_truth", "features", "_weight"]
    assert weighted.count() == 2 + models.T.REPEATS and weighted.agg(F.sum("_weight")).first()[0] == 1000.0
    scored = distinct.withColumn("ml_category", F.lit("common"))
    assert models._accuracy(scored, "_truth") == 0.998


def test_weights_of_terms_are_their_smoothed_idf(spark):
    rows = spark.range(9).select(F.lit("VALVE VALVE").alias("procedure"), F.when(F.col("id") < 4, "ENT").otherwise("").alias("service_text"))
    inputs = features.with_text(features.structured_features(features.feature_inputs(rows)))
    stages = features.fit_features(inputs).stages
    words = next(s for s in stages if isinstance(s, CountVectorizerModel)).vocabulary
    weights = next(s for s in stages if isinstance(s, ElementwiseProduct)).getScalingVec()
    assert weights[words.index("valve")] == 1.0 and weights[words.index("ent")] == pytest.approx(1.0 + math.log(10 / 5))


ODD_TEXTS = (
    "CABG x3 with bypass 48151", "CABG x3 with bypass 62342", "CABG  post 7 bypass\n\n9 graft", "post pre 77 VALVE a1 1a\tb", "12", "", None, "7 valve",
    "valve-5150/graft", "Straße ὈΔΥΣΣΕΎΣ 99", "ꀀꀀ valve ꀁ 5", "valve \U0001d54f\U0001d54f 31 graft", "x3x33 333 valve3", "  9  8  ",
)


def odd_inputs(spark):
    """Odd texts, repeated, with a number in half of them that is in no other row."""
    texts = F.array(*[F.lit(text) for text in ODD_TEXTS])
    text = F.get(texts, F.pmod("id", F.lit(len(ODD_TEXTS))).cast("int"))
    rows = spark.range(420).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 2 == 0, text).otherwise(F.concat(text, F.lit(" "), (F.col("id") * 7919 + 100003).cast("string"))).alias("procedure"),
        F.when(F.col("id") % 5 == 0, "CARDIAC\nTHORACIC").otherwise("").alias("service_text"),
    )
    return features.with_text(features.structured_features(features.feature_inputs(rows)))


def counted_terms(texts):
    """Occurrences and rows of all terms, by brute force."""
    kinds = {"words": ({}, {}), "chars": ({}, {})}
    for text in texts:
        words = [w for w in re.findall(r"\w\w+", text) if w not in T.STOP_WORDS]
        found = {
            "words": [" ".join(words[i:i + n]) for n in T.WORD_NGRAMS for i in range(len(words) - n + 1)],
            "chars": [text[i:i + n] for n in T.CHAR_NGRAMS for i in range(len(text) - n + 1)],
        }
        for kind, terms in found.items():
            for count, terms in zip(kinds[kind], (terms, set(terms)), strict=True):
                for term in terms:
                    count[term] = count.get(term, 0) + 1
    return kinds


@pytest.mark.parametrize(("rare", "words", "chars"), [(10000, 800, 200), (2, 25, 30), (100, 60, 400)])
def test_vocabulary_is_that_of_all_terms(spark, monkeypatch, rare, words, chars):
    """Also where the first guess of what is rare is too high, or a vocabulary has room for rare terms."""
    monkeypatch.setattr(T, "RARE_WORDS", rare)
    monkeypatch.setattr(T, "WORD_FEATURES", words)
    monkeypatch.setattr(T, "CHAR_FEATURES", chars)
    inputs = odd_inputs(spark)
    counters = [s for s in features.fit_features(inputs).stages if isinstance(s, CountVectorizerModel)]
    kinds = counted_terms([row.text for row in inputs.select("text").collect()])
    for counter, (kind, size) in zip(counters, (("words", words), ("chars", chars)), strict=True):
        occurrences, rows = kinds[kind]
        ranked = sorted((t for t in occurrences if rows[t] >= T.MIN_DOC_FREQ), key=lambda t: (-occurrences[t], t.encode()))
        assert counter.vocabulary == ranked[:size]


@pytest.mark.parametrize(("words", "chars", "most"), [(12, 30, 28), (800, 200, 420)])
def test_different_texts_give_the_vectors_of_all_rows(spark, monkeypatch, words, chars, most):
    """Numbers outside the vocabulary do not make a text a different one, and no row gets another vector."""
    monkeypatch.setattr(T, "WORD_FEATURES", words)
    monkeypatch.setattr(T, "CHAR_FEATURES", chars)
    inputs = odd_inputs(spark)
    fitted = features.fit_features(inputs)
    keyed = features.with_key(fitted, features.packed(inputs.select("seq", "text", *features.structured_names())))
    found = features.different_vectors(fitted, keyed)
    assert found.count() <= most and found.agg(F.sum("_n")).first()[0] == 420
    want = {r.seq: r.features for r in fitted.transform(inputs).select("seq", "features").collect()}
    for limit in (T.BROADCAST_KEYS, 0):  # also where the keys are too many for a broadcast
        monkeypatch.setattr(T, "BROADCAST_KEYS", limit)
        assert {r.seq: r.features for r in features.meet(keyed, found).select("seq", "features").collect()} == want


def test_table_scores_are_those_of_its_rows(spark):
    rows = odd_inputs(spark).select("seq", "procedure", "service_text", F.when(F.col("text").contains("valve"), "one").otherwise("two").alias("label"))
    model = models.train(rows, rows, "label", QUICK)
    assert model.metadata["training_samples"] == 420
    one, all_at_once = model.score(rows), model.score_table(rows)
    assert one.columns == all_at_once.columns
    assert {tuple(r)[:1]: r for r in one.collect()} == {tuple(r)[:1]: r for r in all_at_once.collect()}
