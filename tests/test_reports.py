"""Quality reports, curation, review sets and hybrid decisions."""

import pytest
from pyspark.sql import functions as F

from vaporlog.functions.ranking import bin_sizes, top_per_group, with_chosen
from vaporlog.functions.text import display_name, fixed_point
from vaporlog.operators import curate, hybrid, quality, review
from vaporlog.operators import queue as Q

CASES = "seq long, episode_id string, responsible_provider string, procedure string, age_category string, parsing_warnings array<string>, confidence_score double, airway_management array<string>, vascular_access array<string>, monitoring array<string>"


@pytest.fixture
def cases(spark):
    return spark.createDataFrame([
        (0, "1", "A", "Hip", "d", [], 0.9, ["Oral ETT"], [], []),
        (1, "2", "A", "Hip", "d", ["w1"], 0.6, ["Oral ETT", "Mask"], ["Arterial Catheter"], []),
        (2, None, "", "Hip", None, ["w1", "w2"], 0.5, [], [], ["TEE"]),
        (3, "4", "A", None, "d", [], 0.3, [], [], []),
    ], CASES)


def test_summary(cases):
    assert quality.summary(cases).first().asDict() == {
        "total_cases": 4, "cases_with_warnings": 2, "low_confidence_cases": 3, "average_confidence": 0.575
    }
    assert [(r.warning, r.occurrences) for r in quality.top_warnings(cases).collect()] == [("w1", 2), ("w2", 1)]
    assert {r.field: r.missing for r in quality.missing_field_counts(cases).collect()} == {
        "episode_id": 1, "provider": 1, "procedure": 1, "age_category": 1
    }
    assert {r.family: r.rate for r in quality.extraction_rates(cases).collect()} == {
        "airway": 0.5, "vascular": 0.25, "monitoring": 0.25
    }
    assert {(r.family, r.value): r.occurrences for r in quality.extraction_values(cases).collect()}[("airway", "Oral ETT")] == 2
    assert [r.seq for r in quality.problematic_cases(cases).orderBy("seq").collect()] == [1, 2, 3]
    problems = quality.first_problems(cases, n=2).collect()
    assert [(r.seq, r.more) for r in problems] == [(1, 1), (2, 1)]
    table = quality.case_table(cases).collect()
    assert table[2]["Missing Fields"] == "episode_id; responsible_provider; age_category"
    assert table[1]["Confidence Score"] == "0.600"


def test_empty_summary(cases):
    assert quality.summary(cases.filter("seq < 0")).first().average_confidence == 0.0


def test_fixed_point_rounds_like_python(spark):
    values = [i / 1000 for i in range(1001)] + [0.125, 0.375, 1.0, 0.0]
    frame = spark.createDataFrame([(v,) for v in values], "v double")
    shown = frame.select("v", fixed_point(F.col("v"), 2).alias("s")).collect()
    assert all(r.s == f"{r.v:.2f}" for r in shown)


def test_display_name(spark):
    frame = spark.createDataFrame([("O'BRIEN-SMITH_JANE",), ("solo",), ("A_B_C",)], "n string")
    assert [r[0] for r in frame.select(display_name(F.col("n"))).collect()] == ["Jane O'Brien-Smith", "Solo", "B_C A"]


def test_ranks_with_a_hot_group(spark):
    frame = spark.range(3000).select(
        F.col("id").alias("seq"), F.when(F.col("id") % 3 == 0, "cold").otherwise("hot").alias("g"),
        (F.col("id") * 7919 % 1000).alias("score"),
    )
    best = top_per_group(frame, ["g"], [F.desc("score"), F.asc("seq")], 5, F.col("seq")).collect()
    expected = sorted(((r.g, -r.score, r.seq) for r in frame.collect()))
    for group in ("hot", "cold"):
        want = [s for g, _m, s in expected if g == group][:5]
        assert [r.seq for r in sorted(best, key=lambda r: r.rank) if r.g == group] == want
    hashed = curate.order_hash(frame, "seq")
    equal = frame.withColumn("_hash", F.lit(7))
    for rows in (hashed, equal, hashed.withColumn("g", F.when(F.col("g") == "hot", "hot")), hashed.limit(0)):
        for limit in (0, 700, 1000) if rows is hashed else (700,):
            sizes = bin_sizes(rows, ["g"], "_hash").withColumn("_limit", F.lit(limit))
            found = with_chosen(rows, sizes, ["g"], "_hash", "seq").collect()
            for group in {r.g for r in found}:
                ranked = sorted((r for r in found if r.g == group), key=lambda r: (r._hash, r.seq))
                assert [r.chosen for r in ranked] == [i < limit for i in range(len(ranked))]


def test_samples_move_no_whole_rows(spark):
    rows = spark.range(100).select(F.col("id").alias("seq"), F.lit("f").alias("file"), F.lit("x").alias("payload"))
    plan = curate.sample_per_file(rows, 10)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "Window" not in plan
    assert curate.sample_per_file(rows, 10).count() == 10


def test_split(spark):
    frame = spark.createDataFrame([(i, "p", c) for i, c in enumerate("AABBCC")], "seq long, procedure string, rule_category string")
    parts = curate.split_seen_unseen(frame, 0.2).collect()
    assert len(parts) == 6 and sum(r.part == "unseen" for r in parts) == 2
    many = spark.range(100).select(
        F.col("id").alias("seq"), F.lit("p").alias("procedure"), F.when(F.col("id") < 70, "A").otherwise("B").alias("rule_category")
    )
    unseen = [r.rule_category for r in curate.split_seen_unseen(many, 0.2).filter("part = 'unseen'").collect()]
    assert (unseen.count("A"), unseen.count("B")) == (14, 6)
    with pytest.raises(ValueError, match="between 0 and 1"):
        curate.split_seen_unseen(frame, 1.5)


def test_value_sample(spark):
    frame = spark.range(100).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") < 60, "CABG").otherwise("Hip").alias("procedure"),
        F.when(F.col("id") < 80, "Cardiac with CPB").otherwise("Other (procedure cat)").alias("rule_category"),
        F.when(F.col("id") < 10, "w").otherwise("").alias("warnings"),
    )
    tiers = [r.tier for r in curate.sample_by_value(frame, 40).collect()]
    assert {t: tiers.count(t) for t in set(tiers)} == {"high": 10, "medium": 12, "low": 18}


def test_override_merge(spark):
    columns = "seq long, procedure string, rule_category string"
    seen = spark.createDataFrame([(0, "Hip  one", "A"), (1, "knee", "A"), (2, "HIP ONE", "B")], columns)
    unseen = spark.createDataFrame([(3, "hip two", "A"), (4, "elbow", "A")], columns)
    labels = spark.createDataFrame(
        [(0, "hip one", "X"), (1, "HIP one ", "B"), (2, "hip two", "ProcedureCategory.CESAREAN"), (3, " ", "Z")],
        "seq long, procedure string, human_category string",
    )
    overrides = curate.override_map(labels)
    rows = curate.label_parts(seen, unseen)
    retrain, remaining = curate.merge_overrides(rows, overrides)
    got = sorted((r.procedure_key, r.rule_category, r.copy) for r in retrain.collect())
    assert got == [("HIP ONE", "B", 1)] + [("HIP TWO", "Cesarean del", i) for i in (1, 2, 3)] + [("KNEE", "A", 1)]
    assert [r.procedure for r in remaining.collect()] == ["elbow"]
    assert curate.merge_summary(rows, overrides).first().asDict() == {
        "corrected_rows_weighted": 1, "rows_added_by_weighting": 2, "retrain_rows": 5, "seen_overrides_applied": 2,
        "unseen_promoted": 1, "remaining_eval_rows": 1, "override_count": 2,
    }


def test_override_merge_meets_one_row_per_key(spark):
    rows = spark.range(400).select(
        F.col("id").alias("seq"),
        F.when(F.col("id") < 300, "hot").when(F.col("id") < 320, " ").otherwise(F.concat(F.lit("k"), F.pmod("id", F.lit(9)))).alias("procedure"),
        F.when(F.pmod("id", F.lit(3)) == 0, "A").otherwise("B").alias("rule_category"),
        F.when(F.pmod("id", F.lit(5)) == 0, "unseen").otherwise("seen").alias("part"),
    )
    overrides = spark.createDataFrame([("HOT", "A"), ("K1", "C"), ("NONE", "D")], "procedure_key string, override string")
    marked = curate.apply_overrides(rows, overrides).collect()
    last = {}
    for r in sorted(marked, key=lambda r: (r.part == "unseen", r.seq)):
        if r.part == "seen" or r.overridden:
            last[r.procedure_key] = r
    retrain, remaining = curate.merge_overrides(rows, overrides)
    got = [(r.procedure_key, r.seq, r.rule_category, r.overridden, r.corrected) for r in retrain.collect()]
    assert sorted(got) == sorted(
        (k, r.seq, r.rule_category, r.overridden, r.corrected) for k, r in last.items() for _ in range(3 if r.corrected else 1)
    )
    left = sorted(r.seq for r in marked if r.part == "unseen" and not r.overridden)
    assert sorted(r.seq for r in remaining.collect()) == left
    assert curate.merge_summary(rows, overrides).first().remaining_eval_rows == len(left)


def test_quotas():
    assert review.bucket_quotas(600) == {"double_lumen": 180, "tube_route": 180, "ga_mac": 180, "control": 60}
    assert review.bucket_quotas(0) == dict.fromkeys(review.R.BUCKETS, 0)
    for n in range(1, 60):
        assert sum(review.bucket_quotas(n).values()) == n


def test_selection(spark):
    rows = [("double_lumen", 9.0, 0, "a"), ("double_lumen", 8.0, 1, "b"), ("tube_route", 7.0, 0, "a"),
            ("tube_route", 6.0, 2, "c"), ("ga_mac", 5.0, 3, "d"), ("control", 1.5, 4, "e"), ("ga_mac", 9.5, 5, "f")]
    best = spark.createDataFrame(rows, "bucket string, score double, seq long, case_key string")
    chosen = {r.case_key: r.bucket for r in review.select_cases(best, 5).collect()}
    assert chosen == {"a": "double_lumen", "c": "tube_route", "f": "ga_mac", "e": "control", "b": "double_lumen"}
    assert review.select_cases(best, 100).count() == 6


def test_hybrid(spark):
    rows = [("Other (procedure cat)", "Cesarean del", 0.5), ("Cesarean del", "Cesarean del", 0.5), ("Cesarean del", "Vaginal del", 0.6),
            ("Cesarean del", "Vaginal del", 0.9), ("Cesarean del", "Vaginal del", 0.1), ("Cesarean del", "Nope", 0.99)]
    frame = spark.createDataFrame(rows, "rule_category string, ml_category string, ml_confidence double").withColumn(
        "rule_warnings", F.array().cast("array<string>")
    )
    got = [(r.method, r.procedure_category, r.category_warnings) for r in hybrid.fuse(frame).collect()]
    assert [g[0] for g in got] == ["ml_fill_other", "ml_rules_agree", "ml_preferred", "ml_override", "rules", "rules"]
    assert got[2][2] == ["ML preferred over rules: Vaginal del over Cesarean del (conf=0.60)"]
    assert got[5][2] == ["ML returned invalid category: Nope"]


def test_queue(spark):
    rows = [(0, "x", 0.9, False), (1, "y", 0.5, True), (2, " ", 0.1, True), (3, "z", 0.6, False)]
    frame = spark.createDataFrame(rows, "seq long, procedure string, ml_confidence double, disagreement boolean")
    assert [r.seq for r in Q.review_queue(Q.focus_filter(frame)).collect()] == [1, 3]
    assert Q.focus_filter(frame, "all").count() == 3
    reviewed = spark.createDataFrame([(1, "d", "m"), (3, "d", "other")], "seq long, data_id string, model_id string")
    assert sorted(r.seq for r in Q.exclude_reviewed(frame, reviewed, "d", "m").collect()) == [0, 2, 3]


def test_override_lookup_spreads_hot_and_blank_keys(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    try:
        rows = spark.range(6000).select(
            F.col("id").alias("seq"), F.lit("A").alias("rule_category"),
            F.when(F.col("id") % 3 == 0, "hot  key").when(F.col("id") % 3 == 1, F.when(F.col("id") % 2 == 0, " ")).otherwise(F.concat(F.lit("cold "), F.col("id") % 2000)).alias("procedure"),
        )
        overrides = spark.createDataFrame([("HOT KEY", "B"), ("COLD 5", "C"), ("COLD 8", "A")], "procedure_key string, override string")
        found = curate.apply_overrides(rows, overrides)
        parts = found.groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(parts) == 8 and max(r["count"] for r in parts) < 1200
        got = {r.seq: (r.rule_category, r.overridden, r.corrected, r.procedure_key) for r in found.collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(got) == 6000
    assert got[0] == got[5997] == ("B", True, True, "HOT KEY")
    assert got[5] == ("C", True, True, "COLD 5") and got[8] == ("A", True, False, "COLD 8") and got[11][0] == "A"
    assert got[4][:3] == got[1][:3] == ("A", False, False)
