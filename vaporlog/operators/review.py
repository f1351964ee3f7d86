"""The airway and anesthesia review set: scoring, candidate lists, selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporlog.functions.matching import any_of, contains_any, guard_words, literal, searched
from vaporlog.functions.ranking import top_per_group
from vaporlog.functions.staging import computed_once, written_once
from vaporlog.functions.text import sha_fraction
from vaporlog.operators.project import airway_flags
from vaporlog.rules import anesthesia as A
from vaporlog.rules import procedures as P
from vaporlog.rules import review as R


def _any_pattern(text: str, patterns) -> Column:
    """True when one of the upper-case patterns occurs in an upper-cased text column."""
    return F.expr(any_of(
        f"({contains_any(text, [word.upper() for word in guard_words(p)] or [''])} AND rlike({text}, {literal('(?U)' + searched(p))}))"
        for p in patterns
    ))


def case_keys(cases: DataFrame, source: str = "source_file") -> DataFrame:
    """Add ``case_key``; cases without an id get a hash of their content instead."""
    content = F.to_json(F.struct(*sorted(cases.columns)))
    fallback = F.concat(F.lit("missing-case-id-"), F.substring(F.sha2(content, 256), 1, 8))
    case_id = F.coalesce(F.nullif(F.col("episode_id"), F.lit("")), fallback)
    procedure = F.substring(F.coalesce("procedure", F.lit("")), 1, 80)
    return cases.withColumn("case_key", F.concat_ws(":", F.col(source), case_id, procedure))


def assess(cases: DataFrame, source: str = "source_file") -> DataFrame:
    """Add bucket scores, ``review_targets`` and ``review_reasons`` to parsed cases."""
    parts = [F.nullif(F.coalesce(name, F.lit("")), F.lit("")) for name in ("procedure", "procedure_notes", "raw_anesthesia_type")]
    flagged = airway_flags(case_keys(cases, source)).withColumns({
        "_text": F.upper(F.concat_ws("\n", *parts)),
        "_warned": F.upper(F.array_join("parsing_warnings", "\n")),
    })

    def in_text(words) -> Column:
        return F.expr(contains_any("_text", words))

    def in_warnings(words) -> Column:
        return F.expr(contains_any("_warned", words))

    thoracic = in_text(R.THORACIC_HINTS)
    ga_mac = F.col("ga_mac")
    # (bucket, points, reason, condition); order defines the order of reasons. Fixed values.
    tests = (
        ("double_lumen", 12, "predicted_double_lumen", F.col("has_double_lumen_tube")),
        ("double_lumen", 10, "explicit_double_lumen_text", _any_pattern("_text", R.DOUBLE_LUMEN_TEXT)),
        ("double_lumen", 6, "thoracic_category", (F.col("procedure_category") == P.INTRATHORACIC) & thoracic),
        ("double_lumen", 4, "thoracic_procedure_hint", thoracic),
        ("tube_route", 12, "predicted_nasal_route", F.col("tube_route") == "Nasal"),
        ("tube_route", 5, "predicted_oral_route", F.col("tube_route") == "Oral"),
        # Every nasal pattern is a whole-word form of a hint, so the hints decide alone.
        ("tube_route", 8, "nasal_route_text", in_text(R.NASAL_HINTS)),
        ("tube_route", 3, "oral_route_text", _any_pattern("_text", R.ORAL_TEXT)),
        ("ga_mac", 10, "predicted_mac", ga_mac == "MAC"),
        ("ga_mac", 5, "predicted_ga", ga_mac == "GA"),
        ("ga_mac", 8, "mac_note_text", in_text(A.MAC_NOTES)),
        ("ga_mac", 4, "ga_note_text", in_text(A.GA_NOTES)),
        ("ga_mac", 4, "mac_inference_warning", in_warnings(R.MAC_WARNINGS)),
        ("ga_mac", 3, "ga_inference_warning", in_warnings(R.GA_WARNINGS)),
        ("ga_mac", 3, "mac_procedure_hint", in_text(A.MAC_PROCEDURES)),
        (
            "ga_mac",
            3,
            "context_only_ga_mac_inference",
            F.coalesce(F.col("raw_anesthesia_type") == "", F.lit(True)) & ga_mac.isNotNull(),
        ),
    )
    flags = {f"_r{i}": F.coalesce(condition, F.lit(False)) for i, (*_, condition) in enumerate(tests)}
    scored = flagged.withColumns(flags)
    points = {}
    for bucket in R.BUCKETS[:-1]:
        total = F.lit(0.0)
        for i, (name, value, _reason, _condition) in enumerate(tests):
            if name == bucket:
                total = total + F.when(F.col(f"_r{i}"), float(value)).otherwise(0.0)
        points[f"score_{bucket}"] = total
    scored = scored.withColumns(points)
    positive = [F.when(F.col(f"score_{bucket}") > 0, F.lit(bucket)) for bucket in R.BUCKETS[:-1]]
    scored = scored.withColumn("_positive", F.array_compact(F.array(*positive)))
    control = (F.size("_positive") == 0) & (ga_mac.isNotNull() | (F.size("airway_management") > 0))
    reasons = [F.when(F.col(f"_r{i}"), F.lit(reason)) for i, (_b, _v, reason, _c) in enumerate(tests)]
    return computed_once(scored.withColumns({
        "score_control": F.when(control, 1.0 + sha_fraction(F.col("case_key"))).otherwise(0.0),
        "review_targets": F.when(control, F.array(F.lit("control"))).otherwise(F.col("_positive")),
        "review_reasons": F.array_compact(
            F.array(*reasons, F.when(control, F.lit("negative_control")))
        ),
    }).drop("_text", "_warned", "_positive", *flags))


def records(assessed: DataFrame, keep=()) -> DataFrame:
    """The review-table layout, labels blank, not yet assigned to a bucket."""
    def text(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(""))

    blank = F.lit("")
    fields = {
        "case_key": F.col("case_key"),
        "source_file": F.col("source_file"),
        "source_case_id": text("episode_id"),
        "case_date": F.date_format("case_date", "yyyy-MM-dd"),
        "procedure": text("procedure"),
        "procedure_category": F.col("procedure_category"),
        "raw_anesthesia_type": text("raw_anesthesia_type"),
        "procedure_notes": text("procedure_notes"),
        "predicted_anesthesia_type": text("anesthesia_type"),
        "predicted_ga_mac": text("ga_mac"),
        "predicted_tube_route": text("tube_route"),
        "predicted_has_double_lumen_tube": F.when(F.col("has_double_lumen_tube"), "Yes").otherwise("No"),
        "predicted_airway_management": F.array_join("airway_management", "; "),
        "review_targets": F.array_join("review_targets", "; "),
        "priority_bucket": blank,
        "priority_score": F.lit(0.0),
        "review_reasons": F.array_join("review_reasons", "; "),
        "parsing_warnings": F.array_join("parsing_warnings", "; "),
        "label_has_double_lumen_tube": blank,
        "label_ga_mac": blank,
        "label_tube_route": blank,
        "reviewer_notes": blank,
    }
    return assessed.select(*keep, *[fields[name].alias(name) for name in R.REVIEW_COLUMNS])


def bucket_quotas(max_cases: int) -> dict[str, int]:
    """Places per bucket: one each, the rest by weight and largest remainder."""
    if max_cases <= 0:
        return dict.fromkeys(R.BUCKETS, 0)
    floor = 1 if max_cases >= len(R.BUCKETS) else 0
    spare = max_cases - floor * len(R.BUCKETS)
    shares = {bucket: spare * R.BUCKET_WEIGHTS[bucket] for bucket in R.BUCKETS}
    left = spare - sum(int(share) for share in shares.values())
    # sorted() is stable: equal remainders keep bucket order.
    extra = sorted(R.BUCKETS, key=lambda bucket: int(shares[bucket]) - shares[bucket])[:left]
    return {bucket: floor + int(shares[bucket]) + (bucket in extra) for bucket in R.BUCKETS}


def candidate_caps(max_cases: int) -> dict[str, int]:
    """Longest candidate list per bucket."""
    return {
        bucket: 0 if max_cases <= 0 else max(quota * 4, quota or max_cases)
        for bucket, quota in bucket_quotas(max_cases).items()
    }


def candidates(assessed: DataFrame, max_cases: int = R.DEFAULT_MAX_CASES, seq: str = "seq") -> DataFrame:
    """Best cases per bucket, ``(bucket, score, seq, case_key, rank)``.

    Only these narrow rows are ranked; the salted ranking keeps a bucket that holds most
    cases from landing in one task.
    """
    caps = candidate_caps(max_cases)
    scores = F.array(*[
        F.struct(F.lit(bucket).alias("bucket"), F.col(f"score_{bucket}").alias("score"), F.lit(caps[bucket]).alias("cap"))
        for bucket in R.BUCKETS
    ])
    wanted = F.filter(scores, lambda s: (s["score"] > 0) & (s["cap"] > 0))
    exploded = assessed.select(F.col(seq).alias("seq"), "case_key", F.explode(wanted).alias("_s"))
    exploded = exploded.select("_s.*", "seq", "case_key")
    order = [F.desc("score"), F.asc("seq")]
    return top_per_group(exploded, ["bucket"], order, F.col("cap"), F.col("seq")).drop("cap")


def select_cases(best: DataFrame, max_cases: int = R.DEFAULT_MAX_CASES) -> DataFrame:
    """Choose review cases from the candidate lists: ``(case_key, bucket, score, seq)``.

    Buckets take their quota in order, never a case taken before; free places go to the
    best remaining cases of any bucket. The lists hold a few thousand rows at most,
    whatever the input, so the passes are windows over one small partition.
    """
    quotas = bucket_quotas(max_cases)
    firsts = best.groupBy("bucket", "case_key").agg(
        F.min(F.struct((-F.col("score")).alias("minus"), F.col("seq").alias("seq"))).alias("_o")
    )
    wide = firsts.groupBy("case_key").pivot("bucket", list(R.BUCKETS)).agg(F.first("_o"))
    state = wide.withColumn("picked", F.lit(None).cast("string"))
    for bucket in R.BUCKETS:
        order = F.col(bucket)
        free = F.col("picked").isNull() & order.isNotNull()
        turn = Window.partitionBy().orderBy(F.when(free, 0).otherwise(1), order["minus"], order["seq"])
        state = state.withColumn("_turn", F.row_number().over(turn)).withColumn(
            "picked", F.when(free & (F.col("_turn") <= quotas[bucket]), F.lit(bucket)).otherwise(F.col("picked"))
        )
    # Best bucket of a case that was not picked: highest score, then bucket order.
    options = [
        F.when(
            F.col(bucket).isNotNull(),
            F.struct(
                F.col(bucket)["minus"].alias("minus"),
                F.lit(i).alias("place"),
                F.col(bucket)["seq"].alias("seq"),
                F.lit(bucket).alias("bucket"),
            ),
        )
        for i, bucket in enumerate(R.BUCKETS)
    ]
    state = state.withColumn("_best", F.array_min(F.array_compact(F.array(*options))))
    used = F.count("picked").over(Window.partitionBy())
    backfill = Window.partitionBy().orderBy(
        F.when(F.col("picked").isNull(), 0).otherwise(1), F.col("_best.minus"), F.col("_best.seq")
    )
    state = state.withColumns({"_used": used, "_turn": F.row_number().over(backfill)})
    chosen = state.filter(F.col("picked").isNotNull() | (F.col("_used") + F.col("_turn") <= max_cases))
    place = F.coalesce(*[F.when(F.col("picked") == bucket, F.col(bucket)) for bucket in R.BUCKETS])
    return chosen.select(
        "case_key",
        F.coalesce("picked", "_best.bucket").alias("bucket"),
        (-F.coalesce(place["minus"], F.col("_best.minus"))).alias("score"),
        F.coalesce(place["seq"], F.col("_best.seq")).alias("seq"),
    )


def review_set(assessed: DataFrame, max_cases: int = R.DEFAULT_MAX_CASES, seq: str = "seq") -> DataFrame:
    """The selected review records with bucket and score.

    The selection is joined back by its measured size.
    """
    # Scored once, read twice: narrow columns for the ranking, then the chosen records.
    assessed = written_once(assessed)
    chosen = select_cases(candidates(assessed, max_cases, seq), max_cases)
    picked = chosen.select(F.col("seq").alias("_seq"), F.col("bucket").alias("_bucket"), F.col("score").alias("_score"))
    joined = records(assessed, keep=[seq]).join(picked, F.col(seq) == F.col("_seq"))
    return joined.withColumns({
        "priority_bucket": F.col("_bucket"),
        "priority_score": F.bround("_score", 4),
    }).select(*R.REVIEW_COLUMNS)


def bucket_counts(selected: DataFrame) -> DataFrame:
    """Selected cases per bucket."""
    return selected.groupBy("priority_bucket").agg(F.count(F.lit(1)).alias("cases"))
