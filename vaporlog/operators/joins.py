"""Cases, their primary technique, and procedures without a case."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.matching import first_value, literal
from vaporlog.functions.text import join_distinct
from vaporlog.rules import schema as S

KEYS = ("pair_key", "MPOG_Case_ID")


def technique_rank(name: str) -> Column:
    """Invasiveness of a procedure name; unknown names rank 0."""
    ranks = [(f"{name} = {literal(technique)}", str(rank)) for technique, rank in S.TECHNIQUE_RANK.items()]
    return F.expr(first_value(*ranks, otherwise="0"))


def _text_or_null(df: DataFrame, name: str) -> Column:
    return F.col(name) if name in df.columns else F.lit(None).cast("string")


def primary_techniques(procedures: DataFrame, keys=KEYS, seq: str = "_seq") -> DataFrame:
    """The most invasive named procedure per case; ties go to the first input row.

    An aggregate, not a window: each task keeps one candidate per case before the shuffle,
    so a case (or a null id) with a great many procedures is no hot spot.
    """
    name = F.col("ProcedureName")
    ranked = procedures.filter(name.isNotNull()).select(
        *keys,
        F.struct(-technique_rank("ProcedureName"), F.col(seq)).alias("_order"),
        F.struct(
            name.alias("name"),
            _text_or_null(procedures, "Comment").alias("comment"),
            _text_or_null(procedures, "Details").alias("details"),
        ).alias("_best"),
    )
    best = ranked.groupBy(*keys).agg(F.min_by("_best", "_order").alias("_best"))
    detailed = technique_rank("_best.name") >= S.DETAIL_MIN_RANK
    return best.select(
        *keys,
        F.col("_best.name").alias("Airway_Type"),
        F.when(detailed, join_distinct(F.col("_best.comment"), F.col("_best.details"))).alias("Airway_Details"),
    )


def _same(left: DataFrame, right: DataFrame, keys) -> list[Column]:
    """Equality in which a null id equals a null id; still a hash or merge join."""
    return [left[key].eqNullSafe(right[key]) for key in keys]


def join_techniques(cases: DataFrame, procedures: DataFrame, keys=KEYS, seq: str = "_seq") -> DataFrame:
    """Every case with its primary technique; null when it has no named procedure."""
    primary = primary_techniques(procedures, keys, seq)
    joined = cases.join(primary, _same(cases, primary, keys), "left")
    return joined.select(*[cases[name] for name in cases.columns], "Airway_Type", "Airway_Details")


def _ids(cases: DataFrame, keys) -> DataFrame:
    """Keys of the cases, to be held in a hash table by task.

    A merge join would sort the procedures with all their texts; well compressed in the exchange, those of a task are
    many times its memory and go to disk. The keys are few and narrow, and each is kept once.
    """
    return cases.select(*keys).hint("shuffle_hash")


def orphan_procedures(cases: DataFrame, procedures: DataFrame, keys=KEYS) -> DataFrame:
    """Procedures whose case is not in the case list of the same pair."""
    ids = _ids(cases, keys)
    return procedures.join(ids, _same(procedures, ids, keys), "left_anti")


def matched_procedures(cases: DataFrame, procedures: DataFrame, keys=KEYS) -> DataFrame:
    """Procedures whose case is in the case list of the same pair."""
    ids = _ids(cases, keys)
    return procedures.join(ids, _same(procedures, ids, keys), "left_semi")


def roster_candidates(roster: DataFrame, name: str = "name") -> DataFrame:
    """Add ``candidates``: the keys to try for a name, in order."""
    raw = F.col(name)
    plain = F.trim(F.regexp_replace(raw, r"\s*\([^)]+\)", ""))
    plain = F.trim(F.regexp_replace(plain, r'\s*"[^"]+"\s*', " "))
    words = F.split(plain, r"\s+")
    last = F.element_at(words, -1)
    inside = F.regexp_extract(raw, r"\(([^)]+)\)", 1)
    return roster.withColumn(
        "candidates",
        F.array_compact(
            F.array(
                plain,
                F.when(F.size(words) >= 3, F.concat_ws(" ", F.get(words, F.lit(0)), last)),
                F.when(inside != "", F.concat_ws(" ", inside, last)),
            )
        ),
    )


def match_roster(roster: DataFrame, available: DataFrame, name: str = "name", stem: str = "stem") -> DataFrame:
    """First candidate of each name found among the available stems, ignoring case.

    ``matched_stem`` is null for names without a match; ``candidates`` shows what was tried.
    """
    tried = roster_candidates(roster.select(name).filter(F.col(name).isNotNull()).distinct(), name)
    keys = tried.select(name, F.posexplode("candidates").alias("position", "candidate"))
    keys = keys.withColumn("_key", F.lower("candidate"))
    stems = available.groupBy(F.lower(stem).alias("_key")).agg(F.max(stem).alias("matched_stem"))
    # Left join on the candidates keeps names without a match; one row per name is left.
    best = (
        keys.join(stems, "_key", "left")
        .groupBy(name)
        .agg(
            F.min_by("matched_stem", F.when(F.col("matched_stem").isNotNull(), F.col("position"))).alias(
                "matched_stem"
            ),
            F.array_join(
                F.transform(F.array_sort(F.collect_list(F.struct("position", "candidate"))), lambda s: s["candidate"]),
                "; ",
            ).alias("tried"),
        )
    )
    return best
