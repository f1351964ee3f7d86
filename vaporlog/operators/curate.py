"""Training tables: preparation, sampling, splits and override merges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporlog.functions.matching import contains_any
from vaporlog.functions.ranking import bin_sizes, with_chosen
from vaporlog.functions.staging import written_once
from vaporlog.functions.text import clean_text, procedure_key, sha_long, split_lines, strip
from vaporlog.operators.categorize import categorize
from vaporlog.rules import procedures as P
from vaporlog.rules import schema as S
from vaporlog.rules import training as T


#: Keys that hold more than one row in this many are joined apart from the others.
FREQUENT_KEYS = 1000


def normalize_label(label: Column) -> Column:
    """A category label in canonical form; null means the 'other' category."""
    text = strip(label)
    member = F.substring(text, len(P.LABEL_NAME_PREFIX) + 1, 1 << 30)
    names = F.create_map(*[F.lit(part) for pair in P.CATEGORY_BY_NAME.items() for part in pair])
    named = F.try_element_at(names, member)
    symbolic = F.when(text.startswith(P.LABEL_NAME_PREFIX), named)
    return F.when(label.isNull(), F.lit(P.OTHER)).otherwise(F.coalesce(symbolic, text))


def optional_label(label: Column) -> Column:
    """A ground-truth label, or the empty text when it is missing."""
    text = strip(label)
    known = label.isNotNull() & ~F.lower(text).isin(*S.LABEL_MISSING)
    return F.when(known, normalize_label(label)).otherwise(F.lit(""))


def prepare(rows: DataFrame) -> DataFrame:
    """Rule-categorized training rows; rows without a procedure text are dropped.

    Reads ``procedure`` and ``service_text``; other columns pass through.
    """
    kept = rows.filter(F.col("procedure").isNotNull() & ~F.col("procedure").isin("", "nan"))
    kept = kept.withColumn("service_text", clean_text(F.col("service_text")))
    ruled = categorize(kept.withColumn("services", split_lines(F.col("service_text"))))
    return ruled.withColumn("warnings", F.array_join("rule_warnings", "; ")).drop("services", "rule_warnings")


def order_hash(df: DataFrame, key: str, seed: int = T.SEED) -> DataFrame:
    """Add ``_hash``: a stable random order of the rows."""
    return df.withColumn("_hash", sha_long(F.concat_ws("|", F.col(key).cast("string"), F.lit(str(seed)))))


def sample_per_file(rows: DataFrame, n: int, key: str = "seq", file: str = "file", seed: int = T.SEED) -> DataFrame:
    """At most ``n`` random rows of each file."""
    ordered = written_once(order_hash(rows, key, seed))
    sizes = bin_sizes(ordered, [file], "_hash").withColumn("_limit", F.lit(n))
    return with_chosen(ordered, sizes, [file], "_hash", key).filter("chosen").drop("_hash", "chosen")


def value_tiers(prepared: DataFrame) -> DataFrame:
    """Add ``tier``: high, medium or low training value."""
    score = (
        F.when(F.col("warnings") != "", 5).otherwise(0)
        + F.when(F.col("rule_category") != P.OTHER, 3).otherwise(0)
        + F.when(F.expr(contains_any("upper(procedure)", T.HIGH_VALUE_WORDS)), 2).otherwise(0)
    )
    return prepared.withColumn("tier", F.when(score >= 7, "high").when(score >= 3, "medium").otherwise("low"))


def sample_by_value(prepared: DataFrame, size: int = T.TOTAL_SAMPLE, key: str = "seq", seed: int = T.SEED) -> DataFrame:
    """A sample of at most ``size`` rows: half high, 30 % medium value, the rest low.

    Quotas that a tier cannot fill go down to the low tier only.
    """
    tiered = written_once(order_hash(value_tiers(prepared), key, seed))
    high, medium = int(size * T.HIGH_SHARE), int(size * T.MEDIUM_SHARE)
    # Three tiers of at most 4096 bins: the rest works on a few thousand rows.
    sizes = bin_sizes(tiered, ["tier"], "_hash")
    every = Window.partitionBy()

    def filled(tier: str, quota: int) -> Column:
        rows = F.coalesce(F.sum(F.when(F.col("tier") == tier, F.col("_n"))).over(every), F.lit(0))
        return F.least(rows, F.lit(quota))

    quota = (
        F.when(F.col("tier") == "high", F.lit(high))
        .when(F.col("tier") == "medium", F.lit(medium))
        .otherwise(F.lit(size) - filled("high", high) - filled("medium", medium))
    )
    sizes = sizes.withColumn("_limit", quota)
    return with_chosen(tiered, sizes, ["tier"], "_hash", key).filter("chosen").drop("_hash", "chosen")


def split_seen_unseen(prepared: DataFrame, ratio: float = 0.2, label: str = "rule_category", key: str = "seq",
                      seed: int = T.SEED) -> DataFrame:
    """Add ``part``: 'seen' or 'unseen', stratified by label where every class allows it.

    Stratified means each class has two rows or more and both parts can hold every class.
    Class quotas are rounded by largest remainder so that the parts have their exact sizes. The rows are written
    once as they come, so what computes them runs once; both passes read that table and move none of its whole rows.
    """
    if not 0.0 < ratio < 1.0:
        raise ValueError(f"unseen ratio must be between 0 and 1, got {ratio}")
    labeled = written_once(order_hash(prepared.withColumn(label, normalize_label(F.col(label))), key, seed))
    # At most 4096 bins per class; the quotas work on these sizes.
    sizes = bin_sizes(labeled, [label], "_hash")
    every = Window.partitionBy()
    quotas = sizes.groupBy(label).agg(F.sum("_n").alias("_rows")).withColumns({
        "_total": F.sum("_rows").over(every),
        "_classes": F.count(F.lit(1)).over(every),
        "_smallest": F.min("_rows").over(every),
    })
    whole = F.floor(F.col("_total") * F.lit(ratio)).cast("long")
    quotas = quotas.withColumns({
        "_test": F.ceil(F.col("_total") * F.lit(ratio)).cast("long"),
        "_stratify": (F.col("_smallest") >= 2)
        & (whole >= F.col("_classes"))
        & ((F.col("_total") - whole) >= F.col("_classes")),
    }).withColumn("_exact", F.col("_rows") * F.col("_test") / F.col("_total"))
    quotas = quotas.withColumn("_base", F.floor("_exact").cast("long"))
    by_rest = every.orderBy(F.desc(F.col("_exact") - F.col("_base")), label)
    left = F.col("_test") - F.sum("_base").over(every)
    quotas = quotas.withColumn("_left", left).withColumn(
        "_quota", F.col("_base") + F.when(F.row_number().over(by_rest) <= F.col("_left"), 1).otherwise(0)
    )
    # One stratum per class, or one for all rows where the classes are too small.
    quotas = quotas.select(
        label,
        F.when(F.col("_stratify"), F.col(label)).otherwise(F.lit("")).alias("_stratum"),
        F.when(F.col("_stratify"), F.col("_quota")).otherwise(F.col("_test")).alias("_limit"),
    )
    quotas = written_once(quotas)
    per_stratum = sizes.join(quotas, label).groupBy("_stratum", "_bin").agg(F.sum("_n").alias("_n"), F.first("_limit").alias("_limit"))
    strata = quotas.select(label, "_stratum")
    chosen = with_chosen(labeled.join(strata, label), per_stratum, ["_stratum"], "_hash", key)
    return chosen.withColumn("part", F.when(F.col("chosen"), "unseen").otherwise("seen")).select(*prepared.columns, "part")


def category_distribution(rows: DataFrame, label: str = "rule_category") -> DataFrame:
    """Rows and percentage per category."""
    counts = rows.groupBy(label).agg(F.count(F.lit(1)).alias("rows"))
    # One row per category: the window is small.
    total = F.sum("rows").over(Window.partitionBy())
    return counts.select(label, "rows", F.bround(F.col("rows") * 100.0 / total, 1).alias("percent"))


def file_stats(rows: DataFrame, file: str = "file") -> DataFrame:
    """Rows and usable rows of each file."""
    usable = F.col("procedure").isNotNull() & ~F.col("procedure").isin("", "nan")
    return rows.groupBy(file).agg(
        F.count(F.lit(1)).alias("total_rows"), F.count_if(usable).alias("valid_cases"),
        F.count_if(~usable).alias("dropped_rows"),
    )


def keep_last(rows: DataFrame, key: str, seq: str = "seq") -> DataFrame:
    """The last row of each key; a map-side aggregate, so frequent keys are no hot spot."""
    others = [name for name in rows.columns if name != key]
    best = rows.groupBy(key).agg(F.max_by(F.struct(*others), seq).alias("_row"))
    return best.select(key, "_row.*").select(*rows.columns)


def override_map(review_labels: DataFrame, seq: str = "seq") -> DataFrame:
    """Latest human category per procedure key."""
    keyed = review_labels.select(
        procedure_key(F.col("procedure")).alias("procedure_key"),
        normalize_label(F.col("human_category")).alias("override"),
        F.col(seq),
    )
    return keep_last(keyed.filter(F.col("procedure_key") != ""), "procedure_key", seq).drop(seq)


def _keyed(rows: DataFrame, label: str) -> DataFrame:
    return rows.withColumns({
        label: normalize_label(F.col(label)),
        "procedure_key": procedure_key(F.col("procedure")),
    })


def apply_overrides(rows: DataFrame, overrides: DataFrame, label: str = "rule_category") -> DataFrame:
    """Replace labels by their override; adds ``procedure_key``, ``overridden`` and ``corrected``.

    The override table grows with the reviews: Spark broadcasts it only when it measures small, and joins by
    shuffle otherwise. Then no key may be a hot spot: keys with more than one row in FREQUENT_KEYS are that many at
    the most, so their overrides are broadcast; their rows, and those with a blank key, which no override has, go
    to the shuffle join under keys of their own that match nothing and spread evenly.
    """
    keyed = written_once(_keyed(rows, label))
    counts = keyed.filter("procedure_key <> ''").groupBy("procedure_key").agg(F.count(F.lit(1)).alias("_n"))
    total = F.lit(keyed.count())
    frequent = counts.filter(F.col("_n") * FREQUENT_KEYS > total).join(overrides, "procedure_key", "left")
    frequent = F.broadcast(frequent.select(F.col("procedure_key").alias("_hot"), F.col("override").alias("_given")))
    marked = keyed.join(frequent, F.col("procedure_key") == F.col("_hot"), "left")
    alone = F.col("_hot").isNotNull() | (F.coalesce("procedure_key", F.lit("")) == "")
    spread = F.concat(F.lit("\u0000"), F.pmod(F.xxhash64(*rows.columns), F.lit(FREQUENT_KEYS)))
    marked = marked.withColumn("_key", F.when(alone, spread).otherwise(F.col("procedure_key")))
    known = overrides.select(F.col("procedure_key").alias("_of"), "override")
    joined = marked.join(known, F.col("_key") == F.col("_of"), "left").withColumn("override", F.coalesce("_given", "override"))
    has = F.col("override").isNotNull()
    return joined.withColumns({
        "overridden": has,
        "corrected": has & (F.col(label) != F.col("override")),
        label: F.coalesce("override", label),
    }).select(*rows.columns, "procedure_key", "overridden", "corrected")


def _is_seen() -> Column:
    return F.col("part") == "seen"


def _merge_order(seq: str) -> Column:
    """Promoted rows come after all seen rows."""
    return F.struct((~_is_seen()).alias("promoted"), F.col(seq))


def label_parts(seen: DataFrame, unseen: DataFrame) -> DataFrame:
    """Seen and unseen rows as one table with a ``part`` column."""
    return seen.withColumn("part", F.lit("seen")).unionByName(unseen.withColumn("part", F.lit("unseen")))


def merge_overrides(rows: DataFrame, overrides: DataFrame, label: str = "rule_category",
                    seq: str = "seq") -> tuple[DataFrame, DataFrame]:
    """Retrain table and remaining evaluation table from rows with a ``part``.

    Reviewed unseen rows join the seen rows, the last row per procedure key stays, and
    corrected rows are repeated (three times in total). Overrides meet one row per key: the
    last of all rows (what stays if the key is reviewed) and the last seen one (if it is not).
    Only the unseen rows that remain are matched row by row.
    """
    keyed = _keyed(rows, label)
    row = F.struct(*rows.columns)
    per_key = keyed.groupBy("procedure_key").agg(
        F.max_by(row, _merge_order(seq)).alias("_any"),
        F.max_by(F.when(_is_seen(), row), F.when(_is_seen(), F.col(seq))).alias("_seen"),
    )
    joined = per_key.join(overrides, "procedure_key", "left")
    has = F.col("override").isNotNull()
    merged = joined.select(
        "procedure_key", "override", has.alias("overridden"), F.when(has, F.col("_any")).otherwise(F.col("_seen")).alias("_row"),
    ).filter("_row IS NOT NULL").select("procedure_key", "override", "overridden", "_row.*")
    merged = merged.withColumns({
        "corrected": F.col("overridden") & (F.col(label) != F.col("override")),
        label: F.coalesce("override", label),
    }).select(*rows.columns, "procedure_key", "overridden", "corrected")
    copies = F.when(F.col("corrected"), T.CORRECTION_MULTIPLIER).otherwise(1)
    retrain = merged.withColumn("copy", F.explode(F.sequence(F.lit(1), copies)))
    remaining = keyed.filter(~_is_seen()).join(overrides, "procedure_key", "left_anti").select(*rows.columns)
    return retrain, remaining


def merge_summary(rows: DataFrame, overrides: DataFrame, label: str = "rule_category", seq: str = "seq") -> DataFrame:
    """One row of counts describing an override merge, from one pass over the rows; overrides meet one row per key."""
    per_key = _keyed(rows, label).groupBy("procedure_key").agg(
        F.max_by(label, _merge_order(seq)).alias("_last"),
        F.count_if(_is_seen()).alias("_seen"),
        F.count_if(~_is_seen()).alias("_unseen"),
    ).join(overrides, "procedure_key", "left")
    has = F.col("override").isNotNull()
    corrected = F.count_if(has & (F.col("_last") != F.col("override")))
    more = T.CORRECTION_MULTIPLIER - 1

    def total(name: str, where: Column) -> Column:
        return F.sum(F.when(where, F.col(name)).otherwise(0))

    return per_key.agg(
        corrected.alias("corrected_rows_weighted"),
        (corrected * more).alias("rows_added_by_weighting"),
        (F.count_if(has | (F.col("_seen") > 0)) + corrected * more).alias("retrain_rows"),
        total("_seen", has).alias("seen_overrides_applied"),
        total("_unseen", has).alias("unseen_promoted"),
        total("_unseen", ~has).alias("remaining_eval_rows"),
    ).withColumn("override_count", overrides.agg(F.count(F.lit(1))).scalar())
