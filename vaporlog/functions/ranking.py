"""Exact ranks and top-k lists that do not put a hot group into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaporlog.functions.staging import written_once

SALTS = 64
BIN_BITS = 12


def top_per_group(df: DataFrame, groups: list[str], order: list[Column], k, salt: Column) -> DataFrame:
    """The first ``k`` rows of each group.

    ``k`` is a number or a column that is constant in a group. Rows are first cut to k
    per (group, salt), so the final window sees at most SALTS * k rows of a group
    however large the group is. Spark also limits each input partition beforehand.
    """
    limit = k if isinstance(k, Column) else F.lit(k)
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(salt), F.lit(SALTS)))
    partial = Window.partitionBy(*groups, "_salt").orderBy(*order)
    final = Window.partitionBy(*groups).orderBy(*order)
    cut = salted.withColumn("_rn", F.row_number().over(partial)).filter(F.col("_rn") <= limit)
    ranked = cut.drop("_rn", "_salt").withColumn("rank", F.row_number().over(final))
    return ranked.filter(F.col("rank") <= limit)


def bin_sizes(df: DataFrame, groups: list[str], hash_col: str) -> DataFrame:
    """Rows per (group, hash bin): at most 4096 small rows per group."""
    return df.groupBy(*groups, _bin(hash_col).alias("_bin")).agg(F.count(F.lit(1)).alias("_n"))


def _bin(hash_col: str) -> Column:
    return F.shiftright(F.col(hash_col), 32 - BIN_BITS)


def with_chosen(df: DataFrame, sizes: DataFrame, groups: list[str], hash_col: str, key: str) -> DataFrame:
    """Add ``chosen``: whether a row is among the first ``_limit`` of its group by a 32-bit hash, then key.

    ``df`` should be a written table: limits are found on its groups, hash and key, and its whole rows are then read once,
    where they lie, and compared with the limit.
    ``sizes`` has the groups, ``_bin``, ``_n`` (rows) and ``_limit``, the same in a group. Running totals of the 4096 bins of a group
    tell the one bin that holds the limit; only its rows are numbered, and give the last row that is in. The result is one
    small row per group that Spark measures and broadcasts, or joins by shuffle where there are very many groups.
    """
    narrow = df.select(*groups, hash_col, key)
    before = Window.partitionBy(*groups).orderBy("_bin").rowsBetween(Window.unboundedPreceding, -1)
    totals = written_once(sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))))
    edges = totals.filter("_before < _limit AND _limit <= _before + _n")
    renamed = edges.select(*[F.col(g).alias(f"_edge_{g}") for g in groups], F.col("_bin").alias("_edge"), (F.col("_limit") - F.col("_before")).alias("_rest"))
    same = [narrow[g].eqNullSafe(renamed[f"_edge_{g}"]) for g in groups]
    inside = Window.partitionBy(*groups).orderBy(hash_col, key)
    at_edge = narrow.join(renamed, [*same, _bin(hash_col) == F.col("_edge")]).withColumn("_rank", F.row_number().over(inside))
    cuts = at_edge.filter("_rank = _rest").select(*[F.col(g).alias(f"_cut_{g}") for g in groups], F.struct(hash_col, key).alias("_cut"))
    whole = totals.groupBy(*groups).agg((F.sum("_n") <= F.max("_limit")).alias("_whole"))
    found = whole.join(cuts, [whole[g].eqNullSafe(cuts[f"_cut_{g}"]) for g in groups], "left")
    limits = written_once(found.select(*[F.col(g).alias(f"_of_{g}") for g in groups], "_whole", "_cut"))
    joined = df.join(limits, [df[g].eqNullSafe(limits[f"_of_{g}"]) for g in groups], "left")
    inside_cut = F.coalesce(F.struct(hash_col, key) <= F.col("_cut"), F.lit(False))
    return joined.select(*[df[name] for name in df.columns], (F.col("_whole") | inside_cut).alias("chosen"))
