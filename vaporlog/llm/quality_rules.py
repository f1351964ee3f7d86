"""Quality rules with verdicts for whole hosts (DataFrame functions only).

Every document gets the base measures. Failures of each rule are counted by host, the rates are
shrunk towards the corpus with a beta prior fitted to the hosts by moments, and a host whose
shrunk rate exceeds the threshold for any rule is rejected with all its documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.llm.common import apart, sized, staged, text_of

SPACE_RUN = r"[ \t\n\x0B\f\r]+"
#: A document fails a rule where its condition holds.
RULES = {
    "base": "base_failed",
    "symbols": "2 * n_symbols > n_words",
    "word_length": "word_chars < 2 * n_words OR word_chars > 15 * n_words",
    "lines": "2 * n_dup_lines > n_lines",
}
#: A host is rejected when the shrunk rate of a rule's failures is above this.
HOST_THRESHOLD = 0.5
#: The prior weighs as much as this many documents at the most.
PRIOR_WEIGHT = 1000.0


def measures(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Base measures of whole texts; null text has no words. Keeps a hash of the text to find the row again."""
    frame = docs.select(
        docs[id_column].alias("doc_id"), docs[host_column].cast("string").alias("host"), text_of(docs, text_column).alias("t")
    )
    frame = frame.withColumns({
        "w": F.array_remove(F.split("t", SPACE_RUN), ""),
        "lines": F.filter(F.split("t", "\n"), lambda line: line.rlike(r"[^ \t\x0B\f\r]")),
    })
    frame = frame.withColumns({
        "n_words": F.size("w").cast("long"),
        "word_chars": F.length(F.translate("t", " \t\n\u000b\f\r", "")).cast("long"),
        "n_symbols": (F.length("t") - F.length(F.translate("t", "#*$%&|<>", ""))).cast("long"),
        "n_lines": F.size("lines").cast("long"),
        "n_dup_lines": (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"),
        "text_hash": F.xxhash64("t"),
        # one number per window of three words; the last two positions have no whole window
        "h": F.expr("slice(transform(w, (x, i) -> xxhash64(x, get(w, i + 1), get(w, i + 2))), 1, greatest(size(w) - 2, 0))"),
    })
    frame = frame.withColumn("repeats", F.size(F.array_distinct("h")) < F.size("h"))
    frame = frame.withColumn(
        "s", F.expr("CASE WHEN repeats THEN sort_array(transform(h, (x, i) -> struct(x AS v, i AS i))) END")
    )
    frame = frame.withColumn(
        "p",
        F.expr("transform(filter(s, (x, i) -> get(s, i - 1).v = x.v OR get(s, i + 1).v = x.v), x -> x.i)"),
    )
    frame = frame.withColumn(
        "n_repeat_words",
        F.expr(
            "CASE WHEN repeats THEN size(array_distinct(concat(p, transform(p, x -> x + 1), transform(p, x -> x + 2)))) ELSE 0 END"
        ).cast("long"),
    )
    return frame.select(
        "doc_id", "host", "text_hash", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words",
        F.expr("n_words < 50 OR 100 * n_repeat_words > 50 * n_words").alias("base_failed"),
    )


def host_verdicts(measured: DataFrame, threshold: float = HOST_THRESHOLD) -> DataFrame:
    """One row per host: number of documents, shrunk failure rate per rule, and whether it is rejected.

    Documents without a host share one, the null host.
    """
    failed = {name: F.sum(F.expr(f"CAST({rule} AS LONG)")).alias(f"f_{name}") for name, rule in RULES.items()}
    hosts = measured.groupBy("host").agg(F.count(F.lit(1)).alias("n"), *failed.values())
    moments = []
    for name in RULES:
        rate = F.col(f"f_{name}") / F.col("n")
        moments += [F.avg(rate).alias(f"m_{name}"), F.var_pop(rate).alias(f"v_{name}")]
    prior = hosts.agg(*moments).first()
    rates = []
    for name in RULES:
        mean, var = prior[f"m_{name}"] or 0.0, prior[f"v_{name}"] or 0.0
        weight = PRIOR_WEIGHT if var <= 0 else min(PRIOR_WEIGHT, max(1.0, mean * (1 - mean) / var - 1))
        rates.append(((F.col(f"f_{name}") + mean * weight) / (F.col("n") + weight)).alias(f"rate_{name}"))
    shrunk = hosts.select("host", "n", *rates)
    return shrunk.withColumn("host_rejected", F.greatest(*[F.col(f"rate_{name}") for name in RULES]) > threshold)


def judge(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """Measures and verdict of every document; one row per input row.

    kept is false for a failed base rule and for every document of a rejected host. Texts that
    are null or empty have no words, and so fail. Repeated rows are judged and counted each;
    other columns are ignored; an empty table gives no rows.
    """
    measured = staged(measures(docs, id_column, text_column, host_column), "measures")
    verdicts = host_verdicts(measured).select(F.col("host").alias("h"), "host_rejected")
    return measured.join(verdicts, F.col("host").eqNullSafe(F.col("h"))).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~F.col("host_rejected")).alias("kept"), "text_hash",
    )


def keep_good(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", host_column: str = "source") -> DataFrame:
    """The documents that are kept, with all their columns, whatever these are called.

    See `judge`: null and empty texts go, repeated rows stay or go together, null ids are rows like others. An
    empty table stays empty.
    """
    rejected = judge(docs, id_column, text_column, host_column).filter("NOT kept").select("doc_id", "text_hash")
    rejected, (gone, mark) = apart(staged(rejected.distinct(), "rejected"), docs)
    match = docs[id_column].eqNullSafe(F.col(gone)) & (F.xxhash64(text_of(docs, text_column)) == F.col(mark))
    return docs.join(sized(rejected), match, "left_anti")


_W = "[^\\x20\\x09-\\x0D]+"
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT r, regexp_extract_all(t, '{_W}') AS w FROM d
), lines AS (
  SELECT r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS lines FROM d
), wins AS (
  SELECT r, unnest(range(1, len(w) - 1)) AS i, w FROM w WHERE len(w) >= 3
), keyed AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM wins
), again AS (
  SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM keyed
), covered AS (
  SELECT DISTINCT r, i + j AS p FROM again, (SELECT unnest([0, 1, 2]) AS j) WHERE c > 1
), reps AS (
  SELECT r, count(*) AS n_repeat_words FROM covered GROUP BY r
), m AS (
  SELECT d.r, doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
         CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) AS BIGINT) AS n_lines,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words
  FROM d JOIN w USING (r) JOIN lines USING (r) LEFT JOIN reps USING (r)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m
), h AS (
  SELECT source, count(*) AS n,
         sum(CAST(base_failed AS INT)) AS f1, sum(CAST(2 * n_symbols > n_words AS INT)) AS f2,
         sum(CAST(word_chars < 2 * n_words OR word_chars > 15 * n_words AS INT)) AS f3,
         sum(CAST(2 * n_dup_lines > n_lines AS INT)) AS f4
  FROM b GROUP BY source
), rates AS (
  SELECT source, n, unnest([f1, f2, f3, f4]) AS f, unnest([1, 2, 3, 4]) AS k FROM h
), prior AS (
  SELECT k, avg(f / n) AS m, var_pop(f / n) AS v FROM rates GROUP BY k
), weighted AS (
  SELECT k, m, CASE WHEN v <= 0 THEN 1000.0 ELSE least(1000.0, greatest(1.0, m * (1 - m) / v - 1)) END AS p FROM prior
), verdict AS (
  SELECT source, max((f + m * p) / (n + p)) > 0.5 AS rejected FROM rates JOIN weighted USING (k) GROUP BY source
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT rejected AS kept
FROM b JOIN verdict v ON b.source IS NOT DISTINCT FROM v.source
"""
