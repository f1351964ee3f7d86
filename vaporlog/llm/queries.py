"""One query per operator over its whole table, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vaporlog.llm import (
    bpe,
    exact_dedup,
    html_text,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    quality_rules,
    source_divergence,
    token_alignment,
    token_files,
    toxicity,
    warc,
)
from vaporlog.llm.common import table


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents that repeat an earlier line or a near copy of one."""
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents")).drop("text_hash")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("text_hash")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents."""
    return quality_rules.judge(table(spark, sf_dir, "documents")).drop("text_hash")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of equal documents."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces in sequences of at most 1024 tokens."""
    return packing.pack_documents(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back."""
    return warc.archive_round_trip(table(spark, sf_dir, "pages"))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents that share at least 85 of 100 four-word shingles."""
    return ngram_join.similar_components(table(spark, sf_dir, "documents"))


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded."""
    return bpe.round_trip(table(spark, sf_dir, "documents"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License texts and notices in all documents."""
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op10_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_text.extract(table(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of all documents written to coded files and read back."""
    return token_files.token_digests(token_files.token_file_round_trip(table(spark, sf_dir, "documents")))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of all documents against each other and against their language."""
    return source_divergence.source_divergence(table(spark, sf_dir, "documents"))


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents by two tokenizers, aligned and counted."""
    return token_alignment.alignment_summary(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    function.__name__: function
    for function in (
        op1_line_dedup, op2_toxicity, op3_quality_rules, op4_exact_dedup, op5_best_fit_packing, op6_warc, op7_ngram_join,
        op8_bpe, op9_license_scan, op10_html_text, op11_token_files,
        op12_source_divergence, op13_token_alignment,
    )
}

ORACLE = {
    "op3_quality_rules": quality_rules.SQL,
    "op4_exact_dedup": exact_dedup.SQL,
    "op6_warc": warc.SQL,
    "op7_ngram_join": ngram_join.SQL,
    "op12_source_divergence": source_divergence.SQL,
}
