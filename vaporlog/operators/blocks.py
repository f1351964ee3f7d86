"""Nerve-block site terms and standalone routing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.matching import (
    FLAGS,
    Text,
    contains_any,
    first_value,
    folded,
    literal,
    matches_any,
)
from vaporlog.functions.text import clean_text, strip
from vaporlog.rules import blocks as B


def _found_terms(text: Text, sites: dict) -> str:
    """The terms that are found, joined; empty without any."""
    terms = [f"CASE WHEN {matches_any(text, patterns)} THEN {literal(term)} END" for term, patterns in sites.items()]
    return f"concat_ws('; ', {', '.join(terms)})"


def normalize_blocks(df: DataFrame) -> DataFrame:
    """Add ``nerve_block_type`` and ``unmatched_block_source``.

    Reads ``raw_nerve_block_type``, ``final_anesthesia_type`` and ``procedure_notes``;
    notes count only when a primary block text exists.
    """
    notes = F.when(F.col("_primary") != "", clean_text(F.col("procedure_notes"))).otherwise(F.lit(""))
    parts = [F.nullif(F.col(part), F.lit("")) for part in ("_primary", "_technique", "_notes")]
    text = Text("_site_text", "_site_folded")

    def levels(pattern: str, group: int) -> str:
        return f"regexp_extract_all({text.raw}, {literal(FLAGS + pattern)}, {group})"

    every_level = ", ".join(
        (levels(B.THORACIC_RANGE, 1), levels(B.THORACIC_RANGE, 2), levels(B.THORACIC_LEVEL, 1))
    )
    # Most rows name no thoracic level: skip the level search for them.
    level_numbers = first_value(
        (matches_any(text, (B.THORACIC_LEVEL,)), f"transform(concat({every_level}), v -> CAST(v AS INT))"),
        otherwise="CAST(array() AS ARRAY<INT>)",
    )
    last_high = B.THORACIC_HIGH_LAST_LEVEL
    staged = (
        df.withColumns({
            "_primary": clean_text(F.col("raw_nerve_block_type")),
            "_technique": clean_text(F.col("final_anesthesia_type")),
        })
        .withColumn("_notes", notes)
        .withColumn("_site_text", F.concat_ws(" ", *parts))
        .withColumn("_site_folded", F.expr(folded("_site_text")))
        .withColumn("_levels", F.expr(level_numbers))
        .withColumns({
            "_sites": F.expr(_found_terms(text, B.PERIPHERAL_SITES)),
            "_axial": F.expr(_found_terms(text, B.NEURAXIAL_SITES)),
            "_high": F.expr(f"exists(_levels, v -> v <= {last_high}) OR {matches_any(text, B.THORACIC_UPPER)}"),
            "_low": F.expr(f"exists(_levels, v -> v > {last_high}) OR {matches_any(text, B.THORACIC_LOWER)}"),
            "_thoracic": F.expr(matches_any(text, B.THORACIC_GENERIC)),
        })
    )
    bands = (
        f"CASE WHEN _high OR (_thoracic AND NOT _low) THEN {literal(B.THORACIC_HIGH)} END, "
        f"CASE WHEN _low OR (_thoracic AND NOT _high) THEN {literal(B.THORACIC_LOW)} END"
    )
    generic = f"_sites = '' AND {matches_any(text, B.PERIPHERAL_CONTEXT)}"
    lumbar = f"_axial = '' AND {matches_any(text, B.LUMBAR_CONTEXT)}"
    staged = staged.withColumn("_axial", F.expr(f"concat_ws('; ', nullif(_axial, ''), {bands})")).withColumns({
        "_generic": F.expr(generic),
        "_axial": F.expr(first_value((lumbar, "'Lumbar'"), otherwise="_axial")),
    })
    sites = first_value(("_generic", literal(B.OTHER_PERIPHERAL)), otherwise="nullif(_sites, '')")
    named = staged.withColumn("_terms", F.expr(f"concat_ws('; ', {sites}, nullif(_axial, ''))")).withColumn(
        "nerve_block_type", F.expr("CASE WHEN _terms <> '' THEN _terms ELSE nullif(_primary, '') END")
    )
    normalized = F.filter(F.transform(F.split("nerve_block_type", ";"), strip), lambda t: t != "")
    canonical = [*B.PERIPHERAL_SITES, *B.NEURAXIAL_TERMS]
    known = F.coalesce(
        (F.size(normalized) > 0) & F.forall(normalized, lambda term: term.isin(*canonical)), F.lit(False)
    )
    # All terms that can be found are canonical but the generic one; the block text is split only where it stays as it is.
    keep_raw = F.col("_generic") | ((F.col("_terms") == "") & ~known)
    return named.withColumn("unmatched_block_source", F.when(keep_raw, F.col("raw_nerve_block_type"))).drop(
        "_primary", "_technique", "_notes", "_site_text", "_site_folded", "_levels", "_sites", "_axial", "_high", "_low",
        "_thoracic", "_generic", "_terms",
    )


def route_standalone(cases: DataFrame) -> DataFrame:
    """Add ``route``: 'block' or 'neuraxial' (also the default) for standalone procedures."""
    searched = ("raw_anesthesia_type", "raw_nerve_block_type", "unmatched_block_source",
                "procedure", "procedure_notes", "nerve_block_type")
    text = f"upper(concat_ws(' ', {', '.join(searched)}))"
    terms = F.transform(F.split("nerve_block_type", ";"), strip)
    is_block = F.coalesce(
        F.exists(terms, lambda term: term.isin(*B.PERIPHERAL_TERMS)), F.lit(False)
    ) | F.expr(contains_any(text, B.BLOCK_HINTS))
    return cases.withColumn("route", F.when(is_block, F.lit("block")).otherwise(F.lit("neuraxial")))
