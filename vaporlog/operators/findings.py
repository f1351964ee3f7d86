"""Airway, vascular-access and monitoring findings with confidence and context."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.matching import (
    FLAGS,
    Text,
    first_value,
    folded,
    literal,
    match_count,
    matches,
    matches_any,
    searched,
)
from vaporlog.functions.staging import compiled_apart, computed_once
from vaporlog.functions.text import WHITESPACE, is_blank
from vaporlog.rules import anesthesia as A
from vaporlog.rules import techniques as T


# Characters that take two places in the positions that a pattern search reports.
_WIDE = r"[\x{10000}-\x{10FFFF}]"


class FindingText(NamedTuple):
    """A text to search, and the column that tells whether it has characters beyond 16 bits."""

    text: Text
    wide: str


def _with_text(df: DataFrame, column: str) -> tuple[DataFrame, FindingText]:
    """The table with a case-folded copy of a text column, and both as a search target."""
    name, wide = f"_folded_{column}", f"_wide_{column}"
    if name not in df.columns:
        df = df.withColumns({name: F.expr(folded(column)), wide: F.expr(f"rlike({column}, {literal(_WIDE)})")})
    return df, FindingText(Text(column, name), wide)


def _with_negations(df: DataFrame, target: FindingText) -> tuple[DataFrame, str]:
    """The table with the number of negation patterns in a text, counted once for all families."""
    name = f"_negations_{target.text.raw}"
    if name not in df.columns:
        df = df.withColumn(name, F.expr(match_count(target.text, T.NEGATION)))
    return df, name


def confidence(support: str | None = None, negations: str | None = None) -> str:
    """0.5, plus support, minus negations, kept within 0 and 1."""
    score = f"{T.BASE_CONFIDENCE}D"
    if support is not None:
        score += f" + least({support} * {T.SUPPORT_STEP}D, {T.SUPPORT_MAX}D)"
    if negations is not None:
        score += f" - {negations} * {T.NEGATION_STEP}D"
    return f"greatest(0.0D, least(1.0D, {score}))"


def first_match(text: Text, patterns) -> str:
    """Place in the list of the first pattern that occurs, from 0; null without any."""
    return first_value(*[(matches(text, p), str(i)) for i, p in enumerate(patterns)])


def _context_of(target: FindingText, pattern: str) -> str:
    """Text around the first occurrence of one pattern.

    The occurrence and what follows it are one search, its position another. Positions count characters beyond 16 bits
    twice: in texts that have some, group 1 is everything before the first occurrence, counted by characters.
    """
    window, text = T.CONTEXT_WINDOW, target.text.raw
    quick = searched(pattern)
    around = literal(f"{FLAGS}^((?s:.*?))((?:{pattern})(?s:.{{0,{window}}}))")
    found = literal(f"{FLAGS}(?:{quick})(?s:.{{0,{window}}})")
    place = f"regexp_instr({text}, {literal(FLAGS + quick)})"
    before = first_value(
        (target.wide, f"right(regexp_extract({text}, {around}, 1), {window})"),
        otherwise=f"right(left({text}, {place} - 1), {window})",
    )
    return f"btrim(concat({before}, regexp_extract({text}, {found}, 0)), {literal(WHITESPACE)})"


def context(target: FindingText, patterns, place: str | None = None) -> str:
    """Context of the first pattern of the list that occurs; ``place`` is a column with its place in the list, if known."""
    return first_value(*[
        (matches(target.text, p) if place is None else f"{place} = {i}", _context_of(target, p)) for i, p in enumerate(patterns)
    ])


# Before the name of a list of findings: their values alone.
VALUES = "_values_"
COUNTED = ("finding_count", "finding_total")
NO_VALUES = "CAST(array() AS ARRAY<STRING>)"


class Finding(NamedTuple):
    """What is found where a condition holds: its value, score and context."""

    found: str
    value: str
    score: str
    snippet: str


def _family(target: FindingText, name: str, patterns, score: str, place: str) -> Finding:
    """A finding of the pattern at ``place``, a column with the list's first match."""
    return Finding(f"{place} IS NOT NULL", literal(name), score, context(target, patterns, place))


def _listed(findings, source: str) -> Column:
    """Array of what was found: values, confidences and contexts."""
    items = []
    for f in findings:
        fields = {"value": f.value, "confidence": f.score, "context": f.snippet, "source_field": literal(source)}
        named = ", ".join(f"'{name}', {field}" for name, field in fields.items())
        items.append(f"CASE WHEN {f.found} THEN named_struct({named}) END")
    return F.expr(f"array_compact(array({', '.join(items)}))")


def _valued(findings) -> Column:
    """Array of the values of what was found."""
    return F.expr("concat(" + ", ".join(f"CASE WHEN {f.found} THEN array({f.value}) ELSE {NO_VALUES} END" for f in findings) + ")")


def _counted(df: DataFrame, findings) -> dict[str, Column]:
    """How many were found until here, and the sum of their scores, added up one by one in the order of the lists."""
    count, total = ("finding_count", "finding_total") if "finding_count" in df.columns else ("0", "0.0D")
    counts = " + ".join([count, *[f"CASE WHEN {f.found} THEN 1 ELSE 0 END" for f in findings]])
    scores = " + ".join([total, *[f"CASE WHEN {f.found} THEN {f.score} ELSE 0.0D END" for f in findings]])
    return {"finding_count": F.expr(counts), "finding_total": F.expr(scores)}


def _with_findings(df: DataFrame, into: str, findings, source: str, *places: str) -> DataFrame:
    """Add findings, and beside them their values alone and their scores added up, without the places they come from.

    All read the same places of matches. A query that wants no contexts has the first column pruned; the others are
    plain expressions, so that Spark compiles them.
    """
    columns = {into: _listed(findings, source), VALUES + into: _valued(findings), **_counted(df, findings)}
    return compiled_apart(computed_once(df).withColumns(columns).drop(*places))


def _airway(df: DataFrame, column: str) -> DataFrame:
    df, target = _with_text(df, column)
    text = target.text
    df, neg = _with_negations(df, target)
    flagged = compiled_apart(df.withColumns({
        "_tube": F.expr(match_count(text, T.INTUBATION)),
        "_dlt": F.expr(first_match(text, T.DOUBLE_LUMEN)),
    }))
    placed = "(_tube > 0 OR _dlt IS NOT NULL)"
    # A laryngoscope is reported only together with a tube.
    scopes = {"_direct": T.DIRECT_LARYNGOSCOPY, "_video": T.VIDEO_LARYNGOSCOPY}
    flagged = flagged.withColumns({
        "_nasal": F.expr(f"{placed} AND {matches_any(text, T.NASAL_ROUTE)}"),
        **{name: F.expr(first_value((placed, first_match(text, patterns)))) for name, patterns in scopes.items()},
    })
    dlt_context = context(target, T.DOUBLE_LUMEN, "_dlt")
    tube_context = first_value(
        ("_tube > 0", context(target, T.INTUBATION)), otherwise=dlt_context
    )
    tube_name = first_value(("_nasal", literal(T.NASAL_ETT_NAME)), otherwise=literal(T.ORAL_ETT_NAME))
    tube_score = first_value(("_nasal", confidence("1", neg)), otherwise=confidence(None, neg))
    dlt_score = confidence(match_count(text, T.DOUBLE_LUMEN_SUPPORT), neg)
    tubes = (
        Finding(placed, tube_name, tube_score, tube_context),
        Finding("_dlt IS NOT NULL", literal(T.DOUBLE_LUMEN_NAME), dlt_score, dlt_context),
        _family(target, T.DIRECT_LARYNGOSCOPE_NAME, T.DIRECT_LARYNGOSCOPY, confidence("_tube"), "_direct"),
        _family(target, T.VIDEO_LARYNGOSCOPE_NAME, T.VIDEO_LARYNGOSCOPY, confidence("_tube"), "_video"),
    )
    # Two lists: the code that Spark generates for all families at once is too long for the JVM to compile.
    staged = _with_findings(flagged, "_tubes", tubes, column, "_dlt", "_nasal", *scopes)
    families = {"_sga": T.SUPRAGLOTTIC, "_bronch": T.BRONCHOSCOPY, "_mask": T.MASK, "_difficult": T.DIFFICULT_AIRWAY}
    flagged = staged.withColumns({name: F.expr(first_match(text, patterns)) for name, patterns in families.items()})
    others = (
        _family(target, T.SUPRAGLOTTIC_NAME, T.SUPRAGLOTTIC, confidence(None, neg), "_sga"),
        _family(target, T.BRONCHOSCOPIC_NAME, T.BRONCHOSCOPY, confidence("_tube"), "_bronch"),
        _family(target, T.MASK_NAME, T.MASK, confidence(None, neg), "_mask"),
        _family(target, T.DIFFICULT_AIRWAY_NAME, T.DIFFICULT_AIRWAY, confidence(), "_difficult"),
    )
    staged = _with_findings(flagged, "_others", others, column, "_tube", *families)
    both = {f"{kind}airway_findings": F.concat(f"{kind}_tubes", f"{kind}_others") for kind in ("", VALUES)}
    return staged.withColumns(both).drop(*[f"{kind}{name}" for kind in ("", VALUES) for name in ("_tubes", "_others")])


def airway_findings(df: DataFrame, column: str = "procedure_notes") -> DataFrame:
    """Add ``airway_findings``, an array of finding structs."""
    return _airway(df, column).drop(VALUES + "airway_findings", *COUNTED)


def _vascular(df: DataFrame, column: str) -> DataFrame:
    df, target = _with_text(df, column)
    text = target.text
    df, neg = _with_negations(df, target)
    flagged = df.withColumns({
        "_central": F.expr(match_count(text, T.CENTRAL_LINE)),
        "_arterial": F.expr(first_match(text, T.ARTERIAL_LINE)),
        "_pa": F.expr(first_match(text, T.PA_CATHETER)),
    })
    central_context = context(target, T.CENTRAL_LINE)
    found = (
        _family(target, T.ARTERIAL_NAME, T.ARTERIAL_LINE, confidence(None, neg), "_arterial"),
        Finding("_central > 0", literal(T.CENTRAL_NAME), confidence(None, neg), central_context),
        _family(target, T.PA_NAME, T.PA_CATHETER, confidence("_central"), "_pa"),
    )
    return _with_findings(flagged, "vascular_findings", found, column, "_central", "_arterial", "_pa")


def vascular_findings(df: DataFrame, column: str = "procedure_notes") -> DataFrame:
    """Add ``vascular_findings``, an array of finding structs."""
    return _vascular(df, column).drop(VALUES + "vascular_findings", *COUNTED)


def _monitoring(df: DataFrame, column: str, into: str) -> DataFrame:
    df, target = _with_text(df, column)
    families = {
        "_tee": (T.TEE_NAME, T.TEE),
        "_ep": (T.ELECTROPHYSIOLOGIC_NAME, T.ELECTROPHYSIOLOGIC),
        "_csf": (T.CSF_DRAIN_NAME, T.CSF_DRAIN),
        "_neuro": (T.INVASIVE_NEURO_NAME, T.INVASIVE_NEURO),
    }
    flagged = df.withColumns({place: F.expr(first_match(target.text, patterns)) for place, (_, patterns) in families.items()})
    found = [_family(target, name, patterns, confidence(), place) for place, (name, patterns) in families.items()]
    return _with_findings(flagged, into, found, column, *families)


def monitoring_findings(
    df: DataFrame, column: str = "procedure_notes", into: str = "monitoring_findings"
) -> DataFrame:
    """Add an array of monitoring findings of one text column."""
    return _monitoring(df, column, into).drop(VALUES + into, *COUNTED)


def all_findings(df: DataFrame) -> DataFrame:
    """Add the value arrays, ``finding_count``, ``finding_total`` and ``extraction_findings`` of notes and procedure text.

    Monitoring is looked up in both texts: values are merged, findings are all kept. ``finding_total`` is the sum of the
    confidences of ``extraction_findings``, for readers of the scores alone: contexts are then never cut out.
    """
    found = _monitoring(_vascular(_airway(df, "procedure_notes"), "procedure_notes"), "procedure_notes", "monitoring_findings")
    found = _monitoring(found, "procedure", "_procedure_findings")
    return computed_once(
        found.selectExpr(
            *df.columns,
            "_values_airway_findings AS airway_management",
            "_values_vascular_findings AS vascular_access",
            "array_union(_values_monitoring_findings, _values__procedure_findings) AS monitoring",
            *COUNTED,
            "concat(airway_findings, vascular_findings, monitoring_findings, _procedure_findings)"
            " AS extraction_findings",
        )
    )


def score_cases(df: DataFrame) -> DataFrame:
    """Add ``confidence_score`` and ``confidence_warning`` from ``finding_count`` and ``finding_total``."""
    count = F.col("finding_count")
    mean = F.col("finding_total") / count
    no_notes = is_blank(F.col("procedure_notes"))
    return df.withColumns({
        "confidence_score": F.when(count > 0, mean)
        .when(no_notes, F.lit(T.NO_NOTES_CONFIDENCE))
        .otherwise(F.lit(T.NO_FINDINGS_CONFIDENCE)),
        "confidence_warning": F.when((count == 0) & no_notes, F.lit(A.WARN_NO_NOTES)),
    })


def findings_table(cases: DataFrame, keys: list[str]) -> DataFrame:
    """One row per finding, with its position in the case."""
    exploded = cases.select(*keys, F.posexplode("extraction_findings").alias("position", "finding"))
    return exploded.select(*keys, "position", "finding.*")
