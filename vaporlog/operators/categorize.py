"""Procedure categories from services and procedure text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vaporlog.functions.matching import contains_any, first_value, literal
from vaporlog.functions.staging import computed_once
from vaporlog.functions.text import python_list, strip
from vaporlog.rules import procedures as P
from vaporlog.rules import schema as S

NO_TEXTS = "CAST(array() AS ARRAY<STRING>)"


def add_approach(df: DataFrame, text: str = "procedure_upper") -> DataFrame:
    """Add ``approach`` (endovascular, open, unknown) and ``pathology`` (vascular,
    nonvascular, unknown) of an upper-cased procedure text."""
    flagged = df.withColumns({
        "_endo": F.expr(contains_any(text, P.ENDOVASCULAR)),
        "_open": F.expr(contains_any(text, P.OPEN)),
        "_vascular": F.expr(contains_any(text, P.VASCULAR_PATHOLOGY)),
        "_nonvascular": F.expr(contains_any(text, P.NONVASCULAR_PATHOLOGY)),
    })
    approach = first_value(
        ("NOT _endo AND NOT _open", "'unknown'"),
        ("NOT _open", "'endovascular'"),
        ("NOT _endo", "'open'"),
        # Both kinds of words: a cranial opening decides, then an explicit approach.
        (contains_any(text, P.CRANIAL_OPEN), "'open'"),
        (contains_any(text, P.EXPLICIT_ENDOVASCULAR), "'endovascular'"),
        otherwise="'unknown'",
    )
    hematoma = f"{contains_any(text, P.HEMATOMA)} AND NOT {contains_any(text, P.HEMATOMA_VASCULAR)}"
    pathology = first_value(
        ("_vascular AND NOT _nonvascular", "'vascular'"),
        ("_nonvascular AND NOT _vascular", "'nonvascular'"),
        (hematoma, "'nonvascular'"),
        otherwise="'unknown'",
    )
    return flagged.withColumns({"approach": F.expr(approach), "pathology": F.expr(pathology)}).drop(
        "_endo", "_open", "_vascular", "_nonvascular"
    )


def add_specific_categories(df: DataFrame) -> DataFrame:
    """Add the category that each surgery family would give this ``procedure_upper``."""
    text = "procedure_upper"
    with_cpb, without_cpb = literal(P.CARDIAC_WITH_CPB), literal(P.CARDIAC_WITHOUT_CPB)
    valve = f"{contains_any(text, P.TRANSCATHETER)} AND {contains_any(text, P.TRANSCATHETER_VALVE)}"
    cardiac = first_value(
        (contains_any(text, P.OFF_PUMP), without_cpb),
        (contains_any(text, P.STRONG_CPB), with_cpb),
        (contains_any(text, P.NO_CPB), without_cpb),
        (contains_any(text, P.CPB), with_cpb),
        (valve, without_cpb),
        otherwise=with_cpb,
    )
    vessel = first_value(
        ("approach = 'endovascular'", literal(P.MAJOR_VESSELS_ENDOVASCULAR)),
        otherwise=literal(P.MAJOR_VESSELS_OPEN),
    )
    intracerebral = first_value(
        ("approach = 'endovascular'", literal(P.INTRACEREBRAL_ENDOVASCULAR)),
        ("approach = 'open' AND pathology <> 'nonvascular'", literal(P.INTRACEREBRAL_VASCULAR_OPEN)),
        otherwise=literal(P.INTRACEREBRAL_NONVASCULAR_OPEN),
    )
    obgyn = first_value(
        (contains_any(text, P.CESAREAN_TEXT), literal(P.CESAREAN)),
        (contains_any(text, P.VAGINAL_TEXT), literal(P.VAGINAL_DELIVERY)),
        otherwise=literal(P.OTHER),
    )
    return add_approach(df).withColumns({
        "cardiac_category": F.expr(cardiac),
        "vessel_category": F.expr(vessel),
        "intracerebral_category": F.expr(intracerebral),
        "obgyn_category": F.expr(obgyn),
        "_spine": F.expr(contains_any(text, P.SPINE)),
        "_card": F.expr(contains_any(text, P.THORACIC_SERVICE_EXCLUDE)),
    })


def _service_category() -> str:
    """Category of one service ``s``: its first rule that is not excluded."""
    neuro = f"{contains_any('s', P.NEURO_SERVICE)} AND NOT _spine AND NOT {contains_any('s', P.SPINE)}"
    thoracic = (
        f"{contains_any('s', P.THORACIC_SERVICE)} AND NOT _card "
        f"AND NOT {contains_any('s', P.THORACIC_SERVICE_EXCLUDE)}"
    )
    return first_value(
        (contains_any("s", P.CARDIAC_SERVICE), "cardiac_category"),
        (neuro, "intracerebral_category"),
        (thoracic, literal(P.INTRATHORACIC)),
        (contains_any("s", P.VASCULAR_SERVICE), "vessel_category"),
        (contains_any("s", P.TRANSPLANT_SERVICE), literal(P.OTHER)),
    )


def _text_category(text: str) -> str:
    """Category of the procedure text alone; null when no rule speaks."""
    thoracic = f"{contains_any(text, P.THORACIC_TEXT)} AND NOT {contains_any(text, P.THORACIC_TEXT_EXCLUDE)}"
    vascular = f"{contains_any(text, P.VASCULAR_TEXT)} AND NOT {contains_any(text, P.VASCULAR_TEXT_EXCLUDE)}"
    by_rule = first_value(
        (contains_any(text, P.CARDIAC_TEXT), "cardiac_category"),
        (f"{contains_any(text, P.INTRACEREBRAL_TEXT)} AND NOT _spine", "intracerebral_category"),
        (thoracic, literal(P.INTRATHORACIC)),
        (vascular, "vessel_category"),
    )
    return f"coalesce({by_rule}, nullif(obgyn_category, {literal(P.OTHER)}))"


def categorize(df: DataFrame) -> DataFrame:
    """Add ``rule_category`` and ``rule_warnings`` from ``procedure`` and ``services``.

    ``services`` is an array of texts; without any match the procedure text decides.
    """
    cleaned = F.filter(
        F.transform(F.col("services"), lambda s: F.upper(strip(s))),
        lambda s: s.isNotNull() & ~s.isin(*S.SERVICE_MISSING),
    )
    prepared = df.withColumns({
        "procedure_upper": F.coalesce(F.upper(F.col("procedure")), F.lit("")),
        "service_upper": F.coalesce(cleaned, F.expr(NO_TEXTS)),
    })
    obgyn = f"exists(service_upper, s -> {contains_any('s', P.OBGYN_SERVICE)})"
    by_service = first_value(
        (
            "size(service_upper) > 0",
            f"array_distinct(concat(array_compact(transform(service_upper, s -> {_service_category()})), "
            f"CASE WHEN {obgyn} THEN array(obgyn_category) ELSE {NO_TEXTS} END))",
        ),
        otherwise=NO_TEXTS,
    )
    found = first_value(
        (
            "size(_by_service) = 0 AND procedure_upper <> ''",
            f"array_compact(array({_text_category('procedure_upper')}))",
        ),
        otherwise="_by_service",
    )
    categories = first_value(
        (
            f"(size(_found) = 0 OR _found = array({literal(P.OTHER)})) "
            f"AND {contains_any('procedure_upper', P.LABOR_EPIDURAL)}",
            f"array({literal(P.VAGINAL_DELIVERY)})",
        ),
        otherwise="_found",
    )
    staged = (
        add_specific_categories(prepared)
        .withColumn("_by_service", F.expr(by_service))
        .withColumn("_found", F.expr(found))
        .withColumn("_categories", F.expr(categories))
    )
    warning = F.concat(
        F.lit("Multiple procedure categories detected for services "),
        python_list(F.col("service_upper")),
        F.lit(": "),
        python_list(F.col("_categories")),
        F.lit(". Using first: "),
        F.expr("get(_categories, 0)"),
    )
    return computed_once(
        staged.select(
            *df.columns,
            F.expr(f"coalesce(get(_categories, 0), {literal(P.OTHER)}) AS rule_category"),
            F.when(F.expr("size(_categories) > 1"), F.array(warning))
            .otherwise(F.expr(NO_TEXTS))
            .alias("rule_warnings"),
        )
    )


