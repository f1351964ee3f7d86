"""DuckDB SQL for the queries, written independently of the Spark plans.

Word and pattern lists are shared; everything else (joins, windows, rule order, warning
texts) is stated again in SQL. RE2 has no look-ahead, so the one pattern that needs it is
rewritten, and word boundaries next to letters beyond ASCII are spelled out.
"""

from __future__ import annotations

from vaporlog.operators.features import structured_names
from vaporlog.rules import anesthesia as A
from vaporlog.rules import blocks as B
from vaporlog.rules import procedures as P
from vaporlog.rules import review as R
from vaporlog.rules import schema as S
from vaporlog.rules import techniques as T
from vaporlog.rules import training as M
from verification.views import view_sql

ORACLE = {}


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def has(text: str, words) -> str:
    return "(" + " OR ".join(f"position({q(w)} IN {text}) > 0" for w in words) + ")"


LOOKAHEAD = T.MASK[0]


def rx(text: str, pattern: str) -> str:
    if pattern == LOOKAHEAD:
        # 'mask' with no LMA after it on the line: cut each line up to its last LMA first.
        return (
            f"len(list_filter(string_split({text}, chr(10)), lambda x: "
            f"regexp_matches(regexp_replace(x, '(?i)^.*\\bLMA\\b', ''), '(?i)\\bmask\\b'))) > 0"
        )
    if pattern in T.NEGATION:
        # Letters beyond ASCII are letters too.
        pattern = "(?:^|[^\\pL\\pN_])" + pattern[2:]
    return f"regexp_matches({text}, {q('(?i)' + pattern)})"


def lookahead_context(text: str) -> str:
    """Context of the first 'mask' that no LMA follows on its line."""
    parts = f"string_split({text}, chr(10))"
    cut = "regexp_replace({x}, '(?i)^.*\\bLMA\\b', '')"
    flags = f"list_transform({parts}, lambda x: regexp_matches({cut.format(x='x')}, '(?i)\\bmask\\b'))"
    at = f"list_position({flags}, true)"
    line = f"{parts}[{at}]"
    above = f"array_to_string({parts}[1:{at} - 1], chr(10)) || CASE WHEN {at} > 1 THEN chr(10) ELSE '' END"
    head = f"({above} || left({line}, length({line}) - length({cut.format(x=line)})))"
    rest = f"substr({text}, length({head}) + 1)"
    before = f"right({head} || regexp_extract({rest}, '(?i)^((?s:.*?))\\bmask\\b', 1), 50)"
    return strip(f"({before} || regexp_extract({rest}, '(?i)^(?s:.*?)(\\bmask\\b(?s:.{{0,50}}))', 1))")


def rx_any(text: str, patterns) -> str:
    return "(" + " OR ".join(rx(text, p) for p in patterns) + ")"


def rx_count(text: str, patterns) -> str:
    return "(" + " + ".join(f"CAST({rx(text, p)} AS INT)" for p in patterns) + ")"


def ladder(cases, otherwise="NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {otherwise} END"


def strip(text: str) -> str:
    return f"trim({text}, ' ' || chr(9) || chr(10) || chr(13))"


def squeeze(text: str) -> str:
    return strip(f"regexp_replace({text}, '\\s+', ' ', 'g')")


def clean(text: str) -> str:
    return f"CASE WHEN {text} IS NULL OR {strip(text)} IN ('', '<NA>', 'nan', 'NaN', 'None') THEN '' ELSE {strip(text)} END"


def join_distinct(*texts) -> str:
    parts = ", ".join(strip(t) for t in texts)
    kept = f"list_filter([{parts}], lambda x: x IS NOT NULL AND x <> '')"
    # First occurrences, in order.
    first = f"list_filter({kept}, lambda x, i: list_position({kept}, x) = i)"
    return f"nullif(array_to_string({first}, chr(10)), '')"


def provider(text: str) -> str:
    first = strip(f"split_part({text}, ';', 1)")
    untitled = strip(f"regexp_replace({first}, '(?i)\\b(MD|DO|PhD|CRNA|RN)\\b', '', 'g')")
    return squeeze(f"regexp_replace({untitled}, ',\\s*$', '')")


def attending(text: str) -> str:
    return f"coalesce({strip(f'split_part(split_part({text}, chr(59), 1), chr(64), 1)')}, '')"


def lines(text: str) -> str:
    return f"coalesce(list_filter(list_transform(string_split({text}, chr(10)), lambda x: {strip('x')}), lambda x: x <> ''), [])"


def label(text: str) -> str:
    body = strip(text)
    named = [(f"{body} = {q(P.LABEL_NAME_PREFIX + name)}", q(value)) for name, value in P.CATEGORY_BY_NAME.items()]
    return ladder([(f"{text} IS NULL", q(P.OTHER)), *named], body)


def optional_label(text: str) -> str:
    return ladder([(f"{text} IS NULL OR lower({strip(text)}) IN ('', '<na>', 'nan', 'none')", "''")], label(text))


def hash32(text: str) -> str:
    return f"CAST('0x' || substr(sha256({text}), 1, 8) AS BIGINT)"


def key_of(text: str) -> str:
    return f"coalesce(upper({squeeze(text)}), '')"


# --- common table expressions -------------------------------------------------------

CTES: dict[str, tuple[str, ...] | str] = {}
NEEDS: dict[str, tuple[str, ...]] = {}
_BODIES: dict[str, str] = {}


def cte(name: str, body: str, *needs: str) -> None:
    CTES[name] = body
    NEEDS[name] = needs


for _view in ("case_table", "case_list", "proc_list", "predictions", "review_labels", "training_rows", "roster",
              "available_logs", "note_corpus"):
    cte(_view, view_sql(_view))


def register(name: str, sql: str, *needs: str) -> None:
    ordered: list[str] = []

    def visit(cte_name: str) -> None:
        for other in NEEDS[cte_name]:
            visit(other)
        if cte_name not in ordered:
            ordered.append(cte_name)

    for need in needs:
        visit(need)
    _BODIES[name] = sql
    heads = ",\n".join(f"{n} AS MATERIALIZED ({CTES[n]})" for n in ordered)
    ORACLE[name] = f"WITH {heads}\n{sql}" if heads else sql


# Canonical case tables of the paired exports.
RANK = ladder([(f"procedure_name = {q(n)}", str(r)) for n, r in S.TECHNIQUE_RANK.items()], "0")
cte("cases_in", "SELECT * FROM case_list WHERE pair_key IN (SELECT pair_key FROM proc_list)", "case_list", "proc_list")
cte("procs_in", "SELECT * FROM proc_list WHERE pair_key IN (SELECT pair_key FROM case_list)", "case_list", "proc_list")
cte(
    "primary_technique",
    f"""SELECT pair_key, case_id, procedure_name AS airway_type,
        CASE WHEN rank >= 2 THEN {join_distinct('comment', 'details')} END AS airway_details
        FROM (SELECT *, {RANK} AS rank,
              row_number() OVER (PARTITION BY pair_key, case_id ORDER BY {RANK} DESC, seq) AS rn
              FROM proc_list WHERE procedure_name IS NOT NULL) WHERE rn = 1""",
    "proc_list",
)
NORMAL_CASE = f"""SELECT c.pair_key, {{seq}} scheduled_dt AS date, c.case_id AS episode_id,
    {attending('attendings')} AS anesthesiologist, patient_age AS age, CAST(NULL AS VARCHAR) AS emergent,
    asa_status AS asa, airway_type AS final_anesthesia_type,
    {join_distinct('airway_type', 'airway_details')} AS procedure_notes, procedure_text AS procedure,
    '' AS services, CAST(NULL AS VARCHAR) AS nerve_block_type
    FROM {{source}} c LEFT JOIN primary_technique p ON c.pair_key = p.pair_key AND c.case_id = p.case_id"""
NORMAL_ORPHAN = f"""SELECT pair_key, {{seq}} scheduled_dt AS date, case_id AS episode_id,
    {attending('attendings')} AS anesthesiologist, '30' AS age, emergency AS emergent, asa_status AS asa,
    procedure_name AS final_anesthesia_type, {join_distinct('procedure_name', 'comment', 'details')} AS procedure_notes,
    procedure_text AS procedure, '' AS services, primary_block AS nerve_block_type
    FROM {{source}} p WHERE NOT EXISTS (SELECT 1 FROM case_list c
    WHERE c.pair_key = p.pair_key AND c.case_id = p.case_id)"""
cte("pair_cases", NORMAL_CASE.format(seq="CAST(c.seq AS VARCHAR) AS seq,", source="cases_in"), "cases_in", "primary_technique")
cte("pair_orphans", NORMAL_ORPHAN.format(seq="seq,", source="procs_in"), "procs_in", "case_list")


def annotation(source: str, prefix: str) -> str:
    """Register the annotation chain over a canonical table; returns the last name."""
    up, notes, txt = "procedure_upper", "procedure_notes", "site_text"
    date = ladder([
        ("date IS NULL", "NULL"),
        ("regexp_full_match(date, '\\d{4}-\\d{2}-\\d{2}([ T]\\d{2}:\\d{2}:\\d{2})?')", "CAST(try_cast(date AS TIMESTAMP) AS DATE)"),
        ("regexp_full_match(date, '\\d+/\\d+/\\d{4}( .*)?')", "CAST(try_strptime(split_part(date, ' ', 1), '%m/%d/%Y') AS DATE)"),
        ("regexp_full_match(date, '\\d{4}/\\d+/\\d+')", "CAST(try_strptime(date, '%Y/%m/%d') AS DATE)"),
    ])
    emergent = f"coalesce(upper({strip('emergent')}) IN ('E','Y','YES','TRUE','1'), false)"
    cte(
        f"{prefix}_1",
        f"""SELECT *, {date} AS parsed_date, try_cast(trim(age) AS DOUBLE) AS age_number,
            {emergent} AS is_emergent, upper(final_anesthesia_type) AS technique_upper,
            coalesce(upper(procedure), '') AS procedure_upper, {lines('services')} AS service_list,
            substr(episode_id, 1, 25) AS short_id, {provider('anesthesiologist')} AS provider,
            {clean('nerve_block_type')} AS block_clean, {clean('final_anesthesia_type')} AS technique_clean,
            {clean('procedure_notes')} AS notes_clean
            FROM {source}""",
        source,
    )
    endo, opened = has(up, P.ENDOVASCULAR), has(up, P.OPEN)
    approach = ladder([
        (f"{endo} AND {opened} AND {has(up, P.CRANIAL_OPEN)}", "'open'"),
        (f"{endo} AND {opened} AND {has(up, P.EXPLICIT_ENDOVASCULAR)}", "'endovascular'"),
        (f"{endo} AND {opened}", "'unknown'"), (endo, "'endovascular'"), (opened, "'open'"),
    ], "'unknown'")
    vas, non = has(up, P.VASCULAR_PATHOLOGY), has(up, P.NONVASCULAR_PATHOLOGY)
    pathology = ladder([
        (f"{vas} AND NOT {non}", "'vascular'"), (f"{non} AND NOT {vas}", "'nonvascular'"),
        (f"position('HEMATOMA' IN {up}) > 0 AND NOT {has(up, P.HEMATOMA_VASCULAR)}", "'nonvascular'"),
    ], "'unknown'")
    cardiac = ladder([
        (has(up, P.OFF_PUMP), q(P.CARDIAC_WITHOUT_CPB)), (has(up, P.STRONG_CPB), q(P.CARDIAC_WITH_CPB)),
        (has(up, P.NO_CPB), q(P.CARDIAC_WITHOUT_CPB)), (has(up, P.CPB), q(P.CARDIAC_WITH_CPB)),
        (f"position('TRANSCATHETER' IN {up}) > 0 AND {has(up, P.TRANSCATHETER_VALVE)}", q(P.CARDIAC_WITHOUT_CPB)),
    ], q(P.CARDIAC_WITH_CPB))
    obgyn = ladder([(has(up, P.CESAREAN_TEXT), q(P.CESAREAN)), (has(up, P.VAGINAL_TEXT), q(P.VAGINAL_DELIVERY))], q(P.OTHER))
    cte(f"{prefix}_2", f"SELECT *, {approach} AS approach, {pathology} AS pathology, {cardiac} AS cardiac_category, {obgyn} AS obgyn_category FROM {prefix}_1", f"{prefix}_1")
    vessel = ladder([("approach = 'endovascular'", q(P.MAJOR_VESSELS_ENDOVASCULAR))], q(P.MAJOR_VESSELS_OPEN))
    cerebral = ladder([
        ("approach = 'endovascular'", q(P.INTRACEREBRAL_ENDOVASCULAR)),
        ("approach = 'unknown' OR pathology = 'nonvascular'", q(P.INTRACEREBRAL_NONVASCULAR_OPEN)),
    ], q(P.INTRACEREBRAL_VASCULAR_OPEN))
    services = "list_filter(list_transform(service_list, lambda x: upper(x)), lambda x: x NOT IN ('', '<NA>', 'NAN', 'NONE'))"
    cte(f"{prefix}_3", f"SELECT *, {vessel} AS vessel_category, {cerebral} AS intracerebral_category, {services} AS svc FROM {prefix}_2", f"{prefix}_2")
    by_service = ladder([
        (has("x", P.CARDIAC_SERVICE), "cardiac_category"),
        (f"position('NEURO' IN x) > 0 AND NOT {has(up, P.SPINE)} AND NOT {has('x', P.SPINE)}", "intracerebral_category"),
        (f"position('THOR' IN x) > 0 AND position('CARD' IN {up}) = 0 AND position('CARD' IN x) = 0", q(P.INTRATHORACIC)),
        (has("x", P.VASCULAR_SERVICE), "vessel_category"),
        ("position('TRANSPLANT' IN x) > 0", q(P.OTHER)),
    ])
    by_text = ladder([
        (has(up, P.CARDIAC_TEXT), "cardiac_category"),
        (f"{has(up, P.INTRACEREBRAL_TEXT)} AND NOT {has(up, P.SPINE)}", "intracerebral_category"),
        (f"{has(up, P.THORACIC_TEXT)} AND NOT {has(up, P.THORACIC_TEXT_EXCLUDE)}", q(P.INTRATHORACIC)),
        (f"{has(up, P.VASCULAR_TEXT)} AND NOT {has(up, P.VASCULAR_TEXT_EXCLUDE)}", "vessel_category"),
        (f"obgyn_category <> {q(P.OTHER)}", "obgyn_category"),
    ])
    cte(
        f"{prefix}_4",
        f"""SELECT *, list_filter(list_concat(list_transform(svc, lambda x: {by_service}),
            list_transform(list_filter(svc, lambda x: {has('x', P.OBGYN_SERVICE)}), lambda x: obgyn_category)),
            lambda x: x IS NOT NULL) AS cats0, {by_text} AS text_category FROM {prefix}_3""",
        f"{prefix}_3",
    )
    cte(f"{prefix}_5", f"SELECT *, list_filter(cats0, lambda x, i: list_position(cats0, x) = i) AS cats1 FROM {prefix}_4", f"{prefix}_4")
    cte(
        f"{prefix}_6",
        f"""SELECT *, CASE WHEN len(cats1) > 0 THEN cats1 WHEN text_category IS NULL THEN [] ELSE [text_category] END AS cats2
            FROM {prefix}_5""",
        f"{prefix}_5",
    )
    cte(
        f"{prefix}_7",
        f"""SELECT *, CASE WHEN (len(cats2) = 0 OR cats2 = [{q(P.OTHER)}]) AND position('LABOR EPIDURAL' IN {up}) > 0
            THEN [{q(P.VAGINAL_DELIVERY)}] ELSE cats2 END AS cats FROM {prefix}_6""",
        f"{prefix}_6",
    )

    def py_list(items: str) -> str:
        return f"'[' || array_to_string(list_transform({items}, lambda x: chr(39) || x || chr(39)), ', ') || ']'"

    category_warning = (
        f"CASE WHEN len(cats) > 1 THEN 'Multiple procedure categories detected for services ' || {py_list('svc')} || "
        f"': ' || {py_list('cats')} || '. Using first: ' || cats[1] END"
    )
    tube, neg = rx_count(notes, T.INTUBATION), rx_count(notes, T.NEGATION)
    central = rx_count(notes, T.CENTRAL_LINE)
    cte(
        f"{prefix}_8",
        f"""SELECT *, coalesce(cats[1], {q(P.OTHER)}) AS category, {category_warning} AS category_warning,
            {tube} AS tube_n, {neg} AS neg_n, {central} AS central_n,
            {rx_any(notes, T.DOUBLE_LUMEN)} AS dlt, {rx_any(notes, T.NASAL_ROUTE)} AS nasal FROM {prefix}_7""",
        f"{prefix}_7",
    )

    def conf(support="0", negations="0") -> str:
        return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5::DOUBLE + least({support} * 0.1::DOUBLE, 0.4::DOUBLE) - {negations} * 0.3::DOUBLE))"

    def snippet(text: str, patterns) -> str:
        def around(p: str) -> str:
            if p == LOOKAHEAD:
                return lookahead_context(text)
            before = f"regexp_extract({text}, {q('(?i)^((?s:.*?))(?:' + p + ')')}, 1)"
            rest = f"regexp_extract({text}, {q('(?i)^(?s:.*?)((?:' + p + ')(?s:.{0,50}))')}, 1)"
            return strip(f"(right({before}, 50) || {rest})")

        return ladder([(rx(text, p), around(p)) for p in patterns])

    def item(when: str, value: str, score: str, text: str, patterns, source: str) -> str:
        context = patterns if isinstance(patterns, str) else snippet(text, patterns)
        return (
            f"CASE WHEN {when} THEN {{'value': {value}, 'confidence': {score}, 'context': {context}, "
            f"'source_field': {q(source)}}} END"
        )

    placed = "(tube_n > 0 OR dlt)"
    tube_context = f"CASE WHEN tube_n > 0 THEN {snippet(notes, T.INTUBATION)} ELSE {snippet(notes, T.DOUBLE_LUMEN)} END"
    airway = [
        item(f"{placed} AND nasal", q(T.NASAL_ETT_NAME), conf("1", "neg_n"), notes, tube_context, notes),
        item(f"{placed} AND NOT nasal", q(T.ORAL_ETT_NAME), conf("0", "neg_n"), notes, tube_context, notes),
        item("dlt", q(T.DOUBLE_LUMEN_NAME), conf(rx_count(notes, T.DOUBLE_LUMEN_SUPPORT), "neg_n"), notes, T.DOUBLE_LUMEN, notes),
    ]
    for name, patterns, score, given in (
        (T.DIRECT_LARYNGOSCOPE_NAME, T.DIRECT_LARYNGOSCOPY, conf("tube_n"), placed),
        (T.VIDEO_LARYNGOSCOPE_NAME, T.VIDEO_LARYNGOSCOPY, conf("tube_n"), placed),
        (T.SUPRAGLOTTIC_NAME, T.SUPRAGLOTTIC, conf("0", "neg_n"), "true"),
        (T.BRONCHOSCOPIC_NAME, T.BRONCHOSCOPY, conf("tube_n"), "true"),
        (T.MASK_NAME, T.MASK, conf("0", "neg_n"), "true"),
        (T.DIFFICULT_AIRWAY_NAME, T.DIFFICULT_AIRWAY, conf(), "true"),
    ):
        airway.append(item(f"{given} AND {rx_any(notes, patterns)}", q(name), score, notes, patterns, notes))
    vascular = [
        item(rx_any(notes, T.ARTERIAL_LINE), q(T.ARTERIAL_NAME), conf("0", "neg_n"), notes, T.ARTERIAL_LINE, notes),
        item("central_n > 0", q(T.CENTRAL_NAME), conf("0", "neg_n"), notes, T.CENTRAL_LINE, notes),
        item(rx_any(notes, T.PA_CATHETER), q(T.PA_NAME), conf("central_n"), notes, T.PA_CATHETER, notes),
    ]

    def monitors(text: str):
        return [
            item(rx_any(text, p), q(n), conf(), text, p, text)
            for n, p in ((T.TEE_NAME, T.TEE), (T.ELECTROPHYSIOLOGIC_NAME, T.ELECTROPHYSIOLOGIC),
                         (T.CSF_DRAIN_NAME, T.CSF_DRAIN), (T.INVASIVE_NEURO_NAME, T.INVASIVE_NEURO))
        ]

    def kept(items) -> str:
        return f"list_filter([{', '.join(items)}], lambda x: x IS NOT NULL)"

    cte(
        f"{prefix}_9",
        f"""SELECT *, {kept(airway)} AS airway, {kept(vascular)} AS vascular,
            {kept(monitors(notes))} AS monitors, {kept(monitors('procedure'))} AS more_monitors FROM {prefix}_8""",
        f"{prefix}_8",
    )
    mapped = ladder([(f"position({q(w)} IN technique_upper) > 0", q(t)) for w, t in A.ANESTHESIA_MAPPING.items()])
    site_text = "array_to_string(list_filter([block_clean, technique_clean, CASE WHEN block_clean <> '' THEN notes_clean ELSE '' END], lambda x: x <> ''), ' ')"
    cte(
        f"{prefix}_10",
        f"""SELECT *, {mapped} AS mapped, list_concat(airway, vascular, monitors, more_monitors) AS findings,
            list_transform(airway, lambda x: x.value) AS airway_values, list_transform(vascular, lambda x: x.value) AS vascular_values,
            list_concat(list_transform(monitors, lambda x: x.value), list_filter(list_transform(more_monitors, lambda x: x.value),
            lambda v: NOT list_contains(list_transform(monitors, lambda x: x.value), v))) AS monitor_values,
            {site_text} AS site_text FROM {prefix}_9""",
        f"{prefix}_9",
    )
    inference = ladder([
        ("mapped IS NOT NULL", "NULL"), ("len(airway) > 0", q(A.WARN_AIRWAY)),
        (has("upper(coalesce(procedure_notes, ''))", A.MAC_NOTES), q(A.WARN_MAC_NOTE)),
        (has("upper(coalesce(procedure_notes, ''))", A.GA_NOTES), q(A.WARN_GA_NOTE)),
        (has(up, A.MAC_PROCEDURES), q(A.WARN_MAC_PROCEDURE)),
        (f"category IN ({q(P.CESAREAN)}, {q(P.VAGINAL_DELIVERY)})", q(A.WARN_OBSTETRIC)),
    ], q(A.WARN_DEFAULT_GA))
    no_notes = f"(procedure_notes IS NULL OR {strip(notes)} = '')"
    sites = [f"CASE WHEN {rx_any(txt, p)} THEN {q(t)} END" for t, p in B.PERIPHERAL_SITES.items()]
    axial = [f"CASE WHEN {rx_any(txt, p)} THEN {q(t)} END" for t, p in B.NEURAXIAL_SITES.items()]
    rng, one = q("(?i)" + B.THORACIC_RANGE), q("(?i)" + B.THORACIC_LEVEL)
    levels = (
        f"list_transform(list_concat(regexp_extract_all({txt}, {rng}, 1), regexp_extract_all({txt}, {rng}, 2), "
        f"regexp_extract_all({txt}, {one}, 1)), lambda x: CAST(x AS INT))"
    )
    cte(
        f"{prefix}_11",
        f"""SELECT *, {inference} AS inference_warning,
            CASE WHEN len(findings) > 0 THEN list_sum(list_transform(findings, lambda x: x.confidence)) / len(findings)
                 WHEN {no_notes} THEN 0.7::DOUBLE ELSE 0.9::DOUBLE END AS case_confidence,
            CASE WHEN len(findings) = 0 AND {no_notes} THEN {q(A.WARN_NO_NOTES)} END AS confidence_warning,
            list_filter([{', '.join(sites)}], lambda x: x IS NOT NULL) AS sites0,
            list_filter([{', '.join(axial)}], lambda x: x IS NOT NULL) AS axial0, {levels} AS levels FROM {prefix}_10""",
        f"{prefix}_10",
    )
    cte(
        f"{prefix}_12",
        f"""SELECT *, len(list_filter(levels, lambda x: x <= 7)) > 0 OR {rx_any(txt, B.THORACIC_UPPER)} AS high0,
            len(list_filter(levels, lambda x: x >= 8)) > 0 OR {rx_any(txt, B.THORACIC_LOWER)} AS low0,
            {rx_any(txt, B.THORACIC_GENERIC)} AS thoracic FROM {prefix}_11""",
        f"{prefix}_11",
    )
    cte(
        f"{prefix}_13",
        f"""SELECT *, list_concat(axial0,
            CASE WHEN high0 OR (thoracic AND NOT high0 AND NOT low0) THEN ['T 1-7'] ELSE [] END,
            CASE WHEN low0 OR (thoracic AND NOT high0 AND NOT low0) THEN ['T 8-12'] ELSE [] END) AS axial1
            FROM {prefix}_12""",
        f"{prefix}_12",
    )
    cte(
        f"{prefix}_14",
        f"""SELECT *, list_concat(
            CASE WHEN len(sites0) = 0 AND {rx_any(txt, B.PERIPHERAL_CONTEXT)} THEN [{q(B.OTHER_PERIPHERAL)}] ELSE sites0 END,
            CASE WHEN len(axial1) = 0 AND {rx_any(txt, B.LUMBAR_CONTEXT)} THEN ['Lumbar'] ELSE axial1 END) AS terms
            FROM {prefix}_13""",
        f"{prefix}_13",
    )
    bands = ladder([
        ("age_number IS NULL OR isnan(age_number) OR isinf(age_number)", "NULL"),
        ("age_number < 0.25", q(S.AGE_BANDS[0][1])), ("age_number < 3", q(S.AGE_BANDS[1][1])),
        ("age_number < 12", q(S.AGE_BANDS[2][1])), ("age_number < 65", q(S.AGE_BANDS[3][1])),
    ], q(S.AGE_BANDS[4][1]))
    date_warning = ladder([
        ("date IS NULL", "'Missing date value, using default year 2025'"),
        ("parsed_date IS NULL", "'Could not parse date ''' || date || ''', using default year 2025'"),
    ])
    age_warning = ladder([
        ("age IS NULL", "'Missing age value'"), ("age_number IS NULL", "'Invalid age value: ' || age"),
        ("isnan(age_number)", "NULL"),
        ("age_number < 0 OR age_number > 120", "'Age ' || CAST(age_number AS VARCHAR) || ' is outside expected range (0-120)'"),
    ])
    add_e = "is_emergent AND position('E' IN upper(coalesce(asa, ''))) = 0"
    anesthesia_warning = ladder([
        ("final_anesthesia_type IS NULL", "'Missing anesthesia type'"),
        ("mapped IS NULL", "'Unrecognized anesthesia type: ' || final_anesthesia_type"),
    ])
    block = "CASE WHEN len(terms) > 0 THEN array_to_string(terms, '; ') ELSE nullif(block_clean, '') END"
    cte(
        f"{prefix}_15",
        f"""SELECT *, coalesce(parsed_date, DATE '2025-01-01') AS case_date, {bands} AS age_category,
            {date_warning} AS date_warning, {age_warning} AS age_warning,
            coalesce(asa, '') || CASE WHEN {add_e} THEN 'E' ELSE '' END AS asa_text,
            CASE WHEN {add_e} THEN {q(A.WARN_ASA)} END AS asa_warning, {anesthesia_warning} AS anesthesia_warning,
            CASE WHEN mapped IS NOT NULL THEN mapped
                 WHEN inference_warning IN ({q(A.WARN_MAC_NOTE)}, {q(A.WARN_MAC_PROCEDURE)}) THEN 'MAC'
                 WHEN inference_warning = {q(A.WARN_OBSTETRIC)} THEN NULL ELSE 'GA' END AS kind,
            {block} AS block, CASE WHEN len(terms) = 0 OR list_contains(terms, {q(B.OTHER_PERIPHERAL)})
                 THEN nerve_block_type END AS unmatched FROM {prefix}_14""",
        f"{prefix}_14",
    )
    cte(
        prefix,
        f"""SELECT *, list_filter([date_warning, age_warning, asa_warning, anesthesia_warning, category_warning,
            inference_warning, confidence_warning], lambda x: x IS NOT NULL) AS warnings FROM {prefix}_15""",
        f"{prefix}_15",
    )
    return prefix


annotation("case_table", "parsed")
annotation("pair_cases", "parsed_pairs")
annotation("pair_orphans", "parsed_orphans")
cte("notes_in", """SELECT seq, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS age, CAST(NULL AS VARCHAR) AS emergent,
    CAST(NULL AS VARCHAR) AS final_anesthesia_type, CAST(NULL AS VARCHAR) AS procedure, CAST(NULL AS VARCHAR) AS services,
    CAST(NULL AS VARCHAR) AS episode_id, CAST(NULL AS VARCHAR) AS anesthesiologist, CAST(NULL AS VARCHAR) AS nerve_block_type,
    CAST(NULL AS VARCHAR) AS asa, procedure_notes FROM note_corpus""", "note_corpus")
annotation("notes_in", "parsed_notes")

ROUTE = (
    f"CASE WHEN len(list_filter(terms, lambda x: x IN ({', '.join(q(t) for t in B.PERIPHERAL_TERMS)}))) > 0 OR position('BLOCK' IN upper("
    "concat_ws(' ', final_anesthesia_type, nerve_block_type, unmatched, procedure, procedure_notes, block))) > 0 "
    "THEN 'block' ELSE 'neuraxial' END"
)

# --- sources and joins --------------------------------------------------------------

register("s1_paired_exports", """SELECT pair_key, c.n AS case_rows, p.n AS procedure_rows FROM
    (SELECT pair_key, count(*) AS n FROM case_list GROUP BY 1) c JOIN
    (SELECT pair_key, count(*) AS n FROM proc_list GROUP BY 1) p USING (pair_key)""", "case_list", "proc_list")
register("s1_unpaired_exports", """SELECT DISTINCT pair_key, 'CaseList' AS found_in FROM case_list
    WHERE pair_key NOT IN (SELECT pair_key FROM proc_list)
    UNION ALL SELECT DISTINCT pair_key, 'ProcedureList' FROM proc_list
    WHERE pair_key NOT IN (SELECT pair_key FROM case_list)""", "case_list", "proc_list")
register("s2_united_case_tables", """SELECT pair_key, case_id AS "MPOG_Case_ID", asa_status AS "ASA_Status", NULL AS "Emergency" FROM case_list
    UNION ALL SELECT pair_key, case_id, NULL, emergency FROM proc_list""", "case_list", "proc_list")
register("s3_mapped_columns", """SELECT scheduled_dt AS date, case_id AS episode_id, CAST(NULL AS VARCHAR) AS anesthesiologist,
    CAST(NULL AS VARCHAR) AS age, CAST(NULL AS VARCHAR) AS emergent, asa_status AS asa, CAST(NULL AS VARCHAR) AS final_anesthesia_type,
    CAST(NULL AS VARCHAR) AS procedure_notes, CAST(NULL AS VARCHAR) AS procedure, CAST(NULL AS VARCHAR) AS services,
    CAST(NULL AS VARCHAR) AS nerve_block_type,
    'Responsible Provider, Age At Encounter, Final Anesthesia Type, Procedure, Services' AS missing_columns FROM case_list""", "case_list")
register("s4_normalized_cases", NORMAL_CASE.format(seq="", source="case_list"), "case_list", "primary_technique")
register("s5_normalized_orphans", NORMAL_ORPHAN.format(seq="", source="proc_list"), "case_list", "proc_list")
register("s6_service_alias", f"""SELECT seq, coalesce(nullif({clean('service_text')}, ''), nullif({clean('procedure')}, ''),
    nullif({clean('file')}, ''), '') AS resolved FROM training_rows""", "training_rows")
register("w1_primary_technique", """SELECT pair_key, case_id AS "MPOG_Case_ID", airway_type AS "Airway_Type",
    airway_details AS "Airway_Details" FROM primary_technique""", "primary_technique")
register("j1_cases_with_technique", """SELECT c.pair_key, c.case_id AS "MPOG_Case_ID", airway_type AS "Airway_Type",
    airway_details AS "Airway_Details" FROM case_list c LEFT JOIN primary_technique p
    ON c.pair_key = p.pair_key AND c.case_id = p.case_id""", "case_list", "primary_technique")
for _name, _not in (("j2_orphan_procedures", "NOT"), ("j3_matched_procedures", "")):
    register(_name, f"""SELECT pair_key, case_id AS "MPOG_Case_ID", seq, procedure_name AS "ProcedureName" FROM proc_list p
        WHERE {_not} EXISTS (SELECT 1 FROM case_list c WHERE c.pair_key = p.pair_key AND c.case_id = p.case_id)""",
        "case_list", "proc_list")
_plain = "trim(regexp_replace(trim(regexp_replace(name, '\\s*\\([^)]+\\)', '', 'g')), '\\s*\"[^\"]+\"\\s*', ' ', 'g'))"
register("j4_roster_match", f"""SELECT name, (SELECT stem FROM available_logs a, (SELECT unnest(tried) AS t,
      generate_subscripts(tried, 1) AS i) u WHERE lower(a.stem) = lower(u.t) ORDER BY i LIMIT 1) AS matched_stem,
    array_to_string(tried, '; ') AS tried
    FROM (SELECT name, list_filter([plain, CASE WHEN len(words) >= 3 THEN words[1] || ' ' || words[-1] END,
      CASE WHEN inside <> '' THEN inside || ' ' || words[-1] END], lambda x: x IS NOT NULL) AS tried FROM
      (SELECT DISTINCT name, {_plain} AS plain, regexp_split_to_array({_plain}, '\\s+') AS words,
       regexp_extract(name, '\\(([^)]+)\\)', 1) AS inside FROM roster))""", "roster", "available_logs")

# --- annotation ---------------------------------------------------------------------

for _name, _columns in {
    "p1_case_dates": "strftime(case_date, '%Y-%m-%d') AS case_date, date_warning",
    "p2_age_bands": "age_category, age_warning",
    "p3_asa_status": "is_emergent AS emergent, asa_text AS asa_physical_status, asa_warning",
    "p4_anesthesia_mapping": "mapped AS mapped_anesthesia, anesthesia_warning",
    "p5_anesthesia_inference": "kind AS anesthesia_type",
    "p6_procedure_category": "category AS rule_category, coalesce(category_warning, '') AS rule_warnings",
    "p7_cardiac_split": "cardiac_category",
    "p8_approach": "approach",
    "p9_pathology": "pathology",
    "p10_family_categories": "vessel_category, intracerebral_category, obgyn_category",
    "p13_monitoring_values": "array_to_string(monitor_values, '; ') AS monitoring",
    "p16_case_confidence": "round(case_confidence, 6) AS confidence_score",
    "p17_block_sites": "block AS nerve_block_type",
    "p18_thoracic_bands": "list_contains(terms, 'T 1-7') AS upper_band, list_contains(terms, 'T 8-12') AS lower_band",
    "p19_unmatched_blocks": "unmatched AS unmatched_block_source",
    "p20_warnings": "array_to_string(warnings, ' | ') AS warnings",
    "m9_rules_only": "category AS procedure_category, 'rules' AS method, CASE WHEN category_warning IS NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS category_confidence",
    "block_routing_of_cases": f"{ROUTE} AS route",
}.items():
    register(_name, f"SELECT seq, {_columns} FROM parsed", "parsed")
for _name, _list in (("p11_airway_findings", "airway"), ("p12_vascular_findings", "vascular")):
    register(_name, f"SELECT seq, f.value AS value, f.confidence AS confidence FROM (SELECT seq, unnest({_list}) AS f FROM parsed)", "parsed")
LOG = """coalesce(short_id, '') AS "Case ID", strftime(case_date, '%m/%d/%Y') AS "Case Date", {provider} AS "Supervisor",
    {age} AS "Age", {procedure} AS "Original Procedure", asa_text AS "ASA Physical Status","""
CASE_LOG = LOG.format(provider="coalesce(provider, '')", age="coalesce(age_category, '')", procedure="coalesce(procedure, '')") + """
    coalesce(kind, '') AS "Anesthesia Type", array_to_string(airway_values, '; ') AS "Airway Management",
    category AS "Procedure Category", array_to_string(vascular_values, '; ') AS "Specialized Vascular Access",
    array_to_string(monitor_values, '; ') AS "Specialized Monitoring Techniques" """


def _phi(text: str) -> str:
    return squeeze(f"replace(coalesce({text}, ''), '[PHI]', '')")


register("p21_case_log", f"SELECT seq, {CASE_LOG} FROM parsed", "parsed")
register("e2_paired_case_log", f"SELECT pair_key, {CASE_LOG} FROM parsed_pairs", "parsed_pairs")
register("p22_standalone_log", f"""SELECT pair_key, {LOG.format(provider=_phi('provider'), age=f"coalesce(age_category, {q(S.ADULT_BAND)})", procedure=_phi('procedure'))}
    category AS "Procedure Category", {_phi('final_anesthesia_type')} AS "Procedure Name", {_phi('block')} AS "Primary Block",
    {_phi('unmatched')} AS "Unmatched Primary Block (Original)" FROM parsed_orphans""", "parsed_orphans")
FLAGS = f"""list_contains(airway_values, {q(T.DOUBLE_LUMEN_NAME)}) AS has_double_lumen_tube,
    CASE WHEN list_contains(airway_values, {q(T.NASAL_ETT_NAME)}) THEN 'Nasal' WHEN list_contains(airway_values, {q(T.ORAL_ETT_NAME)})
    OR list_contains(airway_values, {q(T.DOUBLE_LUMEN_NAME)}) THEN 'Oral' END AS tube_route,
    CASE WHEN kind IN ('GA', 'MAC') THEN kind END AS ga_mac"""
register("p23_airway_flags", f"SELECT seq, {FLAGS} FROM parsed", "parsed")
register("p27_label_normalization", f"SELECT seq, {label('human_category')} AS label, {optional_label('human_category')} AS optional_label FROM review_labels", "review_labels")
register("p28_resident_names", """SELECT DISTINCT pair_key, upper(substr(split_part(pair_key, '_', 2), 1, 1)) ||
    lower(substr(split_part(pair_key, '_', 2), 2)) || ' ' || upper(substr(split_part(pair_key, '_', 1), 1, 1)) ||
    lower(substr(split_part(pair_key, '_', 1), 2)) AS resident, substr(sha256(pair_key), 1, 8) AS resident_id FROM case_list""", "case_list")
register("n1_n7_text_expressions", f"""SELECT seq, {join_distinct('procedure', 'services', 'procedure')} AS joined,
    {provider('anesthesiologist')} AS provider, {attending('anesthesiologist')} AS attending,
    {squeeze("replace('[PHI] ' || procedure || '  [PHI]', '[PHI]', '')")} AS without_phi, {key_of('procedure_notes')} AS key,
    substr(episode_id, 1, 25) AS episode_id, nullif({clean('nerve_block_type')}, '') AS block,
    coalesce(try_cast(asa AS BIGINT), 0) AS asa_number FROM case_table""", "case_table")
register("u4_services_by_row", """SELECT seq, CAST(i - 1 AS INT) AS position, s AS service FROM
    (SELECT seq, unnest(service_list) AS s, generate_subscripts(service_list, 1) AS i FROM parsed_1)""", "parsed_1")
register("u5_findings_table", """SELECT seq, CAST(i - 1 AS INT) AS position, f.value AS value, f.confidence AS confidence,
    f.source_field AS source_field FROM (SELECT seq, unnest(findings) AS f, generate_subscripts(findings, 1) AS i FROM parsed)""", "parsed")

# --- review set ---------------------------------------------------------------------

cte("keyed", """SELECT *, pair_key || '.CaseList.csv:' || coalesce(nullif(short_id, ''), 'row-' || seq) || ':' ||
    substr(coalesce(procedure, ''), 1, 80) AS case_key, coalesce(nullif(short_id, ''), 'row-' || seq) AS review_id,
    upper(concat_ws(chr(10), nullif(procedure, ''), nullif(procedure_notes, ''), nullif(final_anesthesia_type, ''))) AS t,
    upper(array_to_string(warnings, chr(10))) AS w, """ + FLAGS + " FROM parsed", "parsed")


def _case_rx(patterns) -> str:
    return "(" + " OR ".join(f"regexp_matches(t, {q(p)})" for p in patterns) + ")"


_th = has("t", R.THORACIC_HINTS)
_TESTS = [
    ("double_lumen", 12, "predicted_double_lumen", "has_double_lumen_tube"),
    ("double_lumen", 10, "explicit_double_lumen_text", _case_rx(R.DOUBLE_LUMEN_TEXT)),
    ("double_lumen", 6, "thoracic_category", f"category = {q(P.INTRATHORACIC)} AND {_th}"),
    ("double_lumen", 4, "thoracic_procedure_hint", _th),
    ("tube_route", 12, "predicted_nasal_route", "tube_route = 'Nasal'"),
    ("tube_route", 5, "predicted_oral_route", "tube_route = 'Oral'"),
    ("tube_route", 8, "nasal_route_text", has("t", R.NASAL_HINTS)),
    ("tube_route", 3, "oral_route_text", _case_rx(R.ORAL_TEXT)),
    ("ga_mac", 10, "predicted_mac", "ga_mac = 'MAC'"),
    ("ga_mac", 5, "predicted_ga", "ga_mac = 'GA'"),
    ("ga_mac", 8, "mac_note_text", has("t", A.MAC_NOTES)),
    ("ga_mac", 4, "ga_note_text", has("t", A.GA_NOTES)),
    ("ga_mac", 4, "mac_inference_warning", has("w", R.MAC_WARNINGS)),
    ("ga_mac", 3, "ga_inference_warning", has("w", R.GA_WARNINGS)),
    ("ga_mac", 3, "mac_procedure_hint", has("t", A.MAC_PROCEDURES)),
    ("ga_mac", 3, "context_only_ga_mac_inference", "coalesce(final_anesthesia_type, '') = '' AND ga_mac IS NOT NULL"),
]


def _score(bucket: str) -> str:
    return "CAST(" + " + ".join(f"CASE WHEN {c} THEN {v} ELSE 0 END" for b, v, _r, c in _TESTS if b == bucket) + " AS DOUBLE)"


_reasons = ", ".join(f"CASE WHEN {c} THEN {q(r)} END" for _b, _v, r, c in _TESTS)
cte("scored_cases", f"""SELECT *, {_score('double_lumen')} AS s1, {_score('tube_route')} AS s2, {_score('ga_mac')} AS s3,
    list_filter([{_reasons}], lambda x: x IS NOT NULL) AS reasons0 FROM keyed""", "keyed")
_control = "s1 = 0 AND s2 = 0 AND s3 = 0 AND (ga_mac IS NOT NULL OR len(airway) > 0)"
cte("assessed", f"""SELECT *, CASE WHEN {_control} THEN 1 + {hash32('case_key')} / 4294967296.0 ELSE 0 END::DOUBLE AS s4,
    CASE WHEN {_control} THEN ['control'] ELSE list_filter([CASE WHEN s1 > 0 THEN 'double_lumen' END,
      CASE WHEN s2 > 0 THEN 'tube_route' END, CASE WHEN s3 > 0 THEN 'ga_mac' END], lambda x: x IS NOT NULL) END AS targets,
    CASE WHEN {_control} THEN list_append(reasons0, 'negative_control') ELSE reasons0 END AS reasons FROM scored_cases""", "scored_cases")
register("p25_review_scores", """SELECT seq, s1 AS score_double_lumen, s2 AS score_tube_route, s3 AS score_ga_mac,
    round(s4, 6) AS score_control, array_to_string(targets, '; ') AS review_targets,
    array_to_string(reasons, '; ') AS review_reasons FROM assessed""", "assessed")
register("p26_review_records", """SELECT case_key, pair_key || '.CaseList.csv' AS source_file, review_id AS source_case_id,
    strftime(case_date, '%Y-%m-%d') AS case_date, coalesce(procedure, '') AS procedure, category AS procedure_category,
    coalesce(final_anesthesia_type, '') AS raw_anesthesia_type, coalesce(procedure_notes, '') AS procedure_notes,
    coalesce(kind, '') AS predicted_anesthesia_type, coalesce(ga_mac, '') AS predicted_ga_mac,
    coalesce(tube_route, '') AS predicted_tube_route, CASE WHEN has_double_lumen_tube THEN 'Yes' ELSE 'No' END AS predicted_has_double_lumen_tube,
    array_to_string(airway_values, '; ') AS predicted_airway_management, array_to_string(targets, '; ') AS review_targets,
    '' AS priority_bucket, 0.0::DOUBLE AS priority_score, array_to_string(reasons, '; ') AS review_reasons,
    array_to_string(warnings, '; ') AS parsing_warnings, '' AS label_has_double_lumen_tube, '' AS label_ga_mac,
    '' AS label_tube_route, '' AS reviewer_notes FROM assessed""", "assessed")
# 600 cases: quotas 179 + 179 + 179 + 59 after one place each = 180, 180, 180, 60; lists hold four times that.
cte("bucket_scores", """SELECT * FROM (SELECT 'double_lumen' AS bucket, 1 AS place, s1 AS score, seq, case_key FROM assessed
    UNION ALL SELECT 'tube_route', 2, s2, seq, case_key FROM assessed UNION ALL SELECT 'ga_mac', 3, s3, seq, case_key FROM assessed
    UNION ALL SELECT 'control', 4, s4, seq, case_key FROM assessed) WHERE score > 0""", "assessed")
cte("candidates", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket ORDER BY score DESC, seq) AS rank
    FROM bucket_scores) WHERE rank <= CASE bucket WHEN 'control' THEN 240 ELSE 720 END""", "bucket_scores")
register("w3_bucket_candidates", "SELECT bucket, seq, rank FROM candidates", "candidates")
cte("uniques", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY bucket, case_key ORDER BY score DESC, seq) AS dup
    FROM candidates) WHERE dup = 1""", "candidates")
cte("pick1", "SELECT * FROM uniques WHERE bucket = 'double_lumen' ORDER BY score DESC, seq LIMIT 180", "uniques")
cte("pick2", "SELECT * FROM uniques WHERE bucket = 'tube_route' AND case_key NOT IN (SELECT case_key FROM pick1) ORDER BY score DESC, seq LIMIT 180", "uniques", "pick1")
cte("picks12", "SELECT * FROM pick1 UNION ALL SELECT * FROM pick2", "pick1", "pick2")
cte("pick3", "SELECT * FROM uniques WHERE bucket = 'ga_mac' AND case_key NOT IN (SELECT case_key FROM picks12) ORDER BY score DESC, seq LIMIT 180", "uniques", "picks12")
cte("picks123", "SELECT * FROM picks12 UNION ALL SELECT * FROM pick3", "picks12", "pick3")
cte("pick4", "SELECT * FROM uniques WHERE bucket = 'control' AND case_key NOT IN (SELECT case_key FROM picks123) ORDER BY score DESC, seq LIMIT 60", "uniques", "picks123")
cte("picks", "SELECT * FROM picks123 UNION ALL SELECT * FROM pick4", "picks123", "pick4")
cte("backfill", """SELECT * EXCLUDE (b) FROM (SELECT *, row_number() OVER (PARTITION BY case_key ORDER BY score DESC, place) AS b FROM uniques
    WHERE case_key NOT IN (SELECT case_key FROM picks)) WHERE b = 1 ORDER BY score DESC, seq
    LIMIT (SELECT 600 - count(*) FROM picks)""", "uniques", "picks")
cte("selection", "SELECT * FROM picks UNION ALL SELECT * FROM backfill", "picks", "backfill")
register("w5_review_selection", "SELECT case_key, bucket, round(score, 6) AS score, seq FROM selection", "selection")
register("a17_review_bucket_counts", "SELECT bucket AS priority_bucket, count(*) AS cases FROM selection GROUP BY 1", "selection")
register("w4_bucket_quotas", """WITH n AS (SELECT CAST(floor(count(*) / 100) AS BIGINT) AS room FROM case_table),
    b AS (SELECT * FROM n, (VALUES (0, 'double_lumen', 0.3::DOUBLE), (1, 'tube_route', 0.3::DOUBLE), (2, 'ga_mac', 0.3::DOUBLE),
      (3, 'control', 0.1::DOUBLE)) v(place, bucket, weight)),
    e AS (SELECT *, CASE WHEN room >= 4 THEN 1 ELSE 0 END AS base0, (room - CASE WHEN room >= 4 THEN 4 ELSE 0 END) * weight AS exact FROM b)
    SELECT bucket, CAST(base0 + floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, place) <=
      room - 4 * base0 - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS BIGINT) AS quota FROM e""".replace("WITH n", "SELECT * FROM (WITH n", 1) + ")", "case_table")

# --- reports ------------------------------------------------------------------------

MISSING = """list_filter([CASE WHEN coalesce(short_id, '') = '' THEN 'episode_id' END,
    CASE WHEN coalesce(provider, '') = '' THEN 'responsible_provider' END, CASE WHEN coalesce(procedure, '') = '' THEN 'procedure' END,
    CASE WHEN age_category IS NULL THEN 'age_category' END], lambda x: x IS NOT NULL)"""
PROBLEM = "len(warnings) >= 1 OR (case_confidence < 0.4 AND len(warnings) = 0)"
register("f1_problematic_cases", f"SELECT seq FROM parsed WHERE {PROBLEM}", "parsed")
register("f2_low_confidence", "SELECT seq FROM parsed WHERE case_confidence < 0.7", "parsed")
register("f3_missing_fields", f"SELECT seq, array_to_string({MISSING}, ', ') AS missing_fields FROM parsed", "parsed")
register("f4_standalone_routes", f"SELECT pair_key, short_id AS episode_id, seq, {ROUTE} AS route FROM parsed_orphans", "parsed_orphans")
register("a1_validation_summary", """SELECT count(*) AS total_cases, count(*) FILTER (len(warnings) > 0) AS cases_with_warnings,
    count(*) FILTER (case_confidence < 0.7) AS low_confidence_cases, round_even(avg(case_confidence), 3) AS average_confidence FROM parsed""", "parsed")
HIST = "SELECT warning, count(*) AS occurrences, min(seq) AS first_seq FROM (SELECT seq, unnest(warnings) AS warning FROM parsed) GROUP BY 1"
register("a2_warning_histogram", HIST, "parsed")
register("w11_top_warnings", f"{HIST} ORDER BY occurrences DESC, first_seq, warning LIMIT 10", "parsed")
register("w12_first_problems", f"""SELECT seq, short_id AS episode_id, array_to_string({MISSING}, ', ') AS missing_fields,
    greatest((SELECT count(*) FROM parsed WHERE {PROBLEM}) - 20, 0) AS more FROM parsed WHERE {PROBLEM} ORDER BY seq LIMIT 20""", "parsed")
register("a3_missing_field_counts", """SELECT unnest(['episode_id', 'provider', 'procedure', 'age_category']) AS field,
    unnest([count(*) FILTER (coalesce(short_id, '') = ''), count(*) FILTER (coalesce(provider, '') = ''),
    count(*) FILTER (coalesce(procedure, '') = ''), count(*) FILTER (age_category IS NULL)]) AS missing FROM parsed""", "parsed")
register("a4_extraction_rates", "\nUNION ALL ".join(
    f"SELECT '{f}' AS family, count(*) FILTER (len({c}) > 0) AS cases, round_even(count(*) FILTER (len({c}) > 0) / count(*), 3) AS rate FROM parsed"
    for f, c in (("airway", "airway_values"), ("vascular", "vascular_values"), ("monitoring", "monitor_values"))), "parsed")
register("a5_extraction_values", "SELECT family, value, count(*) AS occurrences FROM (" + " UNION ALL ".join(
    f"SELECT '{f}' AS family, unnest({c}) AS value FROM parsed"
    for f, c in (("airway", "airway_values"), ("vascular", "vascular_values"), ("monitoring", "monitor_values"))) + ") GROUP BY 1, 2", "parsed")
register("a6_validation_table", f"""SELECT seq, coalesce(short_id, '') AS "Case ID", CASE WHEN len(warnings) > 0 THEN 'Yes' ELSE 'No' END AS "Has Warnings",
    CAST(len(warnings) AS INT) AS "Warning Count", array_to_string(warnings, '; ') AS "Warnings",
    printf('%.3f', case_confidence) AS "Confidence Score", CASE WHEN case_confidence < 0.7 THEN 'Yes' ELSE 'No' END AS "Low Confidence",
    coalesce(nullif(array_to_string({MISSING}, '; '), ''), 'None') AS "Missing Fields" FROM parsed""", "parsed")
register("a8_output_summary", """SELECT count(*) AS total_cases, strftime(min(case_date), '%m/%d/%Y') || ' to ' || strftime(max(case_date), '%m/%d/%Y') AS date_range,
    count(*) FILTER (coalesce(short_id, '') = '') AS empty_cases, 0::BIGINT AS missing_dates FROM parsed""", "parsed")
register("a11_resident_summary", """SELECT pair_key, coalesce(c.n, 0) AS cases, coalesce(o.n, 0) AS orphans FROM
    (SELECT pair_key, count(*) AS n FROM pair_cases GROUP BY 1) c FULL JOIN
    (SELECT pair_key, count(*) AS n FROM pair_orphans GROUP BY 1) o USING (pair_key)""", "pair_cases", "pair_orphans")
register("u1_union_of_pairs", f"""SELECT pair_key, short_id AS episode_id, category AS procedure_category, 'case' AS kind, NULL AS route FROM parsed_pairs
    UNION ALL SELECT pair_key, short_id, category, 'standalone', {ROUTE} FROM parsed_orphans""", "parsed_pairs", "parsed_orphans")

# --- model decisions ----------------------------------------------------------------

cte("fused_0", f"""SELECT p.seq, p.procedure, category AS rule_category, category_warning, {strip('ml_category')} AS ml, ml_category,
    ml_confidence AS score, human_category, {strip('ml_category')} IN ({', '.join(q(c) for c in P.CATEGORIES)}) AS known
    FROM parsed p JOIN predictions m ON p.seq = m.seq""", "parsed", "predictions")
cte("fused", f"""SELECT *, CASE WHEN known AND score >= 0.85 THEN 'ml_override' WHEN known AND score >= 0.45 AND ml <> rule_category
      AND rule_category = {q(P.OTHER)} THEN 'ml_fill_other' WHEN known AND score >= 0.45 AND ml <> rule_category THEN 'ml_preferred'
      WHEN known AND score >= 0.45 THEN 'ml_rules_agree' ELSE 'rules' END AS method FROM fused_0""", "fused_0")
_conf = "printf('%.2f', score)"
register("m9_hybrid_decision", f"""SELECT seq, CASE WHEN method = 'rules' THEN rule_category ELSE ml END AS procedure_category, method,
    CASE WHEN method <> 'rules' THEN score WHEN category_warning IS NULL THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS category_confidence,
    CASE WHEN method <> 'rules' AND ml <> rule_category THEN rule_category END AS alternative,
    concat_ws(' | ', category_warning, CASE WHEN NOT known THEN 'ML returned invalid category: ' || ml
      WHEN method = 'ml_override' AND ml <> rule_category THEN 'ML override (conf=' || {_conf} || '): rules suggested ' || rule_category
      WHEN method = 'ml_fill_other' THEN 'ML filled uncategorized rule result (conf=' || {_conf} || ')'
      WHEN method = 'ml_preferred' THEN 'ML preferred over rules: ' || ml || ' over ' || rule_category || ' (conf=' || {_conf} || ')' END)
    AS category_warnings FROM fused""", "fused")
cte("compared", f"""SELECT seq, procedure, score AS ml_confidence, rule_category AS rule_prediction, {label('ml_category')} AS ml_prediction,
    CASE WHEN method = 'rules' THEN rule_category ELSE ml END AS hybrid_prediction, {optional_label('human_category')} AS label,
    {label('ml_category')} <> rule_category AS disagreement FROM fused""", "fused")
register("j7_predictions_side_by_side", "SELECT seq, rule_prediction, ml_prediction, hybrid_prediction, label, disagreement FROM compared", "compared")
register("j6_unreviewed_rows", """SELECT seq, ml_prediction, disagreement FROM compared WHERE seq NOT IN
    (SELECT seq FROM review_labels WHERE seq % 3 = 0 AND seq % 2 = 0)""", "compared", "review_labels")
register("f5_disagreements", """SELECT seq, procedure, ml_prediction, rule_prediction, ml_confidence AS confidence, hybrid_prediction, label
    FROM compared WHERE disagreement""", "compared")
_focus = f"procedure IS NOT NULL AND {strip('procedure')} <> '' AND (disagreement OR ml_confidence < 0.7)"
register("f6_review_focus", f"SELECT seq, ml_confidence, disagreement FROM compared WHERE {_focus}", "compared")
register("w10_review_queue", f"SELECT seq, ml_confidence, disagreement FROM compared WHERE {_focus} ORDER BY disagreement DESC, ml_confidence, seq LIMIT 200", "compared")
register("a12_a13_confidence_bins", """SELECT count(*) AS total_cases, count(*) FILTER (ml_confidence >= 0.85) AS high_confidence,
    count(*) FILTER (ml_confidence >= 0.7 AND ml_confidence < 0.85) AS medium_confidence,
    count(*) FILTER (ml_confidence < 0.7) AS low_confidence, count(*) FILTER (NOT disagreement) AS agreement_count FROM compared""", "compared")
register("a14_labeled_accuracy", """SELECT count(*) AS labeled_cases, avg(CAST(rule_prediction = label AS INT)) AS rule_accuracy,
    avg(CAST(ml_prediction = label AS INT)) AS ml_accuracy, avg(CAST(hybrid_prediction = label AS INT)) AS hybrid_accuracy
    FROM compared WHERE label <> ''""", "compared")
register("a15_classification_report", """SELECT category, CASE WHEN predicted > 0 THEN hit / predicted ELSE 0 END::DOUBLE AS precision,
    CASE WHEN support > 0 THEN hit / support ELSE 0 END::DOUBLE AS recall,
    CASE WHEN hit > 0 THEN 2 * (hit / predicted) * (hit / support) / (hit / predicted + hit / support) ELSE 0 END::DOUBLE AS f1, support
    FROM (SELECT c AS category, count(*) FILTER (label = c) AS support, count(*) FILTER (ml_prediction = c) AS predicted,
      count(*) FILTER (label = c AND ml_prediction = c) AS hit FROM (SELECT * FROM compared WHERE label <> '') r,
      (SELECT label AS c FROM compared WHERE label <> '' UNION SELECT ml_prediction FROM compared WHERE label <> '') k GROUP BY 1)""", "compared")
register("a15_confusion_matrix", "SELECT label, " + ", ".join(
    f'count(*) FILTER (ml_prediction = {q(c)}) AS "{c}"' for c in P.CATEGORIES) + " FROM compared WHERE label <> '' GROUP BY 1", "compared")

# --- training tables ----------------------------------------------------------------

cte("training_cases", """SELECT seq, file, service_text, service_text AS services, procedure, CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS age, CAST(NULL AS VARCHAR) AS emergent,
    CAST(NULL AS VARCHAR) AS final_anesthesia_type, CAST(NULL AS VARCHAR) AS episode_id, CAST(NULL AS VARCHAR) AS anesthesiologist,
    CAST(NULL AS VARCHAR) AS nerve_block_type, CAST(NULL AS VARCHAR) AS asa, CAST(NULL AS VARCHAR) AS procedure_notes
    FROM training_rows WHERE procedure IS NOT NULL AND procedure NOT IN ('', 'nan')""", "training_rows")
annotation("training_cases", "trained")
cte("prepared", f"SELECT seq, file, procedure, {clean('service_text')} AS service_text, category AS rule_category, coalesce(category_warning, '') AS warnings FROM trained_8", "trained_8")
register("f7_training_rows", "SELECT seq, file, procedure, service_text, rule_category, warnings FROM prepared", "prepared")
register("a9_category_distribution", "SELECT rule_category, count(*) AS rows, round_even(count(*) * 100.0::DOUBLE / (SELECT count(*) FROM prepared), 1) AS percent FROM prepared GROUP BY 1", "prepared")
register("a10_file_stats", """SELECT file, count(*) AS total_rows, count(*) FILTER (coalesce(procedure, '') NOT IN ('', 'nan')) AS valid_cases,
    count(*) FILTER (coalesce(procedure, '') IN ('', 'nan')) AS dropped_rows FROM training_rows GROUP BY 1""", "training_rows")
_h = hash32("CAST(seq AS VARCHAR) || '|42'")
register("w6_sample_per_file", f"SELECT seq, file FROM (SELECT *, row_number() OVER (PARTITION BY file ORDER BY {_h}, seq) AS rn FROM training_rows) WHERE rn <= 100", "training_rows")
cte("tiers", f"""SELECT *, CASE WHEN s >= 7 THEN 'high' WHEN s >= 3 THEN 'medium' ELSE 'low' END AS tier FROM
    (SELECT *, CASE WHEN warnings <> '' THEN 5 ELSE 0 END + CASE WHEN rule_category <> {q(P.OTHER)} THEN 3 ELSE 0 END +
     CASE WHEN {has('upper(procedure)', M.HIGH_VALUE_WORDS)} THEN 2 ELSE 0 END AS s FROM prepared)""", "prepared")
register("w7_value_sample", f"""SELECT seq, tier FROM (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY {_h}, seq) AS rn FROM tiers)
    WHERE rn <= CASE tier WHEN 'high' THEN 2000 WHEN 'medium' THEN 1200 ELSE 4000 -
      least(2000, (SELECT count(*) FROM tiers WHERE tier = 'high')) - least(1200, (SELECT count(*) FROM tiers WHERE tier = 'medium')) END""", "tiers")
cte("classes", "SELECT rule_category AS label, count(*) AS n, (SELECT count(*) FROM prepared) AS total FROM prepared GROUP BY 1", "prepared")
cte("class_quotas_0", """SELECT *, CAST(ceil(total * 0.2::DOUBLE) AS BIGINT) AS test, n * CAST(ceil(total * 0.2::DOUBLE) AS BIGINT) / total AS exact,
    (SELECT min(n) >= 2 AND floor(max(total) * 0.2::DOUBLE) >= count(*) FROM classes) AS stratify FROM classes""", "classes")
cte("class_quotas", """SELECT *, floor(exact) + CASE WHEN row_number() OVER (ORDER BY exact - floor(exact) DESC, label) <=
    test - sum(floor(exact)) OVER () THEN 1 ELSE 0 END AS quota FROM class_quotas_0""", "class_quotas_0")
cte("parts", f"""SELECT seq, procedure, rule_category, CASE WHEN (stratify AND in_class <= quota) OR (NOT stratify AND in_all <= test)
    THEN 'unseen' ELSE 'seen' END AS part FROM (SELECT *, row_number() OVER (PARTITION BY rule_category ORDER BY {_h}, seq) AS in_class,
    row_number() OVER (ORDER BY {_h}, seq) AS in_all FROM prepared) p JOIN class_quotas c ON p.rule_category = c.label""", "prepared", "class_quotas")
register("w8_seen_unseen_split", "SELECT seq, rule_category, part FROM parts", "parts")
cte("overrides", f"""SELECT procedure_key, override FROM (SELECT {key_of('procedure')} AS procedure_key, {label('human_category')} AS override,
    row_number() OVER (PARTITION BY {key_of('procedure')} ORDER BY seq DESC) AS rn FROM review_labels) WHERE rn = 1 AND procedure_key <> ''""", "review_labels")
register("w2_keep_last_labels", """SELECT procedure, human_category, seq FROM (SELECT *, row_number() OVER (PARTITION BY procedure ORDER BY seq DESC) AS rn
    FROM review_labels WHERE procedure IS NOT NULL) WHERE rn = 1""", "review_labels")
MARKED = """SELECT p.*, o.override, {key} AS procedure_key, o.override IS NOT NULL AS overridden,
    coalesce(p.rule_category <> o.override, false) AS corrected FROM {rows} p LEFT JOIN overrides o ON o.procedure_key = {key}"""
register("j5_override_lookup", f"""SELECT seq, procedure, coalesce(override, rule_category) AS rule_category, procedure_key, overridden, corrected
    FROM ({MARKED.format(key=key_of('p.procedure'), rows='prepared')})""", "prepared", "overrides")
cte("marked", MARKED.format(key=key_of("p.procedure"), rows="parts"), "parts", "overrides")
cte("merged", """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY procedure_key ORDER BY part = 'unseen' DESC, seq DESC) AS rn FROM marked
    WHERE part = 'seen' OR overridden) WHERE rn = 1""", "marked")
register("u2_u3_retrain_rows", """SELECT procedure_key, coalesce(override, rule_category) AS rule_category, corrected, CAST(copy AS INT) AS copy FROM
    (SELECT *, unnest(CASE WHEN corrected THEN [1, 2, 3] ELSE [1] END) AS copy FROM merged)""", "merged")
register("u2_remaining_unseen", "SELECT seq, procedure, rule_category FROM marked WHERE part = 'unseen' AND NOT overridden", "marked")
register("a16_override_summary", """SELECT (SELECT count(*) FILTER (corrected) FROM merged) AS corrected_rows_weighted,
    (SELECT 2 * count(*) FILTER (corrected) FROM merged) AS rows_added_by_weighting,
    (SELECT count(*) + 2 * count(*) FILTER (corrected) FROM merged) AS retrain_rows,
    (SELECT count(*) FROM marked WHERE part = 'seen' AND overridden) AS seen_overrides_applied,
    (SELECT count(*) FROM marked WHERE part = 'unseen' AND overridden) AS unseen_promoted,
    (SELECT count(*) FROM marked WHERE part = 'unseen' AND NOT overridden) AS remaining_eval_rows,
    (SELECT count(*) FROM overrides) AS override_count""", "merged", "marked", "overrides")

# --- contexts, long notes and features ----------------------------------------------

_EACH = "(SELECT seq, unnest(findings) AS f FROM {source})"
register("p14_finding_contexts", f"""SELECT seq, f.value AS value, f.source_field AS source_field, f.context AS context
    FROM {_EACH.format(source='parsed')}""", "parsed")
register("p15_note_corpus_findings", f"""SELECT seq, f.value AS value, f.confidence AS confidence, f.context AS context
    FROM {_EACH.format(source='parsed_notes')}""", "parsed_notes")


def _number(text: str, words) -> str:
    return f"CAST({has(text, words)} AS INT)::DOUBLE"


def feature_columns(version: int) -> str:
    up, length = "upper(p_text)", "floor(length(p_text) / 100)::DOUBLE AS f_length"
    if version == 1:
        named = {n: _number(up, w) for n, w in M.PROCEDURE_FEATURES_V1.items()}
        named["f_cardiac_bypass"] = f"CAST({has(up, ('BYPASS',))} AND {has(up, ('CARDIAC',))} AS INT)::DOUBLE"
        named |= {n: _number("category", w) for n, w in M.CATEGORY_FEATURES_V1.items()}
    else:
        named = {n: _number(up, w) for n, w in M.PROCEDURE_FEATURES_V2.items()}
        named["f_transcatheter_valve"] = f"CAST({has(up, ('TRANSCATHETER',))} AND {has(up, ('VALVE', 'VALVULOPLASTY'))} AS INT)::DOUBLE"
        named |= {n: _number("upper(s_text)", w) for n, w in M.SERVICE_FEATURES_V2.items()}
        named |= {n: _number("upper(category)", w) for n, w in M.CATEGORY_FEATURES_V2.items()}
        named["f_rule_delivery"] = f"CAST(category IN ({q(P.CESAREAN)}, {q(P.VAGINAL_DELIVERY)}) AS INT)::DOUBLE"
    columns = [f"{sql} AS {name}" for name, sql in named.items()]
    return ", ".join([*columns, length, "CAST(category_warning IS NOT NULL AS INT)::DOUBLE AS f_warnings"])


for _version, _service in ((2, clean("service_text")), (1, "''")):
    _source = f"featured_{_version}"
    cte(f"{_source}_in", f"""SELECT seq, {clean('procedure')} AS procedure, {clean('procedure')} AS p_text, {_service} AS s_text, {_service} AS services,
        CAST(NULL AS VARCHAR) AS date, CAST(NULL AS VARCHAR) AS age, CAST(NULL AS VARCHAR) AS emergent,
        CAST(NULL AS VARCHAR) AS final_anesthesia_type, CAST(NULL AS VARCHAR) AS episode_id, CAST(NULL AS VARCHAR) AS anesthesiologist,
        CAST(NULL AS VARCHAR) AS nerve_block_type, CAST(NULL AS VARCHAR) AS asa, CAST(NULL AS VARCHAR) AS procedure_notes
        FROM training_rows""", "training_rows")
    annotation(f"{_source}_in", _source)
    register("m3_structured_features" + ("" if _version == 2 else "_v1"), f"SELECT seq, {feature_columns(_version)} FROM {_source}_8", f"{_source}_8")

# --- written files ------------------------------------------------------------------

register("s2_scanned_case_tables", """SELECT pair_key, case_id AS "MPOG_Case_ID", nullif(asa_status, '') AS "ASA_Status", NULL AS "Emergency", NULL AS "Details"
    FROM case_list UNION ALL SELECT pair_key, case_id, NULL, nullif(emergency, ''), nullif(details, '') FROM proc_list""", "case_list", "proc_list")
_RESIDENT = """upper(substr(split_part(pair_key, '_', 2), 1, 1)) || lower(substr(split_part(pair_key, '_', 2), 2)) || ' ' ||
    upper(substr(split_part(pair_key, '_', 1), 1, 1)) || lower(substr(split_part(pair_key, '_', 1), 2))"""
register("s7_written_case_logs", f"SELECT {_RESIDENT} AS resident, {CASE_LOG} FROM parsed_pairs", "parsed_pairs")
register("s8_format_metadata", f"""SELECT count(*) AS rows, count(DISTINCT {_RESIDENT}) AS residents, {q(S.FORMAT_VERSIONS['standalone'])} AS version,
    'standalone' AS format_type FROM pair_orphans""", "pair_orphans")
register("s9_saved_training_rows", "SELECT seq, rule_category, warnings FROM prepared", "prepared")
_LINE = " || ',' || ".join(
    f"CASE WHEN {c} IS NULL THEN '' ELSE '\"' || {c} || '\"' END"
    for c in ("case_id", "scheduled_dt", "patient_age", "asa_status", "procedure_text", "attendings"))
register("p24_quarantined_rows", f"""SELECT pair_key, CASE WHEN seq % 50 NOT IN (0, 20) THEN case_id END AS case_id,
    CASE seq % 50 WHEN 0 THEN {_LINE} || ',"two cells",more' WHEN 20 THEN case_id || ',"left open' WHEN 10 THEN 'short' ELSE nullif(scheduled_dt, '') END AS text,
    CASE WHEN seq % 50 IN (0, 20) THEN 'Failed to process row: malformed record' ELSE '' END AS warning FROM case_list""", "case_list")
_NONE = {
    "section": "NULL", "name": "NULL", "value": "NULL", "n": "CAST(NULL AS BIGINT)", "cases_with_warnings": "CAST(NULL AS BIGINT)",
    "low_confidence_cases": "CAST(NULL AS BIGINT)", "has_warnings": "CAST(NULL AS BOOLEAN)", "is_low_confidence": "CAST(NULL AS BOOLEAN)",
    "score": "CAST(NULL AS DOUBLE)", "warnings": "NULL", "missing_fields": "NULL",
}


def _section(section: str, source: str, **fields: str) -> str:
    columns = {**_NONE, "section": q(section), **fields}
    return "SELECT " + ", ".join(f"{sql} AS {name}" for name, sql in columns.items()) + f" FROM ({source})"


register("a7_json_report", "\nUNION ALL ".join([
    _section("summary", _BODIES["a1_validation_summary"], n="total_cases", cases_with_warnings="cases_with_warnings",
             low_confidence_cases="low_confidence_cases", score="average_confidence"),
    _section("warning_types", HIST, name="warning", n="occurrences"),
    _section("missing_fields", _BODIES["a3_missing_field_counts"], name="field", n="missing"),
    _section("extraction_rate", _BODIES["a4_extraction_rates"], name="family", n="cases", score="rate"),
    _section("extraction_values", _BODIES["a5_extraction_values"], name="family", value="value", n="occurrences"),
    _section("problematic_cases", f"SELECT * FROM parsed WHERE {PROBLEM}", name="short_id", n="CAST(len(warnings) AS BIGINT)", has_warnings="len(warnings) > 0",
             is_low_confidence="case_confidence < 0.7", score="round(case_confidence, 6)", warnings="array_to_string(warnings, ' | ')",
             missing_fields=f"array_to_string({MISSING}, ', ')"),
]), "parsed")

# --- text vectors and votes ---------------------------------------------------------

cte("vectored", "SELECT seq, p_text || CASE WHEN s_text <> '' THEN ' SERVICES ' || s_text ELSE '' END AS text FROM featured_2_in", "featured_2_in")
_STOPS = ", ".join(q(word) for word in M.STOP_WORDS)
cte("word_tokens", rf"SELECT seq, list_filter(regexp_extract_all(lower(text), '\w\w+'), lambda x: x NOT IN ({_STOPS})) AS w FROM vectored", "vectored")
_RUNS = "list_transform(range(1, len(w) - {n} + 2), lambda i: array_to_string(w[i:i + {n} - 1], ' '))"
_GRAMS = "list_transform(range(1, length(c) - {n} + 2), lambda i: substr(c, i, {n}))"
cte("word_all", "SELECT seq, unnest(flatten([" + ", ".join(_RUNS.format(n=n) for n in M.WORD_NGRAMS) + "])) AS term FROM word_tokens", "word_tokens")
cte("char_all", "SELECT seq, unnest(flatten([" + ", ".join(_GRAMS.format(n=n) for n in M.CHAR_NGRAMS)
    + r"])) AS term FROM (SELECT seq, lower(regexp_replace(text, '\s\s+', ' ', 'g')) AS c FROM vectored)", "vectored")
for _kind, _size in (("word", M.WORD_FEATURES), ("char", M.CHAR_FEATURES)):
    cte(f"{_kind}_counts", f"SELECT seq, term, count(*) AS n FROM {_kind}_all GROUP BY seq, term", f"{_kind}_all")
    cte(f"{_kind}_vocabulary", f"""SELECT term, row_number() OVER (ORDER BY total DESC, term) AS place,
        ln(((SELECT count(*) FROM vectored) + 1) / (df + 1)::DOUBLE) + 1 AS weight FROM (SELECT term, sum(n) AS total, count(*) AS df FROM {_kind}_counts
        GROUP BY term HAVING count(*) >= {M.MIN_DOC_FREQ} ORDER BY total DESC, term LIMIT {_size})""", f"{_kind}_counts", "vectored")
    cte(f"{_kind}_vectors", f"""SELECT seq, string_agg(CAST(CAST(round(v / norm * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY place) AS shown FROM
        (SELECT seq, place, n * weight AS v, sqrt(sum(n * weight * n * weight) OVER (PARTITION BY seq)) AS norm
         FROM {_kind}_counts JOIN {_kind}_vocabulary USING (term)) GROUP BY seq""", f"{_kind}_counts", f"{_kind}_vocabulary")
_SHOWN = " || ',' || ".join(f"CAST(CAST(round({name} * 1000000) AS BIGINT) AS VARCHAR)" for name in structured_names())
register("m1_m4_text_vectors", f"""SELECT seq, coalesce(w.shown, '') AS word_vector, coalesce(c.shown, '') AS char_vector, {_SHOWN} AS structured
    FROM (SELECT seq, {feature_columns(2)} FROM featured_2_8) f LEFT JOIN word_vectors w USING (seq) LEFT JOIN char_vectors c USING (seq)""",
    "featured_2_8", "word_vectors", "char_vectors")


def _given(times: int, plus: int) -> str:
    raw = [f"((seq * {k + times} + {plus * k}) % 97 + 1)" for k in range(len(P.CATEGORIES))]
    return "list_transform([" + ", ".join(raw) + f"], lambda x: x::DOUBLE / ({' + '.join(raw)}))"


_CLASSES = "[" + ", ".join(q(c) for c in P.CATEGORIES) + "]"
cte("voted", f"""SELECT seq, list_transform(list_zip({_given(3, 7)}, {_given(5, 11)}), lambda p: (p[1] + p[2]) / 2) AS p FROM predictions""", "predictions")
cte("ranked_classes", f"""SELECT seq, c, v, row_number() OVER (PARTITION BY seq ORDER BY v DESC, c) AS rank, list_position(p, list_max(p)) AS best, list_max(p) AS most
    FROM (SELECT seq, p, unnest(p) AS v, unnest({_CLASSES}) AS c FROM voted)""", "voted")
register("m6_w9_votes_and_top_classes", f"""SELECT seq, ({_CLASSES})[any_value(best)] AS ml_category, round(any_value(most), 6) AS ml_confidence,
    string_agg(c, ' | ' ORDER BY rank) AS top_classes, string_agg(CAST(CAST(round(v * 1000000) AS BIGINT) AS VARCHAR), ',' ORDER BY rank) AS top_probabilities
    FROM ranked_classes WHERE rank <= 3 GROUP BY seq""", "ranked_classes")

# --- keys of cases without an id ----------------------------------------------------

_FIELDS = ", ".join(
    f"CASE WHEN {c} IS NOT NULL THEN '\"{c}\":' || to_json({c}) END"
    for c in sorted((*S.COLUMN_MAP, "seq", "pair_key", "source_file")))
register("p26_case_keys", f"""SELECT seq, source_file || ':' || coalesce(nullif(episode_id, ''), 'missing-case-id-' ||
    substr(sha256('{{' || concat_ws(',', {_FIELDS}) || '}}'), 1, 8)) || ':' || substr(coalesce(procedure, ''), 1, 80) AS case_key
    FROM (SELECT *, pair_key || '.CaseList.csv' AS source_file FROM case_table)""", "case_table")
