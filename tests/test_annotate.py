"""Parsed cases: dates, ages, ASA, anesthesia type, categories, findings, blocks."""

import pytest

from vaporlog.operators.basics import parse_dates
from vaporlog.functions.matching import FLAGS, guard_words, literal, required_word, searched
from vaporlog.operators import blocks, project
from vaporlog.operators.annotate import annotate
from vaporlog.rules import techniques as T

FULL = {
    "date": "08/27/2025", "episode_id": "12345", "anesthesiologist": "Dr. Smith, MD", "age": "45.0", "asa": "2",
    "emergent": "N", "final_anesthesia_type": "General", "procedure": "Hip Replacement", "services": "ORTHO\nTRAUMA",
    "procedure_notes": "Intubated with ETT. Arterial line and central line placed. TEE used.",
}


def parsed(case_frame, *rows):
    return annotate(case_frame(*[{**FULL, **row} for row in rows])).orderBy("seq").collect()


def test_full_case(case_frame):
    row = parsed(case_frame, {})[0]
    assert str(row.case_date) == "2025-08-27"
    assert row.responsible_provider == "Dr. Smith"
    assert row.age_category == "d. >= 12 yr. and < 65 yr."
    assert row.anesthesia_type == "GA"
    assert row.services == ["ORTHO", "TRAUMA"]
    assert row.airway_management == ["Oral ETT"]
    assert row.vascular_access == ["Arterial Catheter", "Central Venous Catheter"]
    assert row.monitoring == ["TEE"]
    assert row.parsing_warnings == []
    assert row.confidence_score == pytest.approx(0.5)


def test_dates(case_frame):
    rows = parsed(case_frame, {"date": None}, {"date": "2024-02-03 10:00:00"}, {"date": "1/5/2025"}, {"date": "soon"},
                  {"date": "13/45/2020"}, {"date": "2024-02-03T10:00:00.123"}, {"date": "2024-02-03 23:00:00-05:00"})
    assert [str(r.case_date) for r in rows] == [
        "2025-01-01", "2024-02-03", "2025-01-05", "2025-01-01", "2025-01-01", "2024-02-03", "2024-02-04"
    ]
    assert rows[0].parsing_warnings == ["Missing date value, using default year 2025"]
    assert rows[3].parsing_warnings == ["Could not parse date 'soon', using default year 2025"]
    assert rows[4].parsing_warnings == ["Could not parse date '13/45/2020', using default year 2025"]


@pytest.mark.filterwarnings("ignore")
def test_ages(case_frame):
    values = ["0.1", "0.25", "3", "12", "64.9", "65", "-1", "130", None, "abc", "nan"]
    rows = parsed(case_frame, *[{"age": v} for v in values])
    assert [(r.age_category or "-")[0] for r in rows] == list("abcddeae---")
    assert rows[6].parsing_warnings == ["Age -1.0 is outside expected range (0-120)"]
    assert rows[7].parsing_warnings == ["Age 130.0 is outside expected range (0-120)"]
    assert rows[8].parsing_warnings == ["Missing age value"]
    assert rows[9].parsing_warnings == ["Invalid age value: abc"]
    assert rows[10].parsing_warnings == []


def test_asa(case_frame):
    rows = parsed(case_frame, {"emergent": "Y"}, {"asa": "3E", "emergent": "E"}, {"asa": None, "emergent": "1"},
                  {"emergent": "1.0"})
    assert [r.asa_physical_status for r in rows] == ["2E", "3E", "E", "2"]
    assert rows[0].parsing_warnings == ["Added 'E' to ASA status based on emergent flag"]


def test_anesthesia_inference(case_frame):
    blank = {"final_anesthesia_type": None}
    rows = parsed(
        case_frame,
        {**blank},
        {**blank, "procedure_notes": "Conscious sedation given"},
        {**blank, "procedure_notes": "General anesthesia"},
        {**blank, "procedure": "Colonoscopy", "procedure_notes": "ok"},
        {**blank, "procedure": "Cesarean", "services": "OBGYN", "procedure_notes": "ok"},
        {**blank, "procedure_notes": "ok"},
        {"final_anesthesia_type": "Topical", "procedure_notes": "ok"},
    )
    assert [r.anesthesia_type for r in rows] == ["GA", "MAC", "GA", "MAC", None, "GA", "GA"]
    assert rows[6].parsing_warnings[0] == "Unrecognized anesthesia type: Topical"


def test_categories(case_frame):
    cases = {
        ("CABG", "CARDSURG"): "Cardiac with CPB",
        ("Off-pump CABG", "CARDIAC"): "Cardiac without CPB",
        ("TAVR", ""): "Cardiac without CPB",
        ("Craniotomy tumor", "NEURO"): "Intracerebral Nonvascular (open)",
        ("Craniotomy aneurysm clipping", "NEURO"): "Intracerebral Vascular (open)",
        ("Endovascular coiling", "NEURO"): "Intracerebral (endovascular)",
        ("Lumbar spine fusion", "NEURO"): "Other (procedure cat)",
        ("VATS lobectomy", "THORACIC"): "Intrathoracic non-cardiac",
        ("EVAR", "VASC"): "Procedures on major vessels (endovascular)",
        ("Open aortic repair", ""): "Procedures on major vessels (open)",
        ("C-section", "OBGYN"): "Cesarean del",
        ("Labor epidural", ""): "Vaginal del",
        ("Hip", "nan"): "Other (procedure cat)",
    }
    rows = parsed(case_frame, *[{"procedure": p, "services": s} for p, s in cases])
    assert [r.procedure_category for r in rows] == list(cases.values())


def test_several_categories_warn(case_frame):
    row = parsed(case_frame, {"procedure": "CABG", "services": "CARDIAC\nVASC"})[0]
    assert row.procedure_category == "Cardiac with CPB"
    assert row.parsing_warnings == [
        "Multiple procedure categories detected for services ['CARDIAC', 'VASC']: "
        "['Cardiac with CPB', 'Procedures on major vessels (open)']. Using first: Cardiac with CPB"
    ]


def test_airway_findings(case_frame):
    notes = {
        "Nasal intubation with Glidescope": ["Nasal ETT", "Video Laryngoscope"],
        "DLT placed": ["Oral ETT", "Double Lumen Tube"],
        "Miller blade": [],
        "LMA placed": ["Supraglottic Airway"],
        "Mask then LMA": ["Supraglottic Airway"],
        "LMA then mask": ["Supraglottic Airway", "Mask"],
        "mask\nLMA": ["Supraglottic Airway", "Mask"],
        "Difficult airway": ["Difficult Airway"],
        "Laryngeal mask": ["Supraglottic Airway", "Mask"],
    }
    rows = parsed(case_frame, *[{"procedure_notes": n} for n in notes])
    assert [r.airway_management for r in rows] == list(notes.values())


def test_confidence_and_context(case_frame):
    rows = parsed(
        case_frame,
        {"procedure_notes": "Nasal ETT. No complications"},
        {"procedure_notes": None},
        {"procedure_notes": "calm"},
        {"procedure_notes": "x" * 60 + " \U0001f600 ETT " + "y" * 60},
    )
    finding = rows[0].extraction_findings[0]
    assert finding.value == "Nasal ETT" and finding.confidence == pytest.approx(0.3)
    assert rows[1].confidence_score == 0.7
    assert rows[1].parsing_warnings == ["No procedure notes available for extraction"]
    assert rows[2].confidence_score == 0.9
    assert rows[3].extraction_findings[0].context == "x" * 47 + " \U0001f600 ETT " + "y" * 49


def test_monitoring_of_procedure_counts_twice(case_frame):
    row = parsed(case_frame, {"procedure_notes": "TEE", "procedure": "TEE and lumbar drain"})[0]
    assert row.monitoring == ["TEE", "CSF Drain"]
    assert [f.source_field for f in row.extraction_findings] == ["procedure_notes", "procedure", "procedure"]


def test_block_sites(case_frame):
    cases = [
        ("Femoral + adductor canal", None, None, "Adductor Canal; Femoral", None),
        ("T4-6", None, None, "T 1-7", None),
        ("T6 to T10", None, None, "T 1-7; T 8-12", None),
        ("thoracic epidural", None, None, "T 1-7; T 8-12", None),
        (None, "Spinal", "femoral fracture", "Lumbar", None),
        ("lumbar plexus", None, None, "Lumbar Plexus; Lumbar", None),
        ("PNB", None, None, "Other - peripheral nerve blockade site", "PNB"),
        ("Odd site", None, None, "Odd site", "Odd site"),
        ("nan", None, None, None, "nan"),
        ("block", None, "ISB done", "Interscalene", None),
    ]
    rows = parsed(case_frame, *[
        {"nerve_block_type": b, "final_anesthesia_type": t, "procedure_notes": n} for b, t, n, _, _ in cases
    ])
    assert [r.nerve_block_type for r in rows] == [c[3] for c in cases]
    assert [r.unmatched_block_source for r in rows] == [c[4] for c in cases]


def test_routes(case_frame):
    names = ["Peripheral nerve block", "Labor Epidural", "CSE", "Something"]
    frame = annotate(case_frame(*[{"final_anesthesia_type": n} for n in names]))
    routes = [r.route for r in blocks.route_standalone(frame).orderBy("seq").collect()]
    assert routes == ["block", "neuraxial", "neuraxial", "neuraxial"]


def test_projections(case_frame):
    frame = annotate(case_frame({**FULL, "procedure": "Hip [PHI]  x"}))
    log = project.case_log(frame).first()
    assert log["Case Date"] == "08/27/2025" and log["Specialized Vascular Access"] == "Arterial Catheter; Central Venous Catheter"
    assert project.standalone_log(frame).first()["Original Procedure"] == "Hip x"
    flags = project.airway_flags(frame).first()
    assert (flags.has_double_lumen_tube, flags.tube_route, flags.ga_mac) == (False, "Oral", "GA")


def test_required_words_occur_in_every_match():
    assert required_word(r"\bintubat(ed|ion|e)?\b") == "intubat"
    assert required_word(r"\b(tube|ett)\s+(placed|inserted)\b") is None
    assert required_word(r"\bA-?line\b") == "line"
    assert required_word(T.MASK[0]) == "mask"


def test_filters_do_not_blow_up_the_plan(case_frame):
    frame = annotate(case_frame(FULL)).filter("size(parsing_warnings) = 0 AND confidence_score < 0.9")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RLIKE") < 400
    assert frame.count() == 1


def test_zoned_dates_are_days_in_utc(spark, case_frame):
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        rows = case_frame({"date": "2025-01-01T02:00:00Z"}, {"date": "2025-01-01 23:30:00-05:00"}, {"date": "2025-01-01 02:00:00"}, {"date": "x"})
        days = [str(r.case_date) for r in parse_dates(rows).orderBy("seq").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    assert days[:3] == ["2025-01-01", "2025-01-02", "2025-01-01"]


def test_contexts_are_cut_out_only_on_demand(case_frame):
    """Warnings, categories and scores need no text around a finding; the searches for it are not in their plans."""
    cases = annotate(case_frame(FULL))
    assert "regexp_extract(procedure_notes" in cases.select("extraction_findings")._jdf.queryExecution().optimizedPlan().toString()
    for name in ("parsing_warnings", "confidence_score", "airway_management", "monitoring"):
        assert "regexp_extract(procedure_notes" not in cases.select(name)._jdf.queryExecution().optimizedPlan().toString()


def test_unmatched_block_sources(case_frame):
    """The raw block text stays where it names nothing, or only a block in general."""
    texts = ["Femoral; ESP", "nerve block", "Unknown", "; ;", "Femoral nerve block T4-6", "", None]
    rows = parsed(case_frame, *[{"nerve_block_type": t, "procedure_notes": "calm"} for t in texts])
    assert [r.unmatched_block_source for r in rows] == [None, "nerve block", "Unknown", "; ;", None, "", None]


def test_quick_searches_find_the_same(spark):
    """A look at the first letters changes no match, also for letters that fold to or from others."""
    patterns = [p for pack in vars(T).values() if isinstance(pack, tuple) for p in pack]
    assert searched(r"\b(tube|ett)\s+(placed|inserted)\b").startswith("(?=[te])") and searched(r"\bA-?line\b").startswith("(?=[A])")
    assert searched(r"a|\bb") == "a|\\bb" and searched(r"\bx?y") == r"\bx?y" and searched(r"\bETT|b") == r"\bETT|b"
    texts = ["no ETT", "ett", "xETT", "\u017fupraglottic", "\u017fwan ganz", "\u212aing vision", "\u0130J line", "\u0131-gel", "I-GEL", "mac 3", "tube inserted", "A line\nDL"]
    frame = spark.createDataFrame([(t,) for t in texts], "t string")
    same = " AND ".join(f"regexp_instr(t, {literal(FLAGS + p)}) = regexp_instr(t, {literal(FLAGS + searched(p))})" for p in patterns)
    assert frame.filter(same).count() == len(texts)


def test_guards_hold_for_alternatives():
    assert guard_words(r"\bintubat(ed|ion|e)?\b") == ["intubat"]
    assert guard_words(r"\b(tube|ett)\s+(placed|inserted)\b") == ["placed", "inserted"]
    assert guard_words(r"\b(tube|ett)\s+(placed|inserted)?\b") == ["tube", "ett"]
    assert guard_words(r"\b(?:t|thoracic)\s*\d") == []


def test_scores_and_values_need_no_interpreted_lists(case_frame):
    """Without contexts, findings are plain expressions that Spark compiles; lists of structs would be interpreted."""
    cases = annotate(case_frame(FULL))
    for name in ("confidence_score", "airway_management", "vascular_access", "monitoring"):
        assert "named_struct" not in cases.select(name)._jdf.queryExecution().optimizedPlan().toString()
