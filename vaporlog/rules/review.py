"""Review-set scoring words, bucket weights and column layout.

Fixed values: order of buckets and columns, points and words define the result.
"""

BUCKETS = ("double_lumen", "tube_route", "ga_mac", "control")
BUCKET_WEIGHTS = {"double_lumen": 0.3, "tube_route": 0.3, "ga_mac": 0.3, "control": 0.1}

THORACIC_HINTS = (
    "THORAC",
    "PNEUMONECTOMY",
    "ESOPHAGECTOMY",
    "VATS",
    "MEDIASTIN",
    "LUNG",
    "CHEST",
    "WEDGE RESECTION",
    "THYMECTOMY",
)
NASAL_HINTS = (
    "NASAL",
    "NASOTRACHEAL",
    "SINUS",
    "SEPT",
    "RHINO",
    "MAXILLO",
    "LEFORT",
    "ORTHOGNATH",
    "ADENOID",
)
MAC_WARNINGS = (
    "INFERRED MAC FROM NOTE TEXT",
    "INFERRED MAC FROM PROCEDURE TYPE",
)
GA_WARNINGS = (
    "INFERRED GENERAL ANESTHESIA FROM NOTE TEXT",
    "INFERRED GENERAL ANESTHESIA FROM AIRWAY MANAGEMENT FINDINGS",
)
# Case-sensitive patterns on upper-cased text.
DOUBLE_LUMEN_TEXT = (
    r"\bDOUBLE[- ]LUMEN(\s+(TUBE|ETT))?\b",
    r"\bDLT\b",
    r"\bBRONCHIAL\s+BLOCKER\b",
)
ORAL_TEXT = (
    r"\bORAL\s+ETT\b",
    r"\bORAL\s+INTUB",
    r"\bOROTRACHEAL\b",
)

REVIEW_COLUMNS = (
    "case_key",
    "source_file",
    "source_case_id",
    "case_date",
    "procedure",
    "procedure_category",
    "raw_anesthesia_type",
    "procedure_notes",
    "predicted_anesthesia_type",
    "predicted_ga_mac",
    "predicted_tube_route",
    "predicted_has_double_lumen_tube",
    "predicted_airway_management",
    "review_targets",
    "priority_bucket",
    "priority_score",
    "review_reasons",
    "parsing_warnings",
    "label_has_double_lumen_tube",
    "label_ga_mac",
    "label_tube_route",
    "reviewer_notes",
)
DEFAULT_MAX_CASES = 600
