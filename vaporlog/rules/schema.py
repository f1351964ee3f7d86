"""Column layouts and output formats.

Fixed values: every name, order and default below is part of the file formats.
"""

# Logical name -> physical column of a case table.
COLUMN_MAP = {
    "date": "Date",
    "episode_id": "Episode ID",
    "anesthesiologist": "Responsible Provider",
    "age": "Age At Encounter",
    "emergent": "Emergent",
    "asa": "ASA",
    "final_anesthesia_type": "Final Anesthesia Type",
    "procedure_notes": "Procedure Notes",
    "procedure": "Procedure",
    "services": "Services",
    "nerve_block_type": "Nerve Block Type",
}

# Columns whose absence is reported (processing goes on with nulls).
REQUIRED_COLUMNS = (
    "date",
    "episode_id",
    "anesthesiologist",
    "age",
    "asa",
    "final_anesthesia_type",
    "procedure",
    "services",
)

# CaseList export column -> logical column.
CASE_LIST_COLUMNS = {
    "MPOG_Case_ID": "episode_id",
    "AIMS_Scheduled_DT": "date",
    "AIMS_Patient_Age_Years": "age",
    "ASA_Status": "asa",
    "AIMS_Actual_Procedure_Text": "procedure",
    "Airway_Type": "final_anesthesia_type",
}

# ProcedureList export column -> logical column, for procedures without a case.
ORPHAN_COLUMNS = {
    "MPOG_Case_ID": "episode_id",
    "AIMS_Scheduled_DT": "date",
    "ASA_Status": "asa",
    "Emergency": "emergent",
    "ProcedureName": "final_anesthesia_type",
    "PrimaryBlock": "nerve_block_type",
    "AIMS_Actual_Procedure_Text": "procedure",
}

DEFAULT_ORPHAN_AGE = 30
DEFAULT_YEAR = 2025
EPISODE_ID_LENGTH = 25

# Invasiveness of a procedure name; names not listed rank 0.
TECHNIQUE_RANK = {
    "Intubation complex": 6,
    "Intubation routine": 5,
    "Spinal": 4,
    "Epidural": 3,
    "LMA": 2,
    "Peripheral nerve block": 1,
}
DETAIL_MIN_RANK = 2

CASE_LOG_COLUMNS = (
    "Case ID",
    "Case Date",
    "Supervisor",
    "Age",
    "Original Procedure",
    "ASA Physical Status",
    "Anesthesia Type",
    "Airway Management",
    "Procedure Category",
    "Specialized Vascular Access",
    "Specialized Monitoring Techniques",
)

STANDALONE_COLUMNS = (
    "Case ID",
    "Case Date",
    "Supervisor",
    "Age",
    "Original Procedure",
    "ASA Physical Status",
    "Procedure Category",
    "Procedure Name",
    "Primary Block",
    "Unmatched Primary Block (Original)",
)

FORMAT_VERSIONS = {"caselog": "1", "standalone": "2"}

# Text that stands for "missing" in a CSV cell.
CSV_MISSING = (
    "",
    "#N/A",
    "#N/A N/A",
    "#NA",
    "-1.#IND",
    "-1.#QNAN",
    "-NaN",
    "-nan",
    "1.#IND",
    "1.#QNAN",
    "<NA>",
    "N/A",
    "NA",
    "NULL",
    "NaN",
    "None",
    "n/a",
    "nan",
    "null",
)

# Text that stands for "missing" in free text, in services (upper case) and in labels (lower case).
TEXT_MISSING = ("", "<NA>", "nan", "NaN", "None")
SERVICE_MISSING = ("", "<NA>", "NAN", "NONE")
LABEL_MISSING = ("", "<na>", "nan", "none")

SERVICE_CANDIDATES = ("service_text", "services", "service", "Service", "Services")
PROCEDURE_CANDIDATES = ("AIMS_Actual_Procedure_Text", "procedure")
TRAINING_COLUMNS = {"age": "AIMS_Patient_Age_Years", "asa": "ASA_Status", "emergency": "Emergency"}
LABEL_CANDIDATES = (
    "human_category",
    "category",
    "label",
    "review_label",
    "correct_category",
)

# Accepted date layouts: shape of the text, layout of the parser.
DATE_LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}$", "yyyy-MM-dd HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2} \d{2}:\d{2}$", "yyyy-MM-dd HH:mm"),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}$", "yyyy-MM-dd'T'HH:mm:ss"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}\.\d{1,6}$", "yyyy-MM-dd[ ]['T']HH:mm:ss.[SSSSSS][SSSSS][SSSS][SSS][SS][S]"),
    (r"^\d{4}-\d{2}-\d{2}[ T]\d{2}:\d{2}:\d{2}(Z|[+-]\d{2}:\d{2})$", "yyyy-MM-dd[ ]['T']HH:mm:ssXXX"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", "M/d/yyyy H:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", "M/d/yyyy H:mm:ss"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{8}$", "yyyyMMdd"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
)

# Age bands: (exclusive upper bound in years, label). The last band has no bound.
AGE_BANDS = (
    (0.25, "a. < 3 months"),
    (3.0, "b. >= 3 mos. and < 3 yr."),
    (12.0, "c. >= 3 yr. and < 12 yr."),
    (65.0, "d. >= 12 yr. and < 65 yr."),
    (float("inf"), "e. >= 65 year"),
)
ADULT_BAND = "d. >= 12 yr. and < 65 yr."

EMERGENT_FLAGS = ("E", "Y", "YES", "TRUE", "1")
