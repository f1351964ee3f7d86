"""Clinical input views derived from the supplied tables.

The supplied tables hold no clinical text, so phrases are attached to whole tables by key
arithmetic. Every view is one SQL text that both Spark and DuckDB run, and every row of
the base table becomes a row of the view.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


NL = "' || chr(10) || '"


def pick(key: str, values) -> str:
    """A CASE that picks a literal by key arithmetic; None gives NULL."""
    arms = " ".join(
        f"WHEN {i} THEN " + ("CAST(NULL AS STRING)" if v is None else "'" + v.replace("\n", NL) + "'")
        for i, v in enumerate(values)
    )
    return f"(CASE ({key}) % {len(values)} {arms} END)"


TECHNIQUES = (
    "General", "GETA", "MAC", "Spinal", "Epidural", "CSE", "Monitored anesthesia care",
    "Conscious sedation", None, "Intubation routine", "Intubation complex", "LMA",
    "Peripheral nerve block", "Regional", "general endotracheal", "Labor Epidural", "",
    "Double-lumen tube", "Topical", None, "Local only",
)
PROCEDURES = (
    "CABG x3 with cardiopulmonary bypass", "Off-pump coronary artery bypass", "TAVR transfemoral",
    "Transcatheter mitral valve repair", "Aortic valve replacement", "Heart transplant",
    "Removal ventricular assist device", "Craniotomy for tumor resection", "Craniotomy for aneurysm clipping",
    "Endovascular coiling of cerebral aneurysm", "Burr hole evacuation of subdural hematoma",
    "Craniectomy for AVM hemorrhage", "Lumbar laminectomy and fusion", "Cervical discectomy",
    "VATS lobectomy", "Thoracotomy with wedge resection", "Bronchoscopy and thoracentesis",
    "Esophagectomy", "Carotid endarterectomy", "Endovascular aortic aneurysm repair EVAR",
    "Open repair of abdominal aortic aneurysm", "Femoral-popliteal bypass graft",
    "Percutaneous angioplasty iliac artery", "Mechanical thrombectomy", "Pacemaker insertion",
    "Cesarean delivery", "Repeat C-section", "Labor epidural", "Vaginal delivery", "Hysteroscopy",
    "Dilation and curettage", "Colonoscopy", "Cystourethroscopy with stent", "Total hip arthroplasty",
    "Knee arthroscopy", None, "", "Laparoscopic cholecystectomy", "Robotic prostatectomy",
    "TEE guided cardioversion with SSEP", "Ventriculostomy with ICP monitor", "Liver transplant",
    "ECMO cannulation", "Prostate needle biopsy", "Nasal septoplasty", "LeFort osteotomy",
    "Embolization of arteriovenous malformation", "Thymectomy", "Valvuloplasty transcatheter",
    "Intracranial mass excision", "Microvascular free flap angiogram", "Vasectomy",
    "Video-assisted thoracoscopic pleurodesis", "Lung transplant on pump",
    "Ascending aorta graft on cpb with deep hypothermic circulatory arrest and TEE",
)
SERVICES = (
    "", None, "ORTHO", "CARDSURG", "NEUROSURGERY", "THORACIC", "VASC SURG", "OB/GYN",
    "CARDIAC\nTHORACIC", "ORTHO\n TRAUMA \n\n", "Neuro\nSPINE", "TRANSPLANT", "GYN\nUROLOGY",
    "nan", "VASCSURG\nCARDIOTHORACIC", "OBSTETRICS\nNEURO", "None\nThoracic", "GENERAL", "PLASTICS",
    "CARDVASC\nVASC\nTHOR\nGYN",
)
AIRWAY_NOTES = (
    "Patient intubated with ETT.", "Grade 1 view. Oral intubation via direct laryngoscopy, Mac 3 blade.",
    "Nasal intubation for maxillofacial surgery, video laryngoscopy with Glidescope.",
    "LMA placed without difficulty.", "Mask ventilation easy, then LMA inserted.",
    "LMA removed, mask ventilation at end.", "Double lumen tube placed, position confirmed by bronchoscopy.",
    "DLT exchanged for single lumen ETT.", "Difficult airway: multiple attempts, McGrath used, tube inserted.",
    "Natural airway, face mask oxygen.", "Fiberoptic assisted awake intubation.", "FOI planned.",
    "i-gel supraglottic device.", "BVM only.", "Not intubated.", "Failed intubation, air-Q rescue.",
    "Miller blade used.", "C-MAC and VL available.", "King Vision", "endotracheal tube placed, bag-mask before",
    "Monitored anesthesia care, remained awake", "General anesthesia planned", "Twilight anesthesia",
    "Airway difficult in the past; denied problems. Attempted but not intubated. Laryngeal mask used.",
    "", "Sedated but conversant.", "Orotracheal tube. Bronchial blocker left.",
    "Nasal cannula oxygen\nETT placed after mask\nno LMA",
    "Pre-oxygenated by mask for several minutes before a careful induction in the operating theatre; ETT 7.0 "
    "passed on first look with the cords clearly visible and end tidal carbon dioxide confirmed",
)
LINE_NOTES = (
    "", "Arterial line placed.", "A-line in left radial artery", "CVC via right IJ.",
    "Right IJ was used for a central venous catheter", "Swan-Ganz through internal jugular introducer",
    "PA catheter and central line.", "subclavian attempted\nline abandoned", "Femoral arterial access",
    "femoral venous catheter", "art line without central access", "PAC floated, CVC and femoral line in place",
    "a line", "peripheral IV x2", "No lines", "IJ approach not used, catheter elsewhere", "arterial catheter",
)
MONITOR_NOTES = (
    "", "TEE used.", "Transesophageal echocardiography performed.", "Neuromonitoring with SSEP.",
    "neurophysiologic monitoring and evoked potentials", "Lumbar drain placed.", "CSF drainage via catheter",
    "ICP monitor, EVD open", "intracranial pressure followed", "EP study", "standard monitors",
    "spinal drain and trans-esophageal probe", "ventriculostomy",
)
NEGATION_NOTES = (
    "", "No complications.", "Uneventful.", "Patient denied pain without  issue.", "not applicable",
    "no change, not noted", "All fine",
)
BLOCKS = (
    None, "", "Femoral nerve block", "Adductor canal, popliteal", "ISB", "supraclavicular brachial plexus",
    "Interscalene + ESP", "TAP bilateral", "transversus abdominis plane", "Quadratus lumborum / QL",
    "lumbar plexus", "Peripheral nerve block NOS", "brachial plexus", "Thoracic epidural T4-6",
    "T8-12", "T 1 - 7", "T6 to T10", "thoracic epidural", "upper thoracic", "lower thoracic paravertebral",
    "caudal", "sacral", "cervical", "lumbar epidural", "nan", "Unknown site XYZ", "T11", "T3 and T9",
    "Retrobulbar", "saphenous ; sciatic", "axillary, ankle", "infraclavicular", "labor epidural", "T4-T6-10",
)
DATES = (
    "({d})", "({m} || '/' || {day} || '/' || {y})", "({d} || ' 08:30:00')", "CAST(NULL AS STRING)", "'unknown'",
    "({d} || 'T07:15:00')", "({m} || '/' || {day} || '/' || {y} || ' 9:05')", "''", "'13/45/2020'",
    "({y} || '/' || {m} || '/' || {day})", "({d})",
)
AGES = (
    "'0.1'", "'2'", "'7.5'", "CAST({k} % 100 AS STRING)", "CAST(NULL AS STRING)", "'abc'", "'-1'", "'130'", "'nan'",
    "CAST({k} % 90 AS STRING)", "'65'", "'0.25'", "' 12 '", "'64.9'", "''",
)
ASA = ("1", "2", "3", "4", "5", "2E", None, "3e", "")
EMERGENT = ("N", "Y", "E", "yes", "TRUE", "1", "1.0", None, " y ", "0")
PROVIDERS = (
    "Smith, John MD", "DOE, JANE, CRNA; Other, Name DO", "  Lee,   Ann   PhD ", None, "", "Dr. Brown, MD,",
    "Garcia, Maria rn", "Mdivani, Rne",
)
ATTENDINGS = (
    "DOE, JANE@2025-01-01 08:00:00", "LEE, ANN@2025-02-01 09:00:00; KIM, BO@2025-02-01 10:00:00", None, "",
    " ROE, RICHARD ", "@2025-01-01 08:00:00",
)
NAMES = (
    "Intubation routine", "LMA", "Peripheral nerve block", "Epidural", "Spinal", "Intubation complex",
    "Unknown A", None, "Labor Epidural", "Arterial line", "CSE",
)
COMMENTS = (
    None, "Easy mask ventilation", "Glidescope used", " ", "Grade 2 view, Mac 4 blade",
    "Ultrasound guided single shot at T4-6", "Catheter left in place",
)
DETAILS = (
    None, "ETT 7.5 oral", "Easy mask ventilation", "Nasal ETT", "LMA size 4", "Arterial line placed, no issue",
    "double lumen tube 37F", "Bupivacaine with epinephrine", "",
)
CATEGORY_GUESSES = (
    "Cardiac with CPB", "Cardiac without CPB", "Intracerebral (endovascular)", "Intracerebral Vascular (open)",
    "Intracerebral Nonvascular (open)", "Intrathoracic non-cardiac",
    "Procedures on major vessels (endovascular)", "Procedures on major vessels (open)", "Cesarean del",
    "Vaginal del", "Other (procedure cat)", " Cesarean del ", "Not a category",
)
HUMAN_LABELS = (
    "Cardiac with CPB", "ProcedureCategory.CESAREAN", None, "Other (procedure cat)", " Vaginal del ",
    "ProcedureCategory.UNKNOWN", "nan", "Intrathoracic non-cardiac", "", "<NA>",
)

_DATE = "CAST(CAST(o_orderdate AS DATE) AS STRING)"
_PARTS = {
    "d": _DATE,
    "m": "CAST(EXTRACT(MONTH FROM o_orderdate) AS STRING)",
    "day": "CAST(EXTRACT(DAY FROM o_orderdate) AS STRING)",
    "y": "CAST(EXTRACT(YEAR FROM o_orderdate) AS STRING)",
    "k": "o_orderkey",
}


def _choose(key: str, expressions) -> str:
    arms = " ".join(f"WHEN {i} THEN {e.format(**_PARTS)}" for i, e in enumerate(expressions))
    return f"(CASE ({key}) % {len(expressions)} {arms} END)"


CASE_TABLE = f"""
SELECT o_orderkey AS seq,
       'DOE' || CAST(o_custkey % 40 AS STRING) || '_JANE' AS pair_key,
       {_choose("o_orderkey", DATES)} AS date,
       CASE WHEN o_orderkey % 37 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 41 = 0 THEN ''
            WHEN o_orderkey % 43 = 0 THEN 'LONG-EPISODE-IDENTIFIER-NUMBER-' || CAST(o_orderkey AS STRING)
            ELSE 'EP-' || CAST(o_orderkey AS STRING) END AS episode_id,
       {pick("o_orderkey + o_custkey", PROVIDERS)} AS anesthesiologist,
       {_choose("o_orderkey", AGES)} AS age,
       {pick("o_custkey", EMERGENT)} AS emergent,
       {pick("o_orderkey", ASA)} AS asa,
       {pick("o_orderkey * 5 + o_custkey", TECHNIQUES)} AS final_anesthesia_type,
       CASE WHEN o_orderkey % 19 = 0 THEN CAST(NULL AS STRING) WHEN o_orderkey % 31 = 0 THEN '   ' ELSE
            {pick("o_orderkey", AIRWAY_NOTES)} || ' ' || {pick("o_orderkey", LINE_NOTES)} || chr(10) ||
            {pick("o_orderkey + o_custkey", MONITOR_NOTES)} || ' ' || {pick("o_custkey", NEGATION_NOTES)}
       END AS procedure_notes,
       {pick("o_orderkey * 7 + o_custkey", PROCEDURES)} AS procedure,
       {pick("o_orderkey * 3 + o_custkey", SERVICES)} AS services,
       {pick("o_orderkey * 11 + o_custkey", BLOCKS)} AS nerve_block_type
FROM {{orders}}
"""

CASE_LIST = f"""
SELECT o_orderkey AS seq,
       CASE WHEN o_orderkey % 40 = 39 THEN 'CASEONLY_X' ELSE
            'DOE' || CAST(o_orderkey % 40 AS STRING) || '_JANE' END AS pair_key,
       'C' || CAST(o_orderkey AS STRING) AS case_id,
       {_choose("o_orderkey", DATES)} AS scheduled_dt,
       {_choose("o_orderkey", AGES)} AS patient_age,
       {pick("o_orderkey", ASA)} AS asa_status,
       {pick("o_orderkey * 7 + o_custkey", PROCEDURES)} AS procedure_text,
       {pick("o_orderkey", ATTENDINGS)} AS attendings
FROM {{orders}}
"""

# Returned lines stand for standalone procedures: their id is in no case list.
PROC_LIST = f"""
SELECT CASE WHEN l_orderkey % 40 = 39 THEN 'PROCONLY_Y' ELSE
            'DOE' || CAST(l_orderkey % 40 AS STRING) || '_JANE' END AS pair_key,
       (CASE WHEN l_returnflag = 'R' THEN 'S' ELSE 'C' END) || CAST(l_orderkey AS STRING) AS case_id,
       lpad(CAST(l_linenumber AS STRING), 4, '0') || lpad(CAST(l_partkey AS STRING), 12, '0') ||
       lpad(CAST(l_suppkey AS STRING), 12, '0') || lpad(CAST(CAST(l_quantity AS BIGINT) AS STRING), 8, '0') AS seq,
       CAST(CAST(l_shipdate AS DATE) AS STRING) AS scheduled_dt,
       {pick("l_suppkey", ASA)} AS asa_status,
       {pick("l_partkey", EMERGENT)} AS emergency,
       {pick("l_partkey + l_linenumber", NAMES)} AS procedure_name,
       {pick("l_partkey", BLOCKS)} AS primary_block,
       {pick("l_suppkey", COMMENTS)} AS comment,
       {pick("l_partkey * 3 + l_suppkey", DETAILS)} AS details,
       {pick("l_partkey + l_suppkey", PROCEDURES)} AS procedure_text,
       {pick("l_suppkey", ATTENDINGS)} AS attendings
FROM {{lineitem}}
"""

PREDICTIONS = f"""
SELECT o_orderkey AS seq,
       {pick("o_orderkey + o_custkey", CATEGORY_GUESSES)} AS ml_category,
       CAST((o_orderkey * 37 + o_custkey) % 1000 AS DOUBLE) / CAST(1000 AS DOUBLE) AS ml_confidence,
       {pick("o_orderkey + 3 * o_custkey", HUMAN_LABELS)} AS human_category
FROM {{orders}}
"""

REVIEW_LABELS = f"""
SELECT o_orderkey AS seq,
       CASE o_custkey % 3 WHEN 0 THEN lower({pick("o_orderkey", PROCEDURES)})
            WHEN 1 THEN '  ' || {pick("o_orderkey", PROCEDURES)} || '  ' || CAST(o_custkey AS STRING)
            ELSE {pick("o_orderkey", PROCEDURES)} END AS procedure,
       {pick("o_orderkey + o_custkey", HUMAN_LABELS)} AS human_category
FROM {{orders}}
"""

# Sampled training rows: every case, with a numbered procedure text so keys repeat but do not collapse.
TRAINING_ROWS = f"""
SELECT o_orderkey AS seq,
       'F' || CAST(o_custkey % 25 AS STRING) || '.csv' AS file,
       CASE WHEN o_orderkey % 3 = 0 THEN {pick("o_orderkey", PROCEDURES)}
            ELSE {pick("o_orderkey", PROCEDURES)} || ' ' || CAST(o_custkey AS STRING) END AS procedure,
       {pick("o_orderkey * 3 + o_custkey", SERVICES)} AS service_text,
       {_choose("o_orderkey", AGES)} AS age,
       {pick("o_orderkey", ASA)} AS asa,
       {pick("o_custkey", EMERGENT)} AS emergency
FROM {{orders}}
"""

ROSTER = """
SELECT c_custkey AS seq,
       CASE c_custkey % 6
            WHEN 0 THEN 'Ann Lee' || CAST(c_custkey AS STRING)
            WHEN 1 THEN 'Jane A. Smith' || CAST(c_custkey AS STRING) || ' (Jones' || CAST(c_custkey AS STRING) || ')'
            WHEN 2 THEN 'Robert "Bob" Stone' || CAST(c_custkey AS STRING)
            WHEN 3 THEN 'MARIA del Carmen Ruiz' || CAST(c_custkey AS STRING)
            WHEN 4 THEN 'Wei Chen' || CAST(c_custkey AS STRING) || ' (Will)'
            ELSE 'Solo' || CAST(c_custkey AS STRING) END AS name
FROM {customer}
"""

AVAILABLE_LOGS = """
SELECT s_suppkey AS seq,
       CASE s_suppkey % 6
            WHEN 0 THEN 'ann lee' || CAST(s_suppkey AS STRING)
            WHEN 1 THEN 'Jane Smith' || CAST(s_suppkey AS STRING)
            WHEN 2 THEN 'Robert Stone' || CAST(s_suppkey AS STRING)
            WHEN 3 THEN 'Maria Ruiz' || CAST(s_suppkey AS STRING)
            WHEN 4 THEN 'Will Chen' || CAST(s_suppkey AS STRING)
            ELSE 'Nobody' || CAST(s_suppkey AS STRING) END AS stem
FROM {supplier}
"""

# Long notes: the whole text of every document between two clinical phrases.
NOTE_CORPUS = f"""
SELECT doc_id AS seq,
       {pick("doc_id", AIRWAY_NOTES)} || chr(10) || text || chr(10) || {pick("doc_id", LINE_NOTES)} || ' ' ||
       {pick("doc_id", MONITOR_NOTES)} AS procedure_notes
FROM {{documents}}
"""

VIEWS = {
    "case_table": CASE_TABLE,
    "case_list": CASE_LIST,
    "proc_list": PROC_LIST,
    "predictions": PREDICTIONS,
    "review_labels": REVIEW_LABELS,
    "training_rows": TRAINING_ROWS,
    "roster": ROSTER,
    "available_logs": AVAILABLE_LOGS,
    "note_corpus": NOTE_CORPUS,
}
KEYS = {
    "orders": "o_orderkey",
    "lineitem": "l_orderkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "documents": "doc_id",
}
BASE_TABLES = tuple(KEYS)


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A derived view over the parquet tables of one directory."""
    sql = VIEWS[name]
    used = [t for t in BASE_TABLES if "{" + t + "}" in sql]
    # The given files have one row group each: without the exchange a view would run in one task.
    cores = spark.sparkContext.defaultParallelism
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").repartition(cores, KEYS[t]) for t in used}
    return spark.sql(sql, **tables)


def view_sql(name: str) -> str:
    """The same view as the body of a common table expression."""
    sql = VIEWS[name]
    for table in BASE_TABLES:
        sql = sql.replace("{" + table + "}", table)
    return sql
