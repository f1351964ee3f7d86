"""Sampling, feature and model constants.

Fixed values.
"""

HIGH_VALUE_WORDS = (
    "CARDIAC",
    "CABG",
    "VALVE",
    "BYPASS",
    "CRANIOTOMY",
    "INTRACRANIAL",
    "ENDOVASCULAR",
    "TAVR",
    "ECMO",
    "VASCULAR",
)
TOTAL_SAMPLE = 50000
HIGH_SHARE = 0.5
MEDIUM_SHARE = 0.3
CORRECTION_MULTIPLIER = 3
REVIEW_QUEUE_SIZE = 200

HIGH_CONFIDENCE = 0.85
MEDIUM_CONFIDENCE = 0.7
ML_THRESHOLD = 0.45

STOP_WORDS = (
    "procedure",
    "patient",
    "performed",
    "underwent",
    "status",
    "post",
    "pre",
)
WORD_NGRAMS = (1, 2, 3, 4)
WORD_FEATURES = 800
CHAR_NGRAMS = (3, 4, 5)
CHAR_FEATURES = 200
MIN_DOC_FREQ = 2
# First guess: words that occur less than once in so many rows are in no vocabulary.
RARE_WORDS = 10000
# Frequent words that are kept whole without a look at their characters.
KNOWN_WORDS = 1000
# Longest list of pairs of characters in one pattern; with more, texts are taken as they are.
MOST_PAIRS = 4000
# Different texts that are broadcast at the most.
BROADCAST_KEYS = 20000

# Structured features, second layout: name -> words looked up in the procedure text.
PROCEDURE_FEATURES_V2 = {
    "f_cpb": ("CPB", "CARDIOPULMONARY BYPASS"),
    "f_cabg": ("CABG", "CORONARY ARTERY BYPASS"),
    "f_tavr": ("TAVR", "TAVI"),
    "f_transcatheter_valve": ("VALVE", "VALVULOPLASTY"),
    "f_off_pump": ("OFF-PUMP", "OFF PUMP", "OPCAB"),
    "f_endovascular": ("ENDOVASCULAR", "PERCUTANEOUS"),
    "f_open": ("OPEN", "CRANIOTOMY", "CRANIECTOMY"),
    "f_laparoscopic": ("LAPAROSCOPIC",),
    "f_robotic": ("ROBOTIC",),
    "f_heart": ("CARDIAC", "HEART", "VALVE", "CABG"),
    "f_cranial": ("CRANI", "INTRACRANIAL", "ANEURYSM", "AVM"),
    "f_thoracic": (
        "THORACOTOMY",
        "LOBECTOMY",
        "PNEUMONECTOMY",
        "WEDGE RESECTION",
        "MEDIASTINOSCOPY",
        "VATS",
    ),
    "f_vascular": (
        "AORT",
        "CAROTID",
        "ENDARTERECTOMY",
        "EVAR",
        "TEVAR",
        "FEVAR",
        "POPLITEAL",
        "ILIAC",
        "EMBOLECTOMY",
        "THROMBECTOMY",
    ),
    "f_delivery": ("CESAREAN", "C-SECTION", "LABOR"),
    "f_assist_device": ("ECMO", "VENTRICULAR ASSIST DEVICE"),
    "f_electrophysiology": (
        "PACEMAKER",
        "DEFIBRILLATOR",
        "ICD",
        "ELECTROPHYSIOLOG",
        "ABLATION",
    ),
    "f_bronchoscopy": ("BRONCHOSCOPY", "THORACENTESIS"),
    "f_neuraxial": ("EPIDURAL", "SUBARACHNOID", "INTRATHECAL", "CSE"),
}
# Words looked up in the service text.
SERVICE_FEATURES_V2 = {
    "f_svc_cardiac": ("CARD", "CARDSURG", "CARDIAC"),
    "f_svc_neuro": ("NEURO",),
    "f_svc_thoracic": ("THOR",),
    "f_svc_vascular": ("VASC",),
    "f_svc_obgyn": ("OBGYN", "OB/GYN", "OBSTET", "GYN"),
}
# Words looked up in the upper-cased rule category.
CATEGORY_FEATURES_V2 = {
    "f_rule_cardiac": ("CARDIAC", "CPB"),
    "f_rule_intracerebral": ("INTRACEREBRAL",),
    "f_rule_major_vessels": ("MAJOR VESSELS",),
    "f_rule_intrathoracic": ("INTRATHORACIC",),
}
# Structured features, first layout.
PROCEDURE_FEATURES_V1 = {
    "f_cpb": ("CPB",),
    "f_cardiopulmonary_bypass": ("CARDIOPULMONARY BYPASS",),
    "f_cardiac_bypass": ("BYPASS",),
    "f_endovascular": ("ENDOVASCULAR",),
    "f_open": ("OPEN",),
    "f_laparoscopic": ("LAPAROSCOPIC",),
    "f_robotic": ("ROBOTIC",),
    "f_heart": ("CARDIAC", "HEART"),
    "f_cranial": ("CRANIOTOMY", "INTRACRANIAL"),
    "f_thoracic": ("THORACIC", "CHEST"),
    "f_vascular": ("VASCULAR", "VESSEL"),
    "f_cesarean": ("CESAREAN", "C-SECTION"),
    "f_valve": ("VALVE",),
    "f_cabg": ("CABG",),
    "f_tavr": ("TAVR", "TAVI"),
    "f_avm": ("AVM",),
    "f_aneurysm": ("ANEURYSM",),
    "f_ecmo": ("ECMO",),
}
CATEGORY_FEATURES_V1 = {
    "f_rule_cardiac": ("Cardiac",),
    "f_rule_intracerebral": ("Intracerebral",),
    "f_rule_vessel": ("vessel",),
}
TEXT_LENGTH_STEP = 100

LOGISTIC_MAX_ITER = 2000
FOREST_TREES = 100
FOREST_DEPTH = 20
FOREST_MIN_SPLIT = 5
CV_FOLDS = 5
# Equal training vectors are kept this often at the most; weights stand for the others.
REPEATS = 4
SEED = 42
