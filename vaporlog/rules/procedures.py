"""Procedure-category keywords.

Fixed values: keywords are substrings of upper-cased text; order matters where the
first match wins.
"""

CARDIAC_WITH_CPB = "Cardiac with CPB"
CARDIAC_WITHOUT_CPB = "Cardiac without CPB"
INTRACEREBRAL_ENDOVASCULAR = "Intracerebral (endovascular)"
INTRACEREBRAL_VASCULAR_OPEN = "Intracerebral Vascular (open)"
INTRACEREBRAL_NONVASCULAR_OPEN = "Intracerebral Nonvascular (open)"
INTRATHORACIC = "Intrathoracic non-cardiac"
MAJOR_VESSELS_ENDOVASCULAR = "Procedures on major vessels (endovascular)"
MAJOR_VESSELS_OPEN = "Procedures on major vessels (open)"
CESAREAN = "Cesarean del"
VAGINAL_DELIVERY = "Vaginal del"
OTHER = "Other (procedure cat)"

# Symbolic label name -> category.
CATEGORY_BY_NAME = {
    "CARDIAC_WITH_CPB": CARDIAC_WITH_CPB,
    "CARDIAC_WITHOUT_CPB": CARDIAC_WITHOUT_CPB,
    "INTRACEREBRAL_ENDOVASCULAR": INTRACEREBRAL_ENDOVASCULAR,
    "INTRACEREBRAL_VASCULAR_OPEN": INTRACEREBRAL_VASCULAR_OPEN,
    "INTRACEREBRAL_NONVASCULAR_OPEN": INTRACEREBRAL_NONVASCULAR_OPEN,
    "INTRATHORACIC_NON_CARDIAC": INTRATHORACIC,
    "MAJOR_VESSELS_ENDOVASCULAR": MAJOR_VESSELS_ENDOVASCULAR,
    "MAJOR_VESSELS_OPEN": MAJOR_VESSELS_OPEN,
    "CESAREAN": CESAREAN,
    "VAGINAL_DELIVERY": VAGINAL_DELIVERY,
    "OTHER": OTHER,
}
CATEGORIES = tuple(CATEGORY_BY_NAME.values())
LABEL_NAME_PREFIX = "ProcedureCategory."

# Service rules, in order.
CARDIAC_SERVICE = (
    "CARDIAC",
    "CARDSURG",
    "CARDIOTHORACIC",
    "CARDVASC",
    "CABG",
    "CORONARY ARTERY BYPASS",
    "VALVE REPLACEMENT",
    "VALVE REPAIR",
    "AORTIC VALVE",
    "MITRAL VALVE",
    "TRICUSPID VALVE",
    "PULMONARY VALVE",
    "AVR",
    "MVR",
    "TVR",
    "MAZE PROCEDURE",
    "ATRIAL SEPTAL DEFECT",
    "ASD REPAIR",
    "VSD REPAIR",
    "VENTRICULAR SEPTAL DEFECT",
    "HEART TRANSPLANT",
    "CARDIAC TRANSPLANT",
    "LUNG TRANSPLANT",
    "TAVR",
    "TAVI",
    "LVAD",
    "ECMO",
    "INTRACARDIAC",
    "VENTRICULAR ASSIST DEVICE",
)
NEURO_SERVICE = ("NEURO",)
SPINE = (
    "SPINE",
    "SPINAL",
    "VERTEBR",
    "INTERBODY",
    "ARTHRODESIS",
    "LAMINECTOMY",
    "LAMINOTOMY",
    "DISCECTOMY",
    "FUSION",
)
THORACIC_SERVICE = ("THOR",)
THORACIC_SERVICE_EXCLUDE = ("CARD",)
VASCULAR_SERVICE = (
    "VASC",
    "VASCSURG",
    "ANGIOGRAPHY",
    "ANGIOGRAM",
)
TRANSPLANT_SERVICE = ("TRANSPLANT",)
OBGYN_SERVICE = ("OBGYN", "OB/GYN", "OBSTET", "GYN")

# Procedure-text rules, in order, used when no service matched.
CARDIAC_TEXT = (
    "CARDIAC",
    "CABG",
    "CORONARY ARTERY BYPASS",
    "CARDIOPULMONARY BYPASS",
    "TAVR",
    "TAVI",
    "TRANSCATHETER AORTIC VALVE REPLACEMENT",
    "VALVULOPLASTY",
    "AORTIC VALVE",
    "MITRAL VALVE",
    "TRICUSPID VALVE",
    "PULMONARY VALVE",
    "LVAD",
    "VENTRICULAR ASSIST DEVICE",
    "ECMO",
    "HEART TRANSPLANT",
    "CARDIAC TRANSPLANT",
    "LUNG TRANSPLANT",
)
INTRACEREBRAL_TEXT = (
    "CRANIOTOMY",
    "CRANIECTOMY",
    "BURR HOLE",
    "INTRACRANIAL",
    "CNS",
    "ANEURYSM",
    "AVM",
    "ARTERIOVENOUS",
    "CLIPPING",
    "EMBOLIZATION",
    "EMBOLIZE",
    "VENTRICULOSTOMY",
    "ENCEPHALOCELE",
)
THORACIC_TEXT = (
    "THORACOTOMY",
    "LOBECTOMY",
    "PNEUMONECTOMY",
    "WEDGE RESECTION",
    "VATS",
    "VIDEO-ASSISTED THORACOSCOP",
    "MEDIASTINOSCOPY",
    "PLEURODESIS",
    "THYMECTOMY",
    "ESOPHAGECTOMY",
    "CHEST WALL RESECTION",
    "LUNG RESECTION",
)
THORACIC_TEXT_EXCLUDE = (
    "EPIDURAL",
    "SUBARACHNOID",
    "THORACENTESIS",
    "BRONCHOSCOPY",
    "INTERBODY",
    "VERTEBR",
    "SPINE",
)
VASCULAR_TEXT = (
    "ENDARTERECTOMY",
    "CAROTID",
    "AAA",
    "AORTIC ANEURYSM",
    "AORTA",
    "AORTIC",
    "EVAR",
    "TEVAR",
    "FEVAR",
    "AXILLOFEMORAL",
    "AORTOBIFEMORAL",
    "FEMORAL-POPLITEAL",
    "FEMORAL POPLITEAL",
    "POPLITEAL",
    "ILIAC",
    "THROMBECTOMY",
    "EMBOLECTOMY",
    "BYPASS GRAFT",
    "ARTERIAL BYPASS",
    "ANGIOGRAPHY",
    "ANGIOGRAM",
)
VASCULAR_TEXT_EXCLUDE = (
    "PACEMAKER",
    "DEFIBRILLATOR",
    "ICD",
    "ELECTROPHYSIOLOG",
    "EP ",
    "VASC ACCESS",
    "LYMPHANGIOGRAPHY",
    "MICROVASCULAR",
    "CUTANEOUS VASCULAR",
    "VASCULAR FLOW FLAP",
    "CT ANGIO",
)
LABOR_EPIDURAL = ("LABOR EPIDURAL",)
CESAREAN_TEXT = ("CESAREAN", "C-SECTION", "C SECTION")
VAGINAL_TEXT = ("LABOR EPIDURAL", "VAGINAL", "DELIVERY", "LABOR")

# Use of cardiopulmonary bypass.
OFF_PUMP = ("OFF-PUMP", "OFF PUMP", "OPCAB", "BEATING HEART")
STRONG_CPB = (
    "CPB",
    "CARDIOPULMONARY BYPASS",
    "CABG",
    "CORONARY ARTERY BYPASS",
    "ASCENDING AORTA GRAFT",
    "HEART TRANSPLANT",
    "LUNG TRANSPLANT",
)
NO_CPB = (
    "TAVR",
    "TAVI",
    "TRANSCATHETER AORTIC VALVE REPLACEMENT",
    "OFF-PUMP",
    "OFF PUMP",
    "OPCAB",
    "BEATING HEART",
    "REMOVAL VENTRICULAR ASSIST DEVICE",
    "REMOVAL IMPLANT",
)
CPB = ("BYPASS", "PUMP", "ON-PUMP", "ON PUMP")
TRANSCATHETER = ("TRANSCATHETER",)
TRANSCATHETER_VALVE = ("VALVE", "VALVULOPLASTY", "AORTIC")

# Surgical approach and intracerebral pathology.
ENDOVASCULAR = (
    "ENDOVASCULAR",
    "PERCUTANEOUS",
    "CATHETER",
    "STENT",
    "COIL",
    "COILING",
    "EMBOLIZATION",
    "EMBOLIZE",
    "ANGIOPLASTY",
    "ANGIOGRAM",
    "ANGIOGRAPHY",
    "THROMBECTOMY",
    "EVAR",
    "TEVAR",
    "FEVAR",
    "PTA",
    "INTERVENTION",
    "ENDOGRAFT",
)
OPEN = (
    "OPEN",
    "CRANIOTOMY",
    "CRANIECTOMY",
    "CLIPPING",
    "BYPASS",
    "GRAFT",
    "ENDARTERECTOMY",
    "CEA",
    "REPAIR",
    "RESECTION",
    "EXCISION",
    "DECOMPRESSION",
    "LAPAROTOMY",
    "THORACOTOMY",
    "STERNOTOMY",
)
CRANIAL_OPEN = ("CRANIOTOMY", "CRANIECTOMY", "BURR HOLE", "CLIPPING")
EXPLICIT_ENDOVASCULAR = ("ENDOVASCULAR", "PERCUTANEOUS")
VASCULAR_PATHOLOGY = (
    "ANEURYSM",
    "AVM",
    "ARTERIOVENOUS",
    "VASCULAR MALFORMATION",
    "HEMORRHAGE",
    "BLEED",
    "BLEEDING",
    "STROKE",
    "ISCHEMIA",
    "CAVERNOMA",
    "CAVERNOUS MALFORMATION",
)
NONVASCULAR_PATHOLOGY = (
    "TUMOR",
    "MASS",
    "LESION",
    "CYST",
    "ABSCESS",
    "GLIOMA",
    "MENINGIOMA",
    "NEOPLASM",
    "CANCER",
    "EPILEPSY",
    "SEIZURE",
    "HYDROCEPHALUS",
    "SHUNT",
)
HEMATOMA = ("HEMATOMA",)
HEMATOMA_VASCULAR = ("ANEURYSM", "AVM", "ARTERIOVENOUS")
