"""Anesthesia-type keywords.

Fixed values: keywords are substrings of the upper-cased text; the first one wins.
"""

ANESTHESIA_MAPPING = {
    "CSE": "CSE",
    "EPIDURAL": "Epidural",
    "SPINAL": "Spinal",
    "MAC": "MAC",
    "MONITORED ANESTHESIA CARE": "MAC",
    "CONSCIOUS SEDATION": "MAC",
    "MODERATE SEDATION": "MAC",
    "SEDATION": "MAC",
    "INTUBAT": "GA",
    "LMA": "GA",
    "SUPRAGLOTTIC": "GA",
    "GENERAL": "GA",
    "GETA": "GA",
    "ENDOTRACHEAL": "GA",
    "ETT": "GA",
    "DOUBLE LUMEN": "GA",
    "DOUBLE-LUMEN": "GA",
}

MAC_PROCEDURES = (
    "AMPUTATION FOOT",
    "AMPUTATION METATARSAL",
    "AMPUTATION TOE",
    "COLONOSCOPY",
    "CYSTO",
    "CYSTOURETHROSCOPY",
    "DILATION AND CURETTAGE",
    "EGD FLEXIBLE",
    "HYSTEROSCOPY",
    "INDUCED ABORTION DILATION",
    "INSERTION INTRAUTERINE DEVICE",
    "MECHANICAL THROMBECTOMY",
    "PROSTATE NEEDLE BIOPSY",
    "SIGMOIDOSCOPY",
    "TREATMENT MISSED ABORTION",
    "VASECTOMY",
)

MAC_NOTES = (
    "MONITORED ANESTHESIA CARE",
    "CONSCIOUS SEDATION",
    "MODERATE SEDATION",
    "MINIMAL SEDATION",
    "TWILIGHT",
    "SEDATED BUT CONVERSANT",
    "REMAINED AWAKE",
    "AWAKE AND CONVERSANT",
)

GA_NOTES = (
    "GENERAL ANESTHESIA",
    "GETA",
    "GEN ENDOTRACHEAL",
    "DOUBLE LUMEN",
    "DOUBLE-LUMEN",
)

# Warning texts of the inference steps.
WARN_AIRWAY = "Inferred general anesthesia from airway management findings"
WARN_MAC_NOTE = "Inferred MAC from note text without airway documentation"
WARN_GA_NOTE = "Inferred general anesthesia from note text"
WARN_MAC_PROCEDURE = "Inferred MAC from procedure type without airway documentation"
WARN_OBSTETRIC = "Left anesthesia type blank for obstetric procedure category"
WARN_DEFAULT_GA = "Defaulted anesthesia type to GA for non-obstetric case"
WARN_NO_NOTES = "No procedure notes available for extraction"
WARN_ASA = "Added 'E' to ASA status based on emergent flag"
