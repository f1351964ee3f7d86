"""Text patterns for airway, vascular-access and monitoring findings.

Fixed values: the patterns (case-insensitive regular expressions), their order and
the reported names must stay as they are for results to agree.
"""

INTUBATION = (
    r"\bintubat(ed|ion|e)?\b",
    r"\bETT\b",
    r"\bendotrache(al)?\b",
    r"\b(tube|ett)\s+(placed|inserted|exchanged)\b",
    r"\bnasal\s+intubat",
    r"\boral\s+intubat",
)
DOUBLE_LUMEN = (
    r"\bdouble[- ]lumen(\s+(tube|ett))?\b",
    r"\bDLT\b",
)
DOUBLE_LUMEN_SUPPORT = (
    r"\bintubat(ed|ion|e)?\b",
    r"\bETT\b",
)
DIRECT_LARYNGOSCOPY = (
    r"\bdirect\s+laryngosc",
    r"\bDL\b",
    r"\bmiller\b",
    r"\bmacintosh\b",
    r"\bmac\s+\d+\b",
)
VIDEO_LARYNGOSCOPY = (
    r"\bvideo\s+laryngosc",
    r"\bVL\b",
    r"\bglidescope\b",
    r"\bc-?mac\b",
    r"\bmcgrath\b",
    r"\bking\s+vision\b",
)
SUPRAGLOTTIC = (
    r"\bLMA\b",
    r"\blaryngeal\s+mask\b",
    r"\bsupraglottic\b",
    r"\bi-?gel\b",
    r"\bair-?q\b",
)
BRONCHOSCOPY = (
    r"\bbronchosc(op(y|e|ic))?\b",
    r"\bfiberoptic\b.*\bintubat",
    r"\bFOI\b",
)
MASK = (
    r"\bmask\b(?!.*\bLMA\b)",
    r"\bmask\s+vent(ilation)?\b",
    r"\bBVM\b",
    r"\bbag[- ]?mask\b",
    r"\bface\s+mask\b",
)
DIFFICULT_AIRWAY = (
    r"\bdifficult\s+(airway|intubat)",
    r"\bairway\s+difficult",
    r"\bfailed\s+intubat",
    r"\bmultiple\s+attempt",
)
NASAL_ROUTE = (r"\bnasal\b",)
NEGATION = (
    r"\bno\s+",
    r"\bnot\s+",
    r"\bwithout\s+",
    r"\bdenied\b",
    r"\battempted\s+but\s+not\b",
)

ARTERIAL_LINE = (
    r"\barterial\s+line\b",
    r"\bA-?line\b",
    r"\bart[- ]line\b",
    r"\barterial\s+catheter\b",
    r"\b[Aa]\s+line\b",
    r"\bradial\s+(artery|arterial|line)\b",
    r"\bfemoral\s+(artery|arterial|line)\b",
)
CENTRAL_LINE = (
    r"\bcentral\s+(venous|line)\b",
    r"\bCVC\b",
    r"\binternal\s+jugular\b",
    r"\bIJ\b.*\b(line|catheter)\b",
    r"\bsubclavian\b.*\b(line|catheter)\b",
    r"\bfemoral\s+(venous\s+)?(line|catheter)\b",
    r"\bcentral\s+access\b",
)
PA_CATHETER = (
    r"\bpulmonary\s+artery\s+catheter\b",
    r"\bPA\s+catheter\b",
    r"\bSwan[- ]?Ganz\b",
    r"\bPAC\b",
)

TEE = (
    r"\bTEE\b",
    r"\btransesophageal\s+echo(cardiograph(y|ic))?\b",
    r"\btrans[- ]?esophageal\b",
)
ELECTROPHYSIOLOGIC = (
    r"\belectrophysiolog(ic|y)\b",
    r"\bEP\s+stud(y|ies)\b",
    r"\bSSCP\b",
    r"\bSSEP\b",
    r"\bneuro(physiologic)?\s+monitor",
    r"\bevoked\s+potential",
)
CSF_DRAIN = (
    r"\bCSF\s+(drain(age)?|catheter)\b",
    r"\blumbar\s+drain\b",
    r"\bcerebrospinal\s+fluid\s+drain",
    r"\bspinal\s+drain\b",
)
INVASIVE_NEURO = (
    r"\bICP\s+(monitor|catheter)\b",
    r"\bintracranial\s+pressure\b",
    r"\bventriculostomy\b",
    r"\bEVD\b",
)

ORAL_ETT_NAME = "Oral ETT"
NASAL_ETT_NAME = "Nasal ETT"
DOUBLE_LUMEN_NAME = "Double Lumen Tube"
DIRECT_LARYNGOSCOPE_NAME = "Direct Laryngoscope"
VIDEO_LARYNGOSCOPE_NAME = "Video Laryngoscope"
SUPRAGLOTTIC_NAME = "Supraglottic Airway"
BRONCHOSCOPIC_NAME = "Flexible Bronchoscopic"
MASK_NAME = "Mask"
DIFFICULT_AIRWAY_NAME = "Difficult Airway"
ARTERIAL_NAME = "Arterial Catheter"
CENTRAL_NAME = "Central Venous Catheter"
PA_NAME = "Pulmonary Artery Catheter"
TEE_NAME = "TEE"
ELECTROPHYSIOLOGIC_NAME = "Electrophysiologic mon"
CSF_DRAIN_NAME = "CSF Drain"
INVASIVE_NEURO_NAME = "Invasive neuro mon"

# Confidence of a finding and of a case.
BASE_CONFIDENCE = 0.5
SUPPORT_STEP = 0.1
SUPPORT_MAX = 0.4
NEGATION_STEP = 0.3
NO_NOTES_CONFIDENCE = 0.7
NO_FINDINGS_CONFIDENCE = 0.9
CONTEXT_WINDOW = 50
