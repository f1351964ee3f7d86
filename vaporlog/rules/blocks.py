"""Nerve-block site terms and routing words.

Fixed values: term names and their order define the output text.
"""

OTHER_PERIPHERAL = "Other - peripheral nerve blockade site"

# Peripheral term -> case-insensitive patterns, in canonical order.
PERIPHERAL_SITES = {
    "Adductor Canal": (r"\badductor\s+canal\b", r"\bacb\b"),
    "Ankle": (r"\bankle\b",),
    "Axillary": (r"\baxillary\b",),
    "Erector Spinae Plane": (r"\berector\s+spinae\s+plane\b", r"\besp\b"),
    "Femoral": (r"\bfemoral\b",),
    "Infraclavicular": (r"\binfraclavicular\b",),
    "Interscalene": (r"\binterscalene\b", r"\bisb\b"),
    "Lumbar Plexus": (r"\blumbar\s+plexus\b", r"\bpsoas\s+compartment\b"),
    "Paravertebral": (r"\bparavertebral\b",),
    "Popliteal": (r"\bpopliteal\b",),
    "Quadratus Lumborum": (r"\bquadratus\s+lumborum\b", r"\bql\b"),
    "Retrobulbar": (r"\bretrobulbar\b",),
    "Saphenous": (r"\bsaphenous\b",),
    "Sciatic": (r"\bsciatic\b",),
    "Supraclavicular": (r"\bsupraclavicular\b",),
    "Transverse Abdominal Plane": (r"\btransvers(?:e|us)\s+abdom(?:inal|inis)\s+plane\b", r"\btap\b"),
}

# Neuraxial term -> patterns; the two thoracic bands follow from levels.
NEURAXIAL_SITES = {
    "Caudal": (r"\bcaudal\b", r"\bsacral\b"),
    "Cervical": (r"\bcervical\b",),
    "Lumbar": (r"\blumbar\b",),
}
THORACIC_HIGH = "T 1-7"
THORACIC_LOW = "T 8-12"
THORACIC_HIGH_LAST_LEVEL = 7

PERIPHERAL_CONTEXT = (
    r"\bperipheral\b",
    r"\bpnb\b",
    r"\bnerve\s+block(?:ade)?\b",
    r"\bbrachial\s+plexus\b",
)
LUMBAR_CONTEXT = (r"\bspinal\b", r"\blabor\s+epidural\b")
THORACIC_RANGE = r"\b(?:t|thoracic)\s*([1-9]|1[0-2])\s*(?:-|to)\s*(?:t|thoracic)?\s*([1-9]|1[0-2])\b"
THORACIC_LEVEL = r"\b(?:t|thoracic)\s*([1-9]|1[0-2])\b"
THORACIC_UPPER = (r"\bupper\s+thoracic\b",)
THORACIC_LOWER = (r"\blower\s+thoracic\b",)
THORACIC_GENERIC = (r"\bthoracic\b",)

PERIPHERAL_TERMS = (*PERIPHERAL_SITES, OTHER_PERIPHERAL)
NEURAXIAL_TERMS = (*NEURAXIAL_SITES, THORACIC_HIGH, THORACIC_LOW)

# Words that route a standalone procedure to the block output.
BLOCK_HINTS = ("PERIPHERAL NERVE BLOCK", "NERVE BLOCK", "BLOCK")
