"""States, sources, display labels and thresholds."""

from __future__ import annotations

# The four verdicts in display order.
APTO = "apto"
VEGETARIANO = "vegetariano"
NO_APTO = "no_apto"
REVISAR = "revisar"
STATES = [APTO, VEGETARIANO, NO_APTO, REVISAR]

# Severity of the resolved verdicts.
SEVERITY = {APTO: 0, VEGETARIANO: 1, NO_APTO: 2}

# Decision sources.
SRC_REGISTRY = "certificacion_oficial"
SRC_MAKER = "off_label"
SRC_SEAL = "sello_super"
SRC_INGREDIENTS = "ingredientes"
SRC_SHELF_INGREDIENTS = "ingredientes_super"
SRC_ANALYSIS = "off_analysis"
SRC_DUPLICATE = "duplicado"
SRC_NAME = "heuristica"
SRC_MODEL = "ml"
SRC_NONE = "sin_datos"
SRC_HUMAN = "curaduria_humana"

# Sources with evidence. The three sets differ on purpose.
TRAINING_SOURCES = [SRC_REGISTRY, SRC_MAKER, SRC_INGREDIENTS, SRC_ANALYSIS]
PHANTOM_SOURCES = [
    SRC_REGISTRY, SRC_MAKER, SRC_SEAL, SRC_INGREDIENTS, SRC_SHELF_INGREDIENTS, SRC_ANALYSIS,
]
EXPORT_SOURCES = [*PHANTOM_SOURCES, SRC_DUPLICATE]
NAME_ONLY_SOURCES = [SRC_NAME, SRC_MODEL]
WEAK_SOURCES = [SRC_NAME, SRC_MODEL, SRC_NONE]

# Verdict ; display label.
STATE_LABELS = """
apto ; Apto vegano
vegetariano ; Vegetariano (no vegano)
no_apto ; No apto
revisar ; A revisar
"""

# Source ; display text.
SOURCE_LABELS = """
certificacion_oficial ; Certificado en el registro oficial de ANMAT
off_label ; Declarado vegano por el fabricante
sello_super ; Sello de certificación en la ficha del supermercado
ingredientes ; Analizado desde la lista de ingredientes
ingredientes_super ; Analizado desde los ingredientes que publica el supermercado
off_analysis ; Análisis de ingredientes de Open Food Facts
duplicado ; Mismo producto que otro código de barras ya resuelto
heuristica ; Estimado por reglas sobre el nombre del producto
ml ; Estimado por clasificador automático
sin_datos ; Sin datos suficientes
"""

# Chain ; display name, in scan order of the chains.
CHAIN_LABELS = """
carrefour ; Carrefour
vea ; Vea
dia ; Día
jumbo ; Jumbo
disco ; Disco
"""

# Chains that publish label sheets.
SHEET_CHAINS = ["disco", "jumbo", "vea"]

# Source groups of the methodology report, group ; sources.
SOURCE_GROUPS = """
Alguien lo certificó ; certificacion_oficial, off_label, sello_super
Leímos la lista de ingredientes ; ingredientes, ingredientes_super, off_analysis
Es el mismo producto que otro ; duplicado
Lo estimamos por el nombre ; heuristica, ml
No sabemos ; sin_datos
"""

# Thresholds.
MIN_COVERAGE = 0.60
REGISTRY_OVERLAP = 0.6
COVERAGE_STRONG = 0.25
COVERAGE_WEAK = 0.10
MIN_TRAINING_ROWS = 200
APTO_MIN_PROB = 0.85
OTHER_MIN_PROB = 0.65
FAILURE_STREAK = 25
WINDOW_CAP = 2500
CACHE_TTL_DAYS = 60

# Review file columns.
REVIEW_COLUMNS = [
    "ean", "nombre", "marca", "categoria", "estado_actual", "motivo_actual",
    "ingredientes", "estado_corregido", "revisor",
]

# Fixed value: prefix cut from image addresses in the search index.
IMAGE_PREFIX = "https://images.openfoodfacts.org/images/products/"
