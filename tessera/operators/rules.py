"""Question routing and rule-based filter extraction.

Every rule is a literal-substring test on the lower-cased question, tried in list order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as X

# Any of these marks a question that needs the index.
DATA_KEYWORDS = [
    "aplicacion", "aplicaciones", "app", "apps",
    "critica", "crítica", "criticidad", "criticas", "críticas",
    "colombia", "argentina", "chile", "perú", "peru", "méxico", "mexico",
    "españa", "espana", "uruguay", "venezuela", "paraguay",
    "turquía", "turquia", "estados unidos", "usa", "eeuu",
    "deploy", "drp", "estrategica", "estratégica",
    "activa", "deprecada", "mantenimiento", "desarrollo",
    "lista", "listar", "muestra", "busca", "encuentra",
    "cuantas", "cuántas", "donde", "dónde", "cual", "cuál",
    "aws", "azure", "gcp", "cloud", "on-premise", "kyndryl", "ibm",
    "portal", "sistema", "plataforma", "servicio", "atm", "cajero",
]

# Words that ask for a number.
NUMERIC_WORDS = ["cuantas", "cuántas", "total", "cuánto", "how many", "cantidad", "numero", "número"]

# Words that ask for a visual.
TABLE_WORDS = ["tabla", "table", "listar", "list"]
DIAGRAM_REQUEST_WORDS = ["diagrama", "diagram", "flow", "flujo", "grafico", "chart"]
COMPARISON_WORDS = ["comparar", "compare", "vs", "versus", "diferencia"]

# Fixed values: (needle, country), first match in this order wins.
COUNTRIES = [
    ("colombia", "Colombia"),
    ("perú", "Perú"),
    ("peru", "Perú"),
    ("argentina", "Argentina"),
    ("chile", "Chile"),
    ("uruguay", "Uruguay"),
    ("venezuela", "Venezuela"),
    ("españa", "España"),
    ("espana", "España"),
    ("méxico", "México"),
    ("mexico", "México"),
    ("paraguay", "Paraguay"),
    ("turquía", "Turquía"),
    ("turquia", "Turquía"),
    ("estados unidos", "Estados Unidos"),
    ("usa", "Estados Unidos"),
    ("eeuu", "Estados Unidos"),
]

# Fixed values: (needles, value), first match in this order wins.
CRITICALITY = [
    (["muy critica", "muy crítica", "muy criticas", "muy críticas"], "Muy Crítico"),
    (["critica", "crítica", "criticas", "críticas", "criticidad"], "Crítico"),
    (["media", "medio"], "Medio"),
    (["baja", "bajo"], "Bajo"),
]
ACTIVE_WORDS = ["activa", "activas", "activo", "activos", "en uso"]
STATUS = [
    (["deprecada", "deprecado", "deprecadas"], "Deprecado"),
    (["mantenimiento"], "Mantenimiento"),
    (["desarrollo", "en desarrollo"], "En Desarrollo"),
]
DEPLOY = [
    (["aws"], "AWS"),
    (["azure"], "Azure"),
    (["gcp", "google cloud"], "GCP"),
    (["ibm"], "IBM Cloud"),
    (["kyndryl"], "Kyndryl"),
    (["hybrid", "híbrido", "hibrido"], "Hybrid Cloud"),
    (["on premise", "on-premise"], "On-Premise"),
]
DRP_WORDS = ["drp", "recuperación", "recuperacion"]
STRATEGIC_WORDS = ["estratégica", "estrategica", "estratégicas", "estrategico"]
# Fixed value: the phrase that names one application.
EXACT_NAME_PATTERN = f"qu[ée][{X.WS}]+es[{X.WS}]+(.+?)(?:\\?|\\z)"

FILTER_COLUMNS = [
    "exact_name", "is_numerical", "wants_table", "wants_diagram", "wants_comparison",
    "country", "critic_name", "is_active", "status", "has_drp", "is_strategic", "deploy",
]
# Filters that restrict documents by equality; questions give any of them. The rest of FILTER_COLUMNS steers the answer.
EQUALITY_FILTERS = [
    "country", "status", "critic_name", "deploy", "app_type", "quadrant", "is_strategic", "has_drp", "is_active",
]


def first_match(q: Column, rules: list[tuple[list[str], str]]) -> Column:
    """Value of the first rule with a contained needle; null when none matches."""
    out = F.lit(None).cast("string")
    for needles, value in reversed(rules):
        out = F.when(X.contains_any(q, needles), F.lit(value)).otherwise(out)
    return out


def needs_search(question: Column) -> Column:
    return X.contains_any(F.lower(question), DATA_KEYWORDS)


def exact_name(question: Column) -> Column:
    raw = X.strip(F.regexp_extract(F.lower(question), EXACT_NAME_PATTERN, 1))
    return F.nullif(X.normalize_name(raw), F.lit(""))


def extract_filters(df: DataFrame, question: str = "question") -> DataFrame:
    """Adds the FILTER_COLUMNS; flags that restrict documents are true or null, never false."""
    q = F.lower(F.col(question))
    active = X.contains_any(q, ACTIVE_WORDS)
    true_or_null = lambda words: F.when(X.contains_any(q, words), F.lit(True))
    return df.withColumns(
        {
            "exact_name": exact_name(F.col(question)),
            "is_numerical": X.contains_any(q, NUMERIC_WORDS),
            "wants_table": X.contains_any(q, TABLE_WORDS),
            "wants_diagram": X.contains_any(q, DIAGRAM_REQUEST_WORDS),
            "wants_comparison": X.contains_any(q, COMPARISON_WORDS),
            "country": first_match(q, [([k], v) for k, v in COUNTRIES]),
            "critic_name": first_match(q, CRITICALITY),
            "is_active": F.when(active, F.lit(True)),
            "status": F.when(~active, first_match(q, STATUS)),
            "has_drp": true_or_null(DRP_WORDS),
            "is_strategic": true_or_null(STRATEGIC_WORDS),
            "deploy": first_match(q, DEPLOY),
        }
    )


def filters_json() -> Column:
    """Applied filters as JSON, without the switches that only steer the answer."""
    names = ["country", "critic_name", "is_active", "status", "has_drp", "is_strategic", "deploy"]
    return F.to_json(F.struct(*names))


def matches_filters(doc: dict[str, Column], flt: dict[str, Column]) -> Column:
    """Null-tolerant conjunction: an absent filter accepts every document."""
    out = F.lit(True)
    for name in EQUALITY_FILTERS:
        if name in doc and name in flt:
            out = out & (flt[name].isNull() | F.coalesce(flt[name] == doc[name], F.lit(False)))
    return out
