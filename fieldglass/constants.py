"""Names, limits, patterns and texts that results depend on.

Everything here has to be exactly what it is for the outputs to be right; the
modules that use these values contain the logic.
"""

# --- fixed values: document types and comparison metrics -------------------
DOCUMENT_TYPES = (
    "cni",
    "passeport",
    "permis_conduire",
    "avis_imposition",
    "bulletin_salaire",
    "visale_certificate",
    "autre",
)
OTHER_TYPE = "autre"

METRICS = (
    "equality",
    "levenshtein_distance",
    "deep_equality",
    "string_date_equality",
    "compare_number",
    "token_set_equality",
    "skip",
)
DEFAULT_METRIC = "equality"
SKIP_SCORE = -1.0
FIELD_METRIC_NAME = "json_schema_extra"

# --- fixed values: event log ----------------------------------------------
STARTED = "WorkflowExecutionStarted"
STEP_COMPLETED = "WorkflowExecutionStepCompleted"
COMPLETED = "WorkflowExecutionCompleted"
FAILED = "WorkflowExecutionFailed"
EVENT_TYPES = (STARTED, STEP_COMPLETED, COMPLETED, FAILED)
RETRYABLE_ERROR = "RetryableException"
UNKNOWN_STEP = "unknown"
RETENTION_DAYS = 7

# --- fixed values: tenancy -------------------------------------------------
KEY_STATUSES = ("Active", "Revoked", "Expired")
ADMIN_ROLE = "PlatformAdmin"
KEY_ENVIRONMENTS = ("dev", "staging", "sandbox", "prod")

# --- fixed values: quotas and waiting --------------------------------------
LIMIT_PER_MINUTE = 300
LIMIT_PER_DAY = 5000
#: How far the expiry of streaming counters stays behind, and how many requests move it.
QUOTA_LATE_SECONDS = 3600
QUOTA_QUORUM = 100
WAIT_DEFAULT_SECONDS = 30
WAIT_CAP_SECONDS = 60

# --- fixed values: message delivery ----------------------------------------
MAX_DELIVERIES = 3
IDLE_MS = 300_000
#: Length of a band of event time in the streaming status.
STATUS_BAND_SECONDS = 86_400
# Parts that the timer-driven streams deal their state to, fixed for the life of a checkpoint.
AWAIT_BUCKETS = 64
RECLAIM_BUCKETS = 256
STREAM_MAXLEN = 1000
WEBHOOK_RETRIES = 3
BACKOFF_SECONDS = 5.0
BACKOFF_FACTOR = 2.0
NOT_RETRYABLE_HTTP = (400, 401, 403, 422)

# --- fixed values: files ----------------------------------------------------
MAX_FILE_BYTES = 26_214_400
MIME_EXTENSIONS = {
    "application/pdf": (".pdf",),
    "image/jpeg": (".jpg", ".jpeg"),
    "image/png": (".png",),
}
FILE_SIGNATURES = {
    "25504446": "application/pdf",
    "FFD8FF": "image/jpeg",
    "89504E470D0A1A0A": "image/png",
}
OCTET_STREAM = "application/octet-stream"

# --- fixed values: page rendering -------------------------------------------
RENDER_DPI = 180.0
NATURAL_DPI = 72.0
MAX_LONG_EDGE = 1800.0
MAX_PIXELS = 2_000_000.0
MIN_LONG_EDGE = 1500.0

# --- fixed values: workflow steps --------------------------------------------
WORKFLOW_STEPS = (
    "download_file",
    "preprocess_file",
    "extract_content_ocr",
    "extract_content_marker_ocr",
    "extract_content_mistral_ocr",
    "extract_content_nanonets_ocr",
    "extract_content_deepseek_ocr",
    "extract_barcode_data",
    "extract_barcode_raw_data",
    "extract_barcode_2ddoc_data",
    "llm_classify_document",
    "llm_extract_data",
    "save_workflow_result",
)

# --- fixed values: labelling format -------------------------------------------
METADATA_FIELD = "__metadata__"
TIME_KEY = "total_processing_time_ms"

# --- fixed values: person titles, number-typed labels, label mapping ----------
PERSON_TITLE_PREFIX = r"^\s*(?:(?:m(?:onsieur)?|mme|madame|mlle|docteur|dr|prof(?:esseur)?|pr)\.?\s+)+"
LABEL_TO_FIELD = {
    "Année des revenus": "Année des revenus",
    "Revenu fiscal de référence": "Revenu fiscal de référence",
    "Référence d'avis d'impôt": "Référence d'avis d'impôt",
    "Nombre de parts": "Nombre de parts",
    "Date de mise en recouvrement": "Date de mise en recouvrement",
    "Revenu brut global": "Revenu brut global",
    "Revenu imposable": "Revenu imposable",
    "Impôt sur le revenu net avant corrections": "Impôt sur le revenu net avant corrections",
    "Montant de l'impôt": "Montant de l'impôt",
    "Déclarant 1": "Nom du déclarant 1",
    "Numéro fiscal du déclarant 1": "Numéro fiscal du déclarant 1",
    "Déclarant 2": "Nom du déclarant 2",
    "Numéro fiscal du déclarant 2": "Numéro fiscal du déclarant 2",
}
NUMBER_LABELS = (
    "Revenu fiscal de référence",
    "Nombre de parts",
    "Revenu brut global",
    "Revenu imposable",
    "Montant de l'impôt",
)
REQUIRED_LABELS = ("Année des revenus", "Revenu fiscal de référence", "Nom du déclarant 1")

# --- fixed values: redaction ----------------------------------------------------
MASK = "***"
SENSITIVE_HEADERS = ("authorization", "cookie")
PREVIEW_CHARS = 4096
BAD_DATE_MESSAGE = "Format de date non reconnu : "

# Unicode white space: as the body of a regex character class (Java's \s alone is
# ASCII) and as the set of characters to trim.
WS = r"\s\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WS_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
