"""Default parameters of the operators.

Fixed values: every number and name below must keep its value for the results to
be comparable with earlier indexes and reports.
"""

# chunking
CHUNK_TARGET_CHARS = 800
CHUNK_OVERLAP_CHARS = 80
CHUNK_UNIT_LIMIT_CHARS = 1600

# retrieval
VECTOR_TOP_N = 20
KEYWORD_TOP_N = 10
TRGM_MIN_SIMILARITY = 0.1
RETRIEVE_TOP_K = 8
RRF_CONSTANT = 60
MAX_QUERY_GRAMS = 64
BM25_K1 = 1.2
BM25_B = 0.75
BM25_IDF_FLOOR = 1e-6

# evidence
REFUSE_BELOW = 0.45
ANSWER_FROM = 0.55
CONTEXT_TOTAL_CHARS = 12000
CONTEXT_NEIGHBOUR_CHARS = 1600
CONTEXT_NEIGHBOUR_UNITS = 1
MIN_QUOTE_CHARS = 8

# document graph
GRAPH_POOL_CHUNKS = 400
GRAPH_TOP_K = 3
GRAPH_MIN_SIMILARITY = 0.68
GRAPH_THRESHOLD_PRESETS = (0.60, 0.68, 0.72, 0.76)

# evaluation
SWEEP_REFUSE = (0.35, 0.40, 0.45, 0.50)
SWEEP_ANSWER = (0.50, 0.55, 0.60)
MIN_LIBRARIES = 5
MIN_ITEMS = 40
DIFFICULTIES = ("smoke", "basic", "regular", "hard")
COMPARABLE_FIELDS = (
    "schema_version", "dataset_version", "embedding_model", "embedding_dimension",
    "query_vector_count", "configured_refusal_threshold", "configured_answer_threshold",
    "top_k", "library_count", "document_count", "item_count",
)
GATE_EPSILON = 1e-12
GATE_MRR_DROP = 0.01
GATE_GROUP_MRR_DROP = 0.05

# sources and embedding
MAX_UPLOAD_BYTES = 10 * 1024 * 1024
MAX_TITLE_CHARS = 255
MAX_QUESTION_CHARS = 500
EMBED_BATCH = 32
EMBED_RETRIES = 2
EMBED_DIMENSION = 1024

# sessions
SESSION_TTL_SECONDS = 1800
SESSION_TURNS = 5
REWRITE_TURNS = 3
REWRITE_ANSWER_CHARS = 200
HISTORY_TURNS = 6
HISTORY_ANSWER_CHARS = 1500

# answer statuses, evidence bands and refusal reasons
ANSWERED, NEEDS_REVIEW, INSUFFICIENT, UNVERIFIED, ERROR = (
    "answered", "needs_review", "insufficient", "unverified", "error",
)
BAND_STATUS = {
    "sufficient": ANSWERED,
    "borderline": NEEDS_REVIEW,
    "insufficient": INSUFFICIENT,
}
REASON_STATUS = {
    "borderline_relevance": NEEDS_REVIEW,
    "context_incomplete": NEEDS_REVIEW,
    "invalid_citation": UNVERIFIED,
    "no_citation": UNVERIFIED,
    "invalid_source_selection": UNVERIFIED,
    "answer_not_supported": UNVERIFIED,
    "support_verification_failed": UNVERIFIED,
    "support_context_limit": UNVERIFIED,
    "llm_unavailable": ERROR,
    "embedding_unavailable": ERROR,
    "embedding_mismatch": ERROR,
    "source_changed": ERROR,
    "source_validation_failed": ERROR,
    "source_context_limit": ERROR,
}
INSUFFICIENT_MARKERS = ("资料不足", "无法回答", "没有相关", "未提及", "无法确定")
CONTEXT_INCOMPLETE_MARKER = "上下文不足"

# document and task states
DOCUMENT_STATUSES = ("pending", "processing", "ready", "failed")
TASK_STATUSES = ("queued", "running", "succeeded", "failed", "superseded")
TASK_ACTIVE = ("queued", "running")
TASK_STAGES = ("validating", "reading", "chunking", "embedding", "publishing")
