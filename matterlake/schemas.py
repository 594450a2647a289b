"""Table schemas, enumerations and default values."""

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = (
    T.StringType(),
    T.IntegerType(),
    T.LongType(),
    T.DoubleType(),
    T.BooleanType(),
    T.TimestampType(),
)


def _table(required: dict, optional: dict) -> T.StructType:
    fields = [T.StructField(n, t, False) for n, t in required.items()]
    fields += [T.StructField(n, t, True) for n, t in optional.items()]
    return T.StructType(fields)


FIRMS = _table(
    {"id": _S, "name": _S, "status": _S, "created_at": _TS, "metadata": _S},
    {"created_by": _S},
)

FIRM_USERS = _table(
    {"user_id": _S, "firm_id": _S, "role": _S, "added_at": _TS, "status": _S},
    {"added_by": _S, "min_token_iat": _TS},
)

MATTERS = _table(
    {},
    {
        "id": _S,
        "user_id": _S,
        "firm_id": _S,
        "client_id": _S,
        "client_name": _S,
        "matter_name": _S,
        "governing_law": _S,
        "parties": _S,
        "deal_parameters": _S,
        "context": _S,
        "created_at": _TS,
        "last_accessed": _TS,
        "archived": _B,
        "stage": _S,
        "privilege_scope": _S,
    },
)

DOCUMENTS = _table(
    {},
    {
        "id": _S,
        "firm_id": _S,
        "matter_id": _S,
        "user_id": _S,
        "name": _S,
        "content": _S,
        "doc_type": _S,
        "is_precedent": _B,
        "word_doc_id": _S,
        "status": _S,
        "added_at": _TS,
        "last_modified": _TS,
    },
)

CLIENTS = _table({}, {"id": _S, "user_id": _S, "firm_id": _S})

MATTER_MEMORY = _table(
    {},
    {
        "id": _S,
        "firm_id": _S,
        "matter_id": _S,
        "memory_type": _S,
        "content": _S,
        "scope": _S,
        "source_document_id": _S,
        "chunk_index": _I,
        "embedding": T.ArrayType(T.FloatType()),
        "embedding_model": _S,
        "status": _S,
        "created_at": T.TimestampNTZType(),
    },
)

POSITIONS = _table(
    {
        "id": _S,
        "firm_id": _S,
        "matter_id": _S,
        "clause_type": _S,
        "value": _S,
        "status": _S,
        "extracted_at": _TS,
        "extracted_by": _S,
        "created_at": _TS,
        "updated_at": _TS,
    },
    {
        "seq": _I,
        "counterparty_name": _S,
        "party_role": _S,
        "source_document_id": _S,
        "source_chunk_text": _S,
        "confidence": _D,
        "raw_extract": _S,
        "superseded_by": _S,
    },
)

EXTRACTION_JOBS = _table(
    {
        "id": _S,
        "firm_id": _S,
        "document_id": _S,
        "status": _S,
        "queued_at": _TS,
        "triggered_by": _S,
    },
    {
        "matter_id": _S,
        "started_at": _TS,
        "completed_at": _TS,
        "positions_extracted": _I,
        "chunks_embedded": _I,
        "embedding_model": _S,
        "extraction_model": _S,
        "error_message": _S,
        "triggered_by_user": _S,
    },
)

DOCUMENT_HANDOFFS = _table(
    {
        "id": _S,
        "firm_id": _S,
        "doc_title": _S,
        "doc_title_normalised": _S,
        "paragraph_count": _I,
        "word_count": _I,
        "summary": _S,
        "turn_count": _I,
        "last_active": _TS,
        "created_at": _TS,
        "updated_at": _TS,
    },
    {"last_active_user_id": _S},
)

AUDIT_LOG = _table(
    {"id": _S, "firm_id": _S, "action": _S, "result": _S, "occurred_at": _TS},
    {
        "user_id": _S,
        "resource_type": _S,
        "resource_id": _S,
        "ip_address": _S,
        "user_agent": _S,
        "request_id": _S,
        "payload": _S,
    },
)

ACCESS_CODES = _table(
    {
        "code": _S,
        "client_id": _S,
        "user_id": _S,
        "firm_id": _S,
        "issued_at": _TS,
        "expires_at": _TS,
    },
    {"redeemed_at": _TS},
)

SESSIONS = _table({}, {"user_id": _S, "firm_id": _S, "iat": _L})

TABLES = {
    "firms": FIRMS,
    "firm_users": FIRM_USERS,
    "matters": MATTERS,
    "documents": DOCUMENTS,
    "clients": CLIENTS,
    "matter_memory": MATTER_MEMORY,
    "positions": POSITIONS,
    "extraction_jobs": EXTRACTION_JOBS,
    "document_handoffs": DOCUMENT_HANDOFFS,
    "audit_log": AUDIT_LOG,
    "access_codes": ACCESS_CODES,
}

# The enumerations the stored data uses.
FIRM_STATUSES = ("active", "suspended", "archived")
MEMBER_ROLES = ("owner", "admin", "member")
MEMBER_STATUSES = ("active", "suspended", "removed")
MATTER_STAGES = ("pre_draft", "in_negotiation", "settled", "executed", "closed")
PRIVILEGE_SCOPES = ("privileged", "work_product", "common_interest", "open")
PARTY_KINDS = ("client", "counterparty", "common_interest")
POSITION_STATUSES = ("proposed", "open", "settled", "rejected")
PARTY_ROLES = ("our_side", "counterparty", "neutral", "mutual")
JOB_STATUSES = ("pending", "running", "completed", "failed", "cancelled", "skipped")
JOB_TRIGGERS = (
    "document_upload",
    "manual_reextract",
    "tool_call",
    "scheduled_backfill",
)
AUDIT_RESULTS = ("success", "denied", "error")
NOTE_TYPES = ("decision", "preference", "context")
NOTE_SCOPES = ("matter", "client")

# The clause vocabulary.
CLAUSE_TYPES = (
    "liability_cap",
    "ip_indemnity",
    "ip_ownership",
    "confidentiality",
    "term_length",
    "payment_terms",
    "termination_for_convenience",
    "termination_for_cause",
    "governing_law",
    "jurisdiction",
    "dispute_resolution",
    "warranties",
    "exclusivity",
    "non_compete",
    "non_solicit",
    "audit_rights",
    "data_protection",
    "change_control",
    "assignment",
    "force_majeure",
    "limitation_of_liability",
    "insurance",
    "indemnification",
    "sla",
    "milestones",
    "fees",
    "credits",
    "deliverables",
    "scope",
)

# Work sizes.
CHUNK_TARGET_CHARS = 2000
CHUNK_OVERLAP_CHARS = 200
SENTENCE_PACK_CHARS = 3000
CHARS_PER_TOKEN = 4
MIN_CONTENT_CHARS = 50
EMBED_BATCH = 100
EMBED_ATTEMPTS = 3
SEARCH_DEFAULT_K = 8
DIRECTORY_ROWS = 50
CODE_LIFE_SECONDS = 300
