"""Matters, tenancy, validation, sinks, ledger and access."""

from pyspark.sql import functions as F

from matterlake import schemas as S
from matterlake.functions import coerce as C
from matterlake.functions import temporal as M
from matterlake.operators import access as A
from matterlake.operators import ledger as L
from matterlake.operators import matters as MT
from matterlake.operators import tenancy as T
from matterlake.operators import validation as V
from matterlake.plans import intake as I
from matterlake.sources import sinks, tables
from matterlake.workload.q_positions import PARTIES
from matterlake.workload.registry import query

SQL_NOW = "TIMESTAMP '2024-06-01 00:00:00'"


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")

_VIEW = """
view_ AS (
  SELECT id, coalesce(firm_id, '') AS firm_id, coalesce(client_id, '') AS client_id,
         matter_name, client_name,
         coalesce(json_extract_string(deal_parameters, '$.matter_type'), 'other')
             AS matter_type,
         coalesce(stage, CASE WHEN archived THEN 'closed' ELSE 'in_negotiation' END)
             AS stage,
         coalesce(privilege_scope, 'open') AS privilege_scope,
         coalesce(created_at, TIMESTAMP '1970-01-01 00:00:00') AS opened_at,
         CASE WHEN archived THEN last_accessed END AS closed_at,
         CASE WHEN governing_law <> '' THEN governing_law END
             AS settled_governing_law,
         coalesce(context, '{}') AS state, created_at,
         CASE WHEN parties LIKE '[%' THEN
           ['Nation ' || regexp_extract(parties, 'Nation ([0-9]+)', 1) || ' Ltd',
            'unknown'] ELSE [] END AS others
  FROM matters)
"""


@query(
    "matter_view",
    f"""WITH {_VIEW}
    SELECT id, firm_id, client_id, matter_name, client_name, matter_type, stage,
           privilege_scope, opened_at, closed_at, settled_governing_law, state,
           CASE WHEN len(others) = 0 THEN '' ELSE client_name || '/client/party,'
             || others[1] || '/counterparty/supplier,unknown/counterparty/party' END
             AS shown_parties
    FROM view_""",
    "matters",
)
def matter_view(s):
    shown = F.array_join(
        F.transform(
            "parties", lambda p: F.concat_ws("/", p["party_id"], p["kind"], p["role"])
        ),
        ",",
    )
    return (
        MT.matter_view(s.matters)
        .withColumn("shown_parties", shown)
        .drop("parties", "created_at")
    )


@query(
    "normalised_parties",
    """SELECT id, unnest(CASE WHEN parties LIKE '[%' THEN
        [client_name, 'Nation ' || regexp_extract(parties, 'Nation ([0-9]+)', 1)
         || ' Ltd', 'unknown'] ELSE [] END) AS party_id,
        unnest(CASE WHEN parties LIKE '[%' THEN
        ['client', 'counterparty', 'counterparty'] ELSE [] END) AS kind,
        unnest(CASE WHEN parties LIKE '[%' THEN
        ['party', 'supplier', 'party'] ELSE [] END) AS role
       FROM matters""",
    "matters",
)
def normalised_parties(s):
    return s.matters.select(
        "id", F.explode(C.normalise_parties(F.col("parties"))).alias("p")
    ).select("id", "p.*")


_LISTED = f"""{_VIEW},
listed AS (SELECT * FROM view_)
"""
_DIRECTORY = """firm_id, id, matter_name, client_id, client_name, matter_type, stage,
    opened_at, array_to_string(others, ',') AS counterparties,
    0 AS open_position_count"""


def _directory(df):
    return df.withColumn("counterparties", F.array_join("counterparties", ","))


@query(
    "matter_directory",
    f"WITH {_LISTED} SELECT {_DIRECTORY} FROM listed",
    "matters",
)
def matter_directory(s):
    return _directory(MT.list_matters(s.matters))


@query(
    "matter_directory_of_party",
    f"""WITH {_LISTED} SELECT {_DIRECTORY} FROM listed
    WHERE len(list_filter(others, lambda o: contains(lower(o), 'nation 1'))) > 0""",
    "matters",
)
def matter_directory_of_party(s):
    return _directory(MT.list_matters(s.matters, counterparty="NATION 1"))


@query(
    "matter_directory_filtered",
    f"""WITH {_VIEW},
    chosen AS (SELECT v.* FROM view_ v JOIN matters m ON m.id = v.id
               WHERE m.client_id = 'c3' AND m.stage = 'settled')
    SELECT {_DIRECTORY} FROM chosen""",
    "matters",
)
def matter_directory_filtered(s):
    return _directory(MT.list_matters(s.matters, client_id="c3", stage="settled"))


@query(
    "matter_directory_page",
    f"""WITH {_VIEW},
    ranked AS (SELECT v.*, row_number() OVER (PARTITION BY firm_id
        ORDER BY created_at DESC NULLS FIRST, id) AS rank FROM view_ v)
    SELECT {_DIRECTORY} FROM ranked WHERE rank <= 50""",
    "matters",
)
def matter_directory_page(s):
    """The page of newest matters, asked for as such."""
    return _directory(MT.list_matters(s.matters, n=S.DIRECTORY_ROWS))


@query(
    "matter_directory_counts",
    f"WITH {_LISTED} SELECT firm_id, count(*) AS count FROM listed GROUP BY firm_id",
    "matters",
)
def matter_directory_counts(s):
    return MT.directory_counts(MT.list_matters(s.matters))


@query(
    "matter_document_summary",
    f"""WITH {_VIEW}
    SELECT firm_id, id, matter_name, client_id, client_name, stage, matter_type,
           opened_at, closed_at, len(others)::INT AS counterparty_count,
           (settled_governing_law IS NOT NULL)::INT AS settled_position_count,
           0 AS open_position_count
    FROM view_""",
    "matters",
)
def matter_document_summary(s):
    return MT.document_summary(MT.matter_view(s.matters))


@query(
    "matters_for_requests",
    """SELECT 'o' || o_orderkey AS request_id, 'f' || o_custkey % 9 AS firm_id,
              'm' || o_custkey AS matter_id, m.id IS NOT NULL AS found, m.matter_name
       FROM orders LEFT JOIN matters m
         ON m.firm_id = 'f' || o_custkey % 9 AND m.id = 'm' || o_custkey""",
    "matters",
)
def matters_for_requests(s):
    key = F.col("o_custkey")
    requests = s.base("orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("request_id"),
        F.concat(F.lit("f"), (key % 9).cast("string")).alias("firm_id"),
        F.concat(F.lit("m"), key.cast("string")).alias("matter_id"),
    )
    return MT.matters_for(requests, s.matters).select(
        "request_id", "firm_id", "matter_id", "found", "matter_name"
    )


@query(
    "active_matters",
    """SELECT id, matter_name, client_name, last_accessed,
              coalesce(strftime(last_accessed, '%b %-d, %Y'), '—') AS shown
       FROM matters WHERE NOT archived""",
    "matters",
)
def active_matters(s):
    return tables.active_matters(s.matters).select(
        "id",
        "matter_name",
        "client_name",
        "last_accessed",
        M.display_date(F.col("last_accessed")).alias("shown"),
    )


@query(
    "newest_orders_null_first",
    """SELECT * EXCLUDE (d) FROM (
         SELECT o_custkey, o_orderkey, d,
                row_number() OVER (PARTITION BY o_custkey
                    ORDER BY d DESC NULLS FIRST, o_orderkey) AS rank
         FROM (SELECT *, CASE WHEN o_orderkey % 9 > 0 THEN o_orderdate END AS d
               FROM orders)) WHERE rank <= 3""",
)
def newest_orders_null_first(s):
    from matterlake.plans.containment import newest_first
    from matterlake.plans.skew import top_per_group

    dated = s.base("orders").withColumn(
        "d", F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderdate"))
    )
    return top_per_group(
        dated, ["o_custkey"], newest_first("d", "o_orderkey"), 3
    ).select("o_custkey", "o_orderkey", "rank")


# ---- tenancy --------------------------------------------------------------

_MEMBER = """
member AS (
  SELECT user_id, arg_min(firm_id, (added_at, firm_id)) AS member_firm
  FROM firm_users WHERE status = 'active' GROUP BY user_id)
"""


def _untagged(df):
    """Every third row has lost its firm."""
    n = F.substring("id", 2, 20).cast("long")
    return df.withColumn("firm_id", F.when(n % 3 > 0, F.col("firm_id")))


_UNTAGGED = """
untagged AS (SELECT * REPLACE (CASE WHEN substr(id, 2)::BIGINT % 3 > 0
                                    THEN firm_id END AS firm_id) FROM matters)
"""


@query(
    "tag_matters_by_user",
    f"""WITH {_MEMBER}, {_UNTAGGED}
    SELECT id, user_id, coalesce(firm_id, member_firm) AS firm_id
    FROM untagged LEFT JOIN member USING (user_id)""",
    "firm_users matters",
)
def tag_matters_by_user(s):
    return T.tag_firm(_untagged(s.matters), s.firm_users).select(
        "id", "user_id", "firm_id"
    )


@query(
    "tag_clients_by_user",
    f"""WITH {_MEMBER}
    SELECT 's' || s_suppkey AS id, coalesce(
        CASE WHEN s_nationkey % 2 = 0 THEN 'f' || s_nationkey END, member_firm)
        AS firm_id
    FROM supplier LEFT JOIN member ON user_id = 'u' || s_nationkey""",
    "firm_users",
)
def tag_clients_by_user(s):
    nation = F.col("s_nationkey")
    clients = s.base("supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("id"),
        F.concat(F.lit("u"), nation.cast("string")).alias("user_id"),
        F.when(nation % 2 == 0, F.concat(F.lit("f"), nation.cast("string"))).alias(
            "firm_id"
        ),
    )
    return T.tag_firm(clients, s.firm_users).select("id", "firm_id")


@query(
    "tag_documents_by_matter",
    f"""WITH {_UNTAGGED}
    SELECT d.id, d.matter_id, coalesce(
        CASE WHEN substr(d.id, 2)::BIGINT % 4 > 0 THEN d.firm_id END, m.firm_id)
        AS firm_id
    FROM docs d LEFT JOIN untagged m ON m.id = d.matter_id""",
    "docs matters",
)
def tag_documents_by_matter(s):
    n = F.substring("id", 2, 20).cast("long")
    docs = s.docs.withColumn("firm_id", F.when(n % 4 > 0, F.col("firm_id")))
    return T.tag_firm_by_matter(docs, _untagged(s.matters)).select(
        "id", "matter_id", "firm_id"
    )


@query(
    "tag_coverage",
    f"""WITH {_UNTAGGED}
    SELECT 'matters' AS table_name, count(*) AS total, count(firm_id) AS firm_tagged
    FROM untagged
    UNION ALL SELECT 'documents', count(*), count(firm_id) FROM docs
    UNION ALL SELECT 'positions', count(*), count(firm_id) FROM positions""",
    "matters docs positions",
)
def tag_coverage(s):
    return T.tag_coverage(
        {
            "matters": _untagged(s.matters),
            "documents": s.docs,
            "positions": s.positions,
        }
    )


# ---- validation -----------------------------------------------------------


@query(
    "validate_orders",
    """SELECT o_orderkey, array_to_string(list_filter([
         CASE WHEN o_orderstatus NOT IN ('O', 'F')
              THEN 'o_orderstatus is not an allowed value' END,
         CASE WHEN NOT o_totalprice BETWEEN 1000 AND 400000
              THEN 'o_totalprice is out of range' END,
         CASE WHEN length(o_orderpriority) > 8
              THEN 'o_orderpriority has a bad length' END],
         lambda x: x IS NOT NULL), '; ') AS reasons
       FROM orders""",
)
def validate_orders(s):
    checks = V.rules(
        V.required("o_orderkey"),
        V.in_set("o_orderstatus", ("O", "F")),
        V.in_range("o_totalprice", 1000, 400000),
        V.length_between("o_orderpriority", 0, 8),
    )
    return V.with_reasons(s.base("orders"), checks).select(
        "o_orderkey", F.array_join("reasons", "; ").alias("reasons")
    )


@query(
    "validate_positions",
    """SELECT count(*) AS n_rows,
              count(*) FILTER (WHERE confidence > 1 OR confidence < 0) AS n_bad
       FROM positions""",
    "positions",
)
def validate_positions(s):
    judged = V.with_reasons(s.positions, V.position_rules())
    return judged.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(F.size("reasons") > 0).alias("n_bad"),
    )


@query(
    "validate_uploads",
    """SELECT id, array_to_string(list_filter([
         CASE WHEN matter_id IS NULL THEN 'matter_id is missing' END,
         CASE WHEN length(content) NOT BETWEEN 20 AND 500000
              THEN 'content has a bad length' END],
         lambda x: x IS NOT NULL), '; ') AS reasons
       FROM docs WHERE matter_id IS NULL OR length(content) NOT BETWEEN 20 AND 500000""",
    "docs",
)
def validate_uploads(s):
    docs = s.docs.withColumn("word_doc_id", F.lit(None).cast("string"))
    rejected = V.validate(docs, V.upload_rules())[1]
    return rejected.select("id", F.array_join("reasons", "; ").alias("reasons"))


@query(
    "duplicate_keys",
    """SELECT l_orderkey, l_linenumber, count(*) AS n_rows FROM lineitem
       GROUP BY ALL HAVING count(*) > 1""",
)
def duplicate_keys(s):
    return V.duplicate_keys(s.base("lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "orphan_positions",
    """SELECT p.id, p.matter_id FROM positions p
       WHERE NOT EXISTS (SELECT 1 FROM named_matters m
                         WHERE m.id = p.matter_id AND m.client_name IS NOT NULL)""",
    "positions named_matters",
)
def orphan_positions(s):
    parents = s.named_matters.where(F.col("client_name").isNotNull())
    return V.orphans(s.positions, "matter_id", parents, "id").select(
        "id", "matter_id"
    )


# ---- sinks ----------------------------------------------------------------


def _incoming(s):
    # Every second document names a matter of another firm.
    n = F.substring("id", 2, 20).cast("long")
    other = F.concat(F.lit("f"), (n % 7).cast("string"))
    return s.docs.withColumn(
        "firm_id", F.when(n % 2 == 0, F.col("firm_id")).otherwise(other)
    ).withColumn("is_precedent", F.when(n % 5 == 0, F.lit(True)))


_INCOMING = """
incoming AS (
  SELECT * REPLACE (CASE WHEN n % 2 = 0 THEN firm_id ELSE 'f' || n % 7 END
                    AS firm_id), n % 5 = 0 AS is_precedent
  FROM (SELECT *, substr(id, 2)::BIGINT AS n FROM docs)),
judged AS (SELECT i.*, m.id IS NOT NULL AS known FROM incoming i LEFT JOIN matters m
           ON m.firm_id = i.firm_id AND m.id = i.matter_id)
"""


@query(
    "ingest_documents",
    f"""WITH {_INCOMING}
    SELECT id, firm_id, matter_id, is_precedent, 'active' AS status,
           {SQL_NOW} AS added_at, {SQL_NOW} AS last_modified
    FROM judged WHERE known""",
    "docs matters",
)
def ingest_documents(s):
    accepted, _ = sinks.ingest_documents(_incoming(s), s.matters, now())
    return accepted.select(
        "id",
        "firm_id",
        "matter_id",
        "is_precedent",
        "status",
        "added_at",
        "last_modified",
    )


@query(
    "ingest_rejected",
    f"""WITH {_INCOMING}
    SELECT id, firm_id, matter_id, 'matter not found in this firm' AS reason
    FROM judged WHERE NOT known""",
    "docs matters",
)
def ingest_rejected(s):
    _, rejected = sinks.ingest_documents(_incoming(s), s.matters, now())
    return rejected.select("id", "firm_id", "matter_id", "reason")


@query(
    "audit_rows",
    """SELECT id, firm_id, user_id, action, result, payload, occurred_at,
              CAST(occurred_at AS DATE) AS action_date,
              CAST(NULL AS VARCHAR) AS resource_type FROM actions""",
    "actions",
)
def audit_rows(s):
    return sinks.audit_rows(s.actions).select(
        "id",
        "firm_id",
        "user_id",
        "action",
        "result",
        "payload",
        "occurred_at",
        "action_date",
        "resource_type",
    )


@query(
    "note_rows",
    f"""SELECT t.id, t.firm_id, t.matter_id,
          coalesce(CASE WHEN t.memory_type = 'user' THEN 'decision' END, 'context')
              AS memory_type, t.content, 'matter' AS scope, 'pending' AS status,
          CASE WHEN t.memory_type = 'assistant' THEN 'hashing' END AS embedding_model,
          {SQL_NOW} AS created_at
        FROM turns t JOIN matters m ON m.firm_id = t.firm_id AND m.id = t.matter_id""",
    "turns matters",
)
def note_rows(s):
    kind = F.col("memory_type")
    notes = s.turns.select(
        F.col("id").alias("note_id"),
        "firm_id",
        "matter_id",
        F.when(kind == "user", "decision").alias("note_type"),
        F.col("content").alias("note"),
        F.lit(None).cast("string").alias("scope"),
        F.when(kind == "assistant", F.array(F.lit(1.0).cast("float"))).alias(
            "embedding"
        ),
    )
    kept, _ = sinks.note_rows(notes, s.matters, "hashing", now())
    return kept.drop("embedding")


@query(
    "request_extraction",
    f"""SELECT firm_id, id AS document_id, matter_id, 'pending' AS status,
          {SQL_NOW} AS queued_at, 'document_upload' AS triggered_by,
          user_id AS triggered_by_user FROM docs""",
    "docs",
)
def request_extraction(s):
    docs = s.docs.select(
        "firm_id",
        F.col("id").alias("document_id"),
        "matter_id",
        F.col("user_id").alias("triggered_by_user"),
    )
    return sinks.request_extraction(docs, "document_upload", now()).drop("id")


@query(
    "upsert_members",
    """WITH changes AS (
         SELECT 'u' || user_id AS user_id, 'f' || user_id % 10 AS firm_id,
                CASE WHEN event_type = 'error' THEN 'member' ELSE 'admin' END AS role,
                ts, event_id
         FROM events WHERE event_type IN ('error', 'click')),
       latest AS (SELECT user_id, firm_id, arg_max(role, (ts, event_id)) AS role
                  FROM changes GROUP BY ALL)
       SELECT user_id, firm_id, coalesce(l.role, b.role) AS role
       FROM latest l FULL JOIN firm_users b USING (user_id, firm_id)""",
    "firm_users",
)
def upsert_members(s):
    user = F.col("user_id")
    changes = (
        s.base("events")
        .where(F.col("event_type").isin("error", "click"))
        .select(
            F.concat(F.lit("u"), user.cast("string")).alias("user_id"),
            F.concat(F.lit("f"), (user % 10).cast("string")).alias("firm_id"),
            F.when(F.col("event_type") == "error", "member")
            .otherwise("admin")
            .alias("role"),
            "ts",
            "event_id",
        )
    )
    base = s.firm_users.select("user_id", "firm_id", "role")
    return sinks.upsert(base, changes, ["user_id", "firm_id"], "ts", "event_id")


# ---- ledger and backfill ----------------------------------------------------


@query(
    "ledger_state",
    """WITH ranked AS (
         SELECT *, CASE status WHEN 'pending' THEN 0 WHEN 'running' THEN 1 ELSE 2 END
                AS step FROM job_events),
       state AS (
         SELECT firm_id, job_id, max(document_id) AS document_id,
           arg_max(status, (event_at, step)) AS status,
           min(event_at) FILTER (WHERE status = 'pending') AS queued_at,
           min(event_at) FILTER (WHERE status = 'running') AS started_at,
           max(event_at) FILTER (WHERE step = 2) AS completed_at,
           max(event_at) AS last_at
         FROM ranked GROUP BY ALL)
       SELECT s.firm_id, s.job_id, s.document_id, s.status, queued_at, started_at,
         completed_at, CASE WHEN s.status = 'failed' THEN 0
           ELSE epoch_us(completed_at) // 1000 - epoch_us(started_at) // 1000 END AS duration_ms,
         e.positions_extracted, e.chunks_embedded, e.error_message
       FROM state s JOIN job_events e ON e.job_id = s.job_id AND e.event_at = s.last_at
        AND e.status = s.status""",
    "job_events",
)
def ledger_state(s):
    return L.ledger_state(s.job_events)


@query(
    "job_outcomes",
    """SELECT firm_id, count(*) FILTER (WHERE status = 'completed') AS completed,
              count(*) FILTER (WHERE status = 'failed') AS failed,
              count(*) FILTER (WHERE status = 'skipped') AS skipped
       FROM job_events GROUP BY firm_id""",
    "job_events",
)
def job_outcomes(s):
    return L.job_outcomes(s.job_events)


@query(
    "oldest_pending",
    """SELECT * FROM (SELECT firm_id, id, queued_at, row_number() OVER (
         PARTITION BY firm_id ORDER BY queued_at, id) AS rank
       FROM jobs WHERE status = 'pending') WHERE rank <= 5""",
    "jobs",
)
def oldest_pending(s):
    return L.oldest_pending(s.jobs, 5).select("firm_id", "id", "queued_at", "rank")


@query(
    "backfill_candidates",
    """SELECT firm_id, id AS document_id, matter_id FROM docs d
       WHERE matter_id IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM jobs j WHERE j.document_id = d.id AND j.firm_id = d.firm_id
           AND j.status = 'completed')""",
    "docs jobs",
)
def backfill_candidates(s):
    return I.backfill_candidates(s.docs, s.jobs)


@query(
    "backfill_limited",
    """SELECT firm_id, id AS document_id, matter_id FROM docs d
       WHERE matter_id IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM jobs j WHERE j.document_id = d.id AND j.firm_id = d.firm_id
           AND j.status = 'completed') ORDER BY firm_id, id LIMIT 50""",
    "docs jobs",
)
def backfill_limited(s):
    return I.backfill_candidates(s.docs, s.jobs, limit=50)


@query(
    "content_gate",
    """SELECT id, length(trim(content, ' ' || chr(9) || chr(10) || chr(13))) < 50
           AS skipped FROM plain_docs""",
    "plain_docs",
)
def content_gate(s):
    return s.plain_docs.select("id", I.too_short(F.col("content")).alias("skipped"))


@query(
    "extraction_context",
    """SELECT d.id, d.doc_type, m.matter_name, m.client_name, m.client_name AS our_side
       FROM docs d LEFT JOIN matters m
         ON m.firm_id = d.firm_id AND m.id = d.matter_id""",
    "docs matters",
)
def extraction_context(s):
    return I.with_extraction_context(s.docs, s.matters).select(
        "id", "doc_type", "matter_name", "client_name", "our_side"
    )


# ---- access -----------------------------------------------------------------

_SESSIONS = """
sessions AS (SELECT event_id AS session_id, 'u' || user_id AS user_id,
                    'f' || user_id % 10 AS firm_id, floor(epoch(ts)) AS iat
             FROM events WHERE event_type = 'signup')
"""


def sessions_of(events):
    user = F.col("user_id")
    return events.where(F.col("event_type") == "signup").select(
        F.col("event_id").alias("session_id"),
        F.concat(F.lit("u"), user.cast("string")).alias("user_id"),
        F.concat(F.lit("f"), (user % 10).cast("string")).alias("firm_id"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("iat"),
    )


SESSION_SQL = f"""WITH {_SESSIONS}
    SELECT s.session_id, s.user_id, s.firm_id,
           NOT coalesce(s.iat < epoch(u.min_token_iat), false) AS valid
    FROM sessions s LEFT JOIN firm_users u USING (user_id, firm_id)"""


@query("judged_sessions", SESSION_SQL, "firm_users")
def judged_sessions(s):
    return A.judged_sessions(sessions_of(s.base("events")), s.firm_users).drop("iat")


CODE_SQL = """
codes AS (
  SELECT 'k' || user_id || '-' || event_type AS code, 'c1' AS client_id,
         'u' || user_id AS user_id, 'f' || user_id % 10 AS firm_id,
         min(ts) + INTERVAL 9 DAY AS expires_at,
         CASE WHEN user_id % 8 = 0 THEN min(ts) END AS redeemed_at
  FROM events GROUP BY user_id, event_type),
attempts AS (SELECT event_id AS attempt_id, 'k' || user_id || '-' || event_type AS code,
                    ts AS attempted_at FROM events),
first_ AS (
  SELECT *, row_number() OVER (PARTITION BY code ORDER BY attempted_at, attempt_id) AS n
  FROM attempts JOIN codes USING (code)
  WHERE redeemed_at IS NULL AND expires_at > attempted_at + INTERVAL 6 DAY)
"""


def _code():
    return F.concat(
        F.lit("k"), F.col("user_id").cast("string"), F.lit("-"), F.col("event_type")
    )


def codes_of(events):
    user = F.col("user_id")
    issued = events.groupBy("user_id", "event_type").agg(F.min("ts").alias("issued"))
    return issued.select(
        _code().alias("code"),
        F.lit("c1").alias("client_id"),
        F.concat(F.lit("u"), user.cast("string")).alias("user_id"),
        F.concat(F.lit("f"), (user % 10).cast("string")).alias("firm_id"),
        M.expiry(F.col("issued"), 9 * 86400).alias("expires_at"),
        F.when(user % 8 == 0, F.col("issued")).alias("redeemed_at"),
    )


def attempts_of(events):
    return events.select(
        F.col("event_id").alias("attempt_id"),
        _code().alias("code"),
        M.expiry(F.col("ts"), 6 * 86400).alias("attempted_at"),
    )


@query(
    "first_redemptions",
    f"""WITH {CODE_SQL} SELECT code, attempt_id,
        attempted_at + INTERVAL 6 DAY AS redeemed_at, user_id, firm_id
    FROM first_ WHERE n = 1""",
)
def first_redemptions(s):
    events = s.base("events")
    return A.first_redemptions(attempts_of(events), codes_of(events)).drop("client_id")


@query(
    "authorised_pairs",
    """WITH requests AS (
         SELECT event_id AS request_id, 'f' || user_id % 10 AS firm_id,
           CASE WHEN event_type <> 'view' THEN 'u' || user_id END AS caller_id,
           'u' || (user_id + 10 * (event_id % 40)) AS target_id FROM events)
       SELECT r.*, c.role AS caller_role, t.role AS target_role,
         CASE WHEN r.caller_id IS NULL THEN 'caller not authenticated'
              WHEN NOT coalesce(c.status = 'active' AND c.role IN ('owner', 'admin'),
                                false) THEN 'caller is not an active owner or admin'
              WHEN t.role IS NULL THEN 'target is not a member of this firm' END
           AS reason,
         reason IS NULL AS allowed
       FROM requests r
       LEFT JOIN firm_users c ON c.firm_id = r.firm_id AND c.user_id = r.caller_id
       LEFT JOIN firm_users t ON t.firm_id = r.firm_id AND t.user_id = r.target_id""",
    "firm_users",
)
def authorised_pairs(s):
    return A.authorised_pairs(_pair_requests(s), s.firm_users)


def _pair_requests(s):
    user = F.col("user_id")
    return s.base("events").select(
        F.col("event_id").alias("request_id"),
        F.concat(F.lit("f"), (user % 10).cast("string")).alias("firm_id"),
        F.when(
            F.col("event_type") != "view", F.concat(F.lit("u"), user.cast("string"))
        ).alias("caller_id"),
        F.concat(
            F.lit("u"), (user + 10 * (F.col("event_id") % 40)).cast("string")
        ).alias("target_id"),
    )


@query(
    "revoked_members",
    f"""WITH requests AS (
         SELECT 'f' || user_id % 10 AS firm_id, 'u' || user_id AS caller_id,
           'u' || (user_id + 10 * (event_id % 40)) AS target_id FROM events
         WHERE event_type <> 'view'),
       hit AS (SELECT DISTINCT r.firm_id, r.target_id FROM requests r
         JOIN firm_users c ON c.firm_id = r.firm_id AND c.user_id = r.caller_id
         WHERE c.status = 'active' AND c.role IN ('owner', 'admin'))
       SELECT u.user_id, u.firm_id, CASE WHEN h.target_id IS NOT NULL THEN {SQL_NOW}
              ELSE u.min_token_iat END AS min_token_iat
       FROM firm_users u LEFT JOIN hit h
         ON h.firm_id = u.firm_id AND h.target_id = u.user_id""",
    "firm_users",
)
def revoked_members(s):
    verdicts = A.authorised_pairs(_pair_requests(s), s.firm_users)
    return A.revoke(s.firm_users, verdicts, now()).select(
        "user_id", "firm_id", "min_token_iat"
    )


@query(
    "users_by_email",
    """WITH users AS (SELECT 'u' || c_custkey AS user_id,
                lower(c_mktsegment) || c_custkey % 700 || '@x.org' AS email FROM customer),
       first_ AS (SELECT email, min(user_id) AS user_id FROM users GROUP BY email)
       SELECT 'r' || o_orderkey AS request_id, f.user_id
       FROM orders LEFT JOIN first_ f
         ON f.email = 'building' || o_custkey % 900 || '@x.org'""",
)
def users_by_email(s):
    def address(prefix, number):
        return F.concat(prefix, number.cast("string"), F.lit("@X.org"))

    users = s.base("customer").select(
        F.concat(F.lit("u"), F.col("c_custkey").cast("string")).alias("user_id"),
        address(F.col("c_mktsegment"), F.col("c_custkey") % 700).alias("email"),
    )
    requests = s.base("orders").select(
        F.concat(F.lit("r"), F.col("o_orderkey").cast("string")).alias("request_id"),
        address(F.lit("Building"), F.col("o_custkey") % 900).alias("email"),
    )
    return A.users_by_email(requests, users).select("request_id", "user_id")


@query(
    "position_list_counts",
    """WITH linked AS (SELECT *, lead(id) OVER (
           PARTITION BY firm_id, matter_id, clause_type ORDER BY created_at, seq, id)
           AS superseded_by FROM positions)
       SELECT firm_id, matter_id, count(*) AS count,
              count(*) FILTER (WHERE superseded_by IS NULL AND status = 'open')
                  AS open_count FROM linked GROUP BY ALL""",
    "positions",
)
def position_list_counts(s):
    from matterlake.operators import positions as P

    linked = P.supersede(s.positions)
    is_open = F.col("superseded_by").isNull() & (F.col("status") == "open")
    return linked.groupBy("firm_id", "matter_id").agg(
        F.count(F.lit(1)).alias("count"), F.count_if(is_open).alias("open_count")
    )


@query(
    "other_counterparties",
    f"""WITH {PARTIES}
    SELECT m.id, coalesce(string_agg(q.party_id, ',' ORDER BY q.party_id), '') AS others
    FROM matters m LEFT JOIN parties q
      ON q.firm_id = m.firm_id AND q.matter_id = m.id AND q.party_id <> 'unknown'
    GROUP BY m.id""",
    "matters",
)
def other_counterparties(s):
    view = MT.matter_view(s.matters)
    others = C.others_of(C.counterparties(F.col("parties")), F.lit("unknown"))
    return view.select("id", F.array_join(others, ",").alias("others"))
