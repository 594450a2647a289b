"""Legal tables made from the benchmark tables, as SQL both engines read.

``{events}`` and the like name a benchmark table, ``{ntz}`` the timestamp type
without zone.  Every stand-in reads its whole table.
"""

from pyspark.sql import DataFrame, SparkSession

from matterlake.plans.storage import spread_if_narrow

BASE = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()

LONG_TEXTS = ("documents",)

SQL: dict[str, str] = {}

SQL["positions"] = """
SELECT 'p' || CAST(event_id AS STRING) AS id,
       'f' || CAST(user_id % 10 AS STRING) AS firm_id,
       'm' || CAST(user_id AS STRING) AS matter_id,
       event_type AS clause_type,
       props AS value,
       CASE k % 4 WHEN 0 THEN 'proposed' WHEN 1 THEN 'open'
                  WHEN 2 THEN 'settled' ELSE 'rejected' END AS status,
       CASE WHEN k % 13 > 0
            THEN 'Party ' || CAST(k % 13 AS STRING) || ' Ltd' END AS counterparty_name,
       CASE k % 5 WHEN 0 THEN 'our_side' WHEN 1 THEN 'counterparty'
                  WHEN 2 THEN 'neutral' WHEN 3 THEN 'mutual' END AS party_role,
       CASE WHEN k % 3 > 0
            THEN 'd' || CAST(event_id % 97 AS STRING) END AS source_document_id,
       'note ' || CAST(event_id AS STRING) AS source_chunk_text,
       ts AS extracted_at,
       CASE WHEN k % 3 = 0 THEN 'user:u' || CAST(user_id AS STRING)
            ELSE 'rules' END AS extracted_by,
       value / 1000 AS confidence,
       ts AS created_at,
       ts AS updated_at,
       CAST(event_id % 1000000 AS INT) AS seq
FROM (SELECT *, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k
      FROM {events}) e
"""

SQL["matters"] = """
SELECT 'm' || CAST(c_custkey AS STRING) AS id,
       'u' || CAST(c_custkey % 40 AS STRING) AS user_id,
       'f' || CAST(c_custkey % 10 AS STRING) AS firm_id,
       CASE WHEN c_custkey % 23 > 0
            THEN 'c' || CAST(c_nationkey AS STRING) END AS client_id,
       c_mktsegment AS client_name,
       c_name AS matter_name,
       CASE c_nationkey % 3 WHEN 0 THEN 'England' WHEN 1 THEN '' END AS governing_law,
       CASE WHEN c_custkey % 9 = 0 THEN NULL
            WHEN c_custkey % 9 = 1 THEN '{{"a":1}}'
            ELSE '[{{"id":"' || c_mktsegment || '","kind":"client"}},{{"name":"Nation '
                 || CAST(c_nationkey AS STRING)
                 || ' Ltd","role":"supplier"}},5,{{}}]' END AS parties,
       CASE WHEN c_custkey % 3 = 0
            THEN '{{"matter_type":"msa"}}' END AS deal_parameters,
       CASE WHEN c_custkey % 5 = 0 THEN '{{"draft": 3}}' END AS context,
       CASE WHEN c_custkey % 17 > 0
            THEN CAST(DATE '2020-01-01' + CAST(c_custkey % 1000 AS INT) AS {ntz})
            END AS created_at,
       CASE WHEN c_custkey % 7 > 0
            THEN CAST(DATE '2022-01-01' + CAST(c_custkey % 800 AS INT) AS {ntz})
            END AS last_accessed,
       c_custkey % 11 = 0 AS archived,
       CASE c_custkey % 6 WHEN 0 THEN 'settled' WHEN 1 THEN 'executed' END AS stage,
       CASE WHEN c_custkey % 4 = 0 THEN 'privileged' END AS privilege_scope
FROM {customer}
"""

SQL["firm_users"] = """
SELECT 'u' || CAST(user_id AS STRING) AS user_id,
       'f' || CAST(user_id % 10 AS STRING) AS firm_id,
       CASE user_id % 3 WHEN 0 THEN 'owner' WHEN 1 THEN 'admin'
                        ELSE 'member' END AS role,
       MIN(ts) AS added_at,
       CASE WHEN user_id % 5 = 0 THEN 'suspended' ELSE 'active' END AS status,
       MAX(CASE WHEN event_type = 'error' AND value < 20 THEN ts END)
           AS min_token_iat
FROM {events} GROUP BY user_id
UNION ALL
SELECT 'u' || CAST(user_id AS STRING), 'f' || CAST((user_id + 1) % 10 AS STRING),
       'member', MAX(ts), 'active', NULL
FROM {events} WHERE event_type = 'purchase' GROUP BY user_id
"""

# Documents: text as it is (sentence path) and with line breaks doubled
# (paragraph path).
SQL["docs"] = """
SELECT 'd' || CAST(doc_id AS STRING) AS id,
       'f' || CAST((doc_id % 100) % 10 AS STRING) AS firm_id,
       CASE WHEN doc_id % 19 > 0
            THEN 'm' || CAST(doc_id % 100 AS STRING) END AS matter_id,
       'u' || CAST(doc_id % 40 AS STRING) AS user_id,
       'Memo ' || CAST(doc_id AS STRING) || ' ' || source || '.docx' AS name,
       replace(text, chr(10), chr(10) || chr(10)) AS content,
       CASE WHEN doc_id % 2 = 0 THEN lang END AS doc_type
FROM {documents}
"""

SQL["plain_docs"] = """
SELECT 'd' || CAST(doc_id AS STRING) AS id,
       'f' || CAST((doc_id % 100) % 10 AS STRING) AS firm_id,
       text AS content
FROM {documents}
"""

SQL["jobs"] = """
SELECT 'j' || CAST(d.doc_id AS STRING) AS id,
       'f' || CAST((d.doc_id % 100) % 10 AS STRING) AS firm_id,
       'd' || CAST(d.doc_id AS STRING) AS document_id,
       'm' || CAST(d.doc_id % 100 AS STRING) AS matter_id,
       CASE WHEN l.quality = 1 THEN 'completed' WHEN l.quality = 0 THEN 'failed'
            ELSE 'pending' END AS status,
       CAST(DATE '2023-01-01' + CAST((d.doc_id * 7) % 300 AS INT) AS {ntz})
           AS queued_at
FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id
"""

# Matters, stored documents and hints for the resolution cascade.
SQL["named_matters"] = """
SELECT 'm' || CAST(p_partkey AS STRING) AS id,
       'f' || CAST(p_partkey % 4 AS STRING) AS firm_id,
       p_name || ' ' || p_brand AS matter_name,
       CASE WHEN p_partkey % 3 > 0
            THEN p_type || ' ' || CAST(p_size AS STRING) END AS client_name,
       CASE WHEN p_partkey % 13 > 0
            THEN CAST(DATE '2020-01-01' + CAST(p_partkey % 700 AS INT) AS {ntz})
            END AS created_at
FROM {part}
"""

SQL["named_docs"] = """
SELECT 'd' || CAST(o_orderkey AS STRING) AS id,
       'f' || CAST(o_orderkey % 4 AS STRING) AS firm_id,
       CASE WHEN o_orderkey % 7 > 0
            THEN 'm' || CAST(o_custkey AS STRING) END AS matter_id,
       'Order ' || CAST(o_orderkey % 9000 AS STRING) || ' v'
           || CAST(o_orderkey % 5 AS STRING) || '.docx' AS name,
       o_orderkey % 10 = 0 AS is_precedent,
       CASE WHEN o_orderkey % 3 > 0
            THEN 'w' || CAST(o_orderkey % 14000 AS STRING) END AS word_doc_id
FROM {orders}
"""

SQL["hints"] = """
SELECT 'r' || CAST(c_custkey AS STRING) AS request_id,
       'f' || CAST(c_custkey % 4 AS STRING) AS firm_id,
       CASE WHEN c_custkey % 6 = 0
            THEN 'w' || CAST(c_custkey + 4 AS STRING) END AS word_doc_id,
       CASE c_custkey % 6
            WHEN 0 THEN 'Unknown paper.docx'
            WHEN 1 THEN 'Order ' || CAST(c_custkey AS STRING) || ' v'
                        || CAST(c_custkey % 5 AS STRING) || '.docx'
            WHEN 2 THEN 'order ' || CAST(c_custkey AS STRING)
            WHEN 3 THEN 'Form - ' || p_name || ' ' || p_brand || ' - May.docx'
            WHEN 5 THEN p_name || '_v4_final.docx' END AS document_name,
       CASE WHEN c_custkey % 6 = 4
            THEN 'Agreed between ' || p_type || ' ' || CAST(p_size AS STRING)
                 || ' and a further party, ' || c_name END AS content_snippet
FROM {customer} JOIN {part} ON c_custkey = p_partkey
"""

# Drafts with the size signals of a handoff.
SQL["sized"] = """
SELECT doc_id,
       'f' || CAST(doc_id % 5 AS STRING) AS firm_id,
       'Memo ' || source || ' ' || lang
           || CASE doc_id % 4 WHEN 0 THEN '_v3 (2).docx'
                              WHEN 1 THEN ' v1.2 - signed (12).doc'
                              WHEN 2 THEN '_FINAL.docx' ELSE '.docx' END AS doc_title,
       CAST(length(text) - length(replace(text, chr(10), '')) + 1 AS INT)
           AS paragraph_count,
       CAST(length(text) - length(replace(text, ' ', '')) + 1 AS INT) AS word_count,
       CAST(DATE '2023-01-01' + CAST((doc_id * 11) % 400 AS INT) AS {ntz})
           AS last_active
FROM {documents}
"""

SQL["memory"] = """
SELECT 'v' || CAST(vec_id AS STRING) AS id,
       'f' || CAST(label AS STRING) AS firm_id,
       'm' || CAST(vec_id % 7 AS STRING) AS matter_id,
       'chunk' AS memory_type,
       'text of ' || CAST(vec_id AS STRING) AS content,
       embedding
FROM {embeddings}
"""

SQL["turns"] = """
SELECT 't' || CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id,
       'f' || CAST(conv_id % 5 AS STRING) AS firm_id,
       'm' || CAST(conv_id AS STRING) AS matter_id,
       role AS memory_type,
       text AS content
FROM {conversations}
"""

SQL["questions"] = """
SELECT 'q' || CAST(item_id AS STRING) AS request_id,
       'f' || CAST(item_id % 5 AS STRING) AS firm_id,
       text AS query
FROM {benchmark}
"""

SQL["job_events"] = """
SELECT 'j' || CAST(user_id AS STRING) AS job_id,
       'f' || CAST(user_id % 10 AS STRING) AS firm_id,
       'd' || CAST(user_id AS STRING) AS document_id,
       CASE event_type WHEN 'signup' THEN 'pending' WHEN 'view' THEN 'running'
                       WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed'
                       ELSE 'skipped' END AS status,
       ts AS event_at,
       CASE WHEN event_type = 'purchase'
            THEN CAST(event_id % 9 AS INT) END AS positions_extracted,
       CASE WHEN event_type = 'purchase'
            THEN CAST(event_id % 31 AS INT) END AS chunks_embedded,
       CASE WHEN event_type = 'error' THEN 'failed at ' || props END AS error_message
FROM {events}
"""

SQL["actions"] = """
SELECT 'a' || CAST(event_id AS STRING) AS id,
       'f' || CAST(user_id % 10 AS STRING) AS firm_id,
       'u' || CAST(user_id AS STRING) AS user_id,
       'tool.' || event_type AS action,
       CASE WHEN event_type = 'error' THEN 'error' ELSE 'success' END AS result,
       props AS payload,
       ts AS occurred_at
FROM {events}
"""

SQL["asked_parties"] = """
SELECT 'r' || CAST(s_suppkey AS STRING) AS request_id,
       'f' || CAST(s_suppkey % 10 AS STRING) AS firm_id,
       CASE s_suppkey % 4 WHEN 0 THEN 'party ' || CAST(s_suppkey % 13 AS STRING)
                          WHEN 1 THEN 'Party _ L'
                          WHEN 2 THEN 'nation ' || CAST(s_nationkey AS STRING)
                          ELSE 'LTD' END AS counterparty,
       CASE WHEN s_suppkey % 3 = 0 THEN 'purchase' END AS clause_type
FROM {supplier}
"""


# Rows of every table and feed that has rules, some of which break them.
SQL["raw_firms"] = """
SELECT CAST(s_suppkey AS STRING) AS id,
       CASE WHEN s_suppkey % 7 > 0 THEN s_name END AS name,
       CASE s_suppkey % 5 WHEN 0 THEN 'active' WHEN 1 THEN 'closed'
                          WHEN 2 THEN 'archived' WHEN 3 THEN 'suspended' END AS status
FROM {supplier}
"""

SQL["raw_firm_users"] = """
SELECT CAST(event_id AS STRING) AS id,
       CASE WHEN event_id % 11 > 0 THEN 'u' || CAST(user_id AS STRING) END AS user_id,
       CASE WHEN event_id % 13 > 0 THEN 'f1' END AS firm_id,
       CASE event_type WHEN 'signup' THEN 'owner' WHEN 'view' THEN 'admin'
                       WHEN 'purchase' THEN 'member' WHEN 'error' THEN 'guest' END AS role,
       CASE event_id % 4 WHEN 0 THEN 'active' WHEN 1 THEN 'removed'
                         WHEN 2 THEN 'gone' ELSE 'suspended' END AS status
FROM {events}
"""

SQL["raw_matters"] = """
SELECT 'm' || CAST(c_custkey AS STRING) AS id,
       CASE c_custkey % 4 WHEN 0 THEN 'settled' WHEN 1 THEN 'Settled'
                          WHEN 2 THEN 'pre_draft' END AS stage,
       CASE c_custkey % 3 WHEN 0 THEN 'open' WHEN 1 THEN 'secret' END AS privilege_scope
FROM {customer}
"""

SQL["raw_jobs"] = """
SELECT CASE WHEN doc_id % 17 > 0 THEN CAST(doc_id AS STRING) END AS id,
       CAST(doc_id AS STRING) AS row_name,
       CASE WHEN doc_id % 19 > 0 THEN 'f' END AS firm_id,
       CASE WHEN doc_id % 23 > 0 THEN 'd' || CAST(doc_id AS STRING) END AS document_id,
       CASE WHEN toxic = 1 THEN 'lost' WHEN quality = 1 THEN 'completed' END AS status,
       CASE doc_id % 3 WHEN 0 THEN 'tool_call' WHEN 1 THEN 'by hand'
                       ELSE 'document_upload' END AS triggered_by
FROM {labels}
"""

SQL["raw_handoffs"] = """
SELECT CAST(o_orderkey AS STRING) AS id,
       CASE WHEN o_orderkey % 5 > 0 THEN 'f' END AS firm_id,
       CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS doc_title,
       CAST(o_orderkey % 9 AS INT) - 1 AS paragraph_count,
       CAST(o_custkey % 11 AS INT) - 1 AS word_count,
       CASE WHEN o_orderkey % 3 > 0 THEN o_orderstatus END AS summary,
       CASE WHEN o_orderkey % 2 > 0 THEN CAST(o_custkey % 4 AS INT) - 2 END AS turn_count
FROM {orders}
"""

SQL["raw_audit"] = """
SELECT CAST(event_id AS STRING) AS id,
       CASE WHEN event_id % 6 > 0 THEN 'f' END AS firm_id,
       CASE WHEN event_id % 5 > 0 THEN event_type END AS action,
       CASE event_type WHEN 'error' THEN 'error' WHEN 'view' THEN 'denied'
                       WHEN 'signup' THEN 'success' WHEN 'purchase' THEN 'paid' END AS result
FROM {events}
"""

SQL["raw_notes"] = """
SELECT CAST(doc_id AS STRING) AS id,
       CASE WHEN doc_id % 8 > 0 THEN 'm' END AS matter_id,
       CASE WHEN doc_id % 9 > 0 THEN text END AS note,
       CASE doc_id % 4 WHEN 0 THEN 'decision' WHEN 1 THEN 'guess' END AS note_type,
       CASE doc_id % 3 WHEN 0 THEN 'matter' WHEN 1 THEN 'world' END AS scope
FROM {documents}
"""

SQL["raw_signals"] = """
SELECT CAST(doc_id AS STRING) AS id,
       CASE WHEN doc_id % 8 > 0 THEN text END AS doc_title,
       CAST(doc_id % 6 AS INT) - 1 AS paragraph_count,
       CASE WHEN doc_id % 5 > 0 THEN CAST(n_chars AS INT) - 100 END AS word_count,
       CASE WHEN doc_id % 7 > 0 THEN text END AS summary,
       CASE WHEN doc_id % 2 > 0 THEN CAST(doc_id % 4 AS INT) - 1 END AS turn_count
FROM {documents}
"""

SQL["raw_asserts"] = """
SELECT CAST(event_id AS STRING) AS id,
       CASE WHEN event_id % 6 > 0 THEN 'm' END AS matter_id,
       CASE event_id % 5 WHEN 0 THEN '' WHEN 1 THEN event_type ELSE 'fees' END AS clause_type,
       CASE WHEN event_id % 7 > 0 THEN props END AS value,
       CASE event_id % 4 WHEN 0 THEN 'open' WHEN 1 THEN 'shut' WHEN 2 THEN 'settled' END
         AS status,
       CASE event_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'Acme' END AS counterparty_name,
       CASE event_id % 8 WHEN 0 THEN 'mutual' WHEN 1 THEN 'nobody' END AS party_role
FROM {events}
"""

SQL["raw_edits"] = """
SELECT CAST(doc_id AS STRING) AS id,
       CASE WHEN doc_id % 6 > 0 THEN text END AS old_text,
       CASE WHEN doc_id % 5 > 0 THEN substr(text, 20) END AS new_text
FROM {documents}
"""

SQL["raw_drafts"] = """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id,
       CASE WHEN conv_id % 6 > 0 THEN text END AS document_text
FROM {conversations}
"""

SQL["raw_searches"] = """
SELECT CAST(conv_id AS STRING) || '-' || CAST(turn AS STRING) AS id,
       CASE WHEN conv_id % 6 > 0 THEN substr(text, 1, CAST(turn AS INT)) END AS query
FROM {conversations}
"""


def _format(name: str, tables: dict[str, str], ntz: str) -> str:
    return SQL[name].format(ntz=ntz, **tables).strip()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A benchmark table; long texts in too few splits are dealt out first."""
    scan = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread_if_narrow(scan) if name in LONG_TEXTS else scan


def frame(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The stand-in as a Spark frame over the Parquet files."""
    used = [t for t in BASE if "{" + t + "}" in SQL[name]]
    for t in used:
        table(spark, sf_dir, t).createOrReplaceTempView(f"standin_{t}")
    tables = {t: f"standin_{t}" for t in BASE}
    return spark.sql(_format(name, tables, "TIMESTAMP_NTZ"))


def with_standins(names: list[str], body: str) -> str:
    """``body`` with the stand-ins as leading common table expressions."""
    tables = {t: t for t in BASE}
    ctes = [f"{n} AS ({_format(n, tables, 'TIMESTAMP')})" for n in names]
    body = body.strip()
    recursive = "WITH RECURSIVE " if body.startswith("WITH RECURSIVE ") else "WITH "
    if body.startswith(("WITH RECURSIVE ", "WITH ")):
        head = ", ".join(ctes)
        rest = body.removeprefix("WITH RECURSIVE ").removeprefix("WITH ")
        return f"{recursive}{head}, {rest}" if ctes else f"{recursive}{rest}"
    return f"WITH {', '.join(ctes)} {body}" if ctes else body
