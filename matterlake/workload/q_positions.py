"""Versioned positions: supersession, views, lists, counts, sinks."""

from pyspark.sql import functions as F

from matterlake.functions import coerce as C
from matterlake.operators import counterparties as CP
from matterlake.operators import positions as P
from matterlake.plans.storage import scratch_path
from matterlake.sources import sinks, tables
from matterlake.workload.registry import query

_KEY = "PARTITION BY firm_id, matter_id, clause_type ORDER BY created_at, seq, id"

LINKED = f"""
linked AS (
  SELECT *, lead(id) OVER ({_KEY}) AS superseded_by,
         lag(id) OVER ({_KEY}) AS supersedes,
         row_number() OVER ({_KEY}) AS version
  FROM positions)
"""


def _linked(s):
    return P.supersede(s.positions)


@query(
    "current_positions",
    f"""WITH {LINKED}
    SELECT firm_id, matter_id, clause_type, id, version, supersedes, status, value
    FROM linked WHERE superseded_by IS NULL""",
    "positions",
)
def current_positions(s):
    return P.current(_linked(s)).select(
        "firm_id",
        "matter_id",
        "clause_type",
        "id",
        "version",
        "supersedes",
        "status",
        "value",
    )


@query(
    "latest_positions",
    f"""WITH {LINKED}
    SELECT firm_id, matter_id, clause_type, id, created_at
    FROM linked WHERE superseded_by IS NULL""",
    "positions",
)
def latest_positions(s):
    return P.latest(s.positions).select(
        "firm_id", "matter_id", "clause_type", "id", "created_at"
    )


@query(
    "supersede_hot_keys",
    f"WITH {LINKED} SELECT id, superseded_by, supersedes, version FROM linked",
    "positions",
)
def supersede_hot_keys(s):
    # A threshold under the largest keys takes the sliced plan.
    return P.supersede(s.positions, hot_rows=15, slice_rows=700).select(
        "id", "superseded_by", "supersedes", "version"
    )


@query(
    "supersede_wide_key",
    """SELECT id, lead(id) OVER (
           PARTITION BY firm_id, matter_id, clause_type, party_role, counterparty_name
           ORDER BY created_at, seq, id) AS superseded_by
       FROM positions""",
    "positions",
)
def supersede_wide_key(s):
    wide = (*P.KEY, "party_role", "counterparty_name")
    return P.supersede(s.positions, keys=wide).select("id", "superseded_by")


@query(
    "position_history",
    f"""WITH {LINKED}
    SELECT firm_id, matter_id, clause_type, id, version, superseded_by, created_at
    FROM linked""",
    "positions",
)
def position_history(s):
    return P.history(s.positions).select(
        "firm_id",
        "matter_id",
        "clause_type",
        "id",
        "version",
        "superseded_by",
        "created_at",
    )


def _bucketed(s):
    """The positions stored in buckets of (firm, matter)."""
    path = scratch_path(s.spark, "bucketed")
    name = "positions_" + path[-32:]
    return tables.write_bucketed(s.positions, name, P.MATTER, P.ORDER, 8, path)


@query(
    "position_history_bucketed",
    f"""WITH {LINKED}
    SELECT firm_id, matter_id, clause_type, id, version, superseded_by, created_at
    FROM linked""",
    "positions",
)
def position_history_bucketed(s):
    return P.history(_bucketed(s), bucketed=True).select(
        "firm_id",
        "matter_id",
        "clause_type",
        "id",
        "version",
        "superseded_by",
        "created_at",
    )


@query(
    "current_positions_bucketed",
    f"""WITH {LINKED} SELECT firm_id, matter_id, clause_type, id, version FROM linked
    WHERE superseded_by IS NULL""",
    "positions",
)
def current_positions_bucketed(s):
    return P.current(P.supersede(_bucketed(s))).select(
        "firm_id", "matter_id", "clause_type", "id", "version"
    )


@query(
    "position_history_of_clause",
    f"""WITH {LINKED} SELECT matter_id, id, version FROM linked
    WHERE clause_type = 'purchase'""",
    "positions",
)
def position_history_of_clause(s):
    return P.history(s.positions, "purchase").select("matter_id", "id", "version")


@query(
    "position_view",
    f"""WITH {LINKED}
    SELECT id, firm_id, matter_id, clause_type, coalesce(value, '{{}}') AS value,
           coalesce(status, 'open') AS status, counterparty_name, party_role,
           source_document_id, source_chunk_text, extracted_at, extracted_by,
           confidence, created_at, superseded_by
    FROM linked""",
    "positions",
)
def position_view(s):
    return P.position_view(_linked(s))


_SUMMARY = """firm_id, matter_id, id, clause_type, value, status,
    counterparty_name AS counterparty, party_role,
    CASE WHEN starts_with(extracted_by, 'user:') THEN 'user' ELSE 'system' END
        AS asserted_by,
    created_at AS asserted_at, source_chunk_text AS source_note, confidence,
    superseded_by IS NOT NULL AS superseded"""


@query(
    "position_summary", f"WITH {LINKED} SELECT {_SUMMARY} FROM linked", "positions"
)
def position_summary(s):
    return P.position_summary(_linked(s))


@query(
    "open_positions",
    f"""WITH {LINKED} SELECT {_SUMMARY} FROM linked
    WHERE superseded_by IS NULL AND status = 'open'""",
    "positions",
)
def open_positions(s):
    return P.open_positions(_linked(s))


@query(
    "settled_positions",
    f"""WITH {LINKED} SELECT {_SUMMARY} FROM linked
    WHERE superseded_by IS NULL AND status = 'settled'""",
    "positions",
)
def settled_positions(s):
    return P.settled_positions(_linked(s))


@query(
    "position_counts",
    f"""WITH {LINKED}
    SELECT firm_id, matter_id, count(*) AS active_count,
           count(*) FILTER (WHERE status IN ('open', 'proposed')) AS open_count,
           count(*) FILTER (WHERE status = 'settled') AS settled_count
    FROM linked WHERE superseded_by IS NULL GROUP BY ALL""",
    "positions",
)
def position_counts(s):
    return P.position_counts(_linked(s))


@query(
    "matter_state",
    f"""WITH {LINKED}
    SELECT m.firm_id, m.id, m.matter_name, count(p.id) AS active_count,
           count(p.id) FILTER (WHERE p.status IN ('open', 'proposed')) AS open_count,
           count(p.id) FILTER (WHERE p.status = 'settled') AS settled_count
    FROM matters m LEFT JOIN linked p
      ON p.firm_id = m.firm_id AND p.matter_id = m.id AND p.superseded_by IS NULL
    GROUP BY ALL""",
    "positions matters",
)
def matter_state(s):
    return P.matter_state(s.matters, _linked(s)).select(
        "firm_id", "id", "matter_name", "active_count", "open_count", "settled_count"
    )


@query(
    "matter_positions",
    f"""WITH {LINKED}
    SELECT p.firm_id, p.matter_id,
           CASE WHEN status = 'settled' THEN 'settled' ELSE 'open' END AS section,
           p.id, clause_type, value AS current_value,
           counterparty_name AS counterparty, party_role,
           CASE WHEN starts_with(extracted_by, 'user:') THEN 'user' ELSE 'system' END
               AS asserted_by,
           p.created_at AS asserted_at,
           CASE WHEN status <> 'settled' THEN confidence END AS confidence
    FROM linked p JOIN matters m ON p.firm_id = m.firm_id AND p.matter_id = m.id
    WHERE superseded_by IS NULL AND status <> 'rejected'""",
    "positions matters",
)
def matter_positions(s):
    return P.matter_positions(s.matters, _linked(s))


# The older half of the events is the stored table, the newer half the batch.
_HALVES = """
halves AS (SELECT *, created_at >= (
    SELECT max(ts) - (max(ts) - min(ts)) / 2 FROM events) AS is_new FROM positions)
"""


def _halves(s):
    middle = (
        s.base("events")
        .agg(
            (F.max("ts") - (F.max("ts") - F.min("ts")) / 2).alias("at"),
        )
        .first()["at"]
    )
    rows = s.positions
    new = F.col("created_at") >= F.lit(middle).cast("timestamp_ntz")
    return P.supersede(rows.where(~new)).drop("supersedes", "version"), rows.where(new)


_WRITTEN = f"""
WITH {_HALVES},
old AS (SELECT *, lead(id) OVER ({_KEY}) AS link FROM halves WHERE NOT is_new),
new AS (SELECT *, lead(id) OVER ({_KEY}) AS link FROM halves WHERE is_new),
first_new AS (SELECT firm_id, matter_id, clause_type,
                     arg_min(id, (created_at, seq, id)) AS head
              FROM new GROUP BY ALL),
written AS (
  SELECT o.firm_id, o.id, coalesce(link, head) AS superseded_by, false AS is_new,
         link IS NULL AND head IS NOT NULL AS closed
  FROM old o LEFT JOIN first_new USING (firm_id, matter_id, clause_type)
  UNION ALL SELECT firm_id, id, link, true, link IS NOT NULL FROM new)
"""


@query(
    "write_positions",
    f"{_WRITTEN} SELECT firm_id, id, superseded_by FROM written",
    "positions",
)
def write_positions(s):
    stored, batch = _halves(s)
    return P.write_positions(stored, batch).select("firm_id", "id", "superseded_by")


@query(
    "write_position_counts",
    f"""{_WRITTEN} SELECT firm_id, count(*) FILTER (WHERE is_new) AS inserted,
        count(*) FILTER (WHERE closed) AS superseded
    FROM written GROUP BY firm_id HAVING count(*) FILTER (WHERE is_new) > 0""",
    "positions",
)
def write_position_counts(s):
    stored, batch = _halves(s)
    return P.write_counts(stored, batch)


@query(
    "assert_positions",
    """SELECT id, firm_id, matter_id, clause_type, value, status,
              counterparty_name, party_role,
              source_chunk_text, extracted_by, 1.0::DOUBLE AS confidence,
              lead(id) OVER (PARTITION BY firm_id, matter_id, clause_type
                             ORDER BY seq, id) AS superseded_by
       FROM (SELECT * REPLACE ('user:u' || ltrim(matter_id, 'm') AS extracted_by)
             FROM positions WHERE starts_with(extracted_by, 'user:'))""",
    "positions",
)
def assert_positions(s):
    said = s.positions.select(
        "id",
        "firm_id",
        "matter_id",
        "clause_type",
        "value",
        "status",
        "counterparty_name",
        "party_role",
        F.col("source_chunk_text").alias("source_note"),
        "seq",
        F.when(
            F.col("extracted_by").startswith("user:"),
            F.concat(F.lit("u"), F.ltrim("matter_id", F.lit("m"))),
        ).alias("user_id"),
    )
    accepted, _ = sinks.asserted_positions(
        said, now=F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    )
    return P.supersede(accepted).select(
        "id",
        "firm_id",
        "matter_id",
        "clause_type",
        "value",
        "status",
        "counterparty_name",
        "party_role",
        "source_chunk_text",
        "extracted_by",
        "confidence",
        "superseded_by",
    )


@query(
    "assert_rejected",
    """SELECT id, 'authenticated user required' AS reason FROM positions
       WHERE NOT starts_with(extracted_by, 'user:')""",
    "positions",
)
def assert_rejected(s):
    said = s.positions.withColumn(
        "user_id",
        F.when(
            C.asserted_by(F.col("extracted_by")) == "user", F.col("extracted_by")
        ),
    ).withColumn("source_note", F.col("source_chunk_text"))
    return sinks.asserted_positions(said)[1].select("id", "reason")


@query(
    "scan_one_firm",
    "SELECT id, firm_id, matter_id FROM positions WHERE firm_id = 'f3'",
    "positions",
)
def scan_one_firm(s):
    return tables.scan(s.positions, "f3").select("id", "firm_id", "matter_id")


@query(
    "scan_firms",
    """SELECT id, firm_id, matter_id FROM positions
       WHERE firm_id IN (SELECT 'f' || n_nationkey FROM nation WHERE n_regionkey = 1)""",
    "positions",
)
def scan_firms(s):
    firms = (
        s.base("nation")
        .where("n_regionkey = 1")
        .select(F.concat(F.lit("f"), F.col("n_nationkey").cast("string")).alias("firm_id"))
    )
    return tables.scan(s.positions, firms).select("id", "firm_id", "matter_id")


# ---- counterparties -------------------------------------------------------

_ASKED = """lower(p.counterparty_name) LIKE '%' || lower(r.counterparty) || '%'"""


@query(
    "counterparty_positions",
    f"""WITH {LINKED}
    SELECT r.request_id, p.firm_id, p.id, p.clause_type, p.counterparty_name, p.status
    FROM asked_parties r JOIN linked p ON p.firm_id = r.firm_id AND {_ASKED}
    WHERE p.superseded_by IS NULL
      AND (r.clause_type IS NULL OR r.clause_type = p.clause_type)""",
    "positions asked_parties",
)
def counterparty_positions(s):
    shown = ("firm_id", "id", "clause_type", "counterparty_name", "status")
    # The operator writes the rows it is given.
    linked = _linked(s).select(*shown, "superseded_by")
    return CP.counterparty_positions(s.asked_parties, linked).select("request_id", *shown)


@query(
    "counterparty_positions_literal",
    f"""WITH {LINKED}
    SELECT r.request_id, p.id FROM asked_parties r JOIN linked p
      ON p.firm_id = r.firm_id
     AND contains(lower(p.counterparty_name), lower(r.counterparty))
    WHERE p.superseded_by IS NULL
      AND (r.clause_type IS NULL OR r.clause_type = p.clause_type)""",
    "positions asked_parties",
)
def counterparty_positions_literal(s):
    linked = _linked(s).select(
        "firm_id", "id", "clause_type", "counterparty_name", "superseded_by"
    )
    return CP.counterparty_positions(s.asked_parties, linked, literal=True).select(
        "request_id", "id"
    )


PARTIES = """
parties AS (
  SELECT DISTINCT firm_id, id AS matter_id,
         'Nation ' || ltrim(regexp_extract(parties, 'Nation ([0-9]+)', 1)) || ' Ltd'
             AS party_id
  FROM matters WHERE parties LIKE '[%'
  UNION SELECT firm_id, id, 'unknown' FROM matters WHERE parties LIKE '[%')
"""

_INVOLVED = """
involved AS (
  SELECT DISTINCT r.request_id, r.firm_id, r.clause_type AS wanted, q.matter_id
  FROM asked_parties r JOIN parties q ON q.firm_id = r.firm_id
   AND contains(lower(q.party_id), lower(r.counterparty)))
"""

_STAGE = """coalesce(m.stage, CASE WHEN m.archived THEN 'closed'
                                   ELSE 'in_negotiation' END)"""

_FOUND = f"""
found AS (
  SELECT i.request_id, i.firm_id, i.wanted, p.clause_type, i.matter_id,
         {_STAGE} AS matter_stage, p.value,
         CASE WHEN p.status = 'settled' THEN 'settled' ELSE 'open' END AS status
  FROM involved i JOIN matters m ON m.firm_id = i.firm_id AND m.id = i.matter_id
  JOIN linked p ON p.firm_id = i.firm_id AND p.matter_id = i.matter_id
  WHERE p.superseded_by IS NULL AND p.status <> 'rejected'
  UNION ALL
  SELECT i.request_id, i.firm_id, i.wanted, 'governing_law', i.matter_id, {_STAGE},
         m.governing_law, 'settled'
  FROM involved i JOIN matters m ON m.firm_id = i.firm_id AND m.id = i.matter_id
  WHERE m.governing_law <> ''),
history AS (SELECT * EXCLUDE (wanted) FROM found
            WHERE wanted IS NULL OR wanted = clause_type)
"""


@query(
    "counterparty_history",
    f"WITH {LINKED}, {PARTIES}, {_INVOLVED}, {_FOUND} SELECT * FROM history",
    "positions matters asked_parties",
)
def counterparty_history(s):
    return CP.counterparty_history(s.asked_parties, s.matters, _linked(s))


@query(
    "counterparty_clause_counts",
    f"""WITH {LINKED}, {PARTIES}, {_INVOLVED}, {_FOUND}
    SELECT request_id, clause_type, count(*) AS n_positions,
           count(*) FILTER (WHERE status = 'open') AS n_open,
           count(*) FILTER (WHERE status = 'settled') AS n_settled
    FROM history GROUP BY ALL""",
    "positions matters asked_parties",
)
def counterparty_clause_counts(s):
    return CP.clause_counts(s.asked_parties, s.matters, _linked(s)).drop("firm_id")


@query(
    "counterparty_matter_counts",
    f"""WITH {PARTIES}, {_INVOLVED}
    SELECT r.request_id, r.firm_id, r.counterparty, count(i.matter_id) AS matter_count
    FROM asked_parties r LEFT JOIN involved i USING (request_id, firm_id)
    GROUP BY ALL""",
    "matters asked_parties",
)
def counterparty_matter_counts(s):
    return CP.matter_counts(s.asked_parties, s.matters)


# Orders as positions: a segment is the counterparty, every order a row.
@query(
    "segment_clause_totals",
    """SELECT c_mktsegment AS counterparty, o_orderpriority AS clause_type,
              o_orderstatus AS status, count(*) AS n_positions,
              count(DISTINCT o_custkey) AS n_matters,
              round(sum(o_totalprice), 2) AS total_value
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL""",
)
def segment_clause_totals(s):
    rows = s.base("orders").join(
        s.base("customer"), F.col("o_custkey") == F.col("c_custkey")
    )
    return rows.groupBy(
        F.col("c_mktsegment").alias("counterparty"),
        F.col("o_orderpriority").alias("clause_type"),
        F.col("o_orderstatus").alias("status"),
    ).agg(
        F.count(F.lit(1)).alias("n_positions"),
        F.count_distinct("o_custkey").alias("n_matters"),
        F.round(F.sum("o_totalprice"), 2).alias("total_value"),
    )
