"""Streams over the benchmark files; results must equal the batch.

Some drain a whole table at once, some get it in parts that arrive one after the
other, each drained by a call of its own that goes on from the checkpoint.
"""

from pyspark.sql import functions as F

from matterlake.plans.storage import scratch_path, written
from matterlake.streaming import handoffs as SH
from matterlake.streaming import jobs as J
from matterlake.streaming import supersession as SS
from matterlake.workload import q_documents as QD
from matterlake.workload.q_matters import (
    CODE_SQL,
    SESSION_SQL,
    attempts_of,
    codes_of,
    sessions_of,
)
from matterlake.workload.registry import query


def _stream(s, table):
    # A table may be one file or a folder of files; a stream takes the path of a
    # single file only as a glob.
    schema = s.base(table).schema
    return J.file_stream(s.spark, f"{s.sf_dir}/{table}.parque[t]", schema)


def _drained(s, stream, name):
    path = scratch_path(s.spark, name)
    J.drain_to_table(stream, path)
    return s.spark.read.schema(stream.schema).parquet(path)


def _text(column):
    return F.col(column).cast("string")


def _in_parts(s, rows, part, n, drain):
    """Write the ``n`` parts of ``rows`` one by one; ``drain`` a stream of each.

    A part is whatever new files there are, so it is one micro-batch of any size.
    """
    path = scratch_path(s.spark, "arriving")
    for i in range(n):
        rows.where(part == i).write.mode("append").parquet(path)
        drain(J.file_stream(s.spark, path, rows.schema))


def _positions(events):
    """The id, key and order columns of the positions stand-in."""
    user = F.col("user_id")
    return events.select(
        F.concat(F.lit("p"), _text("event_id")).alias("id"),
        F.concat(F.lit("f"), (user % 10).cast("string")).alias("firm_id"),
        F.concat(F.lit("m"), user.cast("string")).alias("matter_id"),
        F.col("event_type").alias("clause_type"),
        F.col("ts").alias("created_at"),
        (F.col("event_id") % 1000000).cast("int").alias("seq"),
    )


@query(
    "stream_supersession",
    """SELECT * FROM (
         SELECT firm_id, matter_id, clause_type, id, lead(id) OVER (
                  PARTITION BY firm_id, matter_id, clause_type
                  ORDER BY created_at, seq, id) AS superseded_by
         FROM positions) WHERE superseded_by IS NOT NULL""",
    "positions",
)
def stream_supersession(s):
    links, state = SS.fresh_paths(s.spark, "positions")
    SS.supersession_stream(_positions(_stream(s, "events")), links, state)
    return SS.links(s.spark, links)


# Positions arrive in three parts that are not in the order of their times.
ARRIVAL_PARTS = 3
ARRIVAL = f"CAST(substr(id, 2) AS BIGINT) % {ARRIVAL_PARTS}"


def _late_positions(s):
    rows = _positions(s.base("events"))
    part = F.substring("id", 2, 20).cast("long") % ARRIVAL_PARTS
    links, state = SS.fresh_paths(s.spark, "late")
    _in_parts(
        s, rows, part, ARRIVAL_PARTS, lambda st: SS.supersession_stream(st, links, state)
    )
    return links, state


@query(
    "stream_supersession_late",
    f"""SELECT * FROM (
         SELECT firm_id, matter_id, clause_type, id, lead(id) OVER (
                  PARTITION BY firm_id, matter_id, clause_type
                  ORDER BY {ARRIVAL}, created_at, seq, id) AS superseded_by
         FROM positions) WHERE superseded_by IS NOT NULL""",
    "positions",
)
def stream_supersession_late(s):
    return SS.links(s.spark, _late_positions(s)[0])


@query(
    "stream_current_positions",
    f"""SELECT firm_id, matter_id, clause_type, id FROM positions
        QUALIFY row_number() OVER (
          PARTITION BY firm_id, matter_id, clause_type
          ORDER BY {ARRIVAL} DESC, created_at DESC, seq DESC, id DESC) = 1""",
    "positions",
)
def stream_current_positions(s):
    return SS.current_ids(s.spark, _late_positions(s)[1])


@query(
    "stream_audit",
    """SELECT id, firm_id, user_id, action, result, payload, occurred_at FROM actions""",
    "actions",
)
def stream_audit(s):
    user = F.col("user_id")
    actions = _stream(s, "events").select(
        F.concat(F.lit("a"), _text("event_id")).alias("id"),
        F.concat(F.lit("f"), (user % 10).cast("string")).alias("firm_id"),
        F.concat(F.lit("u"), user.cast("string")).alias("user_id"),
        F.concat(F.lit("tool."), F.col("event_type")).alias("action"),
        F.when(F.col("event_type") == "error", "error")
        .otherwise("success")
        .alias("result"),
        F.col("props").alias("payload"),
        F.col("ts").alias("occurred_at"),
    )
    path = scratch_path(s.spark, "audit")
    J.audit_stream(actions, path)
    return s.spark.read.parquet(path).select(
        "id", "firm_id", "user_id", "action", "result", "payload", "occurred_at"
    )


@query("stream_sessions", SESSION_SQL + " WHERE valid", "firm_users")
def stream_sessions(s):
    sessions = sessions_of(_stream(s, "events"))
    judged = J.valid_session_stream(sessions, s.firm_users)
    return _drained(s, judged.drop("iat"), "sessions").withColumn("valid", F.lit(True))


@query(
    "stream_redemptions",
    f"""WITH {CODE_SQL} SELECT code, attempt_id FROM first_ WHERE n = 1""",
)
def stream_redemptions(s):
    attempts = attempts_of(_stream(s, "events"))
    first = J.first_redemption_stream(attempts, codes_of(s.base("events")))
    return _drained(s, first.select("code", "attempt_id"), "redemptions")


@query(
    "stream_intake",
    f"WITH RECURSIVE {QD.INTAKE_SQL} SELECT * FROM ledger",
    "jobs docs",
)
def stream_intake(s):
    """Documents arrive as files; every new one without a label is pending."""
    labels = s.base("labels").select("doc_id", "quality")
    n = F.col("doc_id")
    firm = F.concat(F.lit("f"), ((n % 100) % 10).cast("string"))
    requests = (
        _stream(s, "documents")
        .select("doc_id")
        .join(labels, "doc_id", "left")
        .select(
            F.concat(F.lit("j"), _text("doc_id")).alias("id"),
            firm.alias("firm_id"),
            F.concat(F.lit("d"), _text("doc_id")).alias("document_id"),
            F.concat(F.lit("m"), (n % 100).cast("string")).alias("matter_id"),
            F.when(F.col("quality") == 1, "completed")
            .when(F.col("quality") == 0, "failed")
            .otherwise("pending")
            .alias("status"),
            F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("queued_at"),
        )
    )

    def handle(pending):
        return QD.intake_of(s, jobs=pending).ledger.select(*QD.LEDGER_COLUMNS)

    path = scratch_path(s.spark, "ledger")
    J.intake_stream(requests, handle, path)
    return s.spark.read.parquet(path).select(*QD.LEDGER_COLUMNS)


UPDATE_PARTS = 3


def _updated(i: int) -> str:
    return f"TIMESTAMP '2025-01-0{i + 1} 00:00:00'"


@query(
    "stream_handoffs",
    f"WITH {QD.STORED_SQL}, "
    + ", ".join(
        QD.upsert_sql(i + 1, f"doc_id % {UPDATE_PARTS} = {i}", _updated(i))
        for i in range(UPDATE_PARTS)
    )
    + f" SELECT * FROM after_{UPDATE_PARTS}",
    "sized",
)
def stream_handoffs(s):
    """Three micro-batches of updates, each of which finds what the last one left."""
    # The texts are read once: the table and each part are made from their sizes.
    sized = written(s.sized, "sized")
    updates = QD.updates_of(sized)
    stored = QD.stored_handoffs(sized)
    part = F.substring("request_id", 2, 20).cast("long") % UPDATE_PARTS
    path, mark = scratch_path(s.spark, "handoffs"), scratch_path(s.spark, "mark")
    now = F.expr(
        f"CAST(date_add(DATE '2025-01-01', CAST(CAST(substr(request_id, 2) AS BIGINT) % {UPDATE_PARTS} AS INT))"
        " AS timestamp_ntz)"
    )
    _in_parts(
        s,
        updates,
        part,
        UPDATE_PARTS,
        lambda st: SH.handoff_stream(st, stored, path, mark, now, buckets=16, depth=2),
    )
    return SH.stored_handoffs(s.spark, path, stored.schema, buckets=16)
