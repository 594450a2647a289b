"""Row preparation for the writers, and the writers themselves.

Each ``*_rows`` function is a pure projection; ``append`` and ``replace``
store the result.  Nothing is updated in place: the table format is Parquet.
"""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake import schemas as S
from matterlake.functions import coerce as C
from matterlake.plans.skew import top_per_group

CHUNK = "chunk"


def derived_id(*parts: Column | str) -> Column:
    """A reproducible id: the same input gives the same id on a retry."""
    shown = [F.col(p) if isinstance(p, str) else p for p in parts]
    return F.sha2(
        F.concat_ws(
            "\x1f", *[F.coalesce(p.cast("string"), F.lit("\x1e")) for p in shown]
        ),
        256,
    )


def append(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    df.write.mode("append").partitionBy(*partition_by).parquet(path)


def replace_partitions(df: DataFrame, path: str, partition_by: Sequence[str]) -> None:
    """Overwrite only the partitions that ``df`` touches."""
    (
        df.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy(*partition_by)
        .parquet(path)
    )


def in_firm(
    requests: DataFrame, matters: DataFrame, how: str = "left_semi"
) -> DataFrame:
    """Requests whose matter exists in their firm (``left_anti``: the others)."""
    known = matters.select("firm_id", F.col("id").alias("matter_id"))
    return requests.join(known, ["firm_id", "matter_id"], how).select(
        *requests.columns
    )


def ingest_documents(
    incoming: DataFrame, matters: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(accepted rows with defaults, rejected rows with a reason)."""
    now = F.current_timestamp() if now is None else now
    accepted = (
        in_firm(incoming, matters)
        .withColumn("is_precedent", F.coalesce("is_precedent", F.lit(False)))
        .withColumn("status", F.lit("active"))
        .withColumn("added_at", now)
        .withColumn("last_modified", now)
    )
    rejected = in_firm(incoming, matters, "left_anti").withColumn(
        "reason", F.lit("matter not found in this firm")
    )
    return accepted, rejected


def audit_rows(actions: DataFrame, now: Column | None = None) -> DataFrame:
    """Audit rows with every column present; ``action_date`` partitions them.

    An id is derived from what the action carries, never from the clock, so a
    retry without ``occurred_at`` gives the same id.
    """
    now = F.current_timestamp() if now is None else now
    have = set(actions.columns)
    optional = [
        F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
        for f in S.AUDIT_LOG.fields
        if f.nullable
    ]
    when = F.col("occurred_at") if "occurred_at" in have else now
    given = ["id"] if "id" in have else []
    rows = actions.select(
        *given, "firm_id", "action", "result", when.alias("occurred_at"), *optional
    )
    if not given:
        happened = F.col("occurred_at") if "occurred_at" in have else F.lit(None)
        rows = rows.withColumn(
            "id",
            derived_id("firm_id", "user_id", "action", "request_id", happened, "payload"),
        )
    return rows.withColumn("action_date", F.to_date("occurred_at"))


def append_audit(actions: DataFrame, path: str) -> None:
    append(audit_rows(actions), path, ["firm_id", "action_date"])


def chunk_rows(chunks: DataFrame, model: str, now: Column | None = None) -> DataFrame:
    """Memory rows of the chunks that have a vector.

    Keyed by (document, chunk index): a repeated run gives the same ids, so
    ``replace_partitions`` by document does not double the chunks.
    """
    now = F.localtimestamp() if now is None else now
    return chunks.where(F.col("embedding").isNotNull()).select(
        derived_id("firm_id", "source_document_id", "chunk_index").alias("id"),
        "firm_id",
        "matter_id",
        F.lit(CHUNK).alias("memory_type"),
        F.col("text").alias("content"),
        F.lit(None).cast("string").alias("scope"),
        "source_document_id",
        "chunk_index",
        "embedding",
        F.lit(model).alias("embedding_model"),
        F.lit("active").alias("status"),
        now.alias("created_at"),
    )


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """Per document: chunks stored, and skipped for want of a vector."""
    has = F.col("embedding").isNotNull()
    return chunks.groupBy("firm_id", "source_document_id").agg(
        F.count_if(has).alias("inserted"), F.count_if(~has).alias("skipped")
    )


def note_rows(
    notes: DataFrame, matters: DataFrame, model: str, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(memory rows of lawyer notes, rejected notes with a reason)."""
    now = F.localtimestamp() if now is None else now
    kept = in_firm(notes, matters).select(
        F.col("note_id").alias("id"),
        "firm_id",
        "matter_id",
        F.coalesce("note_type", F.lit("context")).alias("memory_type"),
        F.col("note").alias("content"),
        F.coalesce("scope", F.lit("matter")).alias("scope"),
        "embedding",
        F.when(F.col("embedding").isNotNull(), F.lit(model)).alias("embedding_model"),
        F.lit("pending").alias("status"),
        now.alias("created_at"),
    )
    rejected = in_firm(notes, matters, "left_anti").withColumn(
        "reason", F.lit("matter not found in this firm")
    )
    return kept, rejected


def request_extraction(
    docs: DataFrame, trigger: str, now: Column | None = None
) -> DataFrame:
    """One pending ledger row per document.

    A ``request_id`` column, where given, makes the id the same on a retry and
    tells two requests for one document apart; otherwise ``now`` does.
    """
    if trigger not in S.JOB_TRIGGERS:
        raise ValueError(f"unknown trigger: {trigger}")
    now = F.current_timestamp() if now is None else now
    user = (
        F.col("triggered_by_user")
        if "triggered_by_user" in docs.columns
        else F.lit(None).cast("string")
    )
    asked = F.col("request_id") if "request_id" in docs.columns else now
    return docs.select(
        derived_id("firm_id", "document_id", F.lit(trigger), asked).alias("id"),
        "firm_id",
        "document_id",
        "matter_id",
        F.lit("pending").alias("status"),
        now.alias("queued_at"),
        F.lit(trigger).alias("triggered_by"),
        user.alias("triggered_by_user"),
    )


def upsert(
    base: DataFrame,
    changes: DataFrame,
    keys: Sequence[str],
    changed_at: str,
    tie: str | None = None,
) -> DataFrame:
    """Base and changes merged: per key the newest change, else the base row.

    ``changes`` carries ``changed_at`` (and an optional ``tie`` column); both
    stay out of the result unless the base has them.  Changes of equal time are
    told apart by all their columns, the larger value first, so a rerun agrees.
    """
    order = [F.col(changed_at).desc_nulls_last()]
    order += [F.col(c).desc_nulls_last() for c in ([tie] if tie else [])]
    order += [F.col(c).desc_nulls_last() for c in changes.columns if c not in (changed_at, tie)]
    latest = top_per_group(changes, keys, order, 1).select(*base.columns)
    # A small change feed is broadcast by size, and the base is not shuffled.
    untouched = base.join(latest.select(*keys), list(keys), "left_anti")
    return untouched.select(*base.columns).unionByName(latest)


def asserted_positions(
    asserts: DataFrame, now: Column | None = None
) -> tuple[DataFrame, DataFrame]:
    """(position rows stated by a user, rejected rows with a reason)."""
    now = F.current_timestamp() if now is None else now
    known = F.col("user_id").isNotNull()
    rows = asserts.where(known).select(
        "id",
        "firm_id",
        "matter_id",
        "clause_type",
        "value",
        "status",
        "counterparty_name",
        "party_role",
        F.lit(None).cast("string").alias("source_document_id"),
        F.col("source_note").alias("source_chunk_text"),
        now.alias("extracted_at"),
        F.concat(F.lit(C.USER_PREFIX), "user_id").alias("extracted_by"),
        F.lit(1.0).alias("confidence"),
        now.alias("created_at"),
        now.alias("updated_at"),
        "seq",
    )
    rejected = asserts.where(~known).withColumn(
        "reason", F.lit("authenticated user required")
    )
    return rows, rejected
