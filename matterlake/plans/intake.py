"""Document intake, preview, search and backfill, composed from operators."""

from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake import schemas as S
from matterlake.functions import text as X
from matterlake.functions.models import EmbedFn, ExtractFn
from matterlake.operators import positions as P
from matterlake.operators import textmodel as M
from matterlake.operators.ledger import job_outcomes
from matterlake.operators.vectors import vector_topk
from matterlake.plans.storage import written
from matterlake.sources.sinks import chunk_rows, derived_id, request_extraction

_CONTEXT = {
    "matter": "matter_name",
    "client": "client_name",
    "side": "our_side",
    "kind": "doc_type",
}


def too_short(content: Column) -> Column:
    """Under 50 characters without the blanks around them (or no text)."""
    return F.length(X.trim_blanks(F.coalesce(content, F.lit("")))) < (
        S.MIN_CONTENT_CHARS
    )


def with_extraction_context(docs: DataFrame, matters: DataFrame) -> DataFrame:
    """Adds matter name, client name and our side; the type is kept."""
    known = matters.select(
        "firm_id",
        F.col("id").alias("matter_id"),
        "matter_name",
        "client_name",
        F.col("client_name").alias("our_side"),
    )
    return docs.join(known, ["firm_id", "matter_id"], "left")


def backfill_candidates(
    docs: DataFrame,
    jobs: DataFrame,
    limit: int | None = None,
    limit_first: bool = False,
) -> DataFrame:
    """Documents with text and matter and no completed job.

    ``limit`` applies after the finished ones are removed, so repeated limited
    runs make progress; ``limit_first`` applies it before.
    """
    ready = docs.where(F.col("content").isNotNull() & F.col("matter_id").isNotNull())
    done = jobs.where(F.col("status") == "completed").select(
        "firm_id", F.col("document_id").alias("id")
    )
    if limit is not None and limit_first:
        ready = ready.orderBy("firm_id", "id").limit(limit)
    left = ready.join(done, ["firm_id", "id"], "left_anti")
    if limit is not None and not limit_first:
        left = left.orderBy("firm_id", "id").limit(limit)
    return left.select("firm_id", F.col("id").alias("document_id"), "matter_id")


@dataclass
class IntakeResult:
    """What one intake run adds: memory rows, positions and ledger rows."""

    memory: DataFrame
    positions: DataFrame
    ledger: DataFrame


def run_intake(
    jobs: DataFrame,
    docs: DataFrame,
    matters: DataFrame,
    embed_fn: EmbedFn,
    extract_fn: ExtractFn | None = None,
    rules: Mapping[str, str] | None = None,
    embedding_model: str = "hashing",
    extraction_model: str = M.RULES_MODEL,
    now: Column | None = None,
    lossy: bool = False,
) -> IntakeResult:
    """All pending jobs in one job graph; a failure is a ledger row.

    Model results are written once to the shared folder, because the rows to
    store and the counts of the ledger both read them and a model call is the
    dear part.
    """
    now = F.current_timestamp() if now is None else now
    pending = jobs.where(F.col("status") == "pending").select(
        F.col("id").alias("job_id"),
        "firm_id",
        "document_id",
        F.col("matter_id").alias("_job_matter"),
        "queued_at",
    )
    stored = docs.select(
        "firm_id",
        F.col("id").alias("document_id"),
        F.col("matter_id").alias("_doc_matter"),
        "content",
        "doc_type",
        F.lit(True).alias("_found"),
    )
    matched = pending.join(stored, ["firm_id", "document_id"], "left")
    judged = matched.select(
        "job_id",
        "firm_id",
        "document_id",
        "queued_at",
        F.coalesce("_doc_matter", "_job_matter").alias("matter_id"),
        "_doc_matter",
        "content",
        "doc_type",
        F.when(F.col("_found").isNull(), "failed")
        .when(too_short(F.col("content")), "skipped")
        .alias("early"),
    )
    work = judged.where(F.col("early").isNull())
    # Without a matter nothing is stored, so no model is called.
    placed = work.where(F.col("matter_id").isNotNull())

    chunks = M.chunk_documents(
        placed.select("job_id", "firm_id", "matter_id", "document_id", "content"),
        lossy=lossy,
    ).withColumnRenamed("document_id", "source_document_id")
    embedded = written(M.embed(chunks, embed_fn), "embedded")

    named = with_extraction_context(
        placed.drop("early").withColumnRenamed("matter_id", "_write_matter")
        .withColumnRenamed("_doc_matter", "matter_id"),
        matters,
    ).withColumn("matter_id", F.col("_write_matter"))
    extracted = written(
        M.extract_positions(
            named.select(
                "job_id",
                "firm_id",
                "matter_id",
                "document_id",
                "queued_at",
                "matter_name",
                "client_name",
                "our_side",
                "doc_type",
                "content",
            ),
            extract_fn,
            context=_CONTEXT,
            rules=rules,
        ),
        "extracted",
    )
    found = P.normalise_positions(M.exploded_positions(extracted))
    position_rows = found.select(
        derived_id("firm_id", "job_id", "document_id", "seq").alias("id"),
        "firm_id",
        "matter_id",
        "clause_type",
        "value",
        "status",
        "counterparty_name",
        "party_role",
        F.col("document_id").alias("source_document_id"),
        "source_chunk_text",
        now.alias("extracted_at"),
        F.lit(extraction_model).alias("extracted_by"),
        "confidence",
        F.lit(None).cast("string").alias("raw_extract"),
        now.alias("created_at"),
        now.alias("updated_at"),
        "seq",
        "queued_at",
    )

    n_chunks = embedded.groupBy("job_id").agg(
        F.count_if(F.col("embedding").isNotNull()).alias("chunks_embedded")
    )
    results = extracted.select(
        "job_id",
        F.size("positions").alias("positions_extracted"),
        F.col("error").alias("_error"),
    )
    error = F.when(F.col("early") == "failed", "document not found").otherwise(
        F.col("_error")
    )
    ledger = (
        judged.select("job_id", "firm_id", "document_id", "matter_id", "early")
        .join(n_chunks, "job_id", "left")
        .join(results, "job_id", "left")
        .select(
            "job_id",
            "firm_id",
            "document_id",
            "matter_id",
            F.coalesce(
                F.col("early"), F.when(F.col("_error").isNotNull(), "failed")
            ).alias("_bad"),
            "chunks_embedded",
            "positions_extracted",
            error.alias("error_message"),
        )
    )
    ended = F.coalesce(F.col("_bad"), F.lit("completed"))
    counted = ended != "failed"
    ledger = ledger.select(
        "job_id",
        "firm_id",
        "document_id",
        "matter_id",
        ended.alias("status"),
        F.when(counted, F.coalesce("chunks_embedded", F.lit(0)))
        .cast("int")
        .alias("chunks_embedded"),
        F.when(counted, F.coalesce("positions_extracted", F.lit(0)))
        .cast("int")
        .alias("positions_extracted"),
        "error_message",
        F.when(counted, F.lit(embedding_model)).alias("embedding_model"),
        F.when(counted, F.lit(extraction_model)).alias("extraction_model"),
        now.alias("completed_at"),
    )
    return IntakeResult(
        memory=chunk_rows(embedded, embedding_model),
        positions=position_rows,
        ledger=ledger,
    )


def store_positions(stored: DataFrame, result: IntakeResult) -> DataFrame:
    """The position table after an intake run.

    Documents take effect in the order they were queued, positions of one
    document in list order.
    """
    return P.write_positions(
        stored, result.positions, order=("queued_at", "seq", "id")
    )


def preview_positions(
    drafts: DataFrame,
    matters: DataFrame,
    extract_fn: ExtractFn | None = None,
    rules: Mapping[str, str] | None = None,
    min_chars: int = 0,
) -> DataFrame:
    """Positions of drafts, nothing stored.

    Drafts: (request_id, firm_id, document_text, matter_id or null).  With
    ``min_chars``, texts that are shorter without the blanks around them are
    left out, as intake skips them.
    """
    fit = drafts
    if min_chars:
        fit = drafts.where(F.length(X.trim_blanks(F.col("document_text"))) >= min_chars)
    named = with_extraction_context(
        fit.withColumnRenamed("document_text", "content").withColumn(
            "doc_type", F.lit(None).cast("string")
        ),
        matters,
    )
    extracted = M.extract_positions(named, extract_fn, context=_CONTEXT, rules=rules)
    return P.normalise_positions(
        M.exploded_positions(extracted).drop("client_name", "our_side", "doc_type")
    )


def search_text(
    queries: DataFrame, memory: DataFrame, embed_fn: EmbedFn, k: int = S.SEARCH_DEFAULT_K
) -> DataFrame:
    """Nearest memory rows of query texts (request_id, firm_id, query, matter_id)."""
    asked = M.embed(queries, embed_fn, text="query")
    return vector_topk(asked, memory, k)


@dataclass
class BackfillResult:
    queued: DataFrame
    intake: IntakeResult | None
    outcomes: DataFrame | None


def backfill(
    docs: DataFrame,
    jobs: DataFrame,
    matters: DataFrame,
    embed_fn: EmbedFn,
    extract_fn: ExtractFn | None = None,
    rules: Mapping[str, str] | None = None,
    limit: int | None = None,
    limit_first: bool = False,
    dry_run: bool = False,
    now: Column | None = None,
) -> BackfillResult:
    """Queue every unfinished document, run intake, tally the outcomes."""
    chosen = backfill_candidates(docs, jobs, limit, limit_first)
    if dry_run:
        return BackfillResult(chosen, None, None)
    queued = written(request_extraction(chosen, "scheduled_backfill", now), "queued")
    result = run_intake(queued, docs, matters, embed_fn, extract_fn, rules, now=now)
    return BackfillResult(queued, result, job_outcomes(result.ledger))
