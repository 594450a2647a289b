"""The job ledger as events, its state, and its tallies."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.functions import temporal as M
from matterlake.plans.skew import top_per_group

_RANK = {"pending": 0, "running": 1}


def _progress(status: Column) -> Column:
    """Pending before running before any end state, for equal times."""
    rank = F.lit(2)
    for name, r in _RANK.items():
        rank = F.when(status == name, F.lit(r)).otherwise(rank)
    return rank


def ledger_state(events: DataFrame) -> DataFrame:
    """The present state of every job from its events.

    Events: (job_id, firm_id, document_id, status, event_at, positions_extracted,
    chunks_embedded, error_message).  Times come from the first event of a
    kind, results from the last event.  One aggregation, combined before the
    shuffle.
    """
    status = F.col("status")
    place = F.struct(F.col("event_at"), _progress(status))
    ended = status.isin("completed", "failed", "skipped", "cancelled")
    last = F.max_by(
        F.struct("status", "positions_extracted", "chunks_embedded", "error_message"),
        place,
    )
    state = events.groupBy("firm_id", "job_id").agg(
        F.max("document_id").alias("document_id"),
        last.alias("_last"),
        F.min(F.when(status == "pending", F.col("event_at"))).alias("queued_at"),
        F.min(F.when(status == "running", F.col("event_at"))).alias("started_at"),
        F.max(F.when(ended, F.col("event_at"))).alias("completed_at"),
    )
    return state.select(
        "firm_id",
        "job_id",
        "document_id",
        F.col("_last.status").alias("status"),
        "queued_at",
        "started_at",
        "completed_at",
        F.when(F.col("_last.status") == "failed", F.lit(0))
        .otherwise(M.duration_ms(_ts("started_at"), _ts("completed_at")))
        .alias("duration_ms"),
        F.col("_last.positions_extracted").alias("positions_extracted"),
        F.col("_last.chunks_embedded").alias("chunks_embedded"),
        F.col("_last.error_message").alias("error_message"),
    )


def _ts(name: str) -> Column:
    return F.col(name).cast("timestamp")


def job_outcomes(jobs: DataFrame) -> DataFrame:
    """Completed, failed and skipped jobs per firm."""
    status = F.col("status")
    return jobs.groupBy("firm_id").agg(
        F.count_if(status == "completed").alias("completed"),
        F.count_if(status == "failed").alias("failed"),
        F.count_if(status == "skipped").alias("skipped"),
    )


def oldest_pending(jobs: DataFrame, n: int) -> DataFrame:
    """Per firm the ``n`` pending jobs queued first, with their ``rank``."""
    return top_per_group(
        jobs.where(F.col("status") == "pending"),
        ["firm_id"],
        [F.col("queued_at").asc(), F.col("id").asc()],
        n,
    )


def drain_order(jobs: DataFrame) -> DataFrame:
    """All pending jobs, oldest first."""
    return jobs.where(F.col("status") == "pending").orderBy("queued_at", "id")
