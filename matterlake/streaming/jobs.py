"""Incremental operators as Structured Streaming jobs.

State and checkpoints live in the shared folder.  Sinks are file tables; no
result passes through the driver.
"""

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matterlake.operators import access as A
from matterlake.plans.storage import scratch_path
from matterlake.sources.sinks import audit_rows


def file_stream(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    pattern: str | None = None,
    files_per_trigger: int | None = None,
) -> DataFrame:
    """A growing folder of Parquet files as a stream.

    ``files_per_trigger`` bounds a micro-batch.
    """
    reader = spark.readStream.schema(schema)
    if pattern is not None:
        reader = reader.option("pathGlobFilter", pattern)
    if files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def drain_to_table(
    stream: DataFrame,
    path: str,
    checkpoint: str | None = None,
    mode: str = "append",
    partition_by: tuple[str, ...] = (),
) -> None:
    """Process all that is available, append it to a file table, stop."""
    spark = stream.sparkSession
    writer = (
        stream.writeStream.outputMode(mode)
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "progress"))
        .trigger(availableNow=True)
    )
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.start().awaitTermination()


def drain_batches(
    stream: DataFrame,
    apply: Callable[[DataFrame, int], None],
    checkpoint: str | None = None,
) -> None:
    """Process all that is available with ``apply(batch, batch_id)``, stop."""
    spark = stream.sparkSession
    (
        stream.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint or scratch_path(spark, "progress"))
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )


def intake_stream(
    requests: DataFrame,
    handle: Callable[[DataFrame], DataFrame],
    ledger_path: str,
    checkpoint: str | None = None,
) -> None:
    """Drain pending requests: each is handled once, results go to the ledger.

    ``handle`` maps the pending requests of a batch to ledger rows (failures
    included as rows).  A batch writes its own folder, so a repeated batch
    replaces its rows instead of doubling them.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        pending = batch.where(F.col("status") == "pending")
        rows = handle(pending)
        rows.write.mode("overwrite").parquet(f"{ledger_path}/batch={batch_id}")

    drain_batches(requests, apply, checkpoint)


def audit_stream(
    actions: DataFrame, path: str, checkpoint: str | None = None
) -> None:
    """Append one audit row per action, error actions included."""
    drain_to_table(
        audit_rows(actions), path, checkpoint, partition_by=("firm_id", "action_date")
    )


def valid_session_stream(sessions: DataFrame, firm_users: DataFrame) -> DataFrame:
    """Stream-static join: sessions judged against the present cut-offs."""
    return A.valid_sessions(sessions, firm_users)


_HELD_ROWS = 100_000


def _earliest(rows: pa.Table) -> pa.Table:
    """One row per code: the earliest by ``attempted_at`` and ``attempt_id``."""
    order = [("attempted_at", "ascending"), ("attempt_id", "ascending")]
    rows = rows.take(pc.sort_indices(rows, sort_keys=order))
    places = pa.table({"code": rows["code"], "place": pa.array(range(len(rows)), pa.int64())})
    first = places.group_by("code", use_threads=False).aggregate([("place", "min")])
    return rows.take(first["place_min"])


def _earliest_of_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The earliest row per code of a partition; what was beaten is let go on the way."""
    held, best, n = [], 0, 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        # Twice the codes seen so far, so that each row is sorted a few times at most.
        if n >= max(_HELD_ROWS, 2 * best):
            held = _earliest(pa.Table.from_batches(held)).combine_chunks().to_batches()
            best = n = sum(b.num_rows for b in held)
    if held:
        yield from _earliest(pa.Table.from_batches(held)).to_batches(max_chunksize=_HELD_ROWS)


def first_redemption_stream(attempts: DataFrame, codes: DataFrame) -> DataFrame:
    """The redeeming attempt per code: the first timely one to arrive.

    Within a micro-batch the earliest by ``attempted_at`` and ``attempt_id``
    counts.  An attempt is timely by its own time, however late its row comes,
    so nothing is dropped by a watermark.  The state is one key per redeemed
    code, no more than the table of codes holds.

    Codes are reduced a partition at a time, not by a call each.  That happens
    before the join, too, so a code with very many attempts is no task's burden:
    where any attempt of a code is timely, its earliest is.
    """
    usable = codes.where(F.col("redeemed_at").isNull()).select("code", "expires_at")
    earliest = attempts.mapInArrow(_earliest_of_codes, attempts.schema)
    timely = earliest.join(usable, "code").where(
        F.col("expires_at") > F.col("attempted_at")
    )
    # One row per code and micro-batch is left, so it is settled which one is kept.
    return (
        timely.repartition("code")
        .mapInArrow(_earliest_of_codes, timely.schema)
        .dropDuplicates(["code"])
    )
