"""Handoff upserts as a stream onto a merge-on-read table.

The table is cut by title: an update's target always has the update's title, so
a micro-batch reads the buckets of its own titles and writes one layer of the
rows it changed (``plans.deltas``).  Neither grows with the table.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import types as T

from matterlake.operators.handoffs import TITLE, changed_handoffs, with_title_key
from matterlake.plans import deltas
from matterlake.plans.storage import written
from matterlake.streaming.jobs import drain_batches


def layout_of(
    path: str,
    schema: T.StructType,
    buckets: int = deltas.BUCKETS,
    depth: int = deltas.DEPTH,
) -> deltas.Layout:
    return deltas.Layout(path, schema, ("firm_id", "id"), TITLE, buckets, depth)


def handoff_stream(
    updates: DataFrame,
    handoffs: DataFrame,
    path: str,
    checkpoint: str | None = None,
    now: Column | None = None,
    buckets: int = deltas.BUCKETS,
    depth: int = deltas.DEPTH,
) -> None:
    """Apply handoff updates micro-batch by micro-batch, in order of arrival.

    ``handoffs`` is the table at the start (version 0); batch ``n`` writes
    version ``n + 1`` from version ``n``, so a repeated batch gives the same
    rows.  With a ``checkpoint`` a later call goes on; it finds the table and
    leaves ``handoffs`` aside.
    """
    layout = layout_of(path, handoffs.schema, buckets, depth)
    spark = updates.sparkSession
    if not deltas.has_version(spark, layout):
        deltas.create(handoffs, layout)

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        touched = deltas.touched_buckets(with_title_key(batch), layout)
        stored = deltas.read(session, layout, batch_id, touched)
        changed = written(changed_handoffs(batch, stored, now), "changed")
        deltas.commit(changed, layout, batch_id + 1, touched)

    drain_batches(updates, apply, checkpoint)


def stored_handoffs(
    spark: SparkSession, path: str, schema: T.StructType, buckets: int = deltas.BUCKETS
) -> DataFrame:
    """The table as of the last complete micro-batch."""
    return deltas.read(spark, layout_of(path, schema, buckets))
