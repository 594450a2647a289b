"""Live supersession: the current position of each key as keyed state.

Order is the order of arrival: micro-batch by micro-batch, inside a batch by
``ORDER``.  A row that arrives late supersedes the key's current row, whatever
its time stamps say, as ``write_positions`` does with a stored table.

Two streams, so that neither hot keys nor many keys cost more than the batch:

* The first links the rows inside a micro-batch with the batch operator, which
  cuts a hot key over many tasks, and writes one border row (first and last id)
  per key and batch.
* The second reads the border rows.  A state store holds one id per key; a
  border's first row supersedes it, its last one takes its place.  Only touched
  keys are read and written, however many the store holds.

A repeated micro-batch replaces its own folder, and the state ignores borders
of a batch it has seen, so a restart neither loses nor doubles a link.
"""

from collections.abc import Iterator
from contextlib import contextmanager
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matterlake.operators.positions import KEY, ORDER
from matterlake.plans.skew import HOT_ROWS, with_neighbours
from matterlake.plans.storage import scratch_path, written
from matterlake.streaming.jobs import drain_batches, drain_to_table, file_stream

_STATE = "current"
_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ON_DISK = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def _state_on_disk(spark: SparkSession) -> Iterator[None]:
    """A store that keeps its keys on disk and writes changes only."""
    before = spark.conf.get(_PROVIDER)
    spark.conf.set(_PROVIDER, _ON_DISK)
    try:
        yield
    finally:
        spark.conf.set(_PROVIDER, before)


class _Current(StatefulProcessor):
    """Holds the last id of a key and the batch that brought it."""

    def __init__(self, keys: tuple[str, ...]) -> None:
        self._link = Row(*keys, "id", "superseded_by")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._held = handle.getValueState(_STATE, "id string, batch long")

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:
        held = self._held.get() if self._held.exists() else None
        at, batch = (held[0], held[1]) if held is not None else (None, -1)
        # One row per batch that is waiting.
        for row in sorted(rows, key=lambda r: r["batch"]):
            if row["batch"] <= batch:
                continue
            if at is not None:
                yield self._link(*key, at, row["first_id"])
            at, batch = row["last_id"], row["batch"]
        self._held.update((at, batch))

    def close(self) -> None:
        pass


def supersession_stream(
    positions: DataFrame,
    links_path: str,
    state_path: str,
    keys: tuple[str, ...] = KEY,
    hot_rows: int = HOT_ROWS,
    slice_rows: int | None = None,
) -> None:
    """Drain what is available and write (keys, id, superseded_by) links.

    ``state_path`` keeps the progress of both streams and the state: a later
    call with the same paths goes on where this one stopped.  Null key columns
    are equal, as in the batch form.  Read the result with ``links`` and
    ``current_ids``.
    """
    spark = positions.sparkSession
    own = [positions.schema[k] for k in keys]
    border = T.StructType(
        [
            *[T.StructField(f.name, f.dataType) for f in own],
            T.StructField("first_id", T.StringType()),
            T.StructField("last_id", T.StringType()),
            T.StructField("batch", T.LongType()),
        ]
    )
    borders_path = f"{state_path}/borders"
    # The second stream needs a folder even if the first finds nothing.
    spark.createDataFrame([], border).write.mode("ignore").partitionBy("batch").parquet(
        borders_path
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        slim = batch.select(*keys, *ORDER)
        linked = written(
            with_neighbours(slim, keys, ORDER, "id", hot_rows, slice_rows), "linked"
        )
        inner = linked.where(F.col("next_id").isNotNull()).select(
            *keys, "id", F.col("next_id").alias("superseded_by")
        )
        inner.write.mode("overwrite").parquet(f"{links_path}/inner/batch={batch_id}")
        first, last = F.col("previous_id").isNull(), F.col("next_id").isNull()
        # At most two rows of a key are left.
        borders = (
            linked.where(first | last)
            .groupBy(*keys)
            .agg(
                F.max(F.when(first, F.col("id"))).alias("first_id"),
                F.max(F.when(last, F.col("id"))).alias("last_id"),
            )
        )
        borders.write.mode("overwrite").parquet(f"{borders_path}/batch={batch_id}")

    drain_batches(positions, apply, f"{state_path}/inner")
    waiting = file_stream(spark, borders_path, border)
    link = T.StructType(
        [
            *[T.StructField(f.name, f.dataType) for f in own],
            T.StructField("id", T.StringType()),
            T.StructField("superseded_by", T.StringType()),
        ]
    )
    across = waiting.groupBy(*keys).transformWithState(
        statefulProcessor=_Current(keys),
        outputStructType=link,
        outputMode="Append",
        timeMode="None",
    )
    with _state_on_disk(spark):
        drain_to_table(across, f"{links_path}/across", f"{state_path}/across")


def links(spark: SparkSession, links_path: str) -> DataFrame:
    """All links written so far."""
    inner = spark.read.parquet(f"{links_path}/inner").drop("batch")
    return inner.unionByName(spark.read.parquet(f"{links_path}/across"))


def current_ids(spark: SparkSession, state_path: str) -> DataFrame:
    """(keys, id) of the position that is current in each key, from the state."""
    held = (
        spark.read.format("statestore")
        .option("path", f"{state_path}/across")
        .option("stateVarName", _STATE)
        .load()
    )
    return held.select("key.*", F.col("value.id").alias("id"))


def fresh_paths(spark: SparkSession, name: str) -> tuple[str, str]:
    """New folders for links and state."""
    return scratch_path(spark, f"{name}-links"), scratch_path(spark, f"{name}-state")
