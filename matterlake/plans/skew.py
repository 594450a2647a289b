"""Neighbours within a key when one key may hold a large part of all rows.

``lead`` and ``row_number`` over a key put the whole key into one task.  Keys
of ordinary size take that one-shuffle plan.  A key above ``hot_rows`` is cut
into slices along its order by Spark's range partitioner; windows run per
(key, slice), and the slice borders are joined up through a table with one row
per slice.  The result is the same for any slicing.
"""

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matterlake.plans.storage import written

HOT_ROWS = 2_000_000
HOT_KEYS = 1000
# Rows that a task of ``product_join`` puts out.
PRODUCT_ROWS = 5_000_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, int] | None:
    """The largest keys with more than ``hot_rows`` rows, and their rows.

    At most ``HOT_KEYS`` keys come to the driver.  Any key left out is no
    larger than one ``HOT_KEYS``-th of the table, so it needs no slicing.  The
    count reads the key columns only and combines before its shuffle.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    found = (
        counts.where(F.col("n") > hot_rows)
        .orderBy(F.col("n").desc())
        .limit(HOT_KEYS)
        .collect()
    )
    if not found:
        return None
    schema = T.StructType([df.schema[k] for k in keys])
    frame = df.sparkSession.createDataFrame(
        [tuple(r[k] for k in keys) for r in found], schema
    )
    return frame, sum(r["n"] for r in found)


def _same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    match = F.lit(True)
    for k in keys:
        match = match & left[k].eqNullSafe(right[k])
    return match


def with_neighbours(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    id_col: str,
    hot_rows: int = HOT_ROWS,
    slice_rows: int | None = None,
) -> DataFrame:
    """Adds ``next_id``, ``previous_id`` and ``version`` (from 1) in key order.

    ``order`` must be a total order within a key.  A slice of a hot key holds
    about ``slice_rows`` rows (default: ``hot_rows``).
    """
    hot = hot_keys(df, keys, hot_rows)
    if hot is None:
        return _whole_keys(df, keys, order, id_col)
    # Proven size: at most HOT_KEYS rows.
    frame, n = hot
    frame = F.broadcast(frame)
    cold = df.join(frame, _same(df, frame, keys), "left_anti")
    large = df.join(frame, _same(df, frame, keys), "left_semi")
    slices = max(2, -(-n // (slice_rows or hot_rows)))
    return _whole_keys(cold, keys, order, id_col).unionByName(
        _sliced_keys(large, keys, order, id_col, slices)
    )


def _whole_keys(df, keys, order, id_col) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.select(
        "*",
        F.lead(id_col).over(w).alias("next_id"),
        F.lag(id_col).over(w).alias("previous_id"),
        F.row_number().over(w).cast("long").alias("version"),
    )


def _sliced_keys(df, keys, order, id_col, slices) -> DataFrame:
    # Written, so that every later use sees the same slice of a row.
    sliced = written(
        df.repartitionByRange(slices, *keys, *order).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )
    inner = Window.partitionBy(*keys, "_slice").orderBy(*order)
    rows = sliced.select(
        "*",
        F.lead(id_col).over(inner).alias("_next"),
        F.lag(id_col).over(inner).alias("_previous"),
        F.row_number().over(inner).cast("long").alias("_rank"),
    )
    place = F.struct(*order)
    along = Window.partitionBy(*keys).orderBy("_slice")
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # One row per (key, slice): bounded by the slices plus the hot keys.
    borders = (
        sliced.groupBy(*keys, "_slice")
        .agg(
            F.min_by(id_col, place).alias("_first"),
            F.max_by(id_col, place).alias("_last"),
            F.count(F.lit(1)).alias("_n"),
        )
        .select(
            *[F.col(k).alias(f"_at_{k}") for k in [*keys, "_slice"]],
            F.lead("_first").over(along).alias("_after"),
            F.lag("_last").over(along).alias("_before"),
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
        )
    )
    match = F.lit(True)
    for k in [*keys, "_slice"]:
        match = match & F.col(k).eqNullSafe(F.col(f"_at_{k}"))
    return rows.join(F.broadcast(borders), match).select(
        *df.columns,
        F.coalesce("_next", "_after").alias("next_id"),
        F.coalesce("_previous", "_before").alias("previous_id"),
        (F.col("_rank") + F.col("_offset")).alias("version"),
    )


def top_per_group(
    df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int
) -> DataFrame:
    """The first ``k`` rows of each group, with ``rank`` from 1.

    The rank filter sits directly on ``row_number``, so Catalyst keeps at most
    ``k`` rows of a group per map task before the shuffle (WindowGroupLimit):
    a group that holds a third of the table sends no more than that.
    """
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Rows of a key together and in ``order``, without a global sort.

    A key with much of the rows may be cut over several tasks, each in order.
    """
    return df.hint("rebalance", *keys).sortWithinPartitions(*keys, *order)


def _packed(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """(keys, _pack, _n, _block): the other columns in arrays of at most ``rows``.

    Rows are cut along their order in a partition, so a key of any size is neither
    numbered in one task nor put in one array.
    """
    rest = [c for c in df.columns if c not in keys]
    # By all columns: a task that runs again cuts at the same rows.
    ordered = df.sortWithinPartitions(*keys, *rest)
    # The partition is in the upper bits, so no block reaches into the next one.
    block = F.shiftright(F.monotonically_increasing_id(), rows.bit_length() - 1)
    return (
        ordered.withColumn("_block", block)
        .groupBy(*keys, "_block")
        .agg(F.collect_list(F.struct(*rest)).alias("_pack"))
        .withColumn("_n", F.size("_pack"))
    )


def product_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_counts: DataFrame,
    task_rows: int = PRODUCT_ROWS,
    apart: Sequence[str] = (),
) -> DataFrame:
    """The inner equi join of two sides that may both hold many rows of a key.

    What a task does goes by the rows put out, not by those read, so the product of
    a key is cut into a grid of cells of about ``task_rows`` result rows: left rows
    are dealt over its rows and copied along them, right rows over its columns.  So
    copies grow with the result, by one row for hundreds put out, and not with the
    square of a side.  ``left_counts``: (keys, n_left).

    Right rows travel and join in packs, opened last.  A filter on left columns,
    ``keys`` and ``apart`` (right columns with equal values in a pack) is decided
    once per left row and pack.
    """
    # A power of two, a sixteenth of a square cell's side or less.
    pack = 1 << max(0, (math.isqrt(task_rows) // 16).bit_length() - 1)
    # Written: read for the sizes and the rows.
    packs = written(_packed(right, [*keys, *apart], pack), "packs")
    n_right = packs.groupBy(*keys).agg(F.sum("_n").alias("_n"))
    out = F.col("n_left") * F.col("_n")
    sizes = written(
        left_counts.join(n_right, list(keys)).select(
            *keys, "n_left", F.col("_n").alias("n_right"), out.alias("_out")
        ),
        "sizes",
    )
    total = sizes.agg(F.sum("_out")).first()[0] or 0
    # Square cells copy least; a side is cut no further than the cells go round.
    cells = F.ceil(F.col("_out") / task_rows)
    across = F.round(F.sqrt(cells * F.col("n_right") / F.col("n_left")))
    across = F.greatest(F.lit(1), F.least(across, cells)).cast("int")
    grid = sizes.select(
        *keys, across.alias("_across"), F.ceil(cells / across).cast("int").alias("_down")
    )

    def dealt(columns: Sequence[str], over: str) -> Column:
        return F.pmod(F.xxhash64(*columns), F.col(over)).cast("int")

    def copied(over: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(over) - 1))

    # A fixed number, or small inputs would be put into one task for their size.
    n = max(left.sparkSession.sparkContext.defaultParallelism, -(-total // task_rows))
    place = [*keys, "_row", "_column"]
    lefts = left.join(grid, list(keys)).select(
        *left.columns,
        dealt(left.columns, "_down").alias("_row"),
        copied("_across").alias("_column"),
    )
    rights = packs.join(grid, list(keys)).select(
        *keys,
        *apart,
        "_pack",
        dealt(["_block"], "_across").alias("_column"),
        copied("_down").alias("_row"),
    )
    joined = lefts.repartition(n, *place).join(
        rights.repartition(n, *place).hint("merge"), place
    )
    return joined.select(*left.columns, *apart, F.inline("_pack"))
