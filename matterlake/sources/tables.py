"""Scans with explicit schemas, always for given tenants."""

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matterlake import schemas as S
from matterlake.plans.skew import top_per_group


def read_table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A stored table with its declared schema (never inferred)."""
    return spark.read.schema(S.TABLES[name]).parquet(f"{root}/{name}")


def scan(table: DataFrame, firm_ids: str | Iterable[str] | DataFrame) -> DataFrame:
    """Only the rows of the given firm, firms, or frame of firms.

    One firm or a short list becomes a pushed-down filter (and prunes tables
    partitioned by ``firm_id``); a frame becomes a semi join.
    """
    if isinstance(firm_ids, DataFrame):
        return table.join(firm_ids.select("firm_id"), "firm_id", "left_semi").select(
            *table.columns
        )
    if isinstance(firm_ids, str):
        return table.where(F.col("firm_id") == firm_ids)
    return table.where(F.col("firm_id").isin(*firm_ids))


def active_matters(matters: DataFrame, n: int | None = None) -> DataFrame:
    """Matters that are not archived; with ``n`` the last opened ``n`` of a firm."""
    active = matters.where(~F.col("archived"))
    if n is None:
        return active
    newest = [F.col("last_accessed").desc_nulls_last(), F.col("id").asc()]
    return top_per_group(active, ["firm_id"], newest, n).drop("rank")


def write_bucketed(
    df: DataFrame,
    name: str,
    keys: Sequence[str],
    order: Sequence[str],
    buckets: int,
    path: str,
) -> DataFrame:
    """Store ``df`` as table ``name``, in buckets of ``keys``, each in ``order``.

    Windows and aggregates over ``keys``, or over more columns beside them, read
    it without a shuffle; so do joins of two tables with the same buckets.  One
    file per bucket: choose ``buckets`` so that one fits a task.
    """
    spark = df.sparkSession
    (
        df.repartition(buckets, *keys)
        .write.bucketBy(buckets, *keys)
        .sortBy(*keys, *order)
        .option("path", path)
        .mode("overwrite")
        .saveAsTable(name)
    )
    return spark.table(name)
