"""Bounded samples of labelled documents for fitting classifiers."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as ``''``."""
    name = F.coalesce(doc_id.cast("string"), F.lit(""))
    return (F.crc32(name) % folds).cast("int")


def training_texts(
    docs: DataFrame, labels: DataFrame, label: str, may_learn: Column, most: int
) -> DataFrame:
    """(text, label) of at most ``most`` labelled documents.

    Documents are taken in the order of a hash of their id, so a rerun takes
    the same ones.  ``may_learn`` is over ``doc_id``.  An id labelled more than
    once counts with its largest label.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & may_learn)
        .groupBy("doc_id")
        .agg(F.max("label").cast("double").alias("label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(most)
    )
    # Two numbers a row and at most ``most`` rows, so the size is proven.
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).join(F.broadcast(chosen), "doc_id").select("text", "label")
