"""Minimal word edits of (old, new) text pairs.

Pairs: (pair_id, old_text, new_text).
"""

from collections.abc import Iterator
from itertools import accumulate, chain

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.functions.wordedits import rebuilt, word_edits, words_of
from matterlake.plans.storage import spread

_RESULT = (
    "struct<edits:array<struct<old_text:string,new_text:string,old_start:int>>,"
    "old_words:int,new_words:int,changed_words:int>"
)


def _diff(
    old: str | None, new: str | None, context_words: int, max_words: int | None
) -> tuple:
    """Edits and counts; no edits for a pair that the guard rejects."""
    if old is None or new is None:
        return None, None, None, None
    words = words_of(old), words_of(new)
    n_old, n_new = map(len, words)
    too_long = max_words is not None and max(n_old, n_new) > max_words
    if too_long or (n_old == 0 and n_new > 0):
        return None, n_old, n_new, None
    edits, changed = word_edits(old, new, context_words, words)
    return edits, n_old, n_new, changed


def _as_arrow(rows: list[tuple]) -> pa.Array:
    """Results of ``_diff`` as structs; the edits are built as flat columns."""
    listed, *counts = zip(*rows) if rows else ((),) * 4
    flat = list(chain.from_iterable(e for e in listed if e is not None))
    texts, news, starts = zip(*flat) if flat else ((),) * 3
    edits = pa.StructArray.from_arrays(
        [pa.array(texts, pa.string()), pa.array(news, pa.string()), pa.array(starts, pa.int32())],
        ["old_text", "new_text", "old_start"],
    )
    ends = list(accumulate((len(e or ()) for e in listed), initial=0))
    # A missing start makes a missing list.
    lows = [None if e is None else at for e, at in zip(listed, ends)]
    lists = pa.ListArray.from_arrays(pa.array([*lows, ends[-1]], pa.int32()), edits)
    return pa.StructArray.from_arrays(
        [lists, *(pa.array(c, pa.int32()) for c in counts)],
        ["edits", "old_words", "new_words", "changed_words"],
    )


def _edits_of(context_words: int, max_words: int | None):
    @F.arrow_udf(_RESULT)
    def edits(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for old, new in batches:
            pairs = zip(old.to_pylist(), new.to_pylist())
            yield _as_arrow([_diff(o, n, context_words, max_words) for o, n in pairs])

    return edits


def _pair_error(max_words: int | None) -> Column:
    """Why a pair was not diffed, or null."""
    old_words, new_words = F.col("_r.old_words"), F.col("_r.new_words")
    missing = F.when(old_words.isNull(), "text missing")
    if max_words is not None:
        too_long = F.greatest(old_words, new_words) > max_words
        missing = missing.when(too_long, f"more than {max_words} words on a side")
    return missing.when((old_words == 0) & (new_words > 0), "old text has no words")


def diff_pairs(
    pairs: DataFrame, context_words: int = 2, max_words: int | None = None
) -> DataFrame:
    """One row per pair: its edits as an array, statistics, or an error.

    Pairs of any length are compared; with ``max_words``, longer ones get an
    error instead.
    """
    if not 1 <= context_words <= 6:
        raise ValueError("context_words must be between 1 and 6")
    result = _edits_of(context_words, max_words)(F.col("old_text"), F.col("new_text"))
    # The work per pair grows with the square of its length: move the pairs
    # before it, so that no task holds a run of long ones.
    judged = (
        spread(pairs, "pair_id")
        .select("pair_id", result.alias("_r"))
        .withColumn("error", _pair_error(max_words))
    )
    fine = F.col("error").isNull()
    return judged.select(
        "pair_id",
        F.col("_r.edits").alias("edits"),
        F.when(fine, F.size("_r.edits") == 0).alias("unchanged"),
        F.when(fine, F.col("_r.old_words")).alias("original_old_words"),
        F.when(fine, F.col("_r.changed_words")).alias("changed_old_words"),
        F.when(fine, F.size("_r.edits")).alias("edits_count"),
        "error",
    )


def tighten_edits(
    pairs: DataFrame, context_words: int = 2, max_words: int | None = None
) -> DataFrame:
    """One row per edit; unchanged and rejected pairs keep one row."""
    found = diff_pairs(pairs, context_words, max_words)
    return found.select(
        "pair_id",
        F.posexplode_outer("edits").alias("edit_index", "_e"),
        "unchanged",
        "original_old_words",
        "changed_old_words",
        "edits_count",
        "error",
    ).select(
        "pair_id",
        "edit_index",
        "_e.old_text",
        "_e.new_text",
        "_e.old_start",
        "unchanged",
        "original_old_words",
        "changed_old_words",
        "edits_count",
        "error",
    )


def apply_edits(old: Column, edits: Column) -> Column:
    """The text that ``edits`` (of ``diff_pairs``) make of ``old``.

    Time grows with the text and its edits, not with their product.
    """

    @F.pandas_udf("string")
    def applied(
        old: pd.Series, before: pd.Series, after: pd.Series, start: pd.Series
    ) -> pd.Series:
        rows = zip(old, before, after, start)
        return pd.Series([rebuilt(o, zip(b, a, s)) for o, b, a, s in rows], dtype=object)

    return applied(old, *(edits[c] for c in ("old_text", "new_text", "old_start")))
