"""Matching of document drafts by title and size, and the upsert it drives.

Signals: (request_id, firm_id, doc_title, paragraph_count, word_count).
"""

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.functions import scoring as D
from matterlake.functions import text as X
from matterlake.plans.skew import top_per_group
from matterlake.plans.storage import written
from matterlake.sources.sinks import derived_id

# A request belongs to a firm: two firms may use the same request id.
REQUEST = ("request_id", "firm_id")
TITLE = ("firm_id", "doc_title_normalised")


def with_title_key(df: DataFrame) -> DataFrame:
    """Adds the match key and marks titles that consist of marks only."""
    return df.withColumn(
        "doc_title_normalised", X.normalise_title(F.col("doc_title"))
    ).withColumn("empty_title", F.col("doc_title_normalised") == "")


def newest_handoffs(handoffs: DataFrame, n: int) -> DataFrame:
    """The newest ``n`` handoffs of each title."""
    newest = [F.col("last_active").desc(), F.col("id").asc()]
    return top_per_group(handoffs, TITLE, newest, n).drop("rank")


def _size_class(words: Column) -> Column:
    """Binary digits of the word count: sizes within a band differ by one at most."""
    return F.length(F.bin(F.greatest(words.cast("long"), F.lit(32))))


# Sizes of a title and size class that make a block; and how many stored ones it
# takes for blocks to be made at all.
BLOCK_SIZES = 4096
FEW_SIZES = 32
# Pairs of sizes compared at once, which bounds the tables of a block.
BLOCK_PAIRS = 1 << 18

_GROUP = (*TITLE, "_class")
_FOUND = (
    "firm_id string, doc_title_normalised string, _paragraphs int, _words int, "
    "rank int, combined double, age long, handoff_id string, _n long"
)


def _sizes(
    signals: DataFrame, handoffs: DataFrame, n: int | None
) -> tuple[DataFrame, DataFrame]:
    """The asked and the stored sizes by title and size class.

    Handoffs of one title and size differ only in age, so one row, with its
    newest handoff and their number, stands for all of them; requests of one
    title and size get the same answer.  Copies on either side make no pairs.
    """
    asked = with_title_key(signals).select(
        *TITLE,
        F.col("paragraph_count").cast("int").alias("_paragraphs"),
        F.col("word_count").cast("int").alias("_words"),
    )
    age = -F.unix_micros(F.col("last_active").cast("timestamp"))
    # Handoffs without a time come last.
    newest = F.struct(
        F.coalesce(age, F.lit((1 << 63) - 1)).alias("age"), F.col("id").alias("id")
    )
    stored = handoffs if n is None else newest_handoffs(handoffs, n)
    of_stored = (
        stored.where(F.col("word_count").isNotNull())
        .groupBy(*TITLE, "paragraph_count", "word_count")
        .agg(F.min(newest).alias("_newest"), F.count(F.lit(1)).alias("_n"))
        .select(
            *TITLE,
            _size_class(F.col("word_count")).alias("_class"),
            F.col("paragraph_count").cast("int").alias("paragraph_count"),
            F.col("word_count").cast("int").alias("word_count"),
            "_newest.age",
            F.col("_newest.id").alias("handoff_id"),
            "_n",
        )
    )
    own = _size_class(F.col("_words"))
    of_asked = (
        asked.where(F.col("_words").isNotNull())
        .distinct()
        .withColumn("_class", F.explode(F.array(own - 1, own, own + 1)))
    )
    return of_asked, of_stored


def _paired(asked: DataFrame, stored: DataFrame) -> DataFrame:
    """Each asked size with each stored size within the bands, as rows."""
    sizes = [F.col(c) for c in ("paragraph_count", "word_count", "_paragraphs", "_words")]
    return (
        asked.join(stored.hint("merge"), list(_GROUP))
        .withColumn("rank", D.tier_rank(D.match_tier(*sizes)))
        .where(F.col("rank").isNotNull())
        .withColumn("combined", D.combined_delta(*sizes))
    )


def _reach(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest word counts that match exactly or closely."""
    band = np.maximum(float(D.CLOSE_WORDS), words * D.CLOSE_WORD_SHARE) + 1
    # Shares of counts that are not above zero say nothing.
    band[words <= 0] = np.inf
    return words - band, words + band


def _block(newest_close: bool):
    """The best stored size of a block for each asked size of it, and the count."""

    def best(asked: pa.Table, stored: pa.Table) -> pa.Table:
        n, m = asked.num_rows, stored.num_rows
        if not n or not m:
            return pa.table(_EMPTY)
        ages, ids = stored["age"].to_pylist(), stored["handoff_id"].to_pylist()
        # The first of equals is then the newest.
        order = sorted(range(m), key=lambda i: (ages[i], ids[i] is not None, ids[i] or ""))
        # Missing numbers become NaN, which no band admits.
        p0, w0 = (
            stored[c].to_numpy().astype(float)[order] for c in ("paragraph_count", "word_count")
        )
        number = stored["_n"].to_numpy()[order]
        if newest_close:
            # Neighbours in size need much the same stored sizes, few of all.
            asked = asked.take(pc.sort_indices(asked["_words"]))
            by_words = np.argsort(w0, kind="stable")
            sorted_words = w0[by_words]
        p1, w1 = (asked[c].to_numpy().astype(float) for c in ("_paragraphs", "_words"))
        rows, at, ranks, gaps, counts = ([np.zeros(0, int)] for _ in range(5))
        step = max(1, BLOCK_PAIRS // m)
        for a in range(0, n, step):
            near = np.arange(m)
            if newest_close:
                low, high = _reach(w1[a : a + step])
                ends = np.searchsorted(sorted_words, (low.min(), high.max() + 1))
                near = np.sort(by_words[slice(*ends)])
                if not near.size:
                    continue
            rank, combined = D.tiers_of_arrays(
                p0[None, near], w0[None, near], p1[a : a + step, None], w1[a : a + step, None]
            )
            count = (rank <= (1 if newest_close else 2)) @ number[near]
            if newest_close:
                first = (rank <= 1).argmax(axis=1)
            else:
                least = rank.min(axis=1)
                # A missing difference goes first.
                held = np.where(np.isnan(combined), -np.inf, combined)
                first = np.where(rank == least[:, None], held, np.inf).argmin(axis=1)
            own = np.flatnonzero(count)
            rows.append(a + own)
            at.append(near[first[own]])
            ranks.append(rank[own, first[own]])
            gaps.append(combined[own, first[own]])
            counts.append(count[own])
        rows, at, ranks, gaps, counts = map(np.concatenate, (rows, at, ranks, gaps, counts))
        found = asked.take(rows)
        chosen = stored.take(np.asarray(order)[at])
        columns = [
            *(found[c] for c in (*TITLE, "_paragraphs", "_words")),
            pa.array(ranks, pa.int32()),
            pa.array(gaps, pa.float64(), mask=np.isnan(gaps)),
            chosen["age"],
            chosen["handoff_id"],
            pa.array(counts, pa.int64()),
        ]
        return pa.table(columns, names=list(_EMPTY))

    return best


_EMPTY = {
    "firm_id": pa.array([], pa.string()),
    "doc_title_normalised": pa.array([], pa.string()),
    "_paragraphs": pa.array([], pa.int32()),
    "_words": pa.array([], pa.int32()),
    "rank": pa.array([], pa.int32()),
    "combined": pa.array([], pa.float64()),
    "age": pa.array([], pa.int64()),
    "handoff_id": pa.array([], pa.string()),
    "_n": pa.array([], pa.int64()),
}


def scored_sizes(
    signals: DataFrame,
    handoffs: DataFrame,
    n: int | None = None,
    newest_close: bool = False,
) -> DataFrame:
    """Stored sizes of an asked size's title within the bands, best of each block.

    Where a title has many sizes of a class, they are compared in blocks of about
    ``BLOCK_SIZES`` by as many, and a block hands on one row per asked size: its
    best stored one and the number of handoffs within the bands.  So pairs are
    neither shuffled nor sorted.  ``newest_close``: the best is the newest that
    matches exactly or closely; only these count, and a block compares only
    stored sizes whose word counts can match so.
    """
    asked, stored = (written(x, "sizes") for x in _sizes(signals, handoffs, n))
    counts = (
        stored.groupBy(*_GROUP)
        .agg(F.count(F.lit(1)).alias("_stored"))
        .join(asked.groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("_asked")), list(_GROUP))
    )
    few = F.col("_stored") <= FEW_SIZES
    pieces = {c: F.ceil(F.col(c) / BLOCK_SIZES).cast("int") for c in ("_stored", "_asked")}
    cut = counts.where(~few).select(*_GROUP, *[v.alias(c) for c, v in pieces.items()])
    small = counts.where(few).select(*_GROUP)
    paired = _paired(asked.join(small, list(_GROUP), "left_semi"), stored)
    if newest_close:
        paired = paired.where(F.col("rank") <= 1)

    def sliced(side: DataFrame, own: str, other: str, *size: str) -> DataFrame:
        every = F.sequence(F.lit(0), F.col(other) - 1)
        return (
            side.join(cut, list(_GROUP))
            .withColumn(f"{own}_slice", F.pmod(F.xxhash64(*size), F.col(own)).cast("int"))
            .withColumn(f"{other}_slice", F.explode(every))
            .drop(own, other)
        )

    key = [*_GROUP, "_asked_slice", "_stored_slice"]
    blocks = (
        sliced(asked, "_asked", "_stored", "_paragraphs", "_words")
        .groupBy(*key)
        .cogroup(
            sliced(stored, "_stored", "_asked", "paragraph_count", "word_count").groupBy(*key)
        )
        .applyInArrow(_block(newest_close), _FOUND)
    )
    return paired.select(*blocks.columns).unionByName(blocks)


def _tier() -> Column:
    names = F.array(*[F.lit(name) for name in D.TIER_RANKS])
    return F.get(names, F.col("_best.rank"))


def _answered(signals: DataFrame, best: DataFrame, how: str) -> DataFrame:
    """Every request with the row of ``best`` for its title and size."""
    keyed = with_title_key(signals).select(
        "request_id",
        *TITLE,
        F.col("paragraph_count").alias("_paragraphs"),
        F.col("word_count").alias("_words"),
    )
    return keyed.join(best, [*TITLE, "_paragraphs", "_words"], how)


def match_handoffs(
    signals: DataFrame, handoffs: DataFrame, n: int | None = None
) -> DataFrame:
    """The best handoff per request and the number of other candidates.

    Best tier, then smallest combined difference, then newest.  With ``n`` only
    the newest ``n`` handoffs of a title are compared.
    """
    ranked = F.struct("rank", "combined", "age", "handoff_id")
    best = (
        scored_sizes(signals, handoffs, n)
        .groupBy(*TITLE, "_paragraphs", "_words")
        .agg(F.min(ranked).alias("_best"), (F.sum("_n") - 1).alias("_others"))
    )
    answers = _answered(signals, best, "left").select(
        *REQUEST, "_best.handoff_id", _tier().alias("tier"), "_best.combined", "_others"
    )
    shown = handoffs.select(
        "firm_id",
        F.col("id").alias("handoff_id"),
        "doc_title",
        "summary",
        "last_active",
        "turn_count",
        F.col("paragraph_count").alias("paragraph_count_then"),
        F.col("word_count").alias("word_count_then"),
    )
    return answers.join(shown, ["firm_id", "handoff_id"], "left").select(
        "request_id",
        "firm_id",
        F.col("handoff_id").isNotNull().alias("found"),
        "handoff_id",
        "tier",
        "combined",
        "doc_title",
        "summary",
        "last_active",
        "turn_count",
        "paragraph_count_then",
        "word_count_then",
        F.coalesce("_others", F.lit(0)).alias("other_candidates"),
    )


def update_targets(
    signals: DataFrame, handoffs: DataFrame, n: int | None = None
) -> DataFrame:
    """Per request the newest handoff that matches exactly or closely."""
    best = (
        scored_sizes(signals, handoffs, n, newest_close=True)
        .groupBy(*TITLE, "_paragraphs", "_words")
        .agg(F.min(F.struct("age", "handoff_id", "rank")).alias("_best"))
    )
    return _answered(signals, best, "inner").select(
        *REQUEST, "_best.handoff_id", _tier().alias("tier")
    )


def changed_handoffs(
    updates: DataFrame, handoffs: DataFrame, now: Column | None = None
) -> DataFrame:
    """The rows that the updates write, in the columns of ``handoffs``.

    Updates: signals with (summary, turn_count, user_id).  An update goes to
    its target, or becomes a new row.  Two updates of one batch that hit the
    same row are applied in ``request_id`` order: the last one stays.
    """
    now = F.current_timestamp() if now is None else now
    targets = update_targets(updates, handoffs).select(*REQUEST, "handoff_id")
    aimed = with_title_key(updates).join(targets, list(REQUEST), "left")
    fresh_id = derived_id("firm_id", "request_id", "doc_title")
    rows = aimed.select(
        F.coalesce("handoff_id", fresh_id).alias("id"),
        "firm_id",
        "doc_title",
        "doc_title_normalised",
        "paragraph_count",
        "word_count",
        "summary",
        F.coalesce("turn_count", F.lit(0)).alias("turn_count"),
        now.alias("last_active"),
        F.col("user_id").alias("last_active_user_id"),
        now.alias("updated_at"),
        "request_id",
    )
    last = top_per_group(rows, ["firm_id", "id"], [F.col("request_id").desc()], 1)
    born = handoffs.select("firm_id", "id", F.col("created_at").alias("_born"))
    return (
        last.join(born, ["firm_id", "id"], "left")
        .withColumn("created_at", F.coalesce("_born", "updated_at"))
        .select(*handoffs.columns)
    )


def upsert_handoffs(
    updates: DataFrame, handoffs: DataFrame, now: Column | None = None
) -> DataFrame:
    """The handoff table after the updates (see ``changed_handoffs``)."""
    changed = changed_handoffs(updates, handoffs, now)
    keys = ["firm_id", "id"]
    untouched = handoffs.join(changed.select(*keys), keys, "left_anti")
    return untouched.select(*handoffs.columns).unionByName(changed)


def report_empty_titles(df: DataFrame) -> DataFrame:
    """Per firm the titles whose key is empty: they all share one key."""
    return (
        with_title_key(df)
        .where(F.col("empty_title"))
        .groupBy("firm_id")
        .agg(F.count(F.lit(1)).alias("n_titles"))
    )
