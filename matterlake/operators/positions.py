"""Versioned clause positions: supersession, current and history views."""

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.functions import coerce as C
from matterlake.functions import text as X
from matterlake.plans.skew import HOT_ROWS, in_order, top_per_group, with_neighbours

KEY = ("firm_id", "matter_id", "clause_type")
ORDER = ("created_at", "seq", "id")
# What a table of positions is stored by; a part of the key.
MATTER = ("firm_id", "matter_id")


def supersede(
    positions: DataFrame,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
    slice_rows: int | None = None,
) -> DataFrame:
    """Adds ``superseded_by``, ``supersedes`` and ``version``.

    The next row of the same key supersedes a row, also within one batch and
    whether or not the value differs.
    """
    bare = positions.drop("superseded_by")
    linked = with_neighbours(bare, keys, order, "id", hot_rows, slice_rows)
    return linked.withColumnsRenamed(
        {"next_id": "superseded_by", "previous_id": "supersedes"}
    )


def current(positions: DataFrame) -> DataFrame:
    """Rows that nothing supersedes."""
    return positions.where(F.col("superseded_by").isNull())


def latest(
    positions: DataFrame,
    keys: Sequence[str] = KEY,
    order: Sequence[str] = ORDER,
) -> DataFrame:
    """The current row of each key straight from unlinked rows.

    Equal to ``current(supersede(..))``, but only one row per key and map task
    is shuffled.
    """
    newest = [F.col(c).desc() for c in order]
    return top_per_group(positions, keys, newest, 1).drop("rank")


def history(
    positions: DataFrame,
    clause_type: str | None = None,
    hot_rows: int = HOT_ROWS,
    bucketed: bool = False,
) -> DataFrame:
    """All rows, oldest first within a matter, numbered per key.

    ``version`` is the place within a key.  ``bucketed`` says that the table is
    stored in buckets of ``MATTER`` (``write_bucketed``): then nothing is
    shuffled.
    """
    chosen = positions
    if clause_type is not None:
        chosen = chosen.where(F.col("clause_type") == clause_type)
    linked = supersede(chosen, hot_rows=hot_rows)
    if bucketed:
        return linked.sortWithinPartitions(*MATTER, *ORDER)
    return in_order(linked, MATTER, ORDER)


def write_positions(
    stored: DataFrame,
    batch: DataFrame,
    order: Sequence[str] = ORDER,
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """The stored table after a batch of new rows (in ``order``).

    The first new row of a key supersedes every stored row of the key that is
    still current; within the batch each row supersedes the one before it.
    Rows superseded earlier keep their link.
    """
    place = F.struct(*order)
    first_new = batch.groupBy(*KEY).agg(F.min_by("id", place).alias("_first"))
    columns = stored.columns
    closed = stored.join(first_new, list(KEY), "left").select(
        *[
            F.coalesce("superseded_by", "_first").alias(c)
            if c == "superseded_by"
            else F.col(c)
            for c in columns
        ]
    )
    fresh = supersede(batch, order=order, hot_rows=hot_rows)
    return closed.unionByName(fresh.select(*columns))


def write_counts(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Per firm: rows inserted and rows superseded by writing ``batch``.

    Every stored current row of a touched key is superseded, and every new row
    of a key but its last.
    """
    keyed = batch.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_new"))
    closed = (
        current(stored).join(keyed, list(KEY), "left_semi").groupBy("firm_id").agg(
            F.count(F.lit(1)).alias("n_closed")
        )
    )
    per_firm = keyed.groupBy("firm_id").agg(
        F.sum("n_new").alias("inserted"),
        F.sum(F.col("n_new") - 1).alias("n_inner"),
    )
    return per_firm.join(closed, "firm_id", "left").select(
        "firm_id",
        "inserted",
        (F.col("n_inner") + F.coalesce("n_closed", F.lit(0))).alias("superseded"),
    )


def position_view(positions: DataFrame) -> DataFrame:
    """Stored rows with the defaults of missing values."""
    return positions.select(
        "id",
        "firm_id",
        "matter_id",
        "clause_type",
        F.coalesce("value", F.lit("{}")).alias("value"),
        F.coalesce("status", F.lit("open")).alias("status"),
        "counterparty_name",
        "party_role",
        "source_document_id",
        "source_chunk_text",
        "extracted_at",
        "extracted_by",
        "confidence",
        "created_at",
        "superseded_by",
    )


def position_summary(positions: DataFrame) -> DataFrame:
    """The compact form that the position lists show."""
    return positions.select(
        "firm_id",
        "matter_id",
        "id",
        "clause_type",
        "value",
        "status",
        F.col("counterparty_name").alias("counterparty"),
        "party_role",
        C.asserted_by(F.col("extracted_by")).alias("asserted_by"),
        F.col("created_at").alias("asserted_at"),
        F.col("source_chunk_text").alias("source_note"),
        "confidence",
        F.col("superseded_by").isNotNull().alias("superseded"),
    )


def with_status(positions: DataFrame, *statuses: str) -> DataFrame:
    """Current rows in one of the given states."""
    return current(positions).where(F.col("status").isin(*statuses))


def open_positions(positions: DataFrame) -> DataFrame:
    """Current rows under negotiation (``open`` only), by clause."""
    found = position_summary(with_status(positions, "open"))
    return in_order(found, ("firm_id", "matter_id"), ("clause_type", "id"))


def settled_positions(positions: DataFrame) -> DataFrame:
    """Current agreed rows, by clause."""
    found = position_summary(with_status(positions, "settled"))
    return in_order(found, ("firm_id", "matter_id"), ("clause_type", "id"))


def position_counts(positions: DataFrame) -> DataFrame:
    """Per matter: current, open (with proposed) and settled rows."""
    status = F.col("status")
    return (
        current(positions)
        .groupBy("firm_id", "matter_id")
        .agg(
            F.count(F.lit(1)).alias("active_count"),
            F.count_if(status.isin("open", "proposed")).alias("open_count"),
            F.count_if(status == "settled").alias("settled_count"),
        )
    )


def matter_state(matters: DataFrame, positions: DataFrame) -> DataFrame:
    """Every matter with the counts of its current positions."""
    counts = position_counts(positions).withColumnRenamed("matter_id", "id")
    names = ("active_count", "open_count", "settled_count")
    return matters.join(counts, ["firm_id", "id"], "left").select(
        *matters.columns, *[F.coalesce(n, F.lit(0)).alias(n) for n in names]
    )


def matter_positions(matters: DataFrame, positions: DataFrame) -> DataFrame:
    """The open and settled positions of each matter, one row per position.

    ``section`` says which list a row belongs to.  Rows, not arrays: a matter
    with any number of positions stays splittable.
    """
    status = F.col("status")
    section = F.when(status.isin("open", "proposed"), "open").when(
        status == "settled", "settled"
    )
    known = matters.select("firm_id", F.col("id").alias("matter_id"))
    listed = (
        current(positions)
        .withColumn("section", section)
        .where(F.col("section").isNotNull())
        .join(known, ["firm_id", "matter_id"], "left_semi")
    )
    return listed.select(
        "firm_id",
        "matter_id",
        "section",
        "id",
        "clause_type",
        F.col("value").alias("current_value"),
        F.col("counterparty_name").alias("counterparty"),
        "party_role",
        C.asserted_by(F.col("extracted_by")).alias("asserted_by"),
        F.col("created_at").alias("asserted_at"),
        F.when(F.col("section") == "open", F.col("confidence")).alias("confidence"),
    )


def normalise_positions(raw: DataFrame, excerpt_chars: int | None = None) -> DataFrame:
    """Extractor output forced into the stored shape; other columns stay.

    ``excerpt_chars`` cuts longer excerpts.
    """
    excerpt = F.coalesce(F.col("source_chunk_text"), F.lit(""))
    shaped: dict[str, Column] = {
        "clause_type": F.coalesce(F.col("clause_type"), F.lit("other")),
        "value": C.json_value(F.col("value")),
        "status": C.position_status(F.col("status")),
        "party_role": C.party_role(F.col("party_role")),
        "source_chunk_text": excerpt if excerpt_chars is None else X.head(excerpt, excerpt_chars),
        "confidence": C.clamp_confidence(F.col("confidence")),
    }
    return raw.withColumns(shaped)
