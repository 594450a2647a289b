"""Matters: the default-filled view, summaries, lookup and directory."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.functions import coerce as C
from matterlake.plans.skew import top_per_group


def matter_view(matters: DataFrame) -> DataFrame:
    """Stored matters with defaults, parsed parties and derived columns."""
    archived = F.coalesce("archived", F.lit(False))
    opened = F.coalesce(
        F.col("created_at"),
        F.timestamp_seconds(F.lit(0)).cast(matters.schema["created_at"].dataType),
    )
    law = F.nullif(F.col("governing_law"), F.lit(""))
    return matters.select(
        "id",
        F.coalesce("firm_id", F.lit("")).alias("firm_id"),
        F.coalesce("client_id", F.lit("")).alias("client_id"),
        "matter_name",
        "client_name",
        C.json_field(F.col("deal_parameters"), "matter_type", "other").alias(
            "matter_type"
        ),
        F.coalesce(
            F.col("stage"), F.when(archived, "closed").otherwise("in_negotiation")
        ).alias("stage"),
        F.coalesce("privilege_scope", F.lit("open")).alias("privilege_scope"),
        opened.alias("opened_at"),
        F.when(archived, F.col("last_accessed")).alias("closed_at"),
        C.normalise_parties(F.col("parties")).alias("parties"),
        law.alias("settled_governing_law"),
        F.coalesce("context", F.lit("{}")).alias("state"),
        "created_at",
    )


def _open_count() -> Column:
    # The flat matter row carries no open positions.
    return F.lit(0)


def directory_summary(view: DataFrame) -> DataFrame:
    """The short form used in lists."""
    return view.select(
        "firm_id",
        "id",
        "matter_name",
        "client_id",
        "client_name",
        "matter_type",
        "stage",
        "opened_at",
        C.counterparties(F.col("parties")).alias("counterparties"),
        _open_count().alias("open_position_count"),
    )


def document_summary(view: DataFrame) -> DataFrame:
    """The short form shown for a resolved document, with three counts."""
    return view.select(
        "firm_id",
        "id",
        "matter_name",
        "client_id",
        "client_name",
        "stage",
        "matter_type",
        "opened_at",
        "closed_at",
        F.size(C.counterparties(F.col("parties"))).alias("counterparty_count"),
        F.col("settled_governing_law")
        .isNotNull()
        .cast("int")
        .alias("settled_position_count"),
        _open_count().alias("open_position_count"),
    )


def matters_for(requests: DataFrame, matters: DataFrame) -> DataFrame:
    """Requests (request_id, firm_id, matter_id) with their matter, or none."""
    view = matter_view(matters).withColumnRenamed("id", "matter_id")
    return requests.join(
        view.withColumn("found", F.lit(True)), ["firm_id", "matter_id"], "left"
    ).withColumn("found", F.coalesce("found", F.lit(False)))


def list_matters(
    matters: DataFrame,
    client_id: str | None = None,
    stage: str | None = None,
    counterparty: str | None = None,
    n: int | None = None,
) -> DataFrame:
    """The matters of each firm, filtered by the arguments that are given.

    With ``n`` (``DIRECTORY_ROWS`` for one page) only the newest ``n`` of a firm
    are taken, and the counterparty test comes after that limit.
    """
    chosen = matters
    if client_id is not None:
        chosen = chosen.where(F.col("client_id") == client_id)
    if stage is not None:
        chosen = chosen.where(F.col("stage") == stage)
    if n is not None:
        newest = [F.col("created_at").desc_nulls_first(), F.col("id").asc()]
        chosen = top_per_group(chosen, ["firm_id"], newest, n)
    listed = matter_view(chosen)
    if counterparty is not None:
        listed = listed.where(C.involves(F.col("parties"), F.lit(counterparty)))
    return directory_summary(listed)


def directory_counts(listed: DataFrame) -> DataFrame:
    """Matters listed per firm."""
    return listed.groupBy("firm_id").agg(F.count(F.lit(1)).alias("count"))
