"""Mixing sources to target weights by weighted sampling without replacement.

A document's Efraimidis-Spirakis key is ``u ** (1 / quality)`` with ``u`` drawn
from its id, so reruns agree.  A source first gives all its documents as often
as its budget holds it whole; the rest goes to the documents with the largest
keys, up to the budget, and the last one of them may be cut to some words.

Built-in functions only.  No source is ever gathered: its documents are
range-partitioned by key, and prefix sums run per slice, with one row per slice
carrying the sums across.  The outcome is one row per source (whole epochs, the
key at the cut, the words left for it), which every document is held against,
so texts are not shuffled.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matterlake.plans.storage import written

# The definition of a word and of blanks (fixed values).
WORD = r"[^\x20\x09-\x0D]+"
AFTER_WORD = r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])"

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST_EPOCHS = 2
SEED = "mix"

# A table with one row per source is broadcast up to this many rows.
SHIPPED_SOURCES = 50_000

_USUAL_LENGTH = 6.0


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def usual_words(n_chars: Column, size: Column) -> Column:
    """A quality weight in (0, 1]: how near characters per word are to prose."""
    per_word = n_chars / F.greatest(size, F.lit(1))
    return 1.0 / (1.0 + F.abs(per_word - _USUAL_LENGTH) / _USUAL_LENGTH)


def sampling_key(doc_id: Column, quality: Column, seed: str = SEED) -> Column:
    """``u ** (1 / quality)``, ``u`` from 52 bits of a hash of id and seed."""
    name = F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit("")))
    u = F.conv(F.substring(F.md5(name), 1, 13), 16, 10).cast("double")
    return F.pow((u + 1.0) / float(2**52 + 1), 1.0 / quality)


def targets(sizes: DataFrame) -> DataFrame:
    """``sizes`` (source, source_size) with weight, target, epochs and rest.

    Weights go round over the sources by name, null last.  The budget is shared
    by weight; a source stops at ``MOST_EPOCHS`` times its size and leaves its
    excess to the others.  In ascending order of limit per weight the stopped
    sources come first, so two running sums find the common level.  The window
    orders one row per source.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weighted = sizes.withColumn(
        "weight", F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).cast("double")
    ).withColumn("_limit", MOST_EPOCHS * F.col("source_size").cast("double"))
    along = Window.orderBy(
        F.col("_limit") / F.col("weight"), F.col("source").asc_nulls_last()
    )
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    rest = along.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everyone = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    total = SHARE * F.sum("source_size").over(everyone).cast("double")
    level = (total - F.coalesce(F.sum("_limit").over(before), F.lit(0.0))) / F.sum(
        "weight"
    ).over(rest)
    levelled = weighted.withColumn("_level", level).withColumn(
        "_stops", F.col("_limit") <= F.col("weight") * F.col("_level")
    )
    # The level at the first source that does not stop holds for all after it.
    common = F.min(F.when(~F.col("_stops"), F.struct(F.col("_limit") / F.col("weight"), "_level"))).over(
        everyone
    )
    target = F.when(
        (F.col("_common").isNotNull())
        & (F.col("_limit") > F.col("weight") * F.col("_common._level")),
        F.col("weight") * F.col("_common._level"),
    ).otherwise(F.col("_limit"))
    size = F.col("source_size")
    return (
        levelled.withColumn("_common", common)
        .withColumn("target", target)
        .withColumn(
            "epochs",
            F.when(size > 0, F.floor(F.col("target") / size)).otherwise(0).cast("long"),
        )
        .withColumn(
            "rest", F.floor(F.col("target") - F.col("epochs") * size + 0.5).cast("long")
        )
        .select("source", "source_size", "weight", "target", "epochs", "rest")
    )


def _sized(docs: DataFrame, quality: Column | None, seed: str) -> DataFrame:
    """Adds ``_size``, ``_key`` and ``_tie``; ``_id`` and ``_source`` likewise."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    sized = docs.withColumn("_size", word_count(text))
    weight = usual_words(F.length(text), F.col("_size")) if quality is None else quality
    return (
        sized.withColumn("_key", sampling_key(F.col("doc_id"), weight, seed))
        .withColumn("_tie", F.xxhash64(text))
        .withColumn("_id", F.col("doc_id"))
        .withColumn("_source", F.col("source"))
    )


_ORDER = ("_key", "_id", "_tie")


def _order() -> list[Column]:
    return [F.col("_key").desc(), F.col("_id").asc_nulls_last(), F.col("_tie").asc()]


def plan(slim: DataFrame) -> DataFrame:
    """One row per source: sizes, target, epochs and where the last epoch ends.

    ``cut_key``, ``cut_id``, ``cut_tie``: the document at the end; ``cut_words``:
    the words it still gives; ``cut_rows``: rows that equal it in all of these.
    """
    sizes = slim.groupBy(F.col("_source").alias("source")).agg(
        F.sum("_size").alias("source_size")
    )
    per_source = written(targets(sizes), "targets")
    spark = slim.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written, so that every later use sees the same slice of a row.
    sliced = written(
        slim.repartitionByRange(slices, F.col("_source"), *_order()).withColumn(
            "_slice", F.spark_partition_id()
        ),
        "slices",
    )
    along = Window.partitionBy("_source", "_slice").orderBy(*_order())
    inner = sliced.withColumn(
        "_inside",
        F.coalesce(
            F.sum("_size").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
        ),
    )
    over_slices = Window.partitionBy("_at").orderBy("_on")
    offsets = (
        sliced.groupBy(F.col("_source").alias("_at"), F.col("_slice").alias("_on"))
        .agg(F.sum("_size").alias("_n"))
        .select(
            "_at",
            "_on",
            F.coalesce(
                F.sum("_n").over(over_slices.rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0),
            ).alias("_offset"),
        )
    )
    before = inner.join(
        offsets, F.col("_source").eqNullSafe(F.col("_at")) & (F.col("_slice") == F.col("_on"))
    ).select("_source", "_size", *_ORDER, (F.col("_inside") + F.col("_offset")).alias("_before"))
    budget = per_source.select(F.col("source").alias("_of"), "rest")
    placed = before.join(
        _small(budget), F.col("_source").eqNullSafe(F.col("_of"))
    )
    at_cut = (F.col("_before") < F.col("rest")) & (
        F.col("rest") <= F.col("_before") + F.col("_size")
    )
    # Equal rows are indistinguishable: the run of them that the cut falls in.
    same = Window.partitionBy("_source", *_ORDER)
    cut = (
        placed.where(F.col("rest") > 0)
        .select(
            "_source",
            *_ORDER,
            (F.col("rest") - F.min("_before").over(same)).alias("_words"),
            F.count(F.lit(1)).over(same).alias("_rows"),
            at_cut.alias("_here"),
        )
        .where("_here")
        .select(
            F.col("_source").alias("_of"),
            F.col("_key").alias("cut_key"),
            F.col("_id").alias("cut_id"),
            F.col("_tie").alias("cut_tie"),
            F.col("_words").alias("cut_words"),
            F.col("_rows").alias("cut_rows"),
        )
    )
    return written(
        per_source.join(cut, F.col("source").eqNullSafe(F.col("_of")), "left").drop("_of"),
        "mix",
    )


def _small(per_source: DataFrame) -> DataFrame:
    """Broadcast when the number of sources allows it, else a plain join."""
    few = per_source.limit(SHIPPED_SOURCES + 1).count() <= SHIPPED_SOURCES
    return F.broadcast(per_source) if few else per_source


def _taken(sized: DataFrame, outcome: DataFrame) -> DataFrame:
    """Adds ``_epochs`` (whole copies) and ``_part`` (words of a last copy)."""
    held = _small(
        outcome.select(
            F.col("source").alias("_of"),
            F.col("source_size").alias("_all"),
            F.col("target").alias("_target"),
            F.col("epochs").alias("_epochs"),
            *[F.col(c).alias(f"_{c}") for c in outcome.columns if c.startswith("cut_")],
        )
    )
    joined = sized.join(held, F.col("_source").eqNullSafe(F.col("_of")), "left")
    id_first = (
        F.when(F.col("_id").isNull(), F.lit(False))
        .when(F.col("_cut_id").isNull(), F.lit(True))
        .otherwise(F.col("_id") < F.col("_cut_id"))
    )
    same_id = F.col("_id").eqNullSafe(F.col("_cut_id"))
    ahead = (F.col("_key") > F.col("_cut_key")) | (
        (F.col("_key") == F.col("_cut_key"))
        & (id_first | (same_id & (F.col("_tie") < F.col("_cut_tie"))))
    )
    here = (
        (F.col("_key") == F.col("_cut_key")) & same_id & (F.col("_tie") == F.col("_cut_tie"))
    )
    part = (
        F.when(F.col("_cut_key").isNull(), F.lit(0))
        .when(ahead, F.col("_size"))
        .when(here, F.floor(F.col("_cut_words") / F.col("_cut_rows")))
        .otherwise(F.lit(0))
    )
    return joined.withColumn("_part", part.cast("long"))


def mix(docs: DataFrame, quality: Column | None = None, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target and taken words.

    Null texts have no words; a null source is a source of its own; an empty
    table gives no rows.  Repeated rows each count; where the budget ends
    inside a run of rows that agree in id and text, they share what is left.
    Columns beside doc_id, source and text are not read.
    """
    slim = written(
        _sized(docs.select("doc_id", "source", "text"), quality, seed).select(
            "_source", "_size", *_ORDER
        ),
        "sizes",
    )
    return _taken(slim, plan(slim)).select(
        F.col("_id").alias("doc_id"),
        F.col("_size").alias("size"),
        F.col("_all").alias("source_size"),
        F.col("_target").alias("target"),
        (F.col("_epochs") * F.col("_size") + F.col("_part")).alias("taken"),
    )


def mixed_documents(
    docs: DataFrame, quality: Column | None = None, seed: str = SEED
) -> DataFrame:
    """The mix itself: rows of ``docs``, repeated by epoch.

    The document at the end of a budget is cut behind its last taken word.  A
    text without words is in every whole epoch and in no fraction.
    """
    sized = _sized(docs, quality, seed)
    slim = written(sized.select("_source", "_size", *_ORDER), "sizes")
    taken = _taken(sized, plan(slim))
    copies = F.col("_epochs") + F.when(F.col("_part") > 0, 1).otherwise(0)
    repeated = taken.where(copies > 0).withColumn(
        "_copy", F.explode(F.sequence(F.lit(1).cast("long"), copies))
    )
    last = (F.col("_copy") > F.col("_epochs")) & (F.col("_part") < F.col("_size"))
    pieces = F.slice(F.split("text", AFTER_WORD), 1, F.col("_part").cast("int"))
    text = F.when(last, F.array_join(pieces, "")).otherwise(F.col("text"))
    return repeated.withColumn("text", text).select(*docs.columns)
