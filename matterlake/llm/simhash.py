"""SimHash document fingerprints and search within a Hamming radius.

Terms are words and runs of two and three words.  Each term's hash votes on
the bits of the fingerprint, with the term's weight and the sign of its bit;
the sign of the sum is the bit.  Runs weigh more than words, because single
words are shared by most texts of a language.

A text without words has the fingerprint of no votes (all bits 0).
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matterlake.llm.blocks import (
    SPACED,
    Texts,
    Words,
    cut,
    map_batches,
    mix,
    small_batches,
)
from matterlake.plans.storage import written

BITS = 256
# Words in a run, and the weight of such a term.
TERMS = ((1, 1), (2, 6), (3, 6))

# Byte value -> its bits, the highest first, each in a byte of its own.
_SPREAD = np.ascontiguousarray(
    np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)
).view(np.uint64).ravel()
_GROUP = 255


def fingerprints(texts: Texts, bits: int = BITS) -> np.ndarray:
    """Rows x bits/8 bytes."""
    words = Words(texts, SPACED)
    h = words.hashes()
    votes = np.zeros((texts.n, bits), np.int32)
    for size, weight in TERMS:
        n = max(0, len(h) - size + 1)
        same = np.flatnonzero(words.row[:n] == words.row[len(h) - n :])
        term = np.full(len(same), size, np.uint64)
        for j in range(size):
            term = mix(term + h[same + j])
        _vote(votes, term, words.row[same], weight)
    return np.packbits(votes > 0, axis=1)


def _vote(votes: np.ndarray, h: np.ndarray, row: np.ndarray, weight: int) -> None:
    """Adds ``weight`` with the sign of each bit of ``h`` to its row.

    Eight bits are counted at once in the bytes of one integer, in groups of
    terms small enough that no byte overflows.
    """
    if not len(h):
        return
    at = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    n = np.diff(np.append(at, len(row)))
    groups = -(-n // _GROUP)
    first = np.cumsum(groups) - groups
    nth = np.arange(int(groups.sum())) - np.repeat(first, groups)
    cuts = np.repeat(at, groups) + nth * _GROUP
    for lane in range(votes.shape[1] // 64):
        own = h if lane == 0 else mix(h + np.uint64(lane))
        raw = own.view(np.uint8).reshape(-1, 8)
        sums = np.stack([np.add.reduceat(_SPREAD[raw[:, k]], cuts) for k in range(8)], axis=1)
        ones = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 64).astype(np.int32)
        up = np.add.reduceat(ones, first, axis=0)
        votes[row[at], 64 * lane : 64 * lane + 64] += weight * (2 * up - n[:, None])


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """1 minus the share of bits that differ."""
    return 1.0 - np.bitwise_count(a ^ b).sum(axis=1) / (8.0 * a.shape[1])


def _hex(prints: np.ndarray) -> pa.Array:
    return pa.array([bytes(p).hex() for p in prints], pa.string())


def fingerprint(df: DataFrame, text: str = "text", bits: int = BITS) -> DataFrame:
    """``df`` and ``fingerprint`` (hex); null and empty texts get all zeros."""
    small_batches(df.sparkSession)
    kept = [c for c in df.columns if c != "fingerprint"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.schema.names.index(text))
        parts = [fingerprints(Texts(column[a:b]), bits) for a, b in cut(column)]
        arrays = [batch.column(batch.schema.names.index(c)) for c in kept]
        return pa.RecordBatch.from_arrays(
            [*arrays, _hex(np.concatenate(parts))], names=[*kept, "fingerprint"]
        )

    schema = df.select(*kept).schema.add("fingerprint", "string")
    return map_batches(df, run, schema)


def tables(fingerprint: Column, radius: int, bits: int = BITS) -> Column:
    """The keys of the permuted tables: one per choice of equal blocks.

    The bits are cut into ``radius + 2`` blocks.  Two fingerprints that differ
    in at most ``radius`` bits agree on at least two whole blocks, so each pair
    of blocks brought to the front is one table, and its key is looked up.
    """
    digits = bits // 4
    n = radius + 2
    if n > digits:
        raise ValueError("the radius leaves blocks of less than one hex digit")
    edges = [digits * i // n for i in range(n + 1)]
    block = [
        F.substring(fingerprint, edges[i] + 1, edges[i + 1] - edges[i])
        for i in range(n)
    ]
    return F.array(
        *[
            F.concat(F.lit(f"{i}.{j}:"), block[i], block[j])
            for i in range(n)
            for j in range(i + 1, n)
        ]
    )


def differing_bits(a: Column, b: Column, bits: int = BITS) -> Column:
    def part(c: Column, i: int) -> Column:
        # 15 hex digits stay below the sign bit of a long.
        return F.conv(F.substring(c, i + 1, 15), 16, 10).cast("long")

    total = F.lit(0)
    for i in range(0, bits // 4, 15):
        total = total + F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return total


def within(
    left: DataFrame, right: DataFrame, radius: int, bits: int = BITS
) -> DataFrame:
    """Every pair (left_print, right_print, differing) within ``radius`` bits.

    Both sides have a column ``fingerprint``.  Equal fingerprints are one row
    of the search, whatever number of documents carries them, so a group of
    copies is never expanded; join the pairs back to the documents by
    fingerprint.  Null fingerprints match nothing.
    """

    def keyed(df: DataFrame, name: str) -> DataFrame:
        one = df.where(F.col("fingerprint").isNotNull()).select(
            F.col("fingerprint").alias(name)
        ).distinct()
        return one.select(name, F.explode(tables(F.col(name), radius, bits)).alias("_k"))

    met = keyed(left, "left_print").join(keyed(right, "right_print"), "_k")
    near = met.withColumn(
        "differing", differing_bits(F.col("left_print"), F.col("right_print"), bits)
    ).where(F.col("differing") <= radius)
    return near.select("left_print", "right_print", "differing").distinct()


# -- a document against its edit and its successor --------------------------

_OUT = (
    "doc_id long, n_chars long, edited_sha256 string, fingerprint string, "
    "edited_fingerprint string, near_edited double, near_next double, "
    "_part int, _end int, _text string"
)


def _edited(own: list[str], following: list[str]) -> list[str]:
    return [a[: len(a) - len(a) // 2] + b[: len(a) // 2] for a, b in zip(own, following)]


def _compared(ids: pa.Array, own: list[str], following: list[str], bits: int) -> dict:
    edits = _edited(own, following)
    # The successor of a row is mostly the next row: its print is made once.
    chain = all(following[i] is own[i + 1] for i in range(len(own) - 1))
    run = own + following[-1:] if chain else own + following
    prints = fingerprints(Texts(pa.array(run, pa.large_string())), bits)
    mine = prints[: len(own)]
    after = prints[1:] if chain else prints[len(own) :]
    new = fingerprints(Texts(pa.array(edits, pa.large_string())), bits)
    return {
        "doc_id": ids,
        "n_chars": pa.array([len(t) for t in own], pa.int64()),
        "edited_sha256": pa.array(
            [hashlib.sha256(t.encode()).hexdigest() for t in edits]
        ),
        "fingerprint": _hex(mine),
        "edited_fingerprint": _hex(new),
        "near_edited": pa.array(likeness(mine, new)),
        "near_next": pa.array(likeness(mine, after)),
    }


def against_edit(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """Each text next to its edited text and to the next document.

    The order is by doc_id (null first), then text; the last document is
    followed by the first, a single one by itself.  One range partitioning
    brings neighbours together; a partition is streamed in order, holding one
    text back.  The first and last text of each partition are written with the
    finished rows, and their few links are made from that table.
    """
    spark = docs.sparkSession
    small_batches(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumn("_h", F.xxhash64("text"))
    placed = (
        slim.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "_h")
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "_h")
        .select("doc_id", "text", F.spark_partition_id().alias("_part"))
    )
    blank = dict.fromkeys(
        ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    )

    def border(doc_id: pa.Scalar, text: str, part: int, end: int) -> pa.RecordBatch:
        row = {**blank, "doc_id": doc_id.as_py(), "_part": part, "_end": end, "_text": text}
        return pa.RecordBatch.from_pylist([row], schema=_arrow_schema())

    def finished(ids: pa.Array, own: list[str], following: list[str], part: int):
        rows = _compared(ids, own, following, bits)
        m = len(own)
        rows["_part"] = pa.array([part] * m, pa.int32())
        rows["_end"] = pa.array([-1] * m, pa.int32())
        rows["_text"] = pa.nulls(m, pa.string())
        return pa.RecordBatch.from_arrays(
            [rows[f.name] for f in _arrow_schema()], schema=_arrow_schema()
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_id, held, part = None, None, 0
        for batch in batches:
            column = batch.column(1)
            for a, b in cut(column):
                texts = column[a:b].to_pylist()
                ids = batch.column(0)[a:b]
                part = batch.column(2)[a].as_py()
                if held is None:
                    yield border(ids[0], texts[0], part, 0)
                else:
                    ids = pa.concat_arrays([pa.array([held_id.as_py()], pa.int64()), ids])
                    texts = [held, *texts]
                if len(texts) > 1:
                    yield finished(ids[:-1], texts[:-1], texts[1:], part)
                held_id, held = ids[len(texts) - 1], texts[-1]
        if held is not None:
            yield border(held_id, held, part, 1)

    rows = written(placed.mapInArrow(run, _OUT), "prints")
    inner = rows.where(F.col("_end") == -1).drop("_part", "_end", "_text")
    # Two rows per partition: the links across borders.

    ends = rows.where(F.col("_end") >= 0).select("doc_id", "_text", "_part", "_end")
    heads = ends.where(F.col("_end") == 0).select("_part", F.col("_text").alias("_next"))
    # Part numbers only: one small row per partition, the last one's follower is
    # the first.
    along = Window.orderBy("_part")
    first = F.min("_part").over(
        along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    )
    follow = heads.select(
        "_part", F.coalesce(F.lead("_part").over(along), first).alias("_to")
    )
    links = (
        ends.where(F.col("_end") == 1)
        .join(follow, "_part")
        .join(heads.withColumnRenamed("_part", "_to"), "_to")
        .select("doc_id", "_text", "_next")
    )

    def link(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = _compared(
            batch.column(0), batch.column(1).to_pylist(), batch.column(2).to_pylist(), bits
        )
        return pa.RecordBatch.from_arrays(list(rows.values()), names=list(rows))

    return inner.unionByName(map_batches(links, link, inner.schema))


def _arrow_schema() -> pa.Schema:
    long, text, number, small = pa.int64(), pa.string(), pa.float64(), pa.int32()
    return pa.schema(
        [
            ("doc_id", long),
            ("n_chars", long),
            ("edited_sha256", text),
            ("fingerprint", text),
            ("edited_fingerprint", text),
            ("near_edited", number),
            ("near_next", number),
            ("_part", small),
            ("_end", small),
            ("_text", text),
        ]
    )
