"""A Merkle manifest of a document table.

A leaf is the sha256 of a document's fields, each with its length.  Per
language the leaves stand in the order of their ids, and a binary tree reduces
them to a subroot; the subroots, ordered by language, reduce to the root.  A
run of two nodes becomes the hash of both, a run of one the hash of that one.

Cogrouped subtree exchange.  Leaves are hashed by built-in functions and the
texts go no further.  Range partitioning places them: a node's position is its
place in its slice plus the nodes of earlier slices, one row per slice.  Each
run of ``BLOCK`` consecutive nodes is a superblock.  On the way up every
superblock reduces to one node of the next tier, until a tree has one node.  On
the way down the nodes of a tier and the required outer nodes (the siblings
above each superblock's top) are cogrouped by superblock: one call finishes the
local reduction, joins the local siblings to the outer ones and, at the leaves,
folds each leaf up to the root.  A tier has one ``BLOCK``-th of the rows of the
one below, so tiers are few and no task holds more than a block.

Null columns hash as ``-``.  A null ``lang`` is a tree of its own, before all
others; null ids come first in their tree and are never altered.  Equal ids are
ordered by leaf; rows equal in all columns are leaves of their own with the
same hash.  Empty texts hash as ``0:``; texts of any length are hashed whole.
An empty table gives an empty result.  Other columns are left aside.
"""

from collections.abc import Iterator
from hashlib import sha256

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matterlake.llm.blocks import small_batches
from matterlake.llm.columns import only
from matterlake.plans.storage import written

BLOCK = 1024
EVERY = 7

# A sibling on the path of a node: its hash after the side it stands on, or
# ALONE where the run holds no other node.
LEFT, RIGHT, ALONE = "<", ">", "-"


def _field(value: Column) -> Column:
    value = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)
    )


def leaf_hash(n_chars: Column | None = None) -> Column:
    """The hash of a row's doc_id, source, lang, n_chars and text."""
    n_chars = F.col("n_chars") if n_chars is None else n_chars
    fields = [F.col("doc_id"), F.col("source"), F.col("lang"), n_chars, F.col("text")]
    return F.sha2(F.concat(*map(_field, fields)), 256)


def altered() -> Column:
    """Rows whose ``n_chars`` is tampered with."""
    marked = F.crc32(F.col("doc_id").cast("string")) % EVERY == 0
    return F.coalesce(marked & F.col("n_chars").isNotNull(), F.lit(False))


def leaves(docs: DataFrame) -> DataFrame:
    """(tree, doc_id, node, bent): a leaf, and its hash when tampered with."""
    rows = only(
        docs, doc_id="long", source="string", lang="string", n_chars="long", text="string"
    )
    # Decimal, so that the largest long has a successor.
    more = F.col("n_chars").cast("decimal(20,0)") + 1
    tree = F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))
    return rows.select(
        tree.alias("tree"),
        "doc_id",
        leaf_hash().alias("node"),
        F.when(altered(), leaf_hash(more)).alias("bent"),
        F.monotonically_increasing_id().alias("row"),
    )


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the slice's number and each row's place in its (slice, tree)."""
    part, before, n = TaskContext.get().partitionId(), None, 0
    for batch in batches:
        places = []
        for tree in batch["tree"].to_pylist():
            n = n + 1 if tree == before else 0
            before = tree
            places.append(n)
        yield pa.RecordBatch.from_arrays(
            [
                *batch.columns,
                pa.array([part] * len(places), pa.int32()),
                pa.array(places, pa.int64()),
            ],
            names=[*batch.schema.names, "part", "place"],
        )


def _schema(df: DataFrame, more: str) -> str:
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return f"{own}, {more}"


def placed(nodes: DataFrame, *order: str) -> DataFrame:
    """``nodes`` with ``pos`` (from 0, in ``order`` within a tree) and ``n``,
    the number of nodes of the tree.  ``order`` must tell all rows apart."""
    spark = nodes.sparkSession
    small_batches(spark)
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Written: range bounds are sampled, a second run could cut elsewhere.
    ranked = written(
        nodes.repartitionByRange(slices, "tree", *order)
        .sortWithinPartitions("tree", *order)
        .mapInArrow(_numbered, _schema(nodes, "part int, place long")),
        "ranked",
    )
    whole = Window.partitionBy("tree")
    # At most one row per slice and one per tree.
    offsets = (
        ranked.groupBy("tree", "part")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            "tree",
            "part",
            (F.sum("_n").over(whole.orderBy("part")) - F.col("_n")).alias("_before"),
            F.sum("_n").over(whole).alias("n"),
        )
    )
    return (
        ranked.join(offsets, ["tree", "part"])
        .withColumn("pos", F.col("place") + F.col("_before"))
        .drop("part", "place", "_before")
    )


def _hash(*nodes: str) -> str:
    return sha256("".join(nodes).encode()).hexdigest()


def depth(n: int) -> int:
    """Levels above the leaves of a tree of ``n`` leaves."""
    return max(0, n - 1).bit_length()


def _levels(nodes: list[str], n: int, block: int) -> list[list[str]]:
    """The levels of one superblock, its nodes first, its top last.

    ``n`` is the number of nodes of the tree at this tier: where it is more
    than a block the reduction goes to the block's own height even if the last
    block is short.
    """
    height = depth(block) if n > block else depth(n)
    levels = [nodes]
    for _ in range(height):
        below = levels[-1]
        levels.append([_hash(*below[i : i + 2]) for i in range(0, len(below), 2)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> list[str]:
    """Steps from node ``i`` of the lowest level to the top of the block."""
    steps = []
    for level in levels[:-1]:
        other = i ^ 1
        if other >= len(level):
            steps.append(ALONE)
        else:
            steps.append((LEFT if other < i else RIGHT) + level[other])
        i >>= 1
    return steps


def fold(node: str, steps: list[str]) -> str:
    """The root that ``node`` leads to over ``steps``."""
    for step in steps:
        side, other = step[0], step[1:]
        node = _hash(other, node) if side == LEFT else _hash(node, other)
    return node


def _blocked(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / block).cast("long"))


def _reduced(nodes: DataFrame, block: int) -> DataFrame:
    """One node per superblock: the next tier (tree, pos, n, node)."""

    def top(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        n = int(rows["n"].iloc[0])
        node = _levels(rows["node"].tolist(), n, block)[-1][0]
        up = (rows["tree"].iloc[0], int(rows["block"].iloc[0]), -(-n // block), node)
        return pd.DataFrame([up], columns=["tree", "pos", "n", "node"])

    return (
        _blocked(nodes.select("tree", "pos", "n", "node"), block)
        .groupBy("tree", "block")
        .applyInPandas(top, "tree string, pos long, n long, node string")
    )


def _tiers(nodes: DataFrame, block: int) -> list[DataFrame]:
    """``nodes``, then tier on tier up to one node per tree."""
    tiers = [nodes]
    # One number: the leaves of the largest tree.
    most = nodes.agg(F.max("n")).first()[0] or 0
    while most > 1:
        tiers.append(written(_reduced(tiers[-1], block), "tier"))
        most = -(-most // block)
    return tiers


def _whole_path(rows: pd.DataFrame, above: pd.DataFrame, block: int):
    """Per node of a superblock, in order: its steps up to the root."""
    outer = list(above["steps"].iloc[0])
    levels = _levels(rows["node"].tolist(), int(rows["n"].iloc[0]), block)
    return [_siblings(levels, i) + outer for i in range(len(rows))]


def _passed_down(tier: DataFrame, outer: DataFrame, block: int) -> DataFrame:
    """The steps above each node of ``tier``, which tops a block one tier down."""

    def join(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        return pd.DataFrame(
            {
                "tree": rows["tree"],
                "block": rows["pos"],
                "steps": _whole_path(rows, above, block),
                "subroot": above["subroot"].iloc[0],
                "root": above["root"].iloc[0],
            }
        )

    keys = ("tree", "block")
    return (
        _blocked(tier, block)
        .groupBy(*keys)
        .cogroup(outer.groupBy(*keys))
        .applyInPandas(join, "tree string, block long, steps array<string>, subroot string, root string")
    )


def _root_paths(subroots: DataFrame, block: int) -> DataFrame:
    """Per language tree, as ``outer`` of its only top block: steps and roots."""
    named = subroots.select(
        F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("node")
    )
    nodes = written(placed(named, "name"), "subroots")
    tiers = _tiers(nodes, block)
    outer = tiers[-1].select(
        "tree",
        F.lit(0).cast("long").alias("block"),
        F.array().cast("array<string>").alias("steps"),
        F.lit("").alias("subroot"),
        F.col("node").alias("root"),
    )
    for tier in reversed(tiers[:-1]):
        outer = written(_passed_down(tier, outer, block), "outer")
    # A single subroot is the root itself and was passed nothing.
    return (
        nodes.select("name", "node", F.col("pos").alias("block"))
        .join(outer.select("block", "steps", "root"), "block")
        .select(
            F.col("name").alias("tree"),
            F.lit(0).cast("long").alias("block"),
            "steps",
            F.col("node").alias("subroot"),
            "root",
        )
    )


RESULT = (
    "doc_id string, leaf string, subroot string, root string, proof_sha256 string, "
    "folded_root string, verified boolean"
)


def manifest(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Every row's leaf, subroot, root, proof and check of the (bent) leaf."""
    if block & (block - 1) or block < 2:
        raise ValueError("a block must be a power of two, at least 2")
    # Written: the sampling of range bounds and the placing both read the leaves.
    rows = written(leaves(docs), "leaves")
    nodes = written(
        placed(rows, "doc_id", "node", "row").select(
            "tree",
            # As text: pandas would turn longs beside nulls into doubles.
            F.col("doc_id").cast("string").alias("doc_id"),
            "node",
            F.coalesce("bent", "node").alias("checked"),
            "pos",
            "n",
        ),
        "placed",
    )
    tiers = _tiers(nodes, block)
    outer = written(_root_paths(tiers[-1].select("tree", "node"), block), "roots")
    for tier in reversed(tiers[1:-1]):
        outer = written(_passed_down(tier, outer, block), "outer")

    def finish(rows: pd.DataFrame, above: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("pos", ignore_index=True)
        root = above["root"].iloc[0]
        proofs, folded = [], []
        paths = _whole_path(rows, above, block)
        for checked, steps in zip(rows["checked"], paths, strict=True):
            proofs.append(_hash(*[s[1:] for s in steps]))
            folded.append(fold(checked, steps))
        out = pd.DataFrame(
            {
                "doc_id": rows["doc_id"],
                "leaf": rows["node"],
                "subroot": above["subroot"].iloc[0],
                "root": root,
                "proof_sha256": proofs,
                "folded_root": folded,
            }
        )
        out["verified"] = out["folded_root"] == root
        return out

    keys = ("tree", "block")
    return (
        _blocked(nodes, block)
        .groupBy(*keys)
        .cogroup(outer.groupBy(*keys))
        .applyInPandas(finish, RESULT)
        .withColumn("doc_id", F.col("doc_id").cast("long"))
    )
