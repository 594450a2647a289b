"""Exact cosine top-k of query vectors in a tenant's memory.

The comparison is brute force by definition, so the plan is a blocked matrix
product, and vectors are never shuffled:

* A task scans its part of the memory once and carries, for each query, the
  best ``k`` hits so far across all its Arrow batches.  Queries times ``k`` rows
  leave a task, however many batches it reads.
* A batch is bounded by its centroid and radius: a query whose best ``k`` are all
  nearer than any row of the batch can be skips it.
* Queries travel with the tasks in blocks whose rows and bytes are counted
  first.  Blocks follow the firms, and a block reads its firms' memory only.
* ``clustered`` stores a memory so that near vectors lie together, with one
  (centroid, radius, rows) line per cell.  Given those lines, a search first
  settles which cells can hold a hit, and only those files are read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matterlake import schemas as S
from matterlake.functions import scoring as D
from matterlake.plans.skew import top_per_group
from matterlake.plans.storage import scratch_path, written

# A block of queries is bounded by rows and by the bytes of its vectors.
BLOCK_QUERIES = 2048
BLOCK_BYTES = 64 << 20
PUSHED_FIRMS = 500
# Rows of a firm compared at once, which bounds the distance table.
BATCH_ROWS = 4096

# Queries times rows of a firm whose distances are held at once.
TABLE_CELLS = 1 << 20

# Distances are rounded to this many digits, so that copies of a vector tie
# whatever block they fall in.
DIGITS = 12
# What rounding and the bounds' own arithmetic may be off by.
SLACK = 1e-9
# More than rounding to ``DIGITS`` moves a distance.
ROUNDED = 1e-11

_HIT = "request_id string, firm_id string, id string, distance double"


def _unit_rows(vectors: list) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled to length 1 in double, and which rows are not zero."""
    m = np.asarray([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.sqrt((m * m).sum(axis=1))
    usable = norms > 0
    m[usable] /= norms[usable, None]
    return m, usable


class _Best:
    """The best ``k`` hits so far of each of some queries of one firm."""

    def __init__(self, asked: pd.DataFrame, k: int):
        self.k = k
        self.requests = asked["request_id"].tolist()
        n = len(self.requests)
        vectors = list(asked["query"])
        size = np.array([len(v) for v in vectors], dtype=int)
        self.units, self.usable = np.zeros((n, size.max(initial=0))), np.zeros(n, bool)
        for width in np.unique(size):
            own = np.flatnonzero(size == width)
            self.units[own, :width], self.usable[own] = _unit_rows([vectors[i] for i in own])
        self.size = size
        # Queries of one width and one wanted matter (or none) meet the same rows.
        wanted = [w if isinstance(w, str) else None for w in asked["wanted"]]
        self.parts: dict[str | None, list[np.ndarray]] = {}
        together: dict[tuple, list[int]] = {}
        for i, key in enumerate(zip(wanted, size.tolist())):
            together.setdefault(key, []).append(i)
        for (matter, _), own in together.items():
            self.parts.setdefault(matter, []).append(np.array(own))
        self.held_d = np.full((n, k), np.inf)
        self.held_ids = np.full((n, k), None, dtype=object)
        self.count = np.zeros(n, int)
        # The distance a row must not exceed to matter; infinite until k are held.
        self.bar = np.full(n, np.inf)
        self.skipped = 0

    def _unreachable(self, rows: np.ndarray, usable: np.ndarray) -> np.ndarray:
        """Queries that no row of the batch can serve: all are too far.

        On the unit sphere the angle of query and row is at least that of query
        and centroid less the radius.  Only for vectors of one length, none zero.
        """
        none = np.zeros(len(self.requests), bool)
        centre = rows.mean(axis=0)
        size = np.sqrt(centre @ centre)
        if not usable.all() or size < SLACK:
            return none
        centre /= size
        radius = np.arccos(np.clip(rows @ centre, -1, 1)).max()
        some = np.flatnonzero(
            (self.size == len(centre)) & (self.count == self.k) & self.usable
        )
        angle = np.arccos(np.clip(self.units[some, : len(centre)] @ centre, -1, 1))
        least = 1 - np.cos(np.maximum(0, angle - radius))
        none[some] = least - SLACK > self.bar[some]
        return none

    def offer(self, memory: pd.DataFrame) -> None:
        vectors = list(memory["embedding"])
        ids = memory["id"].to_numpy(dtype=object)
        sizes = np.array([len(v) for v in vectors])
        by_size = {}
        for width in np.unique(sizes):
            at = np.flatnonzero(sizes == width)
            unit, usable = _unit_rows([vectors[i] for i in at])
            by_size[int(width)] = at, unit, usable
        open_ = np.ones(len(self.requests), bool)
        if len(by_size) == 1:
            ((_, unit, usable),) = by_size.values()
            open_ = ~self._unreachable(unit, usable)
        self.skipped += len(self.requests) - int(open_.sum())
        every = np.arange(len(ids))
        for own in self.parts.get(None, ()):
            self._compare(own[open_[own]], every, ids, by_size)
        # A query in a matter meets that matter's rows only.
        for matter, rows in memory.reset_index(drop=True).groupby("matter_id").groups.items():
            for own in self.parts.get(matter, ()):
                self._compare(own[open_[own]], rows.to_numpy(), ids, by_size)

    def _compare(self, own: np.ndarray, rows: np.ndarray, ids: np.ndarray, by_size: dict) -> None:
        """Queries of one width with some rows, so many at a time."""
        if not len(own):
            return
        width = int(self.size[own[0]])
        none = np.empty(0, int), np.empty((0, width)), np.empty(0, bool)
        at, unit, usable = by_size.get(width, none)
        # Rows of another width, and zero vectors, have no distance.
        place = np.full(len(ids), -1)
        place[at[usable]] = np.flatnonzero(usable)
        near_rows = np.flatnonzero(place[rows] >= 0)
        against = unit[place[rows[near_rows]]].T
        step = max(1, TABLE_CELLS // len(rows))
        for lo in range(0, len(own), step):
            some = own[lo : lo + step]
            table = np.full((len(some), len(rows)), np.inf)
            ok = np.flatnonzero(self.usable[some])
            table[np.ix_(ok, near_rows)] = 1.0 - self.units[some[ok], :width] @ against
            self._take(some, table, ids[rows])

    def _take(self, some: np.ndarray, table: np.ndarray, ids: np.ndarray) -> None:
        """Merge the rows of a table that may be among the best into the best."""
        k = self.k
        near = table <= (self.bar[some] + ROUNDED)[:, None]
        many = np.flatnonzero(near.sum(axis=1) > k)
        if len(many):
            edge = np.partition(table[many], k - 1, axis=1)[:, k - 1]
            near[many] &= table[many] <= (edge + ROUNDED)[:, None]
        row, column = np.nonzero(near)
        if not len(row):
            return
        touched = np.unique(row)
        have, slot = np.nonzero(np.arange(k)[None] < self.count[some[touched]][:, None])
        have = touched[have]
        row = np.concatenate((have, row))
        d = np.concatenate(
            (self.held_d[some[have], slot], np.round(table[near], DIGITS))
        )
        names = np.concatenate((self.held_ids[some[have], slot], ids[column]))
        order = np.lexsort((names, d, row))
        row, d, names = row[order], d[order], names[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        kept = rank < k
        query, rank = some[row[kept]], rank[kept]
        self.held_d[query, rank], self.held_ids[query, rank] = d[kept], names[kept]
        np.maximum.at(self.count, query, rank + 1)
        full = some[self.count[some] == k]
        self.bar[full] = self.held_d[full, k - 1]

    def hits(self, firm: str) -> pd.DataFrame:
        held = np.arange(self.k)[None] < self.count[:, None]
        return pd.DataFrame(
            {
                "request_id": np.repeat(np.array(self.requests, dtype=object), self.count),
                "firm_id": firm,
                "id": self.held_ids[held],
                "distance": self.held_d[held],
            }
        )


def _scanned(queries: list, memory: DataFrame, k: int) -> DataFrame:
    """One scan of the memory, with a block of queries at hand."""
    firms = sorted({r["firm_id"] for r in queries if r["firm_id"] is not None})
    if len(firms) <= PUSHED_FIRMS:
        # Reaches the scan: other firms' files and row groups are skipped.
        memory = memory.where(F.col("firm_id").isin(firms))
    held = memory.sparkSession.sparkContext.broadcast(
        [
            (r["request_id"], r["firm_id"], np.asarray(r["query"], float), r["wanted"])
            for r in queries
        ]
    )

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = pd.DataFrame(
            held.value, columns=["request_id", "firm_id", "query", "wanted"]
        )
        per_firm = dict(tuple(asked.groupby("firm_id")))
        best: dict[str, _Best] = {}
        for batch in batches:
            for firm, rows in batch.groupby("firm_id"):
                if firm not in per_firm:
                    continue
                if firm not in best:
                    best[firm] = _Best(per_firm[firm], k)
                for at in range(0, len(rows), BATCH_ROWS):
                    best[firm].offer(rows.iloc[at : at + BATCH_ROWS])
        for firm, found in best.items():
            yield found.hits(firm)

    return memory.mapInPandas(score, _HIT)


def _query_blocks(asked: DataFrame, most: int, most_bytes: int) -> Iterator[list]:
    """The queries, at most about ``most`` at a time, firm by firm."""
    n, width = asked.agg(F.count(F.lit(1)), F.max(F.size("query"))).first()
    rows = max(1, min(most, most_bytes // (8 * max(1, width or 1))))
    if n <= rows:
        yield asked.collect()
        return
    # Written: range bounds are sampled, a second run could cut elsewhere.
    cut = written(
        asked.repartitionByRange(-(-n // rows), "firm_id", "request_id").withColumn(
            "_block", F.spark_partition_id()
        ),
        "query-blocks",
    )
    for (block,) in sorted(cut.select("_block").distinct().collect()):
        yield cut.where(F.col("_block") == block).drop("_block").collect()


@dataclass(frozen=True)
class Clustered:
    """A memory whose near vectors lie together: its rows, and a line per cell."""

    memory: DataFrame
    cells: DataFrame


CELLS = 64
SAMPLED = 4096
# Cells that a search leaves out by name; beyond it by a join.
NAMED_CELLS = 20_000


def clustered(
    memory: DataFrame, path: str | None = None, cells: int = CELLS, sampled: int = SAMPLED
) -> Clustered:
    """Store ``memory`` by (firm, cell); a cell is a row's nearest guide vector.

    The ``cells`` guides are spread over at most ``sampled`` rows (by a hash of
    their ids), which only decides how tight the cells are: every row is stored
    and every bound is taken from all rows of its cell.  Rows without a usable
    vector have a cell of their own, which every search reads.
    """
    spark = memory.sparkSession
    path = path or scratch_path(spark, "clustered")
    rows = (
        memory.where(F.col("embedding").isNotNull())
        .select("embedding")
        .orderBy(F.xxhash64("id"))
        .limit(sampled)
        .collect()
    )
    by_size: dict[int, list] = {}
    for r in rows:
        by_size.setdefault(len(r["embedding"]), []).append(r["embedding"])
    guides = {}
    for n, vectors in by_size.items():
        unit, usable = _unit_rows(vectors)
        if usable.any():
            guides[n] = _spread_out(unit[usable], cells)
    held = spark.sparkContext.broadcast(guides)

    def nearest(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for vectors in batches:
            out = np.full(len(vectors), -1)
            sizes = np.array([-1 if v is None else len(v) for v in vectors])
            for n, guide in held.value.items():
                at = np.flatnonzero(sizes == n)
                if len(at):
                    unit, usable = _unit_rows([vectors.iloc[i] for i in at])
                    out[at] = np.where(usable, (unit @ guide.T).argmax(axis=1), -1)
            yield pd.Series(out)

    cell_of = F.pandas_udf(nearest, "int")
    stored = memory.withColumn("cell", cell_of("embedding"))
    # A hot firm or cell is cut over several tasks and files.
    stored.hint("rebalance", "firm_id", "cell").sortWithinPartitions("firm_id", "cell").write.partitionBy(
        "firm_id", "cell"
    ).parquet(path)
    schema = T.StructType(
        [
            *[f for f in stored.schema if f.name not in ("firm_id", "cell")],
            stored.schema["firm_id"],
            stored.schema["cell"],
        ]
    )
    kept = spark.read.schema(schema).parquet(path)
    return Clustered(kept, written(_cell_lines(kept), "cells"))


def _spread_out(unit: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` rows, each the farthest from those before it."""
    chosen = [0]
    near = unit @ unit[0]
    while len(chosen) < min(n, len(unit)) and near.min() < 1 - SLACK:
        chosen.append(int(near.argmin()))
        near = np.maximum(near, unit @ unit[chosen[-1]])
    return unit[chosen]


def _dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def _unit(v: Column) -> Column:
    norm = F.sqrt(_dot(v, v))
    return F.transform(v, lambda x: F.try_divide(x.cast("double"), norm))


def _cell_lines(memory: DataFrame) -> DataFrame:
    """(firm_id, cell, width, centre, radius, n) of each cell with usable rows."""
    own = ["firm_id", "cell", "width"]
    unit = memory.where(F.col("cell") >= 0).select(
        "firm_id", "cell", F.size("embedding").alias("width"), _unit(F.col("embedding")).alias("u")
    )
    sums = (
        unit.select(*own, F.posexplode("u").alias("i", "x"))
        .groupBy(*own, "i")
        .agg(F.sum("x").alias("x"))
        .groupBy(*own)
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("centre"))
    )
    centres = sums.where(_dot(F.col("centre"), F.col("centre")) > SLACK).select(
        *own, _unit(F.col("centre")).alias("centre")
    )
    return (
        unit.join(centres, own)
        .withColumn("_angle", _angle(F.col("u"), F.col("centre")))
        .groupBy(*own)
        .agg(
            F.first("centre").alias("centre"),
            F.max("_angle").alias("radius"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def _angle(u: Column, v: Column) -> Column:
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), _dot(u, v))))


def needed_cells(queries: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """(firm_id, cell) of the cells that may hold one of a query's ``k`` best.

    From the cells' largest possible distances, nearest first, follows a distance
    within which ``k`` rows surely lie; a cell whose smallest possible distance
    is beyond it holds no hit.  Queries restricted to a matter, and zero vectors,
    need all cells of their firm.
    """
    query = F.col("query")
    asked = queries.select(
        "request_id",
        "firm_id",
        (F.col("wanted").isNotNull() | (_dot(query, query) <= 0)).alias("all"),
        F.size(query).alias("width"),
        _unit(query).alias("q"),
    )
    per_cell = asked.join(cells, ["firm_id", "width"]).withColumn(
        "_angle", _angle(F.col("q"), F.col("centre"))
    )
    far = 1 - F.cos(F.least(F.lit(np.pi), F.col("_angle") + F.col("radius")))
    near = 1 - F.cos(F.greatest(F.lit(0.0), F.col("_angle") - F.col("radius")))
    nearest_first = Window.partitionBy("request_id", "firm_id").orderBy("far", "cell")
    bounded = per_cell.select(
        "request_id", "firm_id", "cell", "all", "n", far.alias("far"), near.alias("near")
    ).withColumn("_sum", F.sum("n").over(nearest_first))
    enough = F.min(F.when(F.col("_sum") >= k, F.col("far"))).over(
        Window.partitionBy("request_id", "firm_id")
    )
    reached = F.coalesce(F.col("near") <= F.col("_enough") + SLACK, F.lit(True))
    return (
        bounded.withColumn("_enough", enough)
        .where(reached | F.col("all"))
        .select("firm_id", "cell")
        .distinct()
    )


def _reachable(asked: DataFrame, memory: DataFrame, cells: DataFrame, k: int) -> DataFrame:
    """``memory`` without the cells that hold no hit of any query.

    Cells without a line (no usable vector, or a centre at zero) stay.
    """
    lines = cells.select("firm_id", "cell").distinct().withColumn("_lined", F.lit(True))
    needed = needed_cells(asked, cells, k).withColumn("_needed", F.lit(True))
    out = (
        lines.join(needed, ["firm_id", "cell"], "left")
        .where(F.col("_needed").isNull())
        .select("firm_id", "cell")
    )
    gone = written(out, "cells-out")
    if gone.count() > NAMED_CELLS:
        return memory.join(gone, ["firm_id", "cell"], "left_anti")
    # Reaches the listing of folders: a cell's files are not opened.
    named = F.concat_ws("\x1f", "cell", "firm_id")
    names = [r[0] for r in gone.select(named).collect()]
    return memory.where(~named.isin(names)) if names else memory


def vector_topk(
    queries: DataFrame,
    memory: DataFrame,
    k: int = S.SEARCH_DEFAULT_K,
    status: str | None = None,
    block_queries: int = BLOCK_QUERIES,
    block_bytes: int = BLOCK_BYTES,
    cells: DataFrame | None = None,
) -> DataFrame:
    """(request_id, rank, memory columns, distance, similarity), k per request.

    Queries: (request_id, firm_id, embedding, matter_id or null).  Rows without
    a vector are out.  Ties go to the smaller id, missing distances last.  With
    ``cells`` (of ``clustered``, whose memory is then given) cells that cannot
    hold a hit are not read.
    """
    if k < 1:
        raise ValueError("k must be at least 1")
    asked = queries.where(F.col("embedding").isNotNull()).select(
        F.col("request_id").cast("string").alias("request_id"),
        "firm_id",
        F.col("embedding").alias("query"),
        F.col("matter_id").alias("wanted"),
    )
    stored = memory.where(F.col("embedding").isNotNull())
    if cells is not None:
        if status is not None:
            raise ValueError("cells count rows of any status")
        stored = _reachable(asked, stored, cells, k)
    if status is not None:
        stored = stored.where(F.col("status") == status)
    slim = stored.select("id", "firm_id", "matter_id", "embedding")
    hits: DataFrame | None = None
    for block in _query_blocks(asked, block_queries, block_bytes):
        # Written block by block, so only one block is held at a time.
        found = written(_scanned(block, slim, k), "hits")
        hits = found if hits is None else hits.unionByName(found)
    distance = F.when(F.col("distance") < float("inf"), F.col("distance"))
    best = top_per_group(
        hits.withColumn("distance", distance),
        ["firm_id", "request_id"],
        [F.col("distance").asc_nulls_last(), F.col("id").asc()],
        k,
    )
    shown = [
        c
        for c in (
            "id",
            "firm_id",
            "matter_id",
            "content",
            "memory_type",
            "source_document_id",
            "embedding_model",
            "created_at",
        )
        if c in memory.columns
    ]
    return (
        memory.select(*shown)
        .join(best, ["firm_id", "id"])
        .select(
            "request_id",
            "rank",
            *shown,
            "distance",
            D.similarity(F.col("distance")).alias("similarity"),
        )
    )


def match_matter_memory(
    memory: DataFrame,
    firm_id: str,
    query: list[float],
    k: int = S.SEARCH_DEFAULT_K,
    matter_id: str | None = None,
) -> DataFrame:
    """The single-query form: eight columns, nearest first.

    One tenant, one constant vector: a filter, one distance column and an
    ``orderBy().limit()``, which Spark runs as a per-task top-k.
    """
    rows = memory.where((F.col("firm_id") == firm_id) & F.col("embedding").isNotNull())
    if matter_id is not None:
        rows = rows.where(F.col("matter_id") == matter_id)
    constant = F.lit([float(x) for x in query]).cast(T.ArrayType(T.DoubleType()))
    return (
        rows.select(
            "id",
            "matter_id",
            "content",
            "memory_type",
            "source_document_id",
            "embedding_model",
            "created_at",
            D.cosine_distance(F.col("embedding"), constant).alias("distance"),
        )
        .orderBy(F.col("distance").asc_nulls_last(), F.col("id").asc())
        .limit(k)
    )


# The table function in SQL: a parameter that is null does not filter.  The rank
# filter stands on the window, so a task keeps k rows before the shuffle.
_MATCH_FUNCTION = """
CREATE OR REPLACE TEMPORARY FUNCTION {name}(
  of_firm STRING, asked ARRAY<DOUBLE>, k INT DEFAULT {k}, of_matter STRING DEFAULT NULL)
RETURNS TABLE(id STRING, matter_id STRING, content STRING, memory_type STRING,
  source_document_id STRING, embedding_model STRING, created_at TIMESTAMP_NTZ,
  distance DOUBLE)
RETURN
  SELECT id, matter_id, content, memory_type, source_document_id, embedding_model,
         created_at, distance
  FROM (SELECT *, row_number() OVER (
                    PARTITION BY firm_id ORDER BY distance ASC NULLS LAST, id) AS place
        FROM (SELECT *, {distance} AS distance FROM {view}
              WHERE firm_id = of_firm AND embedding IS NOT NULL
                AND (of_matter IS NULL OR matter_id = of_matter)))
  WHERE place <= k
"""
_DOT = (
    "aggregate(zip_with({u}, {v}, (x, y) -> CAST(x AS DOUBLE) * CAST(y AS DOUBLE)), "
    "0D, (total, x) -> total + x)"
)


def register_match_function(
    memory: DataFrame,
    name: str = "match_matter_memory",
    view: str = "matter_memory",
    k: int = S.SEARCH_DEFAULT_K,
) -> None:
    """Make the search a table function of the session's SQL.

    ``SELECT * FROM match_matter_memory('firm', array(..), 8, 'matter')`` gives
    the eight columns of the single-query form, in any order; the last two
    arguments may be left out.  ``memory`` becomes the temporary view ``view``;
    columns it lacks are null.
    """
    spark = memory.sparkSession
    kinds = {"source_document_id": "string", "embedding_model": "string", "created_at": "timestamp_ntz"}
    missing = {c: F.lit(None).cast(t) for c, t in kinds.items() if c not in memory.columns}
    memory.withColumns(missing).createOrReplaceTempView(view)
    norms = " * ".join(f"sqrt({_DOT.format(u=c, v=c)})" for c in ("embedding", "asked"))
    both = _DOT.format(u="embedding", v="asked")
    distance = f"CASE WHEN size(embedding) = size(asked) THEN 1D - try_divide({both}, {norms}) END"
    spark.sql(_MATCH_FUNCTION.format(name=name, view=view, k=k, distance=distance))
