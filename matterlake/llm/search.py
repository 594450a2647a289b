"""Exact BM25 top-k: an inverted index in shards, block-max pruning per shard.

Terms are runs of letters, digits and characters outside ASCII in the lower-case
text.  ``build_index`` writes one row per shard of at most ``SHARD_BYTES`` of
text: terms, postings (document, frequency) and document lengths.  Numbers of
documents, lengths and document frequencies are those of all shards, so every
shard scores alike and the best ``k`` of all shards are exact.

A shard is searched in the manner of block-max WAND, a block of documents at a
time instead of a cursor at a time:

* the terms whose largest possible contributions together stay below a part of
  the score of the k-th best so far cannot make a hit alone (the pivot rule), so
  only documents of the other terms are candidates;
* a candidate needs what it has from those terms, plus the block maxima of the
  rest in its block, to reach that score;
* what is left is scored exactly, best bounds first, so the bar rises early.

A query is the set of its distinct terms, of any number.  Equal scores (to ``DIGITS`` digits) are ordered by id.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.llm.blocks import TERMS, Texts, Words, cut, distinct, map_batches, small_batches
from matterlake.plans.skew import top_per_group
from matterlake.plans.storage import written

K1, B = 1.2, 0.75
SHARD_BYTES = 16 << 20
SHARD_DOCUMENTS = 8192
BLOCK = 64
DIGITS = 6
# More than rounding and the order of sums can change a score by.
SLACK = 1e-5
# Queries travel to the shards in blocks of about this many distinct terms.
BLOCK_TERMS = 1_500_000
# One shard in this many is visited first, to know a bar for each query.
FIRST = 8
# Terms are left out of the first sum while their bounds stay below this part of
# the bar: the rest of it is what the bounds of candidates may be too high by.
PIVOT = 0.2

_INDEX = (
    "n_docs long, n_words long, ids binary, lengths binary, terms binary, "
    "bounds binary, posted binary, times binary"
)


def bag(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(term, row, times), by row and term, of lower-case texts."""
    words = Words(texts, TERMS)
    return distinct(words.hashes(), words.row)


def _shard_row(ids: np.ndarray, rows: list) -> dict:
    """The index of consecutive documents; ``rows`` are bags with local rows."""
    term = np.concatenate([r[0] for r in rows])
    row = np.concatenate([r[1] for r in rows]).astype(np.int32)
    times = np.concatenate([r[2] for r in rows]).astype(np.int32)
    lengths = np.bincount(row, weights=times, minlength=len(ids)).astype(np.int32)
    # Rows ascend already, so a stable sort by term keeps postings in order.
    order = np.argsort(term, kind="stable")
    term, row, times = term[order], row[order], times[order]
    new = np.ones(len(term), bool)
    new[1:] = term[1:] != term[:-1]
    at = np.flatnonzero(new)
    return {
        "n_docs": len(ids),
        "n_words": int(lengths.sum()),
        "ids": ids.tobytes(),
        "lengths": lengths.tobytes(),
        "terms": term[at].tobytes(),
        "bounds": np.append(at, len(term)).astype(np.int32).tobytes(),
        "posted": row.astype(np.uint16).tobytes(),
        # Two bytes each, four in a shard with a longer count.
        "times": times.astype(np.uint16 if times.max(initial=0) < 1 << 16 else np.uint32).tobytes(),
    }


_ARROW = pa.schema(
    [("n_docs", pa.int64()), ("n_words", pa.int64())]
    + [(c, pa.binary()) for c in ("ids", "lengths", "terms", "bounds", "posted", "times")]
)


def build_index(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per shard, written to the shared folder.

    Every row of ``docs`` is a document, repeated ids too; rows with a null id
    are left out (they could not be named); null texts have no terms.
    """
    small_batches(docs.sparkSession)
    slim = docs.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("id"),
        F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, size, n = [], [], 0, 0

        def flush():
            return pa.RecordBatch.from_pylist(
                [_shard_row(np.concatenate(ids), rows)], schema=_ARROW
            )

        for batch in batches:
            column = batch.column(1)
            for a, b in cut(column):
                for lo in range(a, b, SHARD_DOCUMENTS):
                    part = column[lo : min(b, lo + SHARD_DOCUMENTS)]
                    texts = Texts(part)
                    if n and (n + texts.n > SHARD_DOCUMENTS or size + len(texts.bytes) > SHARD_BYTES):
                        yield flush()
                        ids, rows, size, n = [], [], 0, 0
                    t, r, c = bag(texts)
                    rows.append((t, r + n, c))
                    ids.append(batch.column(0)[lo : lo + texts.n].to_numpy(zero_copy_only=False).astype(np.int64))
                    n += texts.n
                    size += len(texts.bytes)
        if n:
            yield flush()

    return written(slim.mapInArrow(run, _INDEX), "index")


class Shard:
    """One shard, its weights under global statistics, and its pruning tables."""

    def __init__(self, row: dict, mean_length: float, number: int = 0):
        self.number = number

        def read(name, kind):
            return np.frombuffer(row[name], kind)

        self.ids = read("ids", np.int64)
        self.terms = read("terms", np.uint64)
        self.bounds = read("bounds", np.int32).astype(np.int64)
        self.posted = read("posted", np.uint16).astype(np.int32)
        wide = len(row["times"]) > len(row["posted"])
        times = read("times", np.uint32 if wide else np.uint16).astype(np.float64)
        norm = K1 * (1 - B + B * read("lengths", np.int32) / max(mean_length, 1e-9))
        # The part of a term's score that does not depend on the query.
        self.gain = times * (K1 + 1) / (times + norm[self.posted])
        n = len(self.posted)
        size = np.diff(self.bounds)
        self.term_max = np.maximum.reduceat(self.gain, self.bounds[:-1]) if n else np.empty(0)
        # Block maxima: one entry per (term, block with postings).
        owner = np.repeat(np.arange(len(self.terms)), size)
        block = self.posted // BLOCK
        new = np.ones(n, bool)
        new[1:] = (owner[1:] != owner[:-1]) | (block[1:] != block[:-1])
        at = np.flatnonzero(new)
        self.block_of = block[at]
        self.block_max = np.maximum.reduceat(self.gain, at) if n else np.empty(0)
        self.block_bounds = np.append(np.searchsorted(at, self.bounds[:-1]), len(at))
        # The same postings by document, terms ascending, to score one whole.
        order = np.argsort(self.posted, kind="stable")
        self.forward_term = owner[order].astype(np.int32)
        self.forward_gain = self.gain[order]
        self.forward_bounds = np.searchsorted(self.posted[order], np.arange(len(self.ids) + 1))
        self._weight = np.zeros(len(self.terms))

    def _exact(self, docs: np.ndarray) -> np.ndarray:
        a, b = self.forward_bounds[docs], self.forward_bounds[docs + 1]
        at = _ranges(a, b - a)
        part = self._weight[self.forward_term[at]] * self.forward_gain[at]
        ends = np.cumsum(b - a)
        out = np.zeros(len(docs))
        some = b > a
        out[some] = np.add.reduceat(np.append(part, 0.0), (ends - (b - a))[some])
        # The appended zero only closes the last sum.
        return np.round(out, DIGITS)

    def search(self, terms: np.ndarray, weight: np.ndarray, k: int, best: list) -> list:
        """``best`` with the hits of this shard in it.

        A hit is (-score, id, shard, place), so ascending order is best first.
        """
        if not len(self.terms):
            return best
        at = np.searchsorted(self.terms, terms)
        at[at == len(self.terms)] = 0
        here = self.terms[at] == terms
        at, weight = at[here], weight[here]
        if not len(at):
            return best
        self._weight[at] = weight
        bound = weight * self.term_max[at]
        order = np.argsort(bound)
        at, weight, bound = at[order], weight[order], bound[order]
        reach = np.cumsum(bound)
        size = self.bounds[at + 1] - self.bounds[at]
        if len(best) < k:
            # A first bar: the most promising documents by their rarest terms.
            few = np.argsort(size, kind="stable")
            few = few[: max(1, int(np.searchsorted(np.cumsum(size[few]), 4 * len(self.ids))))]
            best = self._take(self._partial(at[few], weight[few]), None, k, best, limit=4 * k)
        bar = self._bar(best, k)
        rest = int(np.searchsorted(reach, PIVOT * bar - SLACK)) if bar > 0 else 0
        score = self._partial(at[rest:], weight[rest:])
        best = self._take(score, self._block_bound(at[:rest], weight[:rest]), k, best)
        self._weight[at] = 0.0
        return best

    @staticmethod
    def _bar(best: list, k: int) -> float:
        return -best[k - 1][0] if len(best) >= k else 0.0

    def _partial(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        size = self.bounds[at + 1] - self.bounds[at]
        where = _ranges(self.bounds[at], size)
        return np.bincount(
            self.posted[where],
            weights=np.repeat(weight, size) * self.gain[where],
            minlength=len(self.ids),
        )

    def _block_bound(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        size = self.block_bounds[at + 1] - self.block_bounds[at]
        where = _ranges(self.block_bounds[at], size)
        return np.bincount(
            self.block_of[where],
            weights=np.repeat(weight, size) * self.block_max[where],
            minlength=len(self.ids) // BLOCK + 1,
        )

    def _take(
        self,
        partial: np.ndarray,
        blocks: np.ndarray | None,
        k: int,
        best: list,
        limit: int | None = None,
    ) -> list:
        """Scores candidates in waves, best bounds first, while they can enter."""
        docs = np.flatnonzero(partial > 0)
        upper = partial[docs]
        if blocks is not None:
            upper = upper + blocks[docs // BLOCK]
        keep = upper >= self._bar(best, k) - SLACK
        docs, upper = docs[keep], upper[keep]
        order = np.argsort(-upper, kind="stable")[:limit]
        docs, upper = docs[order], upper[order]
        a, wave = 0, max(2 * k, 32)
        while a < len(docs) and upper[a] >= self._bar(best, k) - SLACK:
            some = docs[a : a + wave]
            found = self._exact(some)
            good = np.flatnonzero(found >= self._bar(best, k))
            new = {
                (-float(found[j]), int(self.ids[some[j]]), self.number, int(some[j]))
                for j in good
            }
            best = sorted([*new.difference(best), *best])[:k]
            a += wave
            wave += wave // 2
        return best


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    total = int(size.sum())
    if not total:
        return np.empty(0, np.int64)
    return np.arange(total) - np.repeat(np.cumsum(size) - size - start, size)


def _query_bags(queries: DataFrame, id_col: str, text: str) -> DataFrame:
    """The distinct bags of each query: rows of one id are parts of one query."""
    slim = queries.where(F.col(id_col).isNotNull()).select(
        F.col(id_col).cast("long").alias("query_id"),
        F.lower(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        n, terms = [], []
        for a, b in cut(column):
            t, row, _ = bag(Texts(column[a:b]))
            ends = np.searchsorted(row, np.arange(b - a + 1))
            for i in range(b - a):
                own = slice(ends[i], ends[i + 1])
                n.append(len(t[own]))
                terms.append(t[own].tobytes())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.binary())],
            names=["query_id", "n_terms", "terms"],
        )

    return written(
        map_batches(slim, run, "query_id long, n_terms long, terms binary").distinct(),
        "queries",
    )


def _document_frequencies(index: DataFrame, asked: np.ndarray) -> np.ndarray:
    """In how many documents each of ``asked`` (ascending) stands."""
    held = index.sparkSession.sparkContext.broadcast(asked)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        total = np.zeros(len(held.value), np.int64)
        for terms, bounds in zip(batch.column(0), batch.column(1)):
            own = np.frombuffer(terms.as_buffer(), np.uint64)
            if not len(own):
                continue
            at = np.searchsorted(own, held.value)
            at[at == len(own)] = 0
            here = own[at] == held.value
            total[here] += np.diff(np.frombuffer(bounds.as_buffer(), np.int32))[at[here]]
        some = np.flatnonzero(total)
        return pa.RecordBatch.from_arrays(
            [pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], names=["term", "n"]
        )

    counts = (
        map_batches(index.select("terms", "bounds"), run, "term long, n long")
        .groupBy("term")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    held.unpersist()
    out = np.zeros(len(asked), np.int64)
    out[counts["term"].to_numpy()] = counts["n"].to_numpy()
    return out


def search(
    index: DataFrame,
    queries: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """(query_id, rank, doc_id, score): the best ``k`` documents of each query.

    Documents with no term of the query are no hits; a query without terms has
    none.  Rows with a null id are no queries; rows of one id are one query, of
    the terms of all.  Queries are taken in blocks of
    about ``block_terms`` terms; each block visits the index once, and a task
    sends at most ``k`` rows per query.
    """
    small_batches(index.sparkSession)
    spark = index.sparkSession
    n_docs, n_words = index.agg(F.sum("n_docs"), F.sum("n_words")).first()
    bags = _query_bags(queries, id_col, text).where("n_terms > 0")
    total = bags.agg(F.sum("n_terms")).first()[0] or 0
    blocks = -(-total // block_terms)
    schema = "query_id long, doc_id long, score double, shard long, place long"
    found = spark.createDataFrame([], schema)
    for block in range(blocks if n_docs else 0):
        own = bags.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == block).toArrow()
        if not own.num_rows:
            continue
        found = found.union(
            _search_block(index, own, k, n_docs, n_words / n_docs, schema)
        )
    best = top_per_group(
        found,
        ["query_id"],
        [F.col("score").desc(), F.col("doc_id"), F.col("shard"), F.col("place")],
        k,
    )
    return best.select("query_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


def _whole_queries(own: pa.Table) -> tuple[np.ndarray, list[np.ndarray]]:
    """The distinct ids, and the terms of all rows of each."""
    rows = own["query_id"].to_numpy()
    parts = [np.frombuffer(t.as_buffer(), np.uint64) for t in own["terms"]]
    order = np.argsort(rows, kind="stable")
    ids, first = np.unique(rows[order], return_index=True)
    terms = []
    for some in np.split(order, first[1:]):
        one = [parts[i] for i in some]
        terms.append(one[0] if len(one) == 1 else np.unique(np.concatenate(one)))
    return ids, terms


def _search_block(index, own: pa.Table, k, n_docs, mean_length, schema) -> DataFrame:
    ids, terms = _whole_queries(own)
    asked = np.unique(np.concatenate(terms))
    df = _document_frequencies(index, asked)
    idf = np.log(1 + (n_docs - df + 0.5) / (df + 0.5))
    place = [np.searchsorted(asked, t) for t in terms]
    weights = [idf[p] for p in place]
    numbered = index.withColumn("shard", F.monotonically_increasing_id())
    first = F.pmod(F.xxhash64("shard"), F.lit(FIRST)) == 0

    def visit(shards: DataFrame, bars: np.ndarray) -> DataFrame:
        context = index.sparkSession.sparkContext
        held = context.broadcast((ids, terms, weights, bars))
        return written(shards.mapInArrow(_visitor(held, k, mean_length), schema), "hits")

    some = visit(numbered.where(first), np.zeros(len(ids)))
    # One number per query of the block: the k-th best score in these shards.
    kth = (
        top_per_group(some, ["query_id"], [F.col("score").desc()], k)
        .where(F.col("rank") == k)
        .select("query_id", "score")
        .toArrow()
    )
    bar_of = dict(zip(kth["query_id"].to_pylist(), kth["score"].to_pylist()))
    bars = np.array([bar_of.get(int(i), 0.0) for i in ids])
    return some.union(visit(numbered.where(~first), bars))


def _visitor(held, k: int, mean_length: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, weights, bars = held.value
        # Until a hit beats it, a known bar stands for the k best elsewhere.
        best = [[(-float(b), 1 << 63, -1, -1)] * k if b > 0 else [] for b in bars]
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                number = row.pop("shard")
                shard = Shard(row, mean_length, number)
                for q in range(len(ids)):
                    best[q] = shard.search(terms[q], weights[q], k, best[q])
        hits = [
            (ids[q], i, -s, n, p)
            for q in range(len(ids))
            for s, i, n, p in best[q]
            if n >= 0
        ]
        if hits:
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*hits), kinds)],
                names=["query_id", "doc_id", "score", "shard", "place"],
            )

    return run
