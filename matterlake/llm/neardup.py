"""Near-duplicate classes by DartMinHash signatures and banded joining.

Every element of a weighted set owns a region: its weight times an endless rank
axis.  Hashed darts fall into the region as a Poisson process along the rank,
each with a weight position (a dart above the element's weight misses) and a
coordinate.  A coordinate keeps its earliest dart.  Darts depend on the element
alone, so two sets keep the same dart at a coordinate with probability equal to
their weighted Jaccard similarity, and a set throws about ``k ln k`` darts
however many elements it has.

Elements are runs of five words (lower case, words parted by ASCII blanks); a
text of one to four words is one element.  Texts are linked at a Jaccard
similarity of 0.8 or more of their elements' sets, checked exactly; classes are
the connected components of the links.

1. One row per distinct set: copies share a key and are never paired.
2. Sets that share a band form a bucket, whose hub is the member with the largest
   buckets over all bands.  Each member is held against the worthiest of its
   hubs, then against those of its hubs to which it is not yet connected.
3. Buckets whose members are not yet connected: pairs across components, each in
   its first common band, first by signature, then exactly.  A bucket of more
   than ``BLOCK`` members is cut into blocks that meet two by two.

A signature also carries the set's size and, for each of ``CELLS`` hash cells, the
parity of the elements there.  Each cell whose parities differ holds an element
of one set only, so their number bounds the difference of two sets from below:
pairs that are too far apart by this bound go without a look at their texts, and
no pair that is similar enough goes.

No step gathers a bucket, a component or the links in one task.
"""

from collections.abc import Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matterlake.llm.blocks import (
    SPACED,
    Texts,
    Words,
    cut,
    distinct,
    map_batches,
    mix,
    shingles,
    small_batches,
)
from matterlake.plans.storage import written

WORDS = 5
LEAST = 0.8
ROWS = 5
BANDS = 24
COORDINATES = ROWS * BANDS
# Five standard deviations below 0.8 of the coordinates: a true pair is dropped
# with a probability below one in a million.
LEAST_AGREEING = int(COORDINATES * LEAST - 5 * (COORDINATES * LEAST * (1 - LEAST)) ** 0.5)
BLOCK = 256
CELLS = 2048
_PARITY_END = COORDINATES + CELLS // 8

_UNIT = 1.0 / float(1 << 53)


def _uniform(h: np.ndarray) -> np.ndarray:
    return ((h >> np.uint64(11)).astype(np.float64) + 0.5) * _UNIT


def dart_signatures(
    elements: np.ndarray,
    row: np.ndarray,
    weight: np.ndarray,
    n: int,
    k: int = COORDINATES,
) -> np.ndarray:
    """n x k hashes of the kept darts (0 in the rows of empty sets).

    ``elements`` are 64-bit hashes, distinct within a row, rows ascending.
    Weights are positive; the region is cut into cells of weight 1.
    """
    out = np.zeros((n, k), np.uint64)
    whole = np.ceil(weight).astype(np.int64)
    cell = np.repeat(np.arange(len(elements)), whole)
    nth = np.arange(len(cell)) - np.repeat(np.cumsum(whole) - whole, whole)
    seed = mix(elements[cell] + mix(nth.astype(np.uint64) * np.uint64(2) + np.uint64(1)))
    left = weight[cell] - nth
    of = row[cell]
    mass = np.bincount(row, weights=weight, minlength=n)
    depth = np.zeros(n)
    todo = np.zeros(n, bool)
    todo[np.unique(row)] = True
    # Deep enough for every coordinate in most sets; the others go deeper.
    depth[todo] = k * (np.log(k) + 3.0) / mass[todo]
    while todo.any():
        on = np.flatnonzero(todo[of])
        best = _earliest(seed[on], of[on], left[on], depth, n, k)
        full = todo & (best != 0).all(axis=1)
        out[full] = best[full]
        todo &= ~full
        depth[todo] *= 2
    return out


def _earliest(seed, of, left, depth, n, k) -> np.ndarray:
    """The earliest dart per (row, coordinate) no deeper than ``depth``."""
    rank = np.zeros(len(seed))
    hashes, ranks, places = [], [], []
    live = np.arange(len(seed))
    i = 0
    while len(live):
        i += 1
        h = mix(seed[live] + np.uint64(i * 0x9E3779B97F4A7C15 % (1 << 64)))
        rank[live] -= np.log(_uniform(h))
        near = rank[live] <= depth[of[live]]
        live, h = live[near], h[near]
        g = mix(h + np.uint64(0xD1B54A32D192ED03))
        hit = _uniform(mix(g)) < left[live]
        hashes.append((g | np.uint64(1))[hit])
        ranks.append(rank[live][hit])
        places.append((of[live] * k + (g % np.uint64(k)).astype(np.int64))[hit])
    h, r, p = map(np.concatenate, (hashes, ranks, places))
    order = np.lexsort((h, r, p))
    h, p = h[order], p[order]
    first = np.ones(len(p), bool)
    first[1:] = p[1:] != p[:-1]
    best = np.zeros(n * k, np.uint64)
    best[p[first]] = h[first]
    return best.reshape(n, k)


def _sets(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, row = shingles(Words(texts, SPACED), WORDS)
    return distinct(h, row)


def parities(elements: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """n x CELLS/8 bytes: whether a cell holds an odd number of elements."""
    cell = (mix(elements ^ np.uint64(0xA0761D6478BD642F)) % np.uint64(CELLS)).astype(np.int64)
    out = np.zeros(n * (CELLS // 8), np.uint8)
    np.bitwise_xor.at(
        out, row * (CELLS // 8) + (cell >> 3), (1 << (cell & 7)).astype(np.uint8)
    )
    return out.reshape(n, -1)


_SIGNED = "doc_id long, text_key binary, set_key binary, n int, bands array<long>, signature binary"


def signatures(docs: DataFrame, counted: bool = False) -> DataFrame:
    """(doc_id, text_key, set_key, n, bands, signature) per document.

    ``counted`` weighs an element by how often it occurs.  Texts without words
    have n = 0 and no bands.
    """
    small_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.md5(text)).alias("text_key"),
        F.lower(text).alias("text"),
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(2)
        keys, sizes, bands, signs = [], [], [], []
        for a, b in cut(column):
            texts = Texts(column[a:b])
            h, row, times = _sets(texts)
            weight = times.astype(np.float64) if counted else np.ones(len(h))
            got = dart_signatures(h, row, weight, texts.n)
            n = np.bincount(row, minlength=texts.n)
            own = mix(h + times.astype(np.uint64)) if counted else h
            total = np.zeros((texts.n, 2), np.uint64)
            some = np.flatnonzero(n)
            if len(some):
                at = np.searchsorted(row, some)
                total[some, 0] = np.add.reduceat(own, at)
                total[some, 1] = np.bitwise_xor.reduceat(mix(own), at)
            keys += [t.tobytes() for t in total]
            sizes.append(n)
            band = np.zeros((texts.n, BANDS), np.uint64)
            for j in range(ROWS):
                band = mix(band + got.reshape(texts.n, BANDS, ROWS)[:, :, j])
            band = mix(band + np.arange(BANDS, dtype=np.uint64))
            bands.append(band)
            kept = (mix(got) >> np.uint64(56)).astype(np.uint8)
            size = n.astype("<i8").reshape(-1, 1).view(np.uint8)
            parts = np.concatenate((kept, parities(h, row, texts.n), size), axis=1)
            signs += [s.tobytes() for s in parts]
        n = np.concatenate(sizes)
        held = np.concatenate(bands).view(np.int64)[n > 0].reshape(-1)
        offsets = np.concatenate(([0], np.cumsum((n > 0) * BANDS)))
        return pa.RecordBatch.from_arrays(
            [
                batch.column(0),
                batch.column(1),
                pa.array(keys, pa.binary()),
                pa.array(n, pa.int32()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(held)),
                pa.array(signs, pa.binary()),
            ],
            names=["doc_id", "text_key", "set_key", "n", "bands", "signature"],
        )

    return map_batches(slim, run, _SIGNED)


def opened(column: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures as kept darts, parities and sizes, one row each."""
    table = np.frombuffer(b"".join(column), np.uint8).reshape(-1, _PARITY_END + 8)
    sizes = table[:, _PARITY_END:].copy().view("<i8")[:, 0]
    return table[:, :COORDINATES], table[:, COORDINATES:_PARITY_END], sizes


def may_be_near(left: tuple, right: tuple) -> np.ndarray:
    """Whether the signatures of each pair allow the similarity.

    Sets of sizes a and b are similar enough when at most
    (1 - LEAST) / (1 + LEAST) * (a + b) elements are in one of them only.
    """
    agree = (left[0] == right[0]).sum(axis=1) >= LEAST_AGREEING
    apart = np.bitwise_count(left[1] ^ right[1]).sum(axis=1, dtype=np.int64)
    apart = np.maximum(apart, np.abs(left[2] - right[2]))
    return agree & (apart <= (1 - LEAST) / (1 + LEAST) * (left[2] + right[2]) + 1e-6)


def _plausible(pairs: DataFrame) -> DataFrame:
    """Pairs (x, y, sx, sy) whose signatures allow the similarity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        left, right = (opened(batch.column(c).to_pylist()) for c in (2, 3))
        return batch.select([0, 1]).filter(pa.array(may_be_near(left, right)))

    return map_batches(pairs.select("x", "y", "sx", "sy"), run, "x binary, y binary")


def similarities(left: pa.Array, right: pa.Array) -> np.ndarray:
    """The exact Jaccard similarity of each pair of texts (no elements: 0)."""
    out = []
    for a, b in cut(left):
        rows = b - a
        # Both texts of a pair in one block: what both have occurs twice.
        lh, lr, _ = _sets(Texts(left[a:b]))
        rh, rr, _ = _sets(Texts(right[a:b]))
        _, row, times = distinct(np.concatenate((lh, rh)), np.concatenate((lr, rr)))
        either = np.bincount(row, minlength=rows)
        both = np.bincount(row[times == 2], minlength=rows)
        out.append(both / np.maximum(either, 1))
    return np.concatenate(out) if out else np.empty(0)


def _linked(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (x, y) of set keys whose texts are similar enough.

    Only texts of the sets in question are moved, once per pair.
    """
    pairs = written(pairs.distinct(), "pairs")
    asked = pairs.select(F.col("x").alias("set_key")).union(pairs.select("y")).distinct()
    held = written(texts.join(asked, "set_key", "left_semi"), "texts")
    with_x = pairs.join(held.select(F.col("set_key").alias("x"), F.col("text").alias("tx")), "x")
    both = with_x.join(held.select(F.col("set_key").alias("y"), F.col("text").alias("ty")), "y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        near = similarities(batch.column(2), batch.column(3)) >= LEAST
        return batch.select([0, 1]).filter(pa.array(near))

    return written(
        map_batches(both.select("x", "y", "tx", "ty"), run, "x binary, y binary"), "links"
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each connected component.

    Labels spread over the links and each label is replaced by its own label,
    so the number of rounds grows with the logarithm of a chain's length.
    """
    edges = written(
        links.select("x", "y").union(links.select("y", "x")).distinct(), "edges"
    )
    labels = written(
        edges.groupBy(F.col("x").alias("node")).agg(F.min(F.least("x", "y")).alias("label")),
        "labels",
    )
    while True:
        spread = (
            edges.join(labels.withColumnRenamed("node", "y"), "y")
            .groupBy(F.col("x").alias("node"))
            .agg(F.min("label").alias("_met"))
        )
        met = labels.join(spread, "node").select(
            "node", "label", F.least("label", "_met").alias("_new")
        )
        jump = labels.select(F.col("node").alias("_new"), F.col("label").alias("_far"))
        moved = written(
            met.join(jump, "_new", "left").select(
                "node",
                F.least("_new", F.coalesce("_far", "_new")).alias("label"),
                (F.least("_new", F.coalesce("_far", "_new")) != F.col("label")).alias("moved"),
            ),
            "labels",
        )
        labels = moved.select("node", "label")
        if not moved.where("moved").limit(1).count():
            return labels


def _buckets(sets: DataFrame) -> DataFrame:
    """(set_key, bucket) of the buckets with two or more distinct sets."""
    filed = sets.select("set_key", F.explode("bands").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return written(filed.join(shared, "bucket"), "buckets")


def _with_hubs(buckets: DataFrame) -> DataFrame:
    """(set_key, bucket, size, hub, worth of the hub): each bucket's hub."""
    worth = buckets.groupBy("set_key").agg(F.sum("size").alias("worth"))
    hubs = (
        buckets.join(worth, "set_key")
        .groupBy("bucket")
        .agg(F.max(F.struct("worth", "set_key")).alias("hub"))
        .select("bucket", F.col("hub.set_key").alias("hub"), F.col("hub.worth").alias("worth"))
    )
    return written(buckets.join(hubs, "bucket"), "hubs")


def _first_pairs(hubbed: DataFrame) -> DataFrame:
    """Each member and the worthiest hub of its buckets: one pair a member."""
    best = (
        hubbed.where(F.col("set_key") != F.col("hub"))
        .groupBy("set_key")
        .agg(F.max(F.struct("worth", "hub")).alias("best"))
    )
    return best.select(F.col("set_key").alias("x"), F.col("best.hub").alias("y"))


def _further_pairs(hubbed: DataFrame, labels: DataFrame) -> DataFrame:
    """Members and the hubs of their buckets that are not yet connected."""
    named = hubbed.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left").select(
        F.col("set_key").alias("x"),
        F.col("hub").alias("y"),
        F.coalesce("label", "set_key").alias("_x_label"),
    )
    pairs = named.where(F.col("x") != F.col("y")).distinct()
    ends = pairs.join(
        labels.select(F.col("node").alias("y"), F.col("label").alias("_y_label")), "y", "left"
    )
    return ends.where(F.col("_x_label") != F.coalesce("_y_label", "y")).select("x", "y")


def _signed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    signs = sets.select("set_key", "signature")
    return pairs.join(
        signs.select(F.col("set_key").alias("x"), F.col("signature").alias("sx")), "x"
    ).join(signs.select(F.col("set_key").alias("y"), F.col("signature").alias("sy")), "y")


def _open_pairs(buckets: DataFrame, sets: DataFrame, labels: DataFrame) -> DataFrame:
    """Plausible pairs across components that share a bucket."""
    named = buckets.join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
    named = named.withColumn("label", F.coalesce("label", "set_key"))
    open_ = (
        named.groupBy("bucket")
        .agg(F.min("label").alias("_a"), F.max("label").alias("_b"))
        .where(F.col("_a") != F.col("_b"))
        .select("bucket")
    )
    members = written(
        named.join(open_, "bucket").join(
            sets.select("set_key", "bands", "signature"), "set_key"
        ),
        "open",
    )
    small = members.where(F.col("size") <= BLOCK).drop("size")
    a = small.select(*[F.col(c).alias(f"a_{c}") if c != "bucket" else F.col(c) for c in small.columns])
    b = small.select(*[F.col(c).alias(f"b_{c}") if c != "bucket" else F.col(c) for c in small.columns])
    first = F.filter(F.zip_with("a_bands", "b_bands", lambda p, q: F.when(p == q, p)), lambda c: c.isNotNull())
    pairs = (
        a.join(b, "bucket")
        .where((F.col("a_set_key") < F.col("b_set_key")) & (F.col("a_label") != F.col("b_label")))
        .where(F.element_at(first, 1) == F.col("bucket"))
        .select(
            F.col("a_set_key").alias("x"),
            F.col("b_set_key").alias("y"),
            F.col("a_signature").alias("sx"),
            F.col("b_signature").alias("sy"),
        )
    )
    found = _plausible(pairs)
    large = members.where(F.col("size") > BLOCK)
    if large.limit(1).count():
        found = found.unionByName(_block_pairs(large))
    return found


def _block_pairs(large: DataFrame) -> DataFrame:
    """Large buckets: blocks of members that meet two by two."""
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("set_key"), blocks).cast("int")
    other = F.explode(F.sequence(F.lit(0), blocks - 1)).alias("_other")
    filed = large.withColumn("_own", own).select(
        "bucket", "set_key", "label", "bands", "signature", "_own", other
    ).select(
        "bucket",
        "set_key",
        "label",
        "bands",
        "signature",
        F.least("_own", "_other").alias("_i"),
        F.greatest("_own", "_other").alias("_j"),
    )

    def run(group: pd.DataFrame) -> pd.DataFrame:
        signs = opened(group["signature"])
        bands = np.array(group["bands"].tolist())
        keys, labels = group["set_key"].to_numpy(), group["label"].to_numpy()
        band = int(np.flatnonzero((bands == group["bucket"].iloc[0]).all(axis=0))[0])
        xs, ys = [], []
        for i in range(len(group)):
            near = may_be_near(tuple(part[i : i + 1] for part in signs), signs)
            if band:
                near &= ~(bands[i, :band] == bands[:, :band]).any(axis=1)
            for j in np.flatnonzero(near):
                if keys[i] < keys[j] and labels[i] != labels[j]:
                    xs.append(keys[i])
                    ys.append(keys[j])
        return pd.DataFrame({"x": xs, "y": ys}, dtype=object)

    return filed.groupBy("bucket", "_i", "_j").applyInPandas(run, "x binary, y binary").distinct()


def classes(docs: DataFrame, counted: bool = False) -> DataFrame:
    """(doc_id, text_key, class_id, class_key) per document row.

    ``class_id`` is the smallest doc_id of the class, ``class_key`` its text key
    there.  Texts without words are one class (equal texts always share one);
    null texts count as empty.  A null doc_id sorts behind all others.  Repeated
    rows are rows.  Other columns are not read.
    """
    signed = written(signatures(docs, counted), "signatures")
    one = signed.groupBy("set_key").agg(
        F.first("bands").alias("bands"),
        F.first("signature").alias("signature"),
        F.min("text_key").alias("text_key"),
    )
    sets = written(one, "sets")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select(F.unhex(F.md5(text)).alias("text_key"), F.lower(text).alias("text"))
    buckets = _buckets(sets)

    def checked(pairs: DataFrame) -> DataFrame:
        # One text per set in question.
        pairs = written(pairs, "plausible")
        asked = pairs.select(F.col("x").alias("set_key")).union(pairs.select("y")).distinct()
        chosen = asked.join(sets.select("set_key", "text_key"), "set_key")
        texts = keyed.join(chosen, "text_key").groupBy("set_key").agg(F.first("text").alias("text"))
        return _linked(pairs, texts)

    hubbed = _with_hubs(buckets)
    links = checked(_plausible(_signed(_first_pairs(hubbed), sets)))
    labels = components(links)
    for find in (
        lambda: _plausible(_signed(_further_pairs(hubbed, labels), sets)),
        lambda: _open_pairs(buckets, sets, labels),
    ):
        more = checked(find())
        if more.limit(1).count():
            links = links.unionByName(more)
            labels = components(links)
    named = (
        signed.select("doc_id", "text_key", "set_key")
        .join(labels.withColumnRenamed("node", "set_key"), "set_key", "left")
        .select(
            "doc_id",
            "text_key",
            F.coalesce("label", "set_key").alias("_class"),
        )
    )
    named = written(named, "named")
    smallest = named.groupBy("_class").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_key")).alias("_first")
    )
    return named.join(smallest, "_class").select(
        "doc_id",
        "text_key",
        F.col("_first.doc_id").alias("class_id"),
        F.col("_first.text_key").alias("class_key"),
    )


def deduplicated(docs: DataFrame, counted: bool = False) -> DataFrame:
    """The rows of ``docs`` that stay: one of each class, with all columns.

    The row of the smallest doc_id stays; of rows equal in id and text, one.
    """
    found = classes(docs, counted)
    kept = (
        found.where(
            F.col("doc_id").eqNullSafe(F.col("class_id"))
            & (F.col("text_key") == F.col("class_key"))
        )
        .groupBy("doc_id", "text_key")
        .agg(F.count(F.lit(1)).alias("_times"))
        .select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_of"), "_times")
    )
    kept = written(kept, "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.withColumn("_key", F.unhex(F.md5(text)))
    met = rows.join(
        kept,
        (F.col("_key") == F.col("_of"))
        & F.col("doc_id").cast("long").eqNullSafe(F.col("_id")),
    )
    single = met.where(F.col("_times") == 1).select(*docs.columns)
    again = met.where(F.col("_times") > 1)
    if not kept.where("_times > 1").limit(1).count():
        return single
    return single.unionByName(again.dropDuplicates(["_key", "_id"]).select(*docs.columns))
