"""Document quality by a byte-level convolutional network in numpy.

A document is its UTF-8 bytes, padded to whole segments of 256.  Each byte has
a learned vector; one more channel says whether the byte lies in a pair of
words that occurred a few words before.  Learned filters look at 8 bytes in
steps of 4; a chunk is two neighbouring segments, so chunks of 512 bytes overlap
by half and cover the whole document.  Filters are max-pooled per chunk, a hidden
layer reads the chunk, and the mean and maximum over all chunks give one
probability.

Fitting uses at most ``most`` labelled documents; fitting and scoring cover whole
texts.  The empty text is one padded chunk.
"""

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.llm.blocks import SPACED, Texts, Words, cut, map_batches, mix, small_batches
from matterlake.llm.labelled import training_texts

MOST_LABELLED = 5_000
SEGMENT = 256
WINDOW, STEP = 8, 4
DEPTH = 8
FILTERS = 24
HIDDEN = 16
LOOK_BACK = 12
EPOCHS = 8
BATCH = 48
RATE = 0.004
BLOCK = 1 << 18

PER_SEGMENT = SEGMENT // STEP


def repeated(texts: Texts) -> np.ndarray:
    """1 on the bytes of words that begin a pair seen up to 12 words before."""
    words = Words(texts, SPACED)
    flag = np.zeros(len(texts.bytes), np.uint8)
    h = words.hashes()
    if len(h) < 3:
        return flag
    row = words.row.astype(np.uint64)
    pair = mix(h[:-1] * np.uint64(7) + h[1:]) + row[:-1]
    seen = np.zeros(len(pair), bool)
    for lag in range(1, min(LOOK_BACK, len(pair) - 1) + 1):
        seen[lag:] |= pair[lag:] == pair[:-lag]
    seen &= words.row[1:] == words.row[:-1]
    at = np.flatnonzero(seen)
    edge = np.zeros(len(flag) + 1, np.int32)
    np.add.at(edge, words.start[at], 1)
    np.add.at(edge, words.end[at], -1)
    return (np.cumsum(edge)[:-1] > 0).astype(np.uint8)


def padded(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, flags, segments per text): each text on whole segments.

    At least one step of zeros follows every text, and there are at least two
    segments, one chunk.
    """
    size = np.diff(texts.offsets)
    segments = np.maximum(2, -(-(size + WINDOW) // SEGMENT))
    begin = np.cumsum(segments) - segments
    out = np.zeros(int(segments.sum()) * SEGMENT, np.uint8)
    flags = np.zeros(len(out), np.uint8)
    to = np.arange(len(texts.bytes)) + np.repeat(begin * SEGMENT - texts.offsets[:-1], size)
    out[to] = texts.bytes
    flags[to] = repeated(texts)
    return out, flags, segments


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    filter_bias: np.ndarray
    hidden: np.ndarray
    hidden_bias: np.ndarray
    last: np.ndarray
    last_bias: np.ndarray

    @staticmethod
    def fresh(rng: np.random.Generator) -> "Network":
        def r(*shape, scale):
            return (rng.standard_normal(shape) * scale).astype(np.float32)

        width = WINDOW * (DEPTH + 1)
        return Network(
            r(256, DEPTH, scale=0.5),
            r(width, FILTERS, scale=(2 / width) ** 0.5),
            np.zeros(FILTERS, np.float32),
            r(FILTERS, HIDDEN, scale=(2 / FILTERS) ** 0.5),
            np.zeros(HIDDEN, np.float32),
            r(2 * HIDDEN, scale=0.2),
            np.zeros(1, np.float32),
        )

    def windows(self, data: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """The input of the filters: one row per step."""
        rows = np.empty((len(data) + STEP, DEPTH + 1), np.float32)
        rows[: len(data), :DEPTH] = self.embed[data]
        rows[: len(data), DEPTH] = flags
        rows[len(data) :] = 0
        item = rows.itemsize * (DEPTH + 1)
        return np.lib.stride_tricks.as_strided(
            rows, (len(data) // STEP, WINDOW * (DEPTH + 1)), (STEP * item, rows.itemsize)
        )

    def pooled(self, data: np.ndarray, flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Filter outputs max-pooled per segment, and where the maximum was.

        The last window of a segment reaches into the next; the one that would
        reach into the next text lies in padding and is left out below.
        """
        x = np.ascontiguousarray(self.windows(data, flags))
        z = x @ self.filters
        z = z.reshape(-1, PER_SEGMENT, FILTERS)
        return z, x

    def forward(self, data, flags, segments) -> dict:
        z, x = self.pooled(data, flags)
        ends = np.cumsum(segments)
        z[ends - 1, -1, :] = -1e9
        top = z.max(axis=1) + self.filter_bias
        # A chunk is a segment and the next one of the same text.
        chunks = segments - 1
        head = np.repeat(ends - segments, chunks) + _within(chunks)
        second = top[head + 1] > top[head]
        h = np.maximum(np.where(second, top[head + 1], top[head]), 0)
        g = np.maximum(h @ self.hidden + self.hidden_bias, 0)
        at = np.cumsum(chunks) - chunks
        mean = np.add.reduceat(g, at, axis=0) / chunks[:, None]
        most = np.maximum.reduceat(g, at, axis=0)
        logit = np.concatenate((mean, most), axis=1) @ self.last + self.last_bias
        return dict(x=x, z=z, head=head, second=second, h=h, g=g, at=at, chunks=chunks, mean=mean, most=most, logit=logit)

    def gradient(self, data, flags, segments, y) -> list[np.ndarray]:
        s = self.forward(data, flags, segments)
        n = len(y)
        p = 1 / (1 + np.exp(-np.clip(s["logit"], -30, 30)))
        d = ((p - y) / n).astype(np.float32)
        doc = np.concatenate((s["mean"], s["most"]), axis=1)
        d_last, d_bias = doc.T @ d, np.array([d.sum()], np.float32)
        d_doc = d[:, None] * self.last
        of = np.repeat(np.arange(n), s["chunks"])
        g = s["g"]
        d_g = d_doc[of, :HIDDEN] / s["chunks"][of, None]
        # The maximum over chunks: shared by chunks that tie.
        is_most = (g == s["most"][of]) & (g > 0)
        ties = np.add.reduceat(is_most.astype(np.float32), s["at"], axis=0)
        d_g = d_g + np.where(is_most, d_doc[of, HIDDEN:] / np.maximum(ties, 1)[of], 0)
        d_g = (d_g * (g > 0)).astype(np.float32)
        d_hidden, d_hidden_bias = s["h"].T @ d_g, d_g.sum(axis=0)
        d_h = (d_g @ self.hidden.T) * (s["h"] > 0)
        segment = s["head"][:, None] + s["second"]
        d_top = np.zeros((len(data) // SEGMENT, FILTERS), np.float32)
        np.add.at(d_top, (segment, np.arange(FILTERS)[None, :]), d_h)
        seg, fil = np.nonzero(d_top)
        value = d_top[seg, fil]
        where = s["z"].argmax(axis=1)[seg, fil]
        step = seg * PER_SEGMENT + where
        rows = s["x"][step] * value[:, None]
        d_filters = np.zeros_like(self.filters)
        order = np.argsort(fil, kind="stable")
        heads = np.searchsorted(fil[order], np.arange(FILTERS))
        sums = np.add.reduceat(np.vstack((rows[order], np.zeros((1, rows.shape[1]), np.float32))), np.minimum(heads, len(order)), axis=0)
        some = np.bincount(fil, minlength=FILTERS) > 0
        d_filters[:, some] = sums[some].T
        d_filter_bias = np.bincount(fil, weights=value, minlength=FILTERS).astype(np.float32)
        back = (self.filters.T[fil] * value[:, None]).reshape(-1, WINDOW, DEPTH + 1)[:, :, :DEPTH]
        places = step[:, None] * STEP + np.arange(WINDOW)
        symbols = data[np.minimum(places, len(data) - 1)].ravel()
        flat = back.reshape(-1, DEPTH)
        d_embed = np.stack(
            [np.bincount(symbols, weights=flat[:, k], minlength=256) for k in range(DEPTH)], axis=1
        ).astype(np.float32)
        return [d_embed, d_filters, d_filter_bias, d_hidden, d_hidden_bias, d_last, d_bias]

    def scores(self, texts: Texts) -> np.ndarray:
        logit = self.forward(*padded(texts))["logit"].astype(np.float64)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def _within(counts: np.ndarray) -> np.ndarray:
    return np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)


def _batch_gradient(net: Network, rows: list[tuple[bytes, bytes, float]]) -> list[np.ndarray]:
    """The gradient over ``rows``, in parts of about ``BLOCK`` bytes."""
    size = np.array([len(r[0]) for r in rows])
    part = (np.cumsum(size) - size) // BLOCK
    total: list[np.ndarray] = []
    for own in np.split(np.arange(len(rows)), np.flatnonzero(np.diff(part)) + 1):
        some = [rows[i] for i in own]
        found = net.gradient(
            np.frombuffer(b"".join(r[0] for r in some), np.uint8),
            np.frombuffer(b"".join(r[1] for r in some), np.uint8),
            size[own] // SEGMENT,
            np.array([r[2] for r in some], np.float32),
        )
        share = np.float32(len(some) / len(rows))
        found = [g * share for g in found]
        total = [x + g for x, g in zip(total, found)] if total else found
    return total


def train(rows: list[tuple[bytes, bytes, float]], seed: int = 7) -> Network:
    """``rows``: padded bytes, flags and label of each training document."""
    rng = np.random.default_rng(seed)
    net = Network.fresh(rng)
    names = [f.name for f in fields(Network)]
    y = np.array([r[2] for r in rows])
    if len(rows):
        share = (y.sum() + 0.5) / (len(y) + 1)
        net.last_bias[:] = np.log(share / (1 - share))
    if not 0 < y.sum() < len(y):
        net.last[:] = 0
        return net
    m = [np.zeros_like(getattr(net, n)) for n in names]
    v = [np.zeros_like(getattr(net, n)) for n in names]
    t, total = 0, EPOCHS * -(-len(rows) // BATCH)
    for _ in range(EPOCHS):
        order = rng.permutation(len(rows))
        for a in range(0, len(rows), BATCH):
            some = [rows[i] for i in order[a : a + BATCH]]
            t += 1
            rate = RATE * (1 - t / (total + 1))
            for i, g in enumerate(_batch_gradient(net, some)):
                m[i] = 0.9 * m[i] + 0.1 * g
                v[i] = 0.999 * v[i] + 0.001 * g * g
                step = (m[i] / (1 - 0.9**t)) / (np.sqrt(v[i] / (1 - 0.999**t)) + 1e-8)
                getattr(net, names[i])[...] -= (rate * step).astype(np.float32)
    return net


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    label: str = "quality",
    most: int = MOST_LABELLED,
) -> Network:
    """A network from at most ``most`` labelled documents ``may_learn`` admits.

    They are read whole, and the driver holds twice their bytes.
    """
    small_batches(docs.sparkSession)
    rows = training_texts(docs, labels, label, may_learn, most)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        data, flags = [], []
        column = batch.column(0)
        for a, b in cut(column, BLOCK):
            d, f, segments = padded(Texts(column[a:b]))
            end = np.cumsum(segments)
            for lo, n in zip((end - segments).tolist(), segments.tolist()):
                own = slice(lo * SEGMENT, (lo + n) * SEGMENT)
                data.append(d[own].tobytes())
                flags.append(f[own].tobytes())
        return pa.RecordBatch.from_arrays(
            [pa.array(data, pa.binary()), pa.array(flags, pa.binary()), batch.column(1)],
            names=["data", "flags", "label"],
        )

    table = map_batches(rows, run, "data binary, flags binary, label double").toArrow()
    # Sorted: the order of rows depends on the partitions.
    return train(sorted(zip(*(table[c].to_pylist() for c in ("data", "flags", "label")))))


def score(docs: DataFrame, net: Network, name: str = "score") -> DataFrame:
    """``docs`` and the probability of good quality; all columns pass.

    A column ``name`` of ``docs`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(net)
    kept = [c for c in docs.columns if c != name]
    read = docs.select(*kept, F.col("text").cast("string").alias("_whole_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.num_columns - 1)
        out = [held.value.scores(Texts(column[a:b])) for a, b in cut(column, BLOCK)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.concatenate(out), pa.float64())],
            names=[*batch.schema.names[:-1], name],
        )

    return map_batches(read, run, docs.select(*kept).schema.add(name, "double"))
