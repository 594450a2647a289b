"""Toxicity: a linear classifier with counterfactual regularisation.

Features of a text are the presence of its words, of its pairs of neighbouring
words, and of word beginnings (so that inflected forms share evidence).  Sentences of the
training texts that name a group of people are repeated with each other group
of the same kind in its place; the loss adds the squared change of the score.
A weight on the mention of a group thus costs more than it explains.

Fitting uses at most ``most`` labelled documents; scoring covers whole texts.
A text without known features, the empty one too, gets the base rate.
"""

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matterlake.llm.blocks import TERMS, Texts, Words, cut, map_batches, mix, small_batches
from matterlake.llm.labelled import training_texts

MOST_LABELLED = 12_000
WIDTH = 1 << 20
FEATURES = 8192
LEAST_DOCUMENTS = 4
BEGINNINGS = (5, 6)
PENALTY = 1.0
SHRINK = 0.001
ROUNDS = 400
# Training rows whose features are counted at once.
PIECE = 256

# Names of groups that can stand for one another in a sentence (fixed values).
IDENTITIES = (
    ("women", "men", "transgender", "nonbinary"),
    ("woman", "man"),
    ("girls", "boys"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual"),
    ("immigrants", "refugees", "natives", "foreigners"),
    ("old", "young", "elderly"),
    ("disabled", "blind", "deaf"),
    ("femmes", "hommes"),
    ("musulmans", "chrétiens", "juifs"),
    ("frauen", "männer"),
    ("muslime", "christen", "juden"),
    ("mujeres", "hombres"),
    ("musulmanes", "cristianos", "judíos"),
)

_SENTENCE = regex.compile(r"[^.!?\n]+")
_FEATURES = pa.list_(pa.int32())


def features(texts: Texts) -> tuple[np.ndarray, np.ndarray]:
    """(feature, row) of lower-case texts, features below ``WIDTH``."""
    words = Words(texts, TERMS)
    h = words.hashes()
    parts, rows = [h], [words.row]
    if len(h) > 1:
        same = words.row[1:] == words.row[:-1]
        parts.append(mix(h[:-1] * np.uint64(5) + h[1:])[same])
        rows.append(words.row[1:][same])
    for size in BEGINNINGS:
        long = np.flatnonzero(words.end - words.start > size)
        start = words.start[long]
        parts.append(mix(words.span_hash(start, start + size) + np.uint64(size)))
        rows.append(words.row[long])
    f = (np.concatenate(parts) >> np.uint64(40)) % np.uint64(WIDTH)
    return f.astype(np.int32), np.concatenate(rows)


def _present(f: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    key = np.unique(row.astype(np.int64) * WIDTH + f)
    return (key % WIDTH).astype(np.int32), key // WIDTH


def counterfactuals(text: str, identities=IDENTITIES) -> list[tuple[str, str]]:
    """(sentence, the sentence with another group) for each mention and swap."""
    others = {name: kind for kind in identities for name in kind}
    out = []
    for sentence in _SENTENCE.findall(text):
        for m in regex.finditer(r"\p{L}+", sentence):
            for other in others.get(m.group(), ()):
                if other != m.group():
                    out.append((sentence, sentence[: m.start()] + other + sentence[m.end() :]))
    return out


def _changed(before: str, after: str) -> tuple[np.ndarray, np.ndarray]:
    """The features that only one of two texts has, for each of them."""
    f, g = (np.unique(features(Texts(pa.array([t])))[0]) for t in (before, after))
    return np.setdiff1d(f, g, True), np.setdiff1d(g, f, True)


def _arrays(column: pa.ChunkedArray) -> list[np.ndarray]:
    """The lists of a column as arrays, without a Python number per entry."""
    out = []
    for chunk in column.chunks:
        ends = chunk.offsets.to_numpy()
        flat = chunk.values.to_numpy()
        out += [flat[a:b] for a, b in zip(ends, ends[1:])]
    return out


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def scores(self, texts: Texts) -> np.ndarray:
        f, row = features(texts)
        known = self.weights[f] != 0
        f, row = _present(f[known], row[known])
        z = self.bias + np.bincount(row, weights=self.weights[f], minlength=texts.n)
        return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit_rows(
    rows: list[tuple[np.ndarray, float]],
    swaps: list[tuple[np.ndarray, np.ndarray]],
    penalty: float = PENALTY,
) -> Model:
    """``rows``: (features present, label); ``swaps``: features before, after.

    Features on both sides of a swap cancel out and may be left away.
    """
    y = np.array([label for _, label in rows])
    weights = np.zeros(WIDTH, np.float32)
    n, n1 = len(y), y.sum()
    base = float(np.log((n1 + 0.5) / (n - n1 + 0.5)))
    if not 0 < n1 < n:
        return Model(weights, base)
    # The features that tell the classes apart best (difference of log odds in
    # units of its deviation).  Counted in pieces: the driver holds them once.
    seen, seen1 = np.zeros(WIDTH), np.zeros(WIDTH)
    for a in range(0, n, PIECE):
        some = [f for f, _ in rows[a : a + PIECE]]
        flat = np.concatenate(some)
        label = np.repeat(y[a : a + PIECE], [len(f) for f in some])
        seen += np.bincount(flat, minlength=WIDTH)
        seen1 += np.bincount(flat, weights=label, minlength=WIDTH)
    seen0 = seen - seen1
    odds = np.log((seen1 + 0.5) / (n1 + 1)) - np.log((seen0 + 0.5) / (n - n1 + 1))
    strength = np.abs(odds) / np.sqrt(1 / (seen1 + 0.5) + 1 / (seen0 + 0.5))
    strength[seen < LEAST_DOCUMENTS] = 0
    top = np.argsort(-strength, kind="stable")[:FEATURES]
    top = top[strength[top] > 0]
    place = np.full(WIDTH, -1)
    place[top] = np.arange(len(top))
    kept = [own[own >= 0] for own in (place[f] for f, _ in rows)]
    at, row = np.concatenate(kept), np.repeat(np.arange(n), [len(own) for own in kept])

    change, pair, sign = [], [], []
    for i, (before, after) in enumerate(swaps):
        for f, s in ((before, -1.0), (after, 1.0)):
            f = place[f]
            f = f[f >= 0]
            change.append(f)
            pair.append(np.full(len(f), i))
            sign.append(np.full(len(f), s))
    has = bool(swaps) and sum(map(len, change)) > 0
    if has:
        change, pair, sign = map(np.concatenate, (change, pair, sign))

    w, b = np.zeros(len(top)), base
    m, v = np.zeros(len(top) + 1), np.zeros(len(top) + 1)
    for t in range(1, ROUNDS + 1):
        z = b + np.bincount(row, weights=w[at], minlength=n)
        error = 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30))) - y
        g = np.bincount(at, weights=error[row], minlength=len(top)) / n1 + SHRINK * w
        if has:
            moved = np.bincount(pair, weights=sign * w[change], minlength=len(swaps))
            g += (
                2 * penalty / len(swaps)
                * np.bincount(change, weights=sign * moved[pair], minlength=len(top))
            )
        g = np.append(g, error.sum() / n1)
        m = 0.9 * m + 0.1 * g
        v = 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w -= step[:-1]
        b -= step[-1]
    weights[top] = w
    return Model(weights, float(b))


def fit(
    docs: DataFrame,
    labels: DataFrame,
    may_learn: Column,
    label: str = "toxic",
    most: int = MOST_LABELLED,
    penalty: float = PENALTY,
) -> Model:
    """A model from at most ``most`` labelled documents that ``may_learn`` admits.

    Texts stay on the executors; numbers of features come to the driver.
    """
    small_batches(docs.sparkSession)
    rows = training_texts(docs, labels, label, may_learn, most).withColumn(
        "text", F.lower("text")
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(0)
        found, before, after = [], [], []
        for a, b in cut(column):
            part = column[a:b]
            f, row = _present(*features(Texts(part)))
            ends = np.searchsorted(row, np.arange(b - a + 1))
            for i, text in enumerate(part.to_pylist()):
                found.append(f[ends[i] : ends[i + 1]])
                pairs = [_changed(*p) for p in counterfactuals(text)]
                before.append([p[0] for p in pairs])
                after.append([p[1] for p in pairs])
        return pa.RecordBatch.from_arrays(
            [
                pa.array(found, _FEATURES),
                batch.column(1),
                pa.array(before, pa.list_(_FEATURES)),
                pa.array(after, pa.list_(_FEATURES)),
            ],
            names=["found", "label", "before", "after"],
        )

    table = map_batches(
        rows,
        run,
        "found array<int>, label double, before array<array<int>>, after array<array<int>>",
    ).toArrow()
    found = _arrays(table["found"])
    # The order of rows depends on the partitions; sums of floats do not mind
    # once it is fixed.
    order = sorted(range(len(found)), key=lambda i: (len(found[i]), found[i].tobytes()))
    y = table["label"].to_pylist()
    pairs = (
        _arrays(pa.chunked_array([c.flatten() for c in table[side].chunks], _FEATURES))
        for side in ("before", "after")
    )
    swaps = sorted(zip(*pairs), key=lambda s: (s[0].tobytes(), s[1].tobytes()))
    return fit_rows([(found[i], y[i]) for i in order], swaps, penalty)


def score(docs: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``docs`` and the probability of a toxic text; all columns pass.

    A column ``name`` of ``docs`` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(model)
    kept = [c for c in docs.columns if c != name]
    read = docs.select(*kept, F.lower(F.col("text").cast("string")).alias("_lower_text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(batch.num_columns - 1)
        out = [held.value.scores(Texts(column[a:b])) for a, b in cut(column)]
        return pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], pa.array(np.concatenate(out), pa.float64())],
            names=[*batch.schema.names[:-1], name],
        )

    return map_batches(read, run, docs.select(*kept).schema.add(name, "double"))
