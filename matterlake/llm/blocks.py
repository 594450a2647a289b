"""Byte blocks of a text column, and words and hashes on them in numpy.

An Arrow batch of texts is one run of UTF-8 bytes with offsets.  Everything
here works on that run at once; nothing loops over words.
"""

import sys
import types
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

# A block holds at most this many bytes, unless one text alone is longer.
BLOCK_BYTES = 1 << 20

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Keep Arrow batches of texts small; a smaller setting stays as it is."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def per_process(name: str, make: Callable[[], Any]) -> Any:
    """``make()`` once per Python worker process, whatever task asks."""
    home = sys.modules.setdefault("_llm_process_state", types.ModuleType("state"))
    if name not in home.__dict__:
        home.__dict__[name] = make()
    return home.__dict__[name]


def map_batches(
    df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch], schema: str
) -> DataFrame:
    """``fn`` on every Arrow batch of ``df``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield fn(batch)

    return df.mapInArrow(run, schema)


class Texts:
    """The UTF-8 bytes of a text column (null: empty) and its row offsets."""

    def __init__(self, column: pa.Array):
        column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        o = np.frombuffer(offsets, np.int64, len(column) + 1 + column.offset)
        o = o[column.offset :]
        raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
        self.bytes = raw[o[0] : o[-1]]
        self.offsets = (o - o[0]).astype(np.int64)
        self.n = len(column)

    def replaced(self, data: np.ndarray) -> "Texts":
        """The same rows over other bytes of the same number."""
        out = object.__new__(Texts)
        out.bytes, out.offsets, out.n = data, self.offsets, self.n
        return out


def cut(column: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of at most ``most`` bytes (one long text stays whole)."""
    size = np.diff(Texts(column).offsets)
    start, held = 0, 0
    for i, s in enumerate(size.tolist()):
        if held and held + s > most:
            yield start, i
            start, held = i, 0
        held += s
    if start < len(size):
        yield start, len(size)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: close inputs become far apart."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make(base):
        def grow():
            return np.ones(1, np.uint64), base

        return grow

    out = []
    for name, base in (("powers", _MULTIPLIER), ("inverses", _INVERSE)):
        have, _ = per_process(name, make(base))
        if len(have) < n:
            size = max(n, 2 * BLOCK_BYTES)
            have = np.full(size, base, np.uint64)
            have[0] = 1
            have = np.cumprod(have, dtype=np.uint64)
            sys.modules["_llm_process_state"].__dict__[name] = (have, base)
        out.append(have)
    return out[0], out[1]


class Words:
    """Spans of words in a block and their hashes.

    ``is_word`` maps a byte to whether it belongs to a word; a word never
    crosses from one text into the next.
    """

    def __init__(self, texts: Texts, is_word: np.ndarray):
        b, o = texts.bytes, texts.offsets
        self.texts = texts
        inside = is_word[b]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        heads = o[:-1][np.diff(o) > 0]
        first[heads] = inside[heads]
        tails = heads[1:] - 1
        last[tails] = inside[tails]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        # Words before each text's start: words of text i are bound[i]:bound[i+1].
        self.bound = np.searchsorted(self.start, o)
        self.count = np.diff(self.bound)
        self.row = np.repeat(np.arange(texts.n), self.count)
        self._sums = None

    def _prefix(self) -> np.ndarray:
        if self._sums is None:
            n = len(self.texts.bytes)
            power, _ = _powers(n + 1)
            terms = (self.texts.bytes.astype(np.uint64) + np.uint64(1)) * power[:n]
            self._sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(terms, dtype=np.uint64)))
        return self._sums

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        sums = self._prefix()
        _, inverse = _powers(len(sums))
        return mix((sums[end] - sums[start]) * inverse[start])

    def hashes(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)


# Blanks of the ASCII range part words; every other byte belongs to one.
SPACED = np.ones(256, bool)
SPACED[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False

# Letters, digits and all bytes outside ASCII.
TERMS = np.zeros(256, bool)
TERMS[0x80:] = True
for _a, _b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
    TERMS[_a:_b] = True

_STEP = mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)


def shingles(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of each run of ``size`` words.

    A text with fewer words, but at least one, has one shingle of them all.
    """
    h = words.hashes()
    count, bound = words.count, words.bound
    n = len(h) - size + 1
    if n > 0:
        whole = words.row[:n] == words.row[size - 1 :]
        s = np.zeros(n, np.uint64)
        for j in range(size):
            s += h[j : j + n] * _STEP[j]
        s, row = mix(s[whole]), words.row[:n][whole]
    else:
        s, row = np.empty(0, np.uint64), np.empty(0, np.int64)
    short = np.flatnonzero((count > 0) & (count < size))
    if len(short):
        t = np.zeros(len(short), np.uint64)
        for j in range(size - 1):
            has = count[short] > j
            t[has] += h[bound[short[has]] + j] * _STEP[j]
        t = mix(t + count[short].astype(np.uint64))
        s, row = np.concatenate((s, t)), np.concatenate((row, short))
    return s, row


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, times) sorted by row, then hash."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if not len(h):
        return h, row, np.empty(0, np.int64)
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    at = np.flatnonzero(new)
    return h[at], row[at], np.diff(np.append(at, len(h)))
