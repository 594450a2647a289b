"""Phrase collocations by best-first growth under admissible bounds.

Phrases grow word by word.  Counts come from scans of whole texts in which a
task sums before it sends; what a later scan need not count is decided by
Bloom filters of bounded size, which let a superfluous phrase through now and
then but never hold back a needed one, and never change a count.

1. Words, and per language their total.
2. Phrases of two words, both of them frequent: a phrase is no more frequent
   than its parts, so the rest cannot reach ``least``.
3. Phrases of three words, best first.  A phrase with prefix ``u v`` occurs at
   most ``f(u v)`` times, its rest at least as often as itself, so its score is
   at most ``f(u v) / f(u)``.  A language's frontier is cut at a level: all
   prefixes whose bound reaches the level are grown, and around every phrase of
   two words whose score reaches it, so that what drops it is known.  If as many
   phrases survive at or above the level as are asked for, no phrase below it,
   grown or not, can enter the result, ties included.  Else the level falls and
   the part of the frontier between the levels is grown too; at level 0 all is.

The first level is the score of the ``2 * most``-th best phrase of two words,
each further one takes four times as many; it is read off a histogram of scores,
which are whole numbers up to ``SCALE``.

Null texts count as empty, a null ``lang`` as ``und``.  Texts of any length are
read whole; only ``A`` to ``Z`` are lower-cased.  Repeated rows count as often
as they occur.  An empty table gives an empty result.  Other columns are left
aside.  Ties are settled by count, then by the phrase's UTF-8 bytes.  Arithmetic
is in 38-digit decimals, exact for counts below 10 to the 16th.
"""

from collections import defaultdict
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matterlake.llm.blocks import mix, small_batches
from matterlake.llm.columns import only, text_or_empty
from matterlake.plans.skew import top_per_group
from matterlake.plans.storage import written

LEAST = 10
MOST = 2000
SCALE = 1_000_000
# A phrase falls to a longer one that has this percentage of its occurrences.
COVERED_PERCENT = 50
UNKNOWN = "und"

# What parts pieces (fixed by the definition); the first stands for all.
PIECE_ENDS = b",.;:!?\n\x0b\x0c\r"
END = PIECE_ENDS[:1]
_UPPER = bytes(range(0x41, 0x5B))
_PLAIN = bytes.maketrans(PIECE_ENDS + _UPPER, END * len(PIECE_ENDS) + _UPPER.lower())

# Words of a language that a task holds before it sends its sums.
HELD = 4_000_000
# Different words that a task numbers, over all languages, before it starts anew.
VOCABULARY = 1_000_000
# No filter is larger (16 MiB); a fuller one lets more through.
MOST_BITS = 1 << 27
BITS_PER_KEY = 12
PROBES = 4
_CHUNK = 1 << 16

COUNTS = "lang string, phrase string, a long"
# The row of a language's total among the counts; no phrase is empty.
TOTAL = ""

_SIDE = np.uint64(0x9E3779B97F4A7C15)


def _hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word)


def keys_of(lang: np.uint64, *words: np.ndarray) -> np.ndarray:
    """One number per phrase from the hashes of its words, in order."""
    key = np.full(len(words[0]), lang, np.uint64)
    for word in words:
        key = mix(key * _SIDE + word)
    return key


class Bloom:
    """A set of keys that may claim a little more than it holds."""

    def __init__(self, bits: bytes):
        self.bits = np.frombuffer(bits, np.uint8)
        self.mask = np.uint64(8 * len(bits) - 1)

    def holds(self, keys: np.ndarray) -> np.ndarray:
        left = np.arange(len(keys))
        for i in range(PROBES):
            at = _probe(keys[left], i, self.mask)
            left = left[(self.bits[at >> np.uint64(3)] >> (at & np.uint64(7))) & 1 > 0]
        found = np.zeros(len(keys), bool)
        found[left] = True
        return found


def _probe(keys: np.ndarray, i: int, mask: np.uint64) -> np.ndarray:
    step = mix(keys ^ _SIDE) | np.uint64(1)
    return (keys + np.uint64(i) * step) & mask


def filter_of(phrases: DataFrame, most_bits: int = MOST_BITS) -> bytes:
    """The bits of a filter over (lang, phrase), at most ``most_bits``.

    Each task sends the chunks it set; chunks of one place are joined, and the
    driver receives no more than the filter.
    """
    n = phrases.count()
    size = _CHUNK
    while size < min(most_bits, BITS_PER_KEY * n):
        size *= 2

    def set_bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(size // 8, np.uint8)
        for batch in batches:
            langs = batch["lang"].to_pylist()
            split = [p.encode().split(b" ") for p in batch["phrase"].to_pylist()]
            for lang in set(langs):
                for words in {len(s) for s in split}:
                    own = [
                        s
                        for s, x in zip(split, langs, strict=True)
                        if x == lang and len(s) == words
                    ]
                    hashed = [
                        np.array([_hash(s[i]) for s in own], np.uint64) for i in range(words)
                    ]
                    keys = keys_of(np.uint64(_hash(lang.encode())), *hashed)
                    for i in range(PROBES):
                        at = _probe(keys, i, np.uint64(size - 1))
                        bit = np.left_shift(np.uint8(1), (at & np.uint64(7)).astype(np.uint8))
                        np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), bit)
        chunks = bits.reshape(-1, _CHUNK // 8)
        for i in np.flatnonzero(chunks.any(axis=1)).tolist():
            yield pa.record_batch([pa.array([i]), pa.array([chunks[i].tobytes()])], ["chunk", "bits"])

    def join(chunk: pd.DataFrame) -> pd.DataFrame:
        parts = [np.frombuffer(b, np.uint8) for b in chunk["bits"]]
        both = reduce(np.bitwise_or, parts).tobytes()
        return pd.DataFrame([(chunk["chunk"].iloc[0], both)], columns=["chunk", "bits"])

    schema = "chunk long, bits binary"
    found = (
        phrases.select("lang", "phrase")
        .mapInArrow(set_bits, schema)
        .groupBy("chunk")
        .applyInPandas(join, schema)
        .collect()
    )
    out = bytearray(size // 8)
    for row in found:
        at = row["chunk"] * _CHUNK // 8
        out[at : at + _CHUNK // 8] = row["bits"]
    return bytes(out)


def words_of(text: str) -> list[bytes]:
    """The words of a text, ``A`` to ``Z`` in lower case, ``END`` between pieces.

    What ends a piece is part of no word, so one such mark can stand for all.
    """
    return text.encode().translate(_PLAIN).replace(END, b" " + END + b" ").split()


class Held:
    """Words of one language, numbered in the order in which they came."""

    def __init__(self, lang: str):
        self.lang = lang
        self.key = np.uint64(_hash(lang.encode()))
        self.numbers: defaultdict[bytes, int] = defaultdict()
        self.numbers.default_factory = self.numbers.__len__
        self.numbers[END]  # noqa: B018  (number 0)
        self.parts: list[np.ndarray] = []
        self.n = 0

    def add(self, text: str) -> None:
        words = [*words_of(text), END]
        self.parts.append(np.fromiter(map(self.numbers.__getitem__, words), np.int32, len(words)))
        self.n += len(words)

    def hashes(self) -> np.ndarray:
        return np.array([_hash(w) for w in self.numbers], np.uint64)

    def rows(self, columns: list[np.ndarray], counts: np.ndarray) -> pa.RecordBatch:
        """(lang, phrase, a) of phrases given as one column of numbers per word."""
        words = pa.array(list(self.numbers), pa.binary()).cast(pa.string())
        parts = [words.take(pa.array(c)) for c in columns]
        phrases = parts[0] if len(parts) == 1 else pc.binary_join_element_wise(*parts, " ")
        lang = pa.array([self.lang], pa.string()).take(pa.array(np.zeros(len(counts), np.int32)))
        return pa.record_batch(
            [lang, phrases, pa.array(counts.astype(np.int64))], ["lang", "phrase", "a"]
        )


# Sums the phrases of what is held: columns of word numbers, and their counts.
Summed = Callable[[Held, np.ndarray], tuple[list[np.ndarray], np.ndarray]]
# Rows that leave a task in one batch.
_SENT = 100_000


def _counts(docs: DataFrame, make: Callable[[], Summed], totals: bool = False) -> DataFrame:
    """Occurrences of phrases: (lang, phrase, a), summed in the tasks first.

    With ``totals`` a language's words in all come too, as the phrase ``TOTAL``.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summed = make()
        langs: dict[str, Held] = {}

        def sent(held: Held) -> Iterator[pa.RecordBatch]:
            tokens = np.concatenate(held.parts)
            held.parts, held.n = [], 0
            if totals:
                n = int(np.count_nonzero(tokens))
                yield pa.record_batch(
                    [pa.array([held.lang]), pa.array([TOTAL]), pa.array([n], pa.int64())],
                    ["lang", "phrase", "a"],
                )
            columns, counts = summed(held, tokens)
            for at in range(0, len(counts), _SENT):
                cut = slice(at, at + _SENT)
                yield held.rows([c[cut] for c in columns], counts[cut])

        for batch in batches:
            for lang, text in zip(
                batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True
            ):
                if lang not in langs:
                    langs[lang] = Held(lang)
                held = langs[lang]
                held.add(text)
                if held.n > HELD:
                    yield from sent(held)
            # All languages share what a task may hold.
            while sum(h.n for h in langs.values()) > HELD:
                yield from sent(max(langs.values(), key=lambda h: h.n))
            if sum(len(h.numbers) for h in langs.values()) > VOCABULARY:
                for held in langs.values():
                    if held.n:
                        yield from sent(held)
                langs.clear()
        for held in list(langs.values()):
            if held.n:
                yield from sent(held)

    sums = docs.mapInArrow(run, COUNTS)
    return sums.groupBy("lang", "phrase").agg(F.sum("a").alias("a"))


def _words() -> Summed:
    def summed(held: Held, tokens: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        counts = np.bincount(tokens, minlength=1)
        counts[0] = 0
        found = np.flatnonzero(counts)
        return [found.astype(np.int32)], counts[found]

    return summed


def _summed_pairs(first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
    key, counts = np.unique(first.astype(np.int64) << 32 | second, return_counts=True)
    return (key >> 32).astype(np.int32), (key & 0xFFFFFFFF).astype(np.int32), counts


def _shipped(docs: DataFrame, bits: bytes):
    """A filter as broadcast variable, its size bounded by ``MOST_BITS``."""
    return docs.sparkSession.sparkContext.broadcast(bits)


def _frequent_pairs(words) -> Callable[[], Summed]:
    """Phrases of two words that are both in the filter ``words``."""

    def make() -> Summed:
        bloom = Bloom(words.value)

        def summed(held: Held, tokens: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            frequent = bloom.holds(keys_of(held.key, held.hashes()))
            frequent[0] = False
            usable = frequent[tokens]
            at = np.flatnonzero(usable[:-1] & usable[1:])
            first, second, counts = _summed_pairs(tokens[at], tokens[at + 1])
            return [first, second], counts

        return summed

    return make


def _grown(pairs, rounds: list[tuple]) -> Callable[[], Summed]:
    """Phrases of three words that the last round grows and none before did.

    ``pairs`` holds all phrases of two words that are frequent enough; a round
    is its filters of prefixes to grow and of phrases to be covered.
    """

    def make() -> Summed:
        every = Bloom(pairs.value)
        filters = [(Bloom(g.value), Bloom(c.value)) for g, c in rounds]

        def summed(held: Held, tokens: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
            hashes = held.hashes()
            inside = tokens != 0
            at = np.flatnonzero(inside[:-1] & inside[1:])
            keys = keys_of(held.key, hashes[tokens[at]], hashes[tokens[at + 1]])
            known = every.holds(keys)
            at, keys = at[known], keys[known]
            # Two such phrases, one word apart, make one of three words.
            next_ = np.flatnonzero(np.diff(at) == 1)
            prefix, rest, at = keys[next_], keys[next_ + 1], at[next_]
            for grow, cover in filters[:-1]:
                left = ~(grow.holds(prefix) | cover.holds(rest))
                prefix, rest, at = prefix[left], rest[left], at[left]
            grow, cover = filters[-1]
            at = at[grow.holds(prefix) | cover.holds(rest)]
            first, second, _ = _summed_pairs(tokens[at], tokens[at + 1])
            pair = first.astype(np.int64) << 32 | second
            own = tokens[at].astype(np.int64) << 32 | tokens[at + 1]
            place, third, counts = _summed_pairs(np.searchsorted(pair, own), tokens[at + 2])
            return [first[place], second[place], third], counts

        return summed

    return make


def _ratio(a: Column, left: Column, right: Column) -> Column:
    """``floor(SCALE * a * a / (left * right))``, exactly."""
    wide = "decimal(16,0)"
    over = F.lit(SCALE).cast("decimal(7,0)") * a.cast(wide) * a.cast(wide)
    whole = F.call_function("div", over, left.cast(wide) * right.cast(wide))
    return whole.cast("long")


def _first(phrase: Column) -> Column:
    return F.substring_index(phrase, " ", 1)


def _last(phrase: Column) -> Column:
    return F.substring_index(phrase, " ", -1)


def _looked_up(df: DataFrame, counts: DataFrame, part: Column, name: str) -> DataFrame:
    """``df`` with the count of ``part`` as ``name``; every part has one."""
    found = counts.select("lang", F.col("phrase").alias("_part"), F.col("a").alias(name))
    return df.withColumn("_part", part).join(found, ["lang", "_part"]).drop("_part")


def _scored_pairs(pairs: DataFrame, words: DataFrame) -> DataFrame:
    phrase = F.col("phrase")
    sided = _looked_up(pairs, words, _first(phrase), "l")
    sided = _looked_up(sided, words, _last(phrase), "r")
    a, left, right = F.col("a"), F.col("l"), F.col("r")
    return sided.withColumns(
        # The bound of all that begins with the phrase: its rest counts as often.
        {"score": _ratio(a, left, right), "bound": _ratio(a, left, a)}
    ).select("lang", "phrase", "a", "l", "r", "score", "bound")


def _scored_triples(triples: DataFrame, words: DataFrame, pairs: DataFrame) -> DataFrame:
    phrase = F.col("phrase")
    head = F.substring_index(phrase, " ", 2)
    tail = F.substring_index(phrase, " ", -2)
    sided = _looked_up(triples, words, _first(phrase), "_l1")
    sided = _looked_up(sided, pairs, tail, "_r1")
    sided = _looked_up(sided, pairs, head, "_l2")
    sided = _looked_up(sided, words, _last(phrase), "_r2")
    a = F.col("a")
    one = _ratio(a, F.col("_l1"), F.col("_r1"))
    two = _ratio(a, F.col("_l2"), F.col("_r2"))
    both = sided.withColumns({"_one": one, "_two": two})
    early = F.col("_one") <= F.col("_two")
    return both.select(
        "lang",
        "phrase",
        "a",
        F.when(early, F.col("_l1")).otherwise(F.col("_l2")).alias("l"),
        F.when(early, F.col("_r1")).otherwise(F.col("_r2")).alias("r"),
        F.least("_one", "_two").alias("score"),
    )


def _levels(pairs: DataFrame, langs: DataFrame, n: int) -> DataFrame:
    """(lang, level): the score of the ``n``-th best pair, 0 if there is none.

    From a histogram of whole scores: at most ``SCALE + 1`` rows a language.
    """
    best_first = Window.partitionBy("lang").orderBy(F.col("score").desc())
    found = (
        pairs.groupBy("lang", "score")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_sum", F.sum("_n").over(best_first))
        .where(F.col("_sum") >= n)
        .groupBy("lang")
        .agg(F.max("score").alias("level"))
    )
    return langs.select("lang").join(found, "lang", "left").na.fill(0, ["level"])


def _covered(pairs: DataFrame, triples: DataFrame) -> DataFrame:
    """``pairs`` without those that a longer phrase covers."""
    phrase = F.col("phrase")
    inside = F.array(F.substring_index(phrase, " ", 2), F.substring_index(phrase, " ", -2))
    most = (
        triples.select("lang", "a", F.explode(inside).alias("phrase"))
        .groupBy("lang", "phrase")
        .agg(F.max("a").alias("_longer"))
    )
    covered = 100 * F.col("_longer") >= COVERED_PERCENT * F.col("a")
    return (
        pairs.join(most, ["lang", "phrase"], "left")
        .where(F.col("_longer").isNull() | ~covered)
        .drop("_longer")
    )


def mine(
    docs: DataFrame, most: int = MOST, least: int = LEAST, slack: int = 2
) -> DataFrame:
    """Each language's first ``most`` phrases: lang, rank, phrase, a, l, r, n, score.

    ``slack`` times ``most`` pairs set the first level.
    """
    texts = only(docs, lang="string", text="string").select(
        F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), text_or_empty().alias("text")
    )
    kept = (F.col("a") >= least) | (F.col("phrase") == TOTAL)
    counted = written(_counts(texts, _words, totals=True).where(kept), "words")
    words = counted.where(F.col("phrase") != TOTAL)
    totals = counted.where(F.col("phrase") == TOTAL).select("lang", F.col("a").alias("n"))

    frequent = _shipped(docs, filter_of(words))
    two = _counts(texts, _frequent_pairs(frequent)).where(F.col("a") >= least)
    pairs = written(_scored_pairs(written(two, "pairs"), words), "scored-pairs")
    all_pairs = _shipped(docs, filter_of(pairs))

    triples: DataFrame | None = None
    rounds: list[tuple] = []
    # Per language: the level its frontier was grown to, above all scores at first.
    state = totals.select(
        "lang", F.lit(SCALE + 1).cast("long").alias("level"), F.lit(False).alias("settled")
    )
    wanted = slack * most
    while True:
        lower = _levels(pairs, totals, wanted).withColumnRenamed("level", "_lower")
        levels = written(
            state.join(lower, "lang").select(
                "lang",
                F.col("level").alias("before"),
                F.when(F.col("settled"), F.col("level")).otherwise(F.col("_lower")).alias("level"),
            ),
            "levels",
        )
        frontier = pairs.join(levels, "lang")

        def fresh(value: str, rows: DataFrame = frontier) -> DataFrame:
            value = F.col(value)
            return rows.where((value >= F.col("level")) & (value < F.col("before")))

        rounds.append(
            (
                _shipped(docs, filter_of(fresh("bound"))),
                _shipped(docs, filter_of(fresh("score"))),
            )
        )
        three = _counts(texts, _grown(all_pairs, rounds)).where(F.col("a") >= least)
        scored = written(
            _scored_triples(written(three, "triples"), words, pairs), "scored-triples"
        )
        triples = scored if triples is None else triples.unionByName(scored)

        def reached(rows: DataFrame, at: DataFrame = levels) -> DataFrame:
            both = rows.join(at.select("lang", "level"), "lang")
            return both.where(F.col("score") >= F.col("level")).drop("level")

        alive = written(
            _covered(reached(pairs.drop("bound")), triples).unionByName(reached(triples)),
            "alive",
        )
        sizes = alive.groupBy("lang").agg(F.count(F.lit(1)).alias("_alive"))
        enough = F.coalesce("_alive", F.lit(0)) >= most
        state = written(
            levels.join(sizes, "lang", "left").select(
                "lang", "level", ((F.col("level") == 0) | enough).alias("settled")
            ),
            "settled",
        )
        # One number; the state has a row per language.
        if not state.where(~F.col("settled")).count():
            break
        wanted *= 4
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    top = top_per_group(alive, ["lang"], order, most)
    return top.join(totals, "lang").select(
        "lang",
        F.col("rank").cast("long").alias("rank"),
        "phrase",
        "a",
        "l",
        "r",
        "n",
        "score",
    )
