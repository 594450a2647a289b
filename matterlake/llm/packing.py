"""Packing tokenised documents into sequences of bounded length.

Two steps.  A map over the documents turns each text into ids and cuts only
those longer than a sequence; the pieces (numbers, no text) are written.  The
pieces are then dealt into shards of about ``shard_tokens`` tokens, whatever
their document or source, and each shard is packed by bounded-space online
best-fit: a fixed number of open bins stand in a bitset keyed by free space, a
piece goes to the open bin that it fills best, and when a new bin is needed and
all are open, the fullest closes.  Pieces of a shard arrive longest first,
which needs no look-ahead and leaves the short ones to fill the gaps.

Shards have a bounded size, so no task grows with the table, and a shard's last
bins cost a share of its sequences that does not depend on the number of shards.

The ids are those of the tokenizer library for the whole text.  Its rules for
this file (see ``SEPARABLE``) never look across a blank, so ids are looked up
per run of letters in a table of bounded size, and what is not in the table goes
to the library.  Files with other rules are encoded whole.

Null texts count as empty and give the end mark alone; empty texts likewise.
Texts of any length are read whole.  Repeated rows are packed as often as they
occur; a null ``doc_id`` stays null.  An empty table gives an empty result.
Other columns are left aside.  Ties (pieces of one length) are taken in the
order of a row number that the written pieces carry.
"""

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matterlake.llm.blocks import per_process, small_batches
from matterlake.llm.columns import only, text_or_empty
from matterlake.plans.storage import written

CAPACITY = 2048
BINS = 1024
SHARD_TOKENS = 1 << 21
# Runs of letters whose ids a worker process remembers.
REMEMBERED = 800_000
# Runs that are looked up together.
BLOCK_WORDS = 50_000

# Rules of a tokenizer file under which ids never depend on what stands beyond
# a blank (fixed values of the file format).
SEPARABLE = {
    "normalizer": ("NFC", "Replace", "Lowercase"),
    "pre_tokenizer": ("Split", "ByteLevel"),
}


def _steps(part: dict | None) -> tuple[str, ...]:
    if part is None:
        return ()
    inner = part.get("normalizers") or part.get("pretokenizers") or [part]
    return tuple(p["type"] for p in inner)


def _is_separable(path: str) -> bool:
    with open(path, encoding="utf-8") as f:
        rules = json.load(f)
    if any(_steps(rules[k]) != v for k, v in SEPARABLE.items()):
        return False
    blank, cut = rules["normalizer"]["normalizers"][1], rules["pre_tokenizer"]["pretokenizers"]
    return (
        blank["pattern"] == {"Regex": "\\s+"}
        and blank["content"] == " "
        and cut[0]["behavior"] == "Removed"
        and cut[0]["invert"]
        and "[^\\s" in cut[0]["pattern"]["Regex"]
        and not cut[1]["add_prefix_space"]
        and not cut[1]["use_regex"]
        and not any(
            any(map(str.isspace, t["content"])) or t["lstrip"] or t["rstrip"] or t["normalized"]
            for t in rules["added_tokens"]
        )
    )


# Letters whose class, case and normal form are the same in all versions of
# Unicode: ASCII and Latin without the dotted capital I (its small form is two
# letters).  A word of these and of ASCII marks and digits is cut here.
_LATIN = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u017f"
_BLANKS = "\t\n\x0b\x0c\r "
_BLANK = re.compile(f"[{_BLANKS}]")
# What no run of plain letters holds; it marks a word that is kept whole.
_WHOLE = "\0"


class Ids:
    """Ids of texts as little-endian 32-bit bytes.

    Plain stretches of a text are cut into runs by the file's own pattern; runs
    not seen before go to the library together, blanks between them, and come
    back by their numbers.  Words with other letters, or with a special token,
    go to the library one by one.
    """

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = Tokenizer.from_file(path)
        self.separable = _is_separable(path)
        self.remembered = remembered
        self.known: dict[str, bytes] = {}
        if self.separable:
            with open(path, encoding="utf-8") as f:
                cut = json.load(f)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
            # The classes that the pattern names, over plain letters.
            self.cut = re.compile(cut.replace("\\p{L}", _LATIN).replace("\\p{N}", "0-9"))
            special = self.library.get_added_tokens_decoder().values()
            odd = [f"[^!-~{_LATIN}{_BLANKS}]", *[re.escape(t.content) for t in special]]
            self.odd = re.compile("|".join(odd))

    def _keys(self, text: str) -> list[str]:
        """Runs and whole words of a text, in order."""
        out: list[str] = []
        at = 0
        for found in self.odd.finditer(text):
            if found.start() < at:
                continue
            start = max(at, 1 + max(text.rfind(b, at, found.start()) for b in _BLANKS))
            blank = _BLANK.search(text, found.end())
            end = blank.start() if blank else len(text)
            out += self.cut.findall(text[at:start].lower())
            out.append(_WHOLE + text[start:end])
            at = end
        return out + self.cut.findall(text[at:].lower())

    def _each(self, texts: list[str]) -> list[bytes]:
        found = self.library.encode_batch(texts, add_special_tokens=False)
        return [array("I", e.ids).tobytes() for e in found]

    def _together(self, runs: list[str]) -> Iterator[bytes]:
        found = self.library.encode(" ".join(runs), add_special_tokens=False)
        raw, of_run = array("I", found.ids).tobytes(), np.array(found.word_ids, np.int64)
        ends = np.searchsorted(of_run, np.arange(len(runs)), side="right").tolist()
        start = 0
        for end in ends:
            yield raw[4 * start : 4 * end]
            start = end

    def _learn(self, keys: list[str]) -> None:
        runs = [k for k in keys if k[0] != _WHOLE]
        whole = [k for k in keys if k[0] == _WHOLE]
        self.known.update(zip(runs, self._together(runs), strict=True))
        if whole:
            self.known.update(zip(whole, self._each([k[1:] for k in whole]), strict=True))

    def _block(self, texts: list[list[str]]) -> Iterator[bytes]:
        if len(self.known) > self.remembered:
            self.known.clear()
        known = self.known
        new = [k for k in set().union(*texts) if k not in known]
        if new:
            self._learn(new)
        for keys in texts:
            yield b"".join(map(known.__getitem__, keys))

    def of(self, texts: list[str | None]) -> Iterator[bytes]:
        """One value per text, in order."""
        if not self.separable:
            yield from self._each([t or "" for t in texts])
            return
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self._keys(text or ""))
            size += len(held[-1])
            if size > BLOCK_WORDS:
                yield from self._block(held)
                held, size = [], 0
        if held:
            yield from self._block(held)


PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, row long"


def pieces(
    docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = 0
) -> DataFrame:
    """Each document's ids with ``end_id`` after them, cut at ``capacity``.

    ``row`` numbers the pieces; write the result before using it twice.
    """
    small_batches(docs.sparkSession)
    tail = array("I", [end_id]).tobytes()
    step = 4 * capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = per_process(f"packing-{path}", lambda: Ids(path))
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            out: list[tuple] = []
            texts = batch["text"].to_pylist()
            for doc_id, found in zip(batch["doc_id"].to_pylist(), ids.of(texts), strict=True):
                found += tail
                for k, at in enumerate(range(0, len(found), step)):
                    part = found[at : at + step]
                    out.append((doc_id, k, at // 4, len(part) // 4, zlib.crc32(part), row))
                    row += 1
            if out:
                columns = list(zip(*out, strict=True))
                kinds = [pa.int64(), pa.int32(), *[pa.int64()] * 4]
                yield pa.record_batch(
                    [pa.array(c, t) for c, t in zip(columns, kinds, strict=True)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "row"],
                )

    texts = only(docs, doc_id="long", text="string").withColumn("text", text_or_empty())
    return texts.mapInArrow(run, PIECES)


class Bins:
    """A fixed number of open bins, found by free space.

    Bit ``f`` of ``free`` is set while an open bin has ``f`` places left, so the
    lowest set bit at or above a length is the best fit and the lowest of all is
    the fullest.
    """

    def __init__(self, capacity: int = CAPACITY, most: int = BINS):
        self.capacity, self.most = capacity, most
        self.free = 0
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.n_open = 0
        self.n_bins = 0

    def _take(self, free: int) -> int:
        stack = self.open[free]
        found = stack.pop()
        if not stack:
            self.free ^= 1 << free
        self.n_open -= 1
        return found

    def put(self, length: int) -> tuple[int, int]:
        """(bin, place in it) of a piece of ``length``, at least 1."""
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            chosen = self._take(free)
        else:
            free, chosen = self.capacity, self.n_bins
            self.n_bins += 1
            if self.n_open == self.most:
                self._take((self.free & -self.free).bit_length() - 1)
        left = free - length
        if left:
            if not self.open[left]:
                self.free |= 1 << left
            self.open[left].append(chosen)
            self.n_open += 1
        return chosen, self.capacity - free


def pack(
    cut: DataFrame,
    capacity: int = CAPACITY,
    bins: int = BINS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """``cut`` (``pieces``, written) with ``sequence_id`` and ``offset``."""
    # One number: the tokens of the whole table.
    total = cut.agg(F.sum("length")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    # A shard's number is above its bins' numbers, which stay below 2 ** 24.
    dealt = cut.withColumns(
        {
            "shard": F.pmod(F.xxhash64("row"), F.lit(shards)),
            # As text: pandas would turn longs beside nulls into doubles.
            "doc_id": F.col("doc_id").cast("string"),
        }
    )

    def fill(shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["length", "row"], ascending=[False, True])
        held = Bins(capacity, bins)
        places = [held.put(n) for n in shard["length"].tolist()]
        first = int(shard["shard"].iloc[0]) << 24
        shard["sequence_id"] = [first + b for b, _ in places]
        shard["offset"] = [at for _, at in places]
        return shard.drop(columns=["shard", "row"])

    schema = (
        "doc_id string, piece int, start long, length long, ids_crc32 long, "
        "sequence_id long, offset long"
    )
    placed = dealt.groupBy("shard").applyInPandas(fill, schema)
    return placed.withColumn("doc_id", F.col("doc_id").cast("long"))


def packed(
    docs: DataFrame,
    path: str,
    capacity: int = CAPACITY,
    end_id: int = 0,
    bins: int = BINS,
    shard_tokens: int = SHARD_TOKENS,
) -> DataFrame:
    """Every piece of every document and its place in a sequence."""
    cut = written(pieces(docs, path, capacity, end_id), "pieces")
    return pack(cut, capacity, bins, shard_tokens)
