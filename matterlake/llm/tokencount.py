"""Token counts by a compiled tokenizer: finite-state, no token is built.

Two deterministic machines run one after the other.  The first walks over
character classes and marks where the split pattern starts a match.  The second
reads the bytes of one match.  Its state is the last token of every prefix that
a later token may still build on (no longer than the longest token, so the
number of states is finite), and its transition on a byte emits the change of
the token count.  The transition is compiled from the merge list: the encoding
of a prefix ends in the one token ``t`` such that the token before ``t`` and
``t`` do not merge across their border, which the merge trees of the two decide.

Machines run on whole blocks of matches in step.  What the second machine
answers for a match is kept per process, in a table of bounded size.

Long texts are cut into chunks.  A chunk's state map sends the state at its
start to (count, state at its end).  At a blank after a non-blank every state
is the same, so the map is (what stands before the first such place, the count
between first and last, what stands after): maps compose associatively, and the
composition runs as a scan in pairs.
"""

import hashlib
import json
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from matterlake.llm.blocks import Texts, _powers, cut, map_batches, mix, per_process, small_batches

CHUNK = 1 << 19
SPLIT = regex.compile(r"(?<=\S)(?=\s)")
LONG = 256
# Matches of up to this many letters are looked up by a hash.
HASHED = 256
REMEMBERED = 1 << 21
NEVER = np.int64(1 << 40)

LETTER, NUMBER, BLANK, MARK = 1, 2, 3, 0


def _character_classes() -> np.ndarray:
    """The class of each code point (surrogates: marks)."""
    out = np.zeros(0x110000, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (BLANK, r"\s+")):
        for m in regex.finditer(pattern, every):
            a, b = m.span()
            # Surrogates are absent from the string: positions behind them shift.
            for lo, hi in ((a, min(b, 0xD800)), (max(a, 0xD800), b)):
                if lo < hi:
                    shift = 0x800 if lo >= 0xD800 else 0
                    out[lo + shift : hi + shift] = cls
    return out


def match_starts(points: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Whether the pattern starts a match at each code point.

    ``heads`` marks the first point of each text.  The rules read at most three
    points ahead, so they are one pass of a finite machine:
    a run of one class is a match; of a run of blanks before something else the
    last blank stands alone, or opens the next match if it is a plain space; an
    apostrophe that opens a match takes a following s, t, re, ve, m, ll or d.
    """
    n = len(points)
    c = classes[points]
    start = heads.copy()
    start[1:] |= c[1:] != c[:-1]
    ends = np.ones(n, bool)
    ends[:-1] = start[1:]
    tail = np.ones(n, bool)
    tail[:-1] = heads[1:]
    blank = c == BLANK
    # The last blank of a run that something follows in the same text.
    last = blank & ends & ~tail
    start |= last
    space = np.flatnonzero(last & (points == 0x20))
    start[space + 1] = False
    opener = np.flatnonzero((points == 0x27) & start)
    if len(opener):
        def ahead(k):
            at = opener + k
            ok = at < n
            p = points[np.minimum(at, n - 1)]
            for j in range(1, k + 1):
                ok = ok & ~heads[np.minimum(opener + j, n - 1)]
            return np.where(ok, p, 0)

        one, two = ahead(1), ahead(2)
        short = np.isin(one, [ord(x) for x in "stmd"])
        long = np.zeros(len(opener), bool)
        for a, b in ("re", "ve", "ll"):
            long |= (one == ord(a)) & (two == ord(b))
        for at, size in ((opener[short], 2), (opener[long], 3)):
            start[at + 1] = False
            behind = at + size
            start[behind[behind < n]] = True
    return start


class Machine:
    """The compiled counter of one tokenizer file."""

    def __init__(self, content: bytes):
        spec = json.loads(content)
        model, pre = spec["model"], spec["pre_tokenizer"]
        plain = (
            model["type"] == "BPE"
            and pre["type"] == "ByteLevel"
            and pre["use_regex"]
            and not pre["add_prefix_space"]
            and not model.get("ignore_merges")
            and not spec["normalizer"]
        )
        if not plain:
            raise ValueError("only plain byte-level BPE tokenizers are compiled")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self._cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.classes = _character_classes()
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        to_byte = {chr(p): b for b, p in _printable().items()}
        # Ids in order of making: bytes first, then one per merge.
        ids = {c: b for c, b in to_byte.items()}
        left, right = list(range(256)), list(range(256))
        keys, texts = [], [bytes([b]) for b in range(256)]
        for a, b in merges:
            made = ids.setdefault(a + b, len(texts))
            if made != len(texts):
                raise ValueError("a token is made by two merges")
            left.append(ids[a])
            right.append(ids[b])
            keys.append(ids[a] << 20 | ids[b])
            texts.append(texts[ids[a]] + texts[ids[b]])
        self.left, self.right = np.array(left), np.array(right)
        order = np.argsort(np.array(keys, np.int64))
        self.pair_keys = np.array(keys, np.int64)[order]
        self.pair_made = order.astype(np.int64) + 256
        self._compile(texts)
        self._slots = np.zeros(1 << 16, np.uint64)
        self._values = np.zeros(1 << 16, np.int32)
        self._held = 0

    def _compile(self, texts: list[bytes]) -> None:
        """The trie of reversed tokens; tokens that split themselves are out."""
        self.node_token = [-1]
        edges: dict[int, int] = {}
        for token, text in enumerate(texts):
            node = 0
            for b in reversed(text):
                key = node << 8 | b
                if key not in edges:
                    edges[key] = len(self.node_token)
                    self.node_token.append(-1)
                node = edges[key]
            self.node_token[node] = token
        self.edges = edges
        keys = np.fromiter(edges.keys(), np.int64, len(edges))
        order = np.argsort(keys)
        self.edge_keys = keys[order]
        self.edge_nodes = np.fromiter(edges.values(), np.int64, len(edges))[order]
        tokens = np.array(self.node_token)
        made = np.flatnonzero(tokens >= 256)
        t = tokens[made]
        # A token stands for its bytes if its two parts are stable neighbours
        # up to the merge that makes it.
        kept = self.stable(self.left[t], self.right[t], below=t)
        tokens[made[~kept]] = -1
        self.node_token = tokens

    def _find(self, table: np.ndarray, key: np.ndarray) -> np.ndarray:
        at = np.searchsorted(table, key)
        at[at == len(table)] = 0
        return np.where(table[at] == key, at, -1)

    def stable(self, a: np.ndarray, b: np.ndarray, below: np.ndarray | None = None) -> np.ndarray:
        """Whether no merge crosses the border of neighbouring tokens a, b.

        Tokens are undone from the latest made on, on the side of the border; a
        merge across would have to come before the one that is undone, and wins
        a tie against the right token's, which stands further right.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER) if below is None else below.astype(np.int64)
        out = np.ones(len(a), bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            at = self._find(self.pair_keys, x << 20 | y)
            crossing = np.where(at >= 0, self.pair_made[at], NEVER) < limit[live]
            out[live[crossing]] = False
            go = ~crossing & (np.maximum(x, y) >= 256)
            live, x, y = live[go], x[go], y[go]
            newer = x > y
            limit[live] = np.where(newer, x, y + 1)
            a[live] = np.where(newer, self.right[x], x)
            b[live] = np.where(newer, y, self.left[y])
        return out

    def _run(self, data: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Token counts of the matches ``data[start:start + size]``, in step."""
        if not len(start):
            return np.empty(0, np.int64)
        order = np.argsort(-size, kind="stable")
        start, size = start[order], size[order]
        width = int(size[0])
        last = np.full((width + 1, len(start)), -1, np.int32)
        count = np.zeros((width + 1, len(start)), np.int32)
        for i in range(width):
            lanes = np.arange(np.searchsorted(-size, -i, side="left"))
            node = np.zeros(len(lanes), np.int64)
            for back in range(i + 1):
                byte = data[start[lanes] + i - back].astype(np.int64)
                at = self._find(self.edge_keys, node << 8 | byte)
                on = at >= 0
                lanes, node = lanes[on], self.edge_nodes[at[on]]
                if not len(lanes):
                    break
                token = self.node_token[node]
                ok = token >= 0
                if back < i:
                    before = last[i - back, lanes]
                    some = np.flatnonzero(ok & (before >= 0))
                    ok[:] = False
                    ok[some] = self.stable(before[some].astype(np.int64), token[some])
                done = lanes[ok]
                last[i + 1, done] = token[ok]
                count[i + 1, done] = count[i - back, done] + 1
                lanes, node = lanes[~ok], node[~ok]
        out = np.empty(len(start), np.int64)
        out[order] = count[size, np.arange(len(start))]
        return out

    def _run_long(self, data: bytes) -> int:
        """The same machine on one long match, byte by byte."""
        last, count = [-1], [0]
        stable: dict[tuple[int, int], bool] = {}
        for i in range(len(data)):
            node = 0
            for back in range(i + 1):
                node = self.edges.get(node << 8 | data[i - back], -1)
                if node < 0:
                    raise AssertionError("no token ends here")
                token = int(self.node_token[node])
                if token < 0:
                    continue
                before = last[i - back]
                if before >= 0:
                    key = (before, token)
                    if key not in stable:
                        stable[key] = bool(
                            self.stable(np.array([before]), np.array([token]))[0]
                        )
                    if not stable[key]:
                        continue
                last.append(token)
                count.append(count[i - back] + 1)
                break
        return count[-1]

    def _look(self, h: np.ndarray) -> np.ndarray:
        """Remembered counts; 0 where there is none."""
        out = np.zeros(len(h), np.int64)
        mask = np.uint64(len(self._slots) - 1)
        slot = h & mask
        open_ = np.arange(len(h))
        while len(open_):
            key = self._slots[slot[open_]]
            hit = key == h[open_]
            out[open_[hit]] = self._values[slot[open_[hit]]]
            open_ = open_[~hit & (key != 0)]
            slot[open_] = (slot[open_] + np.uint64(1)) & mask
        return out

    def _remember(self, h: np.ndarray, value: np.ndarray) -> None:
        if self._held + len(h) > REMEMBERED:
            return
        if 2 * (self._held + len(h)) > len(self._slots):
            old = np.flatnonzero(self._slots)
            h = np.concatenate((self._slots[old], h))
            value = np.concatenate((self._values[old], value))
            size = len(self._slots)
            while 2 * len(h) > size:
                size *= 4
            self._slots, self._values = np.zeros(size, np.uint64), np.zeros(size, np.int32)
            self._held = 0
        mask = np.uint64(len(self._slots) - 1)
        slot = h & mask
        rest = np.arange(len(h))
        self._held += len(h)
        while len(rest):
            free = rest[self._slots[slot[rest]] == 0]
            self._slots[slot[free]] = h[free]
            mine = self._slots[slot[rest]] == h[rest]
            self._values[slot[rest[mine]]] = value[rest[mine]]
            rest = rest[~mine]
            slot[rest] = (slot[rest] + np.uint64(1)) & mask

    def _counted(self, data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Counts of single matches, given as byte ranges."""
        size = stop - start
        counts = np.zeros(len(size), np.int64)
        short = size <= LONG
        counts[short] = self._run(data, start[short], size[short])
        for i in np.flatnonzero(~short):
            counts[i] = self._run_long(data[start[i] : stop[i]].tobytes())
        return counts

    def count_whole(self, texts: list[str]) -> np.ndarray:
        """Counts of texts without special tokens, each split by itself."""
        joined = "".join(texts)
        if not joined:
            return np.zeros(len(texts), np.int64)
        points = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        data = np.frombuffer(joined.encode(), np.uint8)
        offsets = np.cumsum([0, *map(len, texts)])
        heads = np.zeros(len(points), bool)
        heads[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(match_starts(points, heads, self.classes))
        stops = np.append(starts[1:], len(points))
        n = len(points)
        power, inverse = _powers(n + 1)
        sums = np.concatenate(
            (np.zeros(1, np.uint64), np.cumsum((points.astype(np.uint64) + np.uint64(1)) * power[:n], dtype=np.uint64))
        )
        h = mix((sums[stops] - sums[starts]) * inverse[starts])
        h |= h == 0
        found = self._look(h)
        # Sums modulo a power of two tell apart what is short: patterned words of
        # a thousand letters and more can share one.  Wide matches go by bytes.
        wide = stops - starts > HASHED
        found[wide] = 0
        new = np.flatnonzero((found == 0) & ~wide)
        if len(new) or wide.any():
            width = 1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            place = np.concatenate((np.zeros(1, np.int64), np.cumsum(width)))
        if len(new):
            _, first, where = np.unique(h[new], return_index=True, return_inverse=True)
            at = new[first]
            counts = self._counted(data, place[starts[at]], place[stops[at]])
            self._remember(h[at], counts)
            found[new] = counts[where]
        if wide.any():
            alike: dict[bytes, list[int]] = {}
            for i in np.flatnonzero(wide).tolist():
                alike.setdefault(data[place[starts[i]] : place[stops[i]]].tobytes(), []).append(i)
            at = np.array([same[0] for same in alike.values()])
            counts = self._counted(data, place[starts[at]], place[stops[at]])
            for same, n in zip(alike.values(), counts.tolist(), strict=True):
                found[same] = n
        totals = np.concatenate((np.zeros(1, np.int64), np.cumsum(found)))
        bounds = np.searchsorted(starts, offsets)
        return totals[bounds[1:]] - totals[bounds[:-1]]

    def count(self, texts: list[str]) -> np.ndarray:
        """Counts of whole texts; a special token in a text is one token."""
        pieces, owner = [], []
        out = np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            parts = [text]
            if self._cut is not None and any(s in text for s in self.special):
                parts = self._cut.split(text)
                out[i] = len(parts) - 1
            for part in parts:
                if len(part) > CHUNK:
                    out[i] += self.count_long(part)
                elif part:
                    pieces.append(part)
                    owner.append(i)
        np.add.at(out, np.array(owner, np.int64), self.count_whole(pieces))
        return out

    def count_long(self, text: str, chunk: int = CHUNK) -> int:
        starts = range(0, max(len(text), 1), chunk)
        maps = [self.chunk_map(text[i : i + chunk]) for i in starts]
        while len(maps) > 1:
            joined = [self.compose(*maps[i : i + 2]) for i in range(0, len(maps) - 1, 2)]
            maps = joined + maps[2 * len(joined) :]
        head, inner, tail = maps[0]
        if inner is None:
            return int(self.count_whole([head])[0])
        return inner + int(self.count_whole([head, tail]).sum())

    def chunk_map(self, text: str) -> tuple[str, int | None, str]:
        first = SPLIT.search(text)
        if first is None:
            return text, None, ""
        a = first.start()
        # The last place: from the end, in growing windows.
        width = 64
        while True:
            spots = [m.start() for m in SPLIT.finditer(text, max(a, len(text) - width))]
            if spots or width > len(text):
                break
            width *= 2
        b = spots[-1] if spots else a
        return text[:a], int(self.count_whole([text[a:b]])[0]), text[b:]

    def compose(self, x: tuple, y: tuple) -> tuple[str, int | None, str]:
        """The map of one chunk after another."""
        if y[1] is None:
            seam = self.chunk_map(x[0] + y[0] if x[1] is None else x[2] + y[0])
            if x[1] is None:
                return seam
            if seam[1] is None:
                return x[0], x[1], seam[0]
            return x[0], x[1] + self._sum(seam[0]) + seam[1], seam[2]
        if x[1] is None:
            seam = self.chunk_map(x[0] + y[0])
            if seam[1] is None:
                return seam[0], y[1], y[2]
            return seam[0], seam[1] + self._sum(seam[2]) + y[1], y[2]
        return x[0], x[1] + self._sum(x[2] + y[0]) + y[1], y[2]

    def _sum(self, text: str) -> int:
        return int(self.count_whole([text])[0])


def _printable() -> dict[int, int]:
    """The code point that stands for each byte in byte-level vocabularies."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: b for b in own} | {b: 256 + i for i, b in enumerate(rest)}


def machine_source(spark, path: str) -> Callable[[], Machine]:
    """What a task calls to get the machine; the file is read on the driver."""
    with open(path, "rb") as f:
        content = f.read()
    held = spark.sparkContext.broadcast(content)
    name = "machine-" + hashlib.md5(content).hexdigest()
    return lambda: per_process(name, lambda: Machine(held.value))


def token_counts(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``df`` and ``n_tokens``; null and empty texts have none.

    A column ``n_tokens`` of ``df`` is replaced, all others pass unchanged.
    """
    small_batches(df.sparkSession)
    machine = machine_source(df.sparkSession, path)
    kept = [c for c in df.columns if c != "n_tokens"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        column = batch.column(names.index(text))
        out = [
            machine().count([t or "" for t in column[a:b].to_pylist()])
            for a, b in cut(column)
        ]
        arrays = [batch.column(names.index(c)) for c in kept]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(np.concatenate(out), pa.int64())], names=[*kept, "n_tokens"]
        )

    return map_batches(df, run, df.select(*kept).schema.add("n_tokens", "long"))


def byte_sizes(column: pa.Array) -> np.ndarray:
    return np.diff(Texts(column).offsets)
