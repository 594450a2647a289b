"""Byte-level BPE encoding and decoding as a tree reduction.

A text is halved until a part is a leaf, leaves are encoded, and neighbours are
joined: tokens near the seam are re-encoded over a window that grows until both
its ends are places where the pattern must start a new match whatever stands
around them.  Merges never cross matches, so the tokens outside stand.

Where the window cannot end inside a part (one match fills it), it takes the
part whole.  Decoding concatenates bytes up the same tree.
"""

import base64
import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType

from matterlake.llm.blocks import map_batches, per_process, small_batches

LEAF = 4096
WINDOW = 32

# Places at which every split of the pattern starts a match: blank after
# non-blank, and the end of a run of letters or of digits.  No match of the
# pattern holds such a pair of neighbours, and no lookahead crosses it: the only
# one asks about blanks at the end of a run, which starts no earlier than here.
SEAM = regex.compile(r"(?<=\S)(?=\s)|(?<=\p{L})(?=\P{L})|(?<=\p{N})(?=\P{N})")

Ids = np.ndarray


def read_ranks(content: bytes) -> dict[bytes, int]:
    pairs = (line.split() for line in content.splitlines() if line)
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


class TreeCodec:
    """Encodes and decodes with the ranks of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF):
        self._plain = tiktoken.Encoding(
            "ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}
        )
        self._leaf = max(2, leaf)
        self.size = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.size[rank] = len(token)

    def _encode_part(self, text: str) -> Ids:
        # No special tokens are registered, so this is ordinary encoding.
        return self._plain.encode_to_numpy(text)

    def encode(self, text: str) -> Ids:
        return self._tree(text, 0, len(text))

    def _tree(self, text: str, a: int, b: int) -> Ids:
        if b - a <= self._leaf:
            return self._encode_part(text[a:b])
        middle = (a + b) // 2
        return self._join(
            text, a, middle, b, self._tree(text, a, middle), self._tree(text, middle, b)
        )

    def _join(self, text: str, a: int, m: int, b: int, left: Ids, right: Ids) -> Ids:
        start, end = self._left_end(text, a, m), self._right_end(text, m, b)
        keep = self._count(left[::-1], len(text[start:m].encode()))
        skip = self._count(right, len(text[m:end].encode()))
        window = self._encode_part(text[start:end])
        return np.concatenate((left[: len(left) - keep], window, right[skip:]))

    def _left_end(self, text: str, a: int, m: int) -> int:
        """The last seam in a window before ``m``; the window doubles."""
        width = WINDOW
        while width < m - a:
            # A seam looks at both neighbours; the last one must be left of m.
            spots = [s.start() for s in SEAM.finditer(text, m - width, m)]
            spots = [s for s in spots if m - width < s < m]
            if spots:
                return spots[-1]
            width *= 2
        return a

    def _right_end(self, text: str, m: int, b: int) -> int:
        width = WINDOW
        while width < b - m:
            for s in SEAM.finditer(text, m, m + width):
                if m < s.start() < m + width:
                    return s.start()
            width *= 2
        return b

    def _count(self, ids: Ids, n_bytes: int) -> int:
        """How many leading ids make ``n_bytes`` bytes (a match border)."""
        if not n_bytes:
            return 0
        guess = 64
        while True:
            sums = np.cumsum(self.size[ids[:guess]])
            if sums[-1] >= n_bytes or guess >= len(ids):
                at = int(np.searchsorted(sums, n_bytes))
                if at >= len(sums) or sums[at] != n_bytes:
                    raise AssertionError("a seam is no token border")
                return at + 1
            guess *= 4

    def decode(self, ids: Ids) -> bytes:
        if len(ids) <= self._leaf:
            return self._plain.decode_bytes(ids.tolist())
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


def codec_source(spark, path: str, pattern: str) -> Callable[[], TreeCodec]:
    """What a task calls to get the codec; the file is read on the driver only."""
    with open(path, "rb") as f:
        content = f.read()
    held = spark.sparkContext.broadcast(content)
    name = "bpe-" + hashlib.md5(content + pattern.encode()).hexdigest()
    return lambda: per_process(name, lambda: TreeCodec(read_ranks(held.value), pattern))


def encode(df: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """``df`` and ``ids`` (array of int); null and empty texts have no ids.

    ``df`` must not have a column ``ids`` of its own worth keeping: it is
    replaced.  All other columns pass unchanged.
    """
    spark = df.sparkSession
    small_batches(spark)
    codec = codec_source(spark, path, pattern)
    kept = [c for c in df.columns if c != "ids"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        own = [codec().encode(t or "") for t in batch.column(names.index(text)).to_pylist()]
        flat = np.concatenate(own).astype(np.int32)
        offsets = np.cumsum([0, *map(len, own)], dtype=np.int32)
        ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
        return pa.RecordBatch.from_arrays(
            [*[batch.column(names.index(c)) for c in kept], ids], names=[*kept, "ids"]
        )

    return map_batches(df, run, df.select(*kept).schema.add("ids", ArrayType(IntegerType())))


def decode(df: DataFrame, path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """``df`` and ``decoded`` (binary): the bytes of ``ids``; null: no bytes."""
    spark = df.sparkSession
    codec = codec_source(spark, path, pattern)
    kept = [c for c in df.columns if c != "decoded"]

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        names = batch.schema.names
        column = batch.column(names.index(ids))
        out = []
        for i in range(len(column)):
            value = column[i].values
            out.append(b"" if value is None else codec().decode(value.to_numpy(zero_copy_only=False)))
        arrays = [batch.column(names.index(c)) for c in kept]
        return pa.RecordBatch.from_arrays(
            [*arrays, pa.array(out, pa.binary())], names=[*kept, "decoded"]
        )

    return map_batches(df, run, df.select(*kept).schema.add("decoded", "binary"))


def round_trip(df: DataFrame, path: str, pattern: str) -> DataFrame:
    """Digests of encoding and decoding: the ids never leave the task.

    Per row: doc_id, n_tokens, ids_sha256 (ids as little-endian unsigned
    32-bit integers) and decoded_sha256.
    """
    spark = df.sparkSession
    small_batches(spark)
    codec = codec_source(spark, path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, first, second = [], [], []
        for t in batch.column(1).to_pylist():
            ids = codec().encode(t or "")
            n.append(len(ids))
            first.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            second.append(hashlib.sha256(codec().decode(ids)).hexdigest())
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.array(first), pa.array(second)],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )

    slim = df.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text")
    return map_batches(
        slim, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )
