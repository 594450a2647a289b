"""Pluggable model functions and their offline stand-ins.

``embed_fn(texts) -> (vectors, total_tokens or None)`` and
``extract_fn(text) -> (positions, input_tokens, output_tokens)`` run inside
tasks.  Any exception is tried again, ``PermanentFailure`` is not.
"""

import hashlib
import re
import time
from collections.abc import Callable
from itertools import zip_longest

import numpy as np

from matterlake import schemas as S

FIRST_PAUSE = 0.5

EmbedFn = Callable[[list[str]], tuple[list, int | None]]
ExtractFn = Callable[[str], tuple[list[dict], int, int]]


class PermanentFailure(Exception):
    """The input will fail again (a client error other than a rate limit)."""


def hashing_embedder(dims: int = 256) -> EmbedFn:
    """Feature hashing of lower-case ASCII words, scaled to length 1."""
    word = re.compile("[a-z0-9]+")
    buckets: dict[str, int] = {}

    def bucket(token: str) -> int:
        if token not in buckets:
            digest = hashlib.md5(token.encode(), usedforsecurity=False).hexdigest()
            if len(buckets) > 100_000:
                buckets.clear()
            buckets[token] = int(digest[:8], 16) % dims
        return buckets[token]

    def embed(texts: list[str]) -> tuple[list, int | None]:
        out = []
        for text in texts:
            hits = [bucket(t) for t in word.findall(text.lower())]
            vector = np.bincount(hits, minlength=dims).astype(np.float64)
            norm = np.sqrt((vector * vector).sum())
            out.append((vector / norm if norm > 0 else vector).astype(np.float32))
        return out, None

    return embed


def embed_batch(
    texts: list[str],
    embed_fn: EmbedFn,
    attempts: int = S.EMBED_ATTEMPTS,
    pause: float = FIRST_PAUSE,
) -> list[tuple]:
    """[(vector or None, tokens, error or None)] in input order.

    Tokens are an even share of the reported total, else estimated.
    """
    answer, reason = _tried(lambda: embed_fn(texts), attempts, pause)
    if answer is None:
        return [(None, _approx_tokens(t), reason) for t in texts]
    vectors, total = answer
    share = -(-total // len(texts)) if total else 0
    rows = []
    for text, vector in zip_longest(texts, list(vectors)[: len(texts)]):
        tokens = share or _approx_tokens(text)
        if vector is None:
            rows.append((None, tokens, "no vector returned for this input"))
        else:
            rows.append(([float(x) for x in vector], tokens, None))
    return rows


def _tried(call: Callable[[], tuple], attempts: int, pause: float) -> tuple:
    """(what ``call`` returned, None) or (None, why the last attempt failed)."""
    for left in reversed(range(max(1, attempts))):
        try:
            return call(), None
        except PermanentFailure as e:
            return None, str(e)
        except Exception as e:  # isolated: the rows carry the error
            reason = str(e)
        if left:
            time.sleep(pause)
            pause *= 2
    return None, reason


def _approx_tokens(text: str) -> int:
    return -(-len(text) // S.CHARS_PER_TOKEN)
