"""Distances between counts and between vectors."""

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# The bands of a document match.
EXACT_WORD_SHARE = 0.01
CLOSE_PARAGRAPHS = 2
CLOSE_PARAGRAPH_SHARE = 0.1
CLOSE_WORDS = 20
CLOSE_WORD_SHARE = 0.05
LOOSE_WORD_SHARE = 0.5
TIER_RANKS = {"exact": 0, "close": 1, "loose": 2}


def count_delta(a: Column, b: Column) -> Column:
    return F.abs(a - b)


def pct_delta(a: Column, b: Column) -> Column:
    """|a - b| as a share of the larger one; 0 when both are 0."""
    larger = F.greatest(a, b)
    share = F.try_divide(F.abs(a - b).cast("double"), larger.cast("double"))
    return F.when(larger == 0, F.lit(0.0)).otherwise(share)


def match_tier(
    stored_paragraphs: Column,
    stored_words: Column,
    paragraphs: Column,
    words: Column,
) -> Column:
    """``exact``, ``close`` or ``loose``; null when the sizes are too far apart."""
    paragraph_gap = count_delta(stored_paragraphs, paragraphs)
    word_gap = count_delta(stored_words, words)
    word_share = pct_delta(stored_words, words)
    paragraph_band = F.greatest(
        F.lit(CLOSE_PARAGRAPHS),
        F.ceil(paragraphs.cast("double") * F.lit(CLOSE_PARAGRAPH_SHARE)),
    )
    word_band = F.greatest(
        F.lit(float(CLOSE_WORDS)), words.cast("double") * F.lit(CLOSE_WORD_SHARE)
    )
    return (
        F.when((paragraph_gap == 0) & (word_share <= EXACT_WORD_SHARE), "exact")
        .when((paragraph_gap <= paragraph_band) & (word_gap <= word_band), "close")
        .when(word_share <= LOOSE_WORD_SHARE, "loose")
    )


def tier_rank(tier: Column) -> Column:
    ranked = F.lit(None).cast("int")
    for name, rank in TIER_RANKS.items():
        ranked = F.when(tier == name, F.lit(rank)).otherwise(ranked)
    return ranked


def combined_delta(
    stored_paragraphs: Column,
    stored_words: Column,
    paragraphs: Column,
    words: Column,
) -> Column:
    gap = count_delta(stored_paragraphs, paragraphs).cast("double")
    return gap + pct_delta(stored_words, words) * F.lit(100.0)


def tiers_of_arrays(
    stored_paragraphs: np.ndarray,
    stored_words: np.ndarray,
    paragraphs: np.ndarray,
    words: np.ndarray,
) -> tuple[np.ndarray, np.ndarray]:
    """``tier_rank`` of ``match_tier`` (3: none) and ``combined_delta`` of arrays."""
    paragraph_gap = np.abs(stored_paragraphs - paragraphs)
    word_gap = np.abs(stored_words - words)
    larger = np.maximum(stored_words, words)
    share = word_gap / np.where(larger == 0, 1.0, larger)
    paragraph_band = np.maximum(CLOSE_PARAGRAPHS, np.ceil(paragraphs * CLOSE_PARAGRAPH_SHARE))
    word_band = np.maximum(float(CLOSE_WORDS), words * CLOSE_WORD_SHARE)
    rank = np.where(share <= LOOSE_WORD_SHARE, np.int8(2), np.int8(3))
    rank[(paragraph_gap <= paragraph_band) & (word_gap <= word_band)] = 1
    rank[(paragraph_gap == 0) & (share <= EXACT_WORD_SHARE)] = 0
    return rank, paragraph_gap + share * 100.0


def _dot(u: Column, v: Column) -> Column:
    products = F.zip_with(u, v, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def cosine_distance(u: Column, v: Column) -> Column:
    """1 - cosine, in double; null for unequal lengths and for zero vectors."""
    norms = F.sqrt(_dot(u, u)) * F.sqrt(_dot(v, v))
    distance = F.lit(1.0) - F.try_divide(_dot(u, v), norms)
    return F.when(F.size(u) == F.size(v), distance)


def similarity(distance: Column) -> Column:
    return F.when(
        distance.isNotNull(), F.greatest(F.lit(0.0), F.lit(1.0) - distance)
    )
