"""The corpus pipeline: documents in, clean, mixed and encoded documents out.

Each stage reads all rows its predecessor kept.  All but the last return the
columns of ``documents``.  An empty table gives an empty table of the same
columns; null texts count as empty; repeated rows fall to the near-duplicate
stage; extra columns pass through the filters.
"""

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matterlake.llm import bpe, mixing, neardup, quality, toxicity
from matterlake.llm.queries import (
    GOOD_FROM,
    TOXIC_FROM,
    quality_held_out,
    toxic_held_out,
)
from matterlake.plans.storage import written

_SCORE = "_pipeline_score"


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/labels.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold."""
    model = toxicity.fit(docs, _labels(spark, sf_dir), ~toxic_held_out())
    scored = toxicity.score(docs, model, _SCORE)
    return scored.where(F.col(_SCORE) < TOXIC_FROM).select(*docs.columns)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that reach the quality threshold."""
    net = quality.fit(docs, _labels(spark, sf_dir), ~quality_held_out())
    scored = quality.score(docs, net, _SCORE)
    return scored.where(F.col(_SCORE) >= GOOD_FROM).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class."""
    return neardup.deduplicated(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of the sources, documents repeated by epoch."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the token ids and their number."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    encoded = bpe.encode(docs, path, public_tokenizers.PATTERN)
    return encoded.select(
        "doc_id", "lang", "source", "ids", F.size("ids").cast("long").alias("n_tokens")
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("encoding", encode),
]

# Trained classifiers decide what stays, which SQL cannot express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
