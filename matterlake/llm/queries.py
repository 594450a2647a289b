"""One query per operator, over its whole table with production parameters."""

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matterlake.llm import (
    bpe,
    collocations,
    htmltext,
    licenses,
    manifest,
    mixing,
    neardup,
    packing,
    quality,
    search,
    simhash,
    tokencount,
    toxicity,
)
from matterlake.llm.labelled import fold

TOP_K = 10
TOXIC_FROM = 0.5
GOOD_FROM = 0.7
TOKEN_LIMIT = 1024
EVERY = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmltext.extract(pages).withColumn("n_chars", F.length("text").cast("long"))


def op2_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.against_edit(_table(spark, sf_dir, "documents"))


def op3_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    asked = docs.where(F.col("doc_id") % EVERY == 0)
    hits = search.search(search.build_index(docs), asked, TOP_K)
    return hits.select(
        F.col("query_id").alias("doc_id"),
        "rank",
        F.col("doc_id").alias("hit_doc_id"),
        "score",
    )


def toxic_held_out() -> Column:
    return fold(F.col("doc_id"), 5) == 0


def quality_held_out() -> Column:
    return fold(F.col("doc_id"), 4) == 2


def _judged(scored: DataFrame, held_out: Column, least: float) -> DataFrame:
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= least).cast("int").alias("predicted"),
    )


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, _table(spark, sf_dir, "labels"), ~toxic_held_out())
    return _judged(toxicity.score(docs, model), toxic_held_out(), TOXIC_FROM)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    net = quality.fit(docs, _table(spark, sf_dir, "labels"), ~quality_held_out())
    return _judged(quality.score(docs, net), quality_held_out(), GOOD_FROM)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    path = public_tokenizers.path("byte_bpe_50k.json")
    return tokencount.token_counts(docs, path).select(
        "doc_id",
        F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit"),
    )


def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.classes(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    families = F.array_sort(F.array_distinct(F.transform("licenses", lambda x: x["family"])))
    return found.select(
        "doc_id",
        "n_paragraphs",
        F.size("licenses").cast("long").alias("n_licensed"),
        F.array_join(families, ",").alias("families"),
    )


def op11_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return packing.packed(_table(spark, sf_dir, "documents"), path)


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest.manifest(_table(spark, sf_dir, "documents"))


def op13_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(_table(spark, sf_dir, "documents"))


OPERATORS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction,
        op2_document_fingerprints,
        op3_topk_search,
        op4_toxicity,
        op5_byte_bpe,
        op6_quality,
        op7_source_mixing,
        op8_token_counts,
        op9_near_duplicates,
        op10_license_scan,
        op11_best_fit_packing,
        op12_merkle_manifest,
        op13_phrase_collocations,
    )
}


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return {**OPERATORS, "pipeline": corpus_pipeline.run}


def oracles() -> dict[str, str]:
    import corpus_pipeline
    from matterlake.llm import oracle

    own = {
        "op3_topk_search": oracle.TOPK_SEARCH,
        "op7_source_mixing": oracle.SOURCE_MIXING,
        "op12_merkle_manifest": oracle.MERKLE_MANIFEST,
        "op13_phrase_collocations": oracle.PHRASE_COLLOCATIONS,
    }
    if corpus_pipeline.ORACLE_SQL is not None:
        own["pipeline"] = corpus_pipeline.ORACLE_SQL
    return own
