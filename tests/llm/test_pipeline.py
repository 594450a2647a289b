"""The pipeline stage by stage against its operators, and the registered names."""

from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from matterlake.llm import neardup, quality, toxicity
from matterlake.llm.queries import quality_held_out, toxic_held_out

SF = "/root/testdata/sf0.001"


def test_registered():
    names = [n for n in __spark_entry__.queries() if n.startswith("op") and n[2].isdigit()]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert "pipeline" in __spark_entry__.queries()


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    ids = lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    model = toxicity.fit(docs, labels, ~toxic_held_out())
    clean = corpus_pipeline.drop_toxic(spark, docs, SF)
    assert clean.columns == docs.columns
    assert ids(clean) == ids(toxicity.score(docs, model).where("score < 0.5"))
    net = quality.fit(docs, labels, ~quality_held_out())
    good = corpus_pipeline.keep_good(spark, docs, SF)
    assert ids(good) == ids(quality.score(docs, net).where("score >= 0.7"))
    single = corpus_pipeline.drop_near_duplicates(spark, docs, SF)
    classes = neardup.classes(docs).select("class_id").distinct()
    assert ids(single) == sorted(r.class_id for r in classes.collect())


def test_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "lang", "source", "ids", "n_tokens"]
    assert out.where(F.size("ids") != F.col("n_tokens")).count() == 0
    assert out.count() > 0
