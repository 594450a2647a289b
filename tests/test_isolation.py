"""A firm's requests never bring rows of another firm."""

import pytest
from pyspark.sql import functions as F

from matterlake.functions import models
from matterlake.operators import counterparties as CP
from matterlake.operators import handoffs as H
from matterlake.operators import matters as MT
from matterlake.operators import positions as P
from matterlake.operators import resolution as R
from matterlake.operators import textmodel as TM
from matterlake.operators import vectors as V
from matterlake.plans import intake as I
from matterlake.workload.q_documents import signals_of, stored_handoffs
from matterlake.workload.registry import Source

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def s(spark):
    return Source(spark, SF)


def two_firms(df):
    """Every row twice: for firm A, and for firm B with the same ids."""
    b = [
        F.concat(F.lit("B-"), F.col(c)).alias(c)
        if c in ("content", "matter_name", "summary", "value")
        else F.col(c)
        for c in df.columns
        if c != "firm_id"
    ]
    a = df.drop("firm_id").withColumn("firm_id", F.lit("A"))
    return a.unionByName(df.select(*b).withColumn("firm_id", F.lit("B")))


def only_a(df):
    assert df.count() > 0
    if "firm_id" in df.columns:
        assert df.where("firm_id <> 'A'").count() == 0
    for name, kind in df.dtypes:
        if kind == "string":
            assert df.where(F.col(name).startswith("B-")).count() == 0


def of_a(df):
    return df.withColumn("firm_id", F.lit("A"))


def test_resolution(s):
    answers = R.resolve_documents(
        of_a(s.hints), two_firms(s.named_docs), two_firms(s.named_matters)
    )
    only_a(answers)
    # Ids repeat in both firms: each request still has one answer.
    assert answers.count() == s.hints.count()
    alone = R.resolve_documents(
        of_a(s.hints), of_a(s.named_docs), of_a(s.named_matters)
    )
    assert answers.exceptAll(alone).count() == 0


def test_handoffs(s):
    both = two_firms(stored_handoffs(s.sized))
    only_a(H.match_handoffs(of_a(signals_of(s.sized)), both))


def test_counterparties_and_matters(s):
    linked = P.supersede(two_firms(s.positions))
    matters = two_firms(s.matters)
    asked = of_a(s.asked_parties)
    only_a(CP.counterparty_history(asked, matters, linked))
    only_a(CP.counterparty_positions(asked, linked))
    requests = of_a(s.matters).select(
        F.col("id").alias("request_id"), "firm_id", F.col("id").alias("matter_id")
    )
    only_a(MT.matters_for(requests, matters))


def test_search(s):
    embed = models.hashing_embedder(32)
    memory = TM.embed(two_firms(s.turns), embed, text="content")
    asked = of_a(s.questions).withColumn("matter_id", F.lit(None).cast("string"))
    only_a(I.search_text(asked, memory, embed, k=3))


def test_supersession_keeps_firms_apart(s):
    linked = P.supersede(two_firms(s.positions).withColumn(
        "id", F.concat("firm_id", F.lit("-"), "id")
    ))
    crossed = linked.where(
        F.col("superseded_by").isNotNull()
        & (F.substring("superseded_by", 1, 1) != F.substring("id", 1, 1))
    )
    assert crossed.count() == 0


def same_ids(df):
    """Every request twice: from firm A and from firm B, under one id."""
    b = df.withColumn("firm_id", F.lit("B"))
    return of_a(df).unionByName(b)


def per_firm(df, firm):
    rows = df.where(F.col("firm_id") == firm).drop("firm_id").collect()
    return sorted(str(r) for r in rows)


def alike(ask, requests):
    """Two firms asking under one id get what each gets alone."""
    both = ask(same_ids(requests))
    for firm in ("A", "B"):
        alone = ask(requests.withColumn("firm_id", F.lit(firm)))
        assert per_firm(both, firm) == per_firm(alone, firm)
        assert alone.count() > 0


def test_equal_request_ids_resolution(s):
    docs, matters = two_firms(s.named_docs), two_firms(s.named_matters)
    alike(lambda h: R.resolve_documents(h, docs, matters), s.hints)


def test_equal_request_ids_handoffs(s):
    stored = two_firms(stored_handoffs(s.sized))
    asked = signals_of(s.sized)
    alike(lambda r: H.match_handoffs(r, stored), asked)
    alike(lambda r: H.update_targets(r, stored), asked)


def test_equal_request_ids_vectors(spark):
    memory = spark.createDataFrame(
        [(f"{f}{i}", f, None, [float(i), 1.0]) for f in "AB" for i in range(5)],
        "id string, firm_id string, matter_id string, embedding array<double>",
    )
    asked = spark.createDataFrame(
        [("r", None, [1.0, 0.0])],
        "request_id string, matter_id string, embedding array<double>",
    ).withColumn("firm_id", F.lit("A"))
    alike(lambda r: V.vector_topk(r, memory, k=3), asked)
    assert V.vector_topk(same_ids(asked), memory, k=3).count() == 6


def test_equal_request_ids_counterparties(s):
    matters = two_firms(s.matters)
    alike(lambda r: CP.matter_counts(r, matters), s.asked_parties)


def test_a_name_behind_many_newer_matters_is_found(spark):
    matters = spark.createDataFrame(
        [(f"m{i}", "A", f"matter number n{i:04d}x", None, f"2024-01-01 00:{i // 60:02d}:{i % 60:02d}") for i in range(600)],
        "id string, firm_id string, matter_name string, client_name string, created_at string",
    )
    hints = spark.createDataFrame(
        [("r", "A", None, "about matter number n0005x today")],
        "request_id string, firm_id string, document_name string, content_snippet string",
    )
    assert [r.matter_id for r in R.by_names_in_hint(hints, matters).collect()] == ["m5"]
    assert R.by_names_in_hint(hints, matters, newest=500).count() == 0
