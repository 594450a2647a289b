"""Versioned positions: golden rows, hot keys, writes, isolation."""

import random

from conftest import plan_of
from pyspark.sql import functions as F

from matterlake.operators import positions as P
from matterlake.plans.skew import hot_keys, top_per_group, with_neighbours

NAMES = "id string, firm_id string, matter_id string, clause_type string, created_at int, seq int"


def rows(spark, data):
    return spark.createDataFrame(data, NAMES)


def test_golden_chain(spark):
    df = rows(
        spark,
        [
            ("p1", "f", "m", "liability_cap", 1, 0),
            ("p2", "f", "m", "liability_cap", 2, 0),
            ("p3", "f", "m", "liability_cap", 2, 1),
            ("p4", "f", "m", "governing_law", 2, 2),
        ],
    )
    got = {r["id"]: (r["superseded_by"], r["version"]) for r in P.supersede(df).collect()}
    assert got == {"p1": ("p2", 1), "p2": ("p3", 2), "p3": (None, 3), "p4": (None, 1)}


def _skewed(spark, n=3000, seed=7):
    """A third of the rows in one key, all with the same time."""
    r = random.Random(seed)
    data = []
    for i in range(n):
        if i % 3 == 0:
            data.append((f"p{i:05d}", "f", "hot", "c", 5, r.randrange(3)))
        else:
            data.append((f"p{i:05d}", "f", f"m{r.randrange(50)}", "c", r.randrange(9), 0))
    return rows(spark, data)


def test_hot_key_slices_give_the_same_links(spark):
    df = _skewed(spark)
    plain = {tuple(r) for r in P.supersede(df).collect()}
    assert hot_keys(df, P.KEY, 200)[1] == 1000
    sliced = P.supersede(df, hot_rows=200, slice_rows=90)
    assert {tuple(r) for r in sliced.collect()} == plain
    counts = P.current(sliced).groupBy(*P.KEY).count().where("count <> 1")
    assert counts.count() == 0


def test_hot_slices_are_small(spark):
    df = _skewed(spark)
    found = with_neighbours(df, P.KEY, P.ORDER, "id", hot_rows=200, slice_rows=100)
    hot = found.where("matter_id = 'hot'").orderBy("version")
    versions = [r["version"] for r in hot.collect()]
    assert versions == list(range(1, 1001))


def test_latest_equals_current(spark):
    df = _skewed(spark)
    a = {r["id"] for r in P.latest(df).collect()}
    b = {r["id"] for r in P.current(P.supersede(df)).collect()}
    assert a == b
    assert "WindowGroupLimit" in plan_of(P.latest(df))


def test_no_window_without_a_key(spark):
    plan = plan_of(P.supersede(_skewed(spark)))
    assert plan.count("Exchange") == 1 and "SinglePartition" not in plan


def test_write_positions_closes_every_current_row(spark):
    stored = rows(
        spark,
        [
            ("a1", "f", "m", "c", 1, 0),
            ("a2", "f", "m", "c", 2, 0),
            ("b1", "f", "m", "d", 1, 0),
            ("x1", "g", "m", "c", 1, 0),
        ],
    ).withColumn(
        "superseded_by", F.when(F.col("id") == "a0", "a1")
    )  # a1 and a2 are both current
    batch = rows(spark, [("n1", "f", "m", "c", 3, 0), ("n2", "f", "m", "c", 3, 1)])
    got = {
        r["id"]: r["superseded_by"] for r in P.write_positions(stored, batch).collect()
    }
    assert got == {
        "a1": "n1",
        "a2": "n1",
        "b1": None,
        "x1": None,
        "n1": "n2",
        "n2": None,
    }
    counts = P.write_counts(stored, batch).collect()
    assert [tuple(r) for r in counts] == [("f", 2, 3)]


def test_normalise_positions(spark):
    raw = spark.createDataFrame(
        [(None, "12 months", "agreed", "them", "x" * 2500, "1.7")],
        "clause_type string, value string, status string, party_role string, "
        "source_chunk_text string, confidence string",
    )
    r = P.normalise_positions(raw).first()
    assert (r["clause_type"], r["value"], r["status"]) == (
        "other",
        '{"raw":"12 months"}',
        "open",
    )
    assert r["party_role"] is None and r["confidence"] == 1.0
    assert len(r["source_chunk_text"]) == 2500
    cut = P.normalise_positions(raw, excerpt_chars=2000).first()
    assert len(cut["source_chunk_text"]) == 2000


def test_top_per_group_limits_before_the_shuffle(spark):
    df = _skewed(spark)
    top = top_per_group(df, ["matter_id"], [F.col("id").asc()], 3)
    plan = plan_of(top)
    assert plan.count("WindowGroupLimit") == 2
    assert top.groupBy("matter_id").count().where("count > 3").count() == 0
