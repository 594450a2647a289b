"""Plans of registered queries: no pair products, pruned scans, early limits."""

import sys
from collections import Counter
from pathlib import Path

import pytest
from conftest import plan_of
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
import __spark_entry__ as entry_module  # noqa: E402

from matterlake.operators import counterparties as CP  # noqa: E402
from matterlake.plans.skew import _packed, product_join  # noqa: E402
from matterlake.workload import catalogue  # noqa: E402

SF = "/root/testdata/sf0.001"
JOINS = (
    "counterparty_positions counterparty_history resolve_by_document_name "
    "resolve_by_matter_name resolve_by_names_in_hint match_handoffs matter_positions "
    "authorised_pairs tag_matters_by_user backfill_candidates first_redemptions "
    "supersede_hot_keys vector_topk_blocks"
).split()
LIMITED = (
    "latest_positions matter_directory_page resolve_by_office_id first_redemptions "
    "oldest_pending newest_orders_null_first"
).split()


def plan(spark, name):
    return plan_of(entry_module.queries()[name](spark, SF))


@pytest.mark.parametrize("name", JOINS)
def test_no_pair_product(spark, name):
    shown = plan(spark, name)
    assert "Cartesian" not in shown and "NestedLoop" not in shown


@pytest.mark.parametrize("name", LIMITED)
def test_rank_filters_run_before_the_shuffle(spark, name):
    assert "Partial" in plan(spark, name).split("WindowGroupLimit", 1)[1]


def test_one_firm_scan_is_narrow(spark):
    shown = plan(spark, "scan_one_firm")
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint>" in shown
    assert "Exchange" not in shown


def test_every_query_but_two_has_sql():
    # The library's own queries; the optional ones are tested with their folder.
    missing = set(catalogue.callables()) - set(catalogue.oracles())
    assert missing == {"tighten_edits", "tighten_turns"}
    assert not set(entry_module.oracle_sql()) - set(entry_module.queries())


@pytest.mark.parametrize("name", ["position_history_bucketed", "current_positions_bucketed"])
def test_bucketed_windows_shuffle_nothing(spark, name):
    assert "Exchange" not in plan(spark, name)


@pytest.mark.parametrize("name", ["position_history", "open_positions", "settled_positions"])
def test_lists_have_no_global_sort(spark, name):
    assert "rangepartitioning" not in plan(spark, name)


def test_product_join_cuts_a_key_with_many_rows_on_both_sides(spark):
    left = spark.createDataFrame([("k", a) for a in range(40)], "key string, a long")
    right = spark.createDataFrame([("k", b) for b in range(30)], "key string, b long")
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("n_left"))
    joined = product_join(left, right, ["key"], counts, task_rows=100)
    rows = joined.withColumn("part", F.spark_partition_id()).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [
        (a, b) for a in range(40) for b in range(30)
    ]
    sizes = Counter(r["part"] for r in rows)
    assert len(sizes) > 3 and max(sizes.values()) <= 600


def rows_shuffled(df) -> int:
    """Rows that the exchanges of an executed plan wrote."""

    def walk(node) -> int:
        own = node.metrics().get("shuffleRecordsWritten") if node.nodeName() == "Exchange" else None
        below = node.children()
        return (own.get().value() if own is not None else 0) + sum(
            walk(below.apply(i)) for i in range(below.size())
        )

    return walk(df._jdf.queryExecution().executedPlan())


def test_product_join_copies_neither_side_to_every_slice(spark):
    left = spark.createDataFrame([("k", a) for a in range(300)], "key string, a long")
    right = spark.createDataFrame([("k", b) for b in range(200)], "key string, b long")
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("n_left"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = product_join(left, right, ["key"], counts, task_rows=100)
        rows = Counter((r["a"], r["b"]) for r in joined.collect())
        # 600 cells: each side goes to the cells of its row or column alone.
        assert rows_shuffled(joined) < 20_000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert rows == Counter((a, b) for a in range(300) for b in range(200))


def test_product_join_keeps_equal_rows_and_nulls(spark):
    left = spark.createDataFrame(
        [("k", 1), ("k", 1), ("k", None), (None, 2), ("l", 3), ("only", 4)], "key string, a long"
    )
    pairs = [("k", "r", None)] * 50 + [("k", None, "x"), ("k", "s", "x"), (None, "t", None), ("l", "u", "y")]
    right = spark.createDataFrame(pairs, "key string, b string, c string")
    counts = left.groupBy("key").agg(F.count(F.lit(1)).alias("n_left"))
    joined = product_join(left, right, ["key"], counts, task_rows=40, apart=["c"])
    assert set(joined.columns) == {"key", "a", "b", "c"}
    want = Counter(
        (k, a, b, c) for k, a in [("k", 1), ("k", 1), ("k", None), ("l", 3)]
        for other, b, c in pairs if other == k
    )
    assert Counter((r["key"], r["a"], r["b"], r["c"]) for r in joined.collect()) == want


def test_packs_are_bounded(spark):
    rows = spark.createDataFrame([("k", "same")] * 500 + [("l", "x")], "key string, b string")
    packs = _packed(rows.coalesce(1), ["key"], 16).collect()
    assert max(len(p["_pack"]) for p in packs) <= 16 and len(packs) <= 34
    assert sum(p["_n"] for p in packs if p["key"] == "k") == 500


def test_positions_are_linked_once_for_counterparties(spark):
    # The links are used for the names and for the rows: the last plan reads them.
    assert "Window" not in plan(spark, "counterparty_positions")


def test_requests_that_ask_the_same_share_the_work(spark):
    matters = spark.createDataFrame(
        [(f"m{i}", "f", "England", '[{"name":"Acme Corp","role":"supplier"}]') for i in range(20)],
        "id string, firm_id string, governing_law string, parties string",
    )
    for c in ("user_id", "client_id", "client_name", "matter_name", "deal_parameters",
              "context", "stage", "privilege_scope"):
        matters = matters.withColumn(c, F.lit(None).cast("string"))
    for c in ("created_at", "last_accessed"):
        matters = matters.withColumn(c, F.lit(None).cast("timestamp_ntz"))
    matters = matters.withColumn("archived", F.lit(False))
    positions = spark.createDataFrame(
        [], "id string, firm_id string, matter_id string, clause_type string, value string, "
        "status string, counterparty_name string, superseded_by string")
    asked = [(f"r{i:02d}", "f", "acme", None) for i in range(30)]
    # One request with rows for two parties and with two clauses.
    asked += [("two", "f", "acme", None), ("two", "f", "corp", None), ("two", "f", "corp", "sla")]
    ask = spark.createDataFrame(
        asked, "request_id string, firm_id string, counterparty string, clause_type string")
    found = CP._asked_matters(ask, CP._asks(ask, "request_id", "firm_id"), matters)
    assert found.count() == 2 * 20  # not one row per request and matter
    rows = Counter(r["request_id"] for r in CP.counterparty_history(ask, matters, positions).collect())
    assert rows == {r: 20 for r, *_ in asked}
    counts = {r["request_id"]: r["n_settled"] for r in CP.clause_counts(ask, matters, positions).collect()}
    assert counts == dict(rows)
    numbers = {r["request_id"]: r["matter_count"] for r in CP.matter_counts(ask, matters).collect()}
    assert numbers == dict(rows)
