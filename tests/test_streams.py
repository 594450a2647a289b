"""Streams over several files equal the batch operators on all rows."""

import pyarrow as pa
from pyspark.sql import functions as F

from matterlake.operators import positions as P
from matterlake.plans.storage import scratch_path
from matterlake.plans import deltas
from matterlake.streaming import handoffs as SH
from matterlake.streaming import jobs as J
from matterlake.streaming import supersession as SS
from matterlake.workload import q_streams
from matterlake.workload.registry import Source

EVENTS = (
    "id string, firm_id string, matter_id string, clause_type string, "
    "created_at timestamp, seq int"
)


def files(spark, name, parts, schema):
    """Each part becomes one file of a growing folder, oldest first."""
    path = scratch_path(spark, name)
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_supersession_over_batches(spark):
    n = 90
    at = F.timestamp_seconds(F.col("id") * 10)
    rows = spark.range(n).select(
        F.format_string("p%03d", "id").alias("id"),
        F.lit("f").alias("firm_id"),
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 7 != 2, F.concat(F.lit("m"), (F.col("id") % 7).cast("string")))
        .alias("matter_id"),
        F.lit("c").alias("clause_type"),
        at.alias("created_at"),
        F.lit(0).alias("seq"),
    )
    path = scratch_path(spark, "growing")
    for lo in range(0, n, 30):
        part = rows.where(f"id >= 'p{lo:03d}' and id < 'p{lo + 30:03d}'")
        part.coalesce(1).write.mode("append").parquet(path)
    stream = J.file_stream(spark, path, rows.schema, files_per_trigger=1)
    out, state = SS.fresh_paths(spark, "positions")
    # The hot key has ten rows in each batch; some matters are null in every batch.
    for _ in range(2):  # a second run finds nothing new
        SS.supersession_stream(stream, out, state, hot_rows=5, slice_rows=3)
    got = sorted((r["id"], r["superseded_by"]) for r in SS.links(spark, out).collect())
    batch = P.supersede(rows).where("superseded_by is not null")
    assert got == sorted((r["id"], r["superseded_by"]) for r in batch.collect())
    now = P.current(P.supersede(rows))
    held = SS.current_ids(spark, state).collect()
    assert len(held) == len(now.select(*P.KEY).distinct().collect())
    assert {tuple(r) for r in held} == {
        (r["firm_id"], r["matter_id"], r["clause_type"], r["id"]) for r in now.collect()
    }


def test_late_positions_supersede_in_order_of_arrival(spark):
    schema = "id string, firm_id string, matter_id string, clause_type string, s long, seq int"
    path = scratch_path(spark, "late-positions")

    def arrive(rows):
        spark.createDataFrame(rows, schema).select(
            "id", "firm_id", "matter_id", "clause_type",
            F.timestamp_seconds("s").alias("created_at"), "seq",
        ).write.mode("append").parquet(path)

    out, state = SS.fresh_paths(spark, "late")

    def drain():
        stream = J.file_stream(spark, path, spark.read.parquet(path).schema)
        SS.supersession_stream(stream, out, state)

    arrive([("a2", "f", "m", "c", 20, 0), ("a1", "f", "m", "c", 10, 0), ("x", "f", None, "c", 1, 0)])
    drain()
    arrive([("late", "f", "m", "c", 5, 0), ("other", "g", "m", "c", 5, 0)])
    drain()
    arrive([("y", "f", None, "c", 0, 1), ("y2", "f", None, "c", 0, 2)])
    drain()
    got = {(r["id"], r["superseded_by"]) for r in SS.links(spark, out).collect()}
    assert got == {("a1", "a2"), ("a2", "late"), ("x", "y"), ("y", "y2")}
    held = {r["id"] for r in SS.current_ids(spark, state).collect()}
    assert held == {"late", "other", "y2"}


def test_supersession_of_an_empty_stream(spark):
    empty = spark.createDataFrame([], EVENTS)
    path = scratch_path(spark, "none")
    empty.write.parquet(path)
    out, state = SS.fresh_paths(spark, "none")
    SS.supersession_stream(J.file_stream(spark, path, empty.schema), out, state)
    assert SS.links(spark, out).collect() == []


def test_intake_stream_handles_each_request_once(spark):
    schema = "id string, status string"
    path = files(
        spark, "requests", [[("j1", "pending"), ("j2", "completed")], [("j3", "pending")]],
        schema,
    )
    stream = J.file_stream(
        spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1
    )
    out, mark = scratch_path(spark, "ledger"), scratch_path(spark, "mark")
    handle = lambda rows: rows.withColumn("status", F.lit("completed"))
    for _ in range(2):  # a second run finds nothing new
        J.intake_stream(stream, handle, out, mark)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == ["j1", "j3"]


def test_handoff_stream_versions(spark):
    from test_resolution import handoff

    stored = handoff(spark, [("h1", "f", "MSA.docx", 10, 500, 1)])
    schema = (
        "request_id string, firm_id string, doc_title string, paragraph_count int, "
        "word_count int, summary string, turn_count int, user_id string"
    )
    path = files(
        spark,
        "updates",
        [
            [("r1", "f", "MSA v2.docx", 10, 501, "first", 1, "u")],
            [("r2", "f", "msa.docx", 11, 505, "second", 2, "u"),
             ("r3", "f", "New.docx", 1, 5, "other", 1, "u")],
        ],
        schema,
    )
    stream = J.file_stream(
        spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1
    )
    out = scratch_path(spark, "handoffs")
    SH.handoff_stream(stream, stored, out)
    table = SH.stored_handoffs(spark, out, stored.schema)
    got = sorted((r["doc_title"], r["summary"]) for r in table.collect())
    assert got == [("New.docx", "other"), ("msa.docx", "second")]
    assert {r["id"] for r in table.collect() if r["doc_title"] == "msa.docx"} == {"h1"}


LAYERED = "firm string, id int, value string"


def layered(spark, name, **more):
    schema = spark.createDataFrame([], LAYERED).schema
    return deltas.Layout(scratch_path(spark, name), schema, ("firm", "id"), ("id",), **more)


def change(spark, layout, version, rows):
    df = spark.createDataFrame(rows, LAYERED)
    deltas.commit(df, layout, version, deltas.touched_buckets(df, layout))


def test_layers_equal_a_table_changed_in_place(spark):
    import random

    rng = random.Random(2)
    layout = layered(spark, "layers", buckets=4, depth=2)
    held = {("f", i): f"v{i}" for i in range(40)} | {(None, 1): "no firm"}
    deltas.create(spark.createDataFrame([(*k, v) for k, v in held.items()], LAYERED), layout)
    for version in range(1, 6):
        rows = {(rng.choice(("f", None)), rng.randrange(50)): f"b{version}" for _ in range(5)}
        for _ in range(2 if version == 3 else 1):  # a repeated batch changes nothing
            change(spark, layout, version, [(*k, v) for k, v in rows.items()])
        held |= rows
        got = {(r["firm"], r["id"]): r["value"] for r in deltas.read(spark, layout).collect()}
        assert got == held
    found = deltas.layers(spark, layout, 5)
    assert max(map(len, found.values())) <= layout.depth
    # An older version stays readable until it expires.
    assert deltas.read(spark, layout, 0).count() == 41
    assert deltas.expire(spark, layout, keep=1) > 0
    assert deltas.read(spark, layout).count() == len(held)


def test_a_small_change_reads_and_writes_its_buckets_only(spark):
    layout = layered(spark, "narrow", buckets=32)
    rows = spark.range(3000).selectExpr("'f' as firm", "cast(id as int) as id", "'x' as value")
    deltas.create(rows, layout)
    change(spark, layout, 1, [("f", 7, "y")])
    layer = spark.read.parquet(f"{layout.path}/data/_version=1")
    assert layer.count() == 1
    [bucket] = deltas.touched_buckets(spark.createDataFrame([("f", 7, "y")], LAYERED), layout)
    part = deltas.read(spark, layout, 1, [bucket])
    assert 0 < part.count() < 3000 / 8
    assert all(f"_bucket={bucket}/" in f for f in part.inputFiles())
    assert {r["value"] for r in part.where("id = 7").collect()} == {"y"}


def test_redemption_and_session_streams(spark):
    schema = "attempt_id int, code string, attempted_at timestamp"
    ts = lambda s: F.timestamp_seconds(F.lit(s))
    path = scratch_path(spark, "tries")
    for part in ([(1, "k1", 100), (2, "k1", 101)], [(3, "k1", 120), (4, "k2", 9000)]):
        spark.createDataFrame(part, "attempt_id int, code string, s long").select(
            "attempt_id", "code", F.timestamp_seconds("s").alias("attempted_at")
        ).coalesce(1).write.mode("append").parquet(path)
    stream = J.file_stream(
        spark, path, spark.createDataFrame([], schema).schema, files_per_trigger=1
    )
    codes = spark.createDataFrame([("k1",), ("k2",)], "code string").select(
        "code", ts(400).alias("expires_at"), F.lit(None).cast("timestamp").alias("redeemed_at")
    )
    out = scratch_path(spark, "first")
    J.drain_to_table(J.first_redemption_stream(stream, codes).select("code", "attempt_id"), out)
    assert [tuple(r) for r in spark.read.parquet(out).collect()] == [("k1", 1)]


def test_late_attempts_redeem_too(spark):
    path = scratch_path(spark, "late")
    parts = [[(1, "k1", 900)], [(2, "k9", 2000)], [(3, "k8", 5002)], [(5, "k2", 301), (4, "k2", 300)]]
    for part in parts:
        spark.createDataFrame(part, "attempt_id int, code string, s long").select(
            "attempt_id", "code", F.timestamp_seconds("s").alias("attempted_at")
        ).coalesce(1).write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    stream = J.file_stream(spark, path, schema, files_per_trigger=1)
    codes = spark.createDataFrame([(f"k{i}",) for i in range(10)], "code string").select(
        "code",
        F.timestamp_seconds(F.lit(9000)).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("redeemed_at"),
    )
    out = scratch_path(spark, "first")
    J.drain_to_table(J.first_redemption_stream(stream, codes).select("code", "attempt_id"), out)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {("k1", 1), ("k9", 2), ("k8", 3), ("k2", 4)}


def test_a_table_streams_as_one_file_or_as_a_folder(spark, tmp_path):
    rows = spark.range(20).toDF("doc_id")
    rows.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    rows.toPandas().to_parquet(tmp_path / "labels.parquet")
    s = Source(spark, str(tmp_path))
    for table in ("documents", "labels"):
        got = q_streams._drained(s, q_streams._stream(s, table), table)
        assert sorted(r["doc_id"] for r in got.collect()) == list(range(20))


def test_codes_are_redeemed_without_a_call_each(spark):
    path = scratch_path(spark, "hot")
    # One code with many attempts over all files, its earliest in the middle, and many codes.
    hot = [(i, "hot", 500 + (i * 7919) % 3000) for i in range(3000)] + [(9000, "hot", 500)]
    rest = [(10_000 + i, f"k{i % 700}", 100 + i // 700) for i in range(2100)]
    late = [(-1, "hot", 1), (-2, "k5", 1), (20_000, "new", 5), (20_001, "new", None)]
    codes = spark.createDataFrame(
        [("hot",), ("new",), *((f"k{i}",) for i in range(700))], "code string"
    ).select(
        "code",
        F.timestamp_seconds(F.lit(9000)).alias("expires_at"),
        F.lit(None).cast("timestamp").alias("redeemed_at"),
    )
    out, mark = scratch_path(spark, "first"), scratch_path(spark, "mark")
    for part, n in ((hot + rest, 6), (late, 1)):
        arrived = spark.createDataFrame(part, "attempt_id int, code string, s long").select(
            "attempt_id", "code", F.timestamp_seconds("s").alias("attempted_at")
        )
        arrived.repartition(n).write.mode("append").parquet(path)
        stream = J.file_stream(spark, path, arrived.schema)
        first = J.first_redemption_stream(stream, codes)
        plan = first._jdf.queryExecution().analyzed().toString()
        assert "FlatMapGroupsInPandasWithState" not in plan
        J.drain_to_table(first.select("code", "attempt_id"), out, mark)
    got = {tuple(r) for r in spark.read.parquet(out).collect()}
    assert got == {("hot", 0), ("new", 20_000), *((f"k{i}", 10_000 + i) for i in range(700))}


def test_earliest_rows_are_kept_while_batches_pass(monkeypatch):
    monkeypatch.setattr(J, "_HELD_ROWS", 10)
    rows = [(f"k{i * 31 % 17}", (i * 37) % 41, i) for i in range(200)]
    table = pa.table(dict(zip(("code", "attempted_at", "attempt_id"), map(list, zip(*rows)))))
    parts = J._earliest_of_codes(iter(table.to_batches(max_chunksize=7)))
    got = {(r["code"], r["attempted_at"], r["attempt_id"]) for p in parts for r in p.to_pylist()}
    assert got == {min(r for r in rows if r[0] == code) for code in {r[0] for r in rows}}
