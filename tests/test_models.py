"""Chunks, embeddings, vectors, extraction and intake."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from matterlake.functions import models
from matterlake.functions.chunking import chunk_text
from matterlake.operators import textmodel as TM
from matterlake.operators import vectors as VX
from matterlake.plans import intake as I


def test_chunk_golden():
    assert chunk_text("") == [] and chunk_text(" \n\n ") == []
    assert chunk_text("x" * 100) == [("x" * 100, 0, 100)]
    a, b = "a" * 1500, "b" * 1500
    first, second = chunk_text(f"{a}\n\n{b}")
    assert first == (a, 0, 1500)
    assert second == ("a" * 200 + "\n\n" + b, 1300, 3002)
    one = chunk_text("c" * 900 + "\n\n" + "d" * 900)
    assert [(s, e) for _, s, e in one] == [(0, 1802)]
    assert len(chunk_text("e" * 2500)) == 1
    # One long sentence is not cut.
    assert [len(t) for t, _, _ in chunk_text("f" * 5000)] == [5000]


def test_chunks_cover_the_text():
    r = np.random.default_rng(1)
    words = ["cost", "3.14", "end.", "Next!", "why?", "x" * 30]
    for _ in range(30):
        text = " ".join(r.choice(words, size=2500))
        joined = "".join(
            t if i == 0 else t[202:] for i, (t, _, _) in enumerate(chunk_text(text))
        )
        assert joined.replace(" ", "") == text.replace(" ", "")


def test_chunk_long_text_is_read_once():
    assert len(chunk_text("x" * 300_000, lossy=True)) == 1
    assert len(chunk_text("." * 300_000, lossy=True)) == 1


def test_embed_batches_and_failures():
    calls = []

    def flaky(texts):
        calls.append(len(texts))
        if len(calls) == 1:
            raise RuntimeError("busy")
        return [[1.0], None], 7

    got = models.embed_batch(["abcd", "x"], flaky, pause=0)
    assert got == [([1.0], 4, None), (None, 4, "no vector returned for this input")]

    def refused(texts):
        calls.append(0)
        raise models.PermanentFailure("bad input")

    n = len(calls)
    assert models.embed_batch(["abcde"], refused, pause=0) == [(None, 2, "bad input")]
    assert len(calls) == n + 1
    assert models.embed_batch(["a"], lambda t: 1 / 0, attempts=2, pause=0)[0][0] is None


def test_embed_operator(spark):
    def lengths(texts):
        assert len(texts) <= 3
        return [[float(len(t))] for t in texts], None

    df = spark.range(20).select(
        "id", F.repeat(F.lit("x"), F.col("id").cast("int")).alias("text")
    )
    rows = TM.embed(df, lengths, batch=3).collect()
    assert all(r["embedding"] == [float(r["id"])] for r in rows)


def _memory(spark, n=200, dims=6, seed=2):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        # A third of all rows are copies of one vector.
        v = [1.0] * dims if i % 3 == 0 else [float(x) for x in r.normal(size=dims)]
        if i % 50 == 1:
            v = [0.0] * dims
        firm = "f" if i % 4 else "g"
        rows.append((f"v{i:03d}", firm, f"m{i % 5}", None if i % 41 == 40 else v, "active"))
    return rows


MEMORY = (
    "id string, firm_id string, matter_id string, embedding array<float>, status string"
)
QUERIES = "request_id string, firm_id string, embedding array<float>, matter_id string"


def _expected(rows, queries, k):
    out = []
    for request, firm, q, wanted in queries:
        scored = []
        for i, f, m, v, _ in rows:
            if f != firm or v is None or (wanted and m != wanted):
                continue
            a, b = np.float32(q).astype(float), np.float32(v).astype(float)
            norm = np.sqrt((a @ a) * (b @ b))
            d = round(1 - a @ b / norm, 12) if norm else None
            scored.append((d is None, d or 0.0, i, d))
        scored.sort()
        out += [(request, n + 1, s[2]) for n, s in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("form", ["one block", "blocks", "cells", "small batches"])
def test_vector_topk(spark, form, monkeypatch):
    rows = _memory(spark)
    queries = [
        (f"q{i}", "fg"[i % 2], [float(i + 1), 1.0, 1.0, -1.0, 2.0, 1.0], f"m{i}" if i > 4 else None)
        for i in range(7)
    ]
    queries.append(("ones", "f", [1.0] * 6, None))
    memory = spark.createDataFrame(rows, MEMORY)
    asked = spark.createDataFrame(queries, QUERIES)
    queries.append(("zero", "f", [0.0] * 6, None))
    asked = spark.createDataFrame(queries, QUERIES)
    extra = {"block_queries": 3} if form == "blocks" else {}
    if form == "cells":
        stored = VX.clustered(memory, cells=4)
        memory, extra = stored.memory, {"cells": stored.cells}
    if form == "small batches":
        monkeypatch.setattr(VX, "BATCH_ROWS", 3)
    found = VX.vector_topk(asked, memory, k=5, **extra).collect()
    got = sorted((r["request_id"], r["rank"], r["id"]) for r in found)
    assert got == _expected(rows, queries, 5)
    assert {r["firm_id"] for r in found if r["request_id"] == "ones"} == {"f"}


def _near(spark, n_groups=6, each=50):
    """Groups of near vectors along the axes."""
    r = np.random.default_rng(4)
    rows = []
    for g in range(n_groups):
        for i in range(each):
            v = np.eye(n_groups)[g] + r.normal(scale=0.01, size=n_groups)
            rows.append((f"v{g}-{i:02d}", "f", "m", [float(x) for x in v], "active"))
    return rows


def test_running_heaps_skip_batches_and_send_k_rows():
    import pandas as pd

    rows = _near(None)
    asked = pd.DataFrame({"request_id": ["q"], "query": [np.eye(6)[0]], "wanted": [None]})
    memory = pd.DataFrame(rows, columns=["id", "firm_id", "matter_id", "embedding", "status"])
    best = VX._Best(asked, 4)
    for at in range(0, len(memory), 10):
        best.offer(memory.iloc[at : at + 10])
    # All batches of the five other groups are passed over.
    assert best.skipped == 25
    expected = [i for _, _, i in _expected(rows, [("q", "f", np.eye(6)[0], None)], 4)]
    assert best.hits("f")["id"].tolist() == expected


def test_tables_of_distances_are_bounded():
    import tracemalloc

    import pandas as pd

    r = np.random.default_rng(5)
    vectors = list(r.normal(size=(6000, 8)))
    asked = pd.DataFrame({"request_id": [f"q{i}" for i in range(6000)], "query": vectors})
    asked["wanted"] = [f"m{i % 3}" if i % 2 else None for i in range(6000)]
    memory = pd.DataFrame({"id": [f"v{i:04d}" for i in range(4096)], "embedding": vectors[:4096]})
    memory["matter_id"] = [f"m{i % 3}" for i in range(4096)]
    best = VX._Best(asked, 2)
    tracemalloc.start()
    best.offer(memory)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All distances at once would take 197 MB.
    assert peak < 100e6
    first = best.hits("f").drop_duplicates("request_id")["id"].tolist()
    assert first[:4096] == memory["id"].tolist()


def test_far_cells_are_not_read(spark):
    rows = _near(spark)
    memory = spark.createDataFrame(rows, MEMORY)
    stored = VX.clustered(memory, cells=6)
    assert stored.cells.agg({"n": "sum"}).first()[0] == len(rows)
    q = [float(x) for x in np.eye(6)[2]]
    asked = spark.createDataFrame([("q", "f", q, None)], QUERIES).withColumnsRenamed(
        {"embedding": "query", "matter_id": "wanted"}
    )
    needed = VX.needed_cells(asked, stored.cells, 4)
    assert needed.count() == 1
    left = VX._reachable(asked, stored.memory, stored.cells, 4)
    assert left.count() == 50
    scan = left._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: []" not in scan and "INSET" in scan.upper() or "IN (" in scan.upper()


def test_table_function_in_sql(spark):
    rows = _memory(spark)
    memory = spark.createDataFrame(rows, MEMORY).selectExpr("*", "'t' as content", "'c' as memory_type")
    VX.register_match_function(memory, name="match_rows", view="rows_of_memory", k=4)
    q = [3.0, 1.0, 1.0, -1.0, 2.0, 1.0]
    asked = f"array({', '.join(f'{x}D' for x in q)})"
    found = spark.sql(f"SELECT * FROM match_rows('f', {asked})")
    assert len(found.columns) == 8
    want = _expected(rows, [("q", "f", q, None)], 4)
    assert {r["id"] for r in found.collect()} == {i for _, _, i in want}
    # Only k rows of a task are sent.
    shown = found._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in shown.split("WindowGroupLimit", 1)[1]
    one = spark.sql(f"SELECT id FROM match_rows('f', {asked}, 2, 'm1') ORDER BY distance")
    want = _expected(rows, [("q", "f", q, "m1")], 2)
    assert [r["id"] for r in one.collect()] == [i for _, _, i in want]


def test_missing_distances_sort_last(spark):
    memory = spark.createDataFrame(
        [
            ("a", "f", "m", [0.0, 0.0], "active"),
            ("b", "f", "m", [1.0, 0.0], "active"),
            ("c", "f", "m", [1.0], "active"),
        ],
        MEMORY,
    )
    asked = spark.createDataFrame([("q", "f", [1.0, 1.0], None)], QUERIES)
    got = VX.vector_topk(asked, memory, k=3).orderBy("rank").collect()
    assert [r["id"] for r in got] == ["b", "a", "c"]
    assert got[1]["distance"] is None and got[1]["similarity"] is None
    with pytest.raises(ValueError):
        VX.vector_topk(asked, memory, k=0)
    assert VX.vector_topk(asked, memory, k=21).count() == 3


def test_rules(spark):
    docs = spark.createDataFrame(
        [(1, "The Liability Cap is low. Force majeure applies."), (2, "none"), (3, None)],
        "id int, content string",
    )
    found = TM.exploded_positions(TM.extract_positions(docs)).collect()
    assert [(r["id"], r["seq"], r["clause_type"], r["value"]) for r in found] == [
        (1, 0, "liability_cap", '{"mention":"Liability Cap"}'),
        (1, 1, "force_majeure", '{"mention":"Force majeure"}'),
    ]


def test_every_mention_is_found(spark):
    text = "Fees. " + "x" * 400 + " late fees, fees and scope of work; the SCOPE."
    rules = {"fees": "fees", "late": "late fees", "scope": "scope( of work)?"}
    docs = spark.createDataFrame([(1, text), (2, ""), (3, None)], "id int, content string")
    found = TM.exploded_positions(TM.extract_positions(docs, rules=rules)).collect()
    got = [(r["seq"], r["clause_type"], r["value"][12:-2]) for r in found]
    assert got == [
        (0, "fees", "Fees"),
        (1, "late", "late fees"),
        (2, "fees", "fees"),
        (3, "fees", "fees"),
        (4, "scope", "scope of work"),
        (5, "scope", "SCOPE"),
    ]
    # Each excerpt holds its mention; together they repeat next to nothing.
    assert all(r["value"][12:-2] in r["source_chunk_text"] for r in found)
    assert sum(len(r["source_chunk_text"]) for r in found) <= len(text) + len("late fees")
    first = TM.exploded_positions(
        TM.extract_positions(docs, rules=rules, first_only=True)
    ).collect()
    assert [r["value"][12:-2] for r in first] == ["Fees", "late fees", "scope of work"]


def test_one_pass_finds_what_each_rule_finds():
    import random
    import re

    from matterlake.functions import mentions

    rng = random.Random(8)
    patterns = ["a b", "b", "a( b)*", "c?", "b a", "B"]
    rules = mentions.compiled(patterns)
    for _ in range(300):
        text = "".join(rng.choice("aAbc  _é.") for _ in range(rng.randrange(30)))
        want = []
        for i, p in enumerate(patterns):
            whole = f"(?<![A-Za-z0-9_])(?:{p})(?![A-Za-z0-9_])"
            want += [
                (m.start(), m.end(), i)
                for m in re.finditer(whole, text, re.I | re.A)
                if m.end() > m.start()
            ]
        assert rules.places(text) == sorted(want)
    assert mentions.compiled([]).places("a") == []
    # Linear in the text: every word a mention.
    assert len(mentions.compiled(["fees"]).places("fees " * 100_000)) == 100_000


def test_failed_documents_are_rows_of_their_own(spark):
    def extract(text):
        if "BOOM" in text:
            raise ValueError("no answer")
        return [], 1, 1

    docs = spark.createDataFrame([(1, "fine"), (2, "BOOM")], "id int, content string")
    extracted = TM.extract_positions(docs, extract)
    assert TM.exploded_positions(extracted).collect() == []
    assert [tuple(r) for r in TM.extraction_errors(extracted).collect()] == [(2, "no answer")]


def test_intake_keeps_failures_apart(spark):
    long_text = "The parties agree on fees and scope. " * 5
    docs = spark.createDataFrame(
        [
            ("d1", "f", "m1", long_text, "msa"),
            ("d2", "f", "m1", "short", None),
            ("d3", "f", None, long_text, None),
            ("d4", "f", "m1", long_text + "BOOM", None),
        ],
        "id string, firm_id string, matter_id string, content string, doc_type string",
    )
    matters = spark.createDataFrame(
        [("m1", "f", "Deal", "Client")],
        "id string, firm_id string, matter_name string, client_name string",
    )
    jobs = spark.createDataFrame(
        [(f"j{i}", "f", f"d{i}", None, "pending", i) for i in range(1, 6)]
        + [("j9", "f", "d1", None, "completed", 0), ("jx", "g", "d1", None, "pending", 9)],
        "id string, firm_id string, document_id string, matter_id string, status string, "
        "queued_at int",
    )

    def extract(text):
        if "BOOM" in text:
            raise RuntimeError("model refused")
        assert text.startswith("matter = Deal\nclient = Client\n")
        return [{"clause_type": "fees", "value": {"a": 1}, "status": "settled"}], 10, 2

    result = I.run_intake(
        jobs, docs, matters, models.hashing_embedder(16), extract_fn=extract
    )
    ledger = {r["job_id"]: r for r in result.ledger.collect()}
    assert {k: v["status"] for k, v in ledger.items()} == {
        "j1": "completed",
        "j2": "skipped",
        "j3": "completed",
        "j4": "failed",
        "j5": "failed",
        "jx": "failed",
    }
    assert ledger["j1"]["positions_extracted"] == 1
    assert ledger["j1"]["chunks_embedded"] == 1
    # Without a matter nothing is stored.
    assert ledger["j3"]["chunks_embedded"] == 0
    assert ledger["j4"]["error_message"] == "model refused"
    assert ledger["j5"]["error_message"] == "document not found"
    assert {r["source_document_id"] for r in result.memory.collect()} == {"d1", "d4"}
    positions = result.positions.collect()
    assert [(r["source_document_id"], r["value"], r["status"]) for r in positions] == [
        ("d1", '{"a": 1}', "settled")
    ]


def test_backfill_limit_and_dry_run(spark):
    docs = spark.createDataFrame(
        [(f"d{i}", "f", "m", "x" * 60, None) for i in range(6)],
        "id string, firm_id string, matter_id string, content string, doc_type string",
    )
    jobs = spark.createDataFrame(
        [("d0", "f", "completed"), ("d1", "f", "completed"), ("d2", "f", "failed")],
        "document_id string, firm_id string, status string",
    )

    def ids(**kw):
        return sorted(
            r["document_id"] for r in I.backfill_candidates(docs, jobs, **kw).collect()
        )

    assert ids() == ["d2", "d3", "d4", "d5"]
    assert ids(limit=2) == ["d2", "d3"]
    assert ids(limit=2, limit_first=True) == []
    matters = spark.createDataFrame(
        [("m", "f", "n", "c")],
        "id string, firm_id string, matter_name string, client_name string",
    )
    embed = models.hashing_embedder(8)
    assert I.backfill(docs, jobs, matters, embed, dry_run=True).intake is None
    out = I.backfill(docs, jobs, matters, embed).outcomes.collect()
    assert [tuple(r) for r in out] == [("f", 4, 0, 0)]


def test_stored_positions_follow_the_queue(spark):
    # One mention each: every further one would be a position of its own.
    text = "The parties agree on fees and scope. " + "Other words follow. " * 3
    docs = spark.createDataFrame(
        [(d, "f", "m", text + d, None) for d in ("late", "soon")],
        "id string, firm_id string, matter_id string, content string, doc_type string",
    )
    jobs = spark.createDataFrame(
        [("a", "f", "late", "m", "pending", 9), ("b", "f", "soon", "m", "pending", 1)],
        "id string, firm_id string, document_id string, matter_id string, status string, "
        "queued_at int",
    )
    matters = spark.createDataFrame(
        [("m", "f", "n", "c")],
        "id string, firm_id string, matter_name string, client_name string",
    )
    run = I.run_intake(
        jobs, docs, matters, models.hashing_embedder(8), rules={"fees": "fees"}
    )
    names = [c for c in run.positions.columns if c != "queued_at"]
    old = run.positions.limit(1).select(
        *[F.lit("old").alias(c) if c == "id" else F.col(c) for c in names],
        F.lit(None).cast("string").alias("superseded_by"),
    )
    after = {
        r["source_document_id"] if r["id"] != "old" else "old": r
        for r in I.store_positions(old, run).collect()
    }
    assert after["old"]["superseded_by"] == after["soon"]["id"]
    assert after["soon"]["superseded_by"] == after["late"]["id"]
    assert after["late"]["superseded_by"] is None


def test_results_are_handed_on_in_pieces(spark):
    texts = pd.Series(["a" * 6, None, "b" * 5, "c" * 40, "", "d"])
    cut = [list(p) for p in TM.pieces(texts, most=10)]
    assert cut == [["a" * 6, None], ["b" * 5], ["c" * 40], ["", "d"]]
    assert [t for p in cut for t in p] == list(texts)
    assert list(TM.pieces(texts[:0])) == []


def test_batches_of_texts_stay_small(spark):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    docs = spark.range(6).select(
        F.col("id"), F.repeat(F.lit("fees are due. "), 100_000).alias("content")
    )
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, "10000")
        chunked = TM.chunk_documents(docs)
        assert int(spark.conf.get(key)) <= 1000
        # A text above the size of a piece; several pieces in a batch.
        per_doc = chunked.groupBy("id").count().collect()
        assert len(per_doc) == 6 and len({r["count"] for r in per_doc}) == 1
        found = TM.with_rule_positions(docs, "content", {"fees": "fees"})
        assert {r["n"] for r in found.select(F.size("positions").alias("n")).collect()} == {100_000}
    finally:
        spark.conf.set(key, before)
