"""Tenancy, validation, sinks, matters, counterparties, ledger, access."""

import datetime as dt

from conftest import plan_of
from pyspark.sql import functions as F

from matterlake import schemas as S
from matterlake.operators import access as A
from matterlake.operators import counterparties as CP
from matterlake.operators import ledger as L
from matterlake.operators import matters as MT
from matterlake.operators import positions as P
from matterlake.operators import tenancy as T
from matterlake.operators import validation as V
from matterlake.plans.storage import scratch_path
from matterlake.sources import sinks, tables


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def day(n):
    return dt.datetime(2024, 1, n)


def test_scan_is_pushed_down(spark):
    path = scratch_path(spark, "scan")
    spark.createDataFrame(
        [("m1", "f"), ("m2", "g")], "id string, firm_id string"
    ).write.partitionBy("firm_id").parquet(path + "/matters")
    table = tables.read_table(spark, path, "matters")
    one = tables.scan(table, "f").select("id", "firm_id")
    assert rows(one, "id") == [("m1",)]
    plan = plan_of(one)
    assert "PartitionFilters: [isnotnull(firm_id" in plan
    assert "ReadSchema: struct<id:string>" in plan
    assert rows(tables.scan(table, ["f", "g"]), "id") == [("m1",), ("m2",)]
    firms = spark.createDataFrame([("g",), ("g",)], "firm_id string")
    assert rows(tables.scan(table, firms), "id") == [("m2",)]


def test_tag_firm_prefers_the_earliest_membership(spark):
    members = spark.createDataFrame(
        [
            ("u1", "g", "active", 2),
            ("u1", "f", "active", 1),
            ("u2", "h", "suspended", 1),
            ("u3", "b", "active", 1),
            ("u3", "a", "active", 1),
        ],
        "user_id string, firm_id string, status string, added_at int",
    )
    df = spark.createDataFrame(
        [("1", "u1", None), ("2", "u2", None), ("3", "u3", None), ("4", "u1", "z")],
        "id string, user_id string, firm_id string",
    )
    got = rows(T.tag_firm(df, members), "id", "firm_id")
    assert got == [("1", "f"), ("2", None), ("3", "a"), ("4", "z")]
    parts = T.tag_coverage({"x": df, "y": df.where("firm_id is not null")})
    assert rows(parts, "table_name", "total", "firm_tagged") == [
        ("x", 4, 1),
        ("y", 1, 1),
    ]


def test_validation(spark):
    df = spark.createDataFrame(
        [("p", "f", "m", "c", "{}", "x", "open", None, 0.5),
         ("p", "f", "m", "c", "{}", "x", "agreed", "them", 1.5),
         (None, "f", "m", "c", "{}", "x", "open", None, None)],
        "id string, firm_id string, matter_id string, clause_type string, value string, "
        "extracted_by string, status string, party_role string, confidence double",
    )
    valid, rejected = V.validate(df, V.position_rules())
    assert valid.count() == 1
    reasons = [r["reasons"] for r in rejected.orderBy(F.col("id").asc_nulls_last()).collect()]
    assert reasons == [
        [
            "status is not an allowed value",
            "party_role is not an allowed value",
            "confidence is out of range",
        ],
        ["id is missing"],
    ]
    assert rows(V.duplicate_keys(df, ["id"]), "id", "n_rows") == [("p", 2)]
    parents = spark.createDataFrame([("q",)], "id string")
    assert V.orphans(df, "id", parents, "id").count() == 2
    for make in (
        V.firm_rules, V.firm_user_rules, V.matter_rules, V.job_rules, V.handoff_rules,
        V.audit_rules, V.upload_rules, V.note_rules, V.signal_rules, V.assert_rules,
        V.edit_rules, V.draft_rules, V.search_rules,
    ):
        assert make()
    assert len(V.signal_rules(update=True)) > len(V.signal_rules())


def test_upsert_and_sinks(spark):
    base = spark.createDataFrame(
        [("u1", "f", "member"), ("u2", "f", "member")],
        "user_id string, firm_id string, role string",
    )
    changes = spark.createDataFrame(
        [("u1", "f", "admin", 1), ("u1", "f", "owner", 2), ("u3", "f", "admin", 1)],
        "user_id string, firm_id string, role string, at int",
    )
    got = rows(sinks.upsert(base, changes, ["user_id", "firm_id"], "at"), "user_id", "role")
    assert got == [("u1", "owner"), ("u2", "member"), ("u3", "admin")]

    path = scratch_path(spark, "audit")
    actions = spark.createDataFrame(
        [("f", "tool.x", "success", "u1"), ("g", "tool.y", "error", None)],
        "firm_id string, action string, result string, user_id string",
    )
    sinks.append_audit(actions, path)
    sinks.append_audit(actions.limit(1), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 3 and "payload" in stored.columns

    chunks = spark.createDataFrame(
        [("f", "m", "d1", 0, "t", [1.0]), ("f", "m", "d1", 1, "u", None)],
        "firm_id string, matter_id string, source_document_id string, chunk_index int, "
        "text string, embedding array<float>",
    )
    memory = sinks.chunk_rows(chunks, "model")
    assert rows(memory, "content", "memory_type", "status") == [("t", "chunk", "active")]
    counts = sinks.chunk_counts(chunks)
    assert rows(counts, "source_document_id", "inserted", "skipped") == [("d1", 1, 1)]
    # Running again replaces the document's chunks.
    path = scratch_path(spark, "memory")
    for _ in range(2):
        sinks.replace_partitions(memory, path, ["firm_id", "source_document_id"])
    assert spark.read.parquet(path).count() == 1


def test_matter_view_defaults(spark):
    df = spark.createDataFrame(
        [("m1", None, None, None, None, None, None, None, None, None, None, None,
          True, None, None)],
        S.MATTERS,
    )
    r = MT.matter_view(df).first()
    assert (r["firm_id"], r["client_id"], r["matter_type"]) == ("", "", "other")
    assert (r["stage"], r["privilege_scope"], r["state"]) == ("closed", "open", "{}")
    assert r["opened_at"].year == 1970 and r["parties"] == []


def matter(spark, *specs):
    made = [
        (i, None, f, "c1", "Client", "Name", law, p, None, None, day(d), day(d), False,
         None, None)
        for i, f, law, p, d in specs
    ]
    return spark.createDataFrame(made, S.MATTERS)


ACME = '[{"id":"Acme Corp"},{"id":"us","kind":"client"}]'


def test_directory_filters_after_the_limit(spark):
    df = matter(
        spark,
        ("old", "f", None, ACME, 1),
        ("mid", "f", None, "[]", 2),
        ("new", "f", None, ACME, 3),
        ("far", "g", None, ACME, 9),
    )
    listed = MT.list_matters(df, counterparty="ACME", n=2)
    assert rows(listed, "firm_id", "id") == [("f", "new"), ("g", "far")]
    assert listed.where("id = 'new'").first()["counterparties"] == ["Acme Corp"]
    ask = spark.createDataFrame(
        [("r1", "f", "new"), ("r2", "g", "new")],
        "request_id string, firm_id string, matter_id string",
    )
    assert rows(MT.matters_for(ask, df), "request_id", "found") == [
        ("r1", True),
        ("r2", False),
    ]


def test_counterparty_history(spark):
    matters = matter(
        spark,
        ("m1", "f", "England", ACME, 1),
        ("m2", "f", None, "[]", 2),
        ("m1", "g", "Spain", ACME, 1),
    )
    names = ("id", "firm_id", "matter_id", "clause_type", "value", "status",
             "counterparty_name", "superseded_by")
    positions = spark.createDataFrame(
        [
            ("p1", "f", "m1", "fees", "1", "proposed", "Acme Corp", None),
            ("p2", "f", "m1", "fees", "0", "open", "Acme Corp", "p1"),
            ("p3", "f", "m1", "sla", "2", "settled", "Acme_x", None),
            ("p4", "f", "m1", "sla", "3", "rejected", "ACME", None),
            ("p5", "f", "m2", "sla", "4", "settled", None, None),
            ("p6", "g", "m1", "sla", "5", "settled", "Acme Corp", None),
        ],
        ", ".join(f"{n} string" for n in names),
    )
    ask = spark.createDataFrame(
        [("r1", "f", "acme", None), ("r2", "f", "acme", "sla"), ("r3", "f", "a%p", None),
         ("r4", "f", "zz", None)],
        "request_id string, firm_id string, counterparty string, clause_type string",
    )
    found = CP.counterparty_history(ask, matters, positions)
    assert rows(found, "request_id", "clause_type", "value", "status") == [
        ("r1", "fees", "1", "open"),
        ("r1", "governing_law", "England", "settled"),
        ("r1", "sla", "2", "settled"),
        ("r2", "sla", "2", "settled"),
    ]
    counts = CP.matter_counts(ask, matters)
    assert rows(counts, "request_id", "matter_count") == [
        ("r1", 1), ("r2", 1), ("r3", 0), ("r4", 0),
    ]
    listed = CP.counterparty_positions(ask, positions)
    assert rows(listed, "request_id", "id") == [
        ("r1", "p1"), ("r1", "p3"), ("r1", "p4"), ("r2", "p3"), ("r2", "p4"),
        ("r3", "p1"),
    ]
    literal = CP.counterparty_positions(ask, positions, literal=True)
    assert "r3" not in {r["request_id"] for r in literal.collect()}
    state = P.matter_state(matters, positions)
    assert rows(state, "firm_id", "id", "active_count", "open_count", "settled_count") == [
        ("f", "m1", 3, 1, 1), ("f", "m2", 1, 0, 1), ("g", "m1", 1, 0, 1),
    ]


def test_ledger(spark):
    events = spark.createDataFrame(
        [
            ("j1", "f", "d1", "pending", day(1), None, None, None),
            ("j1", "f", "d1", "running", day(2), None, None, None),
            ("j1", "f", "d1", "completed", day(3), 4, 7, None),
            ("j2", "f", "d2", "pending", day(1), None, None, None),
            ("j2", "f", "d2", "failed", day(1), None, None, "e" * 3000),
        ],
        "job_id string, firm_id string, document_id string, status string, "
        "event_at timestamp, positions_extracted int, chunks_embedded int, "
        "error_message string",
    )
    state = {r["job_id"]: r for r in L.ledger_state(events).collect()}
    assert state["j1"]["status"] == "completed"
    assert state["j1"]["duration_ms"] == 86_400_000
    assert state["j1"]["positions_extracted"] == 4
    assert state["j2"]["status"] == "failed" and state["j2"]["duration_ms"] == 0
    assert len(state["j2"]["error_message"]) == 3000
    assert rows(L.job_outcomes(L.ledger_state(events)), "completed", "failed") == [(1, 1)]


def test_access(spark):
    members = spark.createDataFrame(
        [
            ("u1", "f", "owner", "active", day(5)),
            ("u2", "f", "member", "active", None),
            ("u3", "f", "admin", "suspended", None),
            ("u4", "g", "member", "active", None),
        ],
        "user_id string, firm_id string, role string, status string, "
        "min_token_iat timestamp",
    )
    ask = spark.createDataFrame(
        [("ok", "f", "u1", "u2"), ("member", "f", "u2", "u1"), ("idle", "f", "u3", "u1"),
         ("far", "f", "u1", "u4"), ("anon", "f", None, "u1")],
        "request_id string, firm_id string, caller_id string, target_id string",
    )
    verdict = A.authorised_pairs(ask, members)
    assert rows(verdict.where("allowed"), "request_id") == [("ok",)]
    assert verdict.where("reason is null").count() == 1
    stamped = A.revoke(members, verdict, F.lit("2024-02-01").cast("timestamp"))
    assert {r["user_id"]: r["min_token_iat"] for r in stamped.collect()} == {
        "u1": day(5), "u2": dt.datetime(2024, 2, 1), "u3": None, "u4": None,
    }
    epoch = int(day(5).replace(tzinfo=dt.timezone.utc).timestamp())
    sessions = spark.createDataFrame(
        [("u1", "f", epoch - 1), ("u1", "f", epoch), ("u2", "f", 1)], S.SESSIONS
    )
    assert rows(A.valid_sessions(sessions, members), "user_id", "iat") == [
        ("u1", epoch), ("u2", 1),
    ]
    users = spark.createDataFrame([("u1", "Ann@x.org")], "user_id string, email string")
    mails = spark.createDataFrame(
        [("r1", "ann@X.ORG"), ("r2", "bob@x.org")], "request_id string, email string"
    )
    assert rows(A.users_by_email(mails, users), "request_id", "user_id") == [
        ("r1", "u1"), ("r2", None),
    ]
    codes = spark.createDataFrame(
        [("k1", "c", "u1", "f", day(1), day(3), None),
         ("k2", "c", "u1", "f", day(1), day(3), day(2))],
        S.ACCESS_CODES,
    )
    tries = spark.createDataFrame(
        [(1, "k1", day(4)), (2, "k1", day(2)), (3, "k1", day(2)), (4, "k2", day(2))],
        "attempt_id int, code string, attempted_at timestamp",
    )
    assert rows(A.first_redemptions(tries, codes), "code", "attempt_id") == [("k1", 2)]


def test_ids_are_the_same_on_a_retry(spark):
    actions = spark.createDataFrame(
        [("f", "read", "ok", "r1"), ("f", "read", "ok", "r2")],
        "firm_id string, action string, result string, request_id string",
    )
    docs = spark.createDataFrame(
        [("f", "d", "m", "r1"), ("f", "d", "m", "r2")],
        "firm_id string, document_id string, matter_id string, request_id string",
    )
    for make in (
        lambda: sinks.audit_rows(actions),
        lambda: sinks.request_extraction(docs, "document_upload"),
    ):
        first, again = ({r["id"] for r in make().collect()} for _ in range(2))
        assert first == again and len(first) == 2


def test_judged_rows_are_counted_while_written(spark):
    from matterlake.plans.storage import scratch_path

    rows = spark.createDataFrame(
        [("m", "a note", "guess", None), (None, "x", "context", "matter"), ("m", "fine", None, None)],
        "matter_id string, note string, note_type string, scope string",
    )
    path = scratch_path(spark, "judged")
    counts = V.write_judged(rows, V.note_rules(), path)
    assert counts["rows"] == 3
    assert {k: n for k, n in counts.items() if n and k != "rows"} == {
        "matter_id is missing": 1,
        "note has a bad length": 1,
        "note_type is not an allowed value": 1,
    }
    assert [r["note"] for r in V.judged_rows(rows, path, True).collect()] == ["fine"]
    bad = {r["note"]: r["reasons"] for r in V.judged_rows(rows, path, False).collect()}
    assert bad["x"] == ["matter_id is missing", "note has a bad length"]
    assert set(V.RULE_SETS) >= {"firms", "notes", "searches"}
