"""Resolution cascade, containment against brute force, handoffs."""

import random

import numpy as np
import pyarrow as pa
import pytest
from conftest import plan_of
from pyspark.sql import functions as F

from matterlake.plans.storage import written
from matterlake.functions import scoring as D
from matterlake.functions import text as X
from matterlake.operators import handoffs as H
from matterlake.operators import resolution as R
from matterlake.plans import containment as CT
from matterlake.plans.wordmatch import _automaton, names_in, word_matches

MATTERS = (
    "id string, firm_id string, matter_name string, client_name string, created_at int"
)
DOCS = (
    "id string, firm_id string, matter_id string, name string, is_precedent boolean, "
    "word_doc_id string"
)
HINTS = (
    "request_id string, firm_id string, word_doc_id string, document_name string, "
    "content_snippet string"
)


@pytest.fixture(scope="module")
def world(spark):
    matters = spark.createDataFrame(
        [
            ("m1", "f", "Alpha lease", None, 1),
            ("m2", "f", "Beta supply", None, 2),
            ("m3", "f", "Elion NDA", "Elion", 3),
            ("m4", "f", "NDA", "Elion", 4),
            ("m9", "g", "Elion NDA", "Elion", 9),
        ],
        MATTERS,
    )
    docs = spark.createDataFrame(
        [
            ("d1", "f", "m1", "Lease.docx", False, "w1"),
            ("d2", "f", None, "Form.docx", True, "w2"),
            ("d3", "f", "m2", "Supply Deal.docx", False, None),
            ("d4", "f", "m1", "A_B.docx", False, None),
            ("d5", "f", "m1", "Twin 1.docx", False, "w5"),
            ("d6", "f", "m1", "Twin 2.docx", False, "w5"),
            ("d7", "f", "m8", "Lost one.docx", False, "w7"),
            ("d8", "g", "m9", "Supply Deal.docx", False, "w1"),
        ],
        DOCS,
    )
    return matters, docs


def hints(spark, *rows):
    return spark.createDataFrame(list(rows), HINTS)


def answers(df):
    return {r["request_id"]: r for r in df.collect()}


def test_cascade(spark, world):
    matters, docs = world
    asked = hints(
        spark,
        ("office", "f", "w1", "nothing", None),
        ("precedent", "f", "w2", None, None),
        ("exact", "f", None, "Supply Deal.docx", None),
        ("part", "f", None, "Supply", None),
        ("cleaned", "f", None, "Elion NDA_v4.docx", None),
        ("reverse", "f", None, "Form - Mutual NDA - May 2026.docx", None),
        ("snippet", "f", None, None, "between Elion Holdco Limited and others"),
        ("underscore", "f", None, "A_B.docx", None),
        ("twins", "f", "w5", "Twin", None),
        ("lost", "f", "w7", None, None),
        ("none", "f", None, "zzz", None),
        ("other firm", "g", None, "Supply", None),
    )
    got = answers(R.outcomes(R.resolve_documents(asked, docs, matters)))
    assert (got["office"]["matter_id"], got["office"]["step"]) == ("m1", 1)
    assert got["precedent"]["result"] == "precedent_only"
    assert got["precedent"]["confidence"] == "exact"
    assert (got["exact"]["matter_id"], got["exact"]["confidence"]) == ("m2", "exact")
    assert (got["part"]["matter_id"], got["part"]["confidence"]) == ("m2", "fuzzy")
    assert (got["cleaned"]["matter_id"], got["cleaned"]["step"]) == ("m3", 3)
    assert (got["reverse"]["matter_id"], got["reverse"]["step"]) == ("m4", 4)
    # Both matters of the client score 1; the newest wins.
    assert got["snippet"]["matter_id"] == "m4"
    assert got["snippet"]["alternatives"] == ["m3"]
    assert got["underscore"]["step"] == 0 and got["underscore"]["result"] == "unknown"
    # Two documents with one office id: the next step answers.
    assert (got["twins"]["step"], got["twins"]["document_id"]) == (2, "d5")
    assert got["twins"]["alternatives"] == ["m1"]
    assert got["lost"]["matter_id"] is None and got["lost"]["step"] == 1
    assert got["lost"]["result"] == "unknown"
    assert got["none"]["confidence"] == "none"
    assert got["other firm"]["matter_id"] == "m9"
    literal = answers(
        R.by_document_name(
            asked.where("request_id = 'underscore'"), docs, matters, literal=True
        )
    )
    assert literal["underscore"]["matter_id"] == "m1"


def test_wildcard_only_name_matches_everything(spark, world):
    matters, docs = world
    got = answers(
        R.by_document_name(hints(spark, ("w", "f", None, "%_", None)), docs, matters)
    )
    assert got["w"]["document_name_found"] == "A_B.docx"
    # Lease, Lost one (matter unknown) and Supply Deal are the other three.
    assert got["w"]["alternatives"] == ["m1", "m2"]


@pytest.mark.parametrize("few", [True, False])
def test_containment_equals_brute_force(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(CT, "SHIPPED_PARTS", 0)
    r = random.Random(3)

    def text(low, high):
        return "".join(r.choice("abAé_ 1") for _ in range(r.randint(low, high)))

    texts = {(r.choice("fg"), text(0, 60)) for _ in range(150)}
    patterns = {(r.choice("fg"), text(0, 5)) for _ in range(40)}
    # Long patterns: pieces of the texts.
    for firm, t in sorted(texts)[:60]:
        a = r.randint(0, max(0, len(t) - 1))
        patterns.add((firm, t[a : a + r.randint(1, 45)].upper()))
    p = spark.createDataFrame(sorted(patterns), "firm_id string, pattern string")
    t = spark.createDataFrame(sorted(texts), "firm_id string, text string")
    pairs = CT.containment_pairs(
        p, t, lambda x, y: X.contains_ignoring_case(y, x)
    )
    got = [tuple(x) for x in pairs.collect()]
    want = {
        (f, x, y)
        for f, x in patterns
        for g, y in texts
        if f == g and x.lower() in y.lower()
    }
    assert len(got) == len(set(got)) and set(got) == want
    plan = plan_of(pairs)
    assert "Cartesian" not in plan and "NestedLoop" not in plan


@pytest.mark.parametrize("letters", [20, 1_000_000])
def test_word_containment_equals_brute_force(spark, letters):
    r = random.Random(5)
    tokens = ["acme", "a", "nda", "elion", "(x)", "é", "..", "b-c", "日本語", "nda2"]
    names = {" ".join(r.choices(tokens, k=r.randint(1, 3))) for _ in range(60)}
    texts = [
        (f"r{i}", " ".join(r.choices(tokens, k=r.randint(0, 9)))) for i in range(120)
    ]
    names = {n for n in names if len(n) >= 3}
    p = spark.createDataFrame(
        [("f", n) for n in sorted(names)], "firm_id string, pattern string"
    )
    t = spark.createDataFrame(
        [("f", x, i) for i, x in texts], "firm_id string, text string, request_id string"
    )
    found = word_matches(p, t, "request_id", block_letters=letters)
    got = sorted((x["pattern"], x["request_id"]) for x in found.collect())
    brute = p.crossJoin(t.drop("firm_id")).where(
        X.contains_word(F.col("pattern"), F.col("text"))
    )
    assert got == sorted((x["pattern"], x["request_id"]) for x in brute.collect())
    assert got


def test_automaton_reads_overlapping_names_and_boundaries():
    automaton = _automaton(["nda", "mutual nda", "(x)", "é", "a_b", ".."])
    assert names_in(automaton, "mutual nda") == ["mutual nda", "nda"]
    assert names_in(automaton, "ndas panda nda_") == []
    # A name that ends in a mark ends where a word letter follows.
    assert names_in(automaton, "f(x)y") == ["(x)"]
    assert names_in(automaton, "f (x) y") == []
    assert names_in(automaton, "aéb") == ["é"]
    assert names_in(automaton, "") == []


def test_hits_behind_any_number_of_others_are_found(spark):
    matters = spark.createDataFrame(
        [("m6", "f", "one", None, 1), ("m7", "f", "two", None, 2)]
        + [(f"n{i:02d}", "f", f"the long name {i:02d}", "Client", i) for i in range(12)],
        MATTERS,
    )
    docs = spark.createDataFrame(
        [(f"d{i}", "f", f"m{i}", f"lease {i}", False, None) for i in range(8)], DOCS
    )
    asked = hints(spark, ("r", "f", None, "lease", None))
    got = answers(R.by_document_name(asked, docs, matters))["r"]
    assert (got["matter_id"], got["document_id"], got["alternatives"]) == ("m6", "d6", ["m7"])
    # The first five hits only, as a service that asks for five rows sees them.
    capped = answers(R.by_document_name(asked, docs, matters, k=5, alternatives=3))["r"]
    assert (capped["matter_id"], capped["document_id"]) == (None, "d0")
    assert capped["alternatives"] == []

    asked = hints(spark, ("r", "f", None, "long name", None))
    every = [f"n{i:02d}" for i in range(12)]
    got = answers(R.by_matter_name(asked, matters))["r"]
    assert [got["matter_id"], *got["alternatives"]] == every
    got = answers(R.by_matter_name(asked, matters, k=5))["r"]
    assert [got["matter_id"], *got["alternatives"]] == every[:5]

    asked = hints(spark, ("r", "f", None, None, "of the client"))
    got = answers(R.by_names_in_hint(asked, matters))["r"]
    assert [got["matter_id"], *got["alternatives"]] == every[::-1]
    got = answers(R.by_names_in_hint(asked, matters, alternatives=3))["r"]
    assert got["alternatives"] == ["n10", "n09", "n08"]


def test_whole_snippets_are_hints(spark):
    name = "a" * 90 + " the end"
    matters = spark.createDataFrame([("m", "f", name + " of it", None, 1)], MATTERS)
    asked = hints(
        spark, ("r", "f", None, None, name), ("s", "f", None, None, "a" * 85 + " other")
    )
    assert set(answers(R.by_matter_name(asked, matters))) == {"r"}
    assert set(answers(R.by_matter_name(asked, matters, hint_chars=80))) == {"r", "s"}


def test_anchors_are_rare_in_texts(spark):
    """Parts rare among patterns but common in texts make no candidates."""
    texts = [("f", f"common words {i}") for i in range(300)] + [("f", "common zebra words")]
    patterns = [("f", "common zebra")]
    found = CT.containment_pairs(
        spark.createDataFrame(patterns, "firm_id string, pattern string"),
        spark.createDataFrame(texts, "firm_id string, text string"),
        lambda p, t: F.lit(True),
    )
    # Without a check of the text only the anchor decides.
    assert found.count() == 1


HANDOFFS = (
    "id string, firm_id string, doc_title string, doc_title_normalised string, "
    "paragraph_count int, word_count int, summary string, turn_count int, "
    "last_active timestamp, last_active_user_id string, created_at timestamp, "
    "updated_at timestamp"
)


def handoff(spark, rows):
    df = spark.createDataFrame(
        rows, "id string, firm_id string, doc_title string, p int, w int, day int"
    )
    at = F.timestamp_seconds(F.col("day") * 86400)
    return df.select(
        "id",
        "firm_id",
        "doc_title",
        X.normalise_title(F.col("doc_title")).alias("doc_title_normalised"),
        F.col("p").alias("paragraph_count"),
        F.col("w").alias("word_count"),
        F.concat(F.lit("s"), "id").alias("summary"),
        F.lit(1).alias("turn_count"),
        at.alias("last_active"),
        F.lit("u").alias("last_active_user_id"),
        at.alias("created_at"),
        at.alias("updated_at"),
    )


SIGNALS = (
    "request_id string, firm_id string, doc_title string, paragraph_count int, "
    "word_count int"
)


def test_match_and_update(spark):
    stored = handoff(
        spark,
        [
            ("h1", "f", "MSA.docx", 100, 5000, 1),
            ("h2", "f", "MSA v2.docx", 101, 5100, 3),
            ("h3", "f", "MSA_final.docx", 50, 2600, 9),
            ("h4", "g", "MSA.docx", 100, 5000, 9),
        ],
    )
    asked = spark.createDataFrame(
        [
            ("r1", "f", "msa v7.docx", 100, 5010),
            ("r2", "f", "msa.docx", 10, 400),
            ("r3", "f", "Other.docx", 100, 5000),
        ],
        SIGNALS,
    )
    got = answers(H.match_handoffs(asked, stored))
    assert (got["r1"]["handoff_id"], got["r1"]["tier"]) == ("h1", "exact")
    assert got["r1"]["other_candidates"] == 2
    assert not got["r2"]["found"] and not got["r3"]["found"]
    # The update takes the newest acceptable one, not the best.
    target = answers(H.update_targets(asked, stored))
    assert {k: v["handoff_id"] for k, v in target.items()} == {"r1": "h2"}
    updates = asked.select(
        "*", F.lit("new").alias("summary"), F.lit(None).cast("int").alias("turn_count"),
        F.lit("u9").alias("user_id"),
    )
    after = {r["id"]: r for r in H.upsert_handoffs(updates, stored).collect()}
    assert len(after) == 6 and after["h2"]["summary"] == "new"
    assert after["h2"]["turn_count"] == 0
    assert after["h2"]["created_at"].day == 4 and after["h2"]["updated_at"].year > 2000
    assert after["h1"]["summary"] == "sh1" and after["h4"]["firm_id"] == "g"


def test_an_old_exact_handoff_is_found(spark):
    rows = [(f"h{i:02d}", "f", "A.docx", 10 + (i > 0), 1000, 100 - i) for i in range(30)]
    rows[25] = ("h25", "f", "A.docx", 99, 1000, 75)
    asked = spark.createDataFrame([("r", "f", "A.docx", 99, 1000)], SIGNALS)
    got = H.match_handoffs(asked, handoff(spark, rows)).first()
    assert (got["tier"], got["handoff_id"]) == ("exact", "h25")
    assert got["other_candidates"] == 29
    # Among the newest twenty, where somebody asks for that, none fits exactly.
    got = H.match_handoffs(asked, handoff(spark, rows), n=20).first()
    assert got["tier"] == "loose" and got["other_candidates"] == 19


def test_empty_titles_are_reported(spark):
    df = spark.createDataFrame(
        [("f", "Final.docx"), ("f", "v2.docx"), ("f", "A.docx")],
        "firm_id string, doc_title string",
    )
    assert [tuple(r) for r in H.report_empty_titles(df).collect()] == [("f", 2)]


def test_texts_with_the_same_names_are_answered_together(spark, monkeypatch):
    matters = spark.createDataFrame(
        [(f"m{i:02d}", "f", "Blue Steel", "Acme" if i % 2 else "Other", None) for i in range(20)],
        "id string, firm_id string, matter_name string, client_name string, created_at timestamp",
    )
    hints = spark.createDataFrame(
        [(f"r{i:02d}", "f", None, None, f"note {i}: blue steel for acme") for i in range(30)],
        "request_id string, firm_id string, word_doc_id string, document_name string, "
        "content_snippet string",
    )
    sizes = {}

    def counting(df, name="cut"):
        out = written(df, name)
        sizes[name] = out.count()
        return out

    monkeypatch.setattr(R, "written", counting)
    got = R.by_names_in_hint(hints, matters).collect()
    assert sizes["sets"] == 1
    assert {r["request_id"] for r in got} == {f"r{i:02d}" for i in range(30)}
    odd = [f"m{i:02d}" for i in range(1, 20, 2)]
    even = [f"m{i:02d}" for i in range(0, 20, 2)]
    assert {(r["matter_id"], tuple(r["alternatives"])) for r in got} == {
        (odd[0], (*odd[1:], *even))
    }


def test_answers_are_not_shuffled_once_more(spark):
    docs = spark.createDataFrame(
        [("d1", "f", None, "Order 1 v1.docx", False, None)],
        "id string, firm_id string, matter_id string, name string, is_precedent boolean, "
        "word_doc_id string",
    )
    matters = spark.createDataFrame(
        [("m1", "f", "Blue Steel", None, None)],
        "id string, firm_id string, matter_name string, client_name string, created_at timestamp",
    )
    rows = [("r1", "f", None, "order 1", None), ("r2", "f", None, None, "blue steel"),
            ("r3", "f", None, None, "zzz")]
    schema = ("request_id string, firm_id string, word_doc_id string, document_name string, "
              "content_snippet string")
    got = R.resolve_documents(spark.createDataFrame(rows, schema), docs, matters)
    assert "LeftOuter" not in plan_of(got)
    assert sorted((r["request_id"], r["step"]) for r in got.collect()) == [
        ("r1", 2), ("r2", 3), ("r3", 0)
    ]
    # A request that is given twice is answered twice.
    twice = R.resolve_documents(spark.createDataFrame(rows + rows[2:], schema), docs, matters)
    assert sorted(r["request_id"] for r in twice.collect()) == ["r1", "r2", "r3", "r3"]


def test_blocks_of_sizes_hand_on_one_row_per_asked_size(spark, monkeypatch):
    rows = [("f", "Memo", i % 9, 100 + 3 * i) for i in range(60)]
    signals = spark.createDataFrame(
        [(f"r{i}", f, t, p + i % 4, w + i % 30) for i, (f, t, p, w) in enumerate(rows)],
        "request_id string, firm_id string, doc_title string, paragraph_count int, word_count int",
    )
    stored = spark.createDataFrame(
        [(f"h{i}", *r, "memo", "s", i % 7, "2024-01-01") for i, r in enumerate(rows)],
        "id string, firm_id string, doc_title string, paragraph_count int, word_count int, "
        "doc_title_normalised string, summary string, turn_count int, last_active string",
    ).withColumn("last_active", F.expr("to_timestamp(last_active) + make_dt_interval(turn_count)"))
    own = H.with_title_key(signals).select("doc_title_normalised").distinct().first()[0]
    stored = stored.withColumn("doc_title_normalised", F.lit(own))

    def answers():
        found = H.match_handoffs(signals, stored).collect()
        return sorted(found), sorted(H.update_targets(signals, stored).collect())

    monkeypatch.setattr(H, "FEW_SIZES", 1000)
    assert H.scored_sizes(signals, stored).count() > 1000
    plain = answers()
    monkeypatch.setattr(H, "FEW_SIZES", 0)
    monkeypatch.setattr(H, "BLOCK_PAIRS", 50)
    # One row per asked size and class of stored sizes, not one per pair.
    assert H.scored_sizes(signals, stored).count() <= 3 * 60
    assert answers() == plain
    monkeypatch.setattr(H, "BLOCK_SIZES", 7)
    assert answers() == plain


def test_update_blocks_compare_only_sizes_near_the_asked(monkeypatch):
    rng = random.Random(3)
    sizes = [(rng.choice([None, *range(9)]), rng.randint(-5, 4000)) for _ in range(900)]
    ages = [rng.randint(0, 50) for _ in sizes]
    stored = pa.table({
        "firm_id": ["f"] * 900, "doc_title_normalised": ["memo"] * 900,
        "paragraph_count": pa.array([p for p, _ in sizes], pa.int32()),
        "word_count": pa.array([w for _, w in sizes], pa.int32()),
        "age": ages, "handoff_id": [f"h{i:03d}" for i in range(900)], "_n": [1] * 900,
    })
    asks = sorted({(rng.randint(0, 12), rng.randint(-5, 4200)) for _ in range(700)})
    rng.shuffle(asks)
    asked = pa.table({
        "firm_id": ["f"] * len(asks), "doc_title_normalised": ["memo"] * len(asks),
        "_paragraphs": pa.array([p for p, _ in asks], pa.int32()),
        "_words": pa.array([w for _, w in asks], pa.int32()),
    })
    p0 = np.array([np.nan if p is None else p for p, _ in sizes], float)
    w0 = np.array([w for _, w in sizes], float)
    want = {}
    for p, w in asks:
        rank, _ = D.tiers_of_arrays(p0[None], w0[None], np.array([[p]], float), np.array([[w]], float))
        fits = np.flatnonzero(rank[0] <= 1)
        if fits.size:
            best = min(fits, key=lambda i: (ages[i], i))
            want[p, w] = (int(rank[0, best]), f"h{best:03d}", fits.size)
    plain, compared = D.tiers_of_arrays, []

    def counting(*sides):
        found = plain(*sides)
        compared.append(found[0].size)
        return found

    monkeypatch.setattr(H.D, "tiers_of_arrays", counting)
    monkeypatch.setattr(H, "BLOCK_PAIRS", 20_000)
    rows = H._block(True)(asked, stored).to_pylist()
    got = {(r["_paragraphs"], r["_words"]): (r["rank"], r["handoff_id"], r["_n"]) for r in rows}
    assert got == want and len(rows) == len(want) > 300
    assert sum(compared) < len(asks) * 900 / 4
    far = asked.set_column(3, "_words", pa.array([90_000] * len(asks), pa.int32()))
    assert H._block(True)(far, stored).num_rows == 0
