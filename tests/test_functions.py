"""Golden rows of the column functions."""

import pytest
from pyspark.sql import functions as F

from matterlake.functions import coerce as C
from matterlake.functions import scoring as D
from matterlake.functions import temporal as M
from matterlake.functions import text as X


def values(spark, rows, names, column):
    df = spark.createDataFrame(rows, names)
    return [r[0] for r in df.select(column).collect()]


TITLES = {
    "Contract_final_v3 (2).docx": "contract",
    "Contract v3.docx": "contract",
    "NDA (2).docx": "nda",
    "Order Form_DRAFT.docx": "order form",
    "SOW 2026 002 - Amendment 1 (2).docx": "sow 2026 002 - amendment 1",
    "MSA v1.2 - signed (12).doc": "msa",
    "Agreement.pdf": "agreement.pdf",
    "rev2.docx": "re",
    "semifinal.docx": "semi",
    "Final.docx": "",
    " A\t B ": "a b",
}


def test_normalise_title(spark):
    found = values(
        spark, [(t,) for t in TITLES], "t string", X.normalise_title(F.col("t"))
    )
    assert found == list(TITLES.values())


def test_normalise_title_is_stable_on_bare_titles(spark):
    bare = sorted(set(TITLES.values()) - {"agreement.pdf"})
    again = values(
        spark, [(t,) for t in bare], "t string", X.normalise_title(F.col("t"))
    )
    assert again == bare


def test_clean_hint(spark):
    rows = [("Elion NDA_v4.docx",), ("A_final_Clean.PDF",), ("100%_x.doc",), ("x.rtf",)]
    found = values(spark, rows, "t string", X.clean_hint(F.col("t")))
    assert found == ["Elion NDA", "A", "100x", "x.rtf"]


WORD_CASES = [
    ("NDA", "Form - Mutual NDA - May.docx", True),
    ("NDA", "the standard form", False),
    ("Elion", "between Elion Holdco Limited", True),
    ("elion", "between ELION Holdco", True),
    ("tude", "étude", True),
    ("Acme Inc.", "Acme Inc. and", False),
    ("Acme Inc.", "Acme Inc.x", True),
    ("a+b", "x a+b y", True),
    ("ab", "x ab y", False),
    ("x\\Ey", "a x\\Ey b", True),
]


def test_contains_word(spark):
    rows = [c[:2] for c in WORD_CASES]
    found = values(
        spark, rows, "n string, t string", X.contains_word(F.col("n"), F.col("t"))
    )
    assert found == [c[2] for c in WORD_CASES]


def test_sentences(spark):
    text = [("cost 3.14 dollars. Next one! tail",)]
    lossy = values(spark, text, "t string", X.sentences(F.col("t"), lossy=True))
    assert lossy == [["14 dollars. ", "Next one! "]]
    keeping = values(spark, text, "t string", X.sentences(F.col("t")))
    assert keeping == [["cost 3.14 dollars. ", "Next one! ", "tail"]]


def test_sentences_read_long_texts_once(spark):
    rows = [("x" * 400_000,), ("." * 400_000,), ("a. " * 100_000,)]
    found = values(spark, rows, "t string", F.size(X.sentences(F.col("t"), True)))
    assert found == [0, 0, 100_000]


def test_tokens_words_paragraphs(spark):
    rows = [("",), ("a",), ("abcd",), ("abcde",)]
    found = values(spark, rows, "t string", X.approx_tokens(F.col("t")))
    assert found == [0, 1, 1, 2]
    rows = [("a\r\n\r\nb c\n\n\n \n\nd ",)]
    assert values(spark, rows, "t string", X.paragraphs(F.col("t"))) == [
        ["a", "b c", "d"]
    ]
    assert values(spark, rows, "t string", X.words(F.col("t"))) == [
        ["a", "b", "c", "d"]
    ]


def test_haystack_and_context(spark):
    rows = [("a", None), ("", "b"), ("a", "b")]
    found = values(
        spark, rows, "a string, b string", X.haystack(F.col("a"), F.col("b"))
    )
    assert found == ["a", "b", "a b"]
    rows = [(None, None, None, None, "T"), ("m", "c", "c", "nda", "T")]
    names = "m string, c string, s string, k string, t string"
    cols = [F.col(c) for c in "mcskt"]
    plain, full = values(spark, rows, names, X.context_block(*cols))
    assert plain == "T"
    assert full == "matter = m\nclient = c\nside = c\nkind = nda\n\nT"
    own = X.context_block(*cols, labels=("A", "B", "C", "D"))
    assert values(spark, rows, names, own)[1] == "A = m\nB = c\nC = c\nD = nda\n\nT"


TIERS = [
    (100, 5000, 100, 5040, "exact", 0.794),
    (100, 5000, 110, 5200, "close", 13.846),
    (100, 5000, 50, 2600, "loose", 98.0),
    (100, 5000, 100, 2400, None, None),
    (0, 0, 0, 0, "exact", 0.0),
    (3, 10, 5, 28, "close", 66.286),
    (10, 100, 12, 121, "loose", 19.355),
]


def test_match_tier(spark):
    df = spark.createDataFrame(
        [t[:4] for t in TIERS], "p0 int, w0 int, p1 int, w1 int"
    )
    cols = [F.col(c) for c in ("p0", "w0", "p1", "w1")]
    got = df.select(D.match_tier(*cols), D.combined_delta(*cols)).collect()
    for row, case in zip(got, TIERS):
        assert row[0] == case[4]
        if case[5] is not None:
            assert row[1] == pytest.approx(case[5], abs=1e-3)


def test_cosine_distance(spark):
    rows = [([1.0, 0.0], [0.0, 2.0]), ([1.0, 1.0], [2.0, 2.0]), ([0.0, 0.0], [1.0, 0.0])]
    rows += [([1.0], [1.0, 0.0])]
    names = "u array<float>, v array<float>"
    found = values(spark, rows, names, D.cosine_distance(F.col("u"), F.col("v")))
    assert found[0] == pytest.approx(1.0) and found[1] == pytest.approx(0.0)
    assert found[2] is None and found[3] is None
    sim = values(spark, [(1.5,), (0.25,)], "d double", D.similarity(F.col("d")))
    assert sim == [0.0, 0.75]


def test_coercions(spark):
    rows = [("1.7",), ("abc",), ("-0.2",), (None,), (" 0.5 ",), ("1d",), ("NaN",)]
    found = values(spark, rows, "c string", C.clamp_confidence(F.col("c")))
    assert found == [1.0, 0.0, 0.0, 0.0, 0.5, 0.0, 0.0]
    rows = [("12 months",), (None,), ('{"a": 1}',), ("[1]",), ('{"a"',), ('say "x"',)]
    assert values(spark, rows, "c string", C.json_value(F.col("c"))) == [
        '{"raw":"12 months"}',
        '{"raw":""}',
        '{"a": 1}',
        "[1]",
        '{"raw":"{\\"a\\""}',
        '{"raw":"say \\"x\\""}',
    ]
    rows = [("settled",), ("agreed",), (None,)]
    assert values(spark, rows, "c string", C.position_status(F.col("c"))) == [
        "settled",
        "open",
        "open",
    ]
    rows = [("mutual",), ("them",), (None,)]
    assert values(spark, rows, "c string", C.party_role(F.col("c"))) == [
        "mutual",
        None,
        None,
    ]


def test_normalise_parties(spark):
    rows = [
        ('[{"id":"x","kind":"client"},{"name":"Y","role":"supplier"},5,{}]',),
        ('{"a":1}',),
        (None,),
        ('[{"partyId":7,"id":"z","kind":"common_interest"},"t",null,["n"]]',),
    ]
    found = values(spark, rows, "p string", C.normalise_parties(F.col("p")))
    assert [[tuple(p) for p in one] for one in found] == [
        [
            ("x", "client", "party"),
            ("Y", "counterparty", "supplier"),
            ("unknown", "counterparty", "party"),
        ],
        [],
        [],
        [("z", "common_interest", "party"), ("unknown", "counterparty", "party")],
    ]


def test_others_of(spark):
    rows = [(["a", None, "b", "c", "d", "e"], "b")]
    for n, want in ((3, ["a", "c", "d"]), (None, ["a", "c", "d", "e"])):
        found = values(
            spark, rows, "i array<string>, c string", C.others_of(F.col("i"), F.col("c"), n)
        )
        assert found == [want]


def test_times(spark):
    df = spark.sql(
        "SELECT 100L AS iat, timestamp_seconds(101) AS cut, "
        "timestamp'2024-03-05 10:00:00' AS t, cast(null as timestamp) AS n"
    )
    row = df.select(
        M.issued_before(F.col("iat"), F.col("cut")),
        M.issued_before(F.col("iat"), F.col("n")),
        F.date_format(M.expiry(F.col("t")), "HH:mm"),
        M.unexpired(M.expiry(F.col("t")), F.col("t")),
        M.display_date(F.col("t")),
        M.display_date(F.col("n")),
        M.duration_ms(F.col("cut"), F.timestamp_seconds(F.lit(103))),
        M.same_address(F.lit("A@x.org"), F.lit("a@X.org")),
    ).first()
    assert tuple(row) == (
        True, False, "10:05", True, "Mar 5, 2024", "—", 2000, True,
    )
