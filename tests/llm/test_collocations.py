"""Phrase mining against counts of every phrase."""

import random
import re
from collections import Counter, defaultdict

import pytest

from matterlake.llm import collocations

SCHEMA = "doc_id long, lang string, text string, phrase string, a int"


def plain(rows, most, least):
    f, totals = defaultdict(Counter), Counter()
    for row in rows:
        lang = "und" if row[1] is None else row[1]
        text = re.sub("[A-Z]", lambda m: m[0].lower(), row[2] or "")
        for piece in re.split("[.,;:!?\n-\r]", text):
            words = re.findall("[^ \t]+", piece)
            totals[lang] += len(words)
            for size in (1, 2, 3):
                for i in range(len(words) - size + 1):
                    f[lang][tuple(words[i : i + size])] += 1
    out = []
    for lang, counts in f.items():
        candidates = {p: a for p, a in counts.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in candidates.items():
            cuts = [(counts[p[:k]], counts[p[k:]]) for k in range(1, len(p))]
            score, k = min((10**6 * a * a // (x * y), k) for k, (x, y) in enumerate(cuts))
            inside = [
                b
                for q, b in candidates.items()
                if len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))
            ]
            if not any(100 * b >= 50 * a for b in inside):
                found.append((-score, -a, " ".join(p).encode(), *cuts[k]))
        for rank, (s, a, p, x, y) in enumerate(sorted(found)[:most]):
            out.append((lang, rank + 1, p.decode(), -a, x, y, totals[lang], -s))
    return sorted(out)


def rows_of(n, seed=1):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["Éa", "the", "The", "x\x1cy", " "]
    rows = []
    for i in range(n):
        words = []
        for _ in range(rng.randrange(0, 30)):
            words.append(rng.choice(vocabulary[: rng.choice((5, 15, 45))]))
            if rng.random() < 0.2:
                words += ["new", "york", "city"][: rng.choice((2, 3, 3, 3))]
            words[-1] += rng.choice(("", "", "", "", ".", ",", ";\n", "\r", "!?"))
        rows.append((i, rng.choice(("en", "en", "de", None)), " ".join(words), "clash", 1))
    return rows


def mined(spark, rows, **more):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    return sorted(map(tuple, collocations.mine(docs, **more).collect()))


@pytest.mark.parametrize(("most", "slack"), [(5, 1), (20, 2), (2000, 2)])
def test_phrases_equal_plain_counts(spark, most, slack):
    rows = rows_of(300)
    assert mined(spark, rows, most=most, least=4, slack=slack) == plain(rows, most, 4)


def test_covered_phrases_lower_the_level(spark, monkeypatch):
    """Most of the best pairs fall to a longer phrase, so more rounds are needed."""
    rows = [(i, "en", f"a{k} b{k} c{k}", None, None) for k in range(12) for i in range(10 + k)]
    rows += [(i, "en", f"p{k} q{k}. p{k}", None, None) for k in range(6) for i in range(10)]
    rounds = []
    grown = collocations._grown
    monkeypatch.setattr(
        collocations, "_grown", lambda pairs, r: rounds.append(len(r)) or grown(pairs, r)
    )
    got = mined(spark, rows, most=15, least=10, slack=1)
    assert got == plain(rows, 15, 10)
    assert len(got) == 15
    assert len(rounds) > 1


def test_small_filters_and_tables_change_nothing(spark, monkeypatch):
    rows = rows_of(200, seed=4)
    monkeypatch.setattr(collocations, "HELD", 7)
    monkeypatch.setattr(collocations, "VOCABULARY", 20)
    monkeypatch.setattr(collocations, "PROBES", 1)
    assert mined(spark, rows, most=10, least=3) == plain(rows, 10, 3)


def test_nulls_repeats_long_texts_and_empty_tables(spark):
    rows = [(1, None, None, None, None), (2, "en", "", None, None), (3, "und", "U V " * 20, None, None)]
    rows += [(4, None, "u v. u v", None, None)] * 5 + [(5, "fr", "l o n g " * 20_000, None, None)]
    assert mined(spark, rows) == plain(rows, 2000, 10)
    assert mined(spark, []) == []


def test_scores_beyond_64_bits(spark):
    big = 10**13
    df = spark.createDataFrame([(big, big + 1, 10 * big)], "a long, l long, r long")
    a, left, right = df["a"], df["l"], df["r"]
    got = df.select(collocations._ratio(a, left, right)).first()[0]
    assert got == 10**6 * big * big // ((big + 1) * 10 * big)
