"""The Merkle manifest against a plain tree."""

import zlib
from collections import defaultdict
from hashlib import sha256

import pytest

from matterlake.llm import manifest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos int"


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return h(*map(field, (doc_id, source, lang, n_chars, text)))


def grown(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        b = levels[-1]
        levels.append([h(*b[i : i + 2]) for i in range(0, len(b), 2)])
    return levels


def path(levels, i):
    out = []
    for level in levels[:-1]:
        other = i ^ 1
        out.append((other < i, level[other] if other < len(level) else None))
        i >>= 1
    return out


def plain(rows):
    trees = defaultdict(list)
    for row in rows:
        doc_id, text, lang, source, n_chars = row[:5]
        bent = doc_id is not None and n_chars is not None and zlib.crc32(str(doc_id).encode()) % 7 == 0
        own = leaf(doc_id, text, lang, source, n_chars)
        checked = leaf(doc_id, text, lang, source, n_chars + 1) if bent else own
        trees[lang].append(((doc_id is not None, doc_id or 0, own), doc_id, own, checked))
    order = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    levels = {t: grown([r[2] for r in sorted(trees[t], key=lambda r: r[0])]) for t in order}
    crown = grown([levels[t][-1][0] for t in order])
    out = []
    for k, t in enumerate(order):
        for i, (_, doc_id, own, checked) in enumerate(sorted(trees[t], key=lambda r: r[0])):
            steps = path(levels[t], i) + path(crown, k)
            node = checked
            for is_left, other in steps:
                node = h(other, node) if is_left else h(node, other or "")
            proof = h(*[s for _, s in steps if s is not None])
            root = crown[-1][0]
            out.append((doc_id, own, levels[t][-1][0], root, proof, node, node == root))
    return out


def rows_of(n, langs):
    rows = []
    for i in range(n):
        lang = langs[i % len(langs)] if i % 5 else langs[0]
        rows.append((i * 3, f"text é {i}" * (i % 4), lang, f"s{i % 3}", i, "tree", 1))
    return rows


def compare(spark, rows, block):
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = sorted(map(tuple, manifest.manifest(docs, block).collect()), key=repr)
    assert got == sorted(plain(rows), key=repr)
    return got


@pytest.mark.parametrize(("n", "block"), [(150, 4), (70, 1024), (65, 2)])
def test_manifest_equals_a_plain_tree(spark, n, block):
    got = compare(spark, rows_of(n, ["en", None, "de", "", "é", "fr"]), block)
    assert {r[-1] for r in got} == {True, False}
    assert all(r[-1] for r in got if r[0] is None or zlib.crc32(str(r[0]).encode()) % 7)


def test_nulls_repeats_and_a_single_row(spark):
    rows = [
        (None, None, None, None, None, None, None),
        (None, "", None, "s", 0, None, None),
        (2**61, "long " * 50_000, "en", "s", 250_000, "x", 1),
        *[(7, "same", "en", "s", 4, "x", 1)] * 9,
        (7, "other", "en", "s", 4, "x", 1),
        (8, "a", "=", None, 2**63 - 1, "x", 1),
    ]
    compare(spark, rows, 4)
    compare(spark, rows[2:3], 1024)


def test_empty_table(spark):
    found = manifest.manifest(spark.createDataFrame([], SCHEMA))
    assert found.collect() == []
    assert found.columns[-1] == "verified"


def test_depth():
    assert [manifest.depth(n) for n in (0, 1, 2, 3, 4, 5, 1024, 1025)] == [0, 0, 1, 2, 2, 3, 10, 11]
