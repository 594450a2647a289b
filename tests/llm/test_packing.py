"""Packing against the tokenizer library and a plain best-fit."""

import random
import zlib
from array import array
from collections import defaultdict

import public_tokenizers
from tokenizers import Tokenizer

from matterlake.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, length string, Text string"


def library_ids(text):
    found = Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False)
    return [*found.ids, 0]


def odd_texts():
    rng = random.Random(3)
    letters = "abcXYZ ,.'\t\n\x0b\x0c  ́éẞ<|>0123٣中文ß İ\x1c\u0085ﬁ한국"
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(1, 80))) for _ in range(300)]
    return [
        *texts,
        "a<|endoftext|>b <|startoftext|> it's I'LL",
        "é ́e x́́ 가 ᄀ ᅡ",
        "",
        None,
        "word " * 9000,
        "x" * 50_000,
    ]


def test_ids_equal_the_library_on_odd_texts():
    texts = odd_texts()
    whole = Tokenizer.from_file(PATH).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for remembered in (packing.REMEMBERED, 5):
        got = list(packing.Ids(PATH, remembered).of(texts))
        assert [list(array("I", g)) for g in got] == [e.ids for e in whole]


def test_files_with_other_rules_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = packing.Ids(path)
    assert not ids.separable
    want = Tokenizer.from_file(path).encode("two  words here", add_special_tokens=False).ids
    assert list(array("I", next(ids.of(["two  words here"])))) == want


def plain_best_fit(lengths, capacity, most):
    free, out, n = {}, [], 0
    for length in lengths:
        fits = [(f, b) for b, f in free.items() if f >= length]
        if fits:
            f = min(fits)[0]
        else:
            if len(free) == most:
                least = min(free.values())
                free.pop(next(b for b in sorted(free, reverse=True) if free[b] == least))
            f, free[n] = capacity, capacity
            n += 1
        out.append(f)
        chosen = next(b for b, v in free.items() if v == f)
        free[chosen] -= length
        if not free[chosen]:
            del free[chosen]
    return out, n


def test_bins_are_best_fit():
    rng = random.Random(5)
    for most in (1, 3, 8):
        lengths = [rng.randint(1, 20) for _ in range(400)]
        bins = packing.Bins(20, most)
        places = [bins.put(n)[1] for n in lengths]
        free, n = plain_best_fit(lengths, 20, most)
        assert places == [20 - f for f in free]
        assert bins.n_bins == n
        assert bins.n_open <= most


def checked(rows, texts, capacity):
    """Pieces hold each document once; sequences are gapless and short enough."""
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(by_doc) == set(texts)
    for doc_id, text in texts.items():
        ids = library_ids(text)
        parts = sorted(by_doc[doc_id], key=lambda r: r["piece"])
        at = 0
        for k, r in enumerate(parts):
            part = ids[at : at + capacity]
            assert (r["piece"], r["start"], r["length"]) == (k, at, len(part))
            assert r["ids_crc32"] == zlib.crc32(array("I", part).tobytes())
            at += len(part)
        assert at == len(ids)
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by_sequence)


def test_packed_documents(spark):
    rng = random.Random(7)
    texts = {i: "lorem ipsum dolor " * rng.randrange(0, 40) for i in range(400)}
    texts |= {2**60 + 1: "large id", 500: None, 501: "", 502: "long text, " * 4000}
    rows = [(i, t, "x", "y") for i, t in texts.items()]
    for shard_tokens in (packing.SHARD_TOKENS, 5000):
        docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
        got = packing.packed(docs, PATH, 256, shard_tokens=shard_tokens).collect()
        n = checked(got, texts, 256)
        total = sum(r["length"] for r in got)
        assert n <= 1.1 * -(-total // 256)


def test_nulls_repeats_and_empty_tables(spark):
    conf = spark.conf.get("spark.sql.caseSensitive")
    rows = [(None, "a b", None, "other"), (None, "a b", None, None), (1, "c", "d", "e")]
    try:
        spark.conf.set("spark.sql.caseSensitive", "true")
        docs = spark.createDataFrame(rows, SCHEMA)
    finally:
        spark.conf.set("spark.sql.caseSensitive", conf)
    got = sorted((r["doc_id"] or 0, r["length"], r["offset"]) for r in packing.packed(docs, PATH).collect())
    assert [g[:2] for g in got] == [(0, 3), (0, 3), (1, 2)]
    assert len({g[2] for g in got}) == 3
    none = packing.packed(spark.createDataFrame([], SCHEMA.rsplit(",", 1)[0]), PATH)
    assert none.collect() == []
    assert none.columns[0] == "doc_id"
