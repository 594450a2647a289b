"""Small tests of each operator: brute force, round trips and edge rows."""

import hashlib
import math
import random
import re
import tracemalloc

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matterlake.llm import (
    bpe,
    htmltext,
    licenses,
    mixing,
    neardup,
    quality,
    search,
    simhash,
    tokencount,
    toxicity,
)
from matterlake.llm.blocks import Texts
from matterlake.llm.labelled import fold

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score int"
# Nulls, empty and long texts, repeated rows, an extra column that clashes.
EDGE = [
    (1, "one two three four five six", "en", "a", 27, 9),
    (1, "one two three four five six", "en", "a", 27, 9),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, 1),
    (None, "a row without an id", "en", "b", 5, 2),
    (4, "word " * 30_000, "en", "b", 150_000, 3),
    (5, "é日本 😀\n\n 'tis", "fr", "b", 9, 4),
]


@pytest.fixture(scope="module")
def edge(spark):
    return spark.createDataFrame(EDGE, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted(map(str, df.collect()))


def random_texts(n, seed=3):
    rng = random.Random(seed)
    parts = ["'", "r", "e", "ll", " ", "  ", "\n", "\t", "12", "é", "日本", "!", " the", "don't", "<|endoftext|>", "aaa", "😀", " "]
    return ["".join(rng.choice(parts) for _ in range(rng.randint(0, 50))) for _ in range(n)]


# -- 1 ------------------------------------------------------------------------

PAGE = (
    "<html><head><title>t</title></head><body><nav><a href=x>Home of the site</a></nav>"
    "<div class='ad'>Buy the best thing of the year now, it is the one you want</div>"
    "<article><h1>Title &amp; more</h1><p>It was  the best\nof times and it was the worst "
    "of times for all of the people in the city.<p>Short.<div class=comments><p>I like "
    "that this is the best of the texts that I have seen.</p></div><script>p('<p>x')"
    "</script></article><footer>The footer of the page</footer></body>"
)


def test_main_text():
    assert htmltext.main_text(PAGE) == (
        "Title & more\nIt was the best of times and it was the worst of times for all of "
        "the people in the city.\nShort."
    )
    for empty in (None, "", "<p></p>", "<script>x</script>"):
        assert htmltext.main_text(empty) == ""
    assert htmltext.main_text("no markup at all") == "no markup at all"
    assert htmltext.main_text("<div>" * 5000 + "<" * 50) == "<" * 50


def test_main_text_of_whole_pages():
    text = "It was the best of times and it was the worst of times for all of the people in the city."
    for page in (
        f'<html><body class="no-sidebar"><p>{text}',
        f'<html class="has-sidebar"><body class="search-results"><main id="search"><p>{text}</main>',
        f'<body class="no-sidebar"><nav>The menu</nav><article class="post related"><p>{text}'
        f'<article class="comment"><p>{text}</article></article>',
        f'<div role="main" class="with-sidebar"><p>{text}</div>',
        f"<head><title>t</title><meta name=a><script>'<p>{text}'</script><p>{text}",
        f"<head><title>t</title><link rel=a><body><p>{text}",
        f"<head class=nav><style>p</style>{text}",
    ):
        assert htmltext.main_text(page) == text
    for page in (f"<article hidden><p>{text}</article>", f"<div class=sidebar><p>{text}</div>"):
        assert htmltext.main_text(page) == ""


def test_extract_rows(spark):
    pages = spark.createDataFrame(
        [(1, "u", PAGE, "old"), (1, "u", PAGE, "old"), (None, None, None, None)],
        "page_id long, url string, html string, text string",
    )
    got = htmltext.extract(pages)
    assert got.columns == ["page_id", "url", "text"]
    assert [r.text[:5] for r in got.orderBy("page_id").collect()] == ["", "Title", "Title"]
    assert htmltext.extract(pages.limit(0)).count() == 0


# -- 2 ------------------------------------------------------------------------


def test_votes_by_hand():
    rng = np.random.default_rng(0)
    h = rng.integers(0, 1 << 63, 1500).astype(np.uint64)
    row = np.sort(rng.integers(0, 4, 1500))
    votes = np.zeros((5, 64), np.int32)
    simhash._vote(votes, h, row, 3)
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(int)
    for r in range(5):
        assert (votes[r] == 3 * (2 * bits[row == r] - 1).sum(axis=0)).all()


def test_against_edit(spark, edge, none):
    got = {}
    for r in simhash.against_edit(edge).collect():
        got.setdefault(r.doc_id, []).append(r)
    ordered = sorted(EDGE, key=lambda r: (r[0] is not None, r[0] or 0))
    texts = [r[1] or "" for r in ordered]
    for i, (doc, *_), in enumerate(ordered):
        own, after = texts[i], texts[(i + 1) % len(texts)]
        edit = own[: len(own) - len(own) // 2] + after[: len(own) // 2]
        digest = hashlib.sha256(edit.encode()).hexdigest()
        assert digest in [r.edited_sha256 for r in got[doc]]
        assert {r.n_chars for r in got[doc]} == {len(own)}
    assert len({r.fingerprint for r in got[1]}) == 1
    assert simhash.against_edit(none).count() == 0
    single = simhash.against_edit(edge.where("doc_id = 5")).collect()
    assert len(single) == 1 and single[0].near_next == 1.0


def test_radius_search_is_complete(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(128) for _ in range(40)]
    prints = base + [b ^ sum(1 << i for i in rng.sample(range(128), rng.randint(0, 6))) for b in base]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    got = {(r.left_print, r.right_print) for r in simhash.within(df, df, 4, 128).collect()}
    want = {(f"{a:032x}", f"{b:032x}") for a in prints for b in prints if (a ^ b).bit_count() <= 4}
    assert got == want


# -- 3 ------------------------------------------------------------------------


def test_topk_by_brute_force(spark, edge, none):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(60)]
    data = [(i, " ".join(rng.choices(words, weights=range(1, 61), k=rng.randint(0, 40)))) for i in range(300)]
    data += [(i + 300, t) for i, t in data[:20]] + [(900, None)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(5)
    bags = [(i, (t or "").split()) for i, t in data]
    n, mean = len(bags), sum(len(b) for _, b in bags) / len(bags)
    df = {w: sum(w in b for _, b in bags) for w in words}
    want = set()
    for q, asked in bags:
        if q % 10:
            continue
        hits = []
        for d, b in bags:
            s = sum(
                math.log(1 + (n - df[w] + 0.5) / (df[w] + 0.5))
                * b.count(w) * 2.2 / (b.count(w) + 1.2 * (0.25 + 0.75 * len(b) / mean))
                for w in set(asked) & set(b)
            )
            if s > 0:
                hits.append((-round(s, 5), d))
        want |= {(q, rank + 1, d) for rank, (_, d) in enumerate(sorted(hits)[:7])}
    index = search.build_index(docs)
    for block in (100, 10**6):
        got = search.search(index, docs.where("doc_id % 10 = 0"), 7, block_terms=block)
        assert {(r.query_id, r.rank, r.doc_id) for r in got.collect()} == want
    edges = search.search(search.build_index(edge), edge, 3).collect()
    assert {r.query_id for r in edges} == {1, 4, 5}
    assert search.search(search.build_index(none), edge, 3).count() == 0
    assert search.search(index, none, 3).count() == 0


def test_topk_counts_of_long_documents(spark):
    data = [(1, "w " * 200_000), (2, "w " * 65_536), (3, "w " * 65_535)]
    data += [(i, "x y") for i in range(4, 1000)]
    index = search.build_index(spark.createDataFrame(data, "doc_id long, text string"))
    asked = spark.createDataFrame([(7, "w")], "doc_id long, text string")
    mean = sum(len(t.split()) for _, t in data) / len(data)
    want = {}
    for d, t in data[:3]:
        n = t.count("w")
        want[d] = math.log(1 + (len(data) - 2.5) / 3.5) * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * n / mean))
    got = {r.doc_id: r.score for r in search.search(index, asked, 5).collect()}
    assert got == pytest.approx(want, abs=2e-6)


def test_topk_of_repeated_queries(spark):
    rng = random.Random(8)
    data = [(i, " ".join(rng.choices([f"w{j}" for j in range(40)], k=12))) for i in range(200)]
    docs = spark.createDataFrame(data, "doc_id long, text string").repartition(6)
    index = search.build_index(docs)

    def hits(*asked):
        queries = spark.createDataFrame(asked, "doc_id long, text string").repartition(3)
        return sorted(map(tuple, search.search(index, queries, 7).collect()))

    want = hits((1, "w1 w2 w3"), (2, "w4 w5 w6"))
    assert len({(q, d) for q, _, d, _ in want}) == 14
    got = hits((1, "w1 w2 w3"), (1, "w1 w2 w3"), (1, "w3 w1 w2 w1"), (2, "w4 w5"), (2, "w6 w5"), (2, None))
    assert got == want


# -- 4, 6 ---------------------------------------------------------------------


def labelled_docs(spark, bad, n=240):
    rng = random.Random(2)
    plain = "river stone walk green slowly under cloud paper table window".split()
    data, marks = [], []
    for i in range(n):
        y = i % 3 == 0
        text = " ".join(rng.choices(plain, k=30))
        data.append((i, bad(text) if y else text))
        marks.append((i, int(y), int(not y)))
    docs = spark.createDataFrame(data, "doc_id long, text string")
    return docs, spark.createDataFrame(marks, "doc_id long, toxic int, quality int")


def accuracy(scored, labels, label, held, least):
    got = scored.where(held).join(labels, "doc_id").collect()
    return sum((r.score >= least) == bool(r[label]) for r in got) / len(got)


def test_toxicity(spark, edge, none):
    docs, labels = labelled_docs(spark, lambda t: "you awful fool " + t)
    held = fold(F.col("doc_id"), 5) == 0
    model = toxicity.fit(docs, labels, ~held)
    assert accuracy(toxicity.score(docs, model), labels, "toxic", held, 0.5) >= 0.95
    got = toxicity.score(edge, model)
    assert got.columns[-1] == "score" and got.count() == len(EDGE)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(none, model).count() == 0
    empty = toxicity.fit(none, labels.limit(0), ~held)
    assert toxicity.score(edge, empty).count() == len(EDGE)


def test_swapped_groups_score_alike():
    def present(text):
        return np.unique(toxicity.features(Texts(pa.array([text])))[0])

    toxic = [f"those women are stupid number{i}" for i in range(20)]
    clean = [f"those chairs are wooden number{i}" for i in range(40)]
    data = [(present(t), 1.0) for t in toxic] + [(present(t), 0.0) for t in clean]
    pairs = [p for t in toxic for p in toxicity.counterfactuals(t)]
    assert len(pairs) == 60
    swaps = [(present(a), present(b)) for a, b in pairs]

    def gap(model):
        a, b = model.scores(Texts(pa.array(["women are wooden", "men are wooden"])))
        return a - b

    assert gap(toxicity.fit_rows(data, swaps, 20.0)) < 0.5 * gap(toxicity.fit_rows(data, [], 0.0))


def test_toxicity_fit_holds_features_once():
    rng = np.random.default_rng(1)
    rows = [
        (np.unique(rng.integers(0, toxicity.WIDTH, 2000)).astype(np.int32), float(i % 2))
        for i in range(4000)
    ]
    tracemalloc.start()
    toxicity.fit_rows(rows, [])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # The rows themselves take 32 MB.
    assert peak < 150e6


def test_swaps_carry_what_they_change():
    lone, other = toxicity._changed("all those women sing", "all those men sing")
    words = Texts(pa.array(["women", "men", "those"]))
    women, men, those = (f for f in toxicity.features(words)[0][:3])
    assert women in lone and men in other
    assert those not in lone and those not in other


def test_quality(spark, edge, none):
    docs, labels = labelled_docs(spark, lambda t: t.replace(" ", "!!# "))
    held = fold(F.col("doc_id"), 4) == 2
    net = quality.fit(docs, labels, ~held)
    assert accuracy(quality.score(docs, net), labels, "quality", held, 0.7) >= 0.95
    got = quality.score(edge, net)
    assert got.count() == len(EDGE)
    assert got.where("score is null or score < 0 or score > 1").count() == 0
    assert quality.score(none, net).count() == 0


def test_quality_learns_from_whole_texts(spark, monkeypatch):
    long = "".join(f"word {i} " for i in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, "short")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "train", lambda rows: rows)
    got = {y: data.rstrip(b"\0") for data, _, y in quality.fit(docs, labels, F.lit(True))}
    assert got == {1.0: long.encode(), 0.0: b"short"}


def test_quality_gradient_in_parts(monkeypatch):
    net = quality.Network.fresh(np.random.default_rng(1))
    rows = []
    for i, text in enumerate(random_texts(9)):
        data, flags, _ = quality.padded(Texts(pa.array([text * 30])))
        rows.append((data.tobytes(), flags.tobytes(), float(i % 2)))
    whole = quality._batch_gradient(net, rows)
    monkeypatch.setattr(quality, "BLOCK", 2_000)
    for a, b in zip(whole, quality._batch_gradient(net, rows)):
        assert np.allclose(a, b, atol=1e-5)


def test_quality_does_not_depend_on_neighbours():
    net = quality.Network.fresh(np.random.default_rng(1))
    texts = random_texts(40) + ["x" * 248, "y" * 256, "long " * 500]
    together = net.scores(Texts(pa.array(texts)))
    alone = [net.scores(Texts(pa.array([t])))[0] for t in texts]
    assert np.allclose(together, alone, atol=1e-5)


def test_quality_gradient():
    net = quality.Network.fresh(np.random.default_rng(1))
    batch = quality.padded(Texts(pa.array(["some text here", "other words " * 60])))
    y = np.array([1.0, 0.0])

    def loss():
        z = net.forward(*batch)["logit"].astype(float)
        return float(np.mean(np.log1p(np.exp(z)) - y * z))

    grads = net.gradient(*batch, y)
    for name, g in zip(("last", "hidden", "filters", "embed"), (grads[5], grads[3], grads[1], grads[0])):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        p = getattr(net, name)
        keep, step = p[at], 1e-3
        p[at] = keep + step
        up = loss()
        p[at] = keep - step
        down = loss()
        p[at] = keep
        assert (up - down) / (2 * step) == pytest.approx(g[at], rel=0.1, abs=1e-4)


# -- 5, 8 ---------------------------------------------------------------------

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("leaf", [2, 5, 4096])
def test_tree_encoding(leaf):
    ranks = bpe.read_ranks(open(RANKS, "rb").read())
    plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.TreeCodec(ranks, public_tokenizers.PATTERN, leaf)
    for t in [*random_texts(600), "a" * 3000, " " * 3000, "ab'" * 2000]:
        ids = codec.encode(t)
        assert ids.tolist() == plain.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()


def test_encode_decode_rows(edge, none):
    got = bpe.decode(bpe.encode(edge, RANKS, public_tokenizers.PATTERN), RANKS, public_tokenizers.PATTERN)
    assert got.count() == len(EDGE)
    for r in got.collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.round_trip(none, RANKS, public_tokenizers.PATTERN).count() == 0
    assert bpe.round_trip(edge, RANKS, public_tokenizers.PATTERN).where("n_tokens = 0").count() == 2


def test_token_counts(edge, none):
    machine = tokencount.Machine(open(VOCABULARY, "rb").read())
    library = Tokenizer.from_file(VOCABULARY)
    texts = [*random_texts(3000), "q" * 2000, "é日" * 300, "-" * 700]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    assert machine.count(texts).tolist() == want
    for t in random_texts(150, 9):
        t = t.replace("<|endoftext|>", "")
        for chunk in (3, 7, 40):
            assert machine.count_long(t, chunk) == machine.count([t])[0]
    got = {(r.doc_id, r.n_tokens) for r in tokencount.token_counts(edge, VOCABULARY).collect()}
    assert got == {(r[0], len(library.encode(r[1] or "", add_special_tokens=False).ids)) for r in EDGE}
    assert tokencount.token_counts(none, VOCABULARY).count() == 0


def test_patterned_words_are_told_apart():
    """Words that share any polynomial sum modulo a power of two."""
    library = Tokenizer.from_file(VOCABULARY)
    texts = []
    for a, b in ("ab", "01", "on"):
        bits = [bin(i).count("1") % 2 for i in range(4096)]
        texts += ["".join((a, b)[x ^ flip] for x in bits) for flip in (0, 1)]
    texts += texts[::-1]
    want = [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    machine = tokencount.Machine(open(VOCABULARY, "rb").read())
    assert machine.count(texts).tolist() == want
    assert [machine.count([t])[0] for t in texts] == want
    assert len(set(want)) > 1


# -- 7 ------------------------------------------------------------------------


def test_mix(spark, edge, none):
    rng = random.Random(4)
    data = [
        (i, "w " * rng.randint(0, 40), "abcd"[min(3, i % 7)] if i % 11 else None) for i in range(400)
    ]
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    assert len(got) == 400 and rows(mixing.mix(docs)) == sorted(map(str, got))
    source = {i: s for i, _, s in data}
    by = {}
    for r in got:
        assert 0 <= r.taken <= 2 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(1.5 * sum(r.size for r in got))
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert sum(r.taken for r in rs) == round(rs[0].target)
        assert rs[0].target <= 2 * rs[0].source_size + 1e-9
    whole = mixing.mixed_documents(docs)
    assert whole.columns == docs.columns
    count = mixing.word_count(F.col("text"))
    assert whole.agg(F.sum(count)).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(edge).count() == len(EDGE)
    assert mixing.mix(none).count() == 0 and mixing.mixed_documents(none).count() == 0
    plan = mixing.mixed_documents(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


# -- 9 ------------------------------------------------------------------------


def test_dart_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    got = []
    for _ in range(30):
        e = np.sort(rng.integers(1, 1 << 62, 60).astype(np.uint64))
        a, b = rng.integers(1, 5, 60).astype(float), rng.integers(1, 5, 60).astype(float)
        s = neardup.dart_signatures(np.concatenate((e, e)), np.repeat([0, 1], 60), np.concatenate((a, b)), 2)
        want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
        got.append((s[0] == s[1]).mean() - want)
    assert abs(np.mean(got)) < 0.03


def test_parities_never_drop_a_near_pair():
    rng = np.random.default_rng(1)
    for size in (1, 9, 200, 6000):
        base = np.unique(rng.integers(1, 1 << 62, size).astype(np.uint64))
        for share in (0.0, 0.05, 0.1, 0.11, 0.3):
            keep = base[rng.random(len(base)) >= share]
            other = np.union1d(keep, rng.integers(1, 1 << 62, int(size * share)).astype(np.uint64))
            if not len(other):
                continue
            both = np.concatenate((base, other))
            row = np.repeat([0, 1], [len(base), len(other)])
            bits = neardup.parities(both, row, 2)
            apart = int(np.bitwise_count(bits[0] ^ bits[1]).sum())
            assert apart <= len(np.setxor1d(base, other))
            same = np.zeros((1, neardup.COORDINATES), np.uint8)
            may = neardup.may_be_near(
                (same, bits[:1], np.array([len(base)])), (same, bits[1:], np.array([len(other)]))
            )[0]
            near = len(np.intersect1d(base, other)) >= 0.8 * len(np.union1d(base, other))
            assert may or not near
            if size == 200 and share == 0.3:
                assert not may


def brute_classes(data):
    def elements(t):
        w = [x for x in re.split(r"[ \t-\r]+", (t or "").lower()) if x]
        return frozenset(zip(*(w[i:] for i in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [elements(t) for _, t in data]
    label = list(range(len(data)))
    changed = True
    near = [
        (i, j)
        for i in range(len(data))
        for j in range(i)
        if sets[i] == sets[j] or (sets[i] | sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    ]
    while changed:
        changed = False
        for i, j in near:
            low = min(label[i], label[j])
            if label[i] != low or label[j] != low:
                label[i] = label[j] = low
                changed = True
    return {data[i][0]: data[label[i]][0] for i in range(len(data))}


@pytest.mark.parametrize("block", [256, 4])
def test_near_duplicate_classes(spark, edge, none, monkeypatch, block):
    monkeypatch.setattr(neardup, "BLOCK", block)
    rng = random.Random(6)
    data, base = [], [f"w{i}" for i in range(60)]
    for family in range(6):
        own = [f"{w}f{family}" for w in base]
        for _ in range(12):
            copy = list(own)
            for _ in range(rng.randint(0, 3)):
                copy[rng.randrange(60)] = f"x{rng.random()}"
            data.append((len(data), " ".join(copy)))
    data += [(100 + i, t) for i, t in ((0, ""), (1, None), (2, "  "), (3, "two words"), (4, "Two  words"))]
    docs = spark.createDataFrame(data, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.classes(docs).collect()}
    assert got == brute_classes(data)
    kept = neardup.deduplicated(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(got.values()))
    if block == 256:
        assert neardup.deduplicated(edge).columns == edge.columns
        assert neardup.deduplicated(edge).count() == len(EDGE) - 2
        assert neardup.classes(none).count() == 0


# -- 10 -----------------------------------------------------------------------


def test_license_scan(spark, edge, none):
    scanner = licenses.train()
    text = "Some words.\nReleased under the MIT License.\nThe license plate.\n\nLicensed under the Apache License, Version 2.0."
    docs = spark.createDataFrame([(1, text, 5), (2, None, 6), (3, "of the in the to any", 7)], "doc_id long, text string, n int")
    got = {r.doc_id: r for r in licenses.scan(docs, scanner).collect()}
    assert [(x.paragraph, x.family) for x in got[1].licenses] == [(1, "mit"), (4, "apache-2.0")]
    assert [text.encode()[x.start : x.end].decode() for x in got[1].licenses] == [text.split("\n")[1], text.split("\n")[4]]
    assert got[1].n_paragraphs == 4 and got[2].n_paragraphs == 0
    assert not got[2].licenses and not got[3].licenses
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            assert scanner.classify("Note that " + notice + " since then")[0] == family
    for other in licenses.OTHERS:
        assert scanner.classify(other) is None
    assert licenses.scan(edge, scanner).count() == len(EDGE)
    assert licenses.scan(none, scanner).count() == 0


def test_license_scan_wrapped_and_dual():
    scanner = licenses.train()

    def found(text):
        return [(x[1], x[4], text[x[2] : x[3]]) for x in scanner.paragraphs(Texts(pa.array(["x", text, "y"]))) if x[0] == 1]

    gpl = (
        " * This program is free software: you can redistribute it and/or modify\n"
        " * it under the terms of the GNU General Public License as published by\n"
        " * the Free Software Foundation, either version 3 of the License, or"
    )
    bsd = (
        "Redistribution and use in source and binary forms, with or without\n"
        "modification, are permitted provided that the following conditions are\nmet:"
    )
    assert found("A tool.\n" + gpl + "\n\nMore.\n" + bsd) == [(1, "gpl", gpl), (6, "bsd", bsd)]
    for own, other in (("lgpl", "Lesser "), ("agpl-3.0", "Affero ")):
        assert [x[1] for x in found(gpl.replace("General", other + "General"))] == [own]
    assert [x[1] for x in found("under a Creative Commons Attribution-\nShareAlike 4.0 International License")] == ["cc-by-sa"]
    for dual in ("the MIT License or the Apache License, Version 2.0", "the MIT\nLicense or the Apache License,\nVersion 2.0"):
        assert {x[1] for x in found("Licensed under " + dual)} == {"mit", "apache-2.0"}
    # A line without words parts paragraphs; repeated notices stay single lines.
    assert found("Released under the\n\nMIT License") == []
    assert [x[0] for x in found("Released under the MIT License\n" * 3)] == [0, 1, 2]
    for family, notices in licenses.TEMPLATES.items():
        for notice in notices:
            for width in (1, 4):
                words = notice.split()
                text = "\n".join(" ".join(words[i : i + width]) for i in range(0, len(words), width))
                assert [x[1] for x in found(text)] == [family]
