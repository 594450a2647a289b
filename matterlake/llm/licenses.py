"""License scans: a trained paragraph classifier and a template comparison.

A paragraph is a run of neighbouring lines, one or more: notices are usually
wrapped.  A line without words ends a run, and so does one that adds nothing to
the notice.  Its features are its word n-grams (one to three words, lower case,
also across line ends).  A sparse multinomial logistic regression, trained on
varied copies of known notices and on other paragraphs, gives a probability per
family and for ``unknown``; its scale is calibrated on notices held out from
the fit.  A family counts only if a template of it confirms: enough of the
template's word pairs stand in the paragraph.  All such families count, but not
one whose pairs are only those that it shares with another that is there.

Only n-grams of the training notices carry weight, so a paragraph with none of
their word pairs is unknown without further work.
"""

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matterlake.llm.blocks import TERMS, Texts, Words, cut, map_batches, mix, small_batches

UNKNOWN = "unknown"
# Usual notices of each family (fixed values).
TEMPLATES = {
    "agpl-3.0": (
        "GNU Affero General Public License, version 3",
        "This program is licensed under the GNU Affero General Public License as published by the Free Software Foundation, version 3.",
        "Released under the AGPL v3 license",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.",
        "Released under the Apache 2.0 license",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc0": (
        "Released under CC0 1.0 Universal Public Domain Dedication",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GPL v2 license",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ),
    "lgpl": (
        "Licensed under the GNU Lesser General Public License, version 2.1",
        "Released under the LGPL v3 license",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "SPDX-License-Identifier: MIT",
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "Licensed under the Mozilla Public License, Version 2.0",
    ),
}
# Paragraphs that speak of licenses, rights or public things otherwise.
OTHERS = (
    "He lost his driving license and had to pay a fine to the general office",
    "The license plate of the car was found by the public on the second day",
    "The version of the story that was released under pressure is not the same",
    "This work is under way and you may use the file as you like to do it",
    "The terms of the contract are subject to the law of the land and to notice",
    "A fishing licensed boat is permitted on the lake provided that it is small",
    "Free software was published by the foundation and used in every school",
    "The public has general rights and the common creative work of this person",
    "All rights reserved",
    "The committee granted permission to any person to copy the document",
)

SIZES = (1, 2, 3)
# The notices are ASCII, and so is the folding of case while looking for them.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32
VARIANTS = 60
SHRINK = 2e-4
ROUNDS = 300
CONFIDENT = 0.5
CONFIRMED = 0.6


def ngrams(
    texts: Texts, words: Words, sizes: tuple[int, ...] = SIZES, apart: int = 0
) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per size: (hash, first word) over words at most ``apart`` lines apart."""
    h = words.hashes()
    lines = np.concatenate(([0], np.cumsum(texts.bytes == 0x0A)))
    place = lines[words.start]
    out = []
    for size in sizes:
        n = max(0, len(h) - size + 1)
        same = np.flatnonzero(
            (place[len(h) - n :] - place[:n] <= apart) & (words.row[:n] == words.row[len(h) - n :])
        )
        own = np.full(len(same), size, np.uint64)
        for j in range(size):
            own = mix(own + h[same + j])
        out.append((own, same))
    return out


def _grams_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(all distinct n-grams, distinct word pairs) of one lower-case line."""
    texts = Texts(pa.array([text.lower().replace("\n", " ")], pa.large_string()))
    parts = ngrams(texts, Words(texts, TERMS))
    return np.unique(np.concatenate([p[0] for p in parts])), np.unique(parts[1][0])


def _runs(
    pair: list[int], first: list[int], last: list[int], least: int
) -> list[tuple[int, int, int]]:
    """(first line, last line, distinct pairs) of runs that hold ``least`` pairs.

    The pairs of one template, by position, with the lines of their two words.
    Each line of a run has one of them.  The first run to reach ``least`` grows
    while a neighbouring line adds a pair, then loses border lines that add none;
    what is before and after it is searched likewise.
    """
    breaks = [i + 1 for i in range(len(pair) - 1) if first[i + 1] > last[i] + 1]
    todo = list(zip([0, *breaks], [*breaks, len(pair)]))
    found = []
    while todo:
        lo, hi = todo.pop()
        held: Counter = Counter()
        x = lo
        for y in range(lo, hi):
            held[pair[y]] += 1
            while held[pair[x]] > 1:
                held[pair[x]] -= 1
                x += 1
            if len(held) >= least:
                break
        else:
            continue
        a, b, y = first[x], last[y], y + 1
        # All pairs on these lines, from here on pair[x:y].
        while x > lo and first[x - 1] >= a:
            x -= 1
            held[pair[x]] += 1
        while y < hi and last[y] <= b:
            held[pair[y]] += 1
            y += 1
        while y < hi:
            end = y
            while end < hi and last[end] <= last[y]:
                end += 1
            if held.keys() >= set(pair[y:end]):
                break
            held.update(pair[y:end])
            b, y = last[y], end
        while x > lo:
            start = x
            while start > lo and first[start - 1] >= first[x - 1]:
                start -= 1
            if held.keys() >= set(pair[start:x]):
                break
            held.update(pair[start:x])
            a, x = first[start], start
        while True:
            start = x
            while first[start] == a:
                start += 1
                if start == y:
                    break
            own = Counter(pair[x:start])
            if start == y or any(held[p] <= n for p, n in own.items()):
                break
            held.subtract(own)
            a, x = first[start], start
        while True:
            end = y
            while last[end - 1] == b:
                end -= 1
                if end == x:
                    break
            own = Counter(pair[end:y])
            if end == x or any(held[p] <= n for p, n in own.items()):
                break
            held.subtract(own)
            b, y = last[end - 1], end
        found.append((a, b, len(held)))
        # Pairs that reach into the run from outside belong to neither side.
        while x > lo and last[x - 1] >= a:
            x -= 1
        while y < hi and first[y] <= b:
            y += 1
        todo += [(lo, x), (y, hi)]
    return found


@dataclass
class Scanner:
    families: list[str]
    grams: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    scale: float
    pairs: np.ndarray
    templates: list[tuple[int, np.ndarray]]
    # Per n-gram and family: whether a template of the family has it.
    owned: np.ndarray

    def paragraphs(self, texts: Texts) -> list[tuple[int, int, int, int, str, float, float]]:
        """(row, first line, start, end, family, probability, likeness), by position.

        Only paragraphs whose family is known are given, one entry per family.
        """
        lower = LOWER[texts.bytes]
        texts, cased = texts.replaced(lower), texts
        words = Words(texts, TERMS)
        ends = np.flatnonzero(texts.bytes == 0x0A)
        ((pair, at),) = ngrams(texts, words, (2,), apart=1)
        known = _among(pair, self.pairs)
        at, place = at[known], np.searchsorted(self.pairs, pair[known])
        line = np.searchsorted(ends, words.start)
        # Lines with words, without one that has none between them.
        parted = (np.diff(words.row) > 0) | (np.diff(line) > 1)
        part = np.concatenate(([0], np.cumsum(parted)))[at]
        keys, which = np.unique(part, return_inverse=True)
        # Only parts with enough pairs of one template can be confirmed.
        in_template = self._in_template()
        once = np.unique(which * len(self.pairs) + place)
        held = np.zeros((len(keys), len(self.templates)))
        np.add.at(held, once // len(self.pairs), in_template[once % len(self.pairs)])
        able = held >= CONFIRMED - 1e-9
        bound = np.searchsorted(which, np.arange(len(keys) + 1))
        out = []
        for key in np.flatnonzero(able.any(axis=1)).tolist():
            own = slice(bound[key], bound[key + 1])
            row = int(words.row[at[own.start]])
            runs = []
            for t in np.flatnonzero(able[key]).tolist():
                some = at[own][in_template[place[own], t] > 0]
                family, pairs = self.templates[t]
                runs += [
                    (a, b, family, n / len(pairs))
                    for a, b, n in _runs(
                        place[own][in_template[place[own], t] > 0].tolist(),
                        line[some].tolist(),
                        line[some + 1].tolist(),
                        int(np.ceil(CONFIRMED * len(pairs) - 1e-9)),
                    )
                ]

            def span(a: int, b: int) -> tuple[int, int]:
                start, end = texts.offsets[row], texts.offsets[row + 1]
                return (
                    max(int(start), int(ends[a - 1]) + 1 if a else 0),
                    min(int(end), int(ends[b]) if b < len(ends) else len(texts.bytes)),
                )

            zero = int(texts.offsets[row])
            first = int(np.searchsorted(ends, zero))
            for together in _overlapping(runs):
                a, b = span(min(r[0] for r in together), max(r[1] for r in together))
                for family, p in self._families(cased.bytes[a:b].tobytes().decode()).items():
                    taken: list[tuple[int, int]] = []
                    # Of runs of one family that overlap, the likest is given.
                    for a, b, f, like in sorted(together, key=lambda r: (-r[3], r[1] - r[0], r[0])):
                        if f == family and all(b < c or a > d for c, d in taken):
                            taken.append((a, b))
                            start, end = span(a, b)
                            out.append((row, a - first, start - zero, end - zero, self.families[f], p, like))
        return sorted(out, key=lambda x: (*x[:4], -x[5], x[4]))

    def _in_template(self) -> np.ndarray:
        """Per pair and template: the share of the template that the pair is."""
        return np.stack(
            [np.isin(self.pairs, t) / max(len(t), 1) for _, t in self.templates], axis=1
        )

    def classify(self, paragraph: str) -> tuple[str, float, float] | None:
        """(family, probability, likeness to its template), None if unknown.

        Of several families the most probable.
        """
        found = self._families(paragraph)
        if not found:
            return None
        pairs = _grams_of(paragraph)[1]
        best = max(found, key=lambda f: found[f])
        like = max(np.isin(t, pairs).mean() for f, t in self.templates if f == best and len(t))
        return self.families[best], found[best], float(like)

    def _families(self, paragraph: str) -> dict[int, float]:
        """The probability of each family that a template confirms.

        A family is left out if what its templates have beside the pairs of
        another such family is not there.  The probability of each of several
        families is that without the others and the n-grams that only they have.
        """
        grams, pairs = _grams_of(paragraph)
        able: dict[int, list[np.ndarray]] = {}
        for f, t in self.templates:
            if len(t) and np.isin(t, pairs).mean() >= CONFIRMED:
                able.setdefault(f, []).append(t)
        if not able:
            return {}
        p = self.probabilities(grams)
        shared = {f: np.concatenate([t for g, t in self.templates if g == f]) for f in able}

        def hidden(f: int, by: int) -> bool:
            beside = [np.setdiff1d(t, shared[by]) for t in able[f]]
            return not any(len(t) and np.isin(t, pairs).mean() >= CONFIRMED for t in beside)

        def left_out(f: int, by: int) -> bool:
            return hidden(f, by) and (not hidden(by, f) or (p[by], by) > (p[f], f))

        kept = [f for f in able if not any(left_out(f, g) for g in able if g != f)]
        out = {}
        for f in kept or [max(able, key=lambda f: p[f])]:
            others = [g for g in kept if g != f]
            foreign = self.owned[:, others].any(axis=1) & ~self.owned[:, f]
            own = float(self.probabilities(np.setdiff1d(grams, self.grams[foreign]), others)[f])
            if own >= CONFIDENT:
                out[f] = own
        return out

    def probabilities(self, grams: np.ndarray, without: list[int] | tuple = ()) -> np.ndarray:
        at = np.searchsorted(self.grams, grams)
        at[at == len(self.grams)] = 0
        at = at[self.grams[at] == grams]
        z = (self.bias + self.weights[at].sum(axis=0)) * self.scale
        z[list(without)] = -np.inf
        p = np.exp(z - z.max())
        return p / p.sum()


def _overlapping(runs: list[tuple]) -> list[list[tuple]]:
    """Runs (first line, last line, ...) in groups that share lines."""
    out: list[list[tuple]] = []
    reach = -1
    for run in sorted(runs):
        if run[0] > reach:
            out.append([])
        out[-1].append(run)
        reach = max(reach, run[1])
    return out


def _among(h: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Positions of ``h`` that are in ``table`` (ascending, small)."""
    bits = np.zeros(1 << 16, bool)
    bits[(table & np.uint64(0xFFFF)).astype(np.int64)] = True
    maybe = np.flatnonzero(bits[(h & np.uint64(0xFFFF)).astype(np.int64)])
    return maybe[np.isin(h[maybe], table)]


def _varied(text: str, rng: np.random.Generator, filler: list[str]) -> str:
    """A notice as it may stand in a document: words lost, words around it."""
    words = text.split()
    if len(words) > 6:
        keep = rng.random(len(words)) > rng.choice([0.0, 0.05, 0.12])
        words = [w for w, k in zip(words, keep) if k]
    around = [rng.choice(filler, rng.integers(0, 12)).tolist() for _ in range(2)]
    if rng.random() < 0.5:
        around = [[], []]
    return " ".join([*around[0], *words, *around[1]])


def train(seed: int = 11) -> Scanner:
    """Fits the scanner; needs no data but the notices above."""
    rng = np.random.default_rng(seed)
    families = sorted(TEMPLATES)
    filler = " ".join(OTHERS).lower().split()
    rows: list[tuple[str, int]] = []
    for i, family in enumerate(families):
        for text in TEMPLATES[family]:
            rows += [(text, i)] + [(_varied(text, rng, filler), i) for _ in range(VARIANTS)]
    none = len(families)
    every = [w for f in families for t in TEMPLATES[f] for w in t.split()]
    for text in OTHERS:
        rows += [(text, none)] + [(_varied(text, rng, filler), none) for _ in range(VARIANTS)]
    for _ in range(20 * VARIANTS):
        # Words of notices in no order: single words are no license.
        n = int(rng.integers(3, 25))
        rows.append((" ".join(rng.choice(every if rng.random() < 0.5 else filler, n)), none))
    grams = [_grams_of(t)[0] for t, _ in rows]
    y = np.array([c for _, c in rows])
    vocabulary = np.unique(np.concatenate([_grams_of(t)[0] for ts in TEMPLATES.values() for t in ts]))
    flat, owner = np.concatenate(grams), np.repeat(np.arange(len(rows)), [len(g) for g in grams])
    at = np.searchsorted(vocabulary, flat)
    at[at == len(vocabulary)] = 0
    hit = vocabulary[at] == flat
    at, owner = at[hit], owner[hit]
    held = rng.random(len(rows)) < 0.2
    fit = ~held[owner]
    w, b = _softmax_fit(at[fit], owner[fit], y, ~held, len(vocabulary), none + 1)
    z = np.zeros((len(rows), none + 1)) + b
    np.add.at(z, owner, w[at])
    scale = _calibrated(z[held], y[held])
    templates = [(i, _grams_of(t)[1]) for i, f in enumerate(families) for t in TEMPLATES[f]]
    pairs = np.unique(np.concatenate([t for _, t in templates]))
    owned = np.stack(
        [
            np.isin(vocabulary, np.concatenate([_grams_of(t)[0] for t in TEMPLATES[f]]))
            for f in families
        ],
        axis=1,
    )
    return Scanner([*families, UNKNOWN], vocabulary, w, b, scale, pairs, templates, owned)


def _softmax_fit(at, owner, y, used, width, classes):
    w, b = np.zeros((width, classes)), np.zeros(classes)
    target = np.eye(classes)[y]
    n = used.sum()
    m, v = np.zeros((width + 1, classes)), np.zeros((width + 1, classes))
    order = np.argsort(at, kind="stable")
    at, owner = at[order], owner[order]
    heads = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
    rows = np.argsort(owner, kind="stable")
    for t in range(1, ROUNDS + 1):
        z = np.zeros((len(y), classes)) + b
        some = owner[rows]
        first = np.flatnonzero(np.r_[True, some[1:] != some[:-1]])
        z[some[first]] += np.add.reduceat(w[at[rows]], first, axis=0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        error = (p / p.sum(axis=1, keepdims=True) - target) * used[:, None] / n
        g = SHRINK * np.vstack((w, np.zeros(classes)))
        g[at[heads]] += np.add.reduceat(error[owner], heads, axis=0)
        g[-1] = error.sum(axis=0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-9)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _calibrated(z: np.ndarray, y: np.ndarray) -> float:
    """The scale of the logits under which held-out paragraphs are likeliest."""
    def loss(s):
        t = z * s
        t = t - t.max(axis=1, keepdims=True)
        return -(t[np.arange(len(y)), y] - np.log(np.exp(t).sum(axis=1))).mean()

    return float(min(np.geomspace(0.25, 4.0, 33), key=loss))


_FOUND = "doc_id long, licenses array<struct<paragraph:int,start:int,end:int,family:string,probability:double,likeness:double>>, n_paragraphs long"


def scan(docs: DataFrame, scanner: Scanner | None = None) -> DataFrame:
    """(doc_id, licenses, n_paragraphs) per document row.

    ``licenses`` has one entry per paragraph and known family: the number of its
    first line, its byte span in the text, the family, its probability and its
    likeness to the template.  ``n_paragraphs`` counts lines that are not blank.  Null and empty
    texts have none; repeated rows are rows; other columns are not read.
    """
    spark = docs.sparkSession
    small_batches(spark)
    held = spark.sparkContext.broadcast(scanner or train())
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        F.coalesce(F.regexp_count("text", F.lit(r"(?m)^.*\S.*$")), F.lit(0)).cast("long").alias("n"),
    )
    names = ("paragraph", "start", "end", "family", "probability", "likeness")
    kind = pa.list_(
        pa.struct(
            list(zip(names, (pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.float64())))
        )
    )

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        column = batch.column(1)
        out: list[list[dict]] = [[] for _ in range(batch.num_rows)]
        for a, b in cut(column):
            for row, *found in held.value.paragraphs(Texts(column[a:b])):
                out[a + row].append(dict(zip(names, found)))
        return pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(out, kind), batch.column(2)],
            names=["doc_id", "licenses", "n_paragraphs"],
        )

    return map_batches(slim, run, _FOUND)
