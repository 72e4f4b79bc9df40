"""Licence scans: a trained passage classifier confirmed by templates.

Templates of the licence families (fixed texts) give the vocabulary of word
n-grams (1 to 3). In a line, and in a block (lines up to one without words, as
notices are wrapped), stretches where template bigrams stand close together are
passages. A softmax regression over the sparse
n-grams of a passage names the family or "unknown". It is trained here on
windows of the templates with words dropped, against shuffled template words
and passages of the corpus (`SAMPLE` at most, of the smallest hashes), where a
passage that holds a whole template sentence is not taken as unknown. Its
temperature is then calibrated on passages kept back. A prediction counts when its
probability reaches `MIN_PROBABILITY` and a template confirms it: the passage
holds at least `MIN_OVERLAP` of the word trigrams of one of its sentences. A block
is then searched for sentences that no line gave: the one with the most trigrams
there is taken, its trigrams are spent, and so on, so that each family with
enough trigrams of its own is returned.

Defined results: null or blank texts have no passages; a null id and repeated
rows pass through; the result has one row per licence passage, whose paragraph is
the line it begins in; other columns
are not read; an empty table gives no rows."""

from __future__ import annotations

import random
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SAMPLE = 2_000
WINDOWS = 40  # training windows per template
EPOCHS = 12
RATE = 0.5
GAP = 6
MIN_PROBABILITY = 0.5
MIN_OVERLAP = 0.6
WORD = re.compile(r"[a-z0-9]+")
UNKNOWN = "unknown"

#: Notices of the licence families, a sentence each.
TEMPLATES = {
    "MIT": ["Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the terms of the MIT license",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
            "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License",
                   "You may obtain a copy of the License at http www apache org licenses LICENSE 2.0"],
    "GPL": ["This file is licensed under the GNU General Public License, version 2", "This file is licensed under the GNU General Public License, version 3",
            "you can redistribute it and or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
            "You should have received a copy of the GNU General Public License along with this program"],
    "LGPL": ["under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "licensed under the GNU Lesser General Public License, version 2.1"],
    "AGPL": ["licensed under the GNU Affero General Public License, version 3", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
            "Use of this source code is governed by a BSD style license", "Released under the BSD 3 Clause License"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
    "CC-BY": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License"],
    "CC0": ["To the extent possible under law, the author has waived all copyright and related rights to this work", "Released under CC0 1.0 Universal"],
    "ISC": ["Permission to use, copy, modify, and or distribute this software for any purpose with or without fee is hereby granted"],
    "Unlicense": ["This is free and unencumbered software released into the public domain"],
}
FAMILIES = [*TEMPLATES, UNKNOWN]


def words(s: str) -> list[str]:
    return WORD.findall(s.lower())


def grams(ws: list[str], low: int = 1, high: int = 3) -> list[str]:
    return [" ".join(ws[i : i + k]) for k in range(low, high + 1) for i in range(len(ws) - k + 1)]


VOCABULARY = {g: i for i, g in enumerate(sorted({g for ts in TEMPLATES.values() for t in ts for g in grams(words(t))}))}
_BIGRAMS = frozenset(g for g in VOCABULARY if g.count(" ") == 1)
_HINT = re.compile(r"licen|copyright|permission|redistribut|cc0|cc by|public domain|unencumbered", re.I)


def _stretches(ws: list[str]) -> list[tuple[int, int]]:
    """(first word, word after the last) where template bigrams stand close together."""
    at = [i for i in range(len(ws) - 1) if f"{ws[i]} {ws[i + 1]}" in _BIGRAMS]
    out, k = [], 0
    while k < len(at):
        j = k
        while j + 1 < len(at) and at[j + 1] - at[j] <= GAP:
            j += 1
        if j > k:
            out.append((at[k], at[j] + 2))
        k = j + 1
    return out


def passages(line: str) -> list[list[str]]:
    """Word stretches of a paragraph in which template bigrams stand close together."""
    if not _HINT.search(line):
        return []
    ws = words(line)
    return [ws[a:b] for a, b in _stretches(ws)]


def blocks(text: str) -> Iterator[list[tuple[int, str]]]:
    """(line number, line) of the lines between lines without words, where one of them has a hint."""
    block: list[tuple[int, str]] = []
    for k, line in enumerate([*text.split("\n"), ""]):
        if WORD.search(line.lower()):
            block.append((k, line))
        else:
            if block and _HINT.search(" ".join(x for _, x in block)):
                yield block
            block = []


_SENTENCES = [(f, words(t)) for f, ts in TEMPLATES.items() for t in ts]
_HOLDERS: dict[str, list[int]] = {}
for _k, (_, _ws) in enumerate(_SENTENCES):
    for _g in sorted(set(grams(_ws, 3, 3))):
        _HOLDERS.setdefault(_g, []).append(_k)
_SIZES = [len(set(grams(ws, 3, 3))) for _, ws in _SENTENCES]


def confirmed(ws: list[str]) -> list[tuple[int, int, str, float]]:
    """(first word, word after the last, family, share) of the template sentences in a passage.
    A trigram of the passage counts for one sentence only."""
    at: dict[int, list[tuple[int, str]]] = {}
    for i in range(len(ws) - 2):
        g = f"{ws[i]} {ws[i + 1]} {ws[i + 2]}"
        for k in _HOLDERS.get(g, ()):
            at.setdefault(k, []).append((i, g))
    spent: set[int] = set()
    out = []

    def best_of(k: int) -> tuple[int, float, int, list[int]] | None:
        """(trigrams, share, -first, positions) of the fullest window of a sentence."""
        free, best, low = [x for x in at[k] if x[0] not in spent], None, 0
        if len(free) < MIN_OVERLAP * _SIZES[k]:
            return None
        wide, held = 2 * len(_SENTENCES[k][1]) + GAP, Counter()
        for high, (i, g) in enumerate(free):
            held[g] += 1
            while i - free[low][0] > wide or held[free[low][1]] > 1:
                held[free[low][1]] -= 1
                if not held[free[low][1]]:
                    del held[free[low][1]]
                low += 1
            if len(held) >= MIN_OVERLAP * _SIZES[k] and (best is None or len(held) > best[0]):
                best = (len(held), len(held) / _SIZES[k], -free[low][0], [x for x, _ in free[low : high + 1]])
        return best

    found = {k: b for k in at if (b := best_of(k))}
    while found:
        k = max(found, key=lambda k: (*found[k][:3], -k))
        _, share, _, places = found.pop(k)
        spent.update(places)
        out.append((places[0], places[-1] + 3, _SENTENCES[k][0], share))
        found = {j: b for j in [*found, k] if (b := (found[j] if j in found and spent.isdisjoint(found[j][3]) else best_of(j)))}
    return sorted(out)


def overlap(ws: list[str], family: str) -> float:
    """Largest share of a template sentence's trigrams that the passage holds."""
    held = set(grams(ws, 3, 3))
    return max((len(held & t) / len(t) for t in (set(grams(words(s), 3, 3)) for s in TEMPLATES.get(family, [])) if t), default=0.0)


class Classifier:
    def __init__(self, weights: np.ndarray, heat: float) -> None:
        self.weights, self.heat = weights, heat

    def logits(self, ws: list[str]) -> np.ndarray:
        at = [VOCABULARY[g] for g in set(grams(ws)) if g in VOCABULARY]
        return self.weights[at].sum(axis=0) + self.weights[-1]

    def chance(self, ws: list[str], family: str) -> float:
        z = self.logits(ws) / self.heat
        p = np.exp(z - z.max())
        return float(p[FAMILIES.index(family)] / p.sum())

    def predict(self, ws: list[str]) -> tuple[str, float]:
        z = self.logits(ws) / self.heat
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return FAMILIES[k], float(p[k] / p.sum())


def train(corpus: list[list[str]], seed: int = 7) -> Classifier:
    rnd = random.Random(seed)
    cases: list[tuple[list[str], int]] = []
    for k, ts in enumerate(TEMPLATES.values()):
        for t in ts:
            ws = words(t)
            for _ in range(WINDOWS):
                n = rnd.randint(min(4, len(ws)), len(ws))
                a = rnd.randint(0, len(ws) - n)
                cases.append(([w for w in ws[a : a + n] if rnd.random() > 0.08], k))
            cases.append((rnd.sample(ws, len(ws)), len(FAMILIES) - 1))
    common = words(" ".join(t for ts in TEMPLATES.values() for t in ts))
    cases += [(rnd.sample(common, rnd.randint(3, 12)), len(FAMILIES) - 1) for _ in range(400)]
    cases += [(ws, len(FAMILIES) - 1) for ws in corpus if max(overlap(ws, f) for f in TEMPLATES) < MIN_OVERLAP]
    rnd.shuffle(cases)
    cut = len(cases) * 4 // 5
    model = Classifier(np.zeros((len(VOCABULARY) + 1, len(FAMILIES))), 1.0)
    at = [np.array([*(VOCABULARY[g] for g in sorted(set(grams(ws))) if g in VOCABULARY), -1]) for ws, _ in cases]
    for epoch in range(EPOCHS):
        for i in range(cut):
            z = model.weights[at[i]].sum(axis=0)
            p = np.exp(z - z.max())
            p /= p.sum()
            p[cases[i][1]] -= 1
            model.weights[at[i]] -= RATE / (1 + epoch) / len(at[i]) ** 0.5 * p

    def loss(heat: float) -> float:
        z = np.array([model.weights[a].sum(axis=0) for a in at[cut:]]) / heat
        z -= z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), [y for _, y in cases[cut:]]]).mean())

    model.heat = min((0.25 * 1.2**k for k in range(20)), key=loss)
    return model


def _sampler(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = {" ".join(p) for t in batch.column(0) for block in blocks(t.as_py() or "") for p in passages(" ".join(line for _, line in block))}
        rows = sorted((xxhash.xxh3_64_intdigest(p.encode()) >> 1, p) for p in found)[:SAMPLE]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["h", "passage"])


def notices(model: Classifier, block: list[tuple[int, str]]) -> list[tuple[int, str, float, float, str]]:
    """(paragraph, family, probability, overlap, passage) of the licence passages of a block."""
    out, done, ws, line_of = [], [], [], []
    for k, line in block:
        here, first = words(line), len(ws)
        ws += here
        line_of += [k] * len(here)
        if not _HINT.search(line):
            continue
        for a, b in _stretches(here):
            f, p = model.predict(here[a:b])
            o = overlap(here[a:b], f)
            if f != UNKNOWN and p >= MIN_PROBABILITY and o >= MIN_OVERLAP:
                out.append((k, f, p, o, " ".join(here[a:b])))
                done.append((first + a, first + b, f))
    for low, high in _stretches(ws):
        for a, b, f, o in confirmed(ws[low:high]):
            a, b = a + low, b + low
            if any(x < b and a < y and g == f for x, y, g in done):
                continue
            p = model.chance(ws[a:b], f)
            if p >= MIN_PROBABILITY:
                out.append((line_of[a], f, p, o, " ".join(ws[a:b])))
                done.append((a, b, f))
    return sorted(out, key=lambda r: r[0])


def _scanner(model: Classifier) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, lines, family, chance, share, text = [], [], [], [], [], []
            for i, t in enumerate(batch.column(1)):
                raw = t.as_py() or ""
                if not _HINT.search(raw):
                    continue
                for block in blocks(raw):
                    for row in notices(model, block):
                        at.append(i)
                        for x, v in zip((lines, family, chance, share, text), row):
                            x.append(v)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int32())), pa.array(lines, pa.int32()), pa.array(family, pa.string()), pa.array(chance, pa.float64()), pa.array(share, pa.float64()), pa.array(text, pa.string())], names=["id", "paragraph", "family", "probability", "overlap", "passage"])

    return run


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, paragraph, family, probability, overlap, passage) of every licence passage."""
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    picked = slim.select("text").mapInArrow(_sampler, "h long, passage string").distinct().orderBy("h", "passage").limit(SAMPLE).collect()
    model = train([r.passage.split() for r in picked])
    kind = docs.schema[id_col].dataType.simpleString()
    return slim.mapInArrow(_scanner(model), f"id {kind}, paragraph int, family string, probability double, overlap double, passage string").withColumnRenamed("id", id_col)
