"""Operators of tessera.llm against brute force, the libraries and edge cases."""

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import public_tokenizers as tokenizer_files
import pytest

import corpus_pipeline
from tessera.llm import bpe_tree, containment, cross_entropy, licences, line_rules, orc_tokens, pii, segment_join, token_counts, toxicity
from tessera.llm.wordbpe import ByteBpe, WordBpe

WORD, BYTE = tokenizer_files.path("word_bpe_49k.json"), tokenizer_files.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
_RND = random.Random(3)
_BITS = ["a", "B", "'", "ll", "s", " ", "\n", "  ", "\t", "1", "22", "!", "é", "日", "<|endoftext|>", "\x1c", "the ", "||", "zq"]
TEXTS = [None, "", " \n ", "it's 'LL x'llama 12 3½ é İΣ ﬁ", "a" * 3000, "ab" * 900 + "!" * 999, "日本語" * 400, "'ll" * 300] + ["".join(_RND.choice(_BITS) for _ in range(_RND.randrange(1, 200))) for _ in range(150)]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", f"src{i % 3}", 0) for i, t in enumerate(TEXTS)] + [(None, "null id", "en", None, 0), (1, "", "en", "src1", 0)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_token_counts_equal_library(docs, empty):
    lib = WordBpe(WORD).library
    for chunk in (64, 32768):
        got = token_counts.token_counts(docs, WORD, chunk_chars=chunk, overlap=16).collect()
        assert len(got) == len(TEXTS) + 2
        for r in got:
            if r.doc_id is not None and r.doc_id < len(TEXTS):
                t = TEXTS[r.doc_id] or ""
                assert (r.n_tokens, r.n_bytes) == (len(lib.encode(t, add_special_tokens=False).ids), len(t.encode()))
    assert token_counts.token_counts(empty, WORD).count() == 0


def test_bpe_tree_equals_library(docs, empty):
    lib = ByteBpe(BYTE).library
    got = bpe_tree.decode_documents(bpe_tree.encode_documents(docs, BYTE, leaf_chars=50, window=8), BYTE).collect()
    for r in got:
        if r.doc_id is not None:
            ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids
            assert np.frombuffer(r.ids, "<u4").tolist() == ids and r.decoded == lib.decode(ids, skip_special_tokens=False)
    assert bpe_tree.encode_documents(empty, BYTE).count() == 0


def test_orc_round_trip(docs, empty):
    lib = WordBpe(WORD).library
    got = sorted((r for r in orc_tokens.round_trip(docs, WORD).collect()), key=lambda r: r.start)
    assert [r.start for r in got] == np.concatenate([[0], np.cumsum([r.n_tokens for r in got])[:-1]]).tolist()
    assert got[0].doc_id is None and [r.doc_id for r in got[1:]] == sorted([*range(len(TEXTS)), 1])
    for r in got[1:]:
        ids = lib.encode(TEXTS[r.doc_id] or "", add_special_tokens=False).ids + [1]
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
    assert orc_tokens.round_trip(empty, WORD).count() == 0


def test_line_rules_paths_agree(spark, empty):
    body = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"Shared  line here\n{body(i)}", "en", "h" if i % 2 else None, 0) for i in range(60)] + [(99, None, "en", "h", 0), (99, "", "en", "h", 0), (None, body(7), "en", "h", 0)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'clash' as kept")
    a = line_rules.apply_rules(df).select("doc_id", "n_words", "n_removed_lines", "kept", "clean_text")
    b = line_rules.apply_rules(df, broadcast_rows=0, salts=4).select("doc_id", "n_words", "n_removed_lines", "kept", "clean_text")
    key = lambda r: str(r)
    assert sorted(map(key, a.collect())) == sorted(map(key, b.collect()))
    assert sum(r.n_removed_lines for r in a.collect()) == 58  # all but the first of each host
    assert line_rules.apply_rules(empty).count() == 0


def _jaccard_groups(rows):
    sets = {}
    for i, t in rows:
        ws = (t or "").encode().lower().split()
        sets[i] = {tuple(ws[k : k + 5]) for k in range(max(1, len(ws) - 4))} if ws else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= 75 * len(sets[x] | sets[y]):
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def test_segment_join_equals_brute_force(spark, empty, monkeypatch):
    rnd, rows = random.Random(5), []
    for g in range(12):
        base = [f"g{g}w{rnd.randrange(400)}" for _ in range(rnd.choice([3, 6, 12, 60, 150, 400]))]
        for _ in range(rnd.randrange(1, 40)):
            ws = list(base)
            for _ in range(rnd.randrange(0, 1 + len(ws) // 15)):
                ws[rnd.randrange(len(ws))] = f"n{rnd.randrange(10**6)}"
            rows.append(" ".join(ws))
    rows = list(enumerate(rows + [None, "", " ", "x y", "X  y"]))
    want = _jaccard_groups(rows)
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    for crowd in (24, 3):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in segment_join.join_groups(df, crowd=crowd).collect()}
        assert got == want
    assert segment_join.join_groups(empty).count() == 0


def test_near_duplicates_stage_equals_brute_force(spark, empty):
    """Null ids, ids with several texts, copies across them and rows without words."""
    rnd = random.Random(9)
    base = [" ".join(f"g{g}w{rnd.randrange(400)}" for _ in range(60)) for g in range(8)]
    texts = base + [b.replace(b.split()[30], "other") for b in base[:5]] + [base[0], base[0].upper(), None, "", "x y"]
    rows = [(rnd.choice([None, 1, 2, 3, 4, 5]), t, "en", rnd.choice(["a", None]), len(t or "")) for t in texts * 2]
    rows += [(None, "a clean text that has no id and no copy", "en", "a", 7), (9, base[6], "en", "a", 1), (9, "a clean text beside a copy under one id", "en", "a", 1)] + [(None, None, "de", None, None)] * 2
    got = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows, SCHEMA), "").collect()
    group = _jaccard_groups([(i, r[1]) for i, r in enumerate(rows)])
    lone = [r for i, r in enumerate(rows) if not group[i][0]]
    members = {}
    for i, r in enumerate(rows):
        if group[i][0]:
            members.setdefault(group[i][1], []).append(r)
    kept = [tuple(r) for r in got]
    assert len(kept) == len(members) + len(lone)
    assert sorted(map(str, lone)) == sorted(str(r) for r in kept if not (r[1] or "").split())
    for rs in members.values():
        here = [r for r in kept if r in rs]
        low = min((r[0] is None, r[0] or 0) for r in rs)
        assert len(here) == 1 and (here[0][0] is None, here[0][0] or 0) == low
    again = corpus_pipeline.near_duplicates(spark, spark.createDataFrame(rows[::-1], SCHEMA).repartition(3), "").collect()
    assert sorted(map(str, map(tuple, again))) == sorted(map(str, kept))
    assert corpus_pipeline.near_duplicates(spark, empty, "").count() == 0


def test_segment_join_links_through_rows_without_an_id(spark):
    """The outer documents are linked only through a row whose id is null."""
    ws = [f"w{k}" for k in range(104)]
    rows = [(5, " ".join(ws)), (None, " ".join(ws[:-10])), (None, " ".join(ws[:-10])), (7, " ".join(ws[:-30])), (9, "one of its own"), (None, None)]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in segment_join.join_groups(df).collect())
    assert got == [("5", 100, "5"), ("7", 70, "5"), ("9", 1, "9"), ("None", 0, "None"), ("None", 90, "5"), ("None", 90, "5")]


def test_one_deletion_signatures_find_close_sets(monkeypatch):
    """With few segments sets fall short, and the spared segments make up for it."""
    monkeypatch.setattr(segment_join, "segments", lambda band: 14)
    rnd = np.random.default_rng(1)
    for _ in range(300):
        x = np.unique(rnd.integers(0, 2**63, 30).astype("u8"))
        y = np.unique(np.concatenate([x[3:], rnd.integers(0, 2**63, 1).astype("u8")]))
        assert 4 * len(np.intersect1d(x, y)) >= 3 * len(np.union1d(x, y))
        band = segment_join.bands_of(min(len(x), len(y)))[0]
        spared = max(0, segment_join.shortfall(x, band), segment_join.shortfall(y, band))
        none = lambda s: np.zeros(len(s), bool)
        assert len(np.intersect1d(segment_join.signatures(x, band, spared, none(x)), segment_join.signatures(y, band, spared, none(y))))


def test_profile_bound_never_exceeds_the_difference():
    """Profiles of other lengths are folded; the bound of equal sets is 0."""
    rnd = np.random.default_rng(2)
    pairs = []
    for n in (1, 40, 100, 190, 200, 800):
        x = np.unique(rnd.integers(0, 2**63, n).astype("u8") * np.uint64(2))
        y = np.unique(np.concatenate([x[n // 8 :], rnd.integers(0, 2**63, n // 6).astype("u8") * np.uint64(2)]))
        pairs += [(x, y), (x, x)]
    got = segment_join.least_differences(*(pa.array([segment_join.profile(p[k]) for p in pairs]) for k in (0, 1)), cells=64)
    for (x, y), d in zip(pairs, got):
        assert 0 <= d <= len(np.setxor1d(x, y))


def test_containment(spark, empty):
    item = " ".join(f"q{k}" for k in range(30))
    rows = [(1, "a b c " + item.upper() + " d e", "en", "s", 0), (2, " ".join(f"q{k}" for k in range(12)), "en", "s", 0), (3, None, "en", "s", 0), (4, "hello there all", "en", "s", 0), (None, item, "en", "s", 0), (1, "a b c " + item.upper() + " d e", "en", "s", 0)]
    items = spark.createDataFrame([(7, item), (8, "hello there"), (9, None), (10, ""), (7, item)], "item_id long, text string")
    df = spark.createDataFrame(rows, SCHEMA)
    for limit in (200_000, 0):
        got = {(r.doc_id, r.item_id, r.n_found) for r in containment.leaks(df, items, broadcast_rows=limit, salts=4).collect()}
        assert got == {(1, 7, 26), (4, 8, 1)}
    assert containment.leaks(empty, items).count() == 0 and containment.leaks(df, items.limit(0)).count() == 0


def test_personal_data(spark, docs, empty):
    texts = ["mail a.b@c.org, +1 (017) 555-7713 at 10.2.3.4", "x 4111 1111 1111 1111 y 4111111111111112 300.1.2.3", None, "@@a@b.c@d.e"]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], SCHEMA)
    got = {r.doc_id: r for r in pii.find(df, with_text=True).collect()}
    assert got[0].base == "email:5:14,phone:16:33,ip:37:45" and (got[1].n_card, got[1].n_ip, got[2].spans) == (1, 0, "")
    assert got[3].base == "email:2:7" and "[EMAIL]" in got[0].clean_text and got[2].clean_text is None
    assert hashlib.sha256(b"").hexdigest() == pii.digests(pii.find(df)).where("doc_id = 2").first().base_sha256
    assert pii.find(empty).count() == 0 and pii.find(docs).count() == len(TEXTS) + 2
    for t in ["a@b a@b.c", "..@a.b-@x.y", ".@.a@b.c", "a@b.c.@x.y"]:
        assert pii.emails(t) == [m.span() for m in pii.EMAIL.finditer(t)]


def test_personal_data_adds_every_rewritten_form(spark):
    """Each form in a text without another hint of an address; the model learns from plain matches."""
    rnd = random.Random(6)
    name = lambda: "".join(rnd.choice("bcfgklmnprsuv") + rnd.choice("eiou") for _ in range(rnd.randrange(2, 5)))
    digits = lambda n: "".join(rnd.choice("123456789") for _ in range(n))
    texts = [f"please write to {name()}.{name()}@{name()}.{rnd.choice(['com', 'org', 'net'])} for the {name()} of us" for _ in range(300)]
    texts += [f"please ring us on +1 {digits(3)} {digits(3)} {digits(4)} in the {name()} of us" for _ in range(150)]
    cards = [f"4111 1111 1111 {k}" for k in range(1000, 10000) if pii.luhn(f"411111111111{k}")]
    texts += [f"please charge {c} for the {name()} of us" for c in cards[:150]]
    texts += [f"we met {name()} at noon on 2021-0{d}-1{d} with {digits(9)} {name()}" for d in range(1, 10)]
    model = pii.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    plain = {0: "john.smith@example.com", 2: "4111 1111 1111 1111", 3: "+1 212 555 7713"}
    planted = []
    for kind, s in plain.items():
        for form, a, b, k in pii.rewritten(s, (0, len(s), kind)):
            if k == kind:
                upper = form.replace(" at ", " AT ").replace("(at)", "(AT)").replace("[at]", "[At]").replace("dot", "DOT")
                planted += [(f, kind) for f in sorted({form, upper})]
    assert len(planted) == 12
    for form, kind in planted:
        text = f"please write to {form} for the rest"
        at = text.index(form)
        assert not pii.base_spans(text)
        assert (at, at + len(form), kind) in pii.added_spans(model, text, []), form
        found = pii.find(spark.createDataFrame([(1, text)], "doc_id long, text string"), model=model, with_text=True).first() if "(at)" in form else None
        assert found is None or found.clean_text == "please write to [EMAIL] for the rest"
    for text in ["we met at noon", "meet me at home. The door", "@ the dot", "antidote at work"]:
        assert pii.added_spans(model, text, []) == [] and pii.regions(text) == [m.span() for m in pii._SPELLED.finditer(text)]


def test_automaton_equals_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rnd = random.Random(2)
    terms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 8))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    for _ in range(1500):
        w = "".join(rnd.choice("abc") for _ in range(rnd.randrange(4, 9)))
        near = min((distance(w, t), k) for k, t in enumerate(terms))
        assert trie.near(w) == ((near[1], near[0]) if near[0] <= 1 else None)


def test_toxicity(spark, empty):
    rows = [(i, f"word{i} other text " + ("badword here" if i % 3 == 0 else "fine here"), "en", "s", 0) for i in range(400)] + [(1000, None, "en", "s", 0), (None, "badwrd", "en", "s", 0)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i in range(400)] + [(5000, None, None)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in toxicity.score(df, labels).collect()}
    assert all(got[i].predicted == int(i % 3 == 0) for i in range(400)) and got[1000].predicted == 0 and got[None].score > 20 * got[1000].score  # one edit away
    assert toxicity.score(empty, labels).count() == 0 and toxicity.score(df, labels.limit(0)).count() == len(rows)


def test_nearest_term_equals_edit_distance_with_swaps():
    rnd = random.Random(8)
    terms = sorted({"".join(rnd.choice("abc") for _ in range(rnd.choice([4, 4, 5, 7, 10, 12]))) for _ in range(60)})
    trie = toxicity.Trie(terms)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randrange(3, 15))) for _ in range(800)]
    for t in terms * 4:
        w = list(t)
        for _ in range(rnd.randrange(3)):
            i = rnd.randrange(len(w) - 1)
            w[i : i + 2] = rnd.choice([[w[i + 1], w[i]], [w[i]], [w[i], "d", w[i + 1]], ["d", w[i + 1]]])
        words.append("".join(w))
    for w in words:
        want = min(((e, k) for k, t in enumerate(terms) if (e := toxicity.taken(w, t)) is not None), default=None)
        assert trie.nearest(w) == (want and want[::-1])
    look = toxicity.Lexicon([("idiot", 2.0), ("stupid", 2.0), ("scumbagging", 2.0), ("jerk", 2.0)]).look
    assert [look(w) for w in ("idoit", "sutpid", "scmbaging", "jrek", "jexk", "jek", "jerk", "the")] == [(2.0, 1), (2.0, 1), (2.0, 2), (2.0, 1), (2.0, 1), (0.0, 0), (2.0, 0), (0.0, 0)]


def test_short_misspelling_counts_only_where_the_window_is_abusive():
    lexicon = toxicity.Lexicon([("jerk", 2.0)])
    assert lexicon.features("you are a j3rk")[5] == 1 and lexicon.features("the red j3rk stands there")[5] == 0
    assert lexicon.features('they said the word "j3rk" to you')[5] == 0 and lexicon.features("the red jerk stands there")[5] == 1


def test_toxicity_keeps_every_term(spark):
    """More terms pass than the earlier limit of 2,000; the join finds what the trie finds."""
    bad = [f"bad{'abcdefghij'[k % 10]}{k:04d}x" for k in range(2300)]
    rows = [(i, " ".join(bad[i // 2 % 2 :: 2]) if i % 2 else f"fine words number{i} you", "en", "s", 0) for i in range(210)]
    rows += [(1000, "you " + bad[3][:-1] + "!", "en", "s", 0), (1000, "said quoted " + bad[4], "en", "s", 0), (None, None, "en", "s", 0), (None, bad[5], "en", "s", 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, 1, i % 2) for i in range(210)], "doc_id long, quality int, toxic int")
    train = toxicity._labelled(df, labels, "doc_id", "text", "toxic").where("fold < 4")
    assert {r[0] for r in train.transform(toxicity.learn_lexicon).collect()} == set(bad)
    a, b = (sorted((str(r.doc_id), round(r.score, 9)) for r in toxicity.score(df, labels, **k).collect()) for k in ({}, {"broadcast_terms": 0}))
    assert a == b and len(a) == len(rows)


def test_licences(spark, empty):
    rows = [(1, "Hello\nReleased under the MIT License.", "en", "s", 0), (2, "the license of the car is under review", "en", "s", 0), (3, None, "en", "s", 0)]
    got = [(r.doc_id, r.paragraph, r.family) for r in licences.scan(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert got == [(1, 1, "MIT")] and licences.scan(empty).count() == 0


def test_wrapped_and_joint_licences(spark):
    notices = {
        "BSD": "# Redistribution and use in source and binary forms, with or without\n# modification, are permitted provided that the following conditions are met:",
        "LGPL": " * This library is free software under the terms of the GNU Lesser\n * General Public License as published by the Free Software Foundation",
        "GPL": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU\nGeneral Public License as published by the Free Software Foundation; either version 2",
        "MPL-2.0": "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed",
        "ISC": "Permission to use, copy, modify, and/or distribute this\nsoftware for any purpose with or without\nfee is hereby granted, provided that",
    }
    rows = [(f, f"Some first words\n\n{t}\n\nand more") for f, t in notices.items()]
    rows += [("two", "Licensed under the MIT License or the Apache License, Version 2.0"), ("lines", "Released under the MIT License\nLicensed under CC BY-SA 4.0\nReleased under the MIT License"),
             ("none", "the terms of the trip are subject to\npermission of the free\nsoftware group and the public"), ("sa", "This work is licensed under a Creative Commons\nAttribution ShareAlike 4.0 International License")]
    got = {}
    for r in licences.scan(spark.createDataFrame(rows, "doc_id string, text string")).collect():
        got.setdefault(r.doc_id, []).append((r.paragraph, r.family))
    assert sorted(got.pop("two")) == [(0, "Apache-2.0"), (0, "MIT")]
    assert sorted(got.pop("lines")) == [(0, "MIT"), (1, "CC-BY-SA"), (2, "MIT")] and got.pop("sa") == [(0, "CC-BY-SA")]
    assert got == {f: [(2, f)] for f in notices}


def test_cross_entropy_paths_agree(spark, empty):
    rnd = random.Random(4)
    good = lambda: " ".join(rnd.choice(["red", "green", "blue", "cat", "dog"]) for _ in range(40))
    rows = [(i, good() if i % 2 else " ".join(f"z{rnd.randrange(50)}" for _ in range(40)), "en", "s", 0) for i in range(120)] + [(500, None, "en", "s", 0), (500, " ", "en", "s", 0)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(100)], "doc_id long, quality int, toxic int")
    df = spark.createDataFrame(rows, SCHEMA)
    a = {r.doc_id: r for r in cross_entropy.score(df, labels).collect()}
    b = {r.doc_id: r for r in cross_entropy.score(df, labels, broadcast_rows=0).collect()}
    assert all(a[i].n_tokens == b[i].n_tokens and a[i].score == pytest.approx(b[i].score, rel=1e-5, abs=1e-6) for i in range(120))
    assert a[101].score < a[102].score and a[500].score is None
    assert cross_entropy.score(empty, labels).count() == 0


def test_profiles_bound_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        n, m = rng.integers(1, 40000, 2)
        both = rng.integers(0, 1 << 63, rng.integers(0, min(n, m) + 1)).astype("u8")
        x, y = (segment_join.distinct(np.concatenate([both, rng.integers(0, 1 << 63, k - len(both)).astype("u8")])) for k in (n, m))
        p, q = segment_join.profile(x), segment_join.profile(y)
        far = segment_join.least_differences(pa.array([p]), pa.array([q]))[0]
        near = np.bitwise_count((segment_join.sketch(p) ^ segment_join.sketch(q)).view("u8")).sum()
        assert near <= far <= len(np.setxor1d(x, y))


def _crowded_rows():
    """Near copies of one text that drift apart, and texts around one long passage."""
    rnd, texts = random.Random(11), []
    base = [f"b{rnd.randrange(10**6)}" for _ in range(120)]
    for g in range(260):
        if g % 40 == 39:  # the group drifts: later copies are made from this one
            base = list(base)
            for _ in range(4):
                base[rnd.randrange(120)] = f"d{rnd.randrange(10**6)}"
        ws = list(base)
        ws[rnd.randrange(120)] = f"n{rnd.randrange(10**6)}"
        texts.append(" ".join(ws))
    passage = [f"p{k}" for k in range(80)]
    for _ in range(150):
        own = [f"o{rnd.randrange(10**6)}" for _ in range(rnd.choice([8, 16, 40]))]
        texts.append(" ".join(passage + own))
    rnd.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize(("per_member", "cell"), [(16, 4096), (0, 16), (10**9, 7)])
def test_crowded_signatures_equal_brute_force(spark, monkeypatch, per_member, cell):
    """The same groups whether crowded signatures are dealt in turns first or compared at once, in one cell or in many."""
    monkeypatch.setattr(segment_join, "PER_MEMBER", per_member)
    rows = _crowded_rows()
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in segment_join.join_groups(df, crowd=6, deal=4, cell=cell).collect()}
    assert got == _jaccard_groups(rows)


def test_cells_hold_every_pair_of_two_groups(spark):
    """Blocks of one signature meet so that each pair outside the largest group shares a cell."""
    rows = [(7, k, 50, "m" if k < 40 else f"g{k % 5}") for k in range(60)]
    member = spark.createDataFrame([(s, n, z, [n] * 16) for s, n, z, _ in rows], "sig long, name long, n int, sketch array<long>")
    first = {"m": 0, **{f"g{k}": 40 + k for k in range(5)}}
    groups = spark.createDataFrame([(n, z, (first[g], z)) for _, n, z, g in rows], "name long, n int, root struct<name: long, n: int>")
    left = segment_join.mixed(member, groups)
    assert {(r.k, r.most) for r in left.collect()} == {(60, 40)}
    cells, group = {}, {n: g for _, n, _, g in rows}
    for r in segment_join.blocks(left, 9).collect():
        cells.setdefault((r.sig, r.i, r.j), ([], []))[r.kind].append(r.name)
    met = {frozenset((x, y)) for xs, ys in cells.values() for x in xs for y in ys if group[x] != group[y]}
    assert met == {frozenset((x, y)) for x in group for y in group if group[x] != group[y]}
    assert max(len(x) for c in cells.values() for x in c) < 30


def test_pairs_meet_at_their_lowest_shared_signature():
    rnd = random.Random(3)
    few = np.array([sorted(rnd.sample(range(40), 16)) for _ in range(30)])
    few[:5, 9:] = segment_join.NO_SIG
    x, y = (np.array([rnd.randrange(30) for _ in range(400)]) for _ in range(2))
    for sig in (0, 7, 25, segment_join.NO_SIG):
        want = [any(s < sig for s in set(few[a]) & set(few[b])) for a, b in zip(x, y)]
        assert segment_join.met_before(few, x, y, sig, cells=1000).tolist() == want
