"""Fill-in-the-middle, SentencePiece merge rounds and token alignment against brute force and the libraries."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers as tokenizer_files
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tessera.llm import cross_entropy, fill_middle, piece_bpe, token_align, toxicity
from tessera.llm.piece_bpe import PieceBpe
from tessera.llm.wordbpe import load_tokenizer

BYTE, PIECE = tokenizer_files.path("byte_bpe_50k.json"), tokenizer_files.path("piece_bpe_32k.model")
_RND = random.Random(11)
_BITS = ["a", "the", "ing", "io", "n", " a", " ", "  ", "▁", "\n", "\t", "\x1c", "é", "日", "ﬁ", "é", "​", "﻿", "\x00", "<s>", "<0x41>", "😀", "1", "=", " " * 20, "İ", "Ａ", "--", "<P>", "<", "P>", "<|endoftext|>"]
TEXTS = [None, "", " ", " \n ", "<", "a<S>b", "a" * 3000, "=" * 700, " " * 5000, " " * 40 + "hello", "日本語" * 400, "word " * 4000, " lead", "trail ", "ab▁c"] + ["".join(_RND.choice(_BITS) for _ in range(_RND.randrange(1, 80))) for _ in range(300)]


@pytest.fixture(scope="module")
def docs(spark):
    """Clashing extra columns, a null id and repeated rows."""
    rows = [(i, t, "x", 1, "y", 0) for i, t in enumerate(TEXTS)] + [(None, "null id here", "x", 1, "y", 0), (3, " \n ", "x", 1, "y", 0), (3, " \n ", "x", 1, "y", 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string, n long, groups string, block int").repartition(3)


def _plain_cut(text, doc_id):
    units = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    n, h = len(units), hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    p, q = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = "".join(units[:p]), "".join(units[p:q]), "".join(units[q:])
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_fill_in_middle_equals_brute_force(docs):
    got = fill_middle.restore_documents(fill_middle.transform_documents(docs)).collect()
    assert len(got) == len(TEXTS) + 3 and {r.form for r in got} == {"plain", "spm", "psm"}
    for r in got:
        text = "null id here" if r.doc_id is None else TEXTS[r.doc_id] or ""
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == _plain_cut(text, r.doc_id) and r.restored == text
    assert fill_middle.transform_documents(docs.limit(0)).count() == 0
    sums = fill_middle.digests(fill_middle.restore_documents(fill_middle.transform_documents(docs))).where("doc_id = 1").first()
    assert sums.output_sha256 == sums.restored_sha256 == hashlib.sha256(b"").hexdigest()


def test_fill_in_middle_takes_other_ids_and_rates(spark):
    df = spark.createDataFrame([("x", "one two three"), ("y", "four")], "doc_id string, text string")
    got = {r.doc_id: r for r in fill_middle.restore_documents(fill_middle.transform_documents(df, rate=100, spm_rate=0)).collect()}
    assert {r.form for r in got.values()} == {"psm"} and got["x"].restored == "one two three"


@pytest.mark.parametrize("size", [1, 2, 4, 5, 63, 1000, 20_000])
def test_skip_list_reaches_every_rank(size):
    widths = np.random.default_rng(size).integers(1, 9, size)
    nodes, at = fill_middle.SkipList(widths), np.concatenate([[0], np.cumsum(widths)])
    for rank in {0, 1, size // 2, size - 1, size} | set(np.random.default_rng(1).integers(0, size + 1, 200).tolist()):
        assert nodes.seek(rank) == at[rank]
    assert size < 1000 or len(nodes.lanes) > 3
    with pytest.raises(IndexError):
        nodes.seek(size + 1)


@pytest.mark.parametrize("bad", [("<P>", "<P>", "<M>"), ("aba", "<S>", "<M>"), ("<P>", ">x", "<M>"), ("<<P>", "<P>", "<M>"), ("", "a", "b")])
def test_sentinels_that_can_overlap_are_refused(docs, bad):
    with pytest.raises(ValueError):
        fill_middle.transform_documents(docs, sentinels=bad)


def test_merge_rounds_equal_the_library(docs):
    lib = PieceBpe(PIECE).library
    got = piece_bpe.decode_documents(piece_bpe.encode_documents(docs, PIECE), PIECE).collect()
    assert len(got) == len(TEXTS) + 3
    for r in got:
        ids = lib.encode("null id here" if r.doc_id is None else TEXTS[r.doc_id] or "")
        assert (r.ids, r.n_tokens, r.decoded) == (ids, len(ids), lib.decode(ids))
    one = piece_bpe.digests(piece_bpe.decode_documents(piece_bpe.encode_documents(docs.where("doc_id = 9"), PIECE), PIECE)).first()
    assert one.ids_sha256 == hashlib.sha256(",".join(map(str, lib.encode(TEXTS[9]))).encode()).hexdigest()
    assert piece_bpe.encode_documents(docs.limit(0), PIECE).count() == 0


def test_merge_rounds_in_small_rounds_and_memory(monkeypatch):
    monkeypatch.setattr(piece_bpe, "ROUND_CHARS", 7)
    bpe = PieceBpe(PIECE, cache=5)
    texts = [t or "" for t in TEXTS if len(t or "") < 500] + ["".join(_RND.choice("abcdethin ou") for _ in range(150)) for _ in range(300)]
    assert [x.tolist() for x in bpe.encode_many(texts)] == bpe.library.encode(texts)
    bpe.verify(texts)


def test_space_runs_and_long_words_equal_the_library():
    bpe = PieceBpe(PIECE)
    texts = [" " * k + end for k in range(70) for end in ("", "h", "\x00", "\n")] + ["".join(_RND.choice("ACGTabc/+") for _ in range(20_000))]
    assert [x.tolist() for x in bpe.encode_many(texts)] == bpe.library.encode(texts)


def test_decoder_leaves_broken_bytes_to_the_library():
    bpe = PieceBpe(PIECE)
    for ids in ([], [1, 5], [230, 230, 300], [0], [3, 4, 400]):
        assert bpe.decode(np.array(ids, np.int64)) == bpe.library.decode(ids)


def test_gallop_equals_search():
    rng = np.random.default_rng(2)
    for n, m in ((0, 1), (1, 1), (3, 500), (500, 3), (9000, 9000), (70_000, 100)):
        target = np.unique(rng.integers(0, 100_000, m))
        driver = np.sort(rng.integers(0, target[-1] + 1, n))
        assert np.array_equal(token_align.gallop(driver, target), np.searchsorted(target, driver))


def _brute(texts):
    """Rows and links of each text, straight from the libraries."""
    lib_a, bpe = load_tokenizer(BYTE), PieceBpe(PIECE)
    lib_a.encode_special_tokens = True
    symbols = token_align.ByteBpe(BYTE)
    rows, links = [], []
    for t in texts:
        a = lib_a.encode(" " + t, add_special_tokens=False).ids if t else []
        b = bpe.library.encode(t or "")
        bytes_a, bytes_b = [symbols.bytes_of[i] for i in a], [bpe.bytes_of[i] for i in b]
        if not t or b"".join(bytes_a) != b" " + t.encode() or b"".join(bytes_b) != b" " + t.encode():
            rows.append((0, 0, 0, ""))
            links.append([])
            continue
        span = lambda parts: [(s, s + len(p)) for s, p in zip(np.cumsum([0, *map(len, parts)]).tolist(), parts)]
        at_a, at_b = span(bytes_a), span(bytes_b)
        links.append([(i, j) for i, (p, q) in zip(a, at_a) for j, (r, s) in zip(b, at_b) if max(p, r) < min(q, s)])
        common = sorted({q for _, q in at_a} & {q for _, q in at_b})
        groups, low = [], 0
        for c in common:
            groups.append("|".join(",".join(str(i) for i, (_, q) in zip(ids, at) if low < q <= c) for ids, at in ((a, at_a), (b, at_b))))
            low = c
        rows.append((len(a), len(b), len(groups), ";".join(groups)))
    return rows, links


@pytest.mark.parametrize("block_chars", [1, 2000, 1 << 21])
def test_token_alignment_equals_brute_force(spark, docs, monkeypatch, block_chars):
    monkeypatch.setattr(token_align, "BLOCK_CHARS", block_chars)
    some = docs.where("doc_id IS NULL OR length(coalesce(text, '')) < 1000")
    texts = {r.doc_id: r.text for r in some.select("doc_id", "text").collect()}
    rows, links = _brute(list(texts.values()))
    seen = dict(zip(texts, zip(rows, links)))
    total = Counter(x for i, (_, l) in seen.items() for x in l * (3 if i == 3 else 1))
    most = Counter()
    for (_, j), n in total.items():
        most[j] = max(most[j], n)
    got = token_align.align_documents(some, BYTE, PIECE).collect()
    assert len(got) == some.count() and sum(r.n_links == 0 for r in got) >= 3
    for r in got:
        (n_a, n_b, n_groups, groups), l = seen[r.doc_id]
        assert (r.n_a, r.n_b, r.n_groups, r.groups, r.n_links) == (n_a, n_b, n_groups, groups, len(l))
        assert (r.n_best, r.count_sum) == (sum(total[x] == most[x[1]] for x in l), sum(total[x] for x in l))


def test_token_alignment_hashes_and_empty_table(docs):
    text = token_align.align_documents(docs.where("doc_id = 9"), BYTE, PIECE).first()
    sha = token_align.digests(token_align.align_documents(docs.where("doc_id = 9"), BYTE, PIECE, hashed=True)).first()
    assert sha.groups_sha256 == hashlib.sha256(text.groups.encode()).hexdigest()
    none = token_align.digests(token_align.align_documents(docs.where("doc_id <= 1"), BYTE, PIECE, hashed=True)).collect()
    assert [(r.n_a, r.groups_sha256) for r in none] == [(0, ""), (0, "")]
    assert token_align.align_documents(docs.limit(0), BYTE, PIECE).count() == 0
    counts = token_align.pair_counts(token_align.aligned_blocks(docs, BYTE, PIECE))
    assert counts.groupBy("b_id").agg(F.max(F.col("best").cast("int")).alias("m")).where("m = 0").count() == 0


def test_decontamination_stage_equals_brute_force(spark, tmp_path):
    """Leaks in rows without an id, and beside clean texts under one id."""
    rnd = random.Random(5)
    items = [" ".join(f"b{k}w{rnd.randrange(50)}" for _ in range(30)) for k in range(4)] + ["three word item", "", None]
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    clean = [" ".join(f"c{rnd.randrange(90)}" for _ in range(60)) for _ in range(12)] + ["", None, "word three item"]
    dirty = [f"{c} {items[k % 5]} {c}" for k, c in enumerate(clean[:8])] + [items[0].upper(), " ".join(items[1].split()[:29])]
    partly = [" ".join(items[2].split()[:15])]
    rows = [(rnd.choice([None, 1, 2, 3]), t, "en", rnd.choice(["a", None]), len(t or "")) for t in clean + dirty + partly] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("item_id", F.lit(1))
    got = sorted(map(str, (tuple(r) for r in corpus_pipeline.decontamination(spark, df, str(tmp_path)).collect())))

    def leaks(text):
        words = (text or "").lower().split()
        for item in items:
            own = (item or "").lower().split()
            k = min(5, len(own))
            grams = lambda w: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}  # noqa: E731,B023
            if own and len(grams(own) & grams(words)) >= 0.75 * len(grams(own)):
                return True
        return False

    want = [r for r in rows if not leaks(r[1])]
    assert got == sorted(map(str, want)) and 0 < len(want) < len(rows)


def test_toxicity_words_walked_together_and_joined_hits(spark):
    """Words that share their first letters' states find what each finds alone; the
    joins of terms and of hits give the scores that the broadcasts give."""
    rnd = random.Random(5)
    terms = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.choice([4, 5, 7, 10, 13]))) for _ in range(40)})
    trie = toxicity.Trie(terms)
    words = sorted({"".join(rnd.choice("abcd") for _ in range(rnd.randrange(1, 15))) for _ in range(600)} | {t[1:] for t in terms} | {t + "x" for t in terms} | {"", "a" * 60, "日本語語"})
    got = {w: (k, e) for w, k, e in trie.walk(words)}
    for w in words:
        want = min(((e, k) for k, t in enumerate(terms) if (e := toxicity.taken(w, t)) is not None), default=None)
        assert got.get(w) == (want and want[::-1]), w
    rows = [(i, f"number{i} of the words " + ("badword you" if i % 3 == 0 else "fine you")) for i in range(300)] + [(1000, None), (None, "badwrd!"), (None, "badwrd!"), (1001, "abdword " * 50)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    ways = [sorted((str(r.doc_id), round(r.score, 9), r.predicted) for r in toxicity.score(df, labels, **k).collect()) for k in ({}, {"broadcast_terms": 0}, {"broadcast_hits": 0}, {"broadcast_terms": 0, "broadcast_hits": 0})]
    assert len(ways[0]) == len(rows) and ways[0] == ways[1] == ways[2] == ways[3]


def _plain_scores(texts, good, drawn):
    """Both models by enumeration: probabilities of every known word after every context."""
    ws = [(t or "").encode().lower().split() for t in texts]
    models, total = [], Counter()
    for mine in (good, drawn):
        words, pairs = Counter(), Counter()
        for i, w in enumerate(ws):
            if w and i in mine:
                words.update([None, *w])
                pairs.update(zip([None, *w], w))
        models.append((words, pairs))
    both, both_pairs = (models[0][k] + models[1][k] for k in (0, 1))
    vocab = {w for w, n in both.items() if n >= 3 and w is not None}
    out = []
    for words, pairs in models:
        n = sum(c for w, c in words.items() if w is not None)
        single = {w: (words[w] + 0.5) / (n + 0.5 * (len(vocab) + 1)) for w in vocab}
        single["?"] = (sum(c for w, c in words.items() if w is not None and w not in vocab) + 0.5) / (n + 0.5 * (len(vocab) + 1))
        kept = {p: pairs[p] for p, c in both_pairs.items() if c >= 3 and p[1] in vocab and (p[0] is None or p[0] in vocab)}

        def prob(h, w):
            f = words[h] if h is None or h in vocab else 0
            seen = 0.6 * kept.get((h, w), 0) / f if f else 0.0
            left = 1 - 0.6 * sum(c for p, c in kept.items() if p[0] == h) / f if f else 1.0
            return seen + left * single[w if w in vocab else "?"]

        for h in [None, *list(vocab)[:5], b"never seen"]:
            assert sum(prob(h, w) for w in vocab | {"?"}) == pytest.approx(1)
        out.append([-sum(np.log(prob(h, w)) for h, w in zip([None, *w_], w_)) / len(w_) if w_ else None for w_ in ws])
    return out


@pytest.mark.parametrize("all_drawn", [True, False])
def test_cross_entropy_equals_enumeration(spark, all_drawn):
    rnd = random.Random(6)
    texts = [" ".join(rnd.choice(["Red", "green", "blue", "cat", "dog"] if i % 2 else [f"z{k}" for k in range(40)]) for _ in range(rnd.randrange(1, 30))) for i in range(90)] + [None, "", " \n", "red unseen cat", "Ünï ünï ünï ünï"]
    rows = [(i, t, "x", 1) for i, t in enumerate(texts)] + [(None, "red cat", "x", 1), (91, "", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, word string, t int").repartition(3)
    labels = spark.createDataFrame([(i, 1 if all_drawn else i % 2) for i in range(len(texts))] + [(None, 1), (3, None)], "doc_id long, quality int")
    good = {r.doc_id for r in labels.where("quality = 1").collect()}
    # The background is drawn by hash, so the enumeration takes the same draw.
    sizes = [len((t or "").split()) for _, t, _, _ in rows]
    share = min(1.0, sum(n for n, r in zip(sizes, rows) if r[0] in good and r[0] is not None) / sum(sizes))
    draw = F.pmod(F.xxhash64(F.lit("background"), F.col("doc_id").alias("id"), "text"), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    drawn = {(r.doc_id, r.text) for r in df.where(draw).collect()}
    numbered = [t for _, t, _, _ in rows]
    want = _plain_scores(numbered, {k for k, r in enumerate(rows) if r[0] in good and r[0] is not None}, {k for k, r in enumerate(rows) if (r[0], r[1]) in drawn})
    want = sorted((str(r[0]), r[1] or "", x, y) for r, x, y in zip(rows, *want) if x is not None)
    ways = []
    for k in ({}, {"broadcast_rows": 0}):
        got = cross_entropy.score(df, labels, **k).collect()
        assert len(got) == len(rows) and all(r.score is None and r.loss_target is None for r in got if r.n_tokens == 0)
        ways.append(sorted((str(r.doc_id), r.loss_target, r.loss_background) for r in got if r.n_tokens))
    for way in ways:
        assert [r[0] for r in way] == [r[0] for r in want]
        for r, w in zip(way, want):
            assert r[1:] == pytest.approx(w[2:], rel=1e-5)
    assert [r[1:] == pytest.approx(q[1:], rel=1e-12) for r, q in zip(*ways)] == [True] * len(want)
    assert cross_entropy.score(df.limit(0), labels).count() == 0 and cross_entropy.score(df, labels.limit(0)).where("score IS NOT NULL").count() == 0


def test_words_new_to_the_cache_equal_the_library(monkeypatch):
    from public_tokenizers import path
    from tessera.llm.wordbpe import WordBpe

    bpe, rnd = WordBpe(path("word_bpe_49k.json"), cache=50), random.Random(3)
    texts = [" ".join("".join(rnd.choice("abcézñßÀÖ'_.,!#$%&*<>0123456789sS") for _ in range(rnd.randrange(1, 9))) for _ in range(rnd.randrange(1, 60))) for _ in range(60)]
    texts += ["It's we've ''s .'s _a_ x1y2", "a" * 70 + " b " + "a" * 70, "  \t\n "]
    # words of a plain text are not tested one by one
    monkeypatch.setattr(WordBpe, "word", lambda self, w: pytest.fail(w))
    for t in [*texts, *texts]:
        if "<|" not in t:
            assert np.frombuffer(bpe.encode(t), "<u4").tolist() == bpe.library.encode(t, add_special_tokens=False).ids


@pytest.mark.parametrize("chunk", [1, 7, 10**6])
def test_cross_entropy_scores_texts_together(monkeypatch, chunk):
    from types import SimpleNamespace as Held

    monkeypatch.setattr(cross_entropy, "CHUNK_WORDS", chunk)
    texts = [None, "a b a", "", "zz", "b zz a b", " ", "a"]
    hash_of = {w: int(cross_entropy.word_hashes(w)[0]) for w in ("a", "b", "zz")}
    known = np.sort(np.array([cross_entropy.START, hash_of["a"], hash_of["b"]], "u8"))
    losses = np.arange(12, dtype="f4").reshape(3, 4) + 1
    at = {w: int(np.searchsorted(known, np.uint64(h))) for w, h in {**hash_of, None: cross_entropy.START}.items()}
    gains = {(None, "a"): (0.5, 0.25), ("a", "b"): (2.0, 4.0)}
    keys = sorted((at[f] * 3 + at[w], *g) for (f, w), g in gains.items())
    table = pa.table({"key": pa.array([k[0] for k in keys]), "kt": pa.array([k[1] for k in keys], pa.float32()), "kb": pa.array([k[2] for k in keys], pa.float32())})
    for pairs in (table, table.slice(0, 0)):
        run = cross_entropy._scorer(Held(value=(known, losses)), Held(value=pairs), (10.0, 20.0))
        got = [tuple(r.values()) for b in run(iter([pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], names=["id", "text"])])) for r in b.to_pylist()]
        for (i, n, *sums), t in zip(got, texts):
            ws = (t or "").split()
            assert n == len(ws) and (n or sums == [None, None])
            for c in (0, 1) if ws else ():
                want = sum(losses[at[w], c] if w != "zz" else (10.0, 20.0)[c] for w in ws)
                want += sum(losses[at[f], 2 + c] for f in [None, *ws[:-1]] if f != "zz")
                want += sum(gains[p][c] for p in zip([None, *ws], ws) if p in gains) if len(pairs) else 0
                assert sums[c] == pytest.approx(float(want))
        assert len(got) == len(texts)


def test_pipeline_encoding_holds_one_python_worker_a_task(spark):
    """Encoding and decoding are separate jobs, with the digests of the chained operators."""
    from tessera.llm import bpe_tree

    rows = [(k, t, "en", "web", len(t or "")) for k, t in enumerate(["two words", "", None, "naïve \u2603 <|endoftext|>", "two words"])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    vocab = corpus_pipeline.tokenizer_files.path(corpus_pipeline.VOCAB)
    got = corpus_pipeline.encoding(spark, df, "")
    assert got._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    chained = bpe_tree.digests(bpe_tree.decode_documents(bpe_tree.encode_documents(df, vocab), vocab))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, chained.collect()))


def test_cross_entropy_in_parts_writes_no_words_of_documents(spark, monkeypatch):
    """A model beyond the broadcast is sent in parts; documents are not taken apart into rows."""
    rnd = random.Random(8)
    text = lambda k: " ".join(f"w{rnd.randrange(60) * k}" for _ in range(rnd.randrange(0, 60)))
    rows = [(i, text(1 + i % 2), "x", 1, "y", 0) for i in range(300)] + [(7, None, "x", 1, "y", 0), (None, "w1 w2 w3", "x", 1, "y", 0), (5, "w0", "x", 1, "y", 0)]
    df = spark.createDataFrame([(r[0], r[1]) for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(250)], "doc_id long, quality int, toxic int")
    kept, real = [], cross_entropy.stored
    monkeypatch.setattr(cross_entropy, "stored", lambda d, name: kept.append(name) or real(d, name))
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.n_tokens)
    whole = sorted(cross_entropy.score(df, labels).collect(), key=key)
    monkeypatch.setattr(cross_entropy, "PART_WORDS", 500)
    for limit in (40,):
        kept.clear()
        parts = sorted(cross_entropy.score(df, labels, broadcast_rows=limit).collect(), key=key)
        assert "model_parts" in kept and not {"rows", "document_grams"} & set(kept)
        assert len(parts) == len(whole) == 303
        for a, b in zip(whole, parts):
            assert (a.doc_id, a.n_tokens) == (b.doc_id, b.n_tokens)
            assert (a.loss_target, a.loss_background) == (None, None) == (b.loss_target, b.loss_background) or (a.loss_target, a.loss_background, a.score) == pytest.approx((b.loss_target, b.loss_background, b.score), rel=1e-6, abs=1e-6)
