"""Toxicity by lexicon, Levenshtein automata and context windows.

The lexicon is learned: words (4 to 40 letters) of at least `MIN_DF` toxic
training texts, kept when the G-squared statistic and the share of toxic texts
among those that hold them reach `MIN_G2` and `MIN_SHARE`. Counts and statistics
are computed in Spark for every word, and all words that pass are terms.
The distinct words of all texts are matched once: sorted by range, each task walks its words through the
Levenshtein automaton intersected with a trie of the terms, and words that begin
alike share the states of their common letters. It finds the terms within one edit. A swap of two neighbouring letters is one
edit; terms of `LONG` letters or more are found within two edits. Words shorter
than `FUZZY_LENGTH` are found by one substitution or swap, and such a hit counts
only where its window speaks for abuse rather than quotation. Beyond `BROADCAST_TERMS` terms
the words are joined with the terms on what is left of either with
one or two letters out, which finds the same terms. Up to `BROADCAST_HITS` words that hit go to every task; more
are joined to the texts that hold them. Every hit is scored by its window: quoting
marks and words of report around it speak for quotation, address and emphasis
for abuse. A logistic regression over the summed scores gives the probability.

Labels are read only for training rows: those whose crc32(id as text) mod 5 is
not 0; remainders 1 to 3 make the lexicon, 4 fits
the regression on the `FIT_ROWS` rows of the smallest hashes. Label, language,
source and id are no inputs of a score.

Defined results: null and empty texts score as texts without hits; null ids
(held_out null) and repeated rows pass through, a row each; null labels are
ignored; other columns are not read; without training rows of both classes
every score is 0.5 or the share of the class there is; an empty table gives no
rows."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

FOLDS = 5
MIN_DF = 4
MIN_G2 = 12.0
MIN_SHARE = 0.6
BROADCAST_TERMS = 20_000  # tries of so many terms take about 100 MB in a task
BROADCAST_HITS = 200_000  # words taken for a term; about 30 MB in a task
FLUSH = 200_000  # words counted in a task before they are handed on
SALTS = 16
FIT_ROWS = 20_000
BROADCAST_LABELS = 1_000_000
WINDOW = 6
FUZZY_LENGTH = 5  # shorter words are found by substitution or swap, under the guard of their window
LONG = 10  # terms of so many letters are found within two edits
MAX_WORD = 40
_TRIM = "\"'`.,;:!?()[]{}<>*#$%&|~_-+=/\\«»“”„‘’…"
_QUOTES = re.compile("[\"«»“”„]")
#: Words of report and of address.
_REPORT = frozenset("said says wrote quoted quote quoting called word words term reported alleged sagte schrieb zitat wort dit écrit mot citation dijo escribió palabra cita".split())
_ADDRESS = frozenset("you your youre u du dich dein ihr tu te toi vous votre tú usted eres sois".split())


def distance(a: str, b: str) -> int:
    """Edits between two words; a swap of neighbours is one, no letter is edited twice."""
    old, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, old[j - 2] + 1)
            new.append(d)
        old, row = row, new
    return row[-1]


def taken(word: str, term: str) -> int | None:
    """The edits of a word that is taken for a term, else None."""
    if word == term:
        return 0
    if len(word) > MAX_WORD or len(word) < FUZZY_LENGTH and len(word) != len(term) or abs(len(word) - len(term)) > 2:
        return None
    edits = distance(word, term)
    return edits if edits <= (2 if len(term) >= LONG and len(word) >= FUZZY_LENGTH else 1) else None


def keys(word: str, edits: int) -> set[str]:
    """The word, and what is left of it with up to `edits` letters out: words within so many edits share one of them."""
    out = last = {word}
    for _ in range(edits):
        last = {w[:i] + w[i + 1 :] for w in last for i in range(len(w))}
        out = out | last
    return out


#: States of the automaton after some letters of a word: the edits spent at each trie node, and
#: at (node, letter) those of a swap whose second letter is still to be read.
States = tuple[dict[int, int], dict[tuple[int, str], int]]


class Trie:
    """Lexicon terms by letter, and the Levenshtein automaton of words run over it."""

    def __init__(self, terms: list[str]) -> None:
        self.terms, self.children, self.end, self.bound = terms, [{}], [-1], [0]
        for k, term in enumerate(terms):
            most, node = 2 if len(term) >= LONG else 1, 0
            self.bound[0] = max(self.bound[0], most)
            for c in term:
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.end.append(-1)
                    self.bound.append(0)
                node = self.children[node][c]
                self.bound[node] = max(self.bound[node], most)
            self.end[node] = k
        self.start = self._closed({0: 0}), {}

    def _closed(self, spent: dict[int, int]) -> dict[int, int]:
        """With the nodes that letters of a term missing in the word lead to."""
        todo = list(spent.items())
        for node, e in todo:
            if spent[node] == e:
                for child in self.children[node].values():
                    if e < self.bound[child] and e + 1 < spent.get(child, 9):
                        spent[child] = e + 1
                        todo.append((child, e + 1))
        return spent

    def step(self, states: States, c: str, swaps: bool = True) -> States:
        """The states after one more letter of the word."""
        new: dict[int, int] = {}
        swapped: dict[tuple[int, str], int] = {}
        children, bound = self.children, self.bound
        for node, e in states[0].items():
            kids = children[node]
            same = kids.get(c)
            if same is not None and e <= bound[same] and e < new.get(same, 9):
                new[same] = e
            e += 1
            if e > bound[node]:
                continue
            if e < new.get(node, 9):
                new[node] = e
            for x, kid in kids.items():
                if x != c and e <= bound[kid]:
                    if e < new.get(kid, 9):
                        new[kid] = e
                    after = children[kid].get(c)
                    if swaps and after is not None and e <= bound[after] and e < swapped.get((after, x), 9):
                        swapped[after, x] = e
        for (node, x), e in states[1].items():
            if x == c and e < new.get(node, 9):
                new[node] = e
        return self._closed(new), swapped

    def _best(self, states: States, n: int) -> tuple[int, int] | None:
        """(term, edits) of the nearest term that a word of n letters with these last states is taken for; ties: the first term."""
        found = []
        for node, e in states[0].items():
            k = self.end[node]
            if k >= 0:
                size = len(self.terms[k])
                if e == 0 or e <= (2 if size >= LONG and n >= FUZZY_LENGTH else 1) and (n >= FUZZY_LENGTH or n == size):
                    found.append((e, k))
        return min(found)[::-1] if found else None

    def walk(self, words: Iterable[str]) -> Iterator[tuple[str, int, int]]:
        """(word, term, edits) of the words that are taken for a term. Words in sorted
        order share the states of the letters that they begin with."""
        path, last = [self.start], ""
        for word in words:
            same, most = 0, min(len(word), len(path) - 1)
            while same < most and word[same] == last[same]:
                same += 1
            del path[same + 1 :]
            for c in word[same:]:
                if not (path[-1][0] or path[-1][1]):
                    break
                path.append(self.step(path[-1], c))
            last = word
            if len(path) == len(word) + 1 and len(word) <= MAX_WORD and (best := self._best(path[-1], len(word))):
                yield word, *best

    def nearest(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term that the word is taken for."""
        return next(((k, e) for _, k, e in self.walk([word])), None)

    def near(self, word: str) -> tuple[int, int] | None:
        """(term, edits) of the nearest term within one edit, swaps not among them, whatever the lengths."""
        states = self.start
        for c in word:
            states = self.step(states, c, swaps=False)
        found = [(e, self.end[node]) for node, e in states[0].items() if self.end[node] >= 0 and e <= 1]
        return min(found)[::-1] if found else None


class Lexicon:
    """Terms with their weights, for single texts."""

    def __init__(self, terms: list[tuple[str, float]]) -> None:
        self.weights, self.trie = [w for _, w in terms], Trie([t for t, _ in terms])

    def look(self, raw: str) -> tuple[float, int]:
        """(weight, edits) of a word as it stands in the text, lower-cased; weight 0: no term."""
        near = self.trie.nearest(raw.strip(_TRIM))
        return (self.weights[near[0]], near[1]) if near else (0.0, 0)

    def features(self, text: str | None) -> list[float]:
        ws = (text or "").lower().split()
        return window_features(ws, {i: g for i, g in enumerate(map(self.look, ws)) if g[0]})


def window_features(ws: list[str], hits: dict[int, tuple[float, int]]) -> list[float]:
    """Features of a text from its words and the (weight, edits) of those that are terms, by position."""
    exact = fuzzy = abuse = quoted = most = 0.0
    unsure = {i for i, g in hits.items() if g[1] and len(ws[i].strip(_TRIM)) < FUZZY_LENGTH}
    n_hits = 0
    for i, (weight, edits) in hits.items():
        low = max(0, i - WINDOW)
        window = ws[low : i + WINDOW + 1]
        before, after = " ".join(ws[low : i + 1]), " ".join(ws[i : i + WINDOW + 1])
        quote = bool(_QUOTES.search(before) and _QUOTES.search(after)) + any(w.strip(_TRIM) in _REPORT for w in ws[low:i])
        heat = any(w.strip(_TRIM) in _ADDRESS for w in window) + ws[i].endswith("!") + sum(hits[j][0] > 0 for j in range(low, min(len(ws), i + WINDOW + 1)) if j != i and j in hits and j not in unsure) / 2
        if i in unsure and heat <= quote:
            continue
        n_hits += 1
        exact, fuzzy = exact + (edits == 0) * weight, fuzzy + (edits > 0) * weight
        quoted, abuse, most = quoted + quote * weight, abuse + heat * weight, max(most, weight / (1 + edits))
    return [math.log1p(exact), math.log1p(fuzzy), math.log1p(abuse), math.log1p(quoted), most, float(n_hits > 0), math.log1p(100 * n_hits / (len(ws) + 20)), math.log1p(len(ws))]


N_FEATURES = 8


def fold(id_col: Column) -> Column:
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(FOLDS)).cast("int")


def _labelled(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(id, text, label, fold) of the training rows."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).withColumn("fold", fold(F.col("id"))).where("fold != 0")
    known = known.groupBy("id", "fold").agg(F.max("label").alias("label"))
    if known.count() <= BROADCAST_LABELS:
        known = F.broadcast(known)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).join(known, "id")


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_toxic, n_clean) from (text, label): in how many texts of each class a word stands."""
    counts: tuple[Counter, Counter] = (Counter(), Counter())

    def handed_on() -> pa.RecordBatch:
        ws = list(counts[0].keys() | counts[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(ws, pa.string()), *(pa.array([c[w] for w in ws], pa.int64()) for c in counts[::-1])], names=["word", "n_toxic", "n_clean"])
        for c in counts:
            c.clear()
        return out

    for batch in batches:
        for text, label in zip(batch.column(0), batch.column(1).to_pylist()):
            found = {w.strip(_TRIM) for w in (text.as_py() or "").lower().split()}
            counts[label].update(w for w in found if 4 <= len(w) <= 40)
            if len(counts[0]) + len(counts[1]) >= FLUSH:
                yield handed_on()
    yield handed_on()


def learn_lexicon(train: DataFrame) -> DataFrame:
    """(term, weight, g2) of every word that passes; the weight is its log odds."""
    sizes = {r.label: r.n for r in train.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, nc = sizes.get(1, 0), sizes.get(0, 0)
    counts = train.where("label in (0, 1)").select("text", "label").mapInArrow(_word_counts, "word string, n_toxic long, n_clean long")
    t, c, total = F.col("t").cast("double"), F.col("c").cast("double"), float(nt + nc)
    held = t + c

    def cell(o: Column, h: Column, n: int) -> Column:
        return F.when((o > 0) & (h > 0) & (n > 0), o * F.log(o * total / (h * float(n)))).otherwise(0.0)

    g2 = 2 * (cell(t, held, nt) + cell(c, held, nc) + cell(nt - t, total - held, nt) + cell(nc - c, total - held, nc))
    kept = counts.groupBy("word").agg(F.sum("n_toxic").alias("t"), F.sum("n_clean").alias("c")).where(F.col("t") >= MIN_DF).withColumn("g2", g2)
    kept = kept.where((t * nc > c * nt) & (F.col("g2") >= MIN_G2) & (t >= MIN_SHARE * held))
    weight = F.log((t + 0.5) / (nt + 1.0)) - F.log((c + 0.5) / (nc + 1.0))
    return kept.select(F.col("word").alias("term"), weight.alias("weight"), "g2")


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The words of the texts that can be or nearly be a term; each about once for `FLUSH` different ones."""
    seen: set[str] = set()

    def handed_on() -> pa.RecordBatch:
        found = {w for w in (w.strip(_TRIM) for w in seen) if 4 <= len(w) <= MAX_WORD}
        seen.clear()
        return pa.RecordBatch.from_arrays([pa.array(found, pa.string())], names=["word"])

    for batch in batches:
        for text in batch.column(0):
            seen.update((text.as_py() or "").lower().split())
            if len(seen) >= FLUSH:
                yield handed_on()
    yield handed_on()


def _matcher(terms: list[tuple[str, float]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(word, weight, edits) of the sorted words that are taken for a term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = Trie([t for t, _ in terms])
        for batch in batches:
            found = list(trie.walk(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _, _ in found], pa.string()), pa.array([terms[k][1] for _, k, _ in found], pa.float64()), pa.array([e for _, _, e in found], pa.int32())], names=["word", "weight", "edits"])

    return run


def _scorer(table: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ws = (text.as_py() or "").lower().split()
                rows.append(window_features(ws, {i: g for i, w in enumerate(ws) if (g := known.get(w.strip(_TRIM)))}))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "f"])

    return run


def _term_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, *r) for r in zip(*(c.to_pylist() for c in batch.columns)) for k in sorted(keys(r[0], 2 if len(r[0]) >= LONG else 1))]
        yield pa.RecordBatch.from_pylist([dict(zip(("key", "term", "weight", "g2"), r)) for r in rows], schema=pa.schema([("key", pa.string()), ("term", pa.string()), ("weight", pa.float64()), ("g2", pa.float64())]))


def _word_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, w) for w in batch.column(0).to_pylist() for k in sorted(keys(w, 2 if len(w) >= LONG - 2 else 1))]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["key", "word"])


def _checked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs (word, term, ...) that the lexicon takes, with their edits."""
    for batch in batches:
        found = [taken(w, t) for w, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
        at = pa.array([i for i, e in enumerate(found) if e is not None], pa.int32())
        yield pa.RecordBatch.from_arrays([*(c.take(at) for c in batch.columns), pa.array([e for e in found if e is not None], pa.int32())], names=["word", "term", "weight", "g2", "edits"])


def _held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(h, word) of the distinct words of each text that can be or nearly be a term."""
    for batch in batches:
        for k in range(0, batch.num_rows, 512):
            some = batch.slice(k, 512)
            rows = [(h, w) for h, t in zip(some.column(0).to_pylist(), some.column(1).to_pylist()) for w in {w.strip(_TRIM) for w in (t or "").lower().split()} if 4 <= len(w) <= 40]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string())], names=["h", "word"])


def _found_scorer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text, hits in zip(batch.column(1), batch.column(2)):
            found = {x["word"]: (x["weight"], x["edits"]) for x in hits.as_py() or []}
            ws = (text.as_py() or "").lower().split()
            rows.append(window_features(ws, {i: g for i, w in enumerate(ws) if (g := found.get(w.strip(_TRIM)))}))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(pa.float64()))], names=["id", "f"])


def _joined_words(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """(word, weight, edits) by joins: the lexicon is in no task as a whole."""
    near = words.mapInArrow(_word_keys, "key string, word string").join(lexicon.mapInArrow(_term_keys, "key string, term string, weight double, g2 double"), "key")
    near = near.select("word", "term", "weight", "g2").distinct().mapInArrow(_checked, "word string, term string, weight double, g2 double, edits int")
    return near.groupBy("word").agg(F.min(F.struct("edits", (-F.col("g2")).alias("rank"), "term", "weight")).alias("b")).select("word", "b.weight", "b.edits")


def _joined_features(rows: DataFrame, kind: str, found: DataFrame) -> DataFrame:
    """(id, f) of (id, text) by joins: the words that hit are in no task as a whole."""
    salt = lambda c: F.pmod(F.xxhash64(c), F.lit(SALTS)).alias("salt")
    salted = lambda df: df.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    known = rows.withColumn("h", F.sha2("text", 256))
    held = known.select("h", "text").where("text is not null").mapInArrow(_held, "h string, word string").distinct()
    hits = held.withColumn("salt", salt("h")).join(salted(found), ["word", "salt"]).groupBy("h").agg(F.collect_list(F.struct("word", "weight", "edits")).alias("hits"))
    full = known.withColumn("salt", salt("id")).join(salted(stored(hits, "hits")), ["h", "salt"], "left")
    return full.select("id", "text", "hits").mapInArrow(_found_scorer, f"id {kind}, f array<double>")


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, steps: int = 30) -> np.ndarray:
    """Weights and intercept by Newton's method."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = ridge * np.eye(len(w))
    keep[-1, -1] = 1e-6
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, x.T @ (y - p) - keep @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    return w


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", broadcast_terms: int = BROADCAST_TERMS, broadcast_hits: int = BROADCAST_HITS) -> DataFrame:
    """(id, held_out, score, predicted), one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    train = _labelled(docs, labels, id_col, text_col, label_col)
    lexicon = stored(learn_lexicon(train.where("fold < 4")), "lexicon")
    words = stored(docs.select(docs[text_col].alias("text")).mapInArrow(_distinct_words, "word string").distinct(), "words")
    if lexicon.count() <= broadcast_terms:
        terms = [(r.term, r.weight) for r in lexicon.orderBy(F.desc("g2"), "term").collect()]
        found = words.orderBy("word").mapInArrow(_matcher(terms), "word string, weight double, edits int")
    else:
        found = _joined_words(words, lexicon)
    found = stored(found.where("weight != 0"), "near_terms")
    if found.count() <= broadcast_hits:
        table = docs.sparkSession.sparkContext.broadcast({r.word: (r.weight, r.edits) for r in found.collect()})
        features = lambda df, kind: df.mapInArrow(_scorer(table), f"id {kind}, f array<double>")
    else:
        features = lambda df, kind: _joined_features(df, kind, found)
    part = train.where("fold = 4")
    rows = features(part.select(F.struct("id", "label").alias("id"), "text"), f"struct<id: {kind}, label: int>")
    fit = rows.orderBy(F.xxhash64("id.id"), "id.id", "f").limit(FIT_ROWS).collect()
    y = np.array([r.id.label for r in fit], float)
    if len(fit):
        w = logistic(np.array([r.f for r in fit]).reshape(-1, N_FEATURES), y)
    else:
        w = np.zeros(N_FEATURES + 1)
    scored = features(docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")), kind)
    z = F.lit(float(w[-1])) + sum((F.col("f")[k] * F.lit(float(w[k])) for k in range(N_FEATURES)), F.lit(0.0))
    return scored.select(F.col("id").alias(id_col), (fold(F.col("id")) == 0).alias("held_out"), (1 / (1 + F.exp(-z))).alias("score")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
