"""Personal data: base patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are taken as they are. The semi-CRF
looks at regions, short stretches around digit runs or written-out addresses,
cuts them into atoms (letter runs, digit runs, single other characters) and
scores whole candidate segments of at most `MAX_ATOMS` atoms: the shape of the
span, its digit groups, check sum and octets, the marks in it, and what stands
beside it. Dynamic programming over the atoms chooses boundaries and types
together. Its spans are added where no base span overlaps.

The model is trained here, by the exact gradient of the likelihood (forward
and backward over segments), on a bounded sample: the `SAMPLE` regions with
the smallest hashes. Their labels are the base matches; copies in which a match
is rewritten in a form the patterns miss (spelled-out addresses, phones
without the plus, dotted cards) carry the label over. Regions without a match,
and copies whose match is spoilt (a wrong check sum, a part above 255, a date),
teach what is not personal data.

Positions are code points, ends exclusive.

Defined results: null text counts as empty; a null id and repeated rows pass
through, a row each; other columns are not read; an empty table gives no
rows, and trains an empty model that adds nothing."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
SAMPLE = 400
EPOCHS = 4
RATE = 0.2
DECAY = 1e-4
MAX_ATOMS = 16
MAX_REGION = 120  # atoms; a longer run of digits and marks is worked through in stretches that overlap by MAX_ATOMS
CONTEXT = 12

#: The base patterns.
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DIGIT = re.compile(r"[0-9]")
_NUMBER = re.compile(r"(?<![0-9A-Za-z])[+(]?[0-9](?:[ .()/-]{0,2}[0-9]){5,}(?![0-9A-Za-z])")
# What follows the local part of a written-out address, in either case; no address without it.
_HOST = r"(?:@|\([Aa][Tt]\)|\[[Aa][Tt]\]|\b[Aa][Tt]\b) ?[A-Za-z0-9-]{1,63}(?:(?:\.| ?(?:\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\]|\b[Dd][Oo][Tt]\b) ?)[A-Za-z0-9-]{1,63}){1,4}"
_SPELLED_HOST = re.compile(_HOST)
_SPELLED = re.compile(r"[A-Za-z0-9._%+-]{1,64} ?" + _HOST)
_AT, _DOT = re.compile(r"@|\([Aa][Tt]\)|\[[Aa][Tt]\]| [Aa][Tt] "), re.compile(r"\.|\([Dd][Oo][Tt]\)|\[[Dd][Oo][Tt]\]| [Dd][Oo][Tt] ")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|[^A-Za-z0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of EMAIL, found from their @ so that a long run without one is read once."""
    found, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1, start):
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            found.append(m.span())
            done = m.end()
        at = text.find("@", max(at + 1, done))
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of the base patterns by start, then kind."""
    found = [(a, b, 0) for a, b in emails(text)] if "@" in text else []
    if _DIGIT.search(text):
        for m in IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                found.append((*m.span(), 1))
        for m in CARD.finditer(text):
            digits = re.sub(r"[\x20-]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                found.append((*m.span(), 2))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 10 <= sum(c in "0123456789" for c in m.group()) <= 15:
                    found.append((*m.span(), 3))
    return sorted(found, key=lambda s: (s[0], s[2], s[1]))


def regions(text: str) -> list[tuple[int, int]]:
    found = [m.span() for m in _NUMBER.finditer(text)] if _DIGIT.search(text) else []
    if _SPELLED_HOST.search(text):
        found += [m.span() for m in _SPELLED.finditer(text)]
    merged: list[list[int]] = []
    for a, b in sorted(found):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(b, merged[-1][1])
        else:
            merged.append([a, b])
    return [(a, b) for a, b in merged]


def shape(s: str) -> str:
    return re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", s))


def features(text: str, a: int, b: int) -> list[str]:
    """Features of the whole span text[a:b]."""
    s = text[a:b]
    groups = re.findall(r"[0-9]+", s)
    digits = "".join(groups)
    lone = not re.search(r"[A-Za-z]", s)
    before, after = text[a - 1 : a], text[b : b + 1]
    out = ["bias", "shape " + shape(s)[:40], f"digits {min(len(digits), 20)}", f"groups {'-'.join(str(len(g)) for g in groups)[:24]}",
           f"before {shape(before) or '^'}", f"after {shape(after) or '$'}", f"marks {''.join(sorted(set(re.findall('[^A-Za-z0-9]', s))))[:8]}", f"first {shape(s[:1])}", f"last {shape(s[-1:])}"]
    if lone and 14 <= len(digits) <= 19:
        out.append(f"sum {luhn(digits)} letters {not lone}")
    elif lone and 10 <= len(digits) <= 13:
        out.append("phone length")
    if len(groups) == 4 and re.fullmatch(r"[0-9]+(?:\.[0-9]+){3}", s):
        out.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)}")
    if at := _AT.search(s):
        tail = _DOT.split(s[at.end() :])
        out.append(f"address {len(tail) > 1 and all(t.strip() for t in tail)} {2 <= len(tail[-1].strip()) <= 6}")
    return out


class Lattice:
    """Atoms of a region and the candidate segments over them."""

    def __init__(self, text: str, start: int, end: int) -> None:
        self.atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
        n = len(self.atoms)
        self.segments = []  # (first atom, atom after the last, features)
        for i in range(n):
            if text[self.atoms[i][0]].isspace():
                continue
            for j in range(i + 1, min(n, i + MAX_ATOMS) + 1):
                a, b = self.atoms[i][0], self.atoms[j - 1][1]
                if not text[b - 1].isspace() and (_DIGIT.search(text, a, b) or "@" in text[a:b] or "at" in text[a:b].lower()):
                    self.segments.append((i, j, features(text, a, b)))


class SemiCrf:
    def __init__(self, index: dict[str, int] | None = None, weights: np.ndarray | None = None) -> None:
        self.index = index if index is not None else {}
        self.weights = weights if weights is not None else np.zeros((0, len(KINDS)))

    def scores(self, lattice: Lattice) -> np.ndarray:
        out = np.full((len(lattice.segments), len(KINDS)), -1.0)
        for k, (_, _, names) in enumerate(lattice.segments):
            out[k] = self.weights[[i for i in map(self.index.get, names) if i is not None]].sum(axis=0) if len(self.weights) else -1.0
        return out

    def best(self, lattice: Lattice) -> list[tuple[int, int, int]]:
        """(first atom, atom after the last, kind) of the best segmentation."""
        n, scores = len(lattice.atoms), self.scores(lattice)
        value, back = [0.0] * (n + 1), [None] * (n + 1)
        ending = defaultdict(list)
        for k, (i, j, _) in enumerate(lattice.segments):
            ending[j].append((i, k))
        for j in range(1, n + 1):
            value[j] = value[j - 1]
            for i, k in ending[j]:
                kind = int(scores[k].argmax())
                if (v := value[i] + scores[k, kind]) > value[j]:
                    value[j], back[j] = v, (i, kind)
        out, j = [], n
        while j > 0:
            if back[j]:
                out.append((back[j][0], j, back[j][1]))
                j = back[j][0]
            else:
                j -= 1
        return out[::-1]

    def gradient(self, lattice: Lattice, gold: set[tuple[int, int, int]], rate: float) -> None:
        """One step up the log likelihood of a labelled region."""
        n, scores = len(lattice.atoms), self.scores(lattice)
        ahead, behind = np.full(n + 1, -np.inf), np.full(n + 1, -np.inf)
        ahead[0] = behind[n] = 0.0
        total = np.logaddexp.reduce(scores, axis=1)
        starting, ending = defaultdict(list), defaultdict(list)
        for k, (i, j, _) in enumerate(lattice.segments):
            starting[i].append((j, total[k]))
            ending[j].append((i, total[k]))
        for j in range(1, n + 1):
            ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[i] + s for i, s in ending[j])])
        for i in range(n - 1, -1, -1):
            behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[j] + s for j, s in starting[i])])
        for k, (i, j, names) in enumerate(lattice.segments):
            chance = np.exp(ahead[i] + behind[j] + scores[k] - ahead[n])
            chance *= -1
            for kind in range(len(KINDS)):
                if (i, j, kind) in gold:
                    chance[kind] += 1
            if np.abs(chance).max() > 1e-4:
                at = [self.index[x] for x in names]
                self.weights[at] += rate * (chance - DECAY * self.weights[at])


def rewritten(region: str, span: tuple[int, int, int]) -> list[tuple[str, int, int, int]]:
    """Copies of a region with the match in a form that the base patterns miss,
    or (kind -1) replaced by something alike that is no personal data."""
    a, b, kind = span
    s = region[a:b]
    if kind == 0:
        user, _, host = s.partition("@")
        forms = [f"{user} at {host.replace('.', ' dot ')}", f"{user}[at]{host.replace('.', '[dot]')}", f"{user}(at){host}", f"{user} @ {host}"]
    elif kind == 2:
        d = re.sub("[^0-9]", "", s)
        forms = [".".join(d[i : i + 4] for i in range(0, len(d), 4))]
    elif kind == 3:
        d = re.sub("[^0-9]", "", s)
        forms = [s[1:], f"({d[-10:-7]}) {d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}-{d[-7:-4]}-{d[-4:]}", f"{d[-10:-7]}.{d[-7:-4]}.{d[-4:]}"]
    else:
        forms = []
    digit = [int(c) for c in s if c in "0123456789"] or [0]
    wrong = {1: [f"{256 + 7 * digit[0]}{s[s.index('.'):]}" if kind == 1 else ""], 2: [s[:-1] + str((digit[-1] + 1 + digit[0] % 8) % 10)],
             3: [f"20{digit[0]}{digit[-1]}-0{1 + digit[-1] % 9}-1{digit[-2] if len(digit) > 1 else 0} 1{digit[-1]}:{digit[0] % 6}{digit[-1]}", f"{digit[0]}.{''.join(map(str, digit))}", "".join(map(str, digit))]}.get(kind, [])
    return [(region[:a] + f + region[b:], a, a + len(f), k) for fs, k in ((forms, kind), (wrong, -1)) for f in fs]


def train(windows: list[tuple[str, int, int]]) -> SemiCrf:
    """From (text, region start, region end); the text around a region is its context."""
    cases = []
    for text, start, end in windows:
        gold = [s for s in base_spans(text) if s[0] < end and s[1] > start]
        if any(x[1] > y[0] for x, y in zip(gold, gold[1:])):
            continue  # base spans of two kinds overlap: no single labelling
        low, high = min([start, *(s[0] for s in gold)]), max([end, *(s[1] for s in gold)])
        cases.append((text, low, high, gold))
        if len(gold) == 1:
            for new, a, b, kind in rewritten(text, gold[0]):
                cases.append((new, min(a, low), max(b, high + len(new) - len(text)), [(a, b, kind)] if kind >= 0 else []))
    labelled, index = [], {}
    for text, low, high, gold in cases:
        lattice = Lattice(text, low, high)
        if not lattice.segments or len(lattice.atoms) > MAX_REGION:
            continue
        first, last = {a: i for i, (a, _) in enumerate(lattice.atoms)}, {b: i + 1 for i, (_, b) in enumerate(lattice.atoms)}
        want = {(first[a], last[b], k) for a, b, k in gold if a in first and b in last}
        for _, _, names in lattice.segments:
            for x in names:
                index.setdefault(x, len(index))
        labelled.append((lattice, want))
    model = SemiCrf(index, np.zeros((len(index), len(KINDS))))
    if index:
        model.weights[index["bias"]] = -2.0
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(labelled)):
            model.gradient(*labelled[k], RATE / (1 + epoch))
    return model


def stretches(text: str, start: int, end: int) -> Iterator[tuple[int, int]]:
    """A region in pieces of at most MAX_REGION atoms, overlapping by MAX_ATOMS."""
    atoms = [m.span() for m in _ATOM.finditer(text, start, end)]
    for k in range(0, max(1, len(atoms)), MAX_REGION - MAX_ATOMS):
        part = atoms[k : k + MAX_REGION]
        if part:
            yield part[0][0], part[-1][1]
        if k + MAX_REGION >= len(atoms):
            return


def added_spans(model: SemiCrf, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    out: list[tuple[int, int, int]] = []
    for start, end in regions(text):
        if any(a <= start and b >= end for a, b, _ in base):
            continue
        for low, high in stretches(text, start, end):
            lattice = Lattice(text, low, high)
            for i, j, kind in model.best(lattice):
                a, b = lattice.atoms[i][0], lattice.atoms[j - 1][1]
                if all(b <= x or a >= y for x, y, _ in base) and all(b <= x or a >= y for x, y, _ in out):
                    out.append((a, b, kind))
    return out


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("h", pa.int64()), ("text", pa.string()), ("low", pa.int32()), ("high", pa.int32())])
    for batch in batches:
        rows = []
        for text in batch.column(0):
            text = text.as_py() or ""
            for a, b in regions(text):
                if b - a <= 200:
                    low = max(0, a - 40)
                    window = text[low : b + 40]
                    rows.append((xxhash.xxh3_64_intdigest(window.encode()) >> 1, window, a - low, b - low))
        # The sample is the smallest hashes of all, so of each batch only its smallest can be in it.
        rows = sorted(set(rows))[:SAMPLE]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema=schema)


def fit(docs: DataFrame, text_col: str = "text") -> SemiCrf:
    """Train on the SAMPLE distinct regions of the smallest hashes."""
    found = docs.select(docs[text_col].alias("text")).mapInArrow(_windows, "h long, text string, low int, high int")
    picked = found.groupBy("h", "text", "low", "high").agg(F.lit(1).alias("one")).orderBy("h", "text", "low").limit(SAMPLE).collect()
    return train([(r.text, r.low, r.high) for r in picked])


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], s[2], s[1])))


def masked(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, b, k in sorted(spans):
        if b <= at:
            continue
        out += [text[at : max(at, a)], f"[{KINDS[k].upper()}]" if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def _finder(model: SemiCrf, with_text: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 512):
                some = batch.slice(k, 512)
                counts, base_, all_, clean = [], [], [], []
                for text in some.column(1):
                    raw = text.as_py()
                    text = raw or ""
                    base = base_spans(text)
                    more = base + added_spans(model, text, base)
                    counts.append([sum(s[2] == k for s in base) for k in range(len(KINDS))])
                    base_.append(joined(base))
                    all_.append(joined(more))
                    if with_text:
                        clean.append(masked(text, more) if more else raw)
                columns = [some.column(0), *(pa.array([c[k] for c in counts], pa.int64()) for k in range(len(KINDS))), pa.array(base_, pa.string()), pa.array(all_, pa.string())]
                names = ["id", *(f"n_{k}" for k in KINDS), "base", "spans"]
                yield pa.RecordBatch.from_arrays(columns + [pa.array(clean, pa.string())] * with_text, names=names + ["clean_text"] * with_text)

    return run


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: SemiCrf | None = None, with_text: bool = False) -> DataFrame:
    """(id, n_email, n_ip, n_card, n_phone of the base patterns, base, spans of both
    as kind:start:end[, clean_text with every span replaced by its kind])."""
    model = model or fit(docs, text_col)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    schema = f"id {kind}, " + ", ".join(f"n_{k} long" for k in KINDS) + ", base string, spans string" + ", clean_text string" * with_text
    return slim.mapInArrow(_finder(model, with_text), schema).withColumnRenamed("id", id_col)


def digests(found: DataFrame) -> DataFrame:
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans")
