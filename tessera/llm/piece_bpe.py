"""SentencePiece BPE in vectorised merge rounds, and decoding.

The library merges, over a whole text, the adjacent pair whose joined piece
scores highest, the leftmost on ties. No piece has the space mark after
another character, so words (space marks with what follows) never affect one
another; nor do the two sides of a pair of characters that no piece has side
by side. The words of many documents that were not seen lately are laid out as
one flat numpy array of symbols, with the rank of each adjacent pair. A
round takes the least rank of every word by a segmented minimum, merges its
places at once from the left, compacts the arrays and looks up only the new
pairs; words without a pair leave. It ends when none is left.

Merging several places of a word at once gives what the library's one-by-one
order gives when no longer piece around the merged one ranks at or before it.
Where one does ("risky" ranks), a place is merged only if the one
before it in the word is further away than the longest piece: what the
library would do first at that place then cannot reach this one. Runs of more
space marks than the longest such piece holds are cut into those pieces where
all pieces of space marks, and no others, share the last score: they are merged
after all else, ties grow the leftmost, and what comes after does not matter
until the longest piece is full.

Characters without a piece become their UTF-8 bytes' pieces. The vocabulary
must be a BPE model with byte pieces, the space mark put before the text, no
other normalisation and no unused or user-defined pieces; a text that the
rounds cannot take (a normalising vocabulary) is found by `verify`.

Defined results: null and empty texts have no ids and decode to ''; null ids
and repeated rows pass through, a row each; other columns are not read; an
empty table gives no rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbpe import loaded

MARK = "▁"
CACHE_WORDS = 200_000
CACHED_CHARS = 64
ROUND_CHARS = 1 << 20
SLICE_ROWS = 256
_WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_BOUND = re.compile(f"[^{MARK}]{MARK}")
_NONE = np.iinfo(np.int32).max


class PieceBpe:
    """The vocabulary of one model file, and a bounded memory of words (two generations of `cache`)."""

    def __init__(self, path: str, cache: int = CACHE_WORDS) -> None:
        import sentencepiece

        self.library = lib = sentencepiece.SentencePieceProcessor(model_file=path)
        size = lib.vocab_size()
        names = [lib.id_to_piece(i) for i in range(size)]
        if any(map(lib.is_unused, range(size))):
            raise ValueError("unused pieces are not supported")
        self.byte_ids = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        plain = {names[i]: i for i in range(size) if not (lib.is_byte(i) or lib.is_control(i) or lib.is_unknown(i))}
        if any(_BOUND.search(p) for p in plain):
            raise ValueError("a piece has a space mark after another character")
        steps = sorted({lib.get_score(i) for i in plain.values()}, reverse=True)
        rank_of_score = {s: k for k, s in enumerate(steps)}
        rank = {p: rank_of_score[lib.get_score(i)] for p, i in plain.items()}
        # Symbols: pieces by their id, then characters that only stand inside pieces, then any other character.
        symbol = dict(plain)
        for p in plain:
            for c in p:
                symbol.setdefault(c, size + len(symbol) - len(plain))
        self.size, self.n_symbols = size, max(symbol.values()) + 2
        self.symbol_of = np.full(0x110000, self.n_symbols - 1, np.int32)
        for c, k in symbol.items():
            if len(c) == 1:
                self.symbol_of[ord(c)] = k
        pairs, joined, ranks, beside = [], [], [], set()
        pieces_at: dict[int, int] = {}
        risky = np.zeros(len(steps), bool)
        for p, i in plain.items():
            beside.update(ord(a) << 21 | ord(b) for a, b in zip(p, p[1:]))
            if len(p) > 1:
                pieces_at[rank[p]] = pieces_at.get(rank[p], 0) + 1
            for k in range(1, len(p)):
                for part in (p[:k], p[k:]):
                    if len(part) > 1 and part in plain and rank[p] <= rank[part]:
                        risky[rank[part]] = True
                if p[:k] in symbol and p[k:] in symbol:
                    pairs.append(symbol[p[:k]] * self.n_symbols + symbol[p[k:]])
                    joined.append(i)
                    ranks.append(rank[p])
        for r, n in pieces_at.items():
            risky[r] |= n > 1
        order = np.argsort(np.array(pairs, np.int64))
        self.pairs = np.append(np.array(pairs, np.int64)[order], np.iinfo(np.int64).max)
        self.joined = np.append(np.array(joined, np.int32)[order], 0)
        self.ranks = np.append(np.array(ranks, np.int32)[order], _NONE)
        self.risky, self.beside = risky, np.array(sorted(beside) or [-1], np.int64)
        self.longest = max(map(len, plain))
        runs = {len(p): rank[p] for p in plain if len(p) > 1 and set(p) == {MARK}}
        top, last = max(runs, default=0), len(steps) - 1
        self.run_id = plain.get(MARK * top, 0)
        tied = top > 1 and set(runs.values()) == {last} and pieces_at[last] == len(runs)
        alone = self.merge(np.full(top, ord(MARK)), np.arange(top) == 0)[0] if tied else []
        self.run = top if len(alone) == 1 else 0
        self.bytes_of = [b"" if lib.is_control(i) or lib.is_unknown(i) else bytes([int(n[3:5], 16)]) if lib.is_byte(i) else n.replace(MARK, " ").encode() for i, n in enumerate(names)]
        self.length_of = np.array([len(b) for b in self.bytes_of], np.int64)
        self.cache, self.young, self.old = cache, {}, {}

    def _lookup(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys = left.astype(np.int64) * self.n_symbols + right
        at = np.searchsorted(self.pairs, keys)
        hit = self.pairs[at] == keys
        return np.where(hit, self.ranks[at], _NONE), self.joined[at]

    def merge(self, points: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the flat code points, and the place of each one's first character. `first` marks where words start."""
        places = np.arange(len(points))
        if len(points) > 1:
            keys = points[:-1].astype(np.int64) << 21 | points[1:]
            at = np.minimum(np.searchsorted(self.beside, keys), len(self.beside) - 1)
            first = first.copy()
            first[1:] |= self.beside[at] != keys  # no piece has the two side by side
        sym, done = self.symbol_of[points], []
        rank, join = np.full(len(sym), _NONE, np.int32), np.zeros(len(sym), np.int32)
        inner = np.flatnonzero(~first[1:]) if len(sym) else np.zeros(0, np.int64)
        rank[inner], join[inner] = self._lookup(sym[inner], sym[inner + 1])
        while len(sym):
            starts = np.flatnonzero(first)
            sizes = np.diff(np.append(starts, len(sym)))
            least = np.minimum.reduceat(rank, starts)
            ended = least == _NONE
            if ended.any():
                out = np.repeat(ended, sizes)
                done.append((sym[out], places[out]))
                sym, places, first, rank, join = (x[~out] for x in (sym, places, first, rank, join))
                least, sizes = least[~ended], sizes[~ended]
                if not len(sym):
                    break
            word = np.repeat(np.arange(len(sizes)), sizes)
            found = np.flatnonzero(rank == least[word])
            turn = np.arange(len(found))
            linked = np.zeros(len(found), bool)
            linked[1:] = found[1:] == found[:-1] + 1  # shares a symbol with the one before
            picked = (turn - np.maximum.accumulate(np.where(linked, 0, turn))) % 2 == 0
            wary = self.risky[rank[found]]
            if wary.any():
                near = np.zeros(len(found), bool)
                near[1:] = (word[found[1:]] == word[found[:-1]]) & (places[found[1:]] - places[found[:-1]] < self.longest)
                picked = np.where(wary, ~near, picked)
            at = found[picked]
            sym[at] = join[at]
            kept = np.ones(len(sym), bool)
            kept[at + 1] = False
            sym, places, first, rank, join = (x[kept] for x in (sym, places, first, rank, join))
            at = at - np.arange(len(at))
            before = at[~first[at]] - 1
            new = np.concatenate([at, before])
            rank[new] = _NONE
            new = new[new + 1 < len(sym)]
            new = new[~first[new + 1]]
            rank[new], join[new] = self._lookup(sym[new], sym[new + 1])
        if not done:
            return sym, places
        sym, places = (np.concatenate(x) for x in zip(*done))
        order = np.argsort(places, kind="stable")
        return sym[order], places[order]

    def _encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word."""
        bodies, heads = words, None
        if self.run and MARK * (self.run + 1) in "".join(words):
            bodies, heads = [], [0] * len(words)
            for k, w in enumerate(words):
                marks = len(w) - len(w.lstrip(MARK)) if w.startswith(MARK * (self.run + 1)) else 0
                heads[k] = max(marks - 1, 0) // self.run
                bodies.append(w[heads[k] * self.run :])
        ends = np.cumsum(list(map(len, bodies)))
        points = np.frombuffer("".join(bodies).encode("utf-32-le"), "<u4").astype(np.int64)
        first = np.zeros(len(points), bool)
        first[np.append(0, ends[:-1])] = True
        sym, places = self.merge(points, first)
        rare = np.flatnonzero(sym >= self.size)
        if len(rare):  # characters without a piece
            wide = np.ones(len(sym), np.int64)
            chars = [chr(p).encode() for p in points[places[rare]].tolist()]
            wide[rare] = [len(b) for b in chars]
            ids, start = np.repeat(sym, wide), np.cumsum(wide) - wide
            into = np.repeat(start[rare], wide[rare]) + np.concatenate([np.arange(len(b)) for b in chars])
            ids[into] = self.byte_ids[np.frombuffer(b"".join(chars), np.uint8)]
            stops = np.append(start, len(ids))
        else:
            ids, stops = sym, np.arange(len(sym) + 1)
        cuts = (stops[np.append(0, np.searchsorted(places, ends))] * 4).tolist()
        packed, run = ids.astype("<i4").tobytes(), np.array([self.run_id], "<i4").tobytes()
        parts = [packed[a:b] for a, b in zip(cuts, cuts[1:])]
        return parts if heads is None else [run * h + p for h, p in zip(heads, parts)]

    def _learn(self, words: set[str]) -> list[str]:
        """Put the packed ids of these words into `young`; returns those too long to stay there."""
        missing = words - self.young.keys()
        new = [w for w in missing if w not in self.old]
        self.young.update((w, self.old[w]) for w in missing if w in self.old)
        self.young.update(zip(new, self._encode_words(new)) if new else ())
        return [w for w in missing if len(w) > CACHED_CHARS]

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; words are merged for about ROUND_CHARS characters at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        waiting: list[tuple[int, list[str]]] = []
        room = ROUND_CHARS

        def flush() -> None:
            long = self._learn(set().union(*(words for _, words in waiting)))
            for k, words in waiting:
                out[k].append(b"".join(map(self.young.__getitem__, words)))
            waiting.clear()
            for w in long:
                del self.young[w]
            if len(self.young) >= self.cache:
                self.young, self.old = {}, self.young

        for k, text in enumerate(texts):
            text, at = MARK + text.replace(" ", MARK) if text else "", 0
            while at < len(text):
                bound = _BOUND.search(text, at + room - 1) if len(text) - at > room else None
                stop = bound.start() + 1 if bound else len(text)
                waiting.append((k, _WORD.findall(text, at, stop)))
                room -= stop - at
                at = stop
                if room <= 0:
                    flush()
                    room = ROUND_CHARS
        if waiting:
            flush()
        return [np.frombuffer(b"".join(parts), "<i4") for parts in out]

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids that an encoder gave; other ids go to the library, which knows the rules for broken bytes."""
        body = b"".join(map(self.bytes_of.__getitem__, ids.tolist()))
        try:
            return body.decode().removeprefix(" ") if len(ids) == 0 or int(ids.min()) > 2 else self.library.decode(ids.tolist())
        except UnicodeDecodeError:
            return self.library.decode(ids.tolist())

    def verify(self, texts: list[str]) -> None:
        """Raise if the rounds and the library differ on any of these texts."""
        for t, ids in zip(texts, self.encode_many(texts)):
            if ids.tolist() != self.library.encode(t):
                raise ValueError(f"the library encodes {t[:50]!r} otherwise")


def _encoder(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(PieceBpe, model)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(k, SLICE_ROWS)
                ids = bpe.encode_many([t.as_py() or "" for t in some.column(1)])
                n = pa.array([len(x) for x in ids], pa.int64())
                offsets = pa.array(np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32))
                rows = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(ids), pa.int32()))
                yield pa.RecordBatch.from_arrays([some.column(0), n, rows], names=["id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>), one row per input row."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(_encoder(model), f"id {kind}, n_tokens long, ids array<int>").withColumnRenamed("id", id_col)


def _decoder(model: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(PieceBpe, model)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(k, SLICE_ROWS)
                rows = some.column(2)
                flat, stops = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy()
                texts = [bpe.decode(flat[a:b]) for a, b in zip(stops, stops[1:])]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return run


def decode_documents(encoded: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """Adds `decoded`, the text of the ids."""
    kind = encoded.schema[id_col].dataType.simpleString()
    slim = encoded.select(encoded[id_col].alias("id"), "n_tokens", F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    return slim.mapInArrow(_decoder(model), f"id {kind}, n_tokens long, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame) -> DataFrame:
    ids = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return decoded.select("doc_id", "n_tokens", F.sha2(ids.cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
