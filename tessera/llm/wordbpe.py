"""Encoding with the two BPE vocabularies of the `tokenizers` library.

The library itself encodes about 1 MB a second. Both vocabularies split a text
before merging, so short pieces can be merged one by one and remembered. The
short cut is taken only for "plain" characters (ASCII and Latin-1 letters),
whose classes, case mapping and normal form are the same in every Unicode
version; anything else goes to the library."""

from __future__ import annotations

import json
import re

import numpy as np

#: Characters outside this set are left to the library.
NOT_PLAIN = re.compile("[^\t-\r -~À-ÖØ-öø-ÿ]")
ASCII_WS = re.compile("[\t-\r ]+")
#: The split patterns of the two vocabularies.
WORD_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+")
BYTE_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_END = "</w>"


def byte_symbols() -> dict[str, int]:
    """Byte-level BPE writes each byte as one printable character: itself if
    printable, else the next unused code point from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


def load_tokenizer(path: str):
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark hands out the cores
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class WordBpe:
    """Ids of a vocabulary whose words end in `</w>`, texts lower-cased, white
    space dropped. White space always separates pieces, so the ids of a text
    are those of its words in turn; words seen before come from a cache of
    bounded size (two generations of `cache` words)."""

    def __init__(self, path: str, cache: int = 250_000) -> None:
        import tiktoken

        self.library = load_tokenizer(path)
        model = json.load(open(path, encoding="utf-8"))["model"]
        vocab, symbols = model["vocab"], byte_symbols()
        by_byte = {b: c for c, b in symbols.items()}
        # The word end is a byte that no text has; joining it to the last byte comes first.
        ranks = {bytes([b]): b for b in range(256)}
        ids = [vocab.get(by_byte[b], 0) for b in range(256)]
        for b in range(255):
            ranks[bytes([b, 255])] = len(ranks)
            ids.append(vocab.get(by_byte[b] + WORD_END, 0))

        def raw(token: str) -> bytes:
            end = token.endswith(WORD_END)
            body = token[: -len(WORD_END)] if end else token
            return bytes(symbols[c] for c in body) + (b"\xff" if end else b"")

        for merge in model["merges"]:
            left, right = merge if not isinstance(merge, str) else merge.split(" ")
            ranks.setdefault(raw(left) + raw(right), len(ranks))
            ids.append(vocab[left + right])
        self.piece = tiktoken.Encoding("words", pat_str=r"(?s).+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.ids = [np.array([i], "<u4").tobytes() for i in ids]
        self.cache, self.young, self.old = cache, {}, {}

    def word(self, word: str) -> bytes:
        found = self.old.get(word)
        if found is None:
            if "<|" in word or NOT_PLAIN.search(word):
                found = np.array(self.library.encode(word, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                found = self.merged(word.lower())
        return self.kept(word, found)

    def plain(self, word: str) -> bytes:
        """`word` of a lower-case word known to be plain."""
        found = self.old.get(word)
        return self.kept(word, self.merged(word) if found is None else found)

    def merged(self, word: str) -> bytes:
        pieces = (word,) if word.isalpha() else WORD_SPLIT.findall(word)
        return b"".join([self.ids[k] for p in pieces for k in self.piece(p.encode() + b"\xff")])

    def kept(self, word: str, found: bytes) -> bytes:
        if len(word) <= 64:
            if len(self.young) >= self.cache:
                self.young, self.old = {}, self.young
            self.young[word] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        plain = NOT_PLAIN.search(text) is None and "<|" not in text
        found = text.lower().split() if plain else [w for w in ASCII_WS.split(text) if w]
        parts = list(map(self.young.get, found))
        if None in parts:
            new = self.plain if plain else self.word
            parts = [new(w) if p is None else p for w, p in zip(found, parts)]
        return b"".join(parts)


class ByteBpe:
    """Byte-level BPE ids of a text, and their bytes again."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.library = load_tokenizer(path)
        spec = json.load(open(path, encoding="utf-8"))
        symbols, vocab = byte_symbols(), spec["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(symbols[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        self.bytes_of = [b""] * (max(*vocab.values(), *self.special.values(), 0) + 1)
        for t, i in ranks.items():
            self.bytes_of[i] = t
        for t, i in self.special.items():
            self.bytes_of[i] = t.encode()
        self.length_of = np.array([len(t) for t in self.bytes_of], "i8")
        self.fast = tiktoken.Encoding("bytes", pat_str=BYTE_SPLIT, mergeable_ranks=ranks, special_tokens={})

    def leaf(self, text: str) -> np.ndarray:
        if NOT_PLAIN.search(text) or any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist())).decode("utf-8", "replace")


_LOADED: dict = {}


def loaded(kind: type, path: str):
    """One instance per Python worker and file."""
    if (kind, path) not in _LOADED:
        _LOADED[kind, path] = kind(path)
    return _LOADED[kind, path]
