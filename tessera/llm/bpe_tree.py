"""BPE encoding by tree concatenation, and decoding.

A text longer than `leaf_chars` is halved until its parts are short; the
parts are encoded by threads, then joined pairwise. Around a join a window is
re-encoded and compared with the tokens on both sides; it grows until both
sides agree exactly, which is proven in one of two ways:

* an anchor on each side: a position before ASCII white space and after a
  printable ASCII character always separates pieces, so tokens up to a left
  anchor and from a right anchor on are final, and those between come from
  the window. Window and side must give the same tokens between the two
  outermost anchors of a side;
* inside one unsplit run of ASCII letters, digits or symbols: a token row
  whose neighbouring pairs are all valid is the encoding of its run, so it is
  enough that the window's first token is the left side's and its last token
  the right side's.

A window that covers both parts is their encoding anyway.

Defined results: null text counts as empty and decodes to ''; null ids and
repeated rows pass through, a row each; other columns are not read; an empty
table gives no rows. Special strings inside texts become their special ids,
as the library does by default."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbpe import ByteBpe, loaded

LEAF_CHARS = 16_384
WINDOW_BYTES = 64
THREADS = 2
_ANCHOR = re.compile(rb"(?<=[!-~])(?=[\t-\r ])")
_RUN = re.compile(rb"[A-Za-z]+|[0-9]+|[!-/:-@\[-`{-~]+")


def _spots(lengths: np.ndarray, start: int) -> np.ndarray:
    """Start of each token, and the end of the last."""
    return start + np.concatenate([[0], np.cumsum(lengths)])


def _outward(data: bytes, at: int, step: int, low: int, high: int) -> int:
    while low < at < high and data[at] & 0xC0 == 0x80:  # inside a character
        at += step
    return at


def join(bpe: ByteBpe, data: bytes, low: int, mid: int, high: int, left: np.ndarray, right: np.ndarray, window: int = WINDOW_BYTES) -> np.ndarray:
    """Ids of data[low:high] from those of data[low:mid] and data[mid:high]."""
    at_left = _spots(bpe.length_of[left], low)
    at_right = _spots(bpe.length_of[right], mid)
    special = tuple(s.encode() for s in bpe.special)
    while True:
        a, b = max(low, mid - window), min(high, mid + window)
        a = int(at_left[np.searchsorted(at_left, a, "right") - 1])
        b = int(at_right[np.searchsorted(at_right, b, "left")])
        whole_a, whole_b = _outward(data, a, -1, low, mid), _outward(data, b, 1, mid, high)
        if whole_a != a and whole_a != low or whole_b != b and whole_b != high:
            window += 4
            if whole_a > low or whole_b < high:
                continue
        a, b = whole_a, whole_b
        if a <= low and b >= high:
            return bpe.leaf(data[low:high].decode())
        seen = bpe.leaf(data[a:b].decode())
        at_seen = _spots(bpe.length_of[seen], a)
        marks = [m.start() + a for m in _ANCHOR.finditer(data[a:b]) if m.start()]
        lefts, rights = ([low] if a == low else []) + [m for m in marks if m < mid], [m for m in marks if m > mid] + ([high] if b == high else [])

        def part(ids: np.ndarray, at: np.ndarray, p: int, q: int) -> np.ndarray | None:
            i, j = np.searchsorted(at, (p, q))
            return ids[i:j] if i < len(at) and j < len(at) and at[i] == p and at[j] == q else None

        def same(ids: np.ndarray, at: np.ndarray, marks: list[int]) -> bool:
            if len(marks) < 2:
                return False
            x, y = part(ids, at, marks[0], marks[-1]), part(seen, at_seen, marks[0], marks[-1])
            return x is not None and y is not None and len(x) > 0 and np.array_equal(x, y)

        agreed_left = (a == low and bool(lefts)) or same(left, at_left, lefts)
        agreed_right = (b == high and bool(rights)) or same(right, at_right, rights)
        if agreed_left and agreed_right:
            p, q = lefts[0], rights[-1]
            middle = part(seen, at_seen, p, q)
            if middle is not None:
                return np.concatenate([left[: np.searchsorted(at_left, p)], middle, right[np.searchsorted(at_right, q) :]])
        if a - 3 >= low and b < high and len(seen) > 1 and _RUN.fullmatch(data, a - 3, b + 1) and not any(s in data[max(low, a - 64) : b + 64] for s in special):
            i, j = int(np.searchsorted(at_left, a)), int(np.searchsorted(at_right, b))
            if at_left[i] == a and at_right[j] == b and i < len(left) and j > 0 and left[i] == seen[0] and right[j - 1] == seen[-1] and a + bpe.length_of[seen[0]] <= mid <= b - bpe.length_of[seen[-1]]:
                return np.concatenate([left[:i], seen, right[j:]])
        window *= 2


def encode(bpe: ByteBpe, text: str | None, leaf_chars: int = LEAF_CHARS, window: int = WINDOW_BYTES, threads: int = THREADS) -> np.ndarray:
    """Ids of the whole text."""
    if not text:
        return np.zeros(0, "<u4")
    if len(text) <= leaf_chars:
        return bpe.leaf(text)
    cuts, parts = [0], [text]
    while len(parts[0]) > leaf_chars:  # halves of halves, all of one depth
        parts = [h for p in parts for h in (p[: len(p) // 2], p[len(p) // 2 :])]
    data = text.encode()
    with ThreadPoolExecutor(threads) as pool:
        rows = list(pool.map(bpe.leaf, parts))
    for p in parts:
        cuts.append(cuts[-1] + len(p.encode()))
    while len(rows) > 1:
        rows = [join(bpe, data, cuts[i], cuts[i + 1], cuts[i + 2], rows[i], rows[i + 1], window) for i in range(0, len(rows), 2)]
        cuts = cuts[::2]
    return rows[0]


def _encoder(vocab: str, leaf_chars: int, window: int, threads: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBpe, vocab)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                ids = [encode(bpe, t.as_py(), leaf_chars, window, threads) for t in some.column(1)]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], names=["id", "n_tokens", "ids"])

    return run


def encode_documents(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", leaf_chars: int = LEAF_CHARS, window: int = WINDOW_BYTES, threads: int = THREADS) -> DataFrame:
    """(id, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return slim.mapInArrow(_encoder(vocab, leaf_chars, window, threads), f"id {kind}, n_tokens long, ids binary").withColumnRenamed("id", id_col)


def _decoder(vocab: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(ByteBpe, vocab)
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                some = batch.slice(k, 256)
                texts = [bpe.decode(np.frombuffer(x.as_py() or b"", "<u4")) for x in some.column(2)]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=["id", "n_tokens", "ids", "decoded"])

    return run


def decode_documents(encoded: DataFrame, vocab: str, id_col: str = "doc_id") -> DataFrame:
    """Adds `decoded`, the text of the packed ids, special ids as their strings."""
    kind = encoded.schema[id_col].dataType.simpleString()
    slim = encoded.select(encoded[id_col].alias("id"), "n_tokens", "ids")
    return slim.mapInArrow(_decoder(vocab), f"id {kind}, n_tokens long, ids binary, decoded string").withColumnRenamed("id", id_col)


def digests(decoded: DataFrame) -> DataFrame:
    return decoded.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
