"""Token counts with overlap resynchronisation.

A document of up to `chunk_chars` characters is encoded in one go. A longer
one is encoded in chunks that overlap, each with the offsets of its tokens.
Two chunks are spliced at a stable common boundary: a white space character
(no piece of this vocabulary spans one, so a boundary there holds in any
context) such that both chunks give the same tokens at the same offsets from
there up to the next such boundary. Without one the overlap is doubled; at
worst both chunks become one. Memory is that of two chunks, and the count is
exactly that of the whole text.

Defined results: null text counts as empty (0 bytes, 0 tokens); null ids and
repeated rows pass through, one output row per input row; other columns are
not read, so clashing names do no harm; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .wordbpe import WordBpe, load_tokenizer, loaded

CHUNK_CHARS = 32_768
OVERLAP_CHARS = 256
TOKEN_LIMIT = 2048
_BLANK = frozenset("\t\n\x0b\x0c\r ")


class Chunk:
    """Tokens of text[start:stop] with offsets in the whole text."""

    def __init__(self, library, text: str, start: int, stop: int) -> None:
        got = library.encode(text[start:stop], add_special_tokens=False)
        self.start, self.stop = start, stop
        self.ids = np.array(got.ids, "<u4")
        self.offsets = np.array(got.offsets, "i8").reshape(-1, 2) + start

    def between(self, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        keep = (self.offsets[:, 0] >= a) & (self.offsets[:, 1] <= b)
        return self.ids[keep], self.offsets[keep]

    def cuts(self, at: int) -> bool:
        return bool(((self.offsets[:, 0] < at) & (self.offsets[:, 1] > at)).any())


def splice_point(text: str, a: Chunk, b: Chunk) -> int | None:
    """The first proven boundary in the overlap from which both chunks agree up to the last one."""
    blanks = [i for i in range(b.start, a.stop) if text[i] in _BLANK]
    if len(blanks) < 2:
        return None
    last = blanks[-1]
    for p in blanks:
        if p >= last:
            return None
        if a.cuts(p) or b.cuts(p):
            continue
        (ids_a, at_a), (ids_b, at_b) = a.between(p, last), b.between(p, last)
        if len(ids_a) and np.array_equal(ids_a, ids_b) and np.array_equal(at_a, at_b):
            return p
    return None


def encode_long(library, text: str, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[np.ndarray, int, int]:
    """Ids of the whole text, the number of chunks, and how often an overlap was widened."""
    done: list[np.ndarray] = []
    a = Chunk(library, text, 0, min(len(text), chunk_chars))
    kept_from, chunks, widened = 0, 1, 0
    while a.stop < len(text):
        wide = overlap
        while True:
            start = max(kept_from, a.stop - wide)
            if start <= kept_from:  # no boundary in all of it: one chunk
                a = Chunk(library, text, kept_from, min(len(text), a.stop + chunk_chars))
                break
            b = Chunk(library, text, start, min(len(text), a.stop + chunk_chars))
            at = splice_point(text, a, b)
            if at is not None:
                done.append(a.ids[(a.offsets[:, 0] >= kept_from) & (a.offsets[:, 1] <= at)])
                a, kept_from, chunks = b, at, chunks + 1
                break
            wide, widened = wide * 2, widened + 1
    done.append(a.ids[a.offsets[:, 0] >= kept_from])
    return np.concatenate(done), chunks, widened


def _counter(vocab: str, chunk_chars: int, overlap: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        short = loaded(WordBpe, vocab)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                text = text.as_py() or ""
                if len(text) <= chunk_chars:
                    rows.append((len(short.encode(text)) // 4, 1, 0))
                else:
                    ids, chunks, widened = encode_long(short.library, text, chunk_chars, overlap)
                    rows.append((len(ids), chunks, widened))
            n, chunks, widened = (pa.array([r[k] for r in rows], t) for k, t in ((0, pa.int64()), (1, pa.int32()), (2, pa.int32())))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), n, chunks, widened], names=[batch.schema.names[0], "n_bytes", "n_tokens", "n_chunks", "n_widened"])

    return run


def token_counts(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", limit: int = TOKEN_LIMIT, chunk_chars: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> DataFrame:
    """(id, n_bytes, n_tokens, n_chunks, n_widened, over_limit), one row per input row."""
    if not 0 < overlap < chunk_chars:
        raise ValueError("overlap must lie between 0 and chunk_chars")
    kind = docs.schema[id_col].dataType.simpleString()
    text = F.coalesce(docs[text_col], F.lit(""))
    slim = docs.select(docs[id_col].alias("id"), text.alias("text"), F.octet_length(text).cast("long").alias("n_bytes"))
    counted = slim.mapInArrow(_counter(vocab, chunk_chars, overlap), f"id {kind}, n_bytes long, n_tokens long, n_chunks int, n_widened int")
    return counted.withColumnRenamed("id", id_col).withColumn("over_limit", F.col("n_tokens") > limit)


__all__ = ["encode_long", "load_tokenizer", "token_counts"]
