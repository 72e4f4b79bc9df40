"""Alignment of the tokens of a byte-level BPE (A) and a SentencePiece BPE (B).

Both encode the same bytes: a space and the text. The ends of the tokens of a
block of documents, as offsets in the block's bytes, are two sorted lists. The
shorter drives: each of its ends gallops through the longer one from the place
of an end before it, in steps that double, then by binary search (ends at wide
strides first, those between from theirs, a stride at a time in lock step).
Common ends cut the tokens into groups. The rank found for a token's start and
the one for its end give the range of tokens of the other side that it overlaps; their
differences are the numbers of its links.

Counting links over the corpus: tasks number the distinct id pairs of a block
by their frequency in it and keep the links as those numbers, so only the
distinct pairs of each block are shuffled: added up by pair, compared with the
highest count of their B id (a table of one row per B id at most, and so
broadcast), and sent back to their block, where the links look theirs up. A
block holds `BLOCK_CHARS` characters or one longer document. The encoded
blocks are written to the shared folder first.

Defined results: a document without tokens (text null, empty, or not the bytes
of both sides, as where it holds U+2581) has zeros and an empty string; null
ids and repeated rows pass through, a row each; other columns are not
read; an empty table gives no rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .piece_bpe import PieceBpe
from .wordbpe import NOT_PLAIN, ByteBpe, loaded

BLOCK_CHARS = 1 << 21
STRIDES = (4096, 64, 8, 1)
#: A pair of ids is one integer: the A id above these bits, the B id in them.
B_BITS = 15


def gallop(driver: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Per element of the sorted `driver`, the index of the first element of the sorted `target` not below it. The last of `target` is not below any."""
    found = np.zeros(len(driver), np.int64)
    for k, stride in enumerate(STRIDES):
        at = np.arange(0, len(driver), stride)
        low = found[at // STRIDES[k - 1] * STRIDES[k - 1]] if k else np.zeros(len(at), np.int64)
        wanted, high = driver[at], low.copy()
        live, step = np.flatnonzero(target[high] < wanted), 1
        while len(live):  # steps that double, until not below
            low[live] = high[live] + 1
            high[live] = np.minimum(high[live] + step, len(target) - 1)
            live, step = live[target[high[live]] < wanted[live]], step * 2
        live = np.flatnonzero(low < high)
        while len(live):
            mid = (low[live] + high[live]) >> 1
            below = target[mid] < wanted[live]
            low[live[below]] = mid[below] + 1
            high[live[~below]] = mid[~below]
            live = live[low[live] < high[live]]
        found[at] = low
    return found


class Block:
    """Alignment of the tokens of some documents: ids of both sides, one after another, and each document's number of them."""

    def __init__(self, a: np.ndarray, b: np.ndarray, widths_a: np.ndarray, widths_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> None:
        ends_a, ends_b = np.cumsum(widths_a), np.cumsum(widths_b)
        a_drives = len(a) <= len(b)
        driver, target = (ends_a, ends_b) if a_drives else (ends_b, ends_a)
        place = gallop(driver, target)
        same = target[place] == driver if len(driver) else np.zeros(0, bool)
        mine, other = np.flatnonzero(same), place[same]
        self.last_a, self.last_b = (mine, other) if a_drives else (other, mine)
        # A token overlaps from the rank of its start (ends at or before it) to that of its end.
        start = np.zeros(len(driver), np.int64)
        start[1:] = place[:-1] + same[:-1]
        count = place - start + 1
        driving = np.repeat(np.arange(len(driver)), count)
        driven = np.arange(len(driving)) - np.repeat(np.cumsum(count) - count, count) + np.repeat(start, count)
        i, j = (driving, driven) if a_drives else (driven, driving)
        self.links = (a[i].astype(np.int32) << B_BITS) | b[j].astype(np.int32)
        self.n_a, self.n_b = n_a, n_b
        self.stop_a, self.stop_b = np.cumsum(n_a), np.cumsum(n_b)
        self.n_groups = np.diff(np.searchsorted(self.last_a, self.stop_a), prepend=0)
        self.n_links = n_a + n_b - self.n_groups  # every end but the common ones starts one more link
        self.a, self.b = a, b

    def texts(self, words: list[str], n_ids_a: int) -> list[str]:
        """Per document `a1,a2|b1;a3|b2,b3`: the groups in order."""
        end_a, end_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        end_a[self.last_a] = 1
        end_b[self.last_b] = 1
        before_a = np.concatenate([[0], self.last_b + 1])  # B tokens in the groups before a group
        out = np.zeros(len(self.a) + len(self.b), np.int64)
        out[np.arange(len(self.a)) + before_a[np.cumsum(end_a) - end_a]] = self.a * 2 + end_a
        out[np.arange(len(self.b)) + (self.last_a + 1)[np.cumsum(end_b) - end_b]] = (self.b + n_ids_a) * 2 + end_b
        stops = (self.stop_a + self.stop_b).tolist()
        return ["".join(map(words.__getitem__, out[p:q].tolist()))[:-1] for p, q in zip([0, *stops], stops)]


class Aligner:
    """Both vocabularies, and the written forms of their ids."""

    def __init__(self, paths: tuple[str, str]) -> None:
        self.A, self.B = loaded(ByteBpe, paths[0]), loaded(PieceBpe, paths[1])
        self.A.library.encode_special_tokens = True
        n_a, n_b = len(self.A.bytes_of), len(self.B.bytes_of)
        if n_b > 1 << B_BITS or n_a >= 1 << (31 - B_BITS):
            raise ValueError("a pair of ids does not fit into 31 bits")
        self.n_ids_a = n_a
        self.words = [f"{i}{e}" for i in range(n_a) for e in ",|"] + [f"{i}{e}" for i in range(n_b) for e in ",;"]

    def a_ids(self, text: str) -> np.ndarray:
        if NOT_PLAIN.search(text):
            return np.array(self.A.library.encode(text, add_special_tokens=False).ids, np.int64)
        return self.A.fast.encode_to_numpy(text, disallowed_special=()).astype(np.int64)

    def block(self, texts: list[str]) -> Block:
        none = np.zeros(0, np.int64)
        rows_b = [x.astype(np.int64) for x in self.B.encode_many(texts)]
        rows_a = [self.a_ids(" " + t) if t else none for t in texts]
        for k, t in enumerate(texts):
            whole = b" " + t.encode()
            if t and any(b"".join(map(side.bytes_of.__getitem__, ids.tolist())) != whole for side, ids in ((self.A, rows_a[k]), (self.B, rows_b[k]))):
                rows_a[k] = rows_b[k] = none
        a, b = (np.concatenate([none, *rows]) for rows in (rows_a, rows_b))
        count = lambda rows: np.array([len(x) for x in rows], np.int64)
        return Block(a, b, self.A.length_of[a], self.B.length_of[b], count(rows_a), count(rows_b))


_ALIGNED = "block long, id {id}, n_a long, n_b long, n_groups long, n_links long, groups string, links binary, pairs array<int>, times array<long>"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about BLOCK_CHARS characters."""
    ids, texts, size = [], [], 0
    for batch in batches:
        for i, t in zip(batch.column(0), batch.column(1)):
            t = t.as_py() or ""
            if texts and size + len(t) > BLOCK_CHARS:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield ids, texts


def _align(paths: tuple[str, str], hashed: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = loaded(Aligner, paths)
        part = TaskContext.get().partitionId()
        for k, (ids, texts) in enumerate(_blocks(batches)):
            got = aligner.block(texts)
            groups = got.texts(aligner.words, aligner.n_ids_a)
            if hashed:
                groups = [hashlib.sha256(g.encode()).hexdigest() if g else "" for g in groups]
            pairs, number, times = np.unique(got.links, return_inverse=True, return_counts=True)
            order = np.argsort(-times, kind="stable")
            place = np.empty(len(order), "<u4")
            place[order] = np.arange(len(order))
            numbers, stops = place[number], np.cumsum(got.n_links).tolist()
            links = [numbers[p:q].tobytes() for p, q in zip([0, *stops], stops)]
            rest = [None] * (len(ids) - 1)  # the block's first row carries its pairs
            longs = lambda x: pa.array(x, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [longs(np.full(len(ids), part << 32 | k)), pa.array([i.as_py() for i in ids], ids[0].type), longs(got.n_a), longs(got.n_b), longs(got.n_groups), longs(got.n_links), pa.array(groups, pa.string()), pa.array(links, pa.binary()), pa.array([pairs[order], *rest], pa.list_(pa.int32())), pa.array([times[order], *rest], pa.list_(pa.int64()))],
                names=["block", "id", "n_a", "n_b", "n_groups", "n_links", "groups", "links", "pairs", "times"],
            )

    return run


def aligned_blocks(docs: DataFrame, byte_vocab: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """One row per document: (block, id, n_a, n_b, n_groups, n_links, groups, links), written to
    the shared folder. `groups` is the text of the groups or, if `hashed`, the SHA-256 of it; `links` packs
    numbers into the distinct pairs of the block, which stand with their `times` in its first row."""
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return stored(slim.mapInArrow(_align((byte_vocab, piece_model), hashed), _ALIGNED.format(id=kind)), "aligned")


def block_pairs(blocks: DataFrame) -> DataFrame:
    """(block, number, pair, times)."""
    return blocks.where("pairs IS NOT NULL").select("block", F.posexplode(F.arrays_zip("pairs", "times")).alias("number", "p")).select("block", "number", F.col("p.pairs").alias("pair"), F.col("p.times").alias("times"))


def pair_counts(blocks: DataFrame) -> DataFrame:
    """(pair, a_id, b_id, links, best): links of each id pair over the corpus, and whether no other pair of its B id has more."""
    counts = stored(block_pairs(blocks).groupBy("pair").agg(F.sum("times").alias("links")), "pair_counts")
    b_id = F.col("pair").bitwiseAND((1 << B_BITS) - 1)
    most = counts.groupBy(b_id.alias("b_id")).agg(F.max("links").alias("most"))  # at most a row per id of B
    named = counts.select("pair", F.shiftright("pair", B_BITS).alias("a_id"), b_id.alias("b_id"), "links")
    return named.join(F.broadcast(most), "b_id").select("pair", "a_id", "b_id", "links", (F.col("links") == F.col("most")).alias("best"))


def _scores(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Links of the documents of one block, looked up in its pairs."""
    size = pairs.num_rows
    links, best = np.zeros(size, np.int64), np.zeros(size, np.int64)
    number = pairs.column("number").to_numpy()
    links[number] = pairs.column("links").to_numpy()
    best[number] = pairs.column("best").to_numpy(zero_copy_only=False)
    held = [np.frombuffer(x.as_py(), "<u4") for x in docs.column("links")]
    columns = [docs.column(c) for c in ("id", "n_a", "n_b", "n_groups", "n_links")]
    sums = [pa.array([int(table[x].sum()) for x in held], pa.int64()) for table in (best, links)]
    return pa.table([*columns, *sums, docs.column("groups")], names=["id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups"])


def align_documents(docs: DataFrame, byte_vocab: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", hashed: bool = False) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups), one row per input row."""
    blocks = aligned_blocks(docs, byte_vocab, piece_model, id_col, text_col, hashed)
    back = block_pairs(blocks).select("block", "number", "pair").join(pair_counts(blocks).select("pair", "links", "best"), "pair").select(F.col("block").alias("home"), "number", "links", "best")
    kind = docs.schema[id_col].dataType.simpleString()
    scored = blocks.drop("pairs", "times").groupBy("block").cogroup(back.groupBy("home")).applyInArrow(_scores, f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups string")
    return scored.withColumnRenamed("id", id_col)


def digests(aligned: DataFrame) -> DataFrame:
    """Of `align_documents(hashed=True)`."""
    return aligned.withColumnRenamed("groups", "groups_sha256")
