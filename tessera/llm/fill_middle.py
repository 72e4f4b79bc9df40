"""Fill-in-the-middle transformation over an indexable skip list of tokens.

A text is cut into tokens (white space with the word after it; trailing white
space is one of its own). The tokens are the nodes of a skip list: every
node is on the base lane, and a share of each lane's nodes, chosen by a hash of
their rank, also on the express lane above. A link carries its width in tokens
and in code points. A cut rank is reached by descending: on each lane links
are followed while their token widths fit into what is left of the rank, and
the code-point widths add up to the exact place of the cut.

A document is transformed or left plain, and cut, by numbers from a hash of
the seed and its id, so a repeated run and a recomputed task agree. The
sentinels must not be able to overlap one another; a text that holds one stays
plain, and so every output can be turned back exactly.

Defined results: null text counts as empty, is plain and gives ''; a null id
hashes as the text `null`; repeated rows pass through, a row each; other
columns are not read, so clashing names do no harm; an empty table gives no
rows."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SEED = 42
RATE = 50
SPM_RATE = 80
SENTINELS = ("<P>", "<S>", "<M>")
LANE_SHARE = 4
SLICE_ROWS = 256


def token_ends(text: str) -> np.ndarray:
    """The code point after each token `[\\x20\\x09-\\x0D]*[^\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+`."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    blank = (points == 32) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    return np.append(ends, len(points))  # the last token ends with the text, blank or not


def _draws(ranks: np.ndarray) -> np.ndarray:
    """An even draw for each rank, the same in every run."""
    x = (ranks.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(31))


class SkipList:
    """Nodes in rank order with express lanes; `units` and `points` are the widths of a lane's links."""

    def __init__(self, widths: np.ndarray, share: int = LANE_SHARE) -> None:
        self.size = len(widths)
        ranks = np.arange(self.size, dtype=np.int64)
        at = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
        #: Per lane, base first: widths of its links and, of each node, the place on the lane below.
        self.lanes: list[tuple[list[int] | np.ndarray, np.ndarray, np.ndarray]] = []
        below, draws = ranks, _draws(ranks)
        while True:
            stops = np.append(ranks, self.size)
            self.lanes.append((np.diff(stops), np.diff(at[stops]), below))
            if len(ranks) <= share:
                return
            digit, draws = draws % np.uint64(share), draws // np.uint64(share)
            up = digit == 0
            up[0] = True  # every lane starts at the head
            below = np.flatnonzero(up)
            if len(below) == len(ranks):
                return
            ranks, draws = ranks[below], draws[below]

    def seek(self, rank: int) -> int:
        """Code points before the node of this rank; the whole width for rank `size`."""
        if not 0 <= rank <= self.size:
            raise IndexError(rank)
        left, passed, node = rank, 0, 0
        for lane in range(len(self.lanes) - 1, -1, -1):
            units, points, below = self.lanes[lane]
            while node < len(units) and units[node] <= left:
                left -= int(units[node])
                passed += int(points[node])
                node += 1
            if node == len(units):  # past the last node: the rank is `size`
                return passed
            node = int(below[node])
        return passed


def _check(sentinels: Sequence[str]) -> None:
    for a in sentinels:
        for b in sentinels:
            for k in range(1, min(len(a), len(b)) + (a != b)):
                if a[-k:] == b[:k]:
                    raise ValueError(f"sentinels {a!r} and {b!r} can overlap")
            if not a or (a != b and a in b):
                raise ValueError("sentinels must be distinct and not empty, none inside another")
    if len(set(sentinels)) != 3:
        raise ValueError("three distinct sentinels are needed")


def cut(text: str, doc_id: object, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: Sequence[str] = SENTINELS) -> tuple[int, str, int | None, int | None, str]:
    """(n, form, prefix_chars, middle_chars, output) of one text."""
    ends = token_ends(text)
    n = len(ends)
    digest = hashlib.sha256(f"{seed}:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    if n == 0 or h3 % 100 >= rate or any(s in text for s in sentinels):
        return n, "plain", None, None, text
    nodes = SkipList(np.diff(ends, prepend=0))
    a, b = sorted(nodes.seek(h % (n + 1)) for h in (h1, h2))
    p, s, m = sentinels
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < spm_rate:
        return n, "spm", a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def restore(output: str, form: str, sentinels: Sequence[str] = SENTINELS) -> str:
    """The text that `cut` was given."""
    if form == "plain":
        return output
    p, s, m = sentinels
    first, second = (p, s) if form == "psm" else (s, p)
    if not output.startswith(first):
        raise ValueError(f"not an output of form {form}")
    one, rest = output[len(first) :].split(second, 1)
    two, middle = rest.split(m, 1)
    prefix, suffix = (one, two) if form == "psm" else (two, one)
    return prefix + middle + suffix


def _transformer(seed: int, rate: int, spm_rate: int, sentinels: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(k, SLICE_ROWS)
                rows = [cut(t.as_py() or "", i.as_py(), seed, rate, spm_rate, sentinels) for i, t in zip(some.column(1), some.column(2))]
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                yield pa.RecordBatch.from_arrays([some.column(0), *(pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds))], names=["id", "n", "form", "prefix_chars", "middle_chars", "output"])

    return run


def transform_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """(id, n, form, prefix_chars, middle_chars, output), one row per input row.
    `rate` and `spm_rate` are percentages: of documents cut, and of those in the form spm."""
    _check(sentinels)
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[id_col].cast("string").alias("name"), docs[text_col].alias("text"))
    made = slim.mapInArrow(_transformer(seed, rate, spm_rate, tuple(sentinels)), f"id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")
    return made.withColumnRenamed("id", id_col)


def _restorer(sentinels: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            for k in range(0, batch.num_rows, SLICE_ROWS):
                some = batch.slice(k, SLICE_ROWS)
                texts = [restore(o.as_py(), f.as_py(), sentinels) for o, f in zip(some.column(names.index("output")), some.column(names.index("form")))]
                yield pa.RecordBatch.from_arrays([*some.columns, pa.array(texts, pa.string())], names=[*names, "restored"])

    return run


def restore_documents(made: DataFrame, sentinels: Sequence[str] = SENTINELS) -> DataFrame:
    """Adds `restored`, the text rebuilt from `output` and `form`."""
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in made.schema.fields)
    return made.mapInArrow(_restorer(tuple(sentinels)), f"{fields}, restored string")


def digests(restored: DataFrame) -> DataFrame:
    sha = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(f"{c}_sha256")
    return restored.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha("output"), sha("restored"))
