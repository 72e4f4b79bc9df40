"""N-gram Jaccard join by universe partition.

Two documents link when their sets of word shingles have Jaccard similarity
`num`/`den` or more, that is, when they differ in at most
(|x| + |y|) (den - num) / (den + num) shingles. Sizes fall into bands; a pair belongs to
the band of its smaller set. In a band the universe of shingles is dealt by
hash into `m` segments, and the part of a set in a segment is one signature.

Pigeonhole: sets that differ in at most H shingles differ in at most H
segments. Put the signatures of both in one order (cost first, see below);
then the first H + 1 of each hold a common one, so only those are indexed,
never empty segments. Small sets take one segment for each shingle.

Allocation: a set may fill fewer than H + 1 segments. The largest shortfall D
of a band is found first, over all sets. The first D segments of that band
then allow one difference: they are indexed in full and with each one
shingle deleted, empty ones too. Such a segment uses up two differences, so
H + 1 - 2 D of the others suffice, which every set has. Segments that hold
only frequent shingles (heavy hitters of the input) come last in the order.
Frequent ones are a cost estimate only: any list gives the same links.

Sets are compared once for all documents that have them. Signatures are
scanned in sorted order; a signature shared by many sets links each to the
first and to its neighbour. A profile of each set (parities of its shingles in 2 to
4 buckets a shingle, up to 4096 bytes) bounds the difference of a
pair from below and drops most pairs that only share a passage, before any
set moves. What is left is verified exactly: first each set with the partner it
shares most signatures with. Then, while crowded signatures hold many pairs of
sets of two groups, each set is dealt at a few of its crowded signatures, chosen
alike by sets that share most, into random parts of about `deal` sets, and
verified with its nearest set of another group there, by sketch (the profile
folded to 1024 bits): a large group of near copies grows together in a turn or
two, with a few pairs for each set. Last, every candidate pair, and every pair
sharing a crowded signature, whose ends are still apart is looked at, so no link
is lost: the sets outside a signature's largest group meet all its sets in
cells of `cell` sets a side, where only pairs whose sketches allow a link
become rows, each at the lowest of a few signatures that both have, and these
are verified.

Shingles and sets are named by 64-bit hashes; sizes go with the names of sets.

Defined results: null, empty and blank texts have no shingles and are linked
with nothing; fewer than five words are one shingle; repeated rows give one
row each; a null id gets its group's smallest id, or null; other columns are
not read; an empty table gives no rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from xxhash import xxh3_64_intdigest

from .common import stored

NUM, DEN = 3, 4
SHINGLE = 5
RATIO = 16 / 9  # of a band's largest size to its smallest
TOKEN_LEVEL = 48  # bands up to this size: a segment for each shingle
CROWD = 24
HOT_KEYS = 200_000
DEAL = 8  # sets compared at once when a crowded signature is dealt
HANDS = 3  # crowded signatures of a set that are dealt in one turn
FEW = 16  # lowest crowded signatures of a set, to meet a partner once
NO_SIG = (1 << 63) - 1  # fills these up; where it is a signature, a pair may meet more often
CELL = 4096  # sets of a crowded signature on each side of one comparison
PER_MEMBER = 16  # comparisons left for a member of a crowded signature, on average, when dealing ends
DOCS = 1000  # worked on at once within a task
SKETCH = 1024  # bits of the profile that a crowded signature carries

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_POWERS = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], "u8")


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def salt(band: int) -> np.uint64:
    return np.uint64(band * 0x9E3779B97F4A7C15 % (1 << 64))


def band_edges(ratio: float = RATIO) -> np.ndarray:
    """Smallest size of each band, up to more than any text can have."""
    edges = [1]
    while edges[-1] < 1 << 31:
        edges.append(max(edges[-1] + 1, int(edges[-1] * ratio)))
    return np.array(edges, "i8")


EDGES = band_edges()


def segments(band: int) -> int:
    """Number of segments of a band; 0: one for each shingle."""
    largest = int(EDGES[band + 1]) - 1
    return 0 if largest <= TOKEN_LEVEL else int(0.45 * largest + 3 * largest**0.5)


def budget(size: int, band: int) -> int:
    """H: the most shingles by which a set of this size differs from a partner in this band."""
    largest = int(EDGES[band + 1]) - 1
    other = min(size, largest) if size > largest else size * DEN // NUM
    return (size + other) * (DEN - NUM) // (DEN + NUM)


def bands_of(size: int) -> list[int]:
    """The band of the size, and the one below if smaller partners reach into it."""
    own = int(np.searchsorted(EDGES, size, "right")) - 1
    return [own] + ([own - 1] if own and size * NUM <= (int(EDGES[own]) - 1) * DEN else [])


def distinct(x: np.ndarray) -> np.ndarray:
    """np.unique of hashes, without its overhead on short arrays."""
    x = np.sort(x)
    return x[np.concatenate(([True], x[1:] != x[:-1]))] if len(x) else x


def shingle_set(text: str | None) -> np.ndarray:
    """The sorted set of 64-bit shingle hashes of a text."""
    ws = text.encode().lower().split() if text else []
    if not ws:
        return np.zeros(0, "u8")
    h = mix(np.fromiter(map(xxh3_64_intdigest, ws), "u8", len(ws)))
    k = min(SHINGLE, len(h))
    total = np.full(len(h) - k + 1, k, "u8")
    for i in range(k):
        total += h[i : len(h) - k + 1 + i] * _POWERS[i]
    return distinct(mix(total))


def name_of(s: np.ndarray) -> int:
    """64-bit name of a set."""
    return int(mix(np.array([np.add.reduce(mix(s ^ _M1)), np.uint64(len(s))], "u8")).sum(dtype="u8").view("i8")) if len(s) else 0


def profile(s: np.ndarray) -> bytes:
    """Parities of the shingle counts in 2 to 4 buckets a shingle, by their low
    bits, at least 1024: the sets of two profiles differ in no fewer shingles
    than the profiles in bits."""
    size = 1 << min(15, max(SKETCH.bit_length() - 1, (2 * len(s) - 1).bit_length()))
    odd = np.bincount((s & np.uint64(size - 1)).view("i8"), minlength=size) & 1
    return np.packbits(odd.astype("u1")).tobytes()


def sketch(profile: bytes) -> np.ndarray:
    """A profile folded to 1024 bits, as 64-bit integers."""
    return np.bitwise_xor.reduce(np.frombuffer(profile, "i8").reshape(-1, SKETCH // 64), axis=0)


def _taken(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts and lengths of a binary column without nulls."""
    kind = "i8" if pa.types.is_large_binary(column.type) else "i4"
    at = np.frombuffer(column.buffers()[1], kind)[column.offset : column.offset + len(column) + 1].astype("i8")
    return np.frombuffer(column.buffers()[2], "u1"), at[:-1], np.diff(at)


def least_differences(x: pa.Array, y: pa.Array, cells: int = 1 << 20) -> np.ndarray:
    """For each row, the least difference of two sets with these profiles;
    the longer profile is folded to the length of the shorter one."""
    (xs, at_x, len_x), (ys, at_y, len_y) = _taken(x), _taken(y)
    out = np.zeros(len(x), "i8")
    for p, q in np.unique(np.column_stack([len_x, len_y]), axis=0):
        rows, short = np.flatnonzero((len_x == p) & (len_y == q)), min(p, q)
        step = max(1, cells // max(p, q))
        for k in range(0, len(rows), step):
            r = rows[k : k + step]
            u = np.bitwise_xor.reduce(xs[at_x[r][:, None] + np.arange(p)].reshape(len(r), -1, short), axis=1)
            v = np.bitwise_xor.reduce(ys[at_y[r][:, None] + np.arange(q)].reshape(len(r), -1, short), axis=1)
            out[r] = np.bitwise_count(u ^ v).sum(axis=1, dtype="i8")
    return out


def parts(s: np.ndarray, band: int, m: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order of the shingles by segment, the start of each filled segment, and its number."""
    if m == 0:
        return np.arange(len(s)), np.arange(len(s)), mix(s + _M1)
    seg = mix(s + salt(band)) % np.uint64(m)
    order = np.argsort(seg.astype("u2") if m < 1 << 16 else seg, kind="stable")
    dealt = seg[order]
    starts = np.flatnonzero(np.concatenate(([True], dealt[1:] != dealt[:-1])))
    return order, starts, dealt[starts]


def shortfall(s: np.ndarray, band: int) -> int:
    m = segments(band)
    filled = len(s) if m == 0 else np.count_nonzero(np.bincount((mix(s + salt(band)) % np.uint64(m)).view("i8"), minlength=m))
    return budget(len(s), band) + 1 - filled


def frequent(s: np.ndarray, hot: np.ndarray) -> np.ndarray:
    """Which shingles of a set are in the sorted list."""
    return hot[np.minimum(np.searchsorted(hot, s), len(hot) - 1)] == s if len(hot) else np.zeros(len(s), bool)


def signatures(s: np.ndarray, band: int, spared: int, often: np.ndarray) -> np.ndarray:
    """Signatures by which a set is found in a band; `spared`: segments that
    allow one difference, `often`: its frequent shingles."""
    m = segments(band)
    order, starts, numbers = parts(s, band, m)
    values = mix(s ^ _M1)[order]
    sums = np.add.reduceat(values, starts)
    tag = salt(band)

    def sign(number, total):
        return mix(mix(number * _M1 + tag) + total)

    out = []
    need = budget(len(s), band) + 1 - 2 * spared
    if spared:
        special = numbers < np.uint64(spared)
        empty = np.setdiff1d(np.arange(spared, dtype="u8"), numbers[special])
        out += [sign(numbers[special], sums[special]), sign(empty, np.zeros(len(empty), "u8"))]
        lengths = np.diff(np.append(starts, len(s)))
        each = np.repeat(np.arange(len(starts)), lengths)
        inside = special[each]
        out.append(sign(numbers[each][inside], sums[each][inside] - values[inside]))
        numbers, sums, starts_kept = numbers[~special], sums[~special], ~special
    else:
        starts_kept = np.ones(len(starts), bool)
    if need > 0:
        sigs = sign(numbers, sums)
        # The top bit says that all shingles of the segment are frequent: such signatures come last.
        dear = np.minimum.reduceat(often[order], starts)[starts_kept]
        sigs = (sigs >> np.uint64(1)) | (dear.astype("u8") << np.uint64(63))
        if need < len(sigs):
            sigs = np.partition(sigs, need - 1)[:need]
        out.append(sigs)
    return np.concatenate(out) if out else np.zeros(0, "u8")


def _slices(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, n):
            yield batch.slice(k, n)


_INFO = "kind int, id {id}, n int, name long, band int, short int, band2 int, short2 int, profile binary, sketch array<long>"


def _describe(id_type: pa.DataType) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in _slices(batches, DOCS):
            n, names, info, fresh, shapes, folded = [], [], [], [], [], []
            for text in batch.column(1):
                s = shingle_set(text.as_py())
                names.append(name_of(s))
                n.append(len(s))
                if len(s) and (names[-1], len(s)) not in met:
                    met.add((names[-1], len(s)))
                    fresh.append(s)
                    own = [(b, shortfall(s, b)) for b in bands_of(len(s))]
                    info.append((*own[0], *(own[1] if len(own) > 1 else (None, None))))
                    shapes.append(profile(s))
                    folded.append(sketch(shapes[-1]))
                else:
                    info.append((None,) * 4)
                    shapes.append(None)
                    folded.append(None)
            columns = [pa.array(np.zeros(len(n), "i4")), batch.column(0), pa.array(n, pa.int32()), pa.array(names, pa.int64()), *(pa.array([i[k] for i in info], pa.int32()) for k in range(4)), pa.array(shapes, pa.binary()), pa.array(folded, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=list("abcdefghij"))
            if fresh:
                keys, counts = np.unique(np.concatenate(fresh), return_counts=True)
                often = counts >= max(3, len(fresh) // 200)
                k = int(often.sum())
                none = pa.nulls(k, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(k, "i4")), pa.nulls(k, id_type), pa.array(counts[often].astype("i4")), pa.array(keys[often].view("i8")), none, none, none, none, pa.nulls(k, pa.binary()), pa.nulls(k, pa.list_(pa.int64()))], names=list("abcdefghij"))

    def named(batches):
        for b in run(batches):
            yield b.rename_columns(["kind", "id", "n", "name", "band", "short", "band2", "short2", "profile", "sketch"])

    return named


def _signer(spared: dict[int, int], hot) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = set()
        for batch in _slices(batches, DOCS):
            sigs, names, sizes = [], [], []
            for text in batch.column(0):
                s = shingle_set(text.as_py())
                if not len(s):
                    continue
                key = (name_of(s), len(s))
                if key in met:  # the same set again in this task
                    continue
                met.add(key)
                often = frequent(s, hot.value)
                found = np.concatenate([signatures(s, b, spared.get(b, 0), often) for b in bands_of(len(s))])
                sigs.append(found)
                names.append(np.full(len(found), key[0], "i8"))
                sizes.append(np.full(len(found), key[1], "i4"))
            if sigs:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(sigs).view("i8")), pa.array(np.concatenate(names)), pa.array(np.concatenate(sizes))], names=["sig", "name", "n"])

    return run


class Scan:
    """Pairs of sets with one signature, from rows sorted by (sig, n, name)."""

    def __init__(self, crowd: int) -> None:
        self.crowd, self.rows, self.open = crowd, None, None

    def pairs(self, sig, name, n, end: bool):
        """(a, na, b, nb) arrays, and (sig, name, n) of the members of crowded signatures."""
        if self.rows is not None:
            sig, name, n = (np.concatenate(x) for x in zip(self.rows, (sig, name, n)))
            self.rows = None
        fresh = np.ones(len(sig), bool)
        fresh[1:] = (sig[1:] != sig[:-1]) | (name[1:] != name[:-1]) | (n[1:] != n[:-1])
        sig, name, n = sig[fresh], name[fresh], n[fresh]
        if not len(sig):
            return [], []
        starts = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        lengths = np.diff(np.append(starts, len(sig)))
        pairs, crowds = [], []

        def crowd(a: int, b: int) -> None:
            """Rows a to b of a crowded signature: each with the first and with the one before."""
            if self.open and self.open[0] == sig[a]:
                hub, last = self.open[1], self.open[2]
            else:
                hub = last = (name[a], n[a])
            before_name, before_n = np.concatenate([[last[0]], name[a : b - 1]]), np.concatenate([[last[1]], n[a : b - 1]])
            pairs.append((np.full(b - a, hub[0]), np.full(b - a, hub[1]), name[a:b], n[a:b]))
            pairs.append((before_name, before_n, name[a:b], n[a:b]))
            crowds.append((sig[a:b], name[a:b], n[a:b]))
            self.open = (sig[a], hub, (name[b - 1], n[b - 1]))

        first_open = bool(self.open) and self.open[0] == sig[0]
        big = lengths > self.crowd
        if first_open:
            big[0] = True
        keep_from = len(sig)
        if not end and not big[-1]:  # the last signature may go on in the next batch
            keep_from = starts[-1]
            self.rows = (sig[keep_from:], name[keep_from:], n[keep_from:])
        for k in np.flatnonzero(big):
            crowd(starts[k], starts[k] + lengths[k])
        small = np.repeat(~big, lengths)
        small[keep_from:] = False
        at = np.flatnonzero(small)
        for d in range(1, self.crowd):
            at = at[at + d < keep_from]
            at = at[sig[at] == sig[at + d]]
            if not len(at):
                break
            pairs.append((name[at], n[at], name[at + d], n[at + d]))
        return pairs, crowds


_PAIRS = "kind int, a long, na int, b long, nb int, times long"


def _scanner(crowd: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scan = Scan(crowd)

        def out(pairs, crowds):
            if pairs:
                a, na, b, nb = (np.concatenate(x) for x in zip(*pairs))
                keep = ((a != b) | (na != nb)) & (DEN * np.minimum(na, nb) >= NUM * np.maximum(na, nb))
                a, na, b, nb = a[keep], na[keep], b[keep], nb[keep]
                turn = (na > nb) | ((na == nb) & (a > b))
                a, b, na, nb = np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb)
                if len(a):
                    order = np.lexsort((nb, b, na, a))
                    a, na, b, nb = a[order], na[order], b[order], nb[order]
                    first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (na[1:] != na[:-1]) | (nb[1:] != nb[:-1])]))
                    times = np.diff(np.append(first, len(a)))
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(first), "i4")), *(pa.array(x[first].astype(t)) for x, t in ((a, "i8"), (na, "i4"), (b, "i8"), (nb, "i4"))), pa.array(times.astype("i8"))], names=["kind", "a", "na", "b", "nb", "times"])
            if crowds:
                s, name, n = (np.concatenate(x) for x in zip(*crowds))
                yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(s), "i4")), pa.array(name), pa.array(n.astype("i4")), pa.array(s), pa.array(np.zeros(len(s), "i4")), pa.array(np.ones(len(s), "i8"))], names=["kind", "a", "na", "b", "nb", "times"])

        none = np.zeros(0, "i8"), np.zeros(0, "i8"), np.zeros(0, "i4")
        for batch in batches:
            yield from out(*scan.pairs(*(batch.column(k).to_numpy() for k in range(3)), end=False))
        yield from out(*scan.pairs(*none, end=True))

    return run


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose profiles allow a link."""
    for batch in batches:
        if batch.num_rows:
            sizes = batch.column(1).to_numpy().astype("i8") + batch.column(3).to_numpy()
            near = least_differences(batch.column(5), batch.column(6)) * (DEN + NUM) <= sizes * (DEN - NUM)
            yield pa.RecordBatch.from_arrays(batch.columns[:5], names=["a", "na", "b", "nb", "times"]).filter(pa.array(near))


def likely(pairs: DataFrame, holders: DataFrame) -> DataFrame:
    one = pairs.join(holders.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("profile").alias("x")), ["a", "na"])
    two = one.join(holders.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("profile").alias("y")), ["b", "nb"])
    return two.select("a", "na", "b", "nb", "times", "x", "y").mapInArrow(_likely, "a long, na int, b long, nb int, times long")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    met = set()
    for batch in _slices(batches, DOCS):
        sets = [shingle_set(t.as_py()) for t in batch.column(0)]
        # Rows of one id meet in one task: a repeated row adds nothing.
        sets = [s for s in sets if (key := (name_of(s), len(s))) not in met and not met.add(key)]
        yield pa.RecordBatch.from_arrays([pa.array([name_of(s) for s in sets], pa.int64()), pa.array([len(s) for s in sets], pa.int32()), pa.array([s.tobytes() for s in sets], pa.binary())], names=["name", "n", "items"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        linked = []
        for x, y in zip(batch.column(4), batch.column(5)):
            u, v = np.frombuffer(x.as_buffer(), "u8"), np.frombuffer(y.as_buffer(), "u8")
            both = np.concatenate([u, v])
            both.sort()
            shared = int((both[1:] == both[:-1]).sum())
            linked.append(DEN * shared >= NUM * (len(both) - shared))
        keep = pa.array(linked)
        yield pa.RecordBatch.from_arrays(batch.columns[:4], names=["a", "na", "b", "nb"]).filter(keep)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, na, b, nb) that link."""
    one = pairs.join(sets.select(F.col("name").alias("a"), F.col("n").alias("na"), F.col("items").alias("x")), ["a", "na"])
    two = one.join(sets.select(F.col("name").alias("b"), F.col("n").alias("nb"), F.col("items").alias("y")), ["b", "nb"])
    return two.select("a", "na", "b", "nb", "x", "y").mapInArrow(_verify, "a long, na int, b long, nb int")


def components(links: DataFrame) -> DataFrame:
    """(name, n, root) of every linked set: smallest-label hooking and pointer jumping until nothing changes."""
    node = lambda x, n: F.struct(F.col(x).alias("name"), F.col(n).alias("n"))
    ends = links.select(node("a", "na").alias("u"), node("b", "nb").alias("v"))
    both = stored(ends.unionByName(ends.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "links")
    labels = stored(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("root")), "labels")
    while True:
        near = both.join(labels.select(F.col("u").alias("v"), F.col("root").alias("r")), "v").groupBy("u").agg(F.min("r").alias("r"))
        hooked = stored(labels.join(near, "u").select("u", F.least("root", "r").alias("root"), F.col("root").alias("was")), "hooked")
        jumped = hooked.alias("x").join(hooked.select(F.col("u").alias("root"), F.col("root").alias("next")).alias("y"), "root", "left")
        new = stored(jumped.select("u", F.least("root", "next").alias("root"), "was"), "labels")
        labels = new.select("u", "root")
        if new.where(F.col("root") != F.col("was")).isEmpty():
            return labels.select("u.name", "u.n", "root")


def rooted_ends(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs with `ra` and `rb`, the roots of their ends; a set without links is its own root."""
    of = lambda x, n, r: groups.select(F.col("name").alias(x), F.col("n").alias(n), F.col("root").alias(r))
    far = pairs.join(of("a", "na", "ra"), ["a", "na"], "left").join(of("b", "nb", "rb"), ["b", "nb"], "left")
    own = lambda r, x, n: F.coalesce(r, F.struct(F.col(x).alias("name"), F.col(n).alias("n"))).alias(r)
    return far.select("a", "na", "b", "nb", own("ra", "a", "na"), own("rb", "b", "nb"))


def apart(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs whose ends are not yet in one group."""
    return rooted_ends(pairs, groups).where("ra != rb").select("a", "na", "b", "nb")


def merged(groups: DataFrame, links: DataFrame) -> tuple[DataFrame, int]:
    """Groups after further links, and how many went into another one.
    Only groups are linked, each by the name of its root."""
    ends = rooted_ends(links, groups).select(F.col("ra.name").alias("a"), F.col("ra.n").alias("na"), F.col("rb.name").alias("b"), F.col("rb.n").alias("nb"))
    upper = stored(components(ends.distinct()), "upper")
    above = upper.select(F.struct("name", "n").alias("root"), F.col("root").alias("top"))
    own = groups.join(above, "root", "left").select("name", "n", F.coalesce("top", "root").alias("root"))
    fresh = upper.join(groups.select("name", "n"), ["name", "n"], "left_anti").select("name", "n", "root")
    return stored(own.unionByName(fresh), "groups"), upper.where(F.struct("name", "n") != F.col("root")).count()


_MEMBER = ("name", "n", "rn", "rs", "sketch")


def near_pairs(name: np.ndarray, n: np.ndarray, rn: np.ndarray, rs: np.ndarray, words: np.ndarray, kind: np.ndarray, nearest: bool, cells: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Places (x, y) of sets of two groups whose sizes and sketches allow a link: x of kind 0 or 2,
    y of kind 1 or 2. With `nearest` each x has only its y of the least difference."""
    left, right = np.flatnonzero(kind != 1), np.flatnonzero(kind != 0)
    step, found = max(1, cells // max(1, len(right))), []
    for k in range(0, len(left), step):
        u = left[k : k + step]
        nu, nv = n[u][:, None], n[right]
        x, y = np.nonzero(((rn[u][:, None] != rn[right]) | (rs[u][:, None] != rs[right])) & (DEN * np.minimum(nu, nv) >= NUM * np.maximum(nu, nv)))
        x, y = u[x], right[y]
        for w in (4, words.shape[1]):  # a part of the sketch drops most pairs
            far = np.bitwise_count(words[x, :w] ^ words[y, :w]).sum(axis=1, dtype="i8")
            near = far * (DEN + NUM) <= (n[x] + n[y]) * (DEN - NUM)
            x, y, far = x[near], y[near], far[near]
        if nearest and len(x):
            order = np.lexsort((y, far, x))
            x, y = x[order], y[order]
            first = np.concatenate([[True], x[1:] != x[:-1]])
            x, y = x[first], y[first]
        found.append((x, y))
    return tuple(np.concatenate(z) for z in zip(*found)) if found else (left, left)


def met_before(few: np.ndarray, x: np.ndarray, y: np.ndarray, sig: int, cells: int = 1 << 22) -> np.ndarray:
    """Which pairs share a signature below `sig` among the lowest ones of both."""
    out, step = np.zeros(len(x), bool), max(1, cells // FEW**2)
    for k in range(0, len(x), step):
        u, v = few[x[k : k + step]], few[y[k : k + step]]
        out[k : k + step] = ((u[:, :, None] == v[:, None, :]) & (u < sig)[:, :, None]).any(axis=(1, 2))
    return out


def _cells(nearest: bool) -> Callable:
    """Candidate pairs from rows sorted by cell (sig, i, j), a cell at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            out, held = split(table, False)
            yield from out
        if held is not None:
            yield from split(held, True)[0]

    def split(table: pa.Table, end: bool) -> tuple[list[pa.RecordBatch], pa.Table | None]:
        if not table.num_rows:
            return [], None
        table = table.combine_chunks()
        sig, i, j, kind, name, n, rn, rs = (table.column(c).to_numpy() for c in range(8))
        starts = np.flatnonzero(np.concatenate([[True], (sig[1:] != sig[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
        stop = table.num_rows if end else starts[-1]
        words = table.column(8).combine_chunks().flatten().to_numpy().view("u8").reshape(-1, SKETCH // 64)
        few = None if nearest else table.column(9).combine_chunks().flatten().to_numpy().reshape(-1, FEW)
        n = n.astype("i8")
        got = []
        for a, b in zip(starts, np.append(starts[1:], table.num_rows)):
            if b > stop:
                break
            x, y = near_pairs(name[a:b], n[a:b], rn[a:b], rs[a:b], words[a:b], kind[a:b], nearest)
            x, y = a + x, a + y
            if few is not None:
                fresh = ~met_before(few, x, y, sig[a])
                x, y = x[fresh], y[fresh]
            got.append((x, y))
        out = []
        if got:
            x, y = (np.concatenate(z) for z in zip(*got))
            turn = (n[x] > n[y]) | ((n[x] == n[y]) & (name[x] > name[y]))
            x, y = np.where(turn, y, x), np.where(turn, x, y)
            ends = np.unique(np.column_stack([name[x], n[x], name[y], n[y]]), axis=0)
            if len(ends):
                out = [pa.RecordBatch.from_arrays([pa.array(ends[:, c].astype(t)) for c, t in enumerate(("i8", "i4", "i8", "i4"))], names=["a", "na", "b", "nb"])]
        return out, table.slice(stop) if stop < table.num_rows else None

    return run


def candidates(rows: DataFrame, holders: DataFrame, nearest: bool) -> DataFrame:
    """Pairs of sets of two groups in one cell whose profiles allow a link. With `nearest` one
    for each set; else all of them, each at the lowest of a few signatures that both have."""
    dealt = rows.select("sig", "i", "j", "kind", *_MEMBER, *([] if nearest else ["few"])).repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j")
    both = dealt.mapInArrow(_cells(nearest), "a long, na int, b long, nb int").distinct()
    return likely(both.withColumn("times", F.lit(1).cast("long")), holders).drop("times")


def mixed(member: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the crowded signatures that hold more than one group, with their group (rn, rs), the
    signature's size k, its largest group `main` and that group's members `most`."""
    rooted = member.join(groups, ["name", "n"], "left").withColumn("root", F.coalesce("root", F.struct("name", "n")))
    counts = rooted.groupBy("sig", "root").agg(F.count(F.lit(1)).alias("c")).groupBy("sig").agg(F.sum("c").alias("k"), F.max(F.struct("c", "root")).alias("top"))
    several = counts.where("top.c < k").select("sig", "k", F.col("top.c").alias("most"), F.col("top.root").alias("main"))
    return stored(rooted.join(several, "sig").select("*", F.col("root.name").alias("rn"), F.col("root.n").alias("rs")), "mixed")


def hands(rows: DataFrame, turn: int, deal: int) -> DataFrame:
    """Each set at a few of its crowded signatures, the same ones for sets that share most, dealt
    at random into parts of about `deal` sets."""
    lowest = [F.min(F.struct(F.xxhash64("sig", F.lit(turn * HANDS + h)), "sig")).getField("sig") for h in range(HANDS)]
    once = rows.groupBy(*_MEMBER).agg(F.array_distinct(F.array(*lowest)).alias("sigs"))
    held = stored(once.select(*_MEMBER, F.explode("sigs").alias("sig")), "hands")
    sizes = held.groupBy("sig").agg(F.count(F.lit(1)).alias("held"))
    part = F.pmod(F.xxhash64("name", "n", F.lit(turn)), F.ceil(F.col("held") / deal)).cast("int")
    return held.join(sizes, "sig").select("sig", part.alias("i"), F.lit(0).alias("j"), F.lit(2).alias("kind"), *_MEMBER)


def blocks(rows: DataFrame, cell: int) -> DataFrame:
    """Cells that hold every pair of sets of two groups of a signature: all its sets by blocks
    on one side, those outside its largest group by blocks on the other."""
    across, down = F.ceil(F.col("k") / cell).cast("int"), F.ceil((F.col("k") - F.col("most")) / cell).cast("int")
    lowest = F.concat(F.sort_array(F.collect_set("sig")), F.array_repeat(F.lit(NO_SIG), FEW))
    rows = rows.join(rows.groupBy("name", "n").agg(F.slice(lowest, 1, FEW).alias("few")), ["name", "n"])
    place = lambda seed, n: F.pmod(F.xxhash64("name", "n", F.lit(seed)), n).cast("int")
    every = rows.select("sig", place(0, across).alias("i"), F.explode(F.sequence(F.lit(0), down - 1)).alias("j"), F.lit(0).alias("kind"), *_MEMBER, "few")
    others = rows.where("root != main").select("sig", F.explode(F.sequence(F.lit(0), across - 1)).alias("i"), place(1, down).alias("j"), F.lit(1).alias("kind"), *_MEMBER, "few")
    return every.unionByName(others)


def join_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD, hot_keys: int = HOT_KEYS, deal: int = DEAL, cell: int = CELL) -> DataFrame:
    """(id, n_shingles, component_id), one row per input row."""
    spark = docs.sparkSession
    kind = docs.schema[id_col].dataType.simpleString()
    slim = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    info = stored(slim.mapInArrow(_describe(to_arrow_type(docs.schema[id_col].dataType)), _INFO.format(id=kind)), "info")
    rows = info.where(F.col("kind") == 0)
    # One row per band, and a bounded list of frequent shingles: both only steer costs and allocation.
    short = rows.select("band", "short").unionByName(rows.select(F.col("band2").alias("band"), F.col("short2").alias("short"))).where("short > 0")
    spared = {r.band: r.short for r in short.groupBy("band").agg(F.max("short").alias("short")).collect()}
    often = info.where(F.col("kind") == 1).groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "name").limit(hot_keys).collect()
    hot = spark.sparkContext.broadcast(np.sort(np.array([r.name for r in often], "i8").view("u8")))
    signed = slim.select("text").mapInArrow(_signer(spared, hot), "sig long, name long, n int")
    shared = signed.repartition("sig").sortWithinPartitions("sig", "n", "name").mapInArrow(_scanner(crowd), _PAIRS)
    found = stored(shared.groupBy("kind", "a", "na", "b", "nb").agg(F.sum("times").alias("times")), "pairs")
    holders = stored(rows.where("n > 0").groupBy("name", "n").agg(F.min("id").alias("id"), F.max("profile").alias("profile"), F.max("sketch").alias("sketch")), "holders")
    pairs, crowds = stored(likely(found.where("kind = 0").drop("kind"), holders), "likely"), found.where("kind = 1").select(F.col("b").alias("sig"), F.col("a").alias("name"), F.col("na").alias("n"))

    # The sets in question, each from one document that has it.
    asked = pairs.select(F.col("a").alias("name"), F.col("na").alias("n")).unionByName(pairs.select(F.col("b").alias("name"), F.col("nb").alias("n"))).unionByName(crowds.select("name", "n")).distinct()
    chosen = holders.select("name", "n", "id").join(asked, ["name", "n"], "left_semi")
    texts = slim.join(chosen.select("id"), "id", "left_semi").select("text")
    found_sets = texts.mapInArrow(_sets, "name long, n int, items binary")
    # A set that only rows without an id have is fetched by its name.
    nameless = slim.where("id IS NULL").select("text").mapInArrow(_sets, "name long, n int, items binary")
    nameless = nameless.join(chosen.where("id IS NULL").select("name", "n"), ["name", "n"], "left_semi").dropDuplicates(["name", "n"])
    sets = stored(found_sets.unionByName(nameless), "sets")

    ends = pairs.select("a", "na", "b", "nb", "times", F.col("a").alias("u"), F.col("na").alias("nu")).unionByName(pairs.select("a", "na", "b", "nb", "times", F.col("b").alias("u"), F.col("nb").alias("nu")))
    best = ends.groupBy("u", "nu").agg(F.max(F.struct("times", "a", "na", "b", "nb")).alias("p")).select("p.a", "p.na", "p.b", "p.nb").distinct()
    links = stored(verified(best, sets), "links")
    groups = stored(components(links), "groups")

    member = stored(crowds.distinct().join(holders.select("name", "n", "sketch"), ["name", "n"]), "crowds")
    members, turns, rest = member.count(), 0, apart(pairs, groups)
    while members:
        left = mixed(member, groups)
        work, sets_left = left.agg(F.sum(F.col("k") - F.col("most")), F.count_distinct("name", "n")).first()
        if not sets_left:
            break
        if turns and (gone * 20 < sets_left) or work <= PER_MEMBER * members:
            # What is left is compared in full.
            rest = rest.unionByName(candidates(blocks(left, cell), holders, False)).distinct()
            break
        # Crowded signatures are dealt into small parts, other ones each turn.
        more = stored(verified(candidates(hands(left, turns, deal), holders, True), sets), "links")
        groups, gone = merged(groups, more)
        turns, rest = turns + 1, apart(pairs, groups)

    more = stored(verified(stored(rest, "rest"), sets), "links")
    if not more.isEmpty():
        groups, _ = merged(groups, more)

    root = F.coalesce("root", F.struct("name", "n"))
    held = holders.drop("profile", "sketch").join(groups, ["name", "n"], "left").select("name", "n", "id", root.alias("root"))
    smallest = held.groupBy("root").agg(F.min("id").alias("component_id"))
    members = held.join(smallest, "root").select("name", "n", "component_id")
    full = rows.select("id", "n", "name").where("n > 0").join(members, ["name", "n"]).select("id", "n", "component_id")
    lone = rows.where("n = 0").select("id", "n", F.col("id").alias("component_id"))
    return full.unionByName(lone).select(F.col("id").alias(id_col), F.col("n").cast("long").alias("n_shingles"), "component_id")


SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS MATERIALIZED (SELECT DISTINCT doc_id, hash(s) AS s FROM (SELECT doc_id, array_to_string(ws[i:i+4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM w WHERE len(ws) > 0))),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM g x JOIN g y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
link AS MATERIALIZED (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)),
edge AS MATERIALIZED (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT edge.b, reach.r FROM reach JOIN edge ON edge.a = reach.doc_id WHERE reach.r < edge.b)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(r) AS c FROM reach GROUP BY doc_id) m USING (doc_id)
"""
