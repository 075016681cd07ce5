"""Exact removal of repeated byte strings by a distributed merge sort of suffixes.

A byte goes if a string of ``length`` bytes over it also starts in a document
with a smaller id.  Two rounds of one merge sort find these strings:

1. Each string of ``length`` bytes has an anchor, the k-mer of the least hash in it.
   Strings of one anchor lie side by side, and their union is a segment.  The
   suffix at each anchor is sorted, up to its segment's end, and then by what the
   segment has before the anchor, from right to left.  So equal segments, and the
   segments of one k-mer, come together: all equal ones but those of the smallest
   document go, and a k-mer that no other document's segments have is done with.
2. What is left are segments of one k-mer that differ around it, at the ends of
   repeated passages.  All their suffixes of ``length`` bytes are sorted; of equal
   ones all but those of the smallest document go.

A round deals its strings to runs.  Each run is sorted, some ranges of hashes at a
time, keeps one document of each string, and is front-coded (length of the prefix
common with the string before, and the rest), a piece for each range.  Runs and
ranges grow with the input, so pieces do not become many and small.  Each range is merged by
a loser tree that compares two strings only beyond the prefixes known to be common,
and it is the merge, of bytes, that decides.  Hashes only leave strings out before:
a string goes on if another run, or another document of its run, has its hash.

A k-mer with very many segments is dealt by segments, so no range takes all of it,
and copies of a passage, however many, give one string for each run.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import shared_table, sliced, worker_state

LENGTH = 50
KMER = 24
#: Bytes that are hashed at once (so few that the arrays of a step stay in a core's cache, and the allocator reuses them rather than asking for new pages), bytes in a run of the first round and in a range of its merge.
BLOCK, RUN_BYTES, RANGE_BYTES = 1 << 16, 4_000_000, 4_000_000
#: Parts up to which runs and ranges keep these sizes; then they grow, up to the largest: bytes of a run and a range of the first round, suffixes of those of the second.
PARTS, LARGEST_RUN, LARGEST_RANGE, LARGEST_SUFFIXES = 96, 32_000_000, 16_000_000, 800_000
#: Strings that are sorted, or given on by a merge, at once.
STRINGS = 65_536
#: A k-mer with more segments in a run is dealt by segments.
HOT = 64
#: Suffixes in a run of the second round, and in a range of its merge.
SUFFIX_RUN, RANGE_SUFFIXES = 200_000, 200_000
#: Rows of a byte matrix that are worked on at once.
ROWS = 32_768


# --- segments and windows ---------------------------------------------------------------------


def segments(data: bytes, starts: np.ndarray, ends: np.ndarray, length: int = LENGTH, k: int = KMER) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, anchor, first window, windows) of the segments of texts that lie one after another in ``data``."""
    n = len(data) - length + 1
    none = np.zeros(0, dtype=np.int64)
    if n < 1:
        return none.view(np.uint64), none, none, none
    words = np.ndarray((len(data) - 7,), dtype="<u8", buffer=np.frombuffer(data, dtype=np.uint8), strides=(1,))
    h = words[: len(data) - k + 1] * np.uint64(0x9E3779B97F4A7C15)
    for at in sorted({*range(8, k - 8, 8), k - 8}):  # of all bytes of the k-mer
        h ^= h >> np.uint64(31)
        h += words[at : len(data) - k + 1 + at] * np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    bits = max(int(len(h) - 1).bit_length(), 1)
    order = (h >> np.uint64(bits) << np.uint64(bits)) | np.arange(len(h), dtype=np.uint64)  # ties: the first in the window
    width, size = length - k + 1, 1
    least = order
    while 2 * size <= width:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < width:
        least = np.minimum(least[:n], least[width - size : width - size + n])
    anchor = (least[:n] & np.uint64((1 << bits) - 1)).astype(np.int64)
    edge = np.zeros(n + 1, dtype=np.int32)  # windows that lie in one text
    whole = ends - starts >= length
    np.add.at(edge, starts[whole], 1)
    np.add.at(edge, ends[whole] - length + 1, -1)
    inside = np.flatnonzero(np.cumsum(edge[:n]) > 0)
    if not len(inside):
        return none.view(np.uint64), none, none, none
    own = anchor[inside]
    begins = np.concatenate([[0], np.flatnonzero((own[1:] != own[:-1]) | (inside[1:] != inside[:-1] + 1)) + 1])
    counts = np.diff(np.concatenate([begins, [len(own)]]))
    least = h[own[begins]]  # least hashes are small: mixed again, so that ranges of them are alike
    least = (least ^ least >> np.uint64(29)) * np.uint64(0xC2B2AE3D27D4EB4F)
    return (least ^ least >> np.uint64(32)) >> np.uint64(16), own[begins], inside[begins], counts


def segment_keys(raw: np.ndarray, anchor: np.ndarray, lo: np.ndarray, n: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(byte matrix, sizes): anchor k-mer, bytes from it on and before it, those that follow, those before from right to left.

    The two counts after the k-mer make unequal strings differ before either ends.
    """
    wide = 2 * (length - k)
    out = np.zeros((len(anchor), k + 2 + wide), dtype=np.uint8)
    sizes = (k + 2 + n - 1 + length - k).astype(np.uint8)
    for s in range(0, len(anchor), ROWS):
        a, l, w = anchor[s : s + ROWS, None], lo[s : s + ROWS, None], n[s : s + ROWS, None]
        part = out[s : s + ROWS]
        part[:, :k] = raw[a + np.arange(k)]
        after, before = l + w + length - 1 - a, a - l
        part[:, k], part[:, k + 1] = after[:, 0], before[:, 0]
        j = np.arange(wide)
        right = after - k
        from_ = np.where(j < right, a + k + j, a - 1 - (j - right))
        part[:, k + 2 :] = np.where(j < right + before, raw[np.clip(from_, 0, len(raw) - 1)], 0)
    return out, sizes


def segment_of(key: bytes, k: int) -> bytes:
    """The bytes of the segment that a key spells."""
    right = key[k] - k
    return key[: k + 1 + right : -1] + key[:k] + key[k + 2 : k + 2 + right]


def mixed(matrix: np.ndarray) -> np.ndarray:
    """48-bit hashes of the rows of a byte matrix."""
    out = np.empty(len(matrix), dtype=np.uint64)
    width = -(-matrix.shape[1] // 8) * 8
    for s in range(0, len(matrix), ROWS):
        part = matrix[s : s + ROWS]
        padded = np.zeros((len(part), width), dtype=np.uint8)
        padded[:, : matrix.shape[1]] = part
        h = np.full(len(part), 0x27D4EB2F165667C5, dtype=np.uint64)
        for word in padded.view("<u8").T:
            h = (h ^ word) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h *= np.uint64(0xC2B2AE3D27D4EB4F)
        out[s : s + ROWS] = (h ^ h >> np.uint64(29)) >> np.uint64(16)
    return out


def range_of(hashes: np.ndarray, n_ranges: int) -> np.ndarray:
    return ((hashes >> np.uint64(16)) * np.uint64(n_ranges) >> np.uint64(32)).astype(np.int64)


# --- front-coded runs -------------------------------------------------------------------------


def compressed(data: bytes, level: int) -> bytes:
    """By a compressor that stays, as making one takes longer than a small piece."""
    state = worker_state("zstandard")
    if level not in state:
        state[level] = zstandard.ZstdCompressor(level=level)
    return state[level].compress(data)


def decompressed(data: bytes) -> bytes:
    state = worker_state("zstandard")
    if "back" not in state:
        state["back"] = zstandard.ZstdDecompressor()
    return state["back"].decompress(data)


def squeeze(column: np.ndarray) -> bytes:
    """A column's bytes, those of one significance together, compressed."""
    planes = np.ascontiguousarray(column).view(np.uint8).reshape(len(column), column.itemsize).T
    return compressed(np.ascontiguousarray(planes).tobytes(), 1)


def unsqueeze(blob: bytes, kind: str) -> np.ndarray:
    raw = np.frombuffer(decompressed(blob), dtype=np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(raw.reshape(size, -1).T).view(kind).ravel()


def changes(rows: np.ndarray) -> np.ndarray:
    """Which rows of a byte matrix differ from the one before; the first does."""
    out = np.ones(len(rows), dtype=bool)
    for s in range(1, len(rows), ROWS):
        out[s : s + ROWS] = (rows[s : s + ROWS] != rows[s - 1 : s - 1 + ROWS][: len(rows) - s]).any(axis=1)
    return out


def front_code(rows: np.ndarray, sizes: np.ndarray, begins: np.ndarray | None = None) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted row with the one before (0 for the first, and where a piece begins), and all rests.

    Rows are padded to one width; equal rows have their whole size in common.
    """
    lcp, rests = np.zeros(len(rows), dtype=np.int64), []
    at = np.arange(rows.shape[1])
    for s in range(0, len(rows), ROWS):
        part, size = rows[s : s + ROWS], sizes[s : s + ROWS].astype(np.int64)
        before = rows[max(s - 1, 0) : s + len(part) - 1] if s else np.concatenate([part[:1], part[:-1]])
        differ = part != before
        own = np.where(differ.any(axis=1), differ.argmax(axis=1), size)
        if not s:
            own[:1] = 0
        if begins is not None:
            own[begins[s : s + ROWS]] = 0
        lcp[s : s + ROWS] = own
        rests.append(part[(at >= own[:, None]) & (at < size[:, None])].tobytes())
    return lcp, b"".join(rests)


def decode_run(lcp: Iterable[int], sizes: Iterable[int], rest: bytes) -> Iterator[tuple[int, bytes]]:
    """(common prefix with the row before, row) of a front-coded run."""
    row, at = b"", 0
    for p, size in zip(lcp, sizes, strict=True):
        end = at + size - p
        row = row[:p] + rest[at:end]
        at = end
        yield p, row


def merge_runs(runs: list[Iterator[tuple[int, bytes]]]) -> Iterator[tuple[int, int, bytes]]:
    """(run, common prefix with the row given before, row) of all rows of sorted runs, in order.

    A loser tree.  Each waiting row knows its common prefix with the last winner
    on its path: the longer prefix is the smaller row, and only rows of equal
    prefixes are compared, from there on.  Equal rows come in order of runs.  No
    row may be a proper prefix of another.
    """
    if not runs:
        return
    k = 1
    while k < len(runs):
        k *= 2
    ended = (-1, b"")
    heads = [next(r, ended) for r in runs] + [ended] * (k - len(runs))
    prefix = [min(h[0], 0) for h in heads]  # -1: the run has ended
    rows = [h[1] for h in heads]
    number = int.from_bytes

    def duel(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's prefix becomes the one with the winner."""
        p = prefix[a]
        if p != prefix[b]:
            return (a, b) if p > prefix[b] else (b, a)
        if p < 0:
            return (a, b) if a < b else (b, a)
        x, y = rows[a], rows[b]
        if x == y:
            if a > b:
                a, b = b, a
            prefix[b] = len(x)
            return a, b
        if x > y:
            a, b = b, a
        end = min(len(x), len(y))
        differ = number(x[p:end]) ^ number(y[p:end])  # the first byte that differs is the highest
        prefix[b] = end - (differ.bit_length() + 7) // 8
        return a, b

    tree = [0] * k  # the losers
    level = list(range(k))
    at = k
    while at > 1:
        at //= 2
        up = []
        for j in range(at):
            won, tree[at + j] = duel(level[2 * j], level[2 * j + 1])
            up.append(won)
        level = up
    champion = level[0]
    while prefix[champion] >= 0:
        yield champion, prefix[champion], rows[champion]
        node = (k + champion) // 2
        prefix[champion], rows[champion] = p, x = next(runs[champion], ended)
        while node:  # as duel, without its call: p and x are the champion's
            other = tree[node]
            q = prefix[other]
            if p < q:
                champion, tree[node] = other, champion
                p, x = q, rows[other]
            elif p == q >= 0:
                y = rows[other]
                if x == y:
                    same = len(x)
                else:
                    end = min(len(x), len(y))
                    same = end - ((number(x[p:end]) ^ number(y[p:end])).bit_length() + 7) // 8
                if x > y or x == y and champion > other:
                    prefix[champion] = same
                    champion, tree[node] = other, champion
                    x = y
                else:
                    prefix[other] = same
            node >>= 1


#: Of a string: its common prefix, its size, its document, the hash of that text, its place, its windows.
STRING = np.dtype([("lcp", "<u1"), ("size", "<u1"), ("doc", "<i8"), ("tag", "<i8"), ("lo", "<i4"), ("n", "<u1")])
PIECE = "run long, range long, rest binary, strings binary"
#: Added to n: the string's k-mer was dealt by segments.
IS_HOT = 128


def _pieces(rows: list[tuple]) -> pa.Table:
    names = [c.split()[0] for c in PIECE.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    return pa.table({c: pa.array(x, pa.int64() if c in ("run", "range") else pa.binary()) for c, x in zip(names, columns, strict=True)})


def groups_of(part: np.ndarray, most: int) -> Iterator[np.ndarray]:
    """The entries of some ranges at a time: no more than ``most``, if one range has no more."""
    order = np.argsort(part, kind="stable")
    ends = np.append(np.flatnonzero(np.diff(part[order])) + 1, len(order))
    a = 0
    while a < len(order):
        b = max(int(ends[np.searchsorted(ends, a + most, side="right") - 1]), int(ends[np.searchsorted(ends, a, side="right")]))
        yield order[a:b]
        a = b


def sorted_run(run: int, keys_of: Callable, places: dict[str, np.ndarray], kmer: np.ndarray, n_ranges: int, k: int) -> pa.Table:
    """The pieces of a run, by range, and with range -1 the strings that the run decides.

    keys_of: gives the byte matrix and the sizes of some of the strings.  places: doc,
    tag, lo and n of each.  kmer: a hash of its first k bytes.
    """
    out: list[tuple] = []
    for at in groups_of(range_of(kmer, n_ranges), STRINGS):  # strings of one k-mer are in one group
        out += _sorted_group(run, *keys_of(at), {c: x[at] for c, x in places.items()}, kmer[at], n_ranges, k)
    return _pieces(out)


def _sorted_group(run: int, rows: np.ndarray, sizes: np.ndarray, places: dict[str, np.ndarray], kmer: np.ndarray, n_ranges: int, k: int) -> list[tuple]:
    keys = rows.view(f"S{rows.shape[1]}").ravel()
    order = np.lexsort((places["doc"], keys))
    rows, sizes, kmer = rows[order], sizes[order], kmer[order]
    places = {c: x[order] for c, x in places.items()}
    doc = places["doc"]
    new = changes(rows)
    first = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    beaten = doc != doc[first]
    out: list[tuple] = []

    def strings(at: np.ndarray, **columns) -> np.ndarray:
        made = np.zeros(len(at), dtype=STRING)
        for c, x in (columns | {c: x[at] for c, x in places.items()}).items():
            made[c] = x
        return made

    if beaten.any():
        out.append((run, -1, b"", squeeze(strings(np.flatnonzero(beaten)))))
    rows, sizes, kmer = rows[~beaten], sizes[~beaten], kmer[~beaten]
    places = {c: x[~beaten] for c, x in places.items()}
    part = range_of(kmer, n_ranges)
    start = np.flatnonzero(changes(rows[:, :k]))
    counts = np.diff(np.concatenate([start, [len(rows)]]))
    low, high = np.minimum.reduceat(places["doc"], start), np.maximum.reduceat(places["doc"], start)
    wide = (counts > HOT) & (low < high)
    if rows.shape[1] > k and wide.any():
        hot = np.repeat(wide, counts)
        part[hot] = range_of(mixed(rows[hot]), n_ranges)
        places["n"] = places["n"] | np.where(hot, IS_HOT, 0).astype(places["n"].dtype)
        # two marks without windows tell the k-mer's own range that more than one document has it
        marks = np.zeros((2 * int(wide.sum()), rows.shape[1]), dtype=np.uint8)
        marks[:, :k] = np.tile(rows[start[wide], :k], (2, 1))
        rows = np.concatenate([rows, marks])
        sizes = np.concatenate([sizes, np.full(len(marks), k + 2, dtype=sizes.dtype)])
        part = np.concatenate([part, np.tile(range_of(kmer[start[wide]], n_ranges), 2)])
        added = {"doc": np.concatenate([low[wide], high[wide]])}
        places = {c: np.concatenate([x, added.get(c, np.zeros(len(marks))).astype(x.dtype)]) for c, x in places.items()}
        again = np.argsort(rows.view(f"S{rows.shape[1]}").ravel(), kind="stable")
        rows, sizes, part = rows[again], sizes[again], part[again]
        places = {c: x[again] for c, x in places.items()}
    at = np.argsort(part, kind="stable")  # sorted within each range
    part, rows, sizes = part[at], rows[at], sizes[at]
    begins = np.ones(len(part), dtype=bool)
    begins[1:] = part[1:] != part[:-1]
    lcp, rest = front_code(rows, sizes, begins)
    made = strings(at, lcp=lcp, size=sizes)
    bytes_ = np.concatenate([[0], np.cumsum(sizes.astype(np.int64) - lcp)]).tolist()
    cuts = [*np.flatnonzero(begins).tolist(), len(part)]
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        out.append((run, int(part[a]), compressed(rest[bytes_[a] : bytes_[b]], 3), squeeze(made[a:b])))
    return out


ENTRY = "doc long, tag long, lo long, n int, data binary"


def merge_range(k: int):
    """Over the pieces of one range: a row for each string that goes, and one with its bytes for each that is open.

    A string goes if a smaller document has an equal one.  Those that stay are
    open if the documents that share their first k bytes are more than one.
    """

    def run(pieces: pa.Table) -> pa.Table:
        made = [unsqueeze(x, STRING) for x in pieces.column("strings").to_pylist()]
        place = {c: np.concatenate([x[c] for x in made]) for c in ("doc", "tag", "lo", "n")}
        if pieces.column("range")[0].as_py() < 0:
            return _entries(place, np.ones(len(place["doc"]), dtype=bool), {})
        starts = np.cumsum([0, *map(len, made)]).tolist()
        rests = pieces.column("rest").to_pylist()
        runs = [decode_run(x["lcp"].tobytes(), x["size"].tobytes(), decompressed(rest)) for x, rest in zip(made, rests, strict=True)]
        del made, rests
        out = []
        at, prefix, keys = [], [], []
        for r, p, key in merge_runs(runs):
            if p < k and len(keys) >= STRINGS:
                out.append(decided(place, at, prefix, keys))
                at, prefix, keys = [], [], []
            at.append(starts[r])
            starts[r] += 1
            prefix.append(p)
            keys.append(key)
        return pa.concat_tables([*out, decided(place, at, prefix, keys)])

    def decided(place: dict[str, np.ndarray], at: list[int], prefix: list[int], keys: list[bytes]) -> pa.Table:
        """The entries of merged strings; those of one k-mer are all among them."""
        order, common = np.array(at), np.array(prefix)
        place = {c: x[order] for c, x in place.items()}
        doc, hot, mark = place["doc"], place["n"] >= IS_HOT, place["n"] == 0
        place["n"] = place["n"] % IS_HOT
        sizes = np.fromiter(map(len, keys), dtype=np.int64, count=len(keys))
        new = common < sizes
        new[0] = True
        same = np.cumsum(new) - 1
        least = np.minimum.reduceat(doc, np.flatnonzero(new))
        beaten = (doc > least[same]) & ~mark
        begins = common < k
        begins[0] = True
        group, start = np.cumsum(begins) - 1, np.flatnonzero(begins)
        far = np.iinfo(np.int64).max
        low = np.minimum.reduceat(np.where(beaten, far, doc), start)
        high = np.maximum.reduceat(np.where(beaten, -far, doc), start)
        is_open = ~beaten & ~mark & (hot | (low < high)[group])
        return _entries(place, beaten, {int(i): segment_of(keys[i], k) for i in np.flatnonzero(is_open)} if k < sizes.max() else {})

    return run


def _entries(place: dict[str, np.ndarray], gone: np.ndarray, left: dict[int, bytes]) -> pa.Table:
    at = np.concatenate([np.flatnonzero(gone), np.fromiter(left, dtype=np.int64, count=len(left))]).astype(np.int64)
    kinds = {"doc": pa.int64(), "tag": pa.int64(), "lo": pa.int64(), "n": pa.int32()}
    columns = {c: pa.array(place[c][at].astype(np.int64)).cast(kind) for c, kind in kinds.items()}
    return pa.table(columns | {"data": pa.array([None] * int(gone.sum()) + list(left.values()), pa.binary())})


# --- the hash filter --------------------------------------------------------------------------

HASHES = "run long, range long, hashes binary"
BITS = "run long, range long, bits binary, n long"


def distinct(hashes: np.ndarray) -> np.ndarray:
    """The distinct hashes, sorted; by a sort alone, where ``np.unique`` fills a hash table first."""
    hashes = np.sort(hashes)
    new = np.ones(len(hashes), dtype=bool)
    new[1:] = hashes[1:] != hashes[:-1]
    return hashes[new]


def hash_blobs(run: int, hashes: np.ndarray, n_ranges: int) -> pa.Table:
    """The distinct 48-bit hashes of a run, a blob for each range."""
    hashes = distinct(hashes)
    part = range_of(hashes, n_ranges)
    cuts = np.concatenate([[0], np.flatnonzero(part[1:] != part[:-1]) + 1, [len(part)]]) if len(part) else np.zeros(1, dtype=np.int64)
    return pa.table(
        {
            "run": pa.array(np.full(len(cuts) - 1, run), pa.int64()),
            "range": pa.array(part[cuts[:-1]] if len(part) else [], pa.int64()),
            "hashes": pa.array([squeeze(np.diff(hashes[a:b], prepend=np.uint64(0))) for a, b in zip(cuts[:-1], cuts[1:], strict=True)], pa.binary()),
        }
    )


def shared_hashes(blobs: pa.Table) -> pa.Table:
    """For each run and range, which of its hashes another run has too: a packed bit for each, in their order."""
    each = [np.cumsum(unsqueeze(x, "<u8"), dtype=np.uint64) for x in blobs.column("hashes").to_pylist()]
    every = np.concatenate(each)
    order = np.argsort(every)
    same = np.diff(every[order]) == 0
    flags = np.zeros(len(every), dtype=bool)  # of all runs at once, so the work is that of the range, however many they are
    flags[order[1:]] = same
    flags[order[:-1]] |= same
    more = np.split(flags, np.cumsum([len(x) for x in each])[:-1])
    return pa.table({"run": blobs.column("run"), "range": blobs.column("range"), "bits": pa.array([np.packbits(x).tobytes() for x in more], pa.binary()), "n": pa.array([len(x) for x in more], pa.int64())})


def wanted(hashes: np.ndarray, doc: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Which entries of a run have a hash that another run, or another document of this run, has too."""
    order = np.argsort(hashes)
    h, d = hashes[order], doc[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = h[1:] != h[:-1]
    start = np.flatnonzero(new)
    replies = replies.sort_by("range")
    bits = [np.unpackbits(np.frombuffer(x, dtype=np.uint8), count=n).astype(bool) for x, n in zip(replies.column("bits").to_pylist(), replies.column("n").to_pylist(), strict=True)]
    more = np.concatenate(bits) | (np.minimum.reduceat(d, start) < np.maximum.reduceat(d, start))
    out = np.zeros(len(h), dtype=bool)
    out[order] = more[np.cumsum(new) - 1]
    return out


# --- round 1: segments of texts ---------------------------------------------------------------


def _text_segments(blocks: pa.Table, length: int, k: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Of about BLOCK bytes of a run's blocks at a time: hash, anchor, first window, windows and block of their segments.

    Anchors and windows are places in the bytes of all blocks, which ``_raw`` gives.
    """
    raw, ends = _raw(blocks)
    first, done = 0, 0
    while first < len(ends):
        last = max(int(np.searchsorted(ends, done + BLOCK, side="right")), first + 1)
        own = ends[first:last] - done
        h, anchor, lo, n = segments(raw[done : done + int(own[-1])], np.concatenate([[0], own[:-1]]), own, length, k)
        at = np.searchsorted(own, lo, side="right") + first
        yield h, (anchor + done).astype(np.int32), (lo + done).astype(np.int32), n.astype(np.uint8), at.astype(np.int32)
        first, done = last, int(ends[last - 1])


def _raw(blocks: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all blocks, end of each)."""
    data = blocks.column("data").combine_chunks()
    offsets = np.frombuffer(data.buffers()[1], dtype=np.int32)[data.offset : data.offset + len(data) + 1].astype(np.int64)
    return np.frombuffer(data.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets[1:] - offsets[0]


def _segment_hashes(n_ranges: int, length: int, k: int):
    def run(blocks: pa.Table) -> pa.Table:
        return hash_blobs(blocks.column("run")[0].as_py(), np.concatenate([x[0] for x in _text_segments(blocks, length, k)]), n_ranges)

    return run


def _segment_run(n_ranges: int, length: int, k: int):
    def run(blocks: pa.Table, replies: pa.Table) -> pa.Table:
        if not replies.num_rows:
            return _pieces([])
        blocks = blocks.combine_chunks()
        doc, tag, pos = (blocks.column(c).to_numpy() for c in ("doc", "tag", "pos"))
        found = list(_text_segments(blocks, length, k))
        hashes, of = (np.concatenate([x[i] for x in found]) for i in (0, 4))
        take = wanted(hashes, doc[of], replies)
        if not take.any():
            return _pieces([])
        anchor, window, n = (np.concatenate([x[i] for x in found])[take] for i in (1, 2, 3))
        hashes, of = hashes[take], of[take]
        del found
        raw, ends = _raw(blocks)
        lo = (window - np.concatenate([[0], ends[:-1]])[of] + pos[of]).astype(np.int32)

        def keys_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return segment_keys(raw, anchor[at].astype(np.int64), window[at].astype(np.int64), n[at].astype(np.int64), length, k)

        return sorted_run(blocks.column("run")[0].as_py(), keys_of, {"doc": doc[of], "tag": tag[of], "lo": lo, "n": n}, hashes, n_ranges, k)

    return run


# --- round 2: all suffixes of the segments that are left --------------------------------------


def _windows(segments_: pa.Table, length: int) -> tuple[np.ndarray, dict[str, np.ndarray]]:
    """(byte matrix of the windows of a run's segments, their doc, tag, lo and n)."""
    data = segments_.column("data").to_pylist()
    sizes = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
    n = sizes - length + 1
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rows = np.lib.stride_tricks.sliding_window_view(np.frombuffer(b"".join(data), dtype=np.uint8), length)
    doc, tag, lo = (np.repeat(segments_.column(c).to_numpy().astype(np.int64), n) for c in ("doc", "tag", "lo"))
    begin = np.repeat(np.cumsum(sizes) - sizes, n) + within
    return rows[begin], {"doc": doc, "tag": tag, "lo": (lo + within).astype(np.int32), "n": np.ones(len(lo), dtype=np.uint8)}


def _window_hashes(n_ranges: int, length: int):
    def run(segments_: pa.Table) -> pa.Table:
        return hash_blobs(segments_.column("run")[0].as_py(), mixed(_windows(segments_, length)[0]), n_ranges)

    return run


def _window_run(n_ranges: int, length: int):
    def run(segments_: pa.Table, replies: pa.Table) -> pa.Table:
        rows, places = _windows(segments_, length)
        hashes = mixed(rows)
        take = wanted(hashes, places["doc"], replies)
        if not take.any():
            return _pieces([])
        rows = rows[take]

        def keys_of(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return rows[at], np.full(len(at), length, dtype=np.uint8)

        return sorted_run(segments_.column("run")[0].as_py(), keys_of, {c: x[take] for c, x in places.items()}, hashes[take], n_ranges, length)

    return run


# --- the operator -----------------------------------------------------------------------------


def _round(dealt: DataFrame, hashes, run, n_ranges: int, k: int) -> DataFrame:
    """One round of the merge sort over ``dealt``, which has a column ``run``."""
    blobs = dealt.groupBy("run").applyInArrow(hashes, HASHES)
    replies = blobs.groupBy("range").applyInArrow(shared_hashes, BITS)
    pieces = dealt.groupBy("run").cogroup(replies.groupBy("run")).applyInArrow(run, PIECE)
    group = F.when(F.col("range") < 0, -1 - F.col("run")).otherwise(F.col("range")).alias("group")
    return pieces.select("*", group).groupBy("group").applyInArrow(merge_range(k), ENTRY)


def _apply(length: int, with_text: bool):
    """The statistics of each text without its removed bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, 128):
            out = []
            for text, los, ns in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3)), strict=True):
                raw = (text or "").encode()
                spans: list[list[int]] = []
                for lo, n in sorted(zip(los or (), ns or (), strict=True)):
                    hi = lo + n + length - 1
                    if spans and lo <= spans[-1][1]:
                        spans[-1][1] = max(spans[-1][1], hi)
                    else:
                        spans.append([lo, hi])
                digest, done, kept = hashlib.sha256(), 0, []
                for a, b in [*spans, [len(raw), len(raw)]]:
                    digest.update(raw[done:a])
                    if with_text:
                        kept.append(raw[done:a])
                    done = b
                row = (len(raw), sum(b - a for a, b in spans), len(spans), digest.hexdigest())
                out.append((*row, b"".join(kept)) if with_text else row)
            columns = list(zip(*out, strict=True)) or [[]] * (4 + with_text)
            kinds = [pa.int64()] * 3 + [pa.string()] + [pa.binary()] * with_text
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept"] * with_text],
            )

    return run


def parts(size: int, least: int, largest: int) -> int:
    """Parts of the least size; where these are more than PARTS, of a larger one, up to the largest.

    Each run has a piece for each range, so that parts of one size would make pieces
    that grow with the square of the input.
    """
    return max(1, min(-(-size // least), PARTS), -(-size // largest))


def _total(df: DataFrame, what: Column) -> int:
    return df.agg(F.sum(what)).first()[0] or 0


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, with_text: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept]) of every row.

    A byte of a text (as UTF-8) is removed if a string of ``length`` bytes over it
    also starts in a document with a smaller id; strings are judged on the input.
    n_spans counts the maximal removed runs; kept has the bytes that remain.

    Ids are integers.  A null text is empty; texts shorter than ``length`` stay
    whole; long ones are dealt to several runs.  Rows of one id never take from one
    another, however many there are; rows that repeat are judged alike, each with
    its result.  A row without an id comes after all others: it loses what they
    have, and they lose nothing to it.  An empty table gives no rows.  Other
    columns are not looked at.
    """
    if not KMER <= length < IS_HOT:
        raise ValueError(f"length must be from {KMER} to {IS_HOT - 1}")
    ids = docs.groupBy(F.col(f"`{doc_id}`").alias("id")).count()
    repeat = bool(ids.where("count > 1").limit(1).count())  # then the hash of a row's text tells it from others of its id
    rows = docs.select(
        F.col(f"`{doc_id}`").alias("id"),
        F.coalesce(F.col(f"`{doc_id}`").cast("long"), F.lit(2**63 - 1)).alias("doc"),
        (F.xxhash64(f"`{text}`") if repeat else F.lit(0)).cast("long").alias("tag"),
        F.col(f"`{text}`").alias("text"),
    )
    texts = rows.select("doc", "tag", F.col("text").cast("binary").alias("raw")).where(F.octet_length("raw") >= length)
    texts = texts.dropDuplicates(["doc", "tag"]) if repeat else texts
    size = _total(texts, F.octet_length("raw"))
    n_runs, n_ranges = parts(size, RUN_BYTES, LARGEST_RUN), parts(size, RANGE_BYTES, LARGEST_RANGE)
    blocks = texts.select("doc", "tag", "raw", F.explode(F.sequence(F.lit(0), F.octet_length("raw") - length, F.lit(BLOCK))).alias("pos"))
    dealt = blocks.select(
        F.pmod(F.xxhash64("doc", "tag", "pos"), F.lit(n_runs)).alias("run"), "doc", "tag", "pos", F.expr(f"substring(raw, pos + 1, {BLOCK + length - 1})").alias("data")
    )
    first = shared_table(_round(dealt, _segment_hashes(n_ranges, length, KMER), _segment_run(n_ranges, length, KMER), n_ranges, KMER))
    gone, left = (first.where(F.col("data").isNull() == is_gone).select("doc", "tag", "lo", x) for is_gone, x in ((True, "n"), (False, "data")))
    n_open = _total(left, F.octet_length("data") - (length - 1))
    if n_open:
        n_runs, n_ranges = parts(n_open, SUFFIX_RUN, LARGEST_SUFFIXES), parts(n_open, RANGE_SUFFIXES, LARGEST_SUFFIXES)
        dealt = left.select(F.pmod(F.xxhash64("doc", "tag", F.floor(F.col("lo") / BLOCK)), F.lit(n_runs)).alias("run"), "doc", "tag", "lo", "data")
        gone = gone.unionByName(_round(dealt, _window_hashes(n_ranges, length), _window_run(n_ranges, length), n_ranges, length).drop("data"))
    listed = gone.groupBy("doc", "tag").agg(F.collect_list(F.struct("lo", "n")).alias("at")).select("doc", "tag", F.col("at.lo").alias("los"), F.col("at.n").alias("ns"))
    judged = rows.join(listed, ["doc", "tag"], "left").select("id", "text", "los", "ns")
    kind = docs.schema[doc_id].dataType.simpleString()
    return judged.mapInArrow(
        _apply(length, with_text), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    )
