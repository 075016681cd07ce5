"""Benchmark decontamination by pigeonhole edit matching.

An item within e edits of some part of a document, cut into e + 1 pieces, has one
piece that the edits leave alone.  So each normalised item is cut into e + 1
pieces, and an Aho-Corasick automaton finds the pieces in each normalised document.
The pieces are the leaves of a binary tree: as a part of k pieces has k - 1 edits
at most or is not needed, one half of it has that too, and so the parts around a
piece's place are verified from the smallest to the whole item by Myers'
bit-parallel distance.  Pieces that are frequent fail at the first.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.llm.common import sliced

#: Edits allowed, as a share of the item's normalised length.
ERROR_RATE = 0.1
#: Normalised characters that an item needs: shorter ones are words of any text, and are left out (``left_out`` lists them).
MIN_CHARS = 20
#: Characters of benchmark text that go to every task at once; more items are matched in blocks, one pass for each.
MAX_BLOCK_CHARS = 4_000_000


def normalise(text: str | None) -> str:
    """Small ASCII letters, single spaces."""
    raw = (text or "").encode()
    return b" ".join(raw.lower().split()).decode()  # of bytes: ASCII only


def error_budget(n: int, rate: float = ERROR_RATE) -> int:
    """Edits that an item of n characters is allowed; an item needs a character that is left alone."""
    return max(0, min(int(rate * n + 1e-9), n - 1))


def cut_item(item: str, errors: int) -> list[tuple[int, str]]:
    """(offset, piece) of errors + 1 pieces of about one length."""
    n = errors + 1
    ends = [len(item) * k // n for k in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def parts_above(n: int) -> list[list[tuple[int, int]]]:
    """Of each of n pieces the parts (first, end) that have it, from two pieces up, without the whole."""
    above: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    waiting = [(0, n)]
    while waiting:
        a, b = waiting.pop()
        if 1 < b - a < n:
            for k in range(a, b):
                above[k].insert(0, (a, b))
        if b - a > 1:
            waiting += [(a, (a + b) // 2), ((a + b) // 2, b)]
    return above


def best_match(pattern: str, text: str, errors: int) -> tuple[int, int] | None:
    """(distance, end) of the part of the text nearest to the pattern, the first such; None beyond the budget.

    Myers' algorithm: the columns of the edit-distance matrix as bit vectors.
    """
    m = len(pattern)
    masks: dict[str, int] = defaultdict(int)
    for i, c in enumerate(pattern):
        masks[c] |= 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = errors + 1, -1
    get = masks.get
    for j, c in enumerate(text):
        eq = get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | ~(xh | pv) & full
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full  # a match may begin anywhere, so the first row is 0
        mh = mh << 1 & full
        pv = mh | ~(xv | ph) & full
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
            if not best:
                break
    return (best, at) if at >= 0 else None


def _has(doc: str, at: int, part: str, errors: int) -> bool:
    """Whether a part of an item is in the document, beginning within so many characters of a place."""
    a, b = max(at - errors, 0), at + len(part) + errors
    return doc.startswith(part, max(at, 0)) or best_match(part, doc[a:b], errors) is not None


class Matcher:
    """Finds the items of one block in texts."""

    def __init__(self, items: list[tuple], rate: float):
        import ahocorasick

        self.items = []
        self.automaton = ahocorasick.Automaton()
        places: dict[str, list[tuple[int, int, list[tuple[int, str, int]]]]] = defaultdict(list)
        for item_id, text in items:
            item = normalise(text)
            if len(item) >= MIN_CHARS:
                errors = error_budget(len(item), rate)
                pieces = cut_item(item, errors)
                ends = [*(a for a, _ in pieces), len(item)]
                for (offset, piece), above in zip(pieces, parts_above(len(pieces)), strict=True):
                    parts = [(offset - ends[a], item[ends[a] : ends[b]], b - a - 1) for a, b in above]
                    places[piece].append((len(self.items), offset, parts))
                self.items.append((item_id, item, errors))
        for piece, where in places.items():
            self.automaton.add_word(piece, (len(piece), where))
        if self.items:
            self.automaton.make_automaton()

    def __call__(self, text: str | None) -> list[tuple]:
        """(item_id, distance) of the items that a text has, the best distance of each."""
        if not self.items or not text:
            return []
        doc = normalise(text)
        windows: dict[int, list[list[int]]] = {}
        for end, (n, where) in self.automaton.iter(doc):
            for k, offset, parts in where:
                item_id, item, errors = self.items[k]
                a = end + 1 - n - offset - errors
                b = a + len(item) + 2 * errors
                own = windows.get(k)
                if own and own[-1][0] <= a and b <= own[-1][1]:
                    continue
                if not all(_has(doc, end + 1 - n - before, part, most) for before, part, most in parts):
                    continue
                if own is None:
                    own = windows[k] = []
                if own and a <= own[-1][1]:  # windows that overlap are verified as one
                    own[-1][0], own[-1][1] = min(own[-1][0], a), max(own[-1][1], b)
                else:
                    own.append([a, b])
        found = []
        for k, own in windows.items():
            item_id, item, errors = self.items[k]
            best = None
            for a, b in own:
                got = best_match(item, doc[max(a, 0) : b], errors)
                if got and (best is None or got[0] < best):
                    best = got[0]
                    if not best:
                        break
            if best is not None:
                found.append((item_id, best))
        return found


def _blocks(benchmark: DataFrame, item_id: str, text: str, max_chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded size; a row at a time comes to the driver."""
    block, n = [], 0
    rows = benchmark.select(F.col(f"`{item_id}`"), F.col(f"`{text}`")).where(F.col(f"`{text}`").isNotNull()).distinct()
    for r in rows.toLocalIterator():
        if block and n + len(r[1]) > max_chars:
            yield block
            block, n = [], 0
        block.append((r[0], r[1]))
        n += len(r[1])
    if block:
        yield block


def left_out(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """(item_id, text) of the items that are too short to be looked for, null and empty ones among them."""
    own = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.length(F.trim(F.regexp_replace(own, r"[\x20\x09-\x0D]+", " ")))
    return benchmark.where(size < MIN_CHARS).select(F.col(f"`{item_id}`").alias("item_id"), F.col(f"`{text}`").alias("text"))


def _shipped(spark: SparkSession, block: list[tuple], rate: float):
    """A function that gives a task the block's matcher.

    The block is broadcast; each task builds the matcher anew and lets it go with its end.
    """
    sent = spark.sparkContext.broadcast(block)
    return lambda: Matcher(sent.value, rate)


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """(doc_id, item_id, distance): every document and every item that a part of it is within the budget of.

    Null and empty texts match nothing, and neither do items of fewer than MIN_CHARS
    characters (``left_out``).  Very long texts are searched whole.  Rows of documents
    that repeat give a row each; items that repeat count once, and items of one text
    under several ids are found each.  Null ids are carried along.  Empty tables give
    no rows.  Other columns are not looked at.

    Each block of the benchmark is one pass over the documents, and goes to the tasks
    by a broadcast of at most ``max_block_chars`` characters.
    """
    kinds = docs.schema[doc_id].dataType.simpleString(), benchmark.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, distance int"
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    item_type = pa.int64() if kinds[1] in ("bigint", "int", "smallint", "tinyint") else pa.string()

    def finder(shipped):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shipped()
            for batch in sliced(batches):
                at, items, distances = [], [], []
                for i, t in enumerate(batch.column(1).to_pylist()):
                    for item, distance in matcher(t):
                        at.append(i)
                        items.append(item)
                        distances.append(distance)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64())), pa.array(items, item_type), pa.array(distances, pa.int32())],
                    names=["doc_id", "item_id", "distance"],
                )

        return run

    out = None
    for block in _blocks(benchmark, item_id, item_text, max_block_chars):
        part = rows.mapInArrow(finder(_shipped(docs.sparkSession, block, error_rate)), schema)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], schema)


def remove_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    error_rate: float = ERROR_RATE,
    max_block_chars: int = MAX_BLOCK_CHARS,
) -> DataFrame:
    """The rows of docs, all columns, that have no part within the budget of an item.

    A filter in each task: nothing is shuffled.  Null and empty texts stay, rows that
    repeat go or stay alike, whatever their ids, and very long texts are searched
    whole.  Items of fewer than MIN_CHARS characters take nothing away.  An empty
    table gives no rows, an empty benchmark all rows; columns of any name are kept.
    """

    def keeper(shipped, at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            matcher = shipped()
            for batch in sliced(batches):
                yield batch.filter(pa.array([not matcher(t) for t in batch.column(at).to_pylist()], pa.bool_()))

        return run

    for block in _blocks(benchmark, item_id, item_text, max_block_chars):
        docs = docs.mapInArrow(keeper(_shipped(docs.sparkSession, block, error_rate), docs.columns.index(text)), docs.schema)
    return docs
