"""Harmonic packing of tokenised documents into sequences of one capacity.

A piece of n tokens is of class k = floor(capacity / n), and a sequence of class k
holds just k pieces: no sequence needs to know another.  A document gives whole
sequences of class 1 and a rest.  A rest that nearly fills its class's share of a
sequence stays whole, and a short one too; of any other a piece is cut that fills the
share of a higher class to the last token, and what remains is a rest again.  A
piece's sequence follows from its number within its class, and each task numbers its
own pieces; only the counts by task and class, and in the end the pieces of the last,
unfilled sequence of each class, meet.
"""

from __future__ import annotations

import os
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed, sliced, worker_state

CAPACITY = 2048
END_ID = 1
#: A rest stays whole if it leaves no more than this part of its share empty, or has fewer tokens than SHORT; no cut of a rest leaves fewer than LEAST tokens.
SLACK, SHORT, LEAST = 1 / 16, 128, 16
TOKENIZER = "byte_bpe_50k.json"
#: Words whose ids a Python worker keeps at most (about 200 bytes each).
MAX_CACHED_WORDS = 250_000


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of whole texts, by the ids of their words.

    The tokenizer splits a text into words before it merges, and a word begins
    at every single space between two characters that are not white space.  So
    a text may be cut there, and each part encoded once and kept.  Texts with
    other white space around a space, or with a special token's string, are
    encoded whole.
    """

    def __init__(self, path: str, max_words: int = MAX_CACHED_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [str(x) for x in self.tokenizer.get_added_tokens_decoder().values()]  # such strings in a text are one id
        self.max_words = max_words
        self.words: dict[str, bytes] = {"": b""}
        space = self.tokenizer.encode(" ", add_special_tokens=False).tokens[0]
        vocabulary = self.tokenizer.get_vocab()
        self.begins = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.begins[[i for token, i in vocabulary.items() if token.startswith(space)]] = True

    def encode_all(self, texts: list[str]) -> list[bytes]:
        made = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("I", x.ids).tobytes() for x in made]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with a space before each: of all as one text, cut at the ids that begin with a space."""
        joined = "".join(words)
        ids = np.array(self.tokenizer.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.begins[ids])
        if len(cuts) != len(words) or any(x in joined for x in self.special):
            return self.encode_all(words)
        data, ends = ids.tobytes(), [*(4 * cuts[1:]).tolist(), 4 * len(ids)]
        return [data[a:b] for a, b in zip((4 * cuts).tolist(), ends, strict=True)]

    def looked_up(self, words: list[str], encode: Callable[[list[str]], list[bytes]]) -> list[bytes]:
        found = [*map(self.words.get, words)]
        missing = [p for p, ids in zip(words, found, strict=True) if ids is None]
        if not missing:
            return found
        new = encode(missing)
        if len(self.words) < self.max_words:
            self.words.update((p, ids) for p, ids in zip(missing, new, strict=True) if len(p) <= 64)  # words seen once are mostly not seen again
        following = iter(new)
        return [next(following) if ids is None else ids for ids in found]

    def __call__(self, texts: pa.Array) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text; each word of all of them is looked up once, unknown ones are encoded together."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        whole = pc.match_substring(texts, "\0")
        for x in self.special:
            whole = pc.or_(whole, pc.match_substring(texts, x))
        parts = pc.split_pattern(pc.replace_substring(pc.if_else(whole, "", texts), " ", "\0 "), "\0")
        begins = parts.offsets.to_numpy()
        coded = parts.flatten().dictionary_encode()
        words, at = coded.dictionary, coded.indices.to_numpy()
        # a word is one space and no other white space at either end; or it is the first of its text
        spaced = pc.starts_with(words, " ")
        odd = pc.or_(pc.utf8_is_space(pc.utf8_slice_codeunits(words, -1)), pc.and_(spaced, pc.utf8_is_space(pc.utf8_slice_codeunits(words, 1, 2))))
        again = whole.to_numpy(zero_copy_only=False).copy()
        if pc.any(odd).as_py():
            again[np.searchsorted(begins, np.flatnonzero(odd.to_numpy(zero_copy_only=False)[at]), side="right") - 1] = True
            words = pc.if_else(odd, "", words)
            spaced = pc.and_(spaced, pc.invert(odd))
        ids = self.looked_up(strings(words.filter(spaced)), self.encode_words)
        ids += self.looked_up(strings(words.filter(pc.invert(spaced))), self.encode_all)
        place = np.empty(len(words), dtype=np.int64)
        place[np.argsort(~spaced.to_numpy(zero_copy_only=False), kind="stable")] = np.arange(len(words))
        joined = pa.array(ids, pa.large_binary()).take(pa.array(place[at]))
        ends = np.frombuffer(joined.buffers()[1], dtype=np.int64)[begins].tolist()
        data = memoryview(joined.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(ends[:-1], ends[1:], strict=True)]
        for i in np.flatnonzero(again).tolist():
            out[i] = self.encode_all([texts[i].as_py()])[0]
        return out


def strings(column: pa.Array) -> list[str]:
    """A large_string column's values, none of which has a NUL, as one string that is split; much faster than by value."""
    ended = pc.binary_join_element_wise(column, pa.scalar("", column.type), pa.scalar("\0", column.type))
    size = np.frombuffer(ended.buffers()[1], dtype=np.int64)[len(column)]
    return str(memoryview(ended.buffers()[2])[:size], "utf-8").split("\0")[:-1]


def grouped(texts: pa.Array, size: int = 1_500_000) -> Iterator[tuple[int, pa.Array]]:
    """(first, texts) of consecutive texts of about so many bytes together."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(ends, size + (ends[first - 1] if first else 0))) + 1
        yield first, texts.slice(first, last - first)
        first = min(last, len(texts))


def cut(n: int, capacity: int = CAPACITY) -> list[tuple[int, int, int]]:
    """(start, length, class) of the pieces of a document of n tokens."""
    out = [(k * capacity, capacity, 1) for k in range(n // capacity)]
    start = n - n % capacity
    while start < n:
        rest = n - start
        k = capacity // rest
        if rest >= SHORT and capacity // k - rest > SLACK * (capacity // k):
            k += 1
            while capacity // k > rest - LEAST:
                k += 1
            rest = capacity // k
        out.append((start, rest, capacity // rest))
        start += rest
    return out


def _pieces(path: str, capacity: int):
    """A row for each piece: its document's columns, its class and its number within the class in this task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        state = worker_state("packing")
        encoder = state.get(path) or state.setdefault(path, WordEncoder(path))
        end = np.array([END_ID], dtype="<u4").tobytes()
        task = TaskContext.get().partitionId()
        made: dict[int, int] = {}
        for batch in sliced(batches, 4096):
            rows, out = [], []
            for first, texts in grouped(batch.column(1)):
                for i, ids in enumerate(encoder(texts), first):
                    ids += end
                    n = len(ids) // 4
                    for start, length, k in cut(n, capacity):
                        rows.append(i)
                        out.append((start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), n, k, made.get(k, 0)))
                        made[k] = made.get(k, 0) + 1
            columns = list(zip(*out, strict=True)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(rows, pa.int64())),
                    *(pa.array(c, pa.int64()) for c in columns[:4]),
                    pa.array(columns[4], pa.int32()),
                    pa.array(columns[5], pa.int64()),
                    pa.array(np.full(len(rows), task), pa.int32()),
                ],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "class", "number", "task"],
            )

    return run


def _fill_rest(capacity: int):
    """First fit, longest first, over the pieces of the last sequences.

    They are fewer than the sum of all classes, floor(capacity / n) for any n: some
    10,000 at a capacity of 2,048, however many documents there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        pieces = pa.Table.from_batches(held).sort_by([("length", "descending"), ("class", "ascending"), ("number", "ascending")])
        room: list[int] = []
        first = 0
        sequence, offset = [], []
        for n in pieces.column("length").to_pylist():
            k = next((j for j in range(first, len(room)) if room[j] >= n), len(room))
            if k == len(room):
                room.append(capacity)
            sequence.append(k)
            offset.append(capacity - room[k])
            room[k] -= n
            while first < len(room) and not room[first]:
                first += 1
        base = pieces.column("base").to_numpy()
        yield from pa.table(
            {c: pieces.column(c) for c in OUTPUT[:5]} | {"sequence_id": pa.array(base + np.array(sequence, dtype=np.int64)), "offset": pa.array(offset, pa.int64())}
        ).to_batches()

    return run


OUTPUT = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def pack(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """A row for each piece of each document: where it was cut and where it lies.

    doc_id, start (its document's ids before it), length, ids_crc32 (of its
    little-endian unsigned 32-bit ids), doc_tokens (with the end id), sequence_id,
    offset (in its sequence, without gaps from 0).

    A document is the tokenizer's ids and the end id, so a null or empty text is
    one piece of one token.  Long texts give many sequences of their own.  Rows
    that repeat, or share an id, or have none, are packed each by itself; equal
    lengths go in the order of their tasks.  An empty table gives no rows.  Other
    columns are not looked at.  A special token's string in a text is that token,
    as the tokenizer has it by default.
    """
    path = path or tokenizer_path()
    kind = docs.schema[doc_id].dataType.simpleString()
    pieces = checkpointed(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(
            _pieces(path, capacity),
            f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, class int, number long, task int",
        )
    )
    # A row for each (class, task): what the tasks before it have made, and where the class's sequences begin.
    made = pieces.groupBy("class", "task").agg(F.count("*").alias("n"))
    sizes = {r["class"]: r["n"] for r in made.groupBy("class").agg(F.sum("n").alias("n")).collect()}  # of 2 * sqrt(capacity) classes at most
    base, first = 0, {}
    for k in sorted(sizes):
        first[k] = base
        base += sizes[k] // k
    from pyspark.sql import Window

    before = Window.partitionBy("class").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    starts = made.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    by_class = docs.sparkSession.createDataFrame([(k, first[k], n // k * k) for k, n in sizes.items()], "class int, first long, full long")
    numbered = (
        pieces.join(starts, ["class", "task"])
        .join(F.broadcast(by_class), "class")
        .withColumn("number", F.col("number") + F.col("before"))
    )
    placed = numbered.where("number < full").withColumn("sequence_id", F.col("first") + F.floor(F.col("number") / F.col("class")))
    # a sequence is of one class, so of capacity pieces at most
    ahead = Window.partitionBy("sequence_id").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    whole = placed.select(*OUTPUT[:5], "sequence_id", F.coalesce(F.sum("length").over(ahead), F.lit(0)).alias("offset"))
    rest = numbered.where("number >= full").select(*OUTPUT[:5], "class", "number", F.lit(base).cast("long").alias("base"))
    rest = rest.repartition(1).mapInArrow(
        _fill_rest(capacity),
        f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
    return whole.unionByName(rest)
