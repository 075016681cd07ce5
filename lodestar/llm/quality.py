"""Quality rules: text statistics of each document, and line frequency across documents.

A line that many documents of one host share is boilerplate.  Lines are
normalised and hashed, Spark counts the distinct documents of each (host, line),
lines above the limit are removed from their documents, and a document that is
depleted by this is rejected.

Exact copies of a document count once, as a document is the hash of its text, both
for a line and for the host; documents that differ count each, near copies too.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed, sliced

SPACES = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
#: A line is boilerplate if more than so many distinct documents of its host hold it, and more than this share of them.
MIN_DOCS = 10
MAX_SHARE = 0.08
#: A document is depleted if less than this share of its words, or fewer than MIN_WORDS, remain.
MIN_REMAINING = 0.3
#: The boilerplate lines go to every task if there are no more than so many (16 bytes each); else a join brings them.
MAX_BROADCAST_LINES = 500_000

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a window of so many words found twice or more in the list."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n > 100_000:  # arrays, as tuples would take a hundred bytes each
        codes: dict[bytes, int] = {}
        ids = np.fromiter((codes.setdefault(w, len(codes)) for w in words), dtype=np.int64, count=len(words))
        key = ids[:n]
        for k in range(1, window):
            _, key = np.unique(key * len(codes) + ids[k : k + n], return_inverse=True)
        again = np.bincount(key)[key] > 1
    else:
        keys = list(zip(*(words[k : k + n] for k in range(window)), strict=True))
        if len(set(keys)) == n:
            return 0
        count = Counter(keys)
        again = np.fromiter((count[k] > 1 for k in keys), dtype=bool, count=n)
    inside = np.zeros(len(words), dtype=bool)
    for k in range(window):
        inside[k : k + n] |= again
    return int(inside.sum())


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """Words, code points in words, symbols, repeated lines, and words in repeated windows."""
    raw = (text or "").encode()
    words = raw.split()  # of bytes: at the six ASCII white spaces only
    spaces = len(raw) - len(raw.translate(None, SPACES))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (
        len(words),
        len(text or "") - spaces,
        len(raw) - len(raw.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(words),
    )


def line_hashes(text: str | None) -> list[tuple[int, int]]:
    """(hash, words) of each line of a text, (0, 0) for lines without a word.

    White space is made single spaces, ASCII letters are made small.
    """
    out = []
    for line in (text or "").encode().split(b"\n"):
        words = line.split()
        out.append((xxhash.xxh64_intdigest(b" ".join(words).lower()) - 2**63 if words else 0, len(words)))
    return out


def boilerplate_lines(docs: DataFrame, min_docs: int = MIN_DOCS, max_share: float = MAX_SHARE) -> DataFrame:
    """(host, line, n_docs) of the lines above the limits; docs has (host, text).

    Distinct documents are counted in two steps, (host, line, hash of the text)
    first, so that a line that a third of all documents hold is counted in many tasks.
    """
    keyed = docs.select("host", "text", F.xxhash64("text").alias("key"))
    lines = keyed.mapInArrow(_keyed_lines, "host string, line long, key long")
    counted = lines.groupBy("host", "line").agg(F.countDistinct("key").alias("n_docs"))
    total = keyed.groupBy("host").agg(F.countDistinct("key").alias("n_host"))
    return (
        counted.where(F.col("n_docs") > min_docs)
        .join(total, "host")
        .where(F.col("n_docs") > max_share * F.col("n_host"))
        .select("host", "line", "n_docs")
    )


def _verdicts(flagged: dict[str, set[int]] | None, min_remaining: float, with_text: bool):
    """A mapper from (doc_id, host, text, n_chars[, lines]) to the statistics and the verdict.

    flagged: the boilerplate lines by host; where None, each row brings its own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            hosts = batch.column(1).to_pylist()
            texts = batch.column(2).to_pylist()
            own = batch.column(3).to_pylist() if flagged is None else None
            out = []
            for i, text in enumerate(texts):
                stats = text_stats(text)
                n = stats[0]
                failed = n < MIN_WORDS or 100 * stats[4] > MAX_REPEAT_PERCENT * n
                bad = flagged.get(hosts[i]) if own is None else set(own[i] or ())
                gone, lines = 0, 0
                cleaned = text
                if bad:
                    hashes = line_hashes(text)
                    drop = [k for k, (h, w) in enumerate(hashes) if w and h in bad]
                    if drop:
                        gone, lines = sum(hashes[k][1] for k in drop), len(drop)
                        if with_text:
                            at = set(drop)
                            cleaned = "\n".join(x for k, x in enumerate(text.split("\n")) if k not in at)
                depleted = n - gone < MIN_WORDS or n - gone < min_remaining * n
                row = (*stats, failed, not failed and not depleted, lines, gone)
                out.append((*row, cleaned) if with_text else row)
            columns = list(zip(*out, strict=True)) or [[]] * (9 + with_text)
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.int64()] * 2 + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))],
                names=["doc", *STATS, "base_failed", "kept", "n_removed_lines", "n_removed_words", *["cleaned"] * with_text],
            )

    return run


SCHEMA = ", ".join(f"{c} long" for c in STATS) + ", base_failed boolean, kept boolean, n_removed_lines long, n_removed_words long"


def judge(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    host: str = "source",
    min_docs: int = MIN_DOCS,
    max_share: float = MAX_SHARE,
    min_remaining: float = MIN_REMAINING,
    max_broadcast: int = MAX_BROADCAST_LINES,
    carry: list[str] | None = None,
) -> DataFrame:
    """The statistics and the verdict of every row, and with ``carry`` its text without boilerplate lines.

    Columns: the id (as ``doc_id``), n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, kept, n_removed_lines, n_removed_words; with
    ``carry`` also ``cleaned`` and the columns named there.

    A null text has no words and fails; a null host is the host "".  Rows that
    repeat are judged alike and stay, one result row each.  A null id is kept
    as it is.  An empty table gives no rows.  Other columns are not looked at.
    """
    struct = F.struct(*[F.col(f"`{c}`") for c in [doc_id, *(carry or [])]])
    rows = docs.select(
        struct.alias("doc"), F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("")).alias("host"), F.col(f"`{text}`").alias("text")
    )
    lines = checkpointed(boilerplate_lines(rows, min_docs, max_share))
    flagged: dict[str, set[int]] | None = None
    if lines.count() <= max_broadcast:
        flagged = {}
        for r in lines.toLocalIterator():
            flagged.setdefault(r.host, set()).add(r.line)
    else:  # each row gets its boilerplate lines by a join on (host, line)
        keyed = rows.withColumn("key", F.xxhash64(F.to_json("doc"), "host", "text"))
        held = keyed.select("host", "text", "key").mapInArrow(_keyed_lines, "host string, line long, key long")
        brought = held.join(lines, ["host", "line"]).groupBy("key").agg(F.collect_set("line").alias("lines"))
        rows = keyed.join(brought, "key", "left").select("doc", "host", "text", "lines")
    doc_type = rows.schema["doc"].dataType.simpleString()
    schema = f"doc {doc_type}, {SCHEMA}" + ", cleaned string" * bool(carry)
    judged = rows.mapInArrow(_verdicts(flagged, min_remaining, bool(carry)), schema)
    return judged.select("doc.*", *judged.columns[1:]).withColumnRenamed(doc_id, "doc_id") if carry is None else judged


def _keyed_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        rows, hashes = [], []
        for i, text in enumerate(batch.column(1).to_pylist()):
            own = {h for h, n in line_hashes(text) if n}
            rows += [i] * len(own)
            hashes += own
        at = pa.array(rows, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(at), pa.array(hashes, pa.int64()), batch.column(2).take(at)], names=["host", "line", "key"]
        )


def clean(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", **limits) -> DataFrame:
    """The rows that are kept, all columns, their text without boilerplate lines.

    Where there is a column ``n_chars`` it follows the new text.
    """
    judged = judge(docs, doc_id, text, host, carry=[c for c in docs.columns if c not in (doc_id, text)], **limits)
    kept = judged.where("kept")
    out = {c: F.col(f"doc.`{c}`") for c in docs.columns if c != text} | {text: F.col("cleaned")}
    if "n_chars" in out:
        changed = F.col("n_removed_lines") > 0
        out["n_chars"] = F.when(changed, F.length("cleaned")).otherwise(out["n_chars"]).cast(docs.schema["n_chars"].dataType)
    return kept.select(*[out[c].alias(c) for c in docs.columns])
