"""Secret scans: known formats, and novelty against primed zstandard.

Known formats are matched by patterns.  Beyond them, a string in a sensitive
context (after words such as "password" or "token") is a candidate.  The text
around it and a dictionary of identifiers prime a zstandard compressor, and the
candidate's marginal compressed bytes are measured: what the code around it or
the dictionary explains compresses away, a random key does not.

The dictionary holds the identifiers that most sensitive contexts of the whole
corpus share, counted by Spark over all documents.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed, sliced

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", "novel"]

CONTEXT = re.compile(r"passw|passwd|pwd|secret|token|api_?key|access_?key|private_?key|credential|bearer|auth", re.I | re.A)
MIN_CHARS = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{%d,}" % MIN_CHARS)
IDENTIFIER = re.compile(r"[A-Za-z_]{3,32}")
HINTS = ("passw", "pwd", "secret", "token", "apikey", "api_key", "access", "private", "credential", "bearer", "auth")

#: Characters from a sensitive word within which a candidate begins, and characters around a candidate that prime the compressor.
REACH, AROUND = 64, 256
#: Identifiers of the dictionary, and texts that an identifier must be in.
DICTIONARY_WORDS, MIN_TEXTS = 4_096, 2
#: A candidate is reported if it costs so many bytes, and so many for each of its characters.
MIN_BYTES, MIN_RATE = 12, 0.7
#: A string of more characters is reported once, not again from each sensitive word within it.
LONG = 4_096


def known_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known formats, in order of start and then kind."""
    low = text.lower()
    found = []
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def contexts(text: str) -> list[tuple[int, int]]:
    """(start, end) of the sensitive words of a text."""
    low = text.lower()
    return [m.span() for m in CONTEXT.finditer(text)] if any(h in low for h in HINTS) else []


def candidates(text: str, known: list[tuple[int, str, int]], near: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """(start, end) of strings in sensitive contexts that no known format covers.

    A candidate has letters and digits: words alone are prose or names.  It begins
    within REACH of its sensitive word and goes on to its own end, however far.
    """
    out: dict[tuple[int, int], None] = {}
    first = stop = digit = letter = -1  # of the run of characters that was looked at last
    for _, end in near:
        for m in CANDIDATE.finditer(text, end, min(len(text), end + REACH + MIN_CHARS)):
            a = m.start()
            if not first <= a < stop:  # sensitive words within one run share its end
                first, stop = CANDIDATE.match(text, a).span()
                digit = next((k for k in range(stop - 1, a - 1, -1) if text[k].isdigit()), -1)
                letter = next((k for k in range(stop - 1, a - 1, -1) if text[k].isalpha()), -1)
            if digit < a or letter < a:
                continue
            if (a, stop) not in out and not any(x < stop and a < y for x, _, y in known):
                out[a, stop] = None
    return list(out)


class Novelty:
    """Marginal compressed bytes of a string after its surroundings, primed with identifiers."""

    def __init__(self, identifiers: list[str]):
        import zstandard

        primer = " ".join(reversed(identifiers)).encode()  # the most common last: near matches are cheapest
        given = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if len(primer) >= 8 else None
        self.compress = zstandard.ZstdCompressor(level=3, dict_data=given, write_content_size=False).compress

    def cost(self, text: str, start: int, end: int) -> int:
        around = (text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]).encode()
        own = text[start:end].encode()
        return len(self.compress(around + own)) - len(self.compress(around))

    def novel_spans(self, text: str, known: list[tuple[int, str, int]]) -> list[tuple[int, str, int]]:
        out: list[tuple[int, str, int]] = []
        for a, b in candidates(text, known, contexts(text)):
            if b - a > LONG and out and out[-1][0] < a and out[-1][2] == b:
                continue  # the end of a long string that is reported
            cost = self.cost(text, a, b)
            if cost >= MIN_BYTES and cost >= MIN_RATE * (b - a):
                out.append((a, "novel", b))
        return out


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _identifiers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Identifiers around the sensitive words of each text, with a hash of that text."""
    for batch in sliced(batches):
        words, texts = [], []
        for text in batch.column(0).to_pylist():
            if text and (near := contexts(text)):
                own: set[str] = set()
                for a, b in near:
                    own.update(m[0].lower() for m in IDENTIFIER.finditer(text, max(0, a - AROUND), min(len(text), b + AROUND)))
                words += sorted(own)
                texts += [int.from_bytes(hashlib.blake2b(text.encode(), digest_size=8).digest(), "big", signed=True)] * len(own)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(texts, pa.int64())], names=["word", "text"])


def identifier_dictionary(docs: DataFrame, text: str = "text", size: int = DICTIONARY_WORDS, min_texts: int = MIN_TEXTS) -> list[str]:
    """The identifiers that most distinct texts have in a sensitive context, ties by name.

    ``size`` bounds the dictionary, as the compressor's window does; counts are
    of all documents.  Identifiers have no digits, so keys never enter.
    """
    found = docs.select(F.col(f"`{text}`")).mapInArrow(_identifiers, "word string, text long")
    counted = checkpointed(found.groupBy("word").agg(F.countDistinct("text").alias("n")).where(F.col("n") >= min_texts))
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(size).collect()]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", identifiers: list[str] | None = None) -> DataFrame:
    """The secrets of every row: doc_id, n_assign, n_access, n_hex, n_novel, base_spans, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, in order of
    start and then kind, joined by commas.  base_spans has the known formats,
    spans has the novel strings as well.

    A null text is the empty text, which has no spans.  Whole texts are scanned
    however long; each candidate's surroundings are bounded.  Rows that repeat
    give a row each, null ids are carried along, an empty table gives no rows,
    and other columns are not looked at.
    """
    identifiers = identifier_dictionary(docs, text) if identifiers is None else identifiers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in sliced(batches):
            counts, base, spans = [], [], []
            for t in batch.column(1).to_pylist():
                known = known_spans(t or "")
                novel = novelty.novel_spans(t or "", known)
                kinds = [k for _, k, _ in known]
                counts.append([*(kinds.count(k) for k in KINDS[:3]), len(novel)])
                base.append(joined(known))
                spans.append(joined(sorted(known + novel, key=lambda x: (x[0], KINDS.index(x[1])))))
            columns = list(zip(*counts, strict=True)) or [[]] * 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(base, pa.string()), pa.array(spans, pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_novel", "base_spans", "spans"],
            )

    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"doc_id {kind}, n_assign long, n_access long, n_hex long, n_novel long, base_spans string, spans string"
    )


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]", identifiers: list[str] | None = None) -> DataFrame:
    """All rows and columns; in the text each secret, or run of secrets that overlap, is replaced by the mark.

    Where there is a column ``n_chars`` it follows the new text.  A filter in
    each task: nothing but the dictionary's counts is shuffled.
    """
    identifiers = identifier_dictionary(docs, text) if identifiers is None else identifiers
    at, size = docs.columns.index(text), docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty(identifiers)
        for batch in sliced(batches):
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size).to_pylist() if size is not None else None
            for i, t in enumerate(texts):
                known = known_spans(t or "")
                spans = sorted(known + novelty.novel_spans(t or "", known))
                if spans:
                    out, done = [], 0
                    for a, _, b in spans:
                        if a >= done:
                            out += [t[done:a], mark]
                        done = max(done, b)
                    texts[i] = "".join([*out, t[done:]])
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)
