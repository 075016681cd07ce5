"""Packed pieces against the tokenizer's own call, and the shape of their sequences."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lodestar.llm import packing

FOLDER = "/root/testdata/sf0.001"


def check(rows, pieces, capacity=packing.CAPACITY):
    """Every piece of every row; rows: (id, text), ids distinct."""
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    of, held = {}, {}
    for p in pieces:
        of.setdefault(p.doc_id, []).append(p)
        held.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert of.keys() == {d for d, _ in rows}
    for d, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], dtype="<u4")
        at = 0
        for p in sorted(of[d], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids))
            at += p.length
            assert p.ids_crc32 == zlib.crc32(ids[p.start : at].tobytes())
        assert at == len(ids)
    for own in held.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return held


def test_all_documents_of_a_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    pieces = packing.pack(docs).collect()
    held = check([(r.doc_id, r.text) for r in docs.collect()], pieces)
    assert len(pieces) < 2.2 * docs.count()
    assert sum(p.length for p in pieces) > 0.95 * packing.CAPACITY * len(held)


def test_odd_texts(spark):
    texts = ["hello <|endoftext|> x", "<|endoftext|>", None, "", " ", "a  b", "tabs\t and\n\n lines ", "\0 nul", " end ", "é ü 漢字 🙂 　x", "one two " * 30_000, "same", "same", "x" * 5_000, " <|endoftext|>", "a <|endof text|> b"]
    rows = list(enumerate(texts))
    frame = spark.createDataFrame([(d, t, "clash", 3) for d, t in rows], "doc_id long, text string, `class` string, number int")
    check(rows, packing.pack(frame).collect())


def test_rows_without_ids_empty_tables_and_repeats(spark):
    kind = "doc_id long, text string"
    assert packing.pack(spark.createDataFrame([], kind)).count() == 0
    rows = [(None, "a b c"), (None, "a b c"), (4, "a b c"), (4, None)]
    got = packing.pack(spark.createDataFrame(rows, kind)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, _ in rows)
    assert len({r.sequence_id for r in got}) == 1
    assert sorted(r.offset for r in got)[0] == 0


@pytest.mark.parametrize("n", [1, 15, 16, 127, 128, 129, 500, 683, 1023, 1024, 1025, 1365, 2047, 2048, 2049, 5000])
def test_pieces_cover_a_document_and_fit_their_class(n):
    at = 0
    for start, length, k in packing.cut(n):
        assert start == at and length >= min(n % packing.CAPACITY or n, packing.LEAST)
        assert packing.CAPACITY // (k + 1) < length <= packing.CAPACITY // k
        at += length
    assert at == n


def test_white_space_nulls_and_slices_of_a_batch():
    rng = random.Random(9)
    odd = ["", None, " ", "<|endoftext|>", "a <|endoftext|>b", "\0"]
    texts = [*odd, *("".join(rng.choice(["a", "b", "Zé", "漢", "🙂", "7", ".", "'s", " ", " ", " ", "  ", "\n", "\t", "\x1c", "\x85", "\u2028", "\u3000", "\0"][: 11 if n % 2 else 19]) for _ in range(n % 23)) for n in range(900))]
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    encoder = packing.WordEncoder(packing.tokenizer_path(), max_words=40)
    batch = pa.array(["left out", *texts, None])
    got: list = []
    for first, part in packing.grouped(batch.slice(1, len(texts)), 700):
        assert first == len(got)
        got += encoder(part)
    assert [np.frombuffer(x, dtype="<u4").tolist() for x in got] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_a_word_is_looked_up_once_for_all_texts_of_a_group():
    class Counted(dict):
        n = 0

        def get(self, *a):
            self.n += 1
            return super().get(*a)

    encoder = packing.WordEncoder(packing.tokenizer_path())
    encoder.words = Counted(encoder.words)
    encoder(pa.array(["one two three " * 1_000 + "end", "two one end"] * 5))
    assert encoder.words.n <= 8  # 30,065 where each word of each text is
