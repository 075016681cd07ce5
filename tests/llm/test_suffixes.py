"""Repeated bytes against plain Python: whole tables, small runs, hot strings, odd rows; and the parts of the merge."""

import hashlib
import os
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import suffixes

FOLDER = "/root/testdata/sf0.001"


def plain(rows, length=50):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each row (id, text), in order of ids."""
    seen: dict = {}
    out = {}
    for d, text in sorted(rows):
        raw = (text or "").encode()
        starts = [i for i in range(len(raw) - length + 1) if seen.get(raw[i : i + length], d) < d]
        gone = bytearray(len(raw))
        for i in starts:
            gone[i : i + length] = b"\1" * length
        for i in range(len(raw) - length + 1):
            seen.setdefault(raw[i : i + length], d)
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        spans = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d] = (len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def found(frame, **options):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(frame, **options).collect()}


@pytest.fixture
def small(monkeypatch):
    """Many runs, ranges and blocks of texts."""
    for name, n in (("RUN_BYTES", 30_000), ("RANGE_BYTES", 20_000), ("SUFFIX_RUN", 2_000), ("RANGE_SUFFIXES", 1_500), ("BLOCK", 700)):
        monkeypatch.setattr(suffixes, name, n)


def test_a_whole_table(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_a_whole_table_in_small_runs(spark, small):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_a_whole_table_sorted_and_merged_a_few_strings_at_a_time(spark, small, monkeypatch):
    for name, n in (("STRINGS", 300), ("PARTS", 3), ("LARGEST_RUN", 200_000), ("LARGEST_RANGE", 100_000), ("HOT", 2)):
        monkeypatch.setattr(suffixes, name, n)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert found(docs) == plain([(r.doc_id, r.text) for r in docs.collect()])


def test_pieces_for_each_byte_do_not_grow_with_the_input():
    def pieces(size):
        return suffixes.parts(size, suffixes.RUN_BYTES, suffixes.LARGEST_RUN) * suffixes.parts(size, suffixes.RANGE_BYTES, suffixes.LARGEST_RANGE) / size

    small = pieces(170_000_000)
    assert all(pieces(size) < 2 * small for size in (860_000_000, 1_700_000_000, 10_200_000_000))  # 58 times for the last where runs and ranges have one size


def test_groups_have_whole_ranges():
    part = np.random.default_rng(5).integers(0, 9, 1_000) ** 2
    groups = list(suffixes.groups_of(part, 150))
    assert sorted(np.concatenate(groups).tolist()) == list(range(1_000)) and len(groups) > 3
    seen: set = set()
    for g in groups:
        own = set(part[g].tolist())
        assert not own & seen and (len(g) <= 150 or len(own) == 1)
        seen |= own
    assert not list(suffixes.groups_of(part[:0], 150))


@pytest.mark.parametrize("length", [30, 50, 100])
def test_hot_strings_and_ends_of_passages(spark, small, length):
    rng = random.Random(length)
    word = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    phrase, passage = word(45), word(400)
    rows = []
    for d in range(400):
        a = rng.randrange(300)
        rows.append((d, word(rng.randrange(90)) + phrase + rng.choice(["same after " * 5, word(60)]) + passage[a : a + rng.randrange(100)] + word(20)))
    rows += [(d, rows[d - 400][1]) for d in range(400, 440)] + [(440, "z" * 3_000), (441, "z" * 2_000 + passage), (442, "ab" * 1_500)]
    rng.shuffle(rows)
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert found(frame, length=length) == plain(rows, length)


def test_odd_rows(spark):
    text = "a passage that is shared by two documents and is well over fifty bytes"
    rows = [(1, text), (1, text), (2, None), (3, ""), (None, f"x {text}"), (4, f"y {text}"), (5, text[:49])]
    frame = spark.createDataFrame([(*r, 7, "c") for r in rows], "doc_id long, text string, doc int, run string")
    got = sorted(((r.doc_id or 99), r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(frame).collect())
    n = len(text)
    assert got == [(1, n, 0), (1, n, 0), (2, 0, 0), (3, 0, 0), (4, n + 2, n), (5, 49, 0), (99, n + 2, n + 1)]  # the last shares a space before it too
    assert suffixes.remove_repeats(frame.limit(0)).count() == 0
    kept = {r.doc_id: bytes(r.kept) for r in suffixes.remove_repeats(frame, with_text=True).collect()}
    assert kept[4] == b"y "


def test_runs_decode_and_merge_in_order():
    rng = random.Random(1)
    whole, runs = [], []
    for _ in range(7):
        rows = sorted(bytes([rng.choice(b"ab") for _ in range(rng.choice([3, 6]))]) + b"\0" for _ in range(rng.randrange(60)))
        rows = [r.ljust(7, b"\1") for r in rows]  # of one size, so none is a prefix of another
        rows.sort()
        whole += rows
        if rows:
            lcp, rest = suffixes.front_code(np.frombuffer(b"".join(rows), dtype=np.uint8).reshape(-1, 7), np.full(len(rows), 7))
            assert [r for _, r in suffixes.decode_run(lcp.tolist(), [7] * len(rows), rest)] == rows
            runs.append((lcp.tolist(), [7] * len(rows), rest))
    merged = list(suffixes.merge_runs([suffixes.decode_run(*r) for r in runs]))
    assert [r for _, _, r in merged] == sorted(whole)
    before = b""
    for _, p, row in merged:
        assert p == len(os.path.commonprefix([before, row]))
        before = row


def test_keys_spell_their_segments():
    raw = bytes(random.Random(2).randrange(97, 101) for _ in range(5_000))
    h, anchor, lo, n = suffixes.segments(raw, np.array([0, 3_000]), np.array([3_000, 5_000]))
    assert n.sum() == 3_000 - 49 + 2_000 - 49
    rows, sizes = suffixes.segment_keys(np.frombuffer(raw, dtype=np.uint8), anchor, lo, n, suffixes.LENGTH, suffixes.KMER)
    for row, size, a, w in zip(rows, sizes.tolist(), lo.tolist(), n.tolist(), strict=True):
        assert suffixes.segment_of(row[:size].tobytes(), suffixes.KMER) == raw[a : a + w + suffixes.LENGTH - 1]


def blobs_of(runs):
    return pa.concat_tables([suffixes.hash_blobs(r, own, 1) for r, own in enumerate(runs)])


def test_shared_hashes_are_those_of_two_runs():
    rng = np.random.default_rng(3)
    runs = [rng.integers(0, 3_000, n).astype(np.uint64) << np.uint64(30) for n in (1, 500, 40, 900, 2)]
    got = suffixes.shared_hashes(blobs_of(runs))
    every = [set(x.tolist()) for x in runs]
    for r, bits, n in zip(*(got.column(c).to_pylist() for c in ("run", "bits", "n")), strict=True):
        flags = np.unpackbits(np.frombuffer(bits, dtype=np.uint8), count=n).tolist()
        assert flags == [any(h in other for k, other in enumerate(every) if k != r) for h in sorted(every[r])]


def test_shared_hashes_of_many_runs_take_the_work_of_the_range():
    hashes = np.random.default_rng(4).integers(0, 1 << 48, 100_000).astype(np.uint64)

    def seconds(n_runs):
        blobs = blobs_of(2 * np.array_split(hashes, n_runs // 2))
        each = []
        for _ in range(3):
            began = time.process_time()
            suffixes.shared_hashes(blobs)
            each.append(time.process_time() - began)
        return min(each)

    assert seconds(400) < 5 * seconds(4)  # 9.9 times where all shared hashes were gone through again for each run
