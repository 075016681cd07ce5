"""The results that the contracts fix, against plain Python over all of a small table."""

import hashlib
import re
from collections import Counter

import pytest
import xxhash

from lodestar.llm import packing, queries, sharding, simhash, suffixes

FOLDER = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "text").collect()
    return {r.doc_id: r.text or "" for r in rows}


def test_shards_are_even_to_within_one_slot():
    owned = Counter(sharding.fill_table([f"s{k}" for k in range(7)], 1009).tolist())
    assert max(owned.values()) - min(owned.values()) <= 1


def test_quality_base(spark, docs):
    got = {r.doc_id: r for r in queries.op2_quality_rules(spark, FOLDER).collect()}
    assert got.keys() == docs.keys()
    for d, text in docs.items():
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        count = Counter(windows)
        inside = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(5)}
        lines = [x for x in text.split("\n") if WORD.search(x)]
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), len(inside))
        assert r.base_failed == (len(words) < 10 or 100 * len(inside) > 20 * len(words))
        assert not (r.base_failed and r.kept)


def _fingerprint(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(len(words) - 2, 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_simhash_components(spark, docs):
    prints = {d: _fingerprint(t) for d, t in docs.items()}
    parent = {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a in sorted(docs):
        for b in docs:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= simhash.THRESHOLD and root(a) != root(b):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_near_dedup(spark, FOLDER).collect()}
    assert got == {d: (f"{prints[d]:016x}", root(d)) for d in docs}


def test_repeated_bytes(spark):
    texts = ["x" * 60, None, "", "a passage that is shared by two documents and is well over fifty bytes, é", "then a passage that is shared by two documents and is well over fifty bytes, é too", "x" * 200, "x" * 49]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    seen, expected = set(), {}
    for d, text in enumerate(texts):
        raw = (text or "").encode()
        starts = [i for i in range(len(raw) - 49) if raw[i : i + 50] in seen]
        gone = {i + k for i in starts for k in range(50)}
        seen |= {raw[i : i + 50] for i in range(len(raw) - 49)}
        spans = sum(1 for i in gone if i - 1 not in gone)
        expected[d] = (len(raw), len(gone), spans, hashlib.sha256(bytes(b for i, b in enumerate(raw) if i not in gone)).hexdigest())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffixes.remove_repeats(rows).collect()}
    assert got == expected


def test_packing_keeps_every_id_once_without_gaps(spark, docs):
    pieces = queries.op9_packing(spark, FOLDER).collect()
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
        by_sequence.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert by_doc.keys() == docs.keys()
    for own in by_doc.values():
        at = 0
        for start, length, _ in sorted(own):
            assert start == at
            at += length
        assert at == own[0][2]
    for own in by_sequence.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
