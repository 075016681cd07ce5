"""Rows that share an id or have none: each text is judged for itself."""

import hashlib
import random

from pyspark.sql import functions as F

from lodestar.llm import simhash, suffixes


def _text(rng, n=30):
    return " ".join("".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(n))


def test_no_unlike_text_goes_for_its_id(spark):
    rng = random.Random(1)
    own = [(None if k % 2 else 7, _text(rng)) for k in range(2_000)]
    copies = [(None, own[0][1]), (None, own[1][1]), (3, own[2][1]), own[4], own[5]]
    kept = simhash.keep_one(spark.createDataFrame(own + copies, "doc_id long, text string")).collect()
    expected = [(3, t) if k == 2 else (d, t) for k, (d, t) in enumerate(own)]
    assert sorted((r.doc_id or -1, r.text) for r in kept) == sorted((d or -1, t) for d, t in expected)


def test_repeated_bytes_of_each_text(spark):
    rng = random.Random(2)
    first = [(1, _text(rng, 60))]
    raw = first[0][1]
    rows = list(first)
    for k in range(2_000):  # of one length, each with a passage of its own place and size
        at, n = rng.randrange(0, 200), rng.randrange(60, 120)
        own = _text(rng)
        rows.append((None if k % 2 else 7, (own[:40] + "|" + raw[at : at + n] + "|" + _text(rng))[:220]))
    seen = {raw[i : i + 50] for i in range(len(raw) - 49)}
    sevens = {t[i : i + 50] for d, t in rows if d == 7 for i in range(len(t) - 49)}
    expected = []
    for d, text in rows:
        before = set() if d == 1 else seen if d == 7 else seen | sevens
        gone = {i + j for i in range(len(text) - 49) if text[i : i + 50] in before for j in range(50)}
        expected.append((d or -1, len(text), len(gone), hashlib.sha256("".join(c for i, c in enumerate(text) if i not in gone).encode()).hexdigest()))
    got = suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(4, F.xxhash64("text")))
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_removed, r.kept_sha256) for r in got.collect()) == sorted(expected)
