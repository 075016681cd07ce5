"""Links of fingerprints by brute force, near copies that are planted, and odd rows."""

import random

import numpy as np
import pytest

from lodestar.llm import simhash
from lodestar.llm.components import connected_components

KIND = "doc_id long, text string"


def _groups(pairs):
    parent: dict = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[max(root(a), root(b))] = min(root(a), root(b))
    return {x: root(x) for x in parent}


@pytest.mark.parametrize(("home", "every"), [(4_096, 65_536), (3, 5)])
def test_links_join_what_brute_force_joins(spark, home, every):
    rng = random.Random(home)
    prints = {rng.getrandbits(64) for _ in range(200)}
    for _ in range(300):  # near ones of near ones, and many around one
        x = rng.choice(sorted(prints)[:40])
        for b in rng.sample(range(64), rng.randint(1, 4)):
            x ^= 1 << b
        prints.add(x)
    signed = lambda x: x - (x >> 63 << 64)
    frame = spark.createDataFrame([(signed(x),) for x in prints], "fp long")
    links = simhash.link_fingerprints(frame, home_block=home, all_block=every)
    got = {r.node: r.label for r in connected_components(links).collect()}
    near = [(signed(a), signed(b)) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= 3]
    assert got == _groups(near)


def test_anchors_cover_all_near_halves():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**32, 500)
    for bit in range(32):
        y = x ^ (1 << bit)
        row, anchor, home = simhash.anchors_of(x)
        other, anchors, _ = simhash.anchors_of(y)
        own = dict(zip(row[home].tolist(), anchor[home].tolist(), strict=True))
        near = set(zip(other.tolist(), anchors.tolist(), strict=True))
        assert all((i, own[i]) in near for i in range(500))


def _planted(rng):
    vocabulary = [f"word{k}" for k in range(4_000)]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    rows, pairs = [], []
    for k in range(150):
        words = some(rng.randint(80, 600))
        near = list(words)
        for at in rng.sample(range(len(near)), max(1, len(near) // 60)):  # one word in sixty: five-word shingles stay above 0.8
            near[at] = rng.choice(vocabulary)
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(near))]
        pairs.append((2 * k, 2 * k + 1))
    rows += [(1_000 + k, " ".join(some(300))) for k in range(100)]
    return rows, pairs


def test_near_copies_are_caught_and_others_stay(spark):
    rows, pairs = _planted(random.Random(2))
    alike = {d: simhash.shingles(t) for d, t in rows}
    wanted = [p for p in pairs if len(alike[p[0]] & alike[p[1]]) >= 0.8 * len(alike[p[0]] | alike[p[1]])]
    kept = {r.doc_id for r in simhash.keep_one(spark.createDataFrame(rows, KIND)).collect()}
    assert {d for d, _ in rows if d >= 1_000 or d % 2 == 0} <= kept
    assert len(wanted) > 120
    assert sum(b not in kept for _, b in wanted) >= 0.9 * len(wanted)


def test_texts_of_the_same_words_are_held_apart(spark):
    rng = random.Random(4)
    words = [f"w{k}" for k in range(200)]
    rows = []
    for k in range(20):  # equal fingerprints of words, other shingles
        rng.shuffle(words)
        rows.append((k, " ".join(words)))
    assert simhash.keep_one(spark.createDataFrame(rows, KIND)).count() == 20


def test_odd_rows(spark):
    text = "a text of some words that is here more than once in this table"
    rows = [(5, text), (5, text), (3, text), (None, text), (8, None), (9, ""), (7, "x y z " * 200_000), (6, "other words in here, not alike at all to what others say")]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], KIND + ", `__key` int, fp string")
    kept = simhash.keep_one(frame)
    assert kept.columns == frame.columns
    assert sorted(r.doc_id for r in kept.collect()) == [3, 6, 7, 8]
    assert simhash.keep_one(frame.limit(0)).count() == 0
    got = simhash.components(frame).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (5, 3, None)} == {3}
    assert {(r.fingerprint, r.component_id) for r in got if r.doc_id in (8, 9)} == {("0" * 16, 8)}
    assert simhash.components(frame.limit(0)).count() == 0
