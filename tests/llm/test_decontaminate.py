"""Items found within their budget of edits, against the distance alone."""

import random

import pytest

from lodestar.llm import decontaminate

RATE = decontaminate.ERROR_RATE


def _edited(rng, item, n):
    """n characters of an item changed, evenly spaced, which no alignment saves."""
    out = list(item)
    for k in range(n):
        out[(2 * k + 1) * len(item) // (2 * n)] = "#"
    return "".join(out)


@pytest.mark.parametrize(("n", "edits"), [(20, 2), (23, 2), (81, 8), (110, 11), (233, 23)])
def test_the_budget_is_the_stated_share(n, edits):
    rng = random.Random(n)
    item = "".join(rng.choice("abcdefghij") for _ in range(n))
    matcher = decontaminate.Matcher([("x", item)], RATE)
    around = "".join(rng.choice("klmnopq") for _ in range(300))
    assert matcher(around + _edited(rng, item, edits) + around) == [("x", edits)]
    assert matcher(around + _edited(rng, item, edits + 1) + around) == []


def test_as_the_distance_over_whole_documents():
    rng = random.Random(5)
    words = ["the", "of", "and", "river", "stone", "a", "in", "bridge", "old", "two"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(k, text(rng.randint(2, 40))) for k in range(60)]
    matcher = decontaminate.Matcher(items, RATE)
    n_found = 0
    for _ in range(180):
        changed = list(items[rng.randrange(60)][1])
        for _ in range(rng.randint(0, len(changed) // 8)):
            at = rng.randrange(len(changed))
            changed[at : at + rng.randint(0, 1)] = rng.choice("abc ")
        doc = decontaminate.normalise(text(30) + " " + "".join(changed) + " " + text(30))
        expected = {k: best[0] for k, item in items if len(item) >= decontaminate.MIN_CHARS and (best := decontaminate.best_match(item, doc, decontaminate.error_budget(len(item))))}
        assert dict(matcher(doc)) == expected
        n_found += len(expected)
    assert n_found > 100


def test_whole_tables_as_the_distance_alone(spark):
    folder = "/root/testdata/sf0.001"
    items = spark.read.parquet(f"{folder}/benchmark.parquet").limit(20)
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("length(text) < 4000")
    wanted = {r.item_id: decontaminate.normalise(r.text) for r in items.collect()}
    expected = set()
    for r in docs.collect():
        doc = decontaminate.normalise(r.text)
        for k, item in wanted.items():
            best = decontaminate.best_match(item, doc, decontaminate.error_budget(len(item)))
            if best:
                expected.add((r.doc_id, k, best[0]))
    got = decontaminate.matches(docs, items)
    assert {tuple(r) for r in got.collect()} == expected
    small = decontaminate.matches(docs, items, max_block_chars=300)  # several blocks
    assert {tuple(r) for r in small.collect()} == expected
    kept = decontaminate.remove_contaminated(docs, items, max_block_chars=300)
    assert {r.doc_id for r in kept.collect()} == {r.doc_id for r in docs.collect()} - {d for d, _, _ in expected}
    assert kept.schema == docs.schema


def test_recall_at_the_stated_rate(spark):
    rng = random.Random(9)
    text = lambda n: " ".join("".join(rng.choice("abcdefghijklmnopqrst") for _ in range(rng.randint(2, 9))) for _ in range(n))
    items = [(k, text(25)) for k in range(80)]
    rows = []
    for k, item in items:
        edited = list(item)
        for at in rng.sample(range(len(item)), int(RATE * len(item)) - 1):
            edited[at] = rng.choice(["", "x", edited[at] + "y"])
        rows += [(k, text(40) + " " + "".join(edited) + " " + text(40)), (1_000 + k, text(100))]
    found = decontaminate.matches(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(k, k) for k, _ in items}


def test_odd_rows(spark):
    item = "a benchmark item of some length"
    bench = spark.createDataFrame([(1, item), (1, item), (2, item), (3, "a"), (4, ""), (5, None), (None, "another item that is long enough")], "item_id long, text string")
    rows = [(7, f"x {item} y"), (7, f"x {item} y"), (None, item.upper()), (8, None), (9, ""), (10, "so a b " * 100_000 + item), (11, "clean text")]
    docs = spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, item_id string")
    got = sorted(((r.doc_id or -1), r.item_id) for r in decontaminate.matches(docs, bench).collect())
    assert got == sorted([(7, 1), (7, 2)] * 2 + [(-1, 1), (-1, 2), (10, 1), (10, 2)])
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [8, 9, 11]
    none = docs.limit(0)
    assert decontaminate.matches(none, bench).count() == 0 and decontaminate.remove_contaminated(none, bench).count() == 0
    assert decontaminate.matches(docs, bench.limit(0)).count() == 0
    assert decontaminate.remove_contaminated(docs, bench.limit(0)).count() == len(rows)
    assert sorted((r.item_id for r in decontaminate.left_out(bench).collect())) == [3, 4, 5]
