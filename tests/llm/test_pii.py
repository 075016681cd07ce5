"""Base spans by the plain patterns, time on long runs, and planted contexts."""

import hashlib
import random
import re
import time

from lodestar.llm import pii, queries

FOLDER = "/root/testdata/sf0.001"


def _luhn(d):
    return sum(x if k % 2 == 0 else 2 * x - 9 * (x > 4) for k, x in enumerate(map(int, reversed(d)))) % 10 == 0


def plain_spans(text):
    digits = lambda s: re.sub(r"[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all((p.lstrip("0") or "0").isdigit() and len(p.lstrip("0")) < 4 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text) if 14 <= len(digits(m[0])) <= 19 and _luhn(digits(m[0]))]
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 10 <= len(digits(m[0])) <= 15]
    return [(a, pii.KINDS[k], b) for a, k, b in sorted(out)]


def test_base_of_a_whole_table(spark):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op7_personal_data(spark, FOLDER).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        spans = plain_spans(text)
        kinds = [k for _, k, _ in spans]
        r = got[d]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [kinds.count(k) for k in pii.KINDS]
        assert r.base_sha256 == hashlib.sha256(pii.joined(spans).encode()).hexdigest()
        assert set(pii.joined(spans).split(",")) <= set(r.spans.split(",")) or not spans


def test_spans_of_random_strings():
    rng = random.Random(4)
    for _ in range(4_000):
        text = "".join(rng.choice("0123456789....@@ +-()ab5") for _ in range(rng.randint(1, 60)))
        assert pii.known_spans(text) == plain_spans(text), text


def test_long_runs_take_linear_time():
    for text in ("1" * 1_000_000, "1." * 500_000, "0" * 6_000 + ".0.0.1", "a" * 1_000_000, "a@" * 300_000, "+1" * 300_000, "+1" + "(" * 500_000, "9.9.9.x" * 100_000, "1 " * 400_000):
        start = time.perf_counter()
        pii.known_spans(text)
        pii.candidates(text, [])
        assert time.perf_counter() - start < 5
    assert pii.known_spans("0" * 6_000 + ".0.0.1")[0][1] == "ip"


def _planted(rng):
    """(rows, planted spans by id): known phones teach contexts in which unknown formats stand."""
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    rows, planted = [], {}
    for k in range(200):
        rows.append((k, f"{word()} {word()} reach me under +49 {number(3)} {number(7)} any time {word()}"))
    for k in range(200, 220):
        text, own = f"{word()} reach me under ", f"{number(3)}-{number(3)}-{number(4)}"
        rows.append((k, f"{text}{own} any time {word()}"))
        planted[k] = f"context_phone:{len(text)}:{len(text) + len(own)}"
    for k in range(220, 420):  # the same shapes in other contexts
        rows.append((k, f"{word()} part number {number(3)}-{number(3)}-{number(4)} in stock {word()}"))
    return rows, planted


def test_contexts_lead_to_unseen_identifiers(spark):
    rows, planted = _planted(random.Random(1))
    got = {r.doc_id: r.spans for r in pii.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {d: s for d, s in got.items() if "context" in s} == planted


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "a@b.cc"), (None, "a@b.cc"), (3, "x " * 300_000 + "a@b.cc")]
    frame = spark.createDataFrame([(*r, 1, "c") for r in rows], "doc_id long, text string, row int, places string")
    got = sorted(((r.doc_id or -1), r.n_email, r.base_spans) for r in pii.scan(frame).collect())
    assert got == [(-1, 1, "email:0:6"), (-1, 1, "email:0:6"), (1, 0, ""), (2, 0, ""), (3, 1, "email:600000:600006")]
    assert pii.scan(frame.limit(0)).count() == 0
