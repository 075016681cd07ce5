"""Long strings in sensitive contexts."""

import base64
import hashlib
import random
import re

from lodestar.llm import queries, secrets


def _blob(n):
    return base64.b64encode(random.Random(7).randbytes(n)).decode().rstrip("=")


def test_a_long_string_is_reported_to_its_end():
    blob = _blob(9_000)
    text = f"the bearer, auth and private_key: {blob} and more text"
    at = text.index(blob)
    assert secrets.Novelty([]).novel_spans(text, []) == [(at, "novel", at + len(blob))]


def test_nothing_of_a_long_string_is_left(spark):
    blob = _blob(6_000)
    rows = spark.createDataFrame([(f"private_key {blob} end",)], "text string")
    assert [r.text for r in secrets.redact(rows, identifiers=[]).collect()] == ["private_key [SECRET] end"]


def test_a_string_begins_within_reach():
    key = _blob(30)
    for gap, found in ((secrets.REACH, True), (secrets.REACH + 1, False)):
        assert bool(secrets.candidates("token" + " " * gap + key, [], [(0, 5)])) == found


def test_many_words_in_one_string_take_linear_time():
    text = "password " + "auth1" * 50_000
    assert len(secrets.candidates(text, [], secrets.contexts(text))) > 40_000


def plain_spans(text):
    out = [(m.start(), 0, m.end()) for m in re.finditer(r"""(?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[1]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 24]
    return [(a, secrets.KINDS[k], b) for a, k, b in sorted(out)]


def test_base_of_a_whole_table(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op3_secret_scan(spark, folder).collect()}
    assert got.keys() == texts.keys()
    for d, text in texts.items():
        spans = plain_spans(text)
        kinds = [k for _, k, _ in spans]
        r = got[d]
        assert [r.n_assign, r.n_access, r.n_hex] == [kinds.count(k) for k in secrets.KINDS[:3]]
        assert r.base_sha256 == hashlib.sha256(secrets.joined(spans).encode()).hexdigest()
        assert set(secrets.joined(spans).split(",")) <= set(r.spans.split(",")) or not spans


def test_spans_of_random_strings():
    rng = random.Random(4)
    parts = ["password", "TOKEN", "ſecret", "api_key", "apiKEY", '"', "'", " ", ":", "=", "abc", "0123456789abcdef", "AKIA", "ABCDEFGH12345678", "é", "\n"]
    for _ in range(4_000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(1, 20)))
        assert secrets.known_spans(text) == plain_spans(text), text


def test_random_keys_are_novel_and_names_are_not(spark):
    rng = random.Random(3)
    names = ["connection_timeout_seconds", "retry_policy_v2_default", "session_handler2_factory", "max_open_files4_limit"]
    rows, planted = [], set()
    for k in range(150):
        rows.append((k, f"the auth header uses {names[k % 4]} as before, and {names[(k + 1) % 4]} too"))
    for k in range(150, 190):
        key = base64.urlsafe_b64encode(rng.randbytes(30)).decode().replace("-", "x").replace("_", "y")
        text = f"send Authorization Bearer {key} with {names[k % 4]}"
        rows.append((k, text))
        planted.add((k, f"novel:{text.index(key)}:{text.index(key) + len(key)}"))
    rows += [(k, f"no context here {base64.b64encode(rng.randbytes(30)).decode()}") for k in range(190, 200)]
    got = {(r.doc_id, s) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect() for s in r.spans.split(",") if s}
    assert len(got & planted) >= 0.95 * len(planted)
    assert len(got - planted) <= 2


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "token=abcdef1"), (None, "token=abcdef1"), (3, "x " * 300_000 + "token=abcdef1")]
    frame = spark.createDataFrame([(*r, "c", "c") for r in rows], "doc_id long, text string, spans string, mark string")
    got = sorted(((r.doc_id or -1), r.n_assign, r.base_spans) for r in secrets.scan(frame).collect())
    assert got == [(-1, 1, "assign:0:13"), (-1, 1, "assign:0:13"), (1, 0, ""), (2, 0, ""), (3, 1, "assign:600000:600013")]
    assert secrets.scan(frame.limit(0)).count() == 0
    clean = secrets.redact(frame).collect()
    assert len(clean) == len(rows) and {r.spans for r in clean} == {"c"}
    assert sorted((r.text or "") for r in clean)[:4] == ["", "", "[SECRET]", "[SECRET]"]
