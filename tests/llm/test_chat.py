"""Recovered roles: against whole-transcript Viterbi, on held-out conversations, and on odd rows."""

import pytest
from pyspark.sql import functions as F

from lodestar.llm import chat

FOLDER = "/root/testdata/sf0.01"
KIND = "conv_id long, turn int, role string, text string"


@pytest.fixture(scope="module")
def conversations(spark):
    return spark.read.parquet(f"{FOLDER}/conversations.parquet")


@pytest.fixture(scope="module")
def held_out(conversations):
    """A model of four fifths of the conversations, and the others by id."""
    test = F.pmod(F.xxhash64("conv_id"), F.lit(5)) == 0
    model = chat.fit(conversations.where(~test))
    others: dict = {}
    for r in conversations.where(test).orderBy("conv_id", "turn").collect():
        others.setdefault(r.conv_id, []).append((r.text, r.role))
    return model, others


def test_held_out_accuracy(held_out):
    model, others = held_out
    right = total = plain = marked = 0
    for own in others.values():
        texts, roles = [t for t, _ in own], [r for _, r in own]
        a, n = chat.accuracy(model, texts, roles)
        right, total = right + a, total + n
        for _, _, k in chat.lines_of(texts):  # turns in alternation, the first the user's
            plain += ["user", "assistant"][k % 2] == roles[k]
        names = {"system": "System", "user": "Human", "assistant": "Bot"}
        one = "\n".join(f"{names[r]}: {(t or 'x').strip()}" for t, r in own)  # no empty lines: markers alone tell turns apart
        states = model.decode([f for f, _, _ in chat.lines_of([one])])
        want = [r for t, r in own for line in (t or "x").strip().split("\n") if line.strip()]
        marked += sum(chat.ROLES[s // 2] == r for s, r in zip(states, want, strict=True)) / len(want)
    print("held out", right / total, "alternation", plain / total, "marked", marked / len(others))
    assert right / total > 0.9
    assert right >= plain
    assert marked / len(others) > 0.95


@pytest.mark.parametrize("size", [2, 3])
def test_chunks_decode_as_one_transcript(spark, held_out, monkeypatch, size):
    model, others = held_out
    some = dict(list(others.items())[:40])
    long = [x for own in list(others.values())[:12] for x in own]
    some[-1] = long
    rows = [(c, k, r, t) for c, own in some.items() for k, (t, r) in enumerate(own)]
    monkeypatch.setattr(chat, "CHUNK", size)
    got: dict = {}
    for r in chat.recover(spark.createDataFrame(rows, KIND), model).orderBy("chunk", "seq").collect():
        got.setdefault(r.conv_id, []).extend([(r.role, r.continued)] + [(r.role, True)] * (r.n_lines - 1))
    for c, own in some.items():
        states = model.decode([f for f, _, _ in chat.lines_of([t for t, _ in own])])
        assert got[c] == [(chat.ROLES[s // 2], s % 2 == 1) for s in states]


def test_counts_do_not_depend_on_chunks(spark, conversations, monkeypatch):
    some = conversations.where("conv_id < 60")
    whole = chat.fit(some)
    monkeypatch.setattr(chat, "CHUNK", 2)
    cut = chat.fit(some)
    assert (whole.move == cut.move).all() and (whole.start == cut.start).all()


def test_odd_rows(spark, held_out):
    model, _ = held_out
    assert chat.recover(spark.createDataFrame([], KIND), model).count() == 0
    assert chat.recover(spark.createDataFrame([], KIND), chat.fit(spark.createDataFrame([], KIND))).count() == 0
    rows = [
        (1, 0, None, "User: hi"), (1, 0, None, "User: hi"), (1, 1, None, "Assistant: hello\nmore"), (1, None, None, "User: late"),
        (2, 0, None, None), (2, 1, None, ""), (2, 2, None, " \n\n"),
        (None, 0, None, "User: alone"), (None, 1, None, "Assistant: alone too"),
        (3, 5, None, "User: " + "long words " * 100_000), (3, 5, None, "Bot: a tie"),
    ]
    frame = spark.createDataFrame([(*r, 1, 2) for r in rows], KIND + ", `key` int, `chunk` int")
    got = chat.recover(frame, model).collect()
    of = {c: sorted((r.chunk, r.seq, r.role, r.n_lines) for r in got if r.conv_id == c) for c in (1, 2, 3, None)}
    assert [x[2:] for x in of[1]] == [("user", 1), ("assistant", 2), ("user", 1)]
    assert of[2] == []
    assert sorted(x[2] for x in of[None]) == ["assistant", "user"]
    assert sorted(x[2] for x in of[3]) == ["assistant", "user"]
    assert max(len(r.rendered) for r in got) > 1_000_000
