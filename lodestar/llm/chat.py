"""Chat formatting: speaker roles of plain transcripts by a hidden Markov model.

A transcript is lines of text; who speaks is hidden.  A state is a role and
whether the line begins a turn.  A line shows a speaker marker or none ("User:",
"Q."), whether an empty line is before it, its length and whether it asks.  The
model is fitted by counts over all labelled conversations, Viterbi recovers the
states, and turns are rendered in one form.

Transcripts are decoded in chunks of so many turns.  The best score from each
state before a chunk to each state at its end is a small matrix.  The matrices of
so many neighbours are multiplied (maximum and sum) to one, those again, up to one
of the whole transcript; then the states at the borders are found from the top
down, and each chunk is decoded by itself.  So no task holds a whole transcript.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed

ROLES = ["system", "user", "assistant"]
#: State 2r begins a turn of role r, state 2r + 1 goes on with it.
N_STATES = 2 * len(ROLES)
#: Input rows (turns or parts of a transcript) that are decoded at once, and chunks whose matrices are multiplied at once.
CHUNK = 256
#: Chunks over which a transcript's rows without a turn are dealt.
LOOSE = 4_096

#: Share of each distribution that stays with what is assumed before any counts.
ASSUMED = 0.05

#: Words that name a speaker at the beginning of a line.
SPEAKERS = {
    "system": ["system", "instruction", "instructions", "context"],
    "user": ["user", "human", "customer", "client", "question", "me", "you", "student", "q"],
    "assistant": ["assistant", "ai", "bot", "agent", "answer", "model", "support", "tutor", "a"],
}
_ROLE_OF = {w: r for r, (_, words) in enumerate(SPEAKERS.items()) for w in words}
MARKER = re.compile(r"^\s*(?:[#>*\-\[<|(]\s*){0,4}(" + "|".join(sorted(_ROLE_OF, key=len, reverse=True)) + r")\s*(?:[\]>|)*]\s*){0,4}(?::|\||>)[*\s]*", re.I | re.A)
FEATURES = ["marker", "blank", "length", "asks"]
VALUES = {"marker": 4, "blank": 2, "length": 12, "asks": 2}


def lines_of(parts: list[str | None]) -> list[tuple[tuple[int, int, int, int], str, int]]:
    """(features, text without its marker, part) of the lines of a transcript's parts, in order."""
    out = []
    for k, part in enumerate(parts):
        blank = 1  # parts are set apart by an empty line
        for line in (part or "").split("\n"):
            if not line.strip():
                blank = 1
                continue
            m = MARKER.match(line)
            body = line[m.end() :] if m else line
            marker = 1 + _ROLE_OF[m[1].lower()] if m else 0
            length = min(VALUES["length"] - 1, max(len(body), 1).bit_length())
            out.append(((marker, blank, length, int(body.rstrip().endswith("?"))), body, k))
            blank = 0
    return out


class Model:
    """Log probabilities from counts {(what, state, value): n}, mixed with what is assumed without any.

    So what the counted conversations never show, as markers, still tells, however many they are.
    """

    def __init__(self, counts: dict[tuple[str, int, int], float]):
        def logs(what: str, states: int, values: int, prior) -> np.ndarray:
            seen = np.array([[counts.get((what, s, v), 0) for v in range(values)] for s in range(states)], dtype=float)
            given = np.array([[prior(s, v) for v in range(values)] for s in range(states)], dtype=float)
            given /= given.sum(axis=1, keepdims=True)
            n = seen.sum(axis=1, keepdims=True)
            return np.log(np.where(n > 0, (1 - ASSUMED) * seen / np.maximum(n, 1) + ASSUMED * given, given))

        begins = lambda s: s % 2 == 0
        self.start = logs("start", 1, N_STATES, lambda _, v: 1.0 if begins(v) else 1e-6)[0]
        # a line goes on with its own role only
        self.move = logs("move", N_STATES, N_STATES, lambda s, v: (1.0 if s // 2 != v // 2 else 0.1) if begins(v) else (1.0 if s // 2 == v // 2 else 1e-9))
        self.shows = {
            "marker": logs("marker", N_STATES, 4, lambda s, v: 2.0 if v == 0 else (2.0 if v == 1 + s // 2 and begins(s) else 1e-3)),
            "blank": logs("blank", N_STATES, 2, lambda s, v: 1.0 if v == begins(s) else 0.1),
            "length": logs("length", N_STATES, VALUES["length"], lambda s, v: 0.5),
            "asks": logs("asks", N_STATES, 2, lambda s, v: 0.5),
        }

    def emissions(self, features: list[tuple[int, int, int, int]]) -> np.ndarray:
        seen = np.array(features)
        return sum(self.shows[f][:, seen[:, j]].T for j, f in enumerate(FEATURES))

    def through(self, features: list) -> np.ndarray:
        """Best score from each state before the lines (the last row: from the beginning) to each state at their end."""
        emit = self.emissions(features)
        score = np.vstack([self.move, self.start]) + emit[0]
        for e in emit[1:]:
            score = (score[:, :, None] + self.move[None]).max(axis=1) + e
        return score

    def decode(self, features: list, before: int | None = None, end: int | None = None) -> list[int]:
        """The best states, given the state before (None: the beginning) and the state at the end (None: any)."""
        if not features:
            return []
        emit = self.emissions(features)
        score = (self.start if before is None else self.move[before]) + emit[0]
        back = []
        for e in emit[1:]:
            ways = score[:, None] + self.move
            back.append(ways.argmax(axis=0))
            score = ways.max(axis=0) + e
        state = int(score.argmax()) if end is None else end
        states = [state]
        for b in reversed(back):
            state = int(b[state])
            states.append(state)
        return states[::-1]


def count_states(parts: list[str | None], roles: list[str | None], first: bool) -> tuple[Counter, int | None, int | None]:
    """(counts, first state, last state) of a labelled stretch of a conversation.

    Parts of unknown roles count for nothing; a stretch that begins or ends with one has no first or last state.
    """
    index = {r: k for k, r in enumerate(ROLES)}
    counts: Counter = Counter()
    last, part_before, begin, any_ = None, -1, None, False
    for features, _, k in lines_of(parts):
        role = index.get((roles[k] or "").strip().lower())
        if role is None:
            last, part_before, any_ = None, k, True
            continue
        state = 2 * role + (k == part_before)
        part_before = k
        if not any_:
            begin, any_ = state, True
            if first:
                counts["start", 0, state] += 1
        if last is not None:
            counts["move", last, state] += 1
        for f, v in zip(FEATURES, features, strict=True):
            counts[f, state, v] += 1
        last = state
    return counts, begin, last


def _chunks(transcripts: DataFrame, conv: str, turn: str, text: str, role: str | None) -> DataFrame:
    """Rows of (key, conv, chunk, turn, text[, role]); rows that repeat are one.

    key: text that tells transcripts apart; a row without a conversation has one of its own.
    Rows without a turn come after all chunks of turns, dealt by their texts.
    """
    name, at, body = (F.col(f"`{c}`") for c in (conv, turn, text))
    least, most = transcripts.agg(F.min(at.cast("long")), F.max(at.cast("long"))).first()
    loose = F.lit(((most or 0) - (least or 0)) // CHUNK + 1) + F.pmod(F.xxhash64(body), F.lit(LOOSE))
    chunk = F.coalesce(F.floor((at.cast("long") - F.lit(least or 0)) / CHUNK), loose).cast("long")
    key = F.coalesce(F.concat(F.lit("="), name.cast("string")), F.concat(F.lit("-"), F.xxhash64(at, body).cast("string")))
    own = [key.alias("key"), name.alias("conv"), chunk.alias("chunk"), F.coalesce(at.cast("long"), F.lit(2**62)).alias("turn"), body.alias("text")]
    return transcripts.select(*own, *([F.col(f"`{role}`").cast("string").alias("role")] if role else [])).distinct()


def _in_order(rows: pa.Table) -> pa.Table:
    return rows.sort_by([("turn", "ascending"), ("text", "ascending")])


COUNTS = "key string, chunk long, what string, state int, value int, n long"


def fit(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text", role: str = "role") -> Model:
    """The model of all labelled conversations.  Without any it knows markers and empty lines only.

    Transitions between neighbouring chunks of a conversation are counted by a join
    of the one's last state and the other's first.  Rows are taken as ``recover`` takes them.
    """
    chunks = _chunks(conversations, conv, turn, text, role)

    def counted(key: tuple, rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        counts, begin, last = count_states(rows.column("text").to_pylist(), rows.column("role").to_pylist(), key[1].as_py() == 0)
        made = [(*k, n) for k, n in counts.items()] + [(what, s, 0, 1) for what, s in (("first", begin), ("last", last)) if s is not None]
        columns = list(zip(*made, strict=True)) or [[]] * 4
        kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64()]
        own = {"key": pa.array([key[0].as_py()] * len(made), pa.string()), "chunk": pa.array([key[1].as_py()] * len(made), pa.int64())}
        return pa.table(own | {c: pa.array(x, k) for c, x, k in zip(("what", "state", "value", "n"), columns, kinds, strict=True)})

    counts = checkpointed(chunks.groupBy("key", "chunk").applyInArrow(counted, COUNTS))
    last = counts.where("what = 'last'").select("key", (F.col("chunk") + 1).alias("chunk"), "state")
    first = counts.where("what = 'first'").select("key", "chunk", F.col("state").alias("value"))
    between = last.join(first, ["key", "chunk"]).select(F.lit("move").alias("what"), "state", "value", F.lit(1).cast("long").alias("n"))
    within = counts.where("what NOT IN ('first', 'last')").select("what", "state", "value", "n")
    total = within.unionByName(between).groupBy("what", "state", "value").agg(F.sum("n").alias("n"))
    return Model({(r.what, r.state, r.value): r.n for r in total.collect()})  # of a fixed number of features and states


def render(role: str, text: str, begins: bool = True, ends: bool = True) -> str:
    return f"<|{role}|>\n" * begins + text + "<|end|>" * ends


TURNS = "chunk long, seq int, role string, continued boolean, n_lines int, rendered string"


def recover(transcripts: DataFrame, model: Model, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv_id, chunk, seq, role, continued, n_lines, rendered): the recovered turns of every transcript.

    A transcript is the texts of one ``conv``, in the order of ``turn``, set apart
    by empty lines; roles are not looked at.  A row is a turn, in order of chunk
    and seq.  A turn that goes on from the chunk before is ``continued`` and has
    no header there.

    Null and empty texts have no lines; a transcript without lines gives no rows.
    Rows that repeat are one, equal turns are ordered by text, and a row without a
    conversation is a transcript of its own.  Rows without a turn come last, in an
    order that follows from their texts.  An empty table gives no rows.  Very long
    texts are lines like any other.  Other columns are not looked at.
    """
    kind = transcripts.schema[conv].dataType.simpleString()
    chunks = _chunks(transcripts, conv, turn, text, None)

    def through(key: tuple, rows: pa.Table) -> pa.Table:
        features = [f for f, _, _ in lines_of(_in_order(rows).column("text").to_pylist())]
        best = [model.through(features).ravel().tolist()] if features else []
        return _matrices(key, best)

    def turns(key: tuple, rows: pa.Table) -> pa.Table:
        rows = _in_order(rows)
        lines = lines_of(rows.column("text").to_pylist())
        before, end = rows.column("before")[0].as_py(), rows.column("end")[0].as_py()
        states = model.decode([f for f, _, _ in lines], before, end)
        made: list[list] = []
        for (_, body, _), s in zip(lines, states, strict=True):
            if s % 2 == 0 or not made:
                made.append([ROLES[s // 2], s % 2 == 1, [body]])
            else:
                made[-1][2].append(body)
        n = len(made)
        return pa.table(
            {
                "conv_id": pa.array([rows.column("conv")[0].as_py()] * n, rows.schema.field("conv").type),
                "chunk": pa.array([key[1].as_py()] * n, pa.int64()),
                "seq": pa.array(range(n), pa.int32()),
                "role": pa.array([m[0] for m in made], pa.string()),
                "continued": pa.array([m[1] for m in made], pa.bool_()),
                "n_lines": pa.array([len(m[2]) for m in made], pa.int32()),
                "rendered": pa.array([render(m[0], "\n".join(m[2]), not m[1]) for m in made], pa.string()),
            }
        )

    levels = [checkpointed(chunks.groupBy("key", "chunk").applyInArrow(through, MATRIX))]
    above = F.floor(F.col("chunk") / CHUNK).cast("long").alias("above")
    most = levels[0].agg(F.max("chunk")).first()[0] or 0
    while most:  # up to one matrix for each transcript
        most //= CHUNK
        levels.append(checkpointed(levels[-1].select("*", above).groupBy("key", "above").applyInArrow(_product, MATRIX)))
    states = levels.pop().groupBy("key", "chunk").applyInArrow(_top, STATES)
    for level in reversed(levels):
        states = level.select("*", above).groupBy("key", "above").cogroup(states.groupBy("key", "chunk")).applyInArrow(_borders, STATES)
    joined = chunks.join(states, ["key", "chunk"])
    return joined.groupBy("key", "chunk").applyInArrow(turns, f"conv_id {kind}, {TURNS}")


MATRIX = "key string, chunk long, best array<double>"
STATES = "key string, chunk long, before int, end int"


def _matrices(key: tuple, best: list[list[float]]) -> pa.Table:
    n = len(best)
    return pa.table({"key": pa.array([key[0].as_py()] * n, pa.string()), "chunk": pa.array([key[1].as_py()] * n, pa.int64()), "best": pa.array(best, pa.list_(pa.float64()))})


def _of(rows: pa.Table) -> list[np.ndarray]:
    return [np.array(x).reshape(N_STATES + 1, N_STATES) for x in rows.column("best").to_pylist()]


def _product(key: tuple, rows: pa.Table) -> pa.Table:
    """One matrix for those of neighbouring chunks."""
    first, *others = _of(rows.sort_by("chunk"))
    for m in others:
        first = (first[:, :, None] + m[None, :N_STATES]).max(axis=1)
    return _matrices(key, [first.ravel().tolist()])


def _top(key: tuple, rows: pa.Table) -> pa.Table:
    """The state at the end of a transcript."""
    ends = [int(m[N_STATES].argmax()) for m in _of(rows)]
    return pa.table({"key": rows.column("key"), "chunk": rows.column("chunk"), "before": pa.array([None] * len(ends), pa.int32()), "end": pa.array(ends, pa.int32())})


def _borders(key: tuple, rows: pa.Table, around: pa.Table) -> pa.Table:
    """The states before and at the end of each of some neighbouring chunks, given those around them all."""
    rows = rows.sort_by("chunk")
    matrices = _of(rows)
    before, end = around.column("before")[0].as_py(), around.column("end")[0].as_py()
    scores = [matrices[0][N_STATES if before is None else before]]
    for m in matrices[1:]:
        scores.append((scores[-1][:, None] + m[:N_STATES]).max(axis=0))
    ends = [end]
    for k in range(len(matrices) - 1, 0, -1):
        ends.append(int((scores[k - 1] + matrices[k][:N_STATES, ends[-1]]).argmax()))
    ends = ends[::-1]
    return pa.table({"key": rows.column("key"), "chunk": rows.column("chunk"), "before": pa.array([before, *ends[:-1]], pa.int32()), "end": pa.array(ends, pa.int32())})


def accuracy(model: Model, parts: list[str | None], roles: list[str]) -> tuple[int, int]:
    """(lines whose role is recovered, lines) of one labelled conversation; for tests."""
    lines = lines_of(parts)
    states = model.decode([f for f, _, _ in lines])
    return sum(ROLES[s // 2] == roles[k] for (_, _, k), s in zip(lines, states, strict=True)), len(lines)
