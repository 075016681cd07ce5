"""Personal data: known formats, and bootstrapped contextual extraction.

Known formats are matched by patterns and checked (parts of addresses, Luhn sums,
numbers of digits).  They seed the search for identifiers of other formats:

- every seed, and every other string with a digit or an @ (a candidate), gives
  its lexical patterns, the words before it and the words around it;
- Spark counts the graph of patterns and instances over all documents and scores
  it in rounds: a pattern by the share of its instances that are of a kind, an
  instance by the patterns that it is found in;
- candidates that patterns of high confidence surround are reported.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed, shared_table, sliced

DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: A match begins where its run of digits begins, as a greedy one before it ends where a run ends; so runs are read once.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
KINDS = ["email", "ip", "card", "phone"]
#: Names of the spans that the method adds, by the kind that their contexts speak for.
FOUND = {k: f"context_{k}" for k in KINDS}

#: An identifier has 6 to 64 characters; longer strings are none.
CANDIDATE = re.compile(r"(?<![^\s(\[\"'<])[A-Za-z0-9+][A-Za-z0-9@._+/-]{4,62}[A-Za-z0-9](?![A-Za-z0-9@_+/-])")
#: Rounds of scoring; distinct seeds that a pattern needs; scores that a pattern and an instance need to be used.
ROUNDS, MIN_SEEDS, MIN_PATTERN, MIN_INSTANCE = 3, 5, 0.8, 0.9
#: Digits that a candidate needs: fewer are dates, counts and versions.
MIN_DIGITS = 6


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches of local part, @ and dotted domain: looked for from each @, which a local part can't hold."""
    out: list[tuple[int, int]] = []
    done, at = 0, text.find("@")
    while at >= 0:
        begin = _run_start(text, done, at)
        if begin < at and (m := DOMAIN.match(text, at + 1)):
            out.append((begin, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    return out


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def _run_start(text: str, low: int, at: int) -> int:
    while at > low and text[at - 1] in _LOCAL_CHARS:
        at -= 1
    return at


def known_spans(text: str) -> list[tuple[int, str, int]]:
    """(start, kind, end) of the known formats, in order of start and then kind."""
    found = [(a, 0, b) for a, b in emails(text)] if "@" in text else []
    found += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(len(own := p.lstrip("0")) <= 3 and int(own or "0") <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            found.append((m.start(), 2, m.end()))
    if "+" in text:
        found += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits_of(m[0])) <= 15]
    return [(a, KINDS[k], b) for a, k, b in sorted(found)]


def candidates(text: str, known: list[tuple[int, str, int]]) -> list[tuple[int, int]]:
    """(start, end) of other strings that may identify a person: with an @, or digits enough, clear of known spans."""
    out, k = [], 0
    for m in CANDIDATE.finditer(text):
        s = m[0]
        if "@" in s or sum(c in "0123456789" for c in s) >= MIN_DIGITS:
            while k < len(known) and known[k][2] <= m.start():
                k += 1
            if not any(a < m.end() and m.start() < b for a, _, b in known[max(0, k - 4) : k + 4]):
                out.append(m.span())
    return out


def patterns(text: str, start: int, end: int) -> list[str]:
    """Lexical patterns of a place: the two words before it, and the word on each side."""
    before = text[max(0, start - 80) : start].lower().split()
    after = text[end : end + 40].lower().split()
    if text[max(0, start - 80) : start].strip() == "" or not before:
        return []
    left = before[-1]
    out = [f"{before[-2]} {left} _"] if len(before) > 1 else []
    return out + ([f"{left} _ {after[0]}"] if after else [])


def joined(spans: list[tuple[int, str, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, k, b in spans)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The known spans of each text, and the places whose contexts count: (start, end, kind, instance, patterns)."""
    place = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string()), ("instance", pa.string()), ("patterns", pa.list_(pa.string()))])
    for batch in sliced(batches):
        counts, base, places = [], [], []
        for text in batch.column(1).to_pylist():
            text = text or ""
            known = known_spans(text)
            kinds = [k for _, k, _ in known]
            counts.append([kinds.count(k) for k in KINDS])
            base.append(joined(known))
            own = [(a, b, k) for a, k, b in known] + [(a, b, None) for a, b in candidates(text, known)]
            places.append([{"start": a, "end": b, "kind": k, "instance": text[a:b], "patterns": p} for a, b, k in own if (p := patterns(text, a, b))])
        columns = list(zip(*counts, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(base, pa.string()), pa.array(places, pa.list_(place))],
            names=["doc_id", *(f"n_{k}" for k in KINDS), "base_spans", "places"],
        )


SCAN = ", ".join(f"n_{k} long" for k in KINDS) + ", base_spans string, places array<struct<start:long,end:long,kind:string,instance:string,patterns:array<string>>>"


def score_patterns(graph: DataFrame, rounds: int = ROUNDS, min_seeds: int = MIN_SEEDS, min_pattern: float = MIN_PATTERN) -> tuple[DataFrame, DataFrame]:
    """(pattern, kind, confidence) and (instance, kind, score) of a graph (pattern, instance, kind of a seed or null).

    The graph has a row for each pattern and instance, so a value that a third
    of all documents share is one instance.  Patterns are scored by partial
    aggregation; a pattern's instances are never gathered.
    """
    seeds = graph.where("kind IS NOT NULL").select("instance", "kind", F.lit(1.0).alias("score")).distinct()
    edges = graph.select("pattern", "instance").distinct()
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= min_seeds)
    instances = seeds
    confident = None
    for _ in range(rounds):
        held = edges.join(instances, "instance").groupBy("pattern", "kind").agg(F.sum("score").alias("of_kind")).where(F.col("of_kind") >= min_seeds)
        confident = checkpointed(
            held.join(sizes, "pattern")
            .select("pattern", "kind", (F.col("of_kind") / F.col("n")).alias("confidence"))
            .where(F.col("confidence") >= min_pattern)
        )
        # an instance is not of a kind only if all its patterns are wrong about it
        reached = edges.join(confident, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(1.0 - F.least("confidence", F.lit(0.99)))))).alias("score")
        )
        instances = checkpointed(
            reached.join(seeds.select("instance"), "instance", "left_anti").unionByName(seeds)
        )
    return confident, instances


def scan(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    rounds: int = ROUNDS,
    min_seeds: int = MIN_SEEDS,
    min_pattern: float = MIN_PATTERN,
    min_instance: float = MIN_INSTANCE,
) -> DataFrame:
    """The personal data of every row: doc_id, n_email, n_ip, n_card, n_phone, n_context, base_spans, spans.

    Spans are ``kind:start:end`` in code points, end exclusive, in order of
    start and then kind, joined by commas.  base_spans has the known formats,
    spans has what their contexts lead to as well (``context_`` and the kind).

    A null text is the empty text, which has no spans.  Whole texts are scanned
    however long.  Rows that repeat give a row each and count once in the graph,
    null ids are carried along, an empty table gives no rows, and other columns
    are not looked at.  A candidate that several kinds claim takes the one of
    the higher score, then the first by name.
    """
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    scanned = shared_table(rows.mapInArrow(_scan, f"doc_id {kind}, {SCAN}").withColumn("row", F.monotonically_increasing_id()))
    places = scanned.select("row", F.explode("places").alias("p")).select("row", "p.*")
    graph = shared_table(
        places.select(F.explode("patterns").alias("pattern"), "instance", "kind").groupBy("pattern", "instance").agg(F.min("kind").alias("kind"))
    )
    confident, instances = score_patterns(graph, rounds, min_seeds, min_pattern)
    open_ = places.where("kind IS NULL").select("row", "start", "end", "instance", F.explode("patterns").alias("pattern"))
    best = instances.where(F.col("score") >= min_instance)
    found = (
        open_.join(confident, "pattern")
        .join(best, ["instance", "kind"])
        .groupBy("row", "start", "end")
        .agg(F.min_by("kind", F.struct(-F.col("score"), "kind")).alias("kind"))
        .groupBy("row")
        .agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end"))).alias("found"))
    )
    known = F.filter(F.split("base_spans", ","), lambda s: s != "")
    parsed = F.transform(
        known,
        lambda s: F.struct(
            F.split_part(s, F.lit(":"), F.lit(2)).cast("long").alias("start"),
            F.array_position(F.array(*map(F.lit, KINDS)), F.split_part(s, F.lit(":"), F.lit(1))).alias("rank"),
            s.alias("span"),
        ),
    )
    names = F.create_map(*[x for k in KINDS for x in (F.lit(k), F.lit(FOUND[k]))])
    added = F.transform(
        F.coalesce("found", F.expr("array()").cast("array<struct<start:bigint,kind:string,end:bigint>>")),
        lambda s: F.struct(s["start"].alias("start"), F.lit(9).cast("long").alias("rank"), F.concat_ws(":", names[s["kind"]], s["start"], s["end"]).alias("span")),
    )
    all_spans = F.array_join(F.transform(F.array_sort(F.concat(parsed, added)), lambda s: s["span"]), ",")
    return scanned.drop("places").join(found, "row", "left").select(
        "doc_id", *(f"n_{k}" for k in KINDS), F.coalesce(F.size("found"), F.lit(0)).cast("long").alias("n_context"), "base_spans", all_spans.alias("spans")
    )
