"""The corpus pipeline against plain Python, and each stage on odd rows."""

from collections import Counter

import corpus_pipeline
import pytest
from test_packing import check
from test_quality import _plain_kept
from test_secrets import plain_spans

from lodestar.llm import decontaminate, quality, secrets, simhash

FOLDER = "/root/testdata/sf0.001"


def _clean(rows):
    """Kept rows of (id, host, text), without the lines that more than MIN_DOCS and MAX_SHARE of their host's texts hold."""
    norm = lambda line: b" ".join(line.encode().split()).lower()
    texts: dict = {}
    for _, host, text in rows:
        texts.setdefault(host, set()).add(text)
    bad = {}
    for host, own in texts.items():
        count = Counter(x for t in own for x in {norm(line) for line in t.split("\n")} if x)
        bad[host] = {x for x, n in count.items() if n > quality.MIN_DOCS and n > quality.MAX_SHARE * len(own)}
    verdicts = _plain_kept([(h, t) for _, h, t in rows])
    return {d: "\n".join(line for line in t.split("\n") if norm(line) not in bad[h]) for (d, h, t), (_, kept) in zip(rows, verdicts, strict=True) if kept}


def _one_of_each(texts):
    prints = {d: [simhash.fingerprint(t), *simhash.pair_fingerprints(t)] for d, t in texts.items()}
    sets = {d: simhash.shingles(t) for d, t in texts.items()}
    root = {d: d for d in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in texts:
        for b in texts:
            if a < b:
                far = [p ^ q for p, q in zip(prints[a], prints[b], strict=True)]
                meets = [x.bit_count() <= simhash.CANDIDATE_BITS and min((x >> 32).bit_count(), (x & 0xFFFFFFFF).bit_count()) <= 1 for x in far[1:]]
                if far[0].bit_count() <= simhash.THRESHOLD or any(meets) and len(sets[a] & sets[b]) >= simhash.ALIKE * len(sets[a] | sets[b]):
                    root[max(find(a), find(b))] = min(find(a), find(b))
    return {d: t for d, t in texts.items() if find(d) == d}


def _without_benchmark(texts, items):
    wanted = [x for x in map(decontaminate.normalise, items) if len(x) >= decontaminate.MIN_CHARS]
    out = {}
    for d, t in texts.items():
        doc = decontaminate.normalise(t)
        if not any(decontaminate.best_match(x, doc, decontaminate.error_budget(len(x))) for x in wanted):
            out[d] = t
    return out


def _redacted(texts):
    count: Counter = Counter()
    for t in set(texts.values()):
        near = secrets.contexts(t)
        count.update({m[0].lower() for a, b in near for m in secrets.IDENTIFIER.finditer(t, max(0, a - secrets.AROUND), min(len(t), b + secrets.AROUND))})
    words = [w for w, n in sorted(count.items(), key=lambda x: (-x[1], x[0])) if n >= secrets.MIN_TEXTS][: secrets.DICTIONARY_WORDS]
    novelty, out = secrets.Novelty(words), {}
    for d, t in texts.items():
        known = plain_spans(t)
        spans = sorted(known + novelty.novel_spans(t, known))
        made, done = "", 0
        for a, _, b in spans:
            if a >= done:
                made += t[done:a] + "[SECRET]"
            done = max(done, b)
        out[d] = made + t[done:]
    return out


def test_the_pipeline_as_plain_python(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").collect()
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    texts = _redacted(_without_benchmark(_one_of_each(_clean([(r.doc_id, r.source, r.text) for r in docs])), items))
    assert 0 < len(texts) < len(docs)
    check(sorted(texts.items()), corpus_pipeline.run(spark, FOLDER).collect())


@pytest.mark.parametrize("name", [k for k, _ in corpus_pipeline.STAGES])
def test_a_stage_on_odd_rows(spark, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    good = "ten words and a few more words so that it stays here"
    rows = [(1, good, "en", "s", 9), (1, good, "en", "s", 9), (None, "another text of more than ten words that no other row in this table is like", None, None, None), (2, None, None, None, None), (3, "", "en", "s", 0), (4, " ".join(f"w{k}" for k in range(100_000)), "en", "s", 9)]
    kinds = "doc_id long, text string, lang string, source string, n_chars int, `row` int, `class` string, kept boolean"
    frame = spark.createDataFrame([(*r, 1, "c", True) for r in rows], kinds)
    made = stage(spark, frame, FOLDER)
    kept = {"quality_rules": [1, 1, None, 4], "near_dedup": [1, None, 2, 4], "decontamination": [1, 1, None, 2, 3, 4], "secret_scan": [1, 1, None, 2, 3, 4]}.get(name)
    if kept is None:
        assert {r.doc_id for r in made.collect()} == {1, 2, 3, 4, None}
    else:
        assert made.columns == frame.columns
        assert Counter(r.doc_id for r in made.collect()) == Counter(kept)
    assert stage(spark, frame.limit(0), FOLDER).count() == 0
