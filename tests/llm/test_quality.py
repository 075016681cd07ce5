"""Lines that the distinct documents of a host share."""

from collections import Counter

from lodestar.llm import quality, queries


def test_documents_that_share_several_lines_count_each(spark):
    common = [f"common line number {k}" for k in range(4)]
    texts = ["\n".join([*common, f"only document {d} has this", f"and this {d * 7}"]) for d in range(30)]
    rows = [("h", t) for t in texts + texts[:10]] + [("h", f"another document {d}") for d in range(70)]
    found = {r.line: r.n_docs for r in quality.boilerplate_lines(spark.createDataFrame(rows, "host string, text string")).collect()}
    assert found == {quality.line_hashes(x)[0][0]: 30 for x in common}


def _plain_kept(rows):
    """The verdict of each row (host, text), by counting whole texts that hold a line."""
    norm = lambda line: b" ".join(line.encode().split()).lower()
    texts: dict = {}
    for host, text in rows:
        texts.setdefault(host or "", set()).add(text or "")
    bad = {}
    for host, own in texts.items():
        count = Counter(x for t in own for x in {norm(line) for line in t.split("\n")} if x)
        bad[host] = {x for x, n in count.items() if n > quality.MIN_DOCS and n > quality.MAX_SHARE * len(own)}
    out = []
    for host, text in rows:
        lines = [norm(line) for line in (text or "").split("\n")]
        words = [w for line in lines for w in line.split()]
        n, left = len(words), sum(len(x.split()) for x in lines if x not in bad[host or ""])
        windows = Counter(tuple(raw[i : i + 5]) for raw in [(text or "").encode().split()] for i in range(len(raw) - 4))
        raw = (text or "").encode().split()
        inside = {i + k for i in range(len(raw) - 4) if windows[tuple(raw[i : i + 5])] > 1 for k in range(5)}
        failed = n < 10 or 100 * len(inside) > 20 * n
        out.append((failed, not failed and left >= quality.MIN_WORDS and left >= quality.MIN_REMAINING * n))
    return out


def test_verdicts_of_a_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()
    got = {r.doc_id: (r.base_failed, r.kept) for r in queries.op2_quality_rules(spark, "/root/testdata/sf0.01").collect()}
    expected = _plain_kept([(r.source, r.text) for r in docs])
    assert got == {r.doc_id: e for r, e in zip(docs, expected, strict=True)}


def _two_footers():
    footers = ["all rights are reserved by the owner of this site", "subscribe to the letter and follow the feed here"]
    rows = [("h", f"{footers[0]}\nshort body {k}\n{footers[1]}") for k in range(300)]
    rows += [("h", f"{footers[k % 2]}\n" + "\n".join(" ".join(f"own{k}word{j}no{i}" for i in range(9)) for j in range(20))) for k in range(300, 340)]
    return footers, rows + [("h", f"clean document {k} of ten words or more than that, surely {k} so") for k in range(60)]


def test_two_footers_are_both_removed(spark):
    footers, rows = _two_footers()
    docs = spark.createDataFrame([(k, h, t) for k, (h, t) in enumerate(rows)], "doc_id long, source string, text string")
    for limit in (quality.MAX_BROADCAST_LINES, 0):  # a broadcast, and a join
        got = {r.doc_id: (r.base_failed, r.kept) for r in quality.judge(docs, max_broadcast=limit).collect()}
        assert [got[k] for k in range(len(rows))] == _plain_kept(rows)
        assert not any(got[k][1] for k in range(300)) and all(got[k][1] for k in range(300, 400))
        for r in quality.clean(docs, max_broadcast=limit).collect():
            assert not any(x in r.text for x in footers)


def test_odd_rows(spark):
    good = "ten words and a few more words so that it stays here"
    rows = [(1, None, good, 9), (1, None, good, 9), (None, "h", good, 9), (2, "h", None, 0), (3, "h", "", 0), (4, "h", " ".join(f"w{k}" for k in range(200_000)), 9)]
    frame = spark.createDataFrame([(*r, True, "c") for r in rows], "doc_id long, source string, text string, n_chars int, kept boolean, host string")
    got = sorted(((r.doc_id or -1), r.n_words, r.kept) for r in quality.judge(frame).collect())
    assert got == [(-1, 12, True), (1, 12, True), (1, 12, True), (2, 0, False), (3, 0, False), (4, 200_000, True)]
    clean = quality.clean(frame)
    assert clean.schema == frame.schema or [f.dataType for f in clean.schema] == [f.dataType for f in frame.schema]
    assert sorted((r.doc_id or -1) for r in clean.collect()) == [-1, 1, 1, 4] and {r.host for r in clean.collect()} == {"c"}
    assert quality.judge(frame.limit(0)).count() == 0 and quality.clean(frame.limit(0)).count() == 0
