"""SimHash near-duplicates by anchor points of a covering code.

A covering code of radius R has a codeword, an anchor, within R bits of every
string.  If x lies within R of an anchor and y within T of x, then y lies within
R + T of that anchor: with each fingerprint at its home anchor and copied to
every anchor within R + T, all pairs within T meet at an anchor.

Of 64-bit fingerprints that differ in 3 bits at most, one 32-bit half differs in
1 bit at most.  So each half is covered by itself, for T = 1: its anchors are the
words whose first 31 bits are in the perfect Hamming code of length 31, so R = 1
and a half has 16.5 anchors within R + T = 2 on average, among 2**27.  At each
anchor whole fingerprints are compared.
"""

from __future__ import annotations

import functools
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import checkpointed, few, give_back, hold_little, shared_table, sliced
from lodestar.llm.components import connected_components

THRESHOLD = 3
SHINGLE_WORDS = 3
SEED = 42
#: An anchor's home fingerprints, and all of its fingerprints, are dealt to tasks in blocks of about so many.
HOME_BLOCK, ALL_BLOCK = 4_096, 65_536
#: Hot anchors go to every task if there are no more than so many (16 bytes each); else a join brings them.
MAX_BROADCAST_ANCHORS = 100_000

_CAPITALS = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS, seed: int = SEED) -> int:
    """64-bit SimHash of a text's word shingles; 0 for a text without a word."""
    words = (text or "").encode().translate(_CAPITALS).split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = max(len(words) - shingle_words + 1, 1)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1)
    starts = [0, *ends[: n - 1].tolist()]
    stops = (ends[shingle_words - 1 :] - 1).tolist() if len(words) >= shingle_words else [len(joined)]
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, stops, strict=True)), dtype=np.uint64, count=n)
    total = np.zeros(64, dtype=np.int64)
    for k in range(0, n, 65_536):
        bits = np.unpackbits(hashes[k : k + 65_536].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        total += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(total * 2 > n).view(">u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in sliced(batches):
        prints = np.fromiter(map(fingerprint, batch.column(1).to_pylist()), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], names=["doc_id", "fp"])


def _error_patterns() -> list[np.ndarray]:
    """For each of the 32 syndromes the changes of 2 bits at most that make a half an anchor, nearest first."""
    weights = [np.array([], dtype=np.int64)] * 32
    found: list[list[tuple[int, int]]] = [[] for _ in range(32)]
    # bit i < 31 has the syndrome i + 1, bit 31 is free (syndrome 0)
    one = [(i + 1 if i < 31 else 0, 1 << i) for i in range(32)]
    found[0].append((0, 0))
    for s, e in one:
        found[s].append((1, e))
    for a in range(32):
        for b in range(a):
            found[one[a][0] ^ one[b][0]].append((2, one[a][1] | one[b][1]))
    for s in range(32):
        weights[s] = np.array([e for _, e in sorted(found[s])], dtype=np.int64)
    return weights


def anchors_of(half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, anchor, is home) for every anchor within 2 bits of each 32-bit half."""
    patterns = _error_patterns()
    syndrome = np.zeros(len(half), dtype=np.int64)
    for i in range(31):
        syndrome ^= np.where(half >> i & 1, i + 1, 0)
    rows, anchors, home = [], [], []
    for s in range(32):
        at = np.flatnonzero(syndrome == s)
        e = patterns[s]
        rows.append(np.repeat(at, len(e)))
        anchors.append((half[at][:, None] ^ e[None, :]).ravel())
        home.append(np.tile(np.arange(len(e)) == 0, len(at)))
    return np.concatenate(rows), np.concatenate(anchors), np.concatenate(home)


def _replicas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hold_little()
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False)
        bits = fp.view(np.uint64)
        for which, half in enumerate((bits >> np.uint64(32), bits & np.uint64(0xFFFFFFFF))):
            row, anchor, home = anchors_of(half.astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(anchor * 2 + which), pa.array(fp[row]), pa.array(home)], names=["anchor", "fp", "home"]
            )
    batch = None
    give_back()


def _links(home: np.ndarray, others: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """A forest that joins just what links join: (fp, a fp that it is joined to).

    Each home fingerprint not yet reached takes in all within the threshold; a
    later one links to what it meets of other trees only once for each tree.
    """
    everything = np.unique(np.concatenate([home, others]))
    index = np.searchsorted(everything, np.unique(home))
    tree = np.arange(len(everything))
    u, v = [], []
    for i in index:
        near = np.flatnonzero(np.bitwise_count(everything ^ everything[i]) <= threshold)
        roots = np.unique(tree[near])
        own = tree[i]
        roots = roots[roots != own]
        if len(roots):
            # one link for each tree that is met: its first member near by
            first = near[np.unique(tree[near], return_index=True)[1]]
            first = first[tree[first] != own]
            u.append(everything[first])
            v.append(np.full(len(first), everything[i]))
            tree[np.isin(tree, roots)] = own
    none = np.array([], dtype=np.uint64)
    return np.concatenate(u or [none]), np.concatenate(v or [none])


def _compare(threshold: int):
    """Over rows sorted by (anchor, block): the links of each run of equal keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None

        def links(key, fp, home):
            change = np.flatnonzero((key[1:] != key[:-1]).any(axis=1)) + 1
            start, stop = np.concatenate([[0], change]), np.concatenate([change, [len(key)]])
            homes = np.add.reduceat(home.astype(np.int64), start)
            u, v = [], []
            for a, b in zip(start[(stop - start > 1) & (homes > 0)], stop[(stop - start > 1) & (homes > 0)], strict=True):
                if b - a == 2:
                    if np.bitwise_count(fp[a] ^ fp[a + 1]) <= threshold and fp[a] != fp[a + 1]:
                        u.append(fp[a : a + 1])
                        v.append(fp[a + 1 : a + 2])
                else:
                    x, y = _links(fp[a:b][home[a:b]], fp[a:b], threshold)
                    u.append(x)
                    v.append(y)
            none = np.array([], dtype=np.uint64)
            u, v = np.concatenate(u or [none]), np.concatenate(v or [none])
            return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        hold_little()
        for batch in batches:
            key = np.column_stack([batch.column(k).to_numpy() for k in (0, 1, 2)])
            fp = batch.column(3).to_numpy().view(np.uint64)
            home = batch.column(4).to_numpy(zero_copy_only=False)
            if carry is not None:
                key, fp, home = np.concatenate([carry[0], key]), np.concatenate([carry[1], fp]), np.concatenate([carry[2], home])
            if not len(key):
                continue
            last = np.flatnonzero((key != key[-1]).any(axis=1))  # the last run may go on in the next batch
            cut = last[-1] + 1 if len(last) else 0
            carry = key[cut:], fp[cut:], home[cut:]
            if cut:
                yield links(key[:cut], fp[:cut], home[:cut])
        if carry is not None and len(carry[0]):
            yield links(*carry)
        batch = key = fp = home = carry = None
        give_back()

    return run


def link_fingerprints(prints: DataFrame, threshold: int = THRESHOLD, home_block: int = HOME_BLOCK, all_block: int = ALL_BLOCK, beyond: int = 0) -> DataFrame:
    """(u, v) of distinct fingerprints such that those within the threshold are joined, directly or through others.

    beyond: pairs up to so many bits are joined too, those of them that meet at an
    anchor, as halves that differ in one bit at most do.

    prints: distinct ``fp``.  An anchor that very many fingerprints share is
    dealt out: its home fingerprints in blocks, each against all blocks of its
    fingerprints, so that no task takes a whole anchor and no pair is lost.
    """
    if not 0 <= threshold <= THRESHOLD:
        raise ValueError(f"anchors cover thresholds up to {THRESHOLD}")
    threshold = max(threshold, beyond)
    rows = prints.select("fp").mapInArrow(_replicas, "anchor long, fp long, home boolean")
    sizes = rows.groupBy("anchor").agg(F.count("*").alias("n"), F.count_if("home").alias("h"))
    hot = sizes.where((F.col("h") > home_block) | ((F.col("h") > 0) & (F.col("n") > all_block))).select(
        "anchor", F.ceil(F.col("h") / home_block).cast("int").alias("hb"), F.ceil(F.col("n") / all_block).cast("int").alias("nb")
    )
    hot = checkpointed(hot)
    n_hot = hot.count()
    if not n_hot:
        return _grouped_links(rows.select("anchor", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "home"), threshold)
    dealt = rows.join(F.broadcast(hot) if n_hot <= MAX_BROADCAST_ANCHORS else hot, "anchor", "left").select("anchor", "fp", "home", F.coalesce("hb", F.lit(1)).alias("hb"), F.coalesce("nb", F.lit(1)).alias("nb"))
    mine = F.when(F.col("hb") > 1, F.pmod(F.xxhash64("fp"), F.col("hb"))).otherwise(0).cast("int")
    other = F.when(F.col("nb") > 1, F.pmod(F.xxhash64("fp", F.lit(7)), F.col("nb"))).otherwise(0).cast("int")
    every = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    plain = (F.col("hb") == 1) & (F.col("nb") == 1)
    cold = dealt.where(plain).select("anchor", F.lit(0).alias("x"), F.lit(0).alias("y"), "fp", "home")
    warm = dealt.where(~plain)
    homes = warm.where("home").select("anchor", mine.alias("x"), F.explode(every("nb")).alias("y"), "fp", "home")
    others = warm.select("anchor", F.explode(every("hb")).alias("x"), other.alias("y"), "fp", F.lit(False).alias("home"))
    return _grouped_links(cold.unionByName(homes).unionByName(others), threshold)


def _grouped_links(dealt: DataFrame, threshold: int) -> DataFrame:
    grouped = dealt.repartition("anchor", "x", "y").sortWithinPartitions("anchor", "x", "y")
    return grouped.mapInArrow(_compare(threshold), "u long, v long").distinct()


def components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row.

    component_id is the smallest id among all documents that a row reaches over
    links of fingerprints within the threshold; its own document is included.
    A null or empty text has the fingerprint zero and is linked like any other;
    very long texts are read whole.  Ties of ids are one id.  Rows that repeat stay, each with its result.  A null id is kept and is never
    the smallest, so that a component of null ids only has a null component_id.
    An empty table gives no rows.  Other columns are not looked at.
    """
    prints = checkpointed(
        docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(_fingerprints, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, fp long")
    )
    nodes = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    labels = connected_components(link_fingerprints(nodes, threshold))
    labelled = labels.withColumnRenamed("node", "fp").join(nodes, "fp")
    first = labelled.groupBy("label").agg(F.min("first").alias("component_id"))
    linked = labelled.join(first, "label").select("fp", "component_id")
    of = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first").alias("component_id"))
    return prints.join(of, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Seeds of the fingerprints of pairs of words, which lead to more candidates; their links hold if the texts are alike.
PAIR_SEEDS = (1, 2, 3)
#: Bits up to which such fingerprints are candidates, where halves of them differ in one bit at most.
CANDIDATE_BITS = 10
#: Words of a shingle, and shared part of all shingles, at which two texts are alike.
ALIKE_WORDS, ALIKE = 5, 0.8


def pair_fingerprints(text: str | None) -> list[int]:
    """64-bit SimHashes of a text's pairs of words, one for each seed."""
    return [fingerprint(text, 2, seed) for seed in PAIR_SEEDS]


def shingles(text: str | None, size: int = ALIKE_WORDS) -> frozenset[int]:
    words = (text or "").encode().translate(_CAPITALS).split()
    return frozenset(xxhash.xxh3_64_intdigest(b" ".join(words[k : k + size])) for k in range(max(len(words) - size + 1, 1)))


def _row_prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["row", "fp_0", *(f"fp_{k + 1}" for k in range(len(PAIR_SEEDS)))]
    for batch in sliced(batches):
        made = [[fingerprint(t), *pair_fingerprints(t)] for t in batch.column(1).to_pylist()]
        prints = np.array(made, dtype=np.uint64).reshape(batch.num_rows, 1 + len(PAIR_SEEDS)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(np.ascontiguousarray(c)) for c in prints.T)], names=names)


def _alike(similarity: float):
    """Of rows (u, v, text, other) the pairs whose texts are alike."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: tuple = ("", frozenset())
        for batch in sliced(batches, 128):
            keep = []
            for text, other in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if known[0] is not other and known[0] != other:  # the pairs of one text follow one another
                    known = other, shingles(other)
                own = shingles(text)
                both = len(own & known[1])
                keep.append(both >= similarity * (len(own) + len(known[1]) - both))
            yield pa.RecordBatch.from_arrays(list(batch.columns[:2]), names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return run


def alike_links(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, similarity: float = ALIKE) -> DataFrame:
    """(u, v) of rows, as (none, id, key), whose contract fingerprints link, and of those that other fingerprints bring together and whose texts are alike.

    Of the rows of one fingerprint each is held against the least, and of two that
    link the least against the least: no group is expanded into its pairs.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    row = F.struct(F.col(f"`{doc_id}`").isNull().alias("none"), F.col(f"`{doc_id}`").alias("id"), F.xxhash64(f"`{doc_id}`", f"`{text}`").alias("key"))
    rows = docs.select(row.alias("row"), F.col(f"`{text}`").alias("text"))
    names = ", ".join(f"fp_{k} long" for k in range(1 + len(PAIR_SEEDS)))
    prints = shared_table(rows.mapInArrow(_row_prints, f"row struct<none:boolean,id:{kind},key:bigint>, {names}").distinct())
    every = []
    for k in range(1 + len(PAIR_SEEDS)):
        own = prints.select("row", F.col(f"fp_{k}").alias("fp"))
        nodes = checkpointed(own.groupBy("fp").agg(F.min("row").alias("first")))
        links = link_fingerprints(nodes, threshold, beyond=CANDIDATE_BITS if k else 0)
        within = own.join(nodes, "fp").where("row > first").select(F.col("row").alias("u"), F.col("first").alias("v"))
        first = lambda c: nodes.select(F.col("fp").alias(c), F.col("first").alias(f"first_{c}"))
        across = links.join(first("u"), "u").join(first("v"), "v").select(F.greatest("first_u", "first_v").alias("u"), F.least("first_u", "first_v").alias("v"))
        every.append(shared_table(within.unionByName(across).distinct()))
    sure, *others = every
    candidates = functools.reduce(DataFrame.unionByName, others).distinct().join(sure, ["u", "v"], "left_anti")
    candidates = checkpointed(candidates)
    needed = checkpointed(candidates.select(F.col("u").alias("row")).unionByName(candidates.select(F.col("v").alias("row"))).distinct())
    texts = rows.join(few(needed), "row", "left_semi")
    texts = shared_table(texts.dropDuplicates(["row"]) if _repeats(rows.select(F.col("row").alias("id"))) else texts)
    of = lambda c, name: texts.select(F.col("row").alias(c), F.col("text").alias(name))
    held = candidates.join(of("u", "text"), "u").join(of("v", "other"), "v").select("u", "v", "text", "other")
    return sure.unionByName(held.mapInArrow(_alike(similarity), sure.schema))


def _repeats(ids: DataFrame) -> bool:
    return bool(ids.groupBy("id").count().where("count > 1").limit(1).count())


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: int = THRESHOLD, similarity: float = ALIKE) -> DataFrame:
    """One row of each group of near duplicates, the one of its smallest id, with all its columns.

    Two rows are near duplicates if their fingerprints link, or if those of
    pairs of words do and their texts share so much of their five-word shingles.  Of
    rows that share the smallest id the one of the smallest hash stays, and of a
    group without ids too: a group keeps one row, and no row goes for another group's
    sake.  Null and empty texts are one group; very long texts are read whole; an
    empty table gives no rows; columns of any name are kept.
    """
    links = alike_links(docs, doc_id, text, threshold, similarity)
    gone = connected_components(links).where("node > label").select(F.col("node.id").alias("__id"), F.col("node.key").alias("__gone"))
    gone = few(checkpointed(gone))
    name = next(c for k in range(len(docs.columns) + 1) if (c := f"__key_{k}") not in docs.columns)
    keyed = docs.withColumn(name, F.xxhash64(f"`{doc_id}`", f"`{text}`"))
    same = (keyed[name] == gone["__gone"]) & keyed[doc_id].eqNullSafe(gone["__id"])
    kept = keyed.join(gone, same, "left_anti")
    if _repeats(docs.select(F.col(f"`{doc_id}`").alias("id"))):  # rows that repeat share a key
        kept = kept.dropDuplicates([doc_id, name])
    return kept.drop(name)
