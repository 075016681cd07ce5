"""The table by a plain filling, and placement of all kinds of keys."""

import xxhash
from pyspark.sql import functions as F

from lodestar.llm import queries, sharding

FOLDER = "/root/testdata/sf0.001"


def plain_table(shards, size):
    lists = []
    for s in shards:
        offset, skip = xxhash.xxh64_intdigest(s, seed=1) % size, xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1
        lists.append([(offset + skip * k) % size for k in range(size)])
        assert sorted(lists[-1]) == list(range(size))
    owner: dict = {}
    while len(owner) < size:
        for k, own in enumerate(lists):
            free = next((x for x in own if x not in owner), None)
            if free is not None:
                owner[free] = k
    return [owner[k] for k in range(size)]


def test_the_table_is_filled_by_turns():
    shards = [f"s{k}" for k in range(7)]
    assert sharding.fill_table(shards, 211).tolist() == plain_table(shards, 211)


def test_every_document_is_placed_by_its_hash(spark):
    table = sharding.fill_table(queries.SHARDS)
    hashes = {r.doc_id: r.h for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", F.xxhash64("doc_id").alias("h")).collect()}
    got = {r.doc_id: (r.slot, r.shard) for r in queries.op1_sharding(spark, FOLDER).collect()}
    assert got == {d: (h % sharding.TABLE_SIZE, queries.SHARDS[table[h % sharding.TABLE_SIZE]]) for d, h in hashes.items()}


def test_few_keys_move_when_a_shard_leaves():
    shards = [f"s{k}" for k in range(20)]
    before, after = sharding.fill_table(shards, 10_007), sharding.fill_table(shards[:-1], 10_007)
    stays = before != 19
    assert (before[stays] == after[stays]).mean() > 0.9


def test_weights_are_shares():
    owner = sharding.fill_table(["a", "b"], 1_009, [3, 1])
    assert abs((owner == 0).mean() - 0.75) < 0.01


def test_odd_rows_and_clashing_names(spark):
    rows = [(1, "k", "x"), (1, "k", "x"), (None, None, "y"), (2, "", "z"), (3, "long " * 100_000, "w")]
    df = spark.createDataFrame(rows, "slot long, shard string, `slot_0` string")
    by_slot = sharding.assign_shards(df, "slot", ["a", "b", "c"], 101).collect()
    assert len(by_slot) == len(rows) and set(by_slot[0].asDict()) == {"slot_0", "slot", "shard"}
    assert len({(r.slot, r.shard) for r in by_slot if r.slot_0 == "x"}) == 1
    by_shard = sharding.assign_shards(df, "shard", ["a", "b", "c"], 101).collect()
    assert all(0 <= r.slot < 101 and r.shard in "abc" for r in by_shard)
    assert sharding.assign_shards(df.limit(0), "slot", ["a"], 101).count() == 0
