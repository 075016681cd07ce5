"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, and
the shards take turns claiming the first slot of theirs that is still free.
The table is even to within one slot, and most slots keep their owner when a
shard joins or leaves.  It has a fixed number of slots whatever the number of
documents, so it is broadcast; a document is placed by one hash and one lookup.
"""

from __future__ import annotations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TABLE_SIZE = 65_537
#: The table is broadcast: no more than so many slots (16 bytes each).
MAX_TABLE_SIZE = 4_194_301


def is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], size: int = TABLE_SIZE, weights: list[int] | None = None) -> np.ndarray:
    """The owner (an index into ``shards``) of each slot.

    A shard of weight w claims w slots in each of its turns.  The order of
    ``shards`` breaks ties only: names decide each shard's preferences.
    """
    if not shards or len(set(shards)) < len(shards):
        raise ValueError("shards must be distinct names, one at least")
    if not is_prime(size) or not len(shards) <= size <= MAX_TABLE_SIZE:
        raise ValueError(f"the table size must be a prime from the number of shards to {MAX_TABLE_SIZE}")
    weights = weights or [1] * len(shards)
    if len(weights) != len(shards) or min(weights) < 1:
        raise ValueError("a weight of 1 or more is needed for each shard")
    offset = [xxhash.xxh64_intdigest(s, seed=1) % size for s in shards]
    skip = [xxhash.xxh64_intdigest(s, seed=2) % (size - 1) + 1 if size > 2 else 1 for s in shards]
    owner = np.full(size, -1, dtype=np.int32)
    at, free = offset[:], size
    while free:
        for k, weight in enumerate(weights):
            for _ in range(min(weight, free)):
                while owner[at[k]] >= 0:
                    at[k] = (at[k] + skip[k]) % size
                owner[at[k]] = k
                free -= 1
    return owner


def slot_of(key: Column, size: int) -> Column:
    """The slot of a key: its 64-bit hash modulo the table's size."""
    return F.pmod(F.xxhash64(key), F.lit(size)).cast("int")


def assign_shards(
    df: DataFrame,
    key: str,
    shards: list[str],
    size: int = TABLE_SIZE,
    weights: list[int] | None = None,
    slot_col: str = "slot",
    shard_col: str = "shard",
) -> DataFrame:
    """All rows and columns of ``df`` with the slot and the shard of each row.

    Equal keys share a shard, and rows that repeat stay.  A null key is a key
    like any other: it hashes to a slot of its own.  Existing columns of the
    names ``slot_col`` and ``shard_col`` are replaced, the key too if it has such a
    name: it is hashed first.  Very long keys are hashed whole.  An empty frame gives an
    empty frame.  To spread one hot key, pass a key that tells its rows apart.
    """
    owner = fill_table(shards, size, weights)
    taken = {c.lower() for c in df.columns}
    at = next(c for k in range(len(taken) + 1) if (c := f"slot_{k}").lower() not in taken)
    table = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(owner.tolist())], f"`{at}` int, `{shard_col}` string")
    others = [F.col(f"`{c}`") for c in df.columns if c.lower() not in (slot_col.lower(), shard_col.lower())]
    placed = df.select(*others, slot_of(F.col(f"`{key}`"), size).alias(at))
    names = [c for c in placed.columns if c != at]
    joined = placed.join(F.broadcast(table), at)
    return joined.select(*[F.col(f"`{c}`") for c in names], F.col(at).alias(slot_col), F.col(f"`{shard_col}`"))
