"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table; the shards take
turns, each claiming its next free slot, until the table is full. Slots differ by at most one
between shards, and adding or losing a shard moves few of them. A key is placed by one lookup.

Edge cases: a null key has a place of its own (that of the empty string); equal keys always share a
shard; an empty table stays empty. Columns of the input named `slot` or `shard` are replaced, also if
one of them is the key.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A prime over 100 times the number of shards keeps the shares within one per cent.
TABLE_SIZE = 65_537


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot, the number of its shard."""
    if not shards or len(set(shards)) != len(shards) or size < len(shards):
        raise ValueError("shards must be distinct, some, and no more than slots")
    number = lambda s, salt: int.from_bytes(hashlib.sha256(f"{salt}:{s}".encode()).digest()[:8], "big")
    start = [number(s, "offset") % size for s in shards]
    skip = [number(s, "skip") % (size - 1) + 1 for s in shards]
    table, turn, filled = [-1] * size, [0] * len(shards), 0
    while True:
        for i in range(len(shards)):
            slot = (start[i] + turn[i] * skip[i]) % size
            while table[slot] >= 0:
                turn[i] += 1
                slot = (start[i] + turn[i] * skip[i]) % size
            table[slot] = i
            turn[i] += 1
            filled += 1
            if filled == size:
                return table


def slot_of(key: Column, size: int = TABLE_SIZE) -> Column:
    """The slot of a key: 60 bits of the MD5 of its text, modulo the table's size."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15)
    return F.conv(digest, 16, 10).cast("long") % F.lit(size)


def assign_shards(df: DataFrame, key: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """All columns, the key's slot and its shard. The table, of fixed size, is broadcast."""
    spark = df.sparkSession
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in ("slot", "shard")]
    placed = df.select(*kept, slot_of(F.col(f"`{key}`"), size).alias("slot"))
    names = [(i, shards[s]) for i, s in enumerate(lookup_table(shards, size))]
    table = spark.createDataFrame(names, "slot long, shard string")
    return placed.join(F.broadcast(table), "slot").select(*kept, "slot", "shard")
