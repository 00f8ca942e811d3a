"""Sharding with a permutation-filled lookup table.

Every shard has a preference order over the slots of a prime-sized table: it starts at an offset and goes on by a skip,
both from a hash of the shard's name. Shards take turns, each claiming its first free slot, until the table is full. A
key's slot is its hash modulo the table size, so placement is one lookup in a broadcast table whose size is a parameter.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Production parameters: a prime of over a hundred slots a shard.
SHARDS, TABLE_SIZE = 32, 4099


def _word(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(shards: int | list[str] = SHARDS, size: int = TABLE_SIZE) -> list[int]:
    """Slot -> shard number. ``size`` must be prime and not below the number of shards."""
    names = [f"shard-{i}" for i in range(shards)] if isinstance(shards, int) else list(shards)
    if not names or size < len(names) or any(size % k == 0 for k in range(2, int(size**0.5) + 1)):
        raise ValueError("size must be a prime, at least the number of shards")
    offset = [_word(f"offset:{n}") % size for n in names]
    skip = [_word(f"skip:{n}") % (size - 1) + 1 if size > 2 else 1 for n in names]
    table, turn, left = [-1] * size, [0] * len(names), size
    while left:
        for s in range(len(names)):
            while table[slot := (offset[s] + turn[s] * skip[s]) % size] >= 0:
                turn[s] += 1
            table[slot] = s
            turn[s] += 1
            left -= 1
            if not left:
                break
    return table


def table_frame(spark: SparkSession, table: list[int]) -> DataFrame:
    """The lookup table as rows (slot, shard), from a literal array."""
    packed = F.split(F.lit(",".join(map(str, table))), ",")
    return spark.range(1).select(F.posexplode(packed).alias("slot", "shard")).select("slot", F.col("shard").cast("int").alias("shard"))


def assign_shards(rows: DataFrame, key: str = "doc_id", shards: int | list[str] = SHARDS, size: int = TABLE_SIZE) -> DataFrame:
    """Adds slot and shard (int) to every row of ``rows``.

    A null key is placed as the empty string. Equal keys go to one shard. Columns of ``rows`` with these names are
    replaced. An empty table stays empty. The broadcast table has ``size`` rows, whatever the input.
    """
    word = F.conv(F.substring(F.md5(F.encode(F.coalesce(F.col(key).cast("string"), F.lit("")), "UTF-8")), 1, 15), 16, 10).cast("long")
    keyed = rows.drop("slot", "shard").withColumn("slot", F.pmod(word, F.lit(size)).cast("int"))
    return keyed.join(F.broadcast(table_frame(rows.sparkSession, lookup_table(shards, size))), "slot")
