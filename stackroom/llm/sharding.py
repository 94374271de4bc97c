"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table; shards take
turns and claim their next free slot. The table depends on shard names alone, so a row's
place needs one hash and one lookup, and adding or removing a shard moves few rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Slots; prime, so that every stride visits all slots. Its two int columns are what is broadcast.
TABLE_SIZE = 65_537
MAX_TABLE_SIZE = 1_000_003


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def _seed(name: str, what: str) -> int:
    return int.from_bytes(hashlib.sha256(f"{what}:{name}".encode()).digest()[:8], "little")


def lookup_table(shards: list[str], size: int = TABLE_SIZE) -> list[int]:
    """For each slot the index of the shard that claimed it."""
    if not is_prime(size) or size > MAX_TABLE_SIZE:
        raise ValueError(f"the table size must be a prime up to {MAX_TABLE_SIZE}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > size:
        raise ValueError("shards need distinct names, and at least one and no more than slots")
    at = [_seed(s, "offset") % size for s in shards]
    stride = [_seed(s, "stride") % (size - 1) + 1 for s in shards]
    owner, left = [-1] * size, size
    while left:
        for k in range(len(shards)):
            while owner[at[k]] >= 0:
                at[k] = (at[k] + stride[k]) % size
            owner[at[k]] = k
            left -= 1
            if not left:
                break
    return owner


def slot_of(key, size: int = TABLE_SIZE):
    """Slot of a key column: 60 bits of its MD5 modulo the table size; null counts as the empty text."""
    return (F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long") % size).cast("int")


def place(df: DataFrame, key_col: str, shards: list[str], size: int = TABLE_SIZE) -> DataFrame:
    """``key_col, slot, shard`` for every row, in the rows' own partitions: no shuffle.

    The lookup table has ``size`` rows whatever the data, and is broadcast. Repeated keys,
    null keys and keys of any length get one place each; a key column that is itself named
    ``slot`` or ``shard`` comes back as ``key``; an empty table gives an empty result; other
    columns, also ones named slot or shard, are not read.
    """
    table = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards, size))], "_slot int, shard string")
    name = "key" if key_col.lower() in ("slot", "shard") else key_col
    rows = df.select(F.col(key_col).alias("_key"), slot_of(F.col(key_col), size).alias("_slot"))
    return rows.join(F.broadcast(table), "_slot").select(F.col("_key").alias(name), F.col("_slot").alias("slot"), "shard")


def write_sharded(df: DataFrame, key_col: str, shards: list[str], path: str, salts: int = 16) -> None:
    """Write whole rows in one folder per shard; each shard is cut by ``salts`` so no task holds one alone."""
    table = df.sparkSession.createDataFrame([(i, shards[k]) for i, k in enumerate(lookup_table(shards))], "_slot int, _shard string")
    rows = df.withColumn("_slot", slot_of(F.col(key_col))).withColumn("_salt", F.pmod(F.xxhash64(*[F.col(c) for c in df.columns]), F.lit(salts)))
    rows.join(F.broadcast(table), "_slot").repartition("_shard", "_salt").drop("_salt", "_slot").write.partitionBy("_shard").parquet(path)
