"""Placement of keys on shards by a permutation-filled lookup table.

Each shard has a preference order over the slots of a table of prime size: a start and a step from digests of its name. The shards take
turns, each claiming the next free slot it prefers, until the table is full. A key's slot is its digest modulo the size, so placement
is one lookup, shares differ by little, and a shard that comes or goes moves few of the other keys.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spliceflow.llm.common import unused

SLOTS = 65_537
SHARDS = tuple(f"shard-{k:03d}" for k in range(64))


def _number(label: str, name: str) -> int:
    return int.from_bytes(sha256(f"{label}:{name}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def lookup_table(shards: list[str] | tuple[str, ...], slots: int = SLOTS) -> list[int]:
    """The shard (its place in the sorted names) of each slot. The order in which the names are given doesn't matter."""
    names = sorted(set(shards))
    if not names or not _is_prime(slots) or slots < len(names):
        raise ValueError("needs at least one shard and a prime number of slots, no fewer than shards")
    start = [_number("start", x) % slots for x in names]
    step = [_number("step", x) % (slots - 1) + 1 for x in names]
    table, at, free = [-1] * slots, start[:], slots
    while free:
        for k in range(len(names)):
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % slots
            table[at[k]] = k
            free -= 1
            if not free:
                break
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Sixty bits of the key's digest (as text; a null key counts as empty) modulo the size of the table."""
    return (F.conv(F.substring(F.sha2(F.coalesce(key.cast("string"), F.lit("")), 256), 1, 15), 16, 10).cast("long") % slots).cast("int")


def place(rows: DataFrame, shards: list[str] | tuple[str, ...] = SHARDS, key_col: str = "doc_id", slots: int = SLOTS, slot_col: str = "slot", shard_col: str = "shard") -> DataFrame:
    """rows with slot_col and shard_col added as the last two columns; no row moves, all columns of rows stay.

    Rows that repeat a key are placed together, null keys like the empty text; an empty table gives an empty one. Where a column of rows
    has one of the two names already, the new one gets underscores in front. The broadcast table has `slots` rows whatever the input.
    """
    slot_col, shard_col = unused(rows, slot_col, shard_col)
    spark: SparkSession = rows.sparkSession
    names = sorted(set(shards))
    at, name = unused(rows, "at", "name")
    table = spark.createDataFrame([(slot, names[k]) for slot, k in enumerate(lookup_table(names, slots))], f"{at} int, {name} string")
    keyed = rows.withColumn(slot_col, slot_of(F.col(key_col), slots))
    return keyed.join(F.broadcast(table), F.col(slot_col) == F.col(at)).select(*keyed.columns, F.col(name).alias(shard_col))


def write_shards(rows: DataFrame, path: str, shards: list[str] | tuple[str, ...] = SHARDS, key_col: str = "doc_id", files_each: int = 4) -> None:
    """Writes rows to a folder for each shard; a shard's rows are dealt to files_each files, so that no task has a whole shard."""
    placed = place(rows, shards, key_col)
    shard = placed.columns[-1]
    placed.repartition(len(set(shards)) * files_each, shard, F.pmod(F.xxhash64(key_col), F.lit(files_each))).write.partitionBy(shard).parquet(path)
