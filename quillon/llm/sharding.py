"""Sharding by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a prime-sized table, given by an offset and a step. The shards
take turns; at its turn a shard claims the first slot of its permutation that is still free. Each shard ends with the
same number of slots, give or take one, and when a shard is added or removed most slots keep their shard.

The table has a fixed size, is filled once on the driver and broadcast; a row is placed by one hash and one lookup in
a dense long-keyed hash relation. There is no shuffle, so hot keys cost nothing but an uneven shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import at, columns_but, packed, unpacked

#: Slots of the production table: a prime, some hundred times the number of shards or more.
SLOTS = 65_537
#: Production shards.
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))
#: Tables up to this many slots are broadcast (about 16 bytes a slot); larger ones are refused.
MAX_SLOTS = 5_000_011


def _digest(text: str, salt: str) -> int:
    return int.from_bytes(hashlib.md5(f"{salt}:{text}".encode()).digest()[:8], "big")


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """For each slot the number of the shard that claimed it."""
    if len(set(shards)) != len(shards) or not shards:
        raise ValueError("shard names must be distinct, and at least one is needed")
    if not _is_prime(slots) or slots > MAX_SLOTS or slots < len(shards):
        raise ValueError(f"the number of slots must be a prime from the number of shards to {MAX_SLOTS}")
    at = [_digest(s, "offset") % slots for s in shards]
    step = [_digest(s, "step") % (slots - 1) + 1 if slots > 2 else 1 for s in shards]
    table, free = [-1] * slots, slots
    while True:
        for i in range(len(shards)):
            slot = at[i]
            while table[slot] >= 0:
                slot = (slot + step[i]) % slots
            table[slot] = i
            at[i] = (slot + step[i]) % slots
            free -= 1
            if not free:
                return table


def table_frame(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    rows = [(slot, shards[i]) for slot, i in enumerate(fill_table(shards, slots))]
    return spark.createDataFrame(rows, "slot bigint, shard string")


def assign_shards(df: DataFrame, key: str = "doc_id", shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """Add slot (bigint) and shard (string); columns of these names in the input are replaced.

    The slot is the first 32 bits of the MD5 digest of the key's text, modulo the number of slots.

    Edge cases: a null key is placed like an empty text. Equal keys, and so repeated rows, share a shard; that is what
    placement by key means, and no task gathers them. An empty table gives an empty result.
    """
    kept = columns_but(df, ("slot", "shard"))
    text = F.coalesce(at(key).cast("string"), F.lit(""))
    slot = F.pmod(F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint"), F.lit(slots)).cast("bigint")
    placed = df.select(packed(kept), slot.alias("slot"))
    table = table_frame(df.sparkSession, shards, slots)
    return placed.join(F.broadcast(table), "slot", "left").select(*unpacked(kept), "slot", "shard")
