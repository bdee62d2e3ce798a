"""Shard placement through a lookup table filled by turns over the shards' preferences."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The lookup table never holds more rows than this, so it can always be broadcast.
MAX_SLOTS = 1_000_003


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def preference(shard: str, slots: int) -> tuple[int, int]:
    """First slot and step of the order in which a shard wants the slots."""
    return _number(f"{shard}/first") % slots, _number(f"{shard}/step") % (slots - 1) + 1


def fill(shards: Sequence[str], slots: int) -> list[int]:
    """Index of the shard that owns each slot.

    The shards take turns; on its turn each claims the first slot of its order that is free.
    With a prime number of slots every order visits all of them, so the shares differ by one slot
    at most, and a shard that leaves gives up little more than its own slots.
    """
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct names, at least one")
    if slots > MAX_SLOTS or slots < len(shards) or slots < 3 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError(f"slots must be a prime from the number of shards to {MAX_SLOTS}")
    orders = [preference(s, slots) for s in shards]
    at = [first for first, _ in orders]
    owner = [-1] * slots
    for turn in range(slots):
        shard = turn % len(shards)
        while owner[at[shard]] >= 0:
            at[shard] = (at[shard] + orders[shard][1]) % slots
        owner[at[shard]] = shard
    return owner


def lookup_table(spark: SparkSession, shards: Sequence[str], slots: int) -> DataFrame:
    """Rows (slot, shard): one for each slot."""
    owners = F.from_json(F.lit(json.dumps(fill(shards, slots))), "array<int>")
    names = F.from_json(F.lit(json.dumps(list(shards))), "array<string>")
    return spark.range(slots).select(
        F.col("id").cast("int").alias("slot"), F.get(names, F.get(owners, F.col("id").cast("int"))).alias("shard")
    )


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: its MD5 as a number, modulo the table's size.  Null counts as an empty text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(digest, 1, 15), 16, 10).cast("bigint") % slots).cast("int")


def place(df: DataFrame, key: str, shards: Sequence[str], slots: int = 65_537) -> DataFrame:
    """Add ``slot`` and ``shard`` to every row by its key.

    Rows with equal keys share a shard; null keys count as an empty text.  Columns of the input
    named slot or shard are replaced.  An empty table gives an empty result.  Only expressions and
    one join with the broadcast table (at most MAX_SLOTS rows): nothing is shuffled, so a hot
    source or a long text changes nothing.
    """
    table = lookup_table(df.sparkSession, shards, slots)
    rows = df.drop("shard").withColumn("slot", slot_of(F.col(key), slots))
    return rows.join(F.broadcast(table), "slot").select(*[c for c in rows.columns if c != "slot"], "slot", "shard")
