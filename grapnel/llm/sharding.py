"""Sharding by a permutation-filled lookup table.

Method.  The table has a prime number of slots.  Each shard's name gives a start and a step, and so a
permutation of all slots; shards take turns, each claiming the next free slot of its preference order,
until the table is full.  Loads differ by one slot at most, and when a shard comes or goes most slots
stay where they are.  A key's slot is its hash modulo the table's size: one broadcast lookup a row.

The table's size is a parameter (65,537 slots of two integers), so the broadcast never grows with the data.

Defined results.  A null key hashes as a fixed value and gets a shard like any key; repeated keys share a
shard; further columns are passed through, but those named ``slot`` or ``shard`` give way to the results.
"""

from __future__ import annotations

import xxhash
from pyspark.sql import DataFrame, functions as F

SLOTS = 65_537
SHARDS = 64


def lookup_table(shards: list[str], slots: int = SLOTS) -> list[int]:
    """The shard (its place in ``shards``) of every slot.  ``slots`` is prime and exceeds the shards' number."""
    if not shards or len(set(shards)) != len(shards):
        raise ValueError("shards must be distinct and at least one")
    if slots < 2 or len(shards) > slots or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("slots must be a prime number, no less than the number of shards")
    starts = [xxhash.xxh64_intdigest(s.encode(), seed=1) % slots for s in shards]
    steps = [xxhash.xxh64_intdigest(s.encode(), seed=2) % (slots - 1) + 1 for s in shards]
    table, wanted, left = [-1] * slots, starts[:], slots
    while True:
        for i, step in enumerate(steps):
            slot = wanted[i]
            while table[slot] >= 0:
                slot = (slot + step) % slots
            table[slot], wanted[i] = i, (slot + step) % slots
            left -= 1
            if not left:
                return table


def place(frame: DataFrame, key: str, shards: list[str], slots: int = SLOTS) -> DataFrame:
    """``frame`` with ``slot`` (int) and ``shard`` (string) as its last columns."""
    rows = list(enumerate(map(shards.__getitem__, lookup_table(shards, slots))))
    table = frame.sparkSession.createDataFrame(rows, "__slot int, __shard string")
    placed = frame.withColumn("__slot", F.pmod(F.xxhash64(F.col(key)), F.lit(slots)).cast("int")).join(F.broadcast(table), "__slot", "left")
    others = (F.col(f"`{c}`") for c in frame.columns if c not in ("slot", "shard"))
    return placed.select(*others, F.col("__slot").alias("slot"), F.col("__shard").alias("shard"))


def shard_loads(placed: DataFrame, text: str = "text") -> DataFrame:
    """Documents and characters a shard; summed in every task before anything moves."""
    return placed.groupBy("shard").agg(F.count("*").alias("n_docs"), F.sum(F.length(F.coalesce(F.col(text), F.lit("")))).alias("n_chars"))
