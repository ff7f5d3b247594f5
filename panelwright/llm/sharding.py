"""Shard placement by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a prime-sized table; shards take
turns claiming the first slot of theirs that is still free. A key's hash names a slot, the slot
names the shard: constant time per row, nearly equal shares, and few moves when shards change.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelwright.llm.common import free_name


def _number(name: str, salt: str) -> int:
    return int(hashlib.md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def _prime(n: int) -> bool:
    return n > 1 and all(n % d for d in range(2, int(n**0.5) + 1))


def fill_table(shards: list[str], slots: int = 65_537, turns: dict[str, int] | None = None) -> np.ndarray:
    """Slot -> index into ``shards``.

    Preference of a shard: slots ``offset, offset + skip, ...`` modulo the prime ``slots``, a
    permutation of all slots. ``turns`` gives a shard more claims a round (default 1).
    """
    if not _prime(slots) or not 0 < len(shards) <= slots or len(set(shards)) < len(shards):
        raise ValueError("a prime number of slots, at least as many as distinct shards, is needed")
    at = [_number(s, "offset") % slots for s in shards]
    skip = [_number(s, "skip") % (slots - 1) + 1 for s in shards]
    claims = [max(1, (turns or {}).get(s, 1)) for s in shards]
    owner, free = np.full(slots, -1, np.int32), slots
    while free:
        for i in range(len(shards)):
            for _ in range(min(claims[i], free)):
                while owner[at[i]] >= 0:
                    at[i] = (at[i] + skip[i]) % slots
                owner[at[i]] = i
                free -= 1
    return owner


def slot_of(key: Column, slots: int) -> Column:
    """Slot of a key: the first 15 hex digits of its MD5, modulo the table size; null as ''."""
    digest = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit(""))), 1, 15)
    return F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(slots)).cast("int")


def place(
    docs: DataFrame, key: str, shards: list[str], slots: int = 65_537, turns: dict[str, int] | None = None,
    slot: str = "slot", shard: str = "shard",
) -> DataFrame:
    """``docs`` with the slot and the shard of each row's ``key``.

    The table has ``slots`` rows of 8 bytes and a name whatever the input's size, so it is
    broadcast; rows are placed where they are read and none is shuffled, so a key that holds a
    third of all rows costs no task more than its share. Equal keys, repeated rows and null
    keys (placed as the empty string) always meet in one shard. Columns named as ``slot`` and
    ``shard`` are replaced; all others, null or not, pass through; empty tables stay empty.
    """
    owner = fill_table(shards, slots, turns)
    at, name = free_name(docs, "_slot"), free_name(docs, "_shard")
    table = docs.sparkSession.createDataFrame(
        pd.DataFrame({at: np.arange(slots, dtype=np.int32), name: np.array(shards, object)[owner]}), f"`{at}` int, `{name}` string")
    placed = docs.withColumn(at, slot_of(F.col(f"`{key}`"), slots)).join(F.broadcast(table), at)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in (slot, shard)]
    return placed.select(*kept, F.col(at).alias(slot), F.col(name).alias(shard))
