"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has a preference order of the slots of a prime-sized table, a permutation given by an offset and a
step from a hash of its name.  The shards take turns, each claiming the first slot on its list
that is still free, until the table is full: all shards get the same number of slots but
for one, and losing a shard moves few slots of the others.  A document's slot is a hash of its
id modulo the table's size, its shard is what the table says there: one broadcast lookup, no shuffle.

The table has `size` rows, a documented bound, whatever the number of documents: unless given, the least prime with 127
slots for each shard.  A null doc_id goes to slot 0.  Repeated rows go where their id does; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLOTS = 127  # of each shard at least: their numbers differ by one, so by less than 0.8 %


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode(), usedforsecurity=False).hexdigest()[:12], 16)


def is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def table_size(shards: int) -> int:
    """The least prime that gives each shard SLOTS slots."""
    n = max(2, SLOTS * shards)
    while not is_prime(n):
        n += 1
    return n


def fill(names: list[str], size: int | None = None) -> list[int]:
    """The position in `names` that each slot of the table belongs to."""
    size = table_size(len(names)) if size is None else size
    if not names or len(set(names)) < len(names):
        raise ValueError("shards need distinct names")
    if not is_prime(size) or size < len(names):
        raise ValueError("the size must be a prime that is not below the number of shards")
    start = [_number("offset " + x) % size for x in names]
    step = [_number("step " + x) % (size - 1) + 1 for x in names]
    table, free, at = [-1] * size, size, list(start)
    while free:
        for k in range(len(names)):
            if not free:
                break
            while table[at[k]] >= 0:
                at[k] = (at[k] + step[k]) % size
            table[at[k]] = k
            free -= 1
    return table


def slot(doc_id: Column, size: int) -> Column:
    """A document's slot: 48 bits of the MD5 of its id as text, modulo the size."""
    return F.coalesce(F.conv(F.substring(F.md5(doc_id.cast("string").cast("binary")), 1, 12), 16, 10).cast("long") % size, F.lit(0))


def place(docs: DataFrame, names: list[str], size: int | None = None) -> DataFrame:
    """`docs` with slot and shard after its own columns; columns of these names are replaced."""
    size = table_size(len(names)) if size is None else size
    rows = [(i, names[k]) for i, k in enumerate(fill(names, size))]
    table = docs.sparkSession.createDataFrame(rows, "slot long, shard string")
    return docs.drop("slot", "shard").withColumn("slot", slot(F.col("doc_id"), size)).join(F.broadcast(table), "slot").select(*(c for c in docs.columns if c not in ("slot", "shard")), "slot", "shard")
