"""A bounded table of bits that tells which rows cannot have a partner in a table of keys.

A key of 64 bits stands for one bit of at most 2^26, in words of 64; the table has a row for each word that has
a bit, so 2^20 rows at most whatever the number of keys, and may be broadcast.  Rows whose bit is not set
have no partner and need no shuffle; the others may have one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gazetrail.llm import storage

MOST = 26  # log2 of the bits


def bits(keys: DataFrame, column: str, most: int = MOST) -> tuple[DataFrame, int]:
    """((word, bits), log2 of the number of bits): 32 bits for each key, as far as `most` goes."""
    size = min(most, max(12, (32 * keys.count()).bit_length()))
    at = F.shiftrightunsigned(column, 64 - size)
    rows = keys.select(F.shiftright(at, 6).alias("word"), F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int")).alias("bit"))
    return storage.written(rows.groupBy("word").agg(F.bit_or("bit").alias("bits")), "sieve"), size


def split(rows: DataFrame, keys: DataFrame, column: str, most: int = MOST) -> DataFrame:
    """`rows` with `maybe`: false where `column` is not among that of `keys`, and rarely true where it isn't."""
    table, size = bits(keys, column, most)
    table = table.select(F.col("word").alias("_word"), F.col("bits").alias("_bits"))
    at = F.shiftrightunsigned(column, 64 - size)
    out = rows.join(F.broadcast(table), F.shiftright(at, 6) == F.col("_word"), "left")
    hit = F.call_function("shiftright", F.col("_bits"), at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    return out.withColumn("maybe", F.coalesce(hit, F.lit(False))).drop("_word", "_bits")
