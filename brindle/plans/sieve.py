"""A sieve: which of many rows can't be in a set of keys, told in the scan.

The set is a bitmap over hashes of its keys. It is broadcast; its size is ``BITS_A_KEY``
bits for each key and ``MOST_BITS`` at most, whatever the number of keys. Rows that pass
may be in the set or not, so that they are joined as usual; the others need no join and
no shuffle. With more keys than bits more rows pass, and results stay the same.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_A_KEY, MOST_BITS = 16, 1 << 29
#: Bits of one bitmap of Spark's.
_WORD = 1 << 15


def sieve(keys: DataFrame, key: str) -> DataFrame:
    """The bitmap of a column of 64-bit hashes: a row for each part that has any, with the number of bits in all."""
    wanted, bits = keys.count() * BITS_A_KEY, _WORD
    while bits < min(wanted, MOST_BITS):
        bits *= 2
    place = F.pmod(F.col(key), F.lit(bits))
    # Keys are dealt first: a task that had keys of every part would send as many bitmaps.
    places = keys.select(F.bitmap_bucket_number(place).alias("part"), F.bitmap_bit_position(place).alias("offset")).repartition("part")
    parts = places.groupBy("part").agg(F.bitmap_construct_agg("offset").alias("map"))
    return parts.select("part", "map", F.lit(bits).alias("bits"))


def sifted(rows: DataFrame, key: Column, made: DataFrame, bits: int, into: str) -> DataFrame:
    """The rows with a new column ``into``: whether the key may be in the set. ``made`` is a sieve, and ``bits`` its number of bits."""
    part, bitmap = f"{into}_part", f"{into}_map"
    place = F.pmod(key, F.lit(bits))
    offset = F.bitmap_bit_position(place)
    parts = F.broadcast(made.select(F.col("part").alias(part), F.col("map").alias(bitmap)))
    joined = rows.join(parts, F.bitmap_bucket_number(place) == F.col(part), "left")
    byte = F.conv(F.hex(F.substring(F.col(bitmap), (F.floor(offset / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(into, F.coalesce(F.getbit(byte, (offset % 8).cast("int")) == 1, F.lit(False))).drop(part, bitmap)


def bits_of(made: DataFrame) -> int:
    """The number of bits of a sieve that was written; a sieve of nothing has one part's."""
    row = made.select("bits").first()
    return row.bits if row else _WORD
