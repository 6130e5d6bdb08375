"""A bitmap of keys, of a size that does not depend on how many there are: which rows need a join with them at all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits of the map: 8 MB at most, in parts of 4 KB.
BITS = 1 << 26


def _bit(key: list[str]) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(BITS)) + 1  # Spark's bitmap functions count from one


def marked(rows: DataFrame, keys: DataFrame, key: list[str], name: str = "suspect") -> DataFrame:
    """``rows`` with a boolean ``name``: false only where no row of ``keys`` has the same ``key``.

    Others are to be joined. The map has ``BITS`` bits, so it can be broadcast at any size of ``keys``; of very many keys all rows become suspects, and the join sees them all. Null parts of a key are passed over by its hash.
    """
    bits = keys.select(_bit(key).alias("bit")).groupBy(F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    at = rows.withColumns({"__bucket": F.bitmap_bucket_number(_bit(key)), "__at": F.bitmap_bit_position(_bit(key))}).join(F.broadcast(bits), "__bucket", "left")
    byte = F.conv(F.hex(F.expr("substring(__bits, cast(__at div 8 as int) + 1, 1)")), 16, 10).cast("int")
    on = F.expr("cast(__at % 8 as int)")
    there = F.call_function("shiftright", byte, on).bitwiseAND(F.lit(1)) == 1
    return at.withColumn(name, F.coalesce(there, F.lit(False))).drop("__bucket", "__at", "__bits")
