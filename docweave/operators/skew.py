"""Joins that stay spread where few keys hold most rows, and joins of a large table with few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows of a key that one task takes.
SHARE = 65_536


def spread_join(rows: DataFrame, keys: DataFrame, on: list[str], count: str, by: list[str]) -> DataFrame:
    """rows joined with keys, one row a key, whose column `count` says how many rows have the key: a key of many rows is
    stored once for each SHARE of them, and its rows are dealt to these by a hash of the columns `by`."""
    parts = F.greatest(F.ceil(F.col(count) / SHARE), F.lit(1))
    hot = keys.filter(F.col(count) > SHARE).select(*on, parts.alias("__parts"))
    dealt = rows.join(hot, on, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*by), F.col("__parts")), F.lit(0).cast("bigint"))).drop("__parts")
    copies = keys.withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), parts.cast("bigint") - 1)))
    return dealt.join(copies, [*on, "__part"]).drop("__part")


#: Cells of the bitmap that narrowed() broadcasts, 4 MB at most.
CELLS = 1 << 25


def narrowed(rows: DataFrame, column: str, keys: DataFrame, key: str) -> DataFrame:
    """rows without those whose `column` is surely not among keys[key], so that only few are shuffled to meet the keys. A
    bitmap of a fixed size is broadcast; the more keys, the more rows it lets through, so the join itself is still to come."""
    cell = lambda c: F.pmod(F.xxhash64(c), F.lit(CELLS)) + 1
    bits = keys.select(F.bitmap_bucket_number(cell(key)).alias("__bucket"), F.bitmap_bit_position(cell(key)).alias("__at")).groupBy("__bucket").agg(F.bitmap_construct_agg("__at").alias("__bits"))
    at = F.bitmap_bit_position(cell(column))
    byte = F.conv(F.hex(F.substring("__bits", (at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    met = rows.withColumn("__bucket", F.bitmap_bucket_number(cell(column))).join(F.broadcast(bits), "__bucket")
    return met.filter(F.getbit(byte, (at % 8).cast("int")) == 1).select(*rows.columns)
