"""Exact distinct counts that merge: a dense dictionary of keys, and bitmaps over its numbers.

A dictionary gives each key a number from 0 without gaps; a later load only adds its new keys, so
numbers never change.  The rows of a load become bitmaps by group: bit ``number`` is set where the
group has the key, 32,768 numbers a bitmap (Spark's ``bitmap_*`` functions), with the rows counted
beside it.  Bitmaps are built in the tasks that read the rows, so an exchange carries one bitmap for
each task, group and bucket and no keys; the bitmaps of several loads are or-ed, whatever rows they
came from, and counted.

A dictionary costs one exchange of the distinct new keys of a load.  Dense numbers keep bitmaps
full: numbers of a sparse key (a hash, an id with gaps) would cost a bitmap for a few keys each.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from emporion.session import materialize


def extended(known: DataFrame | None, keys: DataFrame, key: str = "key") -> DataFrame:
    """(key, number): the dictionary ``known`` with the keys it lacks added, numbered in ranges: each
    range counts its own keys, and the counts of the ranges before are added.  NULL is no key."""
    new = keys.filter(F.col(key).isNotNull()).select(key).distinct()
    if known is not None:
        new = new.join(known, key, "left_anti")
    number = F.monotonically_increasing_id()  # (range, place in it)
    placed = new.repartitionByRange(key).select(key, F.shiftright(number, 33).alias("range"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("n"))
    placed = materialize(placed, "dictionary-new")  # ranges are drawn by sampling: fixed once
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    ranges = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows"))
    offsets = ranges.select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    start = F.lit(0) if known is None else known.agg(F.count(F.lit(1))).scalar()
    added = placed.join(offsets, "range").select(key, (start + F.col("first") + F.col("n")).alias("number"))
    return materialize(added if known is None else known.unionByName(added), "dictionary")


def bitmaps(rows: DataFrame, known: DataFrame, by: list[str], key: str = "key") -> DataFrame:
    """``by``, bucket, bits, rows: the keys of each group as bitmaps.  Rows without a key, or with one
    that the dictionary lacks, count as rows of bucket NULL."""
    numbered = rows.select(*by, key).join(known, key, "left")
    bucket = F.bitmap_bucket_number(F.col("number") + 1)
    return numbered.groupBy(*by, bucket.alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("number") + 1)).alias("bits"), F.count(F.lit(1)).alias("rows"))


def merged(loads: list[DataFrame], by: list[str]) -> DataFrame:
    """The bitmaps of several loads as one table."""
    every = reduce(lambda a, b: a.unionByName(b), loads)
    return every.groupBy(*by, "bucket").agg(F.bitmap_or_agg("bits").alias("bits"), F.sum("rows").alias("rows"))


def counted(table: DataFrame, by: list[str]) -> DataFrame:
    """``by``, rows, distinct_keys."""
    return table.groupBy(*by).agg(
        F.sum("rows").alias("rows"), F.sum(F.when(F.col("bucket").isNotNull(), F.bitmap_count("bits")).otherwise(0)).alias("distinct_keys"))
