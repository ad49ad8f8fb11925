"""Extendible hashing as DataFrame operations.

A directory is indexed by the leading bits of a 64-bit hash.  A bucket of local depth ``d``
owns all hashes that share its first ``d`` bits; only buckets over the limit split on another
bit.  The directory starts at the depth at which an average bucket would just fit and is
doubled (more bits are looked at) only for what is still too large.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporion.llm.common import materialize

BITS = 64


def prefix(h: str, depth: int) -> Column:
    """The first ``depth`` bits of a hash, as a number."""
    if depth <= 0:
        return F.lit(0).cast("long")
    return F.col(h) if depth >= BITS else F.shiftrightunsigned(F.col(h), BITS - depth)


def split_overfull(rows: DataFrame, h: str, weight: str, limit: int, doubling: int = 4, count: str | None = None) -> DataFrame:
    """``rows`` plus ``bucket`` (its hash prefix), ``depth`` (its local depth), ``bucket_weight``
    and ``bucket_count`` (rows, or the sum of column ``count``).

    Weights are summed per directory cell (map-side combined) and rolled up towards shorter
    prefixes; a cell belongs to the shortest prefix that fits ``limit`` or holds one row.
    Cells that fit at no depth looked at so far go to the next round, ``doubling`` bits deeper.
    Rows whose whole hashes are equal cannot be split: they end at depth 64, over the limit if
    need be.  ``rows`` should be a materialised table; an empty one gives an empty result.
    """
    total = rows.agg(F.sum(weight)).first()[0] or 0
    low = min(BITS, max(0, math.ceil(math.log2(max(1, total / max(1, limit)))) - 1))
    pending, done = rows, []
    while True:
        high = min(BITS, low + doubling)
        cells = pending.groupBy(prefix(h, high).alias("_cell")).agg(F.sum(weight).alias("_w"), F.count("*").alias("_n"), (F.sum(count) if count else F.count("*")).alias("_c"))
        up = lambda d: prefix("_cell", BITS - (high - d)) if d < high else F.col("_cell")
        cells = cells.withColumn("_low", up(low))
        best = []
        for d in range(low, high + 1):
            own = Window.partitionBy("_low", up(d)) if d > low else Window.partitionBy("_low")
            cells = cells.withColumn(f"_w{d}", F.sum("_w").over(own)).withColumn(f"_n{d}", F.sum("_n").over(own)).withColumn(f"_c{d}", F.sum("_c").over(own))
            fits = (F.col(f"_w{d}") <= limit) | (F.col(f"_n{d}") == 1) | F.lit(d == BITS)
            best.append(
                F.when(
                    fits,
                    F.struct(
                        up(d).alias("bucket"),
                        F.lit(d).alias("depth"),
                        F.col(f"_w{d}").alias("bucket_weight"),
                        F.col(f"_c{d}").alias("bucket_count"),
                    ),
                )
            )
        directory = materialize(cells.select("_cell", F.coalesce(*best).alias("_b")), "directory")
        placed = pending.withColumn("_cell", prefix(h, high)).join(directory, "_cell")
        done.append(placed.where("_b IS NOT NULL").select(*pending.columns, "_b.*"))
        if directory.where("_b IS NULL").isEmpty():
            break
        pending = placed.where("_b IS NULL").select(*pending.columns)
        low = high + 1
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def route(rows: DataFrame, h: str, directory: DataFrame) -> DataFrame:
    """``rows`` plus ``bucket`` and ``depth``: the bucket of ``directory`` (one row of these two
    columns for each) that owns the hash.  A row is looked up once for each local depth there is
    (65 at most); exactly one bucket owns its prefix."""
    depths = sorted(r["depth"] for r in directory.select("depth").distinct().collect())
    at = [F.struct(F.lit(d).alias("depth"), prefix(h, d).alias("bucket")) for d in depths]
    if not at:  # no bucket: no row has ever been seen
        return rows.withColumns({"bucket": F.lit(0).cast("long"), "depth": F.lit(0)}).limit(0)
    tried = rows.select("*", F.inline(F.array(*at)))
    return tried.join(directory, ["bucket", "depth"]).select(*rows.columns, "bucket", "depth")
