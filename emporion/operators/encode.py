"""One-hot encoding as tables: levels with dense numbers, and sparse encoded rows.

The levels of all categorical columns are numbered from 0 in order of (column, level), the order in
which the slots of a one-hot vector follow one another, without a list of levels on the driver or
in one task: distinct levels are sorted in ranges, each range counts its own, and the sums of the
counts before a range (a row for each range) are added to a level's place in it.

A row is encoded by a join on (column, level); a level that the training rows do not have finds no
partner, so all its slots stay zero.  NULL is a level of its own, as in the model.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from emporion.operators import features as H
from emporion.session import materialize
from emporion.sources.adapter import StarSchema

NULL_LEVEL = "__null__"


def _cells(columns: list[str]) -> Column:
    """(place, level) of each categorical column of a row."""
    return F.explode(F.array(*[
        F.struct(F.lit(i).alias("place"), F.coalesce(F.col(c).cast("string"), F.lit(NULL_LEVEL)).alias("level")) for i, c in enumerate(columns)
    ]))


def level_table(train: DataFrame, columns: list[str]) -> DataFrame:
    """slot, column_name, level: the levels of the training rows, numbered densely."""
    distinct = train.select(_cells(columns).alias("c")).select("c.*").distinct()
    ranges = distinct.repartitionByRange("place", "level").sortWithinPartitions("place", "level")
    number = F.monotonically_increasing_id()  # (range, place in it)
    placed = ranges.select("place", "level", F.shiftright(number, 33).alias("range"), number.bitwiseAND(F.lit((1 << 33) - 1)).alias("n"))
    placed = materialize(placed, "levels")  # the ranges are drawn by sampling: fixed once
    before = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # over a row a range
    offsets = placed.groupBy("range").agg(F.count(F.lit(1)).alias("rows")).select("range", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("first"))
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1)
    return placed.join(offsets, "range").select((F.col("first") + F.col("n")).alias("slot"), names.alias("column_name"), "level")


def encoded(rows: DataFrame, levels: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Sparse one-hot rows: ``keys``, slot, value (1.0); rows of unseen levels have fewer slots."""
    names = F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("c.place") + 1)
    long = rows.select(*keys, _cells(columns).alias("c")).select(*keys, names.alias("column_name"), F.col("c.level").alias("level"))
    return long.join(levels, ["column_name", "level"]).select(*keys, "slot", F.lit(1.0).alias("value"))


def one_hot_summary(star: StarSchema) -> DataFrame:
    """H4 on the v1 table: every one-hot slot of the training levels, with the training and test rows
    in which it is set and the sums of its column there; numeric columns pass through."""
    columns = H.V1_CATEGORICAL
    table = H.training_table_v1(star).select(H.in_test().alias("test"), *columns, *H.V1_NUMERIC)
    levels = level_table(table.filter(~F.col("test")), columns)
    counts = (  # rows of a level are combined before they meet it
        table.select("test", _cells(columns).alias("c")).groupBy("test", "c.place", "c.level").agg(F.count(F.lit(1)).alias("rows"))
        .withColumn("column_name", F.element_at(F.array(*[F.lit(c) for c in columns]), F.col("place") + 1))
    )

    def of(test: bool, x: Column) -> Column:
        return F.coalesce(F.sum(F.when(F.col("test") == test, x)), F.lit(0))

    hot = levels.join(counts, ["column_name", "level"]).groupBy("slot", F.concat(F.lit("cat__"), "column_name", F.lit("_"), "level").alias("feature")).agg(
        of(False, F.col("rows")).alias("train_rows"), of(True, F.col("rows")).alias("test_rows"))
    hot = hot.select("slot", "feature", "train_rows", "test_rows", F.col("train_rows").cast("double").alias("train_sum"), F.col("test_rows").cast("double").alias("test_sum"))
    # Numbers with at most two decimals: summed as decimals, whatever the order of the rows.
    cells = [F.struct(F.lit(i).alias("i"), F.lit(f"remainder__{c}").alias("feature"), F.col(c).cast("decimal(18,2)").alias("x")) for i, c in enumerate(H.V1_NUMERIC)]
    numbers = table.select("test", F.explode(F.array(*cells)).alias("c")).select("test", "c.*").groupBy("i", "feature").agg(
        of(False, (F.col("x") != 0).cast("int")).alias("train_rows"), of(True, (F.col("x") != 0).cast("int")).alias("test_rows"),
        of(False, F.col("x")).cast("double").alias("train_sum"), of(True, F.col("x")).cast("double").alias("test_sum"))
    slots = levels.agg(F.count(F.lit(1))).scalar()
    return hot.unionByName(numbers.select((slots + F.col("i")).alias("slot"), "feature", "train_rows", "test_rows", "train_sum", "test_sum"))
