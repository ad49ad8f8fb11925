"""Exact distributed quantiles against numpy's linear interpolation."""

import numpy as np
import pytest

from emporion.functions.quantiles import exact_median, exact_quantiles, exact_quantiles_of


@pytest.mark.parametrize("n", [1, 2, 7, 1000])
def test_quantiles_match_numpy(spark, n):
    rng = np.random.default_rng(n)
    vals = rng.normal(size=n).round(3).tolist()
    df = spark.createDataFrame([(v,) for v in vals] + [(None,)], "x double")
    probs = [0.0, 0.25, 0.5, 0.75, 1.0]
    got = exact_quantiles(df, "x", probs)
    want = np.quantile(np.array(vals), probs)  # method="linear"
    assert np.allclose(got, want, rtol=0, atol=1e-12)


def test_hot_value_holding_a_third(spark):
    vals = [5.0] * 400 + list(range(800))
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    assert exact_median(df, "x") == float(np.median(vals))
    assert exact_median(df.repartition(7).orderBy("x"), "x") == float(np.median(vals))  # row order is no matter


def test_wide_ranges_and_close_neighbours(spark):
    vals = [-1e300, -1.0, 0.0, 1e-300, 1.0, np.nextafter(1.0, 2.0), 2.0, 1e18, 1.5e308]
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    got = exact_quantiles(df, "x", [i / 8 for i in range(9)])
    assert got == vals


def test_empty_column(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert exact_quantiles(df, "x", [0.5]) == [None]


def test_several_columns_at_once(spark):
    rng = np.random.default_rng(5)
    a = rng.integers(0, 50, size=301).tolist()
    b = rng.normal(size=301).tolist()
    df = spark.createDataFrame([(float(x), float(y) if i % 7 else None) for i, (x, y) in enumerate(zip(a, b))], "a double, b double")
    q = exact_quantiles_of(df, ["a", "b"], [0.1, 0.5, 0.9])
    bb = [y for i, y in enumerate(b) if i % 7]
    assert np.allclose(q["a"], np.quantile(a, [0.1, 0.5, 0.9]))
    assert np.allclose(q["b"], np.quantile(bb, [0.1, 0.5, 0.9]))


def test_a_sketch_and_one_count_settle_values_without_large_ties(spark):
    from pyspark.sql import functions as F

    from emporion.functions import quantiles as Q

    df = spark.range(0, 60_000, 1, 6).select((F.xxhash64("id") % 1_000_000_007).cast("double").alias("x"), (F.col("id") % 7).alias("few"), F.lit(None).cast("int").alias("none"))
    passes, count = [], Q._values_at

    def counted(*a):
        got = count(*a)
        passes.append(got[1])
        return got

    Q._values_at = counted
    try:
        got = Q.exact_quantiles_of(df, ["x", "few", "none"], [0.0, 0.25, 0.5, 0.75, 1.0])
    finally:
        Q._values_at = count
    assert passes == [1]  # beside the sketch: two scans in all
    rows = sorted(r.x for r in df.select("x").collect())
    at = lambda p: rows[int((len(rows) - 1) * p)] + ((len(rows) - 1) * p % 1) * (rows[min(len(rows) - 1, int((len(rows) - 1) * p) + 1)] - rows[int((len(rows) - 1) * p)])
    assert got["x"] == [at(p) for p in (0.0, 0.25, 0.5, 0.75, 1.0)]
    assert got["few"] == [0, 1, 3, 5, 6] and got["none"] == [None] * 5


def test_brackets_that_miss_their_rank_only_cost_passes(spark):
    from emporion.functions import quantiles as Q

    df = spark.range(0, 5000, 1, 3).selectExpr("CAST(id * id AS DOUBLE) AS x")
    wrong = {("x", 10): (1e6, 2e6), ("x", 2500): (0.0, 1.0), ("x", 4999): (5.0, 5.0), ("x", 3000): (9e6, 9e6)}
    got, passes = Q._values_at(df, wrong)
    assert got == {("x", r): float(r * r) for r in (10, 2500, 4999, 3000)} and 1 < passes <= 4
