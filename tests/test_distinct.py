"""Distinct counts from bitmaps against plain sets, over several loads."""

import random

from emporion.functions import distinct as D


def test_merged_loads_count_like_sets(spark):
    rng = random.Random(8)
    loads = [[(rng.choice("ab"), rng.choice([f"k{rng.randrange(60_000)}", None]), i) for i in range(n)] for n in (30_000, 20_000, 0)]
    loads[1] += [("hot", "k1", 0)] * 9000 + [("new", "z", 0), ("nulls", None, 0)]
    known, tables = None, []
    for rows in loads:
        df = spark.createDataFrame(rows, "g string, key string, bucket int")
        known = D.extended(known, df)
        tables.append(D.bitmaps(df, known, ["g"]))
    numbers = sorted(r.number for r in known.collect())
    assert numbers == list(range(len({k for rows in loads for _, k, _ in rows if k})))  # dense over all loads
    got = {r.g: (r.rows, r.distinct_keys) for r in D.counted(D.merged(tables, ["g"]), ["g"]).collect()}
    every = [x for rows in loads for x in rows]
    assert got == {g: (sum(x[0] == g for x in every), len({x[1] for x in every if x[0] == g and x[1]})) for g in ("a", "b", "hot", "new", "nulls")}


def test_numbers_of_known_keys_do_not_change(spark):
    first = D.extended(None, spark.createDataFrame([("b",), ("d",), (None,)], "key string"))
    both = D.extended(first, spark.createDataFrame([("a",), ("b",), ("c",)], "key string"))
    before, after = ({r.key: r.number for r in t.collect()} for t in (first, both))
    assert before == {"b": 0, "d": 1} and after == {"b": 0, "d": 1, "a": 2, "c": 3}


def test_merging_exchanges_bitmaps_only_and_expands_nothing(spark):
    df = spark.range(100_000).selectExpr("id % 5 AS g", "id % 40000 AS key")
    known = D.extended(None, df)
    plan = D.counted(D.merged([D.bitmaps(df, known, ["g"])], ["g"]), ["g"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and "partial_bitmap_construct_agg" in plan and "partial_bitmap_or_agg" in plan
