"""Bucketed warehouse: the order-grain join runs without a shuffle and gives the same answer."""

from collections import Counter

from conftest import SF_SMALL
from emporion.operators import analytics as A
from emporion.session import scratch_dir
from emporion.sources.adapter import CatalogStarSchema, StarSchema
from emporion.sources.warehouse import write_bucketed_star


def _rows(df):
    return Counter(tuple(r) for r in df.collect())


def test_bucketed_join_has_no_exchange(spark):
    star = StarSchema(spark, SF_SMALL)
    write_bucketed_star(star.tables(), "emporion_bkt", scratch_dir(spark, "bucketed"), buckets=4)
    cat = CatalogStarSchema(spark, "emporion_bkt")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # force the shuffle-join path
        joined = cat.items.select("order_id", "price").join(cat.orders.select("order_id", "order_status"), "order_id")
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Exchange" not in plan
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert _rows(A.delay_by_category(cat)) == _rows(A.delay_by_category(star))
    assert _rows(A.kpis(cat)) == _rows(A.kpis(star))
