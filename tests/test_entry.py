"""Driver contract: entry(), queries(), oracle_sql(), and Spark vs DuckDB parity at sf0.001."""

import __spark_entry__ as E
from conftest import SF_SMALL
from emporion.plans import catalog
from emporion.plans.parity import compare


def test_entry_returns_rows(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert df.columns == ["product_category_name_english", "total_delivered_items", "late_items", "late_pct"]


def test_every_query_with_sql_has_a_callable():
    assert set(E.oracle_sql()) <= set(E.queries())
    q, sql = catalog.queries(), catalog.oracle_sql()
    assert set(q) <= set(E.queries())
    without = set(q) - set(sql)
    assert without and all(k.startswith("h") for k in without)  # only model outputs lack SQL


def test_parity_sf0001(spark):
    sql = catalog.oracle_sql()
    names = [k for k in catalog.queries() if k in sql]
    report = compare(spark, SF_SMALL, names, verbose=False)
    bad = {k: v for k, v in report.items() if v["status"] != "match"}
    assert not bad, bad
