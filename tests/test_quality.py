"""Data-quality checks on a fixture with known defects (FIXTURES dq_bad) and on driver data."""

from pyspark.sql import functions as F

from conftest import SF_SMALL, money, table, ts
from emporion.operators import quality as C
from emporion.sources.adapter import FrameStar, StarSchema


def _bad_star(spark):
    t = lambda name, rows: table(spark, name, rows)
    return FrameStar(spark, {
        "dim_customers": t("dim_customers", [
            {"customer_id": "c1", "customer_unique_id": "p1", "customer_state": "SP"},
            {"customer_id": "c2", "customer_unique_id": "p1", "customer_state": "TOOLONG"},
        ]),
        "dim_sellers": t("dim_sellers", [{"seller_id": "s1"}, {"seller_id": "s1"}]),  # duplicate key
        "dim_product_category_translation": t("dim_product_category_translation", []),  # empty table
        "dim_products": t("dim_products", [{"product_id": "p1", "product_category_name": "x"}]),
        "dim_orders": t("dim_orders", [
            {"order_id": "o1", "customer_id": "c1", "order_status": "delivered",
             "order_purchase_timestamp": ts("2018-01-05 00:00:00"),
             "order_delivered_customer_date": ts("2018-01-01 00:00:00")},
            {"order_id": "o2", "customer_id": "c9", "order_status": "delivered",
             "order_purchase_timestamp": ts("2018-01-05 00:00:00")},
        ]),
        "dim_reviews": t("dim_reviews", [
            {"review_id": "r1", "order_id": "o1", "review_score": 0},
            {"review_id": "r1", "order_id": "o2", "review_score": 6},
            {"review_id": "r2", "order_id": "o2", "review_score": None},
        ]),
        "fact_order_items": t("fact_order_items", [
            {"order_id": "o1", "order_item_id": 1, "product_id": "p1", "seller_id": "s1", "price": money(-1), "freight_value": money(1)},
            {"order_id": "o1", "order_item_id": 1, "product_id": None, "seller_id": "s1", "price": None, "freight_value": money(1)},
            {"order_id": "oX", "order_item_id": 2, "product_id": "p9", "seller_id": "s1", "price": money(3), "freight_value": money(1)},
        ]),
        "fact_order_payments": t("fact_order_payments", []),
    })


def test_null_thresholds_guard_empty_tables(spark):
    rows = {(r.table_name, r.column_name): r for r in C.null_thresholds(_bad_star(spark)).collect()}
    assert rows[("fact_order_items", "price")].null_count == 1
    assert rows[("fact_order_items", "price")].null_pct == round(100 / 3, 2)
    assert rows[("fact_order_items", "price")].status == "FAIL"
    assert rows[("fact_order_payments", "payment_value")].null_pct == 0.0  # empty table, no error
    assert rows[("dim_orders", "order_id")].status == "OK"


def test_duplicates_orphans_ranges_and_lengths(spark):
    star = _bad_star(spark)
    dup = {(r.table_name, r.key_columns): r for r in C.duplicates(star, documented_review_repeats=1).collect()}
    assert dup[("dim_sellers", "seller_id")].status == "UNEXPECTED"
    assert dup[("dim_reviews", "review_id")].status == "MATCHES DOCUMENTED FINDING"
    assert dup[("fact_order_items", "order_id,order_item_id")].duplicate_keys == 1

    orph = {(r.child_table, r.child_column): r for r in C.orphans(star).collect()}
    assert orph[("fact_order_items", "product_id")].orphan_rows == 2  # unknown key and NULL key
    assert orph[("fact_order_items", "order_id")].orphan_rows == 1
    assert orph[("dim_orders", "customer_id")].status == "BROKEN"
    assert orph[("dim_products", "product_category_name")].orphan_rows == 1  # empty parent

    rng = {(r.table_name, r.rule): r.violations for r in C.value_ranges(star).collect()}
    assert rng[("fact_order_items", "price < 0")] == 1
    assert rng[("dim_reviews", "review_score NOT BETWEEN 1 AND 5")] == 2  # NULL score is not counted
    assert rng[("dim_orders", "order_delivered_customer_date < order_purchase_timestamp")] == 1

    cons = {(r.table_name, r.column_name, r.rule): r.violations for r in C.declared_constraints(star).collect()}
    assert cons[("dim_customers", "customer_state", "max_length_2")] == 1
    assert cons[("fact_order_items", "product_id", "not_null")] == 1

    c8 = C.delivered_without_date(star, "delivered").first()
    assert (c8.status_without_date, c8.all_without_date) == (1, 1)

    people = C.people_vs_records(star).first()
    assert (people.total_records, people.distinct_people, people.returning_records) == (2, 1, 1)


def test_describe_and_value_counts(spark):
    df = spark.createDataFrame([(float(v),) for v in [1, 2, 3, 4, 100]] + [(None,)], "x double")
    d = C.describe(df, ["x"]).first()
    assert (d["count"], d["min"], d["p25"], d["p50"], d["p75"], d["max"]) == (5, 1.0, 2.0, 3.0, 4.0, 100.0)
    assert d["mean"] == 22.0
    vc = {r.x: (r["count"], r.share) for r in C.value_counts(df, "x").collect()}
    assert vc[1.0] == (1, 0.2) and None not in vc


def test_value_counts_of_many_values_stay_apart(spark):
    df = spark.range(20_000).selectExpr("id % 5000 AS x")
    vc = C.value_counts(df, "x")
    assert "Window" not in vc._jdf.queryExecution().executedPlan().toString()  # no window without keys
    assert {(r["count"], r.share) for r in vc.collect()} == {(4, 0.0002)} and vc.count() == 5000
    assert C.value_counts(df.limit(0), "x").count() == 0


def test_known_answers_driver_sf001(spark):
    # regression constants at sf0.01 (FIXTURES §2), both engines agree on them
    star = StarSchema(spark, "/root/testdata/sf0.01")
    dup = {(r.table_name, r.key_columns): r.duplicate_keys for r in C.duplicates(star).collect()}
    assert dup[("dim_reviews", "review_id")] == 32
    assert dup[("fact_order_items", "order_id,order_item_id")] == 11785
    orph = {(r.child_table, r.child_column): r for r in C.orphans(star).collect()}
    assert (orph[("dim_closed_deals", "seller_id")].orphan_rows, orph[("dim_closed_deals", "seller_id")].child_rows) == (1228, 3665)
    c8 = C.delivered_without_date(star, "F").first()
    assert (c8.status_without_date, c8.all_without_date) == (74, 5257)


def test_row_counts_small(spark):
    star = StarSchema(spark, SF_SMALL)
    rows = {r.table_name: r for r in C.row_count_reconciliation(star, C.adapter_raw_sources(star)).collect()}
    assert rows["dim_product_category_translation"].status == "OK (expected difference)"
    assert all(r.status.startswith("OK") for r in rows.values())


def test_quality_report_common_schema(spark):
    rep = C.quality_report(_bad_star(spark), "delivered")
    assert rep.columns == ["check_id", "table_name", "column_name", "metric", "observed", "expected", "status"]
    rows = rep.collect()
    assert {r.check_id for r in rows} == {"C2", "C3", "C4", "C5", "C6", "C7", "C8"}
    by = {(r.check_id, r.table_name, r.column_name, r.metric): r for r in rows}
    assert by[("C2", "fact_order_items", "price", "null_count")].status == "FAIL"
    assert by[("C6", "fact_order_items", "product_id", "orphans_to_dim_products")].observed == 2
    assert by[("C7", "dim_reviews", None, "review_score NOT BETWEEN 1 AND 5")].observed == 2
    assert by[("C8", "dim_orders", "order_delivered_customer_date", "status_delivered_without_date")].observed == 1


def _scans(df):
    import re

    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"FileScan parquet[^\n]*?(\w+)\.parquet|Scan ExistingRDD|LocalTableScan", plan)


def test_checks_by_row_scan_each_table_once(spark, tmp_path):
    from emporion.operators import rules as R
    from emporion.schemas import TABLES
    from emporion.sources.adapter import StoredStarSchema

    star = StarSchema(spark, SF_SMALL)
    for name, df in star.tables().items():
        cols = [F.col(c.name).cast(c.dtype).alias(c.name) if c.name in df.columns else F.lit(None).cast(c.dtype).alias(c.name)
                for c in TABLES[name].columns]
        df.select(*cols).write.parquet(str(tmp_path / name))
    stored = StoredStarSchema(spark, str(tmp_path))
    every = {"C1", "C2", "C3", "C5", "C7", "C8"}
    seen = R.observe(stored, R.rules_of(stored, every, delivered_status="F"))
    assert seen._jdf.queryExecution().executedPlan().toString().count("FileScan") == len(TABLES)
    # Over the adapter each table reads its own sources once: four tables come from the orders.
    scans = _scans(R.observe(star, R.rules_of(star, every, delivered_status="F")))
    assert {t: scans.count(t) for t in ("lineitem", "orders", "part")} == {"lineitem": 2, "orders": 4, "part": 1}
    assert C.quality_report(stored, "F").count() > 100


def test_suite_shares_one_observation_and_agrees_with_single_checks(spark):
    star = _bad_star(spark)
    names = ["null_thresholds", "status_dependent_nulls", "declared_constraints", "value_ranges", "delivered_without_date", "people_vs_records"]
    got = C.run_quality_suite(star, "delivered", names)
    assert list(got) == names
    for name in names:
        alone = C.SUITE[name](star, **({"delivered_status": "delivered"} if name == "delivered_without_date" else {}))
        assert sorted(map(tuple, got[name]), key=str) == sorted(map(tuple, alone.collect()), key=str), name


def test_decimals_that_do_not_fit_and_absent_columns(spark):
    from emporion.sources.adapter import FrameStar

    items = spark.createDataFrame([("o1", 1, "p", "s", 1e9, "5.00"), ("o2", 1, "p", "s", 10.25, None), ("o3", 1, "p", "s", None, "x")],
                                  "order_id string, order_item_id int, product_id string, seller_id string, price double, freight_value string")
    star = FrameStar(spark, {"fact_order_items": items, "dim_sellers": spark.createDataFrame([("01",)], "seller_zip_code_prefix string")})
    rows = {(r.table_name, r.column_name, r.rule): r.violations for r in C.declared_constraints(star).collect()}
    assert rows["fact_order_items", "price", "decimal_10_2"] == 1 and rows["fact_order_items", "freight_value", "decimal_10_2"] == 1
    assert rows["fact_order_items", "shipping_limit_date", "present"] == 1 and rows["dim_sellers", "seller_id", "present"] == 1
    star = _bad_star(spark)
    star.frames["dim_sellers"] = star.sellers.drop("seller_state")
    by = {(r.table_name, r.column_name, r.metric): r.status for r in C.quality_report(star, "delivered").collect()}
    assert by["dim_sellers", "seller_state", "present"] == "ABSENT"


def test_rules_of_empty_tables_give_zero(spark):
    star = _bad_star(spark)
    for name in ("dim_orders", "fact_order_items"):
        star.frames[name] = star.frames[name].limit(0)
    rows = C.quality_report(star, "delivered").collect()
    assert {r.observed for r in rows if r.table_name == "dim_orders" and r.check_id in ("C2", "C5", "C7", "C8")} == {0}
    assert not [r for r in rows if r.check_id == "C3"]
