"""CSV ingest, warehouse load plan, category patch and geolocation reduce."""

import os

from pyspark.sql import functions as F

from conftest import table
from emporion.schemas import TABLES
from emporion.sources import csv_io
from emporion.sources.adapter import StoredStarSchema
from emporion.sources.warehouse import KNOWN_MISSING_CATEGORIES, insert_if_absent, reduce_geolocation

REVIEWS_CSV = (
    'review_id,order_id,review_score,review_comment_title,review_comment_message\n'
    'r1,o1,5,"Great, fast","said ""wow""\nand left"\n'
    'r2,o2,NA,,NA\n'
    'r3,o3,,"",""\n'
)


def _write(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as fh:
        fh.write(text)


def test_read_csv_quotes_newlines_and_null_tokens(spark, tmp_path):
    p = str(tmp_path / "reviews.csv")
    _write(p, REVIEWS_CSV)
    df = csv_io.read_table_csv(spark, p, "dim_reviews")
    rows = {r.review_id: r for r in df.collect()}
    assert csv_io.count_records(spark, p) == 3  # records, not lines (A9)
    assert rows["r1"].review_comment_title == "Great, fast"
    assert rows["r1"].review_comment_message == 'said "wow"\nand left'
    assert rows["r2"].review_score is None  # NA in a typed column is NULL (T11)
    assert rows["r2"].review_comment_message == "NA"  # free text keeps the literal token
    assert rows["r3"].review_score is None and rows["r3"].review_comment_title is None
    assert df.schema["review_creation_date"].dataType.typeName() == "timestamp_ntz"  # absent column -> NULL


def test_zip_prefix_keeps_leading_zero(spark, tmp_path):
    p = str(tmp_path / "sellers.csv")
    _write(p, "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01037,campinas,SP\n")
    row = csv_io.read_table_csv(spark, p, "dim_sellers").first()
    assert row.seller_zip_code_prefix == "01037"  # T10


def test_geolocation_reduce_first_non_null_in_file_order(spark, tmp_path):
    p = str(tmp_path / "geo.csv")
    _write(p, "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
              "01037,-23.5456781,-46.6393412,,SP\n"
              "01037,-23.5456789,-46.6393418,sao paulo,SP\n"
              "01037,-23.5456799,-46.6393422,são paulo,SP\n"
              ",-1.0,-1.0,nowhere,XX\n")
    raw = csv_io.read_table_csv(spark, p, "dim_geolocation", with_seq=True)
    rows = reduce_geolocation(raw).collect()
    assert len(rows) == 1  # NULL zip dropped
    r = rows[0]
    assert r.geolocation_city == "sao paulo"  # first non-null in file order (T8)
    assert str(r.geolocation_lat) == "-23.545679"  # mean of 7-decimal values, DECIMAL(10,6)


def test_insert_if_absent(spark):
    base = table(spark, "dim_product_category_translation",
                 [{"product_category_name": "pc_gamer", "product_category_name_english": "kept"}])
    out = insert_if_absent(spark, base, KNOWN_MISSING_CATEGORIES + [("pc_gamer", "dup")], "product_category_name")
    got = {r[0]: r[1] for r in out.collect()}
    assert got["pc_gamer"] == "kept"  # existing row wins (ON CONFLICT DO NOTHING)
    assert got["portateis_cozinha_e_preparadores_de_alimentos"] == "portable_kitchen_food_preparers"
    assert len(got) == 2


def _raw_dir(tmp):
    d = os.path.join(tmp, "raw")
    files = {
        "dim_customers": "customer_id,customer_unique_id,customer_zip_code_prefix,customer_city,customer_state\nc1,p1,01037,x,SP\n",
        "dim_sellers": "seller_id,seller_zip_code_prefix,seller_city,seller_state\ns1,01037,x,SP\n",
        "dim_product_category_translation": "product_category_name,product_category_name_english\ncama,bed\n",
        "dim_products": "product_id,product_category_name,product_weight_g\np1,cama,500\n",
        "dim_geolocation": "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n01037,-23.5,-46.6,sp,SP\n01037,-23.7,-46.8,sp2,SP\n",
        "dim_orders": "order_id,customer_id,order_status,order_purchase_timestamp,order_delivered_customer_date,order_estimated_delivery_date\no1,c1,delivered,2018-01-01 10:00:00,2018-01-05 10:00:00,2018-01-10 00:00:00\n",
        "dim_reviews": REVIEWS_CSV,
        "fact_order_items": "order_id,order_item_id,product_id,seller_id,shipping_limit_date,price,freight_value\no1,1,p1,s1,2018-01-02 00:00:00,10.50,2.25\n",
        "fact_order_payments": "order_id,payment_sequential,payment_type,payment_installments,payment_value\no1,1,credit_card,1,12.75\n",
        "dim_marketing_leads": "mql_id,first_contact_date,landing_page_id,origin\nm1,2018-01-01,lp,social\n",
        "dim_closed_deals": "mql_id,seller_id,won_date\nm1,s1,2018-02-01\n",
    }
    for name, text in files.items():
        _write(os.path.join(d, TABLES[name].raw_file), text)
    return d


def test_load_warehouse_is_idempotent(spark, tmp_path):
    raw = _raw_dir(str(tmp_path))
    out = str(tmp_path / "wh")
    csv_io.load_warehouse(spark, raw, out)
    first = {n: sorted(map(tuple, spark.read.parquet(os.path.join(out, n)).collect())) for n in TABLES}
    csv_io.load_warehouse(spark, raw, out)  # A2: a rerun replaces, never appends
    second = {n: sorted(map(tuple, spark.read.parquet(os.path.join(out, n)).collect())) for n in TABLES}
    assert first == second
    assert len(first["dim_product_category_translation"]) == 3  # 1 raw + 2 patched (A4)
    assert len(first["dim_geolocation"]) == 1  # reduced per zip (A5)
    star = StoredStarSchema(spark, out)
    items = star.items.first()
    assert str(items.price) == "10.50" and star.orders.first().order_purchase_timestamp.hour == 10


def test_export_and_read_back_top(spark, tmp_path):
    df = spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.3)], "feature string, importance double")
    p = csv_io.write_csv(df, str(tmp_path / "imp"), single_file=True)
    back = csv_io.read_result_csv(spark, p, "feature string, importance double", top=2,
                                  order_by=[F.desc("importance")])
    assert [r.feature for r in back.collect()] == ["b", "c"]


def test_export_model_outputs(spark, tmp_path):
    from tests_support import planted_star

    star = planted_star(spark, n=200)
    from emporion.operators import model as M

    star._evaluations = {("v2_balanced", ()): M.evaluate(star, "v2_balanced", num_trees=5, max_depth=3)}
    paths = csv_io.export_model_outputs(star, str(tmp_path / "out"))
    seg = spark.read.option("header", True).csv(paths["customer_rfm_segments"])
    assert seg.count() == 200 and "segment" in seg.columns
    imp = csv_io.read_result_csv(spark, paths["feature_importances"], "feature string, importance double", top=15,
                                 order_by=[F.desc("importance")])
    assert imp.count() <= 15
    summary = spark.read.option("header", True).csv(paths["rfm_segment_summary"])
    assert summary.columns[0] == "segment"


def test_first_city_is_that_of_the_first_file(spark, tmp_path):
    from emporion.sources.warehouse import reduce_geolocation

    head = "geolocation_zip_code_prefix,geolocation_lat,geolocation_lng,geolocation_city,geolocation_state\n"
    raw = tmp_path / "geo"
    raw.mkdir()
    (raw / "part-0.csv").write_text(head + "01,1.0,2.0,first,AA\n")
    (raw / "part-1.csv").write_text(head + "".join(f"01,1.0,2.0,second{i},BB\n" for i in range(5000)))  # larger, so read first
    got = reduce_geolocation(csv_io.read_table_csv(spark, str(raw), "dim_geolocation", with_seq=True)).first()
    assert (got.geolocation_city, got.geolocation_state) == ("first", "AA")


def test_plain_tables_are_read_by_several_tasks(spark, tmp_path):
    path = tmp_path / "items.csv"
    path.write_text("order_id,order_item_id,price\n" + "".join(f"o{i},1,{i}.50\n" for i in range(20000)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        df = csv_io.read_table_csv(spark, str(path), "fact_order_items")
        assert df.rdd.getNumPartitions() > 3 and df.count() == 20000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quality_report_of_a_loaded_warehouse(spark, tmp_path):
    from emporion.operators import quality as C

    raw, out = _raw_dir(str(tmp_path)), str(tmp_path / "wh")
    csv_io.load_warehouse(spark, raw, out)
    rows = C.quality_report(StoredStarSchema(spark, out), "delivered", C.csv_raw_sources(spark, raw)).collect()
    counts = {r.table_name: r.status for r in rows if r.check_id == "C1"}
    assert counts.pop("dim_product_category_translation") == "OK (expected difference)"
    assert len(counts) == 9 and set(counts.values()) == {"OK"}
    os.remove(os.path.join(out, "dim_customers", next(f for f in os.listdir(os.path.join(out, "dim_customers")) if f.startswith("part-"))))
    lost = C.row_count_reconciliation(StoredStarSchema(spark, out), C.csv_raw_sources(spark, raw)).collect()
    assert {r.status for r in lost if r.table_name == "dim_customers"} == {"MISMATCH"}
