"""Named query catalogue: ``name -> (spark, sf_dir) -> DataFrame``.

Keys start with the SURVEY §2 operator id.  Every entry reads the driver tables of
``sf_dir`` through :class:`~emporion.sources.adapter.StarSchema`, over whole tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from emporion.functions import round_money
from emporion.operators import analytics as A
from emporion.operators import encode as N
from emporion.operators import features as H
from emporion.operators import forest as T
from emporion.operators import model as M
from emporion.operators import quality as C
from emporion.operators import rfm as R
from emporion.plans.oracle import V2_DESCRIBED
from emporion.sources.adapter import StarSchema

Query = Callable[[SparkSession, str], DataFrame]


def _q(fn, **kw) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(StarSchema.cached(spark, sf_dir), **kw)

    run.__name__ = fn.__name__
    run.__doc__ = fn.__doc__
    return run


ANALYTICS: dict[str, Query] = {
    "b2_delivery_status_preview": _q(A.delivery_status_preview),
    "e1_revenue_by_category": _q(A.revenue_by_category),
    "e1b_revenue_by_category_top15": _q(A.revenue_by_category, top_n=15, category_alias="category"),
    "e2_delay_by_category": _q(A.delay_by_category),
    "e2b_delay_by_category_top15": _q(
        A.delay_by_category, top_n=15, category_alias="category", with_late_items=False
    ),
    "e3_delay_by_seller_state": _q(A.delay_by_seller_state),
    "e3b_delay_by_seller_state_all": _q(A.delay_by_seller_state, top_n=None, with_late_items=False),
    "e4_score_by_status": _q(A.score_by_status),
    "e4b_score_by_status_three_way": _q(A.score_by_status, three_way=True),
    "e4c_review_summary": _q(A.review_summary),
    "b11_status_score_lookup": _q(A.status_score_lookup),
    "e4d_review_histogram": _q(A.review_histogram),
    "e5_repeat_purchase": _q(A.repeat_purchase),
    "e6_rfm_base": _q(A.rfm_top_spenders),
    "e6b_rfm_recency_interval": _q(A.rfm_recency_intervals),
    "e10_channel_funnel": _q(A.channel_funnel),
    "e10b_channel_funnel_dashboard": _q(A.channel_funnel, keep_null_origin=False, with_orders=False),
    "e11_kpis": _q(A.kpis),
}


def _rfm_customers(star: StarSchema) -> DataFrame:
    """Per-person recency / frequency / monetary (monetary as DOUBLE)."""
    return R.rfm_customers(star).withColumn("monetary", round_money("monetary"))


RFM: dict[str, Query] = {
    "e7_rfm_customers": _q(_rfm_customers),
    "e8_rfm_segments": _q(R.rfm_segments),
    "e9_rfm_segment_summary": _q(R.segment_summary),
}


def _geolocation(star: StarSchema) -> DataFrame:
    """A5: the reduced geolocation table (coordinates exposed as DOUBLE)."""
    g = star.geolocation
    return g.select(
        "geolocation_zip_code_prefix",
        g.geolocation_lat.cast("double").alias("geolocation_lat"),
        g.geolocation_lng.cast("double").alias("geolocation_lng"),
        "geolocation_city", "geolocation_state",
    )


def _warehouse_load_counts(star: StarSchema) -> DataFrame:
    """A1-A3, A7, A9 end to end: the adapter's tables are exported as raw CSV files (A7),
    loaded by the ingest plan (A1 typed read, A4 patch, A5 reduce, A2 versions, independent tables
    at the same time) into a warehouse under the shared checkpoint folder, then raw records (A9) are
    reconciled with loaded rows, and the loaded values are summed up: non-null cells and the sum
    of all integer and decimal cells of each table.  Both copies are deleted afterwards."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    from emporion.schemas import LOAD_ORDER, TABLES
    from emporion.session import drop_folder, scratch_dir
    from emporion.sources import csv_io
    from emporion.sources.adapter import ADAPTER_MISSING_CATEGORIES
    from emporion.sources.versions import Warehouse, refresh

    spark = star.spark
    root = scratch_dir(spark, "warehouse")
    raw_dir, house = f"{root}/raw", Warehouse(spark, f"{root}/tables")
    tables = star.tables()
    tables["dim_geolocation"] = star.geolocation_raw

    def counted(name: str) -> tuple:
        path = f"{raw_dir}/{TABLES[name].raw_file}"
        raw = csv_io.count_records(spark, path, bool(TABLES[name].text_columns))
        loaded = house.table(name)
        numbers = [f.name for f in loaded.schema if isinstance(f.dataType, (T.IntegralType, T.DecimalType))]
        cells = sum((F.count(c) for c in loaded.columns), F.lit(0))
        total = sum((F.coalesce(F.sum(F.col(c).cast("decimal(28,6)")), F.lit(0)) for c in numbers), F.lit(0))
        return name, raw, *loaded.agg(F.count(F.lit(1)), cells, F.round(total, 2).cast("double")).first()

    with ThreadPoolExecutor(4) as pool:  # independent small jobs
        list(pool.map(lambda x: csv_io.export_raw_files(dict([x]), raw_dir), tables.items()))
        said = refresh(spark, raw_dir, house.root, patch=ADAPTER_MISSING_CATEGORIES)
        if set(said.values()) != {"loaded"}:
            raise RuntimeError(f"the load did not succeed: {said}")
        rows = list(pool.map(counted, LOAD_ORDER))
    drop_folder(spark, root)
    return spark.createDataFrame(rows, "table_name string, raw_records bigint, loaded_rows bigint, filled_cells bigint, number_sum double")


def _quarantined_cells(star: StarSchema) -> DataFrame:
    """A1 + C5 on raw text: items and orders exported as CSV, with cells spoiled by rules of the order
    id, and read with a quarantine.  One row per broken rule: records and rows that were loaded."""
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    from emporion.session import drop_folder, scratch_dir
    from emporion.sources import csv_io

    spark, root = star.spark, scratch_dir(star.spark, "spoiled")
    turn = F.col("order_id") % 50

    def spoil(column: str, *cells: tuple[int, str | None]) -> F.Column:
        out = F.col(column).cast("string")
        for at, text in cells:
            out = F.when(turn == at, F.lit(text)).otherwise(out)
        return out.alias(column)

    items = star.items.select(
        "order_id", "order_item_id", "product_id", spoil("seller_id", (3, None)), "shipping_limit_date",
        spoil("price", (0, "n/a?"), (1, "123456789012.00"), (2, "-5.00")), "freight_value")
    orders = star.orders.select(
        "order_id", "customer_id", spoil("order_status", (4, "waiting for the carrier to come")),
        spoil("order_purchase_timestamp", (5, "yesterday")), "order_delivered_customer_date")

    def judged(name: str, df: DataFrame) -> list[tuple]:
        good, bad = csv_io.read_checked_csv(spark, csv_io.write_csv(df, f"{root}/{name}"), name)
        loaded = good.count()
        found = bad.groupBy("table_name", "column_name", "rule").agg(F.count_distinct("file", "record_no").alias("records")).collect()
        return [(*r, loaded) for r in found]  # a row a rule

    with ThreadPoolExecutor(2) as pool:  # independent tables
        parts = [r for rows in pool.map(judged, ("fact_order_items", "dim_orders"), (items, orders)) for r in rows]
    drop_folder(spark, root)
    return spark.createDataFrame(parts, "table_name string, column_name string, rule string, records bigint, loaded_rows bigint")


def _sql_over_views(star: StarSchema) -> DataFrame:
    """A SQL text run on the star schema's views."""
    from emporion.plans.oracle import A6_SQL

    star.register_views()
    return star.spark.sql(A6_SQL)


def _first_15_of_export(star: StarSchema) -> DataFrame:
    """An exported result read back, its first 15 rows."""
    from pyspark.sql import functions as F

    from emporion.session import scratch_dir
    from emporion.sources import csv_io

    full = A.revenue_by_category(star, top_n=None, category_alias="category")
    path = csv_io.write_csv(full, scratch_dir(star.spark, "revenue"), single_file=True)
    order = [F.desc_nulls_first("total_revenue"), F.asc_nulls_last("category")]
    return csv_io.read_result_csv(star.spark, path, "category string, total_revenue double, items_sold bigint", top=15, order_by=order)


def _rfm_summary_roundtrip(star: StarSchema) -> DataFrame:
    """A7 + A8: the segment summary exported as CSV and read back with its schema."""
    from emporion.session import scratch_dir
    from emporion.sources import csv_io

    path = csv_io.write_csv(R.segment_summary(star), scratch_dir(star.spark, "rfm_summary"), single_file=True)
    schema = ("segment string, customer_count bigint, avg_recency_days double, avg_frequency double, "
              "avg_monetary double, total_monetary double")
    return csv_io.read_result_csv(star.spark, path, schema)


def _category_patch(star: StarSchema) -> DataFrame:
    """A4: the translation table after insert-if-absent, with the number of products each
    translated category covers (the patched categories are the ones products need)."""
    from pyspark.sql import functions as F

    per_category = star.products.groupBy("product_category_name").agg(
        F.count(F.lit(1)).cast("bigint").alias("products")
    )
    return star.categories.join(per_category, "product_category_name", "left").select(
        "product_category_name", "product_category_name_english",
        F.coalesce(F.col("products"), F.lit(0).cast("bigint")).alias("products"),
    )


SOURCES: dict[str, Query] = {
    "a3_warehouse_load_counts": _q(_warehouse_load_counts),
    "a4_category_patch": _q(_category_patch),
    "a5_geolocation_reduce": _q(_geolocation),
    "a6_sql_over_views": _q(_sql_over_views),
    "a7_rfm_summary_roundtrip": _q(_rfm_summary_roundtrip),
    "a8_first_15_of_export": _q(_first_15_of_export),
}


#: The adapter's status that stands for delivered orders.
DELIVERED_STATUS = "F"

QUALITY: dict[str, Query] = {
    "c0_quality_report": _q(lambda star: C.quality_report(star, DELIVERED_STATUS, C.adapter_raw_sources(star))),
    "c1_row_counts": _q(lambda star: C.row_count_reconciliation(star, C.adapter_raw_sources(star))),
    "c2_null_thresholds": _q(C.null_thresholds),
    "c3_status_dependent_nulls": _q(C.status_dependent_nulls),
    "c4_duplicates": _q(C.duplicates),
    "c4c_people_vs_records": _q(C.people_vs_records),
    "c4d_people_by_state": _q(C.people_by_state),
    "c5_declared_constraints": _q(C.declared_constraints),
    "c5b_quarantined_cells": _q(_quarantined_cells),
    "c6_orphans": _q(C.orphans),
    "c7_value_ranges": _q(C.value_ranges),
    "c8_delivered_without_date": _q(C.delivered_without_date, delivered_status=DELIVERED_STATUS),
    "c9_null_profile_v2": _q(lambda star: C.null_profile(H.training_table_v2_raw(star))),
    "c10_describe_rfm": _q(
        lambda star: C.describe(R.rfm_customers(star, materialize=True), ["recency", "frequency", "monetary"])
    ),
    "c10b_describe_v2": _q(lambda star: C.describe(H.training_table_v2(star), V2_DESCRIBED)),
    "c11_late_share_v1": _q(lambda star: C.value_counts(H.training_table_v1(star), H.LABEL)),
}

FEATURES: dict[str, Query] = {
    "h1_training_table_v1": _q(H.training_table_v1),
    "h2_training_table_v2": _q(H.training_table_v2),
    "h4_one_hot": _q(N.one_hot_summary),
    "h5_split_summary": _q(M.split_summary),
    "h5b_exact_split": _q(H.exact_split_summary),
    "h7_class_weights": _q(M.class_weight_table),
    "b10_median_fill": _q(M.median_fill),
    "h9b_report_of_rule": _q(M.rule_report),
    "h10_auc_of_rule": _q(M.rule_auc),
    "h11b_confusion_of_rule": _q(M.rule_confusion),
}


# Model training has no SQL equivalent: these entries get the driver's rows-only check.
MODEL: dict[str, Query] = {
    "h8_late_probability": _q(T.late_probabilities),
    "h9_classification_report": _q(M.classification_report),
    "h11_confusion_matrix": _q(M.confusion_matrix),
    "h12_feature_importances": _q(M.feature_importances),
    "h13_model_comparison": _q(M.model_comparison),
}


def queries() -> dict[str, Query]:
    out: dict[str, Query] = {}
    for part in (ANALYTICS, RFM, SOURCES, QUALITY, FEATURES, MODEL):
        out.update(part)
    return out


def oracle_sql() -> dict[str, str]:
    from emporion.plans.oracle import ANALYTICS_SQL, FEATURES_SQL, QUALITY_SQL, RFM_SQL, SOURCES_SQL

    out: dict[str, str] = {}
    for part in (ANALYTICS_SQL, RFM_SQL, SOURCES_SQL, QUALITY_SQL, FEATURES_SQL):
        out.update(part)
    return out
