"""Star-schema registry: column types, keys, foreign keys and value rules.

Spark enforces none of the warehouse constraints, so they are kept here as metadata and
turned into data-quality rules by :mod:`emporion.operators.quality`.  Raw CSV files are
read with these schemas (no inference), which keeps zip prefixes such as ``01037`` as text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T


@dataclass(frozen=True)
class Col:
    name: str
    dtype: T.DataType
    not_null: bool = False
    max_len: int | None = None  # VARCHAR(n)


@dataclass(frozen=True)
class Table:
    name: str
    raw_file: str | None  # default source file name; loads accept a mapping to the real names
    columns: tuple[Col, ...]
    key: tuple[str, ...] = ()
    foreign_keys: tuple[tuple[str, str, str], ...] = ()  # (column, parent table, parent column)
    min_values: tuple[tuple[str, float], ...] = ()  # CHECK (col >= v)
    ranges: tuple[tuple[str, float, float], ...] = ()  # CHECK (col BETWEEN lo AND hi)
    text_columns: tuple[str, ...] = field(default=())  # free text: null tokens are kept

    @property
    def spark_schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, c.dtype, True) for c in self.columns])

    def col(self, name: str) -> Col:
        return next(c for c in self.columns if c.name == name)


S = T.StringType()
I = T.IntegerType()
TS = T.TimestampNTZType()
D = T.DateType()
MONEY = T.DecimalType(10, 2)
COORD = T.DecimalType(10, 6)
BIGNUM = T.DecimalType(18, 2)


def _s(name, n, not_null=False):
    return Col(name, S, not_null, n)


TABLES: dict[str, Table] = {
    t.name: t
    for t in [
        Table(
            "dim_customers", "customers.csv",
            (_s("customer_id", 32, True), _s("customer_unique_id", 32, True),
             _s("customer_zip_code_prefix", 5), _s("customer_city", 100), _s("customer_state", 2)),
            key=("customer_id",),
        ),
        Table(
            "dim_sellers", "sellers.csv",
            (_s("seller_id", 32, True), _s("seller_zip_code_prefix", 5), _s("seller_city", 100),
             _s("seller_state", 2)),
            key=("seller_id",),
        ),
        Table(
            "dim_product_category_translation", "product_category_name_translation.csv",
            (_s("product_category_name", 100, True), _s("product_category_name_english", 100)),
            key=("product_category_name",),
        ),
        Table(
            "dim_products", "products.csv",
            (_s("product_id", 32, True), _s("product_category_name", 100),
             Col("product_name_lenght", I), Col("product_description_lenght", I),
             Col("product_photos_qty", I), Col("product_weight_g", I), Col("product_length_cm", I),
             Col("product_height_cm", I), Col("product_width_cm", I)),
            key=("product_id",),
            foreign_keys=(("product_category_name", "dim_product_category_translation",
                           "product_category_name"),),
        ),
        Table(
            "dim_geolocation", "geolocation.csv",
            (_s("geolocation_zip_code_prefix", 5, True), Col("geolocation_lat", COORD),
             Col("geolocation_lng", COORD), _s("geolocation_city", 100), _s("geolocation_state", 2)),
            key=("geolocation_zip_code_prefix",),
        ),
        Table(
            "dim_orders", "orders.csv",
            (_s("order_id", 32, True), _s("customer_id", 32, True), _s("order_status", 20),
             Col("order_purchase_timestamp", TS), Col("order_approved_at", TS),
             Col("order_delivered_carrier_date", TS), Col("order_delivered_customer_date", TS),
             Col("order_estimated_delivery_date", TS)),
            key=("order_id",),
            foreign_keys=(("customer_id", "dim_customers", "customer_id"),),
        ),
        Table(
            "dim_reviews", "order_reviews.csv",
            (_s("review_id", 32, True), _s("order_id", 32, True), Col("review_score", I),
             _s("review_comment_title", 255), Col("review_comment_message", S),
             Col("review_creation_date", TS), Col("review_answer_timestamp", TS)),
            key=("review_id", "order_id"),
            foreign_keys=(("order_id", "dim_orders", "order_id"),),
            ranges=(("review_score", 1, 5),),
            text_columns=("review_comment_title", "review_comment_message"),
        ),
        Table(
            "dim_marketing_leads", "marketing_qualified_leads.csv",
            (_s("mql_id", 32, True), Col("first_contact_date", D), _s("landing_page_id", 32),
             _s("origin", 50)),
            key=("mql_id",),
        ),
        Table(
            "dim_closed_deals", "closed_deals.csv",
            (_s("mql_id", 32, True), _s("seller_id", 32), _s("sdr_id", 32), _s("sr_id", 32),
             Col("won_date", D), _s("business_segment", 100), _s("lead_type", 50),
             _s("lead_behaviour_profile", 50), _s("has_company", 10), _s("has_gtin", 10),
             _s("average_stock", 50), _s("business_type", 50),
             Col("declared_product_catalog_size", BIGNUM), Col("declared_monthly_revenue", BIGNUM)),
            key=("mql_id",),
            # The deals -> sellers key is relaxed: dangling sellers are reported, not rejected.
            foreign_keys=(("mql_id", "dim_marketing_leads", "mql_id"),
                          ("seller_id", "dim_sellers", "seller_id")),
        ),
        Table(
            "fact_order_items", "order_items.csv",
            (_s("order_id", 32, True), Col("order_item_id", I, True), _s("product_id", 32, True),
             _s("seller_id", 32, True), Col("shipping_limit_date", TS), Col("price", MONEY),
             Col("freight_value", MONEY)),
            key=("order_id", "order_item_id"),
            foreign_keys=(("order_id", "dim_orders", "order_id"),
                          ("product_id", "dim_products", "product_id"),
                          ("seller_id", "dim_sellers", "seller_id")),
            min_values=(("price", 0), ("freight_value", 0)),
        ),
        Table(
            "fact_order_payments", "order_payments.csv",
            (_s("order_id", 32, True), Col("payment_sequential", I, True), _s("payment_type", 20),
             Col("payment_installments", I), Col("payment_value", MONEY)),
            key=("order_id", "payment_sequential"),
            foreign_keys=(("order_id", "dim_orders", "order_id"),),
            min_values=(("payment_value", 0),),
        ),
    ]
}

# Ingest order: parents before children (A3).  Without enforced keys the order only matters
# for the category patch, which must run before quality checks read the translation table.
LOAD_ORDER = [
    "dim_customers", "dim_sellers", "dim_product_category_translation", "dim_products",
    "dim_geolocation", "dim_orders", "dim_reviews", "fact_order_items", "fact_order_payments",
    "dim_marketing_leads", "dim_closed_deals",
]
