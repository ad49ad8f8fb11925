"""Star schema over the driver's tables (FIXTURES §2).

The driver ships TPC-H-like tables; the analyses are written against the marketplace star
schema (``dim_*`` / ``fact_*``).  :class:`StarSchema` maps one onto the other as lazy
DataFrames, so every analysis reads the given Parquet files and Catalyst sees one plan from
the scan to the result (pruning and pushdown reach the scans).  Keys keep the driver's
BIGINT type: cheaper to hash and compare than 32-character text keys.

Mapping (driver -> star schema):

======================  ==========================================================
dim_customers           orders ⋈ customer ⋈ nation; one customer_id per order,
                        person = o_custkey, zip = o_custkey % 12, state = nation name
dim_sellers             supplier ⋈ nation; zip = s_suppkey % 10, state = nation name
category (raw)          nation with key < 23: 'Brand#'‖(key+1) -> lower(name)
dim_product_category…   raw categories + the two missing brands, insert-if-absent (A4)
dim_products            part; category = brand; weight NULL when size % 10 = 0
dim_orders              orders ⟕ (min, max ship date per order); delivered = max ship date
                        unless status 'P'; estimate = purchase + 1000 days
dim_reviews             orders; id = custkey‖'-'‖date, score = first priority digit
fact_order_items        lineitem; price = extended price, freight = price × tax (DECIMAL)
fact_order_payments     orders; one payment of the total price
dim_marketing_leads     events; origin NULL for 'error' events
dim_closed_deals        events with value > 50; seller = user_id (may dangle)
geolocation (raw)       embeddings: zip = label, lat = e[0]·90, lng = e[1]·180
dim_geolocation         raw geolocation reduced per zip (A5)
======================  ==========================================================
"""

from __future__ import annotations

import os
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emporion.sources.warehouse import insert_if_absent, reduce_geolocation

DRIVER_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# Adapter constants (FIXTURES §2).
RAW_CATEGORY_NATIONS = 23          # nations 0..22 carry a translation; brands 24, 25 do not
ADAPTER_MISSING_CATEGORIES = [("Brand#24", "missing_a"), ("Brand#25", "missing_b")]
CUSTOMER_ZIP_MODULUS = 12
SELLER_ZIP_MODULUS = 10
PROMISED_DAYS = 1000
PENDING_STATUS = "P"
DEAL_MIN_VALUE = 50
NULL_ORIGIN_EVENT = "error"


def driver_path(sf_dir: str, table: str) -> str:
    return os.path.join(sf_dir, f"{table}.parquet")


# Schemas of the driver tables the adapter reads.  Declaring them skips the
# footer-reading job that schema inference would run on every read.
DRIVER_SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, "
              "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "embeddings": "vec_id bigint, embedding array<float>, label int",
}


def read_driver(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    reader = spark.read
    if table in DRIVER_SCHEMAS:
        reader = reader.schema(DRIVER_SCHEMAS[table])
    return reader.parquet(driver_path(sf_dir, table))


class StarSchema:
    """Lazy star-schema DataFrames for one driver data directory."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    @classmethod
    def cached(cls, spark: SparkSession, sf_dir: str) -> "StarSchema":
        """The session's star schema for ``sf_dir``: the views are defined (and analysed)
        once per session, like temp views registered once, and reused by every query."""
        registry = getattr(spark, "_emporion_stars", None)
        if registry is None:
            registry = {}
            setattr(spark, "_emporion_stars", registry)
        key = (cls, os.path.abspath(sf_dir))
        if key not in registry:
            registry[key] = cls(spark, sf_dir)
        return registry[key]

    def _t(self, name: str) -> DataFrame:
        return read_driver(self.spark, self.sf_dir, name)

    # ---- dimensions -------------------------------------------------------------------
    @cached_property
    def customers(self) -> DataFrame:
        o = self._t("orders").select("o_orderkey", "o_custkey")
        c = self._t("customer").select("c_custkey", "c_nationkey")
        n = self._t("nation").select("n_nationkey", "n_name")
        return (
            o.join(c, o.o_custkey == c.c_custkey)
            .join(n, c.c_nationkey == n.n_nationkey)
            .select(
                F.col("o_orderkey").alias("customer_id"),
                F.col("o_custkey").alias("customer_unique_id"),
                (F.col("o_custkey") % CUSTOMER_ZIP_MODULUS).cast("string").alias("customer_zip_code_prefix"),
                F.col("n_name").alias("customer_state"),
            )
        )

    @cached_property
    def sellers(self) -> DataFrame:
        s = self._t("supplier").select("s_suppkey", "s_nationkey")
        n = self._t("nation").select("n_nationkey", "n_name")
        return s.join(n, s.s_nationkey == n.n_nationkey).select(
            F.col("s_suppkey").alias("seller_id"),
            (F.col("s_suppkey") % SELLER_ZIP_MODULUS).cast("string").alias("seller_zip_code_prefix"),
            F.col("n_name").alias("seller_state"),
        )

    @cached_property
    def categories_raw(self) -> DataFrame:
        return (
            self._t("nation")
            .filter(F.col("n_nationkey") < RAW_CATEGORY_NATIONS)
            .select(
                F.concat(F.lit("Brand#"), (F.col("n_nationkey") + 1).cast("string")).alias("product_category_name"),
                F.lower("n_name").alias("product_category_name_english"),
            )
        )

    @cached_property
    def categories(self) -> DataFrame:
        return insert_if_absent(
            self.spark, self.categories_raw, ADAPTER_MISSING_CATEGORIES, "product_category_name"
        )

    @cached_property
    def products(self) -> DataFrame:
        return self._t("part").select(
            F.col("p_partkey").alias("product_id"),
            F.col("p_brand").alias("product_category_name"),
            F.when(F.col("p_size") % 10 == 0, F.lit(None).cast("int"))
            .otherwise(F.col("p_size"))
            .alias("product_weight_g"),
        )

    @cached_property
    def orders(self) -> DataFrame:
        ship = (
            self._t("lineitem")
            .groupBy("l_orderkey")
            .agg(F.min("l_shipdate").alias("_first_ship"), F.max("l_shipdate").alias("_last_ship"))
        )
        o = self._t("orders").select("o_orderkey", "o_orderstatus", "o_orderdate")
        pending = F.col("o_orderstatus") == PENDING_STATUS
        return o.join(ship, o.o_orderkey == ship.l_orderkey, "left").select(
            F.col("o_orderkey").alias("order_id"),
            F.col("o_orderkey").alias("customer_id"),
            F.col("o_orderstatus").alias("order_status"),
            F.col("o_orderdate").alias("order_purchase_timestamp"),
            F.col("o_orderdate").alias("order_approved_at"),
            F.when(pending, F.lit(None)).otherwise(F.col("_first_ship")).alias("order_delivered_carrier_date"),
            F.when(pending, F.lit(None)).otherwise(F.col("_last_ship")).alias("order_delivered_customer_date"),
            (F.col("o_orderdate") + F.expr(f"INTERVAL {PROMISED_DAYS} DAYS")).alias("order_estimated_delivery_date"),
        )

    @cached_property
    def reviews(self) -> DataFrame:
        return self._t("orders").select(
            F.concat_ws("-", F.col("o_custkey").cast("string"), F.to_date("o_orderdate").cast("string")).alias("review_id"),
            F.col("o_orderkey").alias("order_id"),
            F.substring("o_orderpriority", 1, 1).cast("int").alias("review_score"),
        )

    @cached_property
    def items(self) -> DataFrame:
        return self._t("lineitem").select(
            F.col("l_orderkey").alias("order_id"),
            F.col("l_linenumber").alias("order_item_id"),
            F.col("l_partkey").alias("product_id"),
            F.col("l_suppkey").alias("seller_id"),
            F.col("l_shipdate").alias("shipping_limit_date"),
            F.col("l_extendedprice").cast("decimal(10,2)").alias("price"),
            (F.col("l_extendedprice").cast("decimal(10,2)") * F.col("l_tax").cast("decimal(4,2)"))
            .cast("decimal(10,2)")
            .alias("freight_value"),
        )

    @cached_property
    def payments(self) -> DataFrame:
        return self._t("orders").select(
            F.col("o_orderkey").alias("order_id"),
            F.lit(1).alias("payment_sequential"),
            F.col("o_orderpriority").alias("payment_type"),
            F.lit(1).alias("payment_installments"),
            F.col("o_totalprice").cast("decimal(10,2)").alias("payment_value"),
        )

    @cached_property
    def leads(self) -> DataFrame:
        return self._t("events").select(
            F.col("event_id").alias("mql_id"),
            F.to_date("ts").alias("first_contact_date"),
            F.when(F.col("event_type") == NULL_ORIGIN_EVENT, F.lit(None).cast("string"))
            .otherwise(F.col("event_type"))
            .alias("origin"),
        )

    @cached_property
    def deals(self) -> DataFrame:
        return (
            self._t("events")
            .filter(F.col("value") > DEAL_MIN_VALUE)
            .select(
                F.col("event_id").alias("mql_id"),
                F.col("user_id").alias("seller_id"),
                F.to_date("ts").alias("won_date"),
            )
        )

    @cached_property
    def geolocation_raw(self) -> DataFrame:
        return self._t("embeddings").select(
            F.col("vec_id").alias("_seq"),
            F.col("label").cast("string").alias("geolocation_zip_code_prefix"),
            (F.element_at("embedding", 1).cast("double") * 90).alias("geolocation_lat"),
            (F.element_at("embedding", 2).cast("double") * 180).alias("geolocation_lng"),
            F.concat(F.lit("city_"), (F.col("vec_id") % 7).cast("string")).alias("geolocation_city"),
            F.concat(F.lit("NATION_"), F.col("label").cast("string")).alias("geolocation_state"),
        )

    @cached_property
    def geolocation(self) -> DataFrame:
        return reduce_geolocation(self.geolocation_raw)

    # ---- registry ---------------------------------------------------------------------
    def tables(self) -> dict[str, DataFrame]:
        return {
            "dim_customers": self.customers,
            "dim_sellers": self.sellers,
            "dim_product_category_translation": self.categories,
            "dim_products": self.products,
            "dim_geolocation": self.geolocation,
            "dim_orders": self.orders,
            "dim_reviews": self.reviews,
            "fact_order_items": self.items,
            "fact_order_payments": self.payments,
            "dim_marketing_leads": self.leads,
            "dim_closed_deals": self.deals,
        }

    def register_views(self) -> None:
        """Expose the star schema to ``spark.sql`` under the warehouse table names, so the
        analytical SQL of the original application runs unchanged on Catalyst."""
        for name, df in self.tables().items():
            df.createOrReplaceTempView(name)


class StoredStarSchema(StarSchema):
    """The same interface over star-schema tables already written as Parquet (see
    :func:`emporion.sources.csv_io.load_warehouse`)."""

    def __init__(self, spark: SparkSession, root: str):
        super().__init__(spark, root)
        self.root = root

    def _stored(self, name: str) -> DataFrame:
        from emporion.schemas import TABLES

        # the load wrote the registry's schema: declare it instead of inferring from footers
        return self.spark.read.schema(TABLES[name].spark_schema).parquet(os.path.join(self.root, name))

    customers = property(lambda self: self._stored("dim_customers"))
    sellers = property(lambda self: self._stored("dim_sellers"))
    categories = property(lambda self: self._stored("dim_product_category_translation"))
    products = property(lambda self: self._stored("dim_products"))
    geolocation = property(lambda self: self._stored("dim_geolocation"))
    orders = property(lambda self: self._stored("dim_orders"))
    reviews = property(lambda self: self._stored("dim_reviews"))
    items = property(lambda self: self._stored("fact_order_items"))
    payments = property(lambda self: self._stored("fact_order_payments"))
    leads = property(lambda self: self._stored("dim_marketing_leads"))
    deals = property(lambda self: self._stored("dim_closed_deals"))


class VersionedStarSchema(StoredStarSchema):
    """The star schema of a versioned warehouse (:mod:`emporion.sources.versions`): the tables of its
    newest manifest, or of the one with the given number, all of the same moment."""

    def __init__(self, spark: SparkSession, root: str, version: int | None = None):
        from emporion.sources.versions import Warehouse

        super().__init__(spark, root)
        self.tables_at = Warehouse(spark, root).manifest(version)

    def _stored(self, name: str) -> DataFrame:
        from emporion.schemas import TABLES

        return self.spark.read.schema(TABLES[name].spark_schema).parquet(f"{self.root}/{self.tables_at[name]['path']}")


class FrameStar(StarSchema):
    """The same interface over DataFrames supplied directly (hand-made fixtures, or tables
    produced by an earlier job).  Missing tables raise ``KeyError`` when used."""

    def __init__(self, spark: SparkSession, frames: dict[str, DataFrame], name: str = "frames"):
        super().__init__(spark, name)
        self.frames = frames

    def _f(self, name: str) -> DataFrame:
        return self.frames[name]

    customers = property(lambda self: self._f("dim_customers"))
    sellers = property(lambda self: self._f("dim_sellers"))
    categories = property(lambda self: self._f("dim_product_category_translation"))
    products = property(lambda self: self._f("dim_products"))
    geolocation = property(lambda self: self._f("dim_geolocation"))
    orders = property(lambda self: self._f("dim_orders"))
    reviews = property(lambda self: self._f("dim_reviews"))
    items = property(lambda self: self._f("fact_order_items"))
    payments = property(lambda self: self._f("fact_order_payments"))
    leads = property(lambda self: self._f("dim_marketing_leads"))
    deals = property(lambda self: self._f("dim_closed_deals"))

    def tables(self) -> dict[str, DataFrame]:
        return dict(self.frames)


class CatalogStarSchema(StarSchema):
    """The star schema read from catalog tables (e.g. written by
    :func:`emporion.sources.warehouse.write_bucketed_star`), so bucketing metadata is used."""

    def __init__(self, spark: SparkSession, database: str):
        super().__init__(spark, database)
        self.database = database

    def _table(self, name: str) -> DataFrame:
        return self.spark.table(f"{self.database}.{name}")

    customers = property(lambda self: self._table("dim_customers"))
    sellers = property(lambda self: self._table("dim_sellers"))
    categories = property(lambda self: self._table("dim_product_category_translation"))
    products = property(lambda self: self._table("dim_products"))
    geolocation = property(lambda self: self._table("dim_geolocation"))
    orders = property(lambda self: self._table("dim_orders"))
    reviews = property(lambda self: self._table("dim_reviews"))
    items = property(lambda self: self._table("fact_order_items"))
    payments = property(lambda self: self._table("fact_order_payments"))
    leads = property(lambda self: self._table("dim_marketing_leads"))
    deals = property(lambda self: self._table("dim_closed_deals"))
