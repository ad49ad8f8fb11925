"""Training tables for the late-delivery classifier.

Both tables are item-grain joins of the facts with products, sellers and (delivered) orders;
v2 adds the customer, both geolocations (left joins of the same dimension under two
aliases, D6), the promised delivery window in whole days and the seller-customer distance.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.functions import dow_sunday0, haversine_km, is_late, whole_days_between
from emporion.functions.quantiles import exact_median
from emporion.session import materialize
from emporion.sources.adapter import StarSchema

LABEL = "is_late"

# Feature lists of the two model versions.
V1_CATEGORICAL = ["product_category_name", "seller_state"]
V1_NUMERIC = ["price", "freight_value", "product_weight_g", "purchase_day_of_week"]
V2_CATEGORICAL = ["product_category_name", "seller_state", "customer_state"]
V2_NUMERIC = [
    "price", "freight_value", "product_weight_g", "purchase_day_of_week",
    "estimated_delivery_days", "seller_customer_distance_km",
]


def _located(df: DataFrame, star: StarSchema, zip_col: str, side: str) -> DataFrame:
    """``<side>_lat``, ``<side>_lng`` of a dimension's zip prefix, at the dimension's grain."""
    geo = star.geolocation.select(
        F.col("geolocation_zip_code_prefix").alias(zip_col),
        F.col("geolocation_lat").alias(f"{side}_lat"), F.col("geolocation_lng").alias(f"{side}_lng"),
    )
    return df.join(geo, zip_col, "left").drop(zip_col)


def _delivered_items(star: StarSchema, with_places: bool) -> DataFrame:
    """Items of delivered orders with product, seller and, ``with_places``, the customer's state
    and both coordinates.  Geolocation joins sellers and customers, and customers join orders,
    before the items come in: the items are never dealt out by customer or zip prefix."""
    sellers = star.sellers.select("seller_id", "seller_state", "seller_zip_code_prefix")
    orders = star.orders.filter(F.col("order_delivered_customer_date").isNotNull()).select(
        "order_id", "customer_id", "order_purchase_timestamp",
        "order_estimated_delivery_date", "order_delivered_customer_date",
    )
    if with_places:
        sellers = _located(sellers, star, "seller_zip_code_prefix", "seller")
        customers = star.customers.select("customer_id", "customer_state", "customer_zip_code_prefix")
        orders = orders.join(_located(customers, star, "customer_zip_code_prefix", "customer"), "customer_id")
    items = star.items.select("order_id", "order_item_id", "product_id", "seller_id", "price", "freight_value")
    products = star.products.select("product_id", "product_category_name", "product_weight_g")
    return items.join(products, "product_id").join(sellers, "seller_id").join(orders, "order_id")


def _label() -> F.Column:
    """1 if late, else 0; a missing date is not late."""
    return is_late().cast("int")


def training_table_v1(star: StarSchema) -> DataFrame:
    """H1 + H3: item-grain features of delivered orders with the ``is_late`` label."""
    return _delivered_items(star, with_places=False).select(
        "order_id", "order_item_id",
        F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"),
        "product_category_name", "product_weight_g", "seller_state",
        "order_purchase_timestamp", "order_estimated_delivery_date", "order_delivered_customer_date",
        dow_sunday0("order_purchase_timestamp").alias("purchase_day_of_week"),
        _label().alias(LABEL),
    )


def training_table_v2_raw(star: StarSchema) -> DataFrame:
    """H2 before cleaning: v1 plus customer state and both geolocations (left joins)."""
    j = _delivered_items(star, with_places=True)
    return j.select(
        "order_id", "order_item_id",
        F.col("price").cast("double").alias("price"),
        F.col("freight_value").cast("double").alias("freight_value"),
        "product_category_name", "product_weight_g", "seller_state", "customer_state",
        "order_purchase_timestamp", "order_estimated_delivery_date", "order_delivered_customer_date",
        dow_sunday0("order_purchase_timestamp").alias("purchase_day_of_week"),
        "seller_lat", "seller_lng", "customer_lat", "customer_lng",
    )


def training_table_v2(star: StarSchema) -> DataFrame:
    """H2: rows with both geolocations and a category (B9), plus the promised window in
    whole days (G9), the haversine distance (G11) and the label."""
    raw = training_table_v2_raw(star).na.drop(
        subset=["seller_lat", "seller_lng", "customer_lat", "customer_lng", "product_category_name"]
    )
    return raw.select(
        "order_id", "order_item_id", "price", "freight_value", "product_category_name",
        "product_weight_g", "seller_state", "customer_state", "purchase_day_of_week",
        whole_days_between("order_estimated_delivery_date", "order_purchase_timestamp").alias("estimated_delivery_days"),
        haversine_km("seller_lat", "seller_lng", "customer_lat", "customer_lng").alias("seller_customer_distance_km"),
        _label().alias(LABEL),
    )


def in_test(test_pct: int = 20, seed: int = 42, keys: tuple[str, ...] = ("order_id", "order_item_id")) -> F.Column:
    """H5: whether a row belongs to the test split, by a hash of its key.

    The hash (the first 32 bits of an MD5, which any engine can compute) does not depend on the
    label, so each class is split alike up to sampling noise: stratified in expectation, with no
    global sort or per-class window, and the same after a task is run again."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % 100 < test_pct


def split(df: DataFrame, test_pct: int = 20, seed: int = 42, keys: tuple[str, ...] = ("order_id", "order_item_id")) -> tuple[DataFrame, DataFrame]:
    """H5: (train, test) by :func:`in_test`."""
    test = in_test(test_pct, seed, keys)
    return df.filter(~test), df.filter(test)


HASH_BITS = 60
CLASS_BINS = 4096


def row_hash(keys: tuple[str, ...], seed: int) -> F.Column:
    """The first 60 bits of an MD5 of the row key."""
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed)))
    return F.conv(F.substring(F.md5(text), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def _at_ranks(df: DataFrame, group: str, value: str, ranks: dict) -> dict:
    """For each group the value at a 1-based rank in ascending order, and how many rows of that value
    are among the first so many: by counting rows per bin of the interval that holds the rank.  A pass
    is one aggregate, of which at most ``CLASS_BINS`` rows a group reach the driver."""
    low, high = df.agg(F.min(value), F.max(value)).first()
    left = {g: (low, high, 0) for g, k in ranks.items() if k}  # interval, rows before it
    out = {}
    while left:
        part = F.lit(None).cast("bigint")
        for g, (lo, hi, _) in left.items():
            width = -(-(hi - lo + 1) // CLASS_BINS)
            inside = F.col(group).eqNullSafe(F.lit(g)) & F.col(value).between(lo, hi)
            part = F.when(inside, F.expr(f"({value} - {lo}) div {width}")).otherwise(part)
        bins = df.select(group, part.alias("bin"), value).filter("bin IS NOT NULL").groupBy(group, "bin").agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi")).collect()
        for g in list(left):
            before = left[g][2]
            for r in sorted((r for r in bins if r[group] == g), key=lambda r: r["bin"]):
                if before + r["n"] >= ranks[g]:
                    if r["lo"] == r["hi"]:
                        out[g] = (r["lo"], ranks[g] - before)
                        del left[g]
                    elif before + r["n"] == ranks[g]:  # the whole bin: its largest value ends the quota
                        out[g] = (r["hi"], None)
                        del left[g]
                    else:
                        left[g] = (r["lo"], r["hi"], before)
                    break
                before += r["n"]
    return out


def exact_split(df: DataFrame, label: str = LABEL, test_pct: int = 20, seed: int = 42,
                keys: tuple[str, ...] = ("order_id", "order_item_id")) -> DataFrame:
    """H5 with exact class quotas: ``df`` with ``test``, true for round(test_pct % of n) rows of each
    class (halves up), those with the smallest hashes of their key.

    The hash at a class's quota is found by narrowing histograms, with no sort and no window over a
    class.  Rows beyond it with the same hash, that is the same key, are told apart by their row number
    in the table that the split writes first, so repeated keys do not spoil a quota."""
    rows = materialize(df.withColumn("_hash", row_hash(keys, seed)).withColumn("_row", F.monotonically_increasing_id()), "split-rows")
    sizes = {r[label]: r["n"] for r in rows.groupBy(label).agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    quota = {g: (n * test_pct + 50) // 100 for g, n in sizes.items()}
    at = _at_ranks(rows, label, "_hash", quota)
    tied = {g: k for g, (_, k) in at.items() if k is not None}
    edge = F.lit(False)
    for g in tied:
        edge = edge | (F.col(label).eqNullSafe(F.lit(g)) & (F.col("_hash") == at[g][0]))
    last = _at_ranks(rows.filter(edge), label, "_row", tied) if tied else {}
    test = F.lit(False)
    for g, (h, k) in at.items():
        own = F.col("_hash") <= h if k is None else (F.col("_hash") < h) | ((F.col("_hash") == h) & (F.col("_row") <= last[g][0]))
        test = F.when(F.col(label).eqNullSafe(F.lit(g)), own).otherwise(test)
    return rows.withColumn("test", test).drop("_row")


def exact_split_summary(star: StarSchema) -> DataFrame:
    """H5 with exact quotas: rows per (split, class), the class's share of the split, and a checksum of
    the hashes of the rows that went there."""
    from pyspark.sql import Window

    table = training_table_v1(star).select("order_id", "order_item_id", LABEL)
    tagged = exact_split(table).select(F.when(F.col("test"), "test").otherwise("train").alias("split"), LABEL, "_hash")
    counts = tagged.groupBy("split", LABEL).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.col("_hash") % 1_000_003).alias("hash_sum"))
    total = F.sum("rows").over(Window.partitionBy("split"))  # over the few counted rows
    return counts.select("split", LABEL, "rows", F.round(F.col("rows") / total, 6).alias("share"), "hash_sum")


def fill_median(df: DataFrame, column: str, where: F.Column | None = None) -> tuple[float | None, DataFrame]:
    """Fill NULLs of ``column`` with the exact median of the rows ``where`` holds (T9: the
    training rows, so that the test rows do not leak into it)."""
    med = exact_median(df.filter(where) if where is not None else df, column)
    return med, df.withColumn(column, F.coalesce(F.col(column).cast("double"), F.lit(med)))
