"""Shared fixture builders for tests."""

import datetime as dt
import random

from conftest import money, table
from emporion.sources.adapter import FrameStar


def planted_star(spark, n=600):
    rnd = random.Random(3)
    geo = [
        {"geolocation_zip_code_prefix": "base", "geolocation_lat": money("0.000000"), "geolocation_lng": money("0.000000")},
        {"geolocation_zip_code_prefix": "near", "geolocation_lat": money("0.500000"), "geolocation_lng": money("0.500000")},
        {"geolocation_zip_code_prefix": "far", "geolocation_lat": money("10.000000"), "geolocation_lng": money("10.000000")},
    ]
    customers, orders, items, products = [], [], [], []
    t0 = dt.datetime(2018, 1, 1, 9, 0)
    for i in range(n):
        far = rnd.random() < 0.4
        bought = t0 + dt.timedelta(days=rnd.randrange(300), hours=rnd.randrange(12))
        customers.append({"customer_id": f"c{i}", "customer_unique_id": f"p{i}",
                          "customer_zip_code_prefix": "far" if far else "near", "customer_state": "SP"})
        orders.append({"order_id": f"o{i}", "customer_id": f"c{i}", "order_status": "delivered",
                       "order_purchase_timestamp": bought,
                       "order_estimated_delivery_date": bought + dt.timedelta(days=10),
                       "order_delivered_customer_date": bought + dt.timedelta(days=12 if far else 5)})
        products.append({"product_id": f"x{i}", "product_category_name": rnd.choice(["a", "b", "c"]),
                         "product_weight_g": None if i % 10 == 0 else rnd.randrange(100, 900)})
        items.append({"order_id": f"o{i}", "order_item_id": 1, "product_id": f"x{i}", "seller_id": "s1",
                      "price": money(rnd.randrange(10, 500)), "freight_value": money(rnd.randrange(1, 50))})
    return FrameStar(spark, {
        "dim_geolocation": table(spark, "dim_geolocation", geo),
        "dim_customers": table(spark, "dim_customers", customers),
        "dim_orders": table(spark, "dim_orders", orders),
        "dim_products": table(spark, "dim_products", products),
        "fact_order_items": table(spark, "fact_order_items", items),
        "dim_sellers": table(spark, "dim_sellers", [{"seller_id": "s1", "seller_zip_code_prefix": "base", "seller_state": "SP"}]),
    })




def random_star_rows(seed: int, hot: bool = False) -> dict[str, list[dict]]:
    """A random small marketplace in the registry's schema, rich in edge cases: purchase-time
    ties, undelivered orders, people with several orders, repeated review ids, products
    without (or with an untranslated) category, leads without origin, deals with unknown
    sellers and several deals per seller, equal prices.  With ``hot`` one person places a
    third of the orders and one seller / one product carry a third of the items."""
    rnd = random.Random(seed)
    base = dt.datetime(2018, 1, 1)
    stamps = [base + dt.timedelta(days=rnd.randrange(60), hours=rnd.choice([0, 9, 23])) for _ in range(25)]
    people = [f"p{i}" for i in range(rnd.randrange(8, 30))]
    cats = ["cama", "casa", "esporte", "sem_traducao"]
    products = [{"product_id": f"x{i}", "product_category_name": rnd.choice(cats + [None]),
                 "product_weight_g": rnd.choice([None, 100, 250, 900])} for i in range(10)]
    translations = [{"product_category_name": c, "product_category_name_english": c.upper()} for c in cats[:3]]
    sellers = [{"seller_id": f"s{i}", "seller_state": rnd.choice(["SP", "RJ", "MG"]),
                "seller_zip_code_prefix": rnd.choice(["01037", "20000"])} for i in range(6)]
    customers, orders, reviews, items = [], [], [], []
    for i in range(rnd.randrange(60, 160)):
        oid, cid = f"o{i:04d}", f"c{i:04d}"
        bought = rnd.choice(stamps)
        delivered = None if rnd.random() < 0.2 else bought + dt.timedelta(days=rnd.randrange(0, 20), hours=rnd.randrange(24))
        person = people[0] if hot and rnd.random() < 1 / 3 else rnd.choice(people)
        customers.append({"customer_id": cid, "customer_unique_id": person, "customer_state": rnd.choice(["SP", "BA"])})
        orders.append({"order_id": oid, "customer_id": cid, "order_status": rnd.choice(["delivered", "shipped", "canceled"]),
                       "order_purchase_timestamp": bought, "order_delivered_customer_date": delivered,
                       "order_estimated_delivery_date": bought + dt.timedelta(days=rnd.choice([7, 10, 15]))})
        for _ in range(rnd.choice([0, 1, 1, 2])):
            reviews.append({"review_id": f"r{rnd.randrange(40)}", "order_id": oid, "review_score": rnd.randrange(1, 6)})
        for k in range(rnd.choice([0, 1, 2, 3, 5])):
            hot_item = hot and rnd.random() < 1 / 3
            items.append({"order_id": oid, "order_item_id": k + 1,
                          "product_id": products[0]["product_id"] if hot_item else rnd.choice(products)["product_id"],
                          "seller_id": sellers[0]["seller_id"] if hot_item else rnd.choice(sellers)["seller_id"],
                          "price": money(rnd.choice(["9.90", "10.00", "120.50", "0.99", "33.33"])),
                          "freight_value": money("1.00")})
    origins = ["social", "paid", None, "organic"]
    leads = [{"mql_id": f"m{i}", "origin": rnd.choice(origins)} for i in range(40)]
    deals = [{"mql_id": l["mql_id"], "seller_id": rnd.choice([s["seller_id"] for s in sellers] + ["zz"])}
             for l in leads if rnd.random() < 0.4]
    return {
        "dim_customers": customers, "dim_sellers": sellers, "dim_product_category_translation": translations,
        "dim_products": products, "dim_orders": orders, "dim_reviews": reviews, "fact_order_items": items,
        "dim_marketing_leads": leads, "dim_closed_deals": deals,
    }


def arrow_schema(spark_schema):
    import pyarrow as pa
    from pyspark.sql import types as T

    def conv(t):
        if isinstance(t, T.StringType):
            return pa.string()
        if isinstance(t, T.IntegerType):
            return pa.int32()
        if isinstance(t, T.LongType):
            return pa.int64()
        if isinstance(t, T.DecimalType):
            return pa.decimal128(t.precision, t.scale)
        if isinstance(t, T.TimestampNTZType):
            return pa.timestamp("us")
        if isinstance(t, T.DateType):
            return pa.date32()
        if isinstance(t, T.DoubleType):
            return pa.float64()
        raise TypeError(t)

    return pa.schema([(f.name, conv(f.dataType)) for f in spark_schema.fields])
