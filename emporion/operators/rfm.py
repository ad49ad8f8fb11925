"""RFM segmentation.

* E7 — per person with items: last purchase, orders, spend; recency in whole days from a
  snapshot one day after the newest last purchase among those people (T3, T13).
* E8 — median split: ``recency <= median`` is recent, ``monetary >= median`` is high.
* E9 — per segment: people, mean recency / frequency / spend, total spend (2 dp; means half to even).

The per-person table is written once to the shared checkpoint folder: both medians and the
final labelling read it instead of recomputing the three-way join.  Medians are exact and
distributed (:mod:`emporion.functions.quantiles`).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emporion.functions import round_money, whole_days_between
from emporion.functions.quantiles import exact_medians
from emporion.operators.analytics import rfm_base
from emporion.session import materialize as materialize_table
from emporion.sources.adapter import StarSchema

# Segment labels of the median split.
CHAMPIONS = "Champions"
AT_RISK = "At Risk"
NEW_LOW_VALUE = "New / Low Value"
LOST = "Lost"


def rfm_customers(star: StarSchema, materialize: bool = True) -> DataFrame:
    """customer_unique_id, last_order_date, recency (days), frequency, monetary.

    The per-person base is written once to the shared checkpoint folder; the snapshot (a
    scalar subquery) and every later use (medians, labels) read that table instead of
    re-running the item/order/customer joins."""
    base = rfm_base(star)
    if materialize:
        base = materialize_table(base, "rfm-base")
    snapshot = base.agg(F.max("last_order_date") + F.expr("INTERVAL 1 DAY")).scalar()
    return base.select(
        "customer_unique_id",
        "last_order_date",
        whole_days_between(snapshot, "last_order_date").alias("recency"),
        "frequency",
        "monetary",
    )


def rfm_segments(star: StarSchema, rfm: DataFrame | None = None) -> DataFrame:
    """Per-person flags and segment (monetary exposed as DOUBLE)."""
    rfm = rfm if rfm is not None else rfm_customers(star, materialize=True)
    medians = exact_medians(rfm, ["recency", "monetary"])  # one distributed sort
    rec_median, mon_median = medians["recency"], medians["monetary"]
    # A comparison with NULL is false, as in the flags; the segment follows from the flags.
    recent = F.coalesce(F.col("recency") <= F.lit(rec_median), F.lit(False))
    high = F.coalesce(F.col("monetary").cast("double") >= F.lit(mon_median), F.lit(False))
    return rfm.select(
        "customer_unique_id",
        "last_order_date",
        "recency",
        "frequency",
        F.col("monetary").cast("double").alias("monetary"),
        F.when(recent, "recent").otherwise("not_recent").alias("recency_flag"),
        F.when(high, "high").otherwise("low").alias("monetary_flag"),
        F.when(recent & high, CHAMPIONS)
        .when(~recent & high, AT_RISK)
        .when(recent & ~high, NEW_LOW_VALUE)
        .otherwise(LOST)
        .alias("segment"),
    )


def _mean2(sum_col: str, n_col: str) -> F.Column:
    """Mean as a double, rounded to 2 places the way a float pipeline does: half to even."""
    return F.rint(F.try_divide(F.col(sum_col).cast("double"), F.col(n_col).cast("double")) * 100) / 100


def segment_summary(star: StarSchema, segments: DataFrame | None = None) -> DataFrame:
    """One row per segment (the exported ``rfm_segment_summary`` table)."""
    if segments is None:
        segments = rfm_segments(star, rfm_customers(star, materialize=True))
    seg = segments.withColumn("_m", F.col("monetary").cast("decimal(20,2)"))
    return (
        seg.groupBy("segment")
        .agg(
            F.count(F.lit(1)).alias("customer_count"),
            F.sum("recency").alias("_r"),
            F.sum("frequency").alias("_f"),
            F.sum("_m").alias("_m"),
            F.count("_m").alias("_n"),
        )
        .select(
            "segment",
            F.col("customer_count").cast("bigint").alias("customer_count"),
            _mean2("_r", "customer_count").alias("avg_recency_days"),
            _mean2("_f", "customer_count").alias("avg_frequency"),
            _mean2("_m", "_n").alias("avg_monetary"),
            round_money("_m").alias("total_monetary"),
        )
        .orderBy("segment")
    )
