"""Headline-query benchmark.

/root/testdata/sf0.1) with ``local[$BENCH_CPUS]`` (default 8) and prints one JSON line:
``{"metric": ..., "value": total_sec, "unit": "sec", "queries": {...}, "sf": ...}``.

Each query is timed once, up to the end of ``collect()``, after an untimed warm-up pass that
runs every headline query once on the smallest data directory next to ``$BENCH_SF_DIR``
(JIT and code generation warm-up; recorded in the output).  No data is cached between
queries: every query reads the Parquet files; the star-schema view definitions are built
once per session.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from emporion.operators import quality as C  # noqa: E402
from emporion.plans.catalog import DELIVERED_STATUS, queries  # noqa: E402
from emporion.session import build_session  # noqa: E402
from emporion.sources.adapter import StarSchema  # noqa: E402

HEADLINE = [
    "e1_revenue_by_category",
    "b2_delivery_status_preview",
    "e2_delay_by_category",
    "e3_delay_by_seller_state",
    "e4_score_by_status",
    "e4b_score_by_status_three_way",
    "e5_repeat_purchase",
    "e6_rfm_base",
    "e10_channel_funnel",
    "e9_rfm_segment_summary",
    "e11_kpis",
]
# The costlier work, timed after the headline queries and kept out of their total: training
# tables, the whole quality report, segments, the ingest round trip and one trained model.
MORE = [
    "h1_training_table_v1",
    "h2_training_table_v2",
    "c0_quality_report",
    "e8_rfm_segments",
    "a3_warehouse_load_counts",
    "h9_classification_report",
]


def dq_bundle(spark, sf_dir):
    """The validation script's four groups (row counts, nulls, duplicates, integrity and
    ranges) with its own key lists, run as concurrent jobs."""
    star = StarSchema.cached(spark, sf_dir)
    C.run_quality_suite(
        star, DELIVERED_STATUS,
        ["row_counts", "null_thresholds", "status_dependent_nulls", "duplicates",
         "people_vs_records", "orphans", "value_ranges"],
        sources=C.adapter_raw_sources(star), reference_scope=True,
    )


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    spark = build_session(
        f"local[{cpus}]",
        app_name="emporion-bench",
        shuffle_partitions=max(8, cpus),
        extra={"spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "8g")},
    )
    qs = queries()
    warm_dir = os.path.join(os.path.dirname(os.path.abspath(sf_dir)), "sf0.001")
    if not os.path.isdir(warm_dir):
        warm_dir = sf_dir
    for name in HEADLINE:
        qs[name](spark, warm_dir).collect()
    dq_bundle(spark, warm_dir)
    StarSchema.cached(spark, sf_dir).tables()  # view definitions for the timed directory (no data read)

    timings = {}
    for name in HEADLINE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).collect()
        timings[name] = round(time.perf_counter() - t0, 3)
    t0 = time.perf_counter()
    dq_bundle(spark, sf_dir)
    timings["dq_bundle"] = round(time.perf_counter() - t0, 3)

    more = {}
    for name in MORE:
        t0 = time.perf_counter()
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        more[name] = round(time.perf_counter() - t0, 3)

    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "headline_queries_total",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "more": more,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
        "warmup": f"headline queries once on {warm_dir}",
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
