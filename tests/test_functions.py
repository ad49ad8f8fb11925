"""Scalar expressions against hand-computed values (traps T2, T3, T4, T12, T14; G11)."""

import math

from pyspark.sql import functions as F

from conftest import ts
from emporion.functions import delivery_status, dow_sunday0, haversine_km, late_int, pct, whole_days_between


def test_late_flag_edges(spark):
    # FIXTURES orders_late: delivered = estimate; 1 s after; same day as a midnight estimate; NULL
    rows = [
        ("eq", ts("2018-01-10 00:00:00"), ts("2018-01-10 00:00:00")),
        ("1s", ts("2018-01-10 00:00:01"), ts("2018-01-10 00:00:00")),
        ("sameday", ts("2018-01-10 15:00:00"), ts("2018-01-10 00:00:00")),
        ("null", None, ts("2018-01-10 00:00:00")),
    ]
    df = spark.createDataFrame(rows, "k string, d timestamp_ntz, e timestamp_ntz")
    got = {
        r.k: (r.late, r.status, r.status3)
        for r in df.select(
            "k",
            late_int("d", "e").alias("late"),
            delivery_status("d", "e").alias("status"),
            delivery_status("d", "e", no_date="no_delivery_date").alias("status3"),
        ).collect()
    }
    assert got["eq"] == (0, "on_time", "on_time")
    assert got["1s"] == (1, "late", "late")  # full timestamps, not dates (T14)
    assert got["sameday"] == (1, "late", "late")
    assert got["null"] == (0, "on_time", "no_delivery_date")  # T12


def test_whole_days_floor(spark):
    # FIXTURES orders_days: 23:00 -> 01:00 next day is 0 days; an estimate 2 h before is -1
    df = spark.createDataFrame(
        [(ts("2018-01-01 23:00:00"), ts("2018-01-02 01:00:00")),
         (ts("2018-01-01 12:00:00"), ts("2018-01-01 10:00:00")),
         (ts("2018-01-01 00:00:00"), ts("2018-01-11 00:00:00"))],
        "a timestamp_ntz, b timestamp_ntz",
    )
    assert [r[0] for r in df.select(whole_days_between("b", "a")).collect()] == [0, -1, 10]


def test_whole_days_ignores_session_zone(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        df = spark.createDataFrame([(ts("2021-03-10 00:00:00"), ts("2021-03-20 00:00:00"))], "a timestamp_ntz, b timestamp_ntz")
        assert df.select(whole_days_between("b", "a")).first()[0] == 10  # across a DST change
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_dow_sunday_zero(spark):
    # FIXTURES orders_dow: 2018-01-07 is a Sunday, 2018-01-13 a Saturday
    df = spark.createDataFrame([(ts("2018-01-07 10:00:00"),), (ts("2018-01-13 10:00:00"),)], "t timestamp_ntz")
    assert [r[0] for r in df.select(dow_sunday0("t")).collect()] == [0, 6]


def test_haversine(spark):
    df = spark.createDataFrame(
        [(10.0, 20.0, 10.0, 20.0), (0.0, 0.0, 0.0, 180.0), (51.5007, -0.1246, 40.6892, -74.0445)],
        "a double, b double, c double, d double",
    )
    got = [r[0] for r in df.select(haversine_km("a", "b", "c", "d")).collect()]
    assert got[0] == 0.0
    assert math.isclose(got[1], math.pi * 6371, rel_tol=1e-12)  # antipodes, clamp keeps it finite
    assert math.isclose(got[2], 5574.8, rel_tol=1e-3)  # London - New York


def test_pct_rounds_half_up_in_decimal(spark):
    # 1/8 = 12.5 %; 1/800 = 0.125 % -> 0.13 (half-up); 2345/100000 = 2.345 % -> 2.35
    df = spark.createDataFrame([(1, 8), (1, 800), (2345, 100000)], "a long, b long")
    assert [r[0] for r in df.select(pct("a", "b")).collect()] == [12.5, 0.13, 2.35]
    assert [r[0] for r in spark.range(1).select(F.round(F.lit(0.125).cast("decimal(4,3)"), 2).cast("double")).collect()] == [0.13]
