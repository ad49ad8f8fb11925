"""Property tests: scalar expressions against plain-Python definitions on random inputs."""

import datetime as dt
from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st

from emporion.functions import dow_sunday0, pct, whole_days_between

STAMPS = st.datetimes(min_value=dt.datetime(1990, 1, 1), max_value=dt.datetime(2030, 12, 31))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(STAMPS, STAMPS), min_size=1, max_size=200))
def test_whole_days_is_floor_of_elapsed_time(spark, pairs):
    df = spark.createDataFrame(pairs, "a timestamp_ntz, b timestamp_ntz")
    got = [r[0] for r in df.select(whole_days_between("b", "a")).collect()]
    assert got == [(b - a).days for a, b in pairs]  # timedelta.days floors, as pandas .dt.days


@settings(max_examples=5, deadline=None)
@given(st.lists(STAMPS, min_size=1, max_size=200))
def test_weekday_sunday_zero(spark, stamps):
    df = spark.createDataFrame([(t,) for t in stamps], "t timestamp_ntz")
    got = [r[0] for r in df.select(dow_sunday0("t")).collect()]
    assert got == [(t.weekday() + 1) % 7 for t in stamps]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 10**6), st.integers(1, 10**6)), min_size=1, max_size=200))
def test_pct_is_exact_half_up(spark, pairs):
    pairs = [(min(a, b), b) for a, b in pairs]
    df = spark.createDataFrame(pairs, "a long, b long")
    got = [r[0] for r in df.select(pct("a", "b")).collect()]
    want = [float((Decimal(100 * a) / Decimal(b)).quantize(Decimal("0.01"), rounding=ROUND_HALF_UP)) for a, b in pairs]
    assert got == want
