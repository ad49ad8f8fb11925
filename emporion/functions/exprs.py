"""Scalar building blocks.

Every function returns a ``Column`` made of built-in expressions so that it stays inside
whole-stage codegen and is visible to the optimizer.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: mean Earth radius in km used by the distance feature.
EARTH_RADIUS_KM = 6371.0

DELIVERED = "order_delivered_customer_date"
ESTIMATED = "order_estimated_delivery_date"


def _c(x: str | Column) -> Column:
    return F.col(x) if isinstance(x, str) else x


def is_late(delivered: str | Column = DELIVERED, estimated: str | Column = ESTIMATED) -> Column:
    """Boolean: delivered strictly after the estimate.  NULL delivery gives false."""
    return F.coalesce(_c(delivered) > _c(estimated), F.lit(False))


def late_int(delivered: str | Column = DELIVERED, estimated: str | Column = ESTIMATED) -> Column:
    """B1: 1 when late, else 0 (NULL delivery counts as 0)."""
    return F.when(_c(delivered) > _c(estimated), F.lit(1)).otherwise(F.lit(0))


def delivery_status(
    delivered: str | Column = DELIVERED,
    estimated: str | Column = ESTIMATED,
    late: str = "late",
    on_time: str = "on_time",
    no_date: str | None = None,
) -> Column:
    """G1: CASE label.  With ``no_date`` set, a NULL delivery gets its own label (E4b);
    otherwise it falls into ``on_time`` exactly as the SQL CASE does (T12)."""
    d, e = _c(delivered), _c(estimated)
    expr = F.when(d > e, F.lit(late))
    if no_date is not None:
        expr = expr.when(d.isNull(), F.lit(no_date))
    return expr.otherwise(F.lit(on_time))


def pct(numerator: str | Column, denominator: str | Column, scale: int = 2) -> Column:
    """G6 + G2: ``round(100.0 * a / b, scale)`` computed in DECIMAL (half-up), as DOUBLE."""
    num = _c(numerator).cast("decimal(38,0)")
    den = _c(denominator).cast("decimal(38,0)")
    return F.round(F.lit(100).cast("decimal(3,0)") * num / den, scale).cast("double")


def round_money(x: str | Column, scale: int = 2) -> Column:
    """Round an exact DECIMAL sum half-up and expose it as DOUBLE (T4, T5)."""
    return F.round(_c(x), scale).cast("double")


def to_cents(money: str | Column) -> Column:
    """DECIMAL(p,2) money as exact integer cents (BIGINT).  Grouped sums over BIGINT use
    primitive aggregation buffers; sums over DECIMAL wider than 18 digits use one BigDecimal
    object per group and row.  ANSI mode turns an overflow into an error, never a wrong sum."""
    return (_c(money) * 100).cast("bigint")


def cents_to_double(cents: str | Column) -> Column:
    """Exact cents -> money as DOUBLE (the same value a DECIMAL sum cast to DOUBLE gives)."""
    return (_c(cents).cast("double") / F.lit(100.0)).alias("money")


def cents_to_decimal(cents: str | Column, precision: int = 20) -> Column:
    """Exact cents -> DECIMAL(precision, 2)."""
    return (_c(cents).cast(f"decimal({precision},0)") / F.lit(100)).cast(f"decimal({precision},2)")


def whole_days_between(later: str | Column, earlier: str | Column) -> Column:
    """Elapsed whole days, floored (23:00 -> 01:00 next day is 0; -2 h is -1).

    ``timestampdiff`` on TIMESTAMP_NTZ values involves no time zone, so the result does not
    depend on the session zone (a cast to TIMESTAMP would lose an hour across DST)."""
    micros = F.timestamp_diff("MICROSECOND", _c(earlier), _c(later))
    return F.floor(micros / F.lit(86_400_000_000)).cast("bigint")


def dow_sunday0(ts: str | Column) -> Column:
    """Day of week with Sunday = 0 … Saturday = 6."""
    return (F.dayofweek(_c(ts)) - 1).cast("int")


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance in km.  Inputs may be DECIMAL; they are read as DOUBLE.
    The ``least(1, …)`` clamp only guards rounding error for antipodal points."""
    p1, l1, p2, l2 = (F.radians(_c(v).cast("double")) for v in (lat1, lon1, lat2, lon2))
    a = F.pow(F.sin((p2 - p1) / 2), 2) + F.cos(p1) * F.cos(p2) * F.pow(F.sin((l2 - l1) / 2), 2)
    return F.lit(2 * EARTH_RADIUS_KM) * F.asin(F.sqrt(F.least(F.lit(1.0), a)))
