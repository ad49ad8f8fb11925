"""Column expressions shared by the analyses — all built-in Spark functions, no UDFs."""

from emporion.functions.exprs import (
    EARTH_RADIUS_KM,
    cents_to_decimal,
    cents_to_double,
    to_cents,
    delivery_status,
    dow_sunday0,
    haversine_km,
    is_late,
    late_int,
    pct,
    round_money,
    whole_days_between,
)

__all__ = [
    "EARTH_RADIUS_KM",
    "cents_to_decimal",
    "cents_to_double",
    "to_cents",
    "delivery_status",
    "dow_sunday0",
    "haversine_km",
    "is_late",
    "late_int",
    "pct",
    "round_money",
    "whole_days_between",
]
