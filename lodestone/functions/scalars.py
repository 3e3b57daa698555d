"""Scalar expressions whose meaning differs from Spark's operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Parts of a date that EXTRACT gives, all as 64-bit integers.
PARTS = ("year", "month", "day", "hour", "minute", "second", "week", "millisecond", "microsecond")


def int_div(a: Column, b: Column) -> Column:
    """Division of integers: truncates towards zero, exact at 64 bits; division by zero is an error."""
    return F.call_function("div", a, b)


def decimal_div(a: Column, b: Column) -> Column:
    """Division of decimals in double precision."""
    return a.cast("double") / b.cast("double")


def extract(part: str, value: Column) -> Column:
    """A part of a date or timestamp as a 64-bit integer."""
    if part.lower() not in PARTS:
        raise ValueError(f"unknown part {part!r}")
    seconds = F.date_part(F.lit("second"), value.cast("timestamp_ntz"))
    within = {"second": 1, "millisecond": 1_000, "microsecond": 1_000_000}
    if part.lower() in within:
        return F.floor(seconds * within[part.lower()]).cast("long")
    return F.date_part(F.lit(part), value.cast("timestamp_ntz")).cast("long")


def plus_interval(value: Column, count: int, unit: str) -> Column:
    """A date or timestamp moved by a whole number of years, months, days, hours, minutes or seconds."""
    unit = unit.lower().rstrip("s")
    if unit in ("year", "month"):
        return value + F.make_ym_interval(F.lit(count if unit == "year" else 0), F.lit(count if unit == "month" else 0))
    places = ("day", "hour", "minute", "second")
    return value + F.make_dt_interval(*(F.lit(count if unit == p else 0) for p in places))
