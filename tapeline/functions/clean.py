"""Cleaning of identifiers and clock times as feeds spell them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: An id above this carries a channel prefix: channel * CHANNEL + number.
CHANNEL = 10**12
MINUTE_NS = 60 * 10**9
DAY_NS = 86_400 * 10**9


def plain_id(c: Column) -> Column:
    """The exchange number without channel prefix."""
    return F.when(c > F.lit(CHANNEL), c % F.lit(CHANNEL)).otherwise(c)


def six_digits(c: Column) -> Column:
    """The six-digit symbol of ``sz000001``, ``000001.SZ``, `` 1 `` or ``000001``; null if there is no digit."""
    digits = F.regexp_extract(c, r"(\d+)", 1)
    return F.when(digits != "", F.lpad(digits, 6, "0"))


def clock_ticks(c: Column, per_second: int = 10_000) -> Column:
    """A clock string as whole ticks since midnight: ``HH:MM:SS.ffff``, or plain milliseconds since midnight.

    Null or unreadable strings give null.
    """
    parts = F.split(F.trim(c), ":")
    clock = (
        F.get(parts, F.lit(0)).try_cast("double") * 3600
        + F.get(parts, F.lit(1)).try_cast("double") * 60
        + F.get(parts, F.lit(2)).try_cast("double")
    )
    seconds = F.when(F.contains(c, F.lit(":")), clock).otherwise(F.trim(c).try_cast("double") / 1000)
    return F.round(seconds * per_second).cast("long")


def second_ticks(c: Column, per_second: int = 10_000) -> Column:
    """Seconds since midnight as whole ticks; NaN counts as null."""
    return F.when(~F.isnan(c), F.round(c * per_second).cast("long"))


def finite(c: Column) -> Column:
    """True where ``c`` is a number: not null, NaN or infinite."""
    d = c.cast("double")
    return d.isNotNull() & ~F.isnan(d) & (F.abs(d) != F.lit(float("inf")))


def bar_ns(profile: Column, stamp: Column) -> Column:
    """Nanoseconds since epoch of a bar stamp, whose unit its profile fixes."""
    return F.when(profile == "flatfiles", stamp).when(profile == "rest_split_adjusted", stamp * F.lit(10**6))
