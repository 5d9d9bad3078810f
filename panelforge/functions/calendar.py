"""Trading days by rule, and business-day offsets."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def easter(year: int) -> dt.date:
    """Easter Sunday of the Gregorian calendar (the anonymous algorithm)."""
    a, (b, c) = year % 19, divmod(year, 100)
    d, e = divmod(b, 4)
    g = (8 * b + 13) // 25
    h = (19 * a + b - d - g + 15) % 30
    i, k = divmod(c, 4)
    m = (a + 11 * h) // 319
    r = (2 * e + 2 * i - k - h + m + 32) % 7
    month = (h - m + r + 90) // 25
    return dt.date(year, month, (h - m + r + month + 19) % 32)


def _nth(year: int, month: int, weekday: int, n: int) -> dt.date:
    """The n-th such weekday of a month; n = -1: the last."""
    if n > 0:
        first = dt.date(year, month, 1)
        return first + dt.timedelta((weekday - first.weekday()) % 7 + 7 * (n - 1))
    last = dt.date(year + month // 12, month % 12 + 1, 1) - dt.timedelta(1)
    return last - dt.timedelta((last.weekday() - weekday) % 7)


#: Days on which the New York exchange was closed besides its rules, 1994 to 2025.
SPECIAL_CLOSURES = (
    dt.date(1994, 4, 27), dt.date(2001, 9, 11), dt.date(2001, 9, 12), dt.date(2001, 9, 13), dt.date(2001, 9, 14),
    dt.date(2004, 6, 11), dt.date(2007, 1, 2), dt.date(2012, 10, 29), dt.date(2012, 10, 30), dt.date(2018, 12, 5), dt.date(2025, 1, 9),
)


def nyse_holidays(first: int, last: int) -> list[dt.date]:
    """Full-day closures of the years first to last."""
    out = []
    for y in range(first, last + 1):
        fixed = [(1, 1), (7, 4), (12, 25)] + ([(6, 19)] if y >= 2022 else [])
        for month, day in fixed:
            d = dt.date(y, month, day)
            if d.weekday() == 6:
                out.append(d + dt.timedelta(1))
            elif d.weekday() < 5:
                out.append(d)
            elif month != 1:  # a Saturday New Year isn't made up for
                out.append(d - dt.timedelta(1))
        if y >= 1998:
            out.append(_nth(y, 1, 0, 3))
        out += [_nth(y, 2, 0, 3), easter(y) - dt.timedelta(2), _nth(y, 5, 0, -1), _nth(y, 9, 0, 1), _nth(y, 11, 3, 4)]
    return sorted({*out, *(d for d in SPECIAL_CLOSURES if first <= d.year <= last)})


def is_trading_day(date: Column, first: int, last: int, name: str = "NYSE") -> Column:
    """Whether a date of the years first to last is a trading day.  Calendars: NYSE, or WEEKDAYS without holidays."""
    if name not in ("NYSE", "WEEKDAYS"):
        raise ValueError(f"unknown calendar: {name}")
    closed = nyse_holidays(first, last) if name == "NYSE" else []
    return (F.weekday(date) < 5) & ~date.isin(closed) if closed else F.weekday(date) < 5


def trading_days(spark: SparkSession, start: dt.date, end: dt.date, name: str = "NYSE") -> DataFrame:
    """One row per trading day of [start, end]."""
    days = spark.range(1).select(F.explode(F.sequence(F.lit(start), F.lit(end))).alias("date"))
    return days.where(is_trading_day(F.col("date"), start.year, end.year, name))


def business_day(start: Column, offset: Column) -> Column:
    """The business day `offset` (0 or more) after the first one on or after `start`; holidays count as business days."""
    base = F.date_add(start, F.greatest(F.lit(0), F.lit(7) - F.weekday(start)).cast("int") * (F.weekday(start) >= 5).cast("int"))
    weeks, rest = F.floor(offset / 5), offset % 5
    over = (F.weekday(base) + rest >= 5).cast("int") * 2
    return F.date_add(base, (weeks * 7 + rest + over).cast("int"))
