"""Date scalars (X1-X7), all native Catalyst expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accepted text layouts for a time column, tried in this order.
DATE_FORMATS = ("yyyy-MM-dd", "yyyy-MM", "MM/dd/yyyy", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss")


def parse_date_any(c: Column, kind: str = "string") -> Column:
    """DATE from a date, a timestamp, or text in one of ``DATE_FORMATS`` or any ISO form (``T``,
    fractions of a second, zone); null if none parse. ``kind`` is the column's type name: dates and
    timestamps are cast without a way through text."""
    if kind.startswith(("date", "timestamp")):
        return c.cast("date")
    s = F.trim(c.cast("string"))
    tries = [F.try_to_timestamp(s, F.lit(fmt)) for fmt in DATE_FORMATS]
    # plain days and months are cast, which is many times faster than formats tried in turn; year 0 is left to these
    swapped = F.concat_ws("-", F.substring(s, 7, 4), F.substring(s, 1, 2), F.substring(s, 4, 2))
    return (
        F.when(s.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}-[0-9]{2}\z"), s.try_cast("date"))
        .when(s.rlike(r"^[0-9]{2}/[0-9]{2}/(?!0000)[0-9]{4}\z"), swapped.try_cast("date"))
        .when(s.rlike(r"^(?!0000)[0-9]{4}-[0-9]{2}\z"), F.concat(s, F.lit("-01")).try_cast("date"))
        .otherwise(F.coalesce(*tries, s.try_cast("timestamp")).cast("date"))
    )


def weekday_mon0(c: Column) -> Column:
    """Day of week with Monday = 0 (``dayofweek`` is Sunday = 1, so not that)."""
    return F.weekday(c)


def is_weekend(c: Column) -> Column:
    return F.weekday(c).isin(5, 6).cast("int")


def period_start(c: Column, granularity: str) -> Column:
    """Bucket a date to the start of its period: day, week (Monday), month, quarter or year."""
    g = granularity.lower()
    if g in ("day", "daily", "d"):
        return c.cast("date")
    if g in ("week", "weekly", "w"):
        return F.date_trunc("week", c).cast("date")
    if g in ("month", "monthly", "ms", "m"):
        return F.trunc(c, "month")
    if g in ("quarter", "quarterly", "q"):
        return F.trunc(c, "quarter")
    if g in ("year", "yearly", "y"):
        return F.trunc(c, "year")
    raise ValueError(f"unknown granularity {granularity!r}")


def step_interval(granularity: str) -> Column:
    """The ``sequence`` step for a granularity."""
    g = granularity.lower()
    expr = {
        "day": "INTERVAL 1 DAY", "daily": "INTERVAL 1 DAY", "d": "INTERVAL 1 DAY",
        "week": "INTERVAL 7 DAYS", "weekly": "INTERVAL 7 DAYS", "w": "INTERVAL 7 DAYS",
        "month": "INTERVAL 1 MONTH", "monthly": "INTERVAL 1 MONTH", "ms": "INTERVAL 1 MONTH", "m": "INTERVAL 1 MONTH",
        "quarter": "INTERVAL 3 MONTHS", "quarterly": "INTERVAL 3 MONTHS", "q": "INTERVAL 3 MONTHS",
        "year": "INTERVAL 1 YEAR", "yearly": "INTERVAL 1 YEAR", "y": "INTERVAL 1 YEAR",
    }[g]
    return F.expr(expr)


def is_daily(granularity: str) -> bool:
    return granularity.lower() in ("day", "daily", "d")


def add_periods(c: Column, n: Column | int, granularity: str) -> Column:
    """``c`` moved by ``n`` periods."""
    n = F.lit(n) if isinstance(n, int) else n
    g = granularity.lower()
    if g in ("day", "daily", "d"):
        return F.date_add(c, n)
    if g in ("week", "weekly", "w"):
        return F.date_add(c, n * 7)
    if g in ("month", "monthly", "ms", "m"):
        return F.add_months(c, n)
    if g in ("quarter", "quarterly", "q"):
        return F.add_months(c, n * 3)
    if g in ("year", "yearly", "y"):
        return F.add_months(c, n * 12)
    raise ValueError(f"unknown granularity {granularity!r}")


def days_in_month(c: Column) -> Column:
    """X7."""
    return F.dayofmonth(F.last_day(c))


def calendar_parts(c: Column) -> dict[str, Column]:
    """The calendar features of the tree forecasters."""
    return {
        "year": F.year(c),
        "month": F.month(c),
        "day": F.dayofmonth(c),
        "dayofweek": weekday_mon0(c),
        "quarter": F.quarter(c),
        "is_weekend": is_weekend(c),
    }
