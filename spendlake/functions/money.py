"""Money and statistics scalars that keep results exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import MONEY


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def money(c: Column | str) -> Column:
    return col_(c).cast(MONEY)


def sum_money(c: Column | str) -> Column:
    """Order-independent DECIMAL sum, so the result is the same on every plan and engine."""
    return F.sum(col_(c)).cast(MONEY)


def mean_money(c: Column | str) -> Column:
    """Exact mean of a DECIMAL column, rounded half-up to cents (no double summation)."""
    c = col_(c)
    return (F.sum(c) / F.count(c)).cast(MONEY)


def as_double(c: Column | str) -> Column:
    return col_(c).cast("double")


def safe_ratio(num: Column, den: Column) -> Column:
    """X9 division guard: 0 when the denominator is 0 or null."""
    return F.coalesce(F.try_divide(num, F.nullif(den, F.lit(0))), F.lit(0.0))


def currency_text(c: Column | str) -> Column:
    """Axis labels. 0 or null -> ``$0``; >= 1e9 -> ``$x.xB``; >= 1e6 -> ``$x.xM``;
    >= 1e3 -> ``$xk`` (no decimals); otherwise the plain amount."""
    v = col_(c).cast("double")
    return (
        F.when(v.isNull() | (v == 0), F.lit("$0"))
        .when(v >= 1e9, F.format_string("$%.1fB", v / 1e9))
        .when(v >= 1e6, F.format_string("$%.1fM", v / 1e6))
        .when(v >= 1e3, F.format_string("$%.0fk", v / 1e3))
        .otherwise(F.concat(F.lit("$"), F.when(v == F.floor(v), v.cast("long").cast("string")).otherwise(v.cast("string"))))
    )


def kpi_currency_text(c: Column | str) -> Column:
    """KPI card labels. 0 or null -> ``$0``; >= 1e6 -> ``$x.xxM``; otherwise grouped."""
    v = col_(c).cast("double")
    return (
        F.when(v.isNull() | (v == 0), F.lit("$0"))
        .when(v >= 1e6, F.format_string("$%.2fM", v / 1e6))
        .otherwise(F.concat(F.lit("$"), F.format_number(v, 2)))
    )
