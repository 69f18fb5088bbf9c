"""Regular series: resample with gap fill (A2 / J3), future calendars (X6), holiday regressors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_periods, period_start, step_interval
from ..functions.sizing import bounded_broadcast
from ..sources.tables import MONEY


def resample(
    df: DataFrame,
    keys: Sequence[str] = (),
    granularity: str = "month",
    date_col: str = "date",
    value_col: str = "spend",
    fill: bool = True,
) -> DataFrame:
    """A2: one row per (keys, period) from each key's first to last period, empty periods = 0.

    Output: ``*keys, ds DATE, y DECIMAL(18,2)``.

    Plan: (1) bucket + sum with map-side partial aggregation, so the only fact-sized shuffle
    carries at most one row per (key, period, input partition) even for a hot key; (2) on that
    aggregated series, ``lead(ds)`` per key gives the next present period and the missing ones in
    between are generated with ``sequence`` + ``explode``. No spine table and no join: a gap costs
    exactly the rows it adds. The window shuffle in (2) moves aggregated rows only; a key holds at
    most one row per period, so no task ever holds more than a calendar's worth of rows per key.
    """
    keys = list(keys)
    agg = (
        df.where(F.col(date_col).isNotNull())
        .groupBy(*keys, period_start(F.col(date_col), granularity).alias("ds"))
        .agg(F.sum(value_col).cast(MONEY).alias("y"))
    )
    return fill_gaps(agg, keys, granularity) if fill else agg


def fill_gaps(agg: DataFrame, keys: Sequence[str] = (), granularity: str = "month", ds_col: str = "ds", value_col: str = "y") -> DataFrame:
    """A2 / J3 on an already aggregated series (one row per key and period): the missing periods
    between a key's first and last get value 0. ``lead`` finds the next present period and
    ``sequence`` generates the ones in between; no spine table, no join."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(ds_col)
    agg = agg.withColumn("__next", F.lead(ds_col).over(w))
    nxt = F.col("__next")
    last_fill = add_periods(nxt, -1, granularity)
    first_fill = add_periods(F.col(ds_col), 1, granularity)
    step = step_interval(granularity)
    zero = F.lit(0).cast(agg.schema[value_col].dataType)
    gap_days = F.when(nxt.isNull() | (last_fill < first_fill), F.array().cast(f"array<{agg.schema[ds_col].dataType.simpleString()}>")).otherwise(
        F.sequence(first_fill, last_fill, step)
    )
    # one row in, (1 + gap) rows out: the present period, then its zero-valued successors
    cells = F.concat(
        F.array(F.struct(F.col(ds_col).alias("d"), F.col(value_col).alias("v"))),
        F.transform(gap_days, lambda x: F.struct(x.alias("d"), zero.alias("v"))),
    )
    out = agg.select(*keys, F.explode(cells).alias("__c"))
    return out.select(*keys, F.col("__c.d").alias(ds_col), F.col("__c.v").alias(value_col))


def future_calendar(
    series: DataFrame,
    keys: Sequence[str] = (),
    horizon: int = 24,
    granularity: str = "month",
    ds_col: str = "ds",
) -> DataFrame:
    """Per key, ``horizon`` period starts after the key's last period, with step index ``h``."""
    last = series.groupBy(*keys).agg(F.max(ds_col).alias("__last"))
    return last.select(
        *keys,
        F.posexplode(F.sequence(F.lit(1), F.lit(horizon))).alias("__i", "h"),
        "__last",
    ).select(*keys, "h", add_periods(F.col("__last"), F.col("h"), granularity).alias("ds"))


def attach_holidays(series: DataFrame, holidays: DataFrame, ds_col: str = "ds", max_rows: int = 1_000_000) -> DataFrame:
    """Left join a user-supplied holiday table (``ds DATE, holiday STRING``) as 0/1 flags.

    Holidays are a calendar, bounded by days x names; the table is broadcast only after a row-count
    proof, otherwise the join is left to AQE.
    """
    flags = holidays.groupBy(F.col("ds").alias(ds_col)).agg(F.lit(1).alias("is_holiday"))
    return series.join(bounded_broadcast(flags, max_rows), ds_col, "left").fillna({"is_holiday": 0})
