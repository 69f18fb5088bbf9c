"""Forecasters that are plain aggregates and windows over all series at once.

* ``ols_trend``: per-series least squares on a month counter (``regr_slope`` / ``regr_intercept``)
* ``seasonal_naive``: the value of the same period one season back
* ``ar1_recursive``: recursive multi-step forecast (M7 a): y(t) = max(0, a + b y(t-1)), fed back H
  times inside one ``aggregate`` over ``sequence(1, H)`` per series, so the recursion is a column
  expression and not a driver loop.

Each fit is one grouped aggregation keyed by the series (partial aggregation map-side), and each
forecast is an ``explode`` of H rows per series.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import add_periods
from ..functions.joins import null_safe_join
from ..operators.features import month_index


# Fixed value: time origin of the trend regressions (month 2000-01 / day 2000-01-01), which keeps
# the integer sums of the exact fit small.
ORIGIN_MONTH = 2000 * 12
ORIGIN_DAY = "2000-01-01"


def _t(ds_col: str, granularity: str):
    """Integer time index: days or months since the origin."""
    if granularity.lower() in ("day", "daily", "d"):
        return F.datediff(F.col(ds_col), F.lit(ORIGIN_DAY).cast("date")).cast("long")
    return (month_index(F.col(ds_col)) - F.lit(ORIGIN_MONTH)).cast("long")


def _is_money(series: DataFrame, value: str) -> bool:
    return dict(series.dtypes)[value].startswith("decimal")


D38 = "decimal(38,0)"


def ols_fit(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", value: str = "y", granularity: str = "month") -> DataFrame:
    """Per-series least-squares sufficient statistics (one grouped aggregation, combined
    map-side): n, sum t, sum t^2, and for money in cents sum y, sum t*y, all exact integers."""
    t = _t(ds_col, granularity).cast(D38)
    y = (F.col(value) * 100).cast(D38) if _is_money(series, value) else F.col(value).cast("double")
    return series.groupBy(*keys).agg(
        F.count(F.lit(1)).cast(D38).alias("n"),
        F.sum(t).alias("st"),
        F.sum(t * t).alias("stt"),
        F.sum(y).alias("sy"),
        F.sum(t * y).alias("sty"),
        F.max(ds_col).alias("last_ds"),
    )


def _with_prediction(df: DataFrame, t_col, money: bool, out: str = "yhat") -> DataFrame:
    """Add ``out`` = the fitted trend at time ``t_col`` from the fit columns.

    Money: the exact rational (sy*D - N*st + N*n*t) / (n*D) with D = n*stt - st^2 and
    N = n*sty - st*sy, rounded half away from zero to cents by integer division (``div``
    truncates toward zero, so (2a +- b) div 2b is the rounded quotient), giving the same forecast
    on every engine and partitioning. A series with a single period is flat at its mean.
    Doubles: the same closed form in floating point.
    """
    n, st, stt, sy, sty = (F.col(c) for c in ("n", "st", "stt", "sy", "sty"))
    if money:
        t = t_col.cast(D38)
        d = n * stt - st * st
        num = n * sty - st * sy
        a = F.when(d > 0, sy * d - num * st + num * n * t).otherwise(sy)
        b = F.when(d > 0, n * d).otherwise(n)
        df = df.withColumns({"__a": a.cast(D38), "__b": b.cast(D38)})
        cents = F.expr("(CASE WHEN __a >= 0 THEN 2 * __a + __b ELSE 2 * __a - __b END) div (2 * __b)")
        return df.withColumn(out, (cents.cast(D38) / F.lit(100)).cast("decimal(18,2)")).drop("__a", "__b")
    n, st, stt, sy, sty = (c.cast("double") for c in (n, st, stt, sy, sty))
    t = t_col.cast("double")
    d = n * stt - st * st
    slope = (n * sty - st * sy) / d
    icpt = (sy - slope * st) / n
    return df.withColumn(out, F.when(d != 0, icpt + slope * t).otherwise(sy / n))


def ols_trend(series: DataFrame, keys: Sequence[str], horizon: int = 24, ds_col: str = "ds", value: str = "y", granularity: str = "month") -> DataFrame:
    """Linear trend forecast for every series: ``keys, ds, yhat`` for H periods after the last."""
    money = _is_money(series, value)
    fit = ols_fit(series, keys, ds_col, value, granularity)
    fut = fit.withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    fut = fut.withColumn("ds", add_periods(F.col("last_ds"), F.col("h"), granularity))
    fut = _with_prediction(fut, _t("ds", granularity), money)
    yhat = F.col("yhat").cast("double") if money else F.round("yhat", 2)
    return fut.select(*keys, "ds", yhat.alias("yhat"))


def ols_fitted(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", value: str = "y", granularity: str = "month") -> DataFrame:
    """In-sample fitted values of the trend, rounded to cents (``keys, ds, y, yhat``)."""
    money = _is_money(series, value)
    fit = ols_fit(series, keys, ds_col, value, granularity)
    j = _with_prediction(null_safe_join(series.select(*keys, ds_col, value), fit, keys), _t(ds_col, granularity), money)
    yhat = F.col("yhat") if money else F.round("yhat", 2).cast("decimal(18,2)")
    return j.select(*keys, ds_col, value, yhat.alias("yhat"))


def seasonal_naive(series: DataFrame, keys: Sequence[str], horizon: int = 24, season: int = 12, ds_col: str = "ds", value: str = "y", granularity: str = "month") -> DataFrame:
    """yhat(T + h) = y(T + h - season * ceil(h / season)); the last value where that is missing."""
    last = series.groupBy(*keys).agg(F.max(ds_col).alias("last_ds"), F.max_by(value, ds_col).alias("last_y"))
    fut = last.select(*keys, "last_ds", "last_y", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("h"))
    fut = fut.withColumn("ds", add_periods(F.col("last_ds"), F.col("h"), granularity)).withColumn(
        "src_ds", add_periods(F.col("ds"), -F.lit(season) * F.ceil(F.col("h") / F.lit(season)), granularity)
    )
    hist = series.select(*keys, F.col(ds_col).alias("src_ds"), F.col(value).alias("src_y"))
    j = null_safe_join(fut, hist, [*keys, "src_ds"], "left")
    return j.select(*keys, "ds", F.coalesce("src_y", "last_y").cast("decimal(18,2)").alias("yhat"))


def ar1_fit(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", value: str = "y") -> DataFrame:
    """AR(1) with intercept per series by least squares of y on its previous value."""
    w = Window.partitionBy(*keys).orderBy(ds_col)
    y = F.col(value).cast("double")
    lagged = series.withColumn("__prev", F.lag(y, 1).over(w))
    return lagged.groupBy(*keys).agg(
        F.regr_intercept(y, F.col("__prev")).alias("a"),
        F.regr_slope(y, F.col("__prev")).alias("b"),
        F.max(ds_col).alias("last_ds"),
        F.max_by(y, F.col(ds_col)).alias("last_y"),
    )


def ar1_recursive(series: DataFrame, keys: Sequence[str], horizon: int = 12, ds_col: str = "ds", value: str = "y", granularity: str = "month") -> DataFrame:
    """M7 (a): recursive forecast, clamped at 0 and fed back, as one ``aggregate`` per series.

    A series whose fit is undefined (fewer than 2 lagged pairs, or constant history) carries its
    last value forward.
    """
    fit = ar1_fit(series, keys, ds_col, value)
    a = F.coalesce(F.col("a"), F.lit(0.0))
    b = F.when(F.col("b").isNull(), F.lit(1.0)).otherwise(F.col("b"))
    a = F.when(F.col("b").isNull(), F.lit(0.0)).otherwise(a)
    init = F.struct(F.col("last_y").alias("prev"), F.array().cast("array<double>").alias("out"))

    def step(acc, _h):
        nxt = F.greatest(a + b * acc["prev"], F.lit(0.0))
        return F.struct(nxt.alias("prev"), F.concat(acc["out"], F.array(nxt)).alias("out"))

    path = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), init, step)["out"]
    out = fit.select(*keys, "last_ds", F.posexplode(path).alias("i", "v"))
    return out.select(*keys, add_periods(F.col("last_ds"), F.col("i") + 1, granularity).alias("ds"), F.round("v", 2).alias("yhat"))
