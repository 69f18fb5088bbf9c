"""Series features: lags, rolling means, tail constants, splits, folds, backtest cutoffs
(W1-W3, W6, W9-W11, X1, X2).

These windows are partitioned by the series key and run on squashed (A1) or resampled (A2)
series, where a key holds at most one row per period. A hot key therefore costs one task a
calendar's worth of rows (thousands), never a share of the raw ledger.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import calendar_parts
from ..functions.joins import null_safe_join

# Lag offsets and rolling widths of the legacy feature set.
GROUP_LAGS = (1, 2, 3, 6, 12)
ROLLING_WIDTHS = (3, 6)


def _w(keys: Sequence[str], order: Sequence[str]) -> Window:
    return Window.partitionBy(*keys).orderBy(*order)


def add_lags(df: DataFrame, keys: Sequence[str], order: Sequence[str], value: str, lags: Sequence[int] = GROUP_LAGS, prefix: str = "lag_") -> DataFrame:
    """Row-offset lags per series (not calendar offsets)."""
    w = _w(keys, order)
    return df.withColumns({f"{prefix}{k}": F.lag(value, k).over(w) for k in lags})


def add_rolling_means(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    value: str,
    widths: Sequence[int] = ROLLING_WIDTHS,
    scope: str = "series",
    scale: int = 4,
) -> DataFrame:
    """Mean of the previous ``w`` values (the rolling mean of lag 1), null unless all ``w`` exist.

    ``scope="series"`` keeps the window inside each series. ``scope="global"`` reproduces the
    flattened behaviour where the rolling window crosses series boundaries in frame order; it is an
    un-partitioned window, meant for parity checks on small data only.
    """
    w = _w(keys, order) if scope == "series" else Window.orderBy(*keys, *order)
    out = df
    if scope == "global":
        out = out.withColumn("__lag1", F.lag(value, 1).over(_w(keys, order)))
        src = "__lag1"
        cols = {}
        for n in widths:
            fr = w.rowsBetween(-(n - 1), 0)
            cols[f"rolling_mean_{n}"] = F.when(F.count(src).over(fr) == n, (F.sum(src).over(fr) / F.lit(n)).cast(f"decimal(18,{scale})"))
        return out.withColumns(cols).drop("__lag1")
    cols = {}
    for n in widths:
        fr = w.rowsBetween(-n, -1)
        cols[f"rolling_mean_{n}"] = F.when(F.count(value).over(fr) == n, (F.sum(value).over(fr) / F.lit(n)).cast(f"decimal(18,{scale})"))
    return out.withColumns(cols)


def add_calendar(df: DataFrame, ds_col: str = "ds") -> DataFrame:
    """Year, month, day, day of week (Monday = 0), quarter, weekend flag."""
    return df.withColumns(calendar_parts(F.col(ds_col)))


def tail_features(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", value: str = "y", scale: int = 4) -> DataFrame:
    """Per series the constants given to every future row: the 1st, 2nd, 3rd, 6th and 12th
    last values and the means of the last 3 and 6; a series shorter than the offset falls back to
    its last value. One row per series, computed by one window + one aggregation."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ds_col))
    ranked = series.withColumn("__rn", F.row_number().over(w))
    last = F.max(F.when(F.col("__rn") == 1, F.col(value)))
    n = F.count(F.lit(1))
    aggs = [n.alias("n_periods")]
    for k in GROUP_LAGS:
        aggs.append(F.coalesce(F.max(F.when(F.col("__rn") == k, F.col(value))), last).alias(f"lag_{k}"))
    for k in ROLLING_WIDTHS:
        mean_k = (F.sum(F.when(F.col("__rn") <= k, F.col(value))) / F.lit(k)).cast(f"decimal(18,{scale})")
        aggs.append(F.when(n >= k, mean_k).otherwise(last.cast(f"decimal(18,{scale})")).alias(f"rolling_mean_{k}"))
    return ranked.groupBy(*keys).agg(*aggs)


def chronological_split(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", train_frac: float = 0.8) -> DataFrame:
    """First ``floor(n * frac)`` periods of each series are train, the rest test."""
    w = Window.partitionBy(*keys).orderBy(ds_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    rn = F.row_number().over(w)
    cut = F.floor(n * F.lit(train_frac))
    return series.withColumn("rn", rn).withColumn("is_train", F.col("rn") <= cut)


def expanding_folds(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", n_splits: int = 3) -> DataFrame:
    """Expanding-window time-series folds per series.

    test size = n // (n_splits + 1); fold f validates positions [n - (n_splits - f) * t, + t) and
    trains on everything before. Rows are tagged per fold (a row appears once per fold it is in),
    so all folds of all series are trained in parallel downstream.
    """
    w = Window.partitionBy(*keys).orderBy(ds_col)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    base = series.withColumn("__pos", F.row_number().over(w) - 1).withColumn("__n", n)
    t = F.floor(F.col("__n") / F.lit(n_splits + 1))
    start = F.col("__n") - (F.lit(n_splits) - F.col("fold")) * t
    tagged = base.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(n_splits - 1))))
    role = F.when(F.col("__pos") < start, "train").when(F.col("__pos") < start + t, "val")
    return tagged.withColumn("role", role).where(F.col("role").isNotNull() & (t > 0)).drop("__pos", "__n")


def backtest_cutoffs(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", initial_days: int = 180, period_days: int = 30, horizon_days: int = 90) -> DataFrame:
    """Rolling-origin cutoffs per series: max - horizon, stepping back by period while the
    cutoff leaves ``initial`` days of history. A series too short for one cutoff yields none."""
    b = series.groupBy(*keys).agg(F.min(ds_col).alias("__lo"), F.max(ds_col).alias("__hi"))
    first = F.date_sub(F.col("__hi"), horizon_days)
    floor_ = F.date_add(F.col("__lo"), initial_days)
    cut = F.when(first >= floor_, F.sequence(first, floor_, F.expr(f"INTERVAL -{period_days} DAYS")))
    return b.select(*keys, F.explode(cut).alias("cutoff")).select(*keys, "cutoff")


def backtest_rows(series: DataFrame, cutoffs: DataFrame, keys: Sequence[str], ds_col: str = "ds", horizon_days: int = 90) -> DataFrame:
    """Each series row tagged with every cutoff it belongs to as train (ds <= cutoff) or test
    (cutoff < ds <= cutoff + horizon). Equi-join on the series key; cutoffs per key are bounded by
    span / period, so each row fans out to at most that many folds."""
    j = null_safe_join(series, cutoffs, keys)
    role = F.when(F.col(ds_col) <= F.col("cutoff"), "train").when(F.col(ds_col) <= F.date_add("cutoff", horizon_days), "test")
    return j.withColumn("role", role).where(F.col("role").isNotNull())


def month_index(c: Column) -> Column:
    """Integer month counter (year * 12 + month - 1), the time axis of monthly regressions."""
    return F.year(c) * 12 + F.month(c) - 1
