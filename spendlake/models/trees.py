"""Boosted-tree forecasters (M2, M3, M7 b, M9) on the library's histogram boosting.

One global model is trained over all series at once (calendar parts, the previous three values, and the
series as the mean of its earlier values, an ordered target statistic: no row sees its own value), on
the first 85% of every series; the last 15% is the validation set for the metrics. The H-step forecast is
recursive: each step predicts the next period of every series from the current state (last three
values), clamps at 0 and shifts the state. A series' state is one row, so a task takes all H steps of its
rows as arrays and the forecast is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import add_periods, calendar_parts
from ..operators.features import add_lags, chronological_split
from ..operators.metrics import BAND, error_metrics
from ..session import cut_lineage
from . import boosting

# Engine defaults (trees, learning rate, depth) of the two tree roles.
ENGINES = {
    "xgboost": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 3},
    "catboost": {"maxIter": 100, "stepSize": 0.1, "maxDepth": 6},
}
LAGS = (1, 2, 3)
CAL = ("year", "month", "day", "dayofweek", "quarter", "is_weekend")
FEATURES = [*CAL, *[f"lag_{k}" for k in LAGS], "series_mean"]


def boosting_params(params: dict) -> dict:
    """The engines' parameter names as those of ``boosting.fit``; others pass."""
    names = {"maxIter": "trees", "stepSize": "rate", "maxDepth": "depth", "subsamplingRate": "row_share"}
    return {names.get(k, k): v for k, v in params.items()}


def _features(df: DataFrame, ds_col: str = "ds") -> DataFrame:
    return df.withColumns({k: v.cast("double") for k, v in calendar_parts(F.col(ds_col)).items()})


def training_frame(series: DataFrame, keys: Sequence[str], ds_col: str = "ds", value: str = "y") -> DataFrame:
    """Rows with all lags, calendar parts and the mean of the series' earlier values."""
    lagged = add_lags(series.withColumn(value, F.col(value).cast("double")), keys, [ds_col], value, LAGS)
    before = Window.partitionBy(*keys).orderBy(ds_col).rowsBetween(Window.unboundedPreceding, -1)
    lagged = lagged.withColumn("series_mean", F.avg(value).over(before))
    lagged = lagged.na.drop(subset=[f"lag_{k}" for k in LAGS])
    return _features(lagged, ds_col)


def fit(series: DataFrame, keys: Sequence[str], engine: str = "xgboost", params: dict | None = None, ds_col: str = "ds", value: str = "y", train_frac: float = 0.85, seed: int = 42):
    """Train on the first ``train_frac`` of every series; returns (model, validation predictions)."""
    hp = boosting_params({**ENGINES[engine], **(params or {})})
    frame = cut_lineage(chronological_split(training_frame(series, keys, ds_col, value), keys, ds_col, train_frac))
    model = boosting.fit(frame.where("is_train"), FEATURES, value, loss="squared", seed=seed, **hp)
    return model, boosting.predict(frame.where(~F.col("is_train")), model, "yhat")


def validation_metrics(val: DataFrame, keys: Sequence[str], value: str = "y") -> DataFrame:
    return error_metrics(val, keys, value, "yhat")


def recursive_forecast(
    model: boosting.Model,
    series: DataFrame,
    keys: Sequence[str],
    horizon: int = 24,
    granularity: str = "month",
    ds_col: str = "ds",
    value: str = "y",
) -> DataFrame:
    """M7 (b): H-step recursive forecast for every series; ``keys, ds, yhat``.

    State per series is one row: last period, last three values, mean. The periods to come and their calendar
    parts are listed by Spark; a task then takes the steps for all its series at once. Predictions are clamped
    at 0 and fed back as lag 1.
    """
    y = F.col(value).cast("double")
    ranked = series.select(*keys, ds_col, y.alias("__y")).withColumn(
        "__rn", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(ds_col)))
    )
    state = ranked.groupBy(*keys).agg(
        F.max(ds_col).alias("__last"),
        F.avg("__y").alias("__mean"),
        *[F.max(F.when(F.col("__rn") == k, F.col("__y"))).alias(f"__lag_{k}") for k in LAGS],
    )
    ahead = F.transform(F.sequence(F.lit(1), F.lit(horizon)), lambda h: add_periods(F.col("__last"), h, granularity).cast("date"))
    state = state.withColumn("__ds", ahead)
    part = lambda c: lambda d: calendar_parts(d)[c].cast("double")
    state = state.withColumns({f"__{c}": F.transform("__ds", part(c)) for c in CAL})
    shared = series.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([*[state.schema[k] for k in keys], T.StructField("__ds", T.ArrayType(T.DateType())), T.StructField("__yhat", T.ArrayType(T.DoubleType()))])
    n_lags = len(LAGS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            cal = np.stack([b.column(f"__{c}").flatten().to_numpy().reshape(b.num_rows, horizon) for c in CAL], -1)
            lags = np.column_stack([b.column(f"__lag_{k}").to_numpy(zero_copy_only=False).astype(float) for k in LAGS])
            mean = b.column("__mean").to_numpy(zero_copy_only=False).astype(float)[:, None]
            out = np.zeros((b.num_rows, horizon))
            for h in range(horizon):
                x = np.column_stack([cal[:, h], lags, mean])
                out[:, h] = np.maximum(m.link(m.raw(m.bins(x))), 0.0)
                lags = np.column_stack([out[:, h], lags[:, : n_lags - 1]])
            offsets = pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * horizon)
            yhat = pa.ListArray.from_arrays(offsets, pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([*[b.column(k) for k in keys], b.column("__ds"), yhat], names=[*keys, "__ds", "__yhat"])

    steps = state.mapInArrow(run, schema).withColumn("__s", F.explode(F.arrays_zip("__ds", "__yhat")))
    return steps.select(*keys, F.col("__s.__ds").alias("ds"), F.col("__s.__yhat").alias("yhat"))


def forecast(series: DataFrame, keys: Sequence[str], engine: str = "xgboost", horizon: int = 24, granularity: str = "month", params: dict | None = None, refit: bool = False) -> tuple[DataFrame, DataFrame]:
    """M2 / M3: fit + recursive forecast + validation metrics. Returns (forecast, metrics).

    By default the forecast uses the model fitted on the first 85% (as the reference does);
    ``refit=True`` refits on the whole history for the forecast and keeps the 85% model's
    validation metrics. The input series is checkpointed once: fits and forecast re-read it."""
    series = cut_lineage(series)
    fitted, val = fit(series, keys, engine, params)
    if refit:
        fitted, _ = fit(series, keys, engine, params, train_frac=1.0)
    fc = cut_lineage(recursive_forecast(fitted, series, keys, horizon, granularity))
    return fc, validation_metrics(val, keys)


def month_year_regressor(series: DataFrame, keys: Sequence[str], horizon: int = 24, ds_col: str = "ds", value: str = "y", trees: int = 500, rate: float = 0.05, depth: int = 4, seed: int = 42) -> DataFrame:
    """M9: boosted trees on (month, year) only, a model per series, with a +-10% band.

    A series is a calendar of bounded length; its model is fitted in the task that holds it.
    """
    src = series.select(*keys, F.col(ds_col).alias("ds"), F.col(value).cast("double").alias("y"))
    schema = T.StructType([*[series.schema[k] for k in keys], T.StructField(ds_col, T.DateType()), *[T.StructField(c, T.DoubleType()) for c in ("yhat", "yhat_lower", "yhat_upper")]])
    parts = lambda d: np.column_stack([d.month, d.year]).astype(float)

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.dropna(subset=["ds", "y"]).sort_values("ds")
        if pdf.empty:
            return pd.DataFrame(columns=schema.names)
        days = pd.DatetimeIndex(pd.to_datetime(pdf["ds"]))
        model = boosting.fit_arrays(parts(days), pdf["y"].to_numpy(float), ["month", "year"], trees=trees, rate=rate, depth=depth, seed=seed)
        ahead = pd.date_range(days[-1] + pd.offsets.MonthBegin(1), periods=horizon, freq="MS")
        yhat = model.link(model.raw(model.bins(parts(ahead))))
        out = pd.DataFrame({ds_col: ahead.date, "yhat": yhat, "yhat_lower": yhat * (1 - BAND), "yhat_upper": yhat * (1 + BAND)})
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[schema.names]

    return src.groupBy(*keys).applyInPandas(one, schema)
