"""Legacy regression forecasters on a wide design matrix.

Rows are monthly spend per group of categorical columns; features are year, month, the
categoricals one-hot encoded with the alphabetically first level dropped, per-group lags
(1, 2, 3, 6, 12) and rolling means of the previous 3 / 6 months. Lag / rolling gaps are 0, other
numeric gaps the training mean. The split is chronological at month granularity (a month is never
split between train and test). Everything is a Spark ML ``Pipeline``; the fitted pipeline is
reused for test and future rows (fit once, transform many).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.regression import GeneralizedLinearRegression, LinearRegression
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.sizing import bounded_broadcast
from ..operators.features import GROUP_LAGS, add_lags, add_rolling_means, tail_features
from ..operators.ledger import DEFAULT_LEVEL

ROLL = ("rolling_mean_3", "rolling_mean_6")
LAG_COLS = tuple(f"lag_{k}" for k in GROUP_LAGS)


def monthly_groups(ledger: DataFrame, group_cols: Sequence[str], value: str = "spend") -> DataFrame:
    """Monthly totals per group, with calendar, lag and rolling features."""
    m = ledger.groupBy(*[F.coalesce(F.col(c).cast("string"), F.lit(DEFAULT_LEVEL)).alias(c) for c in group_cols], F.trunc("date", "month").alias("month")).agg(
        F.sum(value).cast("double").alias("spend")
    )
    m = add_lags(m, group_cols, ["month"], "spend", GROUP_LAGS)
    m = add_rolling_means(m, group_cols, ["month"], "spend")
    return m.withColumns({"year": F.year("month").cast("double"), "month_num": F.month("month").cast("double")}).withColumns(
        {c: F.col(c).cast("double") for c in ROLL}
    )


def split_by_month(frame: DataFrame, train_frac: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """W9 at month granularity: the first months holding ``train_frac`` of the rows are train.
    The month counts are one row per month (bounded by the calendar)."""
    counts = frame.groupBy("month").count()
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    cum = counts.withColumn("cum", F.sum("count").over(w)).withColumn("tot", F.sum("count").over(Window.partitionBy()))
    cut = cum.where(F.col("cum") <= F.col("tot") * train_frac).agg(F.max("month")).first()[0]
    if cut is None:
        cut = cum.agg(F.min("month")).first()[0]
    return frame.where(F.col("month") <= F.lit(cut)), frame.where(F.col("month") > F.lit(cut))


def design_stages(cat_cols: Sequence[str], scale: bool) -> list:
    """M6: one-hot with the alphabetically first level dropped (index ``alphabetDesc`` puts it
    last, ``dropLast`` drops it); lag / rolling nulls -> 0 happens before; other numeric nulls ->
    training mean (``Imputer``)."""
    idx = [StringIndexer(inputCol=c, outputCol=f"{c}__i", stringOrderType="alphabetDesc", handleInvalid="error") for c in cat_cols]
    ohe = OneHotEncoder(inputCols=[f"{c}__i" for c in cat_cols], outputCols=[f"{c}__v" for c in cat_cols], dropLast=True)
    imp = Imputer(inputCols=["year", "month_num"], outputCols=["year__m", "month_num__m"], strategy="mean")
    asm = VectorAssembler(inputCols=["year__m", "month_num__m", *LAG_COLS, *ROLL, *[f"{c}__v" for c in cat_cols]], outputCol="raw" if scale else "features")
    stages = [*idx, ohe, imp, asm]
    if scale:
        stages.append(StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True))
    return stages


def prepare(frame: DataFrame) -> DataFrame:
    return frame.fillna(0.0, subset=[*LAG_COLS, *ROLL])


def map_unseen_levels(df: DataFrame, model: PipelineModel, cat_cols: Sequence[str]) -> DataFrame:
    """Levels the model never saw become the dropped (alphabetically first) level, so all of
    their dummies are 0. Level lists come from the fitted indexers (already on the driver) and are
    joined as a broadcast only after a size check."""
    spark = df.sparkSession
    out = df
    indexers = [s for s in model.stages if s.__class__.__name__ == "StringIndexerModel"]
    for c, ind in zip(cat_cols, indexers):
        labels = list(ind.labels)
        first = min(labels)
        known = spark.createDataFrame([(x,) for x in labels], f"{c} string").withColumn(f"{c}__known", F.lit(True))
        out = out.join(bounded_broadcast(known), c, "left").withColumn(
            c, F.when(F.col(f"{c}__known"), F.col(c)).otherwise(F.lit(first))
        ).drop(f"{c}__known")
    return out


def fit_regressor(frame: DataFrame, cat_cols: Sequence[str], kind: str = "tweedie") -> PipelineModel:
    """M4: Tweedie GLM (variance power 1.5, log link); M5: linear regression on standardised
    one-hot features."""
    if kind == "tweedie":
        est = GeneralizedLinearRegression(family="tweedie", variancePower=1.5, linkPower=0.0, labelCol="spend", maxIter=50, regParam=1e-6)
        stages = design_stages(cat_cols, scale=False) + [est]
    else:
        est = LinearRegression(labelCol="spend", regParam=0.0)
        stages = design_stages(cat_cols, scale=True) + [est]
    return Pipeline(stages=stages).fit(prepare(frame))


def evaluate(frame: DataFrame, cat_cols: Sequence[str], kind: str = "tweedie") -> DataFrame:
    """Fit on the first 80% of months, predict the rest; returns test rows with ``prediction``."""
    train, test = split_by_month(frame)
    model = fit_regressor(train, cat_cols, kind)
    scored = model.transform(prepare(map_unseen_levels(test, model, cat_cols)))
    return scored.select(*cat_cols, "month", "spend", "prediction")


def flat_horizon(frame: DataFrame, cat_cols: Sequence[str], horizon: int = 24, kind: str = "tweedie") -> DataFrame:
    """M8: score ``horizon`` future months per group with the group's tail features (last values
    and means) held constant on every future row."""
    model = fit_regressor(frame, cat_cols, kind)
    tails = tail_features(frame.select(*cat_cols, "month", "spend"), cat_cols, "month", "spend").drop("n_periods")
    last = frame.groupBy(*cat_cols).agg(F.max("month").alias("__last"))
    fut = null_safe_join(last, tails, cat_cols).withColumn("h", F.explode(F.sequence(F.lit(1), F.lit(horizon))))
    fut = fut.withColumn("month", F.add_months("__last", F.col("h"))).withColumns(
        {"year": F.year("month").cast("double"), "month_num": F.month("month").cast("double"), "spend": F.lit(0.0)}
    ).withColumns({c: F.col(c).cast("double") for c in [*LAG_COLS, *ROLL]})
    scored = model.transform(prepare(map_unseen_levels(fut, model, cat_cols)))
    return scored.select(*cat_cols, "month", F.greatest(F.col("prediction"), F.lit(0.0)).alias("yhat"))
