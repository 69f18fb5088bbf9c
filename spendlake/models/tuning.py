"""Hyper-parameter search (M10, M11, W12), model registry (M14) and ensembles.

* M10: adaptive search (tree-structured Parzen estimator). Within a series a trial follows from those
  before it; series run in parallel, each in the task that holds it. The best trial per series (lowest
  RMSE over expanding folds) is refitted on the full history.
* M10 (trees): the same sampler over an engine's space, some trials at a time, trained on the first 85% of
  every series and validated on the rest, candidate fits running concurrently.
* M11 / W12: grid search over expanding folds (W10), so validation never precedes training; all numbers of
  trees of a grid point come from one model, and points and folds run in parallel.
* M14: fitted pipelines saved under the shared folder with an append-only registry; the newest
  per family is loaded, older than the 5 newest are pruned from the registry.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..operators.features import chronological_split, expanding_folds
from ..session import cut_lineage
from . import boosting, decompose
from .trees import FEATURES, boosting_params, training_frame

# Search spaces (kind, then bounds or choices).
SPACE = {
    "changepoint_prior_scale": ("log", 1e-3, 0.5),
    "seasonality_mode": ("choice", "additive", "multiplicative"),
}
TREE_SPACES = {
    "xgboost": {"stepSize": ("log", 1e-4, 0.3), "maxDepth": ("int", 3, 10), "maxIter": ("int", 50, 300), "subsamplingRate": ("real", 0.5, 1.0)},
    "catboost": {"stepSize": ("log", 1e-4, 0.3), "maxDepth": ("int", 4, 10), "maxIter": ("int", 50, 300)},
}
MAX_TRIALS = 100
KEEP_MODELS = 5
#: Trials drawn at random before the search adapts, and candidates it weighs for each one after that.
STARTUP = 10
CANDIDATES = 24


def _check_trials(n: int) -> None:
    if not 1 <= n <= MAX_TRIALS:
        raise ValueError(f"trials must be in 1..{MAX_TRIALS}")


class Parzen:
    """Density of one parameter among some trials: kernels around their values and a broad one."""

    def __init__(self, spec: tuple, values: list):
        self.spec = spec
        if spec[0] == "choice":
            self.weight = np.array([1.0 + sum(v == c for v in values) for c in spec[1:]])
            self.weight /= self.weight.sum()
            return
        lo, hi = map(self._scale, spec[1:])
        self.lo, self.hi = lo, hi
        at = np.sort([self._scale(v) for v in values])
        # a kernel is as wide as the distance to its farther neighbour
        edge = np.r_[lo, at, hi]
        wide = np.maximum(edge[2:] - edge[1:-1], edge[1:-1] - edge[:-2])
        least = (hi - lo) / min(100.0, 1.0 + len(at))
        self.mid = np.r_[at, (lo + hi) / 2]
        self.wide = np.r_[np.clip(wide, least, hi - lo), hi - lo]

    def _scale(self, v: float) -> float:
        return math.log(v) if self.spec[0] == "log" else float(v)

    def draw(self, rng: np.random.Generator, n: int) -> list:
        if self.spec[0] == "choice":
            return [self.spec[1 + i] for i in rng.choice(len(self.weight), n, p=self.weight)]
        k = rng.integers(len(self.mid), size=n)
        x = rng.normal(self.mid[k], self.wide[k])
        for _ in range(50):  # draws outside the bounds are repeated
            out = (x < self.lo) | (x > self.hi)
            if not out.any():
                break
            x[out] = rng.normal(self.mid[k[out]], self.wide[k[out]])
        x = np.clip(x, self.lo, self.hi)
        if self.spec[0] == "int":
            return [int(v) for v in np.rint(x)]
        return [float(v) for v in (np.exp(x) if self.spec[0] == "log" else x)]

    def log_density(self, values: list) -> np.ndarray:
        if self.spec[0] == "choice":
            return np.log([self.weight[self.spec[1:].index(v)] for v in values])
        x = np.array([self._scale(v) for v in values])[:, None]
        inside = _normal_cdf((self.hi - self.mid) / self.wide) - _normal_cdf((self.lo - self.mid) / self.wide)
        kernel = np.exp(-0.5 * ((x - self.mid) / self.wide) ** 2) / (self.wide * inside)
        return np.log(kernel.mean(1) + 1e-300)


def _normal_cdf(x: np.ndarray) -> np.ndarray:
    return np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in np.atleast_1d(x)])


def suggest(space: dict, history: list[tuple[dict, float]], rng: np.random.Generator, startup: int = STARTUP) -> dict:
    """The next trial after ``history`` (parameters, loss): uniform at first, then of some candidates from the
    density of the better quarter the one whose density there is largest against that of the others."""
    known = sorted((h for h in history if np.isfinite(h[1])), key=lambda h: h[1])
    if len(known) < startup:
        return {k: _uniform(s, rng) for k, s in space.items()}
    good = known[: min(math.ceil(0.25 * math.sqrt(len(known)) * 2), 25)]
    bad = known[len(good) :]
    out = {}
    for k, spec in space.items():
        better, worse = (Parzen(spec, [t[k] for t, _ in part]) for part in (good, bad))
        drawn = better.draw(rng, CANDIDATES)
        out[k] = drawn[int(np.argmax(better.log_density(drawn) - worse.log_density(drawn)))]
    return out


def _uniform(spec: tuple, rng: np.random.Generator):
    kind = spec[0]
    if kind == "choice":
        return spec[1 + int(rng.integers(len(spec) - 1))]
    if kind == "int":
        return int(rng.integers(spec[1], spec[2] + 1))
    if kind == "log":
        return float(math.exp(rng.uniform(math.log(spec[1]), math.log(spec[2]))))
    return float(rng.uniform(spec[1], spec[2]))


def search(objective, space: dict, n_trials: int, seed: int = 42, startup: int = STARTUP) -> list[tuple[dict, float]]:
    """``n_trials`` trials of ``objective`` (parameters -> loss), each following from those before it."""
    _check_trials(n_trials)
    rng, history = np.random.default_rng(seed), []
    for _ in range(n_trials):
        t = suggest(space, history, rng, startup)
        history.append((t, float(objective(t))))
    return history


def tune_decompose(
    series: DataFrame, keys: Sequence[str], n_trials: int = 20, n_folds: int = 3, granularity: str = "month", seed: int = 42,
    params: dict | None = None, holidays: DataFrame | None = None,
) -> DataFrame:
    """Per series, the trial with the lowest RMSE over ``n_folds`` expanding folds.

    A series goes to its task once and all trials are fitted there; validation never precedes training.
    ``params`` holds for every trial and takes what it names out of the search; ``holidays`` are flags of the
    training and the validation rows. A series too short for a fold keeps ``params`` and the defaults, as
    trial -1 without an RMSE.

    Output: ``keys, trial, changepoint_prior_scale, seasonality_mode, seasonality_prior_scale,
    rmse``."""
    _check_trials(n_trials)
    daily = granularity.lower() in ("day", "daily", "d")
    given = {k: v for k, v in (params or {}).items() if v is not None}
    decompose.settings(given, daily)
    space = {k: v for k, v in SPACE.items() if k not in given}
    src = decompose._source(series, keys, "ds", "y", holidays, None)
    names = decompose.TUNED
    schema = ", ".join([*decompose._key_types(series, keys), "trial int", "changepoint_prior_scale double", "seasonality_mode string", "seasonality_prior_scale double", "rmse double"])

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("ds")
        folds = fold_bounds(len(pdf), n_folds)
        days = pd.to_datetime(pdf["ds"]).values.astype("datetime64[D]").astype(np.int64)
        flags = pdf["is_holiday"].astype(float).to_numpy() if "is_holiday" in pdf else None

        def rmse(t: dict) -> float:
            errors = []
            for start, stop in folds:
                yhat, _, _ = decompose.fit_predict(pdf.iloc[:start], days[start:stop], {**given, **t}, daily, None if flags is None else flags[start:stop])
                errors.append((pdf["y"].to_numpy()[start:stop] - yhat) ** 2)
            return float(np.sqrt(np.concatenate(errors).mean()))

        trials = search(rmse, space, n_trials, seed) if folds else []
        finite = [(loss, i) for i, (_, loss) in enumerate(trials) if np.isfinite(loss)]
        best, at = min(finite, default=(None, -1))
        used = {**decompose.DEFAULTS, **given, **(trials[at][0] if at >= 0 else {})}
        row = {k: pdf[k].iloc[0] for k in keys} | {"trial": at} | {k: used[k] for k in names} | {"rmse": best}
        return pd.DataFrame([row]).astype({"rmse": "float64", **{k: "float64" for k in names if k != "seasonality_mode"}})

    return src.groupBy(*keys).applyInPandas(score, schema)


def fold_bounds(n: int, folds: int) -> list[tuple[int, int]]:
    """W10 on ``n`` sorted periods: (start, stop) of each validation block; it is trained on all that
    comes before it. Fewer folds where the series is short, none where two points cannot precede one."""
    for k in range(min(folds, n - 2), 0, -1):
        size = n // (k + 1)
        if size >= 1 and n - k * size >= 2:
            return [(n - (k - i) * size, n - (k - i - 1) * size) for i in range(k)]
    return []


def tuned_forecast(
    series: DataFrame, keys: Sequence[str], n_trials: int = 20, horizon: int = 24, granularity: str = "month", seed: int = 42,
    params: dict | None = None, holidays: DataFrame | None = None, best: DataFrame | None = None,
) -> DataFrame:
    """M10 end to end: tune per series, then refit each series with its own best parameters (``best``, if the
    search has been run before)."""
    if best is None:
        best = tune_decompose(series, keys, n_trials, granularity=granularity, seed=seed, params=params, holidays=holidays)
    return decompose.forecast(series, keys, horizon, granularity, params, holidays, per_series=best)


#: M11's default grid is the reference role's; a number of trees costs nothing of its own.
GRID = {"maxDepth": [3, 6, 8, 10, 12], "stepSize": [0.01, 0.05, 0.1], "maxIter": [200, 500, 800, 1000], "subsamplingRate": [1.0, 0.8], "l2": [1, 3, 5]}
#: Rows of the training frame that a grid search works on; beyond it, whole series are drawn by hash.
SEARCH_ROWS = 50_000


def grid_search_gbt(series: DataFrame, keys: Sequence[str], grid: dict | None = None, n_folds: int = 3, seed: int = 42, search_rows: int = SEARCH_ROWS) -> DataFrame:
    """Every point of ``grid`` for the global tree model, over ``n_folds`` expanding folds.

    A fold's model is trained on what comes before the rows it is scored on. All numbers of trees of a point
    come from one model, scored after each of them; points and folds run as tasks of their own. The search
    works on the whole training frame up to ``search_rows`` rows (which bounds a task), beyond that on whole
    series drawn by hash. Returns one row per grid point with the mean RMSE of its folds and whether it was
    selected.
    """
    spark = series.sparkSession
    grid = {**{"maxIter": [100], "maxDepth": [6], "stepSize": [0.1], "subsamplingRate": [1.0], "l2": [1.0]}, **(grid or GRID)}
    unknown = set(grid) - set(GRID)
    if unknown:
        raise ValueError(f"unknown grid parameters: {sorted(unknown)}")
    frame = cut_lineage(training_frame(series, keys).select(*keys, "ds", "y", *FEATURES))
    n = frame.count()
    if n > search_rows:
        frame = frame.where(F.pmod(F.xxhash64(*keys), F.lit(1 << 20)) < int(search_rows / n * (1 << 20)))
    folded = expanding_folds(frame, keys, "ds", n_folds).where(F.col("y").isNotNull()).select("fold", "role", "y", *FEATURES)
    stages = sorted(set(grid["maxIter"]))
    names = ("maxDepth", "stepSize", "subsamplingRate", "l2")
    points = [dict(zip(names, p, strict=True)) for p in product(*(grid[k] for k in names))]
    # a task gets a fold and a point: the fold's rows once per point, which search_rows bounds
    numbered = folded.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(len(points) - 1))))

    def score(pdf: pd.DataFrame) -> pd.DataFrame:
        p = points[int(pdf["point"].iloc[0])]
        train, val = pdf[pdf["role"] == "train"], pdf[pdf["role"] == "val"]
        if train.empty or val.empty:
            return pd.DataFrame(columns=["point", "trees", "rmse"])
        own = boosting_params(p)
        model = boosting.fit_arrays(train[FEATURES].to_numpy(float), train["y"].to_numpy(float), FEATURES, trees=stages[-1], seed=seed, **own)
        got = model.staged(model.bins(val[FEATURES].to_numpy(float)), stages)
        rmse = [float(np.sqrt(np.mean((val["y"].to_numpy(float) - g) ** 2))) for g in got]
        return pd.DataFrame({"point": int(pdf["point"].iloc[0]), "trees": stages, "rmse": rmse})

    scored = numbered.groupBy("point", "fold").applyInPandas(score, "point int, trees int, rmse double")
    means = sorted((r["m"], r["point"], r["trees"]) for r in scored.groupBy("point", "trees").agg(F.avg("rmse").alias("m")).collect())
    order = {p: k for k, p in enumerate(product(range(len(points)), stages))}
    rows = [(order[i, t], {**{k: float(v) for k, v in points[i].items()}, "maxIter": float(t)}, m, at == 0) for at, (m, i, t) in enumerate(means)]
    return spark.createDataFrame(sorted(rows, key=lambda r: r[0]), "grid_point int, params map<string,double>, mean_rmse double, selected boolean")


def search_gbt(series: DataFrame, keys: Sequence[str], n_trials: int = 20, parallelism: int = 4, seed: int = 42, space: dict | None = None, train_frac: float = 0.85, engine: str = "xgboost", startup: int = STARTUP) -> DataFrame:
    """M10 for the tree engines: adaptive search over ``engine``'s space, each trial trained on the first
    ``train_frac`` of every series and scored (RMSE) on the rest - a train/validation split by
    time rather than ``TrainValidationSplit``'s random one. ``parallelism`` trials at a time are drawn
    from what is known and submitted from driver threads, as Spark ML's own tuners do.
    ``space`` replaces bounds by name. Returns one row per trial with its validation RMSE and whether it was
    selected."""
    from multiprocessing.pool import ThreadPool

    spark = series.sparkSession
    frame = cut_lineage(chronological_split(training_frame(series, keys), keys, "ds", train_frac))  # every trial reads it
    train, val = frame.where("is_train"), frame.where(~F.col("is_train"))
    _check_trials(n_trials)
    space = {**TREE_SPACES[engine], **{k: (TREE_SPACES[engine][k][0], *bounds) for k, bounds in (space or {}).items()}}
    rng, history = np.random.default_rng(seed), []

    def run(t: dict) -> float:
        model = boosting.fit(train, FEATURES, "y", loss="squared", seed=seed, **boosting_params(t))
        err = boosting.predict(val, model, "__p").agg(F.avg(F.pow(F.col("y") - F.col("__p"), 2)).alias("e")).first()["e"]
        return math.sqrt(err) if err is not None else math.inf

    with ThreadPool(max(1, min(parallelism, n_trials))) as pool:
        while len(history) < n_trials:
            some = [suggest(space, history, rng, startup) for _ in range(min(parallelism, n_trials - len(history)))]
            history += list(zip(some, pool.map(run, some), strict=True))
    best = min(range(n_trials), key=lambda i: history[i][1])
    rows = [(i, {k: float(v) for k, v in t.items()}, loss, i == best) for i, (t, loss) in enumerate(history)]
    return spark.createDataFrame(rows, "trial int, params map<string,double>, val_rmse double, selected boolean")


def random_search_gbt(series: DataFrame, keys: Sequence[str], n_trials: int = 20, **more) -> DataFrame:
    """``search_gbt`` with every trial drawn at random."""
    return search_gbt(series, keys, n_trials, startup=MAX_TRIALS + 1, **more)


# ----------------------------------------------------------------------------- M14
def save_model(spark: SparkSession, model: PipelineModel, family: str, registry_path: str, models_root: str, seq: int) -> str:
    """Save a fitted pipeline and append a registry row (family, seq, path)."""
    path = f"{models_root.rstrip('/')}/{family}-{seq}"
    model.write().overwrite().save(path)
    spark.createDataFrame([(family, seq, path)], "family string, seq long, path string").write.mode("append").parquet(registry_path)
    return path


def registry_view(spark: SparkSession, registry_path: str, keep: int = KEEP_MODELS) -> DataFrame:
    """The newest ``keep`` models per family (older rows are retired)."""
    w = Window.partitionBy("family").orderBy(F.desc("seq"))
    return spark.read.parquet(registry_path).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= keep)


def load_newest(spark: SparkSession, registry_path: str, family: str) -> PipelineModel:
    row = registry_view(spark, registry_path, 1).where(F.col("family") == family).first()
    if row is None:
        raise ValueError(f"no saved model for {family}")
    return PipelineModel.load(row["path"])


# ----------------------------------------------------------------------------- M13
def inverse_rmse_ensemble(forecasts: dict[str, DataFrame], metrics: dict[str, DataFrame], keys: Sequence[str], ds_col: str = "ds") -> DataFrame:
    """Per series, weight each model's forecast by 1 / RMSE (normalised). A model without an RMSE
    for a series gets weight 0 there; models with an RMSE of 0 share the whole weight. Without any
    weight the ensemble is null."""
    names = list(forecasts)
    f = None
    for n in names:
        rmse = F.col("rmse").cast("double")
        part = null_safe_join(
            forecasts[n].select(*keys, ds_col, F.col("yhat").cast("double").alias(f"yhat_{n}")),
            metrics[n].select(*keys, F.coalesce(F.when(rmse >= 0, rmse == 0), F.lit(False)).alias(f"p_{n}"), F.coalesce(F.when(rmse > 0, 1.0 / rmse), F.lit(0.0)).alias(f"w_{n}")),
            keys,
        )
        f = part if f is None else null_safe_join(f, part, [*keys, ds_col])
    # one or more perfect models share the whole weight
    perfect = F.greatest(*[F.col(f"p_{n}") for n in names]) if len(names) > 1 else F.col(f"p_{names[0]}")
    f = f.withColumn("__perfect", perfect)
    for n in names:
        f = f.withColumn(f"w_{n}", F.when(F.col("__perfect"), F.col(f"p_{n}").cast("double")).otherwise(F.col(f"w_{n}")))
    wsum = sum((F.col(f"w_{n}") for n in names[1:]), F.col(f"w_{names[0]}"))
    num = sum((F.col(f"w_{n}") * F.col(f"yhat_{n}") for n in names[1:]), F.col(f"w_{names[0]}") * F.col(f"yhat_{names[0]}"))
    return f.select(*keys, ds_col, F.round(F.try_divide(num, wsum), 2).alias("yhat"), *[F.round(F.try_divide(F.col(f"w_{n}"), wsum), 6).alias(f"weight_{n}") for n in names])
