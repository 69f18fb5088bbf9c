"""Quality classifier by positive-unlabelled learning (operator 10).

Trusted positives and unlabelled text are enough to estimate the risk of a classifier without one
negative label: with class prior p and logistic loss l, the negatives' part of the risk is
E_U[l(-f)] - p E_P[l(-f)], which cannot be negative for the true distributions (Kiryo et al., 2017). The
fit minimises p E_P[l(f)] + max(0, that part) over a linear f of dense text features; all sums run over
all rows in Spark, the driver holds d-sized vectors only. The prior is estimated from the same data: the
least ratio, over score thresholds, of the unlabelled to the positive share above the threshold.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices, sum_vectors

#: Byte classes: lower, upper, digit, blank, sentence punctuation, exclamation, symbol, other ASCII, non-ASCII.
CLASSES = np.full(256, 8)
CLASSES[:128] = 7
for _k, _chars in enumerate(
    [range(97, 123), range(65, 91), range(48, 58), b" \t\n\x0b\x0c\r", b".,;:'\"-()?", b"!", b"#*$%&|<>=+~^@\\/_{}[]`"]
):
    CLASSES[list(_chars)] = _k
#: Rates at which a share saturates: tanh(share * k), for the nine classes.
SCALES = np.array([1, 4, 10, 2, 10, 30, 30, 10, 2])
N_FEATURES = len(SCALES) + 8


def features(text: str | None) -> np.ndarray:
    """Dense features of the whole text; null counts as empty."""
    out = np.zeros(N_FEATURES)
    raw = (text or "").encode()
    n = max(1, len(raw))
    k = len(SCALES)
    out[:k] = np.tanh(np.bincount(CLASSES[np.frombuffer(raw, np.uint8)], minlength=k) / n * SCALES)
    words = (text or "").split()
    w = max(1, len(words))
    lines = [x for x in (text or "").split("\n") if x.strip()]
    out[k] = np.log1p(len(words)) / 10
    out[k + 1] = len(set(words)) / w
    out[k + 2] = max(0, len(words) - 1 - len(set(zip(words, words[1:], strict=False)))) / w
    out[k + 3] = np.tanh(3 * out[k + 2])
    out[k + 4] = 1 - len(set(lines)) / max(1, len(lines))
    out[k + 5] = np.tanh(sum(map(len, words)) / w / 10)
    out[k + 6] = np.tanh(len(words) / 20)
    out[k + 7] = 1.0 if words else 0.0
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def feature_rows(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``x`` binary: the features as doubles. No shuffle."""
    keep = [c for c in docs.columns if c not in (text_col, "x")]
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            x = [features(t).tobytes() for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(x, pa.binary())], names=[*keep, "x"])

    return docs.mapInArrow(run, f"{fields}, x binary" if keep else "x binary")


def matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist())).reshape(-1, N_FEATURES)


def sums(rows: DataFrame, of, size: int) -> np.ndarray:
    """Sum of ``of(x, positive)``, a vector of ``size`` doubles, over all rows (x, positive)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros(size)
        for b in batches:
            for s in slices(iter([b]), 8192):
                total += of(matrix(s.column("x")), s.column("positive").to_numpy(zero_copy_only=False).astype(bool))
        part = TaskContext.get().partitionId() % 32
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "vec"])

    per_task = rows.select("x", "positive").mapInArrow(run, "part int, vec binary")
    out = np.zeros(size)
    for r in sum_vectors(per_task, ["part"]).collect():
        out += np.frombuffer(r["vec"])
    return out


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


def _risk_sums(mean, scale, w, bias):
    """Per row: counts, both risks' sums, gradients and the curvature of the unlabelled part."""

    def of(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        z = np.c_[(x - mean) / scale, np.ones(len(x))]
        f = z @ np.append(w, bias)
        s = 1 / (1 + np.exp(-np.clip(f, -500, 500)))
        p = positive
        hess = z.T @ (z * (s * (1 - s))[:, None])
        return np.concatenate([
            [len(x), p.sum(), _softplus(f).sum(), _softplus(f[p]).sum(), _softplus(-f[p]).sum()],
            (z * s[:, None]).sum(0), (z[p] * s[p, None]).sum(0), z[p].sum(0), hess.ravel(),
        ])

    d = len(w) + 1
    return of, 5 + 3 * d + d * d


def estimate_prior(rows: DataFrame, model: Model, bins: int = 1000, least: float = 0.2) -> float:
    """Least ratio of the unlabelled to the positive share above a score, where at least ``least`` of the positives are."""

    def of(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
        at = np.minimum((model.scores(x) * bins).astype(int), bins - 1)
        return np.r_[np.bincount(at, minlength=bins), np.bincount(at[positive], minlength=bins)].astype(float)

    got = sums(rows, of, 2 * bins)
    above = lambda v: v[::-1].cumsum()[::-1] / v.sum()
    u, p = above(got[:bins]), above(got[bins:])
    ok = p >= least
    return float(min(1.0, (u[ok] / p[ok]).min()))


def fit(rows: DataFrame, prior: float | None = None, ridge: float = 1e-3, steps: int = 10, rounds: int = 2) -> Model:
    """Fit on rows ``(x, positive)``: all of them are unlabelled text, those marked are trusted positives.

    Without ``prior`` it starts at the marked share and is estimated again after each of ``rounds``
    fits. Rows are never sampled. With no rows or no positives every score is the constant 0.
    """
    d = N_FEATURES
    stats = sums(rows, lambda x, p: np.r_[len(x), p.sum(), x.sum(0), (x * x).sum(0)], 2 + 2 * d)
    n, n_pos = stats[0], stats[1]
    if not n or not n_pos:
        return Model(np.zeros(d), np.ones(d), np.zeros(d), -500.0, 0.0)
    mean = stats[2 : 2 + d] / n
    scale = np.sqrt(np.maximum(stats[2 + d :] / n - mean**2, 0))
    scale[scale < 1e-9] = 1.0
    known = prior is not None
    prior = prior if known else n_pos / n
    model = Model(mean, scale, np.zeros(d), 0.0, prior)
    for _ in range(rounds if not known else 1):
        # the first fit with the marked share as prior tells marked from unmarked text
        model = _minimise(rows, mean, scale, prior, ridge, steps)
        if not known:
            prior = max(estimate_prior(rows, model), n_pos / n)
    return _minimise(rows, mean, scale, prior, ridge, steps) if not known else model


def _minimise(rows: DataFrame, mean, scale, prior: float, ridge: float, steps: int) -> Model:
    """Newton steps on the risk; where its negatives' part is below zero, ascent of that part instead."""
    d = N_FEATURES + 1
    v, best = np.zeros(d), (np.inf, np.zeros(d))
    for _ in range(steps):
        of, size = _risk_sums(mean, scale, v[:-1], v[-1])
        s = sums(rows, of, size)
        n, n_pos, u_neg, p_neg, p_pos = s[:5]
        gu, gp, zp = s[5 : 5 + d] / n, s[5 + d : 5 + 2 * d] / n_pos, s[5 + 2 * d : 5 + 3 * d] / n_pos
        hess = s[5 + 3 * d :].reshape(d, d) / n + ridge * np.eye(d)
        negative = u_neg / n - prior * p_neg / n_pos
        risk = prior * p_pos / n_pos + max(0.0, negative) + ridge / 2 * v @ v
        if risk < best[0] - 1e-7:
            best = (risk, v)
        elif risk < np.inf and np.isfinite(best[0]) and risk >= best[0] + 1.0:
            v = (v + best[1]) / 2  # the step was too long
            continue
        if negative >= 0:
            # l(f) - l(-f) = -f, so the whole gradient is gu - prior * zp
            step = np.linalg.solve(hess, gu - prior * zp + ridge * v)
            if np.abs(step).max() < 1e-4:
                break
            v = v - step * min(1.0, 5.0 / np.abs(step).max())
        else:
            v = v + np.linalg.solve(hess, gu - prior * gp) * 0.5
    v = best[1]
    return Model(mean, scale, v[:-1], float(v[-1]), prior)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[Model, DataFrame]:
    """Model of ``docs``, and their features ``(id_col, other columns, x)`` written once.

    ``labels`` is ``(id_col, quality)``; a document is a trusted positive if any of its rows has quality
    1. Other labels and null ones are not used: every row of ``docs`` with a true ``learn`` column is
    unlabelled text. Documents need not have a label; a null id never has one.
    """
    rows = materialise(feature_rows(docs, text_col), "features")
    trusted = labels.where(F.col("quality") == 1).select(F.col(id_col).alias("pid")).where("pid is not null").distinct()
    used = rows.where("learn").join(trusted, F.col(id_col) == F.col("pid"), "left")
    used = materialise(used.select("x", F.col("pid").isNotNull().alias("positive")), "pu-rows")
    return fit(used), rows


def score(rows: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """``rows`` without ``x``, plus ``score`` double in 0..1 and ``predicted`` int. No shuffle."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c not in ("x", "score", "predicted")]
    fields = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 8192):
            s = shared.value.scores(matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                names=[*keep, "score", "predicted"],
            )

    return rows.mapInArrow(run, f"{fields}, score double, predicted int")
