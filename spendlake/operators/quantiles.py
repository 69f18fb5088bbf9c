"""Exact quantiles without putting a group in one task (A3 median, A12, A15).

Spark's exact ``percentile`` merges, per group, a map of every distinct value into one task; for a
month of a 100 TB ledger that map is unbounded. This is an exact distributed selection instead:

1. every value gets a fixed, data-independent bucket b0 = floor(256 * log2|v|) (sign-aware, so
   the bucket order is the value order) and a sub-bucket b1 (the fractional part split B ways);
   a histogram of (group, b0) gives n per group and, for each target rank, the bucket holding
   it (a window over the group's occupied buckets: a few thousand for money spanning cents to
   billions, however many rows);
2. a histogram of (group, b0, b1), restricted to the target buckets (left-semi join on a set of
   at most groups x targets rows), finds the sub-bucket;
3. the distinct values of the target cells with their counts (a hot value collapses map-side to
   one row) give the exact value at the rank.

The linear interpolation between the two ranks around q * (n - 1) is numpy's / SQL
``percentile_cont``. Three passes over the values, no join with per-group statistics, no task
holds more than one group's occupied buckets or one cell's distinct values, nothing goes through
the driver.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096  # sub-buckets per log bucket


LOG_STEPS = 256  # buckets per doubling of |v| (relative width ~0.27%)
SIGN_OFFSET = 1_000_000  # separates negative, zero and positive bucket ranges


def _buckets(v: Column, b: int) -> tuple[Column, Column]:
    """(b0, b1), both non-decreasing in v: log-scale bucket and linear split of its fraction."""
    x = F.log2(F.abs(v)) * F.lit(float(LOG_STEPS))
    k = F.floor(x)
    frac = F.least(F.greatest(F.floor((x - k) * F.lit(float(b))), F.lit(0)), F.lit(b - 1))
    b0 = F.when(v > 0, k + F.lit(SIGN_OFFSET)).when(v < 0, -(k + F.lit(SIGN_OFFSET))).otherwise(F.lit(0))
    b1 = F.when(v > 0, frac).when(v < 0, F.lit(b - 1) - frac).otherwise(F.lit(0))
    return b0.cast("long"), b1.cast("int")


def _locate(hist: DataFrame, targets: DataFrame, cell: list[str], key: str, rank: str) -> DataFrame:
    """For each target, the ``key`` value of ``hist`` (ordered within ``cell``) whose cumulative
    count range holds ``rank``; returns the target with ``key`` and the rank left inside it."""
    w = Window.partitionBy(*cell).orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    h = hist.withColumn("__before", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
    j = targets.join(h, cell)
    hit = (F.col(rank) >= F.col("__before")) & (F.col(rank) < F.col("__before") + F.col("cnt"))
    return j.where(hit).withColumn(rank, F.col(rank) - F.col("__before")).drop("__before", "cnt")


def exact_quantiles(df: DataFrame, groups: Sequence[str], value: str | Column, qs: Sequence[float], buckets: int = BUCKETS) -> DataFrame:
    """Exact linear-interpolated quantiles per group: ``groups..., qi (index into qs), value``."""
    g = list(groups) or ["__all"]
    v = F.col(value) if isinstance(value, str) else value
    base = df.select(*[F.col(c) for c in groups], v.cast("double").alias("v"))
    if not groups:
        base = base.withColumn("__all", F.lit(0))
    base = base.where(F.col("v").isNotNull() & ~F.isnan("v"))
    b0, b1 = _buckets(F.col("v"), buckets)
    rows = base.select(*g, "v", b0.alias("b0"), b1.alias("b1"))

    h0 = rows.groupBy(*g, "b0").agg(F.count(F.lit(1)).alias("cnt"))
    stats = h0.groupBy(*g).agg(F.sum("cnt").alias("n"))
    tq = stats.select(*g, "n", F.posexplode(F.array(*[F.lit(float(q)) for q in qs])).alias("qi", "q"))
    pos = F.col("q") * (F.col("n") - 1)
    tq = tq.withColumn("pos", pos).withColumn("k0", F.floor("pos")).withColumn("k1", F.ceil("pos"))
    targets = tq.select(
        *g, "qi", (F.col("pos") - F.col("k0")).alias("frac"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("k0").alias("rank")), F.struct(F.lit(1).alias("which"), F.col("k1").alias("rank")))).alias("t"),
    ).select(*g, "qi", "frac", "t.which", "t.rank")
    t0 = _locate(h0, targets, g, "b0", "rank")

    cells0 = t0.select(*g, "b0").distinct()
    r1 = rows.join(cells0, [*g, "b0"], "left_semi")
    h1 = r1.groupBy(*g, "b0", "b1").agg(F.count(F.lit(1)).alias("cnt"))
    t1 = _locate(h1, t0, [*g, "b0"], "b1", "rank")

    cells1 = t1.select(*g, "b0", "b1").distinct()
    r2 = r1.join(cells1, [*g, "b0", "b1"], "left_semi")
    h2 = r2.groupBy(*g, "b0", "b1", "v").agg(F.count(F.lit(1)).alias("cnt"))
    t2 = _locate(h2, t1, [*g, "b0", "b1"], "v", "rank")

    lo_v = F.max(F.when(F.col("which") == 0, F.col("v")))
    hi_v = F.max(F.when(F.col("which") == 1, F.col("v")))
    out = t2.groupBy(*g, "qi").agg(F.first("frac").alias("frac"), lo_v.alias("v0"), hi_v.alias("v1"))
    val = F.when(F.col("frac") == 0, F.col("v0")).otherwise(F.col("v0") + (F.col("v1") - F.col("v0")) * F.col("frac"))
    res = out.select(*g, "qi", val.alias("value"))
    return res.drop("__all") if not groups else res


def quantile_columns(df: DataFrame, groups: Sequence[str], value: str | Column, qs: Sequence[float], names: Sequence[str], buckets: int = BUCKETS) -> DataFrame:
    """``exact_quantiles`` pivoted to one column per quantile (one row per group)."""
    long = exact_quantiles(df, groups, value, qs, buckets)
    aggs = [F.max(F.when(F.col("qi") == i, F.col("value"))).alias(n) for i, n in enumerate(names)]
    if groups:
        return long.groupBy(*groups).agg(*aggs)
    return long.agg(*aggs)
