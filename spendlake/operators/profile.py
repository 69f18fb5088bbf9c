"""Spend profiles: monthly statistics, rankings with "Other", matrices, distributions (A3-A17,
A24-A26, W4, W5, W7, W8, T1-T6, J4, P4).

Every operator aggregates first; windows without a partition key only ever run over the
aggregated calendar (one row per month), never over ledger rows. Rankings use ``orderBy().limit()``
(``TakeOrderedAndProject``: a per-partition top-k merged on the driver, bounded by k), and the top
key set is broadcast with its size bounded by k by construction.
"""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.money import as_double, mean_money, sum_money
from ..sources.tables import MONEY
from .ledger import UNCATEGORIZED
from .quantiles import exact_quantiles, quantile_columns

# Percentiles of the distribution report.
PERCENTILES = (10, 25, 50, 75, 90, 95, 99)


def _month(date_col: str = "date") -> Column:
    return F.trunc(F.col(date_col), "month")


def _quantile(c: Column, q, exact: bool, accuracy: int) -> Column:
    """Single-aggregation quantile(s): Spark's exact ``percentile`` (its buffer is one entry per
    distinct value of the group, merged in one task) or the mergeable GK sketch. The operators
    below default to ``method="distributed"`` (``quantiles.exact_quantiles``), exact with
    bounded memory per task; ``"builtin"`` and ``"approx"`` select these one-pass forms."""
    if exact:
        return F.percentile(c, q)
    return F.percentile_approx(c, q, accuracy)


# ----------------------------------------------------------------------------- A3, A4, A13, A24
def monthly_profile(df: DataFrame, date_col: str = "date", value: str = "spend", method: str = "distributed", accuracy: int = 10000) -> DataFrame:
    """A3: per month count, sum, mean, median, sample std, min, max."""
    v = as_double(value)
    aggs = [
        F.count(value).alias("record_count"),
        sum_money(value).alias("total_spend"),
        mean_money(value).alias("avg_spend"),
        F.round(F.stddev_samp(v), 4).alias("std_spend"),
        F.min(value).cast(MONEY).alias("min_spend"),
        F.max(value).cast(MONEY).alias("max_spend"),
    ]
    m = df.withColumn("month", _month(date_col))
    if method == "distributed":
        med = quantile_columns(m, ["month"], value, [0.5], ["median_spend"]).withColumn("median_spend", F.round("median_spend", 6))
        return m.groupBy("month").agg(*aggs).join(med, "month", "left")
    med = F.round(_quantile(v, 0.5, method == "builtin", accuracy), 6).alias("median_spend")
    return m.groupBy("month").agg(*aggs, med)


def spend_range(df: DataFrame, value: str = "spend") -> DataFrame:
    """A4."""
    return df.agg(F.min(value).cast(MONEY).alias("min_spend"), F.max(value).cast(MONEY).alias("max_spend"))


def mean_ci95(df: DataFrame, date_col: str = "date", value: str = "spend") -> DataFrame:
    """Monthly mean with a 95% normal interval, se = std / sqrt(n), +- 1.96 se."""
    v = as_double(value)
    stats = df.groupBy(_month(date_col).alias("month")).agg(
        mean_money(value).alias("mean_spend"), F.stddev_samp(v).alias("std"), F.count(value).alias("n")
    )
    se = F.col("std") / F.sqrt(F.col("n"))
    ci = F.lit(1.96) * se
    return stats.select(
        "month", "mean_spend", "n",
        F.round("std", 4).alias("std_spend"),
        F.round(se, 4).alias("se"),
        F.round(ci, 4).alias("ci_95"),
        F.round(F.col("mean_spend").cast("double") - ci, 4).alias("lower"),
        F.round(F.col("mean_spend").cast("double") + ci, 4).alias("upper"),
    )


def volume_vs_spend(df: DataFrame, date_col: str = "date", value: str = "spend") -> DataFrame:
    """A24 + W7: monthly record count, total, mean, and a 0-based month index."""
    m = df.groupBy(_month(date_col).alias("month")).agg(
        F.count(value).alias("record_count"), sum_money(value).alias("total_spend"), mean_money(value).alias("avg_spend")
    )
    return m.withColumn("month_index", F.row_number().over(Window.orderBy("month")) - 1)


# ----------------------------------------------------------------------------- W4, W5
def monthly_totals(df: DataFrame, date_col: str = "date", value: str = "spend") -> DataFrame:
    return df.groupBy(_month(date_col).alias("month")).agg(sum_money(value).alias("total_spend"))


def cumulative_spend(df: DataFrame, date_col: str = "date", value: str = "spend") -> DataFrame:
    """Running total over months (window over the aggregated calendar only)."""
    w = Window.orderBy("month").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return monthly_totals(df, date_col, value).withColumn("cumulative_spend", F.sum("total_spend").over(w).cast(MONEY))


def growth_rate(df: DataFrame, date_col: str = "date", value: str = "spend") -> DataFrame:
    """Month-over-month change in percent; the first month (no predecessor) is dropped, and the
    rate after a month with a total of 0 is null."""
    m = monthly_totals(df, date_col, value)
    prev = F.lag("total_spend").over(Window.orderBy("month"))
    out = m.withColumn("prev_total", prev).where(F.col("prev_total").isNotNull())
    rate = (F.try_divide(F.col("total_spend"), F.col("prev_total")) - F.lit(1)) * F.lit(100)
    return out.select("month", "total_spend", F.round(rate.cast("double"), 6).alias("growth_rate"))


# ----------------------------------------------------------------------------- A5-A7, A8, T2, T3
def spend_by(df: DataFrame, dim: str, value: str = "spend") -> DataFrame:
    """Total per dimension value, descending."""
    return df.groupBy(dim).agg(sum_money(value).alias("total_spend")).orderBy(F.desc("total_spend"), F.asc_nulls_last(dim))


def top_k(df: DataFrame, dim: str, k: int, value: str = "spend") -> DataFrame:
    """The k largest totals (ties broken by name) with their 1-based rank."""
    totals = df.groupBy(dim).agg(sum_money(value).alias("total_spend"))
    top = totals.orderBy(F.desc("total_spend"), F.asc_nulls_last(dim)).limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("total_spend"), F.asc_nulls_last(dim))))


def top_n_other(df: DataFrame, dim: str, n: int, value: str = "spend", label: str = "name") -> DataFrame:
    """The first n ranks by total keep their name, the rest are summed into ``Other``.

    Semantics: totals of exactly 0 are dropped but still occupy their rank; ``Other`` is emitted
    only when its sum is > 0; null / empty names read ``Uncategorized``; ties rank by name.

    Plan: the report is n + 1 rows, so it is assembled from two bounded results: the top n totals
    (``TakeOrderedAndProject``: per-partition top-n merged on the driver, never all keys in one
    task) and the grand total (one scalar). ``Other`` = grand total - sum of the top n, exact in
    DECIMAL. Two scans, no window over all keys, no re-aggregation.
    """
    spark = df.sparkSession
    totals = df.groupBy(dim).agg(sum_money(value).alias("total_spend"))
    top = totals.orderBy(F.desc("total_spend"), F.asc_nulls_last(dim)).limit(n).collect()
    grand = df.agg(sum_money(value).alias("g")).first()["g"]
    rows = [
        (r[dim] if r[dim] not in (None, "") else UNCATEGORIZED, r["total_spend"], i)
        for i, r in enumerate(top, start=1)
        if r["total_spend"] != 0
    ]
    if grand is not None:
        other = grand - sum((r["total_spend"] for r in top), Decimal(0))
        if other > 0:
            rows.append(("Other", other, n + 1))
    return spark.createDataFrame(rows, f"{label} string, total_spend decimal(18,2), rank int")


def restrict_to_top(df: DataFrame, dim: str, k: int, value: str = "spend") -> DataFrame:
    """Keep rows whose ``dim`` is among the k largest totals (left-semi on a k-row set)."""
    keys = top_k(df, dim, k, value).select(dim)
    return df.join(F.broadcast(keys), dim, "left_semi")


# ----------------------------------------------------------------------------- A9-A11
def pivot_matrix(
    df: DataFrame,
    row: Column | str,
    col: Column | str,
    values: Sequence | None = None,
    value: str = "spend",
) -> DataFrame:
    """Sum matrix ``row x col`` (pivot), missing cells = 0.

    ``values`` fixes the column set and skips the distinct-value discovery job; otherwise Spark
    discovers it (bounded by ``spark.sql.pivotMaxValues``).
    """
    row_c = F.col(row) if isinstance(row, str) else row
    col_c = F.col(col) if isinstance(col, str) else col
    base = df.select(row_c.alias("__row"), col_c.alias("__col"), F.col(value))
    g = base.groupBy("__row")
    p = (g.pivot("__col", list(values)) if values is not None else g.pivot("__col")).agg(F.sum(value))
    cells = [c for c in p.columns if c != "__row"]
    return p.select(F.col("__row"), *[F.coalesce(F.col(f"`{c}`"), F.lit(0)).cast(MONEY).alias(c) for c in cells])


def service_month_matrix(df: DataFrame, k: int = 10, dim: str = "service_name") -> DataFrame:
    """Top-k services x month (``yyyy-MM``) heatmap, zero-filled over every month of the data.

    The month list is the calendar of the data (bounded by its span), passed to ``pivot`` so the
    matrix keeps months in which no top key spent, as the full matrix does.
    """
    months_col = F.date_format("date", "yyyy-MM")
    months = [r[0] for r in df.select(months_col).distinct().orderBy(1).collect()]
    wide = pivot_matrix(restrict_to_top(df, dim, k), dim, months_col, values=months)
    return wide.withColumnRenamed("__row", dim)


def month_top_services(df: DataFrame, k: int = 5, dim: str = "service_name") -> DataFrame:
    """A10: month x top-k services (stacked area)."""
    names = [r[dim] for r in top_k(df, dim, k).select(dim).collect()]  # k names, bounded
    top = df.join(F.broadcast(df.sparkSession.createDataFrame([(n,) for n in names], f"{dim} string")), dim, "left_semi")
    return pivot_matrix(top, _month(), dim, values=names).withColumnRenamed("__row", "month")


def month_region_matrix(df: DataFrame, dim: str = "region") -> DataFrame:
    """Month x region."""
    return pivot_matrix(df, _month(), dim).withColumnRenamed("__row", "month")


def long_matrix(df: DataFrame, row: Column | str, col: Column | str, value: str = "spend") -> DataFrame:
    """A9-A11 in long form: ``(row, col, spend)``, zero-filled over the rows and columns that occur.

    Any number of columns works: nothing is discovered on the driver. Cells are aggregated first; the
    missing ones come from pairing the distinct rows with the distinct columns, both a report's axes
    (months, and a bounded top list or the regions).
    """
    row_c = F.col(row) if isinstance(row, str) else row
    col_c = F.col(col) if isinstance(col, str) else col
    cells = df.groupBy(row_c.alias("row"), col_c.alias("col")).agg(F.sum(value).alias("spend"))
    axis = cells.agg(F.collect_set("col").alias("cols"), F.collect_set("row").alias("rows"))
    zeros = axis.select(F.explode("rows").alias("row"), "cols").select("row", F.explode("cols").alias("col"), F.lit(0).alias("spend"))
    return cells.unionByName(zeros).groupBy("row", "col").agg(F.sum("spend").cast(MONEY).alias("spend"))


def service_month_cells(df: DataFrame, k: int = 10, dim: str = "service_name") -> DataFrame:
    """A9 in long form: the top-k services x every month of the data."""
    month = F.date_format("date", "yyyy-MM")
    names = top_k(df, dim, k).select(dim)
    # every month counts, also one in which no top service spent
    marked = df.groupBy(dim, month.alias("m")).agg(F.sum("spend").alias("spend"))
    cells = long_matrix(marked.join(F.broadcast(names), dim, "left_semi"), dim, "m")
    months = df.groupBy(month.alias("col")).agg(F.lit(0).cast(MONEY).alias("spend"))
    filled = months.withColumn("row", F.explode(F.array(*[F.lit(r[0]) for r in names.collect()])))  # k names
    return cells.unionByName(filled).groupBy("row", "col").agg(F.sum("spend").cast(MONEY).alias("spend"))


def month_top_service_cells(df: DataFrame, k: int = 5, dim: str = "service_name") -> DataFrame:
    """A10 in long form: month x top-k services."""
    return long_matrix(restrict_to_top(df, dim, k), _month(), dim)


def month_region_cells(df: DataFrame, dim: str = "region") -> DataFrame:
    """A11 in long form: month x region."""
    return long_matrix(df, _month(), dim)


# ----------------------------------------------------------------------------- A12, A14-A16
def spend_percentiles(df: DataFrame, value: str = "spend", pcts: Sequence[int] = PERCENTILES, method: str = "distributed", accuracy: int = 10000) -> DataFrame:
    """Linear-interpolation percentiles (numpy default) as rows (percentile, spend_value)."""
    spark = df.sparkSession
    labels = spark.createDataFrame([(i, p) for i, p in enumerate(pcts)], "qi int, percentile int")
    if method == "distributed":
        q = exact_quantiles(df, [], value, [p / 100.0 for p in pcts])
        return q.join(F.broadcast(labels), "qi").select("percentile", F.round("value", 6).alias("spend_value"))
    qs = F.array(*[F.lit(p / 100.0) for p in pcts])
    arr = df.agg(_quantile(as_double(value), qs, method == "builtin", accuracy).alias("q"))
    lab = F.array(*[F.lit(p) for p in pcts])
    return arr.select(F.explode(F.arrays_zip(lab.alias("percentile"), F.col("q").alias("v"))).alias("z")).select(
        F.col("z.percentile").alias("percentile"), F.round("z.v", 6).alias("spend_value")
    )


def value_bounds(df: DataFrame, value: str = "spend") -> tuple:
    """Two scalars (min, max) to the driver; the only driver traffic of the histogram."""
    r = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi")).first()
    return r["lo"], r["hi"]


def _bin(v: Column, lo, hi, bins: int) -> Column:
    """Equal-width bin 1..bins over [lo, hi]; the maximum falls in the last bin. Decimal arithmetic,
    so a value on a bin edge lands in the same bin on every engine."""
    if hi == lo:
        return F.lit(1)
    width = F.lit(hi).cast("decimal(20,6)") - F.lit(lo).cast("decimal(20,6)")
    raw = F.floor((v.cast("decimal(20,6)") - F.lit(lo).cast("decimal(20,6)")) * F.lit(bins) / width) + F.lit(1)
    return F.least(raw, F.lit(bins)).cast("int")


def spend_histogram(df: DataFrame, value: str = "spend", bins: int = 50) -> DataFrame:
    """Counts in ``bins`` equal-width bins between the global min and max."""
    lo, hi = value_bounds(df, value)
    if lo is None:
        return df.sparkSession.createDataFrame([], "bin int, bin_lo double, bin_hi double, n bigint")
    width = (float(hi) - float(lo)) / bins
    b = df.where(F.col(value).isNotNull()).groupBy(_bin(F.col(value), lo, hi, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return b.select(
        "bin",
        F.round(F.lit(float(lo)) + (F.col("bin") - 1) * F.lit(width), 4).alias("bin_lo"),
        F.round(F.lit(float(lo)) + F.col("bin") * F.lit(width), 4).alias("bin_hi"),
        "n",
    )


def box_stats_monthly(df: DataFrame, date_col: str = "date", value: str = "spend", method: str = "distributed", accuracy: int = 10000) -> DataFrame:
    """Quartiles, 1.5 IQR fences, whiskers and outlier count per month.

    Pass 1 aggregates the quartiles per month; pass 2 joins them back (one row per month, so AQE
    broadcasts it) and counts / bounds in a second aggregation.
    """
    v = as_double(value)
    base = df.select(_month(date_col).alias("month"), v.alias("v"))
    if method == "distributed":
        q = quantile_columns(base, ["month"], "v", [0.25, 0.5, 0.75], ["q1", "median", "q3"])
        q = q.select("month", *[F.round(c, 6).alias(c) for c in ("q1", "median", "q3")])
    else:
        q = base.groupBy("month").agg(_quantile(F.col("v"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), method == "builtin", accuracy).alias("q"))
        q = q.select(
            "month",
            F.round(F.col("q")[0], 6).alias("q1"), F.round(F.col("q")[1], 6).alias("median"), F.round(F.col("q")[2], 6).alias("q3"),
        )
    q = q.withColumn("iqr", F.round(F.col("q3") - F.col("q1"), 6))
    q = q.withColumn("lower_fence", F.round(F.col("q1") - 1.5 * F.col("iqr"), 6)).withColumn(
        "upper_fence", F.round(F.col("q3") + 1.5 * F.col("iqr"), 6)
    )
    j = base.join(q, "month")  # q is one row per month: AQE broadcasts it
    inside = (F.col("v") >= F.col("lower_fence")) & (F.col("v") <= F.col("upper_fence"))
    return j.groupBy("month", "q1", "median", "q3", "iqr", "lower_fence", "upper_fence").agg(
        F.min(F.when(inside, F.col("v"))).alias("whisker_low"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_high"),
        F.count_if(~inside).alias("n_outliers"),
    )


def density_monthly(df: DataFrame, date_col: str = "date", value: str = "spend", bins: int = 20) -> DataFrame:
    """Per month, share of the month's rows in each global equal-width bin (violin outline)."""
    lo, hi = value_bounds(df, value)
    if lo is None:
        return df.sparkSession.createDataFrame([], "month date, bin int, n bigint, density double")
    b = df.where(F.col(value).isNotNull()).groupBy(_month(date_col).alias("month"), _bin(F.col(value), lo, hi, bins).alias("bin")).agg(
        F.count(F.lit(1)).alias("n")
    )
    tot = F.sum("n").over(Window.partitionBy("month"))
    return b.withColumn("density", F.round(F.col("n") / tot, 6))


# ----------------------------------------------------------------------------- A25, A26, P4, T5
def key_counts(df: DataFrame, dims: Sequence[str] = ("account_name", "service_name"), exact: bool = True) -> DataFrame:
    """Row count and distinct count per dimension (HyperLogLog++ when ``exact=False``)."""
    dist = F.countDistinct if exact else F.approx_count_distinct
    return df.agg(F.count(F.lit(1)).alias("rows"), *[dist(d).alias(f"distinct_{d}") for d in dims])


LEVELS = ("overall", "account_name", "service_name", "bu_code", "segment")


def level_grouping_sets(df: DataFrame, granularity_col: Column | None = None, value: str = "spend") -> DataFrame:
    """Spend per period at every forecast level in one pass (GROUPING SETS + grouping_id).

    Output: ``level, level_key (string), month, spend``; ``overall`` has a null key.
    """
    period = granularity_col if granularity_col is not None else _month()
    dims = ["account_name", "service_name", "bu_code", "segment"]
    base = df.select(period.alias("month"), "account_name", "service_name", F.col("bu_code").cast("string").alias("bu_code"), "segment", value)
    # the expansion into five sets works on one row per combination that occurs, not on fact rows
    base = base.groupBy("month", *dims).agg(F.sum(value).alias(value))
    sets = [["month"]] + [["month", d] for d in dims]
    out = base.groupingSets(sets, "month", *dims).agg(
        F.grouping_id().alias("gid"), sum_money(value).alias("spend")
    )
    # grouping_id bits: month 16 (never set), account 8, service 4, bu_code 2, segment 1 (set = aggregated away)
    level = (
        F.when(F.col("gid") == 15, "overall").when(F.col("gid") == 7, "account_name").when(F.col("gid") == 11, "service_name")
        .when(F.col("gid") == 13, "bu_code").otherwise("segment")
    )
    key = F.coalesce(*[F.when(level == F.lit(c), F.col(c)) for c in dims])
    return out.select(level.alias("level"), key.alias("level_key"), "month", "spend")


def cascading_suggestions(df: DataFrame, field: str, query: str | None, active: dict | None = None, limit: int = 10) -> DataFrame:
    """Distinct values of ``field`` under the other active filters, case-insensitive
    substring match, nulls dropped, ordered, first ``limit``."""
    active = active or {}
    out = df
    for k, v in active.items():
        if v and k != field:
            out = out.where(F.col(k) == F.lit(v))
    txt = F.col(field).cast("string")
    if query:
        out = out.where(F.lower(txt).contains(query.lower()))
    return out.select(txt.alias("suggestion")).where(F.col("suggestion").isNotNull()).distinct().orderBy("suggestion").limit(limit)


def last_n(df: DataFrame, n: int, ds_col: str = "ds", keys: Sequence[str] = ()) -> DataFrame:
    """T5: the last n periods of each series (daily chart zoom)."""
    w = Window.partitionBy(*keys).orderBy(F.desc(ds_col))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")
