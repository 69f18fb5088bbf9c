"""Ledger operators: canonical columns, coercion, squash, upsert, append, reconcile.

All of these are plain DataFrame plans; none materialises rows on the driver.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import parse_date_any
from ..functions.sizing import bounded_broadcast
from ..sources.tables import MONEY, RAW_MONEY

# Header aliases, canonical name -> accepted names, first present wins.
COLUMN_ALIASES: dict[str, list[str]] = {
    "accountName": ["accountName", "vendor_name", "vendor_account_name", "account"],
    "spend": ["spend", "cost", "public_on_demand", "public_on_demand_cost", "total_amortized_cost"],
    "serviceName": ["serviceName", "enhanced_service_name", "service"],
    "date": ["date", "month", "year_month", "Date", "Month"],
    "buCode": ["buCode", "business_unit", "bu_code"],
    "segment": ["segment", "segment_name"],
}

# Labels for missing dimension values.
UNALLOCATED = "Unallocated"  # ingest
UNCATEGORIZED = "Uncategorized"  # charts (also for empty strings)
UNKNOWN = "Unknown"  # tree-model categoricals
DEFAULT_LEVEL = "default"  # future rows of the legacy scorer

LEDGER_KEY = ("date", "service_name", "account_name")


# ----------------------------------------------------------------------------- S1 / S2
def strip_header(df: DataFrame) -> DataFrame:
    """Header names with surrounding blanks are trimmed."""
    return df.toDF(*[c.strip() for c in df.columns])


def map_aliases(columns: Sequence[str], aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES) -> dict[str, str]:
    """S2 tier 1, plan-time: canonical -> the first alias (in list order) present, case-sensitive."""
    present = set(columns)
    out: dict[str, str] = {}
    for canonical, names in aliases.items():
        hit = next((n for n in names if n in present), None)
        if hit is not None:
            out[canonical] = hit
    return out


def canonicalise(df: DataFrame, aliases: Mapping[str, Sequence[str]] = COLUMN_ALIASES) -> DataFrame:
    """Rename the winning alias of every canonical column; other columns pass through.

    Renaming is positional (``toDF``): Spark resolves names case-insensitively, so a losing
    alias that differs from a canonical name only by case (``Date`` next to ``date``) is kept
    as ``raw_<name>`` instead of colliding with it.
    """
    mapping = map_aliases(df.columns, aliases)
    winners = {actual: canonical for canonical, actual in mapping.items()}
    taken = {c.lower() for c in mapping}
    names = []
    for c in df.columns:
        if c in winners:
            names.append(winners[c])
        elif c.lower() in taken:
            names.append(f"raw_{c}")
        else:
            names.append(c)
    return df.toDF(*names)


def add_synthetic_day(df: DataFrame, month_cols: Sequence[str] = ("month", "year_month", "Month"), key_cols: Sequence[str] = (), seed: int = 42) -> DataFrame:
    """A valid day inside the row's month as ``MM/dd/yyyy`` text, placed right after the
    month column; null when the month does not parse. The day is a seeded hash of the row's key (the
    first 28 bits of an md5, modulo the days in the month), so reruns and recomputed partitions agree."""
    mcol = next((c for c in month_cols if c in df.columns), None)
    if mcol is None:
        raise ValueError(f"no month column among {df.columns}")
    start = F.trunc(parse_date_any(F.col(mcol)), "month")
    text = F.concat_ws("|", F.lit(seed), *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in (mcol, *key_cols)])
    number = F.conv(F.substring(F.md5(text.cast("binary")), 1, 7), 16, 10).cast("long")
    offset = F.pmod(number, F.dayofmonth(F.last_day(start)))
    day = F.date_format(F.date_add(start, offset.cast("int")), "MM/dd/yyyy")
    cols = []
    for c in df.columns:
        if c == "date":
            continue
        cols.append(F.col(c))
        if c == mcol:
            cols.append(day.alias("date"))
    return df.select(*cols)


# ----------------------------------------------------------------------------- P5 - P8, P11
def null_label(c: Column | str, label: str = UNALLOCATED, blank_is_null: bool = False) -> Column:
    """P5: null (and optionally empty string) -> a label."""
    c = F.col(c) if isinstance(c, str) else c
    if blank_is_null:
        c = F.nullif(c, F.lit(""))
    return F.coalesce(c, F.lit(label))


def coerce_spend(c: Column | str) -> Column:
    """Unparseable spend -> 0, kept as a raw decimal with sub-cent digits."""
    c = F.col(c) if isinstance(c, str) else c
    return F.coalesce(F.trim(c.cast("string")).try_cast(RAW_MONEY), F.lit(0).cast(RAW_MONEY))


def normalise_raw(df: DataFrame, bad_dates: str = "raise") -> DataFrame:
    """P5-P8 + P11 on a canonicalised raw frame.

    * time column: first of date / month / Month / ds becomes ``date``; parsed from ISO day,
      ``yyyy-MM``, ``MM/dd/yyyy`` or a timestamp; rows without a date are dropped (P7). A date that is
      there but does not parse fails the job (``bad_dates="raise"``) or drops the row (``"drop"``, for
      callers that divert such rows with ``bad_date_rows`` first)
    * spend: unparseable -> 0 (P6)
    * serviceName / accountName: null or missing -> ``Unallocated`` (P5)
    * buCode / segment carried only when present (P11); ``estimate`` dropped (P8)
    """
    time_col = next((c for c in ("date", "month", "Month", "ds") if c in df.columns), None)
    if time_col is None:
        raise ValueError(f"no time column among {df.columns}")
    if "spend" not in df.columns:
        raise ValueError(f"no spend column among {df.columns}")
    out = df.drop("estimate")
    if time_col != "date":
        out = out.withColumnRenamed(time_col, "date")
    cols = {
        "date": _checked_date(out, "date", bad_dates),
        "spend": coerce_spend("spend"),
        "service_name": null_label(F.col("serviceName")) if "serviceName" in df.columns else F.lit(UNALLOCATED),
        "account_name": null_label(F.col("accountName")) if "accountName" in df.columns else F.lit(UNALLOCATED),
    }
    if "buCode" in df.columns:
        # a code that went through a float column reads 7.0; one with a real fraction is no code
        code = F.trim(F.col("buCode").cast("string")).try_cast("decimal(20,6)")
        cols["bu_code"] = F.when(code == F.floor(code), code).try_cast("int")
    if "segment" in df.columns:
        cols["segment"] = F.col("segment").cast("string")
    keep = [c for c in out.columns if c not in {"date", "spend", "serviceName", "accountName", "buCode", "segment"}]
    if bad_dates == "raise":
        # every other date parses or fails the job, so the test need not parse it a second time
        out = out.where(F.trim(F.col("date").cast("string")) != "")
        return out.select(*[e.alias(k) for k, e in cols.items()], *keep)
    return out.select(*[e.alias(k) for k, e in cols.items()], *keep).where(F.col("date").isNotNull())


def _checked_date(df: DataFrame, name: str, bad_dates: str) -> Column:
    if bad_dates not in ("raise", "drop"):
        raise ValueError(f"bad_dates is raise or drop, not {bad_dates}")
    raw = F.col(name)
    parsed = parse_date_any(raw, dict(df.dtypes)[name])
    if bad_dates == "drop":
        return parsed
    text = F.trim(raw.cast("string"))
    message = F.concat(F.lit("date does not parse: "), text)
    return F.when(parsed.isNull() & (text != ""), F.raise_error(message).cast("date")).otherwise(parsed)


def bad_date_rows(df: DataFrame, date_col: str = "date") -> DataFrame:
    """The raw rows whose date is there but does not parse, to be kept aside."""
    text = F.trim(F.col(date_col).cast("string"))
    return df.where((text != "") & parse_date_any(F.col(date_col), dict(df.dtypes)[date_col]).isNull())


def quality_report(df: DataFrame, date_col: str = "date", spend_col: str = "spend") -> DataFrame:
    """S4 re-aimed: one pass that counts rows breaking each ingest rule (no per-rule jobs)."""
    raw_spend = F.col(spend_col).cast("string")
    parsed = raw_spend.try_cast(RAW_MONEY)
    return df.agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(F.col(date_col).isNull()).alias("null_date"),
        F.count_if(F.col(date_col).isNotNull() & parse_date_any(F.col(date_col)).isNull()).alias("bad_date"),
        F.count_if(F.col(spend_col).isNull()).alias("null_spend"),
        F.count_if(F.col(spend_col).isNotNull() & parsed.isNull()).alias("bad_spend"),
        F.count_if(parsed < 0).alias("negative_spend"),
    )


# ----------------------------------------------------------------------------- A1
def squash(
    df: DataFrame,
    keys: Sequence[str] = LEDGER_KEY,
    value: str = "spend",
    first_cols: Iterable[str] = ("bu_code", "segment"),
    order_col: str | None = None,
) -> DataFrame:
    """A1: one row per key; values summed, first non-null of ``first_cols`` in input order.

    Input order is ``order_col`` when given, else ``monotonically_increasing_id()`` taken at the
    operator's input (file order for a file scan). ``min_by`` over a null-masked ordering is the
    deterministic "first non-null", and unlike ``first()`` it combines map-side, so a hot key is
    reduced to one row per input partition before the shuffle. The sum stays DECIMAL with six
    digits and is rounded to cents only after summing (rounding per row would lose money).
    """
    first_cols = [c for c in first_cols if c in df.columns]
    seq = F.col(order_col) if order_col else F.monotonically_increasing_id()
    base = df.withColumn("__seq", seq) if first_cols else df
    aggs = [F.sum(F.col(value).cast(RAW_MONEY)).cast(MONEY).alias(value)]
    for c in first_cols:
        aggs.append(F.min_by(F.col(c), F.when(F.col(c).isNotNull(), F.col("__seq"))).alias(c))
    return base.groupBy(*keys).agg(*aggs)


# ----------------------------------------------------------------------------- J2
def upsert(
    existing: DataFrame,
    updates: DataFrame,
    keys: Sequence[str] = LEDGER_KEY,
    value: str = "spend",
    refresh: Sequence[str] = (),
    partition_col: str | None = "date",
    max_touched: int = 1_000_000,
) -> DataFrame:
    """Merge ``updates`` into ``existing`` on ``keys``.

    Matched keys take the new ``value`` (replace, not add) and keep their other columns unless
    listed in ``refresh``; unmatched updates are inserted; untouched rows pass through. Applying the
    same updates twice gives the same table. Both sides are squashed to one row per key by the
    caller (A1).

    A resync touches few values of ``partition_col`` (days): existing rows on other days pass
    through without a shuffle (anti-join against the touched days, broadcast after a row-count
    proof), and only rows on touched days enter the shuffled full outer join with the batch.
    """
    if partition_col is not None and partition_col in keys:
        touched = updates.select(partition_col).distinct()
        days = bounded_broadcast(touched, max_touched)
        if days is not touched:  # proven small: split the table
            untouched = existing.join(days, partition_col, "left_anti")
            hot = existing.join(days, partition_col, "left_semi")
            return untouched.unionByName(upsert(hot, updates, keys, value, refresh, None))
    other = [c for c in existing.columns if c not in keys and c != value]
    carried = [c for c in other if c in updates.columns]
    old = existing.withColumn("__old", F.lit(True))
    new = updates.select(
        *keys,
        F.col(value).alias("__new"),
        *[F.col(c).alias(f"__new_{c}") for c in carried],
        F.lit(True).alias("__hit"),
    )
    j = old.join(new, list(keys), "full_outer")
    hit = F.col("__hit").isNotNull()
    was = F.col("__old").isNotNull()
    cols = [F.col(k) for k in keys]
    cols.append(F.when(hit, F.col("__new")).otherwise(F.col(value)).cast(existing.schema[value].dataType).alias(value))
    for c in other:
        if c not in carried:
            cols.append(F.col(c))
        elif c in refresh:
            cols.append(F.when(hit, F.col(f"__new_{c}")).otherwise(F.col(c)).alias(c))
        else:  # matched rows keep the stored value; inserts carry theirs
            cols.append(F.when(was, F.col(c)).otherwise(F.col(f"__new_{c}")).alias(c))
    return j.select(*cols).select(*existing.columns)


# ----------------------------------------------------------------------------- U3 / U4
def append(ledger: DataFrame, records: DataFrame) -> DataFrame:
    """Union by name; missing columns become null."""
    return ledger.unionByName(records, allowMissingColumns=True)


def reconcile(left: DataFrame, right: DataFrame) -> DataFrame:
    """U3 re-aimed at rows: multiset difference both ways, tagged with the side it came from.

    One union with +1 / -1 and one grouped sum: each side is evaluated once.
    """
    cols = [c for c in left.columns if c in right.columns]
    both = left.select(*cols, F.lit(1).alias("__n")).unionByName(right.select(*cols, F.lit(-1).alias("__n")))
    surplus = both.groupBy(*cols).agg(F.sum("__n").alias("__n")).where("__n <> 0")
    side = F.when(F.col("__n") > 0, "left_only").otherwise("right_only")
    times = F.explode(F.sequence(F.lit(1).cast("long"), F.abs("__n")))
    return surplus.select(*cols, side.alias("side"), times.alias("__i")).drop("__i")


def dimension_filter(df: DataFrame, **filters) -> DataFrame:
    """Conjunctive equality on the filters that are not None.

    Keyword names follow the request: ``segment_name`` maps to the ``segment`` column.
    """
    rename = {"segment_name": "segment"}
    conds = [F.col(rename.get(k, k)) == F.lit(v) for k, v in filters.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, conds)) if conds else df


def result_filter(df: DataFrame, filters: Mapping[str, object]) -> DataFrame:
    """Filters on columns the frame does not have are skipped; NaN doubles become null."""
    conds = [F.col(k) == F.lit(v) for k, v in filters.items() if v is not None and k in df.columns]
    out = df.where(reduce(lambda a, b: a & b, conds)) if conds else df
    fixes = {f.name: F.nanvl(F.col(f.name), F.lit(None).cast("double")) for f in out.schema.fields if f.dataType.typeName() in ("double", "float")}
    return out.withColumns(fixes) if fixes else out
