"""Shared SQL text for the DuckDB oracle queries (test artefacts, not used by the Spark plans)."""

from __future__ import annotations

from ..sources.tables import LEDGER_SQL

WITH_LEDGER = "WITH " + LEDGER_SQL.strip()


def with_ledger(body: str) -> str:
    """``WITH ledger AS (...)`` followed by further CTEs (``body`` starts with ``, name AS``) or a SELECT."""
    body = body.strip()
    return WITH_LEDGER + ("\n" if not body.startswith(",") else "") + body


def mean_cents(x: str) -> str:
    """Exact mean of a 2-decimal column rounded half away from zero to cents, as DECIMAL(18,2).

    DuckDB divides decimals in DOUBLE; this keeps the division in integers so it equals Spark's
    DECIMAL ``sum / count``.
    """
    c = f"CAST(SUM({x}) * 100 AS HUGEINT)"
    n = f"COUNT({x})"
    q = f"(SIGN({c}) * ((2 * ABS({c}) + {n}) // (2 * {n})))"
    return f"CAST(CAST({q} AS DECIMAL(18,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


def div_exact(total: str, n: str, scale: int = 4, in_scale: int = 2, precision: int = 18) -> str:
    """``total / n`` for an ``in_scale``-decimal ``total``, rounded half away from zero to
    ``scale`` digits, as DECIMAL(precision, scale), in integer arithmetic (matches Spark's DECIMAL
    division + cast)."""
    c = f"CAST(({total}) * {10 ** in_scale} AS HUGEINT)"
    up = 10 ** (scale - in_scale)
    q = f"(SIGN({c}) * ((2 * ABS({c}) * {up} + ({n})) // (2 * ({n}))))"
    unit = "0." + "0" * (scale - 1) + "1"
    return f"CAST(CAST({q} AS DECIMAL(38,0)) * CAST({unit} AS DECIMAL({scale + 1},{scale})) AS DECIMAL({precision},{scale}))"


def resample_cte(name: str, keys: list[str], trunc: str = "month", step: str = "1 MONTH", source: str = "ledger") -> str:
    """CTE ``name(keys..., ds, y)``: per-key sum by period with every period between the key's
    first and last present (empty = 0)."""
    k = ", ".join(keys)
    kk = ", ".join(f"s.{c}" for c in keys)
    on = " AND ".join([f"s.{c} = a.{c}" for c in keys] + ["s.ds = a.ds"])
    return f"""
, {name}_agg AS (SELECT {k}, CAST(date_trunc('{trunc}', date) AS DATE) AS ds, SUM(spend) AS y FROM {source} GROUP BY ALL)
, {name}_b AS (SELECT {k}, MIN(ds) AS lo, MAX(ds) AS hi FROM {name}_agg GROUP BY ALL)
, {name}_s AS (SELECT {k}, CAST(UNNEST(generate_series(CAST(lo AS TIMESTAMP), CAST(hi AS TIMESTAMP), INTERVAL {step})) AS DATE) AS ds FROM {name}_b)
, {name} AS (SELECT {kk}, s.ds, CAST(COALESCE(a.y, 0) AS DECIMAL(18,2)) AS y FROM {name}_s s LEFT JOIN {name}_agg a ON {on})"""


def _t_sql(ds: str) -> str:
    return f"CAST(year({ds}) * 12 + month({ds}) - 1 - 24000 AS HUGEINT)"


def _pred_sql(t: str) -> str:
    """Exact trend value in cents at ``t`` (integer closed form, half away from zero), DECIMAL."""
    d = "(n * stt - st * st)"
    num = "(n * sty - st * sy)"
    a = f"(CASE WHEN {d} > 0 THEN sy * {d} - {num} * st + {num} * n * {t} ELSE sy END)"
    b = f"(CASE WHEN {d} > 0 THEN n * {d} ELSE n END)"
    q = f"((CASE WHEN {a} >= 0 THEN 2 * {a} + {b} ELSE 2 * {a} - {b} END) // (2 * {b}))"
    return f"CAST(CAST({q} AS DECIMAL(38,0)) * CAST(0.01 AS DECIMAL(3,2)) AS DECIMAL(18,2))"


def ols_sql(name: str, src: str, keys: list[str], horizon: int) -> str:
    """CTEs ``{name}_fit`` (sufficient statistics) and ``{name}(keys, ds, yhat DOUBLE)``: the
    exact monthly trend forecast for ``horizon`` months after each key's last month."""
    k = ", ".join(keys)
    t = _t_sql("ds")
    fut = "CAST(last_ds + INTERVAL (h) MONTH AS DATE)"
    return f"""
, {name}_fit AS (SELECT {k}, CAST(COUNT(*) AS HUGEINT) AS n, SUM({t}) AS st, SUM({t} * {t}) AS stt,
                 SUM(CAST(y * 100 AS HUGEINT)) AS sy, SUM({t} * CAST(y * 100 AS HUGEINT)) AS sty, MAX(ds) AS last_ds
          FROM {src} GROUP BY ALL)
, {name} AS (SELECT {k}, {fut} AS ds, CAST({_pred_sql(_t_sql(fut))} AS DOUBLE) AS yhat
          FROM {name}_fit, (SELECT UNNEST(range(1, {horizon + 1})) AS h))"""


def ols_fitted_sql(name: str, src: str, keys: list[str]) -> str:
    """CTE ``{name}(keys, ds, y, p)``: in-sample exact trend values (needs ``{name}_fit``-style
    statistics, computed here as ``{name}_f``)."""
    k = ", ".join(keys)
    t = _t_sql("ds")
    on = " AND ".join(f"s.{c} = f.{c}" for c in keys)
    return f"""
, {name}_f AS (SELECT {k}, CAST(COUNT(*) AS HUGEINT) AS n, SUM({t}) AS st, SUM({t} * {t}) AS stt,
                 SUM(CAST(y * 100 AS HUGEINT)) AS sy, SUM({t} * CAST(y * 100 AS HUGEINT)) AS sty FROM {src} GROUP BY ALL)
, {name} AS (SELECT {", ".join("s." + c for c in keys)}, s.ds, s.y, {_pred_sql(_t_sql("s.ds"))} AS p
          FROM {src} s JOIN {name}_f f ON {on})"""
