"""Size guards for broadcasts.

A side is broadcast only after proving it has at most ``max_rows`` rows. The proof is a
``limit(max_rows + 1).count()``, which stops reading as soon as the bound is exceeded, so the check
costs at most ``max_rows + 1`` rows per task no matter how large the side is. Beyond the bound the
frame is returned unhinted and Catalyst / AQE choose a shuffle join from runtime statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_MAX_BROADCAST_ROWS = 200_000
#: A broadcast side's rows times their width by schema stay below this; executors hold it beside their work.
MAX_BROADCAST_BYTES = 64 << 20


def rows_within_bytes(df: DataFrame, max_rows: int) -> int:
    """``max_rows``, or fewer where rows of this schema would pass MAX_BROADCAST_BYTES.

    A row's width is twice its types' default size, so that strings count 40 bytes.
    """
    return min(max_rows, MAX_BROADCAST_BYTES // max(1, 2 * df._jdf.schema().defaultSize()))


def has_at_most(df: DataFrame, max_rows: int) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def bounded_broadcast(df: DataFrame, max_rows: int = DEFAULT_MAX_BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` only if it provably fits in ``max_rows`` rows and MAX_BROADCAST_BYTES; otherwise
    leave it to AQE."""
    if has_at_most(df, rows_within_bytes(df, max_rows)):
        return F.broadcast(df)
    return df


def require_at_most(df: DataFrame, max_rows: int, what: str) -> None:
    """Fail loudly when a side that must be small (anchors, trial tables) is not."""
    if not has_at_most(df, max_rows):
        raise ValueError(f"{what} has more than {max_rows} rows; refusing to ship it to every task")
