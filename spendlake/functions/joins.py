"""Equality joins in which a null key matches a null key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left.join(right, keys, how)`` with ``<=>`` on every key: a series with a null label stays one.

    Null-safe equality is an equi-join for the planner (hash or sort-merge). The keys come out once, as
    in a join by name; ``how`` is inner, left, full_outer, left_semi or left_anti.
    """
    keys = list(keys)
    other = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in right.columns if c not in keys], F.lit(True).alias("__r"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__r_{k}")) for k in keys])
    if how in ("left_semi", "left_anti"):
        return left.join(other, same, how)
    if how == "full_outer":
        left = left.withColumn("__l", F.lit(True))
        j = left.join(other, same, how)
        named = [F.when(F.col("__l"), F.col(k)).otherwise(F.col(f"__r_{k}")).alias(k) for k in keys]
        rest = [c for c in [*left.columns, *right.columns] if c not in keys and c != "__l"]
        return j.select(*named, *rest)
    return left.join(other, same, how).drop("__r", *[f"__r_{k}" for k in keys])
