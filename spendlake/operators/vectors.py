"""Nearest-anchor vector matching.

Every vector is scored against a small set of anchor vectors by cosine similarity; the best anchor
wins when its score reaches the threshold. Anchors are few (the targets of a mapping), so they are
proven small (row-count check), collected once and embedded in the plan as a literal array; each
row then scores all anchors with higher-order array functions. No join, no cross product of
tables, no Python per row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import require_at_most

DEFAULT_THRESHOLD = 0.75  # library default; the ingest path passes 0.65
MAX_ANCHORS = 1_024  # anchors travel inside the plan as literals


def centroids(df: DataFrame, vec_col: str, label_col: str) -> DataFrame:
    """Mean vector per label (anchor candidates): one aggregation over (label, position)."""
    cells = df.select(label_col, F.posexplode(vec_col).alias("pos", "v"))
    return cells.groupBy(label_col, "pos").agg(F.avg(F.col("v").cast("double")).alias("v"))


def _anchor_literal(anchors: DataFrame, label_col: str) -> tuple[Column, Column]:
    """(labels literal, vectors literal) from a long (label, pos, v) anchor frame."""
    require_at_most(anchors.select(label_col).distinct(), MAX_ANCHORS, "anchor set")
    rows = anchors.orderBy(label_col, "pos").collect()
    by_label: dict = {}
    for r in rows:
        by_label.setdefault(r[label_col], []).append(float(r["v"]))
    labels = list(by_label)
    lab = F.array(*[F.lit(x) for x in labels])
    vecs = F.array(*[F.array(*[F.lit(x) for x in by_label[k]]) for k in labels])
    norms = F.array(*[F.lit(sum(x * x for x in by_label[k]) ** 0.5) for k in labels])
    return lab, vecs, norms


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity of two numeric arrays (null when either norm is 0)."""
    return dot(a, b) / F.nullif(norm(a) * norm(b), F.lit(0.0))


def match_to_anchors(df: DataFrame, vec_col: str, anchors: DataFrame, label_col: str = "label", threshold: float = DEFAULT_THRESHOLD) -> DataFrame:
    """S3: argmax-cosine anchor per row; ``mapped`` when the best score >= threshold.

    Output adds ``mapped_to`` (null when unmapped), ``confidence`` (best score rounded to 4) and
    ``status``. Ties keep the first anchor in label order.
    """
    labels, vecs, norms = _anchor_literal(anchors, label_col)
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    # the row norm once per row, anchor norms once per plan
    base = df.withColumn("__v", v).withColumn("__vn", norm(F.col("__v")))
    scores = F.transform(vecs, lambda a, i: dot(F.col("__v"), a) / F.nullif(F.col("__vn") * norms[i], F.lit(0.0)))
    out = base.withColumn("__s", scores).withColumn("__best", F.array_max("__s")).withColumn("__idx", F.array_position("__s", F.col("__best")))
    hit = F.col("__best") >= F.lit(threshold)
    return out.select(
        *[c for c in df.columns if c != vec_col],
        F.when(hit, F.element_at(labels, F.col("__idx").cast("int"))).alias("mapped_to"),
        F.round("__best", 4).alias("confidence"),
        F.when(hit, F.lit("mapped")).otherwise(F.lit("unmapped")).alias("status"),
    )


def first_claim(matches: DataFrame, order_col: str, target_col: str = "mapped_to") -> DataFrame:
    """S3 assignment rule: a target can be claimed once; among rows mapped to the same target the
    first in ``order_col`` order keeps it and the others become ``unmapped``.

    The first claimant per target is a ``min`` aggregation (combined map-side, so a target
    claimed by a third of all rows costs one row per partition), joined back on (target, order).
    """
    firsts = matches.where(F.col(target_col).isNotNull()).groupBy(target_col).agg(F.min(order_col).alias("__first"))
    j = matches.join(firsts, target_col, "left")
    keep = F.col(target_col).isNotNull() & (F.col(order_col) == F.col("__first"))
    return j.select(
        *[c for c in matches.columns if c not in (target_col, "status")],
        F.when(keep, F.col(target_col)).alias(target_col),
        F.when(keep, F.lit("mapped")).otherwise(F.lit("unmapped")).alias("status"),
    )
