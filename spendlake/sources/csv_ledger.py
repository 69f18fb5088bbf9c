"""Spend CSV exports -> raw string columns with trimmed header names.

Every file is read by its own header: files are grouped by their header line, each group is one scan
with an explicit all-string schema, so nothing is inferred and a file with other or reordered columns
keeps its meaning. Quoted fields may hold doubled quotes and line breaks; a row with too many or too few
fields fails the read. Coercion happens in ``normalise_raw`` (P6, P7). Only header lines reach the driver.
"""

from __future__ import annotations

import csv
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.ledger import canonicalise, normalise_raw, squash, strip_header

#: Where a row stands in its export: file, block of the file, row within the task that reads it.
POSITION = "__position"


def headers(spark: SparkSession, path: str) -> dict[tuple[str, ...], list[str]]:
    """Header -> the files under ``path`` that have it, in order of file name."""
    names = sorted(r[0] for r in spark.read.format("binaryFile").load(path).select("path").collect())
    if not names:
        raise ValueError(f"empty CSV export: {path}")
    found: dict[tuple[str, ...], list[str]] = {}
    for name in names:
        first = spark.read.text(name).limit(1).first()  # one line, not the file
        if first is not None:
            found.setdefault(tuple(next(csv.reader([first[0].lstrip("\ufeff")]))), []).append(name)
    if not found:
        raise ValueError(f"empty CSV export: {path}")
    return found


def read_csv_groups(spark: SparkSession, path: str, multi_line: bool = True) -> list[DataFrame]:
    """One frame per distinct header: trimmed names, all columns as text, and ``POSITION``.

    ``multi_line=False`` lets Spark split large files, for exports without line breaks inside quotes.
    """
    out = []
    for names, files in headers(spark, path).items():
        schema = T.StructType([T.StructField(f"_c{i}", T.StringType(), True) for i in range(len(names))])
        reader = spark.read.option("header", True).option("mode", "FAILFAST").option("escape", '"').option("multiLine", multi_line)
        raw = reader.schema(schema).csv(files)
        at = F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id())
        cols = [f.name for f in schema]
        out.append(strip_header(raw.select(*cols, at.alias(POSITION)).toDF(*names, POSITION)))
    return out


def read_csv_export(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """All files as one frame; a column that a file does not have is null in its rows."""
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    return reduce(union, read_csv_groups(spark, path, multi_line)).drop(POSITION)


def ingest_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """S1 -> S2 -> P5-P8 -> A1: CSV exports as squashed canonical ledger rows.

    Aliases are resolved per header, and "first" in the squash is the first by file and position.
    """
    union = lambda a, b: a.unionByName(b, allowMissingColumns=True)
    groups = [normalise_raw(canonicalise(g)) for g in read_csv_groups(spark, path, multi_line)]
    return squash(reduce(union, groups), order_col=POSITION)
