"""Ledger table, catalog and exports (S8-S13, J2 at table level, J6).

The ledger table is Parquet partitioned by ``dataset_id`` and ``month``; a scan for one dataset
prunes partitions and columns. A merge (upsert) rewrites only the partitions the update batch
touches: it reads those partitions, merges, writes the result to a fresh staging path, then
overwrites exactly those partitions from staging (dynamic partition overwrite). Nothing is ever
overwritten while it is being read, and a lost executor just recomputes from files.
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from ..operators.ledger import LEDGER_KEY, upsert
from ..session import cut_lineage, shared_path

LEDGER_TABLE_COLUMNS = ("dataset_id", "date", "spend", "account_name", "service_name", "bu_code", "segment")
PARTITIONS = ("dataset_id", "month")


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def remove_path(spark: SparkSession, path: str) -> None:
    """Remove a staged table that nothing reads any more."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def with_month(df: DataFrame) -> DataFrame:
    return df.withColumn("month", F.date_format("date", "yyyy-MM"))


def write_ledger(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Write ledger rows partitioned by (dataset_id, month); ``overwrite`` replaces only the
    partitions present in ``df`` (dynamic partition overwrite).

    The ``rebalance`` hint lets AQE size the write: small partitions are merged into few files
    and a hot (dataset, month) partition is split over several tasks instead of one.
    """
    (
        with_month(df).hint("rebalance", *PARTITIONS).write.mode(mode)
        .option("partitionOverwriteMode", "dynamic").partitionBy(*PARTITIONS).parquet(path)
    )


def scan_ledger(spark: SparkSession, path: str, dataset_id: str | None = None, columns: Sequence[str] = LEDGER_TABLE_COLUMNS[1:]) -> DataFrame:
    """One dataset's rows, pruned to the ledger columns (partition + column pruning)."""
    df = spark.read.parquet(path)
    if dataset_id is not None:
        df = df.where(F.col("dataset_id") == F.lit(dataset_id))
    return df.select(*columns)


def merge_into_ledger(spark: SparkSession, path: str, updates: DataFrame, keys: Sequence[str] = LEDGER_KEY) -> None:
    """J2 + S9: idempotent upsert of squashed ``updates`` (must carry dataset_id) into the table.

    Only (dataset_id, month) partitions present in the batch are read and rewritten. The touched
    partition list is a distinct over the batch (bounded by datasets x months in the batch).
    """
    upd = cut_lineage(with_month(updates))  # the batch is read three times below
    touched = upd.select(*PARTITIONS).distinct()
    if _exists(spark, path):
        current = spark.read.parquet(path).join(bounded_broadcast(touched, 100_000), list(PARTITIONS), "left_semi")
        merged = upsert(current.drop("month"), upd.drop("month"), ["dataset_id", *keys])
    else:
        merged = upd.drop("month")
    staging = shared_path(spark, "ledger-staging")
    write_ledger(merged.select(*LEDGER_TABLE_COLUMNS), staging, "overwrite")
    write_ledger(spark.read.parquet(staging).select(*LEDGER_TABLE_COLUMNS), path, "overwrite")
    remove_path(spark, staging)


def records_json(df: DataFrame, date_cols: Sequence[str] = ("ds",)) -> DataFrame:
    """One JSON record per row with ISO dates (``to_json``), e.g. for an API payload
    or ``write.text``; rows stay distributed."""
    iso = {c: F.date_format(c, "yyyy-MM-dd") for c in date_cols if c in df.columns}
    return df.withColumns(iso).select(F.to_json(F.struct(*df.columns)).alias("record"))


def export_rows(forecast: DataFrame, filters: dict | None = None, ds_col: str = "ds", filter_cols: Sequence[str] = ()) -> DataFrame:
    """CSV export rows: ISO date, predicted / lower / upper to 2 decimals (falsy -> 0.00),
    then one column per active filter: a constant from ``filters`` or, for many series at once,
    the series key column in ``filter_cols`` (``All`` when unset)."""
    filters = filters or {}

    def money_text(c: str):
        # half-up on the decimal value (via 6 digits, so binary noise of a double cannot flip it)
        v = F.col(c).cast("double")
        txt = F.col(c).cast("decimal(38,6)").cast("decimal(18,2)").cast("string")
        return F.when(F.coalesce(v, F.lit(0.0)) != 0, txt).otherwise(F.lit("0.00"))

    cols = [
        F.date_format(ds_col, "yyyy-MM-dd").alias("Date"),
        money_text("yhat").alias("Predicted Spend"),
        money_text("yhat_lower").alias("Lower Bound"),
        money_text("yhat_upper").alias("Upper Bound"),
    ]
    cols += [F.lit(v if v else "All").alias(k) for k, v in filters.items()]
    cols += [F.coalesce(F.col(c).cast("string"), F.lit("All")).alias(c) for c in filter_cols]
    return forecast.select(*cols)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


# ----------------------------------------------------------------------------- S10, S11, J6
def newest_dataset(catalog: DataFrame) -> DataFrame:
    """The default dataset is the newest one (ties by id)."""
    return catalog.orderBy(F.desc("created_at"), F.desc("dataset_id")).limit(1)


def run_latest_state(events: DataFrame) -> DataFrame:
    """The run registry is append-only; a run's state is its latest event per task_id."""
    w = Window.partitionBy("task_id").orderBy(F.desc("seq"))
    return events.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") == 1).drop("__rn")


def run_state(events: DataFrame, fields: Sequence[str], key: str = "task_id", seq: str = "seq") -> DataFrame:
    """S11 with partial updates: per run the newest non-null value of each field, whatever order the events
    come in; an event sets the fields it holds and leaves the others. Null if no event sets a field.
    One combinable aggregation, so a run with very many events costs a row per partition."""
    newest = [F.max_by(c, F.when(F.col(c).isNotNull(), F.col(seq))).alias(c) for c in fields]
    return events.groupBy(key).agg(*newest, F.max(seq).alias("last_seq"))


def runs_with_dataset(runs: DataFrame, catalog: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Runs joined to their dataset, and orphan runs whose dataset is gone (left anti)."""
    return runs.join(catalog, "dataset_id", "inner"), runs.join(catalog, "dataset_id", "left_anti")


def table_path(spark: SparkSession, name: str) -> str:
    return os.path.join(shared_path(spark, name))
