"""Incremental billing ingest and streaming daily spend (R1-R4) on Structured Streaming.

* R1: landed billing files are read with the file source (``readStream``), each micro-batch is
  squashed and appended to the merge-on-read ledger table (``foreachBatch``, ``ledger_table``), with a
  checkpoint so a restarted or failed query resumes where it stopped.
* R2: providers revise the trailing 3 days, so the event-time watermark is 3 days.
* R3: tumbling daily spend per service is a ``window(ts, '1 day')`` aggregation; months are not a
  fixed-length window, so they are bucketed with ``date_trunc`` downstream.
* R4: replays are idempotent: exact repeats are dropped within the watermark, and the sink is
  keyed (replace, not add), so applying a batch twice equals applying it once.

Checkpoints and sink tables live under the shared folder named by ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.sizing import bounded_broadcast
from ..session import shared_path
from ..sources.sinks import _exists, remove_path
from ..sources.tables import MONEY
from .ledger_table import LedgerTable

LATE_HORIZON = "3 days"


def swap_partitions(rows: DataFrame, path: str, part_col: str, name: str) -> None:
    """Replace the partitions of ``path`` that ``rows`` holds; ``rows`` may be derived from ``path``.

    The rows are written aside first, so nothing is overwritten while it is read, then moved in by
    dynamic partition overwrite; the staged copy is removed afterwards.
    """
    spark = rows.sparkSession
    staging = shared_path(spark, name)
    rows.hint("rebalance", part_col).write.mode("overwrite").partitionBy(part_col).parquet(staging)
    (
        spark.read.parquet(staging).hint("rebalance", part_col).write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic").partitionBy(part_col).parquet(path)
    )
    remove_path(spark, staging)


def keyed_window_sink(path: str, keys: Sequence[str], part_col: str, version_col: str | None = None):
    """foreachBatch writer into a keyed table.

    Without ``version_col`` a batch row replaces the stored row with the same key (update-mode
    aggregates emit the full new value). With it, the row with the highest version wins, so a
    delivery that arrives after a newer one cannot roll a key back. Only the ``part_col``
    partitions present in the batch are rewritten: merged into a fresh staging path first, then
    swapped in with dynamic partition overwrite (never overwriting a path while reading it).
    """

    def write(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        own = not batch.is_cached  # a caller that cached the batch also releases it
        if own:
            batch = batch.persist()  # read several times below
        try:
            _write(spark, batch, epoch_id)
        finally:
            if own:
                batch.unpersist()

    def _write(spark, batch: DataFrame, epoch_id: int) -> None:
        if batch.isEmpty():
            return
        touched = batch.select(part_col).distinct()
        if _exists(spark, path):
            old = spark.read.parquet(path).join(bounded_broadcast(touched, 100_000), part_col, "left_semi").select(*batch.columns)
            if version_col is None:
                merged = null_safe_join(old, batch.select(*keys), keys, "left_anti").unionByName(batch)
            else:
                merged = newest_per_key(old.unionByName(batch), keys, version_col)
        else:
            merged = batch
        swap_partitions(merged, path, part_col, f"stage-{epoch_id}")

    return write


def land_in_order(df: DataFrame, ts_col: str, path: str, files: int = 8, drop_ts: bool = False, bounds: tuple | None = None, single_file: bool = True) -> None:
    """Fixture: land rows as ``files`` slices in event-time order, one append per time slice, so
    the file source (which orders by modification time) sees them arrive in order. The slice
    bounds are two scalars (min, max) from one aggregation. A watermark needs ``single_file``: within a
    slice the rows of several files are in no order of time."""
    if bounds is None:
        bounds = df.agg(F.min(F.col(ts_col).cast("timestamp")).alias("lo"), F.max(F.col(ts_col).cast("timestamp")).alias("hi")).first()
    lo, hi = bounds
    sec = F.unix_micros(F.col(ts_col).cast("timestamp"))
    span = max(int((hi - lo).total_seconds() * 1e6), 1)
    sliced = df.withColumn("__slice", F.least(F.floor((sec - F.unix_micros(F.lit(lo).cast("timestamp"))) * files / F.lit(span)), F.lit(files - 1)))
    if drop_ts:
        sliced = sliced.drop(ts_col)
    # stage all slices in one job, then deliver them one by one in time order
    staging = shared_path(df.sparkSession, "landing-staging")
    sliced.write.partitionBy("__slice").parquet(staging)
    for i in range(files):
        part = f"{staging}/__slice={i}"
        if _exists(df.sparkSession, part):
            rows = df.sparkSession.read.parquet(part)
            (rows.coalesce(1) if single_file else rows).write.mode("append").parquet(path)


def daily_spend_stream(spark: SparkSession, source_dir: str, schema, ts_col: str = "ts", key: str = "event_type", value: str = "value", max_files: int = 1) -> DataFrame:
    """R2 + R3: streaming daily spend per key with a 3-day lateness horizon (update mode)."""
    events = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(source_dir)
    events = events.withColumn(ts_col, F.col(ts_col).cast("timestamp"))
    return (
        events.withWatermark(ts_col, LATE_HORIZON)
        .groupBy(F.window(ts_col, "1 day").alias("w"), F.col(key))
        .agg(F.sum(F.col(value).cast(MONEY)).cast(MONEY).alias("spend"), F.count(F.lit(1)).alias("events"))
        .select(F.to_date(F.col("w.start")).alias("day"), key, "spend", "events")
    )


def run_daily_spend(spark: SparkSession, source_dir: str, schema, sink: str, checkpoint: str, key: str = "event_type", max_files: int = 1, monthly_sink: str | None = None) -> DataFrame:
    """Run R3 to completion (``availableNow``) into a keyed daily table and return it.

    With ``monthly_sink``, each batch also re-aggregates the calendar months it touched from the
    daily table (``date_trunc``; ``window`` has no calendar months) and swaps those month
    partitions into the monthly table, so both tables are complete after every batch.
    """
    agg = daily_spend_stream(spark, source_dir, schema, key=key, max_files=max_files)
    daily_writer = keyed_window_sink(sink, ["day", key], "day")

    def write(batch: DataFrame, epoch_id: int) -> None:
        batch = batch.persist()
        try:
            daily_writer(batch, epoch_id)
            if monthly_sink is not None and not batch.isEmpty():
                months = batch.select(F.trunc("day", "month").alias("month")).distinct()
                days = batch.sparkSession.read.parquet(sink).withColumn("month", F.trunc("day", "month"))
                touched = days.join(bounded_broadcast(months, 100_000), "month", "left_semi")
                roll = touched.groupBy("month", key).agg(F.sum("spend").cast(MONEY).alias("spend"), F.sum("events").alias("events"))
                swap_partitions(roll, monthly_sink, "month", f"month-stage-{epoch_id}")
        finally:
            batch.unpersist()

    q = (
        agg.writeStream.outputMode("update").option("checkpointLocation", checkpoint)
        .foreachBatch(write).trigger(availableNow=True).start()
    )
    q.awaitTermination()
    return spark.read.parquet(sink)


def ledger_ingest_stream(spark: SparkSession, landing_dir: str, schema, sink: str, checkpoint: str, max_files: int | None = None, max_bytes: int = 1 << 30) -> DataFrame:
    """R1 + R4 + J2: landed billing syncs (each re-sends the trailing days) into a merge-on-read ledger table.

    Rows of a key within one sync are summed (A1), however many files and batches the sync comes in; a
    later sync replaces the key's spend and nothing else. A file that is delivered again under its name, and
    a batch that runs again, change nothing; files of different names add up, equal or not; a late file never
    rolls a key back. No row is dropped for lateness: billing revisions are money, so the ledger path has no
    watermark. Input order is file time, file name and row. Files in subfolders are read too.

    A micro-batch takes ``max_bytes`` of files (or ``max_files``, if given) and appends what they hold; stored
    months are rewritten only when their deltas pass the table's bounds.
    """
    at = F.struct(F.col("_metadata.file_modification_time"), F.col("_metadata.file_path"), F.col("_metadata.row_index"))
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", True)
    reader = reader.option("maxFilesPerTrigger", max_files) if max_files else reader.option("maxBytesPerTrigger", max_bytes)
    rows = reader.parquet(landing_dir).select("*", at.alias("__position"))
    table = LedgerTable(spark, sink)

    def take(batch: DataFrame, epoch_id: int) -> None:
        # not kept: a pass reads its columns from the files again, and a batch of wide rows would fill the executors
        if not batch.isEmpty():
            LedgerTable(batch.sparkSession, sink).append(batch, epoch_id)

    q = (
        rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
        .trigger(availableNow=True).start()
    )
    q.awaitTermination()
    found = table.read()
    if found is None:
        empty = ", ".join(f"{c} {t}" for c, t in (("date", "date"), ("service_name", "string"), ("account_name", "string"), ("spend", MONEY), ("bu_code", "int"), ("segment", "string")))
        return spark.createDataFrame([], empty)
    return found


def drop_replays(stream: DataFrame, ts_col: str, keys: Sequence[str], horizon: str = LATE_HORIZON) -> DataFrame:
    """Drop exact repeats of a record seen within the lateness horizon (state is bounded by
    the watermark). Records older than the watermark are dropped too, so use it only where the
    horizon is a contract (R2), not on money that must never be lost."""
    return stream.withWatermark(ts_col, horizon).dropDuplicatesWithinWatermark(list(keys))


def land_syncs(ledger_rows: DataFrame, path: str, period_days: int = 7, overlap_days: int = 3, revise: dict | None = None) -> None:
    """Fixture: deliver ledger rows as periodic syncs; each sync also re-sends the ``overlap_days`` before its
    period (the provider revision window), changed as ``revise`` says."""
    base, last = sync_ids(period_days, overlap_days)
    landed = ledger_rows.withColumn("sync_id", F.explode(F.array_distinct(F.array(base, last))))
    if revise is not None:  # what a re-sent row says
        again = F.col("sync_id") != base
        landed = landed.withColumns({c: F.when(again, e).otherwise(F.col(c)).cast(ledger_rows.schema[c].dataType) for c, e in revise.items()})
    landed.write.mode("append").parquet(path)


def sync_ids(period_days: int = 7, overlap_days: int = 3) -> tuple[Column, Column]:
    """The first and the last sync that send a row of ``date``."""
    days = F.datediff("date", F.lit("1970-01-01"))
    base = F.floor(days / F.lit(period_days)).cast("long")
    # the next sync too when the row falls in that sync's re-read window
    return base, base + (days >= (base + 1) * period_days - overlap_days).cast("long")


def redeliver(spark: SparkSession, source: str, target: str) -> None:
    """Fixture: the files of ``source`` once more, under their own names, in another folder."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    src, dst = (jvm.org.apache.hadoop.fs.Path(p) for p in (source, target))
    fs = src.getFileSystem(conf)
    fs.mkdirs(dst)
    for f in fs.listStatus(src):
        if f.isFile() and f.getPath().getName().endswith(".parquet"):
            jvm.org.apache.hadoop.fs.FileUtil.copy(fs, f.getPath(), fs, jvm.org.apache.hadoop.fs.Path(dst, f.getPath().getName()), False, conf)


def newest_per_key(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
