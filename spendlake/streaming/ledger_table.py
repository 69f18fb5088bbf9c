"""A merge-on-read ledger: micro-batches append what they bring, readers resolve it, months are compacted.

Layout below one folder::

    kind=delta/epoch=<n>/month=<yyyy-MM>/   what micro-batch n brought: one row per key and sync
    kind=base/epoch=<n>/month=<yyyy-MM>/    that month's deltas up to n and its base before, merged
    parts/epoch=<n>/                        the files that micro-batch n took in, by sync

A batch that runs again overwrites its own folders and nothing else. Only folders whose write ended (with
its ``_SUCCESS`` mark) are read; a month is its newest base and the deltas behind it. Nothing is changed in
place, so a reader is never disturbed; ``vacuum`` removes what is merged into a base.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.joins import null_safe_join
from ..functions.sizing import bounded_broadcast
from ..session import cut_lineage
from ..sources.tables import MONEY, RAW_MONEY

LEDGER_KEYS = ("date", "service_name", "account_name")
#: A month is compacted once its deltas hold so many bytes, or lie in so many folders.
COMPACT_BYTES = 256 << 20
COMPACT_DELTAS = 16
#: A row's place in its file takes so many bits.
ROW_BITS = 40


def take_in(batch: DataFrame, seen: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """``batch`` without files that were taken in before, and the ``(sync_id, part)`` that are new.

    A part is a file's rows of one sync, named by the file's own name and a digest of the rows in any order.
    Files of other names add up, even if their rows are equal; a file delivered again under its name counts
    once, in one batch or in several; one that comes with other rows under an old name adds up too.
    """
    cols = [F.col(c) for c in batch.columns if c not in ("__position", "month")]
    named = batch.withColumn("__file", F.col("__position.file_path"))
    digest = F.concat_ws(":", F.element_at(F.split("__file", "/"), -1), F.count(F.lit(1)), F.sum(F.xxhash64(*cols).cast("decimal(20,0)")))
    parts = named.groupBy("__file", "sync_id").agg(digest.alias("part"))
    parts = parts.groupBy("sync_id", "part").agg(F.min("__file").alias("__file"))
    if seen is not None:
        parts = null_safe_join(parts, seen.select("sync_id", "part").distinct(), ["sync_id", "part"], "left_anti")
    # one row per file and sync of the batch
    parts = parts.persist()
    rows = null_safe_join(named, bounded_broadcast(parts.select("__file", "sync_id")), ["__file", "sync_id"], "left_semi")
    return rows.drop("__file"), parts.select("sync_id", "part")


def by_sync(rows: DataFrame, position: str, keys: Sequence[str] = LEDGER_KEYS) -> DataFrame:
    """One row per key and sync: summed spend, the first value of the other columns, the first position.

    Rows are shuffled and sorted with a number in place of their file's time and path, which packs well on the
    wire but not in a task's memory; the result has them again.
    """
    named = rows.withColumns({"__time": F.col(f"{position}.file_modification_time"), "__path": F.col(f"{position}.file_path"), "__row": F.col(f"{position}.row_index")})
    numbers = F.row_number().over(Window.orderBy("__time", "__path")).cast("long")  # one row per file
    files = cut_lineage(named.select("__time", "__path").distinct().withColumn("__no", numbers))
    narrow = null_safe_join(named.drop(position), bounded_broadcast(files), ["__time", "__path"]).drop("__time", "__path")
    narrow = narrow.withColumn("__at", F.shiftleft("__no", ROW_BITS) + F.col("__row")).drop("__no", "__row")
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("__at"))).alias(c)
    one = narrow.groupBy(*keys, "sync_id").agg(F.min("__at").alias("__at"), F.sum(F.col("spend").cast(RAW_MONEY)).cast(RAW_MONEY).alias("spend"), first("bu_code"), first("segment"))
    back = one.withColumn("__no", F.shiftright("__at", ROW_BITS)).join(bounded_broadcast(files), "__no")
    at = F.struct(F.col("__time").alias("file_modification_time"), F.col("__path").alias("file_path"), F.col("__at").bitwiseAND((1 << ROW_BITS) - 1).alias("row_index"))
    return back.select(*keys, "sync_id", at.alias("at"), "spend", "bu_code", "segment")


def _age() -> Column:
    """Order of syncs; a null one comes before all others."""
    return F.struct(F.col("sync_id").isNotNull().alias("known"), F.col("sync_id").alias("sync"))


def ends(rows: DataFrame, keys: Sequence[str] = LEDGER_KEYS) -> DataFrame:
    """Of rows by key and sync those of each key's first and last sync: no other can matter later."""
    span = rows.groupBy(*keys).agg(F.min(_age()).alias("__lo"), F.max(_age()).alias("__hi"))
    joined = null_safe_join(rows, span, keys)
    return joined.where(_age().eqNullSafe(F.col("__lo")) | _age().eqNullSafe(F.col("__hi"))).drop("__lo", "__hi")


def resolve(rows: DataFrame, keys: Sequence[str] = LEDGER_KEYS) -> DataFrame:
    """J2 over stored rows: each key's spend of its latest sync, other columns of its first one.

    Two grouped aggregates; the second goes over one row per key and sync.
    """
    one = by_sync(rows, "at", keys)
    firsts = F.min_by(F.struct("bu_code", "segment"), _age()).alias("f")
    out = one.groupBy(*keys).agg(F.max_by("spend", _age()).cast(MONEY).alias("spend"), firsts)
    return out.select(*keys, "spend", "f.bu_code", "f.segment")


@dataclass
class LedgerTable:
    """The table at ``path``; ``keys`` identify a ledger row and hold ``date``."""

    spark: SparkSession
    path: str
    keys: tuple[str, ...] = LEDGER_KEYS
    compact_bytes: int = COMPACT_BYTES
    compact_deltas: int = COMPACT_DELTAS

    def _fs(self, path: str):
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def _children(self, path: str) -> list[str]:
        fs, p = self._fs(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []

    def _epochs(self, kind: str) -> dict[int, list[str]]:
        """Months of each finished epoch of a kind."""
        out = {}
        for e in self._children(f"{self.path}/{kind}"):
            names = self._children(f"{self.path}/{kind}/{e}")
            if "_SUCCESS" in names:
                out[int(e.partition("=")[2])] = [n.partition("=")[2] for n in names if n.startswith("month=")]
        return out

    def live(self) -> dict[str, list[tuple[str, int]]]:
        """Each month's newest base, if it has one, and the deltas behind it, as (kind, epoch)."""
        out: dict[str, list[tuple[str, int]]] = defaultdict(list)
        upto: dict[str, int] = {}
        for e, months in self._epochs("kind=base").items():
            for m in months:
                upto[m] = max(upto.get(m, e), e)
        for m, e in upto.items():
            out[m].append(("kind=base", e))
        for e, months in sorted(self._epochs("kind=delta").items()):
            for m in months:
                if e > upto.get(m, -1):
                    out[m].append(("kind=delta", e))
        return out

    def _rows(self, months: dict[str, list[tuple[str, int]]]) -> DataFrame | None:
        paths = [f"{self.path}/{kind}/epoch={e}/month={m}" for m, parts in sorted(months.items()) for kind, e in parts]
        return self.spark.read.parquet(*paths) if paths else None

    def read(self) -> DataFrame | None:
        """The resolved ledger; None while nothing has been taken in."""
        rows = self._rows(self.live())
        return None if rows is None else resolve(rows, self.keys)

    def _write(self, rows: DataFrame, kind: str, epoch: int) -> None:
        rows = rows.withColumn("month", F.coalesce(F.date_format("date", "yyyy-MM"), F.lit("none")))
        # the whole folder is replaced, and marked when it is complete
        writer = rows.hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "static")
        writer.partitionBy("month").parquet(f"{self.path}/{kind}/epoch={epoch}")

    def append(self, batch: DataFrame, epoch: int) -> None:
        """Take in a micro-batch: its rows by key and sync become a delta, its files are noted."""
        before = [e for e in self._epochs("parts") if e < epoch]
        seen = self.spark.read.parquet(*[f"{self.path}/parts/epoch={e}" for e in before]) if before else None
        rows, parts = take_in(batch, seen)
        self._write(by_sync(rows, "__position", self.keys), "kind=delta", epoch)
        parts.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/parts/epoch={epoch}")
        parts.unpersist()
        self.compact(epoch)

    def _size(self, month: str, parts: list[tuple[str, int]]) -> int:
        total = 0
        for kind, e in parts:
            fs, p = self._fs(f"{self.path}/{kind}/epoch={e}/month={month}")
            total += fs.getContentSummary(p).getLength()
        return total

    def compact(self, epoch: int) -> list[str]:
        """Merge the months whose deltas have grown past the bounds into a base as of ``epoch``."""
        due = {}
        for m, parts in self.live().items():
            deltas = [p for p in parts if p[0] == "kind=delta"]
            base = self._size(m, [p for p in parts if p not in deltas])
            # a delta much smaller than the base can wait, so a byte is rewritten a bounded number of times
            if len(deltas) >= self.compact_deltas or self._size(m, deltas) >= max(self.compact_bytes, base // 4):
                if deltas:
                    due[m] = parts
        if due:
            self._write(ends(by_sync(self._rows(due), "at", self.keys), self.keys), "kind=base", epoch)
        return sorted(due)

    def vacuum(self) -> int:
        """Remove the folders of months that are merged into a newer base; returns how many. Call it when no
        reader still uses them."""
        live = self.live()
        gone = 0
        for kind in ("kind=delta", "kind=base"):
            for e, months in self._epochs(kind).items():
                for m in months:
                    if (kind, e) not in live[m]:
                        fs, p = self._fs(f"{self.path}/{kind}/epoch={e}/month={m}")
                        fs.delete(p, True)
                        gone += 1
        return gone
