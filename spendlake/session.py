"""Session helpers: a local session for tests and benches, and the shared folder for lineage cuts.

On a cluster the session comes from the job runner; nothing here overrides its settings except
where a key is unset (local runs and tests).
"""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "16g") -> SparkSession:
    """Session for local[N] runs (tests, bench). Executors and memory come from the caller."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("spendlake")
    for k, v in LOCAL_CONF.items():
        builder = builder.config(k, v)
    builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    builder = builder.config("spark.driver.memory", memory)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared folder named by ``spark.checkpoint.dir``.

    The cluster names it; only on a local master we set our own where it is unset. Elsewhere an unset
    folder is an error: a machine-local one would not be seen by other executors.
    """
    sc = spark.sparkContext
    current = sc.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not current and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all executors share")
    if not current:
        current = tempfile.mkdtemp(prefix="spendlake-ckpt-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", current)
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(current)
    return sc.getCheckpointDir() or current


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared checkpoint folder for written tables and stream state."""
    base = ensure_checkpoint_dir(spark)
    if base.startswith("file:"):
        base = base[len("file:"):]
    path = os.path.join(base, f"{name}-{uuid.uuid4().hex[:12]}")
    return path


def stable_path(spark: SparkSession, name: str) -> str:
    """The path of that name in the folder that ``spark.checkpoint.dir`` names, the same for every session.

    The context's own checkpoint folder is one below it, new for each application.
    """
    own = ensure_checkpoint_dir(spark)
    return os.path.join(spark.conf.get("spark.checkpoint.dir", None) or os.path.dirname(own), name)


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint into the shared folder (survives executor loss, unlike a local one)."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read from it: later passes read the columns they take."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)
