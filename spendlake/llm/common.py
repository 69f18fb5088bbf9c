"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_path

#: Characters that separate words in every operator: ``[\x20\x09-\x0D]``.
BLANKS = " \t\n\x0b\x0c\r"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, computes it once.

    The files live in the folder that ``spark.checkpoint.dir`` names, so a lost executor costs
    nothing but the tasks it was running.
    """
    path = shared_path(df.sparkSession, f"llm-{name}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(doc_id: str | Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    c = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(c.cast("string"), F.lit(""))) % folds


#: Arrow bytes of a slice that Python works on at once; a single larger row makes a slice of its own.
SLICE_BYTES = 2 << 20


def slices(batches: Iterator[pa.RecordBatch], rows: int = 512, max_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of ``rows`` rows and ``max_bytes`` at most, so that a task's Python memory does not follow the
    batch or the length of its texts. A row that is larger on its own is a slice."""
    for b in batches:
        todo = [b.slice(i, rows) for i in range(0, b.num_rows, rows)][::-1]
        s = None
        while todo:
            s = todo.pop()
            if s.num_rows > 1 and s.nbytes > max_bytes:
                half = s.num_rows // 2
                todo += [s.slice(half), s.slice(0, half)]
            else:
                yield s
        # a worker lives on between batches and tasks; what Arrow keeps for later would count all that time
        del b, s, todo
        pa.default_memory_pool().release_unused()


def file_bytes(path: str, limit: int = 64 << 20) -> bytes:
    """A tokenizer file, read once on the driver; ``limit`` bounds what is later broadcast."""
    with open(path, "rb") as f:
        raw = f.read(limit + 1)
    if len(raw) > limit:
        raise ValueError(f"{path} is larger than {limit} bytes")
    return raw


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """Smallest reachable id of each vertex: ``(id, component)`` from undirected ``(a, b)`` edges.

    Alternating large-star / small-star rounds (Kiveris et al., 2014). A round is two grouped minima
    and two joins on a vertex id; every round is written to the shared folder, nothing but one count
    reaches the driver. Self loops and repeated edges are ignored, nulls are not vertices.
    """
    spark = edges.sparkSession
    e = edges.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    e = e.where("a is not null and b is not null and a <> b")
    e = materialise(e.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "cc")
    for _ in range(max_rounds):
        # large star: every larger neighbour of u goes to the smallest vertex around u
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(
            F.explode(
                F.array(
                    F.struct(F.col("a"), F.col("m").alias("b")),
                    F.struct(F.col("b").alias("a"), F.col("m").alias("b")),
                )
            ).alias("s")
        )
        nxt = materialise(small.select("s.a", "s.b").where("a <> b").distinct(), "cc")
        # a forest of stars does not change any more: every vertex has one edge, none is both leaf and hub
        roots = nxt.select(F.col("b").alias("a")).distinct()
        many = nxt.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
        done = nxt.join(roots, "a", "left_semi").isEmpty() and many.isEmpty()
        e = nxt
        if done:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    hubs = e.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return e.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(hubs)


def unique_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` does not have yet."""
    return stem if stem not in df.columns else f"{stem}_{uuid.uuid4().hex[:8]}"


def sum_vectors(df: DataFrame, keys: list[str], vec: str = "vec", dtype: str = "<f8") -> DataFrame:
    """Element-wise sum of equally long binary vectors by ``keys``: one row per key.

    A group has one vector per task that made it, so its size follows the number of tasks, not rows.
    """
    fields = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column(vec):
                v = np.frombuffer(x.as_buffer(), dtype)
                total = v.copy() if total is None else total + v
        cols = [pa.array([k.as_py()], k.type) for k in key]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([total.tobytes()], pa.binary())], names=[*keys, vec])

    return df.groupBy(*keys).applyInArrow(add, f"{fields}, `{vec}` binary")
