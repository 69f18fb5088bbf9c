"""Token counts through a digest cache (operator 6).

The cache is a Parquet table ``(version, digest, n_tokens)`` in a shared folder: ``version`` is the
digest of the tokenizer file and of its library's version, ``digest`` that of the normalised content. A run joins the digests of all
documents to it, encodes one document of each digest that it lacks, appends those counts and joins them
to every document. Counting a table twice therefore encodes nothing the second time. Each run appends
under a folder ``run=...`` of its own, so that runs at the same time do not touch each other's files.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
import tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .common import file_bytes, materialise, slices

#: A count belongs to the version of the library that made it.
LIBRARIES = {"json": tokenizers.__version__, "model": sentencepiece.__version__}
CACHE_SCHEMA = "version string, digest binary, n_tokens long"


class Counter:
    """Counts of the library that the file belongs to: tokenizers for .json, sentencepiece for .model."""

    def __init__(self, raw: bytes, kind: str):
        if kind == "json":
            tok = Tokenizer.from_str(raw.decode())
            tok.no_truncation()
            tok.no_padding()
            self.count = lambda texts: [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
        elif kind == "model":
            sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
            self.count = lambda texts: [len(x) for x in sp.encode(texts, num_threads=1)]
        else:
            raise ValueError(f"no library for a .{kind} file")


_LOADED: dict[str, Counter] = {}


def read_cache(spark: SparkSession, path: str, version: str) -> DataFrame:
    """One row per digest of this tokenizer version; empty where the cache does not exist yet.

    Two runs may append the same digest at once; their counts are equal, so one of them is taken.
    """
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], CACHE_SCHEMA).drop("version")
    found = spark.read.schema(CACHE_SCHEMA).parquet(path).where(F.col("version") == version)
    return found.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    docs: DataFrame, tokenizer_path: str, cache_path: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(id_col, n_bytes long, n_tokens long)``, one row per row of ``docs``.

    Normalised content is the text itself with null as empty: the tokenizers count white space and case
    by their own rules, so nothing else may be folded without changing a count. Repeated rows and equal
    texts each get a row, from one encoding. Null ids pass through. An empty table gives no rows. Other
    columns are left out, so their names cannot clash. Very long texts are encoded whole, one at a time. An
    append that did not end leaves no count; a count that is gone when the result is read is an error, not
    a missing row. Runs at the same time may encode a text twice, to the same count.

    The documents' text is shuffled only to reach the chosen row of each new digest; the join of counts
    to documents carries digests. A digest that many rows share is split by the adaptive skew join.
    """
    spark = docs.sparkSession
    raw = file_bytes(tokenizer_path)
    kind = tokenizer_path.rpartition(".")[2]
    version = hashlib.sha256(raw + f"{kind} {LIBRARIES.get(kind)}".encode()).hexdigest()
    model = spark.sparkContext.broadcast(raw)
    text = F.coalesce(F.col(text_col), F.lit(""))
    content = docs.select(
        F.col(id_col).alias("id"),
        text.alias("content"),
        F.unhex(F.sha2(F.encode(text, "UTF-8"), 256)).alias("digest"),
        F.octet_length(text).cast("long").alias("n_bytes"),
    )
    keys = materialise(content.select("id", "digest", "n_bytes"), "digests")
    distinct = keys.groupBy("digest").agg(F.min("id").alias("id"))
    misses = distinct.join(read_cache(spark, cache_path, version), "digest", "left_anti")
    # the chosen row of a digest; rows that share both id and digest have the same text
    chosen = content.where("id is not null").select("id", "digest", "content").join(misses.hint("merge"), ["id", "digest"])
    chosen = chosen.dropDuplicates(["id", "digest"])
    unnamed = content.where("id is null").select("digest", "content").join(
        misses.where("id is null").select("digest"), "digest"
    ).dropDuplicates(["digest"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if version not in _LOADED:
            _LOADED.clear()
            _LOADED[version] = Counter(model.value, kind)
        count = _LOADED[version].count
        for b in slices(batches, 256):
            n = count(b.column("content").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [pa.array([version] * len(n)), b.column("digest"), pa.array(n, pa.int64())],
                names=["version", "digest", "n_tokens"],
            )

    to_encode = chosen.select("digest", "content").unionByName(unnamed.select("digest", "content"))
    to_encode.mapInArrow(run, CACHE_SCHEMA).write.parquet(f"{cache_path}/run={uuid.uuid4().hex}")
    counts = read_cache(spark, cache_path, version)
    lost = F.raise_error(F.lit("the token cache lost counts while it was read")).cast("long")
    return keys.join(counts, "digest", "left").select(F.col("id").alias(id_col), "n_bytes", F.coalesce("n_tokens", lost).alias("n_tokens"))
