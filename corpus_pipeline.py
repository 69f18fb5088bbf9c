"""The corpus pipeline: five stages over ``documents``, each a Parquet table read by the next.

Every stage takes (spark, docs, sf_dir), works on all documents its predecessor kept and returns the
columns of ``documents``, further columns included; the last returns token ids. Repeated rows are judged
alike, and each of them stays or goes; texts are taken whole, however long; an empty table stays empty. Near-duplicate documents are judged on five-word
shingles at a Jaccard similarity of 0.8.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendlake.llm import bpe, decontaminate, langid, line_dedup, ngram_join
from spendlake.llm.common import fold, materialise, table, unique_name

#: Least posterior of a document's language.
MIN_LANGUAGE_SCORE = 0.5


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is recognised; those without a letter or a clear language go.

    That takes null and empty texts. A null id trains as the empty text's fold; of equally likely languages
    the first in alphabetical order counts.
    """
    path = public_tokenizers.path("piece_bpe_32k.model")
    model = langid.train(docs.where(fold("doc_id") != 0), path)
    lang, score = unique_name(docs, "lang_found"), unique_name(docs, "lang_score")
    out = langid.predict(docs, model, lang_out=lang, score_out=score, keep_text=True)
    return out.where((F.col(lang) != "und") & (F.col(score) >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the long lines that five or more share, except in the largest id.

    Null texts become empty ones; a null id counts as the smallest.
    """
    out = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs), counts=False)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near copies; rows without an id stay."""
    found = ngram_join.components(docs, k=5, num=80, den=100)
    gone = found.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", *decontaminate.sentences())
    leaks = unique_name(docs, "leaks_found")
    return decontaminate.annotate(docs, items, out_col=leaks).where(F.size(leaks) == 0).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digest of the text that they decode to."""
    path = public_tokenizers.path("word_bpe_49k.json")
    out = bpe.encode(docs.select("doc_id", "text"), path, decoded_col="decoded")
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("language ID", language),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_copies),
    ("benchmark decontamination", benchmark),
    ("BPE encoding and decoding", tokens),
]

#: Learned languages, graph components and BPE have no SQL; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), "stage-" + name.replace(" ", "-"))
    return docs
