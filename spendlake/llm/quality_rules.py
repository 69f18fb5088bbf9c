"""Host-level quality rules (operator 7), in DataFrame functions only.

Document statistics are computed inside a row; the failures of the base rules are aggregated by host,
each host's rate is shrunk towards the corpus by an empirical beta prior, and the verdict of a host is
joined back to its documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise

BLANK = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
WINDOW = 8
#: A host's documents are spread over this many join keys, so that one host never fills one task.
SALTS = 32


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated once per row, however often ``use`` reads it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def repeated_words(words: Column, window: int = WINDOW) -> Column:
    """Number of words that lie in a window of ``window`` words found twice or more in ``words``.

    Windows are compared by a 64-bit hash of their words' hashes. The sorted form that finds the
    places is built only for texts in which a window does repeat.
    """

    def places(h: Column) -> Column:
        at = F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))
        twice = lambda s: F.filter(
            s,
            lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False))
            | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)),
        )
        return F.array_sort(F.transform(let(F.array_sort(at), twice), lambda x: x["i"]))

    def covered(p: Column) -> Column:
        steps = F.zip_with(F.slice(p, 2, F.size(p) - 1), F.slice(p, 1, F.size(p) - 1), lambda a, b: F.least(a - b, F.lit(window)))
        return F.aggregate(steps, F.lit(window).cast("long"), lambda s, x: s + x)

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) < F.size(h), let(places(h), covered)).otherwise(F.lit(0).cast("long"))

    def hashes(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), F.size(w) - (window - 1)), lambda i: F.xxhash64(F.slice(w, i, window)))

    by_word = F.transform(words, lambda x: F.xxhash64(x))
    return F.when(F.size(words) < window, F.lit(0).cast("long")).otherwise(let(let(by_word, hashes), count))


def statistics(docs: DataFrame, text_col: str = "text") -> list[Column]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of the whole text; null counts as empty."""
    text = F.coalesce(F.col(text_col), F.lit(""))

    def of_words(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        )

    words = let(F.array_remove(F.split(text, f"{BLANK}+"), ""), of_words)
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    dup = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return [
        words.alias("words"),
        (F.size(F.split(text, SYMBOL, -1)) - 1).cast("long").alias("n_symbols"),
        dup.alias("n_dup_lines"),
    ]


def beta_prior(hosts: DataFrame, low: float = 1.0, high: float = 1000.0) -> tuple[float, float]:
    """(a, b) of the beta prior of host failure rates, from one row of totals over all hosts.

    The mean is the corpus rate m; the weight k = a + b is matched to the spread of the rates,
    k = m (1 - m) / variance - 1, within [low, high]. Without spread, or with nothing or everything
    failing, k is ``high``.
    """
    t = hosts.agg(
        F.sum("n").alias("n"), F.sum("failed").alias("f"), F.sum(F.col("failed") * F.col("failed") / F.col("n")).alias("s")
    ).first()
    if not t["n"]:
        return 0.0, high
    m = t["f"] / t["n"]
    spread = t["s"] / t["n"] - m * m
    k = min(high, max(low, m * (1 - m) / spread - 1)) if spread > 1e-12 else high
    return m * k, (1 - m) * k


def judge(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    host_col: str = "source",
    min_words: int = 20,
    max_repeat_pct: int = 30,
    max_host_rate: float = 0.5,
) -> DataFrame:
    """Statistics, ``base_failed`` and ``kept`` of every row of ``docs``.

    A document fails the base rules with fewer than ``min_words`` words or more than ``max_repeat_pct``
    percent repeated words; it is kept unless it fails or its host's shrunk failure rate is above
    ``max_host_rate``. A null or empty text has no words and fails. Rows with a null host form a host of
    their own. Repeated rows are judged, and count for their host, as often as they stand there. Empty
    tables give no rows; other columns are not read.
    """
    host = F.col(host_col).cast("string")
    facts = docs.select(F.col(id_col).alias("id"), F.coalesce(host, F.lit("")).alias("host"), host.isNull().alias("no_host"), *statistics(docs, text_col))
    facts = facts.select("id", "host", "no_host", "words.*", "n_symbols", "n_dup_lines")
    failed = (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat_pct * F.col("n_words"))
    facts = materialise(facts.withColumn("base_failed", failed), "rules")
    hosts = facts.groupBy("host", "no_host").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("base_failed").cast("long")).alias("failed")
    )
    hosts = materialise(hosts, "hosts")
    a, b = beta_prior(hosts)
    rate = (F.col("failed") + F.lit(a)) / (F.col("n") + F.lit(a + b))
    verdict = hosts.select("host", "no_host", (rate > max_host_rate).alias("host_failed"))
    verdict = verdict.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = facts.withColumn("salt", F.pmod(F.xxhash64("id", "n_words", "word_chars"), F.lit(SALTS)).cast("int"))
    out = salted.join(verdict, ["host", "no_host", "salt"])
    return out.select(
        F.col("id").alias(id_col),
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        "base_failed",
        (~F.col("base_failed") & ~F.col("host_failed")).alias("kept"),
    )
