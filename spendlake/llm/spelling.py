"""Spelling variant grouping by search schemes over an FM-index in both directions (operator 12).

If two words differ by one inserted, deleted or replaced code point, one half of either stands unchanged at
the beginning or at the end of the other. A word is therefore looked up twice: its first half is matched
exactly from the left delimiter and extended over the second half with one error, and its second half
exactly from the right delimiter and extended over the first.

The index is the delimited vocabulary ``$word$word$...`` as an FM-index for each direction: a pattern stands
for an interval of suffix ranks, and extending it by a character is two rank queries. All words of a block
are extended together as arrays. Words that still agree share one interval, so what may follow an interval is
listed once for all of them.

The vocabulary is cut into blocks of bounded size by order of the words (from the left) and of the reversed
words (from the right). A word is sent to the blocks that its exact half can reach: its own, and neighbours
only where words with that half go on across a border.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, slices

#: Characters of vocabulary in a block, on average.
BLOCK_CHARS = 1 << 19
#: Distinct words, and their characters, that a counting task keeps.
HELD_WORDS = 300_000
HELD_CHARS = 1 << 24
#: Queries that are extended together.
TOGETHER = 1 << 15
UPPER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def observed(doc_id: int | None, found: Counter, every: int) -> Iterator[tuple[str, int]]:
    """The words that a document's runs count as: where ``every`` divides the crc32 of id and run, the run
    lacks the code point that the crc32 points at."""
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for w, n in found.items():
        h = zlib.crc32(w.encode(), start)
        if every and h % every == 0:
            at = h % len(w)
            w = w[:at] + w[at + 1 :]
        yield w, n


def vocabulary(
    docs: DataFrame, min_chars: int = 7, min_count: int = 2, every: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``(word, n)``: the words of all texts with at least ``min_chars`` code points and ``min_count`` uses.

    With ``every``, runs are altered as ``observed`` says (a test corpus of misspellings); 0 leaves them as
    they are. A null id counts as the empty text, a null or empty text has no words, repeated rows count
    again. A task hands on what it holds whenever that passes HELD_WORDS words or HELD_CHARS characters.
    """
    src = docs.select(F.col(id_col).cast("long").alias("did"), F.col(text_col).cast("binary").alias("content"))
    longer = re.compile(f"[a-zÀ-ÿ]{{{min_chars},}}")

    def flush(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        held = 0
        for b in slices(batches):
            for did, t in zip(b.column("did").to_pylist(), b.column("content").to_pylist(), strict=True):
                found = Counter(longer.findall(t.translate(UPPER).decode())) if t else Counter()
                for w, n in observed(did, found, every):
                    if len(w) >= min_chars:
                        if w not in seen:
                            held += len(w)
                        seen[w] += n
            if len(seen) > HELD_WORDS or held > HELD_CHARS:
                yield flush(seen)
                seen, held = Counter(), 0
        yield flush(seen)

    counts = src.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.where(F.col("n") >= min_count)


class FMIndex:
    """Suffix ranks of ``$w1$w2$...$`` for distinct words; patterns grow at their right end.

    (The text is stored reversed, since an FM-index extends to the left.) Symbol 0 is the delimiter.
    """

    def __init__(self, words: list[str]):
        self.words = words
        letters = sorted(set("".join(words)))
        self.symbol = {c: i + 1 for i, c in enumerate(letters)}
        table = np.zeros(max(map(ord, letters), default=0) + 1, np.int64)
        for c, i in self.symbol.items():
            table[ord(c)] = i
        size = np.array([len(w) + 1 for w in words], np.int64)
        data = np.frombuffer(("".join("\0" + w[::-1] for w in words) + "\0").encode("utf-32-le"), "<u4")
        text = np.where(data > 0, table[data], 0)
        self.n = len(text)
        order, rank = self._suffixes(text)
        self.bwt = text[order - 1]
        # rank queries by binary search among the places of each symbol
        self.places = np.sort(self.bwt * self.n + np.arange(self.n))
        starts = np.cumsum(size) - size
        # suffixes that begin with a delimiter come first; each but the text's last is one word's
        self.word_at = np.full(len(words) + 1, -1, np.int64)
        self.word_at[rank[starts]] = np.arange(len(words))

    @staticmethod
    def _suffixes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Order and ranks of the rotations, by doubling; distinct words make them differ within two words."""
        order = np.argsort(text, kind="stable")
        rank = np.cumsum(np.r_[0, text[order][1:] != text[order][:-1]])[np.argsort(order, kind="stable")]
        k = 1
        while rank.max(initial=0) < len(text) - 1:
            key = rank * len(text) + np.roll(rank, -k)
            order = np.argsort(key, kind="stable")
            ranked = np.empty_like(rank)
            ranked[order] = np.cumsum(np.r_[0, key[order][1:] != key[order][:-1]])
            rank, k = ranked, 2 * k
        return order, rank

    def extend(self, lo: np.ndarray, hi: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Intervals after one more symbol each; empty (lo == hi) where the text does not have it."""
        return np.searchsorted(self.places, c * self.n + lo), np.searchsorted(self.places, c * self.n + hi)

    def follows(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each interval the letters that follow it: (index of the interval, symbol) without repeats."""
        size = hi - lo
        at = np.repeat(np.arange(len(lo)), size)
        pos = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + lo[at]
        both = np.unique(at * (len(self.symbol) + 1) + self.bwt[pos])
        at, c = np.divmod(both, len(self.symbol) + 1)
        return at[c > 0], c[c > 0]


def _distinct(*cols: np.ndarray) -> list[np.ndarray]:
    order = np.lexsort(cols)
    cols = [c[order] for c in cols]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return [c[new] for c in cols]


def search(index: FMIndex, queries: list[str], exact: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """(query, word) indices: words of the index that begin with the query's first ``exact`` code points and
    differ from it by one code point inserted, deleted or replaced after them."""
    size = np.array([len(q) for q in queries], np.int64)
    need = np.array(exact, np.int64)
    code = index.symbol
    flat = np.array([code.get(c, -1) for q in queries for c in q], np.int64)
    begin = np.cumsum(size) - size
    # states without an error yet: one a query; with one: query, interval
    none = np.zeros(0, np.int64)
    q0 = np.arange(len(queries))
    lo0, hi0 = index.extend(np.zeros_like(q0), np.full_like(q0, index.n), np.zeros_like(q0))
    q1, lo1, hi1 = none, none, none
    out_q, out_w = [none], [none]

    def alive(q, lo, hi):
        use = hi > lo
        return q[use], lo[use], hi[use]

    for j in range(int(size.max(initial=-1)) + 1):
        # characters from j on are unread; a query may differ here once its exact half is read
        start = need[q0] <= j
        born_q, born_lo, born_hi = q0[start], lo0[start], hi0[start]
        skip = [none] * 3
        if len(born_q):
            span, which = np.unique(born_lo * (index.n + 1) + born_hi, return_inverse=True)
            at, c = index.follows(*np.divmod(span, index.n + 1))
            first, last = np.searchsorted(at, np.arange(len(span))), np.searchsorted(at, np.arange(len(span)), "right")
            child_lo, child_hi = index.extend(*(x[at] for x in np.divmod(span, index.n + 1)), c)
            each = (last - first)[which]
            use = np.repeat(np.arange(len(born_q)), each)
            child = np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each) + first[which][use]
            grown = (born_q[use], child_lo[child], child_hi[child])
            # a letter inserted: nothing is read
            q1, lo1, hi1 = (np.concatenate(x) for x in zip((q1, lo1, hi1), grown, strict=True))
            # another letter in place of this one; this one deleted
            more = size[grown[0]] > j
            here = flat[np.minimum(begin[grown[0]] + j, len(flat) - 1)] if len(flat) else none
            other = more & (c[child] != here)
            left = size[born_q] > j
            skip = [np.concatenate([x[other], y[left]]) for x, y in zip(grown, (born_q, born_lo, born_hi), strict=True)]
        # words read to their end
        if len(q1):
            q1, lo1, hi1 = _distinct(q1, lo1, hi1)
            end = size[q1] == j
            lo, hi = index.extend(lo1[end], hi1[end], np.zeros(end.sum(), np.int64))
            fq, flo, _ = alive(q1[end], lo, hi)
            out_q.append(fq)
            out_w.append(index.word_at[flo])
            q1, lo1, hi1 = q1[~end], lo1[~end], hi1[~end]
        # read character j
        on = size[q0] > j
        q0, lo0, hi0 = q0[on], lo0[on], hi0[on]
        lo0, hi0 = index.extend(lo0, hi0, flat[begin[q0] + j])
        q0, lo0, hi0 = alive(q0, lo0, hi0)
        lo1, hi1 = index.extend(lo1, hi1, flat[begin[q1] + j])
        q1, lo1, hi1 = alive(q1, lo1, hi1)
        q1, lo1, hi1 = (np.concatenate(x) for x in zip((q1, lo1, hi1), skip, strict=True))
    q, w = _distinct(np.concatenate(out_q), np.concatenate(out_w))
    return q, w


def near_pairs(words: DataFrame, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(word, near, near_n)``: for each of the distinct ``words`` (word, n) the words that differ from it by
    one code point inserted, deleted or replaced, each once."""
    words = materialise(words.select("word", "n"), "vocabulary")
    chars = words.agg(F.sum(F.length("word")).alias("s")).first()["s"] or 0
    blocks = max(1, -(-chars // block_chars))
    found = None
    for turned in (False, True):
        key = F.reverse("word") if turned else F.col("word")
        keyed = words.select(key.alias("key"), "n")
        part = _search_blocks(keyed, blocks, turned)
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def _search_blocks(keyed: DataFrame, blocks: int, turned: bool) -> DataFrame:
    """The pairs that one direction finds among the rows (key, n), ``key`` reversed in the other direction."""
    spark = keyed.sparkSession
    dealt = keyed.repartitionByRange(blocks, "key").withColumn("at", F.spark_partition_id())
    dealt = materialise(dealt, "blocks")
    # the driver holds one border a block
    borders = sorted(r["low"] for r in dealt.groupBy("at").agg(F.min("key").alias("low")).collect())
    shared = spark.sparkContext.broadcast(borders)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        borders = shared.value
        for b in slices(batches, 4096):
            out: tuple[list, ...] = ([], [], [], [])
            for w, n in zip(b.column("key").to_pylist(), b.column("n").to_pylist(), strict=True):
                home = bisect_right(borders, w) - 1
                half = w[: len(w) - len(w) // 2] if turned else w[: len(w) // 2]
                first = max(0, bisect_left(borders, half) - 1)
                last = bisect_right(borders, half + "\U0010ffff") - 1
                for block in range(first, last + 1):
                    for x, v in zip(out, (block, int(block != home), w, n), strict=True):
                        x.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.int32()), pa.array(out[1], pa.int8()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())], names=["block", "guest", "key", "n"])

    sent = dealt.select("key", "n").mapInArrow(route, "block int, guest byte, key string, n long")

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, counts, index = [], [], None
        for b in batches:
            guest = np.asarray(b.column("guest")) > 0
            keys = b.column("key").to_pylist()
            if index is None:
                members = np.flatnonzero(~guest)
                words += [keys[i] for i in members]
                counts.append(b.column("n").to_numpy()[members])
                if not guest.any():
                    continue
                index, numbers = FMIndex(words), np.concatenate(counts)
                yield from answer(index, words, numbers)
            yield from answer(index, [k for k, g in zip(keys, guest, strict=True) if g], numbers)
        if index is None:
            yield from answer(FMIndex(words), words, np.concatenate(counts))

    def answer(index: FMIndex, queries: list[str], numbers: np.ndarray) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(queries), TOGETHER):
            part = queries[i : i + TOGETHER]
            q, w = search(index, part, [len(x) - len(x) // 2 if turned else len(x) // 2 for x in part])
            step = -1 if turned else 1
            mine = pa.array([part[x][::step] for x in q.tolist()], pa.string())
            other = pa.array([index.words[x][::step] for x in w.tolist()], pa.string())
            yield pa.RecordBatch.from_arrays([mine, other, pa.array(numbers[w])], names=["word", "near", "near_n"])

    # a block's own words come first, then the words sent to it
    sorted_blocks = sent.repartition(max(1, len(borders)), "block").sortWithinPartitions("block", "guest")
    return sorted_blocks.mapInArrow(_by_block(look), "word string, near string, near_n long")


def _by_block(look):
    """Hand ``look`` one block's batches at a time; the input is sorted by block."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, pa.RecordBatch]]:
        for b in batches:
            ids = b.column("block").to_numpy()
            cut = np.r_[0, np.flatnonzero(ids[1:] != ids[:-1]) + 1, len(ids)]
            for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                if e > s:
                    yield int(ids[s]), b.slice(s, e - s)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, group in groupby(pieces(batches), key=lambda x: x[0]):
            yield from look(b for _, b in group)

    return run


def variants(words: DataFrame, ratio: int = 10, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """``(word, form, root, n, n_near, form_n)``, one row per row of ``words`` (word, n), words distinct.

    ``n_near`` counts the words that differ by exactly one code point; ``form`` is the one of them with the
    largest n, of equals the first in code-point order, if that n is ``ratio`` (at least 2) times the word's,
    and ``form_n`` its n; ``root`` is where following the forms ends, the word itself if it has none. Null
    words are not words and give no row. An empty table gives no rows; other columns are not read.
    """
    if ratio < 2:
        raise ValueError("the ratio must be 2 or more")
    words = materialise(words.where("word is not null").select("word", "n"), "words")
    pairs = near_pairs(words, block_chars)
    best = pairs.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("m"), F.col("near"))).alias("b"))
    out = words.join(best, "word", "left")
    has = F.col("n") * ratio <= -F.col("b.m")
    out = out.select(
        "word",
        F.when(has, F.col("b.near")).alias("form"),
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(has, -F.col("b.m")).cast("long").alias("form_n"),
    )
    out = materialise(out, "forms")
    # n grows by the ratio with each step, so chains are short; each round doubles the steps taken
    step = materialise(out.where("form is not null").select("word", F.col("form").alias("root")), "roots")
    while True:
        on = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        nxt = materialise(step.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        step = nxt.select("word", "root")
        if nxt.where("moved").isEmpty():
            break
    out = out.join(step, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
