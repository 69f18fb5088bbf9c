"""Benchmark decontamination by BM25 with block-max WAND (operator 3).

Benchmark items form an inverted index; every passage of every document is a query against it. An
item's impacts are its BM25 term weights divided by the least total that a passage holding the required
share of its word shingles can have, so the retrieval threshold is 1 for all items and retrieval loses
no item that verification would accept. Blocks of the postings keep their largest impact: the words of
a whole document give an upper bound per block for all its passages, only blocks that reach 1 are
scored, and only documents with a scored item are cut into passages. Retrieved items are verified by
the overlap of question and answer shingles with the passage.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices, unique_name

WORD = re.compile(r"\w+")
SHINGLE = 5
EPS = 1e-9
LEAK = "struct<item_id:bigint,score:double,question_overlap:double,answer_overlap:double,passage:int>"


def words(text: str | None) -> list[str]:
    return WORD.findall((text or "").lower())


def shingles(ids: list) -> set[tuple]:
    """Distinct runs of SHINGLE words; a shorter sequence is one shingle, an empty one none."""
    if len(ids) < SHINGLE:
        return {tuple(ids)} if ids else set()
    return set(zip(*(ids[i:] for i in range(SHINGLE)), strict=False))


def _gather(begin: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """Positions of all postings of ``terms`` in a list with offsets ``begin``."""
    n = begin[terms + 1] - begin[terms]
    return np.arange(n.sum()) + np.repeat(begin[terms] - (np.cumsum(n) - n), n)


@dataclass
class Index:
    """Inverted index of items ``(item_id, question, answer or None)``."""

    items: list[tuple]
    overlap: float = 0.8
    k1: float = 1.2
    b: float = 0.75
    block: int = 16
    cache_size: int = 300_000
    cache: dict = field(default_factory=dict, repr=False)

    def __post_init__(self):
        parts = [(i, words(q), words(a)) for i, q, a in self.items]
        # neighbours in a block are alike: by length, then text
        parts = sorted((p for p in parts if p[1] or p[2]), key=lambda p: (len(p[1]) + len(p[2]), p[1], p[2]))
        self.vocab: dict[str, int] = {}
        self.ids, self.shingles, rows = [], [], []
        for k, (i, q, a) in enumerate(parts):
            q, a = ([self.vocab.setdefault(w, len(self.vocab)) for w in x] for x in (q, a))
            self.ids.append(i)
            self.shingles.append((shingles(q), shingles(a)))
            term, tf = np.unique(q + a, return_counts=True)
            rows.append((np.full(len(term), k), term, tf))
        self.size = len(parts)
        if not parts:
            return
        length = np.array([len(q) + len(a) for _, q, a in parts])
        self.longest = int(length.max())
        item, term, tf = (np.concatenate(x) for x in zip(*rows, strict=True))
        df = np.bincount(term, minlength=len(self.vocab))
        idf = np.log1p((self.size - df + 0.5) / (df + 0.5))
        norm = self.k1 * (1 - self.b + self.b * length[item] / length.mean())
        impact = idf[term] * tf * (self.k1 + 1) / (tf + norm)
        self.total = np.bincount(item, impact, self.size)
        # a passage that lacks more word places than shingles it may lack holds too few shingles
        lack = [sum(int((1 - self.overlap) * len(s) + EPS) for s in both) for both in self.shingles]
        self.least = np.zeros(self.size)
        for k in range(self.size):
            mine = np.sort(impact[item == k])
            self.least[k] = max(mine[: len(mine) - lack[k]].sum(), mine[0])
        order = np.lexsort((item, term))
        self.post_item, self.post_term = item[order], term[order]
        self.impact = (impact / self.least[item])[order]
        self.begin = np.searchsorted(self.post_term, np.arange(len(self.vocab) + 1))
        blk = self.post_item // self.block
        first = np.flatnonzero(np.r_[True, (blk[1:] != blk[:-1]) | (self.post_term[1:] != self.post_term[:-1])])
        self.blk, self.blk_max = blk[first], np.maximum.reduceat(self.impact, first)
        self.blk_begin = np.searchsorted(self.post_term[first], np.arange(len(self.vocab) + 1))
        self.n_blocks = -(-self.size // self.block)

    def read(self, text: str) -> np.ndarray:
        """Word ids of a text in the index's vocabulary, -1 outside it."""
        chunks = text.split()
        if len(self.cache) > self.cache_size:
            self.cache.clear()
        for c in set(chunks):
            if c in self.cache:
                continue
            ids = [self.vocab.get(w, -1) for w in words(c)]
            self.cache[c] = ids[0] if len(ids) == 1 else ids
        found = [self.cache[c] for c in chunks]
        if any(type(x) is list for x in found):
            found = [y for x in found for y in (x if type(x) is list else [x])]
        return np.array(found, np.int64)

    def retrieve(self, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Items whose score for these distinct words reaches their threshold, and the scores."""
        at = _gather(self.blk_begin, terms)
        bound = np.bincount(self.blk[at], self.blk_max[at], self.n_blocks)
        if bound.max() < 1 - EPS:
            return np.zeros(0, int), np.zeros(0)
        at = _gather(self.begin, terms)
        at = at[bound[self.post_item[at] // self.block] >= 1 - EPS]
        score = np.bincount(self.post_item[at], self.impact[at], self.size)
        hit = np.flatnonzero(score >= 1 - EPS)
        return hit, score[hit]

    def leaks(self, text: str | None) -> list[dict]:
        """Verified items of a text, one entry per item id: that of its best passage, the first of equals."""
        if not self.size or not text:
            return []
        ids = self.read(text)
        terms = np.unique(ids)
        terms = terms[terms >= 0]
        if not len(terms) or not len(self.retrieve(terms)[0]):
            return []
        # passages overlap by half and are twice as long as the longest item, so none is cut apart
        best: dict = {}
        for start in range(0, max(1, len(ids) - self.longest), self.longest):
            passage = ids[start : start + 2 * self.longest]
            terms = np.unique(passage)
            hit, score = self.retrieve(terms[terms >= 0]) if terms[-1] >= 0 else ((), ())
            have = shingles(passage.tolist()) if len(hit) else set()
            for k, s in zip(hit, score, strict=True):
                # a part shorter than a shingle is looked for as it stands
                q, a = (self._share(x, have, passage) for x in self.shingles[k])
                if q >= self.overlap - EPS and a >= self.overlap - EPS:
                    got = {"item_id": self.ids[k], "score": float(s * self.least[k] / self.total[k]), "question_overlap": q, "answer_overlap": a, "passage": start}
                    old = best.get(self.ids[k])
                    if old is None or (q, a, got["score"]) > (old["question_overlap"], old["answer_overlap"], old["score"]):
                        best[self.ids[k]] = got
        return sorted(best.values(), key=lambda x: (x["item_id"] is not None, x["item_id"] or 0))

    @staticmethod
    def _share(part: set[tuple], have: set[tuple], passage: np.ndarray) -> float:
        if not part:
            return 1.0
        if len(part) == 1 and len(one := next(iter(part))) < SHINGLE:
            windows = np.lib.stride_tricks.sliding_window_view(passage, len(one)) if len(passage) >= len(one) else np.zeros((0, len(one)))
            return float((windows == np.array(one)).all(1).any())
        return len(part & have) / len(part)


def sentences(item: str = "text") -> list:
    """Question and answer of an item that is one text: the last sentence is the answer.

    A text of one sentence is all question.
    """
    text = F.trim(F.col(item))
    answer = F.regexp_extract(text, r"(?s)[.!?]\s+([^.!?]*(?:[.!?](?=\S)[^.!?]*)*[.!?]*)$", 1)
    question = F.when(F.length(answer) > 0, F.substring(text, F.lit(1), F.length(text) - F.length(answer))).otherwise(text)
    return [question.alias("question"), F.when(F.length(answer) > 0, answer).alias("answer")]


def annotate(
    docs: DataFrame,
    items: DataFrame,
    overlap: float = 0.8,
    text_col: str = "text",
    out_col: str = "leaks",
    shard_bytes: int = 32 << 20,
) -> DataFrame:
    """``docs`` plus ``out_col``: array of the items it leaks, empty where it is clean.

    ``items`` has item_id, question and answer (answer may be null). An item leaks into a document if
    one passage holds at least ``overlap`` of the question's and of the answer's 5-word shingles; words
    are ``\\w+`` in lower case. Entries carry item_id, score (share of the item's own BM25 total),
    both overlaps and the word position of the passage.

    Indexes are broadcast, each of at most ``shard_bytes`` of item text (one item may be larger); more
    items mean more passes over the documents, in shards by hash of the id. Null or empty documents and
    items without words leak nothing; rows of one item id count as one item each and share an entry;
    repeated documents are judged one by one. A column named ``out_col`` is replaced. No shuffle.
    """
    items = items.select(F.col("item_id").cast("long").alias("item_id"), "question", "answer")
    size = F.octet_length(F.concat_ws(" ", "question", "answer"))
    total = items.agg(F.sum(size).alias("n")).first()["n"] or 0
    shards = int(total // shard_bytes) + 1
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c != out_col])
    name = unique_name(docs, "shard_leaks")
    leaks = F.array().cast(f"array<{LEAK}>")
    base = docs.columns
    parts = []
    for k in range(shards):
        own = items if shards == 1 else items.where(F.pmod(F.xxhash64("item_id"), F.lit(shards)) == k)
        index = Index([tuple(r) for r in own.collect()], overlap)
        docs = _scan(docs, index, text_col, f"{name}_{k}")
        parts.append(F.col(f"{name}_{k}"))
    return docs.select(*[F.col(f"`{c}`") for c in base], F.concat(leaks, *parts).alias(out_col))


def _scan(docs: DataFrame, index: Index, text_col: str, out: str) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)
    leak = T.ArrayType(T._parse_datatype_string(LEAK))
    kind = pa.list_(
        pa.struct([("item_id", pa.int64()), ("score", pa.float64()), ("question_overlap", pa.float64()), ("answer_overlap", pa.float64()), ("passage", pa.int32())])
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            found = [shared.value.leaks(t) for t in b.column(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(out, leak)]))
