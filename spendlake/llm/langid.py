"""Language ID by segmentation-marginalised unigrams (operator 4).

A language is a probability for each piece of a fixed public vocabulary. A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its
words. The piece probabilities are learned by expectation maximisation: words are counted once per
language, then each iteration distributes every word's count over its segmentations (forward-backward).
Words of equal length are scored together as one array.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_bytes, materialise, slices, sum_vectors

LETTERS = regex.compile(r"\p{L}+")
START = "▁"
#: Words of up to so many characters are summed in probabilities, which doubles hold for pieces of any table
#: (1e-18 to this power); longer ones in logarithms.
SHORT = 16
#: Characters of words that are scored together.
TOGETHER = 1 << 18
#: Leading bits of a piece's hash that are looked up before the hash itself.
SEEN_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
BLOCK = 1024


class Pieces:
    """The vocabulary's lower-case letter pieces by hash; one more index stands for any other letter."""

    def __init__(self, raw: bytes, max_piece: int | None = None):
        sp = sentencepiece.SentencePieceProcessor(model_proto=raw)
        texts = {sp.id_to_piece(i) for i in range(sp.vocab_size())}
        texts = {p for p in texts if (b := p.removeprefix(START)) == b.lower() and (not b or b.isalpha())}
        self.max_piece = max_piece or max(map(len, texts))
        self.texts = sorted(p for p in texts if 0 < len(p) <= self.max_piece)
        h = np.array([self.hash(p) for p in self.texts], np.uint64)
        self.order = np.argsort(h)
        self.keys = h[self.order]
        if len(np.unique(h)) != len(h):
            raise ValueError("two pieces share a hash")
        self.seen = np.zeros(1 << SEEN_BITS, bool)
        self.seen[self.keys >> np.uint64(64 - SEEN_BITS)] = True
        self.unknown = len(self.texts)
        self.none = self.unknown + 1
        # pieces of one letter by code point; the last place stands for all code points behind
        single = {ord(p): i for i, p in enumerate(self.texts) if len(p) == 1}
        self.letters = np.full(max(single, default=0) + 2, self.unknown, np.int64)
        self.letters[list(single)] = list(single.values())
        self.size = self.none + 1

    @staticmethod
    def hash(p: str) -> int:
        h = 0
        for c in p:
            h = (h * int(MULTIPLIER) + ord(c)) % 2**64
        return h

    def cover(self, codes: np.ndarray) -> Cover:
        """The pieces at all places of words of one length; a letter that is no piece is ``unknown``."""
        hits, h = [], codes
        for n in range(1, min(self.max_piece, codes.shape[1]) + 1):
            if n == 1:
                start, word = (x.ravel() for x in np.indices(h.shape[::-1]))
                hits.append((start, word, self.letters[np.minimum(h.T.ravel(), len(self.letters) - 1)]))
                continue
            h = h[:, :-1] * MULTIPLIER + codes[:, n - 1 :]
            start, word = np.nonzero(self.seen[h >> np.uint64(64 - SEEN_BITS)].T)
            mine = h[word, start]
            at = np.minimum(np.searchsorted(self.keys, mine), len(self.keys) - 1)
            found = self.keys[at] == mine
            hits.append((start[found], word[found], self.order[at[found]]))
        return Cover(len(codes), codes.shape[1], hits)


@dataclass
class Cover:
    """Pieces in words of one length: for each piece length the places that have one, by start."""

    words: int
    length: int
    hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]]

    def by_start(self) -> list[list[tuple[int, np.ndarray, np.ndarray]]]:
        """At each start the pieces' lengths, with the words that have one and which."""
        out: list[list] = [[] for _ in range(self.length)]
        for k, (start, word, piece) in enumerate(self.hits, 1):
            first = np.searchsorted(start, np.arange(self.length + 1))
            for i in np.unique(start).tolist():
                out[i].append((k, word[first[i] : first[i + 1]], piece[first[i] : first[i + 1]]))
        return out

    def dense(self, none: int) -> list[np.ndarray]:
        """For lengths 1, 2, ...: the piece at each start of each word, ``none`` where there is none."""
        out = []
        for k, (start, word, piece) in enumerate(self.hits, 1):
            at = np.full((self.words, self.length - k + 1), none, np.int32)
            at[word, start] = piece
            out.append(at)
        return out


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indices of words of one length, TOGETHER characters at once, and their code points with the start mark."""
    size = np.array([len(w) for w in words])
    for n in np.unique(size):
        same = np.flatnonzero(size == n)
        step = max(1, TOGETHER // int(n + 1))
        for i in range(0, len(same), step):
            at = same[i : i + step]
            codes = np.frombuffer("".join(START + words[j] for j in at).encode("utf-32-le"), "<u4")
            yield at, codes.reshape(len(at), n + 1).astype(np.uint64)


def forward(cover: Cover, n: int, prob: np.ndarray) -> np.ndarray:
    """Probability of each prefix, ``(words, n + 1, languages)``; ``prob`` is ``(pieces, languages)``."""
    alpha = np.zeros((n + 1, cover.words, prob.shape[1]))
    alpha[0] = 1
    for i, pieces in enumerate(cover.by_start()):
        for k, word, piece in pieces:
            alpha[i + k, word] += alpha[i, word] * prob[piece]
    return alpha.transpose(1, 0, 2)


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(1)
    return top + np.log(np.exp(x - top[:, None]).sum(1))


def log_forward(cover: Cover, n: int, logp: np.ndarray, none: int) -> np.ndarray:
    """Logarithm of ``forward``, of a word of any length; ``logp`` is that of its ``prob``."""
    cover = cover.dense(none)
    ends = np.full((len(cover[0]), n, len(cover)), none, np.int32)  # the pieces that end at each place
    for k, at in enumerate(cover):
        ends[:, k:, k] = at
    alpha = np.full((len(cover[0]), n + 1, logp.shape[1]), -np.inf)
    alpha[:, 0] = 0
    for i in range(1, n + 1):
        k = min(i, len(cover))
        alpha[:, i] = _log_sum(alpha[:, i - k : i][:, ::-1] + logp[ends[:, i - 1, :k]])
    return alpha


def log_backward(cover: Cover, n: int, logp: np.ndarray, none: int) -> np.ndarray:
    """Logarithm of each suffix's probability under one language, ``(words, n + 1)``."""
    cover = cover.dense(none)
    starts = np.full((len(cover[0]), n, len(cover)), none, np.int32)
    for k, at in enumerate(cover):
        starts[:, : n - k, k] = at
    beta = np.full((len(cover[0]), n + 1), -np.inf)
    beta[:, n] = 0
    for i in range(n - 1, -1, -1):
        k = min(n - i, len(cover))
        beta[:, i] = _log_sum(beta[:, i + 1 : i + k + 1] + logp[starts[:, i, :k]])
    return beta


def logarithm(prob: np.ndarray) -> np.ndarray:
    with np.errstate(divide="ignore"):
        return np.log(prob)


def log_probability(pieces: Pieces, codes: np.ndarray, prob: np.ndarray, logp: np.ndarray) -> np.ndarray:
    """Log probability of each word by language, ``(words, languages)``."""
    n, cover = codes.shape[1], pieces.cover(codes)
    if n <= SHORT:
        return np.log(forward(cover, n, prob)[:, n])
    out = np.empty((len(codes), prob.shape[1]))
    step = max(1, 8 * TOGETHER // codes.size)
    for i in range(0, prob.shape[1], step):
        out[:, i : i + step] = log_forward(cover, n, logp[:, i : i + step], pieces.none)[:, n]
    return out


def expected(pieces: Pieces, words: list[str], counts: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """Expected number of uses of each piece under one language's ``prob``."""
    total, logp = np.zeros(pieces.size), logarithm(prob)
    for at, codes in by_length(words):
        n, cover = codes.shape[1], pieces.cover(codes)
        if n > SHORT:
            alpha = log_forward(cover, n, logp[:, None], pieces.none)[:, :, 0]
            beta = log_backward(cover, n, logp, pieces.none)
            for k, (start, word, piece) in enumerate(cover.hits, 1):
                use = np.exp(alpha[word, start] + logp[piece] + beta[word, start + k] - alpha[word, n])
                total += np.bincount(piece, use * counts[at][word], pieces.size)
            continue
        places = cover.by_start()
        alpha = forward(cover, n, prob[:, None])[:, :, 0].T
        beta = np.zeros_like(alpha)
        beta[n] = 1
        for i in range(n - 1, -1, -1):
            for k, word, piece in places[i]:
                beta[i, word] += prob[piece] * beta[i + k, word]
        weight = counts[at] / alpha[n]
        for k, (start, word, piece) in enumerate(cover.hits, 1):
            use = weight[word] * alpha[start, word] * prob[piece] * beta[start + k, word]
            total += np.bincount(piece, use, pieces.size)
    total[pieces.none] = 0
    return total


def runs(text: str) -> list[str]:
    """The lower-case letter runs of a text."""
    return LETTERS.findall(text.lower())


def word_counts(docs: DataFrame, lang: Column, text: Column, held: int = 300_000) -> DataFrame:
    """``(lang, word, n)`` over all rows with a language; a task keeps ``held`` distinct entries at most."""
    src = docs.select(lang.alias("lang"), text.alias("content")).where("lang is not null and content is not null")

    def flush(seen: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for name, chunks in seen.items():
            words: Counter = Counter()
            for c, n in chunks.items():
                for w in runs(c):
                    words[w] += n
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())],
                names=["lang", "word", "n"],
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[str, Counter] = {}
        for b in slices(batches):
            for name, t in zip(b.column("lang").to_pylist(), b.column("content").to_pylist(), strict=True):
                seen.setdefault(name, Counter()).update(t.split())
            if sum(map(len, seen.values())) > held:
                yield from flush(seen)
                seen = {}
        yield from flush(seen)

    return src.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


@dataclass
class Model:
    """Languages with their share of documents and piece probabilities ``(pieces, languages)``."""

    langs: list[str]
    prior: np.ndarray
    prob: np.ndarray
    vocabulary: bytes
    max_piece: int | None
    cache_size: int = 200_000
    pieces: Pieces | None = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"pieces": None, "cache": None, "logp": None, "rows": None}

    def _ready(self) -> None:
        if self.pieces is None:
            self.pieces = Pieces(self.vocabulary, self.max_piece)
            self.logp = logarithm(self.prob)
            self.cache = None
        if self.cache is None or len(self.cache) > self.cache_size:
            self.cache, self.rows = {}, np.zeros((0, len(self.langs)))

    def _learn(self, words: list[str]) -> None:
        """Score new words: log probability by language."""
        if len(self.cache) + len(words) > len(self.rows):
            grown = np.zeros((2 * len(self.cache) + len(words), len(self.langs)))
            grown[: len(self.cache)] = self.rows[: len(self.cache)]
            self.rows = grown
        begin = len(self.cache)
        for at, codes in by_length(words):
            self.rows[begin + at] = log_probability(self.pieces, codes, self.prob, self.logp)
        self.cache.update(zip(words, range(begin, begin + len(words)), strict=True))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Most probable language and its posterior; ``und`` and 0 where there is no letter."""
        if not self.langs:
            return ["und"] * len(texts), np.zeros(len(texts))
        self._ready()
        parts = [runs(t) if t else [] for t in texts]
        if new := list(set().union(*parts).difference(self.cache)):
            self._learn(new)
        size = np.array([len(p) for p in parts], np.int64)
        use = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(parts)), np.int64, int(size.sum()))
        total = np.zeros((len(texts), len(self.langs)))
        some = np.flatnonzero(size)
        # the words of a text are added up some at a time, so that the sums' terms stay few
        for i in range(0, len(some), 64):
            at = some[i : i + 64]
            begin = int(size[: at[0]].sum())
            rows = self.rows[use[begin : begin + int(size[at].sum())]]
            total[at] = np.add.reduceat(rows, np.cumsum(size[at]) - size[at])
        score = total + np.log(self.prior)
        best = score.argmax(1)  # of equals the first in alphabetical order
        post = 1 / np.exp(score - score.max(1, keepdims=True)).sum(1)
        return [self.langs[k] if n else "und" for k, n in zip(best, size, strict=True)], np.where(size > 0, post, 0.0)


def train(
    docs: DataFrame,
    vocabulary_path: str,
    lang_col: str = "lang",
    text_col: str = "text",
    iterations: int = 2,
    max_piece: int | None = None,
    smoothing: float = 0.01,
    max_langs: int = 500,
) -> Model:
    """Learn a model from all rows of ``docs`` that have a text and a language.

    The driver gets ``languages x pieces`` doubles and no words; ``max_langs`` bounds the first factor
    (more is an error), the vocabulary the second. No training rows give a model that answers ``und``.
    Repeated rows count as often as they stand there. All of the vocabulary's pieces take part unless
    ``max_piece`` bounds their length, the start mark included.
    """
    spark = docs.sparkSession
    raw = file_bytes(vocabulary_path)
    pieces = Pieces(raw, max_piece)
    lang, text = F.col(lang_col), F.col(text_col)
    sizes = docs.where(lang.isNotNull() & text.isNotNull()).groupBy(lang.alias("l")).count().limit(max_langs + 1).collect()
    if len(sizes) > max_langs:
        raise ValueError(f"more than {max_langs} languages")
    sizes = sorted((r["l"], r["count"]) for r in sizes)
    langs = [name for name, _ in sizes]
    prior = np.array([n for _, n in sizes], float)
    prob = np.zeros((pieces.size, len(langs)))
    if langs:
        words = materialise(word_counts(docs, lang, text), "words")
        prob[: pieces.none] = 1 / pieces.none
        for _ in range(iterations):
            got = _expected_pieces(words, spark.sparkContext.broadcast((raw, max_piece, langs, prob)))
            counts = np.zeros_like(prob)
            for r in sum_vectors(got, ["lang", "block"]).collect():
                v = np.frombuffer(r["vec"])
                counts[r["block"] * BLOCK : r["block"] * BLOCK + len(v), langs.index(r["lang"])] = v
            counts[: pieces.none] += smoothing
            prob = counts / counts.sum(0)
    return Model(langs, prior / max(prior.sum(), 1), prob, raw, max_piece)


def _expected_pieces(words: DataFrame, state) -> DataFrame:
    """Each task's expected piece counts by language, in blocks of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw, max_piece, langs, prob = state.value
        pieces = Pieces(raw, max_piece)
        total: dict[str, np.ndarray] = {}
        for b in slices(batches, 50_000):
            names, text, n = (b.column(c).to_pylist() for c in ("lang", "word", "n"))
            groups: dict[str, list[int]] = {}
            for i, name in enumerate(names):
                groups.setdefault(name, []).append(i)
            for name, at in groups.items():
                got = expected(pieces, [text[i] for i in at], np.array([n[i] for i in at], float), prob[:, langs.index(name)])
                total[name] = total.get(name, 0) + got
        for name, v in total.items():
            parts = [v[i : i + BLOCK].tobytes() for i in range(0, len(v), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(parts)), pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())],
                names=["lang", "block", "vec"],
            )

    return words.mapInArrow(run, "lang string, block int, vec binary")


def predict(
    docs: DataFrame,
    model: Model,
    text_col: str = "text",
    lang_out: str = "lang_pred",
    score_out: str = "score",
    keep_text: bool = False,
) -> DataFrame:
    """``docs`` without its text (unless ``keep_text``), plus the predicted language and its posterior probability.

    ``und`` with score 0 where the text is null or has no letter. Every row gets a prediction from its
    text alone; columns named like the outputs are replaced, others pass through. No shuffle.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    left_out = (lang_out, score_out) if keep_text else (text_col, lang_out, score_out)
    keep = [c for c in docs.columns if c not in left_out]
    docs = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, text_col])])
    fields = [T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            langs, score = shared.value.predict(b.column(text_col).to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*[b.column(c) for c in keep], pa.array(langs, pa.string()), pa.array(score)],
                names=[*keep, lang_out, score_out],
            )

    return docs.mapInArrow(run, T.StructType([*[docs.schema[c] for c in keep], *fields]))
