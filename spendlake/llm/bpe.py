"""BPE encoding and decoding in batched numpy merge rounds (operator 1).

The vocabulary file is a public word-level BPE: NFC, white space to one blank, lower case, a split
pattern, bytes as symbols and a word-end mark on the last symbol. Text is cut at white space; every
distinct piece of text is normalised, split into words and encoded once per cache generation. The
symbols of all new words lie in one flat array; a round finds each adjacent pair by binary search over
the sorted pair keys, takes the lowest rank of each word and merges all places that have it.

Merging all places of a word's lowest pair at once is the same as one at a time when no merge that
uses a token ranks before the merge that makes it; ``Bpe`` checks this of its table and otherwise
merges only the leftmost place per round.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import file_bytes, slices

#: Fixed value: the split pattern of the vocabulary file, matched on normalised text.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")
#: str.split() also splits at these four controls, which are no white space in Unicode.
CONTROLS = re.compile("[\x1c-\x1f]")
PIECES = regex.compile(r"[^\p{White_Space}]+")
NONE = np.iinfo(np.int32).max


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAC + 1), *range(0xAE, 0xFF + 1)]
    out, extra = [""] * 256, 0
    for b in shown:
        out[b] = chr(b)
    for b in range(256):
        if not out[b]:
            out[b], extra = chr(256 + extra), extra + 1
    return out


class Bpe:
    """Merge tables of a vocabulary file, and a cache of encoded pieces of text, bounded in pieces and characters."""

    def __init__(self, raw: bytes, cache_size: int = 200_000, cache_chars: int = 4 << 20):
        spec = json.loads(raw)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        end = spec["model"]["end_of_word_suffix"] or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for t, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = t
        chars = byte_symbols()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + end] for c in chars], np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        keys = left << 32 | right
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks, self.made = keys[order], order.astype(np.int32), made[order]
        born = np.full(len(self.tokens), -1, np.int64)
        np.maximum.at(born, made, np.arange(len(made)))
        self.at_once = bool((np.maximum(born[left], born[right]) < np.arange(len(made))).all())
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.cache_size, self.cache_chars = cache_size, cache_chars
        self._clear()

    def _clear(self) -> None:
        self.cache: dict[str, int] = {}
        self.chars = 0
        self.ids = np.zeros(1 << 16, np.int32)
        self.ends = np.zeros(1 << 14, np.int64)  # where each piece's ids end; the next one's begin there

    def _append(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        n = len(self.cache)
        used = int(self.ends[n - 1]) if n else 0
        if used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[:used], np.zeros(used + len(ids), np.int32)])
        if n + len(pieces) > len(self.ends):
            self.ends = np.concatenate([self.ends[:n], np.zeros(n + len(pieces), np.int64)])
        self.ids[used : used + len(ids)] = ids
        self.ends[n : n + len(pieces)] = used + np.cumsum(sizes)
        self.cache.update(zip(pieces, range(n, n + len(pieces)), strict=True))
        self.chars += sum(map(len, pieces))

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of non-empty words, and how many each has."""
        size = np.array([len(w) for w in words], np.int64)
        data = np.frombuffer(b"".join(words), np.uint8)
        sym, word = self.inner[data], np.repeat(np.arange(len(words)), size)
        ends = np.cumsum(size) - 1
        sym[ends] = self.last[data[ends]]
        done_sym, done_word = [], []
        while len(sym):
            key = sym[:-1] << 32 | sym[1:]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            hit = (self.keys[at] == key) & (word[:-1] == word[1:])
            rank = np.append(np.where(hit, self.ranks[at], NONE), NONE)
            first = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            count = np.diff(np.r_[first, len(word)])
            best = np.repeat(np.minimum.reduceat(rank, first), count)
            over = best == NONE
            done_sym.append(sym[over])
            done_word.append(word[over])
            chosen = (rank == best) & ~over
            place = np.flatnonzero(chosen)
            if len(place):
                # of pairs that overlap (a a a) every second one, from the left of each run
                if self.at_once:
                    run = np.r_[True, np.diff(place) != 1]
                    start = np.maximum.accumulate(np.where(run, np.arange(len(place)), 0))
                    place = place[(np.arange(len(place)) - start) % 2 == 0]
                else:
                    place = place[np.r_[True, word[place[1:]] != word[place[:-1]]]]
                sym[place] = self.made[at[place]]
                keep = ~over
                keep[place + 1] = False
                sym, word = sym[keep], word[keep]
            else:
                break
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order].astype(np.int32), np.bincount(word, minlength=len(words))

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pieces of text (no white space inside) into the cache."""
        words: list[bytes] = []
        per_piece = np.zeros(len(pieces), np.int64)
        for i, p in enumerate(pieces):
            found = WORDS.findall(unicodedata.normalize("NFC", p).replace("Σ", "σ").lower())
            per_piece[i] = len(found)
            words += [w.encode() for w in found]
        ids, size = self.encode_words(words) if words else (np.zeros(0, np.int32), np.zeros(0, np.int64))
        total = np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(per_piece)]]
        self._append(pieces, ids, np.diff(total))

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all texts, and how many each has."""
        if len(self.cache) > self.cache_size or self.chars > self.cache_chars:
            self._clear()
        parts: list[list[str]] = []
        for t in texts:
            cut = self.split.split(t) if self.split and any(s in t for s in self.special) else [t]
            found: list[str] = []
            for c in cut:
                if c in self.special:
                    found.append(c)
                elif CONTROLS.search(c):
                    found += PIECES.findall(c)
                else:
                    found += c.split()
            parts.append(found)
        new = list(set().union(*parts).difference(self.cache))
        if marks := [s for s in new if s in self.special]:
            self._append(marks, np.array([self.special[s] for s in marks], np.int32), np.ones(len(marks), np.int64))
        if new := [p for p in new if p not in self.special]:
            self._learn(new)
        count = np.array([len(f) for f in parts], np.int64)
        use = np.fromiter(map(self.cache.__getitem__, chain.from_iterable(parts)), np.int64, int(count.sum()))
        begins = np.where(use > 0, self.ends[use - 1], 0)
        n = self.ends[use] - begins
        shift = np.repeat(begins - (np.cumsum(n) - n), n)
        ids = self.ids[np.arange(len(shift)) + shift]
        upto = np.r_[0, np.cumsum(n)][np.cumsum(np.r_[0, count])]
        return ids, np.diff(upto)


_LOADED: dict[int, Bpe] = {}


def _bpe(raw: bytes) -> Bpe:
    """One table per Python worker and file, so the cache outlives a task."""
    key = hash(raw)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Bpe(raw)
    return _LOADED[key]


def _decoded(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False)
    offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
    return pc.binary_join(pa.ListArray.from_arrays(offsets, pc.take(tokens, pc.list_flatten(ids))), " ")


def encode(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """``docs`` without ``text_col``, plus ``ids_col`` array<int>: the ids of the whole text. With
    ``decoded_col`` also what ``decode`` makes of them, in the same pass: one Python worker a task, not two.

    A null text counts as empty and gives no ids. Other columns pass through, repeated rows too; a
    column that already has the name ``ids_col`` is replaced. Text never leaves its task: no shuffle.
    Special strings of the file inside a text become their ids, as its library does by default.
    """
    raw = docs.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))
    added = [ids_col] + ([decoded_col] if decoded_col else [])
    keep = [c for c in docs.columns if c not in (text_col, *added)]
    docs = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col(text_col), F.lit("")).alias(text_col))
    kinds = [T.ArrayType(T.IntegerType()), T.StringType()]
    schema = T.StructType([*[docs.schema[c] for c in keep], *[T.StructField(c, k) for c, k in zip(added, kinds, strict=False)]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(raw.value)
        tokens = pa.array(bpe.tokens) if decoded_col else None
        for b in slices(batches):
            ids, size = bpe.encode(b.column(text_col).to_pylist())
            offsets = pa.array(np.r_[0, np.cumsum(size)].astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
            out = [lists, _decoded(lists, tokens)] if decoded_col else [lists]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], *out], names=[*keep, *added])

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, tokenizer_path: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``encoded`` plus ``out_col``: the tokens of the ids joined by blanks, special tokens kept.

    This is the library's result for a file without a decoder: word-end marks and byte characters stay.
    Null ids give an empty text; an id outside the vocabulary is an error.
    """
    raw = encoded.sparkSession.sparkContext.broadcast(file_bytes(tokenizer_path))
    keep = [c for c in encoded.columns if c != out_col]
    encoded = encoded.select(*[F.col(f"`{c}`") for c in keep])
    schema = T.StructType([*encoded.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = pa.array(_bpe(raw.value).tokens)
        for b in slices(batches):
            text = _decoded(b.column(ids_col), tokens)
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], text], names=[*keep, out_col])

    return encoded.mapInArrow(run, schema)
