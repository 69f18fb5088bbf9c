"""N-gram Jaccard join with token-combination prefixes (operator 2).

Documents are sets of hashed word shingles; equal sets are one class. Shingles are ordered rare ones
first, frequent ones last. A set of n shingles whose partner has at least ``lo`` may lack at most
tau = n - ceil(t (n + lo) / (1 + t)) of its shingles in it, so among any prefix from which tau can be
taken away without emptying it, the pair shares something. Rare shingles are indexed singly. Frequent
ones are divided into groups and indexed as pairs within a group; a group of c shingles counts c - 1, so
the prefix is extended until singles plus groups count tau + 1: whatever tau shingles are missing, one
rare shingle or two of one group are left. Sizes fall into bands of ratio t, and an index key belongs to
one band and the next smaller, which keeps ``lo`` close to n.

A key's sets are compared by parity bitmaps, whose Hamming distance never exceeds the size of the
symmetric difference, so the filter drops no link. First every set is verified against its nearest
neighbour; what that connects need not be compared again. Then the other pairs that share a key, pass
the filter and lie in different components are verified, last those of keys that many sets have, so no
link between components is lost. The rows of a key that very many sets have lie in blocks of bounded
length in order of size, and each pair of blocks is a task's work of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.sizing import bounded_broadcast
from .common import connected_components, materialise, slices

U = np.uint64
GOLD = U(0x9E3779B97F4A7C15)
NO_ID = 2**63 - 1
SLOT_BITS = 22
SLOT_BLOCK = 1 << 16
#: From this size on a band's frequent shingles are indexed as pairs.
PAIRS_FROM = 16
#: Sets before it in order of size that a set is first compared with under each key.
NEIGHBOURS = 64
#: Rows of one key that are held at once; a key of more is divided into blocks of so many at most.
KEY_BLOCK = 1 << 14
#: Lists that a document's partners are divided into while they are merged.
LOTS = 16
#: Keys to divide that are broadcast; more of them meet their rows by a shuffle.
MAX_HOT_KEYS = 1 << 21
#: Shingles that a task gathers before it counts them.
HELD_SLOTS = 1 << 20
#: Candidate pairs that a task gathers before it hands them on.
HELD_PAIRS = 1 << 20


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix finaliser)."""
    h = h ^ (h >> U(30))
    h *= U(0xBF58476D1CE4E5B9)
    h ^= h >> U(27)
    h *= U(0x94D049BB133111EB)
    h ^= h >> U(31)
    return h


_BLANK = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))
_MASKS = np.array([(1 << 8 * i) - 1 for i in range(8)] + [2**64 - 1], U)
#: Words of more bytes are hashed one by one.
LONG_WORD = 512


def word_hashes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words of all texts, A-Z in lower case, and where each text's words end.

    Words are taken eight bytes at a time, all words together.
    """
    raw = b" ".join(t or b"" for t in texts).lower() + b" " * 8
    data = np.frombuffer(raw, np.uint8)
    blank = _BLANK[data]
    edge = np.flatnonzero(blank[1:] != blank[:-1]) + 1
    if not blank[0]:
        edge = np.r_[0, edge]
    start, size = edge[::2], edge[1::2] - edge[::2]
    eight = np.ndarray((len(data) - 7,), "<u8", raw, strides=(1,))  # the eight bytes from every place on
    h = size.astype(U)
    on = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(on):
        part = eight[start[on] + at] & _MASKS[np.minimum(size[on] - at, 8)]
        h[on] = mix(h[on] * GOLD + part)
        at += 8
        on = on[size[on] > at]
    for i in np.flatnonzero(size > LONG_WORD):
        h[i] = xxhash.xxh3_64_intdigest(raw[start[i] : start[i] + size[i]])
    upto = np.cumsum([len(t or b"") + 1 for t in texts])
    return h, np.searchsorted(start, upto)


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each whole text (UTF-8); those of all texts are mixed at once."""
    if not texts:
        return []
    h, ends = word_hashes(texts)
    whole = _shingles(h, k)
    out, begin = [], 0
    for end in ends.tolist():
        n = end - begin
        s = np.sort(whole[begin : end - k + 1]) if n >= k else _shingles(h[begin:end], n)
        out.append(s if len(s) < 2 else s[np.r_[True, s[1:] != s[:-1]]])
        begin = end
    return out


def _shingles(h: np.ndarray, size: int) -> np.ndarray:
    if not size or len(h) < size:
        return np.zeros(0, U)
    s = np.full(len(h) - size + 1, size, U)
    for i in range(size):
        s *= GOLD
        s += h[i : len(h) - size + 1 + i]
        s = mix(s)
    return s


def shingle_set(text: str | None, k: int) -> np.ndarray:
    """That of one text."""
    return shingle_sets([(text or "").encode()], k)[0]


def slot(tokens: np.ndarray) -> np.ndarray:
    return (mix(tokens) >> U(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class Plan:
    """Threshold num / den of at least a half, and what follows from it for each size."""

    k: int
    num: int
    den: int

    def __post_init__(self):
        if 2 * self.num < self.den:
            raise ValueError("the threshold must be a half or more")
        self.bounds = [1]
        while self.bounds[-1] < 1 << 32:
            self.bounds.append(self.bounds[-1] * self.den // self.num + 1)
        self.edges = np.array(self.bounds)

    def linked(self, common: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * common >= self.num * (n + m - common)

    def tags(self, n: int) -> Iterator[tuple[int, int]]:
        """(band of the key, shingles that a partner under it may lack)."""
        band = int(np.searchsorted(self.edges, n, "right")) - 1
        least = max(-(-self.num * n // self.den), self.bounds[max(band - 1, 0)])
        for tag, lo in ((band, least), (band + 1, self.bounds[band + 1])):
            tau = n + -(self.num * (n + lo)) // (self.num + self.den)
            if tau >= 0:
                yield tag, tau

    def groups(self, tag: int) -> int:
        """Groups of frequent shingles under a band's keys; 0: they are indexed singly."""
        s = self.bounds[tag]
        return 0 if s < PAIRS_FROM else max(1, (self.den - self.num) * s // self.den // 4)

    def keys(self, tokens: np.ndarray, frequent: np.ndarray) -> np.ndarray:
        """Index keys of a set (tokens sorted) given its frequent ones."""
        out = []
        for tag, tau in self.tags(len(tokens)):
            groups = self.groups(tag)
            rare = tokens if not groups else tokens[~frequent]
            if len(rare) > tau:
                keys = rare[: tau + 1]
            else:
                keys = np.concatenate([rare, self._pairs(tokens[frequent], groups, tau + 1 - len(rare))])
            out.append(mix(keys + U((tag + 1) * int(GOLD) % 2**64)))
        return np.concatenate(out) if out else np.zeros(0, U)

    @staticmethod
    def _pairs(often: np.ndarray, groups: int, count: int) -> np.ndarray:
        """Keys of the pairs within groups, over the shortest prefix that counts ``count``."""
        group = (often >> U(4)) % U(groups)
        first = np.zeros(len(often), bool)
        first[np.unique(group, return_index=True)[1]] = True
        upto = int(np.searchsorted(np.cumsum(~first), count)) + 1
        often, group = often[:upto], group[:upto]
        order = np.argsort(group, kind="stable")
        often, group = often[order], group[order]
        found = [np.zeros(0, U)]
        for j in range(1, len(often)):
            same = group[j:] == group[:-j]
            if not same.any():
                break
            found.append(mix(often[:-j][same] * GOLD ^ often[j:][same]))
        return np.concatenate(found)


def bitmap(tokens: np.ndarray) -> bytes:
    """Parity of the tokens in each of 128 to 2,048 places, about one place a token."""
    bits = min(2048, max(128, 1 << int(len(tokens) - 1).bit_length()))
    at = (mix(tokens ^ GOLD) & U(bits - 1)).astype(np.int64)
    return np.packbits(np.bincount(at, minlength=bits) & 1).tobytes()


def fold(raw: bytes, size: int) -> np.ndarray:
    """A bitmap brought to ``size`` bytes: places that fall together add their parities."""
    v = np.frombuffer(raw, np.uint8)
    return np.bitwise_xor.reduce(v.reshape(-1, size), 0) if len(v) > size else v


def pack(tokens: np.ndarray) -> bytes:
    """The upper 48 bits of each token, sorted; what verification compares."""
    return np.ascontiguousarray((tokens >> U(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    v = np.zeros((len(raw) // 6, 8), np.uint8)
    v[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return v.view("<u8").ravel()


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(text_col).cast("binary").alias("content"))


def _digest(tokens: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(xxhash.xxh3_128_digest(tokens.tobytes()), np.int64).tolist())


def _first_scan(src: DataFrame, k: int) -> DataFrame:
    """A row (did, d1, d2, n) per document, and each task's shingle counts by hashed slot, at most 255."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(1 << SLOT_BITS, np.int64)
        names = ["did", "d1", "d2", "n", "block", "vec"]
        any_row, held = False, []
        for b in slices(batches):
            any_row = True
            sets = shingle_sets(b.column("content").to_pylist(), k)
            held += sets
            if sum(map(len, held)) > HELD_SLOTS:
                slots += np.bincount(slot(np.concatenate(held)), minlength=len(slots))
                held = []
            d1, d2, n = zip(*[(*_digest(s), len(s)) for s in sets], strict=True)
            none = pa.nulls(len(sets), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [b.column("did"), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(n, pa.int64()), none, pa.nulls(len(sets), pa.binary())],
                names=names,
            )
        if held:
            slots += np.bincount(slot(np.concatenate(held)), minlength=len(slots))
        if any_row:
            parts = np.minimum(slots, 255).astype(np.uint8).reshape(-1, SLOT_BLOCK)
            for i, p in enumerate(parts):
                none = [pa.nulls(1, pa.int64())] * 4
                yield pa.RecordBatch.from_arrays([*none, pa.array([i], pa.int32()), pa.array([p.tobytes()], pa.binary())], names=names)

    return src.mapInArrow(run, "did long, d1 long, d2 long, n long, block int, vec binary")


def _frequent_slots(vectors: DataFrame) -> bytes:
    """One bit per slot: set where its count stands out from what rare shingles add up to.

    The driver gets the summed counts, 2^SLOT_BITS of them however large the input.
    """

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOT_BLOCK, np.uint32)
        for b in batches:
            for x in b.column("vec"):
                total += np.frombuffer(x.as_buffer(), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["block", "vec"])

    counts = np.zeros(1 << SLOT_BITS, np.uint32)
    for r in vectors.groupBy("block").applyInArrow(add, "block int, vec binary").toLocalIterator():
        counts[r["block"] * SLOT_BLOCK : (r["block"] + 1) * SLOT_BLOCK] = np.frombuffer(r["vec"], np.uint32)
    mean = counts.mean()
    return np.packbits(counts > mean + 4 + 5 * np.sqrt(mean)).tobytes()


def _index_rows(src: DataFrame, plan: Plan, frequent: bytes) -> DataFrame:
    """``(did, d1, n, keys array<long>)`` of every document that has shingles."""
    shared = src.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for b in slices(batches):
            rows, keys = [], [np.zeros(0, U)]
            sets = shingle_sets(b.column("content").to_pylist(), plan.k)
            for did, s in zip(b.column("did").to_pylist(), sets, strict=True):
                if len(s):
                    keys.append(plan.keys(s, often[slot(s)]))
                    rows.append((did, *_digest(s), len(s)))
            if not rows:
                continue
            cols = [pa.array(c, pa.int64()) for c in zip(*rows, strict=True)]
            offsets = pa.array(np.cumsum([len(x) for x in keys]).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(keys).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*cols, lists], names=["did", "d1", "d2", "n", "keys"])

    return src.mapInArrow(run, "did long, d1 long, d2 long, n long, keys array<long>")


def _runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that never cut a run of equal keys apart; the input is sorted by key."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(key).to_numpy()
        cut = int(np.searchsorted(k == k[-1], True))
        if held and cut == 0 and held[-1].column(key)[-1].as_py() == k[0]:
            held.append(b)
            continue
        if held or cut:
            yield pa.Table.from_batches([*held, b.slice(0, cut)])
        held = [b.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def _hot_keys(index: DataFrame, block: int) -> DataFrame:
    """The keys (key) that about ``block`` sets or more have, found in a part of the documents by hash.

    This only chooses which keys are divided: all rows of a key stay, however it is counted.
    """
    share = max(1, min(64, block // 128))
    some = index.where(F.pmod(F.xxhash64("did"), F.lit(share)) == 0).select(F.explode("keys").alias("key"))
    return materialise(some.groupBy("key").count().where(F.col("count") * share >= block).select("key"), "hot-keys")


def _hot_blocks(rows: DataFrame, block: int) -> DataFrame:
    """``(key, did, n, block)``: the rows (key, did, n) in order of size, no more than ``block`` to a block.

    Rows are dealt out by ranges, so a key's rows spread over tasks; a block lies in one of them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, last, length = TaskContext.get().partitionId() << 32, None, 0
        for b in batches:
            key = b.column("key").to_numpy()
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else []
            out = np.zeros(len(key), np.int64)
            for s, e in zip(start, np.r_[start[1:], len(key)], strict=True):
                if key[s] != last:
                    at, last, length = at + 1, key[s], 0
                place = length + np.arange(e - s)
                out[s:e] = at + place // block
                at, length = at + (length + int(e - s) - 1) // block, (length + int(e - s) - 1) % block + 1
            yield b.append_column("block", pa.array(out))

    rows = materialise(rows, "hot-rows")
    dealt = rows.repartitionByRange("key", "n", "did").sortWithinPartitions("key", "n", "did")
    return materialise(dealt.mapInArrow(run, "key long, did long, n long, block long"), "hot-blocks")


def _shared_keys(index: DataFrame, block: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows (key, did, m) whose key m sets have, more than one, without the keys that very many sets
    have; and the rows (key, did, n, block) of those, if there are any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "key"):
            t = t.combine_chunks()
            k = t.column("key").to_numpy()
            start = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
            m = np.diff(np.r_[start, len(k)])
            t = t.append_column("m", pa.array(np.repeat(m, m).astype(np.int32)))
            yield from t.filter(pa.array(np.repeat(m > 1, m))).to_batches()

    keyed = index.select(F.explode("keys").alias("key"), "did", "n")
    hot = _hot_keys(index, block)
    blocks = None
    if not hot.isEmpty():
        hot = bounded_broadcast(hot, MAX_HOT_KEYS)
        blocks = _hot_blocks(keyed.join(hot, "key", "left_semi"), block)
        keyed = keyed.join(hot, "key", "left_anti")
    keyed = keyed.select("key", "did").repartition("key").sortWithinPartitions("key")
    return materialise(keyed.mapInArrow(run, "key long, did long, m int"), "shared-keys"), blocks


def _block_pairs(rows: DataFrame, plan: Plan) -> DataFrame:
    """``(block, key, side)``: the pairs of a key's blocks that may hold a link between components, each
    under a key of its own, its first block as side 0, its second as side 1; a block's pair with itself
    is its side 0 alone. ``rows`` has (key, n, block, comp)."""
    one = rows.groupBy("key", "block").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("comp").alias("first"), F.max("comp").alias("last")
    )
    one = materialise(one, "blocks")
    two = one.select("key", *[F.col(c).alias(f"{c}2") for c in ("block", "lo", "hi", "first", "last")])
    pairs = one.join(two, "key").where("block <= block2")
    pairs = pairs.where((plan.den * F.col("hi") >= plan.num * F.col("lo2")) & (plan.den * F.col("hi2") >= plan.num * F.col("lo")))
    pairs = pairs.where(F.least("first", "first2") != F.greatest("last", "last2"))
    pairs = pairs.select(F.xxhash64("block", "block2").alias("key"), "block", "block2")
    second = pairs.where("block < block2").select(F.col("block2").alias("block"), "key", F.lit(1).alias("side"))
    return pairs.select("block", "key", F.lit(0).alias("side")).unionByName(second)


def _place(did: str) -> Column:
    return F.pmod(F.xxhash64(did), F.lit(1 << SLOT_BITS))


def _marked(ids: DataFrame):
    """A broadcast bitmap of 2^SLOT_BITS hashed places, set where ``ids`` (did) has one."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << SLOT_BITS, bool)
        for b in batches:
            bits[b.column("p").to_numpy()] = True
        if bits.any():
            yield pa.RecordBatch.from_arrays([pa.array([np.packbits(bits).tobytes()], pa.binary())], names=["vec"])

    want = np.zeros((1 << SLOT_BITS) // 8, np.uint8)
    for r in ids.select(_place("did").alias("p")).distinct().coalesce(16).mapInArrow(mark, "vec binary").toLocalIterator():
        want |= np.frombuffer(r["vec"], np.uint8)
    return ids.sparkSession.sparkContext.broadcast(want.tobytes())


def _sets(src: DataFrame, k: int, wanted: DataFrame) -> DataFrame:
    """``(did, n, bits, tokens)`` of the wanted documents and of a few that share their hashed places.

    The places skip most other documents before their sets are built; joins behind it are exact.
    """
    shared = _marked(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for b in slices(batches):
            b = b.filter(pa.array(want[b.column("p").to_numpy()]))
            rows = []
            sets = shingle_sets(b.column("content").to_pylist(), k)
            for did, s in zip(b.column("did").to_pylist(), sets, strict=True):
                if len(s):
                    rows.append((did, len(s), bitmap(s), pack(s)))
            if rows:
                kinds = [pa.int64()] * 2 + [pa.binary()] * 2
                cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(cols, names=["did", "n", "bits", "tokens"])

    return src.select("did", _place("did").alias("p"), "content").mapInArrow(run, "did long, n long, bits binary, tokens binary")


def _by_key(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", *first, "n", "did")


def _bits(raw: list[bytes]) -> np.ndarray:
    width = min(map(len, raw))
    return np.array([fold(x, width) for x in raw]).view(np.uint64)


def _distance(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def _may_link(plan: Plan, dist, n, m):
    """Symmetric difference of a linked pair: n + m - 2 o, with o >= t (n + m) / (1 + t)."""
    return dist * (plan.num + plan.den) <= (plan.den - plan.num) * (n + m)


def _nearest(keyed: DataFrame, plan: Plan) -> DataFrame:
    """``(b, a, dist, partners)``: for each row (key, did, n, bits) those of the NEIGHBOURS sets before it
    in order of size under its key that may link, and the nearest of them.

    Under a key of no more than NEIGHBOURS + 1 sets these are all pairs; under others only the nearest
    is a partner.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "key"):
            t = t.combine_chunks()
            key, did, n = (t.column(c).to_numpy() for c in ("key", "did", "n"))
            raw = t.column("bits").to_pylist()
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found = [np.zeros((0, 3), np.int64)]
            for s, e in zip(start, np.r_[start[1:], len(key)], strict=True):
                bits, m, mine = _bits(raw[s:e]), e - s, []
                for j in range(1, min(NEIGHBOURS, m - 1) + 1):
                    dist, at = _distance(bits[j:], bits[:-j]), np.arange(s + j, e)
                    use = _may_link(plan, dist, n[at], n[at - j]) & (did[at] != did[at - j])
                    if use.any():
                        mine.append(np.c_[did[at[use]], dist[use], did[at[use] - j]])
                if mine:
                    mine = np.unique(np.concatenate(mine), axis=0)  # by document, the nearest first
                    nearest = np.r_[True, mine[1:, 0] != mine[:-1, 0]]
                    found.append(mine if m <= NEIGHBOURS + 1 else mine[nearest])
            rows = np.unique(np.concatenate(found), axis=0)
            if len(rows):
                first = np.flatnonzero(np.r_[True, rows[1:, 0] != rows[:-1, 0]])
                lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(rows)].astype(np.int32)), pa.array(rows[:, 2].copy()))
                cols = [pa.array(rows[first, c].copy()) for c in (0, 2, 1)]
                yield pa.RecordBatch.from_arrays([*cols, lists], names=["b", "a", "dist", "partners"])

    return _by_key(keyed).mapInArrow(run, "b long, a long, dist long, partners array<long>")


def _crossing(keyed: DataFrame, plan: Plan) -> DataFrame:
    """``(a, b)``: all pairs of different components among the rows (key, did, n, bits, comp, side) of a
    key that may link, each once; where a key has rows of side 1, the pairs of one of each side.

    A task hands on a document's partners as lists, so pairs that meet under many keys stay numbers in a list
    until the lists are merged; partners lie in LOTS lots by hash, each with a list of its own.
    """

    def hand_on(found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        if len(pairs):
            lot = (mix(pairs[:, 1].astype(U)) % U(LOTS)).astype(np.int64)
            order = np.lexsort((lot, pairs[:, 0]))
            pairs, lot = pairs[order], lot[order]
            first = np.flatnonzero(np.r_[True, (pairs[1:, 0] != pairs[:-1, 0]) | (lot[1:] != lot[:-1])])
            lists = pa.ListArray.from_arrays(pa.array(np.r_[first, len(pairs)].astype(np.int32)), pa.array(pairs[:, 1].copy()))
            yield pa.RecordBatch.from_arrays([pa.array(pairs[first, 0].copy()), pa.array(lot[first]), lists], names=["a", "lot", "partners"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, "key"):
            t = t.combine_chunks()
            key, did, n, comp, side = (t.column(c).to_numpy() for c in ("key", "did", "n", "comp", "side"))
            raw = t.column("bits").to_pylist()
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            found, held = [np.zeros((0, 2), np.int64)], 0
            for s, e in zip(start, np.r_[start[1:], len(key)], strict=True):
                if (comp[s:e] == comp[s]).all():
                    continue
                bits, m, ns = _bits(raw[s:e]), e - s, n[s:e]
                second = int(np.searchsorted(side[s:e], 1))  # the first row of side 1, if there is one
                for i in range(0, second, 128):
                    if held > HELD_PAIRS:
                        yield from hand_on(found)
                        found, held = [np.zeros((0, 2), np.int64)], 0
                    for j in range(i if second == m else second, m, 1024):
                        dist = _distance(bits[i : i + 128, None], bits[None, j : j + 1024])
                        x, y = np.nonzero(_may_link(plan, dist, ns[i : i + 128, None], ns[None, j : j + 1024]))
                        x, y = x + i + s, y + j + s
                        use = (x < y) & (comp[x] != comp[y]) & ((second == m) | (x < s + second))
                        found.append(np.c_[did[y[use]], did[x[use]]])
                        held += int(use.sum())
            yield from hand_on(found)

    lists = _by_key(keyed, "side").mapInArrow(run, "a long, lot long, partners array<long>")
    merged = lists.groupBy("a", "lot").agg(F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners"))
    return merged.select("a", F.explode("partners").alias("b"))


def _verify(pairs: DataFrame, sets: DataFrame, plan: Plan) -> DataFrame:
    """The pairs ``(a, b)`` whose sets really link; only sets in a pair are shuffled."""
    pairs = materialise(pairs.select("a", "b"), "candidates")
    ids = pairs.select(F.col("a").alias("did")).unionByName(pairs.select(F.col("b").alias("did"))).distinct()
    shared = _marked(ids)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        want = np.unpackbits(np.frombuffer(shared.value, np.uint8)).astype(bool)
        for b in batches:
            yield b.filter(pa.array(want[b.column("p").to_numpy()])).select(["did", "tokens"])

    some = sets.select("did", _place("did").alias("p"), "tokens").mapInArrow(pick, "did long, tokens binary")
    one = some.select(F.col("did").alias("a"), F.col("tokens").alias("ta"))
    two = some.select(F.col("did").alias("b"), F.col("tokens").alias("tb"))
    both = pairs.join(two, "b").join(one, "a").select("a", "b", "ta", "tb")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 256):
            keep = []
            for x, y in zip(b.column("ta").to_pylist(), b.column("tb").to_pylist(), strict=True):
                x, y = unpack(x), unpack(y)
                keep.append(bool(plan.linked(len(np.intersect1d(x, y, assume_unique=True)), len(x), len(y))))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return materialise(both.mapInArrow(run, "a long, b long"), "links")


def _joined(comp: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components ``(id, component)`` of the links together with those found before."""
    edges = links if comp is None else links.unionByName(comp.select(F.col("id").alias("a"), F.col("component").alias("b")))
    return materialise(connected_components(edges), "components")


def _component_of(rows: DataFrame, comp: DataFrame, did: str, name: str) -> DataFrame:
    named = comp.select(F.col("id").alias(did), F.col("component").alias("__c"))
    return rows.join(named, did, "left").withColumn(name, F.coalesce("__c", did)).drop("__c")


def components(
    docs: DataFrame,
    k: int = 4,
    num: int = 85,
    den: int = 100,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = KEY_BLOCK,
) -> DataFrame:
    """``(id_col, n_shingles, component_id)``, one row per row of ``docs``.

    Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z in lower case; a document's set is its distinct ``k``-word
    shingles, with fewer words the whole sequence as one. Two documents link when
    ``den * intersection >= num * union``; ``component_id`` is the smallest id reachable by links.
    ``num / den`` is at least a half. ``block`` bounds the rows of one key that a task holds, twice over.

    Null, empty and blank texts have no set and link with nothing. Rows of one id are one document: texts
    of the same id are connected. A null id comes after all others: such rows share a component, which
    is null if it holds no other id. Repeated rows each get a row. An empty table gives no rows; other
    columns are not read.
    """
    plan = Plan(k, num, den)
    src = _source(docs, id_col, text_col)
    first = materialise(_first_scan(src, k), "shingle-counts")
    frequent = _frequent_slots(first.where("block is not null").select("block", "vec"))
    ids = first.where("block is null").select("did", "d1", "d2", "n")
    some = ids.where("n > 0")
    classes = materialise(some.groupBy("d1", "d2").agg(F.min("did").alias("did")), "classes")
    index = _index_rows(src, plan, frequent).join(classes, ["did", "d1", "d2"])
    shared, hot = _shared_keys(materialise(index.select("did", "n", "keys"), "index"), block)
    keyed = shared.select("key", "did")
    if hot is not None:
        keyed = keyed.unionByName(hot.select(F.xxhash64("block").alias("key"), "did"))
    sets = materialise(_sets(src, k, keyed.select("did")), "sets")
    bits = sets.select("did", "n", "bits")
    near = _nearest(keyed.join(bits, "did"), plan).groupBy("b").agg(
        F.min(F.struct("dist", "a")).alias("s"), F.array_distinct(F.flatten(F.collect_list("partners"))).alias("partners")
    )
    near = materialise(near, "nearest")
    # an id with several texts connects their classes
    several = some.groupBy("did").agg(F.min(F.struct("d1", "d2")).alias("x"), F.max(F.struct("d1", "d2")).alias("y"))
    several = several.where("x <> y").select("did")
    twice = some.join(several, "did", "left_semi").join(classes.withColumnRenamed("did", "rep"), ["d1", "d2"])
    twice = twice.select(F.col("did").alias("a"), F.col("rep").alias("b"))
    # the nearest neighbour of each set, then the others, then all pairs of the keys that many sets have,
    # each only where the components found so far differ
    best = near.select(F.col("s.a").alias("a"), "b")
    comp = _joined(None, _verify(best, sets, plan).unionByName(twice))
    pairs = near.select("b", F.explode("partners").alias("a"))
    others = _component_of(_component_of(pairs, comp, "a", "ca"), comp, "b", "cb")
    comp = _joined(comp, _verify(others.where("ca <> cb"), sets, plan))
    mine = _component_of(shared.where(F.col("m") > NEIGHBOURS + 1).select("key", "did"), comp, "did", "comp")
    mine = mine.withColumn("side", F.lit(0))
    if hot is not None:
        rows = materialise(_component_of(hot, comp, "did", "comp"), "hot-components")
        sides = _block_pairs(rows, plan)
        mine = mine.unionByName(rows.select("did", "block", "comp").join(sides, "block").drop("block"))
    comp = _joined(comp, _verify(_crossing(mine.join(bits, "did"), plan), sets, plan))
    named = classes.select("d1", "d2", F.col("did").alias("rep")).join(comp, F.col("rep") == F.col("id"), "left")
    named = named.select("d1", "d2", F.coalesce("component", "rep").alias("component"))
    out = ids.join(named, ["d1", "d2"], "left").select("did", "n", F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("did")).alias("component"))
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return out.select(real("did").alias(id_col), F.col("n").alias("n_shingles"), real("component").alias("component_id"))
