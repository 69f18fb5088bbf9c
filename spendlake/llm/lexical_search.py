"""Ranked lexical search of many items at once, by shared subexpressions (operator 11).

An item's score of a document is a sum over the item's terms, so items with terms in common repeat each
other's work. The sums are therefore planned before they are evaluated. Terms that the same items hold
equally often are one node. Within each item the nodes stand in order of support; neighbours that several
items have in common are joined to a new node, round after round, until no two items share a pair. The
result is a graph in which every node is the sum of earlier ones and an item the sum of few.

Documents are cut into terms once and keep only the frequencies of the items' terms. Then a block of
documents at a time, each node's partial score is accumulated once for the whole block and used by all
nodes and items above it. A task keeps each item's best documents and hands on only those.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import materialise, slices

#: ASCII other than letters and digits separates terms; A-Z become a-z; all other code points are letters.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))
NO_ID = 2**63 - 1
#: Different terms of the items of one shard, counted once per item; a larger item is a shard of its own.
SHARD_ENTRIES = 1 << 17
#: Accumulators (nodes x documents) that a task holds at once.
HELD_SUMS = 1 << 21


def terms(text: bytes | None) -> list[bytes]:
    """The terms of a text (UTF-8) in order; none where it is null."""
    return (text or b"").translate(FOLD).split()


@dataclass
class Plan:
    """A graph of shared sums: node i < len(terms) is a term's weight, later ones are sums of earlier ones."""

    terms: list[bytes]
    items: list
    #: Per level: the nodes that each new node adds up, as flat indices and the place where each begins.
    levels: list[tuple[np.ndarray, np.ndarray]]
    #: The same for the items' totals.
    totals: tuple[np.ndarray, np.ndarray]
    n_nodes: int
    #: Additions per document without sharing, and with it.
    plain: int
    shared: int


def _flat(parts: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    size = np.array([len(p) for p in parts], np.int64)
    return np.array([n for p in parts for n in p], np.int64), np.cumsum(size) - size


def build_plan(bags: list[tuple[object, dict[bytes, int]]]) -> Plan:
    """Mine the shared term sets of items ``(id, {term: count})``; items without terms are left out."""
    bags = [(i, b) for i, b in bags if b]
    names = sorted({t for _, b in bags for t in b})
    place = {t: i for i, t in enumerate(names)}
    holders: dict[int, list[tuple[int, int]]] = {}
    for at, (_, bag) in enumerate(bags):
        for t, n in bag.items():
            holders.setdefault(place[t], []).append((at, n))
    # terms with the same holders and counts are one node
    same: dict[tuple, list[int]] = {}
    for t, who in sorted(holders.items()):
        same.setdefault(tuple(who), []).append(t)
    nodes, made, support = len(names), [], {}
    lists: list[list[int]] = [[] for _ in bags]
    for who, members in sorted(same.items(), key=lambda x: (-len(x[0]), x[1])):
        node = members[0]
        if len(members) > 1:
            node, nodes = nodes, nodes + 1
            made.append(members)
        support[node] = len(who)
        for at, n in who:
            lists[at] += [node] * n
    levels = [_flat(made)] if made else []
    plain = sum(sum(b.values()) for _, b in bags)
    work = sum(map(len, made))
    while True:
        pairs = Counter(p for x in lists for p in {*zip(x, x[1:], strict=False)})
        pairs = {p: n for p, n in pairs.items() if n > 1}
        if not pairs:
            break
        made, new = [], {}
        for x in lists:
            # the pairs that most items share first, no node in two of them
            best = sorted((-pairs[p], i) for i, p in enumerate(zip(x, x[1:], strict=False)) if p in pairs)
            used, take = set(), {}
            for _, i in best:
                if i not in used and i + 1 not in used:
                    used |= {i, i + 1}
                    p = (x[i], x[i + 1])
                    if p not in new:
                        new[p] = nodes + len(made)
                        made.append(list(p))
                    take[i] = new[p]
            x[:] = [take.get(i, n) for i, n in enumerate(x) if i in take or i not in used]
        nodes += len(made)
        levels.append(_flat(made))
        work += 2 * len(made)
    return Plan(names, [i for i, _ in bags], levels, _flat(lists), nodes, plain, work + sum(map(len, lists)))


def evaluate(plan: Plan, leaves: np.ndarray) -> np.ndarray:
    """Totals ``(items, documents)`` from the terms' values ``(terms, documents)``, each node added up once."""
    acc = np.zeros((plan.n_nodes, leaves.shape[1]), np.int64)
    acc[: len(leaves)] = leaves
    at = len(leaves)
    for parts, begin in plan.levels:
        acc[at : at + len(begin)] = np.add.reduceat(acc[parts], begin, axis=0)
        at += len(begin)
    parts, begin = plan.totals
    return np.add.reduceat(acc[parts], begin, axis=0)


class Best:
    """Each item's best documents so far: highest score first, of equals the smaller id."""

    def __init__(self, n_items: int, k: int):
        self.k = k
        self.rows = np.zeros((0, 3), np.int64)  # item, score, doc_id
        self.least = np.ones(n_items, np.int64)  # what a document must score to matter

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        item, doc = np.nonzero(scores >= self.least[:, None])
        if not len(item):
            return
        rows = np.concatenate([self.rows, np.c_[item, scores[item, doc], ids[doc]]])
        rows = rows[np.lexsort((rows[:, 2], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], np.arange(len(self.least)))
        place = np.arange(len(rows)) - first[rows[:, 0]]
        self.rows = rows[place < self.k]
        last = rows[place == self.k - 1]
        self.least[last[:, 0]] = last[:, 1]


def _bags(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """``(item, low, entries, terms, counts)``: each item's terms, ``low`` the smallest of their hashes."""
    src = items.select(F.col(item_col).alias("item"), F.col(text_col).cast("binary").alias("content"))
    schema = T.StructType([src.schema["item"], T.StructField("term", T.BinaryType()), T.StructField("count", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            for i, t in enumerate(b.column("content").to_pylist()):
                if found := Counter(terms(t)):
                    item = pa.DictionaryArray.from_arrays(pa.array([0] * len(found), pa.int32()), b.column("item").slice(i, 1)).dictionary_decode()
                    yield pa.RecordBatch.from_arrays([item, pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=schema.names)

    one = src.mapInArrow(run, schema).groupBy("item", "term").agg(F.sum("count").alias("count"))
    bags = one.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "count"))).alias("bag"))
    low = F.array_min(F.transform("bag.term", lambda t: F.xxhash64(t)))
    return bags.select("item", low.alias("low"), F.size("bag").alias("entries"), F.col("bag.term").alias("terms"), F.col("bag.count").alias("counts"))


def shards(items: DataFrame, item_col: str = "item_id", text_col: str = "text", entries: int = SHARD_ENTRIES) -> Iterator[Plan]:
    """The items' plans, each of so many entries at most; items that share their rarest hash lie together.

    The driver holds one plan at a time, which is what a task gets.
    """
    bags = materialise(_bags(items, item_col, text_col), "item-terms")
    total = bags.agg(F.sum("entries").alias("s")).first()["s"]
    if not total:
        return
    schema = bags.select("item", F.lit(0).alias("shard"), "terms", "counts").schema

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard = held = 0
        for b in batches:
            mine = []
            for n in b.column("entries").to_pylist():
                if held and held + n > entries:
                    shard, held = shard + 1, 0
                held += n
                mine.append(shard)
            yield pa.RecordBatch.from_arrays([b.column("item"), pa.array(mine, pa.int32()), b.column("terms"), b.column("counts")], names=schema.names)

    parts = -(-total // entries)
    dealt = bags.repartitionByRange(parts, "low", "item").sortWithinPartitions("low", "item").mapInArrow(deal, schema)
    dealt = materialise(dealt.withColumn("task", F.spark_partition_id()), "item-shards")
    at = F.struct("task", "shard")
    # tasks may hold little: neighbours are packed to full shards, each from its first part to its last
    packs: list[list] = []
    for r in dealt.groupBy(at.alias("at")).agg(F.sum(F.size("terms")).alias("n")).orderBy("at").collect():
        if packs and packs[-1][2] + r["n"] <= entries:
            packs[-1][1:] = [r["at"], packs[-1][2] + r["n"]]
        else:
            packs.append([r["at"], r["at"], r["n"]])
    for first, last, _ in packs:
        low, high = (F.struct(F.lit(x["task"]).alias("task"), F.lit(x["shard"]).alias("shard")) for x in (first, last))
        rows = dealt.where((at >= low) & (at <= high)).collect()
        bag = [(x["item"], {bytes(t): n for t, n in zip(x["terms"], x["counts"], strict=True)}) for x in rows]
        yield build_plan(sorted(bag, key=lambda x: (x[0] is None, x[0])))


def frequencies(docs: DataFrame, plan_terms: list[bytes], id_col: str, text_col: str) -> DataFrame:
    """``(did, n, at array<int>, tf array<long>)`` of each row with a term: its length in terms, and which of
    ``plan_terms`` it holds how often."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(plan_terms)
    src = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("did"), F.col(text_col).cast("binary").alias("content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {t: i for i, t in enumerate(shared.value)}
        for b in slices(batches):
            keep, size, at, tf, upto = [], [], [], [], [0]
            for t in b.column("content").to_pylist():
                words = terms(t)
                keep.append(bool(words))
                if words:
                    found = Counter(filter(place.__contains__, words))
                    size.append(len(words))
                    at += map(place.__getitem__, found)
                    tf += found.values()
                    upto.append(len(at))
            ids = b.column("did").filter(pa.array(keep, pa.bool_()))
            offsets = pa.array(upto, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(at, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(tf, pa.int64()))]
            yield pa.RecordBatch.from_arrays([ids, pa.array(size, pa.int64()), *lists], names=["did", "n", "at", "tf"])

    return src.mapInArrow(run, "did long, n long, at array<int>, tf array<long>")


def _statistics(freq: DataFrame, n_terms: int) -> tuple[int, int, np.ndarray]:
    """Documents, all their terms, and the documents of each plan term."""
    sums = freq.agg(F.count(F.lit(1)).alias("n"), F.sum("n").alias("l")).first()
    df = np.zeros(n_terms, np.int64)
    for r in freq.select(F.explode("at").alias("t")).groupBy("t").count().toLocalIterator():
        df[r["t"]] = r["count"]
    return sums["n"], sums["l"] or 0, df


def weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for d in df.tolist()], np.int64)


def _ranked(freq: DataFrame, plan: Plan, item_type: T.DataType, k: int) -> DataFrame:
    """``(item, score, did)``: the best documents of each task."""
    spark = freq.sparkSession
    n_docs, n_all, df = _statistics(freq, len(plan.terms))
    shared = spark.sparkContext.broadcast((plan, weights(n_docs, df)))
    arrow_type = to_arrow_type(item_type)
    step = max(1, HELD_SUMS // max(1, plan.n_nodes + len(plan.totals[0])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, w = shared.value
        best = Best(len(plan.items), k)
        for b in slices(batches, step, 1 << 30):
            ids, n = b.column("did").to_numpy(), b.column("n").to_numpy()
            at, tf = (b.column(c).flatten().to_numpy() for c in ("at", "tf"))
            size = np.diff(b.column("at").offsets.to_numpy())
            doc = np.repeat(np.arange(len(ids)), size)
            m = 25 + 75 * n * n_docs // n_all
            leaves = np.zeros((len(plan.terms), len(ids)), np.int64)
            leaves[at, doc] = w[at] * (1_000_000_000 * tf // (1000 * tf + 8 * m[doc]))
            best.add(evaluate(plan, leaves), ids)
        item = pa.array([plan.items[i] for i in best.rows[:, 0]], arrow_type)
        yield pa.RecordBatch.from_arrays([item, pa.array(best.rows[:, 1].copy()), pa.array(best.rows[:, 2].copy())], names=["item", "score", "did"])

    schema = T.StructType([T.StructField("item", item_type), T.StructField("score", T.LongType()), T.StructField("did", T.LongType())])
    return freq.where(F.size("at") > 0).mapInArrow(run, schema)


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    entries: int = SHARD_ENTRIES,
) -> DataFrame:
    """``(item_col, rank, id_col, score)``: each item's ``k`` best rows of ``docs`` with a score above 0.

    Terms are maximal runs of ASCII letters and digits and of all code points from U+0080, A-Z in lower
    case. N rows have a term, L terms in all, n in one row; a term occurs in df rows, tf times in one. Its
    weight is ``w = floor(1000 ln((2N + 2) / (2df + 1)))``, a row's ``m = 25 + (75 n N) div L``, its score
    the sum of ``w ((10^9 tf) div (1000 tf + 8 m))`` over the item's terms, repeats included. Higher scores
    come first, equal ones by ascending id.

    The items are the query set; they are answered in shards of ``entries`` terms, one pass over the
    documents each. Null and empty texts have no terms: such documents are not counted, such items get no
    rows. Repeated rows of ``docs`` are documents of their own and rank next to each other; a null id comes
    after all others of the same score. Rows of ``items`` with the same id are one item, to which all their
    terms belong; a null id is an id like others. Empty tables give no rows; other columns are not read.
    """
    spark = docs.sparkSession
    item_type = items.schema[item_col].dataType
    out = None
    for plan in shards(items, item_col, item_text_col, entries):
        freq = materialise(frequencies(docs, plan.terms, id_col, text_col), "frequencies")
        part = materialise(_ranked(freq, plan, item_type, k), "ranked")
        out = part if out is None else out.unionByName(part)
    if out is None:
        out = spark.createDataFrame([], T.StructType([T.StructField("item", item_type), T.StructField("score", T.LongType()), T.StructField("did", T.LongType())]))
    order = Window.partitionBy("item").orderBy(F.desc("score"), "did")
    out = out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select(F.col("item").alias(item_col), "rank", F.when(F.col("did") != NO_ID, F.col("did")).alias(id_col), "score")
