"""Histogram gradient boosting on Spark, with squared or Tweedie loss (M2, M4), and target statistics (M3).

Features are cut into quantile bins once. A tree grows level by level: every task adds up, for each open
node, feature and bin, the gradients and curvatures of its rows; the sums of all tasks are one small array
per node, from which the driver takes the best splits and the Newton values of the leaves. So a level is one
pass over the binned rows, whatever their number, and nothing but sums leaves a task. Of two children only the
one with fewer rows is summed; the other's sums are what it leaves of their parent's. The working table holds
some thousand rows as one packed row, feature by feature, so a pass costs no work per row outside numpy; packed
rows are an RDD of bytes, which reach a task without being turned into columns and back. Each tree is added to
the rows once, in the first pass of the next one, and kept; scores are written back to cut lineage every few trees.

The Tweedie loss with variance power ``p`` in (1, 2) has a log link: the score is the logarithm of the mean,
zero amounts are allowed, and predictions are positive.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel
from pyspark.sql import DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.joins import null_safe_join
from ..functions.sizing import bounded_broadcast
from ..session import cut_lineage, written

#: Trees after which the rows' scores are written back.
WRITE_EVERY = 25
#: Tasks whose sums the driver adds up itself; those of more tasks are summed by node in Spark first.
DIRECT_TASKS = 32
#: Binned rows of a partition of the working table, about; a task holds some blocks of them at a time.
PARTITION_ROWS = 1 << 23
#: Fewer rows than this are not split further to give every core a task.
SPREAD_ROWS = 1 << 15
#: Binned rows of a packed row, about.
BLOCK_ROWS = 1 << 15
#: Rows whose sums a task takes at once (more where the sums are large), and cells up to which it takes two features together.
SUM_ROWS = 1 << 16
PAIR_CELLS = 1 << 17
#: Up to so many rows lie in one partition, and its task grows all trees from its own sums, without a pass each.
ONE_TASK_ROWS = 1 << 16


@dataclass
class Tree:
    """A tree of depth d in heap order: node i has the children 2i+1 and 2i+2; rows with a bin of the node's
    feature up to ``bin`` go left. ``feature`` -1 marks a leaf, whose ``value`` counts."""

    feature: np.ndarray
    bin: np.ndarray
    value: np.ndarray

    def node_of(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        for _ in range(int(np.log2(len(self.feature) + 1)) - 1):
            f = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(f, 0)] > self.bin[at]
            at = np.where(f >= 0, 2 * at + 1 + right, at)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.node_of(bins)]


@dataclass
class Model:
    features: list[str]
    edges: list[np.ndarray]
    base: float
    loss: str
    trees: list[Tree] = field(default_factory=list)

    def bins(self, x: np.ndarray) -> np.ndarray:
        """Bin numbers ``(rows, features)``: values up to the first edge are 0; a missing value is a bin of its own, the last."""
        out = np.empty(x.shape, np.uint8)
        for j, e in enumerate(self.edges):
            out[:, j] = np.where(np.isnan(x[:, j]), len(e) + 1, np.searchsorted(e, x[:, j], "left"))
        return out

    def raw(self, bins: np.ndarray, trees: int | None = None) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for t in self.trees[:trees]:
            out += t.predict(bins)
        return out

    def staged(self, bins: np.ndarray, at: Sequence[int]) -> list[np.ndarray]:
        """Predictions after each of the numbers of trees in ``at``, ascending, from one run through the trees."""
        raw, out, done = np.full(len(bins), self.base), [], 0
        for n in at:
            for t in self.trees[done:n]:
                raw = raw + t.predict(bins)
            done = n
            out.append(self.link(raw))
        return out

    def link(self, raw: np.ndarray) -> np.ndarray:
        return np.exp(raw) if self.loss == "tweedie" else raw


def gradients(loss: str, power: float, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of half the unit deviance by the score."""
    if loss == "squared":
        return raw - y, np.ones_like(y)
    a, b = np.exp((1 - power) * raw), np.exp((2 - power) * raw)
    return b - y * a, (2 - power) * b + (power - 1) * y * a


def tweedie_deviance(y: np.ndarray, mu: np.ndarray, power: float = 1.5) -> float:
    """Mean unit deviance."""
    p = power
    return float(np.mean(2 * (np.power(y, 2 - p) / ((1 - p) * (2 - p)) - y * np.power(mu, 1 - p) / (1 - p) + np.power(mu, 2 - p) / (2 - p))))


def best_splits(hist: np.ndarray, l2: float, min_weight: float, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of each node (feature or -1, bin, left sums, right sums) from ``hist`` (nodes, features, bins, 3), whose
    last axis sums gradient, curvature and rows. Equal gains: the first feature, the lowest bin."""
    left = np.cumsum(hist, axis=2)[:, :, :-1]
    total = hist.sum(2)[:, :, None]
    right = total - left

    def score(s: np.ndarray) -> np.ndarray:
        return s[..., 0] ** 2 / (s[..., 1] + l2)

    gain = score(left) + score(right) - score(total)
    ok = (left[..., 1] >= min_weight) & (right[..., 1] >= min_weight) & (left[..., 2] > 0) & (right[..., 2] > 0)
    gain = np.where(ok & allowed[None, :, None], gain, -np.inf).reshape(len(hist), -1)
    # sums of doubles in another order differ in their last digits: gains so close count as equal
    top = gain.max(1)
    near = gain >= (top - 1e-9 * np.maximum(np.abs(top), 1.0))[:, None]
    at = near.argmax(1)
    f, b = np.divmod(at, hist.shape[2] - 1)
    rows = np.arange(len(hist))
    feature = np.where(top > 1e-12, f, -1)
    return feature, b, left[rows, f, b], right[rows, f, b]


def fit(
    rows: DataFrame,
    features: Sequence[str],
    label: str = "y",
    loss: str = "tweedie",
    power: float = 1.5,
    trees: int = 100,
    depth: int = 4,
    rate: float = 0.1,
    bins: int = 64,
    l2: float = 1.0,
    min_weight: float = 1e-3,
    row_share: float = 1.0,
    column_share: float = 1.0,
    seed: int = 42,
) -> Model:
    """Boosted trees on all rows of ``rows`` that have a label.

    ``features`` are numeric columns; a null is a bin of its own. ``row_share`` of the rows and
    ``column_share`` of the features, drawn anew for each tree by ``seed``, grow it. The driver holds the
    bin edges, the trees and one level's sums: 2^depth x features x bins numbers, whatever the input.
    """
    if loss not in ("tweedie", "squared"):
        raise ValueError(f"unknown loss {loss!r}")
    if not 1 < power < 2:
        raise ValueError("the variance power lies between 1 and 2")
    if not (1 <= depth <= 12 and 2 <= bins <= 250 and 0 < row_share <= 1 and 0 < column_share <= 1 and trees >= 0):
        raise ValueError("a parameter is out of its range")
    features = list(features)
    src = rows.where(F.col(label).isNotNull()).select(F.col(label).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    stats = src.agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("m"), F.min("y").alias("lo")).first()
    if not stats["n"]:
        raise ValueError("no rows with a label")
    if loss == "tweedie" and (stats["lo"] < 0 or stats["m"] <= 0):
        raise ValueError("Tweedie loss takes labels of 0 and more, not all of them 0")
    probs = [i / bins for i in range(1, bins)]
    cuts = src.approxQuantile([f"f{i}" for i in range(len(features))], probs, 1 / (20 * bins))
    edges = [np.unique(np.array(c, float)) for c in cuts]
    model = Model(features, edges, float(np.log(stats["m"]) if loss == "tweedie" else stats["m"]), loss)
    parts = 1 if stats["n"] <= ONE_TASK_ROWS else _partitions(stats["n"], rows.sparkSession.sparkContext.defaultParallelism)
    width = max(len(e) for e in edges) + 2
    state = _binned(src, model, parts)
    rng, draws = np.random.default_rng(seed), []
    for _ in range(trees):
        allowed = np.zeros(len(features), bool)
        allowed[rng.permutation(len(features))[: max(1, round(column_share * len(features)))]] = True
        draws.append((allowed, int(rng.integers(2**31))))
    if parts == 1:
        model.trees = _fit_here(state, draws, width, loss, power, depth, rate, l2, min_weight, row_share)
        return model
    blocks = state.rdd
    for k, (allowed, draw) in enumerate(draws):
        before = blocks
        if k:  # filled by the first level's pass, read by the others
            blocks = _add_tree(blocks, len(features), model.trees[-1])
            if k % WRITE_EVERY == 0:
                blocks.checkpoint()
        else:
            blocks = blocks.map(_block)
        blocks.persist(KEEP)
        gradient = _Drawn(loss, power, row_share, draw)
        model.trees.append(_grow(_Levels(blocks, gradient, allowed, parts, width), depth, rate, l2, min_weight, allowed))
        if k:
            before.unpersist()
    if draws:
        blocks.unpersist()
    return model


def _partitions(rows: int, cores: int) -> int:
    """Partitions of PARTITION_ROWS at most, about; as many as give each of the cores the same number of them."""
    parts = max(2, -(-rows // PARTITION_ROWS))
    return max(parts, min(cores, rows // SPREAD_ROWS)) if parts < cores else -(-parts // cores) * cores


def _drawn(rid: np.ndarray, draw: int, row_share: float) -> np.ndarray:
    """Whether a tree's draw takes each row."""
    h = (rid.view(np.uint64) ^ np.uint64(draw)) * np.uint64(0x9E3779B97F4A7C15)
    return (h >> np.uint64(44)).astype(np.int64) < int(row_share * (1 << 20))


def _fit_here(state: DataFrame, draws: list, width: int, loss: str, power: float, depth: int, rate: float, l2: float, min_weight: float, row_share: float) -> list[Tree]:
    """All trees from the one partition of ``state``, ONE_TASK_ROWS rows at most."""
    n_features = len(draws[0][0]) if draws else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (dict(zip(KINDS, (x.as_buffer() for x in cells), strict=True)) for b in batches for cells in zip(*(b.column(c) for c in KINDS), strict=True))
        parts = [(bins.T, rid, y, raw) for bins, rid, y, raw in (_arrays(r, n_features) for r in rows)]
        if not parts:
            return
        bins, rid, y, raw = (np.ascontiguousarray(np.concatenate(x)) for x in zip(*parts, strict=True))
        for allowed, draw in draws:
            use = _drawn(rid, draw, row_share) if row_share < 1 else slice(None)
            g, h = gradients(loss, power, y[use], raw[use])
            cut = bins[use]
            tree = _grow(lambda t, nodes: _sums(cut, g, h, t, nodes, width), depth, rate, l2, min_weight, allowed)  # noqa: B023
            raw = raw + tree.predict(bins)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tree)], pa.binary())], names=["tree"])

    if not draws:
        return []
    return [pickle.loads(r["tree"]) for r in state.coalesce(1).mapInArrow(run, "tree binary").collect()]


def fit_arrays(
    x: np.ndarray, y: np.ndarray, features: Sequence[str], loss: str = "squared", power: float = 1.5, trees: int = 100, depth: int = 4, rate: float = 0.1,
    bins: int = 64, l2: float = 1.0, min_weight: float = 1e-3, row_share: float = 1.0, seed: int = 42,
) -> Model:
    """The same model on arrays inside a task, for one series or a bounded sample."""
    inner = np.arange(1, bins) / bins
    edges = [np.unique(np.quantile(v[~np.isnan(v)], inner, method="inverted_cdf")) if (~np.isnan(v)).any() else np.zeros(0) for v in x.T]
    mean = max(float(y.mean()), 1e-12) if loss == "tweedie" else float(y.mean())
    model = Model(list(features), edges, float(np.log(mean)) if loss == "tweedie" else mean, loss)
    cut, raw, rng = model.bins(x), np.full(len(y), model.base), np.random.default_rng(seed)
    width, allowed = max(len(e) for e in edges) + 2, np.ones(x.shape[1], bool)
    for _ in range(trees):
        use = rng.random(len(y)) < row_share if row_share < 1 else np.ones(len(y), bool)
        g, h = gradients(loss, power, y, raw)
        sums = lambda tree, nodes: _sums(cut[use], g[use], h[use], tree, nodes, width)  # noqa: B023, E731
        model.trees.append(_grow(sums, depth, rate, l2, min_weight, allowed))
        raw += model.trees[-1].predict(cut)
    return model


def _sums(bins: np.ndarray, g: np.ndarray, h: np.ndarray, tree: Tree, nodes: Sequence[int], width: int) -> np.ndarray:
    """Sums ``(nodes, features, bins, 3)`` over the rows given."""
    n = bins.shape[1]
    place = np.full(len(tree.feature), -1, np.int64)
    place[nodes] = np.arange(len(nodes))
    mine = place[tree.node_of(bins)]
    use = mine >= 0
    cell = ((mine[use][:, None] * n + np.arange(n)) * width + bins[use]).ravel()
    size = len(nodes) * n * width
    parts = [np.bincount(cell, np.repeat(w, n), size) for w in (g[use], h[use])] + [np.bincount(cell, minlength=size)]
    return np.stack(parts, -1).reshape(len(nodes), n, width, 3).astype(float)


#: Of a packed row: so many rows' numbers, labels, bins (feature by feature) and raw scores.
PACKED = "rid binary, y binary, bins binary, raw binary"
KINDS = {"rid": "<i8", "y": "<f8", "bins": "u1", "raw": "<f8"}
#: Blocks are bytes already, so they are kept as they are.
KEEP = StorageLevel(True, True, False, True)


def _packed(**columns: np.ndarray) -> pa.RecordBatch:
    cells = [pa.array([np.ascontiguousarray(a, KINDS[c]).tobytes()], pa.binary()) for c, a in columns.items()]
    return pa.RecordBatch.from_arrays(cells, names=list(columns))


def _block(row: Row | dict) -> dict[str, bytes]:
    return {c: bytes(row[c]) for c in KINDS}


def _arrays(block: Row | dict, n_features: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(bins, rid, y, raw)`` of a packed row, bins as (features, rows); the arrays are not to be written to."""
    bins, rid, y, raw = (np.frombuffer(block[c], KINDS[c]) for c in ("bins", "rid", "y", "raw"))
    return bins.reshape(n_features, -1), rid, y, raw


def _binned(src: DataFrame, model: Model, parts: int) -> DataFrame:
    """The working table of ``PACKED`` rows, written once."""
    shared = src.sparkSession.sparkContext.broadcast(model)

    def pack(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        m = shared.value
        of = lambda c: np.concatenate([b.column(c).to_numpy(zero_copy_only=False) for b in batches])
        x = np.column_stack([of(f"f{i}") for i in range(len(m.features))])
        return _packed(rid=of("rid"), y=of("y"), bins=m.bins(x.astype(float)).T, raw=np.full(len(x), m.base))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: list[pa.RecordBatch] = []
        for b in batches:
            block += [b] if b.num_rows else []
            if sum(x.num_rows for x in block) >= BLOCK_ROWS:
                yield pack(block)
                block = []
        if block:
            yield pack(block)

    # the row number only spreads rows and draws them; it is stored, so it does not change between passes
    numbered = src.withColumn("rid", F.xxhash64(F.monotonically_increasing_id()))
    if parts == 1:
        return cut_lineage(numbered.repartition(1).mapInArrow(run, PACKED))
    return cut_lineage(numbered.mapInArrow(run, PACKED).repartition(parts))  # blocks of bytes move, not rows


@dataclass
class _Drawn:
    """The rows that a tree's draw takes, and their gradients and curvatures."""

    loss: str
    power: float
    row_share: float
    draw: int

    def of(self, rid: np.ndarray, mine: np.ndarray) -> np.ndarray:
        return mine & _drawn(rid, self.draw, self.row_share) if self.row_share < 1 else mine

    def __call__(self, y: np.ndarray, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return gradients(self.loss, self.power, y, raw)


def _add_tree(state: DataFrame | RDD, n_features: int, tree: Tree) -> RDD:
    """The blocks of ``state`` with the tree added to the raw scores."""

    def add(block: Row | dict) -> dict[str, bytes]:
        bins, _, _, raw = _arrays(block, n_features)
        return {**_block(block), "raw": (raw + tree.value.take(_walk(tree, bins))).tobytes()}

    return (state.rdd if isinstance(state, DataFrame) else state).map(add)


def _walk(tree: Tree, bins: np.ndarray) -> np.ndarray:
    """``tree.node_of`` for bins as (features, rows). Few nodes are tried one by one on whole columns of bytes."""
    size = len(tree.feature)
    kind = np.dtype(np.uint8 if size < 256 else np.int16)
    at = np.zeros(bins.shape[1], kind)
    for level in range(int(np.log2(size + 1)) - 1):
        first = 2**level - 1
        nodes = first + np.flatnonzero(tree.feature[first : 2 * first + 1] >= 0)
        if not len(nodes):
            break
        if len(nodes) > 64:
            f = tree.feature[at]
            right = bins[np.maximum(f, 0), np.arange(len(at))] > tree.bin[at]
            at = np.where(f >= 0, 2 * at.astype(np.int64) + 1 + right, at).astype(kind)
            continue
        for i in nodes.tolist():  # the children's numbers are above those of the level
            right = (bins[tree.feature[i]] > int(tree.bin[i])).astype(kind)
            at += (at == i) * (right + kind.type(i + 1))
    return at


def _grow(sums, depth: int, rate: float, l2: float, min_weight: float, allowed: np.ndarray) -> Tree:
    """A tree of ``depth`` levels from ``sums`` (tree so far, open nodes) -> (nodes, features, bins, 3)."""
    size = 2 ** (depth + 1) - 1
    tree = Tree(np.full(size, -1), np.zeros(size, np.int64), np.zeros(size))
    open_nodes = [0]
    for level in range(depth):
        hist = sums(tree, open_nodes)
        feature, at, left, right = best_splits(hist, l2, min_weight, allowed)
        total = hist[:, 0].sum(1)
        nxt = []
        for i, node in enumerate(open_nodes):
            if level == 0:
                tree.value[node] = -rate * total[i, 0] / (total[i, 1] + l2)
            if feature[i] >= 0:
                tree.feature[node], tree.bin[node] = feature[i], at[i]
                for child, s in ((2 * node + 1, left[i]), (2 * node + 2, right[i])):
                    tree.value[child] = -rate * s[0] / (s[1] + l2)
                    nxt.append(child)
        open_nodes = nxt
        if not open_nodes:
            break
    return tree


@dataclass
class _Levels:
    """The sums that ``_grow`` asks for level by level, each level from a pass over the blocks."""

    blocks: RDD
    gradient: _Drawn
    allowed: np.ndarray
    parts: int
    width: int
    last: dict[int, np.ndarray] = field(default_factory=dict)

    def __call__(self, tree: Tree, nodes: Sequence[int]) -> np.ndarray:
        if nodes == [0]:
            found = dict(zip(nodes, self._pass(tree, nodes), strict=True))
        else:
            few = []
            for parent in sorted({(i - 1) // 2 for i in nodes}):
                rows = self.last[parent][tree.feature[parent], :, 2]
                few.append(2 * parent + 1 + int(2 * rows[: tree.bin[parent] + 1].sum() > rows.sum()))
            found = dict(zip(few, self._pass(tree, few), strict=True))
            for i in few:
                rest = self.last[(i - 1) // 2] - found[i]
                rest[rest[..., 2] == 0] = 0  # no rows: no digits left over
                found[i - 1 if i % 2 == 0 else i + 1] = rest
        self.last = found
        return np.stack([found[i] for i in nodes])

    def _pass(self, tree: Tree, nodes: Sequence[int]) -> np.ndarray:
        sums = _histograms(self.blocks, self.gradient, self.allowed, tree, self.parts, self.width, nodes)
        out = np.zeros((len(nodes), len(self.allowed), self.width, 3))
        out[:, self.allowed] = sums
        out[:, ~self.allowed, 0] = sums[:, :1].sum(2)  # so that each feature has the node's totals
        return out


def _cells(bins: Sequence[np.ndarray], slot: np.ndarray, g: np.ndarray, h: np.ndarray, nodes: int, width: int) -> np.ndarray:
    """Sums ``(nodes, features, bins, 3)`` over rows with the node number ``slot``, from a column of bins per feature."""
    out = np.zeros((nodes, len(bins), width, 3))
    step = 2 if nodes * width * width <= PAIR_CELLS else 1
    for j in range(0, len(bins), step):
        cols = bins[j : j + step]
        cell, size = cols[0].astype(np.intp), width
        if len(cols) == 2:  # both features' sums are margins of their common ones
            cell, size = cell * width + cols[1], width * width
        if nodes > 1:
            cell += slot * np.intp(size)
        for k, weight in enumerate((g, h, None)):
            common = np.bincount(cell, weight, nodes * size).reshape(nodes, -1, width)
            if len(cols) == 2:
                out[:, j, :, k], out[:, j + 1, :, k] = common.sum(2), common.sum(1)
            else:
                out[:, j, :, k] = common[:, 0]
    return out


def _histograms(blocks: RDD, gradient: _Drawn, allowed: np.ndarray, tree: Tree, parts: int, width: int, open_nodes: Sequence[int]) -> np.ndarray:
    """Sums ``(open nodes, allowed features, bins, 3)`` over all rows that the tree's draw takes."""
    columns, n_features = np.flatnonzero(allowed), len(allowed)
    shape = (len(open_nodes), len(columns), width, 3)
    enough = min(max(SUM_ROWS, 4 * len(open_nodes) * width * width), 1 << 20)
    place = np.full(len(tree.feature), -1, np.int16)
    place[open_nodes] = np.arange(len(open_nodes))

    def run(rows: Iterator[dict]) -> Iterator[np.ndarray]:
        total = np.zeros(shape)
        held: list[tuple] = []

        def add() -> None:
            cut, slot, g, h = (np.concatenate(x, axis=-1) for x in zip(*held, strict=True))
            total[:] += _cells(cut, slot, g, h, *shape[::2])
            held.clear()

        for block in rows:
            bins, rid, y, raw = _arrays(block, n_features)
            slot = place.take(_walk(tree, bins))
            at = np.flatnonzero(gradient.of(rid, slot >= 0))
            held.append((np.stack([bins[j].take(at) for j in columns]), slot.take(at), *gradient(y.take(at), raw.take(at))))
            if sum(len(x[1]) for x in held) >= enough:
                add()
        if held:
            add()
        yield total

    sums = blocks.mapPartitions(run)
    return sums.treeReduce(np.add) if parts > DIRECT_TASKS else sum(sums.collect())


def predict(rows: DataFrame, model: Model, out_col: str = "prediction") -> DataFrame:
    """``rows`` plus ``out_col``, the predicted mean; a column of that name is replaced."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    keep = [c for c in rows.columns if c != out_col]
    named = rows.select(*[F.col(f"`{c}`") for c in keep], *[F.col(f"`{c}`").cast("double").alias(f"__f{i}") for i, c in enumerate(model.features)])
    schema = T.StructType([*[rows.schema[c] for c in keep], T.StructField(out_col, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.column_stack([b.column(f"__f{i}").to_numpy(zero_copy_only=False) for i in range(len(m.features))]).astype(float) if b.num_rows else np.zeros((0, len(m.features)))
            y = m.link(m.raw(m.bins(x)))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(y)], names=[*keep, out_col])

    return named.mapInArrow(run, schema)


def target_statistics(rows: DataFrame, columns: Sequence[str], label: str, order: str, prior: float = 1.0, suffix: str = "__ts", train: str | None = None) -> DataFrame:
    """M3: ``rows`` plus, for each categorical column, the mean label of its level over earlier rows.

    Earlier means a smaller ``order`` (a period): no row sees its own label or one of its period. The mean is
    drawn towards that of all earlier rows, which counts as ``prior`` rows; where nothing is earlier it is
    null. With ``train`` (a boolean column), only rows where it is true are counted. Levels and periods are
    summed first, so the running sums go over one row per level and period, however many rows a level has;
    any number of levels will do. Null levels are a level of their own. A column's sums are written once; they
    are broadcast where a count proves them small, so that only columns of many levels move the rows.
    """
    y = F.col(label).cast("double") if train is None else F.when(F.col(train), F.col(label).cast("double"))
    running = lambda c, w: F.sum(c).over(w)
    sums = lambda *keys: rows.groupBy(*keys).agg(F.sum(y).alias("s"), F.count(y).alias("n"))
    before = Window.orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)  # one row a period
    overall = sums(F.col(order).alias("__o")).select("__o", (running("s", before) / F.nullif(running("n", before), F.lit(0))).alias("__mean"))
    out = null_safe_join(rows.withColumn("__o", F.col(order)), bounded_broadcast(written(overall, "period-means")), ["__o"], "left")
    for c in columns:
        w = Window.partitionBy("__c").orderBy("__o").rowsBetween(Window.unboundedPreceding, -1)
        level = sums(F.col(c).alias("__c"), F.col(order).alias("__o")).select("__c", "__o", F.coalesce(running("s", w), F.lit(0.0)).alias("__s"), F.coalesce(running("n", w), F.lit(0)).alias("__n"))
        out = null_safe_join(out.withColumn("__c", F.col(c)), bounded_broadcast(written(level, "level-sums")), ["__c", "__o"], "left")
        out = out.withColumn(c + suffix, (F.col("__s") + prior * F.col("__mean")) / (F.col("__n") + prior)).drop("__c", "__s", "__n")
    return out.drop("__o", "__mean")
