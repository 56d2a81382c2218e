"""Regression trees that grow inside tasks: boosted ones (M3) and forests (M4).

Spark ML boosts with some five small jobs a tree, two tasks each, whatever the
rows: with few rows all time is the scheduler's.  Here the rows of a fit, binned
to a byte a feature, are held by one task, which grows all its trees; the fits
of the horizons are tasks of their own.  Splits, bags, feature subsets, sums and
gains follow Spark's ``GBTRegressor`` draw by draw and in its order of rows, so
the trees are the same, and they are written and read as its saved model.

A forest of many rows needs all of them for every tree and level, and Spark ML
waits for the slowest task of each.  Here every task holds the binned rows and
grows some trees from the root to the leaves.  Bags (Poisson counts) and feature
subsets are drawn by tree, so they do not depend on the number of tasks; they
are other draws than Spark's, which follow its partitions.
"""

from __future__ import annotations

import json
import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazecast.session import SharedFolder, shared_dir

SAMPLE_ROWS = 10_000           # rows that thresholds are taken from, as in Spark
CELLS_AT_ONCE = 1 << 22        # bits of the bags that are drawn at the same time
ROWS_A_STEP = 1 << 13          # rows whose bins fit in a processor's cache
EPSILON = 2.0 ** -52
NODE = ("treeID int, id int, prediction double, impurity double, impurityStats array<double>, rawCount long, gain double, "
        "leftChild int, rightChild int, featureIndex int, threshold array<double>")
NODE_ARROW = pa.schema([(n, {"int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "array<double>": pa.list_(pa.float64())}[t])
                        for n, t in (c.split() for c in NODE.split(", "))])
NODE_NAMES = NODE_ARROW.names

# PySpark looks through every attribute of a model but properties for its params: it
# would wrap all trees, one by one, whenever a model is fitted or loaded
for _model in (GBTRegressionModel, RandomForestRegressionModel):
    if not isinstance(_model.trees, property):
        _model.trees = property(_model.trees.func, doc=_model.trees.__doc__)


# ---------------------------------------------------------------------------
# Spark's random numbers, for many seeds at once
# ---------------------------------------------------------------------------


def _u(x) -> np.uint64:
    return np.uint64(x & (1 << 64) - 1)


def _murmur(words: list[np.ndarray], h: np.ndarray) -> np.ndarray:
    """Scala's MurmurHash3 of whole 32-bit words (as uint64 arrays)."""
    low = _u(0xFFFFFFFF)

    def rotl(x, n):
        return (x << _u(n) | x >> _u(32 - n)) & low
    for k in words:
        h = (rotl(h ^ rotl(k * _u(0xCC9E2D51) & low, 15) * _u(0x1B873593) & low, 13) * _u(5) + _u(0xE6546B64)) & low
    h = h ^ _u(4 * len(words))
    h = (h ^ h >> _u(16)) * _u(0x85EBCA6B) & low
    h = (h ^ h >> _u(13)) * _u(0xC2B2AE35) & low
    return h ^ h >> _u(16)


def xorshift_states(seeds: np.ndarray) -> np.ndarray:
    """States of Spark's XORShiftRandom for int64 seeds."""
    big = np.asarray(seeds, np.int64).astype(">i8", copy=False)[..., None].view("<u4").astype(np.uint64)
    words = [big[..., 0], big[..., 1]]
    low = _murmur(words, np.full(words[0].shape, 0x3C074A61, np.uint64))
    return _murmur(words, low) << _u(32) | low


def _step(s: np.ndarray) -> np.ndarray:
    s = s ^ s << _u(21)
    s = s ^ s >> _u(35)
    return s ^ s << _u(4)


def next_doubles(s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(states after, one double a state)."""
    a = _step(s)
    b = _step(a)
    return b, (((a & _u((1 << 26) - 1)) << _u(27)) + (b & _u((1 << 27) - 1))).astype(np.float64) * 2.0 ** -53


def _applied(columns: np.ndarray, s: np.ndarray) -> np.ndarray:
    """A 64 x 64 bit matrix times every state."""
    out = np.zeros_like(s)
    for i, c in enumerate(columns):
        out ^= -(s >> _u(i) & _u(1)) & c
    return out


def uniforms(seeds: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """The first ``n`` doubles of every seed: (offset, doubles by seed and lane),
    in which lane ``i`` goes on at ``i * lane length + offset``.  The generator is
    linear in its bits, so lanes start by jumps."""
    s = xorshift_states(seeds)[:, None]
    width = 1 << max(0, math.ceil(math.log2(max(n, 1)) / 2))
    length = -(-n // width)
    jump = _u(1) << np.arange(64, dtype=np.uint64)
    square, steps = _step(jump), 2 * length
    while steps:
        if steps & 1:
            jump = _applied(square, jump)
        square, steps = _applied(square, square), steps >> 1
    while s.shape[1] < width:
        s = np.concatenate([s, _applied(jump, s)], axis=1)
        jump = _applied(jump, jump)
    for i in range(length):
        s, d = next_doubles(s)
        yield i, d


def drawn(seeds: np.ndarray, n: int, keep) -> np.ndarray:
    """``keep(double)`` for the first ``n`` doubles of every seed, a row a seed."""
    if n == 0:
        return np.zeros((len(seeds), 0), bool)
    lanes = [keep(d) for _, d in uniforms(seeds, n)]
    return np.stack(lanes, axis=2).reshape(len(seeds), -1)[:, :n]


class JavaRandom:
    """java.util.Random for many seeds."""

    def __init__(self, seeds: np.ndarray):
        self.s = (np.asarray(seeds, np.int64).astype(np.uint64) ^ _u(0x5DEECE66D)) & _u((1 << 48) - 1)

    def _next(self) -> np.ndarray:
        self.s = (self.s * _u(0x5DEECE66D) + _u(0xB)) & _u((1 << 48) - 1)
        return (self.s >> _u(16)).astype(np.uint32).view(np.int32).astype(np.int64)

    def longs(self) -> np.ndarray:
        return (self._next() << 32) + self._next()


# ---------------------------------------------------------------------------
# thresholds
# ---------------------------------------------------------------------------


def sampled_rows(n: int, fraction: float, seed: int) -> np.ndarray:
    """Positions that Spark's Bernoulli sampler takes of a partition of ``n`` rows."""
    if fraction >= 1.0:
        return np.arange(n)
    if fraction > 0.4:
        return np.flatnonzero(drawn(np.array([seed]), n, lambda d: d <= fraction)[0])
    found, at, s, each = [], -1, xorshift_states(np.array([seed])), math.log1p(-fraction)
    while True:                 # gaps between the rows taken
        s, d = next_doubles(s)
        at += 1 + int(math.log(max(float(d[0]), 5e-11)) / each)
        if at >= n:
            return np.array(found, np.int64)
        found.append(at)


def thresholds_of(values: np.ndarray, expected: float, splits: int) -> np.ndarray:
    """Spark's split thresholds of a continuous feature: values of the sampled
    rows, of which ``expected`` were to be; zeros are told by what is missing."""
    found = values[values != 0.0]
    if len(found) == 0:
        return np.empty(0)
    v, c = np.unique(found, return_counts=True)
    c = c.astype(np.float64)
    if expected - len(found) > EPSILON * len(found) * 100:
        at = int(np.searchsorted(v, 0.0))
        v, c = np.insert(v, at, 0.0), np.insert(c, at, expected - len(found))
    middle = (v[:-1] + v[1:]) / 2.0
    if len(middle) <= splits:
        return middle
    stride = expected / (splits + 1)
    target, out, before = stride, [], c[0]
    for i, x in enumerate(np.cumsum(c)[1:].tolist()):
        if abs(before - target) < abs(x - target):
            out.append(middle[i])
            target += stride
        before = x
    return np.array(out)


def _vectors(batch: pa.RecordBatch, p: int) -> np.ndarray:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False)
    return x.reshape(batch.num_rows, p)


def find_thresholds(rows: DataFrame, p: int, sizes: list[int], seed: int, bins: int) -> list[np.ndarray]:
    """Thresholds of every feature, from the rows that Spark would sample."""
    n = sum(sizes)
    fraction = min(1.0, max(bins * bins, SAMPLE_ROWS) / n)
    start = int(_step(xorshift_states(np.array([seed])))[0]) & 0xFFFFFFFF
    each = JavaRandom(np.array([start - ((start & 1 << 31) << 1)]))
    seeds = [int(each.longs()[0]) for _ in sizes]

    def sample(batches):
        i, at = TaskContext.get().partitionId(), 0
        taken = sampled_rows(sizes[i], fraction, seeds[i])
        for b in batches:
            some = taken[(taken >= at) & (taken < at + b.num_rows)] - at
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([b.column("x").take(pa.array(some))], names=["x"])
    got = rows.select("x").mapInArrow(sample, "x array<double>").toArrow().column("x").combine_chunks()
    x = got.flatten().to_numpy(zero_copy_only=False).reshape(-1, p)
    return [thresholds_of(x[:, i], fraction * n, bins - 1) for i in range(p)]


# ---------------------------------------------------------------------------
# one tree
# ---------------------------------------------------------------------------


def feature_subsets(seeds: np.ndarray, nodes: int, p: int, k: int) -> np.ndarray:
    """Features that Spark offers to the first ``nodes`` nodes of a tree of every
    seed, in the order in which nodes are split: a reservoir of ``k`` of ``p``."""
    each = JavaRandom(seeds)
    s = xorshift_states(np.stack([each.longs() for _ in range(nodes)], axis=1))
    out = np.broadcast_to(np.arange(k), (*s.shape, k)).copy()
    for item in range(k, p):
        s, d = next_doubles(s)
        place = (d * (item + 1)).astype(np.int64)
        t, j = np.nonzero(place < k)
        out[t, j, place[t, j]] = item
    return out


def _impurity(n, s, q):
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(n == 0, 0.0, (q - s * s / n) / n)


class Binned:
    """Rows of a fit: a byte a feature, and the partitions they came in, whose
    sums are taken apart and then added up."""

    def __init__(self, bins: np.ndarray, sizes: list[int], thresholds: list[np.ndarray]):
        self.bins, self.thresholds = bins, thresholds
        self.n, self.p = bins.shape
        self.n_splits = np.array([len(t) for t in thresholds])
        self.width = int(self.n_splits.max()) + 1
        self.ends = np.cumsum(sizes)

    def of(self, rows: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Bins of a feature (or several) of each of these rows."""
        at = rows * self.p
        return self.bins.ravel().take(at + features if features.ndim == 1 else at[:, None] + features)

    def sums(self, rows: np.ndarray, slot: np.ndarray, y: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Count, sum and sum of squares by node, offered feature and bin."""
        r, k = features.shape
        out = np.zeros((3, r * k * self.width))
        first = 0
        for end in np.searchsorted(rows, self.ends):
            some = slice(first, end)
            first = end
            if some.start == some.stop:
                continue
            key = self.of(rows[some], features[slot[some]]).astype(np.int64)
            key += (slot[some] * (k * self.width))[:, None] + np.arange(k) * self.width
            key, mine = key.ravel(), np.repeat(y[some], k)
            out[0] += np.bincount(key, minlength=out.shape[1])
            out[1] += np.bincount(key, mine, out.shape[1])
            out[2] += np.bincount(key, mine * mine, out.shape[1])
        return out.reshape(3, r, k, self.width)

    def weights(self, rows: np.ndarray, slot: np.ndarray, w: np.ndarray, wy: np.ndarray, features: np.ndarray) -> np.ndarray:
        """Weight and weighted sum by node, offered feature and bin, in steps of few
        enough rows for a processor's cache."""
        r, k = features.shape
        out = np.zeros((2, k, r * self.width))
        for first in range(0, len(rows), ROWS_A_STEP):
            some = slice(first, first + ROWS_A_STEP)
            node, at, mine, my = slot[some], rows[some] * self.p, w[some], wy[some]
            cell = node * self.width
            for j in range(k):
                key = cell + self.bins.ravel().take(at + features[:, j].take(node))
                out[0, j] += np.bincount(key, mine, out.shape[2])
                out[1, j] += np.bincount(key, my, out.shape[2])
        return out.reshape(2, k, r, self.width).swapaxes(1, 2)


def best_splits(cells: np.ndarray, features: np.ndarray, n_splits: np.ndarray, parents: np.ndarray | None, least: int):
    """Per node: its own sums, gain (-inf: no split), place of the best feature
    among the offered ones, its bin, and the sums left and right of it.  Sums of
    a node are those of its parent's split; a root's come from its first split."""
    total = np.cumsum(cells, axis=3)
    left, right = total[..., :-1], total[..., -1:] - total[..., :-1]
    known = np.arange(left.shape[3]) < n_splits[features][..., None]
    if parents is None:
        j = int(np.argmax(n_splits[features[0]] > 0))
        parents = (left[:, 0, j, 0] + right[:, 0, j, 0])[:, None] if left.shape[3] else total[:, :, 0, -1]
    gain = np.full(known.shape, -np.inf)
    ok = known & (left[0] >= least) & (right[0] >= least)
    if ok.any():
        node = np.nonzero(ok)[0]
        a, b = left[:, ok], right[:, ok]
        both = a[0] + b[0]
        gain[ok] = _impurity(*parents)[node] - a[0] / both * _impurity(*a) - b[0] / both * _impurity(*b)
        gain[gain < 0] = -np.inf
    flat = gain.reshape(len(features), -1)
    if not flat.shape[1]:
        return parents, np.full(len(features), -np.inf), None, None, None, None
    best = flat.argmax(axis=1)
    place, at = np.divmod(best, gain.shape[2])
    i = np.arange(len(features))
    return parents, flat[i, best], place, at, left[:, i, place, at], right[:, i, place, at]


def grow(table: Binned, y: np.ndarray, kept: np.ndarray, subsets: np.ndarray | None, depth: int, least: int) -> tuple[list, np.ndarray]:
    """One tree on the ``kept`` rows: its nodes [sums, impurity, gain, feature,
    bin, left, right], the root first, and the node that every row ends in."""
    nodes: list[list] = [[None, 0.0, -1.0, -1, -1, -1, -1]]
    ends, reached = np.zeros(table.n, np.int32), np.arange(table.n)
    rows, slot, own = np.flatnonzero(kept), np.zeros(int(kept.sum()), np.int64), np.array([0])
    parents, used = None, 0
    everywhere, y_rows = np.zeros(table.n, np.int64), y[rows]
    for level in range(depth + 1):
        if not len(own):
            break
        offered = np.broadcast_to(np.arange(table.p), (len(own), table.p)) if subsets is None else subsets[used:used + len(own)]
        used += len(own)
        cells = table.sums(rows, slot, y_rows, offered)
        sums, gain, place, at, left, right = best_splits(cells, offered, table.n_splits, parents, least)
        open_next, go, bin_of, wide = [], np.full(len(own), -1), np.zeros(len(own), np.int64), np.zeros((len(own), 2), np.int64)
        dumb = ~(table.n_splits[offered] > 0).any(axis=1)
        impurity = _impurity(*sums)
        for i, node in enumerate(own.tolist()):
            mine = sums[:, i]
            if dumb[i]:         # nothing offered can split: the node's own rows count
                of = rows[slot == i]
                own_y = [np.concatenate([[0.0], y[of]]).cumsum()[-1], np.concatenate([[0.0], y[of] * y[of]]).cumsum()[-1]]
                mine = np.array([len(of), *own_y])
            nodes[node][0] = mine
            if gain[i] == -np.inf:
                nodes[node][1] = -1.0
                continue
            nodes[node][1] = float(impurity[i])
            if gain[i] <= 0:
                continue
            f = int(offered[i, place[i]])
            nodes[node][2:5] = [float(gain[i]), f, int(at[i])]
            go[i], bin_of[i] = f, at[i]
            for side, s in enumerate((left[:, i], right[:, i])):
                imp = float(_impurity(*s))
                nodes[node][5 + side] = wide[i, side] = len(nodes)
                nodes.append([s, imp, -1.0, -1, -1, -1, -1])
                if level + 1 < depth and abs(imp) >= EPSILON:
                    open_next.append((len(nodes) - 1, s))
        # rows of split nodes go on; a stack of nodes is emptied from its end
        split = go[everywhere] >= 0
        reached, everywhere = reached[split], everywhere[split]
        if not len(reached):
            break
        side = (table.of(reached, go[everywhere]) > bin_of[everywhere]).astype(np.int64)
        now = wide[everywhere, side]
        ends[reached] = now
        open_next.reverse()
        own = np.array([x for x, _ in open_next], np.int64)
        parents = np.stack([s for _, s in open_next], axis=1) if open_next else None
        place_of = np.full(len(nodes), -1)
        place_of[own] = np.arange(len(own))
        still = place_of[now] >= 0
        reached, everywhere = reached[still], place_of[now[still]]
        mine = kept[reached]
        rows, slot = reached[mine], everywhere[mine]
        y_rows = y[rows]
    return nodes, ends


def values_of(nodes: list) -> np.ndarray:
    """What each node of a tree predicts."""
    return np.array([float(s[1] / s[0]) if s[0] else 0.0 for s, *_ in nodes])


def written(tree: int, nodes: list, thresholds: list[np.ndarray]) -> Iterator[tuple]:
    """Rows of ``NODE`` in Spark's order; a split whose leaves predict the same is
    a leaf."""
    value = values_of(nodes)
    out: list[list] = []

    def put(i: int) -> tuple[bool, float]:
        s, impurity, gain, f, b, left, right = nodes[i]
        here = len(out)
        row = [tree, here, float(value[i]), impurity, [float(x) for x in s], int(s[0]), -1.0, -1, -1, -1, []]
        out.append(row)
        if left < 0:
            return True, row[2]
        a = put(left)
        at = len(out)
        b_ = put(right)
        if a[0] and b_[0] and a[1] == b_[1]:
            del out[here + 1:]
            row[2] = a[1]
            return True, a[1]
        row[6:] = [gain, here + 1, at, f, [float(thresholds[f][b])]]
        return False, row[2]
    put(0)
    return iter(out)


# ---------------------------------------------------------------------------
# boosting
# ---------------------------------------------------------------------------


def boosted(table: Binned, label: np.ndarray, sizes: list[int], trees: int, depth: int, step: float, rate: float,
            least: int, k: int, seed: int) -> Iterator[tuple[int, list]]:
    """(number, nodes) of every tree of a boosted fit with squared errors."""
    pred = np.zeros(table.n)
    block = max(1, min(64, CELLS_AT_ONCE // table.n))
    for first in range(0, trees, block):
        seeds = seed + np.arange(first, min(first + block, trees))
        subsets = feature_subsets(seeds, (1 << depth) - 1, table.p, k) if k < table.p else [None] * len(seeds)
        bags = (np.concatenate([drawn(seeds + i + 1, size, lambda d: d < rate) for i, size in enumerate(sizes)], axis=1)
                if rate < 1.0 else np.ones((len(seeds), table.n), bool))
        for m, offered, kept in zip(range(first, trees), subsets, bags):
            y = 2.0 * (label - pred) if m else label
            nodes, ends = grow(table, y, kept, offered, depth, least)
            pred = pred + values_of(nodes)[ends] * (step if m else 1.0)
            yield m, nodes


#: params that the trees of a model have of their own
TREE_PARAMS = {"cacheNodeIds", "checkpointInterval", "featuresCol", "impurity", "labelCol", "leafCol", "maxBins", "maxDepth", "maxMemoryInMB",
               "minInfoGain", "minInstancesPerNode", "minWeightFractionPerNode", "predictionCol", "seed"}
Regressor = GBTRegressor | RandomForestRegressor


def _save_metadata(spark: SparkSession, reg: Regressor, path: str, p: int, weights: list[float]) -> None:
    """What Spark writes beside the nodes of a model of ``reg``."""
    reg.write().save(f"{path}/estimator")
    told = json.loads(spark.read.text(f"{path}/estimator/metadata").first()[0])
    tree = {x: told[x] for x in ("timestamp", "sparkVersion")} | {x: {n: v for n, v in told[x].items() if n in TREE_PARAMS}
                                                                  for x in ("paramMap", "defaultParamMap")}
    trees = [(i, json.dumps(tree | {"class": "org.apache.spark.ml.regression.DecisionTreeRegressionModel", "uid": f"dtr_{uuid.uuid4().hex[:12]}"}), w)
             for i, w in enumerate(weights)]
    told |= {"class": told["class"].replace("Regressor", "RegressionModel"), "numFeatures": p, "numTrees": len(trees)}
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.text(f"{path}/model/metadata")
    spark.createDataFrame(trees, "_1 int, _2 string, _3 double").coalesce(1).write.parquet(f"{path}/model/treesMetadata")


def _write_nodes(grown: DataFrame, path: str) -> None:
    split = F.struct("featureIndex", F.col("threshold").alias("leftCategoriesOrThreshold"), F.lit(-1).alias("numCategories"))
    node = F.struct("id", "prediction", "impurity", "impurityStats", "rawCount", "gain", "leftChild", "rightChild", split.alias("split"))
    grown.select("treeID", node.alias("nodeData")).write.parquet(f"{path}/model/data")


def _inputs(data: DataFrame) -> tuple[DataFrame, list[int]]:
    """Features, label and partition of the rows of a fit, and rows a partition."""
    rows = data.select(vector_to_array("features").alias("x"), F.col("label").cast("double").alias("label"), F.spark_partition_id().alias("part"))
    counted = {r[0]: r[1] for r in rows.groupBy("part").count().collect()}
    if not counted:
        raise ValueError("a fit needs rows")
    return rows, [counted.get(i, 0) for i in range(max(counted) + 1)]


def _binned(batch: pa.RecordBatch, thresholds: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Bins and labels of some rows."""
    x, y = _vectors(batch, len(thresholds)), batch.column("label").to_numpy(zero_copy_only=False)
    if not (np.isfinite(x).all() and np.isfinite(y).all()):
        raise ValueError("features and labels of a fit must be finite")
    bins = np.empty(x.shape, np.uint8)
    for f, t in enumerate(thresholds):
        bins[:, f] = np.searchsorted(t, x[:, f])
    return bins, y


def grows(reg: Regressor) -> bool:
    """Whether trees that grow here are those that ``reg`` asks for."""
    return (reg.getFeatureSubsetStrategy(), reg.getMinInfoGain(), reg.getMinWeightFractionPerNode()) == ("sqrt", 0.0, 0.0) and reg.getMaxBins() < 256


def grow_boosted(reg: GBTRegressor, data: DataFrame, p: int) -> str:
    """The folder with the trees of ``reg.fit(data)``, all of which one task grows:
    it holds ``p`` + 100 bytes a row or so.  The partitions of ``data`` are files."""
    rows, sizes = _inputs(data)
    thresholds = find_thresholds(rows, p, sizes, reg.getSeed(), min(reg.getMaxBins(), sum(sizes)))
    how = {"trees": reg.getMaxIter(), "depth": reg.getMaxDepth(), "step": reg.getStepSize(), "rate": reg.getSubsamplingRate(),
           "least": reg.getMinInstancesPerNode(), "k": math.ceil(math.sqrt(p)), "seed": reg.getSeed()}

    def run(batches):
        bins, label = np.empty((sum(sizes), p), np.uint8), np.empty(sum(sizes))
        free = np.concatenate([[0], np.cumsum(sizes)])
        for b in batches:
            (x, y), part = _binned(b, thresholds), b.column("part").to_numpy()
            for i in np.unique(part):       # a batch may reach into the next partition
                of = part == i
                to = slice(free[i], free[i] + np.count_nonzero(of))
                free[i], label[to], bins[to] = to.stop, y[of], x[of]
        table = Binned(bins, sizes, thresholds)
        for m, nodes in boosted(table, label, sizes, **how):
            yield pa.RecordBatch.from_pylist([dict(zip(NODE_NAMES, r)) for r in written(m, nodes, thresholds)], NODE_ARROW)
    path = shared_dir(data.sparkSession, "boosted")
    _write_nodes(rows.coalesce(1).mapInArrow(run, NODE), path)
    return path


# ---------------------------------------------------------------------------
# forests
# ---------------------------------------------------------------------------


def bag(seed: int, tree: int, n: int, rate: float, nodes: int, p: int, k: int) -> tuple[np.ndarray, np.ndarray | None]:
    """How often every row is in the bag of a tree, and the features that are
    offered to its nodes (all, if ``k`` is ``p``)."""
    draws = np.random.default_rng([seed & (1 << 64) - 1, tree])
    return draws.poisson(rate, n), draws.random((nodes, p)).argsort(axis=1)[:, :k] if k < p else None


def grow_bagged(table: Binned, y: np.ndarray, counts: np.ndarray, subsets: np.ndarray | None, depth: int, least: int) -> list:
    """The nodes (as of ``grow``) of a tree on rows that count several times."""
    nodes: list[list] = [[None, 0.0, -1.0, -1, -1, -1, -1]]
    rows = np.flatnonzero(counts)
    w = counts[rows].astype(np.float64)
    y, slot, own, used = y[rows], np.zeros(len(rows), np.int64), [0], 0
    wy = w * y
    for level in range(depth + 1):
        sums = np.stack([np.bincount(slot, w, len(own)), np.bincount(slot, wy, len(own)), np.bincount(slot, wy * y, len(own))])
        impurity = _impurity(*sums)
        for i, node in enumerate(own):
            nodes[node][:2] = [sums[:, i], float(impurity[i])]
        if level == depth:
            break
        offered = np.broadcast_to(np.arange(table.p), (len(own), table.p)) if subsets is None else subsets[used:used + len(own)]
        used += len(own)
        gain, place, at = bagged_splits(table.weights(rows, slot, w, wy, offered), offered, table.n_splits, sums, least)
        go, bin_of, child, following = np.full(len(own), -1), np.zeros(len(own), np.int64), np.zeros(len(own), np.int64), []
        for i, node in enumerate(own):
            if abs(impurity[i]) < EPSILON:
                continue
            if gain[i] == -np.inf:
                nodes[node][1] = -1.0
            elif gain[i] > 0:
                f, child[i] = int(offered[i, place[i]]), len(following)
                go[i], bin_of[i] = f, at[i]
                nodes[node][2:] = [float(gain[i]), f, int(at[i]), len(nodes), len(nodes) + 1]
                following += [len(nodes), len(nodes) + 1]
                nodes += [[None, 0.0, -1.0, -1, -1, -1, -1] for _ in range(2)]
        if not following:
            break
        if (go < 0).any():
            split = go[slot] >= 0
            rows, slot, w, wy, y = rows[split], slot[split], w[split], wy[split], y[split]
        own = following
        slot = child[slot] + (table.of(rows, go[slot]) > bin_of[slot])
    return nodes


def bagged_splits(cells: np.ndarray, offered: np.ndarray, n_splits: np.ndarray, sums: np.ndarray, least: int):
    """Per node gain (-inf: no split), place of the best feature among the offered
    ones and its bin; what a split gains is what its means explain."""
    total = np.cumsum(cells, axis=3)[..., :-1]
    n, s, _ = sums[:, :, None, None]
    left, right = total, np.stack([n - total[0], s - total[1]])
    ok = (np.arange(total.shape[3]) < n_splits[offered][..., None]) & (left[0] >= least) & (right[0] >= least)
    with np.errstate(divide="ignore", invalid="ignore"):
        gain = np.where(ok, (left[1] ** 2 / left[0] + right[1] ** 2 / right[0] - s * s / n) / n, -np.inf)
    gain[gain < 0] = -np.inf
    flat = gain.reshape(len(offered), -1)
    if not flat.shape[1]:
        return np.full(len(offered), -np.inf), None, None
    best = flat.argmax(axis=1)
    return flat[np.arange(len(offered)), best], *np.divmod(best, gain.shape[2])


def grow_forest(reg: RandomForestRegressor, data: DataFrame, p: int) -> str:
    """The folder with the trees of a forest: every task holds all rows, ``p`` + 50
    bytes each or so, and grows some trees.  Binned rows are read from files, by
    every task."""
    spark = data.sparkSession
    rows, sizes = _inputs(data)
    thresholds = find_thresholds(rows, p, sizes, reg.getSeed(), min(reg.getMaxBins(), sum(sizes)))
    path, starts = shared_dir(spark, "forest"), np.concatenate([[0], np.cumsum(sizes)])

    def pack(batches):
        at = int(starts[TaskContext.get().partitionId()])
        for b in batches:
            bins, y = _binned(b, thresholds)
            yield pa.RecordBatch.from_pydict({"at": [at], "n": [len(y)], "bins": [bins.tobytes()], "label": [y.tobytes()]})
            at += len(y)
    rows.select("x", "label").mapInArrow(pack, "at long, n long, bins binary, label binary").write.parquet(f"{path}/binned")
    n, trees, depth, rate, least, seed = (sum(sizes), reg.getNumTrees(), reg.getMaxDepth(), reg.getSubsamplingRate(),
                                          reg.getMinInstancesPerNode(), reg.getSeed())
    k, tasks = math.ceil(math.sqrt(p)), max(1, min(trees, spark.sparkContext.defaultParallelism))

    def run(task, packed):
        bins, label = np.empty((n, p), np.uint8), np.empty(n)
        for at, size, x, y in packed:
            bins[at:at + size] = np.frombuffer(x, np.uint8).reshape(size, p)
            label[at:at + size] = np.frombuffer(y)
        table = Binned(bins, sizes, thresholds)
        for m in range(task, trees, tasks):
            yield from written(m, grow_bagged(table, label, *bag(seed, m, n, rate, (1 << depth) - 1, p, k), depth, least), thresholds)
    # all files to every task: a union of tables of one partition each would be one partition
    every = spark.sparkContext.union([spark.read.parquet(f"{path}/binned").coalesce(1).rdd] * tasks)
    _write_nodes(spark.createDataFrame(every.mapPartitionsWithIndex(run), NODE, verifySchema=False), path)
    SharedFolder(spark, path).remove("binned")
    return path


# ---------------------------------------------------------------------------
# what has grown
# ---------------------------------------------------------------------------


def importances(reg: Regressor, spark: SparkSession, path: str, p: int) -> np.ndarray:
    """Spark's feature importances of the trees in a folder, without a model of
    them: gains by the rows they split, in a forest by tree as shares of the tree's."""
    split = spark.read.parquet(f"{path}/model/data").where("nodeData.leftChild >= 0")
    got = split.select("treeID", "nodeData.id", "nodeData.split.featureIndex",
                       (F.col("nodeData.gain") * F.col("nodeData.impurityStats")[0]).alias("gain")).toPandas()
    got = got.sort_values(["treeID", "id"])
    trees = int(got.treeID.max()) + 1 if len(got) else 0
    each = np.bincount(got.treeID * p + got.featureIndex, got.gain, trees * p).reshape(trees, p)
    if isinstance(reg, RandomForestRegressor):
        of = each.sum(axis=1, keepdims=True)
        each = np.divide(each, of, out=np.zeros_like(each), where=of != 0)
    total = each.sum(axis=0)
    return total / total.sum() if total.sum() else total


def model_of(reg: Regressor, spark: SparkSession, path: str, p: int) -> GBTRegressionModel | RandomForestRegressionModel:
    """The model that Spark has of the trees in a folder."""
    if isinstance(reg, GBTRegressor):
        _save_metadata(spark, reg, path, p, [1.0] + [reg.getStepSize()] * (reg.getMaxIter() - 1))
        return GBTRegressionModel.load(f"{path}/model")
    _save_metadata(spark, reg, path, p, [1.0] * reg.getNumTrees())
    return RandomForestRegressionModel.load(f"{path}/model")
