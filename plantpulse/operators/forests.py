"""Forests of large training tables (M5, M6), fitted level by level over binned rows.

MLlib's learner walks node objects for every row, tree and pass. Here the rows
are binned once (at most ``maxBins`` values a feature, MLlib's rule for the cuts,
from quantiles of all rows) and written to the shared folder as blocks of bytes.
A pass walks all trees over a task's blocks with arrays and adds up the statistics
of the open nodes; they are summed and the best splits chosen per tree in the
tasks behind the shuffle, and only those come to the driver. A row's bag count
for a tree follows from the seed, the tree and the block, so nothing is kept per row and
tree. Splits, leaves, pruning and importances follow MLlib; the result is an
MLlib model, written in its own format and loaded.

A task holds its blocks (a byte per feature, one or eight for the label) and the
statistics of one tree, whatever the number of rows and trees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize, release, scratch_path

#: Training tables of more rows are fitted here, smaller ones by MLlib.
LARGE_ROWS = 1_000_000

#: Rows of one block: the columns of a block stay in a core's cache.
BLOCK_ROWS = 65_536

#: Deeper forests are MLlib's: a level's statistics grow with its nodes.
MAX_DEPTH = 14

#: Cuts are chosen among so many quantiles of all rows.
QUANTILES, ACCURACY = 1_000, 10_000

BINS = 32


def _subset(learner, classifier: bool, n: int) -> int | None:
    """Features tried at a node, by MLlib's names."""
    how = learner.getFeatureSubsetStrategy().lower()
    if how == "auto":
        how = "all" if learner.getNumTrees() == 1 else "sqrt" if classifier else "onethird"
    sizes = {"all": n, "sqrt": math.ceil(math.sqrt(n)), "onethird": math.ceil(n / 3.0),
             "log2": max(1, math.ceil(math.log2(n)))}
    return sizes.get(how)


def takes(learner) -> bool:
    """A forest whose settings are covered here; others are MLlib's."""
    if not isinstance(learner, (RandomForestClassifier, RandomForestRegressor)):
        return False
    weighted = learner.isDefined("weightCol") and bool(learner.getWeightCol())
    impurity = "gini" if isinstance(learner, RandomForestClassifier) else "variance"
    return (learner.getMaxDepth() <= MAX_DEPTH and learner.getMaxBins() == BINS and learner.getSubsamplingRate() == 1.0
            and learner.getMinWeightFractionPerNode() == 0.0
            and learner.getImpurity() == impurity and (not weighted or learner.getMinInstancesPerNode() == 1)
            and _subset(learner, impurity == "gini", 4) is not None)


# ------------------------------------------------------------------ cuts and blocks


def cuts_of(values: np.ndarray, bins: int = BINS) -> np.ndarray:
    """MLlib's thresholds of a continuous feature, from a sample of its values:
    halfway between neighbours, all of them or one behind every full stride."""
    v, n = np.unique(values, return_counts=True)
    middle = v[:-1] / 2.0 + v[1:] / 2.0
    if len(middle) <= bins - 1:
        return middle
    stride = n.sum() / bins
    cuts, before, target = [], n[0], stride
    for i in range(1, len(v)):
        now = before + n[i]
        if abs(before - target) < abs(now - target):
            cuts.append(middle[i - 1])
            target += stride
        before = now
    return np.array(cuts)


def _survey(rows: DataFrame, n: int) -> dict | None:
    """Cuts per feature and the labels' range from all rows; None where MLlib
    would refuse a row."""
    grid = [i / QUANTILES for i in range(1, QUANTILES)]
    odd = F.col("y").isNull() | F.isnan("y") | F.col("w").isNull() | ~(F.col("w") >= 0) | F.isnan("w") | F.col("x").isNull()
    odd = odd | F.exists("x", lambda v: v.isNull() | F.isnan(v))
    aggs = [F.max(F.coalesce(odd, F.lit(True))).alias("odd"), F.min("y").alias("lo"), F.max("y").alias("hi"),
            F.max(F.col("y") != F.floor("y")).alias("broken")]
    for i in range(n):
        v = F.col("x")[i]
        aggs += [F.percentile_approx(v, grid, ACCURACY).alias(f"q{i}"), F.min(v).alias(f"a{i}"), F.max(v).alias(f"z{i}")]
    r = rows.agg(*aggs).first()
    if r["odd"] or r["odd"] is None:
        return None
    cuts = [cuts_of(np.array([r[f"a{i}"], *r[f"q{i}"], r[f"z{i}"]])) for i in range(n)]
    return {"cuts": cuts, "lo": r["lo"], "hi": r["hi"], "broken": r["broken"]}


BLOCK_SCHEMA = "block long, n int, bins binary, y binary, w binary"


def _pack(cuts, classifier: bool, weighted: bool):
    """Rows as blocks: bins (a row of bytes per feature), labels, weights."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, held, size = TaskContext.get().partitionId() << 24, [], 0

        def block():
            nonlocal at, held, size
            bins, y, w = (np.concatenate(p, axis=-1) for p in zip(*held))
            out = pa.RecordBatch.from_pydict({
                "block": pa.array([at], pa.int64()), "n": pa.array([len(y)], pa.int32()),
                "bins": pa.array([bins.tobytes()], pa.binary()),
                "y": pa.array([y.astype(np.uint8 if classifier else np.float64).tobytes()], pa.binary()),
                "w": pa.array([w.tobytes() if weighted else b""], pa.binary())})
            at, held, size = at + 1, [], 0
            return out
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, len(cuts))
            bins = np.stack([np.searchsorted(c, x[:, i], side="left") for i, c in enumerate(cuts)]).astype(np.uint8)
            held.append((bins, b.column("y").to_numpy(zero_copy_only=False), b.column("w").to_numpy(zero_copy_only=False)))
            size += b.num_rows
            if size >= BLOCK_ROWS:
                yield block()
        if size:
            yield block()
    return run


# ------------------------------------------------------------------ bags and walks

_CDF = np.cumsum([math.exp(-1.0) / math.factorial(k) for k in range(9)])
#: Poisson(1) counts of equally likely 16-bit numbers.
_POISSON = np.searchsorted(_CDF, (np.arange(65_536) + 0.5) / 65_536).astype(np.uint8)


def bag_counts(seed: int, tree: int, block: int, n: int) -> np.ndarray:
    """How often each row of a block is in a tree's bag."""
    numbers = np.random.SFC64([seed & 0xFFFFFFFF, tree, block & 0xFFFFFFFF, block >> 32])
    return _POISSON.take(numbers.random_raw(-(-n // 4)).view(np.uint16)[:n])


def steps(tree, n: int) -> tuple[np.ndarray, np.ndarray]:
    """A tree as two tables for blocks of ``n`` rows: where the column starts that
    a node looks at, and by node and bin the next node; nodes count in ``BINS``."""
    feature, cut, left = tree
    start = np.repeat(feature.astype(np.int64) * n, BINS)
    return start, ((left[:, None] + (np.arange(BINS) > cut[:, None])) * BINS).astype(np.int64).ravel()


def walk(tables, flat: np.ndarray, rows: np.ndarray, depth: int) -> np.ndarray:
    """The node that each row reaches after ``depth`` steps; leaves stay."""
    start, following = tables
    node, at, bins = np.zeros(len(rows), np.int64), np.empty(len(rows), np.int64), np.empty(len(rows), np.uint8)
    for _ in range(depth):  # the mode lets numpy write into the buffers at once
        np.take(start, node, out=at, mode="wrap")
        at += rows
        np.take(flat, at, out=bins, mode="wrap")
        node += bins
        np.take(following, node, out=at, mode="wrap")
        node, at = at, node
    return node // BINS


class _Level:
    """What the tasks of one pass need: per open tree its walk tables, the slot of
    each node among the open ones (-1: closed) and the features tried there."""

    def __init__(self, depth, seed, bagged, groups, weighted, squares, trees):
        self.depth, self.seed, self.bagged, self.groups = depth, seed, bagged, groups
        self.weighted, self.squares, self.trees = weighted, squares, trees  # {tree: (tables, slots, tried)}

    def values(self) -> int:
        return 1 + (self.groups == 1) * (1 + self.squares) + self.weighted

    def add_up(self, tree: int, blocks) -> np.ndarray:
        """[tried, value, slot, group, bin] sums over the blocks, and behind them
        the sum of squares per slot (regression)."""
        shape, slots, tried = self.trees[tree]
        m, k = tried.shape
        one, cells = self.groups == 1, m * self.groups * BINS
        hist, squares = np.zeros((k, self.values(), cells)), np.zeros(m)
        size, tables = None, None
        for block, n, flat, y, w in blocks:
            if n != size:
                size, tables = n, steps(shape, n)
                first = [tried[:, j].astype(np.int64) * n for j in range(k)]
            if self.bagged:
                count = bag_counts(self.seed, tree, block, n)
                rows = count.nonzero()[0]
            else:
                count, rows = np.ones(n, np.uint8), np.arange(n)
            slot = slots.take(walk(tables, flat, rows, self.depth))
            if slot.size and slot.min() < 0:
                here = (slot >= 0).nonzero()[0]
                rows, slot = rows.take(here), slot.take(here)
            if not len(rows):
                continue
            raw = count.take(rows).astype(np.float64)
            weight = raw * w.take(rows) if self.weighted else raw
            values, label = [weight], y.take(rows)
            if one:
                values.append(weight * label)
                squared = values[1] * label
                squares += np.bincount(slot, squared, m)
                if self.squares:
                    values.append(squared)
            if self.weighted:
                values.append(raw)
            base = (slot if one else slot * self.groups + label) * BINS
            every = k * n == len(flat)
            for j in range(k):
                key = base + (flat[j * n:(j + 1) * n].take(rows) if every else flat.take(first[j].take(slot) + rows))
                for v, x in enumerate(values):
                    hist[j, v] += np.bincount(key, x, cells)
        return np.concatenate([hist.ravel(), squares] if one else [hist.ravel()])


STATS_SCHEMA = "tree int, stats binary"


def _add_up(level: _Level):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks = []
        for b in batches:
            for r in b.to_pylist():
                y = np.frombuffer(r["y"], np.uint8 if level.groups > 1 else np.float64)
                blocks.append((r["block"], r["n"], np.frombuffer(r["bins"], np.uint8), y, np.frombuffer(r["w"])))
        if not blocks:
            return
        for tree in level.trees:
            sums = level.add_up(tree, blocks)
            kind = np.float64 if level.groups == 1 or level.weighted else np.int64
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()),
                                              "stats": pa.array([sums.astype(kind).tobytes()], pa.binary())})
    return run


# ------------------------------------------------------------------ splits


def best_splits(level: _Level, tree: int, sums: np.ndarray, min_rows: int, min_gain: float) -> np.ndarray:
    """Per slot: gain (-1 where the node stays a leaf), feature, cut, then the
    statistics of the node, of its left and of its right child. Statistics are
    the class weights, or (weight, sum, sum of squares), and the rows in the bag."""
    tried = level.trees[tree][2]
    (m, k), one = tried.shape, level.groups == 1
    if one:
        sums, squares = sums[:-m], sums[-m:]
    h = sums.reshape(k, level.values(), m, level.groups, BINS)
    left = np.cumsum(h, axis=-1)
    total, left = left[..., -1:], left[..., :-1]

    def parts(x):
        """(weight, what is squared, rows) of every candidate."""
        weight = x[:, 0].sum(axis=2)
        raw = x[:, -1].sum(axis=2) if level.weighted else weight
        return weight, x[:, 1] if one else x[:, 0], raw
    score = []
    with np.errstate(divide="ignore", invalid="ignore"):
        sides = [parts(x) for x in (left, total - left, total)]
        score = [(x * x).sum(axis=2) / w for w, x, _ in sides]
        gain = (score[0] + score[1] - score[2]) / sides[2][0]
    fits = (sides[0][2] >= min_rows) & (sides[1][2] >= min_rows) & (sides[0][0] > 0) & (sides[1][0] > 0)
    floor = (1e-14 * squares / np.maximum(total[0, 0, :, 0, 0], 1e-300))[None, :, None] if one else 1e-12
    gain = np.where(fits & (gain > floor) & (gain >= min_gain), gain, -1.0)
    flat = gain.transpose(1, 0, 2).reshape(m, -1)
    best = flat.argmax(axis=1)
    j, cut, slot = best // (BINS - 1), best % (BINS - 1), np.arange(m)

    def stats(x, at):
        rows = x[j, -1, slot, :, at].sum(axis=1) if level.weighted else x[j, 0, slot, :, at].sum(axis=1)
        if not one:
            return np.column_stack([x[j, 0, slot, :, at], rows])
        second = x[j, 2, slot, 0, at] if level.squares else np.zeros(m)
        return np.column_stack([x[j, 0, slot, 0, at], x[j, 1, slot, 0, at], second, rows])
    whole = stats(total, 0)
    if one:
        whole[:, 2] = squares
    lower = stats(left, cut)
    upper = whole - lower
    return np.column_stack([flat[slot, best], tried[slot, j], cut, whole, lower, upper])


def _choose(level: _Level, min_rows: int, min_gain: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, sums = np.float64 if level.groups == 1 or level.weighted else np.int64, {}
        for b in batches:
            for tree, stats in zip(b.column("tree").to_pylist(), b.column("stats")):
                part = np.frombuffer(stats.as_buffer(), kind)
                if tree in sums:
                    sums[tree] += part
                else:
                    sums[tree] = part.astype(np.float64)
        for tree, total in sums.items():
            found = best_splits(level, tree, total, min_rows, min_gain)
            yield pa.RecordBatch.from_pydict({"tree": pa.array([tree], pa.int32()),
                                              "stats": pa.array([found.tobytes()], pa.binary())})
    return run


# ------------------------------------------------------------------ trees


class _Tree:
    """Nodes in order of their level: children come behind their parent."""

    def __init__(self, width: int):
        self.feature, self.cut, self.left = np.zeros(1, np.int32), np.full(1, 255, np.uint8), np.zeros(1, np.int32)
        self.gain, self.stats, self.open = np.full(1, -1.0), np.zeros((1, width)), np.zeros(1, np.int32)

    def grow(self, found: np.ndarray, last: bool, groups: int) -> None:
        """Take the splits of the open nodes; their children are open next, but
        not those that hold one class."""
        width = self.stats.shape[1]
        self.stats[self.open] = found[:, 3:3 + width]
        found, parents = found[found[:, 0] >= 0], self.open[found[:, 0] >= 0]
        first, n = len(self.left), 2 * len(parents)
        self.gain[parents], self.feature[parents], self.cut[parents] = found[:, 0], found[:, 1], found[:, 2]
        self.left[parents] = first + 2 * np.arange(len(parents))
        new = np.arange(first, first + n, dtype=np.int32)
        self.left, self.feature = np.concatenate([self.left, new]), np.concatenate([self.feature, np.zeros(n, np.int32)])
        self.cut, self.gain = np.concatenate([self.cut, np.full(n, 255, np.uint8)]), np.concatenate([self.gain, np.full(n, -1.0)])
        self.stats = np.concatenate([self.stats, found[:, 3 + width:].reshape(n, width)])
        self.open = new[:0] if last else new
        if groups > 1 and not last:
            self.open = new[(self.stats[new, :-1] > 0).sum(axis=1) > 1]

    def nodes(self, cuts, groups: int) -> dict:
        """The columns of MLlib's nodes, without pairs of leaves that predict the same."""
        s, leaf = self.stats[:, :-1], self.gain < 0
        if groups > 1:
            n = np.maximum(s.sum(axis=1), 1e-300)
            prediction, impurity = s.argmax(axis=1).astype(float), 1.0 - ((s / n[:, None]) ** 2).sum(axis=1)
        else:
            n = np.maximum(s[:, 0], 1e-300)
            prediction = s[:, 1] / n
            impurity = np.maximum(s[:, 2] / n - prediction ** 2, 0.0)
        while True:
            inner = (~leaf).nonzero()[0]
            a = self.left[inner]
            same = leaf[a] & leaf[a + 1] & (prediction[a] == prediction[a + 1])
            if not same.any():
                break
            leaf[inner[same]] = True
        kept, level = np.zeros(len(leaf), bool), np.zeros(1, np.int64)
        while len(level):
            kept[level] = True
            a = self.left[level[~leaf[level]]]
            level = np.concatenate([a, a + 1])
        leaf, number = leaf[kept], np.cumsum(kept) - 1
        left = np.where(leaf, -1, number[self.left[kept]])
        feature, cut = np.where(leaf, -1, self.feature[kept]), self.cut[kept]
        table = np.full((len(cuts), BINS), np.nan)
        for i, c in enumerate(cuts):
            table[i, :len(c)] = c
        return {"id": np.arange(kept.sum()), "prediction": prediction[kept], "impurity": impurity[kept],
                "impurityStats": s[kept], "rawCount": self.stats[kept, -1].round().astype(np.int64),
                "gain": np.where(leaf, -1.0, self.gain[kept]), "leftChild": left, "rightChild": np.where(leaf, -1, left + 1),
                "featureIndex": feature, "at": table[feature[~leaf], cut[~leaf]]}


def _model(learner, trees: list[_Tree], cuts, groups: int, spark):
    """MLlib's model: one of no rows to speak of is saved, its nodes are written
    anew, and it is loaded."""
    classifier = groups > 1
    rows = [(Vectors.dense([float(i)] * len(cuts)), float(i), 1.0) for i in range(max(groups, 2))]
    names = [learner.getFeaturesCol(), learner.getLabelCol()]
    if learner.isDefined("weightCol") and learner.getWeightCol():
        names.append(learner.getWeightCol())
    small = spark.createDataFrame([r[:len(names)] for r in rows], names).coalesce(1)
    path = scratch_path(spark, "forest")
    learner.fit(small).write().overwrite().save(path)
    shape = spark.read.parquet(f"{path}/data").schema
    parts = [t.nodes(cuts, groups) for t in trees]
    cols = {c: np.concatenate([p[c] for p in parts]) for c in parts[0]}

    def lists(values, lengths):
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()))
    n, width = cols["impurityStats"].shape
    split = pa.StructArray.from_arrays([
        pa.array(cols["featureIndex"], pa.int32()), lists(cols["at"], cols["featureIndex"] >= 0),
        pa.array(np.full(n, -1), pa.int32())], ["featureIndex", "leftCategoriesOrThreshold", "numCategories"])
    kinds = {"id": pa.int32(), "prediction": pa.float64(), "impurity": pa.float64(), "impurityStats": None,
             "rawCount": pa.int64(), "gain": pa.float64(), "leftChild": pa.int32(), "rightChild": pa.int32()}
    node = pa.StructArray.from_arrays([*[pa.array(cols[c], k) if k else lists(cols[c].ravel(), np.full(n, width))
                                         for c, k in kinds.items()], split], [*kinds, "split"])
    tree = pa.array(np.repeat(np.arange(len(parts)), [len(p["id"]) for p in parts]), pa.int32())
    table = spark.createDataFrame(pa.Table.from_arrays([tree, node], ["treeID", "nodeData"]), schema=shape)
    table.coalesce(1).write.mode("overwrite").parquet(f"{path}/data")
    return (RandomForestClassificationModel if classifier else RandomForestRegressionModel).load(path)


def fit_forest(learner, train: DataFrame):
    """``learner`` (one that ``takes`` accepts) fitted on ``train``; by MLlib where
    a row is odd, a label is no class or a feature is categorical."""
    spark, classifier = train.sparkSession, isinstance(learner, RandomForestClassifier)
    weighted = learner.isDefined("weightCol") and bool(learner.getWeightCol())
    vector = learner.getFeaturesCol()
    rows = train.select(vector_to_array(vector).alias("x"), F.col(learner.getLabelCol()).cast("double").alias("y"),
                        (F.col(learner.getWeightCol()) if weighted else F.lit(1.0)).cast("double").alias("w"))
    first, attrs = rows.select(F.size("x")).first(), train.schema[vector].metadata.get("ml_attr", {}).get("attrs", {})
    known = None if first is None or {"nominal", "binary"} & set(attrs) else _survey(rows, first[0])
    if known is None or classifier and (known["broken"] or known["lo"] < 0 or known["hi"] > 99):
        return learner.fit(train)
    cuts, groups = known["cuts"], max(2, int(known["hi"]) + 1) if classifier else 1
    tried = _subset(learner, classifier, len(cuts))
    packed = rows.mapInArrow(_pack(cuts, classifier, weighted), BLOCK_SCHEMA)
    blocks = materialize(packed, "forest-rows")
    seed, depth, count = learner.getSeed(), learner.getMaxDepth(), learner.getNumTrees()
    trees = [_Tree((groups if classifier else 3) + 1) for _ in range(count)]
    try:
        for d in range(max(depth, 1)):
            rng, open_trees = np.random.default_rng([seed & 0xFFFFFFFF, d]), {}
            for i, t in enumerate(trees):
                m = len(t.open)
                if m:
                    slots = np.full(len(t.left), -1, np.int64)
                    slots[t.open] = np.arange(m)
                    some = rng.random((m, len(cuts))).argsort(axis=1)[:, :tried] if tried < len(cuts) else np.tile(np.arange(tried), (m, 1))
                    open_trees[i] = ((t.feature, t.cut, t.left), slots, np.sort(some, axis=1).astype(np.int32))
            if not open_trees:
                break
            level = _Level(d, seed, learner.getBootstrap(), groups, weighted, not classifier and d >= depth - 1, open_trees)
            sums = blocks.mapInArrow(_add_up(level), STATS_SCHEMA).repartition(min(len(open_trees), 48), "tree")
            found = sums.mapInArrow(_choose(level, learner.getMinInstancesPerNode(), learner.getMinInfoGain()), STATS_SCHEMA)
            for r in found.collect():
                splits = np.frombuffer(r["stats"]).reshape(len(trees[r["tree"]].open), -1).copy()
                if depth == 0:
                    splits[:, 0] = -1.0
                trees[r["tree"]].grow(splits, d >= depth - 1, groups)
    finally:
        release(blocks)
    return _model(learner, trees, cuts, groups, spark)
