"""Forests and boosted trees whose passes over the rows are sums in the tasks; the results are Spark's models.

Columns become numbers of at most BINS ranges, kept as a byte a value in blocks of
rows. A level of all trees is one pass: tasks add up what every node has in each
range, Spark adds the tasks' sums and finds the best split of a node where they meet.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import RDD, StorageLevel, TaskContext, cloudpickle
from pyspark.ml.classification import GBTClassifier, RandomForestClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.session import scratch_path, shared_dir, stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the library

#: Ranges of a column, rows of a block, numbers that a pass may sum in a task, rounds after which the rows' scores are written.
BINS, ROWS, HELD, WRITTEN = 32, 1 << 16, 1 << 23, 10
#: Numbers of all tasks' sums that the driver adds up itself.
FEW = 1 << 21
#: Ranges of the scores by which the area under the ROC curve is found.
SCORES = 1 << 16
#: Poisson counts of mean one at 65,536 even places.
POISSON = np.searchsorted(np.cumsum(np.exp(-1) / np.cumprod([1, *range(1, 12)])), (np.arange(65536) + 0.5) / 65536).astype(np.uint8)


#: A plain tuple, which tasks read without the library: a number, a byte per column and row, labels, folds, and of each model that is being boosted a score
#: per row and the two numbers by which the row enters the sums of the round.
Block = tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list]


@dataclass(frozen=True)
class Spec:
    """How a model is grown. ``weights`` are those of labels 0 and 1; rows of ``test_fold`` take no part; a node looks at ``columns`` of the columns."""
    depth: int
    seed: int
    columns: int
    weights: tuple[float, float] = (1.0, 1.0)
    boosted: bool = True
    subsample: float = 1.0
    test_fold: int | None = None
    min_rows: int = 1


@dataclass
class Tree:
    """Nodes as lists: column (-1 for a leaf), last range on the left, first of two children, gain, and the two sums of the node's rows."""
    column: list = field(default_factory=lambda: [-1])
    cut: list = field(default_factory=lambda: [0])
    left: list = field(default_factory=lambda: [-1])
    gain: list = field(default_factory=lambda: [-1.0])
    sums: list = field(default_factory=lambda: [(0.0, 0.0)])

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column, last range on the left and first child; a leaf is its own left child, and every range is on its left."""
        column, cut, left = np.array(self.column), np.array(self.cut, np.uint8), np.array(self.left)
        leaf = column < 0
        return np.where(leaf, 0, column), np.where(leaf, np.uint8(255), cut), np.where(leaf, np.arange(len(leaf)), left)

    def values(self) -> np.ndarray:
        a, b = np.array(self.sums).T
        return np.divide(b, a, out=np.zeros_like(b), where=a > 0)


# ------------------------------------------------------------------ rows as blocks

def column_cuts(df: DataFrame, features: Sequence[str]) -> list[np.ndarray]:
    """Values at which each column is cut: between all values if they are few, else at even shares of the rows."""
    values = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    about = values.agg(*[F.approx_count_distinct(f).alias(f) for f in features]).first()
    cuts, many = {}, []
    for f in features:
        known = sorted(r[0] for r in values.where(F.col(f).isNotNull() & ~F.isnan(f)).select(f).distinct().collect()) if about[f] <= 2 * BINS else None
        if known is not None and len(known) <= BINS:
            cuts[f] = (np.array(known[:-1]) + np.array(known[1:])) / 2
        else:
            many.append(f)
    if many:
        for f, at in zip(many, values.approxQuantile(many, [i / BINS for i in range(1, BINS)], 0.001)):
            cuts[f] = np.unique(at)
    return [cuts[f] for f in features]


def blocks_of(df: DataFrame, features: Sequence[str], label: str, cuts: Sequence[np.ndarray], fold: str | None = None) -> RDD:
    """The rows as blocks, written once; null and NaN are in a column's last range, as Spark's models send them to the right."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, n, made = TaskContext.get().partitionId(), [], 0, 0

        def block(rows: pa.Table) -> pa.RecordBatch:
            columns = [c.to_numpy() for c in rows.columns]
            bins = np.stack([np.searchsorted(at, x) for at, x in zip(cuts, columns)]).astype(np.uint8)
            return pa.record_batch({"number": [(part << 32) + made], "bins": [bins.tobytes()], "y": [columns[-2].astype(np.uint8).tobytes()],
                                    "fold": [columns[-1].astype(np.int8).tobytes()]})
        for batch in batches:
            held, n = [*held, batch], n + batch.num_rows
            if n >= ROWS:
                yield block(pa.Table.from_batches(held))
                held, n, made = [], 0, made + 1
        if n:
            yield block(pa.Table.from_batches(held))

    width = len(features)
    rows = df.select(*[F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)], F.col(label).cast("int").alias("y"),
                     (F.lit(0) if fold is None else F.col(fold)).cast("int").alias("fold"))
    packed = stored(rows.mapInArrow(pack, "number long, bins binary, y binary, fold binary"), "blocks")

    def read(r) -> Block:
        y = np.frombuffer(r["y"], np.uint8)
        return r["number"], np.frombuffer(r["bins"], np.uint8).reshape(width, len(y)), y, np.frombuffer(r["fold"], np.int8), np.zeros((0, len(y)), np.float32), []
    return packed.rdd.map(read)


# ------------------------------------------------------------------ passes

def _nodes(tree: tuple, bins: np.ndarray, levels: int) -> np.ndarray:
    """The node of each row after some levels."""
    n = bins.shape[1]
    (column, cut, left), node, flat, at = tree, np.zeros(n, np.int64), bins.ravel(), np.arange(n)
    column = column * n
    for _ in range(levels):
        right = flat.take(column.take(node) + at) > cut.take(node)
        node = left.take(node)
        node += right
    return node


def _residual(y: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """What the next tree is to add, by Spark's loss 2 log(1 + exp(-2 y F))."""
    sign = np.where(y == 1, np.float32(1), np.float32(-1))
    return 4 * sign / (1 + np.exp(np.clip(2 * sign * scores, -60, 60)))


def _weighed(block: Block, spec: Spec, model: int, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The two numbers of each row that nodes sum: in a forest its draws and those of label 1, in boosting its weight and weighted residual."""
    at, _, y, fold, scores, _ = block
    n, rng = len(y), np.random.default_rng([spec.seed, number, at])
    if not spec.boosted:
        a = POISSON[rng.integers(0, 65536, n, dtype=np.uint16)].astype(np.float64)
    else:
        a = np.array(spec.weights)[y]
        if spec.subsample < 1:
            a = a * (rng.random(n, dtype=np.float32) < spec.subsample)
    if spec.test_fold is not None:
        a = a * (fold != spec.test_fold)
    if not spec.boosted:
        return a, a * y
    return a, a * (np.where(y == 1, 1.0, -1.0) if number == 0 else _residual(y, scores[model]))


def _best(spec: Spec, sums: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each node: gain, place of the column, last range on the left, the sums of its rows and of those on the left."""
    run = sums.cumsum(axis=2)
    whole, low = run[:, :, -1:], run[:, :, :-1]
    high = whole - low

    def inner(s):  # weight times impurity, but for a term that is the same for a node and its children
        a, b = s[..., 0], s[..., 1]
        if spec.boosted:
            return -np.divide(b * b, a, out=np.zeros_like(a), where=a > 0), a
        ones, noughts = spec.weights[1] * b, spec.weights[0] * (a - b)
        w = ones + noughts
        return w - np.divide(ones * ones + noughts * noughts, w, out=np.zeros_like(w), where=w > 0), w
    (all_, w), (l, _), (r, _) = inner(whole), inner(low), inner(high)
    gain = np.divide(all_ - l - r, w, out=np.zeros_like(l), where=w > 0)
    least = 1e-9 if spec.boosted else spec.min_rows
    gain = np.where((low[..., 0] >= least) & (high[..., 0] >= least), gain, -1.0).reshape(len(sums), -1)
    best, at = gain.argmax(axis=1), np.arange(len(sums))
    place, cut = np.divmod(best, BINS - 1)
    return gain[at, best], place, cut, whole[:, 0, 0], low.reshape(len(sums), -1, 2)[at, best]


def _pass(rows: RDD, specs: Sequence[Spec], trees: Sequence[Tree], fronts: Sequence[Sequence[int]], looks: Sequence[np.ndarray], numbers: Sequence[int],
          level: int, units: Sequence[tuple[int, int, int]]) -> list:
    """The best splits of some nodes: of ``units``, each a model and a range of its open nodes."""
    grown = {t: trees[t].arrays() for t, _, _ in units}
    slots = {}
    for t in grown:
        slots[t] = np.full(len(trees[t].column), -1)
        slots[t][fronts[t]] = np.arange(len(fronts[t]))
    columns = {t: looks[t] for t in grown}

    def sums(blocks: Iterator[Block]) -> Iterator:
        held: dict = {}
        for block in blocks:
            bins, last = block[1], None
            n, flat = bins.shape[1], bins.ravel()
            for t, lo, hi in units:
                if t != last:
                    a, b = block[5][t] if block[5] else _weighed(block, specs[t], t, numbers[t])
                    slot, last = slots[t].take(_nodes(grown[t], bins, level)), t
                open_ = (slot >= lo) & (slot < hi)
                look, wide = columns[t][lo:hi], columns[t].shape[1]
                size = (hi - lo) * wide * BINS
                if (t, lo) not in held:
                    held[t, lo] = np.zeros((2, size))
                every = wide == len(bins)
                if every and 4 * np.count_nonzero(open_) > 3 * n:  # the few others go to a place of their own
                    at, base, x, z = None, np.where(open_, slot - lo, hi - lo) * (wide * BINS), a, b
                else:
                    at = np.flatnonzero(open_ & (a > 0))
                    mine, x, z = slot.take(at) - lo, a.take(at), b.take(at)
                    base = mine * (wide * BINS)
                for j in range(wide):
                    place = base + (bins[j] if at is None else bins[j].take(at) if every else flat.take(look[:, j].take(mine) * n + at))
                    place += j * BINS
                    held[t, lo][0] += np.bincount(place, x, size)[:size]
                    held[t, lo][1] += np.bincount(place, z, size)[:size]
        yield from held.items()

    def best(item):
        (t, lo), s = item
        return t, lo, _best(specs[t], np.moveaxis(s.reshape(2, -1, columns[t].shape[1], BINS), 0, -1))
    tasks, numbered = rows.getNumPartitions(), sum(2 * BINS * (hi - lo) * columns[t].shape[1] for t, lo, hi in units)
    if numbered * tasks > FEW:
        return rows.mapPartitions(sums).reduceByKey(lambda x, y: x + y, min(len(units), tasks)).map(best).collect()
    added: dict = {}
    for key, s in rows.mapPartitions(sums).collect():  # FEW numbers, not worth a stage of their own
        added[key] = added[key] + s if key in added else s
    return [best(item) for item in added.items()]


def grow(rows: RDD, width: int, specs: Sequence[Spec], numbers: Sequence[int]) -> list[Tree]:
    """A tree of each model, all a level at a time. ``numbers`` set the draws apart; the tree of number 0 of a boosted model fits the label itself."""
    trees = [Tree() for _ in specs]
    fronts = [[0] for _ in specs]
    for level in range(max(s.depth for s in specs)):
        fronts = [f if level < s.depth else [] for f, s in zip(fronts, specs)]
        looks = [np.array([np.arange(width) if s.columns == width else
                           np.sort(np.random.default_rng([s.seed, number, node]).permutation(width)[:s.columns]) for node in front]).reshape(len(front), s.columns)
                 for s, number, front in zip(specs, numbers, fronts)]
        passes, size = [[]], 0
        for t, (s, front) in enumerate(zip(specs, fronts)):
            wide = max(1, HELD // (2 * BINS * s.columns))
            for lo in range(0, len(front), wide):
                hi = min(lo + wide, len(front))
                size += (hi - lo) * 2 * BINS * s.columns
                if size > HELD and passes[-1]:
                    passes.append([])
                    size = (hi - lo) * 2 * BINS * s.columns
                passes[-1].append((t, lo, hi))
        if not passes[-1]:
            break
        after: list[list[int]] = [[] for _ in specs]
        for units in passes:
            for t, lo, (gain, place, cut, whole, low) in sorted(_pass(rows, specs, trees, fronts, looks, numbers, level, units), key=lambda r: r[:2]):
                tree = trees[t]
                for i, (g, p, c) in enumerate(zip(gain.tolist(), place.tolist(), cut.tolist())):
                    node = fronts[t][lo + i]
                    tree.sums[node] = tuple(whole[i].tolist())
                    if g <= 1e-12:
                        continue
                    tree.column[node], tree.cut[node], tree.left[node], tree.gain[node] = int(looks[t][lo + i, p]), c, len(tree.column), g
                    after[t] += [len(tree.column), len(tree.column) + 1]
                    tree.column += [-1, -1]
                    tree.cut += [0, 0]
                    tree.left += [-1, -1]
                    tree.gain += [-1.0, -1.0]
                    tree.sums += [tuple(low[i].tolist()), tuple((whole[i] - low[i]).tolist())]
        fronts = after
    if not any(tree.sums[0][0] for tree in trees):
        raise ValueError("no rows to train on")
    return trees


class Boosting:
    """Models boosted side by side; the rows carry a score of each, which a round adds the new trees' to."""

    def __init__(self, spark: SparkSession, blocks: RDD, width: int, specs: Sequence[Spec], rates: Sequence[float]):
        shared_dir(spark)
        self.width, self.specs, self.rates, self.rounds = width, list(specs), list(rates), 0
        self.trees: list[list[Tree]] = [[] for _ in specs]
        models = len(self.specs)
        weighed = self._weighed(0)
        self.rows, self._old = blocks.map(lambda b: weighed((*b[:4], np.zeros((models, len(b[2])), np.float32), []))).persist(StorageLevel.MEMORY_AND_DISK), None

    def _weighed(self, number: int) -> Callable[[Block], Block]:
        specs = self.specs
        return lambda b: (*b[:5], [tuple(x.astype(np.float32) for x in _weighed(b, s, t, number)) for t, s in enumerate(specs)])

    def run(self, rounds: int) -> None:
        """Goes on for so many rounds."""
        for _ in range(rounds):
            new = grow(self.rows, self.width, self.specs, [self.rounds] * len(self.specs))
            rates = [1.0 if self.rounds == 0 else r for r in self.rates]
            for mine, tree in zip(self.trees, new):
                mine.append(tree)
            self._replace(self._added(new, rates))
            self.rounds += 1

    def keep(self, models: Sequence[int]) -> None:
        """Goes on with some of the models alone."""
        at = list(models)
        self.specs, self.rates, self.trees = ([have[i] for i in at] for have in (self.specs, self.rates, self.trees))
        self._replace(lambda b: (*b[:4], b[4][at], [b[5][i] for i in at]))

    def _added(self, new: Sequence[Tree], rates: Sequence[float]) -> Callable[[Block], Block]:
        grown = [(t.arrays(), (t.values() * r).astype(np.float32)) for t, r in zip(new, rates)]
        depths = [s.depth for s in self.specs]
        weighed = self._weighed(self.rounds + 1)
        return lambda b: weighed((*b[:4], b[4] + np.stack([v.take(_nodes(t, b[1], d)) for (t, v), d in zip(grown, depths)]), []))

    def _replace(self, change: Callable[[Block], Block]) -> None:
        """The rows two changes ago are let go: those before this one are read until it has been computed."""
        if self._old is not None:
            self._old.unpersist()
        self._old, self.rows = self.rows, self.rows.map(change).persist(StorageLevel.MEMORY_AND_DISK)
        if self.rounds % WRITTEN == WRITTEN - 1:
            self.rows.checkpoint()

    def areas(self) -> list[float]:
        """The area under the ROC curve of each model over the rows of its test fold, by SCORES ranges of the probability."""
        specs = self.specs

        def counts(blocks: Iterator[Block]) -> Iterator:
            for _, _, y, fold, scores, _ in blocks:
                for t, s in enumerate(specs):
                    mine = fold == s.test_fold
                    p = 1 / (1 + np.exp(np.clip(-2 * scores[t][mine].astype(np.float64), -60, 60)))
                    yield t, np.bincount(np.minimum((p * SCORES).astype(np.int64), SCORES - 1) * 2 + y[mine], minlength=2 * SCORES)
        found = dict(self.rows.mapPartitions(counts).reduceByKey(lambda x, y: x + y, len(specs)).mapValues(_area).collect())
        return [found[t] for t in range(len(specs))]

    def close(self) -> None:
        for rows in (self.rows, self._old):
            if rows is not None:
                rows.unpersist()


def _area(counts: np.ndarray) -> float:
    no, yes = counts.reshape(-1, 2).T.astype(float)
    below = np.cumsum(no) - no
    pairs = no.sum() * yes.sum()
    return float((yes * (below + no / 2)).sum() / pairs) if pairs else 0.0


# ------------------------------------------------------------------ Spark's models

def _model(spark: SparkSession, estimator, trees: Sequence[Tree], shares: Sequence[float], cuts: Sequence[np.ndarray], weights: tuple[float, float], counted: str):
    """Spark's model of these trees, read from its own format. A boosted node keeps no sum of squares, so its impurity is given as 0."""
    shape = spark.createDataFrame([(Vectors.dense([0.0] * len(cuts)), float(i), 1.0) for i in (0, 1)], ["features", estimator.getLabelCol(), "weight"])
    one, path = estimator.copy({estimator.getParam(counted): 1}).fit(shape), scratch_path(spark, "trees")
    one.write().save(path)
    meta = json.loads(spark.read.text(f"{path}/metadata").first()[0])
    meta["paramMap"][counted] = meta["numTrees"] = len(trees)
    data, about = spark.read.parquet(f"{path}/data").schema, spark.read.parquet(f"{path}/treesMetadata")
    text = about.first()[1]
    forest = isinstance(estimator, RandomForestClassifier)

    def node(tree: Tree, i: int) -> tuple:
        a, b = tree.sums[i]
        stats = [weights[0] * (a - b), weights[1] * b] if forest else [a, b, b * b / a if a else 0.0]
        whole = sum(stats[:2])
        impurity = 1 - (stats[0] / whole) ** 2 - (stats[1] / whole) ** 2 if forest and whole else 0.0
        prediction = float(stats[1] > stats[0]) if forest else (b / a if a else 0.0)
        split = (tree.column[i], [float(cuts[tree.column[i]][tree.cut[i]])], -1) if tree.column[i] >= 0 else (-1, [], -1)
        below = (tree.left[i], tree.left[i] + 1) if tree.column[i] >= 0 else (-1, -1)
        return i, prediction, impurity, stats, int(a) if forest else -1, tree.gain[i], *below, split

    nodes = [(t, node(tree, i)) for t, tree in enumerate(trees) for i in range(len(tree.column))]
    spark.createDataFrame(nodes, data, verifySchema=False).write.mode("overwrite").parquet(f"{path}/data")
    schema = about.schema
    spark.createDataFrame([(t, text, float(s)) for t, s in enumerate(shares)], schema).coalesce(1).write.mode("overwrite").parquet(f"{path}/treesMetadata")
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")
    return type(one).load(path)


def fit_forest(df: DataFrame, features: Sequence[str], label: str, weights: tuple[float, float], trees: int, depth: int, min_rows: int, seed: int):
    """Spark's forest model; every tree draws its rows with replacement and every node looks at the root of the number of columns, as in Spark."""
    spark, cuts = df.sparkSession, column_cuts(df, features)
    blocks = blocks_of(df, features, label, cuts).persist(StorageLevel.MEMORY_AND_DISK)
    columns = len(features) if trees == 1 else int(np.ceil(np.sqrt(len(features))))
    spec = Spec(depth, seed, columns, weights, boosted=False, min_rows=min_rows)
    grown = grow(blocks, len(features), [spec] * trees, range(trees))
    blocks.unpersist()
    estimator = RandomForestClassifier(labelCol=label, weightCol="weight", numTrees=trees, maxDepth=depth, minInstancesPerNode=min_rows, seed=seed)
    return _model(spark, estimator, grown, [1.0] * trees, cuts, weights, "numTrees")


def fit_boosted(df: DataFrame, features: Sequence[str], label: str, weights: tuple[float, float], rounds: int, rate: float, depth: int, subsample: float, seed: int):
    """Spark's model of boosted trees, with its loss and its weights of trees."""
    spark, cuts = df.sparkSession, column_cuts(df, features)
    fit = Boosting(spark, blocks_of(df, features, label, cuts), len(features), [Spec(depth, seed, len(features), weights, subsample=subsample)], [rate])
    fit.run(rounds)
    fit.close()
    estimator = GBTClassifier(labelCol=label, weightCol="weight", maxIter=rounds, stepSize=rate, maxDepth=depth, subsamplingRate=subsample, seed=seed)
    return _model(spark, estimator, fit.trees[0], [1.0, *[rate] * (rounds - 1)], cuts, weights, "maxIter")
