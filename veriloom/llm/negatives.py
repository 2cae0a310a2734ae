"""Hard negatives by a multiway hyperplane tree with distance ranges between sibling subtrees."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.llm.common import stored

#: Vectors the split points are chosen from at most: those whose id hashes lowest.
SAMPLE_ROWS = 1 << 16
#: Split points of a node, and vectors a leaf should hold, about.
WAYS, LEAF_ROWS = 12, 4096
#: Vectors and queries that meet in one group at most, about.
GROUP_VECTORS, GROUP_QUERIES = 1 << 14, 1 << 12
SCALE = 256
#: Sums of products below this are exact in doubles.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Scaled components stay below this, so that squared norms are finite.
LARGEST = 1e150


@dataclass
class Node:
    """A leaf, or split points with a child each.

    ``low[i, j]`` and ``high[i, j]`` bound the distances from split point i to what
    lies below child j; ``least`` and ``most`` bound the squared norms there.
    """

    points: np.ndarray | None = None
    children: list[Node] = field(default_factory=list)
    low: np.ndarray | None = None
    high: np.ndarray | None = None
    least: np.ndarray | None = None
    most: np.ndarray | None = None
    number: int = -1


def apart(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of rows to points."""
    return np.sqrt(np.maximum(0, (x ** 2).sum(1)[:, None] - 2 * x @ points.T + (points ** 2).sum(1)))


def spread_points(x: np.ndarray, ways: int, rng) -> np.ndarray:
    """Up to ``ways`` different rows far from each other: of three times as many drawn, each time the one farthest from those taken."""
    drawn = x[rng.permutation(len(x))[:3 * ways]]
    taken, far = [0], apart(drawn, drawn[:1])[:, 0]
    while len(taken) < ways and far.max() > 0:
        taken.append(int(far.argmax()))
        far = np.minimum(far, apart(drawn, drawn[taken[-1:]])[:, 0])
        far[taken] = 0
    return drawn[taken]


def fit(sample: np.ndarray, rows: int, ways: int = WAYS, leaf_rows: int = LEAF_ROWS, seed: int = 11) -> list[Node]:
    """A tree for ``rows`` vectors from a sample of them, as the list of its nodes, the root first.

    A node is split while its share of the sample stands for more than
    ``leaf_rows`` vectors, has four times as many vectors as split points, and
    holds different ones; so the tree has fewer nodes than the sample has rows.
    """
    rng, nodes = np.random.default_rng(seed), [Node()]
    todo = [(nodes[0], sample)]
    while todo:
        node, x = todo.pop()
        if len(x) * rows <= leaf_rows * max(1, len(sample)) or len(x) < 4 * ways:
            continue
        points = spread_points(x, ways, rng)
        if len(points) < 2:
            continue
        near = apart(x, points).argmin(1)
        node.points, node.children = points, [Node() for _ in points]
        nodes += node.children
        todo += [(child, x[near == j]) for j, child in enumerate(node.children)]
    for i, node in enumerate(nodes):
        node.number = i
    return nodes


def descend(nodes: list[Node], x: np.ndarray, seen: Callable | None = None) -> np.ndarray:
    """The leaf of each row: at every node the child of the nearest split point. ``seen(node, distances, child)`` is told every step."""
    leaf = np.zeros(len(x), dtype=np.int32)
    todo = [(nodes[0], np.arange(len(x)))]
    while todo:
        node, rows = todo.pop()
        if node.points is None or not len(rows):
            leaf[rows] = node.number
            continue
        distance = apart(x[rows], node.points)
        near = distance.argmin(1)
        if seen:
            seen(node, rows, distance, near)
        todo += [(child, rows[near == j]) for j, child in enumerate(node.children)]
    return leaf


def reach(nodes: list[Node], queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(leaf, queries that may find something there): inner products asked for lie in one of a query's windows ``low`` to ``high``.

    A window of inner products is an annulus of distances d^2 = |q|^2 + |x|^2 - 2 s
    once |x| is bounded. What lies in it is, by the triangle inequality, between
    d_low - d(q, p) or d(q, p) - d_high and d(q, p) + d_high away from a split
    point p. A sibling whose range from any p misses that is left out. Windows
    without a value (low > high) reach nothing.
    """
    norm = (queries ** 2).sum(1)
    wide = low <= high
    found, todo = [], [(nodes[0], np.flatnonzero(wide.any(1)))]
    while todo:
        node, rows = todo.pop()
        if not len(rows):
            continue
        if node.points is None:
            found.append((node.number, rows))
            continue
        d = apart(queries[rows], node.points)
        for j, child in enumerate(node.children):
            if not np.isfinite(node.least[j]):
                continue  # nothing lies there
            size = norm[rows] + node.most[j] + 1
            slack = 1e-9 * size
            outer = norm[rows][:, None] + node.most[j] - 2 * low[rows] + slack[:, None]  # squared, per window
            inner = norm[rows][:, None] + node.least[j] - 2 * high[rows] - slack[:, None]
            alive = np.zeros(len(rows), dtype=bool)
            for w in range(low.shape[1]):
                d_high = np.sqrt(np.maximum(0, outer[:, w]))[:, None]
                d_low = np.sqrt(np.maximum(0, inner[:, w]))[:, None]
                rounding = 1e-6 * np.sqrt(size)[:, None]
                nearest, farthest = np.maximum(d_low - d, d - d_high) - rounding, d + d_high + rounding
                alive |= wide[rows, w] & (outer[:, w] >= 0) & ((node.high[:, j] >= nearest) & (node.low[:, j] <= farthest)).all(1)
            todo.append((child, rows[alive]))
    return found


def integers(x: np.ndarray, scale: float) -> np.ndarray:
    return np.floor(scale * x.astype(float))


def products(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of integer vectors, one row a query: by doubles where they are exact, else by whole numbers held within 64 bits."""
    bound = np.sqrt((queries ** 2).sum(1).max() * (vectors ** 2).sum(1).max()) if len(queries) and len(vectors) else 0
    if bound * 2 < EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.array([[int(c) for c in q] for q in queries], dtype=object) @ np.array([[int(c) for c in v] for v in vectors], dtype=object).T
    return np.clip(whole, LEAST, MOST).astype(np.int64)


def _matrix(raw, size: int) -> np.ndarray:
    return np.frombuffer(b"".join(raw), dtype="<f8").reshape(-1, size)


def _encode_batches(batches, nodes: list[Node], size: int, scale: float):
    for batch in batches:
        if batch.num_rows:
            x = integers(batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(-1, size), scale)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(descend(nodes, x)), pa.array(list(map(bytes, x)), pa.binary())],
                                             names=["vec_id", "label", "leaf", "vector"])


def _range_batches(batches, nodes: list[Node], size: int):
    """Per node and pair (split point, child): least and largest distance; as split point -1 the squared norms below the child."""
    low: dict = {}
    high: dict = {}

    def widen(key, a, b):
        low[key], high[key] = min(low.get(key, np.inf), a), max(high.get(key, -np.inf), b)

    for batch in batches:
        x = _matrix(batch.column(0).to_pylist(), size)
        norm = (x ** 2).sum(1)

        def seen(node, rows, distance, near):
            for j in np.unique(near):
                mine = near == j
                lows, highs, norms = distance[mine].min(0), distance[mine].max(0), norm[rows[mine]]
                widen((node.number, -1, int(j)), float(norms.min()), float(norms.max()))
                for i, (a, b) in enumerate(zip(lows.tolist(), highs.tolist())):
                    widen((node.number, i, int(j)), a, b)

        descend(nodes, x, seen)
    if low:
        keys = [pa.array([k[i] for k in low], pa.int32()) for i in range(3)]
        yield pa.RecordBatch.from_arrays([*keys, pa.array(list(low.values())), pa.array([high[k] for k in low])], names=["node", "i", "j", "low", "high"])


def _ranged(codes: DataFrame, nodes: list[Node], size: int) -> None:
    """Fills in the ranges of all nodes from all vectors; as many numbers reach the driver as the tree has pairs of siblings."""
    for node in nodes:
        if node.points is not None:
            n = len(node.points)
            node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
            node.least, node.most = np.full(n, np.inf), np.full(n, -np.inf)
    ranges = (codes.select("vector").mapInArrow(lambda it: _range_batches(it, nodes, size), "node int, i int, j int, low double, high double")
              .groupBy("node", "i", "j").agg(F.min("low").alias("low"), F.max("high").alias("high")))
    for r in ranges.toLocalIterator():
        node = nodes[r["node"]]
        if r["i"] < 0:
            node.least[r["j"]], node.most[r["j"]] = r["low"], r["high"]
        else:
            node.low[r["i"], r["j"]], node.high[r["i"], r["j"]] = r["low"], r["high"]


def _route_batches(batches, nodes: list[Node], size: int, first: bool):
    """Which leaves a query has to look at: its own one first, later all others that its windows reach."""
    for batch in batches:
        cols = dict(zip(batch.schema.names, (c.to_pylist() for c in batch.columns)))
        if not cols["query_id"]:
            continue
        q = _matrix(cols["vector"], size)
        home = descend(nodes, q)
        if first:
            pairs = [(int(leaf), i) for i, leaf in enumerate(home)]
        else:
            low, high = (np.array(cols[c], dtype=float) for c in ("low", "high"))
            pairs = [(leaf, i) for leaf, rows in reach(nodes, q, low, high) for i in rows.tolist() if home[i] != leaf]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([cols[c][i] for _, i in pairs], batch.schema.field(c).type) for c in batch.schema.names), pa.array([leaf for leaf, _ in pairs], pa.int32())],
            names=[*batch.schema.names, "leaf"])


def first_of(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by descending score, then ascending id."""
    if len(score) > 4 * k:
        limit = np.partition(score, len(score) - k)[len(score) - k]
        near = np.flatnonzero(score >= limit)
        return near[np.lexsort((ids[near], -score[near]))[:k]]
    return np.lexsort((ids, -score))[:k]


@dataclass
class Search:
    """The indexed vectors: (vec_id, label, leaf, vector) with the tree over them."""

    codes: DataFrame
    nodes: list[Node]
    size: int
    rows_of: dict[int, int]
    group_vectors: int = GROUP_VECTORS
    group_queries: int = GROUP_QUERIES

    def _meet(self, asked: DataFrame, same: bool, k: int, first: bool) -> DataFrame:
        """(query_id, slot, found_id, score): per query, window and leaf looked at the k first."""
        nodes, size = self.nodes, self.size
        routed = stored(asked.mapInArrow(lambda it: _route_batches(it, nodes, size, first), _with_leaf(asked)), "routed")
        asked_of = {r["leaf"]: r["n"] for r in routed.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per leaf
        layout = {leaf: (-(-self.rows_of.get(leaf, 0) // self.group_vectors), -(-n // self.group_queries)) for leaf, n in asked_of.items() if self.rows_of.get(leaf)}
        spark = asked.sparkSession
        shape = F.broadcast(spark.createDataFrame([(leaf, *s) for leaf, s in layout.items()], "leaf int, parts int, blocks int"))  # a row per leaf
        left = (routed.join(shape, "leaf").withColumn("block", F.pmod(F.xxhash64("query_id"), "blocks").cast("int"))
                .withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts", "blocks"))
        right = (self.codes.join(shape, "leaf").withColumn("part", F.pmod(F.xxhash64("vec_id", "vector"), "parts").cast("int"))
                 .withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).drop("parts", "blocks"))

        def group(a, b):
            out: list = [[], [], [], []]
            if len(a) and len(b):
                x, ids, labels = _matrix(b["vector"], size), b["vec_id"].to_numpy(), b["label"].to_numpy()
                for at in range(0, len(a), 128):  # bounds the matrix of scores
                    part = a.iloc[at:at + 128]
                    scores = products(_matrix(part["vector"], size), x)
                    for qid, label, low, high, slots, score in zip(part["query_id"], part["label"], part["low"], part["high"], part["slots"], scores):
                        fits = ((labels == label) == same) & (ids != qid)
                        for lo, hi, slot in zip(low, high, slots):
                            inside = np.flatnonzero(fits & (score >= lo) & (score <= hi))
                            best = inside[first_of(score[inside], ids[inside], k)]
                            for values, more in zip(out, (np.full(len(best), qid), np.full(len(best), slot), ids[best], score[best])):
                                values.append(more)
            columns = (np.concatenate(o) if o else np.zeros(0, dtype=np.int64) for o in out)
            return pd.DataFrame(dict(zip(("query_id", "slot", "found_id", "score"), columns)))

        key = ["leaf", "part", "block"]
        return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(group, "query_id long, slot int, found_id long, score long")

    def first(self, asked: DataFrame, same: bool, k: int) -> DataFrame:
        """(query_id, slot, rank, found_id, score): the k highest scores of each window, ties by smaller id.

        ``asked`` has (query_id, label, vector, low, high, slots), a query's windows
        as arrays of whole scores. ``same`` asks for rows of the query's label, else
        for rows of others. What the query's own leaf holds narrows its windows from
        below before any other leaf is looked at; that changes no result.
        """
        near = stored(_top(self._meet(asked, same, k, True), k), "near")
        limits = (near.where(F.col("rank") == k).groupBy("query_id")
                  .agg(F.map_from_entries(F.collect_list(F.struct("slot", "score"))).alias("limit")))  # at most one entry a window
        narrowed = F.zip_with("low", "slots", lambda low, slot: F.greatest(low, F.coalesce(F.element_at("limit", slot), low)))
        rest = asked.join(limits, "query_id", "left").withColumn("low", F.coalesce(F.when(F.col("limit").isNull(), F.col("low")), narrowed)).drop("limit")
        return _top(near.drop("rank").unionByName(self._meet(rest, same, k, False)), k)


def _with_leaf(asked: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in asked.schema) + ", leaf int"


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id", "slot").orderBy(F.desc("score"), "found_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def valid_rows(vectors: DataFrame, column: str, label: str, scale: float) -> tuple[DataFrame, int]:
    """(vec_id, label, v) of the rows that take part, and the size of their vectors."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(label).cast("long").alias("label"), F.col(column).cast("array<double>").alias("v")).dropna()
    rows = rows.where((F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * scale) < LARGEST)))
    common = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return (rows.where(F.size("v") == common["n"]), common["n"]) if common else (rows.where("false"), 0)


def mine(vectors: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low_percent: int = 50, high_percent: int = 95,
         scale: float = SCALE, column: str = "embedding", label: str = "label", ways: int = WAYS, leaf_rows: int = LEAF_ROWS,
         sample_rows: int = SAMPLE_ROWS, group_vectors: int = GROUP_VECTORS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Anchors are rows whose vec_id is divisible by ``every``. Components x become
    floor(scale * x); a row's score is its inner product with the anchor. An
    anchor's positives are the first rows of its label, and for each of them the
    first rows of other labels are taken whose score is from ``low_percent`` to
    ``high_percent`` of the positive's. Higher scores are first, ties go to the smaller vec_id.

    A row takes part if its vec_id, label and vector are not null and the vector
    is as long as most, finite and below LARGEST when scaled. An anchor never finds its own vec_id; other
    rows that are repeated are found as often, a repeated anchor asks once, with
    the least (label, vector). Scores beyond 64 bits are held at their ends.

    Every row is in the tree and every answer exact: a subtree is left out only
    where its ranges rule out every window of the anchor.
    """
    spark = vectors.sparkSession
    rows, size = valid_rows(vectors, column, label, scale)
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("v").toPandas() if size else []
    if not len(sample):
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    nodes = fit(integers(np.stack(sample["v"].to_numpy()), scale), rows.count(), ways, leaf_rows)
    codes = stored(rows.mapInArrow(lambda it: _encode_batches(it, nodes, size, scale), "vec_id long, label long, leaf int, vector binary"), "leaves")
    _ranged(codes, nodes, size)
    rows_of = {r["leaf"]: r["n"] for r in codes.groupBy("leaf").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per leaf
    search = Search(codes, nodes, size, rows_of, group_vectors, group_queries)

    anchors = (codes.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id"))
               .agg(F.min(F.struct("label", "vector")).alias("a")).select("query_id", "a.label", "a.vector"))
    anywhere = anchors.withColumns({"low": F.array(F.lit(LEAST)), "high": F.array(F.lit(MOST)), "slots": F.array(F.lit(0))})
    liked = stored(search.first(anywhere, True, positives), "positives")
    # whole bounds: score * 100 >= low * positive, and <= high * positive
    whole = F.col("score").cast("decimal(20,0)")
    bound = {"low": F.ceil(whole * low_percent / 100).cast("long"), "high": F.floor(whole * high_percent / 100).cast("long")}
    windows = liked.withColumns(bound).where("low <= high").groupBy("query_id").agg(
        F.array_sort(F.collect_list(F.struct(F.col("rank").alias("slot"), "low", "high"))).alias("w"))  # at most one entry a positive
    asked = anchors.join(windows, "query_id").select("query_id", "label", "vector", F.col("w.low"), F.col("w.high"), F.col("w.slot").alias("slots"))
    found = search.first(asked, False, negatives)
    pairs = liked.select("query_id", F.col("rank").alias("slot"), F.col("found_id").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.join(pairs, ["query_id", "slot"]).select(
        F.col("query_id").alias("anchor_id"), "positive_id", F.col("rank").cast("int"), F.col("found_id").alias("negative_id"), "positive_score",
        F.col("score").alias("negative_score"))
