"""Nearest neighbours by one-bit codes of randomly rotated vectors, reranked where error bounds leave doubt."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.llm.common import stored

#: Vectors the clusters are fitted on at most: those whose id hashes lowest.
SAMPLE_ROWS = 16_384
CLUSTERS = 256
#: Clusters each query searches first; the others follow where the triangle inequality allows a nearer vector.
FIRST_PROBES = 4
#: Width of the error bounds in standard deviations of the estimate.
BOUND = 3.0
#: Vectors and queries of a task's group at most, about.
GROUP_VECTORS, GROUP_QUERIES = 1 << 15, 1 << 11


@dataclass
class Index:
    """What is fitted: a rotation, and centroids with the number of vectors and the largest distance in each cluster."""

    rotation: np.ndarray
    centroids: np.ndarray
    count: np.ndarray | None = None
    radius: np.ndarray | None = None


def valid(column: str, size: int):
    """Vectors of ``size`` finite components, not all zero."""
    c = F.col(column)
    return ((F.size(c) == size) & F.forall(c, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
            & F.exists(c, lambda x: x != 0))


def fit(vectors: np.ndarray, clusters: int = CLUSTERS, seed: int = 7, rounds: int = 8) -> Index:
    """k-means on a sample and a random rotation. Fewer vectors than 32 per cluster make fewer clusters."""
    rng = np.random.default_rng(seed)
    size = vectors.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((size, size)))[0]
    k = max(1, min(clusters, len(vectors) // 32))
    centroids = vectors[rng.permutation(len(vectors))[:k]].astype(float)
    for _ in range(rounds if k > 1 else 0):
        near = nearest(vectors, centroids)
        total = np.zeros_like(centroids)
        np.add.at(total, near, vectors)
        count = np.bincount(near, minlength=k)
        centroids[count > 0] = total[count > 0] / count[count > 0, None]
    if k == 1:
        centroids = vectors.mean(0, keepdims=True)
    return Index(rotation, centroids)


def nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), dtype=np.int64)
    for i in range(0, len(x), 4096):
        out[i:i + 4096] = (-2 * x[i:i + 4096] @ centroids.T + (centroids ** 2).sum(1)).argmin(1)
    return out


def encode(x: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(cluster, packed signs, norm of the residual, inner product of its direction with its code)."""
    cluster = nearest(x, index.centroids)
    residual = x - index.centroids[cluster]
    norm = np.sqrt((residual ** 2).sum(1))
    turned = residual @ index.rotation / np.where(norm, norm, 1)[:, None]
    return cluster, np.packbits(turned > 0, axis=1), norm, np.abs(turned).sum(1) / np.sqrt(x.shape[1])


def bounds(query: np.ndarray, centroid: np.ndarray, rotation: np.ndarray, signs: np.ndarray, norm: np.ndarray, fit_: np.ndarray,
           width: float) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper bounds of the squared distances of one query to the coded vectors of a cluster.

    The inner product of the directions is estimated by that with the code,
    divided by the code's own fit; its error has a standard deviation of
    sqrt((1 - fit^2) / fit^2 / (d - 1)).
    """
    d = len(query)
    away = query - centroid
    size = np.sqrt(away @ away)
    turned = away @ rotation / (size or 1.0)
    fit_ = np.maximum(fit_, 1e-9)
    estimate = (signs @ turned) / np.sqrt(d) / fit_
    error = width * np.sqrt(np.maximum(0, 1 - fit_ ** 2)) / fit_ / np.sqrt(max(1, d - 1))
    middle, slack = norm ** 2 + size ** 2 - 2 * norm * size * estimate, 2 * norm * size * error
    tiny = 1e-9 * (norm ** 2 + size ** 2)
    return middle - slack - tiny, middle + slack + tiny


def _apart(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    return np.sqrt(((vectors.astype(float) - query) ** 2).sum(1))


def search_group(query_ids, queries, limits, ids, vectors, signs, norm, fit_, centroid, rotation, k: int, width: float):
    """The k nearest of the group for each query within its limit: rows (query, vector, distance)."""
    out = [[], [], []]
    for qid, q, limit in zip(query_ids, queries, limits):
        low, high = bounds(q, centroid, rotation, signs, norm, fit_, width)
        others = np.flatnonzero(ids != qid)
        if len(others) > 4 * k:  # the best by estimate are measured first; their k-th distance bounds what else is worth it
            likely = others[np.argpartition((low + high)[others], 4 * k - 1)[:4 * k]]
            limit = min(limit, np.sort(_apart(vectors[likely], q))[k - 1])
        at = others[low[others] <= limit * limit * (1 + 1e-9)]
        apart = _apart(vectors[at], q)
        best = np.lexsort((ids[at], apart))[:k]
        out[0].append(np.full(len(best), qid))
        out[1].append(ids[at][best])
        out[2].append(apart[best])
    return [np.concatenate(o) if o else np.zeros(0) for o in out]


def _encode_batches(batches, index: Index, kind: str):
    for batch in batches:
        if not batch.num_rows:
            continue
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(batch.num_rows, -1)
        cluster, code, norm, own = encode(x.astype(float), index)
        rows = [pa.array(list(map(bytes, a)), pa.binary()) for a in (np.ascontiguousarray(x), code)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(cluster.astype(np.int32)), rows[0], rows[1], pa.array(norm), pa.array(own)],
                                         names=["vec_id", "cluster", "vector", "code", "norm", "fit"])


def _route_batches(batches, index: Index, kind: str, k: int, first: bool):
    """The clusters a query has to search: the nearest ones first, later those that may hold something within its limit."""
    for batch in batches:
        ids, raw, limits = (batch.column(i).to_pylist() for i in range(3))
        q = np.frombuffer(b"".join(raw), dtype=kind).reshape(len(ids), -1).astype(float)
        apart = np.sqrt(np.maximum(0, ((q[:, None, :] - index.centroids[None]) ** 2).sum(2)))
        order = apart.argsort(1, kind="stable")
        enough = np.cumsum(index.count[order], 1)
        home = (np.arange(order.shape[1]) < FIRST_PROBES) | (np.c_[np.zeros(len(ids)), enough[:, :-1]] <= k)
        if first:
            wanted = home
        else:
            at = np.take_along_axis(apart, order, 1)
            wanted = ~home & (at - index.radius[order] <= np.array(limits)[:, None] * (1 + 1e-9))
        wanted &= index.count[order] > 0
        row, place = np.nonzero(wanted)
        yield pa.RecordBatch.from_arrays(
            [pa.array([ids[i] for i in row], pa.int64()), pa.array([raw[i] for i in row], pa.binary()),
             pa.array([limits[i] for i in row], pa.float64()), pa.array(order[row, place].astype(np.int32))],
            names=["query_id", "query", "limit", "cluster"])


def _search(codes: DataFrame, routed: DataFrame, index: Index, kind: str, k: int, width: float) -> DataFrame:
    """Meets queries and vectors by cluster; large clusters and many queries are dealt to groups of bounded size."""
    asked = {r["cluster"]: r["n"] for r in routed.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row per cluster
    clusters = len(index.centroids)
    parts = np.maximum(1, -(-index.count // GROUP_VECTORS)).astype(int)
    blocks = np.array([max(1, -(-asked.get(c, 0) // GROUP_QUERIES)) for c in range(clusters)])
    wanted = F.array(*(F.lit(int(asked.get(c, 0) > 0)) for c in range(clusters)))
    n_parts, n_blocks = (F.element_at(F.array(*(F.lit(int(n)) for n in counts)), F.col("cluster") + 1) for counts in (parts, blocks))
    left = (routed.withColumn("block", F.pmod(F.xxhash64("query_id"), n_blocks).cast("int"))
            .withColumn("part", F.explode(F.sequence(F.lit(0), n_parts - 1))))
    right = (codes.where(F.element_at(wanted, F.col("cluster") + 1) == 1)
             .withColumn("part", F.pmod(F.xxhash64("vec_id"), n_parts).cast("int"))
             .withColumn("block", F.explode(F.sequence(F.lit(0), n_blocks - 1))))
    rotation, centroids = index.rotation, index.centroids

    def group(a, b):
        if not len(a) or not len(b):
            return pd.DataFrame({"query_id": pd.Series(dtype="int64"), "vec_id": pd.Series(dtype="int64"), "score": pd.Series(dtype="float64")})
        size = centroids.shape[1]
        queries = np.frombuffer(b"".join(a["query"]), dtype=kind).reshape(len(a), -1).astype(float)
        vectors = np.frombuffer(b"".join(b["vector"]), dtype=kind).reshape(len(b), -1)
        bits = np.unpackbits(np.frombuffer(b"".join(b["code"]), dtype=np.uint8).reshape(len(b), -1), axis=1)[:, :size]
        found = search_group(a["query_id"].to_numpy(), queries, a["limit"].to_numpy(), b["vec_id"].to_numpy(), vectors,
                             bits.astype(np.float32) * 2 - 1, b["norm"].to_numpy(), b["fit"].to_numpy(), centroids[a["cluster"].iloc[0]], rotation, k, width)
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), found)))

    key = ["cluster", "part", "block"]
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInPandas(group, "query_id long, vec_id long, score double")


def _top(found: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def neighbours(vectors: DataFrame, every: int = 100, k: int = 10, column: str = "embedding", clusters: int = CLUSTERS,
               sample_rows: int = SAMPLE_ROWS, width: float = BOUND) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest rows of each row whose vec_id is divisible by ``every``.

    Nearness is the Euclidean distance of the original vectors in double
    precision; ties go to the smaller vec_id. A row takes part if its vec_id is
    not null and its vector is valid: as long as most are, finite, not zero. A
    query never finds its own vec_id; other rows that are repeated are found as
    often. A query whose vec_id is repeated asks with the least of its vectors.
    Fewer candidates than k give fewer rows, an empty table none.

    Every vector is indexed. Codes decide what is compared exactly: a vector is
    left out only if its lower bound, ``width`` standard deviations below the
    estimate, is above the k-th distance measured so far. Clusters are left out only by the
    triangle inequality.
    """
    from pyspark.sql.types import DoubleType

    spark = vectors.sparkSession
    kind = "<f8" if isinstance(vectors.schema[column].dataType.elementType, DoubleType) else "<f4"
    rows = vectors.select(F.col("vec_id").cast("long"), F.col(column).alias("v")).where("vec_id is not null and v is not null")
    common = rows.groupBy(F.size("v").alias("n")).count().where("n > 0").orderBy(F.desc("count"), F.desc("n")).first()
    size = common["n"] if common else 0
    rows = rows.where(valid("v", size)) if size else rows.where("false")
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).toPandas()
    if not len(sample):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    index = fit(np.stack(sample["v"].to_numpy()).astype(float), clusters)
    codes = stored(rows.mapInArrow(lambda it, index=index: _encode_batches(it, index, kind),
                                   "vec_id long, cluster int, vector binary, code binary, norm double, fit double"), "codes")
    of = {r["cluster"]: r for r in codes.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("norm").alias("r")).collect()}
    n = len(index.centroids)
    index = Index(index.rotation, index.centroids, np.array([of[c]["n"] if c in of else 0 for c in range(n)]),
                  np.array([of[c]["r"] if c in of else 0.0 for c in range(n)]))
    queries = codes.where(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("vector").alias("query"))

    def route(asked: DataFrame, first: bool) -> DataFrame:
        return asked.mapInArrow(lambda it: _route_batches(it, index, kind, k, first), "query_id long, query binary, limit double, cluster int")

    near = stored(_top(_search(codes, route(queries.withColumn("limit", F.lit(float("inf"))), True), index, kind, k, width), k), "near")
    limits = near.where(F.col("rank") == k).select("query_id", F.col("score").alias("limit"))
    asked = queries.join(limits, "query_id", "left").withColumn("limit", F.coalesce("limit", F.lit(float("inf"))))
    far = _search(codes, route(asked, False), index, kind, k, width)
    return _top(near.drop("rank").unionByName(far), k).select("query_id", F.col("rank").cast("int"), "vec_id", "score")
