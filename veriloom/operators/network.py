"""Fits of Spark's perceptron whose passes over the rows are matrix products in the tasks."""

from __future__ import annotations

import sys
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.classification import MultilayerPerceptronClassificationModel, MultilayerPerceptronClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veriloom.session import stored

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of the library

#: Steps that L-BFGS remembers, rows of one product, and the relative gain that so many rounds must make together.
MEMORY, ROWS, TOLERANCE, PATIENCE = 10, 2048, 1e-6, 20


def _layers(weights: np.ndarray, sizes: Sequence[int]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Matrix (out, in) and offset of each layer, as Spark lays them out: a matrix by columns, then its offsets."""
    out, at = [], 0
    for a, b in zip(sizes[:-1], sizes[1:]):
        out.append((weights[at:at + a * b].reshape(b, a, order="F"), weights[at + a * b:at + a * b + b]))
        at += a * b + b
    return out


def loss_and_slope(weights: np.ndarray, sizes: Sequence[int], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Sum of the rows' log losses and its gradient; hidden layers are logistic, the last one softmax."""
    # logistic(z) is (tanh(z / 2) + 1) / 2, which takes fewer passes over the block
    half = np.float32(0.5)
    layers, seen = [(w.astype(np.float32), b.astype(np.float32)) for w, b in _layers(weights, sizes)], [x]
    for w, b in layers[:-1]:
        z = seen[-1] @ (w * half).T
        z += b * half
        np.tanh(z, out=z)
        z *= half
        z += half
        seen.append(z)
    z = seen[-1] @ layers[-1][0].T + layers[-1][1]
    z -= z.max(axis=1, keepdims=True)
    total = np.log(np.exp(z).sum(axis=1, keepdims=True))
    loss = float((total[:, 0] - z[np.arange(len(y)), y]).sum(dtype=np.float64))
    g = np.exp(z - total)
    g[np.arange(len(y)), y] -= 1
    slopes = []
    for (w, _), below in zip(reversed(layers), reversed(seen)):
        slopes.append(np.concatenate([(g.T @ below).ravel(order="F"), np.ones(len(g), np.float32) @ g]))
        if below is not x:
            g = g @ w
            g *= below
            g -= g * below
    return loss, np.concatenate(slopes[::-1]).astype(np.float64)


def _pass(rows: DataFrame, sizes: Sequence[int]) -> Callable[[np.ndarray], tuple[float, np.ndarray]]:
    """Mean loss and slope of all rows at some weights: one sum a task, added up by Spark.

    The rows are written once more as the bytes of blocks of them, which Spark moves as a whole in every pass.
    """
    spark, width = rows.sparkSession, sizes[0]

    def packed(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(-1, width)
            y = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int32, copy=False)
            cuts = range(0, len(y), ROWS)
            if len(y):
                yield pa.record_batch({"x": pa.array([x[lo:lo + ROWS].tobytes() for lo in cuts], pa.binary()), "y": pa.array([y[lo:lo + ROWS].tobytes() for lo in cuts], pa.binary())})

    blocks = stored(rows.mapInArrow(packed, "x binary, y binary"), "blocks")

    def at(weights: np.ndarray) -> tuple[float, np.ndarray]:
        sent = spark.sparkContext.broadcast(weights.astype(np.float32))  # a fixed number of weights

        def sums(batches):
            total = np.zeros(len(sent.value) + 2)
            for batch in batches:
                for block_x, block_y in zip(*batch.columns):
                    y = np.frombuffer(block_y.as_buffer(), np.int32)
                    loss, slope = loss_and_slope(sent.value, sizes, np.frombuffer(block_x.as_buffer(), np.float32).reshape(-1, width), y)
                    total[0] += loss
                    total[1] += len(y)
                    total[2:] += slope
            if total[1]:
                yield pa.record_batch({"s": pa.array([total], pa.list_(pa.float64()))})

        added = blocks.mapInArrow(sums, "s array<double>").select(Summarizer.sum(array_to_vector("s"))).first()[0].toArray()
        sent.destroy()
        if not len(added) or not added[1]:
            raise ValueError("no rows to train on")
        return added[0] / added[1], added[2:] / added[1]
    return at


def minimize(at: Callable[[np.ndarray], tuple[float, np.ndarray]], w: np.ndarray, rounds: int) -> np.ndarray:
    """L-BFGS: as many rounds as asked for, or until PATIENCE of them gain no more than TOLERANCE of the first loss."""
    (loss, slope), steps = at(w), []
    losses = [loss]
    for _ in range(rounds):
        d, kept = -slope, []
        for s, y in reversed(steps):
            a = (s @ d) / (y @ s)
            kept.append(a)
            d = d - a * y
        if steps:
            s, y = steps[-1]
            d = d * ((s @ y) / (y @ y))
        for (s, y), a in zip(steps, reversed(kept)):
            d = d + (a - (y @ d) / (y @ s)) * s
        if d @ slope >= 0:
            d, steps = -slope, []
        size, low, high, best = 1.0 if steps else 1 / max(float(np.linalg.norm(slope)), 1e-12), 0.0, None, None
        for _ in range(20):  # weak Wolfe conditions by bisection
            there, new = at(w + size * d)
            if not there <= loss + 1e-4 * size * (d @ slope):
                high = size
            else:
                best = (size, there, new)
                if new @ d >= 0.9 * (slope @ d):
                    break
                low = size
            size = 2 * low if high is None else (low + high) / 2
        if best is None:
            break
        size, there, new = best
        s, y = size * d, new - slope
        if s @ y > 0:
            steps = [*steps, (s, y)][-MEMORY:]
        w, loss, slope = w + s, there, new
        losses.append(loss)
        if len(losses) > PATIENCE and losses[-1 - PATIENCE] - loss <= TOLERANCE * losses[0]:
            break
    return w


def fit_network(df: DataFrame, features: str, label: str, sizes: Sequence[int], rounds: int, seed: int) -> MultilayerPerceptronClassificationModel:
    """Spark's perceptron model with weights found by L-BFGS over all rows, whose features are written once as 4-byte numbers."""
    rows = stored(df.select(vector_to_array(features, "float32").alias("x"), F.col(label).cast("int").alias("y")), "inputs")
    shape = df.sparkSession.createDataFrame([(Vectors.dense([0.0] * sizes[0]), float(i)) for i in range(sizes[-1])], ["features", label])
    still = MultilayerPerceptronClassifier(labelCol=label, layers=list(sizes), maxIter=0, seed=seed)  # no round: the weights that Spark starts from, or those given
    weights = minimize(_pass(rows, sizes), still.fit(shape).weights.toArray(), rounds)
    return still.setInitialWeights(Vectors.dense(weights)).fit(shape)
