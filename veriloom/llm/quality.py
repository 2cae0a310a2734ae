"""Quality of documents from histogram gradient-boosted trees over document statistics."""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.llm.common import bound_batches, held_out

#: Labelled rows the trees are fitted on at most: those whose id hashes lowest.
SAMPLE_ROWS = 20_000
THRESHOLD = 0.3

FEATURES = (
    "log_bytes", "log_words", "word_len", "word_len_sd", "longest_word", "distinct_words", "top_word", "repeated_next", "upper_words",
    "upper", "digits", "non_ascii", "stops", "commas", "bangs", "bars", "symbols", "quotes", "spaces", "distinct_lines",
    "words_per_line", "ends_in_symbol", "capital_starts", "distinct_pairs")

_CLASS = np.zeros(256, dtype=np.int64)
for _i, _chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", bytes(range(128, 256)), b".?", b",;:", b"!", b"|",
                             b"#$%&*+/<=>@\\^_`~[]{}", b"\"'()-", b" \t\n\r\x0b\x0c"), 1):
    _CLASS[list(_chars)] = _i


def statistics(text: str | None) -> list[float]:
    """The FEATURES of a whole text; null counts as empty, and a share of nothing is 0."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = len(words), len(raw)
    share = np.zeros(11)
    for i in range(0, size, 1 << 20):
        share += np.bincount(_CLASS[np.frombuffer(raw[i:i + (1 << 20)], dtype=np.uint8)], minlength=11)
    share /= max(1, size)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n) if n else np.zeros(1)
    counts = Counter(words)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    m = max(1, n)
    ends = sum(not (w[-1:].isalnum() or w[-1] > 127 or w[-1:] in b".,;:?'\")") for w in words)
    return [np.log1p(size), np.log1p(n), lengths.mean(), lengths.std(), lengths.max(), len(counts) / m,
            max(counts.values(), default=0) / m, sum(map(bytes.__eq__, words, words[1:])) / m, sum(map(bytes.isupper, words)) / m,
            *share[1:11], len(set(lines)) / max(1, len(lines)), n / max(1, len(lines)), ends / m,
            sum(w[:1].isupper() for w in words) / m, len(set(zip(words, words[1:]))) / max(1, n - 1)]


@dataclass
class Trees:
    """Complete binary trees of one depth, flattened: row t of each array is a tree in heap order."""

    feature: np.ndarray
    cut: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1, all trees walked level by level for all rows at once."""
        raw = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        rows = np.arange(len(x))
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf):
            at = np.zeros(len(x), dtype=np.int64)
            for _ in range(depth):
                at = 2 * at + 1 + (x[rows, feature[at]] > cut[at])
            raw += leaf[at - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-raw))


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 4, rate: float = 0.15, bins: int = 64,
              ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Second-order boosting of the logistic loss on quantile histograms.

    ``least`` is the smallest sum of second derivatives a leaf may have. With no
    row the score is 0.5 everywhere, with one label it is that label's smoothed share.
    """
    n = len(x)
    p = (y.sum() + 1) / (n + 2)
    base = float(np.log(p / (1 - p)))
    inner, leaves = 2 ** depth - 1, 2 ** depth
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, inner), dtype=np.int64), np.zeros((0, inner)), np.zeros((0, leaves)), base)
    edges = [np.unique(np.quantile(x[:, j], np.arange(1, bins) / bins)) for j in range(x.shape[1])]
    code = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(edges)], 1)
    raw = np.full(n, base)
    trees = []
    for _ in range(rounds):
        prob = 1 / (1 + np.exp(-raw))
        g, h = prob - y, prob * (1 - prob)
        feature, cut, leaf = np.zeros(inner, dtype=np.int64), np.full(inner, np.inf), np.zeros(leaves)
        at = np.zeros(n, dtype=np.int64)
        for level in range(depth):
            first, width = 2 ** level - 1, 2 ** level
            local = at - first
            sums = [np.bincount(local, weights=w, minlength=width) for w in (g, h)]
            best, gain = np.zeros((width, 2), dtype=np.int64), np.full(width, 1e-9)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                k = len(e) + 1
                left = [np.bincount(local * k + code[:, j], weights=w, minlength=width * k).reshape(width, k).cumsum(1)[:, :-1] for w in (g, h)]
                right = [s[:, None] - q for s, q in zip(sums, left)]
                value = (left[0] ** 2 / (left[1] + ridge) + right[0] ** 2 / (right[1] + ridge)
                         - (sums[0] ** 2 / (sums[1] + ridge))[:, None])
                value[(left[1] < least) | (right[1] < least)] = 0
                top = value.argmax(1)
                better = value[np.arange(width), top] > gain
                gain[better] = value[np.arange(width), top][better]
                best[better] = np.stack([np.full(width, j), top], 1)[better]
            for i in np.flatnonzero(gain > 1e-9):
                feature[first + i], cut[first + i] = best[i, 0], edges[best[i, 0]][best[i, 1]]
            at = 2 * at + 1 + (x[np.arange(n), feature[at]] > cut[at])
        local = at - inner
        leaf = -rate * np.bincount(local, weights=g, minlength=leaves) / (np.bincount(local, weights=h, minlength=leaves) + ridge)
        raw += leaf[local]
        trees.append((feature, cut, leaf))
    return Trees(*(np.stack(a) for a in zip(*trees)), base)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from labelled documents that are not held out.

    At most ``sample_rows`` ids are taken, those with the lowest hash, so the ids
    may be broadcast and their statistics (24 numbers each) be sent to the
    driver. Several labels of one id count as their rounded mean; null ids and
    labels are left out; repeated documents count as often as they occur, up to
    the bound.
    """
    bound_batches(docs.sparkSession)
    known = (labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out())
             .groupBy(F.col("doc_id").cast("long").alias("_id")).agg((F.avg("quality") >= 0.5).cast("int").alias("_y"))
             .orderBy(F.xxhash64("_id"), "_id").limit(sample_rows))
    stats = F.pandas_udf(lambda texts: pd.Series([statistics(t) for t in texts]), "array<double>")
    rows = (docs.select(F.col("doc_id").cast("long").alias("_id"), "text").join(F.broadcast(known), "_id")
            .select("_id", "_y", stats("text").alias("x")).orderBy(F.xxhash64("_id"), "_id").limit(sample_rows).toPandas())
    rows = rows.sort_values("_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=float).reshape(len(rows), len(FEATURES))
    return fit_trees(x, rows["_y"].to_numpy(dtype=float))


def score(text: str | Column, model: Trees) -> Column:
    """The probability that a text is of label 1, from the text alone; null counts as empty."""
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(FEATURES))))

    return F.pandas_udf(scores, "double")(text)


def score_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``, repeated rows and null ids included.

    Whole texts are scored where they lie; no text is shuffled. Without labels all scores are 0.5.
    """
    model = fit(docs, labels)
    return (docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), score("text", model).alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with their columns."""
    model = fit(docs, labels)
    name = next(c for c in (f"_score{i}" for i in range(len(docs.columns) + 1)) if c not in docs.columns)
    return docs.withColumn(name, score("text", model)).where(F.col(name) >= threshold).drop(name)
