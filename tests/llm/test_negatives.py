import math

import numpy as np
import pytest

from veriloom.llm import negatives as N

SCHEMA = "vec_id long, embedding array<double>, label int, slot int, low long, leaf int"


def brute(rows, every=50, positives=5, negatives=3, low=50, high=95, scale=256):
    """Every anchor against every row, in whole numbers."""
    ok = [(i, [math.floor(scale * x) for x in v], c) for i, v, c in rows
          if i is not None and c is not None and v and all(x is not None and math.isfinite(x) for x in v)]
    lengths = [len(v) for _, v, _ in ok]
    ok = [r for r in ok if len(r[1]) == max(set(lengths), key=lambda n: (lengths.count(n), n))]
    anchors = {}
    for i, v, c in ok:
        if i % every == 0:
            anchors[i] = min(anchors.get(i, (c, np.array(v, float).tobytes(), v)), (c, np.array(v, float).tobytes(), v))
    out = []
    for a, (c, _, v) in anchors.items():
        scored = sorted((-max(N.LEAST, min(N.MOST, sum(x * y for x, y in zip(v, w)))), i, d) for i, w, d in ok if i != a)
        for s, i, _ in [x for x in scored if x[2] == c][:positives]:
            near = [x for x in scored if x[2] != c and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, i, n, x[1], -s, -x[0]) for n, x in enumerate(near, 1)]
    return sorted(out)


def mined(spark, rows, **how):
    found = N.mine(spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(3), **how)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def planted(rng, n, size, groups, noise, labels=4):
    centres = rng.standard_normal((groups, size))
    near = rng.integers(0, groups, n)
    x = centres[near] + noise * rng.standard_normal((n, size))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x * rng.uniform(0.2, 3, (n, 1)), rng.integers(0, labels, n)


@pytest.mark.parametrize("noise", [0.05, 3.0])
def test_negatives_equal_all_pairs(spark, noise):
    rng = np.random.default_rng(1)
    x, labels = planted(rng, 500, 6, 12, noise)
    rows = [(i, v.tolist(), int(c)) for i, (v, c) in enumerate(zip(x, labels))]
    rows += [(7000 + i, rows[3][1], 1) for i in range(40)] + [(10_000 + i, rows[150][1], int(i % 3)) for i in range(60)]  # ties
    rows += [(100, rows[5][1], 2), (100, rows[100][1], 0), (101, rows[101][1], 1)]  # repeated ids
    rows += [(None, rows[0][1], 1), (8000, None, 1), (8050, rows[0][1], None), (8100, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (8150, [float("nan")] * 6, 1),
             (8200, [float("inf")] * 6, 1), (8250, [1.0], 1), (8300, [], 1), (8350, [0.0] * 6, 1)]
    want = brute(rows, every=20)
    assert len(want) > 200
    assert mined(spark, rows, every=20, ways=3, leaf_rows=60, group_vectors=32, group_queries=20) == want
    assert mined(spark, rows, every=20) == want


def test_large_components_stay_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, (rng.standard_normal(3) * 10.0 ** rng.integers(3, 9)).tolist(), i % 2) for i in range(60)] + [(60, [1e140, 1.0, 1.0], 0), (70, [-1e140, 1.0, 1.0], 1)]
    assert mined(spark, rows, every=5, ways=2, leaf_rows=8) == brute(rows, every=5)


def test_ranges_rule_out_subtrees_and_lose_nothing():
    rng = np.random.default_rng(3)
    x = N.integers(planted(rng, 4000, 8, 30, 0.02)[0], 256)
    nodes = N.fit(x, len(x), ways=6, leaf_rows=100)
    leaf = N.descend(nodes, x)
    for node in nodes:
        if node.points is not None:
            n = len(node.points)
            node.low, node.high = np.full((n, n), np.inf), np.full((n, n), -np.inf)
            node.least, node.most = np.full(n, np.inf), np.full(n, -np.inf)

    def seen(node, rows, distance, near):
        for j in range(len(node.points)):
            if (near == j).any():
                node.low[:, j], node.high[:, j] = distance[near == j].min(0), distance[near == j].max(0)
                norms = (x[rows[near == j]] ** 2).sum(1)
                node.least[j], node.most[j] = norms.min(), norms.max()

    N.descend(nodes, x, seen)
    q = x[:200]
    scores = q @ x.T
    top = np.sort(scores, 1)[:, -6]
    windows = np.stack([np.floor(top * 0.8), np.full(200, 1.0)], 1), np.stack([np.floor(top * 0.95), np.full(200, -1.0)], 1)
    reached = np.zeros((200, len(nodes)), dtype=bool)
    for number, rows in N.reach(nodes, q, *windows):
        reached[rows, number] = True
    inside = (scores >= windows[0][:, :1]) & (scores <= windows[1][:, :1])
    assert all(reached[i, leaf[inside[i]]].all() for i in range(200))
    looked_at = reached[:, leaf].mean()
    assert looked_at < 0.6, looked_at


def test_few_rows(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(0, [1.0, 2.0], 1)]) == []
    assert mined(spark, [(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.8, 1.0], 0)]) == brute([(0, [1.0, 2.0], 1), (1, [1.0, 2.0], 1), (2, [0.8, 1.0], 0)])
    same = [(i, [0.5, 0.5], i % 2) for i in range(300)]
    assert mined(spark, same, low_percent=50, high_percent=100, ways=3, leaf_rows=20, group_vectors=32) == brute(same, high=100)
