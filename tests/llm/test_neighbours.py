import numpy as np

from veriloom.llm import neighbours as B


def slow(rows, every, k):
    ids = np.array([r[0] for r in rows])
    x = np.array([r[1] for r in rows], dtype=float)
    out = {}
    for q in sorted({i for i in ids.tolist() if i % every == 0}):
        apart = np.sqrt(((x - x[list(ids).index(q)]) ** 2).sum(1))
        order = [i for i in np.lexsort((ids, apart)) if ids[i] != q][:k]
        out[q] = [(int(ids[i]), float(apart[i])) for i in order]
    return out


def test_found_rows_match_brute_force(spark, monkeypatch):
    monkeypatch.setattr(B, "GROUP_VECTORS", 300)
    monkeypatch.setattr(B, "GROUP_QUERIES", 3)
    rng = np.random.default_rng(0)
    centre = rng.normal(size=(20, 24)) * 2
    rows = [(i, (centre[i % 20] + rng.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    rows += [(2000 + i, rows[0][1]) for i in range(400)]  # a group of equal vectors
    df = spark.createDataFrame([(*r, 0, "x") for r in rows], "vec_id long, embedding array<float>, cluster int, query_id string")
    got: dict = {}
    for r in B.neighbours(df, every=50, clusters=16, width=5.0).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(got.setdefault(r["query_id"], [])) + 1
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    want = slow(rows, 50, 10)
    assert {q: [v for v, _ in f] for q, f in got.items()} == {q: [v for v, _ in f] for q, f in want.items()}
    assert all(np.allclose([s for _, s in got[q]], [s for _, s in want[q]]) for q in want)


def test_recall_with_the_default_bounds(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r["vec_id"], r["embedding"]) for r in table.collect()]
    want = slow(rows, 100, 10)
    got = {(r["query_id"], r["vec_id"]) for r in B.neighbours(table).collect()}
    assert np.mean([(q, v) in got for q, found in want.items() for v, _ in found]) > 0.97


def test_bounds_hold():
    rng = np.random.default_rng(1)
    x, q = rng.normal(size=(4000, 64)), rng.normal(size=64)
    index = B.fit(x, clusters=1)
    _, code, norm, fit = B.encode(x, index)
    signs = np.unpackbits(code, axis=1)[:, :64].astype(np.float32) * 2 - 1
    low, high = B.bounds(q, index.centroids[0], index.rotation, signs, norm, fit, 3.0)
    true = ((x - q) ** 2).sum(1)
    assert ((low <= true) & (true <= high)).mean() > 0.99
    assert abs(np.mean((low + high) / 2 - true)) < 0.05 * true.mean()


def test_rows_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [nan, 1.0]), (5, [1.0, 2.0]), (None, [3.0, 3.0]),
            (6, [1.0]), (7, [1.0, None]), (8, [inf, 1.0]), (9, []), (100, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in B.neighbours(df).orderBy("rank").collect()]
    assert got == [(0, 1, 1, 0.0), (0, 2, 1, 0.0), (0, 3, 5, 2.0)]
    assert B.neighbours(df.limit(0)).count() == 0 and B.neighbours(df.where("embedding is null")).count() == 0
