import numpy as np

from veriloom.llm import quality as Q


def walk(trees, row):
    raw = trees.base
    for feature, cut, leaf in zip(trees.feature, trees.cut, trees.leaf):
        at = 0
        while at < len(feature):
            at = 2 * at + 1 + (row[feature[at]] > cut[at])
        raw += leaf[at - len(feature)]
    return 1 / (1 + np.exp(-raw))


def test_flat_trees_score_like_a_walk_down_each_tree():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    x[:, 3] = 1.0
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)
    model = Q.fit_trees(x[:1500], y[:1500], rounds=40)
    score = model.score(x[1500:])
    assert np.allclose(score, [walk(model, r) for r in x[1500:]])
    assert ((score > 0.5) == y[1500:]).mean() > 0.97


def test_first_split_is_the_best_one():
    rng = np.random.default_rng(1)
    x, y = rng.integers(0, 6, (300, 3)).astype(float), rng.integers(0, 2, 300).astype(float)
    model = Q.fit_trees(x, y, rounds=1, depth=1, least=0.0)
    p = (y.sum() + 1) / (len(y) + 2)
    g, h = p - y, np.full(len(y), p * (1 - p))

    def value(j, c):
        left = x[:, j] <= c
        return sum(g[s].sum() ** 2 / (h[s].sum() + 1) for s in (left, ~left) if s.any())

    best = max(value(j, c) for j in range(3) for c in np.unique(x[:, j])[:-1])
    assert np.isclose(value(model.feature[0][0], model.cut[0][0]), best)


def test_few_labels_give_a_defined_score():
    assert Q.fit_trees(np.zeros((0, 24)), np.zeros(0)).score(np.zeros((2, 24))).tolist() == [0.5, 0.5]
    assert 0.5 < Q.fit_trees(np.zeros((5, 24)), np.ones(5)).score(np.zeros((1, 24)))[0] < 1


def test_statistics_of_odd_texts():
    for text in (None, "", " \n ", "x", "!" * 10, "é" * 100_000, "word " * 100_000):
        row = Q.statistics(text)
        assert len(row) == len(Q.FEATURES) and np.isfinite(row).all()
    named = dict(zip(Q.FEATURES, Q.statistics("AB cd cd.\nAB cd cd.")))
    assert named["upper"] == 4 / 19 and named["distinct_lines"] == 0.5 and named["distinct_words"] == 0.5


def test_held_out_scores_separate_the_labels_and_every_row_has_one(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    more = docs.limit(2).selectExpr("cast(null as long) doc_id", "cast(null as string) text", "lang", "source", "n_chars")
    out = Q.score_documents(docs.unionByName(more).unionByName(docs.limit(1)), labels.withColumnRenamed("toxic", "score"))
    rows = out.toPandas()
    assert len(rows) == docs.count() + 3 and rows["score"].between(0, 1).all() and (rows["predicted"] == (rows["score"] >= 0.3)).all()
    held = rows[rows["held_out"] & rows["doc_id"].notna()].merge(labels.toPandas(), on="doc_id")
    good, bad = held[held["quality"] == 1]["score"].to_numpy(), held[held["quality"] == 0]["score"].to_numpy()
    assert (good[:, None] > bad[None]).mean() > 0.95 and (good >= 0.3).mean() > 0.95
    kept = Q.keep_good(docs.withColumnRenamed("source", "_score0"), labels)
    assert kept.columns == ["doc_id", "text", "lang", "_score0", "n_chars"] and 0.7 < kept.count() / docs.count() < 0.95


def test_labels_of_held_out_rows_are_not_learnt(spark):
    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.selectExpr("doc_id", "case when crc32(cast(doc_id as string)) % 5 = 0 then 1 - quality else quality end quality")
    nulls = spark.createDataFrame([(None, 0), (1, None)], "doc_id long, quality int")
    one, two = (sorted(map(tuple, Q.score_documents(docs, x).collect())) for x in (labels.select("doc_id", "quality"), turned.union(nulls)))
    assert one == two
    assert {r["score"] for r in Q.score_documents(docs, labels.limit(0)).collect()} == {0.5}
    assert Q.score_documents(docs.limit(0), labels).count() == 0
