"""The network's passes: slopes against differences, weights against Spark's own model and fit."""

import numpy as np
from pyspark.ml.classification import MultilayerPerceptronClassifier
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.sql import functions as F

from veriloom.operators import modelling as M
from veriloom.operators import network as N


def test_slopes_are_those_of_the_loss():
    rng, sizes = np.random.default_rng(3), [4, 6, 5, 2]
    w, x, y = rng.uniform(-1, 1, 4 * 6 + 6 + 6 * 5 + 5 + 5 * 2 + 2), rng.normal(size=(50, 4)).astype(np.float32), rng.integers(0, 2, 50)
    slope = N.loss_and_slope(w, sizes, x, y)[1]
    for i in rng.integers(0, len(w), 25):
        up, down = w.copy(), w.copy()
        up[i] += 0.01
        down[i] -= 0.01
        assert abs((N.loss_and_slope(up, sizes, x, y)[0] - N.loss_and_slope(down, sizes, x, y)[0]) / 0.02 - slope[i]) < 0.02


def test_the_network_is_as_good_as_sparks_own_fit(spark):
    df = spark.range(600).select("id", F.sin(F.col("id") * 1.7).alias("a"), F.cos(F.col("id") * 0.31).alias("b"))
    df = df.withColumn("label", (F.col("a") * F.col("b") > 0).cast("double")).repartition(4)
    model = M.train_network(df, ["a", "b"], "label", hidden=(8, 6), rounds=40)
    scored = model.transform(df)
    own = M._assembled(["a", "b"], MultilayerPerceptronClassifier(labelCol="label", layers=[2, 8, 6, 2], maxIter=40, seed=42), scale=True).fit(df).transform(df)
    loss = MulticlassClassificationEvaluator(labelCol="label", metricName="logLoss")
    assert loss.evaluate(scored) < loss.evaluate(own) + 0.1 and loss.evaluate(scored) < 0.3
    # the loss that the passes saw is that of Spark's model of these weights
    rows = scored.select("features", "label").collect()
    x, y = np.array([r["features"].toArray() for r in rows], dtype=np.float32), np.array([int(r["label"]) for r in rows])
    assert abs(N.loss_and_slope(model.stages[-1].weights.toArray(), [2, 8, 6, 2], x, y)[0] / 600 - loss.evaluate(scored)) < 1e-4


def test_a_fit_makes_no_pass_of_its_own_beyond_its_rounds(spark, monkeypatch):
    """Every pass over the rows is one of products in the tasks."""
    passes, real = [], N._pass
    monkeypatch.setattr(N, "_pass", lambda rows, sizes: lambda w, at=real(rows, sizes): passes.append(rows.count()) or at(w))
    df = spark.range(100).select((F.col("id") / 50.0 - 1).alias("a"), (F.col("id") >= 50).cast("double").alias("label"))
    M.train_network(df, ["a"], "label", hidden=(3,), rounds=4)
    assert 5 <= len(passes) <= 30 and set(passes) == {100}


def test_a_pass_moves_blocks_and_no_single_rows(spark, monkeypatch):
    """Of 100 rows in one file, blocks of 30 are four."""
    written, real = {}, N.stored
    monkeypatch.setattr(N, "ROWS", 30)
    monkeypatch.setattr(N, "stored", lambda df, name: written.setdefault(name, real(df, name)))
    df = spark.range(0, 100, 1, 1).select((F.col("id") / 50.0 - 1).alias("a"), (F.col("id") >= 50).cast("double").alias("label"))
    model = M.train_network(df, ["a"], "label", hidden=(3,), rounds=30)
    assert written["inputs"].count() == 100 and written["blocks"].count() == 4
    assert model.transform(df).where("prediction = label").count() > 95
