"""Trees fitted on blocks of rows."""

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from veriloom.operators import modelling as M
from veriloom.operators import trees as R


def _rows(spark, n=600):
    x, z = F.col("id") % 13, F.col("id") * 7 % 11
    return spark.range(n).select("id", x.cast("double").alias("x"), z.cast("double").alias("z"),
                                 ((x + z + F.col("id") % 3) > 11).cast("double").alias("label"))


def test_boosted_trees_are_those_of_spark(spark):
    df = _rows(spark)
    mine = M.train_boosted(df, ["x", "z"], "label", rounds=4, depth=3, subsample=1.0)
    weighted = mine.stages[0].transform(df).withColumn("weight", F.when(F.col("label") == 1, 3.0).otherwise(1.0))
    theirs = GBTClassifier(labelCol="label", weightCol="weight", maxIter=4, stepSize=0.1, maxDepth=3).fit(weighted)
    p = [np.array([r[0] for r in m.transform(weighted).orderBy("id").select(vector_to_array("probability")[1]).collect()]) for m in (mine.stages[-1], theirs)]
    assert np.abs(p[0] - p[1]).max() < 1e-5 and mine.stages[-1].treeWeights == theirs.treeWeights


def test_many_tasks_small_passes_and_scores_written_between_make_the_same_trees(spark, monkeypatch):
    df = _rows(spark).repartition(5, "id")
    one = M.train_boosted(df, ["x", "z"], "label", rounds=3, depth=4, subsample=1.0)
    for name, value in (("FEW", 0), ("HELD", 300), ("WRITTEN", 1)):
        monkeypatch.setattr(R, name, value)
    cut = M.train_boosted(df, ["x", "z"], "label", rounds=3, depth=4, subsample=1.0)
    assert one.stages[-1].toDebugString.split("\n", 1)[1] == cut.stages[-1].toDebugString.split("\n", 1)[1]


def test_a_grid_is_boosted_once_per_depth(spark, monkeypatch):
    grown = []
    grow = R.grow
    monkeypatch.setattr(R, "grow", lambda rows, width, specs, numbers: grown.append(len(specs)) or grow(rows, width, specs, numbers))
    out = M.tune_boosted(_rows(spark), ["x", "z"], "label", rounds=(2, 3), depths=(2, 3)).collect()
    assert grown == [2, 2, 2] and len(out) == 4 and all(r["auc"] > 0.7 for r in out)
