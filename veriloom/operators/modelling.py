"""Splits, training, scoring and the model registry as tables."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.columns import fired, ratio
from veriloom.functions.ordered import row_numbers, running
from veriloom.operators.network import fit_network
from veriloom.operators.trees import Boosting, Spec, blocks_of, column_cuts, fit_boosted, fit_forest
from veriloom.session import materialize, scratch_path, stored

# Costs of the impact estimate, limits of the retraining rule and of the A/B test.
LOW_COST, HIGH_COST, INVESTIGATION, AVERAGE_COST = 5000.0, 25000.0, 500.0, 15000.0
RETRAIN = {"drifted_features": 3, "accuracy": 0.85, "new_rows": 5000}
AB_GAIN, AB_LATENCY, AB_SHARE = 0.02, 20.0, 10


def hashed(key: str, salt: str = "") -> Column:
    """Deterministic shuffle order that other engines can reproduce."""
    return F.md5(F.concat(F.lit(salt), F.col(key).cast("string")))


# ------------------------------------------------------------------ splits

def stratified_split(df: DataFrame, key: str, label: str, test_share: float = 0.2) -> DataFrame:
    """Adds ``part``: the same share of each label is 'test', chosen by hash order."""
    ranked = running(df.withColumn("_h", hashed(key)), [label], ["_h", key],
                     sums={"_rn": F.lit(1).cast("long")}, totals={"_n": F.lit(1).cast("long")})
    cut = F.floor(F.col("_n") * F.lit(test_share) + 0.5)
    return ranked.withColumn("part", F.when(F.col("_rn") <= cut, "test").otherwise("train")).drop("_h", "_rn", "_n")


def stratified_folds(df: DataFrame, key: str, label: str, folds: int = 5, salt: str = "", name: str = "fold") -> DataFrame:
    """Adds the fold number; folds of a label differ by at most one row."""
    ranked = row_numbers(df.withColumn("_h", hashed(key, salt)), [label], ["_h", key], "_rn")
    return ranked.withColumn(name, F.pmod(F.col("_rn") - 1, F.lit(folds)).cast("int")).drop("_h", "_rn")


def time_blocks(df: DataFrame, ts: str, key: str, folds: int = 5) -> DataFrame:
    """Adds ``block`` 0..folds, equal in size and ordered in time.

    Fold i trains on blocks up to i and tests on block i + 1.
    """
    ranked = running(df, [], [ts, key], sums={"_rn": F.lit(1).cast("long")}, totals={"_n": F.lit(1).cast("long")})
    block = F.floor((F.col("_rn") - 1) * (folds + 1) / F.col("_n").cast("double"))
    return ranked.withColumn("block", block.cast("int")).drop("_rn", "_n")


def time_fold(blocks: DataFrame, fold: int) -> tuple[DataFrame, DataFrame]:
    return blocks.where(F.col("block") <= fold), blocks.where(F.col("block") == fold + 1)


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """label, n, weight = N / (classes * n)."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    total = df.agg(F.count(F.lit(1))).scalar()
    classes = counts.agg(F.count(F.lit(1))).scalar()
    return counts.withColumn("weight", total.cast("double") / (classes * F.col("n")))


def add_class_weights(df: DataFrame, label: str) -> DataFrame:
    return df.join(F.broadcast(class_weights(df, label).drop("n")), label, "left")  # a row per class


# ------------------------------------------------------------------ training

def plain(model: PipelineModel, spark: SparkSession) -> PipelineModel:
    """The model without the summary of its training, which holds the session and keeps the model from tasks once the session has observed a metric."""
    last = model.stages[-1]
    if not getattr(last, "hasSummary", False):
        return model
    path = scratch_path(spark, "model")
    last.write().save(path)
    return PipelineModel([*model.stages[:-1], type(last).load(path)])


def _assembled(features: Sequence[str], stage=None, scale: bool = False) -> Pipeline:
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="keep")]
    if scale:
        stages = [VectorAssembler(inputCols=list(features), outputCol="_raw", handleInvalid="keep"),
                  StandardScaler(inputCol="_raw", outputCol="features", withMean=True)]
    return Pipeline(stages=[*stages, stage] if stage is not None else stages)


def train_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 300, depth: int = 20, min_rows: int = 1,
                 seed: int = 42) -> PipelineModel:
    """``min_rows`` is the least number of rows of a leaf. Spark has no least number of rows of a split node."""
    counts = {int(r[label]): r["weight"] for r in class_weights(df, label).collect()}  # a row per class
    model = fit_forest(df, features, label, (counts.get(0, 1.0), counts.get(1, 1.0)), trees, depth, min_rows, seed)
    return PipelineModel([*_assembled(features).fit(df).stages, model])


def train_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: int = 500, rate: float = 0.1, depth: int = 6,
                  subsample: float = 0.8, positive_weight: float = 3.0, seed: int = 42) -> PipelineModel:
    model = fit_boosted(df, features, label, (1.0, positive_weight), rounds, rate, depth, subsample, seed)
    return PipelineModel([*_assembled(features).fit(df).stages, model])


def train_network(df: DataFrame, features: Sequence[str], label: str, hidden: Sequence[int] = (256, 128, 64, 32), rounds: int = 100,
                  seed: int = 42) -> PipelineModel:
    """Perceptron with logistic layers, fitted by L-BFGS on the scaled features."""
    scaled = _assembled(features, scale=True).fit(df)
    model = fit_network(scaled.transform(df), "features", label, [len(features), *hidden, 2], rounds, seed)
    return plain(PipelineModel([*scaled.stages, model]), df.sparkSession)


def train_logistic(df: DataFrame, features: Sequence[str], label: str, rounds: int = 50) -> PipelineModel:
    return plain(_assembled(features, LogisticRegression(labelCol=label, maxIter=rounds)).fit(df), df.sparkSession)


def tune_boosted(df: DataFrame, features: Sequence[str], label: str, rounds: Sequence[int] = (100, 300), depths: Sequence[int] = (4, 6),
                 seed: int = 42) -> DataFrame:
    """Area under the ROC curve per grid point, over a fifth of the rows that takes no part in the fits.

    The depths are boosted side by side, and fewer rounds are the start of more.
    """
    spark, cuts = df.sparkSession, column_cuts(df, features)
    parted = df.withColumn("_test", F.when(F.rand(seed) < 0.8, 0).otherwise(1))
    fit = Boosting(spark, blocks_of(parted, features, label, cuts, "_test"), len(features),
                   [Spec(d, seed, len(features), test_fold=1) for d in depths], [0.1] * len(depths))
    rows = []
    for r in sorted(set(rounds)):
        fit.run(r - fit.rounds)
        rows += [(int(r), int(d), a) for d, a in zip(depths, fit.areas())]
    fit.close()
    return spark.createDataFrame(rows, "rounds int, depth int, auc double")


def score(model: PipelineModel, df: DataFrame) -> DataFrame:
    """Adds predicted_risk, p_high, p_low and confidence (the larger probability)."""
    out = model.transform(df).withColumn("_p", vector_to_array("probability"))
    return out.withColumns({
        "predicted_risk": F.when(F.col("prediction") == 1, "high").otherwise("low"),
        "p_high": F.col("_p")[1], "p_low": F.col("_p")[0], "confidence": F.array_max("_p"),
    }).drop("_p", "_raw", "features", "rawPrediction", "probability", "prediction")


def feature_importance(model: PipelineModel, features: Sequence[str], spark: SparkSession) -> DataFrame:
    weights = model.stages[-1].featureImportances.toArray()
    rows = sorted(((f, float(w)) for f, w in zip(features, weights)), key=lambda r: (-r[1], r[0]))
    return spark.createDataFrame(rows, "feature string, importance double")


def importance_summary(importance: DataFrame, top: int = 10, limit: float = 0.01) -> DataFrame:
    """The most important features with the sum of all and the number above the limit."""
    s = importance.agg(F.sum("importance").alias("total"), F.count_if(F.col("importance") > limit).alias("above"))
    first = importance.orderBy(F.desc("importance"), "feature").limit(top)
    return first.withColumns({"importance_sum": s.select("total").scalar(), "features_above_threshold": s.select("above").scalar()})


def cross_validate(df: DataFrame, train: Callable[[DataFrame], PipelineModel], measure: Callable[[DataFrame], DataFrame],
                   key: str, label: str, folds: int = 5, repeats: int = 1, parallelism: int = 3) -> DataFrame:
    """(repeat, fold, part, metric, score): train and test metrics of every fold.

    ``measure`` turns a scored frame into (metric, value) rows. Each repeat draws its own folds, which are
    written once; models are fitted in ``parallelism`` threads of the driver.
    """
    out, spark = None, df.sparkSession
    for r in range(repeats):
        data = stored(stratified_folds(df, key, label, folds, salt=f"r{r}"), "folds")
        parts = [{"train": data.where(F.col("fold") != f), "test": data.where(F.col("fold") == f)} for f in range(folds)]
        with ThreadPool(min(parallelism, folds)) as pool:
            models = pool.map(inheritable_thread_target(spark)(lambda p: train(p["train"])), parts, 1)
        for f, model in enumerate(models):
            for part, rows in parts[f].items():
                m = measure(score(model, rows)).select(F.lit(r).alias("repeat"), F.lit(f).alias("fold"), F.lit(part).alias("part"),
                                                       "metric", F.col("value").alias("score"))
                out = m if out is None else out.unionAll(m)
    return out


def permutation_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], key: str,
                           measure: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Drop of each metric when one feature is shuffled between rows. The rows are scored as they are and numbered once for all features."""
    base = materialize(measure(score(model, df)).withColumnRenamed("value", "base"))
    numbered, out = stored(row_numbers(df.withColumn("_h", hashed(key)), [], ["_h", key], "_rn").drop("_h"), "numbered"), None
    for f in features:
        a = numbered.drop(f)
        b = row_numbers(df.select(key, f).withColumn("_h", hashed(key, f)), [], ["_h", key], "_rn").select("_rn", f)
        shuffled = measure(score(model, a.join(b, "_rn").drop("_rn")))
        drop = base.join(shuffled, "metric").select(F.lit(f).alias("feature"), "metric", (F.col("base") - F.col("value")).alias("drop"))
        out = drop if out is None else out.unionAll(drop)
    return out


def recursive_elimination(df: DataFrame, features: Sequence[str], label: str, keep: int, trees: int = 20, depth: int = 5) -> DataFrame:
    """feature, rank: drops the least important feature per round; kept ones have rank 1."""
    left, ranks = list(features), []
    while len(left) > keep:
        model = train_forest(df, left, label, trees=trees, depth=depth)
        weights = model.stages[-1].featureImportances.toArray()
        worst = min(range(len(left)), key=lambda i: (weights[i], left[i]))
        ranks.append((left.pop(worst), len(left) - keep + 2))
    rows = [(f, 1) for f in left] + ranks
    return df.sparkSession.createDataFrame(rows, "feature string, rank int")


# ------------------------------------------------------------------ results of scoring

def batch_stats(scored: DataFrame, risk: str = "predicted_risk", confidence: str = "confidence") -> DataFrame:
    n, high = F.count(F.lit(1)), F.count_if(F.col(risk) == "high")
    return scored.agg(n.alias("total_claims"), high.alias("high_risk_claims"), (n - high).alias("low_risk_claims"),
                      (ratio(high, n) * 100).alias("high_risk_percentage"), F.avg(confidence).alias("average_confidence"))


def business_impact(scored: DataFrame, risk: str = "predicted_risk", confidence: str = "confidence") -> DataFrame:
    high, c = F.col(risk) == "high", F.col(confidence)
    investigation = F.when(high, INVESTIGATION).otherwise(0.0)
    cost = F.when(high, HIGH_COST).otherwise(LOW_COST) * c + investigation
    return scored.withColumns({
        "estimated_cost": F.round(cost, 2), "investigation_cost": investigation,
        "potential_savings": F.round(F.greatest(F.lit(0.0), F.lit(AVERAGE_COST) - cost), 2),
        "confidence_multiplier": F.round(c, 3),
        "recommendation": F.when(high & (c > 0.7), "investigate").otherwise("process_normally"),
    })


# ------------------------------------------------------------------ registry, retraining, A/B test

def promote(registry: DataFrame, version: int | Column, name: str = "version", stage: str = "stage") -> DataFrame:
    """The version becomes Production, the one in production Archived."""
    v = version if isinstance(version, Column) else F.lit(version)
    return registry.withColumn(stage, F.when(F.col(name) == v, "Production")
                               .when(F.col(stage) == "Production", "Archived").otherwise(F.col(stage)))


def rollback(registry: DataFrame, name: str = "version", stage: str = "stage") -> DataFrame:
    """Back to the greatest version below the current one; unchanged if there is none."""
    current = registry.where(F.col(stage) == "Production").agg(F.max(name)).scalar()
    previous = registry.where(F.col(name) < current).agg(F.max(name)).scalar()
    return promote(registry, F.coalesce(previous, current), name, stage)


def retrain_reasons(status: DataFrame, drifted: str = "drifted_features", accuracy: str = "accuracy", due: str = "schedule_due",
                    new_rows: str = "new_rows") -> DataFrame:
    reasons = fired({
        "Data drift detected": F.col(drifted) >= RETRAIN["drifted_features"],
        "Performance degradation": F.col(accuracy) < RETRAIN["accuracy"],
        "Scheduled retraining": F.col(due),
        "Sufficient new data available": F.col(new_rows) > RETRAIN["new_rows"],
    })
    return status.withColumn("reasons", reasons).withColumn("should_retrain", F.size("reasons") > 0)


def ab_assign(df: DataFrame, key: str, treatment_percent: int = AB_SHARE) -> DataFrame:
    bucket = F.conv(F.substring(hashed(key), 1, 8), 16, 10).cast("long") % 100
    return df.withColumn("variant", F.when(bucket < treatment_percent, "treatment").otherwise("control"))


def ab_compare(df: DataFrame, correct: str, latency: str) -> DataFrame:
    """Accuracy and latency per variant and whether the treatment succeeds."""
    def of(v: str, e: Column) -> Column:
        return F.avg(F.when(F.col("variant") == v, e))
    ok, ms = F.col(correct).cast("double"), F.col(latency)
    s = df.agg(*[of(v, e).alias(f"{v}_{n}") for v in ("control", "treatment") for n, e in (("accuracy", ok), ("latency", ms))])
    gain = F.col("treatment_accuracy") - F.col("control_accuracy")
    slower = F.col("treatment_latency") - F.col("control_latency")
    return s.withColumns({"accuracy_gain": gain, "latency_increase": slower,
                          "success": (gain >= AB_GAIN) & (slower <= AB_LATENCY)})
