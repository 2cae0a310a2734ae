"""Statistical comparison and ranking of models.

Inputs are cv_scores(model, metric, fold, score) and model_metrics(model, metric,
value): one row per model, metric and fold, whatever the size of the data scored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions import stats
from veriloom.functions.columns import ratio

# Significance, effect-size steps, ranking weights and selection thresholds.
ALPHA, CONFIDENCE, PRACTICAL = 0.05, 0.95, 0.02
EFFECTS = ((0.2, "negligible"), (0.5, "small"), (0.8, "medium"))
WEIGHTS = {"accuracy": 0.15, "f1_score": 0.20, "roc_auc": 0.25, "precision_positive": 0.15, "recall_positive": 0.15,
           "cost_savings_percentage": 0.10}
MINIMUM = {"accuracy": 0.7, "f1_score": 0.6, "roc_auc": 0.7}
COMPOSITE = {"roc_auc": 0.35, "recall": 0.25, "precision": 0.20, "high_risk_detection_rate": 0.20}
KPI = {"accuracy": (">=", 0.85), "precision": (">=", 0.90), "recall": (">=", 0.80), "f1_score": (">=", 0.85), "roc_auc": (">=", 0.88)}


def cv_summary(scores: DataFrame) -> DataFrame:
    return scores.groupBy("model", "metric").agg(
        F.avg("score").alias("mean"), F.stddev_pop("score").alias("std"), F.min("score").alias("min"), F.max("score").alias("max"),
        F.median("score").alias("median"), F.count(F.lit(1)).alias("folds"))


def pairs(scores: DataFrame) -> DataFrame:
    """Scores of two models side by side per metric and fold; each pair of models once."""
    a = scores.select("metric", "fold", F.col("model").alias("model_1"), F.col("score").alias("score_1"))
    b = scores.select("metric", "fold", F.col("model").alias("model_2"), F.col("score").alias("score_2"))
    return a.join(b, ["metric", "fold"]).where(F.col("model_1") < F.col("model_2")).withColumn("diff", F.col("score_1") - F.col("score_2"))


PAIR = ("metric", "model_1", "model_2")


def paired_ttest(scores: DataFrame) -> DataFrame:
    g = pairs(scores).groupBy(*PAIR).agg(F.avg("diff").alias("mean_difference"), F.stddev_samp("diff").alias("_sd"), F.count(F.lit(1)).alias("n"))
    t = ratio(F.col("mean_difference"), F.col("_sd") / F.sqrt("n"), None)
    out = g.withColumn("t_statistic", t)
    p = stats.p_value_udf(stats.t_sf2)(F.col("t_statistic"), (F.col("n") - 1).cast("double"))
    return (out.withColumn("p_value", p).withColumn("significant", F.coalesce(F.col("p_value") < ALPHA, F.lit(False)))
            .withColumn("winner", F.when(F.col("mean_difference") > 0, F.col("model_1")).otherwise(F.col("model_2"))).drop("_sd"))


def effect_size(scores: DataFrame) -> DataFrame:
    g = pairs(scores).groupBy(*PAIR).agg(F.avg("diff").alias("mean_difference"),
                                         F.stddev_pop("score_1").alias("_a"), F.stddev_pop("score_2").alias("_b"))
    pooled = F.sqrt((F.col("_a") * F.col("_a") + F.col("_b") * F.col("_b")) / 2)
    out = g.withColumn("cohens_d", ratio(F.col("mean_difference"), pooled))
    size = F.abs("cohens_d")
    label = F.when(size < EFFECTS[0][0], EFFECTS[0][1]).when(size < EFFECTS[1][0], EFFECTS[1][1]).when(size < EFFECTS[2][0], EFFECTS[2][1])
    return out.drop("_a", "_b").withColumns({"interpretation": label.otherwise("large"),
                                             "practical_difference": F.abs("mean_difference") > PRACTICAL})


def confidence_interval(scores: DataFrame, level: float = CONFIDENCE) -> DataFrame:
    g = pairs(scores).groupBy(*PAIR).agg(F.avg("diff").alias("mean_difference"), F.stddev_samp("diff").alias("_sd"), F.count(F.lit(1)).alias("_n"))
    t = stats.p_value_udf(stats.t_quantile)(F.lit((1 + level) / 2), (F.col("_n") - 1).cast("double"))
    half = t * F.col("_sd") / F.sqrt("_n")
    return g.withColumn("_h", half).select(*PAIR, "mean_difference", (F.col("mean_difference") - F.col("_h")).alias("ci_lower"),
                                           (F.col("mean_difference") + F.col("_h")).alias("ci_upper"))


def mean_rank(partition: list, order):
    """Rank with ties sharing their mean."""
    w = W.partitionBy(*partition)
    return F.rank().over(w.orderBy(order)) + (F.count(F.lit(1)).over(w.partitionBy(*partition, order)) - 1) / 2.0


def wilcoxon(scores: DataFrame) -> DataFrame:
    """Signed-rank statistic, zero differences left out, with the normal approximation of the p-value."""
    d = pairs(scores).where(F.col("diff") != 0).withColumn("_abs", F.round(F.abs("diff"), 12))
    ranked = d.withColumn("_rank", mean_rank([*PAIR], F.col("_abs")))
    ties = F.count(F.lit(1)).over(W.partitionBy(*PAIR, "_abs"))
    g = ranked.withColumn("_t", ties).groupBy(*PAIR).agg(
        F.sum(F.when(F.col("diff") > 0, F.col("_rank")).otherwise(0.0)).alias("_plus"),
        F.sum(F.when(F.col("diff") < 0, F.col("_rank")).otherwise(0.0)).alias("_minus"),
        F.count(F.lit(1)).alias("n"), F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("_ties"))
    out = g.withColumn("statistic", F.least("_plus", "_minus"))
    n = F.col("n").cast("double")
    var = n * (n + 1) * (2 * n + 1) / 24 - F.col("_ties") / 48
    z = ratio(n * (n + 1) / 4 - F.col("statistic"), F.sqrt(var), None)
    p = 2 * stats.p_value_udf(stats.normal_sf)(z)
    return out.withColumn("p_value", F.least(p, F.lit(1.0))).drop("_plus", "_minus", "_ties")


def friedman(scores: DataFrame) -> DataFrame:
    """Chi-square over the models' ranks within each fold, corrected for ties."""
    s = scores.withColumn("_s", F.round("score", 12))
    ranked = s.withColumn("_rank", mean_rank(["metric", "fold"], F.col("_s"))).withColumn(
        "_t", F.count(F.lit(1)).over(W.partitionBy("metric", "fold", "_s")))
    per_model = ranked.groupBy("metric", "model").agg(F.sum("_rank").alias("_r"), F.sum((F.col("_t") * F.col("_t") - 1).cast("double")).alias("_ties"),
                                                      F.count(F.lit(1)).alias("_n"))
    g = per_model.groupBy("metric").agg(F.sum(F.col("_r") * F.col("_r")).alias("_rr"), F.sum("_ties").alias("_ties"),
                                        F.max("_n").alias("folds"), F.count(F.lit(1)).alias("models"))
    n, k = F.col("folds").cast("double"), F.col("models").cast("double")
    raw = 12.0 / (n * k * (k + 1)) * F.col("_rr") - 3 * n * (k + 1)
    correction = 1 - F.col("_ties") / (n * k * (k * k - 1))
    out = g.withColumn("statistic", ratio(raw, correction, None))
    p = stats.p_value_udf(stats.chi2_sf)(F.col("statistic"), k - 1)
    return out.select("metric", "folds", "models", "statistic", p.alias("p_value"))


def win_probability(scores: DataFrame) -> DataFrame:
    return pairs(scores).groupBy(*PAIR).agg(F.avg(F.when(F.col("diff") > 0, 1.0).otherwise(0.0)).alias("win_probability"))


def metric_ranking(metrics: DataFrame) -> DataFrame:
    """Rank of the models per metric by (model, metric, value)."""
    return metrics.withColumn("rank", F.row_number().over(W.partitionBy("metric").orderBy(F.desc("value"), "model")))


def weighted_ranking(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    """Weighted score over the number of metrics, and over the sum of weights.

    Percentages are read as shares; values are kept within 0..1.
    """
    weights = weights or WEIGHTS
    w = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    share = F.when(F.col("metric").endswith("_percentage"), F.col("value") / 100).otherwise(F.col("value"))
    scored = metrics.where(F.col("metric").isin(list(weights)) & F.col("value").isNotNull()).select(
        "model", w[F.col("metric")].alias("_w"), F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0)).alias("_v"))
    g = scored.groupBy("model").agg((F.sum(F.col("_w") * F.col("_v")) / F.count(F.lit(1))).alias("score"),
                                    (F.sum(F.col("_w") * F.col("_v")) / F.sum("_w")).alias("normalized_score"))
    return g.withColumn("rank", F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("score"), "model")))


def composite_score(metrics: DataFrame, weights: dict[str, float] | None = None) -> DataFrame:
    weights = weights or COMPOSITE
    wide = metrics.groupBy("model").pivot("metric", list(weights)).agg(F.first("value"))
    total = sum((F.col(m) * v for m, v in weights.items()), F.lit(0.0))
    return wide.withColumn("composite_score", total)


def select_best(ranking: DataFrame, metrics: DataFrame, minimum: dict[str, float] | None = None) -> DataFrame:
    """The best of the top three that meets all thresholds, else the top one with a warning."""
    limits = F.create_map(*[F.lit(x) for kv in (minimum or MINIMUM).items() for x in kv])
    failing = metrics.where(F.col("value") < limits[F.col("metric")]).select("model").distinct().withColumn("_bad", F.lit(True))
    top = ranking.orderBy("rank").limit(3).join(failing, "model", "left")
    order = W.partitionBy(F.lit(0)).orderBy(F.col("_bad").isNotNull(), "rank")
    ok = F.col("_bad").isNull()
    following = F.lead(F.when(ok, F.col("score"))).over(order)
    first = top.withColumn("_next", following).withColumn("_place", F.row_number().over(order)).where(F.col("_place") == 1)
    raw = 0.5 + (F.col("score") - F.col("_next")) * 10
    gap = F.when(raw > 1.0, 1.0).otherwise(raw)
    return first.select(F.col("model").alias("recommended_model"), "score", F.when(ok, "success").otherwise("warning").alias("status"),
                        F.when(ok, F.coalesce(gap, F.lit(0.5))).alias("confidence"))


def business_ranking(metrics: DataFrame) -> DataFrame:
    """Ranks by savings, by detection rate and by 0.6 savings share + 0.4 detection."""
    names = ["cost_savings", "cost_savings_percentage", "high_risk_detection_rate"]
    wide = metrics.groupBy("model").pivot("metric", names).agg(F.first("value"))
    wide = wide.withColumn("business_score", F.col("cost_savings_percentage") / 100 * 0.6 + F.col("high_risk_detection_rate") * 0.4)

    def place(c: str):
        return F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc(c), "model"))
    return wide.withColumns({"savings_rank": place("cost_savings"), "detection_rank": place("high_risk_detection_rate"),
                             "business_rank": place("business_score")})
