"""Evaluation of predictions.

Input is a table with y_true, y_pred (0/1 or class labels), p and optional group
columns. Everything is counts: one row per confusion cell or per distinct score.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.functions.columns import ratio
from veriloom.functions.ordered import quantiles, running

# Claim costs, the share of a high claim still paid after investigation, the
# cost matrix of the second scheme, the fairness limit and the clipping of probabilities.
COST_LOW, COST_HIGH, COST_INVESTIGATION, PAID_SHARE = 5000.0, 25000.0, 500.0, 0.7
FP_COST, FN_COST, REVIEW_COST = 500.0, 10000.0, 150.0
FAIR_LIMIT = 0.05
EPS = 2.220446049250313e-16


def confusion(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """tp, tn, fp, fn, n per group."""
    t, p = F.col("y_true") == 1, F.col("y_pred") == 1
    return df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
                               F.count_if(t & ~p).alias("fn"), F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by, "y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def _c(name: str) -> Column:
    return F.col(name).cast("double")


def confusion_rates(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn = (_c(x) for x in ("tp", "tn", "fp", "fn"))
    return counts.withColumns({
        "sensitivity": ratio(tp, tp + fn), "specificity": ratio(tn, tn + fp), "false_positive_rate": ratio(fp, fp + tn),
        "false_negative_rate": ratio(fn, fn + tp), "positive_predictive_value": ratio(tp, tp + fp),
        "negative_predictive_value": ratio(tn, tn + fn)})


BASIC = ("accuracy", "balanced_accuracy", "precision", "recall", "f1_score", "precision_positive", "recall_positive",
         "f1_positive", "matthews_corrcoef", "cohen_kappa")


def basic_metrics(counts: DataFrame) -> DataFrame:
    """Closed forms over the confusion counts; precision, recall and f1 are weighted by support."""
    tp, tn, fp, fn, n = (_c(x) for x in ("tp", "tn", "fp", "fn", "n"))
    pos, neg = tp + fn, tn + fp
    p1, p0 = ratio(tp, tp + fp), ratio(tn, tn + fn)
    r1, r0 = ratio(tp, pos), ratio(tn, neg)
    f1, f0 = ratio(2 * tp, 2 * tp + fp + fn), ratio(2 * tn, 2 * tn + fp + fn)
    acc = ratio(tp + tn, n)
    chance = ratio((tp + fp) * pos + (tn + fn) * neg, n * n)
    classes = F.when(pos > 0, 1).otherwise(0) + F.when(neg > 0, 1).otherwise(0)
    return counts.withColumns({
        "accuracy": acc, "balanced_accuracy": ratio(r1 + r0, classes),
        "precision": ratio(pos * p1 + neg * p0, n), "recall": ratio(pos * r1 + neg * r0, n), "f1_score": ratio(pos * f1 + neg * f0, n),
        "precision_positive": p1, "recall_positive": r1, "f1_positive": f1,
        "matthews_corrcoef": ratio(tp * tn - fp * fn, F.sqrt((tp + fp) * pos * neg * (tn + fn))),
        "cohen_kappa": ratio(acc - chance, 1 - chance)})


def classification_report(df: DataFrame) -> DataFrame:
    """Per class: precision, recall, f1 and support, for any number of classes."""
    m = confusion_matrix(df)
    sides = m.select(F.explode(F.array(
        F.struct(F.col("y_true").alias("label"), F.col("n").alias("support"), F.lit(0).cast("long").alias("predicted"),
                 F.when(F.col("y_true") == F.col("y_pred"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("y_pred").alias("label"), F.lit(0).cast("long").alias("support"), F.col("n").alias("predicted"),
                 F.lit(0).cast("long").alias("hit")))).alias("s")).select("s.*")
    s = sides.groupBy("label").agg(*[F.sum(c).alias(c) for c in ("support", "predicted", "hit")])
    return s.select("label", ratio(F.col("hit"), F.col("predicted")).alias("precision"), ratio(F.col("hit"), F.col("support")).alias("recall"),
                    ratio(2 * F.col("hit"), F.col("support") + F.col("predicted")).alias("f1_score"), "support")


def log_loss(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    p = F.least(F.greatest(F.col("p"), F.lit(EPS)), F.lit(1 - EPS))
    loss = F.when(F.col("y_true") == 1, -F.log(p)).otherwise(-F.log(1 - p))
    return df.groupBy(*by).agg(F.avg(loss).alias("log_loss"))


# ------------------------------------------------------------------ curves

def score_steps(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct score, from the highest: positives and negatives at and above it, and all of them."""
    by = list(by)
    hist = df.groupBy(*by, (-F.col("p")).alias("_order")).agg(
        F.count_if(F.col("y_true") == 1).alias("pos"), F.count_if(F.col("y_true") != 1).alias("neg"))
    run = running(hist, by, ["_order"], sums={"cum_pos": F.col("pos"), "cum_neg": F.col("neg")},
                  totals={"all_pos": F.col("pos"), "all_neg": F.col("neg")})
    return run.withColumn("threshold", -F.col("_order")).drop("_order")


def roc_curve(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return steps.select(*by, "threshold", ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"),
                        ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"))


def youden_threshold(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold of the largest tpr - fpr, the highest one among equals."""
    j = (F.col("tpr") - F.col("fpr")).alias("j")
    c = roc_curve(steps, by).select(*by, "threshold", j)
    return c.groupBy(*by).agg(F.max_by("threshold", F.struct("j", "threshold")).alias("optimal_threshold"), F.max("j").alias("youden_j"))


def roc_auc(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rank-sum form; tied scores count half."""
    by = list(by)
    steps = score_steps(df, by)
    # average rank of a score from below: rows below it plus the middle of its own
    n = F.col("all_pos") + F.col("all_neg")
    own = F.col("pos") + F.col("neg")
    rank = n - (F.col("cum_pos") + F.col("cum_neg")) + (own + 1) / 2.0
    s = steps.groupBy(*by).agg(F.sum(F.col("pos") * rank).alias("_r"), F.max("all_pos").alias("_p"), F.max("all_neg").alias("_q"))
    p, q = F.col("_p").cast("double"), F.col("_q").cast("double")
    return s.select(*by, ratio(F.col("_r") - p * (p + 1) / 2, p * q, None).alias("roc_auc"))


def pr_curve(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """threshold, precision, recall and both at the next higher score (1 and 0 at the start)."""
    tp, fp, pos = F.col("cum_pos"), F.col("cum_neg"), F.col("all_pos")
    tp0, fp0 = tp - F.col("pos"), fp - F.col("neg")
    return steps.select(*by, "threshold", ratio(tp, tp + fp).alias("precision"), ratio(tp, pos).alias("recall"),
                        ratio(tp0, tp0 + fp0, 1.0).alias("prev_precision"), ratio(tp0, pos).alias("prev_recall"))


def pr_summary(steps: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Trapezoid area, average precision and the threshold of the best F1 (the lowest among equals)."""
    c = pr_curve(steps, by)
    p, r = F.col("precision"), F.col("recall")
    step = r - F.col("prev_recall")
    f1 = ratio(2 * p * r, p + r)
    return c.groupBy(*by).agg(
        F.sum(step * (p + F.col("prev_precision")) / 2).alias("pr_auc"), F.sum(step * p).alias("average_precision"),
        F.max_by("threshold", F.struct(f1, -F.col("threshold"))).alias("best_f1_threshold"), F.max(f1).alias("best_f1"))


# ------------------------------------------------------------------ calibration

def calibration_bins(df: DataFrame, bins: int = 10, strategy: str = "uniform") -> DataFrame:
    """bin, n, fraction_positive, mean_predicted for the non-empty bins, closed on the right."""
    if strategy == "uniform":
        place = F.least(F.greatest(F.ceil(F.col("p") * bins) - 1, F.lit(0)), F.lit(bins - 1))
    else:
        probs = {f"q{i}": i / bins for i in range(1, bins)}
        edges = quantiles(df, ["p"], probs).select(F.struct(*probs)).scalar()
        # equal edges count once
        above = [(F.col("p") > edges[f"q{i}"]) & (F.lit(i == 1) | (edges[f"q{i}"] > edges[f"q{max(i - 1, 1)}"])) for i in range(1, bins)]
        place = reduce(lambda a, b: a + b, [F.when(a, 1).otherwise(0) for a in above])
    return df.groupBy(place.cast("int").alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.col("y_true").cast("double")).alias("fraction_positive"), F.avg("p").alias("mean_predicted"))


def calibration_errors(binned: DataFrame, weighted: bool = False) -> DataFrame:
    gap = F.abs(F.col("fraction_positive") - F.col("mean_predicted"))
    ece = F.sum(gap * F.col("n")) / F.sum("n") if weighted else F.avg(gap)
    return binned.agg(ece.alias("expected_calibration_error"), F.max(gap).alias("maximum_calibration_error"))


def brier(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(F.avg((F.col("p") - F.col("y_true")) * (F.col("p") - F.col("y_true"))).alias("brier_score"))


# ------------------------------------------------------------------ business and fairness

def business_costs(counts: DataFrame) -> DataFrame:
    tp, tn, fp, fn, n = (_c(x) for x in ("tp", "tn", "fp", "fn", "n"))
    parts = {"cost_tn": tn * COST_LOW, "cost_fp": fp * (COST_LOW + COST_INVESTIGATION), "cost_fn": fn * COST_HIGH,
             "cost_tp": tp * (COST_INVESTIGATION + COST_HIGH * PAID_SHARE)}
    total = parts["cost_tn"] + parts["cost_fp"] + parts["cost_fn"] + parts["cost_tp"]
    baseline = (tn + fp) * COST_LOW + (tp + fn) * COST_HIGH
    return counts.withColumns({
        **parts, "total_cost": total, "baseline_cost": baseline, "cost_savings": baseline - total,
        "cost_savings_percentage": ratio(baseline - total, baseline) * 100, "cost_per_claim": ratio(total, n),
        "high_risk_detection_rate": ratio(tp, tp + fn), "investigation_precision": ratio(tp, tp + fp)})


def cost_matrix(counts: DataFrame, fp_cost: float = FP_COST, fn_cost: float = FN_COST, review: float = REVIEW_COST) -> DataFrame:
    tp, tn, fp, fn, n = (_c(x) for x in ("tp", "tn", "fp", "fn", "n"))
    reviews = (tp + fp) * review
    return counts.withColumns({
        "false_positive_cost": fp * fp_cost, "false_negative_cost": fn * fn_cost, "manual_review_cost": reviews,
        "total_cost": fp * fp_cost + fn * fn_cost + reviews, "high_risk_coverage": ratio(tp, tp + fn),
        "automation_rate": ratio(tn, n), "flagging_precision": ratio(tp, tp + fp)})


def fairness_groups(df: DataFrame, sensitive: Sequence[str]) -> DataFrame:
    """Metrics per sensitive column and group. Counts per combination of groups come first."""
    counts = confusion(df, list(sensitive))
    long = counts.select("tp", "tn", "fp", "fn", "n", F.explode(F.array(*[
        F.struct(F.lit(s).alias("feature"), F.col(s).cast("string").alias("group")) for s in sensitive])).alias("g"))
    by = long.groupBy("g.feature", "g.group").agg(*[F.sum(c).alias(c) for c in ("tp", "tn", "fp", "fn", "n")])
    tp, tn, fp, fn, n = (_c(x) for x in ("tp", "tn", "fp", "fn", "n"))
    return by.select("feature", "group", "n", ratio(tp + tn, n).alias("accuracy"), ratio(tp, tp + fp).alias("precision"),
                     ratio(tp, tp + fn).alias("recall"), ratio(tp + fp, n).alias("positive_rate"))


def fairness(groups: DataFrame, limit: float = FAIR_LIMIT) -> DataFrame:
    spread = F.max("accuracy") - F.min("accuracy")
    return groups.groupBy("feature").agg(
        F.count(F.lit(1)).alias("groups"), spread.alias("accuracy_disparity"),
        (F.max("positive_rate") - F.min("positive_rate")).alias("demographic_parity"), (spread < limit).alias("is_fair"))


# ------------------------------------------------------------------ summaries

def metric_rows(df: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by, metric, value) of the basic metrics, costs and area under the ROC curve."""
    by = list(by)
    wide = business_costs(basic_metrics(confusion(df, by)))
    names = [*BASIC, "cost_savings", "cost_savings_percentage", "high_risk_detection_rate"]
    rows = wide.select(*by, *names).unpivot(by, names, "metric", "value")
    auc = roc_auc(df, by).select(*by, F.lit("roc_auc").alias("metric"), F.col("roc_auc").alias("value"))
    return rows.unionByName(auc)


def evaluation_entry(df: DataFrame, model: str, at: str) -> DataFrame:
    """History row of one evaluation."""
    rows = metric_rows(df).where(F.col("metric").isin("accuracy", "f1_score", "roc_auc"))
    return rows.select(F.lit(model).alias("model"), F.lit(at).cast("timestamp_ntz").alias("ts"), "metric", "value")
