"""Queries over the evaluation and comparison of predictions."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.operators import compare as C
from veriloom.operators import evaluate as V
from veriloom.operators.schema import threshold_gate
from veriloom.plans import profiles as P
from veriloom.plans.registry import query
from veriloom.session import materialize, scratch_path


def _r(df, *names, places=6):
    return df.withColumns({c: F.round(c, places) for c in names})


def _div(a, b):
    return f"coalesce(round(({a}) / nullif({b}, 0), 6), 0)::double"


@query("ev_confusion", f"""
    select tp::bigint as tp, tn::bigint as tn, fp::bigint as fp, fn::bigint as fn, n::bigint as n, {_div('tp', 'tp + fn')} as sensitivity,
      {_div('tn', 'tn + fp')} as specificity, {_div('fp', 'fp + tn')} as false_positive_rate, {_div('fn', 'fn + tp')} as false_negative_rate,
      {_div('tp', 'tp + fp')} as positive_predictive_value, {_div('tn', 'tn + fn')} as negative_predictive_value from @confusion c""")
def _(spark, sf):
    out = V.confusion_rates(V.confusion(P.predictions(spark, sf)))
    return _r(out, *out.columns[5:])


@query("ev_confusion_matrix", "select y_true, y_pred, count(*) as n from @predictions p group by 1, 2")
def _(spark, sf):
    return V.confusion_matrix(P.predictions(spark, sf))


BASIC_SQL = """
    select {by} (tp + tn) / n as accuracy, (tp / (tp + fn) + tn / (tn + fp)) / 2 as balanced_accuracy,
      ((tp + fn) * tp / nullif(tp + fp, 0) + (tn + fp) * tn / nullif(tn + fn, 0)) / n as precision, (tp + tn) / n as recall,
      ((tp + fn) * 2 * tp / (2 * tp + fp + fn) + (tn + fp) * 2 * tn / (2 * tn + fp + fn)) / n as f1_score,
      tp / (tp + fp) as precision_positive, tp / (tp + fn) as recall_positive, 2 * tp / (2 * tp + fp + fn) as f1_positive,
      (tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn)) as matthews_corrcoef,
      ((tp + tn) / n - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) / (1 - ((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / (n * n)) as cohen_kappa
    from {src} c"""


@query("ev_basic", f"select {', '.join(f'round({m}, 6) as {m}' for m in V.BASIC)} from ({BASIC_SQL.format(by='', src='@confusion')}) b")
def _(spark, sf):
    out = V.basic_metrics(V.confusion(P.predictions(spark, sf))).select(*V.BASIC)
    return _r(out, *V.BASIC)


@query("ev_classification_report", """
    with p as (select * from @predictions q), l as (select distinct y_true as label from p),
    c as (select label, count(*) filter (where y_true = label) as support, count(*) filter (where y_pred = label) as predicted,
      count(*) filter (where y_true = label and y_pred = label) as hit from l, p group by label)
    select label, round(hit / predicted, 6) as precision, round(hit / support, 6) as recall, round(2 * hit / (support + predicted), 6) as f1_score, support from c""")
def _(spark, sf):
    return _r(V.classification_report(P.predictions(spark, sf)), "precision", "recall", "f1_score")


@query("ev_log_loss", f"""
    select round(avg(case when y_true = 1 then -ln(q) else -ln(1 - q) end), 6) as log_loss from (
      select y_true, least(greatest(p, {V.EPS!r}::double), 1 - {V.EPS!r}::double) as q from @predictions p) c""")
def _(spark, sf):
    return _r(V.log_loss(P.predictions(spark, sf)), "log_loss")


STEPS = """h as (select p as threshold, count(*) filter (where y_true = 1)::double as pos, count(*) filter (where y_true = 0)::double as neg from @predictions p group by 1),
    s as (select *, sum(pos) over (order by threshold desc) as tp, sum(neg) over (order by threshold desc) as fp, sum(pos) over () as ap, sum(neg) over () as an from h)"""


@query("ev_roc_curve", f"with {STEPS} select threshold, round(fp / an, 6) as fpr, round(tp / ap, 6) as tpr from s")
def _(spark, sf):
    return _r(V.roc_curve(V.score_steps(P.predictions(spark, sf))), "fpr", "tpr")


@query("ev_youden", f"with {STEPS} select threshold as optimal_threshold, round(tp / ap - fp / an, 6) as youden_j from s order by tp / ap - fp / an desc, threshold desc limit 1")
def _(spark, sf):
    return _r(V.youden_threshold(V.score_steps(P.predictions(spark, sf))), "youden_j")


@query("ev_roc_auc", """
    with r as (select y_true, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0::double as r from @predictions q),
    s as (select sum(r) filter (where y_true = 1) as s, count(*) filter (where y_true = 1)::double as a, count(*) filter (where y_true = 0)::double as b from r)
    select round((s - a * (a + 1) / 2) / (a * b), 6) as roc_auc from s""")
def _(spark, sf):
    return _r(V.roc_auc(P.predictions(spark, sf)), "roc_auc")


PR = f"""{STEPS}, c as (select threshold, tp / (tp + fp) as p, tp / ap as r, coalesce((tp - pos) / nullif(tp - pos + fp - neg, 0), 1) as pp, (tp - pos) / ap as pr from s)"""


@query("ev_pr_curve", f"with {PR} select threshold, round(p, 6) as precision, round(r, 6) as recall from c")
def _(spark, sf):
    return _r(V.pr_curve(V.score_steps(P.predictions(spark, sf))), "precision", "recall").select("threshold", "precision", "recall")


@query("ev_average_precision", f"""
    with {PR}, f as (select threshold, coalesce(2 * p * r / nullif(p + r, 0), 0) as f1 from c order by f1 desc, threshold limit 1)
    select round(sum((r - pr) * (p + pp) / 2), 6) as pr_auc, round(sum((r - pr) * p), 6) as average_precision,
      (select threshold from f) as best_f1_threshold, round((select f1 from f), 6) as best_f1 from c""")
def _(spark, sf):
    return _r(V.pr_summary(V.score_steps(P.predictions(spark, sf))), "pr_auc", "average_precision", "best_f1")


CAL = """b as (select least(greatest(ceil(p * 10) - 1, 0), 9)::int as bin, count(*) as n, avg(y_true::double) as f, avg(p) as m from @predictions q group by 1)"""


@query("ev_calibration_bins", f"with {CAL} select bin, n, round(f, 6) as fraction_positive, round(m, 6) as mean_predicted from b")
def _(spark, sf):
    return _r(V.calibration_bins(P.predictions(spark, sf)), "fraction_positive", "mean_predicted")


@query("ev_calibration", f"""
    with {CAL} select round(avg(abs(f - m)), 6) as expected_calibration_error, round(max(abs(f - m)), 6) as maximum_calibration_error,
      (select round(avg((p - y_true) * (p - y_true)), 6) from @predictions q) as brier_score from b""")
def _(spark, sf):
    p = P.predictions(spark, sf)
    out = V.calibration_errors(V.calibration_bins(p)).withColumn("brier_score", V.brier(p).scalar())
    return _r(out, *out.columns)


@query("ev_calibration_quantile", """
    with q as (select quantile_cont(p, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from @predictions q1),
    b as (select len(list_filter(list_distinct(e), lambda x: p > x))::int as bin, count(*) as n, avg(y_true::double) as f, avg(p) as m from @predictions q2, q group by 1)
    select bin, n, round(f, 6) as fraction_positive, round(m, 6) as mean_predicted from b""")
def _(spark, sf):
    return _r(V.calibration_bins(P.predictions(spark, sf), strategy="quantile"), "fraction_positive", "mean_predicted")


COSTS = """(select *, tn * 5000 + fp * 5500 + fn * 25000 + tp * 18000 as total, (tn + fp) * 5000 + (tp + fn) * 25000 as base from {src} c)"""


@query("ev_business_cost", f"""
    select tn * 5000 as cost_tn, fp * 5500 as cost_fp, fn * 25000 as cost_fn, tp * 18000 as cost_tp, total as total_cost, base as baseline_cost,
      base - total as cost_savings, round((base - total) / base * 100, 6) as cost_savings_percentage, round(total / n, 6) as cost_per_claim,
      {_div('tp', 'tp + fn')} as high_risk_detection_rate, {_div('tp', 'tp + fp')} as investigation_precision from {COSTS.format(src='@confusion')} b""")
def _(spark, sf):
    out = V.business_costs(V.confusion(P.predictions(spark, sf))).drop("tp", "tn", "fp", "fn", "n")
    return _r(out, "cost_savings_percentage", "cost_per_claim", "high_risk_detection_rate", "investigation_precision")


@query("ev_business_cost_matrix", f"""
    select fp * 500 as false_positive_cost, fn * 10000 as false_negative_cost, (tp + fp) * 150 as manual_review_cost,
      fp * 500 + fn * 10000 + (tp + fp) * 150 as total_cost, {_div('tp', 'tp + fn')} as high_risk_coverage, {_div('tn', 'n')} as automation_rate,
      {_div('tp', 'tp + fp')} as flagging_precision from @confusion c""")
def _(spark, sf):
    out = V.cost_matrix(V.confusion(P.predictions(spark, sf))).drop("tp", "tn", "fp", "fn", "n")
    return _r(out, "high_risk_coverage", "automation_rate", "flagging_precision")


FAIR = """g as (select feature, grp, count(*)::double as n, avg((y_true = y_pred)::int) as acc, avg(y_pred) as rate from (
      select 'lang' as feature, lang as grp, y_true, y_pred from @predictions p1 union all select 'source', source, y_true, y_pred from @predictions p2) u group by 1, 2)"""


@query("ev_fairness", f"""
    with {FAIR} select feature, count(*) as groups, round(max(acc) - min(acc), 6) as accuracy_disparity, round(max(rate) - min(rate), 6) as demographic_parity,
      max(acc) - min(acc) < 0.05 as is_fair from g group by 1""")
def _(spark, sf):
    out = V.fairness(V.fairness_groups(P.predictions(spark, sf), ["lang", "source"]))
    return _r(out, "accuracy_disparity", "demographic_parity")


@query("ev_fairness_groups", f"with {FAIR} select feature, grp as \"group\", n::bigint as n, round(acc, 6) as accuracy, round(rate, 6) as positive_rate from g")
def _(spark, sf):
    return _r(V.fairness_groups(P.predictions(spark, sf), ["lang", "source"]).drop("precision", "recall"), "accuracy", "positive_rate")


@query("ev_history", f"""
    with {STEPS}, b as ({BASIC_SQL.format(by='', src='@confusion')}),
    a as (select sum(pos * (an - fp + neg / 2)) / max(ap * an) as auc from s)
    select 'model_b' as model, timestamp '2001-01-01' as ts, 'accuracy' as metric, round(accuracy, 6) as value from b
    union all select 'model_b', timestamp '2001-01-01', 'f1_score', round(f1_score, 6) from b
    union all select 'model_b', timestamp '2001-01-01', 'roc_auc', round(auc, 6) from a""")
def _(spark, sf):
    entry = _r(V.evaluation_entry(P.predictions(spark, sf), "model_b", P.AS_OF), "value")
    path = scratch_path(spark, "evaluations")
    entry.write.mode("append").parquet(path)
    return spark.read.parquet(path)


# ---------------------------------------------------------------- comparison

def _cv(spark, sf):
    """cv_scores: accuracy and recall of three threshold models on five folds."""
    counts = V.basic_metrics(V.confusion(P.models_scored(spark, sf), ["model", "fold"]))
    return counts.select("model", "fold", "accuracy", F.col("recall_positive").alias("recall")).unpivot(
        ["model", "fold"], ["accuracy", "recall"], "metric", "score")


CV = """cv as (unpivot (select model, fold, avg((y_true = y_pred)::int)::double as accuracy,
      (sum((y_true = 1 and y_pred = 1)::int) / sum(y_true))::double as recall from @scored s group by 1, 2) on accuracy, recall into name metric value score),
    pr as (select a.metric, a.fold, a.model as model_1, b.model as model_2, a.score as s1, b.score as s2, a.score - b.score as d
      from cv a join cv b on a.metric = b.metric and a.fold = b.fold and a.model < b.model)"""


@query("ml_cv_summary", f"""
    with {CV} select model, metric, round(avg(score), 6) as mean, round(stddev_pop(score), 6) as std, round(min(score), 6) as min, round(max(score), 6) as max,
      round(median(score), 6) as median, count(*) as folds from cv group by 1, 2""")
def _(spark, sf):
    return _r(C.cv_summary(_cv(spark, sf)), "mean", "std", "min", "max", "median")


@query("cmp_paired_ttest", f"""
    with {CV} select metric, model_1, model_2, count(*) as n, round(avg(d), 6) as mean_difference,
      round(avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0), 4) as t_statistic, case when avg(d) > 0 then model_1 else model_2 end as winner from pr group by 1, 2, 3""")
def _(spark, sf):
    out = C.paired_ttest(materialize(_cv(spark, sf))).drop("p_value", "significant")
    return _r(_r(out, "mean_difference"), "t_statistic", places=4)


# The t distribution with four degrees of freedom (five folds) has a closed form.
@query("cmp_paired_pvalues", f"""
    with {CV}, t as (select metric, model_1, model_2, avg(d) / nullif(stddev_samp(d) / sqrt(count(*)), 0) as t from pr group by 1, 2, 3),
    p as (select *, 1 - 0.75::double * abs(t) / sqrt(1 + t * t / 4) * (1 - t * t / (1 + t * t / 4) / 12) as p from t)
    select metric, model_1, model_2, round(t, 4) as t_statistic, round(p, 6) as p_value, coalesce(p < 0.05, false) as significant from p""")
def _(spark, sf):
    out = C.paired_ttest(materialize(_cv(spark, sf))).select("metric", "model_1", "model_2", "t_statistic", "p_value", "significant")
    return _r(_r(out.withColumn("significant", F.coalesce("significant", F.lit(False))), "p_value"), "t_statistic", places=4)


@query("cmp_effect_size", f"""
    with {CV}, e as (select metric, model_1, model_2, avg(d) as m, coalesce(avg(d) / nullif(sqrt((var_pop(s1) + var_pop(s2)) / 2), 0), 0) as c from pr group by 1, 2, 3)
    select metric, model_1, model_2, round(m, 6) as mean_difference, round(c, 4) as cohens_d,
      case when abs(c) < 0.2 then 'negligible' when abs(c) < 0.5 then 'small' when abs(c) < 0.8 then 'medium' else 'large' end as interpretation,
      abs(m) > 0.02 as practical_difference from e""")
def _(spark, sf):
    return _r(_r(C.effect_size(materialize(_cv(spark, sf))), "mean_difference"), "cohens_d", places=4)


@query("cmp_confidence_interval", f"""
    with {CV} select metric, model_1, model_2, round(avg(d), 6) as mean_difference, round(avg(d) - 2.7764451051977987 * stddev_samp(d) / sqrt(5), 5) as ci_lower,
      round(avg(d) + 2.7764451051977987 * stddev_samp(d) / sqrt(5), 5) as ci_upper from pr group by 1, 2, 3""")
def _(spark, sf):
    return _r(_r(C.confidence_interval(materialize(_cv(spark, sf))), "mean_difference"), "ci_lower", "ci_upper", places=5)


@query("cmp_wilcoxon", f"""
    with {CV}, r as (select *, rank() over (partition by metric, model_1, model_2 order by a) + (count(*) over (partition by metric, model_1, model_2, a) - 1) / 2.0::double as r
      from (select *, round(abs(d), 12) as a from pr where d <> 0) q)
    select metric, model_1, model_2, count(*) as n, least(sum(case when d > 0 then r else 0 end), sum(case when d < 0 then r else 0 end))::double as statistic from r group by 1, 2, 3""")
def _(spark, sf):
    return C.wilcoxon(materialize(_cv(spark, sf))).drop("p_value")


@query("cmp_friedman", f"""
    with {CV}, r as (select metric, model, fold, rank() over (partition by metric, fold order by s) + (count(*) over (partition by metric, fold, s) - 1) / 2.0::double as r,
        count(*) over (partition by metric, fold, s) as t from (select *, round(score, 12) as s from cv) q),
    m as (select metric, model, sum(r) as rs, sum(t * t - 1) as ties from r group by 1, 2),
    g as (select metric, sum(rs * rs) as rr, sum(ties)::double as ties, count(*)::double as k, 5.0::double as n from m group by 1)
    select metric, n::bigint as folds, k::bigint as models, round((12 / (n * k * (k + 1)) * rr - 3 * n * (k + 1)) / (1 - ties / (n * k * (k * k - 1))), 5) as statistic from g""")
def _(spark, sf):
    return _r(C.friedman(materialize(_cv(spark, sf))).drop("p_value"), "statistic", places=5)


@query("cmp_win_probability", f"with {CV} select metric, model_1, model_2, round(avg((d > 0)::int), 6) as win_probability from pr group by 1, 2, 3")
def _(spark, sf):
    return _r(C.win_probability(_cv(spark, sf)), "win_probability")


METRIC_NAMES = [*V.BASIC, "cost_savings", "cost_savings_percentage", "high_risk_detection_rate", "roc_auc"]
MODEL_METRICS = f"""k as (select model, sum((y_true = 1 and y_pred = 1)::int)::double as tp, sum((y_true = 0 and y_pred = 0)::int)::double as tn,
      sum((y_true = 0 and y_pred = 1)::int)::double as fp, sum((y_true = 1 and y_pred = 0)::int)::double as fn, count(*)::double as n from @scored s group by 1),
    bm as ({BASIC_SQL.format(by='model,', src='k')}),
    cm as (select model, base - total as cost_savings, (base - total) / base * 100 as cost_savings_percentage, tp / (tp + fn) as high_risk_detection_rate
      from {COSTS.format(src='k')} b),
    rk as (select model, y_true, rank() over (partition by model order by p) + (count(*) over (partition by model, p) - 1) / 2.0::double as r from @scored q),
    au as (select model, (sum(r) filter (where y_true = 1) - a * (a + 1) / 2) / (a * (count(*) - a)) as roc_auc from rk,
      (select count(*) filter (where y_true = 1)::double as a from @predictions p) x group by model, a),
    mm as (unpivot (select * from bm join cm using (model) join au using (model)) on {', '.join(METRIC_NAMES)} into name metric value value)"""


def _metrics(spark, sf):
    return materialize(V.metric_rows(P.models_scored(spark, sf), ["model"]))


@query("cmp_metric_ranking", f"""
    with {MODEL_METRICS} select model, metric, round(value, 6) as value, row_number() over (partition by metric order by round(value, 9) desc, model) as rank from mm""")
def _(spark, sf):
    m = _metrics(spark, sf).withColumn("value", F.round("value", 9))
    return _r(C.metric_ranking(m), "value")


WEIGHTED = f"""{MODEL_METRICS}, w(metric, w) as (values {', '.join(f"('{m}', {v}::double)" for m, v in C.WEIGHTS.items())}),
    wr as (select model, sum(w * v) / count(*) as score, sum(w * v) / sum(w) as normalized_score from (
      select model, w, least(greatest(case when metric = 'cost_savings_percentage' then value / 100 else value end, 0), 1) as v from mm join w using (metric)) q group by 1),
    ranked as (select *, row_number() over (order by score desc, model) as rank from wr)"""


@query("cmp_weighted_ranking", f"with {WEIGHTED} select model, round(score, 6) as score, round(normalized_score, 6) as normalized_score, rank from ranked")
def _(spark, sf):
    return _r(C.weighted_ranking(_metrics(spark, sf)), "score", "normalized_score")


@query("cmp_composite_score", f"""
    with {MODEL_METRICS}, v as (select model, max(value) filter (where metric = 'roc_auc') as roc_auc, max(value) filter (where metric = 'recall') as recall,
      max(value) filter (where metric = 'precision') as precision, max(value) filter (where metric = 'high_risk_detection_rate') as high_risk_detection_rate from mm group by 1)
    select model, round(roc_auc, 6) as roc_auc, round(recall, 6) as recall, round(precision, 6) as precision, round(high_risk_detection_rate, 6) as high_risk_detection_rate,
      round(roc_auc * 0.35 + recall * 0.25 + precision * 0.20 + high_risk_detection_rate * 0.20, 6) as composite_score from v""")
def _(spark, sf):
    out = C.composite_score(_metrics(spark, sf))
    return _r(out, *out.columns[1:])


@query("cmp_select_best", f"""
    with {WEIGHTED}, bad as (select distinct model from mm where (metric = 'accuracy' and value < 0.7) or (metric = 'f1_score' and value < 0.6) or (metric = 'roc_auc' and value < 0.7)),
    t as (select r.*, b.model is not null as failing from ranked r left join bad b on r.model = b.model where rank <= 3),
    o as (select *, lead(case when not failing then score end) over (order by failing, rank) as nxt, row_number() over (order by failing, rank) as place from t)
    select model as recommended_model, round(score, 6) as score, case when failing then 'warning' else 'success' end as status,
      round(case when not failing then case when nxt is null then 0.5 else least(0.5 + (score - nxt) * 10, 1.0) end end, 6) as confidence from o where place = 1""")
def _(spark, sf):
    m = _metrics(spark, sf)
    return _r(C.select_best(C.weighted_ranking(m), m), "score", "confidence")


@query("cmp_business_ranking", f"""
    with {MODEL_METRICS}, b as (select *, cost_savings_percentage / 100 * 0.6 + high_risk_detection_rate * 0.4 as business_score from cm)
    select model, cost_savings, round(cost_savings_percentage, 6) as cost_savings_percentage, round(high_risk_detection_rate, 6) as high_risk_detection_rate,
      round(business_score, 6) as business_score, row_number() over (order by cost_savings desc, model) as savings_rank,
      row_number() over (order by high_risk_detection_rate desc, model) as detection_rank, row_number() over (order by business_score desc, model) as business_rank from b""")
def _(spark, sf):
    return _r(C.business_ranking(_metrics(spark, sf)), "cost_savings_percentage", "high_risk_detection_rate", "business_score")


@query("cmp_threshold_gate", f"""
    with {MODEL_METRICS} select model, metric, round(value, 6) as value, lim as "limit", value >= lim as passed from mm join (values ('accuracy', 0.85::double),
      ('precision', 0.90), ('recall', 0.80), ('f1_score', 0.85), ('roc_auc', 0.88)) g(metric, lim) using (metric)""")
def _(spark, sf):
    return _r(threshold_gate(_metrics(spark, sf), C.KPI), "value")
