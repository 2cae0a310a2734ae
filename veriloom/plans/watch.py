"""Queries over drift, monitoring and governance."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.functions.lexicon import SPACE
from veriloom.operators import drift as D
from veriloom.operators import governance as G
from veriloom.operators import monitor as N
from veriloom.plans import profiles as P
from veriloom.plans.registry import query
from veriloom.session import materialize, scratch_path, spread_rows, stored


def _r(df, *names, places=6):
    return df.withColumns({c: F.round(c, places) for c in names})


def _event_sides(spark, sf):
    ev = P.events(spark, sf)
    cut = F.lit(P.SPLIT_TS).cast("timestamp_ntz")
    return ev.where(F.col("ts") < cut), ev.where(F.col("ts") >= cut)


def _doc_sides(spark, sf):
    d = spread_rows(P.documents(spark, sf).select("doc_id", "text"), "doc_id")
    return d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")


REF, NEW = "ts < timestamp '2024-01-16'", "ts >= timestamp '2024-01-16'"


@query("drift_feature_types", """
    select 'doc_id' as feature, 'numerical' as type, count(*) as rows from documents union all select 'n_chars', 'numerical', count(*) from documents
    union all select 'text', case when avg(length(coalesce(text, 'nan'))) > 20 or count(distinct text)::double / count(*) > 0.5 then 'text' else 'categorical' end, count(*) from documents
    union all select 'lang', case when avg(length(coalesce(lang, 'nan'))) > 20 or count(distinct lang)::double / count(*) > 0.5 then 'text' else 'categorical' end, count(*) from documents
    union all select 'source', case when avg(length(coalesce(source, 'nan'))) > 20 or count(distinct source)::double / count(*) > 0.5 then 'text' else 'categorical' end, count(*) from documents""")
def _(spark, sf):
    return D.feature_types(P.documents(spark, sf))


@query("drift_reference_stats", f"""
    select 'value' as feature, round(avg(value), 6) as mean, round(stddev_samp(value), 6) as std, min(value) as min, max(value) as max, round(quantile_cont(value, 0.25), 6) as q25,
      round(quantile_cont(value, 0.5), 6) as median, round(quantile_cont(value, 0.75), 6) as q75, round(min(value) + 7 * (max(value) - min(value)) / 20, 6) as edge_7,
      21 as n_edges from events where {REF}""")
def _(spark, sf):
    ref, _new = _event_sides(spark, sf)
    out = D.numeric_reference(ref, ["value"])
    out = out.withColumns({"edge_7": F.col("edges")[7], "n_edges": F.size("edges")}).drop("edges")
    return _r(out, "mean", "std", "q25", "median", "q75", "edge_7")


@query("drift_reference_categories", f"""
    select 'event_type' as feature, event_type as value, count(*) as n, round(count(*)::double / sum(count(*)) over (), 6) as share from events where {REF} group by event_type""")
def _(spark, sf):
    return _r(D.category_shares(_event_sides(spark, sf)[0], ["event_type"]), "share")


@query("drift_reference_text", f"""
    with w as (select unnest(regexp_split_to_array(text, '[{SPACE}]+')) as w from documents where doc_id % 2 = 0)
    select (select round(avg(length(text)), 6) from documents where doc_id % 2 = 0) as avg_length, (select quantile_cont(length(text), 0.5)::double from documents where doc_id % 2 = 0) as median_length,
      count(*) as tokens, count(distinct w) as distinct_tokens from w where w <> ''""")
def _(spark, sf):
    return _r(D.text_reference(_doc_sides(spark, sf)[0], "text"), "avg_length")


KS = f"""h as (select value, count(*) filter (where {REF})::double as r, count(*) filter (where {NEW})::double as n from events where value is not null group by 1),
    ks as (select max(abs(cr / tr - cn / tn)) as d, max(tr) as tr, max(tn) as tn from (
      select sum(r) over (order by value) as cr, sum(n) over (order by value) as cn, sum(r) over () as tr, sum(n) over () as tn from h) q),
    kp as (select *, greatest(0, least(1, 2 * list_sum(list_transform(range(1, 60), lambda k: (case when k % 2 = 1 then 1 else -1 end) * exp(-2.0::double * k * k * d * d * tr * tn / (tr + tn)))))) as p from ks)"""


@query("drift_ks", f"with {KS} select 'value' as feature, tr::bigint as n_ref, tn::bigint as n_new, round(d, 6) as ks_statistic, round(p, 5) as p_value from kp")
def _(spark, sf):
    return _r(_r(D.ks(*_event_sides(spark, sf), ["value"]), "ks_statistic"), "p_value", places=5)


def _psi_sql(bins, eps):
    return f"""e as (select min(value) as lo, max(value) as hi from events where {REF}),
    pb as (select case when value between lo and hi then least(floor((value - lo) / (hi - lo) * {bins}), {bins} - 1) end as bin, {REF} as is_ref from events, e where value is not null),
    pc as (select bin, count(*) filter (where is_ref)::double as r, count(*) filter (where not is_ref)::double as n from pb group by 1),
    ps as (select sum((q - p) * ln(q / p)) as psi from (select greatest(r / (select sum(r) from pc), {eps}::double) as p, greatest(n / (select sum(n) from pc), {eps}::double) as q
      from pc where bin is not null) x)"""


@query("drift_psi_numeric", f"with {_psi_sql(20, '1e-10')} select 'value' as feature, round(psi, 6) as psi from ps")
def _(spark, sf):
    return _r(D.psi_numeric(*_event_sides(spark, sf), ["value"]), "psi")


@query("drift_psi_10bin", f"""with {_psi_sql(10, '1e-4')} select 'value' as feature, round(abs(psi), 6) as psi,
    case when abs(psi) > 0.25 then 'high' when abs(psi) > 0.1 then 'medium' else 'low' end as severity from ps""")
def _(spark, sf):
    out = D.psi_numeric(*_event_sides(spark, sf), ["value"], bins=10, eps=1e-4).withColumn("psi", F.abs("psi"))
    return _r(out.withColumn("severity", D.psi_severity(F.col("psi"))), "psi")


@query("drift_moments", f"""
    with s as (select avg(value) filter (where {REF}) as mr, stddev_samp(value) filter (where {REF}) as sr, avg(value) filter (where {NEW}) as mn, stddev_samp(value) filter (where {NEW}) as sn from events)
    select 'value' as feature, round(abs(mn - mr) / sr, 6) as mean_shift, round(sn / sr, 6) as std_ratio from s""")
def _(spark, sf):
    return _r(D.moments(*_event_sides(spark, sf), ["value"]), "mean_shift", "std_ratio")


@query("drift_numeric_details", f"""with {KS}, {_psi_sql(20, '1e-10')},
    s as (select avg(value) filter (where {REF}) as mr, stddev_samp(value) filter (where {REF}) as sr, avg(value) filter (where {NEW}) as mn, stddev_samp(value) filter (where {NEW}) as sn from events)
    select 'value' as feature, tr::bigint as n_ref, tn::bigint as n_new, round(d, 5) as ks_statistic, round(p, 5) as p_value, round(psi, 5) as psi,
      round(abs(mn - mr) / sr, 5) as mean_shift, round(sn / sr, 5) as std_ratio from kp, ps, s""")
def _(spark, sf):
    out = D.numeric_details(stored(D.histograms(*_event_sides(spark, sf), ["value"]), "histograms"))
    return _r(out, "ks_statistic", "p_value", "psi", "mean_shift", "std_ratio", places=5)


CAT = f"""c as (select event_type as value, count(*) filter (where {REF})::double as r, count(*) filter (where {NEW})::double as n from events group by 1),
    ct as (select sum(r) as tr, sum(n) as tn from c),
    cx as (select count(*) as k, sum((n - r / tr * tn) * (n - r / tr * tn) / (r / tr * tn)) as x, sum((n / tn - r / tr) * ln((n / tn) / (r / tr))) as psi from c, ct)"""


@query("drift_chi2", f"with {CAT} select 'event_type' as feature, k as categories, round(x, 6) as chi2_statistic, round(exp(-x / 2) * (1 + x / 2), 6) as p_value from cx")
def _(spark, sf):
    return _r(D.chi2(D.category_sides(*_event_sides(spark, sf), ["event_type"])), "chi2_statistic", "p_value")


@query("drift_psi_categorical", f"with {CAT} select 'event_type' as feature, round(psi, 6) as psi from cx")
def _(spark, sf):
    return _r(D.psi_categorical(D.category_sides(*_event_sides(spark, sf), ["event_type"])), "psi")


@query("drift_new_categories", """
    with v as (select 'event_type' as feature, case when event_id % 2 = 0 and event_type = 'click' then 'tap' else event_type end as value, event_id % 2 = 1 and event_type <> 'error' as keep, event_id % 2 = 0 as is_new from events),
    r as (select distinct value from v where not is_new and keep), n as (select distinct value from v where is_new)
    select 'event_type' as feature, value, 'new' as change from n where value not in (select value from r)
    union all select 'event_type', value, 'missing' from r where value not in (select value from n)""")
def _(spark, sf):
    ev = P.events(spark, sf)
    new = ev.where("event_id % 2 = 0").withColumn("event_type", F.when(F.col("event_type") == "click", "tap").otherwise(F.col("event_type")))
    ref = ev.where("event_id % 2 = 1 and event_type <> 'error'")
    return D.category_changes(D.category_sides(ref, new, ["event_type"]))


@query("drift_text_length", """
    with s as (select avg(length(text)) filter (where doc_id % 2 = 0) as r, avg(length(text)) filter (where doc_id % 2 = 1) as n from documents)
    select 'text' as feature, round(r, 6) as avg_length_ref, round(n, 6) as avg_length_new, round(abs(n - r) / r, 6) as length_shift from s""")
def _(spark, sf):
    return _r(D.text_length_shift(*_doc_sides(spark, sf), "text"), "avg_length_ref", "avg_length_new", "length_shift")


def _js_sql(table, column, ref, new):
    def side(cond):
        return (f"select word, count(*)::double as n from (select unnest(regexp_split_to_array(lower({column}), '[{SPACE}]+')) as word from {table} where {cond}) w"
                " where word <> '' group by 1")
    return f"""ja as ({side(ref)}), jb as ({side(new)}),
    jm as (select coalesce(ja.n / (select sum(n) from ja), 1e-10::double) as p, coalesce(jb.n / (select sum(n) from jb), 1e-10::double) as q from ja full join jb using (word)),
    js as (select sum(p * ln(p / ((p + q) / 2))) / 2 + sum(q * ln(q / ((p + q) / 2))) / 2 as js from jm)"""


@query("drift_text_js", f"with {_js_sql('documents', 'text', 'doc_id % 2 = 0', 'doc_id % 2 = 1')} select 'text' as feature, round(js, 6) as js_divergence from js")
def _(spark, sf):
    return _r(D.text_divergence(*_doc_sides(spark, sf), "text"), "js_divergence")


REPORT = f"""{KS}, {_psi_sql(20, '1e-10')}, {CAT}, {_js_sql('events', 'props', REF, NEW)},
    tl as (select abs(avg(length(props)) filter (where {NEW}) - avg(length(props)) filter (where {REF})) / avg(length(props)) filter (where {REF}) as s from events),
    rep as (select 'value' as feature, 'numerical' as feature_type, greatest(1 - p, psi / 0.2) as drift_score, p < 0.05 or psi > 0.2 as drift_detected from kp, ps
      union all select 'event_type', 'categorical', greatest(1 - exp(-x / 2) * (1 + x / 2), psi / 0.2), exp(-x / 2) * (1 + x / 2) < 0.05 or psi > 0.2 from cx
      union all select 'props', 'text', greatest(s / 0.2, js / 0.1), s > 0.2 or js > 0.1 from tl, js)"""


def _report(spark, sf):
    ref, new = _event_sides(spark, sf)
    return materialize(D.report(ref, new, ["value"], ["event_type"], ["props"]))


@query("drift_report", f"with {REPORT} select feature, feature_type, round(drift_score, 5) as drift_score, drift_detected, null::varchar as error from rep")
def _(spark, sf):
    return _r(_report(spark, sf), "drift_score", places=5)


@query("drift_summary", f"""with {REPORT}, s as (select count(*) as features, avg(drift_score) as o, count(*) filter (where drift_detected) as k from rep)
    select features, round(o, 5) as overall_drift_score, k as features_with_drift, round(100.0::double * k / features, 6) as drift_percentage, o > 0.1 or k > 0 as drift_detected,
      case when o < 0.1 then 'none' when o < 0.3 then 'warning' else 'critical' end as severity from s""")
def _(spark, sf):
    return _r(_r(D.summary(_report(spark, sf)), "drift_percentage"), "overall_drift_score", places=5)


@query("drift_top_features", f"with {REPORT} select feature, round(drift_score, 5) as drift_score from rep order by drift_score desc, feature limit 5")
def _(spark, sf):
    return _r(D.top_features(_report(spark, sf)).select("feature", "drift_score"), "drift_score", places=5)


@query("drift_overall_count_rule", f"""with {REPORT} select count(*) filter (where drift_detected) as features_with_drift,
    round(count(*) filter (where drift_detected)::double / count(*), 6) as drift_share, count(*) filter (where drift_detected) >= 3 as overall_drift_detected from rep""")
def _(spark, sf):
    return _r(D.count_rule(_report(spark, sf)), "drift_share")


@query("drift_concept", f"""
    with q as (select quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from events where {REF}),
    b as (select len(list_filter(e, lambda x: value > x))::int as bin, {REF} as r, (event_type = 'error')::int as y from events, q),
    s as (select bin, count(*) filter (where r) as n_ref, count(*) filter (where not r) as n_new, avg(y) filter (where r) as a, avg(y) filter (where not r) as b from b group by 1)
    select bin, n_ref, n_new, round(a, 6) as rate_ref, round(b, 6) as rate_new, coalesce(round(n_new * (b - a) * (b - a) / (a * (1 - a)), 6), 0) as chi2_term from s""")
def _(spark, sf):
    ref, new = (d.withColumn("y", (F.col("event_type") == "error").cast("int")) for d in _event_sides(spark, sf))
    return _r(D.concept(ref, new, "value", "y"), "rate_ref", "rate_new", "chi2_term")


# ---------------------------------------------------------------- monitoring

def _history(spark, sf):
    """Daily accuracy-like values per event type as metric history."""
    h = P.history(spark, sf)
    return h.select("model", "ts", F.lit("accuracy").alias("metric"), "value").unionAll(
        h.select("model", "ts", F.lit("f1_score").alias("metric"), (F.col("value") * 0.9).alias("value")))


HIST = "(select model, ts, 'accuracy' as metric, value from @history h1 union all select model, ts, 'f1_score', value * 0.9 from @history h2)"
AS_OF = "2024-01-31"
BASE_SQL = f"base as (select model, metric, arg_max(value, ts) as baseline, max(ts) as set_at from {HIST} h where ts < timestamp '2024-01-16' group by 1, 2)"
CUR_SQL = f"cur as (select model, metric, arg_max(value, ts) as value from {HIST} h where ts >= timestamp '2024-01-16' group by 1, 2)"
DEG_SQL = f"""{BASE_SQL}, {CUR_SQL}, deg as (select model, avg(case when baseline > 0 then -(value - baseline) / baseline else 0 end) as d, count(*) as k from cur join base using (model, metric) group by 1),
    sev as (select *, case when d > 0.1 then 'critical' when d > 0.05 then 'warning' else 'none' end as severity from deg)"""


def _base_and_current(spark, sf):
    h, cut = _history(spark, sf), F.lit(P.SPLIT_TS).cast("timestamp_ntz")
    base = N.baseline(h.where(F.col("ts") < cut))
    current = N.baseline(h.where(F.col("ts") >= cut)).select("model", "metric", F.col("baseline").alias("value"))
    return materialize(base), materialize(current)


@query("mon_baseline", f"with {BASE_SQL} select model, metric, round(baseline, 6) as baseline, set_at from base")
def _(spark, sf):
    return _r(_base_and_current(spark, sf)[0], "baseline")


@query("mon_degradation", f"with {DEG_SQL} select model, round(d, 6) as overall_degradation, k as metrics, d > 0.05 as degradation_detected, severity from sev")
def _(spark, sf):
    base, current = _base_and_current(spark, sf)
    return _r(N.degradation(current, base), "overall_degradation")


TREND = f"""r as (select h.*, min(ts) over (partition by model, metric) as t0 from {HIST} h where ts > timestamp '{AS_OF}' - interval 7 days and ts <= timestamp '{AS_OF}'),
    tr as (select model, metric, count(*) as points, regr_slope(value, date_diff('day', t0, ts)) as slope, corr(value, date_diff('day', t0, ts)) as r,
      arg_min(value, ts) as initial_value, arg_max(value, ts) as current_value from r group by 1, 2 having count(*) >= 2)"""


@query("mon_trend", f"""with {TREND} select model, metric, points, round(slope, 6) as slope, round(r * r, 6) as r_squared, case when slope > 0 then 'improving' else 'declining' end as trend_direction,
    case when abs(r) > 0.7 then 'strong' else 'weak' end as trend_strength, round(initial_value, 6) as initial_value, round(current_value, 6) as current_value,
    round(current_value - initial_value, 6) as total_change from tr""")
def _(spark, sf):
    out = N.trend(_history(spark, sf), AS_OF, 7).drop("p_value")
    return _r(out, "slope", "r_squared", "initial_value", "current_value", "total_change")


def _actions(spark, sf):
    base, current = _base_and_current(spark, sf)
    h = _history(spark, sf)
    models = P.events(spark, sf).select(F.col("event_type").alias("model")).distinct()
    base = base.where("model <> 'view'")
    degraded = N.degradation(current, base)
    status = N.monitoring_status(models, base, current, degraded, N.trend(h, AS_OF, 7))
    return N.recommendations(status), degraded, current


ACTIONS = f"""{DEG_SQL}, {TREND},
    st as (select m.model, m.model <> 'view' as hb, case when m.model <> 'view' then severity else 'none' end as severity, case when m.model <> 'view' then d else 0 end as d,
      exists (select 1 from tr where tr.model = m.model and slope <= 0 and abs(r) > 0.7) as declining from (select distinct event_type as model from events) m left join sev using (model)),
    ac as (select model, case when hb and severity = 'critical' then 'critical' when hb and severity = 'warning' then 'medium' else 'low' end as overall_priority,
      list_filter([case when not hb then 'establish_baseline' end, case when hb and severity = 'critical' then 'immediate_investigation' end,
        case when hb and severity = 'critical' and d > 0.08 then 'retrain_model' end, case when hb and severity = 'warning' then 'investigate_performance' end,
        case when hb and declining then 'monitor_trend' end, case when hb then 'check_data_drift' end], lambda x: x is not null) as a from st)"""


@query("mon_recommend", f"""with {ACTIONS} select model, overall_priority, (p - 1)::int as position, a[p] as action,
    case when a[p] = 'establish_baseline' then 'high' when a[p] in ('immediate_investigation', 'retrain_model') then 'critical' when a[p] = 'check_data_drift' then 'low' else 'medium' end as priority
    from (select *, unnest(range(1, len(a) + 1)) as p from ac) q""")
def _(spark, sf):
    return _actions(spark, sf)[0]


SCORED = """(select event_id, ts, user_id, (value > 10)::int as y_pred, case when event_id % 3 <> 0 then (user_id % 2 = 0)::int end as y_true,
    (0.5 + (event_id % 50) / 100.0)::double as confidence, event_type from events)"""


def _scored(spark, sf):
    from veriloom.plans.streams import _scored as scored
    return scored(P.events(spark, sf))


@query("mon_window_metrics", f"""
    with w as (select * from {SCORED} s where ts > timestamp '2024-01-30' - interval 24 hours and ts <= timestamp '2024-01-30')
    select round(count(*) filter (where y_true = y_pred)::double / count(y_true), 6) as accuracy,
      round(count(*) filter (where y_true = 1 and y_pred = 1)::double / count(*) filter (where y_pred = 1 and y_true is not null), 6) as precision,
      round(count(*) filter (where y_true = 1 and y_pred = 1)::double / count(*) filter (where y_true = 1), 6) as recall,
      count(*) as prediction_count, count(y_true) as labeled_count, round(avg(confidence), 9) as avg_confidence from w""")
def _(spark, sf):
    out = N.window_metrics(_scored(spark, sf), "2024-01-30", 24)
    return _r(_r(out, "accuracy", "precision", "recall"), "avg_confidence", places=9)


@query("mon_prediction_distribution", f"""
    select ts::date as day, y_pred as predicted, case when confidence < 0.5 then 'very_low' when confidence < 0.7 then 'low' when confidence < 0.9 then 'medium' else 'high' end as band,
      count(*) as n from {SCORED} s group by 1, 2, 3""")
def _(spark, sf):
    return N.prediction_distribution(_scored(spark, sf), "ts", "y_pred", "confidence")


@query("mon_quality_over_time", """
    with v as (select ts::date as day, case when event_id % 17 = 0 then null else value end as value from events),
    b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (select quantile_cont(value, 0.25) as q1, quantile_cont(value, 0.75) as q3 from v) q),
    d as (select day, count(*) as rows, avg((value is null)::int) as n, avg((coalesce(value < lo or value > hi, false))::int) as o from v, b group by 1)
    select day, rows, round(n, 6) as null_share, round(o, 6) as outlier_share, round(n - lag(n) over (order by day), 6) as null_share_change from d""")
def _(spark, sf):
    ev = P.events(spark, sf).withColumn("value", F.when(F.col("event_id") % 17 != 0, F.col("value")))
    return _r(N.quality_over_time(ev, "ts", "value"), "null_share", "outlier_share", "null_share_change")


@query("mon_schema_evolution", """
    select c as column_name, o as old_type, n as new_type, ch as change, (select count(*) from events) as old_rows, (select count(*) from events) as new_rows from (values
      ('event_id', 'bigint', 'bigint', 'same'), ('ts', 'timestamp_ntz', 'date', 'retyped'), ('user_id', 'bigint', 'bigint', 'same'), ('event_type', 'string', 'string', 'same'),
      ('value', 'double', 'double', 'same'), ('props', 'string', null, 'removed'), ('channel', null, 'string', 'added')) s(c, o, n, ch)""")
def _(spark, sf):
    ev = P.events(spark, sf)
    return N.schema_evolution(ev, ev.drop("props").withColumn("ts", F.col("ts").cast("date")).withColumn("channel", F.lit("web")))


@query("mon_drift_perf_link", f"""with {REPORT}, {CUR_SQL}, dd as (select avg(drift_score) > 0.1 or count(*) filter (where drift_detected) > 0 as drift_detected from rep)
    select model, round(avg(value), 6) as avg_performance, drift_detected, case when not drift_detected then 'unknown' when avg(value) < 0.7 then 'possible' else 'unlikely' end
      as drift_performance_correlation from cur, dd group by model, drift_detected""")
def _(spark, sf):
    current = _base_and_current(spark, sf)[1]
    found = D.summary(_report(spark, sf)).select("drift_detected").scalar()
    perf = current.groupBy("model").agg(F.avg("value").alias("avg_performance")).withColumn("drift_detected", found)
    return _r(N.drift_performance_link(perf), "avg_performance")


@query("mon_integrated", f"""with {REPORT}, {ACTIONS},
    ds as (select avg(drift_score) as o, avg(drift_score) > 0.1 or count(*) filter (where drift_detected) > 0 as drift_detected from rep),
    pf as (select model, avg(value) as p from cur group by 1)
    select model, overall_priority as priority, round(p, 6) as avg_performance, severity0 as performance_severity, drift_detected,
      case when o < 0.1 then 'none' when o < 0.3 then 'warning' else 'critical' end as drift_severity, round(o, 5) as overall_drift_score,
      case when not drift_detected then 'unknown' when p < 0.7 then 'possible' else 'unlikely' end as drift_performance_correlation,
      drift_detected and overall_priority in ('critical', 'high') as alert
    from ac left join pf using (model) left join (select model, severity as severity0 from sev where model <> 'view') q using (model), ds""")
def _(spark, sf):
    actions, degraded, current = _actions(spark, sf)
    out = N.integrated(D.summary(_report(spark, sf)), degraded, actions, current)
    return _r(_r(out, "avg_performance"), "overall_drift_score", places=5)


# From this day on the new half of the events is shifted, so that there is drift to be found.
SHIFT_TS = "2024-01-24"
SHIFTED = {"value": "value * 3", "user_id": "user_id % 7", "event_type": "case when event_type = 'click' then 'tap' else event_type end"}
SHIFTED_SQL = "(select ts, " + ", ".join(f"case when ts >= timestamp '{SHIFT_TS}' then {e} else {c} end as {c}" for c, e in SHIFTED.items()) + " from events)"


def _psi_days_sql(bins: int = 20, eps: str = "1e-10::double") -> str:
    ref, numbers = REF, ("value", "user_id")
    ends = ", ".join(f"min({c}) filter (where {ref})::double as lo_{c}, max({c}) filter (where {ref})::double as hi_{c}" for c in numbers)
    cell = "case when {c} between lo_{c} and hi_{c} then least(floor(({c} - lo_{c}) / (hi_{c} - lo_{c}) * {b}), {b} - 1)::int::varchar else 'outside' end"
    parts = [f"select ts::date as day, {ref} as is_ref, '{c}' as feature, 'numerical' as feature_type, {cell.format(c=c, b=bins)} as cell from sh, en where {c} is not null" for c in numbers]
    parts.append(f"select ts::date, {ref}, 'event_type', 'categorical', event_type from sh where event_type is not null")
    return f"""sh as materialized (select * from {SHIFTED_SQL} s0), en as (select {ends} from sh), cl as materialized ({" union all ".join(parts)}),
    rc as (select feature, cell, count(*)::double / sum(count(*)) over (partition by feature) as p from cl where is_ref group by 1, 2),
    dt as (select day, feature, feature_type, count(*) as n from cl where not is_ref group by 1, 2, 3),
    dc as (select day, feature, cell, count(*) as k from cl where not is_ref group by 1, 2, 3),
    al as (select feature, cell from rc union select feature, cell from dc),
    pd as (select day, feature, feature_type, n, sum((q - p) * ln(q / p)) as psi from (
        select dt.*, coalesce(rc.p, {eps}) as p, coalesce(dc.k::double / dt.n, {eps}) as q
        from dt join al using (feature) left join rc using (feature, cell) left join dc using (day, feature, cell)
        where cell <> 'outside' and (rc.p is not null or dc.k is not null)) x group by 1, 2, 3, 4),
    dd as (select *, psi > 0.2 and n >= 100 as drift_detected from pd)"""


def _psi_days(spark, sf):
    ev = P.events(spark, sf)
    shifted = ev.select("ts", *[F.when(F.col("ts") >= N.at(SHIFT_TS), F.expr(e)).otherwise(F.col(c)).alias(c) for c, e in SHIFTED.items()])
    cut = N.at(P.SPLIT_TS)
    return D.psi_by_period(shifted.where(F.col("ts") < cut), shifted.where(F.col("ts") >= cut), N.day("ts"), ["value", "user_id"], ["event_type"])


@query("drift_psi_by_day", f"with {_psi_days_sql()} select day, feature, feature_type, n, round(psi, 6) as psi, drift_detected from dd")
def _(spark, sf):
    return _r(_psi_days(spark, sf).withColumnRenamed("period", "day"), "psi")


@query("mon_alert_rules", f"""
    with {_psi_days_sql()}, m as (select ts::date as day, avg((y_true = y_pred)::int) as accuracy, avg(confidence) as avg_confidence from {SCORED} s group by 1),
    fd as (select day, (count(*) filter (where drift_detected))::double as k from dd group by 1)
    select day, 'accuracy' as metric, round(accuracy, 6) as value, 0.85::double as "limit", 'critical' as severity, 'performance_degradation' as alert from m where accuracy < 0.85
    union all select day, 'avg_confidence', round(avg_confidence, 6), 0.7, 'warning', 'low_confidence' from m where avg_confidence < 0.7
    union all select day, 'features_with_drift', k, 3.0, 'warning', 'data_drift' from fd where k >= 3""")
def _(spark, sf):
    daily = _scored(spark, sf).groupBy(N.day("ts").alias("day")).agg(
        F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"), F.avg("confidence").alias("avg_confidence"))
    drifted = D.features_with_drift(_psi_days(spark, sf)).select(
        F.col("period").alias("day"), F.lit("features_with_drift").alias("metric"), F.col("features_with_drift").cast("double").alias("value"))
    metrics = daily.unpivot(["day"], ["accuracy", "avg_confidence"], "metric", "value").unionByName(drifted)
    return _r(N.alert_rules(metrics), "value")


@query("mon_alert_sustained", """
    with f as (select *, coalesce(value > 5, false) as ok, sum(case when coalesce(value > 5, false) then 0 else 1 end) over (partition by user_id order by ts, event_id) as island from events),
    g as (select user_id, island, min(ts) as started, max(ts) as ended, count(*) as rows from f where ok group by 1, 2)
    select user_id, started, ended, rows, (epoch_us(ended) - epoch_us(started)) / 60000000.0::double as minutes from g where (epoch_us(ended) - epoch_us(started)) / 60000000.0::double >= 15""")
def _(spark, sf):
    return N.sustained(P.events(spark, sf), "user_id", "ts", "event_id", F.col("value") > 5, 15)


@query("mon_alert_cooldown", """
    with recursive s as (select event_type, time_bucket(interval 5 minutes, ts) as slot, count(*) as n from events where value > 15 group by 1, 2),
    f as (select event_type, min(slot) as sent_at from s group by 1
      union all select f.event_type, (select min(slot) from s where s.event_type = f.event_type and s.slot >= f.sent_at + interval 12 hours) from f
        where exists (select 1 from s where s.event_type = f.event_type and s.slot >= f.sent_at + interval 12 hours)),
    t as (select event_type, sum(n)::bigint as raised from s group by 1)
    select event_type, raised, sent_at from f join t using (event_type)""")
def _(spark, sf):
    return N.cooldown(P.events(spark, sf).where("value > 15"), ["event_type"], "ts", 12, 5)


CHECKS = """(select event_type as model, date_trunc('day', ts) as ts, count(*) as samples, avg((value > 10)::int) > 0.4 as drift_detected,
    case when avg((value > 10)::int) > 0.45 then 'critical' when avg((value > 10)::int) > 0.38 then 'medium' else 'low' end as priority from events group by 1, 2)"""


@query("mon_period_summary", f"""
    select model, count(*) as checks, round(100.0::double * count(*) filter (where drift_detected) / count(*), 6) as drift_percentage,
      round(100.0::double * count(*) filter (where priority in ('critical', 'high')) / count(*), 6) as issue_percentage, round(avg(samples), 6) as mean_samples,
      arg_max(priority, ts) as latest_priority, max(ts) as last_check from {CHECKS} c where ts > timestamp '{AS_OF}' - interval 14 days and ts <= timestamp '{AS_OF}' group by 1""")
def _(spark, sf):
    h = P.history(spark, sf)
    share = F.col("value")
    checks = h.select("model", "ts", F.col("prediction_count").alias("samples"), (share > 0.4).alias("drift_detected"),
                      F.when(share > 0.45, "critical").when(share > 0.38, "medium").otherwise("low").alias("priority"))
    return _r(N.period_summary(checks, AS_OF, 14), "drift_percentage", "issue_percentage", "mean_samples")


@query("mon_model_usage", """
    select 'model_' || user_id % 4 as model, count(*) as predictions, count(*) filter (where event_type = 'error') as errors, round(avg(value), 6) as mean_seconds, max(ts) as last_used
    from events group by 1""")
def _(spark, sf):
    log = P.events(spark, sf).select(F.concat(F.lit("model_"), F.col("user_id") % 4).alias("m"), "ts", (F.col("event_type") == "error").alias("failed"), "value")
    return _r(N.model_usage(log, "m", "ts", "failed", "value"), "mean_seconds")


@query("mon_request_stats", """
    with r as (select *, row_number() over (partition by endpoint order by ts desc, event_id desc) as rn from @requests q)
    select endpoint, count(*) as requests, count(*) filter (where is_error) as errors, round(avg(duration), 6) as mean, round(quantile_cont(duration, 0.5), 6) as median,
      min(duration) as min, max(duration) as max, count(*) filter (where duration > 5) as slow from r where rn <= 1000 group by 1""")
def _(spark, sf):
    return _r(N.request_stats(P.requests(spark, sf)), "mean", "median")


@query("mon_error_rate", """
    with w as (select time_bucket(interval 1 minute, ts) - k * interval 1 minute as window_start, is_error from @requests q, range(5) r(k))
    select window_start, count(*) as requests, count(*) filter (where is_error) as errors, round(count(*) filter (where is_error)::double / count(*), 6) as error_rate
    from w group by 1 having count(*) filter (where is_error)::double / count(*) > 0.05""")
def _(spark, sf):
    return _r(N.error_rate(P.requests(spark, sf)), "error_rate")


@query("mon_latency_quantiles", """
    select endpoint, count(duration) as n, round(quantile_cont(duration, 0.95), 6) as p95, round(quantile_cont(duration, 0.99), 6) as p99, quantile_cont(duration, 0.95) > 30 as over_limit
    from @requests q group by 1""")
def _(spark, sf):
    return _r(N.latency_quantiles(P.requests(spark, sf), 30.0), "p95", "p99")


@query("mon_rate_anomaly", """
    with c as (select event_id, user_id, count(*) over (partition by user_id order by ts range between interval '59 minutes 59.999999 seconds' preceding and current row) as recent from events)
    select event_id, user_id, recent from c where recent > 1""")
def _(spark, sf):
    return N.rate_anomalies(P.events(spark, sf).select("event_id", "user_id", "ts"), "user_id", "ts", "event_id", 60, 1).drop("ts")


def _trailing_sql(kind, actor, minutes, limit, where):
    rule, severity, *_ = N.SECURITY[kind]
    return f"""select event_id, '{rule}' as rule, '{severity}' as severity, {actor}::varchar as actor, n as observed from (select event_id, {actor}, count(*) over (
      partition by {actor} order by ts range between interval '{minutes} minutes' preceding and current row)
      - count(*) over (partition by {actor} order by ts range between interval '{minutes} minutes' preceding and interval '{minutes} minutes' preceding) as n
      from events where {actor} is not null and {where}) q where n > {limit}"""


# the events are too sparse for windows of minutes
SECURITY = {"failed": (*N.SECURITY["failed"][:2], 20_160, 2), "rate": (*N.SECURITY["rate"][:2], 10_080, 4), "bulk": (*N.SECURITY["bulk"][:2], None, 15),
            "role": N.SECURITY["role"]}


@query("mon_security_rules", f"""{_trailing_sql('failed', 'user_id', 20160, 2, "event_type = 'error'")} union all {_trailing_sql('rate', 'user_id', 10080, 4, 'true')}
    union all select event_id, '{N.SECURITY['bulk'][0]}', 'critical', user_id::varchar, floor(value)::bigint from events where floor(value) > 15
    union all select event_id, '{N.SECURITY['role'][0]}', 'critical', user_id::varchar, 1 from events where event_type = 'signup'""")
def _(spark, sf):
    ev = P.events(spark, sf)
    return N.security_alerts(ev, "event_id", "ts", "user_id", "user_id", F.col("event_type") == "error", F.floor("value"), F.col("event_type") == "signup", SECURITY)


@query("mon_alert_group", """
    select event_type, date_trunc('hour', ts) as hour, count(*) as alerts, min(ts) as first_at, max(ts) as last_at from events where value > 15 group by 1, 2""")
def _(spark, sf):
    return N.alert_groups(P.events(spark, sf).where("value > 15"), "event_type", "ts")


def _volume_sql(period, src, ts, high, duration, limit, saving):
    return f"""with g as (select {period} as period, count(*) as volume, round(avg(({high})::int), 6) as high_share, round(avg(({duration} <= {limit})::int), 6) as sla_share,
      round(sum({saving}), 2) as savings from {src} group by 1)
    select *, round((volume - lag(volume) over (order by period))::double / lag(volume) over (order by period), 6) as growth from g"""


@query("mon_business_daily", _volume_sql("ts::date", "events", "ts", "value > 10", "value", 8, "value"))
def _(spark, sf):
    out = N.volume(P.events(spark, sf), "ts", "day", F.col("value") > 10, "value", 8, "value")
    return _r(_r(out, "high_share", "sla_share", "growth"), "savings", places=2)


@query("mon_business_monthly", _volume_sql("date_trunc('month', claim_date)::date", "@claims c", "claim_date", "risk_level = 'high'", "policy_duration", 30, "claim_amount"))
def _(spark, sf):
    out = N.volume(P.claims(spark, sf, "claim_date", "risk_level", "policy_duration", "claim_amount"), "claim_date", "month",
                   F.col("risk_level") == "high", "policy_duration", 30, "claim_amount")
    return _r(_r(out, "high_share", "sla_share", "growth"), "savings", places=2)


# ---------------------------------------------------------------- governance

@query("gov_pseudonymize", "select sha256('pepper' || c_custkey::varchar) as c_custkey, sha256('pepper' || c_name) as c_name, c_mktsegment from customer")
def _(spark, sf):
    return G.pseudonymize(P.table(spark, sf, "customer").select("c_custkey", "c_name", "c_mktsegment"), ["c_custkey", "c_name"], "pepper")


def _masked_sql():
    out = "text"
    for pattern, mask in G.MASKS:
        out = f"regexp_replace({out}, '(?i){pattern}', '{mask}', 'g')"
    return f"select doc_id, {out} as text from documents"


@query("gov_anonymize", _masked_sql())
def _(spark, sf):
    return G.anonymize(spread_rows(P.documents(spark, sf).select("doc_id", "text"), "doc_id"), "text")


def _subjects(spark, sf):
    return P.table(spark, sf, "customer").where("c_custkey % 50 = 7").select("c_custkey")


@query("gov_erase", "select o_orderkey, o_custkey from orders where o_custkey not in (select c_custkey from customer where c_custkey % 50 = 7)")
def _(spark, sf):
    path = scratch_path(spark, "erased")
    G.erase(P.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", _subjects(spark, sf)).write.parquet(path)
    return spark.read.parquet(path)


@query("gov_subject_export", """
    select 'customer' as table_name, c_custkey::varchar as subject, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"}' as record from customer where c_custkey % 50 = 7
    union all select 'orders', o_custkey::varchar, '{"o_orderkey":' || o_orderkey || ',"o_custkey":' || o_custkey || '}' from orders
      where o_custkey in (select c_custkey from customer where c_custkey % 50 = 7)""")
def _(spark, sf):
    tables = {"customer": (P.table(spark, sf, "customer").select("c_custkey", "c_mktsegment"), "c_custkey"),
              "orders": (P.table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey")}
    path = scratch_path(spark, "subject_export")
    G.export_subject(tables, _subjects(spark, sf)).write.json(path)
    return spark.read.schema("table_name string, subject string, record string").json(path)
