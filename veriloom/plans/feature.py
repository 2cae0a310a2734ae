"""Queries over feature engineering."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import functions as F

from veriloom.functions import lexicon as L
from veriloom.operators import features as E
from veriloom.operators import modelling as M
from veriloom.operators import text as X
from veriloom.operators.stages import FeatureStage
from veriloom.plans import profiles as P
from veriloom.plans.registry import query
from veriloom.session import materialize, scratch_path, spread_rows

NUMBERS = ("claim_id", "claim_amount", "customer_age", "policy_duration")


def _r(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _sum(words, text="t"):
    return "(" + " + ".join(f"contains({text}, '{w}')::int" for w in words) + ")"


# Claims with the features of the document of the same number.
FULL = f"""(select claim_id, claim_amount, customer_age, policy_duration, length(text) as text_length,
    len(regexp_extract_all(text, '[^{L.SPACE}]+')) as word_count, p / greatest(p + n, 1) as sentiment_positive, n / greatest(p + n, 1) as sentiment_negative,
    (p - n) / greatest(p + n, 1) as sentiment_compound, damage_types_mentions from (select *, {_sum(L.POSITIVE)} as p, {_sum(L.NEGATIVE)} as n,
      {_sum(L.KEYWORDS["damage_types"])} as damage_types_mentions from (select *, lower(text) as t from @claims c1 join documents on claim_id = doc_id) d0) d)"""


def _full(spark, sf):
    docs = spread_rows(P.documents(spark, sf).select(F.col("doc_id").alias("claim_id"), "text"), "claim_id")
    return E.combine(P.claims(spark, sf, *NUMBERS), X.features(docs, "text").drop("text"), "claim_id")


@query("fe_ratio", f"""
    select claim_id, claim_amount / customer_age as claim_amount_to_customer_age_ratio,
      claim_amount / (case when d = 0 then 1e-6 else d end) as claim_amount_to_policy_duration_ratio,
      customer_age / (case when d = 0 then 1e-6 else d end)::double as customer_age_to_policy_duration_ratio,
      text_length / (case when word_count = 0 then 1e-6 else word_count end)::double as text_length_to_word_count_ratio,
      round(sentiment_positive / (case when sentiment_negative = 0 then 1e-6 else sentiment_negative end)::double, 6) as sentiment_positive_to_sentiment_negative_ratio
    from (select *, policy_duration - 1 as d from {FULL} c1) c""")
def _(spark, sf):
    df = E.ratios(_full(spark, sf).withColumn("policy_duration", F.col("policy_duration") - 1))
    names = [f"{a}_to_{b}_ratio" for a, b in E.RATIOS]
    return _r(df.select("claim_id", *names), sentiment_positive_to_sentiment_negative_ratio=6)


@query("fe_interaction", f"""
    select claim_id, claim_amount * customer_age as claim_amount_x_customer_age, claim_amount * policy_duration as claim_amount_x_policy_duration,
      customer_age * policy_duration as customer_age_x_policy_duration, round(sentiment_compound * text_length, 6) as sentiment_compound_x_text_length,
      customer_age + policy_duration as customer_age_plus_policy_duration
    from {FULL} c""")
def _(spark, sf):
    df = E.interactions(_full(spark, sf), add=[("customer_age", "policy_duration")])
    names = [f"{a}_x_{b}" for a, b in E.PRODUCTS] + ["customer_age_plus_policy_duration"]
    return _r(df.select("claim_id", *names), sentiment_compound_x_text_length=6)


@query("fe_polynomial", """
    select claim_id, claim_amount * claim_amount as "poly_claim_amount^2", claim_amount * customer_age as "poly_claim_amount customer_age",
      claim_amount * policy_duration as "poly_claim_amount policy_duration", customer_age::double * customer_age as "poly_customer_age^2",
      customer_age::double * policy_duration as "poly_customer_age policy_duration",
      policy_duration::double * policy_duration as "poly_policy_duration^2" from @claims c""")
def _(spark, sf):
    return E.polynomial(P.claims(spark, sf, *NUMBERS), NUMBERS[1:], squares=True).drop(*NUMBERS[1:])


@query("fe_binning", """
    select claim_id, case when x > 0 and x <= 500 then 'very_low' when x > 500 and x <= 2000 then 'low' when x > 2000 and x <= 10000 then 'medium'
        when x > 10000 and x <= 50000 then 'high' when x > 50000 then 'very_high' end as claim_amount_bin,
      case when a > 0 and a <= 25 then 'young' when a > 25 and a <= 35 then 'adult' when a > 35 and a <= 50 then 'middle'
        when a > 50 and a <= 65 then 'senior' when a > 65 and a <= 100 then 'elderly' end as age_bin,
      case when d > 0 and d <= 6 then 'new' when d > 6 and d <= 12 then 'short' when d > 12 and d <= 24 then 'medium'
        when d > 24 and d <= 60 then 'long' when d > 60 then 'very_long' end as policy_duration_bin
    from (select claim_id, claim_amount as x, customer_age as a, policy_duration as d from @claims c1) c""")
def _(spark, sf):
    return E.binning(P.claims(spark, sf, *NUMBERS)).drop(*NUMBERS[1:])


@query("fe_composite_risk", f"""
    with f as (select * from {FULL} f0), s as (select min(claim_amount) as lo, max(claim_amount) as hi from f)
    select claim_id, round(((claim_amount - lo) / (hi - lo) + abs(customer_age - 45) / 45.0 + 1.0 / (1 + policy_duration / 12.0::double)
      + sentiment_negative) / 4, 6) as composite_risk_score from f, s""")
def _(spark, sf):
    out = E.composite_risk(_full(spark, sf), "claim_amount", "customer_age", "policy_duration", "sentiment_negative")
    return _r(out.select("claim_id", "composite_risk_score"), composite_risk_score=6)


WITH_TEXT = """(select claim_id, claim_amount, length(text) as text_length, lower(text) as t from @claims c1 join documents on claim_id = doc_id)"""
FRAUD = L.KEYWORDS["fraud_indicators"]


def _described(spark, sf):
    """Claims with the document of the same number as description."""
    docs = spread_rows(P.documents(spark, sf).select(F.col("doc_id").alias("claim_id"), "text"), "claim_id")
    texts = X.features(docs, "text").drop("text")
    return E.combine(P.claims(spark, sf, "claim_id", "claim_amount", "claim_date"), texts, "claim_id")


@query("fe_fraud_score", f"""
    with f as (select * from {FULL} f0), q as (select quantile_cont(claim_amount, 0.95) as p95 from f)
    select claim_id, round(((coalesce(claim_amount > p95, false)::int + (sentiment_negative > 0.5)::int + (damage_types_mentions > 2)::int) / 3.0)::double, 6)
      as fraud_risk_score from f, q""")
def _(spark, sf):
    out = E.fraud_score(_full(spark, sf), "claim_amount", "sentiment_negative", "damage_types_mentions")
    return _r(out.select("claim_id", "fraud_risk_score"), fraud_risk_score=6)


@query("fe_fraud_flags", f"""
    with c as (select d.claim_id, d.claim_amount, d.text_length, claim_date, {" + ".join(f"contains(t, '{w}')::int" for w in FRAUD)} as k
               from {WITH_TEXT} d join @claims c2 using (claim_id)),
    q as (select quantile_cont(claim_amount, 0.8) as p80 from c)
    select claim_id, coalesce(claim_amount % 100 = 0, false)::int as round_number_claim, coalesce(claim_amount % 1000 = 0, false)::int as very_round_claim,
      (isodow(claim_date) >= 6)::int as weekend_claim, (hour(claim_date) >= 22)::int as late_night_claim, (k > 0)::int as fraud_keywords_present,
      coalesce(text_length < 50 and claim_amount > p80, false)::int as short_desc_high_claim from c, q""")
def _(spark, sf):
    df = E.fraud_flags(_described(spark, sf), "claim_amount", "claim_date", "fraud_indicators_mentions", "text_length")
    return df.select("claim_id", "round_number_claim", "very_round_claim", "weekend_claim", "late_night_claim",
                     "fraud_keywords_present", "short_desc_high_claim")


@query("fe_severity_flags", f"""
    select doc_id, ({_sum(L.KEYWORDS["medical_terms"], "lower(text)")} >= 2)::int as high_medical_severity,
      ({_sum(L.KEYWORDS["severity_indicators"], "lower(text)")} >= 1)::int as high_damage_severity,
      (len(regexp_extract_all(text, '@')) >= 3)::int as multi_party_claim from documents""")
def _(spark, sf):
    """The mail addresses of a text stand for the persons in it."""
    df = X.features(spread_rows(P.documents(spark, sf).select("doc_id", "text"), "doc_id"), "text")
    df = df.withColumn("person_mentions", F.regexp_count("text", F.lit("@")))
    return E.severity_flags(df).select("doc_id", "high_medical_severity", "high_damage_severity", "multi_party_claim")


@query("fe_rolling_mean", """
    select claim_id, round(avg(claim_amount) over (order by claim_date, claim_id rows between 29 preceding and current row), 6) as claim_amount_rolling_mean,
    from @claims c""")
def _(spark, sf):
    df = E.rolling_mean(P.claims(spark, sf, "claim_id", "claim_amount", "claim_date"), "claim_amount", ["claim_date", "claim_id"])
    return _r(df.select("claim_id", "claim_amount_rolling_mean"), claim_amount_rolling_mean=6)


@query("fe_recent_count", """
    select claim_id, count(*) over (partition by customer_id order by claim_date
      range between interval '29 days 23 hours 59 minutes 59.999999 seconds' preceding and current row) as recent_claims_count from @claims c""")
def _(spark, sf):
    df = E.recent_count(P.claims(spark, sf, "claim_id", "customer_id", "claim_date"), "customer_id", "claim_date", "claim_id")
    return df.select("claim_id", "recent_claims_count")


@query("fe_percentile_rank", """
    with c as (select claim_id, customer_age, rank() over (order by customer_age) as r, count(*) over (partition by customer_age) as k, count(*) over () as n from @claims c1)
    select claim_id, round((r + (k - 1) / 2.0) / n, 6)::double as customer_age_percentile from c""")
def _(spark, sf):
    df = E.percentile_rank(P.claims(spark, sf, "claim_id", "customer_age"), "customer_age", "claim_id")
    return _r(df.drop("customer_age"), customer_age_percentile=6)


@query("fe_quantile_outlier", """
    with q as (select quantile_cont(claim_amount, 0.05) as a, quantile_cont(claim_amount, 0.95) as b,
      quantile_cont(customer_age, 0.05) as c, quantile_cont(customer_age, 0.95) as d from @claims c1)
    select claim_id, coalesce(claim_amount < a or claim_amount > b, false)::int as claim_amount_is_outlier,
      (customer_age < c or customer_age > d)::int as customer_age_is_outlier from @claims c2, q""")
def _(spark, sf):
    df = E.quantile_outlier(P.claims(spark, sf, "claim_id", "claim_amount", "customer_age"), ["claim_amount", "customer_age"])
    return df.drop("claim_amount", "customer_age")


@query("fe_clean_infinite", """
    select claim_id, case when claim_amount is null or claim_id % 7 = 0 then 0 else claim_amount end::double as claim_amount from @claims c""")
def _(spark, sf):
    x = F.when(F.col("claim_id") % 14 == 0, F.lit(float("-inf"))).when(F.col("claim_id") % 7 == 0, F.lit(float("nan"))).otherwise(F.col("claim_amount"))
    return E.clean_infinite(P.claims(spark, sf, "claim_id", "claim_amount").withColumn("claim_amount", x), ["claim_amount"])


@query("fe_claim_frequency", """
    with p as (select claim_id, policy_duration, row_number() over (partition by customer_id order by claim_date, claim_id) - 1 as previous_claims from @claims c1)
    select claim_id, previous_claims, previous_claims / greatest(policy_duration, 1) * 12 as claims_per_year,
      (previous_claims / greatest(policy_duration, 1) * 12 > 2)::int as is_frequent_claimant from p""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "customer_id", "claim_date", "policy_duration")
    df = E.previous_count(df, "customer_id", ["claim_date", "claim_id"])
    return E.claim_frequency(df, "previous_claims", "policy_duration").drop("customer_id", "claim_date", "policy_duration")


@query("fe_coverage_ratio", """
    with j as (select o_orderkey, o_totalprice, c_acctbal from orders left join customer on o_custkey = c_custkey), q as (select quantile_cont(o_totalprice, 0.9) as p90 from j)
    select o_orderkey, case when c_acctbal <> 0 then o_totalprice / c_acctbal end as claim_to_coverage_ratio, (o_totalprice > p90)::int as high_value_claim from j, q""")
def _(spark, sf):
    o = P.table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    c = P.table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_acctbal")
    p90 = E.quantile_of(o, "o_totalprice", 0.9)
    df = E.coverage_ratio(o.join(c, "o_custkey", "left"), "o_totalprice", "c_acctbal", p90)
    return df.select("o_orderkey", "claim_to_coverage_ratio", "high_value_claim")


@query("fe_policy_age", """
    select l_orderkey, l_linenumber, l_partkey, l_suppkey, date_diff('day', o_orderdate::date, l_shipdate::date)::int as days_since_policy_start,
      coalesce(date_diff('day', o_orderdate::date, l_shipdate::date) < 30, false)::int as early_claim_indicator,
      coalesce(case when l_partkey % 3 = 0 then l_linenumber end, 0) as policy_lapse_history
    from lineitem left join orders on l_orderkey = o_orderkey""")
def _(spark, sf):
    li = P.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate",
                                               F.expr("case when l_partkey % 3 = 0 then l_linenumber end").alias("lapsed"))
    o = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate")
    return E.policy_age(li.join(o, "l_orderkey", "left"), "l_shipdate", "o_orderdate", "lapsed").drop("l_shipdate", "o_orderdate", "lapsed")


@query("fe_customer_agg", """
    with k as (select customer_id, claim_type, count(*) as n from @claims c1 group by 1, 2),
    m as (select customer_id, '{' || string_agg('"' || claim_type || '":' || n, ',' order by claim_type) || '}' as counts from k group by 1),
    a as (select customer_id, round(sum(claim_amount), 2) as s, round(avg(claim_amount), 6) as m, round(stddev_samp(claim_amount), 4) as sd, count(claim_amount) as n,
            min(claim_date) as lo, max(claim_date) as hi from @claims c2 group by 1)
    select claim_id, s as claim_amount_sum, m as claim_amount_mean, sd as claim_amount_std, n as claim_amount_count, lo as claim_date_min, hi as claim_date_max,
      counts as claim_type_counts from @claims c left join a using (customer_id) left join (select customer_id, counts from m) m2 using (customer_id)""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "customer_id", "claim_amount", "claim_date", "claim_type")
    out = E.add_customer_aggregates(df, "customer_id", "claim_amount", "claim_date", "claim_type", "claim_id")
    out = out.withColumn("claim_type_counts", F.to_json("claim_type_counts"))
    return _r(out.drop("customer_id", "claim_amount", "claim_date", "claim_type"), claim_amount_sum=2, claim_amount_mean=6, claim_amount_std=4)


@query("fe_location_agg", """
    with a as (select location, round(avg(claim_amount), 4) as m, round(avg(case when risk_level = 'high' then 1.0 else 0.0 end), 6) as r from @claims c1 group by 1)
    select claim_id, m as location_avg_amount, r as location_risk_rate from @claims c left join a using (location)""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "location", "claim_amount", "risk_level")
    out = E.add_location_aggregates(df, "location", "claim_amount", "risk_level", "claim_id")
    return _r(out.select("claim_id", "location_avg_amount", "location_risk_rate"), location_avg_amount=4, location_risk_rate=6)


@query("fe_lag", """
    select claim_id, lag(claim_amount, 1) over w as claim_amount_lag1, lag(claim_amount, 2) over w as claim_amount_lag2
    from @claims c window w as (partition by customer_id order by claim_date, claim_id)""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "customer_id", "claim_amount", "claim_date")
    out = E.lag_features(df, "customer_id", ["claim_date", "claim_id"], "claim_amount", [1, 2])
    return out.select("claim_id", "claim_amount_lag1", "claim_amount_lag2")


@query("fe_seasonal_trend", """
    select date_trunc('month', claim_date)::date as month, count(*) as claims, round(sum(claim_amount), 2) as total, round(avg(claim_amount), 4) as mean,
      case when month(claim_date) in (12, 1, 2) then 'winter' when month(claim_date) in (3, 4, 5) then 'spring'
        when month(claim_date) in (6, 7, 8) then 'summer' else 'autumn' end as season from @claims c group by 1, 5""")
def _(spark, sf):
    return _r(E.seasonal_trend(P.claims(spark, sf, "claim_date", "claim_amount"), "claim_date", "claim_amount"), total=2, mean=4)


@query("fe_combine", """
    select claim_id, claim_amount, length(text) as text_length from @claims c join documents on claim_id = doc_id""")
def _(spark, sf):
    return _described(spark, sf).select("claim_id", "claim_amount", "text_length")


FEATURES = ["claim_amount", "customer_age", "policy_duration", "amount_half", "age_duration"]
F_VIEW = """(select claim_id, risk_level, coalesce(claim_amount, 0) as claim_amount, customer_age::double as customer_age, policy_duration::double as policy_duration,
    coalesce(claim_amount, 0) * 0.5 + policy_duration * 100 as amount_half, (customer_age * policy_duration)::double as age_duration from @claims c9)"""


def _features(spark, sf):
    amount = F.coalesce("claim_amount", F.lit(0.0))
    return P.claims(spark, sf, "claim_id", "risk_level", "claim_amount", "customer_age", "policy_duration").withColumns({
        "claim_amount": amount, "amount_half": amount * 0.5 + F.col("policy_duration") * 100,
        "age_duration": (F.col("customer_age") * F.col("policy_duration")).cast("double")})


F_LONG = "(unpivot (select risk_level, " + ", ".join(f"{f}::double as {f}" for f in FEATURES) + f" from {F_VIEW} fv) on {', '.join(FEATURES)} into name feature value value)"
F_SCORES = f"""f as (select feature, (sum(n * (m - g) * (m - g)) / (count(*) - 1)) / (sum(n * v) / (sum(n) - count(*))) as score from (
      select feature, risk_level, count(value) as n, avg(value) as m, var_pop(value) as v from l group by 1, 2) c
      join (select feature, avg(value) as g from l group by 1) gg using (feature) group by feature)"""
MI_SCORES = f"""q as (select feature, quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) as e from l group by 1),
    c as (select feature, risk_level, len(list_filter(e, lambda x: value > x)) as bin, count(*)::double as n from l join q using (feature) group by 1, 2, 3),
    m as (select feature, sum(n / t * ln(n * t / (x * y))) as score from (
      select *, sum(n) over (partition by feature) as t, sum(n) over (partition by feature, bin) as x, sum(n) over (partition by feature, risk_level) as y from c) j group by feature)"""


@query("fe_fitted_stage", """
    with c as (select claim_id, claim_amount as a, customer_age as g, policy_duration as d from @claims c1),
    s as (select min(a) as lo, max(a) as hi, avg(a) as mean, quantile_cont(a, 0.8) as p80, quantile_cont(a, 0.95) as p95 from c where claim_id % 2 = 0)
    select claim_id, a / g as ratio, a * g as product, round(((a - lo) / (hi - lo) + abs(g - 45) / 45.0::double + 1.0::double / (1 + d / 12.0::double)) / 3, 9) as composite_risk_score,
      coalesce((a > p95)::int, 0)::double as fraud_risk_score, coalesce((a > p80)::int, 0) as high_amount, round(a - mean, 4) as above_usual
    from c, s where claim_id % 2 = 1""")
def _(spark, sf):
    """Fitted on the even claims as part of a pipeline, saved, loaded, and used on the odd ones."""
    claims = P.claims(spark, sf, "claim_id", "claim_amount", "customer_age", "policy_duration")
    stage = FeatureStage(amount="claim_amount", age="customer_age", duration="policy_duration")
    path = scratch_path(spark, "feature_stage")
    Pipeline(stages=[stage]).fit(claims.where("claim_id % 2 = 0")).write().save(path)
    out = PipelineModel.load(path).transform(claims.where("claim_id % 2 = 1"))
    return out.select("claim_id", F.col("claim_amount_to_customer_age_ratio").alias("ratio"), F.col("claim_amount_x_customer_age").alias("product"),
                      F.round("composite_risk_score", 9).alias("composite_risk_score"), "fraud_risk_score", "high_amount", F.round("above_usual", 4).alias("above_usual"))


@query("fe_select_f", f"with l as {F_LONG}, {F_SCORES} select feature, round(score, 3) as score from f order by score desc, feature limit 3")
def _(spark, sf):
    return _r(E.top_features(E.anova_f(_features(spark, sf), FEATURES, "risk_level"), 3), score=3)


@query("fe_select_mi", f"with l as {F_LONG}, {MI_SCORES} select feature, round(score, 6) as score from m order by score desc, feature limit 3")
def _(spark, sf):
    return _r(E.top_features(E.mutual_information(_features(spark, sf), FEATURES, "risk_level"), 3), score=6)


@query("fe_select_intersect", f"""with l as {F_LONG}, {F_SCORES}, {MI_SCORES}
    (select feature from f order by score desc, feature limit 4) intersect (select feature from m order by score desc, feature limit 4)""")
def _(spark, sf):
    df = _features(spark, sf)
    tables = [E.anova_f(df, FEATURES, "risk_level"), E.mutual_information(df, FEATURES, "risk_level")]
    return E.select_intersect(tables, len(FEATURES))


@query("fe_select_rfe", "select f as feature, f in ('claim_amount', 'amount_half') as kept, 4 as ranks from (values ('claim_amount'), ('amount_half'), ('customer_age'), ('policy_duration'), ('age_duration')) v(f)")
def _(spark, sf):
    df = _features(spark, sf).withColumn("label", F.when(F.col("risk_level") == "high", 1.0).otherwise(0.0))
    # the label is a limit on the amount, so the two columns that tell the amount stay to the end
    out = M.recursive_elimination(df, FEATURES, "label", keep=2)
    return out.select("feature", (F.col("rank") == 1).alias("kept"), out.agg(F.count_distinct("rank").cast("int")).scalar().alias("ranks"))


@query("fe_drop_correlated", f"""
    with p as (select 'amount_half' as feature, abs(corr(claim_amount, amount_half)) as c from {F_VIEW} f1
      union all select 'customer_age', abs(corr(claim_amount, customer_age)) from {F_VIEW} f2
      union all select 'policy_duration', abs(corr(claim_amount, policy_duration)) from {F_VIEW} f3
      union all select 'age_duration', abs(corr(claim_amount, age_duration)) from {F_VIEW} f4)
    select feature, round(max(c), 6) as max_corr from p where c > 0.95 group by feature""")
def _(spark, sf):
    return _r(E.correlated_features(_features(spark, sf), FEATURES), max_corr=6)


@query("fe_low_variance", f"""
    select feature, round(v, 6) as variance, v <= 0.01 as "drop" from (
      select 'l_tax' as feature, var_samp(l_tax) as v from lineitem union all select 'l_discount', var_samp(l_discount) from lineitem
      union all select 'l_quantity', var_samp(l_quantity) from lineitem) q""")
def _(spark, sf):
    return _r(E.low_variance(P.table(spark, sf, "lineitem"), ["l_tax", "l_discount", "l_quantity"]), variance=6)


@query("fe_pca", "select o_orderkey as claim_id, true as components_ok, true as uncorrelated, true as share_ok from orders")
def _(spark, sf):
    df = E.polynomial(_features(spark, sf), FEATURES, squares=True).drop("risk_level")
    cols = [c for c in df.columns if c != "claim_id"]
    out = materialize(E.principal_components(df, cols))
    parts = [c for c in out.columns if c.startswith("pca_")]
    pairs = [F.abs(F.corr(a, b)) for i, a in enumerate(parts) for b in parts[:i]]
    kept, given = (reduce(lambda a, b: a + b, [F.var_samp(c) for c in names]) for names in (parts, cols))
    checks = out.agg(F.coalesce(F.greatest(*pairs, F.lit(0.0), F.lit(0.0)) < 1e-6, F.lit(True)).alias("u"), (kept >= 0.95 * given).alias("s"))
    ok = reduce(lambda a, b: a & b, [F.col(c).isNotNull() & ~F.isnan(c) for c in parts])
    return out.select("claim_id", ok.alias("components_ok"), checks.select("u").scalar().alias("uncorrelated"), checks.select("s").scalar().alias("share_ok"))


@query("fe_importance", f"""with l as {F_LONG}, {F_SCORES}, {MI_SCORES}
    select feature, 'f_classif' as method, round(score, 3) as importance from f
    union all select feature, 'mutual_info', round(score, 6) from m""")
def _(spark, sf):
    df = _features(spark, sf)
    f = _r(E.anova_f(df, FEATURES, "risk_level"), score=3)
    mi = _r(E.mutual_information(df, FEATURES, "risk_level"), score=6)
    return E.importance({"f_classif": f, "mutual_info": mi}).orderBy(F.desc("importance"), "feature")
