"""Queries over cleaning, imputation, encoding and scaling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from veriloom.operators import prep as R
from veriloom.plans import profiles as P
from veriloom.plans.registry import query
from veriloom.session import scratch_path

BASE = ("claim_id", "customer_id", "claim_amount", "claim_date", "claim_type", "customer_age", "policy_duration", "risk_level")


def _r(df, **places):
    return df.withColumns({c: F.round(c, n) for c, n in places.items()})


def _mostly_null(spark, sf):
    return P.table(spark, sf, "orders").selectExpr(
        "o_orderkey", "case when o_orderkey % 10 = 0 then o_totalprice end as rare", "1 as fixed",
        "case when o_orderkey % 2 = 0 then 'x' end as fixed_or_null", "o_orderstatus")


@query("prep_drop_sparse_cols", """
    select o_orderkey, 1 as fixed, case when o_orderkey % 2 = 0 then 'x' end as fixed_or_null, o_orderstatus from orders""")
def _(spark, sf):
    return R.drop_sparse(_mostly_null(spark, sf))


@query("prep_drop_constant_cols", """
    select o_orderkey, case when o_orderkey % 10 = 0 then o_totalprice end as rare, o_orderstatus from orders""")
def _(spark, sf):
    return R.drop_constant(_mostly_null(spark, sf))


@query("prep_dedupe_columns", "select o_orderkey, o_orderstatus from orders")
def _(spark, sf):
    o = P.table(spark, sf, "orders")
    return R.dedupe_columns(o.select("o_orderkey", "o_orderstatus", F.col("o_custkey").alias("o_orderkey")))


@query("prep_drop_duplicates", """
    select customer_id, claim_date, claim_id, claim_amount from @claims c
    qualify row_number() over (partition by customer_id, date_trunc('year', claim_date) order by claim_id) = 1""")
def _(spark, sf):
    df = P.claims(spark, sf, "customer_id", "claim_date", "claim_id", "claim_amount").withColumn("_year", F.year("claim_date"))
    return R.drop_duplicates(df, ["customer_id", "_year"], ["claim_id"]).drop("_year")


def _gappy(spark, sf):
    """Claims with more nulls, planted by key."""
    return P.claims(spark, sf, *BASE, "location").withColumns({
        "claim_type": F.when(F.col("claim_id") % 15 == 1, None).otherwise(F.col("claim_type")),
        "customer_age": F.when(F.col("claim_id") % 11 == 2, None).otherwise(F.col("customer_age")),
        "location": F.when(F.col("claim_id") % 13 == 3, None).otherwise(F.col("location"))})


GAPPY = """(select * replace (case when claim_id % 15 = 1 then null else claim_type end as claim_type,
    case when claim_id % 11 = 2 then null else customer_age end as customer_age,
    case when claim_id % 13 = 3 then null else location end as location) from @claims c1)"""


@query("prep_fill_strategy", f"""
    with g as {GAPPY},
    m as (select location from g where location is not null group by 1 order by count(*) desc, location limit 1)
    select claim_id, coalesce(claim_type, 'UNKNOWN') as claim_type, coalesce(location, (select location from m)) as location,
      coalesce(customer_age, (select quantile_cont(customer_age, 0.5) from g))::double as customer_age,
      coalesce(claim_amount, 0)::double as claim_amount from g""")
def _(spark, sf):
    df = _gappy(spark, sf).select("claim_id", "claim_type", "location", "customer_age", "claim_amount")
    how = {"claim_type": ("constant", "UNKNOWN"), "location": "mode", "customer_age": "median", "claim_amount": ("constant", 0)}
    return R.apply_imputer(df, R.fit_imputer(df, how), list(how))


def _impute_numbers(strategy):
    def run(spark, sf):
        df = _gappy(spark, sf).select("claim_id", "claim_amount", "customer_age")
        how = {"claim_amount": strategy, "customer_age": strategy}
        return _r(R.apply_imputer(df, R.fit_imputer(df, how), list(how)), claim_amount=4, customer_age=4)
    return run


def _impute_sql(amount, age):
    return f"""with g as {GAPPY} select claim_id, round(coalesce(claim_amount, {amount}), 4)::double as claim_amount,
        round(coalesce(customer_age, {age}), 4)::double as customer_age from g"""


query("prep_impute_mean", _impute_sql("(select avg(claim_amount) from g)", "(select avg(customer_age) from g)"))(_impute_numbers("mean"))
query("prep_impute_median", _impute_sql("(select quantile_cont(claim_amount, 0.5) from g)",
                                        "(select quantile_cont(customer_age, 0.5) from g)"))(_impute_numbers("median"))
MODE = "(select {c} from g where {c} is not null group by 1 order by count(*) desc, {c} limit 1)"
query("prep_impute_mode", _impute_sql(MODE.format(c="claim_amount"), MODE.format(c="customer_age")))(_impute_numbers("mode"))


@query("prep_impute_categorical", f"""
    with g as {GAPPY} select claim_id, coalesce(claim_type, {MODE.format(c="claim_type")}) as claim_type,
      coalesce(location, 'missing') as location from g""")
def _(spark, sf):
    df = _gappy(spark, sf).select("claim_id", "claim_type", "location")
    how = {"claim_type": "mode", "location": ("constant", "missing")}
    return R.apply_imputer(df, R.fit_imputer(df, how), list(how))


@query("prep_impute_knn", """
    with c as (select claim_id, claim_amount, customer_age as a, policy_duration as d from @claims c1),
    n as (select q.claim_id, x.claim_amount from c q join c x on x.claim_amount is not null where q.claim_amount is null
      qualify row_number() over (partition by q.claim_id order by (q.a - x.a) * (q.a - x.a) + (q.d - x.d) * (q.d - x.d), x.claim_id) <= 5),
    f as (select claim_id, avg(claim_amount) as f from n group by 1)
    select claim_id, round(coalesce(claim_amount, f), 6) as claim_amount, a as customer_age, d as policy_duration from c left join f using (claim_id)""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "claim_amount", "customer_age", "policy_duration")
    return _r(R.knn_impute(df, "claim_amount", ["customer_age", "policy_duration"], "claim_id"), claim_amount=6)


# rows that lack one or both features; distances count the common ones, times two where it is one of two
GAPS = """(select claim_id, claim_amount, claim_type, case when claim_id % 11 <> 0 then customer_age end as customer_age,
    case when claim_id % 13 <> 0 then policy_duration end as policy_duration from @claims c1)"""
NEAREST = """
    with c as (select claim_id, {t} as t, customer_age as a, policy_duration as d from {gaps} g),
    n as (select q.claim_id, x.t from c q join c x on x.t is not null
      and ((q.a is not null and x.a is not null) or (q.d is not null and x.d is not null)) where q.t is null
      qualify row_number() over (partition by q.claim_id order by (coalesce((q.a - x.a) * (q.a - x.a), 0) + coalesce((q.d - x.d) * (q.d - x.d), 0))
        * case when q.a is null or x.a is null or q.d is null or x.d is null then 2 else 1 end, x.claim_id) <= 5),
    f as ({fill})"""


def _gaps(spark, sf):
    df = P.claims(spark, sf, "claim_id", "claim_amount", "claim_type", "customer_age", "policy_duration")
    return df.withColumns({"customer_age": F.expr("case when claim_id % 11 <> 0 then customer_age end"),
                           "policy_duration": F.expr("case when claim_id % 13 <> 0 then policy_duration end")})


@query("prep_impute_knn_incomplete", NEAREST.format(t="claim_amount", gaps=GAPS, fill="select claim_id, avg(t) as f from n group by 1") + """
    select claim_id, round(coalesce(t, f, (select avg(t) from c)), 6) as claim_amount, a as customer_age, d as policy_duration from c left join f using (claim_id)""")
def _(spark, sf):
    df = _gaps(spark, sf).drop("claim_type")
    return _r(R.knn_impute(df, "claim_amount", ["customer_age", "policy_duration"], "claim_id"), claim_amount=6)


@query("prep_impute_knn_category", NEAREST.format(
    t="case when claim_id % 9 <> 0 then claim_type end", gaps=GAPS,
    fill="select claim_id, t as f from (select claim_id, t, count(*) as n from n group by 1, 2) qualify row_number() over (partition by claim_id order by n desc, t) = 1") + """
    select claim_id, coalesce(t, f, (select t from c where t is not null group by t order by count(*) desc, t limit 1)) as claim_type,
      a as customer_age, d as policy_duration from c left join f using (claim_id)""")
def _(spark, sf):
    df = _gaps(spark, sf).drop("claim_amount").withColumn("claim_type", F.expr("case when claim_id % 9 <> 0 then claim_type end"))
    return R.knn_impute(df, "claim_type", ["customer_age", "policy_duration"], "claim_id").select("claim_id", "claim_type", "customer_age", "policy_duration")


@query("prep_impute_ffill", """
    select event_id, user_id, last_value(case when event_id % 3 = 0 then null else value end ignore nulls)
      over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as value from events""")
def _(spark, sf):
    df = P.events(spark, sf).selectExpr("event_id", "user_id", "ts", "case when event_id % 3 = 0 then null else value end as value")
    return R.forward_fill(df, ["user_id"], ["ts", "event_id"], ["value"]).drop("ts")


@query("prep_standardize_text", """
    select o_orderkey, upper(trim(o_orderpriority)) as claim_type, n_name_title as location
    from orders left join customer on o_custkey = c_custkey
    left join (select n_nationkey, array_to_string(list_transform(string_split(lower(n_name), ' '),
        lambda w: upper(w[1]) || w[2:]), ' ') as n_name_title from nation) n on c_nationkey = n_nationkey""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "claim_type", "location").withColumn("claim_type", F.concat(F.lit(" "), F.lower("claim_type")))
    return R.standardize_text(df, ["claim_type"], ["location"]).withColumnRenamed("claim_id", "o_orderkey")


@query("prep_filter_valid", "select claim_id, claim_amount, customer_age from @faulty f where claim_amount > 0 and customer_age between 18 and 120")
def _(spark, sf):
    return R.filter_valid(P.faulty(spark, sf), "claim_amount", "customer_age").select("claim_id", "claim_amount", "customer_age")


BOUNDS = """b as (select q1 - 1.5 * (q3 - q1) as lo, q3 + 1.5 * (q3 - q1) as hi from (
    select quantile_cont(claim_amount, 0.25) as q1, quantile_cont(claim_amount, 0.75) as q3 from f) q)"""
WIDE = "(select claim_id, case when claim_id % 29 = 5 then claim_amount * 10 else claim_amount end as claim_amount from @claims c1)"


def _wide(spark, sf):
    return P.claims(spark, sf, "claim_id", "claim_amount").withColumn(
        "claim_amount", F.when(F.col("claim_id") % 29 == 5, F.col("claim_amount") * 10).otherwise(F.col("claim_amount")))


@query("prep_outlier_cap", f"""
    with f as {WIDE}, {BOUNDS}
    select claim_id, case when claim_amount is not null then round(least(greatest(claim_amount, lo), hi), 4) end as claim_amount from f, b""")
def _(spark, sf):
    df = _wide(spark, sf)
    return _r(R.cap_outliers(df, ["claim_amount"], R.outlier_bounds(df, ["claim_amount"])), claim_amount=4)


@query("prep_outlier_remove", f"with f as {WIDE}, {BOUNDS} select claim_id, claim_amount from f, b where claim_amount is null or claim_amount between lo and hi")
def _(spark, sf):
    df = _wide(spark, sf)
    return R.remove_outliers(df, ["claim_amount"], R.outlier_bounds(df, ["claim_amount"]))


@query("prep_outlier_transform", "select claim_id, round(sign(claim_amount) * ln(1 + abs(claim_amount)), 6) as claim_amount from @faulty f")
def _(spark, sf):
    return _r(R.log_transform(P.faulty(spark, sf).select("claim_id", "claim_amount"), ["claim_amount"]), claim_amount=6)


@query("prep_date_parts", """
    select claim_id, year(claim_date)::int as claim_date_year, month(claim_date)::int as claim_date_month, day(claim_date)::int as claim_date_day,
      (isodow(claim_date) - 1)::int as claim_date_weekday, isodow(claim_date) >= 6 as claim_date_is_weekend,
      date_diff('day', claim_date::date, date '2001-01-01')::int as claim_date_days_since from @claims c""")
def _(spark, sf):
    return R.date_parts(P.claims(spark, sf, "claim_id", "claim_date"), ["claim_date"], P.AS_OF).drop("claim_date")


@query("prep_log_amount", """
    select claim_id, round(ln(1 + claim_amount), 6) as claim_amount_log,
      claim_amount / greatest(policy_duration, 1) as amount_per_year from @claims c""")
def _(spark, sf):
    df = R.amount_scales(P.claims(spark, sf, "claim_id", "claim_amount", "policy_duration"), "claim_amount", "policy_duration")
    return _r(df.select("claim_id", "claim_amount_log", "amount_per_year"), claim_amount_log=6)


@query("prep_bucketize", """
    select claim_id, case when claim_amount > 0 and claim_amount <= 1000 then 'small' when claim_amount > 1000 and claim_amount <= 5000 then 'medium'
        when claim_amount > 5000 and claim_amount <= 20000 then 'large' when claim_amount > 20000 then 'very_large' end as claim_amount_category,
      case when customer_age > 0 and customer_age <= 25 then 'young' when customer_age > 25 and customer_age <= 35 then 'adult'
        when customer_age > 35 and customer_age <= 50 then 'middle_aged' when customer_age > 50 and customer_age <= 65 then 'senior'
        when customer_age > 65 then 'elderly' end as age_group,
      case when policy_duration > 0 and policy_duration <= 6 then 'new' when policy_duration > 6 and policy_duration <= 12 then 'short_term'
        when policy_duration > 12 and policy_duration <= 24 then 'medium_term' when policy_duration > 24 then 'long_term' end as policy_duration_category
    from @claims c""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "claim_amount", "customer_age", "policy_duration")
    out = R.bucketize(df, BINS)
    return out.select("claim_id", *BINS)


BINS = {"claim_amount_category": ("claim_amount", R.AMOUNT_BINS), "age_group": ("customer_age", R.AGE_BINS),
        "policy_duration_category": ("policy_duration", R.DURATION_BINS)}


@query("prep_onehot", """
    select claim_id, case when claim_status = 'O' then 1.0 else 0.0 end::double as "claim_status_O",
      case when claim_status = 'P' then 1.0 else 0.0 end::double as "claim_status_P" from @claims c""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "claim_status")
    return R.encode_categories(df, "claim_status", "claim_id")


@query("prep_get_dummies", "select claim_id, " + ", ".join(
    f"case when claim_status = '{v}' then 1.0 else 0.0 end::double as \"type_{v}\"" for v in "FOP") + " from @claims c")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "claim_status")
    return R.one_hot(df, "claim_status", R.categories(df, "claim_status"), drop_first=False, prefix="type")


@query("prep_label_encode", """
    with d as (select location as l, row_number() over (order by location) - 1 as code from (select distinct location from @claims c1 where claim_id % 3 = 0) q)
    select claim_id, coalesce(code, 0)::int as location_code from @claims c left join d on location = l""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "location")
    labels = R.fit_labels(df.where("claim_id % 3 = 0"), "location")
    return R.label_encode(df, "location", labels, "claim_id", "location_code").drop("location")


@query("prep_target_encode", """
    with t as (select customer_id, avg(case when risk_level = 'high' then 1.0 else 0.0 end) as m from @claims c1 where claim_id % 4 = 0 group by 1),
    g as (select avg(case when risk_level = 'high' then 1.0 else 0.0 end) as m from @claims c2 where claim_id % 4 = 0)
    select claim_id, round(coalesce(t.m, g.m), 6) as customer_code from @claims c left join t using (customer_id), g""")
def _(spark, sf):
    df = P.claims(spark, sf, "claim_id", "customer_id", "risk_level").withColumn("y", F.when(F.col("risk_level") == "high", 1).otherwise(0))
    fitted = R.fit_targets(df.where("claim_id % 4 = 0"), "customer_id", "y")
    return _r(R.target_encode(df, "customer_id", fitted, "claim_id", "customer_code").select("claim_id", "customer_code"), customer_code=6)


def _scale(method):
    def run(spark, sf):
        df = P.claims(spark, sf, "claim_id", "claim_amount", "customer_age")
        cols = ["claim_amount", "customer_age"]
        return _r(R.apply_scaler(df, R.fit_scaler(df, cols, method), cols), claim_amount=6, customer_age=6)
    return run


def _scale_sql(center, scale):
    def one(c):
        return f"round(({c} - (select {center.format(c=c)} from f)) / (select {scale.format(c=c)} from f), 6)::double as {c}"
    return f"with f as (select * from @claims c0) select claim_id, {one('claim_amount')}, {one('customer_age')} from f"


query("prep_scale_standard", _scale_sql("avg({c})", "stddev_pop({c})"))(_scale("standard"))
query("prep_scale_minmax", _scale_sql("min({c})", "(max({c}) - min({c}))::double"))(_scale("minmax"))
query("prep_scale_robust", _scale_sql("quantile_cont({c}, 0.5)", "(quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25))"))(_scale("robust"))


# The pairs that interact.
PAIRS = [("claim_amount", "customer_age"), ("claim_amount", "policy_duration"), ("customer_age", "policy_duration")]


@query("prep_interact_select", f"""
    with c as (select (risk_level = 'high')::int as y, coalesce(claim_amount, (select median(claim_amount) from @claims m))::double as claim_amount, customer_age::double as customer_age, policy_duration::double as policy_duration from @claims c),
    w as (select *, {", ".join(f"{a} * {b} as {a}_x_{b}" for a, b in PAIRS)} from c),
    l as (unpivot w on columns(* exclude (y)) into name feature value v),
    g as (select feature, y, count(*) as n, avg(v) as m, var_pop(v) as s from l group by 1, 2),
    f as (select feature, (sum(n * (m - gm) * (m - gm)) / (count(*) - 1)) / (sum(n * s) / (sum(n) - count(*))) as score
      from (select *, sum(n * m) over (partition by feature) / sum(n) over (partition by feature) as gm from g) q group by 1)
    select feature, round(score, 3) as importance, row_number() over (order by score desc, feature) <= 3 as selected,
      (select count(*) from orders) as rows_out, 5 as columns_out from f""")
def _(spark, sf):
    """Three of six features, products of two among them; what the fitted preprocessor gives has just these."""
    df = P.claims(spark, sf, "claim_id", "claim_amount", "customer_age", "policy_duration", "risk_level")
    df = df.withColumn("y", F.when(F.col("risk_level") == "high", 1).otherwise(0)).drop("risk_level")
    fitted = R.Preprocessor("claim_id", P.AS_OF, label="y", interactions=PAIRS, select=3).fit(df)
    out = fitted.transform(df)
    return fitted.importance().select("feature", F.round("importance", 3).alias("importance"), "selected", out.agg(F.count("*")).scalar().alias("rows_out"),
                                      F.lit(len(out.columns)).alias("columns_out"))


PREPARED = ["claim_amount", "customer_age", "policy_duration", "claim_date_year", "claim_date_days_since"]


def _prepared_sql() -> str:
    """Imputed, capped and scaled numbers, label codes and some 0/1 columns, step by step."""
    capped = PREPARED[:3]
    median = ", ".join(f"coalesce({c}, (select quantile_cont({c}, 0.5) from g))::double as {c}" for c in capped)
    mode = ", ".join(f"coalesce({c}, {MODE.format(c=c)}) as {c}" for c in ("claim_type", "location"))
    ends = ", ".join(f"quantile_cont({c}, 0.25) as q1_{c}, quantile_cont({c}, 0.75) as q3_{c}" for c in capped)
    cap = ", ".join(f"greatest(least({c}, q3_{c} + 1.5 * (q3_{c} - q1_{c})), q1_{c} - 1.5 * (q3_{c} - q1_{c})) as {c}" for c in capped)
    moments = ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in PREPARED)
    scaled = ", ".join(f"round(({c} - m_{c}) / s_{c}, 4) as {c}" for c in PREPARED)
    return f"""with g as {GAPPY},
        i as (select claim_id, (risk_level = 'high')::int as y, {median}, {mode}, year(claim_date)::double as claim_date_year,
            date_diff('day', claim_date::date, date '{P.AS_OF}')::double as claim_date_days_since from g),
        e as (select {ends} from i), c as (select i.* replace ({cap}) from i, e), m as (select {moments} from c),
        l as (select location, (row_number() over (order by location) - 1)::int as code from (select distinct location from i) q)
        select c.claim_id, y, {scaled}, code as location, (claim_type = '2-HIGH')::int::double as type_high,
          (i0.age > 0 and i0.age <= 25)::int::double as young, true as finite_ok
        from c join (select claim_id, customer_age as age from i) i0 using (claim_id) join l on l.location = c.location, m"""


@query("prep_preprocessor", _prepared_sql())
def _(spark, sf):
    df = _gappy(spark, sf).withColumn("y", F.when(F.col("risk_level") == "high", 1).otherwise(0)).drop("risk_level", "customer_id")
    fitted = R.Preprocessor("claim_id", P.AS_OF, dates=["claim_date"], label="y", bins=BINS, outliers="cap").fit(df)
    path = scratch_path(spark, "preprocessor")
    fitted.save(spark, path)
    out = R.FittedPreprocessor.load(spark, path).transform(df)
    values = [c for c, t in out.dtypes if t == "double"]
    finite = [F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in values]
    return out.select("claim_id", "y", *[F.round(c, 4).alias(c) for c in PREPARED], "location", F.col("`claim_type_2-HIGH`").alias("type_high"),
                      F.col("age_group_young").alias("young"), reduce(lambda a, b: a & b, finite).alias("finite_ok"))
