"""Queries over schema validation and data quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.operators import quality as Q
from veriloom.operators import schema as S
from veriloom.operators.schema import FieldRule
from veriloom.plans import profiles as P
from veriloom.plans.registry import query

FAULTY_SCHEMA = (
    FieldRule("claim_id", "integer", min_value=0),
    FieldRule("claim_amount", "float", min_value=0, max_value=400000),
    FieldRule("customer_age", "integer", min_value=18, max_value=120),
    FieldRule("claim_type", "categorical", allowed_values=("1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"), pattern="[1-4]-"),
    FieldRule("rank_text", "integer"),
    FieldRule("filed_date", "date"),
    FieldRule("region", "categorical"),
    FieldRule("notes", required=False),
)


@query("val_required_columns", """
    select field, status, (select count(*) from orders) as total_records from (values ('claim_id', 'present'), ('claim_amount', 'present'),
      ('customer_age', 'present'), ('claim_type', 'present'), ('rank_text', 'present'), ('filed_date', 'present'), ('region', 'missing'),
      ('notes', 'absent_optional'), ('customer_id', 'unexpected'), ('zero_count', 'unexpected')) v(field, status)""")
def _(spark, sf):
    return S.column_presence(P.faulty(spark, sf), FAULTY_SCHEMA)


@query("val_unexpected_columns", """
    select f as field, 'unexpected' as status, (select count(*) from orders) as total_records
    from (values ('customer_id'), ('zero_count')) v(f)""")
def _(spark, sf):
    return S.column_presence(P.faulty(spark, sf), FAULTY_SCHEMA).where("status = 'unexpected'")


def _count(cond: str, field: str, rule: str) -> str:
    return (f"select '{field}' as field, '{rule}' as rule, count(*) filter (where {cond}) as n_bad,"
            " count(*) as n_rows from @faulty f")


@query("val_null_violation", " union all ".join(
    _count(f"{c} is null", c, "null") for c in ("claim_id", "claim_amount", "customer_age", "claim_type", "rank_text", "filed_date")))
def _(spark, sf):
    return S.rule_counts(P.faulty(spark, sf), FAULTY_SCHEMA, ["null"])


@query("val_type_check", _count(r"not regexp_matches(rank_text, '^\s*[-+]?\d+\s*$')", "rank_text", "type"))
def _(spark, sf):
    return S.rule_counts(P.faulty(spark, sf), FAULTY_SCHEMA, ["type"])


@query("val_date_parse", _count("filed_date is not null and try_cast(filed_date as timestamp) is null", "filed_date", "date"))
def _(spark, sf):
    return S.rule_counts(P.faulty(spark, sf), FAULTY_SCHEMA, ["date"])


RANGE_SQL = " union all ".join([
    _count("claim_id < 0", "claim_id", "min"), _count("claim_amount < 0", "claim_amount", "min"),
    _count("claim_amount > 400000", "claim_amount", "max"), _count("customer_age < 18", "customer_age", "min"),
    _count("customer_age > 120", "customer_age", "max")])


@query("val_range", RANGE_SQL)
def _(spark, sf):
    return S.rule_counts(P.faulty(spark, sf), FAULTY_SCHEMA, ["min", "max"])


@query("val_allowed_values", """
    select claim_type, count(*) as n from @faulty f
    where claim_type not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW') group by 1""")
def _(spark, sf):
    return S.disallowed_values(P.faulty(spark, sf), "claim_type", FAULTY_SCHEMA[3].allowed_values)


@query("val_pattern", _count("not regexp_matches(claim_type, '^(?:[1-4]-)')", "claim_type", "pattern"))
def _(spark, sf):
    return S.rule_counts(P.faulty(spark, sf), FAULTY_SCHEMA, ["pattern"])


@query("val_report", r"""
    with c as (select count(*) as n,
        count(*) filter (where claim_amount is null) as a0, count(*) filter (where claim_amount < 0) as a1,
        count(*) filter (where claim_amount > 400000) as a2, count(*) filter (where customer_age > 120) as g,
        count(*) filter (where claim_type not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '5-LOW')) as t1,
        count(*) filter (where not regexp_matches(claim_type, '^(?:[1-4]-)')) as t2,
        count(*) filter (where not regexp_matches(rank_text, '^\s*[-+]?\d+\s*$')) as r,
        count(*) filter (where try_cast(filed_date as timestamp) is null) as d from @faulty f)
    select 'claim_id' as field, true as is_valid, '' as errors, '' as warning, 0 as n_bad, n as total_records from c
    union all select 'claim_amount', a0 + a1 + a2 = 0, array_to_string(list_filter(
        [case when a2 > 0 then 'max' end, case when a1 > 0 then 'min' end, case when a0 > 0 then 'null' end],
        lambda x: x is not null), ','), '', a0 + a1 + a2, n from c
    union all select 'customer_age', g = 0, case when g > 0 then 'max' else '' end, '', g, n from c
    union all select 'claim_type', t1 + t2 = 0, array_to_string(list_filter(
        [case when t1 > 0 then 'allowed' end, case when t2 > 0 then 'pattern' end], lambda x: x is not null), ','), '', t1 + t2, n from c
    union all select 'rank_text', r = 0, case when r > 0 then 'type' else '' end, '', r, n from c
    union all select 'filed_date', d = 0, case when d > 0 then 'date' else '' end, '', d, n from c
    union all select 'region', false, 'missing', '', 0, n from c
    union all select 'notes', true, '', '', 0, n from c
    union all select 'customer_id', true, '', 'unexpected', 0, n from c
    union all select 'zero_count', true, '', 'unexpected', 0, n from c""")
def _(spark, sf):
    return S.validation_report(P.faulty(spark, sf), FAULTY_SCHEMA)


@query("val_json", """
    with j as (select case when event_id % 25 = 0 then '{bad' when event_id % 10 = 1 then '{"k": null}' else props end as t from events),
    k as (select t, case when json_valid(t) then cast(json_extract(t, '$.k') as bigint) end as k from j)
    select 'k' as field, 'null' as rule, count(*) filter (where k is null) as n_bad, count(*) as n_rows from k
    union all select 'k', 'max', count(*) filter (where k > 50), count(*) from k
    union all select '_corrupt', 'null', count(*) filter (where not json_valid(t)), count(*) from k""")
def _(spark, sf):
    fields = (FieldRule("k", "integer", max_value=50),)
    text = F.expr("""case when event_id % 25 = 0 then '{bad' when event_id % 10 = 1 then '{"k": null}' else props end""")
    parsed = S.parse_json(P.events(spark, sf).select(text.alias("t")), "t", fields)
    rules = S.rule_violations(parsed, fields) + [("_corrupt", "null", F.col("_corrupt").isNotNull())]
    return S.count_conditions(parsed, rules)


@query("val_schema_io", """
    select 'claim_amount' as field, 'min' as rule, count(*) filter (where claim_amount < 0) as n_bad, count(*) as n_rows from @claims c
    union all select 'customer_age', 'min', count(*) filter (where customer_age < 18), count(*) from @claims c
    union all select 'customer_age', 'max', count(*) filter (where customer_age > 120), count(*) from @claims c
    union all select 'policy_duration', 'min', count(*) filter (where policy_duration < 0), count(*) from @claims c""")
def _(spark, sf):
    fields = S.schema_from_dict(S.schema_to_dict(S.CLAIMS_SCHEMA))
    return S.rule_counts(P.claims(spark, sf, "claim_amount", "customer_age", "policy_duration"), fields, ["min", "max"])


REQUEST_COLUMNS = {"claimant_age": "customer_age", "policy_duration_months": "policy_duration"}


REQUEST_VIEW = """(select *, (claim_id % 5 - 1)::int as previous_claims, dayname(claim_date) as day_of_week,
    case when claim_id % 3 = 0 then ' ' else claim_type end as claim_description, case when claim_id % 7 <> 0 then claim_amount - 1000 end as policy_premium,
    case when claim_id % 4 <> 0 then customer_age - 30 end as deductible_amount from @claims c1)"""


@query("val_request_rules", f"""
    with v as (select claim_id, array_to_string(list_filter([
        case when not coalesce(length(trim(claim_id::varchar)) > 0, false) then 'claim_id' end,
        case when not coalesce(claim_amount > 0, false) then 'claim_amount' end,
        case when not coalesce(customer_age between 0 and 120, false) then 'claimant_age' end,
        case when not coalesce(policy_duration >= 0, false) then 'policy_duration_months' end,
        case when not coalesce(previous_claims >= 0, false) then 'previous_claims' end,
        case when not coalesce(region in ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE'), false) then 'region' end,
        case when not coalesce(claim_type in ('1-URGENT', '2-HIGH', '3-MEDIUM'), false) then 'claim_type' end,
        case when not coalesce(day_of_week in ('Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday'), false) then 'day_of_week' end,
        case when not coalesce(length(trim(claim_description)) >= 10, false) then 'claim_description' end,
        case when not coalesce(policy_premium > 0, true) then 'policy_premium' end,
        case when not coalesce(deductible_amount >= 0, true) then 'deductible_amount' end],
        lambda x: x is not null), ',') as broken from {REQUEST_VIEW} c)
    select claim_id, broken from v where broken <> ''""")
def _(spark, sf):
    rules = S.request_rules(REQUEST_COLUMNS, regions=("AFRICA", "AMERICA", "ASIA", "EUROPE"), types=("1-URGENT", "2-HIGH", "3-MEDIUM"),
                            days=("Monday", "Tuesday", "Wednesday", "Thursday", "Friday"))
    i = F.col("claim_id")
    df = P.claims(spark, sf, "claim_id", "claim_amount", "claim_date", "customer_age", "policy_duration", "region", "claim_type").withColumns({
        "previous_claims": (i % 5 - 1).cast("int"), "day_of_week": F.date_format("claim_date", "EEEE"),
        "claim_description": F.when(i % 3 == 0, " ").otherwise(F.col("claim_type")),
        "policy_premium": F.when(i % 7 != 0, F.col("claim_amount") - 1000), "deductible_amount": F.when(i % 4 != 0, F.col("customer_age") - 30)})
    _, bad = S.split_quarantine(df, rules)
    return bad.select("claim_id", F.array_join("violations", ",").alias("broken"))


@query("val_business_rules", """
    with j as (select l_orderkey, l_shipdate, o_orderdate, o_totalprice, l_extendedprice, l_linestatus, o_orderstatus
               from lineitem left join orders on l_orderkey = o_orderkey)
    select 'amount_positive' as rule, count(*) filter (where not coalesce(l_extendedprice > 0, false)) as n_bad, count(*) as n_rows from j
    union all select 'not_before_start', count(*) filter (where not coalesce(l_shipdate >= o_orderdate, false)), count(*) from j
    union all select 'type_matches', count(*) filter (where not coalesce(l_linestatus = o_orderstatus, false)), count(*) from j""")
def _(spark, sf):
    df = P.table(spark, sf, "lineitem").join(P.table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "left")
    return S.business_rules(df, {"amount_positive": F.col("l_extendedprice") > 0,
                                 "not_before_start": F.col("l_shipdate") >= F.col("o_orderdate"),
                                 "type_matches": F.col("l_linestatus") == F.col("o_orderstatus")})


@query("val_foreign_key", """
    select l_suppkey, count(*) as n from lineitem
    where l_suppkey not in (select s_suppkey from supplier where s_suppkey % 7 <> 0) group by 1""")
def _(spark, sf):
    known = P.table(spark, sf, "supplier").where("s_suppkey % 7 <> 0")
    return S.orphans(P.table(spark, sf, "lineitem"), known, "l_suppkey", "s_suppkey").groupBy("l_suppkey").agg(F.count("*").alias("n"))


@query("val_freshness", """
    select max(ts) as newest, date_diff('day', max(ts)::date, date '2024-02-05')::int as age_days,
      date_diff('day', max(ts)::date, date '2024-02-05') <= 3 as fresh from events""")
def _(spark, sf):
    return S.freshness(P.events(spark, sf), "ts", "2024-02-05", 3)


# ---------------------------------------------------------------- data quality

def _long_sql(columns, expr, view="@faulty f") -> str:
    return " union all ".join(f"select '{c}' as feature, {expr.format(c=c)} from {view}" for c in columns)


FAULTY_COLUMNS = list(P.FAULTY_FIELDS)
FAULTY_NUMBERS = ["claim_id", "customer_id", "claim_amount", "customer_age", "zero_count"]
FAULTY_TEXTS = ["claim_type", "rank_text", "filed_date"]


@query("dq_missing", f"""
    select feature, missing, rows, round(100.0 * missing / rows, 6)::double as pct,
      case when 100.0 * missing / rows > 50 then 'critical' when 100.0 * missing / rows > 15 then 'high' end as severity
    from ({_long_sql(FAULTY_COLUMNS, "count(*) filter (where {c} is null) as missing, count(*) as rows")}) m""")
def _(spark, sf):
    return Q.missing_report(P.faulty(spark, sf)).withColumn("pct", F.round("pct", 6))


@query("dq_duplicates", """
    with d as (select distinct customer_age, claim_type, zero_count from @faulty f), t as (select count(*) as rows from orders)
    select t.rows, t.rows - (select count(*) from d) as duplicates,
      round(100.0 * (t.rows - (select count(*) from d)) / t.rows, 6)::double as pct, 'high' as severity from t""")
def _(spark, sf):
    df = P.faulty(spark, sf).select("customer_age", "claim_type", "zero_count")
    return Q.duplicate_rows(df).withColumn("pct", F.round("pct", 6))


@query("dq_duplicate_ids", _long_sql(["claim_id", "customer_id"], "count(*) as rows, count(*) - count(distinct {c}) as duplicates"))
def _(spark, sf):
    return Q.duplicate_ids(P.faulty(spark, sf))


OUTLIER_SQL = """
    with l as ({long}), b as ({bounds}),
    c as (select feature, count(v) as n, round(lower, 4) as lower, round(upper, 4) as upper,
            count(*) filter (where v < lower or v > upper) as outliers from l join b using (feature) group by feature, lower, upper)
    select feature, n, lower, upper, outliers, round(100.0 * outliers / n, 6)::double as pct,
      case when 100.0 * outliers / n > 20 then 'high' when 100.0 * outliers / n > 10 then 'medium' end as severity from c"""
FAULTY_LONG = _long_sql(FAULTY_NUMBERS, "{c}::double as v")


def _rounded(df):
    return df.withColumns({"lower": F.round("lower", 4), "upper": F.round("upper", 4), "pct": F.round("pct", 6)})


@query("dq_outliers_iqr", OUTLIER_SQL.format(long=FAULTY_LONG, bounds="""
    select feature, q1 - 1.5 * (q3 - q1) as lower, q3 + 1.5 * (q3 - q1) as upper from (
      select feature, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from l group by feature) q"""))
def _(spark, sf):
    return _rounded(Q.outliers(P.faulty(spark, sf)))


@query("dq_outliers_zscore", OUTLIER_SQL.format(long=FAULTY_LONG, bounds="""
    select feature, avg(v) - 3 * stddev_pop(v) as lower, avg(v) + 3 * stddev_pop(v) as upper from l group by feature"""))
def _(spark, sf):
    return _rounded(Q.outliers(P.faulty(spark, sf), method="zscore"))


NUMBER = r"regexp_matches({c}, '^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$')"


@query("dq_should_be_numeric", "select feature, n, numeric, numeric > 0.8 * n as should_be_numeric from (" + _long_sql(
    FAULTY_TEXTS, "count({c}) as n, count(*) filter (where " + NUMBER + ") as numeric") + ") q")
def _(spark, sf):
    return Q.numeric_text(P.faulty(spark, sf))


@query("dq_invalid_dates", _long_sql(["filed_date"], "count({c}) as n, count(*) filter (where try_cast({c} as timestamp) is null) as invalid"))
def _(spark, sf):
    return Q.invalid_dates(P.faulty(spark, sf))


@query("dq_type_distribution", """
    select 'bigint' as data_type, 2 as columns, sum((claim_id is not null)::int + (customer_id is not null)::int)::bigint as non_null from @faulty f
    union all select 'double', 1, count(claim_amount) from @faulty f
    union all select 'int', 2, count(customer_age) + count(zero_count) from @faulty f
    union all select 'string', 3, count(claim_type) + count(rank_text) + count(filed_date) from @faulty f""")
def _(spark, sf):
    return Q.type_distribution(P.faulty(spark, sf))


@query("dq_negative_values", _long_sql(["claim_amount", "customer_age", "zero_count"], "count(*) filter (where {c} < 0) as affected, count(*) as rows"))
def _(spark, sf):
    return Q.negatives(P.faulty(spark, sf))


@query("dq_excessive_zeros", "select *, round(affected::double / rows, 6) as share, affected::double / rows > 0.5 as excessive from (" + _long_sql(
    FAULTY_NUMBERS, "count(*) filter (where {c} = 0) as affected, count(*) as rows") + ") q")
def _(spark, sf):
    return Q.zeros(P.faulty(spark, sf)).withColumn("share", F.round("share", 6))


@query("dq_issue_severity", "select *, case when affected > rows * 0.1 then 'high' else 'medium' end as severity from (" + _long_sql(
    ["claim_amount", "customer_age", "zero_count"], "count(*) filter (where {c} < 0) as affected, count(*) as rows") + ") q where affected > 0")
def _(spark, sf):
    n = Q.negatives(P.faulty(spark, sf)).where("affected > 0")
    return n.withColumn("severity", Q.consistency_severity(F.col("affected"), F.col("rows")))


@query("dq_profile_numeric", f"""
    select feature, count(*) as rows, count(v) as non_null, count(*) - count(v) as nulls, count(distinct v) as distinct_values,
      round(count(distinct v)::double / count(*), 6) as cardinality, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std,
      min(v) as min, max(v) as max, round(quantile_cont(v, 0.25), 4) as q25, round(quantile_cont(v, 0.5), 4) as q50,
      round(quantile_cont(v, 0.75), 4) as q75, count(*) filter (where v = 0) as zeros, count(*) filter (where v < 0) as negatives
    from ({FAULTY_LONG}) l group by feature""")
def _(spark, sf):
    p = Q.profile_numeric(P.faulty(spark, sf))
    return p.withColumns({"cardinality": F.round("cardinality", 6), **{c: F.round(c, 4) for c in ("mean", "std", "q25", "q50", "q75")}})


FAULTY_TEXT_LONG = _long_sql(FAULTY_TEXTS, "{c} as value")


@query("dq_profile_text", f"""
    with h as (select feature, value, count(*) as n from ({FAULTY_TEXT_LONG}) l where value is not null group by 1, 2),
    r as (select *, row_number() over (partition by feature order by n desc, value) as rn from h)
    select feature, sum(n)::bigint as non_null, count(*) as distinct_values, round(sum(length(value) * n)::double / sum(n), 6) as avg_length,
      min(length(value))::int as min_length, max(length(value))::int as max_length,
      max(case when rn = 1 then value end) as most_frequent, max(n) as frequency from r group by feature""")
def _(spark, sf):
    return Q.profile_text(P.faulty(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


@query("dq_value_counts", f"select feature, value, count(*) as n from ({FAULTY_TEXT_LONG}) l where value is not null group by 1, 2")
def _(spark, sf):
    return Q.category_counts(P.faulty(spark, sf))


@query("dq_dataset_stats", """
    select count(*) as rows, 8 as columns, round(100.0 * (7 * count(*) + count(claim_amount)) / (8 * count(*)), 6)::double as completeness
    from @faulty f""")
def _(spark, sf):
    return Q.dataset_stats(P.faulty(spark, sf)).withColumn("completeness", F.round("completeness", 6))


ISSUES_SQL = f"""
    t as (select count(*) as n from orders),
    l as ({FAULTY_LONG}),
    b as (select feature, quantile_cont(v, 0.25) as q1, quantile_cont(v, 0.75) as q3 from l group by feature),
    o as (select feature, count(v) as n, count(*) filter (where v < q1 - 1.5 * (q3 - q1) or v > q3 + 1.5 * (q3 - q1)) as k
          from l join b using (feature) group by feature),
    z as (select feature, count(*) filter (where v = 0) as zero, count(*) filter (where v < 0) as neg, count(*) - count(v) as miss from l group by feature),
    x as (select feature, count(value) as n, count(*) filter (where {NUMBER.format(c='value')}) as numeric,
            count(*) filter (where feature = 'filed_date' and try_cast(value as timestamp) is null) as undated from ({FAULTY_TEXT_LONG}) s group by feature),
    d as (select (select n from t) - count(*) as k from (select distinct * from @faulty f) q),
    ids as ({_long_sql(["claim_id", "customer_id"], "count(*) - count(distinct {c}) as k")}),
    i as (
      select case when miss > 0.5 * n then 'critical' else 'high' end as severity, 'missing_data' as category, 'missing' as issue, feature, miss as affected
        from z, t where miss > 0.15 * n
      union all select case when neg > 0.1 * n then 'high' else 'medium' end, 'inconsistency', 'negative_values', feature, neg
        from z, t where neg > 0 and feature in ('claim_amount', 'customer_age', 'zero_count')
      union all select case when zero > 0.1 * n then 'high' else 'medium' end, 'inconsistency', 'excessive_zeros', feature, zero from z, t where zero > 0.5 * n
      union all select 'medium', 'format', 'should_be_numeric', feature, 0 from x where numeric > 0.8 * n
      union all select 'medium', 'format', 'invalid_date_format', feature, 0 from x where undated > 0
      union all select case when k > 0.05 * n then 'high' else 'medium' end, 'duplicates', 'duplicate_rows', null, k from d, t where k > 0
      union all select 'critical', 'duplicates', 'duplicate_ids', feature, k from ids where k > 0
      union all select case when k > 0.2 * n then 'high' else 'medium' end, 'outliers', 'outliers', feature, k from o where k > 0.1 * n),
    s as (select greatest(0.0, least(100.0, 100.0 - coalesce(sum(
            case severity when 'critical' then 20 when 'high' then 10 when 'medium' then 5 else 2 end * least(2.0 * affected / n, 1.0)), 0.0)))::double as score,
          count(affected) as k from i, t)"""


@query("dq_score", f"with {ISSUES_SQL} select round(score, 6) as quality_score, k as total_issues from s")
def _(spark, sf):
    found, rows = Q.assess(P.faulty(spark, sf))
    return Q.score(found, F.lit(rows)).withColumn("quality_score", F.round("quality_score", 6))


@query("dq_recommendations", f"""
    with {ISSUES_SQL}
    select m as recommendation from (select distinct category from i) c join (values
      {", ".join(f"('{c}', '{m}')" for c, m in Q.MESSAGES.items())}) v(category, m) using (category)
    union all select m from s, (values {", ".join(f"({c}, '{m}')" for c, m in Q.SCORE_MESSAGES.items())}) v(below, m) where score < below""")
def _(spark, sf):
    found, rows = Q.assess(P.faulty(spark, sf))
    return Q.recommendations(found, Q.score(found, F.lit(rows)).select("quality_score").scalar())


@query("dq_report", f"""
    with {ISSUES_SQL}
    select 'claims' as dataset, severity, category, issue, feature, affected::bigint as affected, n as total_records,
      round(score, 6) as quality_score from s, t, i""")
def _(spark, sf):
    return Q.report(P.faulty(spark, sf), "claims").withColumn("quality_score", F.round("quality_score", 6))


# Gate limits (null share, duplicate share, amount, age, age of data in years, record count, overall score).
GATE = {"null_share": ("<", 0.15), "duplicate_share": ("<", 0.01), "min_amount": (">=", 0), "max_amount": ("<=", 1_000_000),
        "min_age": (">=", 18), "max_age": ("<=", 120), "oldest_years": ("<=", 5), "records": (">=", 1000), "quality_score": (">=", 0.85)}


@query("val_threshold_gate", f"""
    with {ISSUES_SQL}, m as (select avg(case when claim_amount is null then 1.0 else 0.0 end)::double as null_share,
        (1.0 - count(distinct claim_id)::double / count(*))::double as duplicate_share, min(claim_amount)::double as min_amount,
        max(claim_amount)::double as max_amount, min(customer_age)::double as min_age, max(customer_age)::double as max_age,
        (date_diff('day', min(try_cast(filed_date as date)), date '{P.AS_OF}') / 365.25)::double as oldest_years, count(*)::double as records,
        (select score / 100 from s)::double as quality_score from @faulty f),
    gl as (unpivot m on null_share, duplicate_share, min_amount, max_amount, min_age, max_age, oldest_years, records, quality_score into name metric value value)
    select metric, round(value, 6) as value, lim as limit, coalesce(case op when '<' then value < lim when '<=' then value <= lim
      when '>=' then value >= lim end, false) as passed
    from (values ('null_share', '<', 0.15::double), ('duplicate_share', '<', 0.01), ('min_amount', '>=', 0), ('max_amount', '<=', 1000000),
      ('min_age', '>=', 18), ('max_age', '<=', 120), ('oldest_years', '<=', 5), ('records', '>=', 1000), ('quality_score', '>=', 0.85)) g(metric, op, lim)
    left join gl using (metric)""")
def _(spark, sf):
    df = P.faulty(spark, sf)
    oldest = F.min(F.expr("try_cast(filed_date as date)"))
    m = df.agg(
        F.avg(F.when(F.col("claim_amount").isNull(), 1.0).otherwise(0.0)).alias("null_share"),
        (F.lit(1.0) - F.count_distinct("claim_id").cast("double") / F.count("*")).alias("duplicate_share"),
        F.min("claim_amount").alias("min_amount"), F.max("claim_amount").alias("max_amount"),
        F.min("customer_age").cast("double").alias("min_age"), F.max("customer_age").cast("double").alias("max_age"),
        (F.datediff(F.lit(P.AS_OF).cast("date"), oldest) / F.lit(365.25).cast("double")).alias("oldest_years"), F.count("*").cast("double").alias("records"))
    found, count = Q.assess(df)
    overall = Q.score(found, F.lit(count)).select((F.col("quality_score") / 100).alias("quality_score"))
    rows = m.unpivot([], m.columns, "metric", "value").unionByName(overall.unpivot([], ["quality_score"], "metric", "value"))
    return S.threshold_gate(rows, GATE).withColumn("value", F.round("value", 6))


@query("dq_source_consistency", """
    with a as (select o_orderkey as k, o_totalprice as price, o_orderstatus as st from orders where o_orderkey % 97 <> 0),
    b as (select o_orderkey as k, case when o_orderkey % 50 = 1 then o_totalprice + 1 else o_totalprice end as price,
            case when o_orderkey % 30 = 2 then null else o_orderstatus end as st from orders where o_orderkey % 89 <> 0),
    j as (select a.k as ak, b.k as bk, a.price as ap, b.price as bp, a.st as sa, b.st as sb from a full join b on a.k = b.k)
    select 'only_in_first' as "check", count(*) filter (where bk is null) as n from j
    union all select 'only_in_second', count(*) filter (where ak is null) from j
    union all select 'differs_price', count(*) filter (where ak is not null and bk is not null and ap is distinct from bp) from j
    union all select 'differs_st', count(*) filter (where ak is not null and bk is not null and sa is distinct from sb) from j""")
def _(spark, sf):
    o = P.table(spark, sf, "orders")
    a = o.where("o_orderkey % 97 <> 0").selectExpr("o_orderkey as k", "o_totalprice as price", "o_orderstatus as st")
    b = o.where("o_orderkey % 89 <> 0").selectExpr(
        "o_orderkey as k", "case when o_orderkey % 50 = 1 then o_totalprice + 1 else o_totalprice end as price",
        "case when o_orderkey % 30 = 2 then null else o_orderstatus end as st")
    return Q.source_consistency(a, b, ["k"], ["price", "st"])


@query("dq_text_bounds", """
    select 'text' as feature, count(*) filter (where length(text) < 5) as too_short, count(*) filter (where length(text) > 1000) as too_long,
      count(*) as rows from documents""")
def _(spark, sf):
    return Q.text_bounds(P.documents(spark, sf), ["text"])
