"""Queries over splits, training, scoring and the registry."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.feature import Imputer, SQLTransformer
from pyspark.sql import functions as F

from veriloom.operators import evaluate as V
from veriloom.operators import modelling as M
from veriloom.plans import profiles as P
from veriloom.plans.registry import query
from veriloom.operators.registry import ModelRegistry
from veriloom.operators.search import SPACE as SEARCH_SPACE
from veriloom.operators.search import best_setting, halving_search
from veriloom.session import materialize, scratch_path, stored

# The operators' own defaults (300 trees of depth 20, 500 rounds, a grid of 100 and 300 rounds) take minutes on one machine; see README.
FOREST = {"trees": 50, "depth": 10}
ROUNDS = (20, 50)
INPUTS = ["customer_age", "policy_duration", "exposure", "discount", "quantity"]


def _training(spark, sf):
    """Claims with line-item totals as features and the risk level as label.

    Of these only ``exposure``, the amount up to a factor that differs by claim, has to do with the label: what a model must find.
    """
    amounts = P.table(spark, sf, "orders").select(F.col("o_orderkey").alias("claim_id"), F.expr("o_totalprice * (0.8D + (o_orderkey % 9) / 20.0D)").alias("exposure"))
    lines = P.table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("claim_id")).agg(
        F.sum("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"))
    df = P.claims(spark, sf, "claim_id", "customer_age", "policy_duration", "risk_level").join(lines, "claim_id").join(amounts, "claim_id")
    labelled = df.withColumn("label", F.when(F.col("risk_level") == "high", 1.0).otherwise(0.0)).drop("risk_level")
    return stored(labelled.repartition(spark.sparkContext.defaultParallelism, "claim_id"), "training")


def _measure(scored):
    y = scored.select(F.col("label").cast("int").alias("y_true"), F.when(F.col("predicted_risk") == "high", 1).otherwise(0).alias("y_pred"))
    return V.basic_metrics(V.confusion(y)).select("accuracy", "f1_score").unpivot([], ["accuracy", "f1_score"], "metric", "value")


@query("ml_split_stratified", """
    with r as (select claim_id, risk_level, row_number() over (partition by risk_level order by md5(claim_id::varchar), claim_id) as rn,
      count(*) over (partition by risk_level) as n from @claims c)
    select claim_id, risk_level, case when rn <= floor(n * 0.2::double + 0.5) then 'test' else 'train' end as part from r""")
def _(spark, sf):
    return M.stratified_split(P.claims(spark, sf, "claim_id", "risk_level"), "claim_id", "risk_level")


@query("ml_split_time", """
    with r as (select claim_id, floor((row_number() over (order by claim_date, claim_id) - 1) * 6 / (count(*) over ())::double)::int as block from @claims c),
    f as (select i as fold, claim_id, case when block <= i then 'train' else 'test' end as part from r, range(5) x(i) where block <= i + 1)
    select fold::int as fold, part, count(*) as n, min(claim_id) as first_id, max(claim_id) as last_id from f group by 1, 2""")
def _(spark, sf):
    blocks = materialize(M.time_blocks(P.claims(spark, sf, "claim_id", "claim_date"), "claim_date", "claim_id"))
    out = None
    for i in range(5):
        for part, rows in zip(("train", "test"), M.time_fold(blocks, i)):
            s = rows.agg(F.count("*").alias("n"), F.min("claim_id").alias("first_id"), F.max("claim_id").alias("last_id")).select(
                F.lit(i).alias("fold"), F.lit(part).alias("part"), "n", "first_id", "last_id")
            out = s if out is None else out.unionAll(s)
    return out


@query("ml_class_weight", """
    select risk_level, count(*) as n, round((select count(*) from orders)::double / (2 * count(*)), 6) as weight from @claims c group by 1""")
def _(spark, sf):
    return M.class_weights(P.claims(spark, sf, "risk_level"), "risk_level").withColumn("weight", F.round("weight", 6))


def _checked(scored):
    """What must hold of every scored row, whatever the model: probabilities that sum to one, the label and confidence that follow
    from them, and, of all rows together, an accuracy that no constant answer reaches (a constant one has that of the larger label, about a half)."""
    p, q = F.col("p_high"), F.col("p_low")
    scored = materialize(scored)
    hit = F.avg((F.col("label") == F.when(F.col("predicted_risk") == "high", 1.0).otherwise(0.0)).cast("double"))
    learned = scored.agg((hit >= 0.15 + F.greatest(F.avg("label"), 1 - F.avg("label"))).alias("ok")).scalar()
    return scored.withColumn("learned_ok", learned).select("claim_id", (p.between(0, 1) & q.between(0, 1) & (F.abs(p + q - 1) < 1e-9)).alias("probabilities_ok"),
                         (F.col("predicted_risk") == F.when(p > q, "high").otherwise("low")).alias("label_ok"),
                         (F.abs(F.col("confidence") - F.greatest(p, q)) < 1e-12).alias("confidence_ok"), "learned_ok")


ALL_SCORED = "select o_orderkey as claim_id, true as probabilities_ok, true as label_ok, true as confidence_ok, true as learned_ok from orders where o_orderkey in (select l_orderkey from lineitem)"


@query("ml_train_rf", ALL_SCORED)
def _(spark, sf):
    df = _training(spark, sf)
    return _checked(M.score(M.train_forest(df, INPUTS, "label", **FOREST), df))


@query("ml_train_gbt", ALL_SCORED)
def _(spark, sf):
    df = _training(spark, sf)
    return _checked(M.score(M.train_boosted(df, INPUTS, "label", rounds=100), df))


@query("ml_train_mlp", ALL_SCORED)
def _(spark, sf):
    df = _training(spark, sf)
    return _checked(M.score(M.train_network(df, INPUTS, "label"), df))


@query("ml_tune", "select r::int as rounds, d::int as depth, true as auc_ok from (values (20), (50)) a(r), (values (4), (6)) b(d)")
def _(spark, sf):
    return M.tune_boosted(_training(spark, sf), INPUTS, "label", rounds=ROUNDS).select("rounds", "depth", F.col("auc").between(0.75, 1).alias("auc_ok"))


def _drawn(axis):
    """The SQL of a candidate's place in the range of an axis."""
    return f"('0x' || substr(md5('42:' || c || ':{axis}'), 1, 8))::bigint / 4294967296::double"


@query("ml_search_halving", f"""
    select c::int as candidate, round(exp(ln(0.01::double) + {_drawn('rate')} * (ln(0.3::double) - ln(0.01::double))), 6) as rate,
      (2 + floor({_drawn('depth')} * 4))::int as depth, round(0.6::double + {_drawn('subsample')} * 0.4, 6) as subsample,
      round(0.6::double + {_drawn('columns')} * 0.4, 6) as columns, round(1.0::double + {_drawn('positive_weight')} * 9.0, 6) as positive_weight,
      r::int as first_rounds, true as order_ok, 6::int as at_rung_0, 2::int as at_rung_1, 1::int as at_rung_2, true as best_auc_ok
    from range(6) t(c), (values (4)) v(r)""")
def _(spark, sf):
    """The six candidates with their settings, and of the whole search: its rungs, that none that stopped was better than one that
    went on, and that the winner finds the label."""
    space = {**SEARCH_SPACE, "depth": ("int", 2, 5)}
    out = materialize(halving_search(_training(spark, sf), INPUTS, "label", "claim_id", candidates=6, rounds=4, folds=2, space=space))
    worst = out.groupBy("rung").agg(F.min(F.when(F.col("kept"), F.col("auc"))).alias("in"), F.max(F.when(~F.col("kept"), F.col("auc"))).alias("out"))
    order_ok = worst.agg(F.bool_and(F.coalesce(F.col("in") >= F.col("out"), F.lit(True)))).scalar()
    at = {f"at_rung_{i}": out.agg(F.count_if(F.col("rung") == i).cast("int")).scalar() for i in range(3)}
    return out.where("rung = 0").select("candidate", "rate", "depth", "subsample", "columns", "positive_weight", F.col("rounds").alias("first_rounds"), order_ok.alias("order_ok"), *[v.alias(k) for k, v in at.items()],
                                        best_setting(out).agg(F.max(F.col("auc")) >= 0.75).scalar().alias("best_auc_ok"))


@query("ml_cross_validate", """
    select 0::int as repeat, f::int as fold, p as part, m as metric, true as score_ok
    from range(5) a(f), (values ('train'), ('test')) b(p), (values ('accuracy'), ('f1_score')) c(m)""")
def _(spark, sf):
    df = _training(spark, sf)
    out = M.cross_validate(df, lambda d: M.train_logistic(d, INPUTS, "label"), _measure, "claim_id", "label", folds=5)
    return out.select("repeat", "fold", "part", "metric", F.col("score").between(0.65, 1).alias("score_ok"))


@query("ml_batch_score", ALL_SCORED)
def _(spark, sf):
    df = _training(spark, sf)
    return _checked(M.score(M.train_logistic(df, INPUTS, "label"), df))


def _scored(spark, sf):
    p = F.col("p")
    return P.predictions(spark, sf).select("key", F.when(p >= 0.5, "high").otherwise("low").alias("predicted_risk"),
                                           F.greatest(p, 1 - p).alias("confidence"))


SCORED = "(select key, case when p >= 0.5 then 'high' else 'low' end as risk, greatest(p, 1 - p) as c from @predictions p0)"


@query("ml_batch_stats", f"""
    select count(*) as total_claims, count(*) filter (where risk = 'high') as high_risk_claims, count(*) filter (where risk = 'low') as low_risk_claims,
      round(100.0::double * count(*) filter (where risk = 'high') / count(*), 6) as high_risk_percentage, round(avg(c), 6) as average_confidence from {SCORED} s""")
def _(spark, sf):
    return M.batch_stats(_scored(spark, sf)).withColumns({c: F.round(c, 6) for c in ("high_risk_percentage", "average_confidence")})


@query("ml_business_impact", f"""
    select key, risk as predicted_risk, round((case when risk = 'high' then 25000 else 5000 end) * c + (case when risk = 'high' then 500 else 0 end), 2) as estimated_cost,
      case when risk = 'high' then 500.0 else 0.0 end::double as investigation_cost,
      round(greatest(0, 15000 - ((case when risk = 'high' then 25000 else 5000 end) * c + (case when risk = 'high' then 500 else 0 end))), 2) as potential_savings,
      case when risk = 'high' and c > 0.7 then 'investigate' else 'process_normally' end as recommendation from {SCORED} s""")
def _(spark, sf):
    return M.business_impact(_scored(spark, sf)).drop("confidence", "confidence_multiplier")


@query("ml_feature_importance", f"select f as feature, f = 'exposure' as most_important, true as importance_ok, true as sum_ok from (values {', '.join(f"('{i}')" for i in INPUTS)}) v(f)")
def _(spark, sf):
    model = M.train_forest(_training(spark, sf), INPUTS, "label", **FOREST)
    out = M.importance_summary(M.feature_importance(model, INPUTS, spark))
    return out.select("feature", (F.col("importance") == out.agg(F.max("importance")).scalar()).alias("most_important"), F.col("importance").between(0, 1).alias("importance_ok"), (F.abs(F.col("importance_sum") - 1) < 1e-9).alias("sum_ok"))


@query("ml_permutation_importance", f"""select f as feature, m as metric, f = 'exposure' as largest, true as drop_ok
    from (values {', '.join(f"('{i}')" for i in INPUTS)}) v(f), (values ('accuracy'), ('f1_score')) w(m)""")
def _(spark, sf):
    df = _training(spark, sf)
    out = M.permutation_importance(M.train_forest(df, INPUTS, "label", **FOREST), df, INPUTS, "claim_id", _measure)
    out = materialize(out)
    top = out.groupBy("metric").agg(F.max("drop").alias("most"))
    return out.join(top, "metric").select("feature", "metric", (F.col("drop") == F.col("most")).alias("largest"), F.col("drop").between(-1, 1).alias("drop_ok"))


REGISTRY = """(select left(claim_type, 1)::int as version, round(avg((risk_level = 'high')::int), 6)::double as metric, max(claim_date) as created_at,
    case when left(claim_type, 1) = '4' then 'Production' when left(claim_type, 1) = '5' then 'Staging' else 'Archived' end as stage from @claims c group by 1, 4)"""


def _registry(spark, sf):
    """One version per claim type, with the share of high risk as its metric."""
    version = F.substring("claim_type", 1, 1).cast("int").alias("version")
    g = P.claims(spark, sf, "claim_type", "risk_level", "claim_date").groupBy(version).agg(
        F.round(F.avg(F.when(F.col("risk_level") == "high", 1.0).otherwise(0.0)), 6).alias("metric"), F.max("claim_date").alias("created_at"))
    return g.withColumn("stage", F.when(F.col("version") == 4, "Production").when(F.col("version") == 5, "Staging").otherwise("Archived"))


@query("ml_registry", f"select version, metric, created_at, case when version = 5 then 'Production' else 'Archived' end as stage from {REGISTRY} r")
def _(spark, sf):
    return M.promote(_registry(spark, sf), 5)


def _store(spark, sf):
    """Two versions of a pipeline whose fitted mean comes from the even and from the odd claims; 1, then 2 promoted, then rolled back."""
    rule = SQLTransformer(statement="select *, round(amount, 6) as filled, amount > 200000 as large from __THIS__")
    claims = P.claims(spark, sf, "claim_id", "claim_amount")
    registry = ModelRegistry(spark, scratch_path(spark, "registry"))
    for odd in (0, 1):
        part = claims.where(F.col("claim_id") % 2 == odd)
        model = Pipeline(stages=[Imputer(strategy="mean", inputCol="claim_amount", outputCol="amount"), rule]).fit(part)
        registry.register("claims", model, "2024-01-01", {"rows": float(part.count())})
    for version in (1, 2):
        registry.promote("claims", version, "2024-01-02")
    registry.rollback("claims", "2024-01-03")
    return registry, claims


@query("ml_registry_store", """
    with c as (select claim_id, claim_amount as a from @claims c1), m as (select claim_id % 2 + 1 as version, avg(a) as mean, count(*) as n from c group by 1)
    select v as model_version, case v when 1 then 'Production' else 'Archived' end as stage, asked, claim_id, round(coalesce(a, mean), 6) as filled,
      coalesce(a, mean) > 200000 as large from c, (values ('1', 1), ('2', 2), ('production', 1)) q(asked, v) join m on m.version = v""")
def _(spark, sf):
    registry, claims = _store(spark, sf)
    stages = registry.versions("claims").select(F.col("version").alias("model_version"), "stage")
    scored = [registry.score("claims", claims, v).withColumn("asked", F.lit(name)) for name, v in (("1", 1), ("2", 2), ("production", None))]
    both = scored[0].unionByName(scored[1]).unionByName(scored[2])
    return both.join(F.broadcast(stages), "model_version").select("model_version", "stage", "asked", "claim_id", "filled", "large")  # a row per version


@query("ml_registry_history", """select * from (values (0, 'register', 1, 'Staging'), (1, 'register', 2, 'Staging'), (2, 'promote', 1, 'Production'),
    (3, 'promote', 2, 'Production'), (4, 'rollback', 1, 'Production')) h(number, action, version, stage), (select count(*) as claims from orders) n""")
def _(spark, sf):
    registry, claims = _store(spark, sf)
    return registry.history("claims").drop("at").withColumn("claims", claims.agg(F.count("*")).scalar())


@query("ml_rollback", f"select version, metric, created_at, case when version = 3 then 'Production' when version = 5 then 'Staging' else 'Archived' end as stage from {REGISTRY} r")
def _(spark, sf):
    return M.rollback(_registry(spark, sf))


@query("ml_retrain_trigger", """
    with s as (select lang as model, count(*) filter (where source = 'web') as drifted_features, avg((y_true = y_pred)::int) as accuracy, count(*) * 100 as new_rows from @predictions p group by 1),
    r as (select *, list_filter([case when drifted_features >= 3 then 'Data drift detected' end, case when accuracy < 0.85 then 'Performance degradation' end,
      case when model = 'en' then 'Scheduled retraining' end, case when new_rows > 5000 then 'Sufficient new data available' end], lambda x: x is not null) as reasons from s)
    select model, array_to_string(reasons, '; ') as reasons, len(reasons) > 0 as should_retrain from r""")
def _(spark, sf):
    status = P.predictions(spark, sf).groupBy(F.col("lang").alias("model")).agg(
        F.count_if(F.col("source") == "web").alias("drifted_features"), F.avg((F.col("y_true") == F.col("y_pred")).cast("int")).alias("accuracy"),
        (F.count("*") * 100).alias("new_rows")).withColumn("schedule_due", F.col("model") == "en")
    return M.retrain_reasons(status).select("model", F.array_join("reasons", "; ").alias("reasons"), "should_retrain")


VARIANT = "case when ('0x' || md5(event_id::varchar)[1:8])::bigint % 100 < 10 then 'treatment' else 'control' end"


@query("ml_ab_assign", f"select event_id, {VARIANT} as variant from events")
def _(spark, sf):
    return M.ab_assign(P.events(spark, sf).select("event_id"), "event_id")


@query("ml_ab_compare", f"""
    with a as (select {VARIANT} as variant, (event_type <> 'error')::int::double as ok, value from events),
    s as (select avg(ok) filter (where variant = 'control') as ca, avg(value) filter (where variant = 'control') as cl,
      avg(ok) filter (where variant = 'treatment') as ta, avg(value) filter (where variant = 'treatment') as tl from a)
    select round(ca, 6) as control_accuracy, round(cl, 6) as control_latency, round(ta, 6) as treatment_accuracy, round(tl, 6) as treatment_latency,
      round(ta - ca, 6) as accuracy_gain, round(tl - cl, 6) as latency_increase, ta - ca >= 0.02 and tl - cl <= 20 as success from s""")
def _(spark, sf):
    df = M.ab_assign(P.events(spark, sf).select("event_id", "event_type", "value"), "event_id")
    out = M.ab_compare(df.withColumn("ok", F.col("event_type") != "error"), "ok", "value")
    return out.withColumns({c: F.round(c, 6) for c in out.columns if c != "success"})
