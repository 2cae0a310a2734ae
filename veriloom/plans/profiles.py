"""Logical views over the test tables, as DataFrames and as SQL text.

``sql()`` expands ``@name`` to the sub-query of a view, so both sides of a check
start from the same definition.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AS_OF = "2001-01-01"
SPLIT_TS = "2024-01-16"

ORDER_FIELDS = {
    "claim_id": "o_orderkey",
    "customer_id": "o_custkey",
    "claim_amount": "case when o_orderkey % 20 = 0 then null else o_totalprice end",
    "claim_date": "o_orderdate",
    "claim_type": "o_orderpriority",
    "claim_status": "o_orderstatus",
    "customer_age": "cast(18 + (o_custkey % 63) as int)",
    "policy_duration": "cast(1 + (o_orderkey % 60) as int)",
    "risk_level": "case when o_totalprice > 250000 then 'high' else 'low' end",
}
JOINED_FIELDS = {"customer_segment": "c_mktsegment", "location": "n_name", "region": "r_name"}
CLAIM_FIELDS = {**ORDER_FIELDS, **JOINED_FIELDS}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def claims(spark: SparkSession, sf: str, *names: str) -> DataFrame:
    """Claims view with the given columns (all by default); joins only what they need."""
    names = names or tuple(CLAIM_FIELDS)
    df = table(spark, sf, "orders")
    if set(names) & set(JOINED_FIELDS):
        df = df.join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    if set(names) & {"location", "region"}:
        df = df.join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left")
    if "region" in names:
        df = df.join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return df.select(*[F.expr(CLAIM_FIELDS[n]).alias(n) for n in names])


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang", "source")
    p = F.round(F.least(F.col("n_chars"), F.lit(5000)).cast("double") / F.lit(5000.0).cast("double"), 4)
    return (docs.join(table(spark, sf, "labels"), "doc_id")
            .select(F.col("doc_id").alias("key"), F.col("quality").alias("y_true"), p.alias("p"),
                    F.when(p >= 0.3, 1).otherwise(0).alias("y_pred"), "lang", "source"))


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events")


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents")


def models_scored(spark: SparkSession, sf: str) -> DataFrame:
    """Three threshold models over the predictions: one row per model and key."""
    p = predictions(spark, sf)
    models = F.explode(F.array(*[F.struct(F.lit(n).alias("model"), F.lit(t).alias("threshold"))
                                 for n, t in THRESHOLDS.items()])).alias("m")
    return (p.select("key", "y_true", "p", "lang", "source", models)
            .select("key", "y_true", "p", "lang", "source", "m.model",
                    F.when(F.col("p") >= F.col("m.threshold"), 1).otherwise(0).alias("y_pred"),
                    (F.col("key") % 5).alias("fold")))


THRESHOLDS = {"model_a": 0.2, "model_b": 0.3, "model_c": 0.4}

# A version of the claims with planted faults, derived from the keys.
FAULTY_FIELDS = {
    "claim_id": "cast(o_orderkey - (case when o_orderkey % 40 = 7 then 1 else 0 end) as bigint)",
    "customer_id": "o_custkey",
    "claim_amount": "case when o_orderkey % 6 = 0 then null when o_orderkey % 9 = 4 then -o_totalprice else o_totalprice end",
    "customer_age": "cast(18 + (o_custkey % 63) + (case when o_orderkey % 8 = 3 then 500 else 0 end) as int)",
    "zero_count": "cast(case when o_orderkey % 3 = 0 then 5 else 0 end as int)",
    "claim_type": "o_orderpriority",
    "rank_text": "case when o_orderkey % 10 = 0 then 'n/a' else left(o_orderpriority, 1) end",
    "filed_date": "case when o_orderkey % 50 = 0 then 'not a date' else concat('1999-01-0', cast(1 + o_orderkey % 9 as varchar(5))) end",
}


def faulty(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(*[F.expr(e).alias(n) for n, e in FAULTY_FIELDS.items()])


VIEWS = {
    "faulty": "(select " + ", ".join(f"{e} as {n}" for n, e in FAULTY_FIELDS.items()) + " from orders)",
    "claims": "(select " + ", ".join(f"{e} as {n}" for n, e in CLAIM_FIELDS.items()) +
              " from orders left join customer on o_custkey = c_custkey"
              " left join nation on c_nationkey = n_nationkey"
              " left join region on n_regionkey = r_regionkey)",
    "predictions": "(select doc_id as key, quality as y_true,"
                   " round(cast(least(n_chars, 5000) as double) / 5000.0, 4) as p,"
                   " case when round(cast(least(n_chars, 5000) as double) / 5000.0, 4) >= 0.3 then 1 else 0 end as y_pred,"
                   " lang, source from documents join labels using (doc_id))",
    "scored": "(select key, y_true, p, lang, source, model, case when p >= threshold then 1 else 0 end as y_pred,"
              " key % 5 as fold from @predictions p0, (values ('model_a', 0.2::double), ('model_b', 0.3::double),"
              " ('model_c', 0.4::double)) m0(model, threshold))",
    "confusion": "(select sum(case when y_true = 1 and y_pred = 1 then 1 else 0 end)::double as tp,"
                 " sum(case when y_true = 0 and y_pred = 0 then 1 else 0 end)::double as tn,"
                 " sum(case when y_true = 0 and y_pred = 1 then 1 else 0 end)::double as fp,"
                 " sum(case when y_true = 1 and y_pred = 0 then 1 else 0 end)::double as fn,"
                 " count(*)::double as n from @predictions c0)",
    "history": "(select event_type as model, date_trunc('day', ts) as ts,"
               " avg(case when value > 10 then 1.0 else 0.0 end)::double as value,"
               " count(*) as prediction_count from events group by 1, 2)",
    "requests": "(select event_id, event_type as endpoint, ts, value as duration, event_type = 'error' as is_error,"
                " user_id from events)",
}


def history(spark: SparkSession, sf: str) -> DataFrame:
    """Daily metric per model, the shape of a metric history table."""
    return (events(spark, sf).groupBy(F.col("event_type").alias("model"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("ts"))
            .agg(F.avg(F.when(F.col("value") > 10, 1.0).otherwise(0.0)).alias("value"),
                 F.count(F.lit(1)).alias("prediction_count")))


def requests(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", F.col("event_type").alias("endpoint"), "ts",
                                    F.col("value").alias("duration"),
                                    (F.col("event_type") == "error").alias("is_error"), "user_id")


def sql(text: str) -> str:
    """Expand @views, also inside views."""
    while True:
        out = re.sub(r"@(\w+)", lambda m: VIEWS[m.group(1)], text)
        if out == text:
            return out
        text = out
