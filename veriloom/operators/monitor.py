"""Performance monitoring and alert rules over metric, request and event tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veriloom.functions import stats
from veriloom.functions.columns import fired, micros, missing, ratio
from veriloom.functions.ordered import quantiles, running
from veriloom.functions.skew import lookup_join
from veriloom.operators.features import recent_count
from veriloom.operators.quality import bounds_lookup, iqr_bounds
from veriloom.session import stored

# Thresholds of degradation, trend, alerts and requests.
PRIMARY = ("accuracy", "f1_score", "roc_auc")
DEGRADATION, CRITICAL, RETRAIN = 0.05, 0.10, 0.08
STRONG_R, POOR_PERFORMANCE = 0.7, 0.7
ALERT_RULES = (("accuracy", "<", 0.85, "critical", "performance_degradation"),
               ("features_with_drift", ">=", 3.0, "warning", "data_drift"),
               ("avg_confidence", "<", 0.7, "warning", "low_confidence"))
SLOW_SECONDS, ERROR_RATE = 5.0, 0.05
LAST_REQUESTS = 1000


def at(value: str) -> Column:
    return F.lit(value).cast("timestamp_ntz")


# ------------------------------------------------------------------ performance

def baseline(history: DataFrame) -> DataFrame:
    """Latest value per model and metric."""
    return history.groupBy("model", "metric").agg(F.max_by("value", "ts").alias("baseline"), F.max("ts").alias("set_at"))


def metric_changes(current: DataFrame, base: DataFrame) -> DataFrame:
    """(model, metric, baseline, value, relative_change, degradation)."""
    change = F.when(F.col("baseline") > 0, (F.col("value") - F.col("baseline")) / F.col("baseline")).otherwise(0.0)
    return current.join(base.select("model", "metric", "baseline"), ["model", "metric"]).withColumns(
        {"relative_change": change, "degradation": -change})


def degradation(current: DataFrame, base: DataFrame, metrics: Sequence[str] = PRIMARY) -> DataFrame:
    """Mean relative drop per model and its severity."""
    g = metric_changes(current, base).where(F.col("metric").isin(list(metrics))).groupBy("model").agg(
        F.avg("degradation").alias("overall_degradation"), F.count(F.lit(1)).alias("metrics"))
    d = F.col("overall_degradation")
    return g.withColumns({"degradation_detected": d > DEGRADATION,
                          "severity": F.when(d > CRITICAL, "critical").when(d > DEGRADATION, "warning").otherwise("none")})


def trend(history: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    """Linear trend per model and metric over the last days, on whole days since the first entry."""
    recent = history.where((F.col("ts") > at(as_of) - F.expr(f"interval {days} days")) & (F.col("ts") <= at(as_of)))
    first = recent.groupBy("model", "metric").agg(F.min("ts").alias("_t0"))
    rows = lookup_join(recent, first, ["model", "metric"], F.struct("ts", "value"), how="inner")
    x = F.floor((micros(F.col("ts")) - micros(F.col("_t0"))) / F.lit(86_400_000_000)).cast("double")
    y = F.col("value")
    g = rows.withColumn("_x", x).groupBy("model", "metric").agg(
        F.count(F.lit(1)).alias("points"), F.regr_slope("value", "_x").alias("slope"), F.corr("value", "_x").alias("_r"),
        F.stddev_pop("_x").alias("_sx"), F.min_by("value", "ts").alias("initial_value"), F.max_by("value", "ts").alias("current_value"))
    g = g.where((F.col("points") >= 2) & (F.col("_sx") > 0))
    r, n = F.coalesce("_r", F.lit(0.0)), F.col("points")
    t = F.when(n > 2, r * F.sqrt(F.try_divide(n - 2, F.greatest(1 - r * r, F.lit(1e-300)))))
    p = stats.p_value_udf(stats.t_sf2)(t, (n - 2).cast("double"))
    return g.select("model", "metric", "points", "slope", (r * r).alias("r_squared"), p.alias("p_value"),
                    F.when(F.col("slope") > 0, "improving").otherwise("declining").alias("trend_direction"),
                    F.when(F.abs(r) > STRONG_R, "strong").otherwise("weak").alias("trend_strength"),
                    "initial_value", "current_value", (F.col("current_value") - F.col("initial_value")).alias("total_change"))


def recommendations(status: DataFrame) -> DataFrame:
    """Ordered actions per model from has_baseline, has_recent, severity, overall_degradation and declining."""
    base, recent = F.col("has_baseline"), F.col("has_recent")
    live = base & recent
    critical, warning = live & (F.col("severity") == "critical"), live & (F.col("severity") == "warning")
    actions = fired({
        "establish_baseline": ~base, "resume_monitoring": base & ~recent, "immediate_investigation": critical,
        "retrain_model": critical & (F.col("overall_degradation") > RETRAIN), "investigate_performance": warning,
        "monitor_trend": live & F.col("declining"), "check_data_drift": live})
    step = status.select("model", F.when(critical, "critical").when(warning, "medium").otherwise("low").alias("overall_priority"),
                         F.posexplode(actions).alias("position", "action"))
    a = F.col("action")
    priority = (F.when(a == "establish_baseline", "high").when(a.isin("immediate_investigation", "retrain_model"), "critical")
                .when(a == "check_data_drift", "low").otherwise("medium"))
    return step.withColumn("priority", priority)


def monitoring_status(models: DataFrame, base: DataFrame, recent: DataFrame, degraded: DataFrame, trends: DataFrame) -> DataFrame:
    """One row per model with what recommendations() needs."""
    declining = trends.where("trend_direction = 'declining' and trend_strength = 'strong'").select("model").distinct().withColumn("_d", F.lit(True))
    has_base = base.select("model").distinct().withColumn("_b", F.lit(True))
    has_recent = recent.select("model").distinct().withColumn("_r", F.lit(True))
    j = models.join(has_base, "model", "left").join(has_recent, "model", "left").join(declining, "model", "left").join(
        degraded.select("model", "severity", "overall_degradation"), "model", "left")
    return j.select("model", F.col("_b").isNotNull().alias("has_baseline"), F.col("_r").isNotNull().alias("has_recent"),
                    F.coalesce("severity", F.lit("none")).alias("severity"),
                    F.coalesce("overall_degradation", F.lit(0.0)).alias("overall_degradation"), F.col("_d").isNotNull().alias("declining"))


def window_metrics(predictions: DataFrame, as_of: str, hours: int = 24, by: Sequence[str] = (), keep_last: int | None = None) -> DataFrame:
    """Metrics of the last hours over (ts, y_pred, y_true or null, confidence)."""
    rows = predictions.where((F.col("ts") > at(as_of) - F.expr(f"interval {hours} hours")) & (F.col("ts") <= at(as_of)))
    if keep_last is not None:
        rows = rows.orderBy(F.desc("ts")).limit(keep_last)
    return metric_aggregate(rows, by)


def metric_aggregate(rows: DataFrame, by: Sequence = ()) -> DataFrame:
    t, p = F.col("y_true"), F.col("y_pred")
    hit, labelled = F.count_if(t == p), F.count(t)
    tp = F.count_if((t == 1) & (p == 1))
    return rows.groupBy(*by).agg(
        ratio(hit, labelled).alias("accuracy"), ratio(tp, F.count_if((p == 1) & t.isNotNull())).alias("precision"),
        ratio(tp, F.count_if(t == 1)).alias("recall"), F.count(F.lit(1)).alias("prediction_count"), labelled.alias("labeled_count"),
        F.avg("confidence").alias("avg_confidence"))


def day(ts: str) -> Column:
    return F.col(ts).cast("date")


def prediction_distribution(df: DataFrame, ts: str, label: str, confidence: str, edges: Sequence[float] = (0.5, 0.7, 0.9)) -> DataFrame:
    c = F.col(confidence)
    band = F.when(c < edges[0], "very_low").when(c < edges[1], "low").when(c < edges[2], "medium").otherwise("high")
    return df.groupBy(day(ts).alias("day"), F.col(label).alias("predicted"), band.alias("band")).agg(F.count(F.lit(1)).alias("n"))


def quality_over_time(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Null and outlier share per day, with the change from the day before."""
    look = bounds_lookup(iqr_bounds(df, [value]))
    b = look[value]
    daily = df.groupBy(day(ts).alias("day")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg(F.when(missing(df, value), 1.0).otherwise(0.0)).alias("null_share"),
        F.avg(F.when((F.col(value) < b["lower"]) | (F.col(value) > b["upper"]), 1.0).otherwise(0.0)).alias("outlier_share"))
    by_day = W.partitionBy(F.lit(0)).orderBy("day")  # one row per calendar day
    return daily.withColumn("null_share_change", F.col("null_share") - F.lag("null_share").over(by_day))


def schema_evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """Columns added, removed or retyped, with the rows of both loads."""
    spark = old.sparkSession
    a, b = dict(old.dtypes), dict(new.dtypes)
    rows = [(c, a.get(c), b.get(c), "removed" if c not in b else "added" if c not in a else "retyped" if a[c] != b[c] else "same")
            for c in [*a, *(x for x in b if x not in a)]]
    table = spark.createDataFrame(rows, "column_name string, old_type string, new_type string, change string")
    n_old, n_new = (d.agg(F.count(F.lit(1))).scalar() for d in (old, new))
    return table.select("*", n_old.alias("old_rows"), n_new.alias("new_rows"))


def drift_performance_link(df: DataFrame, drifted: str = "drift_detected", performance: str = "avg_performance") -> DataFrame:
    link = F.when(~F.col(drifted), "unknown").when(F.col(performance) < POOR_PERFORMANCE, "possible").otherwise("unlikely")
    return df.withColumn("drift_performance_correlation", link)


def integrated(drift_summary: DataFrame, degraded: DataFrame, actions: DataFrame, performance: DataFrame) -> DataFrame:
    """Per model: drift, degradation, priority, likely link, and whether both call for an alert."""
    d = drift_summary.select(F.struct("drift_detected", "severity", "overall_drift_score")).scalar()
    priority = actions.groupBy("model").agg(F.min_by("overall_priority", "position").alias("priority"))
    avg = performance.groupBy("model").agg(F.avg("value").alias("avg_performance"))
    out = (priority.join(avg, "model", "left").join(degraded.select("model", F.col("severity").alias("performance_severity")), "model", "left")
           .withColumns({"drift_detected": d["drift_detected"], "drift_severity": d["severity"], "overall_drift_score": d["overall_drift_score"]}))
    return drift_performance_link(out).withColumn("alert", F.col("drift_detected") & F.col("priority").isin("critical", "high"))


# ------------------------------------------------------------------ alerts

def alert_rules(metrics: DataFrame, rules: Sequence[tuple] = ALERT_RULES) -> DataFrame:
    """Rows of (…, metric, value) that break a rule (metric, operator, limit, severity, alert)."""
    table = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(o).alias("op"), F.lit(float(v)).alias("limit"), F.lit(s).alias("severity"), F.lit(t).alias("alert"))
                      for m, o, v, s, t in rules])
    mine = metrics.withColumn("_r", F.explode(F.filter(table, lambda r: r["m"] == F.col("metric"))))
    v, op, lim = F.col("value"), F.col("_r.op"), F.col("_r.limit")
    broken = ((op == "<") & (v < lim)) | ((op == "<=") & (v <= lim)) | ((op == ">") & (v > lim)) | ((op == ">=") & (v >= lim))
    return mine.where(broken).select(*metrics.columns, F.col("_r.limit").alias("limit"), F.col("_r.severity").alias("severity"),
                                     F.col("_r.alert").alias("alert"))


def sustained(df: DataFrame, key: str, ts: str, row_key: str, condition: Column, minutes: float) -> DataFrame:
    """Unbroken runs of rows meeting the condition that last at least ``minutes``.

    The number of failing rows seen so far names the run, so one running count
    finds all runs and the rest is an aggregate.
    """
    ok = F.coalesce(condition, F.lit(False))
    run = running(df.withColumn("_ok", ok), [key], [ts, row_key], sums={"_island": F.when(F.col("_ok"), 0).otherwise(1).cast("long")})
    g = run.where("_ok").groupBy(key, "_island").agg(F.min(ts).alias("started"), F.max(ts).alias("ended"), F.count(F.lit(1)).alias("rows"))
    lasted = (micros(F.col("ended")) - micros(F.col("started"))) / 60_000_000.0
    return g.withColumn("minutes", lasted).where(F.col("minutes") >= minutes).drop("_island")


def _next_due(slots: DataFrame, gap: int) -> DataFrame:
    """(_k, _slot, _next): per slot the first slot of the key at least ``gap`` later, if there is one.

    Slots and the times at which the next may follow are put in one descending
    order, which is cut by range: a key's slots may lie in any number of tasks.
    """
    asked = slots.select("_k", (-(F.col("_slot") + gap)).alias("_down"), F.lit(1).alias("_kind"), F.lit(None).cast("long").alias("_found"), F.col("_slot"))
    given = slots.select("_k", (-F.col("_slot")).alias("_down"), F.lit(0).alias("_kind"), F.col("_slot").alias("_found"), F.lit(None).cast("long").alias("_slot"))
    met = running(asked.unionAll(given), ["_k"], ["_down", "_kind"], lasts={"_next": F.col("_found")})
    return met.where("_kind = 1 and _next is not null").select("_k", "_slot", "_next")


def cooldown(alerts: DataFrame, keys: Sequence[str], ts: str, hours: float, grid_minutes: int,
             last_sent: DataFrame | None = None) -> DataFrame:
    """At most one alert per key within ``hours``, the earliest first.

    Alerts come from rules evaluated on a time grid, so those of one key and grid
    step are one alert. ``last_sent`` (keys, sent_at) carries on from an earlier run.

    Every slot points to the first one of its key that is far enough behind it.
    What is sent is what pointers reach from a key's first due slot: pointers of
    doubled length add as many slots as were reached before, so the rounds are the
    logarithm of the longest chain, and no key's slots ever meet in one task.
    """
    keys = list(keys)
    step, gap = grid_minutes * 60_000_000, int(hours * 3_600_000_000)
    name = F.to_json(F.struct(*keys)).alias("_k")  # null keys are keys as well
    slot = (F.floor(micros(F.col(ts)) / F.lit(step)) * step).cast("long")
    slots = stored(alerts.where(F.col(ts).isNotNull()).groupBy(*keys, slot.alias("_slot")).agg(F.count(F.lit(1)).alias("_n")).withColumn("_k", name), "slots")
    totals = slots.groupBy("_k").agg(*[F.first(k).alias(k) for k in keys], F.sum("_n").alias("raised"))
    first = slots
    if last_sent is not None:
        last = last_sent.groupBy(name).agg(F.max(micros(F.col("sent_at"))).alias("_last"))
        first = lookup_join(slots, last, ["_k"], "_slot").where(F.col("_last").isNull() | (F.col("_slot") >= F.col("_last") + gap))
    added = stored(first.groupBy("_k").agg(F.min("_slot").alias("_slot")), "sent")
    jump = stored(_next_due(slots, gap), "jumps")
    sent = added
    while not added.isEmpty():
        added = stored(sent.join(jump, ["_k", "_slot"]).select("_k", F.col("_next").alias("_slot")), "sent")
        sent = sent.unionAll(added)
        further = jump.select("_k", F.col("_slot").alias("_next"), F.col("_next").alias("_further"))
        jump = stored(jump.join(further, ["_k", "_next"]).select("_k", "_slot", F.col("_further").alias("_next")), "jumps")
    out = lookup_join(sent, totals, ["_k"], "_slot")
    return out.select(*keys, "raised", F.timestamp_micros("_slot").cast("timestamp_ntz").alias("sent_at"))


def alert_groups(alerts: DataFrame, name: str, ts: str) -> DataFrame:
    """One row per alert name and hour."""
    hour = F.date_trunc("hour", ts).cast("timestamp_ntz")
    return alerts.groupBy(name, hour.alias("hour")).agg(F.count(F.lit(1)).alias("alerts"), F.min(ts).alias("first_at"), F.max(ts).alias("last_at"))


# ------------------------------------------------------------------ requests and usage

def period_summary(checks: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Checks of the last days per model: drift and issue shares, mean samples, latest status."""
    rows = checks.where((F.col("ts") > at(as_of) - F.expr(f"interval {days} days")) & (F.col("ts") <= at(as_of)))
    n = F.count(F.lit(1))
    return rows.groupBy("model").agg(
        n.alias("checks"), (ratio(F.count_if("drift_detected"), n) * 100).alias("drift_percentage"),
        (ratio(F.count_if(F.col("priority").isin("critical", "high")), n) * 100).alias("issue_percentage"),
        F.avg("samples").alias("mean_samples"), F.max_by("priority", "ts").alias("latest_priority"), F.max("ts").alias("last_check"))


def model_usage(log: DataFrame, model: str, ts: str, failed: str, seconds: str) -> DataFrame:
    return log.groupBy(F.col(model).alias("model")).agg(
        F.count(F.lit(1)).alias("predictions"), F.count_if(F.col(failed)).alias("errors"), F.avg(seconds).alias("mean_seconds"),
        F.max(ts).alias("last_used"))


def request_stats(log: DataFrame, last: int = LAST_REQUESTS, slow: float = SLOW_SECONDS) -> DataFrame:
    """Per endpoint over its last requests. Each task keeps at most ``last`` rows per endpoint before the shuffle."""
    newest = W.partitionBy("endpoint").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = log.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= last)
    return rows.groupBy("endpoint").agg(
        F.count(F.lit(1)).alias("requests"), F.count_if("is_error").alias("errors"), F.avg("duration").alias("mean"),
        F.percentile("duration", F.lit(0.5)).alias("median"), F.min("duration").alias("min"), F.max("duration").alias("max"),
        F.count_if(F.col("duration") > slow).alias("slow"))


def sliding_counts(log: DataFrame, keys: Sequence[str], ts: str, measures: dict[str, Column], window_minutes: int, slide_minutes: int) -> DataFrame:
    """Sums per key and sliding window. Rows are first summed per slide step, then each step is added to its windows."""
    step = slide_minutes * 60_000_000
    bucket = (F.floor(micros(F.col(ts)) / F.lit(step)) * step).cast("long")
    steps = log.groupBy(*keys, bucket.alias("_b")).agg(*[F.sum(m).alias(n) for n, m in measures.items()])
    back = F.sequence(F.lit(0), F.lit(window_minutes // slide_minutes - 1))
    spread = steps.withColumn("_k", F.explode(back)).withColumn("_w", F.col("_b") - F.col("_k") * step)
    return spread.groupBy(*keys, F.timestamp_micros("_w").cast("timestamp_ntz").alias("window_start")).agg(
        *[F.sum(n).alias(n) for n in measures])


def error_rate(log: DataFrame, limit: float = ERROR_RATE, window_minutes: int = 5, slide_minutes: int = 1, keys: Sequence[str] = ()) -> DataFrame:
    w = sliding_counts(log, keys, "ts", {"requests": F.lit(1).cast("long"), "errors": F.when(F.col("is_error"), 1).otherwise(0).cast("long")},
                       window_minutes, slide_minutes)
    rate = ratio(F.col("errors"), F.col("requests"))
    return w.withColumn("error_rate", rate).where(F.col("error_rate") > limit)


def latency_quantiles(log: DataFrame, limit: float, by: str = "endpoint") -> DataFrame:
    q = quantiles(log, ["duration"], {"p95": 0.95, "p99": 0.99}, [by])
    return q.select(by, "n", "p95", "p99", (F.col("p95") > limit).alias("over_limit"))


def rate_anomalies(events: DataFrame, user: str, ts: str, row_key: str, minutes: int, limit: int) -> DataFrame:
    """Events at which a user had more than ``limit`` events in the trailing minutes."""
    counted = recent_count(events, user, ts, row_key, span=minutes * 60_000_000, name="recent")
    return counted.where(F.col("recent") > limit)


# The security rules, as (rule, severity, minutes, limit); without minutes the limit is one event's.
SECURITY = {"failed": ("Unauthorized Access Attempt", "high", 5, 5), "rate": ("Suspicious API Usage", "medium", 1, 1000),
            "bulk": ("Data Breach Indicator", "critical", None, 10_000), "role": ("Privilege Escalation", "critical", None, 0)}


def security_alerts(events: DataFrame, row_key: str, ts: str, user: str, address: str, failed: Column, records: Column, escalated: Column,
                    rules: dict[str, tuple] = SECURITY) -> DataFrame:
    """(row key, rule, severity, actor, observed): events at which a rule fires.

    More failed attempts of a user, or requests from an address, than the limit in the trailing minutes, reads of more records
    than the limit, and changes to a role with all rights. An event may break several rules. Unknown users and addresses break no rate rule; null conditions do not hold.
    """
    def row(df: DataFrame, kind: str, actor: str, observed: Column) -> DataFrame:
        rule, severity, *_ = rules[kind]
        return df.select(row_key, F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.col(actor).cast("string").alias("actor"),
                         observed.cast("long").alias("observed"))

    def trailing(df: DataFrame, kind: str, actor: str) -> DataFrame:
        known = df.where(F.col(actor).isNotNull()).select(row_key, ts, actor)
        return row(rate_anomalies(known, actor, ts, row_key, *rules[kind][2:]), kind, actor, F.col("recent"))

    bulk = row(events.where(records > rules["bulk"][3]), "bulk", user, records)
    role = row(events.where(escalated), "role", user, F.lit(1))
    return trailing(events.where(failed), "failed", user).unionAll(trailing(events, "rate", address)).unionAll(bulk).unionAll(role)


def volume(df: DataFrame, ts: str, unit: str, high: Column, duration: str, limit: float, saving: str | None = None) -> DataFrame:
    """Volume, high-risk share, SLA share and savings per day or month, with the growth over the period before."""
    aggs = [F.count(F.lit(1)).alias("volume"), F.avg(F.when(high, 1.0).otherwise(0.0)).alias("high_share"),
            F.avg(F.when(F.col(duration) <= limit, 1.0).otherwise(0.0)).alias("sla_share")]
    if saving:
        aggs.append(F.sum(saving).alias("savings"))
    g = df.groupBy(F.trunc(F.col(ts).cast("date"), "month").alias("period") if unit == "month" else day(ts).alias("period")).agg(*aggs)
    before = F.lag("volume").over(W.partitionBy(F.lit(0)).orderBy("period"))  # one row per period
    return g.withColumn("growth", ratio(F.col("volume") - before, before, None))
