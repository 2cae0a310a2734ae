"""Queries over Structured Streaming; each has a batch equivalent in SQL where one exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from veriloom.plans import profiles as P
from veriloom.plans.registry import query
from veriloom.plans.watch import CAT, KS, NEW, REF, _psi_sql
from veriloom.session import scratch_path
from veriloom.streaming import streams as S

DELAY = "1 hour"
# Windows are complete once the watermark, one hour behind the newest event, has passed their end.
CLOSED = "(select date_trunc('millisecond', max(ts)) - interval 1 hour from events)"


def _stream(spark, sf, **options):
    return S.event_time(S.file_stream(spark, sf, P.events(spark, sf).schema, glob="events.parquet", **options))


def _ntz(df, *names):
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in names})


def _table(spark, df, name, mode="append"):
    path = scratch_path(spark, name)
    S.run_to_table(df, path, scratch_path(spark, f"{name}-ckpt"), mode)
    return spark.read.parquet(path)


def _scored(df):
    """Events as predictions: label known for two thirds of them."""
    return df.select("event_id", "ts", "user_id", F.when(F.col("value") > 10, 1).otherwise(0).alias("y_pred"),
                     F.when(F.col("event_id") % 3 != 0, F.when(F.col("user_id") % 2 == 0, 1).otherwise(0)).alias("y_true"),
                     (F.lit(0.5) + (F.col("event_id") % 50) / 100.0).cast("double").alias("confidence"))


SCORED = """(select event_id, ts, user_id, (value > 10)::int as y_pred, case when event_id % 3 <> 0 then (user_id % 2 = 0)::int end as y_true,
    (0.5 + (event_id % 50) / 100.0)::double as confidence from events)"""


@query("st_source", "select event_id, ts, user_id, event_type, value, props from events")
def _(spark, sf):
    return _ntz(_table(spark, _stream(spark, sf), "st_source"), "ts")


@query("st_incremental_load", f"select event_id, value, case when ts < timestamp '{P.SPLIT_TS}' then 1 else 2 end as run from events")
def _(spark, sf):
    """Files arrive between two runs; the second one takes those alone, a third finds nothing."""
    root, path, ckpt, ev = *(scratch_path(spark, n) for n in ("st_inc_in", "st_inc", "st_inc-ckpt")), P.events(spark, sf)
    split = F.lit(P.SPLIT_TS).cast("timestamp_ntz")
    for run, part in enumerate((ev.where(F.col("ts") < split), ev.where(F.col("ts") >= split), None), 1):
        if part is not None:
            part.write.mode("append").parquet(root)
        S.run_to_table(S.file_stream(spark, root, ev.schema).select("event_id", "value", F.lit(run).alias("run")), path, ckpt)
    return spark.read.parquet(path)


@query("st_validate_quarantine", """
    select event_id, array_to_string(list_filter([case when value <= 5 then 'value' end, case when event_type = 'error' then 'event_type' end],
      lambda x: x is not null), ',') as violations from events""")
def _(spark, sf):
    good, bad = scratch_path(spark, "st_good"), scratch_path(spark, "st_bad")
    rules = {"value": F.col("value") > 5, "event_type": F.col("event_type") != "error"}
    S.run_batches(_stream(spark, sf), S.quarantine_writer(rules, good, bad), scratch_path(spark, "st_quarantine-ckpt"))
    kept = spark.read.parquet(good).select("event_id", F.lit("").alias("violations"))
    return kept.unionAll(spark.read.parquet(bad).select("event_id", F.array_join("violations", ",")))


@query("st_dedup", "select event_id, user_id, value, 1 as copy from events")
def _(spark, sf):
    """Every event comes again in a later micro-batch, within the watermark's delay; the state store has to know it."""
    root, ev = scratch_path(spark, "st_dedup_in"), P.events(spark, sf)
    for copy in (1, 2):
        ev.withColumn("copy", F.lit(copy)).coalesce(1).write.mode("append").parquet(root)
    schema = spark.read.parquet(root).schema
    twice = S.event_time(S.file_stream(spark, root, schema, files_per_batch=1))
    return _table(spark, S.deduplicate(twice, "ts", ["event_id"], "60 days").select("event_id", "user_id", "value", "copy"), "st_dedup")


@query("st_tumbling_metrics", f"""
    select date_trunc('hour', ts) as window_start, coalesce(round(count(*) filter (where y_true = y_pred)::double / nullif(count(y_true), 0), 6), 0)::double as accuracy,
      count(*) as prediction_count, count(y_true) as labeled_count, round(avg(confidence), 6) as avg_confidence
    from {SCORED} s group by 1 having date_trunc('hour', min(ts)) + interval 1 hour <= {CLOSED}""")
def _(spark, sf):
    out = _table(spark, S.tumbling_metrics(_scored(_stream(spark, sf)), "ts", "1 hour", DELAY), "st_tumbling")
    return _ntz(out, "window_start").select("window_start", F.round("accuracy", 6).alias("accuracy"), "prediction_count", "labeled_count",
                                            F.round("avg_confidence", 6).alias("avg_confidence"))


@query("st_sliding_metrics", f"""
    with w as (select date_trunc('hour', ts) - k * interval 1 hour as window_start, s.* from {SCORED} s, range(24) r(k))
    select window_start, count(*) as prediction_count, coalesce(round(count(*) filter (where y_true = y_pred)::double / nullif(count(y_true), 0), 6), 0)::double as accuracy,
      round(sum(confidence) / count(*), 9) as avg_confidence from w group by 1 having window_start + interval 24 hours <= {CLOSED}""")
def _(spark, sf):
    out = _table(spark, S.sliding_metrics(_scored(_stream(spark, sf)), "ts", "24 hours", "1 hour", DELAY), "st_sliding")
    return _ntz(out, "window_start").withColumns({"accuracy": F.round("accuracy", 6), "avg_confidence": F.round("avg_confidence", 9)})


@query("st_rate_alert", f"""
    with w as (select user_id, time_bucket(interval 10 minutes, ts) - k * interval 10 minutes as window_start from events, range(6) r(k))
    select user_id, window_start, count(*) as n from w group by 1, 2 having count(*) > 1 and window_start + interval 1 hour <= {CLOSED}""")
def _(spark, sf):
    out = S.rate_alerts(_stream(spark, sf), "ts", "user_id", "1 hour", "10 minutes", DELAY, 1)
    return _ntz(_table(spark, out, "st_rate"), "window_start")


@query("st_label_join", """
    with p as (select event_id // 2 as id, ts from events where event_id % 2 = 0), o as (select event_id // 2 as id, ts as outcome_ts, event_type as outcome from events where event_id % 2 = 1 and event_id % 3 <> 0)
    select p.id, p.ts, o.outcome from p left join o on p.id = o.id and outcome_ts >= ts and outcome_ts <= ts + interval 4 minutes""")
def _(spark, sf):
    """A late pair of events moves the watermark past all others, so every prediction comes out."""
    root = scratch_path(spark, "st_label_in")
    P.events(spark, sf).write.parquet(root)
    _closing(spark, sf).write.mode("append").parquet(root)
    ev = S.event_time(S.file_stream(spark, root, P.events(spark, sf).schema))
    half = F.floor(F.col("event_id") / 2).alias("id")
    p = ev.where("event_id % 2 = 0").select(half, "ts")
    o = ev.where("event_id % 2 <> 0 and event_id % 3 <> 0").select(half, F.col("ts").alias("outcome_ts"), F.col("event_type").alias("outcome"))
    out = _ntz(_table(spark, S.label_join(p, o, "id", DELAY, "4 minutes"), "st_label"), "ts")
    return out.where("id >= 0").select("id", "ts", "outcome")


REFERENCE_END = "2024-01-08"
STEPS = (("2000-01-01", "2024-01-08"), ("2024-01-08", "2024-01-16"), ("2024-01-16", "2024-01-24"), ("2024-01-24", "2100-01-01"))


def _closing(spark, sf):
    """Two events two days after all others, which close every window and join before them."""
    ev = P.events(spark, sf)
    last = ev.agg((F.max("ts") + F.expr("interval 2 days")).alias("ts")).withColumn("event_id", F.explode(F.array(F.lit(-2), F.lit(-1))))
    return last.select(*[F.col(f.name).cast(f.dataType) if f.name in ("ts", "event_id") else F.lit(None).cast(f.dataType).alias(f.name) for f in ev.schema])


def _event_files(spark, sf, name, steps=STEPS, closing=False):
    """The events written in steps of time and streamed in about as many batches."""
    root, ev = scratch_path(spark, name), P.events(spark, sf)
    for a, b in steps:
        part = ev.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz")))
        part.write.mode("append").parquet(root)
    if closing:
        _closing(spark, sf).coalesce(1).write.mode("append").parquet(root)
    files = len(spark.read.parquet(root).inputFiles())
    return S.event_time(S.file_stream(spark, root, ev.schema, files_per_batch=-(-files // (len(steps) + closing))))


def _steps(spark, sf, name, steps=STEPS):
    """The stream of the events after each step of time has been written; a run of it finds that step's files alone."""
    root, ev = scratch_path(spark, name), P.events(spark, sf)
    for a, b in steps:
        ev.where((F.col("ts") >= F.lit(a).cast("timestamp_ntz")) & (F.col("ts") < F.lit(b).cast("timestamp_ntz"))).write.mode("append").parquet(root)
        yield S.event_time(S.file_stream(spark, root, ev.schema))


@query("st_recent_count", """
    select event_id, count(*) over (partition by user_id order by ts range between interval '6 days 23 hours 59 minutes 59.999999 seconds' preceding and current row)
      as recent_claims_count from events""")
def _(spark, sf):
    root = scratch_path(spark, "st_recent")
    writer = S.recent_count_writer(root, "user_id", "ts", "event_id", days=7)
    S.run_batches(_event_files(spark, sf, "st_recent_in"), writer, scratch_path(spark, "st_recent-ckpt"))
    return S.latest_counts(spark, root, "event_id")


@query("st_recent_count_late", """
    select event_id, count(*) over (partition by user_id order by ts range between interval '6 days 23 hours 59 minutes 59.999999 seconds' preceding and current row)
      as recent_claims_count from events""")
def _(spark, sf):
    """The newest events come first, so later files correct the counts of stored rows."""
    root = scratch_path(spark, "st_recent_late")
    writer = S.recent_count_writer(root, "user_id", "ts", "event_id", days=7, deltas=2)
    S.run_batches(_event_files(spark, sf, "st_recent_late_in", STEPS[::-1]), writer, scratch_path(spark, "st_recent_late-ckpt"))
    return S.latest_counts(spark, root, "event_id")


def _step_drift_sql(number: int, start: str, end: str) -> str:
    """The drift of one step against the reference, by the statements of the drift report on both sides put together."""
    ctes = f"{KS}, {_psi_sql(20, '1e-10')}, {CAT}".replace(REF, "is_ref").replace(NEW, "not is_ref").replace("from events", "from sides")
    return f"""select * from (with sides as (select *, true as is_ref from events where ts < timestamp '{REFERENCE_END}'
        union all select *, false from events where ts >= timestamp '{start}' and ts < timestamp '{end}'), {ctes}
      select {number} as batch, 'value' as feature, 'numerical' as feature_type, greatest(1 - p, psi / 0.2) as s, p < 0.05 or psi > 0.2 as drift_detected from kp, ps
      union all select {number}, 'event_type', 'categorical', greatest(1 - exp(-x / 2) * (1 + x / 2), psi / 0.2), exp(-x / 2) * (1 + x / 2) < 0.05 or psi > 0.2 from cx)"""


@query("st_drift_microbatch", "select batch::int as batch, feature, feature_type, round(s, 5) as drift_score, drift_detected, null::varchar as error from ("
       + " union all ".join(_step_drift_sql(i, *step) for i, step in enumerate(STEPS)) + ") d")
def _(spark, sf):
    """Each step of time is one batch, in however many files it comes."""
    root, ckpt = scratch_path(spark, "st_drift"), scratch_path(spark, "st_drift-ckpt")
    reference = P.events(spark, sf).where(F.col("ts") < F.lit(REFERENCE_END).cast("timestamp_ntz"))
    writer = S.drift_writer(reference, root, numerical=["value"], categorical=["event_type"])
    for stream in _steps(spark, sf, "st_drift_in"):
        S.run_batches(stream, writer, ckpt)
    return spark.read.parquet(root).select("batch", "feature", "feature_type", F.round("drift_score", 5).alias("drift_score"), "drift_detected", "error")


@query("st_alert_cooldown", """
    with recursive s as (select distinct event_type, time_bucket(interval 15 minutes, ts) as slot from events where value > 20),
    f as (select event_type, min(slot) as sent_at from s group by 1
      union all select f.event_type, (select min(slot) from s where s.event_type = f.event_type and s.slot >= f.sent_at + interval 24 hours) from f
        where exists (select 1 from s where s.event_type = f.event_type and s.slot >= f.sent_at + interval 24 hours))
    select event_type, sent_at from f""")
def _(spark, sf):
    root = scratch_path(spark, "st_cooldown")
    alerts = _event_files(spark, sf, "st_cooldown_in").where("value > 20")
    S.run_batches(alerts, S.cooldown_writer(root, ["event_type"], "ts", 24, 15), scratch_path(spark, "st_cooldown-ckpt"))
    return spark.read.parquet(f"{root}/sent").select("event_type", "sent_at")


@query("st_late_data", f"""
    select date_trunc('day', ts)::timestamp as day, count(*) as n, (select count(*) from events where ts < timestamp '{P.SPLIT_TS}') as dropped
    from events where ts >= timestamp '{P.SPLIT_TS}' group by 1""")
def _(spark, sf):
    """The newer half arrives first, so the older half is late: its rows are in no window and are found by the watermark of their batch."""
    late_last = (*STEPS[2:], ("2000-01-01", P.SPLIT_TS))
    stream = _event_files(spark, sf, "st_late_in", late_last, closing=True)
    counts = stream.withWatermark("ts", DELAY).groupBy(F.window("ts", "1 day").alias("window")).agg(F.count("*").alias("n"))
    path, late = scratch_path(spark, "st_late"), scratch_path(spark, "st_late_rows")
    S.run_to_table(counts.select(F.col("window.start").alias("day"), "n"), path, scratch_path(spark, "st_late-ckpt"))
    S.run_batches(stream, S.late_writer(late, "ts", "1 day", DELAY), scratch_path(spark, "st_late_rows-ckpt"))
    dropped = spark.read.parquet(f"{late}/late").agg(F.count("*")).scalar()
    return _ntz(spark.read.parquet(path), "day").withColumn("dropped", dropped)
