"""Streams of claims, events and predictions.

Transformations take and return streaming DataFrames. Runners process what is
available and stop; in production the same query gets another trigger. Sinks
that write more than one table do so per micro-batch under the batch number, so
a repeated batch overwrites itself and nothing is written twice.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from veriloom.functions.columns import ratio, violated
from veriloom.functions.skew import lookup_join
from veriloom.operators import drift, features, monitor


def file_stream(spark: SparkSession, folder: str, schema: T.StructType, glob: str | None = None,
                files_per_batch: int | None = None, file_format: str = "parquet") -> DataFrame:
    reader = spark.readStream.schema(schema).format(file_format)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.load(folder)


def kafka_stream(spark: SparkSession, servers: str, topic: str, schema: T.StructType, **options) -> DataFrame:
    """JSON messages of a topic; needs the Kafka connector on the class path."""
    raw = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).options(**options).load()
    return raw.select(F.from_json(F.col("value").cast("string"), schema).alias("v")).select("v.*")


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def run_to_table(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Append what is available to a parquet table, exactly once per checkpoint."""
    q = (df.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q


def run_batches(df: DataFrame, fn: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append") -> StreamingQuery:
    q = df.writeStream.foreachBatch(fn).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def batch_path(root: str, batch: int) -> str:
    return f"{root}/batch={batch:010d}"


# ------------------------------------------------------------------ row-wise and deduplication

def quarantine_writer(rules: dict[str, Column], good: str, bad: str) -> Callable[[DataFrame, int], None]:
    """Splits each batch into rows that keep all rules and rows that do not."""
    def write(batch: DataFrame, number: int) -> None:
        marked = batch.withColumn("violations", violated(rules)).persist()
        try:
            marked.where(F.size("violations") == 0).drop("violations").write.mode("overwrite").parquet(batch_path(good, number))
            marked.where(F.size("violations") > 0).write.mode("overwrite").parquet(batch_path(bad, number))
        finally:
            marked.unpersist()
    return write


def deduplicate(df: DataFrame, ts: str, keys: Sequence[str], delay: str) -> DataFrame:
    return df.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


# ------------------------------------------------------------------ windows

def tumbling_metrics(df: DataFrame, ts: str, width: str, delay: str, by: Sequence[str] = ()) -> DataFrame:
    """Prediction metrics per window over (y_pred, y_true or null, confidence)."""
    out = monitor.metric_aggregate(df.withWatermark(ts, delay), [F.window(ts, width).alias("window"), *by])
    return out.select(F.col("window.start").alias("window_start"), *[c for c in out.columns if c != "window"])


def sliding_metrics(df: DataFrame, ts: str, width: str, slide: str, delay: str) -> DataFrame:
    """Metrics per sliding window. Rows are summed per slide step first; only steps enter the overlapping windows."""
    t, p = F.col("y_true"), F.col("y_pred")
    steps = df.withWatermark(ts, delay).groupBy(F.window(ts, slide).alias("step")).agg(
        F.count(F.lit(1)).alias("n"), F.count(t).alias("labelled"), F.count_if(t == p).alias("hit"), F.sum("confidence").alias("conf"))
    wide = steps.groupBy(F.window(F.window_time("step"), width, slide).alias("window")).agg(
        *[F.sum(c).alias(c) for c in ("n", "labelled", "hit", "conf")])
    return wide.select(F.col("window.start").alias("window_start"), F.col("n").alias("prediction_count"),
                       ratio(F.col("hit"), F.col("labelled")).alias("accuracy"), ratio(F.col("conf"), F.col("n")).alias("avg_confidence"))


def rate_alerts(df: DataFrame, ts: str, user: str, width: str, slide: str, delay: str, limit: int) -> DataFrame:
    """Users with more than ``limit`` events in a window; counted per slide step first."""
    steps = df.withWatermark(ts, delay).groupBy(user, F.window(ts, slide).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    wide = steps.groupBy(user, F.window(F.window_time("step"), width, slide).alias("window")).agg(F.sum("n").alias("n"))
    return wide.where(F.col("n") > limit).select(user, F.col("window.start").alias("window_start"), "n")


def late_writer(root: str, ts: str, width: str, delay: str) -> Callable[[DataFrame, int], None]:
    """Keeps the rows that come after their window has been closed, which a windowed query over the same batches leaves out.

    A batch is held against the newest time of the batches up to the one before
    the last, less the delay, as Spark does with late rows: the watermark that
    follows from a batch is the one by which the batch after the next is
    filtered. The state is one time per
    batch, of which a batch reads two. Late rows are under ``late``.
    """
    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        seen = [spark.read.parquet(batch_path(f"{root}/seen", n)).first()["seen"] if n >= 0 else None for n in (number - 2, number - 1)]
        late = F.lit(False) if seen[0] is None else F.window(ts, width)["end"] <= F.lit(seen[0]) - F.expr(f"interval {delay}")
        batch.persist()
        try:
            batch.where(late).write.mode("overwrite").parquet(batch_path(f"{root}/late", number))
            newest = batch.agg(F.max(ts)).first()[0]
        finally:
            batch.unpersist()
        times = [t for t in (seen[1], newest) if t is not None]
        spark.createDataFrame([(max(times, default=None),)], "seen timestamp").coalesce(1).write.mode("overwrite").parquet(
            batch_path(f"{root}/seen", number))
    return write


# ------------------------------------------------------------------ joins

def label_join(predictions: DataFrame, outcomes: DataFrame, key: str, delay: str, within: str) -> DataFrame:
    """Predictions (key, ts, …) with outcomes (key, outcome_ts, …) that arrive within a time; others stay without."""
    p = predictions.withWatermark("ts", delay)
    o = outcomes.withColumnRenamed(key, "_k").withWatermark("outcome_ts", delay)
    on = (F.col(key) == F.col("_k")) & (F.col("outcome_ts") >= F.col("ts")) & (F.col("outcome_ts") <= F.col("ts") + F.expr(f"interval {within}"))
    return p.join(o, on, "left_outer").drop("_k")


# ------------------------------------------------------------------ micro-batches that call batch operators

def _names(spark: SparkSession, path: str) -> list[str]:
    """Names below a folder; none if it does not exist."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return sorted(s.getPath().getName() for s in fs.listStatus(folder)) if fs.exists(folder) else []


def _remove(spark: SparkSession, path: str) -> None:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _numbers(names: Sequence[str], kind: str) -> list[int]:
    return sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}="))


class DayStore:
    """Rows by day: a compacted base and the deltas of later batches, each a folder that is read by its path.

    A base under number n holds all batches up to n. A batch that runs again
    overwrites its deltas and reads no base of its own number or later.
    """

    def __init__(self, root: str, deltas: int = 8):
        self.root, self.deltas = root, deltas

    def add(self, rows: DataFrame, number: int) -> None:
        """``rows`` with a column ``day``; only the days it has are written."""
        (rows.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("day", "batch").parquet(self.root))

    def days(self, spark: SparkSession) -> set[str]:
        return {n.partition("=")[2] for n in _names(spark, self.root) if n.startswith("day=")}

    def paths(self, spark: SparkSession, day: str, number: int) -> list[str]:
        """The newest base before a batch, and the deltas after it up to that batch."""
        names = _names(spark, f"{self.root}/day={day}")
        base = max((n for n in _numbers(names, "base") if n < number), default=-1)
        deltas = [f"{self.root}/day={day}/batch={n}" for n in _numbers(names, "batch") if base < n <= number]
        return ([f"{self.root}/day={day}/base={base}"] if base >= 0 else []) + deltas

    def compact(self, spark: SparkSession, schema: T.StructType, day: str, number: int) -> None:
        """Many deltas become a base; what the base before it had replaced goes."""
        paths = self.paths(spark, day, number)
        if len(paths) <= self.deltas:
            return
        spark.read.schema(schema).parquet(*paths).write.mode("overwrite").parquet(f"{self.root}/day={day}/base={number}")
        names = _names(spark, f"{self.root}/day={day}")
        before = max((n for n in _numbers(names, "base") if n < number), default=-1)
        for kind, last in (("batch", before), ("base", before - 1)):
            for n in _numbers(names, kind):
                if n <= last:
                    _remove(spark, f"{self.root}/day={day}/{kind}={n}")


def recent_count_writer(root: str, key: str, ts: str, row_key: str, days: int = 30, deltas: int = 8) -> Callable[[DataFrame, int], None]:
    """Trailing counts of new rows, and corrected counts of stored rows that late ones fall into the window of.

    A batch touches some days. Rows from ``days`` before to ``days`` after them are
    opened, by path, and of these only the keys of the batch are counted again, by
    the batch operator, which has no per-key task. Results go to the batch's number;
    ``latest_counts`` takes the newest of each row. Rows without key or time have no count.
    """
    rows_of = DayStore(f"{root}/rows", deltas)

    def write(batch: DataFrame, number: int) -> None:
        spark, counts = batch.sparkSession, batch_path(f"{root}/counts", number)
        rows = batch.select(key, ts, row_key)
        dated = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("day", F.col(ts).cast("date").cast("string"))
        rows_of.add(dated, number)
        have = rows_of.days(spark)
        touched = [date.fromisoformat(d) for d in have if any(p.endswith(f"/batch={number}") for p in rows_of.paths(spark, d, number))]
        near = {str(d + timedelta(days=i)) for d in touched for i in range(-days, days + 1)} & have
        later = sorted({str(d + timedelta(days=i)) for d in touched for i in range(days + 1)} & have)
        uncounted = rows.where(F.col(key).isNull() | F.col(ts).isNull()).withColumn("recent_claims_count", F.lit(None).cast("long"))
        if not touched:
            uncounted.write.mode("overwrite").parquet(counts)
            return
        stored_rows = spark.read.schema(rows.schema).parquet(*[p for d in sorted(near) for p in rows_of.paths(spark, d, number)])
        mine = lookup_join(stored_rows, dated.select(key).distinct(), [key], row_key, how="left_semi")
        counted = features.recent_count(mine, key, ts, row_key, days * features.DAY_MICROS).where(F.col(ts).cast("date").cast("string").isin(later))
        counted.select(*uncounted.columns).unionByName(uncounted).write.mode("overwrite").parquet(counts)
        for day in sorted(str(d) for d in touched):
            rows_of.compact(spark, rows.schema, day, number)
    return write


def latest_counts(spark: SparkSession, root: str, row_key: str) -> DataFrame:
    """(row_key, recent_claims_count) as of the newest batch that counted the row; a row without id stands for itself."""
    found = spark.read.parquet(f"{root}/counts")
    return found.groupBy(row_key).agg(F.max_by("recent_claims_count", F.col("batch").cast("long")).alias("recent_claims_count"))


def drift_writer(reference: DataFrame, root: str, **features_by_type) -> Callable[[DataFrame, int], None]:
    """Drift report of each batch against the reference."""
    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            drift.report(reference, kept, **features_by_type).write.mode("overwrite").parquet(batch_path(root, number))
        finally:
            kept.unpersist()
    return write


def cooldown_writer(root: str, keys: Sequence[str], ts: str, hours: float, grid_minutes: int,
                    forget_hours: float | None = None) -> Callable[[DataFrame, int], None]:
    """Alerts of each batch that are due, given when each key was last served.

    The state is a table with one time per key, a new one per batch; a batch reads
    the one before it and no alert of an earlier batch. With ``forget_hours`` a key
    leaves the state that long before the newest alert; older alerts are then too late and not sent.
    """
    schema_keys = list(keys)

    def write(batch: DataFrame, number: int) -> None:
        spark, state = batch.sparkSession, f"{root}/state"
        before = spark.read.parquet(batch_path(state, number - 1)) if number > 0 else None
        alerts = batch
        newest = batch.agg(F.max(ts).cast("timestamp_ntz").alias("t")).first()["t"]
        if before is not None:
            seen = before.agg(F.max("newest").alias("t")).first()["t"]
            newest = max([t for t in (newest, seen) if t is not None], default=None)
        oldest = newest - timedelta(hours=forget_hours) if forget_hours is not None and newest is not None else None
        if oldest is not None:
            alerts = batch.where(F.col(ts).cast("timestamp_ntz") >= F.lit(oldest))
        due = monitor.cooldown(alerts, schema_keys, ts, hours, grid_minutes, before.drop("newest") if before is not None else None)
        due.write.mode("overwrite").parquet(f"{root}/sent/batch={number:010d}")
        sent = spark.read.schema(due.schema).parquet(f"{root}/sent/batch={number:010d}").select(*schema_keys, "sent_at")
        held = (sent if before is None else sent.unionByName(before.drop("newest"))).groupBy(*schema_keys).agg(F.max("sent_at").alias("sent_at"))
        if oldest is not None:
            held = held.where(F.col("sent_at") >= F.lit(oldest - timedelta(hours=hours)))
        held.withColumn("newest", F.lit(newest).cast("timestamp_ntz")).write.mode("overwrite").parquet(batch_path(state, number))
        if number > 1:
            _remove(spark, batch_path(state, number - 2))
    return write
