"""Profiles that add up: every load is profiled once, and the profile of all loads is merged from the parts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veriloom.functions.columns import ratio

#: The feature under which whole rows are counted.
ROW = "*"
#: Size parameter of the quantile sketches; at 400 the rank error is below 0.7 % with 99 % confidence.
SKETCH_SIZE = 400


def _known(df: DataFrame, c: str) -> Column:
    """The value of a column; NaN is missing, -0.0 is 0.0."""
    if isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType)):
        return F.when(~F.isnan(F.col(f"`{c}`")), F.col(f"`{c}`") + F.lit(0.0))
    return F.col(f"`{c}`")


def _digest(df: DataFrame, c: str) -> Column:
    """128 bits of a value, null if it is missing."""
    kind = df.schema[c].dataType
    value = _known(df, c)
    if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
        value = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
    return F.unhex(F.md5(value if isinstance(kind, T.BinaryType) else value.cast("string")))


def row_digest(df: DataFrame, columns: Sequence[str] | None = None) -> Column:
    """128 bits of a whole row. Missing values are equal to each other and to nothing else; values carry their lengths, so none runs into the next."""
    parts = []
    for c in columns or df.columns:
        kind, value = df.schema[c].dataType, _known(df, c)
        if isinstance(kind, (T.ArrayType, T.StructType, T.MapType)):
            value = F.when(value.isNotNull(), F.to_json(F.struct(value.alias("v"))))
        text = F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.md5(F.concat(*parts)))


def summaries(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """One row per column with what can be merged: counts, moments, ends, lengths, and sketches of quantiles and distinct values.

    One aggregate over ``df``. Numbers have moments, ends and a quantile sketch, strings have lengths; the rest is null.
    """
    columns = list(columns or df.columns)
    aggs, rows = [F.count(F.lit(1)).alias("rows")], []
    for i, c in enumerate(columns):
        kind, v = df.schema[c].dataType, _known(df, c)
        number = v.cast("double") if isinstance(kind, T.NumericType) else F.lit(None).cast("double")
        length = F.length(v) if isinstance(kind, T.StringType) else F.lit(None).cast("int")
        # a column without numbers has no sketch
        sketch = F.kll_sketch_agg_double(number, SKETCH_SIZE) if isinstance(kind, T.NumericType) else F.max(F.lit(None).cast("binary"))
        measures = {"n": F.count(v), "mean": F.avg(number), "m2": F.var_pop(number) * F.count(number), "low": F.min(number), "high": F.max(number),
                    "chars": F.sum(length.cast("long")), "shortest": F.min(length), "longest": F.max(length), "sketch": sketch,
                    "distinct_sketch": F.hll_sketch_agg(F.coalesce(_digest(df, c), F.lit(b"")))}
        aggs += [e.alias(f"a{i}_{m}") for m, e in measures.items()]
        rows.append(F.struct(F.lit(c).alias("feature"), F.lit(kind.simpleString()).alias("type"), F.col("rows"),
                             *[F.col(f"a{i}_{m}").alias(m) for m in measures]))
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def value_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(feature, digest, n): how often each value of each column occurs, and, as feature ``*``, each row of these columns.

    Values travel as 128-bit digests, so a text is never a shuffle key, and are
    counted in the tasks first. Two values are taken for one only if their digests are equal.
    """
    columns = list(columns or df.columns)
    parts = df.select(*[_digest(df, c).alias(f"d{i}") for i, c in enumerate(columns)])
    digests = [F.col(f"d{i}") for i in range(len(columns))]
    row = F.unhex(F.md5(F.concat(*[F.coalesce(d, F.lit(b"\0")) for d in digests])))
    entries = F.array(*[F.struct(F.lit(c).alias("feature"), d.alias("digest")) for c, d in zip(columns, digests)],
                      F.struct(F.lit(ROW).alias("feature"), row.alias("digest")))
    return (parts.select(F.inline(F.filter(entries, lambda e: e["digest"].isNotNull())))
            .groupBy("feature", "digest").agg(F.count(F.lit(1)).alias("n")))


class ProfileStore:
    """The profile parts of a table below ``root``. A part is written under its name; written again, it is replaced."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def add(self, part: str, df: DataFrame, columns: Sequence[str] | None = None, exact: bool = True) -> None:
        """Profiles a load. Without ``exact`` no values are counted, and distinct values are known from sketches only."""
        summaries(df, columns).write.mode("overwrite").parquet(f"{self.root}/summaries/part={part}")
        if exact:
            value_counts(df, columns).write.mode("overwrite").parquet(f"{self.root}/values/part={part}")

    def values(self) -> DataFrame:
        """(feature, digest, n) over all parts."""
        return self.spark.read.parquet(f"{self.root}/values").groupBy("feature", "digest").agg(F.sum("n").alias("n"))

    def profile(self, exact: bool = True) -> DataFrame:
        """One row per column: type, rows, missing, distinct and once-only values, estimated distinct, mean, std, min, max, quartiles, lengths.

        Moments are merged about the common mean. Quartiles come from sketches
        (rank error below 0.7 %), the rest is exact but for ``distinct_estimate``. Types that differ between parts are joined by a bar.
        """
        parts = self.spark.read.parquet(f"{self.root}/summaries")
        numbers = F.when(F.col("mean").isNotNull(), F.col("n"))
        means = parts.groupBy("feature").agg(ratio(F.sum(F.col("mean") * numbers), F.sum(numbers), None).alias("_mean"))
        deviation = F.col("m2") + numbers * F.pow(F.col("mean") - F.col("_mean"), F.lit(2.0))
        merged = parts.join(F.broadcast(means), "feature").groupBy("feature").agg(  # one row per column
            F.array_join(F.sort_array(F.collect_set("type")), "|").alias("type"), F.sum("rows").alias("rows"), F.sum(F.col("rows") - F.col("n")).alias("missing"),
            F.hll_sketch_estimate(F.hll_union_agg("distinct_sketch")).alias("_estimate"), F.first("_mean").alias("mean"),
            F.sqrt(ratio(F.sum(deviation), F.sum(numbers) - 1, None)).alias("std"), F.min("low").alias("min"), F.max("high").alias("max"),
            F.kll_merge_agg_double("sketch").alias("_sketch"), (F.sum("chars") / F.sum(F.when(F.col("chars").isNotNull(), F.col("n")))).alias("avg_length"),
            F.min("shortest").alias("min_length"), F.max("longest").alias("max_length"))
        quartiles = {f"q{int(100 * q)}": F.when(F.col("min").isNotNull(), F.kll_sketch_get_quantile_double("_sketch", F.lit(q))) for q in (0.25, 0.5, 0.75)}
        # missing values are one entry of the sketch
        out = merged.withColumns({"distinct_estimate": F.col("_estimate") - F.when(F.col("missing") > 0, 1).otherwise(0), **quartiles}).drop("_sketch", "_estimate")
        if not exact:
            return out
        counts = self.values().where(F.col("feature") != ROW).groupBy("feature").agg(
            F.count(F.lit(1)).alias("distinct_values"), F.count_if(F.col("n") == 1).alias("once"))
        return out.join(F.broadcast(counts), "feature", "left").fillna(0, ["distinct_values", "once"])  # one row per column

    def duplicates(self) -> DataFrame:
        """rows, distinct_rows, and duplicate_rows beyond the first of each, over all parts."""
        return self.values().where(F.col("feature") == ROW).agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_rows"),
            F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))
