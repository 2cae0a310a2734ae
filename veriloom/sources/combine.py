"""Choosing, filtering and combining sources."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.functions.columns import all_of, col


@dataclass(frozen=True)
class SourceSpec:
    """A named source; ``load`` builds its lazy DataFrame."""

    name: str
    load: Callable[[SparkSession], DataFrame]
    kind: str = "files"
    enabled: bool = True
    priority: int = 1
    metadata: dict = field(default_factory=dict)


def load_sources(spark: SparkSession, specs: Sequence[SourceSpec], names: Sequence[str] | None = None,
                 filters: dict | None = None) -> dict[str, DataFrame]:
    """The enabled sources among ``names``, each with the filters applied."""
    chosen = [s for s in specs if s.enabled and (names is None or s.name in names)]
    return {s.name: apply_filters(s.load(spark), filters or {}) for s in chosen}


def combine(spark: SparkSession, frames: dict[str, DataFrame], schema=None) -> DataFrame:
    """Union by column name; ``_data_source`` is added when there is more than one source."""
    if not frames:
        return spark.createDataFrame([], schema or "value string")
    if len(frames) == 1:
        return next(iter(frames.values()))
    tagged = [df.withColumn("_data_source", F.lit(name)) for name, df in frames.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def apply_filters(df: DataFrame, filters: dict) -> DataFrame:
    """Scalar means equality, a list means membership, unknown columns are ignored."""
    conditions = [F.col(c).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(c) == v
                  for c, v in filters.items() if c in df.columns]
    return df.where(all_of(conditions))


def between(df: DataFrame, column: str, start=None, end=None) -> DataFrame:
    """Closed range; an open end is left out."""
    conditions = ([F.col(column) >= F.lit(start)] if start is not None else []) + \
                 ([F.col(column) <= F.lit(end)] if end is not None else [])
    return df.where(all_of(conditions))


def select_claims(df: DataFrame, columns: Sequence[str], date: str, key: str, start=None, end=None,
                  status: str | None = None, statuses: Sequence[str] | None = None,
                  limit: int | None = None) -> DataFrame:
    """Projection with optional date range, status list, and newest-first limit."""
    out = between(df.select(*columns), date, start, end)
    if statuses:
        out = out.where(F.col(status).isin(list(statuses)))
    out = out.orderBy(F.desc(date), F.asc(key))
    return out if limit is None else out.limit(limit)


def query_with_filters(spark: SparkSession, query: str, args: dict | None = None, date: str | None = None,
                       start=None, end=None, filters: dict | None = None) -> DataFrame:
    """A user's query as a sub-query; ranges and filters are added as predicates, not as text."""
    df = spark.sql(query, args=args or {})
    if date is not None:
        df = between(df, date, start, end)
    return apply_filters(df, filters or {})


def since(df: DataFrame, ts: str, mark: Column, now: Column | None = None) -> DataFrame:
    """Rows in (mark, now]: a row on the mark was loaded by the run that set it."""
    out = df.where(F.col(ts) > mark)
    return out if now is None else out.where(F.col(ts) <= now)


def high_water_mark(loaded: DataFrame, ts: str) -> Column:
    """Largest loaded timestamp as a scalar sub-query."""
    return loaded.agg(F.max(ts)).scalar()


def with_history(new: DataFrame, history: DataFrame, date: str, as_of: str, months: int = 24) -> DataFrame:
    """New rows and the last ``months`` of history."""
    cutoff = F.add_months(F.lit(as_of).cast("date"), -months)
    return new.unionByName(history.where(F.col(date) >= cutoff), allowMissingColumns=True)


def health(spark: SparkSession, specs: Sequence[SourceSpec]) -> DataFrame:
    """Per source: is it enabled and does it hold a row. Reads at most one row of each."""
    def one(s: SourceSpec) -> DataFrame:
        return (s.load(spark).limit(1).agg((F.count(F.lit(1)) > 0).alias("has_rows"))
                .select(F.lit(s.name).alias("source"), F.lit(s.enabled).alias("enabled"),
                        (F.lit(s.enabled) & col("has_rows")).alias("healthy")))
    return reduce(DataFrame.unionAll, [one(s) for s in specs])


def table_schema(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullable, and how many rows have a value."""
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns])
    long = counts.unpivot([], df.columns, "column_name", "non_null")
    kinds = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.dataType.simpleString())])
    nullable = F.create_map(*[F.lit(x) for f in df.schema for x in (f.name, f.nullable)])
    place = F.array_position(F.array(*[F.lit(c) for c in df.columns]), F.col("column_name"))
    return long.select(place.cast("int").alias("position"), "column_name",
                       kinds[F.col("column_name")].alias("data_type"),
                       nullable[F.col("column_name")].alias("nullable"), "non_null")
