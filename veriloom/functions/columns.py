"""Column expressions used by several operators."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER_PATTERN = r"^\s*[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?\s*$"


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def missing(df: DataFrame, name: str) -> Column:
    """Null, or NaN where the type has it."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.col(name).isNull() | F.isnan(name)
    return F.col(name).isNull()


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]


def string_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, T.StringType)]


def ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    """a / b as double, ``default`` where b is zero or null."""
    q = F.try_divide(a.cast("double"), b.cast("double"))
    return q if default is None else F.coalesce(q, F.lit(float(default)))


def at_least_one(c: Column) -> Column:
    """Values below one become one; null stays null."""
    return F.when(c < 1, 1).otherwise(c)


def right_closed_bin(value: Column, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (lo, hi] holding ``value``; null outside all of them."""
    out = None
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        inside = (value > lo) if hi == float("inf") else (value > lo) & (value <= hi)
        out = F.when(inside, label) if out is None else out.when(inside, label)
    return out


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions, F.lit(True))


def violated(rules: dict[str, Column]) -> Column:
    """Array of the names of rules that do not hold on the row (null counts as broken)."""
    marks = [F.when(F.coalesce(ok, F.lit(False)), F.lit(None)).otherwise(F.lit(name))
             for name, ok in rules.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def fired(rules: dict[str, Column]) -> Column:
    """Array of the names of rules that hold, in the order given."""
    marks = [F.when(hit, F.lit(name)) for name, hit in rules.items()]
    return F.filter(F.array(*marks), lambda x: x.isNotNull())


def to_long(df: DataFrame, ids: Sequence[str], columns: Sequence[str],
            name: str = "feature", value: str = "value", as_type: str = "double") -> DataFrame:
    """Columns to rows, all cast to one type."""
    cast = df.select(*ids, *[F.col(c).cast(as_type).alias(c) for c in columns])
    return cast.unpivot(list(ids), list(columns), name, value)


def is_number_text(c: Column) -> Column:
    return c.rlike(NUMBER_PATTERN)


def micros(c: Column) -> Column:
    """Microseconds since the epoch of a timestamp with or without zone."""
    return F.unix_micros(c.cast("timestamp"))
