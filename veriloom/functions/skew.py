"""Joins that stay balanced when a few keys hold most rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veriloom.session import scratch_path, written_bytes

#: Rows with a null key match nothing; they are spread over so many tasks.
SALTS = 32
MAX_HOT_KEYS = 1000
#: Bytes of a lookup's parquet files up to which it is broadcast.
MAX_BROADCAST_BYTES = 8 << 20


def written_lookup(lookup: DataFrame) -> tuple[DataFrame, bool]:
    """The lookup as a stored table, and whether its files are small enough to be sent to every executor."""
    spark = lookup.sparkSession
    path = scratch_path(spark, "lookup")
    lookup.write.parquet(path)
    return spark.read.schema(lookup.schema).parquet(path), written_bytes(spark, path) <= MAX_BROADCAST_BYTES


def _hot_keys(weights: DataFrame, on: Sequence[str], weight: str) -> DataFrame:
    """Keys with more than 1/MAX_HOT_KEYS of all rows, so at most MAX_HOT_KEYS of them; ``_salts`` grows with a key's share."""
    total = weights.agg(F.sum(weight).alias("t")).scalar()
    share = F.col(weight) / total
    return (weights.where(F.col(weight) * MAX_HOT_KEYS > total)
            .select(*on, F.ceil(share * MAX_HOT_KEYS).cast("int").alias("_salts")))


def lookup_join(rows: DataFrame, lookup: DataFrame, on: Sequence[str], row_key: str | Column,
                weight: str | None = None, how: str = "left") -> DataFrame:
    """Join ``rows`` to a table with one row per key.

    The lookup is written out first: it is mostly an aggregate of the large
    table, which should be scanned for it only once. If its files have at most
    MAX_BROADCAST_BYTES it goes to the rows, which then stay where they are.
    Otherwise rows of hot keys are spread by a hash of ``row_key`` over as many
    tasks as their share asks for, and the lookup rows of just those keys are
    repeated as often. ``weight`` names a lookup column with the number of
    ``rows`` per key; without it the rows are counted here. The list of hot keys
    is bounded by its own definition, which is why it may be broadcast.
    """
    on = list(on)
    lookup, small = written_lookup(lookup)
    if small:
        return rows.join(F.broadcast(lookup), on, how)
    if weight is None:
        weights = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("_w"))
        hot = _hot_keys(weights, on, "_w")
    else:
        hot = _hot_keys(lookup, on, weight)
    hot = written_lookup(hot)[0]
    any_null = reduce(lambda a, b: a | b, [F.col(c).isNull() for c in on])
    spread = F.pmod(F.xxhash64(row_key), F.when(any_null, F.lit(SALTS)).otherwise(F.coalesce("_salts", F.lit(1)))).cast("int")
    left = rows.join(F.broadcast(hot), on, "left").withColumn("_salt", spread).drop("_salts")
    right = (lookup.join(F.broadcast(hot), on, "left")
             .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", F.lit(1)) - 1)))
             .drop("_salts"))
    return left.join(right, on + ["_salt"], how).drop("_salt")
