"""Helpers the operators of this subpackage share."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veriloom.session import stored

#: Rows of one Arrow batch at most: a batch of long texts has to fit a Python worker several times.
BATCH_ROWS = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bound_batches(spark: SparkSession) -> None:
    """Lower the rows per Arrow batch to BATCH_ROWS; smaller settings stay."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if not 0 < now <= BATCH_ROWS:
        spark.conf.set(key, str(BATCH_ROWS))


def words_of(text: str | None) -> list[bytes]:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def hashes(items: Iterable[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, items, repeat(seed)), dtype=np.uint64)


def map_rows(df: DataFrame, fn: Callable[..., Iterator[dict]], schema: str, *args) -> DataFrame:
    """``fn(columns, *args)`` on each Arrow batch, given as a dict of Python lists, returns columns of the output."""
    fields = df.sparkSession.createDataFrame([], schema).schema

    def run(batches, fn=fn, args=args, names=df.columns):
        to_arrow = _arrow_schema(fields)
        for batch in batches:
            out = fn(dict(zip(names, (c.to_pylist() for c in batch.columns), strict=True)), *args)
            if out is not None:
                yield pa.RecordBatch.from_arrays([pa.array(out[f.name], type=f.type) for f in to_arrow], schema=to_arrow)

    return df.mapInArrow(partial(run), fields)


def _arrow_schema(fields):
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(fields)


def members(keys: DataFrame, column: str, rows: int):
    """A condition on a long column that holds for every value of ``keys`` and, by chance, for some others.

    A bit map of 16 bits a key, of 4 KB to 16 MB in all, is sent to the tasks;
    with more than 8 million keys it stays at 16 MB and lets more others through.
    It thins out rows before a join that decides, so rows that match nothing
    are not shuffled; what passes by chance changes no result.
    """
    spark = keys.sparkSession
    size = min(27, max(15, (16 * rows).bit_length()))
    place = F.shiftrightunsigned(F.xxhash64(column), 64 - size)
    parts = (keys.select(place.alias("at")).groupBy(F.shiftright("at", 15).alias("bucket"))
             .agg(F.bitmap_construct_agg(F.col("at").bitwiseAND(F.lit(32767))).alias("bits")).collect())  # at most 4096 rows of 4 KB
    bits = bytearray(1 << (size - 3))
    for r in parts:
        bits[r["bucket"] << 12:(r["bucket"] + 1) << 12] = r["bits"]
    sent = spark.sparkContext.broadcast(bytes(bits))

    @F.pandas_udf("boolean")
    def inside(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series(np.frombuffer(sent.value, np.uint8)[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1)

    return lambda key: inside(F.shiftrightunsigned(F.xxhash64(key), 64 - size))


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows no model may learn from: crc32 of the id as text is divisible by five. A null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


__all__ = ["BATCH_ROWS", "bound_batches", "hashes", "held_out", "map_rows", "members", "stored", "table", "words_of"]
