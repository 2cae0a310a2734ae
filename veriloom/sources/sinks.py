"""Writers and the small tables that describe what was written."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

FORMATS = ("parquet", "csv", "json")


def write(df: DataFrame, path: str, file_format: str = "parquet", mode: str = "errorifexists",
          partition_by: Sequence[str] = ()) -> str:
    if file_format not in FORMATS:
        raise ValueError(f"unsupported format: {file_format}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if file_format == "csv":
        writer = writer.option("header", True)
    getattr(writer, file_format)(path)
    return path


def catalog_entry(df: DataFrame, bucket: str, key: str, created_at: str, tags: dict[str, str] | None = None) -> DataFrame:
    """One catalogue row for a data set: id, location, schema, row count, tags."""
    tag_map = F.to_json(F.create_map(*[F.lit(x) for kv in (tags or {}).items() for x in kv])) if tags else F.lit("{}")
    return df.agg(F.count(F.lit(1)).alias("row_count")).select(
        F.lit(f"{bucket}_{key}".replace("/", "_")).alias("dataset_id"),
        F.lit(f"{bucket}/{key}").alias("location"),
        F.lit(created_at).cast("timestamp_ntz").alias("created_at"),
        F.lit(df.schema.json()).alias("schema_json"), tag_map.alias("tags"), "row_count")


def flatten(df: DataFrame, separator: str = "_") -> DataFrame:
    """Nested structs to columns joined with ``separator``; arrays and maps to JSON text."""
    def walk(prefix: list[str], schema: T.StructType) -> list[Column]:
        out: list[Column] = []
        for f in schema:
            path = [*prefix, f.name]
            c = F.col(".".join(f"`{p}`" for p in path))
            if isinstance(f.dataType, T.StructType):
                out += walk(path, f.dataType)
            elif isinstance(f.dataType, (T.ArrayType, T.MapType)):
                out.append(F.to_json(c).alias(separator.join(path)))
            else:
                out.append(c.alias(separator.join(path)))
        return out
    return df.select(*walk([], df.schema))


def export_history(history: DataFrame, path: str, file_format: str = "json", mode: str = "append") -> str:
    return write(history, path, file_format, mode)
