"""Readers: one lazy DataFrame per source."""

from __future__ import annotations

import re
from collections.abc import Sequence
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Default ports, URL forms and file classes.
JDBC_PORTS = {"postgresql": 5432, "mysql": 3306, "oracle": 1521}
JDBC_URLS = {
    "postgresql": "jdbc:postgresql://{host}:{port}/{database}",
    "mysql": "jdbc:mysql://{host}:{port}/{database}",
    "oracle": "jdbc:oracle:thin:@//{host}:{port}/{database}",
}
STRUCTURED = ("csv", "json", "parquet", "xlsx", "xls")
UNSTRUCTURED = ("pdf", "txt", "doc", "docx", "jpg", "jpeg", "png", "tiff")
READABLE = {"csv": "csv", "json": "json", "parquet": "parquet"}
FETCH_SIZE = 10_000
#: Objects that are read side by side.
READ_AT_ONCE = 8


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, **options) -> DataFrame:
    """CSV with header. Give a schema for large inputs: inference reads them twice."""
    reader = spark.read.option("header", True).options(**options)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return reader.csv(path)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None,
              lines: bool = True, **options) -> DataFrame:
    """JSON lines (splittable), or with ``lines=False`` one array per file."""
    reader = spark.read.options(**options)
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("multiLine", not lines).json(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_structured(spark: SparkSession, path: str, file_format: str | None = None, **options) -> DataFrame:
    """Pick the reader by extension."""
    kind = (file_format or path.rsplit(".", 1)[-1]).lower()
    readers = {"csv": read_csv, "json": read_json, "parquet": read_parquet}
    if kind not in readers:
        raise ValueError(f"unsupported format: {kind}")
    return readers[kind](spark, path, **options)


def jdbc_options(kind: str, host: str, database: str, port: int | None = None, *,
                 table: str | None = None, query: str | None = None,
                 user: str | None = None, password: str | None = None,
                 fetch_size: int = FETCH_SIZE, split_on: str | None = None,
                 lower: object = None, upper: object = None, parts: int | None = None) -> dict[str, str]:
    """Options of a database read. ``split_on`` makes it a parallel read in ``parts`` ranges."""
    if kind not in JDBC_URLS:
        raise ValueError(f"unknown database kind: {kind}")
    if (table is None) == (query is None):
        raise ValueError("give either a table or a query")
    out = {"url": JDBC_URLS[kind].format(host=host, port=port or JDBC_PORTS[kind], database=database),
           "fetchsize": str(fetch_size)}
    if split_on is None:
        out["dbtable" if table else "query"] = table or query
    else:
        # a partitioned read takes a table expression, not a query
        out["dbtable"] = table or f"({query}) src"
        out.update(partitionColumn=split_on, lowerBound=str(lower), upperBound=str(upper),
                   numPartitions=str(parts))
    if user is not None:
        out.update(user=user, password=password or "")
    return out


def read_jdbc(spark: SparkSession, **options) -> DataFrame:
    return spark.read.format("jdbc").options(**jdbc_options(**options)).load()


def extension(path: str | Column = "path") -> Column:
    c = F.col(path) if isinstance(path, str) else path
    return F.lower(F.regexp_extract(c, r"\.([^./]+)$", 1))


def file_name(path: str = "path") -> Column:
    return F.regexp_extract(F.col(path), r"([^/]+)$", 1)


def table_key(path: Column, root: str) -> Column:
    """The file a path names or, of a part file, the outermost folder below ``root`` that has a readable extension."""
    inner = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*:", "", root).strip("/") + "/"
    start = F.locate(inner, path)
    skipped = F.when(start > 0, start + len(inner) - 1).otherwise(0)
    below = F.substring(path, skipped + 1, F.length(path))
    folder = F.regexp_extract(below, rf"^((?:[^/]*/)*?[^/]*\.(?i:{'|'.join(READABLE)}))/", 1)
    return F.when(folder != "", F.concat(F.substring(path, F.lit(1), skipped), folder)).otherwise(path)


def list_objects(spark: SparkSession, path: str, extensions: Sequence[str] | None = None,
                 max_keys: int | None = None, tables: bool = False) -> DataFrame:
    """Files below ``path``. The content column is never read.

    With ``tables`` a folder of part files that has a readable extension (``orders.parquet/``) is one
    object, with the size of all its files and the time of the newest.
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", "modificationTime")
    if tables:
        found = found.groupBy(table_key(F.col("path"), path).alias("path")).agg(F.sum("length").alias("length"), F.max("modificationTime").alias("modificationTime"))
    files = found.select(F.col("path").alias("key"), file_name().alias("file_name"),
                         extension().alias("extension"), F.col("length").alias("size"),
                         F.col("modificationTime").alias("last_modified"))
    if extensions is not None:
        files = files.where(F.col("extension").isin([e.lower().lstrip(".") for e in extensions]))
    return files if max_keys is None else files.orderBy("key").limit(max_keys)


def modified_between(df: DataFrame, start=None, end=None) -> DataFrame:
    """Rows of files changed in the closed interval; skipped files are not opened."""
    changed = F.col("_metadata.file_modification_time")
    if start is not None:
        df = df.where(changed >= F.lit(start))
    if end is not None:
        df = df.where(changed <= F.lit(end))
    return df


def with_provenance(df: DataFrame, load_time: str | None = None) -> DataFrame:
    """Adds the file and folder a row came from and, if given, the load time."""
    path = F.col("_metadata.file_path")
    out = df.select("*", F.col("_metadata.file_name").alias("_source_file"),
                    F.regexp_replace(path, r"/[^/]*$", "").alias("_source_bucket"))
    return out if load_time is None else out.withColumn("_load_timestamp", F.lit(load_time).cast("timestamp"))


def read_text_files(spark: SparkSession, path: str, **options) -> DataFrame:
    """Whole files as text: UTF-8, or Latin-1 where the bytes are not valid UTF-8."""
    files = spark.read.format("binaryFile").options(**options).load(path)
    valid = F.is_valid_utf8(F.col("content").cast("string"))
    text = F.when(valid, F.decode("content", "UTF-8")).otherwise(F.decode("content", "ISO-8859-1"))
    return (files.select(F.col("path").alias("key"), text.alias("content"),
                         F.when(valid, "utf-8").otherwise("latin-1").alias("encoding_used"))
            .withColumns({
                "character_count": F.length("content"),
                "word_count": F.regexp_count("content", F.lit(r"\S+")),
                "line_count": F.size(F.split("content", "\n", -1)),
            }))


def read_image_info(spark: SparkSession, path: str) -> DataFrame:
    """Size and channels of images, with the placeholder text used as their content."""
    image = spark.read.format("image").option("dropInvalid", True).load(path)
    kind = F.upper(extension(F.col("image.origin")))
    mode = (F.when(F.col("image.nChannels") == 1, "L").when(F.col("image.nChannels") == 3, "RGB")
            .when(F.col("image.nChannels") == 4, "RGBA"))
    return image.select(
        F.col("image.origin").alias("key"), F.col("image.width").alias("width"),
        F.col("image.height").alias("height"), mode.alias("mode"),
        F.format_string("[Image: %s %dx%d]", kind, F.col("image.width"), F.col("image.height")).alias("content"))


def route_formats(listing: DataFrame) -> DataFrame:
    """Class of each listed file by extension and whether a reader exists for it."""
    ext = F.col("extension")
    return listing.withColumns({
        "file_class": F.when(ext.isin(*STRUCTURED), "structured")
                       .when(ext.isin(*UNSTRUCTURED), "unstructured").otherwise("unsupported"),
        "processing_status": F.when(ext.isin(*READABLE, "txt"), "success").otherwise("unsupported"),
    })


def file_summary(df: DataFrame, root: str | None = None) -> DataFrame:
    """Rows and columns per source file of a structured read, or per table below ``root`` if that is given."""
    name = F.col("_metadata.file_name") if root is None else F.element_at(F.split(table_key(F.col("_metadata.file_path"), root), "/"), -1)
    return (df.groupBy(name.alias("file_name"))
            .agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns))))


def summarize_objects(spark: SparkSession, listing: DataFrame) -> DataFrame:
    """A routed listing with the rows and columns of every object that has a structured reader.

    Each of them is read, a few at a time. One that cannot be read has the
    status 'error', the message and no numbers; the others are not touched by it.
    """
    found = listing.where(F.col("extension").isin(*READABLE)).select("key", "extension").collect()  # a row per object

    def counted(key: str, kind: str) -> tuple:
        try:
            df = read_structured(spark, re.sub(r"([\[\]{}*?\\])", r"\\\1", key), READABLE[kind])  # a name is no pattern
            return key, df.count(), len(df.columns), None
        except Exception as error:  # whatever reading raises is that object's result
            return key, None, None, f"{type(error).__name__}: {error}"

    with ThreadPool(READ_AT_ONCE) as pool:
        read = pool.starmap(inheritable_thread_target(spark)(counted), [tuple(r) for r in found])
    counts = spark.createDataFrame(read, "key string, rows long, columns int, error_message string")
    status = F.when(F.col("error_message").isNotNull(), "error").otherwise(F.col("processing_status"))
    return route_formats(listing).join(counts, "key", "left").withColumn("processing_status", status)
