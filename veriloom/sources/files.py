"""A Python data source for files: byte ranges of large ones, many small ones in a task, a user function, a status per range."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes one task reads, and of one piece of a file.
RANGE_BYTES = 32 << 20
#: What opening a file counts for when small files are put together, in bytes.
OPEN_BYTES = 1 << 20
STATUS = "key string, start long, length long, processing_status string, error_message string"

Process = Callable[[str, int, bytes], Iterable[tuple]]


@dataclass
class Ranges(InputPartition):
    """What one task reads: (path, first byte, byte after the last)."""

    pieces: list[tuple[str, int, int]]

    def __post_init__(self):
        self.value = None


def _file_system(path: str):
    """The file system of a path or URI, and the path within it."""
    from pyarrow import fs

    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", path):
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return fs.LocalFileSystem(), path


def list_files(path: str, extensions: Sequence[str] = ()) -> list[tuple[str, int]]:
    """(path, size) of the files below a folder by name, or of one file; hidden ones and markers (``_SUCCESS``) are left out."""
    from pyarrow import fs

    system, inner = _file_system(path)
    info = system.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else system.get_file_info(fs.FileSelector(inner, recursive=True))
    wanted = tuple("." + e.lower().lstrip(".") for e in extensions)
    below = len(inner.rstrip("/"))

    def asked(f) -> bool:
        hidden = any(part.startswith(("_", ".")) for part in f.path[below:].split("/"))
        return f.type == fs.FileType.File and not hidden and (not wanted or f.path.lower().endswith(wanted))

    return sorted((f.path, f.size) for f in found if asked(f))


def plan_ranges(files: Iterable[tuple[str, int]], size: int, whole: bool) -> list[Ranges]:
    """Tasks of about ``size`` bytes: large files in pieces unless ``whole``, small ones together in the order of their names."""
    tasks: list[Ranges] = []
    pieces: list[tuple[str, int, int]] = []
    filled = 0
    for path, length in files:
        step = max(length, 1) if whole else size
        for start in range(0, max(length, 1), step):
            end = min(length, start + step)
            if pieces and filled + end - start > size:
                tasks.append(Ranges(pieces))
                pieces, filled = [], 0
            pieces.append((path, start, end))
            filled += end - start + min(OPEN_BYTES, size // 8)
    return [*tasks, Ranges(pieces)] if pieces else tasks


def read_lines(handle, start: int, end: int, length: int, block: int = 1 << 20) -> tuple[int, bytes]:
    """The lines that begin in [start, end) and where the first of them begins; a line that crosses ``end`` is read to its end."""
    at = start
    if start:
        # the line that holds the byte before belongs to the range before
        handle.seek(start - 1)
        at = start - 1
        while at < length:
            data = handle.read(min(block, length - at))
            found = data.find(b"\n")
            if found >= 0:
                at += found + 1
                break
            at += len(data)
        if at >= end:
            return at, b""
    handle.seek(at)
    parts = [handle.read(end - at)]
    to = end
    while to < length and not parts[-1].endswith(b"\n"):
        data = handle.read(min(block, length - to))
        found = data.find(b"\n")
        parts.append(data if found < 0 else data[:found + 1])
        to += len(data)
    return at, b"".join(parts)


class _Reader(DataSourceReader):
    def __init__(self, path: str, extensions: Sequence[str], size: int, whole: bool, process: Process, width: int):
        self.path, self.extensions, self.size, self.whole, self.process, self.width = path, extensions, size, whole, process, width

    def partitions(self) -> list[Ranges]:
        return plan_ranges(list_files(self.path, self.extensions), self.size, self.whole) or [Ranges([])]

    def read(self, partition: Ranges) -> Iterator[tuple]:
        for path, start, end in partition.pieces:
            at, got, rows = start, 0, []
            try:
                system, _ = _file_system(self.path)
                with system.open_input_file(path) as handle:
                    length = handle.size()
                    if length < end:
                        raise EOFError(f"{length} bytes, {end} or more when the file was listed")
                    if self.whole:
                        data = handle.read()
                    else:
                        at, data = read_lines(handle, start, end, length)
                got = len(data)
                if got or not length:
                    rows = [tuple(r) for r in self.process(path, at, data)]
                    if any(len(r) != self.width for r in rows):
                        raise ValueError(f"the function has to give {self.width} values a row")
                status = [(path, at, got, "success", None)]
            except Exception as error:  # whatever a function raises on a file is that file's result
                rows, status = [], [(path, at, got, "error", f"{type(error).__name__}: {error}")]
            if rows:
                yield from (s + r for s in status for r in rows)
            elif status[0][3] == "error" or got or not end:
                yield status[0] + (None,) * self.width


def read_files(spark: SparkSession, path: str, process: Process, schema: str, extensions: Sequence[str] = (), whole: bool = False,
               range_bytes: int = RANGE_BYTES) -> DataFrame:
    """What ``process(key, start, data)`` gives for every range of the files at ``path``, after the range's key, start, length and status.

    A range is the lines that begin in a piece of ``range_bytes`` bytes, so a file
    of any size is read by many tasks and no line is cut; only a line
    longer than a piece takes more memory than one. ``whole`` gives the function whole files (formats that
    cannot be cut). Small files share a task. ``schema`` names the
    function's columns. A range on which reading or the function fails gives
    one row with processing_status 'error', the message and nulls, and the job goes on; one for which
    the function gives nothing has a row of nulls. Files and folders whose names begin with _ or . are
    left out; an empty folder gives no rows. Files are listed by the driver and opened by the tasks,
    through any file system that pyarrow knows, so a path has to be one that all executors see.
    """
    if range_bytes < 1:
        raise ValueError("a range has at least one byte")
    own = T.StructType.fromDDL(schema)
    width = len(own.fields)

    class Files(DataSource):
        @classmethod
        def name(cls) -> str:
            return "veriloom_files"

        def schema(self) -> str:
            return f"{STATUS}, {schema}"

        def reader(self, schema: T.StructType) -> DataSourceReader:
            return _Reader(path, tuple(extensions), range_bytes, whole, process, width)

    spark.dataSource.register(Files)
    return spark.read.format("veriloom_files").load()


def write_joined(df: DataFrame, path: str, name: str = "joined.txt") -> str:
    """Writes a column of lines as one file of a folder: tasks write parts, then each part is put at its place in the file.

    A part's place is the sum of the sizes before it, so a task that runs again writes the same bytes to the
    same place, and no task holds more than a block or reads more than a part. The folder has to be one of a file system that
    all executors share and that can be written at a place (a mounted one); elsewhere, one task writes the file.
    """
    import os

    local = re.sub(r"^file:/*", "/", path)
    if re.match(r"^[A-Za-z][A-Za-z0-9+.-]+:", local):
        df.coalesce(1).write.text(path)
        return path
    df.write.text(f"{path}/_parts")
    pieces, at = [], 0
    for part, length in list_files(f"{local}/_parts", ["txt"]):
        pieces.append((part, at, length))
        at += length
    target = os.path.join(local, name)
    with open(target, "wb") as out:
        out.truncate(at)

    def place(batches):
        for batch in batches:
            for part, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                with open(part, "rb") as source, open(target, "r+b") as out:
                    out.seek(start)
                    while block := source.read(1 << 20):
                        out.write(block)
            yield batch

    if pieces:
        spark = df.sparkSession
        parts = spark.createDataFrame(pieces, "part string, start long, length long")  # a row per part file
        parts.repartitionByRange(min(len(pieces), 1000), "start").mapInArrow(place, parts.schema).write.format("noop").mode("overwrite").save()
    return path


def text_counts(key: str, start: int, data: bytes) -> list[tuple]:
    """(encoding_used, characters, words, line_ends) of a range: UTF-8, or Latin-1 where its bytes are not valid UTF-8."""
    try:
        text, encoding = data.decode("utf-8"), "utf-8"
    except UnicodeDecodeError:
        text, encoding = data.decode("latin-1"), "latin-1"
    return [(encoding, len(text), len(text.split()), text.count("\n"))]


def all_read(ranges: DataFrame) -> DataFrame:
    """The ranges if all of them were read; a job over them fails with the message of one that was not.

    For totals, which without the rows of a failed range would look like those of the whole file.
    """
    message = F.concat_ws(" ", F.col("key"), F.lit("at byte"), F.col("start"), F.lit("failed:"), F.col("error_message"))
    return ranges.where(F.when(F.col("processing_status") == "error", F.raise_error(message).cast("boolean")).otherwise(True))


def file_status(ranges: DataFrame) -> DataFrame:
    """One row per file: its ranges and bytes, 'error' if any range failed, and the first message."""
    failed = F.col("processing_status") == "error"
    once = ranges.select("key", "start", "length", "processing_status", "error_message").distinct()
    return once.groupBy("key").agg(F.count(F.lit(1)).alias("ranges"), F.sum("length").alias("bytes"),
                                   F.when(F.bool_or(failed), "error").otherwise("success").alias("processing_status"),
                                   F.min_by("error_message", F.when(failed, F.col("start"))).alias("error_message"))
