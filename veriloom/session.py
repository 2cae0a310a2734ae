"""Session defaults and the shared scratch folder."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "veriloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the defaults the operators assume; keyword conf wins."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local session may
    fall back to a folder of its own, which is made once per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if configured:
        if not current.isDefined():
            sc.setCheckpointDir(configured)
        return configured
    if current.isDefined():
        return current.get()
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    path = tempfile.mkdtemp(prefix="veriloom-")
    sc.setCheckpointDir(path)
    return path


#: Intermediate tables made so far, oldest first.
_scratch: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder for one intermediate table."""
    path = os.path.join(shared_dir(spark), f"{name}-{uuid.uuid4().hex}")
    _scratch.append(path)
    return path


class Scratch:
    """Remembers the intermediate tables made within it; ``remove`` deletes them once nothing reads them any more."""

    def __init__(self):
        self.paths: list[str] = []

    def __enter__(self) -> "Scratch":
        self._from = len(_scratch)
        return self

    def __exit__(self, *error) -> None:
        self.paths += _scratch[self._from:]
        del _scratch[self._from:]

    def remove(self, spark: SparkSession) -> None:
        for path in self.paths:
            target = spark._jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
        self.paths.clear()


def spread_rows(df: DataFrame, key: str) -> DataFrame:
    """More tasks for heavy per-row work when the scan has fewer than there are cores.

    A file with a single row group is read by one task whatever its size. Inputs
    that already split well are left alone, so large tables see no extra shuffle.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(wanted, key) if df.rdd.getNumPartitions() < wanted else df


def stored(df: DataFrame, name: str, *by: str) -> DataFrame:
    """Write ``df`` as a parquet table in the shared folder and read it back, in a folder per value of the columns ``by``.

    Better than a checkpoint where later passes need only some of the columns.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path) if by else df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def written_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of the files below a path."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(target).getLength()


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` to reliable storage and go on from there.

    Used where a value must not change if a task is run again, such as the
    number of a range partition. The copy outlives lost executors.
    """
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)
