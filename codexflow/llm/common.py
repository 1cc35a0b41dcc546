"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: dict[str, SparkSession] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is read from ``spark.checkpoint.dir``. Where the session names none
    (local tests) one below the warehouse, which is shared too, is set.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        spark.sparkContext.setCheckpointDir(spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; it is removed when the driver ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(_remove_all)
    _written[path] = spark
    return path


def write_table(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write ``df`` once to the shared folder and return the table read back.

    This cuts the lineage with files that every executor can read, so a lost
    executor costs a reread, not a recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    # What the write has shuffled isn't needed afterwards.
    clean = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(clean, "false")
    spark.conf.set(clean, "true")
    try:
        df.write.options(**{"compression": "zstd", **options}).parquet(path)
    finally:
        spark.conf.set(clean, before)
    return spark.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete ``path`` on whatever file system it is on."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    _written.pop(path, None)


def written() -> set[str]:
    """The paths of the tables that are kept now."""
    return set(_written)


def release(spark: SparkSession, since: set[str], keep: DataFrame) -> None:
    """Remove tables written after ``since`` was taken, but those that ``keep`` reads."""
    used = keep.inputFiles()
    for path in written() - since:
        name = path.rsplit("/", 1)[-1]
        if not any(f"/{name}/" in f for f in used):
            remove(spark, path)


def _remove_all() -> None:
    for path, spark in list(_written.items()):
        if spark.sparkContext._jsc is not None:
            remove(spark, path)


def partitions(spark: SparkSession) -> int:
    """The session's number of shuffle partitions."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_or_empty(column: str = "text"):
    """The text column with null as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))
