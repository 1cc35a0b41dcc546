"""Streams: incremental upserts and windowed counts of change logs.

These go beyond one-shot ingestion: the same operators fed by a stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.operators import store


def windowed_counts(log: DataFrame, size: str = "1 day", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Changes by window and field; works on streams, where rows later than ``late`` drop."""
    rows = log.withWatermark("recorded_at", late) if log.isStreaming else log
    w = F.window("recorded_at", size, slide) if slide else F.window("recorded_at", size)
    return rows.groupBy(w.alias("w"), "field_name").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.col("w.start").alias("start"), "field_name", "n", "total")


def sessions(log: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Bursts of changes to one entry."""
    rows = log.withWatermark("recorded_at", late) if log.isStreaming else log
    return rows.groupBy(F.session_window("recorded_at", gap).alias("w"), "entry_id").agg(F.count("*").alias("n")).select("entry_id", F.col("w.start").alias("start"), "n")


def upsert_stream(changes: DataFrame, table: str, keys: list[str], checkpoint: str, keep_old: tuple[str, ...] = ()):
    """Upsert each micro-batch into a table by writing its next version, ``{table}/v={batch}``.

    A batch that is run again writes the same version from the one before, so
    the outcome is exactly once. The one before is the last whole version under
    this number; only a table without any starts empty, and only at the first
    batch: otherwise its history is lost and the batch fails. The version before
    the last is kept for readers, older ones are removed. Returns the started query.
    """

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(table)
        fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        at = lambda n: jvm.org.apache.hadoop.fs.Path(f"{table}/v={n}")
        named = [f.getPath().getName() for f in fs.listStatus(folder)] if fs.exists(folder) else []
        versions = sorted(int(n[2:]) for n in named if n.startswith("v=") and n[2:].isdigit())
        whole = [n for n in versions if n < number and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{table}/v={n}/_SUCCESS"))]
        if number > 0 and not whole:
            raise RuntimeError(f"no version of {table} before batch {number}: its history is missing")
        old = spark.read.parquet(f"{table}/v={whole[-1]}") if whole else spark.createDataFrame([], batch.drop("ordinal").schema)
        store.upsert(old, batch, keys, keep_old).write.mode("overwrite").parquet(f"{table}/v={number}")
        for n in whole[:-1]:
            fs.delete(at(n), True)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
