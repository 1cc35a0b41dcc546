"""Cutting the lineage of iterative operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the session's checkpoint folder.

    The folder is that of ``spark.checkpoint.dir``; where the session names
    none, as in tests, one below the warehouse is set.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        context.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return df.checkpoint()


def kept_folder(spark, name: str) -> str:
    """A new folder below the session's checkpoint folder, for tables that one query needs."""
    cut(spark.range(0))
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below the session's checkpoint folder, and read back."""
    path = kept_folder(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
