"""The corpus pipeline: quality, near copies, benchmark passages, secrets, packing.

Each stage takes all that the one before kept. The quality stage drops what the
classifier rejects, near-dedup leaves one document of each group, the
decontamination stage drops documents with a benchmark passage, the secret scan
replaces secrets in the texts, and packing places what is left in sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codexflow.llm import common
from codexflow.llm.decontaminate import drop_contaminated
from codexflow.llm.near_dedup import drop_near_copies
from codexflow.llm.packing import pack_documents
from codexflow.llm.quality import keep_quality
from codexflow.llm.secrets import redact_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_quality(docs, common.read(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs, words=5)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, common.read(spark, sf_dir, "benchmark"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontaminate", decontaminate), ("secrets", secrets), ("packing", packing)]

#: The classifier and the tokenizer can't be told in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written and read again.

    What a stage wrote on its way, and the stage before it, are removed then.
    """
    docs, before = common.read(spark, sf_dir, "documents"), common.written()
    for name, stage in STAGES:
        docs = common.write_table(stage(spark, docs, sf_dir), f"stage-{name}")
        if docs.inputFiles():
            common.release(spark, before, docs)
    return docs
