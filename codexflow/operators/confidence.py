"""Confidence assessments, review outcomes and calibration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import bibliographic as B
from codexflow.functions import text as T


def identity_assessments(matches: DataFrame) -> DataFrame:
    """Assessments of matches ``(subject_id, score, source_label)``; a score of 0 stays 0."""
    return matches.select(
        F.concat_ws("::", "subject_id", F.lit("identity_resolution"), "source_label").alias("assessment_id"), "subject_id",
        F.lit("identity_resolution").alias("dimension"), F.col("score").alias("value"), B.band(F.col("score")).alias("band"),
    )


def legacy_assessments(field_log: DataFrame, relation_log: DataFrame, topic_rows: DataFrame) -> DataFrame:
    """Assessments made from old logs, once for each id."""
    row = lambda df, kind, subject: df.select(
        F.concat_ws("::", F.lit(f"legacy-{kind}"), subject).alias("assessment_id"), subject.alias("subject_id"), F.lit(kind).alias("dimension"), F.col("confidence").alias("value"), B.band(F.col("confidence")).alias("band")
    )
    fields = row(field_log, "field_provenance", F.col("id").cast("string"))
    edges = row(relation_log, "relation_provenance", F.concat_ws("->", "source", "target"))
    topics = row(topic_rows, "topic_membership", F.concat_ws("@", "citation_key", "slug"))
    return fields.unionByName(edges).unionByName(topics).dropDuplicates(["assessment_id"])


def latest_assessments(assessments: DataFrame) -> DataFrame:
    """The last assessment of each subject."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("dimension"), F.desc("recorded_at"), F.desc("assessment_id"))
    return assessments.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def calibration_rows(outcomes: DataFrame, assessments: DataFrame) -> DataFrame:
    """Reviewed outcomes with what had been assessed."""
    last = latest_assessments(assessments).select("subject_id", F.col("value").alias("assessed"), "band")
    return outcomes.join(last, "subject_id").select("subject_id", "reviewed_match", "assessed", "band")


def payload(columns: list[str]) -> Column:
    """A row as JSON without nulls and empty values; zeros stay."""
    return F.to_json(F.struct(*[F.when(F.col(c).cast("string") != "", F.col(c)).alias(c) for c in columns]), {"ignoreNullFields": "true"})


def annotations(conflicts: DataFrame, log: DataFrame) -> DataFrame:
    """For exports: number of open conflicts, their fields, and the last source of each entry."""
    is_open = F.col("status") == "open"
    open_ones = conflicts.groupBy("entry_id").agg(F.count_if(is_open).alias("x_conflicts"), F.array_join(F.array_sort(F.collect_set(F.when(is_open, F.col("field_name")))), ",").alias("x_conflict_fields"))
    last = log.groupBy("entry_id").agg(F.max_by("source_label", F.struct("recorded_at", "id")).alias("x_last_source"))
    return open_ones.join(last, "entry_id", "full").withColumns({"x_conflicts": F.coalesce("x_conflicts", F.lit(0)), "x_conflict_fields": T.text("x_conflict_fields")})
