"""Text and JSON files: line lists, jobs, topic phrases, corpus manifests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of text files, trimmed, without blank ones."""
    return spark.read.text(path).select(F.trim("value").alias("line")).filter("line <> ''")


def _items(spark: SparkSession, path: str, schema: str, *names: str) -> DataFrame:
    """A list, or the list under the first of the names that a file has; one row an item."""
    text = spark.read.text(path, wholetext=True).select(F.col("value"), F.col("_metadata.file_path").alias("file"))
    tries = [F.from_json("value", f"array<struct<{schema}>>", {"mode": "PERMISSIVE"})]
    wrapped = F.from_json("value", "struct<" + ",".join(f"{n}:array<struct<{schema}>>" for n in names) + ">")
    is_list = F.ltrim("value").startswith("[")
    found = F.when(is_list, tries[0]).otherwise(F.coalesce(*[wrapped[n] for n in names]))
    return text.select("file", F.posexplode(found).alias("ordinal", "item")).select("file", "ordinal", "item.*")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    """Batch jobs; a relative ``seed_bib`` is beside its file."""
    jobs = _items(spark, path, "name:string,topic:string,seed_bib:string,topic_limit:int,expand:boolean,status:string,preview:boolean", "jobs")
    folder = F.regexp_replace("file", "[^/]*$", "")
    return jobs.withColumn("seed_bib", F.when(F.col("seed_bib").rlike("^(/|[a-z0-9]+:)"), F.col("seed_bib")).otherwise(F.concat(folder, "seed_bib")))


def read_topic_phrases(spark: SparkSession, path: str) -> DataFrame:
    return _items(spark, path, "slug:string,suggested_phrase:string,phrase:string,status:string,review_notes:string", "topics", "items")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The seed sets of a corpus manifest: slug, title and bibliography of each topic."""
    return _items(spark, path, "topic_slug:string,topic_title:string,topic_url:string,seed_bib:string,entry_count:int", "seed_sets")
