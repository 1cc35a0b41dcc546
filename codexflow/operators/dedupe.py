"""Duplicate clusters of entries, their canonical entry, keys and checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import text as T

RICH = ("doi", "url", "abstract", "publisher", "journal", "booktitle", "editor")
FIELDS = ["author", "title", "year", "journal", "booktitle", "publisher", "abstract", "doi"]


def duplicate_key() -> Column:
    """First author, year and title, or empty if any is missing."""
    author = F.substring_index(T.duplicate_text(F.col("author")), " and ", 1)
    year, title = F.trim(T.text("year")), T.duplicate_text(F.col("title"))
    return F.when((author == "") | (year == "") | (title == ""), "").otherwise(F.concat_ws("|", author, year, title))


def richness(columns: list[str] = FIELDS) -> Column:
    """3 for each rich field that has a value, 1 for each other."""
    return sum((F.when(T.filled(c).isNotNull(), 3 if c in RICH else 1).otherwise(0) for c in columns), F.lit(0))


def clusters(entries: DataFrame, least: int = 2) -> DataFrame:
    """``key``, ``n`` and the sorted members of each cluster."""
    keyed = entries.withColumn("key", duplicate_key()).filter("key <> ''")
    members = F.array_sort(F.collect_list(F.struct(T.text("topic").alias("topic"), T.text("year").alias("year"), "citation_key")))
    # Keys alone are counted first, so only clusters gather members.
    many = keyed.groupBy("key").agg(F.count("*").alias("n")).filter(F.col("n") >= least)
    return keyed.join(many, "key").groupBy("key", "n").agg(F.transform(members, lambda m: m["citation_key"]).alias("members"))


def canonical(entries: DataFrame) -> DataFrame:
    """The richest entry of each cluster; of equals the shortest key, then the last one."""
    keyed = entries.withColumn("key", duplicate_key()).filter("key <> ''").withColumn("richness", richness())
    rank = F.struct("richness", -F.length("citation_key"), "citation_key")
    return keyed.groupBy("key").agg(F.count("*").alias("n"), F.max_by(F.struct("citation_key", "entry_type", "richness"), rank).alias("c")).filter("n >= 2").select("key", "n", "c.*")


def fold_merge(entries: DataFrame) -> DataFrame:
    """Each cluster's canonical entry with missing fields from the others, in order of id.

    A field's value is that of the canonical entry, else of the first other one
    that has it: an ordered minimum for each field, so nothing is gathered.
    """
    keyed = entries.withColumn("key", duplicate_key()).filter("key <> ''")
    best = canonical(entries).select("key", F.col("citation_key").alias("best"))
    rows = keyed.join(best, "key")
    order = F.struct(F.col("citation_key") != F.col("best"), F.col("entry_id"))
    value = lambda c: F.min_by(F.col(c), F.when(T.filled(c).isNotNull(), order)).alias(c)
    return rows.groupBy("key", F.col("best").alias("citation_key")).agg(*[value(c) for c in FIELDS])


def weaknesses() -> Column:
    venue = F.col("entry_type").isin("article", "inproceedings", "incollection") & T.filled("journal").isNull() & T.filled("booktitle").isNull()
    return F.array_compact(F.array(
        F.when(F.col("entry_type") == "misc", "entry_type:misc"), F.when(T.filled("doi").isNull(), "missing:doi"),
        F.when(richness() < 6, "low_field_richness"), F.when(venue, "missing:venue"),
    ))


def is_suspicious_type(howpublished: Column | None = None) -> Column:
    """Entry types that the venue's words speak against."""
    low = lambda c: F.lower(T.text(c))
    kind, journal, publisher = F.col("entry_type"), low("journal"), low("publisher")
    how = low(F.lit("") if howpublished is None else howpublished)
    return (
        ((kind == "article") & journal.rlike("elsevier|springer|press|publications|publisher|university"))
        | ((kind == "misc") & how.rlike("journal|review|letters|proceedings|conference|symposium"))
        | ((kind == "book") & publisher.rlike("journal|review|letters|proceedings|conference") & ~publisher.rlike("press|academic|elsevier|springer|wiley|university"))
        | ((kind == "incollection") & (T.filled("booktitle").isNull()))
    )


def assign_keys(groups: DataFrame, existing: DataFrame) -> DataFrame:
    """Keys for groups ``(grp, base, ordinal)``: a taken key gets the group's hash.

    The first group by ordinal keeps a key, unless an entry has it already.
    """
    first = Window.partitionBy("base").orderBy("ordinal", "grp")
    taken = existing.select(F.col("citation_key").alias("base"), F.lit(True).alias("_taken")).distinct()
    rows = groups.withColumn("_n", F.row_number().over(first)).join(taken, "base", "left")
    own = (F.col("_n") == 1) & F.col("_taken").isNull()
    return rows.select("grp", "base", F.when(own, F.col("base")).otherwise(F.concat("base", F.lit("_"), F.left(F.sha1("grp"), F.lit(8)))).alias("citation_key"))


def validation(entries: DataFrame) -> DataFrame:
    """One row of counts over an export: missing fields, suspicious types, duplicates."""
    lacking = lambda c: F.count_if(T.filled(c).isNull()).alias(f"missing_{c}")
    main = entries.agg(F.count("*").alias("n_entries"), lacking("author"), lacking("title"), lacking("year"), F.count_if(is_suspicious_type()).alias("suspicious"))
    dup = entries.withColumn("key", duplicate_key()).filter("key <> ''").groupBy("key").agg(F.count("*").alias("n")).filter("n >= 2")
    dup = dup.agg(F.count("*").alias("duplicate_clusters"), F.coalesce(F.sum("n"), F.lit(0)).alias("duplicate_entries"))
    return main.crossJoin(F.broadcast(dup))  # one row each


def is_safe(found: str = "search") -> Column:
    """Whether a resolution may be applied: found by id, or the same title and year, or title and first author."""
    same = lambda a, b: T.match_text(F.col(a)) == T.match_text(F.col(b))
    first = lambda c: F.split(T.match_text(F.col(c)), " ")[0]
    return (F.lit(found) != "search") | (same("title", "new_title") & ((T.text("year") == T.text("new_year")) | (first("author") == first("new_author"))))
