"""Bibliographic model tables derived from the test tables.

Each is a DataFrame here and, with the same literals, a named SQL query for the
oracle. The test tables hold no bibliography, so fields are made from ids and
words of ``documents`` by fixed rules.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FAMILIES = ("Smith", "Miller", "Garcia", "Rossi", "Tanaka", "Kowalski", "Novak", "Silva", "Haddad", "Olsen", "Weber", "Laurent")
GIVEN = ("Ann", "Ben", "Carla", "Dan", "Eva", "Finn", "Gus")
TYPES = ("article", "book", "inproceedings", "misc", "techreport")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pick(names: tuple[str, ...], n) -> F.Column:
    return F.element_at(F.array(*map(F.lit, names)), (F.pmod(n, F.lit(len(names))) + 1).cast("int"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One bibliographic entry for each document; copies of a text agree in title, year and author."""
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    # The first 40 words are used; the rest of a text stays one piece.
    words = F.filter(F.split("text", "[ \n\t]+", 42), lambda x: x != "")
    n = F.length("text")
    word = lambda a, b: F.array_join(F.slice("words", a, b), " ")
    out = docs.join(labels, "doc_id", "left").withColumn("words", words)
    kind = _pick(TYPES, F.col("doc_id"))
    return out.select(
        F.col("doc_id").alias("entry_id"),
        F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("citation_key"),
        kind.alias("entry_type"),
        F.when(F.col("quality") == 1, "reviewed").otherwise("draft").alias("review_status"),
        F.when(F.col("doc_id") % 17 == 0, F.lit("")).when(F.col("doc_id") % 19 == 0, F.concat(F.lit("Referenced work "), F.col("doc_id").cast("string"))).otherwise(word(1, 8)).alias("title"),
        F.when(F.col("doc_id") % 11 == 0, F.lit(None)).otherwise((F.lit(1960) + n % 65).cast("string")).alias("year"),
        F.when(F.col("doc_id") % 13 == 0, F.lit("")).otherwise(F.concat(_pick(FAMILIES, n), F.lit(", "), _pick(GIVEN, n), F.lit(" and "), _pick(GIVEN, n * 3), F.lit(" "), _pick(FAMILIES, n * 5 + 1))).alias("author"),
        F.when(kind == "article", F.concat(F.lit("Journal of "), F.col("source"))).alias("journal"),
        F.when(kind == "inproceedings", F.concat(F.lit("Proceedings of "), F.col("lang"))).alias("booktitle"),
        F.when(kind == "book", F.lit("University Press")).alias("publisher"),
        F.when(F.col("doc_id") % 4 != 0, word(9, 32)).alias("abstract"),
        F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("10."), (F.lit(1000) + F.col("doc_id") % 50).cast("string"), F.lit("/X"), F.col("doc_id").cast("string"))).alias("doi"),
        F.col("text").alias("fulltext"),
        F.col("source").alias("topic"),
        F.col("lang"),
    )


def relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations ``(source, target, relation)``; some targets have no entry."""
    docs = table(spark, sf_dir, "documents").select("doc_id")
    total = docs.count()
    key = lambda c: F.concat(F.lit("doc"), c.cast("string"))
    two = F.explode(F.array(F.pmod(F.col("doc_id") * 7 + 3, F.lit(total + 20)), F.pmod(F.col("doc_id") * 13 + 5, F.lit(total + 20))))
    return docs.select(F.col("doc_id"), two.alias("t")).filter("t <> doc_id").select(key(F.col("doc_id")).alias("source"), key(F.col("t")).alias("target"), F.lit("cites").alias("relation")).distinct()


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One topic for each source."""
    src = table(spark, sf_dir, "documents").select("source").distinct()
    n = F.regexp_extract("source", r"(\d+)$", 1).cast("int")
    status = _pick(("unreviewed", "pending", "accepted", "rejected"), n)
    return src.select(
        F.col("source").alias("slug"), F.concat(F.lit("Topic "), F.upper("source")).alias("name"), status.alias("phrase_review_status"),
        F.when(n % 2 == 0, F.concat(F.lit("the phrase "), F.col("source"))).alias("suggested_phrase"),
        F.when(n % 3 == 0, F.concat(F.lit("old "), F.col("source"))).alias("expansion_phrase"),
    )


def entry_topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    conf = (F.lit(0.5) + (F.col("doc_id") % 5) / 10).cast("double")
    return docs.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("citation_key"), F.col("source").alias("slug"), conf.alias("confidence"))


def provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of field changes, from ``events``."""
    ev = table(spark, sf_dir, "events")
    return ev.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("entry_id"), F.col("event_type").alias("field_name"), F.col("props").alias("field_value"),
        F.concat(F.lit("src"), (F.col("event_id") % 4).cast("string")).alias("source_label"), F.round("value", 4).alias("value"),
        F.when(F.col("event_id") % 3 == 0, "accepted").when(F.col("event_id") % 7 == 0, "rejected").otherwise("open").alias("status"), F.col("ts").alias("recorded_at"),
    )


def references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain-text references in several styles, from ``part`` and ``supplier``."""
    parts = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    year = (F.lit(1950) + n % 75).cast("string")
    name = F.concat(_pick(FAMILIES, n), F.lit(", "), F.left(_pick(GIVEN, n), F.lit(1)), F.lit("."))
    title = F.concat(F.initcap("p_name"), F.lit(" study"))
    doi = F.when(n % 5 == 0, F.concat(F.lit(" doi:10.5555/p"), n.cast("string"))).otherwise("")
    vol = F.concat((n % 40 + 1).cast("string"), F.lit("("), (n % 6 + 1).cast("string"), F.lit("): "), (n % 300).cast("string"), F.lit("-"), (n % 300 + 9).cast("string"))
    line = (
        F.when(n % 4 == 0, F.concat(name, F.lit(" ("), year, F.lit("). "), title, F.lit(". Journal of Parts "), vol, F.lit("."), doi))
        .when(n % 4 == 1, F.concat(F.regexp_replace(name, ", .*", ""), F.lit(". "), title, F.lit(". University Press, "), year, F.lit("."), doi))
        .when(n % 4 == 2, F.concat(F.regexp_replace(name, r"\.$", ""), F.lit(". "), year, F.lit(". "), title, F.lit(". Technical Report No. "), n.cast("string"), F.lit(", Parts Institute."), doi))
        .otherwise(F.concat(title, F.lit(" without anything that tells the year")))
    )
    return parts.select(n.alias("ref_id"), line.alias("line"))


_DIGITS = r"(\d+)$"


def _sql_pick(names: tuple[str, ...], n: str) -> str:
    return "[" + ", ".join(f"'{x}'" for x in names) + f"][({n}) % {len(names)} + 1]"


_KIND = _sql_pick(TYPES, "d.doc_id")
_N = "length(d.text)"
SQL_TABLES = {
    "entries": f"""SELECT d.doc_id AS entry_id, 'doc' || d.doc_id AS citation_key, {_KIND} AS entry_type,
      CASE WHEN l.quality = 1 THEN 'reviewed' ELSE 'draft' END AS review_status,
      CASE WHEN d.doc_id % 17 = 0 THEN '' WHEN d.doc_id % 19 = 0 THEN 'Referenced work ' || d.doc_id ELSE array_to_string(w[1:8], ' ') END AS title,
      CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(1960 + {_N} % 65 AS VARCHAR) END AS year,
      CASE WHEN d.doc_id % 13 = 0 THEN '' ELSE {_sql_pick(FAMILIES, _N)} || ', ' || {_sql_pick(GIVEN, _N)} || ' and ' || {_sql_pick(GIVEN, _N + ' * 3')} || ' ' || {_sql_pick(FAMILIES, _N + ' * 5 + 1')} END AS author,
      CASE WHEN {_KIND} = 'article' THEN 'Journal of ' || source END AS journal,
      CASE WHEN {_KIND} = 'inproceedings' THEN 'Proceedings of ' || lang END AS booktitle,
      CASE WHEN {_KIND} = 'book' THEN 'University Press' END AS publisher,
      CASE WHEN d.doc_id % 4 <> 0 THEN array_to_string(w[9:40], ' ') END AS abstract,
      CASE WHEN d.doc_id % 3 = 0 THEN '10.' || (1000 + d.doc_id % 50) || '/X' || d.doc_id END AS doi,
      d.text AS fulltext, source AS topic, lang
    FROM (SELECT *, list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda x: x <> '') AS w FROM documents) d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
    "relations": """SELECT DISTINCT 'doc' || doc_id AS source, 'doc' || t AS target, 'cites' AS relation
    FROM (SELECT doc_id, unnest([(doc_id * 7 + 3) % (n + 20), (doc_id * 13 + 5) % (n + 20)]) AS t FROM documents, (SELECT count(*) AS n FROM documents)) WHERE t <> doc_id""",
    "topics": rf"""SELECT slug, 'Topic ' || upper(slug) AS name, {_sql_pick(("unreviewed", "pending", "accepted", "rejected"), "n")} AS phrase_review_status,
      CASE WHEN n % 2 = 0 THEN 'the phrase ' || slug END AS suggested_phrase, CASE WHEN n % 3 = 0 THEN 'old ' || slug END AS expansion_phrase
    FROM (SELECT DISTINCT source AS slug, CAST(regexp_extract(source, '{_DIGITS}', 1) AS INT) AS n FROM documents)""",
    "entry_topics": "SELECT 'doc' || doc_id AS citation_key, source AS slug, CAST(0.5 + (doc_id % 5) / 10 AS DOUBLE) AS confidence FROM documents",
    "provenance": """SELECT event_id AS id, user_id AS entry_id, event_type AS field_name, props AS field_value, 'src' || (event_id % 4) AS source_label, round(value, 4) AS value,
      CASE WHEN event_id % 3 = 0 THEN 'accepted' WHEN event_id % 7 = 0 THEN 'rejected' ELSE 'open' END AS status, ts AS recorded_at FROM events""",
    "refs": rf"""SELECT n AS ref_id, CASE n % 4
      WHEN 0 THEN nm || ' (' || yr || '). ' || title || '. Journal of Parts ' || (n % 40 + 1) || '(' || (n % 6 + 1) || '): ' || (n % 300) || '-' || (n % 300 + 9) || '.' || doi
      WHEN 1 THEN fam || '. ' || title || '. University Press, ' || yr || '.' || doi
      WHEN 2 THEN regexp_replace(nm, '\.$', '') || '. ' || yr || '. ' || title || '. Technical Report No. ' || n || ', Parts Institute.' || doi
      ELSE title || ' without anything that tells the year' END AS line
    FROM (SELECT p_partkey AS n, CAST(1950 + p_partkey % 75 AS VARCHAR) AS yr, {_sql_pick(FAMILIES, "p_partkey")} AS fam,
      {_sql_pick(FAMILIES, "p_partkey")} || ', ' || left({_sql_pick(GIVEN, "p_partkey")}, 1) || '.' AS nm,
      array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' study' AS title,
      CASE WHEN p_partkey % 5 = 0 THEN ' doi:10.5555/p' || p_partkey ELSE '' END AS doi FROM part)""",
}


def with_tables(sql: str) -> str:
    """SQL with the model tables that it names defined before it."""
    used = [n for n in SQL_TABLES if re.search(rf"\b{n}\b", sql)]
    if not used:
        return sql
    ctes = ",\n".join(f"{n} AS ({SQL_TABLES[n]})" for n in used)
    body = sql.strip()
    if body[:14].upper() == "WITH RECURSIVE":
        return f"WITH RECURSIVE {ctes},\n{body[14:]}"
    return f"WITH {ctes},\n{body[4:]}" if body[:5].upper() == "WITH " else f"WITH {ctes}\n{body}"
