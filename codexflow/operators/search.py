"""Phrase search with BM25 ranking, and its index.

A query is one literal phrase. A row's phrase hits are counted by a pattern
over the folded text, in the JVM, so only counts leave the scan: the whole
corpus' statistics are one row, and the ranking is a top-k without a full sort.
"""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import text as T

COLUMNS = ("title", "abstract", "fulltext")
_TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.2, 0.75


def phrase_tokens(phrase: str) -> list[str]:
    """The folded tokens of a query."""
    plain = "".join(c for c in unicodedata.normalize("NFD", phrase.strip().lower()) if not unicodedata.combining(c))
    return [t for t in re.findall(r"[^\W_]+", plain)]


def phrase_hits(c: Column, tokens: list[str]) -> Column:
    """How often the tokens follow one another in a column; overlapping hits count each."""
    phrase = r"[^\p{L}\p{N}]+".join(tokens)
    return F.regexp_count(T.fold(T.text(c)), F.lit(rf"(?<![\p{{L}}\p{{N}}])(?={phrase}(?![\p{{L}}\p{{N}}]))"))


def token_count(c: Column) -> Column:
    return F.regexp_count(T.text(c), F.lit(_TOKEN))


def build_index(entries: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The search index: folded columns and the row's number of tokens; written, it serves any query."""
    folded = [T.fold(T.text(c)).alias(c) for c in columns]
    return entries.select("citation_key", *folded, sum((token_count(F.col(c)) for c in columns), F.lit(0)).alias("n_tokens"))


def search_text(entries: DataFrame, phrase: str, limit: int | None = 10, members: DataFrame | None = None, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """Rows with the phrase within one column, best first: ``citation_key, title, year, score``.

    More negative is better. ``members`` (column ``citation_key``) restricts the
    rows after the statistics, which are those of the whole corpus.
    """
    tokens = phrase_tokens(phrase)
    if not tokens:
        return entries.select("citation_key", "title", "year", F.lit(0.0).alias("score")).limit(0)
    hits = sum((phrase_hits(F.col(c), tokens) for c in columns), F.lit(0))
    size = sum((token_count(F.col(c)) for c in columns), F.lit(0))
    rows = entries.select("citation_key", "title", "year", hits.alias("f"), size.alias("d"))
    stats = rows.agg(F.count("*").alias("n_rows"), F.count_if(F.col("f") > 0).alias("n_hit"), F.avg("d").alias("mean"))
    found = rows.filter("f > 0")
    if members is not None:
        found = found.join(members.select("citation_key"), "citation_key", "left_semi")
    # The statistics are one row.
    scored = found.crossJoin(F.broadcast(stats)).select("citation_key", "title", "year", bm25().alias("score"))
    return scored if limit is None else scored.orderBy("score", "citation_key").limit(limit)


def postings(entries: DataFrame, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The positions of each term in each column: ``term, citation_key, column, positions``."""
    tokens = lambda c: F.regexp_extract_all(T.fold(T.text(c)), F.lit(_TOKEN), F.lit(0))
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), tokens(F.col(c)).alias("words")) for c in columns]))
    words = entries.select("citation_key", each.alias("e")).select("citation_key", "e.column", F.posexplode("e.words").alias("at", "term"))
    return words.groupBy("term", "citation_key", "column").agg(F.array_sort(F.collect_list("at")).alias("positions"))


#: Parts of the postings by their term's hash: a phrase reads only its own.
PARTS = 64


def _part(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def write_index(entries: DataFrame, path: str, columns: tuple[str, ...] = COLUMNS) -> None:
    """Write the index's three tables: postings by part, rows with their size, and the corpus' statistics."""
    size = sum((token_count(F.col(c)) for c in columns), F.lit(0))
    entries.select("citation_key", "title", "year", size.cast("long").alias("d")).write.mode("overwrite").parquet(f"{path}/rows")
    rows = entries.sparkSession.read.parquet(f"{path}/rows")
    rows.agg(F.count("*").alias("n_rows"), F.avg("d").alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")
    found = postings(entries, columns).withColumn("part", _part(F.col("term")))
    # Ranges of term and key: a word of most rows is split over files, and a term's rows are found by the files' statistics.
    found.repartitionByRange("part", "term", "citation_key").sortWithinPartitions("part", "term", "citation_key").write.mode("overwrite").partitionBy("part").parquet(f"{path}/postings")


def search_index(spark, path: str, phrase: str, limit: int | None = 10, members: DataFrame | None = None) -> DataFrame:
    """``search_text`` from a written index: reads the postings of the phrase's terms alone."""
    tokens = phrase_tokens(phrase)
    rows = spark.read.parquet(f"{path}/rows")
    if not tokens:
        return rows.select("citation_key", "title", "year", F.lit(0.0).alias("score")).limit(0)
    every = spark.read.parquet(f"{path}/postings")
    hit = None
    for i, t in enumerate(tokens):
        # The part's number is a constant, so other parts' folders aren't listed.
        part = spark.range(1).select(_part(F.lit(t))).first()[0]
        one = every.filter((F.col("part") == part) & (F.col("term") == t)).select("citation_key", "column", F.expr(f"transform(positions, p -> p - {i})").alias("p"))
        # Positions where the phrase would begin, of all its terms.
        hit = one if hit is None else hit.join(one.withColumnRenamed("p", "q"), ["citation_key", "column"]).select("citation_key", "column", F.array_intersect("p", "q").alias("p")).filter(F.size("p") > 0)
    f = hit.groupBy("citation_key").agg(F.sum(F.size("p")).alias("f"))
    stats = spark.read.parquet(f"{path}/stats").crossJoin(F.broadcast(f.agg(F.count("*").alias("n_hit"))))
    if members is not None:
        f = f.join(members.select("citation_key"), "citation_key", "left_semi")
    scored = f.join(rows, "citation_key").crossJoin(F.broadcast(stats)).select("citation_key", "title", "year", bm25().alias("score"))
    return scored if limit is None else scored.orderBy("score", "citation_key").limit(limit)


def bm25() -> Column:
    """The score of a row from its hits ``f`` and size ``d`` and the corpus' ``n_rows``, ``n_hit`` and ``mean``."""
    idf = F.ln((F.col("n_rows") - F.col("n_hit") + 0.5) / (F.col("n_hit") + 0.5))
    idf = F.when(idf <= 0, F.lit(1e-6)).otherwise(idf)
    norm = F.col("f") + K1 * (1 - B + B * F.col("d") / F.col("mean"))
    return -idf * F.col("f") * (K1 + 1) / norm


def search_like(entries: DataFrame, text: str, limit: int | None = 10, columns: tuple[str, ...] = COLUMNS) -> DataFrame:
    """The plain fallback: a case-insensitive pattern in any column, with score 0."""
    found = entries.filter(" or ".join(f"coalesce({c}, '') ilike :p" for c in columns).replace(":p", "'%" + text.replace("'", "''") + "%'"))
    out = found.select("citation_key", "title", "year", F.lit(0.0).alias("score"))
    return out if limit is None else out.orderBy("citation_key").limit(limit)
