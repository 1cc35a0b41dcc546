"""References out of plain text: blocks, three parsers, venues, comparison of backends.

A parser is a set of column expressions over one line of text; the first that
fits wins. Lines become blocks within their document's row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import bibliographic as B
from codexflow.functions import text as T

START = r"^(?:\[\d+\]|\d+\.|\(\d+\))\s*"
LEAST_CHARS = 20
VOLUME = r"(\d+)\s*(?:\(([^)]+)\))?\s*[:;,]\s*(\d+\s*[-–]\s*\d+)\b"
PAGES = r"(?i)\bpp?\.\s*(\d+\s*[-–]\s*\d+)\b"
LAST_PAGES = r"[,;]\s*(\d+\s*[-–]\s*\d+)\.?$"
REPORT = r"(?i)\b(?:technical\s+report|report|working\s+paper|bulletin)\s+(?:no\.?|number)?\s*([A-Za-z0-9.\-]+)\b"


def reference_blocks(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``ordinal`` (from 1) and ``line`` of each block.

    A blank line or a numbered start ends a block; lines under 20 characters
    are left out before they could start one.
    """
    def line(raw: Column) -> Column:
        said = F.btrim(raw, F.lit(" \t\f\x0b"))
        return F.struct(said.rlike(START).alias("starts"), F.translate(T.collapse(F.regexp_replace(said, START, "")), "\x01", " ").alias("line"), (said == "").alias("blank"))

    raw = F.split(F.regexp_replace(T.text(text), "\r\n?", "\n"), "\n")
    kept = texts.select(key, F.filter(F.transform(raw, line), lambda x: (F.length(x["line"]) >= LEAST_CHARS) | x["blank"]).alias("lines"))
    # Lines are put together within their row, so no text is shuffled: a mark stands before each block.
    first = lambda x, i: x["starts"] | (i == 0) | F.get(F.col("lines"), i - 1)["blank"]
    marked = F.transform("lines", lambda x, i: F.when(x["blank"], "").otherwise(F.concat(F.when(first(x, i), "\x01").otherwise(" "), x["line"])))
    blocks = F.split(F.array_join(marked, ""), "\x01")
    # What stands before the first mark is empty.
    rows = kept.select(key, F.posexplode(F.slice(blocks, 2, F.greatest(F.size(blocks) - 1, F.lit(0)))).alias("at", "line"))
    return rows.select(key, (F.col("at") + 1).cast("long").alias("ordinal"), "line")


def _before(c: Column, pattern: str) -> Column:
    """What stands before the first match."""
    return F.regexp_replace(c, f"(?s){pattern}.*$" if not pattern.startswith("(?i)") else f"(?is){pattern[4:]}.*$", "")


def _after(c: Column, pattern: str) -> Column:
    return F.regexp_replace(c, f"(?s)^.*?{pattern}" if not pattern.startswith("(?i)") else f"(?is)^.*?{pattern[4:]}", "")


_PAREN_YEAR = r"(?i)\((?:1[6-9]|20|21)\d{2}[a-z]?\)"


def _year_style(line: Column, pattern: str) -> Column:
    """Author, year, title and venue around the first year; null if a part is missing."""
    year = F.regexp_extract(line, pattern, 0)
    author = T.strip_chars(_before(line, pattern), " .")
    rest = T.strip_chars(_after(line, pattern), " .")
    parts = F.filter(F.transform(F.split(rest, r"\. "), lambda x: T.strip_chars(x, " .")), lambda x: x != "")
    title, venue = T.clean_title(F.coalesce(F.get(parts, 0), F.lit(""))), T.clean_title(F.array_join(F.slice(parts, 2, 1000), ". "))
    made = F.struct(T.normalize_authors(author).alias("author"), T.strip_chars(year, "()").alias("year"), title.alias("title"), venue.alias("venue"), F.lit(False).alias("publisher_style"))
    return F.when((year != "") & (author != "") & (rest != "") & (title != "") & (T.normalize_authors(author) != ""), made)


def _publisher_style(line: Column) -> Column:
    """``Author. Title. Publisher, year``."""
    year = F.regexp_extract(line, B.YEAR, 0)
    prefix = T.strip_chars(_before(line, B.YEAR), " .,;")
    head = F.regexp_extract(prefix, r"(?s)^(.*)\.[^.]*$", 1)
    publisher = T.strip_chars(F.regexp_extract(prefix, r"([^.]*)$", 1), " .,;")
    author = T.normalize_authors(F.substring_index(head, ".", 1))
    title = T.clean_title(F.regexp_replace(head, r"(?s)^[^.]*\.", ""))
    made = F.struct(author.alias("author"), year.alias("year"), title.alias("title"), publisher.alias("venue"), F.lit(True).alias("publisher_style"))
    return F.when((year != "") & head.contains(".") & (author != "") & (title != "") & (publisher != ""), made)


def venue_metadata(venue: Column) -> Column:
    """Type, venue, volume, number, pages and report number in a venue's text."""
    said = T.strip_chars(T.text(venue), " .")
    kind = B.entry_type_of(said)
    hit = lambda p, g: B.found(said, p, g)
    by_volume, by_pages, by_last = said.rlike(VOLUME), said.rlike(PAGES), said.rlike(LAST_PAGES)
    pages = F.when(by_volume, hit(VOLUME, 3)).when(by_pages, hit(PAGES, 1)).when(by_last, hit(LAST_PAGES, 1))
    short = F.when(by_volume, _before(said, VOLUME)).when(by_pages, _before(said, PAGES)).when(by_last, _before(said, LAST_PAGES)).otherwise(said)
    short = F.coalesce(F.nullif(T.strip_chars(short, " ,;:."), F.lit("")), said)
    report = T.clean_title(F.regexp_replace(F.regexp_replace(short, r"(?i)\b(?:technical\s+report|tech report|report|working\s+paper|bulletin)\b", ""), r"(?i)\b(?:no\.?|number)\s*[A-Za-z0-9.\-]+\b", ""))
    thesis = T.clean_title(F.regexp_replace(F.regexp_replace(short, r"(?i)\b(?:ph\.?d\.?|doctoral|doctor's|master'?s)\s+(?:dissertation|thesis)\b", ""), r"(?i)^\((?:master|doctoral).*?\)\s*", ""))
    place = F.when(kind == "techreport", F.coalesce(F.nullif(report, F.lit("")), short)).when(kind.isin("phdthesis", "mastersthesis"), F.coalesce(F.nullif(thesis, F.lit("")), short)).otherwise(short)
    number = F.coalesce(F.when(kind == "techreport", hit(REPORT, 1)), F.when(by_volume, hit(VOLUME, 2)))
    return F.struct(kind.alias("entry_type"), F.nullif(place, F.lit("")).alias("venue"), F.when(by_volume, hit(VOLUME, 1)).alias("volume"), number.alias("number"), B.normalize_pages(pages).alias("pages"))


#: The field that a venue goes to, by type.
SLOTS = {"article": "journal", "inproceedings": "booktitle", "incollection": "booktitle", "book": "publisher", "phdthesis": "school", "mastersthesis": "school", "techreport": "institution"}


def parse_references(blocks: DataFrame, line: str = "line", ordinal: str = "ordinal") -> DataFrame:
    """Blocks with ``entry_type``, ``citation_key`` and ``fields``; blocks that no parser reads go."""
    c = F.col(line)
    rows = blocks.withColumn("p", F.coalesce(_year_style(c, _PAREN_YEAR), _publisher_style(c), _year_style(c, B.YEAR))).filter("p is not null")
    rows = rows.withColumn("m", venue_metadata(F.col("p")["venue"]))
    own = F.when(F.col("p")["publisher_style"] & ~F.col("m")["entry_type"].isin("book", "phdthesis", "mastersthesis", "techreport"), "book").otherwise(F.col("m")["entry_type"])
    rows = rows.withColumn("entry_type", own)
    slot = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SLOTS.items() for x in kv]), F.col("entry_type")), F.lit("howpublished"))
    p, m = F.col("p"), F.col("m")
    plain = {"author": p["author"], "year": p["year"], "title": p["title"], "volume": m["volume"], "number": m["number"], "pages": m["pages"]}
    fields = F.map_concat(F.create_map(*[x for k, v in plain.items() for x in (F.lit(k), v)], slot, m["venue"]), B.identifier_fields(c))
    rows = rows.withColumn("fields", F.map_filter(fields, lambda _, v: v.isNotNull() & (v != "")))
    return rows.withColumn("citation_key", B.reference_key(p["author"], p["year"], p["title"], F.col(ordinal))).drop("p", "m")


#: Backends by name: each takes blocks and returns parsed references.
BACKENDS: dict[str, Callable[[DataFrame], DataFrame]] = {"heuristic": parse_references}


def register_backend(name: str, backend: Callable[[DataFrame], DataFrame]) -> None:
    BACKENDS[name] = backend


def compare_backends(results: dict[str, DataFrame], key: str, fields: tuple[str, ...]) -> DataFrame:
    """One row for each reference: which backends have it, and the fields in which they differ.

    Results ``(key, fields map)`` meet by key; a missing value is a value of its own.
    """
    rows = None
    for name, df in results.items():
        one = df.select(key, F.lit(name).alias("backend"), "fields")
        rows = one if rows is None else rows.unionByName(one)
    n = len(results)
    value = lambda f: F.coalesce(F.try_element_at("fields", F.lit(f)), F.lit("<missing>"))
    differs = [((F.size(F.collect_set(value(f))) > 1) | ((F.count("*") < n) & (F.max(value(f)) != "<missing>"))).alias(f"_{f}") for f in fields]
    out = rows.groupBy(key).agg(F.array_sort(F.collect_set("backend")).alias("backends"), *differs)
    return out.select(key, "backends", F.array_compact(F.array(*[F.when(F.col(f"_{f}"), F.lit(f)) for f in fields])).alias("differing_fields"))


def comparison_summary(comparison: DataFrame) -> DataFrame:
    """How often each field differs: ``field``, ``n``, beside rows and rows with any difference."""
    total = comparison.agg(F.count("*").alias("row_count"), F.count_if(F.size("differing_fields") > 0).alias("rows_with_differences"))
    each = comparison.select(F.explode("differing_fields").alias("field")).groupBy("field").agg(F.count("*").alias("n"))
    return each.crossJoin(F.broadcast(total))  # one row


def threshold_failures(summary: DataFrame, most: dict[str, int]) -> DataFrame:
    """A line for each field that differs more often than allowed."""
    limit = F.try_element_at(F.create_map(*[F.lit(x) for kv in most.items() for x in kv]), F.col("field"))
    return summary.filter(F.col("n") > limit).select("field", F.format_string("%s differs in %d rows, at most %d", "field", "n", limit).alias("failure"))


def is_citation_blob(c: Column) -> Column:
    """Text that is a citation, not a title."""
    low, count = F.lower(c), lambda x: F.length(c) - F.length(F.replace(c, F.lit(x), F.lit("")))
    return (
        low.rlike(r"http://|https://|www\.| accessed | url |supporting material|grant|poll results|prescribing information")
        | (count(",") >= 3) | (count(";") >= 2) | c.rlike(r"(?i)\(\d{4}[a-z]?\)") | c.rlike(r"\b[A-Z]\.[ ]?[A-Z]?\.")
    )


def carry_authors(refs: DataFrame, page: str = "page", at: str = "at", line: str = "line") -> DataFrame:
    """``---`` in place of the author becomes the page's last author before it."""
    dash = F.col(line).rlike(r"^\s*[-_]{3,}\s*,?\s*")
    own = F.when(~dash, F.nullif(F.trim(F.substring_index(F.regexp_replace(F.col(line), B.CORPUS_YEAR, "\x01$1"), "\x01", 1)), F.lit("")))
    w = Window.partitionBy(page).orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    last = F.last(own, ignorenulls=True).over(w)
    return refs.withColumn(line, F.when(dash & last.isNotNull(), F.concat(last, F.lit(" "), F.regexp_replace(F.col(line), r"^\s*[-_]{3,}\s*,?\s*", ""))).otherwise(F.col(line)))
