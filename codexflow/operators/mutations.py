"""Single mutations of the store, each as new table versions with what was accepted.

Changes are tables, so one call serves one row or many. Nothing is collected;
rows that the store refuses are told by the ``accepted`` table's absence of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import text as T
from codexflow.operators import store

#: Types of works that reviews are written about (fixed values).
REVIEWED_TYPES = ("book", "incollection", "inproceedings", "phdthesis")
#: Marks behind a thesis' title (fixed values).
THESIS_TAILS = (" ProQuest", " UMI No.", " Dissertation Abstracts", " University Microfilms")


def get_entry(entries: DataFrame, key: str) -> DataFrame:
    """The entry of a key, or no row."""
    return entries.filter(F.col("citation_key") == key)


def replace_entries(entries: DataFrame, replacements: DataFrame, review_status: str = "enriched") -> DataFrame:
    """New version in which existing entries take all fields of their replacement.

    Keys and full texts stay, the status is set; replacements without an entry
    are refused. Of several for a key the last by ``ordinal`` counts.
    """
    new = store.last_writes(replacements, ["citation_key"], [F.desc("ordinal")]).withColumn("_new", F.lit(True))
    fixed = {"citation_key", "fulltext", "entry_id"}
    a, b = entries.alias("a"), new.alias("b")
    value = lambda c: F.when(F.col("b._new"), F.lit(review_status) if c == "review_status" else F.col(f"b.{c}") if c in new.columns else F.lit(None)).otherwise(F.col(f"a.{c}"))
    return a.join(b, F.col("a.citation_key") == F.col("b.citation_key"), "left").select(*[F.col(f"a.{c}") if c in fixed else value(c).alias(c) for c in entries.columns])


def add_relations(relations: DataFrame, log: DataFrame, entries: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """New versions of relations and of their log: sources must exist, known edges stay, each call is logged."""
    accepted = new.join(entries.select(F.col("citation_key").alias("source")), "source", "left_semi")
    edges = accepted.select("source", "target", "relation")
    return store.insert_ignore(relations.select("source", "target", "relation"), edges, ["source", "target", "relation"]), log.unionByName(accepted.select(log.columns))


def relations_with_log(relations: DataFrame, entries: DataFrame, log: DataFrame) -> DataFrame:
    """Edges of known entries, each with all its log rows, or one row without."""
    known = relations.join(entries.select(F.col("citation_key").alias("source")), "source", "left_semi")
    return known.join(log, ["source", "target", "relation"], "left")


def ensure_topics(topics: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert by slug: the name is overwritten, other fields only by a value."""
    return store.upsert(topics, changes, ["slug"], tuple(c for c in topics.columns if c not in ("slug", "name", "source_type")))


def add_entry_topics(members: DataFrame, entries: DataFrame, changes: DataFrame) -> DataFrame:
    """Upsert memberships of entries that exist."""
    accepted = changes.join(entries.select("citation_key"), "citation_key", "left_semi")
    return store.upsert(members, accepted, ["citation_key", "slug"])


def apply_conflicts(entries: DataFrame, conflicts: DataFrame, fields: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Entries with the value of their latest open conflict of each field, and the conflicts with those accepted."""
    latest = store.latest_open(conflicts.filter(F.col("field_name").isin(*fields)))
    # At most one value for each field.
    values = latest.groupBy("entry_id").agg(F.map_from_entries(F.collect_list(F.struct("field_name", "field_value"))).alias("_values"))
    new = lambda c: F.when(F.map_contains_key("_values", F.lit(c)), F.col("_values")[c]).otherwise(F.col(c))
    out = entries.join(values, "entry_id", "left").select(*[new(c).alias(c) if c in fields else F.col(c) for c in entries.columns])
    done = latest.select("id", F.lit(True).alias("_done"))
    status = F.when(F.col("_done"), "accepted").otherwise(F.col("status"))
    return out, conflicts.join(done, "id", "left").withColumn("status", status).drop("_done")


def encode_extra(fields: Column) -> Column:
    """A field map as JSON, by name; blanks are left out."""
    kept = F.map_filter(fields, lambda _, v: T.text(v) != "")
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(kept))))


def decode_extra(said: Column) -> Column:
    """A JSON object as a field map; anything else is empty."""
    return F.coalesce(F.from_json(said, "map<string,string>"), F.create_map().cast("map<string,string>"))


def filter_clusters(members: DataFrame, text: str, columns: tuple[str, ...]) -> DataFrame:
    """Members of clusters in which any of the columns holds the text, without regard to case."""
    return members.filter(F.exists(F.array(*[F.lower(T.text(c)) for c in columns]), lambda c: F.contains(c, F.lit(text.lower()))))


def without_reviews(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Found works, but no article without an abstract whose title is that of another work of a reviewed type."""
    title = F.trim(F.lower(T.text("title")))
    # Two keys of a title tell whether another one has it.
    works = entries.filter(F.col("entry_type").isin(*REVIEWED_TYPES) & (title != "")).groupBy(title.alias("_t")).agg(F.min("citation_key").alias("_a"), F.max("citation_key").alias("_b"))
    rows = found.withColumn("_t", title).join(works, "_t", "left")
    other = F.col("_a").isNotNull() & ((F.col("_a") != F.col("citation_key")) | (F.col("_b") != F.col("citation_key")))
    review = (F.col("entry_type") == "article") & (T.text("abstract") == "") & other
    return rows.filter(~review).select(found.columns)


def thesis_title(text: Column, marker: str = r"(?i)\(?\b(?:ph\.?\s*d\.?|doctoral|master'?s|m\.?\s*[as]\.?)\s+(?:thesis|dissertation)\b") -> Column:
    """The title before a thesis' mark and catalogue numbers; behind the author's sentence if there was a mark."""
    said = T.clean_title(T.collapse(T.text(text)))
    head = T.strip_chars(F.regexp_replace(said, f"(?s){marker}.*$", ""), " .")
    marked = said.rlike(marker)
    out = F.when(marked, head).otherwise(said)
    for tail in THESIS_TAILS:
        out = F.when(F.contains(out, F.lit(tail)), T.strip_chars(F.substring_index(out, tail, 1), " .")).otherwise(out)
    rest = F.trim(F.regexp_replace(out, r"^.*?\. ", ""))
    return T.strip_chars(F.when(marked & F.contains(out, F.lit(". ")), rest).otherwise(out), " .")


def lenient_json(text: Column) -> Column:
    """The JSON in a text: the whole, a fenced block, or from the first bracket to the last; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(\{.*\}|\[.*\])\s*```", 1)
    tries = [text, fenced, F.regexp_extract(text, r"(?s)\{.*\}", 0), F.regexp_extract(text, r"(?s)\[.*\]", 0)]
    good = lambda c: F.when((F.trim(c) != "") & F.try_parse_json(c).isNotNull(), F.trim(c))
    return F.coalesce(*map(good, tries))


def extraction_note(note: Column, backend: Column, raw: Column) -> Column:
    """A note with the extraction's facts that it doesn't have yet."""
    said = F.trim(T.text(note))
    lacks = lambda word: ~F.contains(F.lower(said), F.lit(word))
    fact = lambda name, value: F.concat(F.lit(name + " = {"), value, F.lit("}"))
    return F.concat_ws(
        "; ", F.when(said != "", said), F.when(lacks("extracted_reference"), fact("extracted_reference", F.lit("true"))), F.when(lacks("extracted_by"), fact("extracted_by", backend)),
        F.when((T.text(raw) != "") & lacks("raw_reference"), fact("raw_reference", raw)),
    )
