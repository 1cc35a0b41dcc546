"""The store's operators: lists, filters, and mutations as new table versions.

A mutation is a function of the old table and a set of changes; the outcome is
the new table. Within one set of changes the last write (by ``ordinal``) wins.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import bibliographic as B
from codexflow.functions import text as T

def in_order(df: DataFrame, limit: int | None = None) -> DataFrame:
    """Entries without a year first, years as text."""
    out = df.orderBy(F.coalesce("year", F.lit("")), "citation_key")
    return out if limit is None else out.limit(limit)


def list_entries(entries: DataFrame, limit: int = 50) -> DataFrame:
    return in_order(entries.select("citation_key", "entry_type", "review_status", "title", "year"), limit)


def entry_with_topics(entries: DataFrame, entry_topics: DataFrame, topics: DataFrame) -> DataFrame:
    """Entries with their topics as a sorted array."""
    mine = entry_topics.join(topics.select("slug", "name"), "slug").groupBy("citation_key").agg(F.array_sort(F.collect_list(F.struct("slug", "name", "confidence"))).alias("topics"))
    return entries.join(mine, "citation_key", "left").withColumn("topics", F.coalesce("topics", F.array().cast("array<struct<slug:string,name:string,confidence:double>>")))


def same_title(entries: DataFrame, title: Column) -> DataFrame:
    """Entries whose title equals without regard to case and blanks around it."""
    return entries.filter(F.trim(F.lower("title")) == F.trim(F.lower(title)))


def is_stub(title="title", entry_type="entry_type", abstract="abstract") -> Column:
    low = F.lower(F.trim(T.text(title)))
    return (low == "") | low.startswith("referenced work ") | low.startswith("untitled") | ((F.col(entry_type) == "misc") & (F.trim(T.text(abstract)) == ""))


def resolution_candidates(entries: DataFrame, doi_only=False, misc_only=False, stub_only=False, topic: str | None = None) -> DataFrame:
    """Entries worth resolving, by any of the conditions together."""
    tests = [c for c, on in ((T.filled("doi").isNotNull(), doi_only), (F.col("entry_type") == "misc", misc_only), (is_stub(), stub_only)) if on]
    if topic is not None:
        tests.append(F.col("topic") == topic)
    return entries.filter(reduce(Column.__and__, tests, F.lit(True))).select("citation_key", "entry_type", "review_status", "title", "year", "doi", "abstract").distinct()


def is_export_stub(url: Column | None = None) -> Column:
    """Entries that an export leaves out: only a doi is known."""
    squeezed = lambda c: T.collapse(T.text(c))
    title, url = F.lower(squeezed("title")), T.collapse(T.text(F.lit("") if url is None else url))
    bare = (title == "") | title.startswith("referenced work ") | title.startswith("untitled")
    none = reduce(Column.__and__, [squeezed(c) == "" for c in ("author", "abstract", "journal", "booktitle")])
    return (squeezed("doi") != "") & bare & none & ((url == "") | url.startswith("https://doi.org/"))


def last_writes(changes: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The last change of each key. The window is ranked by key; all columns stay."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return changes.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def upsert(old: DataFrame, changes: DataFrame, keys: list[str], keep_old: tuple[str, ...] = (), order: list | None = None) -> DataFrame:
    """New version of ``old``: changed rows overwrite, but ``keep_old`` columns only with a value.

    ``order`` says which of several changes of a key is last (first in the order).
    """
    new = last_writes(changes, keys, order or [F.desc("ordinal")]).select(*old.columns)
    values = [c for c in old.columns if c not in keys]
    a, b = old.alias("a"), new.withColumn("_new", F.lit(True)).alias("b")
    on = reduce(Column.__and__, [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys])
    pick = lambda c: F.coalesce(f"b.{c}", f"a.{c}") if c in keep_old else F.when(F.col("b._new"), F.col(f"b.{c}")).otherwise(F.col(f"a.{c}"))
    return a.join(b, on, "full").select(*[F.coalesce(f"b.{k}", f"a.{k}").alias(k) for k in keys], *[pick(c).alias(c) for c in values])


def replace_children(old: DataFrame, new: DataFrame, key: str, changed: DataFrame) -> DataFrame:
    """Rows that belong to changed entries are rewritten: old ones go, new ones come."""
    return old.join(changed.select(key).distinct(), key, "left_anti").unionByName(new)


def insert_ignore(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Add the rows whose key isn't there."""
    return old.unionByName(new.dropDuplicates(keys).join(old.select(keys), keys, "left_anti").select(old.columns))


def delete_cascade(children: DataFrame, key: str, deleted: DataFrame) -> DataFrame:
    return children.join(deleted.select(key).distinct(), key, "left_anti")


def creators_of(entries: DataFrame) -> DataFrame:
    """One row for each author of each entry: ordinal from 1, family and given names."""
    rows = entries.select("citation_key", F.posexplode(T.names(F.col("author"))).alias("pos", "full_name"))
    p = T.person(F.col("full_name"))
    return rows.select("citation_key", (F.col("pos") + 1).alias("ordinal"), "full_name", p["family"].alias("family_name"), p["given"].alias("given_names"))


def author_field(creators: DataFrame) -> DataFrame:
    """The author field put together again, by ordinal."""
    ordered = F.array_sort(F.collect_list(F.struct("ordinal", "full_name")))
    return creators.groupBy("citation_key").agg(F.array_join(F.transform(ordered, lambda x: x["full_name"]), " and ").alias("author"))


def orphans(child: DataFrame, parent: DataFrame, keys: list[str]) -> DataFrame:
    return child.join(parent, keys, "left_anti")


def health(counts: dict[str, DataFrame], problems: dict[str, DataFrame]) -> DataFrame:
    """One row: how many rows each table has, the issues found, and a verdict."""
    # Each is one row.
    sizes = [df.agg(F.count("*").alias(f"n_{n}")) for n, df in counts.items()]
    issues = [df.agg(F.count("*").alias(f"_{n}")) for n, df in problems.items()]
    one = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), sizes + issues)
    found = F.array_compact(F.array(*[F.when(F.col(f"_{n}") > 0, F.lit(n)) for n in problems]))
    first = next(iter(counts))
    verdict = F.when(F.size(found) > 0, "degraded").when(F.col(f"n_{first}") == 0, "empty").otherwise("healthy")
    return one.select(*[f"n_{n}" for n in counts], F.array_join(found, ",").alias("issues"), verdict.alias("health"))


def fields_map(columns: list[str]) -> Column:
    """The named columns as a field map, blanks left out."""
    pairs = F.create_map(*[x for c in columns for x in (F.lit(c), T.filled(c))])
    return F.map_filter(pairs, lambda _, v: v.isNotNull())


def merge_fields(base: Column, new: Column) -> Column:
    """Merged field map: values fill missing and placeholder fields, others stay."""
    fill = lambda k, b, n: F.when(F.trim(T.text(n)) == "", b).when(B.is_placeholder(k, T.text(b)), n).otherwise(b)
    return F.map_filter(F.map_zip_with(base, new, fill), lambda _, v: v.isNotNull())


def merge_conflicts(base: Column, new: Column) -> Column:
    """Fields where both have a value and they differ: array of name, current, proposed."""
    pairs = F.map_zip_with(base, new, lambda k, b, n: F.when((F.trim(T.text(n)) != "") & ~B.is_placeholder(k, T.text(b)) & (b != n), F.struct(b.alias("current_value"), n.alias("proposed_value"))))
    found = F.filter(F.map_entries(pairs), lambda e: e["value"].isNotNull())
    return F.array_sort(F.transform(found, lambda e: F.struct(e["key"].alias("field_name"), e["value"]["current_value"].alias("current_value"), e["value"]["proposed_value"].alias("proposed_value"))))


def set_conflict_status(conflicts: DataFrame, where: Column, status: str) -> DataFrame:
    """Only open rows change."""
    return conflicts.withColumn("status", F.when((F.col("status") == "open") & where, F.lit(status)).otherwise(F.col("status")))


def latest_open(conflicts: DataFrame) -> DataFrame:
    """The latest open conflict of each entry and field."""
    return last_writes(conflicts.filter("status = 'open'"), ["entry_id", "field_name"], [F.desc("recorded_at"), F.desc("id")])


def protect(existing: Column, incoming: Column, protected: tuple[str, ...]) -> Column:
    """Incoming fields win, but for protected ones that have a value."""
    kept = F.map_filter(existing, lambda k, v: k.isin(*protected) & (F.trim(T.text(v)) != ""))
    value = lambda k, a, b: F.coalesce(F.try_element_at(kept, k), b, a)
    return F.map_zip_with(existing, F.map_filter(incoming, lambda _, v: F.trim(T.text(v)) != ""), value)
