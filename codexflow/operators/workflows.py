"""Compositions: topic expansion, bootstraps, support gaps, enrichment, bundles, snapshots."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.functions import bibliographic as B
from codexflow.functions import text as T
from codexflow.operators import claims, dedupe, graph, store, topics
from codexflow.sources import bibtex


def expand_topic(
    entries: DataFrame, relations: DataFrame, seeds: DataFrame, phrase: str, rounds: int = 1, per_seed: int = 25, least: float = 0.2,
    as_of_year: int = 2026, recent_years: int = 5, most: int | None = None,
) -> DataFrame:
    """Entries met from the seeds in rounds, with relevance, whether they join the topic, and whether they are recent.

    ``most`` keeps the first by round and key. Nothing is stored: a preview is
    this table, a commit adds its assigned rows to the topic.
    """
    met = graph.expand_rounds(relations, entries, seeds, rounds, per_seed)
    rows = met.join(entries, "citation_key")
    venue = F.concat_ws(" ", "journal", "booktitle")
    rows = rows.select("citation_key", "round", "year", "title", F.round(topics.relevance(F.lit(phrase), venue=venue), 6).alias("relevance"))
    anchor = topics.title_anchor(F.lit(phrase), F.col("title"))
    out = rows.select("citation_key", "round", "relevance", ((F.col("relevance") >= least) & (anchor >= 0.2)).alias("assigned"), B.is_recent(F.col("year"), as_of_year, recent_years).alias("recent"))
    return out if most is None else out.orderBy("round", "citation_key").limit(most)


def bootstrap(entries: DataFrame, relations: DataFrame, seeds: DataFrame, candidates: DataFrame, topic: str, topic_limit: int = 5, expand: bool = True, per_seed: int = 25) -> DataFrame:
    """What a bootstrap brings: seeds, the best candidates of a topic that share a title word, and what these cite."""
    best = topics.rank_candidates(candidates, topic, seeds, topic_limit)
    anchored = best.filter(F.size(F.array_intersect(T.tokens(F.lit(topic)), T.tokens(F.col("title")))) > 0)
    rows = seeds.select("citation_key", F.lit("seed").alias("origin")).unionByName(anchored.select("citation_key", F.lit("topic").alias("origin")))
    if expand:
        more = graph.expand_rounds(relations, entries, rows.select("citation_key"), 1, per_seed).filter("round > 0")
        rows = rows.unionByName(more.select("citation_key", F.lit("expansion").alias("origin")))
    order = F.create_map(*[F.lit(x) for i, o in enumerate(("seed", "topic", "expansion")) for x in (o, i)])
    return rows.groupBy("citation_key").agg(F.min_by("origin", order[F.col("origin")]).alias("origin"))


def bootstrap_batch(jobs: Iterable[dict], entries: DataFrame, relations: DataFrame, seeds_of, candidates: DataFrame) -> DataFrame:
    """Bootstraps of several jobs ``{name, topic, topic_limit, expand}`` in one table; ``seeds_of(job)`` gives seeds."""
    each = [
        bootstrap(entries, relations, seeds_of(j), candidates, j["topic"], j.get("topic_limit", 5), j.get("expand", True)).select(F.lit(j["name"]).alias("job"), "*")
        for j in jobs
    ]
    return reduce(DataFrame.unionByName, each)


def support_gaps(claim_rows: DataFrame, entries: DataFrame, existing: DataFrame, keep: int = 3) -> DataFrame:
    """New support for claims ``(claim_id, claim)``: not among the existing references ``(title, doi)``, each title once a claim."""
    titles = existing.select(T.claim_title(F.col("title")).alias("t")).distinct()
    dois = existing.filter(T.filled("doi").isNotNull()).select(F.lower(F.trim("doi")).alias("d")).distinct()
    new = entries.withColumns({"t": T.claim_title(F.col("title")), "d": F.lower(F.trim(T.text("doi")))}).join(titles, "t", "left_anti").join(dois, "d", "left_anti")
    new = new.groupBy("t").agg(F.min("citation_key").alias("citation_key"), F.min_by("title", "citation_key").alias("title"))
    return claims.support(claim_rows, new, keep)


def enrich_canonicals(entries: DataFrame, found: DataFrame, unsafe: bool = False) -> DataFrame:
    """Weak canonical entries with resolutions ``(citation_key, new_title, new_year, new_author, found_by)`` and whether they may be applied."""
    weak = entries.withColumn("reasons", dedupe.weaknesses()).filter(F.size("reasons") > 0)
    rows = weak.join(found, "citation_key", "left")
    safe = (F.col("found_by") != "search") | dedupe.is_safe("search")
    return rows.select("citation_key", F.array_join("reasons", ",").alias("reasons"), F.when(F.col("new_title").isNull(), "unresolved").when(safe | F.lit(unsafe), "apply").otherwise("unsafe").alias("action"))


def corrections(groups: DataFrame, entries: DataFrame, asked: DataFrame) -> DataFrame:
    """Corrections ``(key, field_name, value)`` of clusters, with an error where there is no such cluster or field."""
    rows = asked.join(groups.select("key", "citation_key"), "key", "left").join(entries.select("citation_key", F.lit(True).alias("_e")), "citation_key", "left")
    error = F.when(F.col("citation_key").isNull(), "no such cluster").when(F.col("_e").isNull(), "no such entry").when(~F.col("field_name").isin(*dedupe.FIELDS), "no such field")
    return rows.select("key", "field_name", "value", "citation_key", error.alias("error"))


def verification_bibtex(verified: DataFrame, entries: DataFrame) -> DataFrame:
    """Best matches as BibTeX with ``x_status``, ``x_match_score``, ``x_query`` and ``x_alternates``."""
    info = F.concat_ws("|", T.text("doi"), T.text("title"), F.coalesce(F.get(T.names(F.col("author")), 0), F.lit("")), T.text("year"), F.format_string("%.2f", "score"))
    rows = verified.join(entries, "citation_key", "left").withColumn("info", F.when(F.col("citation_key").isNotNull(), info))
    others = F.transform(F.array_sort(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "info")))), lambda x: x["info"])
    rows = rows.groupBy("query_id").agg(F.min_by(F.struct("citation_key", "entry_type", "title", "author", "year", "doi", "score", "status"), "rank").alias("b"), F.array_join(others, " || ").alias("alternates"))
    b = F.col("b")
    fields = {c: b[c] for c in ("author", "title", "year", "doi")} | {"x_status": b["status"], "x_match_score": F.format_string("%.2f", F.coalesce(b["score"], F.lit(0.0))), "x_query": F.col("query_id").cast("string"), "x_alternates": F.col("alternates")}
    made = F.map_filter(F.create_map(*[x for k, v in fields.items() for x in (F.lit(k), T.filled(v))]), lambda _, v: v.isNotNull())
    key = F.coalesce(b["citation_key"], F.concat(F.lit("verification"), F.col("query_id").cast("string")))
    return rows.select("query_id", bibtex.render(F.coalesce(b["entry_type"], F.lit("misc")), key, made).alias("bibtex"))


def graph_json(traversal: DataFrame, entries: DataFrame) -> DataFrame:
    """One viewer's graph: nodes and edges as one JSON text, so only for a bounded traversal."""
    nodes = graph.graph_nodes(traversal, entries).agg(F.array_sort(F.collect_list(F.struct(F.col("citation_key").alias("id"), "label", "exists"))).alias("nodes"))
    edges = graph.numbered_edges(traversal).agg(F.array_sort(F.collect_list(F.struct("id", "source", "target", "relation"))).alias("edges"))
    return nodes.crossJoin(F.broadcast(edges)).select(F.to_json(F.struct("nodes", "edges")).alias("json"))


def topic_bundle(entries: DataFrame, topic: str) -> DataFrame:
    """A topic's files: a manifest, a log line and its bibliography, one row a file part."""
    mine = entries.filter(F.col("topic") == topic)
    fields = store.fields_map(["author", "title", "year", "journal", "booktitle", "publisher", "doi"])
    bib = mine.filter(~store.is_export_stub()).select(F.lit(f"{topic}/bibliography.bib").alias("path"), "citation_key", bibtex.render(F.col("entry_type"), F.col("citation_key"), fields).alias("content"))
    count = mine.agg(F.count("*").alias("works"), F.count_if(store.is_export_stub()).alias("stubs"))
    manifest = count.select(F.lit(f"{topic}/manifest.json").alias("path"), F.lit("").alias("citation_key"), F.to_json(F.struct(F.lit(topic).alias("topic"), "works", "stubs")).alias("content"))
    return manifest.unionByName(bib)


def works_with_identifiers(entries: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Entries with their identifiers ``(citation_key, scheme, value)`` as one sorted text."""
    said = F.array_join(F.array_sort(F.collect_set(F.concat_ws(":", "scheme", "value"))), ", ")
    return entries.join(identifiers.groupBy("citation_key").agg(said.alias("identifiers")), "citation_key", "left").select("citation_key", "title", T.text("identifiers").alias("identifiers"))


def paired_authors(c: Column) -> Column:
    """``Doe, J., Roe, K.`` as ``Doe, J. and Roe, K.``: fragments are family and given names in turn."""
    said = T.strip_chars(T.collapse(F.replace(c, F.lit("&"), F.lit(" and "))), " ,;:")
    bare = lambda x: F.trim(F.regexp_replace(x, r"(?i)^and\s+", ""))
    parts = F.filter(F.transform(F.split(said, ","), lambda x: F.trim(x)), lambda x: x != "")

    def joined(p):
        pair = lambda i: F.concat_ws(", ", bare(F.get(p, i)), bare(F.get(p, i + 1)))
        return F.array_join(F.transform(F.sequence(F.lit(0), F.size(p) - 1, F.lit(2)), pair), " and ")

    return T.let(parts, lambda p: F.when((said.contains(" and ") & ~said.contains(",")) | (F.size(p) < 2), said).otherwise(joined(p)))


def in_collection(title: Column, venue: Column) -> Column:
    """Title, editor, book title and publisher of ``…, in Editors, eds., Book: Publisher``; else null."""
    pattern = r"(?i)^(.*?), in (.+?),\s+eds?\.,\s+(.+)$"
    prefix, rest = T.clean_title(F.regexp_extract(venue, pattern, 1)), F.trim(F.regexp_extract(venue, pattern, 3))
    book, publisher = F.substring_index(rest, ": ", 1), F.regexp_extract(rest, r": (.*)$", 1)
    made = F.struct(
        F.when(prefix != "", T.clean_title(F.concat(title, F.lit(": "), prefix))).otherwise(title).alias("title"), paired_authors(F.regexp_extract(venue, pattern, 2)).alias("editor"),
        T.clean_title(book).alias("booktitle"), F.nullif(T.clean_title(publisher), F.lit("")).alias("publisher"),
    )
    return F.when(venue.rlike(pattern), made)


def snapshot(tables: dict[str, DataFrame], path: str) -> None:
    """Copy tables to a folder of their own: a backup that ``restore`` reads."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def restore(spark: SparkSession, path: str, names: Iterable[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{path}/{n}") for n in names}
