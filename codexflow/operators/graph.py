"""The citation graph: edges, traversal by levels, expansion and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codexflow.functions import bibliographic as B
from codexflow.functions import text as T
from codexflow.operators.lineage import cut


def all_edges(relations: DataFrame) -> DataFrame:
    """Stored edges and, for each ``cites`` edge, the derived reverse one."""
    back = relations.filter("relation = 'cites'").select(F.col("target").alias("source"), F.col("source").alias("target"), F.lit("cited_by").alias("relation"))
    return relations.select("source", "target", "relation").unionByName(back).dropDuplicates(["source", "target", "relation"])


def traverse(
    relations: DataFrame, entries: DataFrame, seeds: DataFrame, relation_types: tuple[str, ...] = ("cites",), max_depth: int = 1,
    review_status: str | None = None, include_missing: bool = True,
) -> DataFrame:
    """Edges met when going out from the seeds, level by level.

    Each expanded node's edges come once, one deeper than the node, those back
    to known nodes too. Targets without an entry are told but not expanded.
    With ``review_status`` other targets are neither; ``include_missing``
    matters only then. The levels' number is a parameter, so the plan has a
    known size; a node is expanded at its least depth. From the third level on
    each level's frontier is kept, so earlier levels aren't computed again.
    """
    edges = all_edges(relations).filter(F.col("relation").isin(*relation_types))
    known = entries.select(F.col("citation_key").alias("target"), F.col("review_status").alias("target_review_status"), F.col("title").alias("target_title"), F.lit(True).alias("_known"))
    edges = edges.join(known, "target", "left").withColumn("target_exists", F.coalesce("_known", F.lit(False))).drop("_known")
    if review_status is not None:
        edges = edges.filter((F.col("target_exists") & (F.col("target_review_status") == review_status)) | (~F.col("target_exists") & F.lit(include_missing)))
    frontier = seeds.select(F.col("citation_key").alias("source")).distinct()
    visited, out = frontier, None
    for depth in range(1, max_depth + 1):
        met = edges.join(frontier, "source", "left_semi").withColumn("depth", F.lit(depth))
        out = met if out is None else out.unionByName(met)
        if depth < max_depth:
            frontier = met.filter("target_exists").select(F.col("target").alias("source")).distinct().join(visited, "source", "left_anti")
            frontier = cut(frontier) if max_depth > 2 else frontier
            visited = visited.unionByName(frontier)
    return out.select("source", "target", "relation", "depth", "target_exists", "target_review_status", "target_title")


def missing_targets(traversal: DataFrame) -> DataFrame:
    return traversal.filter(~F.col("target_exists"))


def graph_nodes(traversal: DataFrame, entries: DataFrame) -> DataFrame:
    """Each node once, with its title or key and whether it has an entry."""
    keys = traversal.select(F.col("source").alias("citation_key")).unionByName(traversal.select(F.col("target").alias("citation_key"))).distinct()
    found = entries.select("citation_key", "title", F.lit(True).alias("_known"))
    return keys.join(found, "citation_key", "left").select("citation_key", F.coalesce(T.filled("title"), "citation_key").alias("label"), F.coalesce("_known", F.lit(False)).alias("exists"))


def numbered_edges(traversal: DataFrame) -> DataFrame:
    """Edges in order with their number: for one viewer's graph, so on one task."""
    w = Window.orderBy("depth", "relation", "source", "target")
    return traversal.select(F.concat(F.lit("edge-"), F.row_number().over(w).cast("string")).alias("id"), "source", "target", "relation", "depth")


def dot_lines(traversal: DataFrame) -> DataFrame:
    """The edges as lines of a DOT graph."""
    q = lambda c: F.concat(F.lit('"'), T.escape_dot(F.col(c)), F.lit('"'))
    return traversal.select(F.concat(F.lit("  "), q("source"), F.lit(" -> "), q("target"), F.lit(' [label="'), "relation", F.lit('"];')).alias("line")).distinct()


def expand_references(entries: DataFrame, payloads: DataFrame, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """New entries and ``cites`` edges from reference lists of works.

    ``payloads``: citation_key, references (array of structs with DOI, author,
    year, article-title, volume-title, journal-title, unstructured).
    """
    rows = payloads.select("citation_key", F.posexplode("references").alias("pos", "ref"))
    if limit is not None:
        rows = rows.filter(F.col("pos") < limit)
    r = lambda c: T.filled(F.col("ref")[c])
    title = F.coalesce(r("article-title"), r("volume-title"), r("unstructured"), r("journal-title"))
    rows = rows.filter(r("DOI").isNotNull() | title.isNotNull())
    ordinal = F.col("pos") + 1
    named = F.coalesce(title, F.concat(F.lit("Referenced work "), ordinal.cast("string")))
    key = B.cited_key(F.col("ref")["DOI"], F.col("ref")["author"], F.col("ref")["year"], named, ordinal)
    kind = F.when(r("journal-title").isNotNull() | r("article-title").isNotNull(), "article").when(r("volume-title").isNotNull(), "book").otherwise("misc")
    rows = rows.select(
        F.col("citation_key").alias("source"), key.alias("citation_key"), kind.alias("entry_type"), named.alias("title"), r("year").alias("year"), r("author").alias("author"),
        F.lower(r("DOI")).alias("doi"), r("journal-title").alias("journal"), "pos", F.when(r("DOI").isNotNull(), 1.0).otherwise(0.6).alias("confidence"),
    )
    known = entries.filter(T.filled("doi").isNotNull()).groupBy(F.lower("doi").alias("doi")).agg(F.min("citation_key").alias("existing"))
    rows = rows.join(known, "doi", "left").withColumn("citation_key", F.coalesce("existing", "citation_key"))
    new = rows.filter("existing is null").groupBy("citation_key").agg(*[F.min_by(c, F.struct("source", "pos")).alias(c) for c in ("entry_type", "title", "year", "author", "doi", "journal")])
    edges = rows.groupBy("source", F.col("citation_key").alias("target")).agg(F.max("confidence").alias("confidence")).withColumn("relation", F.lit("cites"))
    return new.join(entries.select("citation_key"), "citation_key", "left_anti"), edges.select("source", "target", "relation", "confidence")


def existing_keys(found: DataFrame, entries: DataFrame) -> DataFrame:
    """The key of the entry that a found work already has: by doi, else by openalex id."""
    doi = entries.filter(T.filled("doi").isNotNull()).groupBy(F.lower("doi").alias("doi")).agg(F.min("citation_key").alias("by_doi"))
    oa = entries.filter(T.filled("openalex").isNotNull()).groupBy(F.upper("openalex").alias("openalex")).agg(F.min("citation_key").alias("by_oa"))
    out = found.withColumns({"doi": F.lower("doi"), "openalex": F.upper("openalex")}).join(doi, "doi", "left").join(oa, "openalex", "left")
    return out.withColumn("existing_key", F.coalesce("by_doi", "by_oa")).drop("by_doi", "by_oa")


def directed(found: DataFrame, relation: str) -> DataFrame:
    """Edges from found works: ``cites`` goes out from the seed, ``cited_by`` comes in, ``both`` each."""
    kinds = ("cites", "cited_by") if relation == "both" else (relation,)
    rows = found.filter(F.col("relation").isin(*kinds))
    out = F.col("relation") == "cites"
    return rows.select(F.when(out, F.col("seed")).otherwise(F.col("found")).alias("source"), F.when(out, F.col("found")).otherwise(F.col("seed")).alias("target"), F.lit("cites").alias("relation"))


def expand_rounds(relations: DataFrame, entries: DataFrame, seeds: DataFrame, rounds: int, per_seed: int) -> DataFrame:
    """Round by round, each seed's first targets by key; a key comes in its first round.

    ``citation_key``, ``round``: seeds are round 0.
    """
    edges = relations.filter("relation = 'cites'").join(entries.select(F.col("citation_key").alias("target")), "target", "left_semi")
    rank = Window.partitionBy("source").orderBy("target")
    first = edges.withColumn("_n", F.row_number().over(rank)).filter(F.col("_n") <= per_seed).select("source", "target")
    level = seeds.select("citation_key").distinct().withColumn("round", F.lit(0))
    out = level
    for i in range(1, rounds + 1):
        found = first.join(level.select(F.col("citation_key").alias("source")), "source", "left_semi").select(F.col("target").alias("citation_key")).distinct()
        level = found.join(out.select("citation_key"), "citation_key", "left_anti").withColumn("round", F.lit(i))
        level = cut(level) if rounds > 2 else level
        out = out.unionByName(level)
    return out
