"""Queries of the composed operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.operators import dedupe, graph, resolve, workflows
from codexflow.plans import corpus as C
from codexflow.plans import work_queries as W
from codexflow.plans.registry import query


@query(f"""WITH RECURSIVE f AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM relations WHERE target IN (SELECT citation_key FROM entries)) WHERE k <= 2),
w(k, r) AS (SELECT citation_key, 0 FROM entries WHERE entry_id % 40 = 0 UNION SELECT target, r + 1 FROM w JOIN f ON source = k WHERE r < 2), m AS (SELECT k, CAST(min(r) AS INT) AS r FROM w GROUP BY k), {W._REL_CTE}
SELECT k AS citation_key, r AS round, relevance, relevance >= 0.05 AND share > 0 AS assigned, coalesce(TRY_CAST(year AS INT) >= 2026 - 20, false) AS recent FROM m JOIN x ON x.citation_key = k JOIN entries e ON e.citation_key = k""")
def expand_topic(spark, sf):
    e = C.entries(spark, sf)
    return workflows.expand_topic(e, C.relations(spark, sf), e.filter("entry_id % 40 = 0"), "that with from evolution", rounds=2, per_seed=2, least=0.05, recent_years=20)


@query("""WITH s AS (SELECT citation_key FROM entries WHERE entry_id % 200 = 1), f AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM relations WHERE target IN (SELECT citation_key FROM entries)) WHERE k <= 25)
SELECT citation_key, 'seed' AS origin FROM s UNION ALL SELECT DISTINCT target, 'expansion' FROM f JOIN s ON source = s.citation_key WHERE target NOT IN (SELECT citation_key FROM s)""")
def bootstrap_composition(spark, sf):
    e = C.entries(spark, sf)
    c = e.select("citation_key", "title", "abstract", F.lit("openalex").alias("source"))
    return workflows.bootstrap(e, C.relations(spark, sf), e.filter("entry_id % 200 = 1"), c, "zzzq qqqz", topic_limit=5)


@query("SELECT citation_key, title, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) || ', ' ELSE '' END || 'openalex:W' || entry_id AS identifiers FROM entries")
def works_with_identifiers(spark, sf):
    e = C.entries(spark, sf)
    ids = e.filter("doi is not null").select("citation_key", F.lit("doi").alias("scheme"), F.lower("doi").alias("value"))
    ids = ids.unionByName(e.select("citation_key", F.lit("openalex").alias("scheme"), F.concat(F.lit("W"), F.col("entry_id").cast("string")).alias("value")))
    return workflows.works_with_identifiers(e, ids)


@query("SELECT p_partkey AS id, 'Doe, J. and Roe' || p_partkey || ', K. and Solo' AS authors FROM part")
def paired_authors(spark, sf):
    c = F.concat(F.lit(" Doe, J., & Roe"), F.col("p_partkey").cast("string"), F.lit(", K., Solo;"))
    return C.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), workflows.paired_authors(c).alias("authors"))


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN 'Main: ' || p_name END AS title, CASE WHEN p_partkey % 2 = 0 THEN 'Doe, J. and Roe, K.' END AS editor, CASE WHEN p_partkey % 2 = 0 THEN 'The Book' END AS booktitle, CASE WHEN p_partkey % 2 = 0 THEN 'Press' END AS publisher FROM part")
def in_collections(spark, sf):
    venue = F.when(F.col("p_partkey") % 2 == 0, F.concat("p_name", F.lit(", in Doe, J., and Roe, K., eds., The Book: Press"))).otherwise(F.col("p_name"))
    rows = C.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), workflows.in_collection(F.lit("Main"), venue).alias("c"))
    return rows.select("id", "c.title", "c.editor", "c.booktitle", "c.publisher")


@query(f"""WITH {W._KEYED}, {W._BEST} SELECT c.key, f AS field_name, 'v' AS value, m.citation_key, CASE WHEN m.citation_key IS NULL THEN 'no such cluster' WHEN f = 'shoe' THEN 'no such field' END AS error
FROM (SELECT key FROM best UNION ALL SELECT 'none') c LEFT JOIN best m ON m.key = c.key, (SELECT unnest(['title', 'shoe']) AS f)""")
def cluster_corrections(spark, sf):
    e = C.entries(spark, sf)
    best = dedupe.canonical(e)
    keys = best.select("key").unionByName(spark.createDataFrame([("none",)], "key string"))
    asked = keys.select("key", F.explode(F.array(F.lit("title"), F.lit("shoe"))).alias("field_name"), F.lit("v").alias("value"))
    return workflows.corrections(best, e, asked)


@query(f"""SELECT citation_key, reasons, CASE WHEN k = 0 THEN 'unresolved' WHEN k = 1 OR ok THEN 'apply' ELSE 'unsafe' END AS action FROM (SELECT citation_key, entry_id % 3 AS k, entry_id % 2 = 0 AND trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) = trim(regexp_replace(lower(title), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g')) AS ok,
  array_to_string(list_filter([CASE WHEN entry_type = 'misc' THEN 'entry_type:misc' END, CASE WHEN coalesce(trim(doi), '') = '' THEN 'missing:doi' END, CASE WHEN {W._RICH} < 6 THEN 'low_field_richness' END], lambda x: x IS NOT NULL), ',') AS reasons FROM entries) WHERE reasons <> ''""")
def enrich_canonicals(spark, sf):
    e = C.entries(spark, sf)
    found = e.filter("entry_id % 3 <> 0").select("citation_key", F.when(F.col("entry_id") % 2 == 0, F.col("title")).otherwise("Another").alias("new_title"), F.col("year").alias("new_year"), F.col("author").alias("new_author"), F.when(F.col("entry_id") % 3 == 1, "doi").otherwise("search").alias("found_by"))
    return workflows.enrich_canonicals(e, found)


@query()
def verification_bibtex(spark, sf):
    """Text built from the checked ranking; tests hold single entries."""
    e = C.entries(spark, sf)
    q = e.select(F.col("entry_id").alias("query_id"), "title", "author", "year")
    return workflows.verification_bibtex(resolve.verify(q, e), e)


@query("SELECT count(*) AS n_nodes, (SELECT count(*) FROM relations WHERE source IN ('doc1', 'doc2', 'doc3')) AS n_edges FROM (SELECT source FROM relations WHERE source IN ('doc1', 'doc2', 'doc3') UNION SELECT target FROM relations WHERE source IN ('doc1', 'doc2', 'doc3'))")
def graph_json(spark, sf):
    e = C.entries(spark, sf)
    j = workflows.graph_json(graph.traverse(C.relations(spark, sf), e, W._seeds(e)), e)
    p = F.from_json("json", "nodes array<struct<id:string>>, edges array<struct<id:string>>")
    return j.select(F.size(p["nodes"]).cast("long").alias("n_nodes"), F.size(p["edges"]).cast("long").alias("n_edges"))


@query("SELECT path, count(*) AS n FROM (SELECT 'src2/manifest.json' AS path UNION ALL SELECT 'src2/bibliography.bib' FROM entries WHERE topic = 'src2') GROUP BY path")
def topic_bundle(spark, sf):
    return workflows.topic_bundle(C.entries(spark, sf), "src2").groupBy("path").agg(F.count("*").alias("n"))


@query()
def support_gaps(spark, sf):
    """Claims against entries that aren't cited yet; tests hold it on small rows."""
    c = C.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("text").alias("claim"))
    e = C.entries(spark, sf)
    return workflows.support_gaps(c, e, e.filter("entry_id % 2 = 0").select("title", "doi"))
