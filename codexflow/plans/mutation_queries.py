"""Queries of single mutations, text repairs and the written search index."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.operators import lineage, mutations, search
from codexflow.plans import corpus as C
from codexflow.plans.registry import query
from codexflow.plans.store_queries import _bm25, _rounded


@query(_bm25(["of", "the"]))
def search_written_index(spark, sf):
    """The phrase search from postings on disk."""
    path = lineage.kept_folder(spark, "index")
    search.write_index(C.entries(spark, sf), path)
    return _rounded(search.search_index(spark, path, "of the", limit=None))


@query("""SELECT citation_key, CASE WHEN entry_id % 3 = 0 THEN 'New title' ELSE title END AS title, CASE WHEN entry_id % 3 = 0 THEN NULL ELSE author END AS author,
  CASE WHEN entry_id % 3 = 0 THEN 'enriched' ELSE review_status END AS review_status, CAST(length(fulltext) AS INT) AS n FROM entries""")
def replaced_entries(spark, sf):
    e = C.entries(spark, sf)
    new = e.filter("entry_id % 3 = 0").select("citation_key", "entry_type", F.lit("New title").alias("title"), F.lit(1).alias("ordinal"))
    new = new.unionByName(new.limit(1).select(F.lit("nobody").alias("citation_key"), "entry_type", "title", "ordinal"))
    return mutations.replace_entries(e, new).select("citation_key", "title", "author", "review_status", F.length("fulltext").alias("n"))


@query("SELECT citation_key, title FROM entries WHERE citation_key = 'doc7'")
def get_entry(spark, sf):
    return mutations.get_entry(C.entries(spark, sf), "doc7").select("citation_key", "title")


_NEW = """new AS (SELECT 'doc' || (entry_id * 3) AS source, 'doc' || (entry_id + 1) AS target, 'cites' AS relation, 'import' AS label FROM entries),
ok AS (SELECT * FROM new WHERE source IN (SELECT citation_key FROM entries))"""


@query(f"""WITH {_NEW}, r AS (SELECT * FROM relations UNION SELECT source, target, relation FROM ok)
SELECT r.source, r.target, r.relation, ok.label FROM r LEFT JOIN ok USING (source, target, relation)""")
def added_relations(spark, sf):
    e, old = C.entries(spark, sf), C.relations(spark, sf)
    key = lambda c: F.concat(F.lit("doc"), c.cast("string"))
    new = e.select(key(F.col("entry_id") * 3).alias("source"), key(F.col("entry_id") + 1).alias("target"), F.lit("cites").alias("relation"), F.lit("import").alias("label"))
    edges, log = mutations.add_relations(old, new.limit(0), e, new)
    return mutations.relations_with_log(edges, e, log)


@query("""SELECT slug, CASE WHEN n % 2 = 0 THEN 'Renamed' ELSE name END AS name, CASE WHEN n % 4 = 0 THEN 'fresh' ELSE suggested_phrase END AS suggested_phrase FROM (SELECT *, CAST(substr(slug, 4) AS INT) AS n FROM topics)
UNION ALL SELECT 'added', 'Renamed', NULL""")
def ensured_topics(spark, sf):
    t = C.topics(spark, sf)
    n = F.substring("slug", 4, 9).cast("int")
    new = t.filter(n % 2 == 0).select(F.col("slug"), F.lit("Renamed").alias("name"), F.when(n % 4 == 0, "fresh").alias("suggested_phrase"))
    new = new.unionByName(spark.createDataFrame([("added", "Renamed", None)], "slug string, name string, suggested_phrase string"))
    rest = [F.lit(None).cast("string").alias(c) for c in t.columns if c not in new.columns]
    return mutations.ensure_topics(t, new.select("*", *rest, F.lit(1).alias("ordinal"))).select("slug", "name", "suggested_phrase")


@query("""SELECT citation_key, slug, CASE WHEN slug = 'src1' THEN CAST(0.25 AS DOUBLE) ELSE confidence END AS confidence FROM entry_topics""")
def added_members(spark, sf):
    e, m = C.entries(spark, sf), C.entry_topics(spark, sf)
    new = m.filter("slug = 'src1'").select("citation_key", "slug", F.lit(0.25).alias("confidence"), F.lit(1).alias("ordinal"))
    none = spark.createDataFrame([("nobody", "src1", 1.0, 1)], "citation_key string, slug string, confidence double, ordinal int")
    return mutations.add_entry_topics(m, e, new.unionByName(none))


@query("""WITH o AS (SELECT *, row_number() OVER (PARTITION BY entry_id, field_name ORDER BY recorded_at DESC, id DESC) AS k FROM provenance WHERE status = 'open' AND field_name = 'click')
SELECT p.id, CASE WHEN o.k = 1 THEN 'accepted' ELSE p.status END AS status FROM provenance p LEFT JOIN o ON o.id = p.id AND o.k = 1""")
def applied_conflicts(spark, sf):
    log = C.provenance(spark, sf)
    users = log.select("entry_id").distinct().withColumn("click", F.lit("old"))
    return mutations.apply_conflicts(users, log, ("click",))[1].select("id", "status")


@query("""WITH o AS (SELECT entry_id, arg_max(field_value, (recorded_at, id)) AS v FROM provenance WHERE status = 'open' AND field_name = 'click' GROUP BY 1)
SELECT u.entry_id, CASE WHEN o.entry_id IS NULL THEN 'old' ELSE v END AS click FROM (SELECT DISTINCT entry_id FROM provenance) u LEFT JOIN o USING (entry_id)""")
def applied_conflict_values(spark, sf):
    log = C.provenance(spark, sf)
    users = log.select("entry_id").distinct().withColumn("click", F.lit("old"))
    return mutations.apply_conflicts(users, log, ("click",))[0]


@query("SELECT citation_key FROM entries WHERE contains(lower(coalesce(title, '')), 'er') OR contains(lower(coalesce(author, '')), 'er') OR contains(lower(citation_key), 'er')")
def cluster_filter(spark, sf):
    return mutations.filter_clusters(C.entries(spark, sf), "ER", ("title", "author", "citation_key")).select("citation_key")


@query("""SELECT e.citation_key FROM entries e WHERE NOT (entry_type = 'article' AND coalesce(abstract, '') = '' AND trim(title) <> '' AND EXISTS
  (SELECT 1 FROM entries o WHERE o.citation_key <> e.citation_key AND o.entry_type IN ('book', 'incollection', 'inproceedings', 'phdthesis') AND trim(lower(o.title)) = trim(lower(e.title))))""")
def without_reviews(spark, sf):
    e = C.entries(spark, sf)
    return mutations.without_reviews(e, e).select("citation_key")


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN props WHEN 1 THEN props WHEN 2 THEN '[1, 2]' END AS said FROM events""")
def lenient_json(spark, sf):
    n, p = F.col("event_id") % 4, F.col("props")
    text = F.when(n == 0, p).when(n == 1, F.concat(F.lit("Here it is:\n```json\n"), p, F.lit("\n``` done"))).when(n == 2, F.lit("so [1, 2] then")).otherwise("no { json } here")
    return C.table(spark, sf, "events").select("event_id", mutations.lenient_json(text).alias("said"))


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 THEN event_type || '; ' ELSE '' END || 'extracted_reference = {true}; extracted_by = {' || event_type || '}' || CASE WHEN event_id % 3 = 0 THEN '; raw_reference = {x}' ELSE '' END AS note FROM events""")
def extraction_notes(spark, sf):
    n = F.col("event_id")
    note = mutations.extraction_note(F.when(n % 2 == 0, F.col("event_type")), F.col("event_type"), F.when(n % 3 == 0, "x"))
    return C.table(spark, sf, "events").select("event_id", note.alias("note"))


@query("SELECT event_id, '{\"a\":\"' || event_type || '\",\"b\":\"' || event_id || '\"}' AS said, event_type AS a FROM events")
def extra_fields(spark, sf):
    said = mutations.encode_extra(F.create_map(F.lit("b"), F.col("event_id").cast("string"), F.lit("a"), F.col("event_type"), F.lit("c"), F.lit("")))
    return C.table(spark, sf, "events").select("event_id", said.alias("said")).select("event_id", "said", mutations.decode_extra(F.col("said"))["a"].alias("a"))


@query("SELECT p_partkey AS id, p_name || ' of parts' AS title FROM part")
def thesis_titles(spark, sf):
    n = F.col("p_partkey")
    said = F.concat(F.when(n % 2 == 0, F.concat(F.lit("Smith A. "), "p_name", F.lit(" of parts. PhD thesis, Univ."))).otherwise(F.concat("p_name", F.lit(" of parts. ProQuest 123"))))
    return C.table(spark, sf, "part").select(n.alias("id"), mutations.thesis_title(said).alias("title"))
