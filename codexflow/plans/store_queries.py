"""Queries of the store: search, lists, filters, topics, mutations, logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import text as T
from codexflow.operators import confidence, search, store, topics
from codexflow.plans import corpus as C
from codexflow.plans.registry import query
from codexflow.streaming import ingest

_FOLD = "strip_accents(lower(coalesce({c}, '')))"
_TOK = "regexp_extract_all(" + _FOLD + r", '[\p{{L}}\p{{N}}]+')"


def _bm25(tokens: list[str], where: str = "") -> str:
    want = "[" + ", ".join(f"'{t}'" for t in tokens) + "]"
    n = len(tokens)
    toks = ", ".join(_TOK.format(c=c) + f" AS t_{c}" for c in search.COLUMNS)
    hits = " + ".join(f"len(list_filter(range(1, len(t_{c}) - {n - 2}), lambda i: t_{c}[i:i + {n - 1}] = {want}))" for c in search.COLUMNS)
    size = " + ".join(f"len(t_{c})" for c in search.COLUMNS)
    return f"""WITH toks AS (SELECT citation_key, title, year, topic, {toks} FROM entries),
    hits AS (SELECT citation_key, title, year, topic, {hits} AS f, {size} AS d FROM toks),
    stats AS (SELECT count(*) AS n, count(*) FILTER (f > 0) AS h, avg(d) AS m FROM hits)
    SELECT citation_key, title, year, round(-(CASE WHEN ln((n - h + 0.5) / (h + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - h + 0.5) / (h + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * d / m)), 9) AS score
    FROM hits, stats WHERE f > 0 {where}"""


def _rounded(df):
    return df.withColumn("score", F.round("score", 9))


@query(_bm25(["of", "the"]))
def search_phrase_bm25(spark, sf):
    return _rounded(search.search_text(C.entries(spark, sf), "of the", limit=None))


@query(_bm25(["la"], "AND topic = 'src3'") + " ORDER BY score, citation_key LIMIT 10")
def search_text(spark, sf):
    """The flagship: the ten best rows of a topic for a phrase."""
    members = C.entry_topics(spark, sf).filter("slug = 'src3'")
    return _rounded(search.search_text(C.entries(spark, sf), "la", limit=10, members=members))


@query("SELECT citation_key, title, year, CAST(0 AS DOUBLE) AS score FROM entries WHERE coalesce(title, '') ILIKE '%er_n%' OR coalesce(abstract, '') ILIKE '%er_n%'")
def search_like_fallback(spark, sf):
    return search.search_like(C.entries(spark, sf), "er_n", limit=None, columns=("title", "abstract"))


@query("SELECT citation_key, " + " + ".join(f"len({_TOK.format(c=c)})" for c in search.COLUMNS) + " AS n_tokens FROM entries")
def search_index(spark, sf):
    return search.build_index(C.entries(spark, sf)).select("citation_key", F.col("n_tokens").cast("long"))


@query("SELECT citation_key, entry_type, review_status, title, year FROM entries ORDER BY coalesce(year, ''), citation_key LIMIT 50")
def list_entries(spark, sf):
    return store.list_entries(C.entries(spark, sf))


@query("SELECT citation_key, title, year, confidence FROM entries JOIN entry_topics USING (citation_key) WHERE slug = 'src1'")
def list_topic_entries(spark, sf):
    return C.entries(spark, sf).join(C.entry_topics(spark, sf).filter("slug = 'src1'"), "citation_key").select("citation_key", "title", "year", "confidence")


@query("SELECT e.citation_key, e.title, CAST(to_json(list({'slug': t.slug, 'name': t.name} ORDER BY t.slug)) AS VARCHAR) AS topics FROM entries e JOIN entry_topics et USING (citation_key) JOIN topics t USING (slug) GROUP BY 1, 2")
def entry_with_topics(spark, sf):
    out = store.entry_with_topics(C.entries(spark, sf), C.entry_topics(spark, sf), C.topics(spark, sf))
    return out.select("citation_key", "title", F.to_json(F.transform("topics", lambda x: F.struct(x["slug"].alias("slug"), x["name"].alias("name")))).alias("topics"))


@query("SELECT a.citation_key, b.citation_key AS same_as FROM entries a JOIN entries b ON trim(lower(a.title)) = trim(lower(b.title)) AND a.citation_key <> b.citation_key WHERE a.title <> ''")
def same_title(spark, sf):
    e = C.entries(spark, sf).filter("title <> ''").select("citation_key", F.trim(F.lower("title")).alias("t"))
    return e.join(e.select(F.col("citation_key").alias("same_as"), "t"), "t").filter("citation_key <> same_as").select("citation_key", "same_as")


_CAND = "SELECT DISTINCT citation_key, entry_type, review_status, title, year, doi, abstract FROM entries WHERE "
_STUB = "(coalesce(trim(title), '') = '' OR starts_with(lower(trim(title)), 'referenced work ') OR starts_with(lower(trim(title)), 'untitled') OR (entry_type = 'misc' AND coalesce(trim(abstract), '') = ''))"


@query(_CAND + _STUB)
def resolution_candidates_stub(spark, sf):
    return store.resolution_candidates(C.entries(spark, sf), stub_only=True)


@query(_CAND + "entry_type = 'misc' AND doi IS NOT NULL AND topic = 'src4'")
def resolution_candidates_misc(spark, sf):
    return store.resolution_candidates(C.entries(spark, sf), doi_only=True, misc_only=True, topic="src4")


@query("SELECT slug, name, phrase_review_status, count(et.citation_key) AS entry_count FROM topics LEFT JOIN entry_topics et USING (slug) GROUP BY ALL")
def topics_with_counts(spark, sf):
    return topics.topics_with_counts(C.topics(spark, sf), C.entry_topics(spark, sf)).select("slug", "name", "phrase_review_status", "entry_count")


@query("SELECT slug, name, CASE phrase_review_status WHEN 'pending' THEN 0 WHEN 'unreviewed' THEN 1 WHEN 'rejected' THEN 2 WHEN 'accepted' THEN 3 ELSE 4 END AS rank FROM topics")
def topic_reviews_ranked(spark, sf):
    return C.topics(spark, sf).select("slug", "name", topics.review_rank(F.col("phrase_review_status")).alias("rank")).orderBy("rank", "name", "slug")


_DECISIONS = "SELECT slug, CASE WHEN n % 3 = 0 THEN 'accepted' WHEN n % 3 = 1 THEN 'rejected' END AS decision, CASE WHEN n % 4 = 0 THEN 'override ' || slug END AS phrase FROM (SELECT slug, CAST(regexp_extract(slug, '(\\d+)$', 1) AS INT) AS n FROM topics) WHERE n % 3 < 2"


@query(f"""WITH d AS ({_DECISIONS.replace("\\\\", "\\")})
SELECT t.slug, coalesce(decision, phrase_review_status) AS phrase_review_status, CASE WHEN decision = 'accepted' THEN NULL ELSE suggested_phrase END AS suggested_phrase,
  CASE WHEN decision = 'accepted' THEN coalesce(phrase, suggested_phrase, expansion_phrase) ELSE coalesce(phrase, expansion_phrase) END AS expansion_phrase FROM topics t LEFT JOIN d USING (slug)""")
def review_topic_phrases(spark, sf):
    t = C.topics(spark, sf)
    n = F.regexp_extract("slug", r"(\d+)$", 1).cast("int")
    d = t.select("slug", F.when(n % 3 == 0, "accepted").when(n % 3 == 1, "rejected").alias("decision"), F.when(n % 4 == 0, F.concat(F.lit("override "), "slug")).alias("phrase")).filter("decision is not null")
    return topics.review_phrases(t, d).select("slug", "phrase_review_status", "suggested_phrase", "expansion_phrase")


@query("SELECT slug, CASE WHEN slug LIKE '%5' THEN 'new ' || slug ELSE suggested_phrase END AS suggested_phrase, CASE WHEN slug LIKE '%5' THEN 'pending' ELSE phrase_review_status END AS phrase_review_status FROM topics")
def stage_topic_phrases(spark, sf):
    t = C.topics(spark, sf)
    staged = t.filter("slug like '%5'").select("slug", F.concat(F.lit("new "), "slug").alias("suggested_phrase"))
    return topics.stage_phrases(t, staged).select("slug", "suggested_phrase", "phrase_review_status")


@query("SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 <> 0)")
def orphan_rows(spark, sf):
    kept = C.table(spark, sf, "customer").filter("c_custkey % 3 <> 0").select(F.col("c_custkey").alias("o_custkey"))
    return store.orphans(C.table(spark, sf, "orders"), kept, ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("""SELECT (SELECT count(*) FROM entries) AS n_entries, (SELECT count(*) FROM relations) AS n_relations,
  CASE WHEN m > 0 THEN 'dangling_relations' ELSE '' END AS issues, CASE WHEN m > 0 THEN 'degraded' WHEN (SELECT count(*) FROM entries) = 0 THEN 'empty' ELSE 'healthy' END AS health
  FROM (SELECT count(*) AS m FROM relations WHERE target NOT IN (SELECT citation_key FROM entries))""")
def health_summary(spark, sf):
    e, r = C.entries(spark, sf), C.relations(spark, sf)
    dangling = store.orphans(r, e.select(F.col("citation_key").alias("target")), ["target"])
    return store.health({"entries": e, "relations": r}, {"dangling_relations": dangling})


_CHANGES = "SELECT doc_id % 700 AS entry_id, 'changed ' || doc_id AS title, CASE WHEN doc_id % 2 = 0 THEN 'full ' || doc_id END AS fulltext, doc_id AS ordinal FROM documents WHERE doc_id % 5 = 0"


@query(f"""WITH c AS ({_CHANGES}), l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY ordinal DESC) AS k FROM c) WHERE k = 1)
SELECT coalesce(l.entry_id, e.entry_id) AS entry_id, CASE WHEN l.entry_id IS NOT NULL THEN l.title ELSE e.title END AS title, coalesce(l.fulltext, e.fulltext) AS fulltext
FROM entries e FULL JOIN l ON l.entry_id = e.entry_id""")
def entry_upsert(spark, sf):
    old = C.entries(spark, sf).select("entry_id", "title", "fulltext")
    d = C.table(spark, sf, "documents").filter("doc_id % 5 = 0")
    new = d.select((F.col("doc_id") % 700).alias("entry_id"), F.concat(F.lit("changed "), F.col("doc_id").cast("string")).alias("title"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("full "), F.col("doc_id").cast("string"))).alias("fulltext"), F.col("doc_id").alias("ordinal"))
    return store.upsert(old, new, ["entry_id"], keep_old=("fulltext",))


@query("""WITH l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doi ORDER BY entry_id DESC) AS k FROM (SELECT '10.' || (1000 + entry_id % 50) AS doi, entry_id FROM entries WHERE doi IS NOT NULL)) WHERE k = 1)
SELECT doi, entry_id FROM l""")
def identifier_last_wins(spark, sf):
    ids = C.entries(spark, sf).filter("doi is not null").select(F.concat(F.lit("10."), (F.lit(1000) + F.col("entry_id") % 50).cast("string")).alias("doi"), "entry_id")
    return store.last_writes(ids, ["doi"], [F.desc("entry_id")])


@query("SELECT source, target, relation FROM relations UNION SELECT DISTINCT 'doc' || doc_id, 'doc' || (doc_id + 1), 'cites' FROM documents")
def edge_insert_ignore(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id")
    new = d.select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("source"), F.concat(F.lit("doc"), (F.col("doc_id") + 1).cast("string")).alias("target"), F.lit("cites").alias("relation"))
    return store.insert_ignore(C.relations(spark, sf), new, ["source", "target", "relation"])


@query("SELECT source, target, relation FROM relations WHERE source NOT IN (SELECT citation_key FROM entries WHERE review_status = 'reviewed')")
def delete_cascade(spark, sf):
    gone = C.entries(spark, sf).filter("review_status = 'reviewed'").select(F.col("citation_key").alias("source"))
    return store.delete_cascade(C.relations(spark, sf), "source", gone)


@query("""SELECT citation_key, i AS ordinal, trim(list[i]) AS full_name, CASE WHEN contains(list[i], ',') THEN trim(split_part(list[i], ',', 1)) ELSE string_split(trim(list[i]), ' ')[-1] END AS family_name,
  CASE WHEN contains(list[i], ',') THEN trim(split_part(list[i], ',', 2)) ELSE array_to_string(string_split(trim(list[i]), ' ')[:-2], ' ') END AS given_names
  FROM (SELECT citation_key, string_split(author, ' and ') AS list FROM entries WHERE author <> ''), unnest(range(1, len(list) + 1)) AS r(i)""")
def entry_creators(spark, sf):
    return store.creators_of(C.entries(spark, sf)).withColumn("ordinal", F.col("ordinal").cast("long"))


@query("SELECT citation_key, author FROM entries WHERE author <> ''")
def author_field(spark, sf):
    return store.author_field(store.creators_of(C.entries(spark, sf)))


@query("""SELECT entry_id, field_name, id, field_value, recorded_at FROM (SELECT *, row_number() OVER (PARTITION BY entry_id, field_name ORDER BY recorded_at DESC, id DESC) AS k FROM provenance WHERE status = 'open') WHERE k = 1""")
def latest_open_conflict(spark, sf):
    return store.latest_open(C.provenance(spark, sf)).select("entry_id", "field_name", "id", "field_value", "recorded_at")


@query("SELECT id, CASE WHEN status = 'open' AND field_name = 'click' THEN 'rejected' ELSE status END AS status FROM provenance")
def conflict_status_update(spark, sf):
    return store.set_conflict_status(C.provenance(spark, sf), F.col("field_name") == "click", "rejected").select("id", "status")


@query("SELECT p.id, e.citation_key, p.field_name, p.source_label FROM provenance p JOIN entries e USING (entry_id)")
def provenance_log(spark, sf):
    return C.provenance(spark, sf).join(C.entries(spark, sf).select("entry_id", "citation_key"), "entry_id").select("id", "citation_key", "field_name", "source_label")


@query("""SELECT entry_id, count(*) FILTER (status = 'open') AS x_conflicts, coalesce(array_to_string(list_sort(list(DISTINCT field_name) FILTER (status = 'open')), ','), '') AS x_conflict_fields,
  arg_max(source_label, {'a': recorded_at, 'b': id}) AS x_last_source FROM provenance GROUP BY 1""")
def export_annotations(spark, sf):
    log = C.provenance(spark, sf)
    return confidence.annotations(log, log)


_BAND = "CASE WHEN {v} IS NULL THEN 'unknown' WHEN {v} < 0.2 THEN 'very_low' WHEN {v} < 0.4 THEN 'low' WHEN {v} < 0.7 THEN 'moderate' WHEN {v} < 0.9 THEN 'high' ELSE 'very_high' END"


@query("SELECT 's' || id || '::identity_resolution::' || source_label AS assessment_id, 's' || id AS subject_id, 'identity_resolution' AS dimension, (id % 11) / 10 AS value, " + _BAND.format(v="(id % 11) / 10") + " AS band FROM provenance")
def identity_assessments(spark, sf):
    m = C.provenance(spark, sf).select(F.concat(F.lit("s"), F.col("id").cast("string")).alias("subject_id"), ((F.col("id") % 11) / 10).alias("score"), "source_label")
    return confidence.identity_assessments(m)


@query("SELECT 'legacy-field_provenance::' || id AS assessment_id, CAST(id AS VARCHAR) AS subject_id, 'field_provenance' AS dimension, CAST(1 AS DOUBLE) AS value, 'very_high' AS band FROM provenance UNION SELECT 'legacy-relation_provenance::' || source || '->' || target, source || '->' || target, 'relation_provenance', 0.5, 'moderate' FROM relations UNION SELECT 'legacy-topic_membership::' || citation_key || '@' || slug, citation_key || '@' || slug, 'topic_membership', confidence, " + _BAND.format(v="confidence") + " FROM entry_topics")
def assessments_union(spark, sf):
    return confidence.legacy_assessments(C.provenance(spark, sf).withColumn("confidence", F.lit(1.0)), C.relations(spark, sf).withColumn("confidence", F.lit(0.5)), C.entry_topics(spark, sf))


@query("""WITH a AS (SELECT 'doc' || (id % 300) AS subject_id, field_name AS dimension, value AS v, recorded_at, CAST(id AS VARCHAR) AS aid FROM provenance),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY subject_id ORDER BY dimension DESC, recorded_at DESC, aid DESC) AS k FROM a) WHERE k = 1)
SELECT 'doc' || doc_id AS subject_id, quality = 1 AS reviewed_match, v AS assessed, """ + _BAND.format(v="v / 100") + " AS band FROM labels JOIN l ON l.subject_id = 'doc' || doc_id")
def calibration_rows(spark, sf):
    from codexflow.functions import bibliographic as B

    log = C.provenance(spark, sf)
    a = log.select(F.concat(F.lit("doc"), (F.col("id") % 300).cast("string")).alias("subject_id"), F.col("field_name").alias("dimension"), "value", "recorded_at", F.col("id").cast("string").alias("assessment_id"), B.band(F.col("value") / 100).alias("band"))
    out = C.table(spark, sf, "labels").select(F.concat(F.lit("doc"), F.col("doc_id").cast("string")).alias("subject_id"), (F.col("quality") == 1).alias("reviewed_match"))
    return confidence.calibration_rows(out, a)


@query("SELECT time_bucket(INTERVAL '1 day', recorded_at) AS start, field_name, count(*) AS n, round(sum(value), 2) AS total FROM provenance GROUP BY 1, 2")
def provenance_windows(spark, sf):
    return ingest.windowed_counts(C.provenance(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("""WITH m AS (SELECT entry_id, recorded_at, CASE WHEN recorded_at >= lag(recorded_at) OVER w + INTERVAL '30 minutes' OR lag(recorded_at) OVER w IS NULL THEN 1 ELSE 0 END AS s FROM provenance WINDOW w AS (PARTITION BY entry_id ORDER BY recorded_at)),
g AS (SELECT *, sum(s) OVER (PARTITION BY entry_id ORDER BY recorded_at ROWS UNBOUNDED PRECEDING) AS k FROM m) SELECT entry_id, min(recorded_at) AS start, count(*) AS n FROM g GROUP BY entry_id, k""")
def provenance_sessions(spark, sf):
    return ingest.sessions(C.provenance(spark, sf)).withColumn("start", F.col("start").cast("timestamp_ntz"))


@query("SELECT lang, entry_type, count(*) AS n, grouping_id(lang, entry_type) AS g FROM entries GROUP BY CUBE (lang, entry_type)")
def entry_cube(spark, sf):
    return C.entries(spark, sf).cube("lang", "entry_type").agg(F.count("*").alias("n"), F.grouping_id("lang", "entry_type").alias("g"))


@query("SELECT citation_key, entry_type, title FROM entries WHERE coalesce(trim(doi), '') <> '' AND (trim(title) = '' OR starts_with(lower(trim(title)), 'referenced work ') OR starts_with(lower(trim(title)), 'untitled')) AND coalesce(trim(author), '') = '' AND coalesce(trim(abstract), '') = '' AND journal IS NULL AND booktitle IS NULL")
def export_stubs(spark, sf):
    return C.entries(spark, sf).filter(store.is_export_stub()).select("citation_key", "entry_type", "title")


@query("SELECT citation_key, coalesce(abstract, '') AS said FROM entries WHERE trim(coalesce(abstract, '')) <> '' AND review_status = 'draft'")
def filtered_statuses(spark, sf):
    return C.entries(spark, sf).filter((F.col("review_status") == "draft") & T.filled("abstract").isNotNull()).select("citation_key", T.text("abstract").alias("said"))
