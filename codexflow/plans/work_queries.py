"""Queries of the graph, duplicates, topics, resolution and claims."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import text as T
from codexflow.operators import claims, dedupe, graph, resolve, store, topics
from codexflow.plans import corpus as C
from codexflow.plans.functions_queries import expanded_sql, keyword_sql
from codexflow.plans.registry import query


def _traverse_sql(depth: int, edges: str = "SELECT source, target, relation FROM relations", where: str = "", seeds: str = "citation_key IN ('doc1', 'doc2', 'doc3')") -> str:
    return f"""WITH RECURSIVE ed AS ({edges}), e2 AS (SELECT ed.*, e.citation_key IS NOT NULL AS target_exists, e.review_status, e.title FROM ed LEFT JOIN entries e ON e.citation_key = ed.target),
    e3 AS (SELECT * FROM e2 {where}), walk(k, d) AS (SELECT citation_key, 0 FROM entries WHERE {seeds} UNION SELECT target, d + 1 FROM walk JOIN e3 ON source = k WHERE target_exists AND d + 1 < {depth}),
    lo AS (SELECT k, min(d) AS d FROM walk GROUP BY k)
    SELECT source, target, relation, CAST(d + 1 AS INT) AS depth, target_exists, review_status AS target_review_status, title AS target_title FROM lo JOIN e3 ON source = k WHERE d < {depth}"""


def _seeds(entries):
    return entries.filter(F.col("citation_key").isin("doc1", "doc2", "doc3"))


@query(_traverse_sql(1))
def graph_depth1(spark, sf):
    e = C.entries(spark, sf)
    return graph.traverse(C.relations(spark, sf), e, _seeds(e))


@query(_traverse_sql(3))
def graph_depth3(spark, sf):
    e = C.entries(spark, sf)
    return graph.traverse(C.relations(spark, sf), e, _seeds(e), max_depth=3)


@query(_traverse_sql(2, "SELECT target AS source, source AS target, 'cited_by' AS relation FROM relations"))
def graph_cited_by(spark, sf):
    e = C.entries(spark, sf)
    return graph.traverse(C.relations(spark, sf), e, _seeds(e), relation_types=("cited_by",), max_depth=2)


@query(_traverse_sql(3, where="WHERE review_status = 'reviewed' OR NOT target_exists", seeds="entry_id % 50 = 1"))
def graph_status_filter(spark, sf):
    e = C.entries(spark, sf)
    return graph.traverse(C.relations(spark, sf), e, e.filter("entry_id % 50 = 1"), max_depth=3, review_status="reviewed")


@query("SELECT * FROM (" + _traverse_sql(1, seeds="TRUE") + ") WHERE NOT target_exists")
def graph_missing_only(spark, sf):
    e = C.entries(spark, sf)
    return graph.missing_targets(graph.traverse(C.relations(spark, sf), e, e))


@query("SELECT k AS citation_key, coalesce(nullif(trim(title), ''), k) AS label, e.citation_key IS NOT NULL AS exists FROM (SELECT source AS k FROM relations UNION SELECT target FROM relations) LEFT JOIN entries e ON e.citation_key = k")
def graph_nodes(spark, sf):
    e = C.entries(spark, sf)
    return graph.graph_nodes(graph.traverse(C.relations(spark, sf), e, e), e)


@query("SELECT 'edge-' || row_number() OVER (ORDER BY depth, relation, source, target) AS id, source, target, relation, depth FROM (" + _traverse_sql(2) + ")")
def graph_edges_numbered(spark, sf):
    e = C.entries(spark, sf)
    return graph.numbered_edges(graph.traverse(C.relations(spark, sf), e, _seeds(e), max_depth=2))


@query("""SELECT DISTINCT '  "' || source || '" -> "' || target || '" [label="' || relation || '"];' AS line FROM relations""")
def graph_dot(spark, sf):
    e = C.entries(spark, sf)
    return graph.dot_lines(graph.traverse(C.relations(spark, sf), e, e))


@query("SELECT source, target, relation FROM relations UNION SELECT target, source, 'cited_by' FROM relations")
def graph_all_edges(spark, sf):
    return graph.all_edges(C.relations(spark, sf))


@query("""WITH RECURSIVE f AS (SELECT source, target FROM (SELECT source, target, row_number() OVER (PARTITION BY source ORDER BY target) AS k FROM relations WHERE target IN (SELECT citation_key FROM entries)) WHERE k <= 1),
w(k, r) AS (SELECT citation_key, 0 FROM entries WHERE entry_id % 100 = 0 UNION SELECT target, r + 1 FROM w JOIN f ON source = k WHERE r < 3) SELECT k AS citation_key, CAST(min(r) AS INT) AS round FROM w GROUP BY k""")
def expand_rounds(spark, sf):
    e = C.entries(spark, sf)
    return graph.expand_rounds(C.relations(spark, sf), e, e.filter("entry_id % 100 = 0"), rounds=3, per_seed=1)


@query("SELECT 'doc' || doc_id AS source, 'doi105555c' || (doc_id % 300) AS target, 'cites' AS relation, CAST(1 AS DOUBLE) AS confidence FROM documents UNION SELECT 'doc' || doc_id, 'ref' || (1900 + doc_id % 100) || 'some2', 'cites', CAST(0.6 AS DOUBLE) FROM documents")
def expand_references(spark, sf):
    d = C.table(spark, sf, "documents").select("doc_id")
    n = F.col("doc_id")
    ref = lambda doi, author, year, title: F.struct(doi.alias("DOI"), author.alias("author"), year.alias("year"), title.alias("article-title"), F.lit(None).cast("string").alias("volume-title"), F.lit(None).cast("string").alias("journal-title"), F.lit(None).cast("string").alias("unstructured"))
    none = F.lit(None).cast("string")
    refs = F.array(ref(F.concat(F.lit("10.5555/c"), (n % 300).cast("string")), none, none, none), ref(none, none, (F.lit(1900) + n % 100).cast("string"), F.lit("Some title")), ref(none, none, none, none))
    payloads = d.select(F.concat(F.lit("doc"), n.cast("string")).alias("citation_key"), refs.alias("references"))
    return graph.expand_references(C.entries(spark, sf), payloads)[1]


_DUP = r"trim(regexp_replace(regexp_replace(replace(lower(coalesce({c}, '')), '&', ' and '), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g'))"
_A, _T = "split_part(" + _DUP.format(c="author") + ", ' and ', 1)", _DUP.format(c="title")
_DKEY = f"CASE WHEN {_A} = '' OR coalesce(trim(year), '') = '' OR {_T} = '' THEN '' ELSE {_A} || '|' || trim(year) || '|' || {_T} END"
_RICH = " + ".join(f"CASE WHEN coalesce(trim({c}), '') <> '' THEN {3 if c in dedupe.RICH else 1} ELSE 0 END" for c in dedupe.FIELDS)
_KEYED = f"keyed AS (SELECT *, {_DKEY} AS key, {_RICH} AS richness FROM entries), multi AS (SELECT key, count(*) AS n FROM keyed WHERE key <> '' GROUP BY key HAVING count(*) >= 2)"
_BEST = "best AS (SELECT * FROM (SELECT k.*, m.n, row_number() OVER (PARTITION BY k.key ORDER BY richness DESC, length(citation_key), citation_key DESC) AS r FROM keyed k JOIN multi m USING (key)) WHERE r = 1)"


@query(f"WITH {_KEYED} SELECT key, n, array_to_string(list(citation_key ORDER BY topic, year, citation_key), ',') AS members FROM keyed JOIN multi USING (key) GROUP BY key, n")
def dup_clusters(spark, sf):
    return dedupe.clusters(C.entries(spark, sf)).withColumn("members", F.array_join("members", ","))


@query(f"WITH {_KEYED}, {_BEST} SELECT key, n, citation_key, entry_type, CAST(richness AS INT) AS richness FROM best")
def canonical_argmax(spark, sf):
    return dedupe.canonical(C.entries(spark, sf))


@query(f"WITH {_KEYED}, {_BEST} SELECT k.key, any_value(b.citation_key) AS citation_key, " + ", ".join(f"arg_min(k.{c}, {{'a': k.citation_key <> b.citation_key, 'b': k.entry_id}}) FILTER (coalesce(trim(k.{c}), '') <> '') AS {c}" for c in dedupe.FIELDS) + " FROM keyed k JOIN best b ON b.key = k.key GROUP BY k.key")
def cluster_fold_merge(spark, sf):
    return dedupe.fold_merge(C.entries(spark, sf))


@query("SELECT grp, base, CASE WHEN k = 1 AND base NOT IN (SELECT citation_key FROM entries WHERE entry_id % 2 = 0) THEN base ELSE base || '_' || left(sha1(grp), 8) END AS citation_key FROM (SELECT 'g' || doc_id AS grp, 'doc' || (doc_id % 400) AS base, row_number() OVER (PARTITION BY doc_id % 400 ORDER BY doc_id) AS k FROM documents)")
def key_collision(spark, sf):
    d = C.table(spark, sf, "documents")
    groups = d.select(F.concat(F.lit("g"), F.col("doc_id").cast("string")).alias("grp"), F.concat(F.lit("doc"), (F.col("doc_id") % 400).cast("string")).alias("base"), F.col("doc_id").alias("ordinal"))
    return dedupe.assign_keys(groups, C.entries(spark, sf).filter("entry_id % 2 = 0"))


_SUS = "(entry_type = 'article' AND regexp_matches(lower(coalesce(journal, '')), 'elsevier|springer|press|publications|publisher|university')) OR (entry_type = 'book' AND regexp_matches(lower(coalesce(publisher, '')), 'journal|review|letters|proceedings|conference') AND NOT regexp_matches(lower(publisher), 'press|academic|elsevier|springer|wiley|university'))"


@query(f"WITH {_KEYED} SELECT count(*) AS n_entries, count(*) FILTER (coalesce(trim(author), '') = '') AS missing_author, count(*) FILTER (coalesce(trim(title), '') = '') AS missing_title, count(*) FILTER (year IS NULL) AS missing_year, count(*) FILTER ({_SUS}) AS suspicious, (SELECT count(*) FROM multi) AS duplicate_clusters, (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM multi) AS duplicate_entries FROM entries")
def export_validation(spark, sf):
    return dedupe.validation(C.entries(spark, sf))


@query(f"SELECT citation_key, array_to_string(list_filter([CASE WHEN entry_type = 'misc' THEN 'entry_type:misc' END, CASE WHEN coalesce(trim(doi), '') = '' THEN 'missing:doi' END, CASE WHEN {_RICH} < 6 THEN 'low_field_richness' END, CASE WHEN entry_type IN ('article', 'inproceedings', 'incollection') AND journal IS NULL AND booktitle IS NULL THEN 'missing:venue' END], lambda x: x IS NOT NULL), ',') AS reasons FROM entries")
def canonical_weaknesses(spark, sf):
    return C.entries(spark, sf).select("citation_key", F.array_join(dedupe.weaknesses(), ",").alias("reasons"))


_TT = "list_filter(string_split(" + _DUP.format(c="{c}") + f", ' '), lambda x: length(x) >= 4 AND NOT list_contains([{', '.join(repr(w) for w in T.TOPIC_STOP)}], x))"


@query(f"""WITH terms AS (SELECT topic, term, count(*) AS n FROM (SELECT topic, unnest(list_distinct({_TT.format(c="title")})) AS term FROM entries) GROUP BY 1, 2),
own AS (SELECT slug AS topic, {_TT.format(c="name")} AS own FROM topics), size AS (SELECT topic, count(*) AS n_entries FROM entries GROUP BY 1),
r AS (SELECT t.topic, term, n, n_entries, row_number() OVER (PARTITION BY t.topic ORDER BY n DESC, term) AS k FROM terms t JOIN own USING (topic) JOIN size USING (topic) WHERE NOT list_contains(own, term)),
c AS (SELECT *, bool_or(n >= 2) OVER (PARTITION BY topic) AS twice FROM r WHERE k <= CASE WHEN n_entries <= 1 THEN 1 WHEN n_entries <= 3 THEN 2 ELSE 4 END)
SELECT size.topic, size.n_entries, coalesce(array_to_string(list(term ORDER BY k) FILTER (term IS NOT NULL), ' '), '') AS keywords,
  array_to_string(list_filter([CASE WHEN size.n_entries <= 1 THEN 'single_entry_topic' WHEN size.n_entries <= 3 THEN 'small_topic' END, CASE WHEN count(term) = 0 THEN 'no_keyword_signal' WHEN count(term) = 1 THEN 'thin_keyword_signal' END,
  CASE WHEN bool_or(length(term) <= 3 OR regexp_matches(term, '[0-9]') OR term IN ('boundry', 'colloquium', 'edition', 'history', 'idea', 'central', 'bearing', 'time')) THEN 'noisy_keywords' END], lambda x: x IS NOT NULL), ',') AS reasons
FROM size LEFT JOIN (SELECT * FROM c WHERE NOT twice OR n >= 2) c USING (topic) GROUP BY 1, 2""")
def topic_keywords(spark, sf):
    out = topics.topic_keywords(C.entries(spark, sf), C.topics(spark, sf))
    return out.select("topic", "n_entries", F.array_join("keywords", " ").alias("keywords"), F.array_join(topics.review_reasons(F.col("n_entries"), F.col("keywords")), ",").alias("reasons"))


_PH = "'that with from evolution'"


def _over(a: str, b: str) -> str:
    return f"CASE WHEN len({a}) = 0 OR len({b}) = 0 THEN 0.0 ELSE len(list_intersect({a}, {b})) / len({a}) END"


_REL_CTE = f"""s AS (SELECT citation_key, title, {expanded_sql(_PH)} AS p, {expanded_sql("title")} AS t, {expanded_sql("abstract")} AS a, {expanded_sql("concat_ws(' ', journal, booktitle)")} AS v,
  {keyword_sql(c=_PH)} AS core0, {keyword_sql(c="title")} AS kt FROM entries),
x AS (SELECT citation_key, round(least(CAST(1 AS DOUBLE), 0.6 * {_over("p", "t")} + 0.25 * {_over("p", "a")} + 0.05 * {_over("p", "v")}), 6) AS relevance,
  {_over("list_filter(core0, lambda c: c NOT IN ('evolution', 'origin', 'origins', 'science', 'study', 'studies'))", "kt")} AS share FROM s)"""


@query(f"WITH {_REL_CTE} SELECT citation_key, relevance FROM x")
def topic_relevance(spark, sf):
    venue = F.concat_ws(" ", "journal", "booktitle")
    return C.entries(spark, sf).select("citation_key", F.round(topics.relevance(F.lit("that with from evolution"), venue=venue), 6).alias("relevance"))


@query(f"WITH {_REL_CTE} SELECT citation_key, relevance, CASE WHEN share > 0 THEN greatest(CAST(0.25 AS DOUBLE), share) ELSE 0.0 END AS anchor FROM x WHERE relevance >= 0.05 AND share > 0")
def topic_assign(spark, sf):
    out = topics.assign(C.entries(spark, sf), F.lit("that with from evolution"), least=0.05)
    return out.select("citation_key", F.round("relevance", 6).alias("relevance"), "anchor")


def _tokens(c: str) -> str:
    return f"list_distinct(list_filter(regexp_split_to_array(lower(coalesce({c}, '')), '[^\\p{{L}}\\p{{N}}_]+'), lambda x: x <> ''))"


_BASE = {"openalex": 3.0, "pubmed": 2.5, "crossref": 2.0, "datacite": 1.5}


@query(f"""WITH c AS (SELECT 'k' || (entry_id % 200) AS citation_key, title, abstract, ['openalex', 'pubmed', 'crossref', 'datacite'][entry_id % 4 + 1] AS source, entry_id FROM entries),
sd AS (SELECT citation_key AS seed, {_tokens("title")} AS w FROM entries WHERE entry_id % 250 = 3),
sc AS (SELECT c.citation_key, c.source, c.title, (CAST(0 AS DOUBLE) + CASE c.source WHEN 'openalex' THEN 3.0 WHEN 'pubmed' THEN 2.5 WHEN 'crossref' THEN 2.0 ELSE 1.5 END)
  + len(list_intersect({_tokens("'of the thing'")}, list_distinct(list_concat({_tokens("c.title")}, {_tokens("c.abstract")}))))
  + 0.25 * (SELECT count(*) FROM sd WHERE len(list_intersect(sd.w, {_tokens("c.title")})) > 0) AS score FROM c)
SELECT citation_key, score FROM (SELECT citation_key, max(score) AS score FROM sc GROUP BY 1) ORDER BY score DESC, citation_key LIMIT 25""")
def bootstrap_rank(spark, sf):
    e = C.entries(spark, sf)
    c = e.select(F.concat(F.lit("k"), (F.col("entry_id") % 200).cast("string")).alias("citation_key"), "title", "abstract", C._pick(tuple(_BASE), F.col("entry_id")).alias("source"), "entry_id")
    # A candidate of one source may come several times: its best row counts.
    seeds = e.filter("entry_id % 250 = 3").select("citation_key", "title")
    return topics.rank_candidates(c.drop("entry_id"), "of the thing", seeds, 25).select("citation_key", "score")


@query(f"""WITH q AS (SELECT entry_id AS query_id, title AS qt, author AS qa, CAST(TRY_CAST(year AS INT) + entry_id % 2 AS VARCHAR) AS qy, {_tokens("title")} AS qw FROM entries),
p AS (SELECT q.*, e.citation_key, e.title, e.author, e.year, e.doi, len(list_intersect(qw, {_tokens("e.title")})) / greatest(len(qw), 1) AS ov FROM q, entries e WHERE len(qw) > 0),
s AS (SELECT query_id, citation_key, title, coalesce(year, '') AS year, coalesce(doi, '') AS doi, round(CAST(0 AS DOUBLE) + (CASE WHEN ov >= 0.9 THEN 0.55 WHEN ov >= 0.7 THEN 0.40 WHEN ov >= 0.5 THEN 0.20 ELSE 0 END)
  + (CASE WHEN qa <> '' AND split_part(qa, ',', 1) = split_part(coalesce(author, ''), ',', 1) THEN 0.25 ELSE 0 END)
  + (CASE WHEN qy IS NULL OR year IS NULL THEN 0 WHEN qy = year THEN 0.15 WHEN abs(CAST(qy AS INT) - CAST(year AS INT)) = 1 THEN 0.07 ELSE 0 END), 4) AS score FROM p WHERE ov >= 0.5),
u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id, lower(doi), trim(regexp_replace(lower(title), '\\s+', ' ', 'g')), year ORDER BY citation_key) AS k FROM s) WHERE k = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, year, citation_key) AS rank FROM u)
SELECT q.query_id, CAST(coalesce(rank, 1) AS INT) AS rank, citation_key, score, CASE WHEN score IS NULL THEN 'not_found' WHEN doi <> '' AND score >= 0.95 THEN 'exact' WHEN score >= 0.75 THEN 'high_confidence' ELSE 'ambiguous' END AS status
FROM q LEFT JOIN r ON r.query_id = q.query_id AND rank <= 4""")
def verify_score_top4(spark, sf):
    e = C.entries(spark, sf)
    q = e.select(F.col("entry_id").alias("query_id"), "title", "author", (F.col("year").cast("int") + F.col("entry_id") % 2).cast("string").alias("year"))
    return resolve.verify(q, e)


@query("""SELECT p_partkey AS id, p_name AS title, 'Smith' AS author, CAST(1900 + p_partkey % 100 AS VARCHAR) AS year FROM part""")
def query_fields(spark, sf):
    n = F.col("p_partkey")
    p = C.table(spark, sf, "part").select(n.alias("id"), F.concat(F.lit("Smith, "), (F.lit(1900) + n % 100).cast("string"), F.lit('. "'), "p_name", F.lit('" in X')).alias("v"))
    return p.select("id", resolve.query_fields(F.col("v")).alias("f")).select("id", "f.title", "f.author", "f.year")


@query(r"""WITH n AS (SELECT *, trim(regexp_replace(lower(title), '[^\p{L}\p{N}_]+', ' ', 'g')) AS t, list_filter(regexp_extract_all(lower(author), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x <> 'and') AS w FROM entries)
SELECT q.entry_id AS query_id, arg_min(c.citation_key, c.entry_id) AS citation_key FROM n q JOIN n c ON q.t = c.t AND q.t <> '' AND c.entry_id <> q.entry_id
WHERE (q.year IS NULL OR c.year IS NULL OR q.year = c.year) AND (len(q.w) = 0 OR list_has_any(q.w, c.w)) GROUP BY 1""")
def title_match_exact(spark, sf):
    e = C.entries(spark, sf)
    q = e.select(F.col("entry_id").alias("query_id"), "title", "author", "year")
    # Each entry against the others: the first other one by id.
    c = e.select("citation_key", F.col("entry_id").alias("ordinal"), "title", "author", "year")
    return resolve.exact_matches(q, c, others_only=True)


def _cat(c: str) -> str:
    return f"list_distinct(list_transform(list_filter(regexp_extract_all(lower(coalesce({c}, '')), '[a-z0-9]+'), lambda x: length(x) >= 4 AND NOT list_contains([{', '.join(repr(w) for w in T.CATALOG_STOP)}], x)), lambda x: CASE WHEN ends_with(x, 'ical') AND length(x) > 6 THEN left(x, length(x) - 4) || 'ic' ELSE x END))"


@query(f"""WITH n AS (SELECT *, {_cat("title")} AS w FROM entries), p AS (SELECT q.entry_id AS query_id, c.citation_key, round(len(list_intersect(q.w, c.w)) / len(list_distinct(list_concat(q.w, c.w))), 6) AS score
FROM n q, n c WHERE len(q.w) > 0 AND len(c.w) > 0 AND (q.year IS NULL OR c.year IS NULL OR q.year = c.year))
SELECT query_id, citation_key, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, citation_key) AS k FROM p WHERE score >= 0.6) WHERE k = 1""")
def title_match_jaccard(spark, sf):
    e = C.entries(spark, sf)
    return resolve.catalog_matches(e.select(F.col("entry_id").alias("query_id"), "title", "year"), e)


_CASC = "[" + ", ".join(f"'{s}'" for s in resolve.CASCADE) + "]"


@query(f"""WITH a AS (SELECT citation_key, {_CASC}[i] AS source, i AS p, (entry_id * 7 + i * 5) % 11 < 2 AS found FROM entries, unnest(range(1, {len(resolve.CASCADE) + 1})) AS r(i)),
w AS (SELECT citation_key, min(p) FILTER (found) AS win FROM a GROUP BY 1)
SELECT w.citation_key, {_CASC}[win] AS source, array_to_string(list(a.source ORDER BY p), '>') AS attempts FROM w JOIN a ON a.citation_key = w.citation_key AND (win IS NULL OR p <= win) GROUP BY 1, 2""")
def resolve_cascade(spark, sf):
    e = C.entries(spark, sf).select("citation_key", "entry_id", F.posexplode(F.array(*map(F.lit, resolve.CASCADE))).alias("i", "source"))
    return resolve.cascade(e.select("citation_key", "source", ((F.col("entry_id") * 7 + (F.col("i") + 1) * 5) % 11 < 2).alias("found")))


@query("""SELECT citation_key, CASE WHEN trim(title) = '' OR starts_with(lower(title), 'referenced work ') THEN 'New ' || entry_id ELSE title END AS title, coalesce(doi, '10.9/n' || entry_id) AS doi,
  array_to_string(list_filter([CASE WHEN doi IS NOT NULL THEN 'doi' END, CASE WHEN trim(title) <> '' AND NOT starts_with(lower(title), 'referenced work ') THEN 'title' END], lambda x: x IS NOT NULL), ',') AS conflicts,
  CASE WHEN entry_type = 'misc' THEN 'article' ELSE entry_type END AS entry_type FROM entries""")
def merge_conflicts(spark, sf):
    from codexflow.functions import bibliographic as B

    e = C.entries(spark, sf)
    n = F.col("entry_id").cast("string")
    base = F.map_filter(F.create_map(F.lit("title"), F.col("title"), F.lit("doi"), F.col("doi")), lambda _, v: v.isNotNull())
    new = F.create_map(F.lit("title"), F.concat(F.lit("New "), n), F.lit("doi"), F.concat(F.lit("10.9/n"), n), F.lit("note"), F.lit(""))
    e = e.select("citation_key", base.alias("b"), new.alias("n"), B.merged_type(F.col("entry_type"), F.lit("article")).alias("entry_type"))
    merged = store.merge_fields(F.col("b"), F.col("n"))
    return e.select("citation_key", merged["title"].alias("title"), merged["doi"].alias("doi"), F.array_join(F.transform(store.merge_conflicts(F.col("b"), F.col("n")), lambda x: x["field_name"]), ",").alias("conflicts"), "entry_type")


@query("SELECT citation_key, coalesce(doi, 'oa-doi') AS doi, 'T' AS title, CASE WHEN coalesce(abstract, '') = '' THEN 'A' ELSE abstract END AS abstract FROM entries")
def enrich_protected(spark, sf):
    e = C.entries(spark, sf)
    have = store.fields_map(["doi", "title", "abstract"])
    new = F.create_map(F.lit("doi"), F.lit("oa-doi"), F.lit("title"), F.lit("T"), F.lit("abstract"), F.lit("A"))
    e = e.select("citation_key", store.protect(have, new, ("doi", "abstract")).alias("m"))
    return e.select("citation_key", *[F.col("m")[c].alias(c) for c in ("doi", "title", "abstract")])


@query("SELECT citation_key, entry_type = 'book' OR (entry_type = 'misc' AND regexp_matches(lower(title), 'dictionary|history|world|universe|record')) AS catalog FROM entries")
def prefers_catalog(spark, sf):
    return C.entries(spark, sf).select("citation_key", resolve.prefers_catalog().alias("catalog"))


_BODY = "regexp_replace(split_part(coalesce(text, ''), 'References', 1), '\\s+', ' ', 'g')"
_SENT = f"""sents AS (SELECT conv_id, turn, p, trim(s) AS s FROM (SELECT conv_id, turn, string_split(regexp_replace({_BODY}, '([.!?])\\s+([A-Z0-9"\\[])', '\\1' || chr(1) || '\\2', 'g'), chr(1)) AS l FROM conversations),
  unnest(l) WITH ORDINALITY AS u(s, p))"""


@query(f"""WITH {_SENT} SELECT conv_id, turn, count(*) AS n, max(length(s)) AS longest FROM sents
WHERE s <> '' AND NOT (upper(s) = s AND length(s) > 24) AND NOT regexp_matches(s, '^([IVX]+\\.|[A-Z]\\.)\\s+[A-Z]') AND NOT regexp_matches(lower(s), '{claims.NO_CLAIM[4:]}') GROUP BY 1, 2""")
def claim_sentences(spark, sf):
    c = C.table(spark, sf, "conversations").select("conv_id", "turn", F.explode(claims.sentences(F.col("text"))).alias("s"))
    return c.groupBy("conv_id", "turn").agg(F.count("*").alias("n"), F.max(F.length("s")).cast("long").alias("longest"))


@query("SELECT conv_id, turn, 3|| ',(Smith and Lee, 2001),Jones (1999' || CASE WHEN turn % 2 = 0 THEN 'a' ELSE '' END || ')' AS markers FROM conversations")
def claim_markers(spark, sf):
    c = C.table(spark, sf, "conversations")
    said = F.concat(F.lit("As shown [3] and [3] (Smith and Lee, 2001) by Jones (1999"), F.when(F.col("turn") % 2 == 0, "a").otherwise(""), F.lit(")."))
    return c.select("conv_id", "turn", F.array_join(claims.markers(said), ",").alias("markers"))


_SIG = claims.SIGNAL[4:]


@query(f"""SELECT conv_id, turn, round(CAST(3 AS DOUBLE) + (CASE WHEN length(text) >= 220 THEN 1.25 WHEN length(text) >= 140 THEN 0.85 WHEN length(text) >= 90 THEN 0.45 ELSE 0 END)
  + least(len(regexp_extract_all(regexp_replace(text, '[^\\x00-\\x7F]', 'x', 'g'), '(?i){_SIG}')), 6) * 0.25 + CASE WHEN contains(text, ',') THEN 0.2 ELSE 0 END + CASE WHEN regexp_matches(lower(text), '{claims.HINTS}') THEN 0.3 ELSE 0 END, 6) AS score FROM conversations""")
def claim_need_score(spark, sf):
    return C.table(spark, sf, "conversations").select("conv_id", "turn", F.round(claims.need_score(F.col("text")), 6).alias("score"))


@query()
def claim_rows(spark, sf):
    """Sequential: tests hold it against a plain loop."""
    return claims.claim_rows(C.table(spark, sf, "conversations"), ["conv_id", "turn"], least=45)


@query("""WITH w AS (SELECT conv_id * 1000 + turn AS claim_id, unnest(list_distinct(list_filter(regexp_extract_all(lower(text), '[a-z0-9]{4,}'), lambda x: NOT list_contains(""" + "[" + ", ".join(f"'{x}'" for x in T.CLAIM_STOP) + """], x)))) AS word FROM conversations),
t AS (SELECT citation_key, list_distinct(list_filter(regexp_extract_all(lower(title), '[a-z0-9]{4,}'), lambda x: NOT list_contains(""" + "[" + ", ".join(f"'{x}'" for x in T.CLAIM_STOP) + """], x))) AS l FROM entries),
e AS (SELECT citation_key, len(l) AS n, unnest(l) AS word FROM t), s AS (SELECT claim_id, citation_key, round(count(*) / any_value(n), 4) AS score FROM w JOIN e USING (word) GROUP BY 1, 2)
SELECT claim_id, CAST(k AS INT) AS rank, citation_key, score, CASE WHEN score >= 0.5 THEN 'candidate_support' ELSE 'candidate' END AS label FROM (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY score DESC, citation_key) AS k FROM s) WHERE k <= 3""")
def claim_support(spark, sf):
    c = C.table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("claim_id"), F.col("text").alias("claim"))
    return claims.support(c, C.entries(spark, sf))
