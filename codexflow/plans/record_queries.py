"""Queries of the readers, writers and reference extraction."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import text as T
from codexflow.operators import extract, store
from codexflow.plans import corpus as C
from codexflow.plans.registry import query
from codexflow.sources import bibtex, html, payloads, registry, sinks

_TITLE = "array_to_string(list_transform(string_split(p_name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') || ' study'"
_FAMS = "[" + ", ".join(f"'{x}'" for x in C.FAMILIES) + "][n % 12 + 1]"
_GIV = "[" + ", ".join(f"'{x}'" for x in C.GIVEN) + "][n % 7 + 1]"


@query(f"""SELECT ref_id, CASE m WHEN 0 THEN 'article' WHEN 1 THEN 'book' ELSE 'techreport' END AS entry_type,
  lower({_FAMS}) || yr || lower(regexp_replace(string_split(title, ' ')[1], '[^A-Za-z0-9]+', '', 'g')) || '1' AS citation_key, title, yr AS year,
  CASE WHEN m = 1 THEN {_FAMS} WHEN m = 0 THEN {_FAMS} || ', ' || left({_GIV}, 1) ELSE {_FAMS} || ', ' || left({_GIV}, 1) END AS author,
  CASE m WHEN 0 THEN 'Journal of Parts' WHEN 1 THEN 'University Press' END AS venue, CASE WHEN m = 0 THEN CAST(n % 40 + 1 AS VARCHAR) END AS volume,
  CASE m WHEN 0 THEN CAST(n % 6 + 1 AS VARCHAR) WHEN 2 THEN CAST(n AS VARCHAR) END AS number, CASE WHEN m = 0 THEN (n % 300) || '--' || (n % 300 + 9) END AS pages
FROM (SELECT p_partkey AS ref_id, p_partkey AS n, p_partkey % 4 AS m, CAST(1950 + p_partkey % 75 AS VARCHAR) AS yr, {_TITLE} AS title FROM part) WHERE m < 3""")
def parsed_references(spark, sf):
    out = extract.parse_references(C.references(spark, sf).withColumn("ordinal", F.lit(1)))
    f = lambda k: F.try_element_at("fields", F.lit(k))
    return out.select("ref_id", "entry_type", "citation_key", f("title").alias("title"), f("year").alias("year"), f("author").alias("author"), F.coalesce(f("journal"), f("publisher")).alias("venue"), f("volume").alias("volume"), f("number").alias("number"), f("pages").alias("pages"))


_V = [("Journal of X 12(3): 45-67", "article"), ("Proceedings of Y, pp. 10–20", "inproceedings"), ("Wiley, 5-9.", "book"), ("PhD thesis, MIT", "phdthesis"), ("Technical Report No. 7, Lab", "techreport"), ("nothing", "misc")]
_META = [
    ("Journal of X 12(3): 45-67", "article", "Journal of X", "12", "3", "45--67"), ("Proceedings of Y, pp. 10–20", "inproceedings", "Proceedings of Y", None, None, "10--20"), ("Wiley, 5-9.", "book", "Wiley", None, None, "5--9"),
    ("PhD thesis, MIT", "phdthesis", "MIT", None, None, None), ("Technical Report No. 7, Lab", "techreport", "Lab", None, "7", None), ("nothing", "misc", "nothing", None, None, None),
]


def _literal(v) -> str:
    return "NULL" if v is None else f"'{v}'"


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_literal, r)) + ")" for r in _META) + ") t(raw, entry_type, venue, volume, number, pages)")
def venue_metadata(spark, sf):
    return spark.createDataFrame([(v,) for v, _ in _V], "raw string").select("raw", extract.venue_metadata(F.col("raw")).alias("m")).select("raw", "m.*")


@query("""SELECT key, string_agg(line, ' ' ORDER BY pos) AS line, CAST(ordinal AS BIGINT) AS ordinal FROM (
  SELECT doc_id AS key, p AS pos, trim(regexp_replace(l, '\\s+', ' ', 'g')) AS line, sum(CASE WHEN first THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS ordinal FROM (
    SELECT *, lag(p) OVER (PARTITION BY doc_id ORDER BY p) IS NULL OR blank_before OR starts AS first FROM (
      SELECT doc_id, p, regexp_replace(trim(l), '^(?:\\[\\d+\\]|\\d+\\.|\\(\\d+\\))\\s*', '') AS l, regexp_matches(trim(l), '^(?:\\[\\d+\\]|\\d+\\.|\\(\\d+\\))') AS starts, trim(l) = '' AS blank,
        coalesce(lag(trim(l) = '') OVER (PARTITION BY doc_id ORDER BY p), false) AS blank_before FROM (
        SELECT doc_id, u.p, u.l FROM documents, unnest(string_split(replace(text, '. ', '.' || chr(10) || CASE WHEN doc_id % 2 = 0 THEN chr(10) ELSE '[' || (doc_id % 9) || '] ' END), chr(10))) WITH ORDINALITY AS u(l, p))
      WHERE trim(l) = '' OR length(trim(regexp_replace(regexp_replace(trim(l), '^(?:\\[\\d+\\]|\\d+\\.|\\(\\d+\\))\\s*', ''), '\\s+', ' ', 'g'))) >= 20)
    WHERE NOT blank)) GROUP BY key, ordinal""")
def reference_blocks(spark, sf):
    cut = F.when(F.col("doc_id") % 2 == 0, "\n").otherwise(F.concat(F.lit("["), (F.col("doc_id") % 9).cast("string"), F.lit("] ")))
    d = C.table(spark, sf, "documents").select(F.col("doc_id").alias("key"), F.replace("text", F.lit(". "), F.concat(F.lit(".\n"), cut)).alias("text"))
    return extract.reference_blocks(d, key="key")


_ALT = "ref_id % 3 <> 0"


def _compared(spark, sf):
    a = extract.parse_references(C.references(spark, sf).withColumn("ordinal", F.lit(1)))
    b = a.filter(_ALT).withColumn("fields", F.map_concat(F.map_filter("fields", lambda k, _: k != "year"), F.create_map(F.lit("year"), F.when(F.col("ref_id") % 5 == 0, "1900").otherwise(F.col("fields")["year"]))))
    return extract.compare_backends({"heuristic": a, "other": b}, "ref_id", ("title", "year"))


_CMP = """SELECT p_partkey AS ref_id, CASE WHEN p_partkey % 3 <> 0 THEN 'heuristic,other' ELSE 'heuristic' END AS backends,
  CASE WHEN p_partkey % 3 = 0 THEN 'title,year' WHEN p_partkey % 5 = 0 AND 1950 + p_partkey % 75 <> 1900 THEN 'year' ELSE '' END AS differing_fields FROM part WHERE p_partkey % 4 < 3"""


@query(_CMP)
def backend_compare(spark, sf):
    return _compared(spark, sf).select("ref_id", F.array_join("backends", ",").alias("backends"), F.array_join("differing_fields", ",").alias("differing_fields"))


@query(f"WITH c AS ({_CMP}) SELECT field, count(*) AS n, (SELECT count(*) FROM c) AS row_count, (SELECT count(*) FROM c WHERE differing_fields <> '') AS rows_with_differences FROM (SELECT unnest(string_split(differing_fields, ',')) AS field FROM c WHERE differing_fields <> '') GROUP BY field")
def backend_summary(spark, sf):
    return extract.comparison_summary(_compared(spark, sf))


@query(f"WITH c AS ({_CMP}) SELECT field, field || ' differs in ' || count(*) || ' rows, at most 10' AS failure FROM (SELECT unnest(string_split(differing_fields, ',')) AS field FROM c WHERE differing_fields <> '') WHERE field = 'year' GROUP BY field HAVING count(*) > 10")
def backend_threshold(spark, sf):
    return extract.threshold_failures(extract.comparison_summary(_compared(spark, sf)), {"year": 10})


@query("SELECT ref_id, contains(lower(line), 'http') OR length(line) - length(replace(line, ',', '')) >= 3 OR regexp_matches(line, '\\(\\d{4}[a-z]?\\)') OR regexp_matches(line, '\\b[A-Z]\\.[ ]?[A-Z]?\\.') AS blob FROM refs")
def citation_blobs(spark, sf):
    return C.references(spark, sf).select("ref_id", extract.is_citation_blob(F.col("line")).alias("blob"))


@query("SELECT p_partkey AS at, CASE WHEN p_partkey % 4 = 1 THEN 'Author A' || p_partkey || '. 1999. ' || p_name WHEN p_partkey = 0 THEN '---, 2001. ' || p_name ELSE 'Author A' || (p_partkey - (p_partkey + 3) % 4) || '. ' || '2001. ' || p_name END AS line FROM part")
def carried_authors(spark, sf):
    n = F.col("p_partkey")
    line = F.when(n % 4 == 1, F.concat(F.lit("Author A"), n.cast("string"), F.lit(". 1999. "), "p_name")).otherwise(F.concat(F.lit("---, 2001. "), "p_name"))
    p = C.table(spark, sf, "part").select(F.floor((n - 1) / 4).alias("page"), n.alias("at"), line.alias("line"))
    return extract.carry_authors(p).select("at", "line")


@query("SELECT citation_key, entry_type, title, author FROM entries WHERE title <> ''")
def bibtex_round_trip(spark, sf):
    e = C.entries(spark, sf).filter("title <> ''").select("entry_type", "citation_key", store.fields_map(["title", "author", "year", "journal", "doi"]).alias("fields"))
    text = e.select(bibtex.render(F.col("entry_type"), F.col("citation_key"), F.col("fields")).alias("text"))
    back = bibtex.parse_entries(text)
    return back.select("citation_key", "entry_type", F.col("fields")["title"].alias("title"), T.text(F.try_element_at("fields", F.lit("author"))).alias("author"))


@query("""SELECT citation_key, '@' || entry_type || '{' || citation_key || ',' || chr(10) || array_to_string(list_filter([CASE WHEN author <> '' THEN '  author = {' || author || '}' END, CASE WHEN year IS NOT NULL THEN '  year = {' || year || '}' END,
  CASE WHEN journal IS NOT NULL THEN '  journal = {' || journal || '}' END, CASE WHEN doi IS NOT NULL THEN '  doi = {' || doi || '}' END], lambda x: x IS NOT NULL), ',' || chr(10)) || chr(10) || '}' AS bibtex FROM entries""")
def rendered_bibtex(spark, sf):
    e = C.entries(spark, sf).select("entry_type", "citation_key", store.fields_map(["author", "year", "journal", "doi"]).alias("fields"))
    return sinks.export_bibtex(e, F.lit(False))


@query("SELECT 'doi' || replace(replace(lower(doi), '.', ''), '/', '') AS citation_key, 'article' AS entry_type, trim(regexp_replace(title, '\\s+', ' ', 'g')) AS title, author, year, 'J ' || lang AS journal, doi FROM entries WHERE doi IS NOT NULL AND title <> ''")
def crossref_records(spark, sf):
    e = C.entries(spark, sf).filter("doi is not null and title <> ''")
    person = F.transform(T.names(F.col("author")), lambda x: F.struct(F.when(x.contains(","), F.substring_index(x, ",", 1)).otherwise(x).alias("family"), F.when(x.contains(","), F.trim(F.substring_index(x, ",", -1))).otherwise("").alias("given")))
    issued = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts")))
    body = F.to_json(F.struct(F.lit("journal-article").alias("type"), F.array("title").alias("title"), person.alias("author"), F.col("doi").alias("DOI"), F.array(F.concat(F.lit("J "), "lang")).alias("container-title"), issued.alias("issued")))
    out = payloads.crossref(e.select(body.alias("body")))
    return out.select("citation_key", "entry_type", "title", T.text("author").alias("author"), "year", "journal", "doi")


@query("SELECT 'w' || entry_id AS openalex, 'openalexw' || entry_id AS citation_key, 'inproceedings' AS entry_type, year, 'alpha beta gamma alpha' AS abstract, 'Conf' AS booktitle FROM entries WHERE title <> ''")
def openalex_records(spark, sf):
    e = C.entries(spark, sf).filter("title <> ''")
    index = F.create_map(F.lit("alpha"), F.array(F.lit(0), F.lit(3)), F.lit("beta"), F.array(F.lit(1)), F.lit("gamma"), F.array(F.lit(2)))
    src = F.struct(F.struct(F.lit("Conf").alias("display_name"), F.lit("conference").alias("type")).alias("source"))
    body = F.to_json(F.struct(F.concat(F.lit("https://openalex.org/w"), F.col("entry_id").cast("string")).alias("id"), F.col("title").alias("display_name"), F.col("year").cast("int").alias("publication_year"), F.lit("other").alias("type"), index.alias("abstract_inverted_index"), src.alias("primary_location")))
    out = payloads.openalex(e.select(body.alias("body")))
    return out.select(F.col("extra")["openalex"].alias("openalex"), "citation_key", "entry_type", "year", "abstract", "booktitle")


@query("SELECT p_partkey AS id, p_partkey % 4 > 1 AS admitted FROM part")
def openalex_admission(spark, sf):
    n = F.col("p_partkey")
    title = F.when(n % 4 == 0, "Untitled work").when(n % 4 == 1, "The Blood Journal").when(n % 4 == 2, F.concat(F.lit("A long study of "), "p_name")).otherwise("Blood")
    doi = F.when(n % 4 == 3, "10.1/x").otherwise("")
    return C.table(spark, sf, "part").select(n.alias("id"), payloads.admits_openalex(title, F.lit("article"), doi, F.lit("the blood-journal"), F.lit("")).alias("admitted"))


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN props WHEN event_id % 4 = 1 THEN 'cached' END AS body FROM events")
def payload_lookup(spark, sf):
    ev = C.table(spark, sf, "events").select("event_id", "props", F.concat(F.lit("http://x/"), F.col("event_id").cast("string")).alias("url"))
    stored = ev.filter("event_id % 4 = 0").select("url", F.col("props").alias("body"))
    fresh = ev.filter("event_id % 4 < 2").select("url", F.lit("cached").alias("body"))
    return payloads.lookup(ev.select("event_id", "url"), stored, fresh).select("event_id", "body")


_OAI = "<record><header><identifier>oai:{0}</identifier></header><metadata><oai_dc:dc><dc:title>{1}</dc:title><dc:creator>Doe, Jane</dc:creator><dc:date>2001-02-03</dc:date><dc:type>Thesis</dc:type><dc:identifier>https://doi.org/10.5555/p{0}</dc:identifier></oai_dc:dc></metadata></record>"


@query("SELECT 'oai:' || p_partkey AS oai_id, 'phdthesis' AS entry_type, 'doe2001' || lower(string_split(p_name, ' ')[1]) || '1' AS citation_key, p_name AS title, 'Doe, Jane' AS author, '2001' AS year, '10.5555/p' || p_partkey AS doi FROM part")
def oai_records(spark, sf):
    a, rest = _OAI.split("{0}", 1)
    b, rest = rest.split("{1}", 1)
    c, d = rest.split("{0}", 1)
    n = F.col("p_partkey").cast("string")
    body = F.concat(F.lit("<ListRecords>" + a), n, F.lit(b), "p_name", F.lit(c), n, F.lit(d + "</ListRecords>"))
    out = payloads.oai_records(C.table(spark, sf, "part").select(body.alias("body")))
    return out.select("oai_id", "entry_type", "citation_key", "title", "author", "year", "doi")


@query("SELECT page_id, len(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"'']([^\"'']*)[\"'']')) AS n_links FROM pages")
def html_links(spark, sf):
    return C.table(spark, sf, "pages").select("page_id", F.size(html.links(F.col("html"))).cast("long").alias("n_links"))


@query("SELECT DISTINCT url AS page, regexp_extract(url, '^(https?://[^/?#]+)', 1) || regexp_replace(l, '#.*$', '') AS link FROM (SELECT url, unnest(regexp_extract_all(html, '(?i)<a\\s[^>]*?href=[\"''](/[^\"'']*)[\"'']', 1)) AS l FROM pages) WHERE NOT regexp_matches(l, '(?:biblio|origins\\.html)$')")
def html_topic_links(spark, sf):
    return html.topic_links(C.table(spark, sf, "pages"))


@query("SELECT page_id, trim(regexp_replace(regexp_extract(html, '(?is)<article>(.*?)</article>', 1), '<[^>]+>', '', 'g')) AS said FROM pages")
def html_reference_text(spark, sf):
    p = C.table(spark, sf, "pages")
    pre = F.regexp_replace(F.regexp_replace("html", "<article>", "<pre>"), "</article>", "</pre>")
    return p.select("page_id", html.reference_text(pre).alias("said"))


@query("SELECT * FROM (VALUES " + ", ".join(f"('{a}', '{b}', {len(c)})" for a, b, c in registry.SERVICES) + ") t(label, state, n)")
def source_catalog(spark, sf):
    return registry.catalog(spark).select("label", "state", F.size("capabilities").alias("n"))


@query("""SELECT 'works/' || citation_key || '.md' AS path, '---' || chr(10) || 'type: work' || chr(10) || 'id: "' || citation_key || '"' || chr(10) || 'title: "' || replace(title, '"', '\\"') || '"' || chr(10) || '---' || chr(10) || chr(10) || '# ' || title || chr(10) || chr(10)
  || '| field | value |' || chr(10) || '| --- | --- |' || chr(10) || '| author | ' || replace(author, '|', '\\|') || ' |' || chr(10) || '| year | ' || coalesce(year, '') || ' |' || chr(10) || '| doi | ' || coalesce(doi, '') || ' |' || chr(10) AS content FROM entries""")
def work_pages(spark, sf):
    return sinks.work_pages(C.entries(spark, sf))


@query("SELECT 'topics/' || slug || '.md' AS path, '# ' || name || chr(10) || chr(10) || count(e.citation_key) || ' works, ' || coalesce(min(year), '') || ' to ' || coalesce(max(year), '') || chr(10) AS content FROM topics LEFT JOIN entries e ON e.topic = slug GROUP BY slug, name")
def topic_pages(spark, sf):
    return sinks.topic_pages(C.entries(spark, sf), C.topics(spark, sf))


@query("SELECT 'node' AS kind, count(*) AS n FROM entries UNION ALL SELECT 'edge', (SELECT count(*) FROM relations) + (SELECT count(*) FROM entry_topics)")
def graph_profile(spark, sf):
    return sinks.graph_profile(C.entries(spark, sf), C.relations(spark, sf), C.entry_topics(spark, sf)).groupBy("kind").agg(F.count("*").alias("n"))
