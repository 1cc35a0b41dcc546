"""Queries of the scalar functions: texts, names, keys, identifiers, types."""

from __future__ import annotations

from pyspark.sql import functions as F

from codexflow.functions import bibliographic as B
from codexflow.functions import text as T
from codexflow.plans import corpus as C
from codexflow.plans.registry import query

_ENT = "replace(replace(replace({c}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"
_WS = "trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


def _norm(c: str) -> str:
    c = f"trim(regexp_replace(regexp_replace({_ENT.format(c=c)}, '<[^>]+>', ' ', 'g'), '\\s+', ' ', 'g'))"
    c = f"regexp_replace({c}, '([\\(\\[\\{{])\\s+', '\\1', 'g')"
    return f"regexp_replace({c}, '\\s+([\\)\\]\\}},.;:!?])', '\\1', 'g')"


_DIRTY = "'<b>Abstract: ' || coalesce(title, '') || ' &amp; ( x ) , y </b>  '"


def _dirty():
    return F.concat(F.lit("<b>Abstract: "), T.text("title"), F.lit(" &amp; ( x ) , y </b>  "))


@query(f"SELECT citation_key, {_norm(_DIRTY)} AS said, regexp_replace({_norm(_DIRTY)}, '^abstract\\s*[:.\\-]?\\s*', '', 'i') AS abstract FROM entries")
def normalized_text(spark, sf):
    return C.entries(spark, sf).select("citation_key", T.normalize_text(_dirty()).alias("said"), T.normalize_abstract(_dirty()).alias("abstract"))


@query(r"""SELECT citation_key, regexp_replace(trim('. "' || title || '";', ' .,;:"'''), '\s+', ' ', 'g') AS cleaned,
  trim(regexp_replace(regexp_replace(regexp_replace(replace(author || ' et al.', ' & ', ' and '), '\bet al\.?$', 'and others'), '\s+and\s+', ' and ', 'g'), '\s*,\s*', ', ', 'g'), ' .') AS authors FROM entries""")
def cleaned_titles(spark, sf):
    return C.entries(spark, sf).select("citation_key", T.clean_title(F.concat(F.lit('. "'), "title", F.lit('";'))).alias("cleaned"), T.normalize_authors(F.concat("author", F.lit(" et al."))).alias("authors"))


_FAM = "CASE WHEN contains(split_part(author, ' and ', 1), ',') THEN split_part(author, ',', 1) ELSE '' END"


@query(rf"""SELECT citation_key, coalesce(nullif(trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'topic') AS slug,
  coalesce(nullif(trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '-'), ''), 'topic') AS unicode_slug,
  coalesce(nullif(left(regexp_replace(lower(title), '[^a-z0-9]+', '', 'g'), 40), ''), 'verification') AS slug_key,
  trim(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_]+', ' ', 'g')) AS match_text,
  trim(regexp_replace(regexp_replace(replace(lower(title), '&', ' and '), '[^a-z0-9\s]+', ' ', 'g'), '\s+', ' ', 'g')) AS duplicate_text,
  trim(regexp_replace(lower(title), '[^a-z0-9]+', ' ', 'g')) AS claim_title,
  nullif(trim(regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')), '') AS fingerprint FROM entries""")
def text_forms(spark, sf):
    t = F.col("title")
    return C.entries(spark, sf).select(
        "citation_key", T.slug(t).alias("slug"), T.slug(t, unicode=True).alias("unicode_slug"), T.slug_key(t).alias("slug_key"), T.match_text(t).alias("match_text"),
        T.duplicate_text(t).alias("duplicate_text"), T.claim_title(t).alias("claim_title"), T.title_fingerprint(t).alias("fingerprint"),
    )


def _list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_STEM = "CASE " + " ".join(
    f"WHEN length(x) > {len(s) + 3} AND ends_with(x, '{s}') THEN left(x, length(x) - {len(s)})" + (" || 'y'" if s in ("ies", "ied") else "") for s in T.SUFFIXES
) + " ELSE x END"
_KW = f"list_distinct(list_transform(list_filter(regexp_extract_all(replace(lower(coalesce({{c}}, '')), 'ß', 'ss'), '[a-z0-9]+'), lambda x: length(x) >= 4), lambda x: {_STEM}))"
_REL = "MAP {" + ", ".join(f"'{k}': {_list(v)}" for k, v in T.related_terms().items()) + "}"


def expanded_sql(c: str) -> str:
    kw = _KW.format(c=c)
    return f"list_distinct(list_concat({kw}, flatten(list_transform({kw}, lambda t: coalesce(({_REL})[t], [])))))"


keyword_sql = _KW.format


@query(f"SELECT citation_key, array_to_string(list_sort({_KW.format(c='abstract')}), ' ') AS stems FROM entries")
def keyword_stems(spark, sf):
    return C.entries(spark, sf).select("citation_key", F.array_join(F.array_sort(T.keyword_terms(F.col("abstract"))), " ").alias("stems"))


_PHRASES = ["human evolution and fossils", "origins of primates", "the chimpanzees", "dental studies", "morphology ratings", "bodies"]


@query(f"SELECT p, array_to_string(list_sort({expanded_sql('p')}), ' ') AS terms FROM (SELECT unnest({_list(_PHRASES)}) AS p)")
def expanded_terms(spark, sf):
    return spark.createDataFrame([(p,) for p in _PHRASES], "p string").select("p", F.array_join(F.array_sort(T.expanded_terms(F.col("p"))), " ").alias("terms"))


@query(rf"""SELECT citation_key, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(abstract), '[a-z0-9]{{4,}}'), lambda x: NOT list_contains({_list(T.CLAIM_STOP)}, x)))), ' ') AS meaningful,
  array_to_string(list_sort(list_distinct(list_transform(list_filter(regexp_extract_all(lower(abstract), '[a-z0-9]+'), lambda x: length(x) >= 4 AND NOT list_contains({_list(T.CATALOG_STOP)}, x)), lambda x: CASE WHEN ends_with(x, 'ical') AND length(x) > 6 THEN left(x, length(x) - 4) || 'ic' ELSE x END))), ' ') AS catalog,
  array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(lower(author), '[a-z0-9]+'), lambda x: length(x) >= 2 AND x NOT IN ('and', 'et', 'al')))), ' ') AS authors FROM entries WHERE abstract IS NOT NULL""")
def token_sets(spark, sf):
    j = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), " ")
    e = C.entries(spark, sf).filter("abstract is not null")
    return e.select("citation_key", j(T.meaningful_tokens(F.col("abstract"))).alias("meaningful"), j(T.catalog_tokens(F.col("abstract"))).alias("catalog"), j(T.author_tokens(F.col("author"))).alias("authors"))


_FAMILY = "lower(regexp_replace(coalesce(nullif(split_part(author, ',', 1), ''), ''), '[^A-Za-z0-9]+', '', 'g'))"
_WORD = r"regexp_extract(title, '^\s*(\S+)', 1)"


@query(rf"""SELECT citation_key, coalesce(nullif({_FAMILY}, ''), 'ref') || coalesce(year, '') || coalesce(nullif(lower(regexp_replace({_WORD}, '[^A-Za-z0-9]+', '', 'g')), ''), 'untitled') || '7' AS extracted,
  coalesce(nullif(regexp_replace({_FAMILY}, '[^\p{{L}}\p{{N}}]+', '', 'g'), ''), 'ref') || coalesce(year, '') || CASE WHEN trim(title) = '' THEN 'untitled' ELSE regexp_replace(lower({_WORD}), '[^\p{{L}}\p{{N}}]+', '', 'g') END AS resolved,
  CASE WHEN doi IS NOT NULL THEN 'doi' || lower(regexp_replace(doi, '[^A-Za-z0-9]+', '', 'g')) ELSE coalesce(nullif({_FAMILY}, ''), 'ref') || coalesce(year, 'nd') || coalesce(nullif(lower(regexp_replace({_WORD}, '[^A-Za-z0-9]+', '', 'g')), ''), 'untitled') || '7' END AS cited,
  CASE WHEN doi IS NOT NULL THEN 'doi' || lower(regexp_replace(doi, '[^A-Za-z0-9]+', '', 'g')) ELSE 'openalexw' || entry_id END AS openalex FROM entries""")
def citation_keys(spark, sf):
    a, y, t, d = (F.col(c) for c in ("author", "year", "title", "doi"))
    oid = F.concat(F.lit("W"), F.col("entry_id").cast("string"))
    return C.entries(spark, sf).select("citation_key", B.reference_key(a, y, t, F.lit(7)).alias("extracted"), B.resolution_key(a, y, t).alias("resolved"), B.cited_key(d, a, y, t, F.lit(7)).alias("cited"), B.openalex_key(d, oid, a, y, t).alias("openalex"))


_IDS = {
    "doi": "' 10.1234/ABC' || n || ' '", "pmid": "CAST(n AS VARCHAR)", "pmcid": "'PMC' || n", "arxiv": "'2101.' || lpad(CAST(n % 90000 + 1000 AS VARCHAR), 5, '0') || 'v2'", "orcid": "'0000-0001-' || lpad(CAST(n % 10000 AS VARCHAR), 4, '0') || '-123x'",
    "ror": "'https://ror.org/0A' || n", "dblp": "'conf:x' || n", "openalex": "'w' || n",
}
_VALID = {"doi": r"^10\.\d{4,9}/\S+$", "pmid": r"^\d{5,7}$", "pmcid": r"^pmc(?:\d+|[0-9a-f]+)$", "arxiv": r"^\d{4}\.\d{4,5}$", "orcid": r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$", "ror": r"^https?://ror\.org/[0-9a-z]{4,10}$", "dblp": r"^[a-zA-Z0-9_]+:[a-zA-Z0-9_]+$", "openalex": r"^W(?:[0-9]{4}-[A-F0-9]{4}|[0-9]+)$"}
_CASE = {"doi": "lower(v)", "pmid": "v", "pmcid": "lower(v)", "arxiv": "split_part(lower(v), 'v', 1)", "orcid": "upper(v)", "ror": "lower(v)", "dblp": "v", "openalex": "upper(v)"}


@query(" UNION ALL ".join(f"SELECT p AS part, '{s}' AS scheme, CASE WHEN regexp_matches({_CASE[s]}, '{_VALID[s]}') THEN {_CASE[s]} END AS value FROM (SELECT n AS p, trim({v}) AS v FROM (SELECT p_partkey * 37 AS n FROM part))" for s, v in _IDS.items()))
def normalized_identifiers(spark, sf):
    n = C.table(spark, sf, "part").select((F.col("p_partkey") * 37).alias("n"))
    rows = None
    for s, v in _IDS.items():
        one = n.select(F.col("n").alias("part"), F.lit(s).alias("scheme"), F.expr(v.replace("VARCHAR", "STRING")).alias("value"))
        rows = one if rows is None else rows.unionByName(one)
    return rows.select("part", "scheme", B.normalize_identifier(F.col("scheme"), F.col("value")).alias("value"))


@query("SELECT citation_key, CASE WHEN doi IS NOT NULL THEN 'doi:' || lower(doi) WHEN entry_id >= 10000 AND entry_id <= 9999999 THEN 'pmid:' || entry_id ELSE 'openalex:W' || entry_id END AS id FROM entries")
def primary_identifiers(spark, sf):
    e = C.entries(spark, sf)
    fields = F.create_map(F.lit("openalex"), F.concat(F.lit("w"), F.col("entry_id").cast("string")), F.lit("pmid"), F.col("entry_id").cast("string"), F.lit("doi"), F.col("doi"))
    return e.select("citation_key", B.primary_identifier(fields).alias("id"))


@query(r"SELECT ref_id, nullif(rtrim(regexp_extract(line, '10\.\d{4,9}/[-._;()/:A-Za-z0-9]+'), '.,;)'), '') AS doi, nullif(regexp_extract(line, '\b((1[6-9]|20|21)\d{2}[a-z]?)\b', 1), '') AS year FROM refs")
def identifiers_in_text(spark, sf):
    return C.references(spark, sf).select("ref_id", F.try_element_at(B.identifier_fields(F.col("line")), F.lit("doi")).alias("doi"), B.found(F.col("line"), B.YEAR).alias("year"))


_VENUES = ["Journal of X", "Master's Thesis, MIT", "PhD dissertation", "Technical Report No. 3", "Retrieved from http://x", "Proceedings of Y", "Wiley", "somewhere", "ACM Transactions", "Doctoral dissertation", "Working Paper 4", "Annual Conference", "University of Z", ""]
_TYPE_SQL = """CASE WHEN contains(v, 'master') AND contains(v, 'thesis') THEN 'mastersthesis' WHEN regexp_matches(v, 'ph\\.d|phd|thesis|dissertation') THEN 'phdthesis'
  WHEN regexp_matches(v, 'technical report|tech report|report no|working paper|bulletin') THEN 'techreport' WHEN regexp_matches(v, 'retrieved from|available at|accessed|http://|https://|www\\.') THEN 'misc'
  WHEN regexp_matches(v, 'journal|transactions|review|letters') THEN 'article' WHEN regexp_matches(v, 'proceedings|conference|workshop|symposium') THEN 'inproceedings'
  WHEN regexp_matches(v, 'press|publisher|publications|springer|wiley|elsevier|university') THEN 'book' ELSE 'misc' END"""


@query("SELECT venue, " + _TYPE_SQL + " AS entry_type FROM (SELECT venue, lower(venue) AS v FROM (SELECT unnest([" + ", ".join("'" + v.replace("'", "''") + "'" for v in _VENUES) + "]) AS venue))")
def guessed_types(spark, sf):
    return spark.createDataFrame([(v,) for v in _VENUES], "venue string").select("venue", B.entry_type_of(F.col("venue")).alias("entry_type"))


@query("SELECT p_partkey AS id, regexp_replace((p_partkey % 300) || ' – ' || (p_partkey % 300 + 9), '\\s*[–-]+\\s*', '--', 'g') AS pages FROM part")
def page_ranges(spark, sf):
    n = F.col("p_partkey")
    return C.table(spark, sf, "part").select(n.alias("id"), B.normalize_pages(F.concat((n % 300).cast("string"), F.lit(" – "), (n % 300 + 9).cast("string"))).alias("pages"))


@query("SELECT l_orderkey, l_linenumber, l_discount AS value, CASE WHEN v < 0.2 THEN 'very_low' WHEN v < 0.4 THEN 'low' WHEN v < 0.7 THEN 'moderate' WHEN v < 0.9 THEN 'high' ELSE 'very_high' END AS band FROM (SELECT *, l_discount * 10 AS v FROM lineitem)")
def confidence_bands(spark, sf):
    return C.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").alias("value"), B.band(F.col("l_discount") * 10).alias("band"))


@query("SELECT citation_key, year FROM entries WHERE TRY_CAST(year AS INT) >= 2026 - 20")
def recent_entries(spark, sf):
    return C.entries(spark, sf).filter(B.is_recent(F.col("year"), 2026, 20)).select("citation_key", "year")


@query("SELECT citation_key, trim(title) = '' OR regexp_matches(lower(title), '^referenced work \\d+$') AS placeholder FROM entries")
def placeholders(spark, sf):
    return C.entries(spark, sf).select("citation_key", B.is_placeholder("title", F.col("title")).alias("placeholder"))


@query(r"SELECT c_custkey, family || ', ' || given AS person, lower(family) AS surname FROM (SELECT c_custkey, 'N' || c_custkey AS family, replace(c_mktsegment, ' ', '') AS given FROM customer)")
def person_names(spark, sf):
    c = C.table(spark, sf, "customer").select("c_custkey", F.concat(F.replace("c_mktsegment", F.lit(" "), F.lit("")), F.lit(" N"), F.col("c_custkey").cast("string")).alias("n"))
    p = T.person(F.col("n"))
    return c.select("c_custkey", F.concat_ws(", ", p["family"], p["given"]).alias("person"), T.surname(F.col("n")).alias("surname"))


@query("SELECT c_custkey, 'Tolkien' || c_custkey || ', ' || CASE WHEN c_custkey % 2 = 0 THEN 'K. ' ELSE '' END || 'J. R.' AS said FROM customer WHERE c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'Tolkien' || c_custkey || ', John' FROM customer WHERE c_custkey % 3 = 0")
def display_names(spark, sf):
    n = F.col("c_custkey")
    raw = F.when(n % 3 == 0, F.concat(F.lit("Tolkien"), n.cast("string"), F.lit(", John"))).otherwise(F.concat(F.lit("J.R., Tolkien"), n.cast("string"), F.when(n % 2 == 0, " K").otherwise("")))
    return C.table(spark, sf, "customer").select("c_custkey", T.display_name(raw).alias("said"))


@query("SELECT event_id, array_to_string(list_sort([trim(x) for x in regexp_split_to_array(v, '[\n;,]') if trim(x) <> '']), '|') AS parts FROM (SELECT event_id, event_type || '; a' || (event_id % 3) || ',, b ' AS v FROM events)")
def relation_values(spark, sf):
    ev = C.table(spark, sf, "events").select("event_id", F.concat("event_type", F.lit("; a"), (F.col("event_id") % 3).cast("string"), F.lit(",, b ")).alias("v"))
    return ev.select("event_id", F.array_join(F.array_sort(T.relation_values(F.col("v"))), "|").alias("parts"))


@query(r"""SELECT p_partkey AS id, replace(replace(replace(replace(x, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;') AS html, replace(replace(x, '\', '\\'), '"', '\"') AS dot, trim(replace(x, '|', '\|')) AS cell FROM (SELECT p_partkey, p_name || ' <a> & "b" | c\d' AS x FROM part)""")
def escaped_texts(spark, sf):
    x = F.concat("p_name", F.lit(' <a> & "b" | c\\d'))
    return C.table(spark, sf, "part").select(F.col("p_partkey").alias("id"), T.escape_html(x).alias("html"), T.escape_dot(x).alias("dot"), T.escape_cell(x).alias("cell"))


@query("SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS said FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM (SELECT doc_id, list_filter(regexp_split_to_array(regexp_replace(lower(text), '[^a-z]+', ' ', 'g'), ' '), lambda x: x <> '') AS w FROM documents)) GROUP BY doc_id")
def inverted_index_text(spark, sf):
    words = F.filter(F.split(F.regexp_replace(F.lower("text"), "[^a-z]+", " "), " "), lambda x: x != "")
    rows = C.table(spark, sf, "documents").select("doc_id", F.posexplode(words).alias("p", "w"))
    index = rows.groupBy("doc_id", "w").agg(F.collect_list("p").alias("ps")).groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("w", "ps"))).alias("index"))
    return index.select("doc_id", B.inverted_text(F.col("index")).alias("said"))


@query("SELECT conv_id, turn, length(text) > 60 AND contains(lower(text), 'copyright ') AS blob FROM conversations")
def page_blobs(spark, sf):
    return C.table(spark, sf, "conversations").select("conv_id", "turn", B.is_page_blob(F.col("text")).alias("blob"))
