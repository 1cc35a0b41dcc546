"""Queries of the services' records: responses are made from the model tables, mapped, and held against SQL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexflow.functions import text as T
from codexflow.plans import corpus as C
from codexflow.plans.registry import query
from codexflow.sources import payloads

_DOI_KEY = "'doi' || replace(replace(lower(doi), '.', ''), '/', '')"
_TITLE = "trim(regexp_replace(title, '\\s+', ' ', 'g'))"


def _titled(spark, sf):
    return C.entries(spark, sf).filter("title <> ''")


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[c.alias(k) for k, c in fields.items()])).alias("body")


def _id(prefix: str, c: str = "entry_id", suffix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.col(c).cast("string"), F.lit(suffix))


@query(f"""SELECT {_DOI_KEY} AS citation_key, CASE WHEN entry_id % 2 = 0 THEN 'techreport' ELSE 'misc' END AS entry_type, {_TITLE} AS title, nullif(author, '') AS author, year, doi, 'on ' || lang AS abstract
  FROM entries WHERE title <> '' AND doi IS NOT NULL""")
def datacite_records(spark, sf):
    e = _titled(spark, sf).filter("doi is not null")
    kind = F.when(F.col("entry_id") % 2 == 0, "Report").otherwise("Dataset")
    said = F.array(F.struct(F.lit("Other").alias("descriptionType"), F.lit("x").alias("description")), F.struct(F.lit("Abstract").alias("descriptionType"), F.concat(F.lit("Abstract: on "), "lang").alias("description")))
    attributes = F.struct(
        F.col("doi"), F.array(F.struct("title")).alias("titles"), F.transform(T.names(F.col("author")), lambda n: F.struct(n.alias("name"))).alias("creators"), F.col("year").cast("int").alias("publicationYear"),
        F.struct(kind.alias("resourceTypeGeneral")).alias("types"), said.alias("descriptions"),
    )
    return payloads.datacite(e.select(_json(attributes=attributes))).select("citation_key", "entry_type", "title", "author", "year", "doi", "abstract")


@query(f"""SELECT CASE WHEN doi IS NULL THEN 'pmid' || (1000 + entry_id) ELSE {_DOI_KEY} END AS citation_key, {_TITLE} AS title, 'Lee A and Bo C' AS author, year, CAST(1000 + entry_id AS VARCHAR) AS pmid,
  CASE WHEN entry_id % 2 = 0 THEN 'true' ELSE 'false' END AS is_oa FROM entries WHERE title <> ''""")
def europepmc_records(spark, sf):
    body = _json(
        pmid=(F.col("entry_id") + 1000).cast("string"), doi=F.col("doi"), title=F.concat("title", F.lit(".")), authorString=F.lit("Lee A, Bo C."), pubYear=F.col("year"),
        isOpenAccess=F.when(F.col("entry_id") % 2 == 0, "Y").otherwise("N"),
    )
    out = payloads.europepmc(_titled(spark, sf).select(body))
    return out.select("citation_key", "title", "author", "year", F.col("extra")["pmid"].alias("pmid"), F.col("extra")["is_oa"].alias("is_oa"))


@query(f"""SELECT CASE WHEN doi IS NULL THEN 's2p' || entry_id ELSE {_DOI_KEY} END AS citation_key, {_TITLE} AS title, nullif(author, '') AS author, year, doi, journal, '2101.' || entry_id AS arxiv FROM entries WHERE title <> ''""")
def semantic_scholar_records(spark, sf):
    ids = F.map_filter(F.create_map(F.lit("DOI"), F.col("doi"), F.lit("ArXiv"), _id("2101.")), lambda _, v: v.isNotNull())
    body = _json(
        paperId=_id("P"), title=F.col("title"), year=F.col("year").cast("int"), venue=F.col("journal"), authors=F.transform(T.names(F.col("author")), lambda n: F.struct(n.alias("name"))), externalIds=ids,
    )
    return payloads.semantic_scholar(_titled(spark, sf).select(body)).select("citation_key", "title", "author", "year", "doi", "journal", F.col("extra")["arxiv"].alias("arxiv"))


@query("SELECT 'olol' || entry_id || 'w' AS citation_key, 'book' AS entry_type, title, 'Ann Lee and Bo' AS author, year, publisher, '978' || entry_id AS isbn FROM entries WHERE title <> ''")
def open_library_records(spark, sf):
    body = _json(
        key=_id("/works/OL", suffix="W"), title=F.col("title"), author_name=F.array(F.lit("Ann Lee"), F.lit(" "), F.lit("Bo")), first_publish_year=F.col("year").cast("int"), publisher=F.array("publisher", F.lit("Other")),
        isbn=F.array(_id("978")),
    )
    return payloads.open_library(_titled(spark, sf).select(body)).select("citation_key", "entry_type", "title", "author", "year", "publisher", F.col("extra")["isbn"].alias("isbn"))


@query(f"""SELECT CASE WHEN doi IS NULL THEN 'lee' || coalesce(year, '') || regexp_replace(lower(split_part({_TITLE}, ' ', 1)), '[^\\p{{L}}\\p{{N}}]+', '', 'g') ELSE {_DOI_KEY} END AS citation_key, 'article' AS entry_type,
  {_TITLE} AS title, 'Lee, Ann and Bo, C.' AS author, year, 'J of X' AS journal, doi, CAST(entry_id AS VARCHAR) || '--9' AS pages FROM entries WHERE title <> ''""")
def open_citations_records(spark, sf):
    body = _json(
        id=F.concat_ws(" ", F.concat(F.lit("doi:"), "doi"), _id("omid:br/")), title=F.col("title"), author=F.lit("Lee, Ann [orcid:0000-0001]; Bo, C."), pub_date=F.concat("year", F.lit("-02-03")), venue=F.lit("J of X [issn:1234-5678]"),
        type=F.lit("journal article"), page=_id("", suffix="-9"),
    )
    return payloads.open_citations(_titled(spark, sf).select(body)).select("citation_key", "entry_type", "title", "author", "year", "journal", "doi", "pages")


@query("""SELECT lower(doi) AS source_doi, '10.7/t' || (entry_id + k) AS target_doi, CAST(0.85 AS DOUBLE) AS confidence FROM entries, (SELECT unnest([1, 2]) AS k) WHERE doi IS NOT NULL""")
def open_citations_edges(spark, sf):
    e = C.entries(spark, sf).filter("doi is not null")
    edge = lambda a, b: F.struct(a.alias("citing"), b.alias("cited"))
    to = lambda k: F.concat(F.lit("10.7/T"), (F.col("entry_id") + k).cast("string"))
    # The third has no id and the fourth is beyond the limit.
    made = F.array(edge(F.concat(F.lit("doi:"), "doi"), to(1)), edge(F.col("doi"), to(2)), edge(F.lit("omid:1"), to(3)), edge(F.col("doi"), to(4)))
    return payloads.open_citations_edges(e.select(F.to_json(made).alias("body")), limit=3)


@query(f"""SELECT {_DOI_KEY} AS citation_key, 'incollection' AS entry_type, title, year, journal, doi, CASE WHEN entry_id % 2 = 0 THEN 'true' ELSE 'false' END AS is_oa, CASE WHEN entry_id % 2 = 0 THEN 'http://oa/' || entry_id END AS oa_url
  FROM entries WHERE title <> '' AND doi IS NOT NULL""")
def unpaywall_records(spark, sf):
    free = F.col("entry_id") % 2 == 0
    body = _json(
        doi=F.col("doi"), title=F.col("title"), year=F.col("year").cast("int"), genre=F.lit("book-chapter"), journal_name=F.col("journal"), is_oa=free, best_oa_location=F.when(free, F.struct(_id("http://oa/").alias("url"))),
    )
    extra = lambda k: F.try_element_at("extra", F.lit(k)).alias(k)
    return payloads.unpaywall(_titled(spark, sf).filter("doi is not null").select(body)).select("citation_key", "entry_type", "title", "year", "journal", "doi", extra("is_oa"), extra("oa_url"))


@query("""SELECT '21' || p_partkey AS arxiv, 'lee2021' || lower(split_part(p_name, ' ', 1)) AS citation_key, p_name AS title, 'Ann Lee and Bo Ek' AS author, '2021' AS year, 'http://arxiv.org/abs/21' || p_partkey || 'v2' AS url, 'on ' || p_type AS abstract FROM part""")
def arxiv_records(spark, sf):
    one = lambda tag, *said: F.concat(F.lit(f"<{tag}>"), *said, F.lit(f"</{tag}>"))
    who = F.lit("<author><name>Ann Lee</name></author><author><name>Bo Ek</name></author>")
    entry = F.concat(one("id", _id("http://arxiv.org/abs/21", "p_partkey", "v2")), F.lit("<published>2021-01-02</published>"), one("title", F.col("p_name")), one("summary", F.lit("on "), F.col("p_type")), who)
    body = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><entry>'), entry, F.lit("</entry></feed>"))
    out = payloads.arxiv(C.table(spark, sf, "part").select(body.alias("body")))
    return out.select(F.col("extra")["arxiv"].alias("arxiv"), "citation_key", "title", "author", "year", "url", "abstract")


_MED = "CASE WHEN p_partkey % 2 = 0 THEN '1998' ELSE '2003' END"


def _articles(spark, sf):
    """PubMed articles: every other one has only the free date of its issue."""
    odd = F.col("p_partkey") % 2 == 1
    date = F.when(odd, "<PubDate><Year>2003</Year></PubDate>").otherwise("<PubDate><MedlineDate>1998 Jan-Feb</MedlineDate></PubDate>")
    who = F.lit("<AuthorList><Author><CollectiveName>The Group</CollectiveName></Author><Author><LastName>Lee</LastName><ForeName>Ann</ForeName></Author></AuthorList>")
    parts = F.concat(F.lit('<Abstract><AbstractText Label="AIM">To see.</AbstractText><AbstractText>On '), "p_type", F.lit(".</AbstractText></Abstract>"))
    body = F.concat(
        F.lit("<PubmedArticle><PMID>"), F.col("p_partkey").cast("string"), F.lit("</PMID><Article><ArticleTitle>"), "p_name", F.lit(".</ArticleTitle><Journal><Title>Parts</Title>"), date, F.lit("</Journal>"), who, parts,
        F.lit("<Pagination><MedlinePgn>10-20</MedlinePgn></Pagination></Article></PubmedArticle>"),
    )
    # The table is one small file, whose XML is large work: its rows go to all cores before bodies are made.
    part = C.table(spark, sf, "part").select("p_partkey", "p_name", "p_type").repartition(4 * spark.sparkContext.defaultParallelism, "p_partkey")
    return payloads.pubmed(part.select(body.alias("body"))).withColumn("pmid", F.col("extra")["pmid"])


@query(f"""SELECT 'pmid' || p_partkey AS citation_key, p_name AS title, 'The Group and Lee, Ann' AS author, {_MED} AS year, 'Parts' AS journal, '10--20' AS pages, 'AIM: To see. On ' || p_type || '.' AS abstract, CAST(p_partkey AS VARCHAR) AS pmid FROM part""")
def pubmed_records(spark, sf):
    return _articles(spark, sf).select("citation_key", "title", "author", "year", "journal", "pages", "abstract", "pmid")


@query(f"""SELECT coalesce(a.pmid, b.pmid) AS pmid, coalesce(a.title, b.title) AS title, coalesce(a.doi, b.doi) AS doi FROM
  (SELECT CAST(p_partkey AS VARCHAR) AS pmid, p_name AS title, CAST(NULL AS VARCHAR) AS doi FROM part) a FULL JOIN (SELECT CAST(p_partkey + 5 AS VARCHAR) AS pmid, 'summary' AS title, '10.8/' || p_partkey AS doi FROM part) b ON a.pmid = b.pmid""")
def merged_pubmed(spark, sf):
    summaries = C.table(spark, sf, "part").select((F.col("p_partkey") + 5).cast("string").alias("pmid"), F.lit("summary").alias("title"), _id("10.8/", "p_partkey").alias("doi"))
    return payloads.merge_pubmed(summaries, _articles(spark, sf)).select("pmid", "title", "doi")


@query("""SELECT id, CAST(position AS INT) AS position, CASE position WHEN 0 THEN 'DBLP:conf/x/' ELSE 'DBLP:journals/y/' END || id AS citation_key, CASE position WHEN 0 THEN 'inproceedings' ELSE 'article' END AS entry_type,
  p_name AS title, '2001' AS year, 'dblp' AS biburl FROM (SELECT p_partkey AS id, p_name, unnest(CASE WHEN p_partkey % 4 = 0 THEN [0] WHEN p_partkey % 3 = 0 THEN [0] ELSE [0, 1] END) AS position FROM part)""")
def dblp_search_records(spark, sf):
    """Searches of two hits, the second of which isn't stored for every third, and of one without a list for every fourth."""
    p, n = C.table(spark, sf, "part"), F.col("p_partkey")
    hit = lambda key: F.concat(F.lit('{"info":{"key":"' + key), n.cast("string"), F.lit('"}}'))
    hits = F.when(n % 4 == 0, hit("conf/x/")).otherwise(F.concat(F.lit("["), hit("conf/x/"), F.lit(","), hit("journals/y/"), F.lit(',{"info":{}}]')))
    asked = p.select(n.alias("id"), F.concat(F.lit('{"result":{"hits":{"hit":'), hits, F.lit("}}}")).alias("body"))
    record = lambda kind, key: p.select(
        _id(f"https://dblp.org/rec/{key}", "p_partkey", ".bib").alias("url"),
        F.concat(F.lit(f"@{kind}{{DBLP:{key}"), n.cast("string"), F.lit(", title = {"), "p_name", F.lit('}, year = 2001, biburl = "dblp"}\n@misc{second, title = {x}}')).alias("body"),
    )
    stored = record("inproceedings", "conf/x/").unionByName(record("article", "journals/y/").filter(F.regexp_extract("url", r"(\d+)\.bib$", 1).cast("int") % 3 != 0))
    return payloads.dblp_search(asked, stored, keep=("id",)).select("id", "position", "citation_key", "entry_type", "title", "year", F.try_element_at("extra", F.lit("biburl")).alias("biburl"))


@query("""SELECT CASE WHEN entry_id % 2 = 0 THEN 'Ann Lee_' ELSE 'crossref_' END || coalesce(year, 'n.d.') || '_' || title AS citation_key, 'article' AS entry_type, title, CASE WHEN entry_id % 2 = 0 THEN 'Ann Lee and Bo' END AS author, year, 'J' AS journal
  FROM entries WHERE title <> ''""")
def crossref_plain_records(spark, sf):
    person = lambda family, given: F.struct(F.lit(family).alias("family"), F.lit(given).alias("given"))
    who = F.when(F.col("entry_id") % 2 == 0, F.array(person("Lee", "Ann"), person("", "Cy"), person("Bo", ""))).otherwise(F.array(person("", "Cy")))
    issued = F.when(F.col("year").isNotNull(), F.struct(F.array(F.array(F.col("year").cast("int"))).alias("date-parts")))
    work = F.struct(F.array("title").alias("title"), who.alias("author"), F.lit("book").alias("type"), issued.alias("issued"), F.array(F.lit("J")).alias("container-title"), F.lit("").alias("DOI"))
    # A work stands alone or as a response's message.
    body = F.when(F.col("entry_id") % 3 == 0, F.to_json(F.struct(work.alias("message")))).otherwise(F.to_json(work))
    return payloads.crossref_plain(_titled(spark, sf).select(body.alias("body"))).select("citation_key", "entry_type", "title", "author", "year", "journal")


@query("SELECT 'oai:' || r_regionkey AS oai_id, r_name AS title FROM region")
def oai_paged_records(spark, sf):
    """A list over pages, each with the token of the next, the last without."""
    r, n = C.table(spark, sf, "region"), F.col("r_regionkey")
    last = r.agg(F.max("r_regionkey").alias("last"))
    token = F.when(n < F.col("last"), F.concat(F.lit("<resumptionToken>t"), (n + 1).cast("string"), F.lit("</resumptionToken>"))).otherwise(F.lit("<resumptionToken/>"))
    record = F.concat(F.lit("<record><header><identifier>oai:"), n.cast("string"), F.lit("</identifier></header><metadata><dc><title>"), "r_name", F.lit("</title></dc></metadata></record>"))
    pages = r.crossJoin(F.broadcast(last)).select(_id("t", "r_regionkey").alias("token"), F.concat(F.lit("<ListRecords>"), record, token, F.lit("</ListRecords>")).alias("body"))
    every = payloads.oai_pages(pages.filter("token = 't0'"), pages)
    return payloads.oai_records(every).select("oai_id", "title")


@query("""SELECT CAST(k AS INT) AS pos, 'lee2001' || lower(split_part(p_name, ' ', 1)) || (k + 1) AS citation_key, CASE k WHEN 0 THEN 'article' ELSE 'phdthesis' END AS entry_type, p_name AS title, 'Lee, Ann' AS author, '2001' AS year, '1--9' AS pages
  FROM part, (SELECT unnest([0, 1]) AS k)""")
def anystyle_records(spark, sf):
    one = lambda kind: F.struct(
        F.lit(kind).alias("type"), F.array("p_name").alias("title"), F.array(F.struct(F.lit("Lee").alias("family"), F.lit("Ann").alias("given"))).alias("author"), F.array(F.lit("May 2001")).alias("date"),
        F.array(F.lit("1-9")).alias("pages"),
    )
    rows = C.table(spark, sf, "part").select(F.to_json(F.array(one("article-journal"), one("thesis"))).alias("body"))
    return payloads.anystyle(rows).select("pos", "citation_key", "entry_type", "title", "author", "year", "pages")
