"""Records of scholarly services, read from a table of stored responses.

A response is a row ``(url, body)``. Looking one up is a join on the url's
hash; a missing response is null. Each service's records become entries with
the same columns by projection of its JSON or XML.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.operators.lineage import cut
from codexflow.functions import bibliographic as B
from codexflow.functions import text as T
from codexflow.sources import bibtex

#: The columns of every mapped record.
COLUMNS = ("entry_type", "citation_key", "title", "author", "year", "journal", "booktitle", "abstract", "doi", "url", "publisher", "volume", "number", "pages", "extra")

CROSSREF = (
    "type string, title array<string>, author array<struct<family:string,given:string>>, DOI string, URL string, abstract string, `container-title` array<string>, publisher string, "
    "`published-print` struct<`date-parts`:array<array<int>>>, `published-online` struct<`date-parts`:array<array<int>>>, issued struct<`date-parts`:array<array<int>>>, "
    "created struct<`date-parts`:array<array<int>>>, volume string, issue string, page string"
)
OPENALEX = (
    "id string, display_name string, publication_year int, doi string, type string, authorships array<struct<author:struct<display_name:string>>>, "
    "abstract_inverted_index map<string,array<int>>, primary_location struct<source:struct<display_name:string,type:string>>"
)
DATACITE = (
    "attributes struct<doi:string,titles:array<struct<title:string>>,creators:array<struct<familyName:string,givenName:string,name:string>>,"
    "descriptions:array<struct<descriptionType:string,description:string>>,publisher:string,publicationYear:int,url:string,types:struct<resourceTypeGeneral:string>>"
)
EUROPEPMC = "id string, pmid string, pmcid string, doi string, title string, authorString string, journalTitle string, pubYear string, abstractText string, isOpenAccess string, citedByCount int"
SEMANTIC = "paperId string, title string, year int, venue string, abstract string, authors array<struct<name:string>>, externalIds map<string,string>, citationCount int, openAccessPdf struct<url:string>"
OPENLIBRARY = "key string, title string, author_name array<string>, first_publish_year int, publisher array<string>, isbn array<string>"
OPENCITATIONS = "id string, title string, author string, pub_date string, venue string, volume string, issue string, page string, type string, publisher string"
UNPAYWALL = (
    "doi string, title string, year int, genre string, journal_name string, publisher string, is_oa boolean, oa_status string, "
    "best_oa_location struct<url:string,url_for_pdf:string,license:string,version:string,host_type:string>"
)


def url_key(url: Column, suffix: str = "json") -> Column:
    """The name under which a response is stored."""
    return F.concat(F.sha1(url), F.lit("." + suffix))


def lookup(requests: DataFrame, stored: DataFrame, fresh: DataFrame | None = None) -> DataFrame:
    """Requests ``(url)`` with ``body``: of the fixed responses, else of the cached ones, else null."""
    out = requests.join(stored.select(url_key(F.col("url")).alias("_k"), F.col("body").alias("_a")), url_key(F.col("url")) == F.col("_k"), "left").drop("_k")
    if fresh is not None:
        out = out.join(fresh.select(url_key(F.col("url")).alias("_k"), F.col("body").alias("_b")), url_key(F.col("url")) == F.col("_k"), "left").drop("_k")
    return out.withColumn("body", F.coalesce("_a", "_b") if fresh is not None else F.col("_a")).drop("_a", "_b")


def decode(raw: Column) -> Column:
    """Bytes as UTF-8, or as Latin-1 if they aren't."""
    return F.when(F.is_valid_utf8(raw.cast("string")), raw.cast("string")).otherwise(F.decode(raw, "ISO-8859-1"))


def _first(c: Column) -> Column:
    return F.get(c, 0)


def _abstract(c: Column) -> Column:
    return T.normalize_abstract(T.text(c))


def _record(df: DataFrame, keep: list[str], **fields: Column) -> DataFrame:
    """Rows with all columns of a record; those not given are null, blanks too."""
    extra = fields.pop("extra", F.create_map().cast("map<string,string>"))
    said = {c: F.nullif(T.text(fields[c].cast("string")), F.lit("")) if c in fields else F.lit(None).cast("string") for c in COLUMNS if c != "extra"}
    return df.select(*keep, *[v.alias(k) for k, v in said.items()], F.map_filter(extra, lambda _, v: v.isNotNull() & (v != "")).alias("extra"))


def _json(df: DataFrame, schema: str, body: str, keep: list[str]) -> DataFrame:
    return df.select(*keep, F.from_json(body, schema).alias("r")).filter("r is not null")


def crossref(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Crossref works: year of the first date that is given."""
    rows = _json(df, CROSSREF, body, list(keep))
    r = F.col("r")
    year = F.coalesce(*[_first(_first(r[d]["date-parts"])) for d in ("published-print", "published-online", "issued", "created")]).cast("string")
    who = F.array_join(F.transform(r["author"], lambda p: F.concat_ws(", ", F.nullif(p["family"], F.lit("")), F.nullif(p["given"], F.lit("")))), " and ")
    title, kind = T.normalize_text(T.text(_first(r["title"]))), B.mapped_type(r["type"], B.CROSSREF_TYPES)
    venue = _first(r["container-title"])
    key = F.when(T.filled(r["DOI"]).isNotNull(), B.prefixed_key("doi", r["DOI"])).otherwise(B.resolution_key(who, year, title))
    return _record(
        rows, list(keep), entry_type=kind, citation_key=key, title=title, author=who, year=year, doi=r["DOI"], url=r["URL"], abstract=_abstract(r["abstract"]), publisher=r["publisher"],
        journal=F.when(kind == "article", venue), booktitle=F.when(kind.isin("inproceedings", "incollection"), venue), volume=r["volume"], number=r["issue"], pages=B.normalize_pages(r["page"]),
    )


def crossref_plain(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Crossref works as the source plugin has them: always articles, whole names given first, keys of author, year and title."""
    rows = df.select(*keep, F.coalesce(F.from_json(F.get_json_object(body, "$.message"), CROSSREF), F.from_json(body, CROSSREF)).alias("r")).filter("r is not null")
    r = F.col("r")
    names = F.transform(F.filter(r["author"], lambda p: T.text(p["family"]) != ""), lambda p: F.concat_ws(" ", F.nullif(p["given"], F.lit("")), p["family"]))
    year = F.coalesce(*[F.nullif(_first(_first(r[d]["date-parts"])), F.lit(0)) for d in ("published-print", "published-online", "issued", "created")]).cast("string")
    title = F.array_join(r["title"], " ")
    or_ = lambda c, other: F.coalesce(F.nullif(c, F.lit("")), other)
    key = F.concat(F.coalesce(_first(names), F.lit("crossref")), F.lit("_"), F.coalesce(year, F.lit("n.d.")), F.lit("_"), or_(title, T.text(r["DOI"])))
    return _record(
        rows, list(keep), entry_type=F.lit("article"), citation_key=key, title=title, author=F.array_join(names, " and "), year=year, doi=r["DOI"], journal=_first(r["container-title"]),
        publisher=r["publisher"], url=r["URL"], abstract=F.trim(r["abstract"]),
    )


def dblp(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """DBLP records, BibTeX in each body: the first entry of each, with its own key; texts without one give no row."""
    rows = df.select(*keep, F.get(bibtex.parse_column(F.col(body)), 0).alias("r")).filter("r is not null")
    fields = F.col("r")["fields"]
    given = {c: F.try_element_at(fields, F.lit(c)) for c in COLUMNS if c not in ("entry_type", "citation_key", "extra")}
    rest = F.map_filter(fields, lambda k, _: ~k.isin(*given))
    return _record(rows, list(keep), entry_type=F.col("r")["entry_type"], citation_key=F.col("r")["citation_key"], **given, extra=rest)


def dblp_keys(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """The keys of a DBLP search's hits with their ``position``, and the url of each record; a lone hit may stand without a list."""
    hits = F.get_json_object(body, "$.result.hits.hit")
    one = "struct<info:struct<key:string>>"
    found = F.when(F.startswith(F.ltrim(hits), F.lit("[")), F.from_json(hits, f"array<{one}>")).otherwise(F.array(F.from_json(hits, one)))
    rows = df.select(*keep, F.posexplode(found).alias("position", "_h")).select(*keep, "position", F.col("_h.info.key").alias("dblp_key"))
    path = F.replace(F.replace(F.url_encode("dblp_key"), F.lit("%2F"), F.lit("/")), F.lit("%3A"), F.lit(":"))
    return rows.filter(T.text("dblp_key") != "").withColumn("url", F.concat(F.lit("https://dblp.org/rec/"), path, F.lit(".bib")))


def dblp_search(df: DataFrame, stored: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """A DBLP search's hits as records: each hit's key is looked up among stored responses."""
    kept = (*keep, "position", "dblp_key")
    return dblp(lookup(dblp_keys(df, body, keep), stored).filter("body is not null"), "body", kept)


def openalex(df: DataFrame, body: str = "body", keep: tuple[str, ...] = (), flavour: str = "resolve") -> DataFrame:
    """OpenAlex works. ``flavour``: ``resolve`` keeps the work's url, ``expand`` doesn't."""
    rows = _json(df, OPENALEX, body, list(keep))
    r = F.col("r")
    doi, oid = F.regexp_replace(T.text(r["doi"]), "^https://doi.org/", ""), F.substring_index(T.text(r["id"]), "/", -1)
    who = F.array_join(F.transform(r["authorships"], lambda a: T.display_name(a["author"]["display_name"])), " and ")
    src = r["primary_location"]["source"]
    title, year, kind = T.normalize_text(T.text(r["display_name"])), r["publication_year"].cast("string"), B.openalex_type(T.text(r["type"]), T.text(src["type"]))
    words = B.inverted_text(r["abstract_inverted_index"])
    in_journal = (T.text(r["type"]) == "article") | (T.text(src["type"]) == "journal")
    return _record(
        rows, list(keep), entry_type=kind, citation_key=B.openalex_key(doi, oid, who, year, title, "n.d." if flavour == "resolve" else "nd"), title=title, author=who, year=year, doi=doi,
        url=F.when(F.lit(flavour == "resolve"), r["id"]), abstract=F.when(~B.is_page_blob(words), words), journal=F.when(in_journal, src["display_name"]), booktitle=F.when(~in_journal, src["display_name"]),
        extra=F.create_map(F.lit("openalex"), oid),
    )


GENERIC_TITLES = (
    "blood", "cladistics", "leukemia", "springer", "addison-wesley", "physica d", "molecular biology and evolution", "lecture notes in artificial intelligence",
    "artificial life ii", "mcgill j educ", "j coll sci teach",
)


def admits_openalex(title: Column, work_type: Column, doi: Column, source: Column, abstract: Column) -> Column:
    """Whether a work is one: it has a title of its own, not that of its container, nor a generic one."""
    title, squeeze = T.normalize_text(T.text(title)), lambda c: F.regexp_replace(F.lower(T.text(c)), "[^a-z0-9]+", "")
    blank = (title == "") | (F.lower(title) == "untitled work")
    container = (squeeze(title) != "") & (squeeze(title) == squeeze(source))
    generic = F.lower(title).isin(*GENERIC_TITLES) | (~T.text(work_type).isin("book", "book-chapter", "dissertation") & title.rlike(r"^(?:[A-Z][a-z]?\.?\s*){1,4}$"))
    no_doi = T.text(doi) == ""
    return ~(blank | (no_doi & container) | (no_doi & (T.text(abstract) == "") & generic))


def datacite(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = _json(df, DATACITE, body, list(keep))
    r = F.col("r")["attributes"]
    who = F.array_join(F.transform(r["creators"], lambda p: F.coalesce(F.nullif(F.concat_ws(", ", F.nullif(p["familyName"], F.lit("")), F.nullif(p["givenName"], F.lit(""))), F.lit("")), p["name"])), " and ")
    title, year = T.normalize_text(T.text(_first(r["titles"])["title"])), r["publicationYear"].cast("string")
    said = F.get(F.filter(r["descriptions"], lambda d: F.lower(d["descriptionType"]) == "abstract"), 0)["description"]
    kind = B.mapped_type(F.lower(T.text(r["types"]["resourceTypeGeneral"])), B.DATACITE_TYPES)
    key = F.when(T.filled(r["doi"]).isNotNull(), B.prefixed_key("doi", r["doi"])).otherwise(B.resolution_key(who, year, title))
    return _record(rows, list(keep), entry_type=kind, citation_key=key, title=title, author=who, year=year, doi=r["doi"], url=r["url"], abstract=_abstract(said), publisher=r["publisher"])


def europepmc(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = _json(df, EUROPEPMC, body, list(keep))
    r = F.col("r")
    who = F.array_join(F.transform(F.filter(F.split(F.regexp_replace(T.text(r["authorString"]), r"\.$", ""), r",\s*"), lambda x: x != ""), T.display_name), " and ")
    key = B.pubmed_key(r["doi"], r["pmid"], who, r["pubYear"], r["title"])
    extra = F.create_map(F.lit("pmid"), r["pmid"], F.lit("pmcid"), r["pmcid"], F.lit("is_oa"), (r["isOpenAccess"] == "Y").cast("string"), F.lit("cited_by"), r["citedByCount"].cast("string"))
    return _record(rows, list(keep), entry_type=F.lit("article"), citation_key=key, title=F.regexp_replace(T.normalize_text(T.text(r["title"])), r"\.$", ""), author=who, year=r["pubYear"], journal=r["journalTitle"], doi=r["doi"], abstract=_abstract(r["abstractText"]), extra=extra)


def semantic_scholar(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = _json(df, SEMANTIC, body, list(keep))
    r = F.col("r")
    who, doi = F.array_join(F.transform(r["authors"], lambda a: a["name"]), " and "), F.try_element_at(r["externalIds"], F.lit("DOI"))
    key = F.when(T.filled(doi).isNotNull(), B.prefixed_key("doi", doi)).otherwise(B.prefixed_key("s2", r["paperId"]))
    extra = F.create_map(F.lit("s2"), r["paperId"], F.lit("arxiv"), F.try_element_at(r["externalIds"], F.lit("ArXiv")), F.lit("cited_by"), r["citationCount"].cast("string"), F.lit("pdf"), r["openAccessPdf"]["url"])
    return _record(rows, list(keep), entry_type=F.lit("article"), citation_key=key, title=T.normalize_text(T.text(r["title"])), author=who, year=r["year"], journal=r["venue"], abstract=_abstract(r["abstract"]), doi=doi, extra=extra)


def open_library(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = _json(df, OPENLIBRARY, body, list(keep))
    r = F.col("r")
    extra = F.create_map(F.lit("openlibrary"), r["key"], F.lit("isbn"), _first(r["isbn"]))
    return _record(rows, list(keep), entry_type=F.lit("book"), citation_key=B.prefixed_key("ol", F.substring_index(r["key"], "/", -1)), title=r["title"], author=F.array_join(F.filter(r["author_name"], lambda x: F.trim(x) != ""), " and "), year=r["first_publish_year"], publisher=_first(r["publisher"]), extra=extra)


def open_citations(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """Metadata rows: ids as ``scheme:value`` words, authors split at semicolons, ids in brackets dropped."""
    rows = _json(df, OPENCITATIONS, body, list(keep))
    r = F.col("r")
    doi = F.regexp_replace(F.get(F.filter(F.split(T.text(r["id"]), r"\s+"), lambda x: x.startswith("doi:")), 0), "^doi:", "")
    bare = lambda c: F.trim(F.regexp_replace(T.text(c), r"\s*\[[^\]]*\]", ""))
    who = F.array_join(F.filter(F.transform(F.split(T.text(r["author"]), ";"), bare), lambda x: x != ""), " and ")
    year, kind = F.substring(T.text(r["pub_date"]), 1, 4), B.mapped_type(F.replace(T.text(r["type"]), F.lit(" "), F.lit("-")), B.CROSSREF_TYPES)
    key = F.when(T.filled(doi).isNotNull(), B.prefixed_key("doi", doi)).otherwise(B.resolution_key(who, year, r["title"]))
    return _record(rows, list(keep), entry_type=kind, citation_key=key, title=T.normalize_text(T.text(r["title"])), author=who, year=year, journal=bare(r["venue"]), volume=r["volume"], number=r["issue"], pages=B.normalize_pages(r["page"]), doi=doi, publisher=bare(r["publisher"]))


def open_citations_edges(df: DataFrame, body: str = "body", limit: int = 25) -> DataFrame:
    """Edges of a list of citations; the limit holds before malformed rows go."""
    rows = df.select(F.explode(F.slice(F.from_json(body, "array<struct<citing:string,cited:string>>"), 1, limit)).alias("e"))
    doi = lambda c: F.lower(B.found(T.text(c), r"(?i)(?:doi:)?(10\.\S+)", 1))
    return rows.select(doi(F.col("e.citing")).alias("source_doi"), doi(F.col("e.cited")).alias("target_doi"), F.lit(0.85).alias("confidence")).filter("source_doi is not null and target_doi is not null")


def unpaywall(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    rows = _json(df, UNPAYWALL, body, list(keep))
    r, best = F.col("r"), F.col("r")["best_oa_location"]
    extra = F.create_map(*[x for k, v in {"is_oa": r["is_oa"].cast("string"), "oa_status": r["oa_status"], "oa_url": best["url"], "oa_pdf": best["url_for_pdf"], "oa_license": best["license"], "oa_version": best["version"], "oa_host": best["host_type"]}.items() for x in (F.lit(k), v)])
    return _record(rows, list(keep), entry_type=B.mapped_type(r["genre"], B.CROSSREF_TYPES), citation_key=B.prefixed_key("doi", r["doi"]), title=r["title"], year=r["year"], journal=r["journal_name"], publisher=r["publisher"], doi=r["doi"], extra=extra)


def _x(body: Column, path: str) -> Column:
    return F.trim(F.regexp_replace(F.xpath_string(body, F.lit(path)), r"\s+", " "))


def _local(*names: str) -> str:
    return "/".join(f"*[local-name()='{n}']" for n in names)


def arxiv(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """arXiv's Atom entries, one in each body."""
    b = F.col(body)
    entry = "//" + _local("entry")
    who = F.array_join(F.xpath(b, F.lit(f"{entry}/{_local('author', 'name')}/text()")), " and ")
    title, year = _x(b, f"{entry}/{_local('title')}"), F.left(_x(b, f"{entry}/{_local('published')}"), F.lit(4))
    aid = F.regexp_replace(F.substring_index(_x(b, f"{entry}/{_local('id')}"), "/abs/", -1), r"v\d+$", "")
    return _record(df, list(keep), entry_type=F.lit("misc"), citation_key=B.resolution_key(who, year, title), title=title, author=who, year=year, abstract=_x(b, f"{entry}/{_local('summary')}"), url=_x(b, f"{entry}/{_local('id')}"), extra=F.create_map(F.lit("arxiv"), aid))


def pubmed(df: DataFrame, body: str = "body", keep: tuple[str, ...] = ()) -> DataFrame:
    """PubMed article XML: abstract parts joined with their labels, authors one by one, the year of the
    article's date, else of the issue, else of the issue's free date."""
    b = F.col(body)
    # Each call of xpath parses the text anew: paths whose last tag isn't there are left out, and what is needed twice is bound.
    some = lambda x, path, tag=None: F.when(~x.contains(tag or "<" + path.rsplit("/", 1)[-1]), F.lit("")).otherwise(F.xpath_string(x, F.lit(path)))
    said = lambda v: F.nullif(F.trim(v), F.lit(""))
    flat = lambda path, tag=None: F.trim(F.regexp_replace(some(b, path, tag), r"\s+", " "))
    each = F.regexp_extract_all(b, F.lit(r"(?s)<Author\b[^>]*>.*?</Author>"), F.lit(0))
    facts = lambda a: F.struct(*[some(a, f"//{t}").alias(t) for t in ("LastName", "ForeName", "Initials", "CollectiveName")])
    name = lambda s: F.coalesce(F.nullif(F.concat_ws(", ", said(s["LastName"]), F.coalesce(said(s["ForeName"]), said(s["Initials"]))), F.lit("")), said(s["CollectiveName"]))
    parts = F.regexp_extract_all(b, F.lit(r"(?s)<AbstractText\b[^>]*>.*?</AbstractText>"), F.lit(0))
    part = lambda p: F.struct(some(p, "/AbstractText/@Label", "Label").alias("label"), some(p, "/AbstractText").alias("said"))
    read = {
        "who": F.transform(each, facts), "parts": F.transform(parts, part), "free": flat("//PubDate/MedlineDate"), "made": flat("//ArticleDate/Year", "<ArticleDate"), "issued": flat("//PubDate/Year"),
        "doi": flat("//ArticleId[@IdType='doi']", "<ArticleId"), "pmid": flat("//PMID"), "title": flat("//ArticleTitle"), "pages": flat("//MedlinePgn"),
    }
    df = df.withColumns({f"_{k}": v for k, v in read.items()})
    r = {k: F.col(f"_{k}") for k in read}
    names = F.array_join(F.filter(F.transform(r["who"], name), lambda n: n.isNotNull()), " and ")
    free = B.found(r["free"], B.QUERY_YEAR, 1)
    df = df.withColumns({"_names": names, "_year": F.coalesce(*[F.nullif(r[p], F.lit("")) for p in ("made", "issued")], free)})
    who, year = F.col("_names"), F.col("_year")
    doi, pmid = r["doi"], F.regexp_replace(r["pmid"], r"\D", "")
    title = F.regexp_replace(r["title"], r"\.$", "")
    words = F.array_join(F.filter(F.transform(r["parts"], lambda p: F.concat_ws(": ", F.nullif(p["label"], F.lit("")), said(p["said"]))), lambda p: p != ""), " ")
    return _record(df, list(keep), entry_type=F.lit("article"), citation_key=B.pubmed_key(doi, pmid, who, year, title), title=title, author=who, year=year, journal=flat("//Journal/Title", "<Journal"), volume=flat("//Volume"), number=flat("//Issue"), pages=B.normalize_pages(r["pages"]), doi=doi, abstract=T.collapse(words), extra=F.create_map(F.lit("pmid"), pmid))


def merge_pubmed(summaries: DataFrame, articles: DataFrame) -> DataFrame:
    """Summary and article of a pmid together; the article's fields first."""
    a, b = articles.alias("a"), summaries.alias("b")
    shared = [c for c in articles.columns if c in summaries.columns and c != "pmid"]
    return a.join(b, F.col("a.pmid") == F.col("b.pmid"), "full").select(F.coalesce("a.pmid", "b.pmid").alias("pmid"), *[F.coalesce(f"a.{c}", f"b.{c}").alias(c) for c in shared])


def oai_records(df: DataFrame, body: str = "body") -> DataFrame:
    """Records of an OAI-PMH list: Dublin Core and MODS become entries, others ``misc``."""
    raw = F.regexp_extract_all(F.col(body), F.lit(r"(?s)<record>.*?</record>"), F.lit(0))
    rows = df.select(F.posexplode(raw).alias("pos", "rec")).withColumn("rec", F.regexp_replace("rec", r"(</?)[A-Za-z_]+:", "$1"))
    rec = F.col("rec")
    every = lambda *paths: F.flatten(F.array(*[F.xpath(rec, F.lit(p)) for p in paths]))
    author = F.array_join(F.coalesce(F.nullif(every("//creator/text()"), F.array().cast("array<string>")), every("//name/namePart/text()")), " and ")
    title = F.get(every("//metadata//title/text()"), 0)
    dates = F.filter(every("//date/text()", "//dateIssued/text()"), lambda d: d.rlike(r"^\d{4}"))
    year = F.left(F.get(dates, 0), F.lit(4))
    said = F.lower(F.array_join(every("//type/text()", "//genre/text()"), " "))
    kind = F.when(said.contains("thesis") | said.contains("dissertation"), "phdthesis").when(said.contains("article"), "article").when(said.contains("book"), "book").when(said.contains("conference"), "inproceedings").otherwise("misc")
    ids = every("//metadata//identifier/text()")
    doi = F.get(F.filter(F.transform(ids, lambda i: F.regexp_extract(i, B.DOI, 0)), lambda i: i != ""), 0)
    url = F.get(F.filter(ids, lambda i: i.startswith("http")), 0)
    return rows.select(
        F.get(every("//header/identifier/text()"), 0).alias("oai_id"), kind.alias("entry_type"), B.reference_key(author, F.coalesce(year, F.lit("nd")), title, F.col("pos") + 1).alias("citation_key"),
        title.alias("title"), author.alias("author"), year.alias("year"), doi.alias("doi"), url.alias("url"), F.get(every("//description/text()", "//abstract/text()"), 0).alias("abstract"),
    )


def resumption_token(body: Column) -> Column:
    return B.found(body, r"<resumptionToken[^>]*>([^<]+)</resumptionToken>", 1)


def oai_pages(first: DataFrame, stored: DataFrame, most: int | None = None) -> DataFrame:
    """Pages ``(token, body)`` followed from the first by their tokens, until no page has a new one.

    ``most`` is the caller's limit, if any. Each page is kept before the next is
    looked up; a token that came before ends the walk.
    """
    page = out = first.select("body")
    seen = None
    while most is None or (most := most - 1) > 0:
        tokens = page.select(resumption_token(F.col("body")).alias("token")).filter("token is not null").distinct()
        new = cut(tokens if seen is None else tokens.join(seen, "token", "left_anti"))
        seen = new if seen is None else seen.unionByName(new)
        page = cut(new.join(stored, "token").select("body"))
        if page.limit(1).count() == 0:
            break
        out = out.unionByName(page)
    return out


def oai_identify(body: Column) -> Column:
    one = lambda n: F.xpath_string(body, F.lit(f"//*[local-name()='{n}']"))
    return F.struct(one("repositoryName").alias("name"), one("baseURL").alias("base_url"), one("protocolVersion").alias("version"), one("earliestDatestamp").alias("earliest"))


def oai_sets(body: Column) -> Column:
    every = lambda n: F.xpath(body, F.lit(f"//*[local-name()='set']/*[local-name()='{n}']/text()"))
    return F.arrays_zip(every("setSpec").alias("spec"), every("setName").alias("name"))


def oai_formats(body: Column) -> Column:
    every = lambda n: F.xpath(body, F.lit(f"//*[local-name()='{n}']/text()"))
    return F.arrays_zip(every("metadataPrefix").alias("prefix"), every("schema").alias("schema"))


def anystyle(df: DataFrame, body: str = "body") -> DataFrame:
    """The JSON of a reference parser: arrays of titles, authors, dates and so on."""
    schema = "array<struct<type:string,title:array<string>,author:array<struct<family:string,given:string>>,date:array<string>,`container-title`:array<string>,volume:array<string>,pages:array<string>,doi:array<string>>>"
    rows = df.select(F.posexplode(F.from_json(body, schema)).alias("pos", "r"))
    r = F.col("r")
    who = F.array_join(F.transform(r["author"], lambda p: F.concat_ws(", ", p["family"], p["given"])), " and ")
    year, title = B.found(T.text(_first(r["date"])), r"\d{4}"), T.clean_title(T.text(_first(r["title"])))
    kind = F.when(r["type"].startswith("article"), "article").when(r["type"] == "chapter", "incollection").when(r["type"].startswith("paper"), "inproceedings").when(r["type"] == "thesis", "phdthesis").when(r["type"] == "report", "techreport").when(r["type"] == "book", "book").otherwise("misc")
    return rows.select("pos", kind.alias("entry_type"), B.reference_key(who, year, title, F.col("pos") + 1).alias("citation_key"), title.alias("title"), who.alias("author"), year.alias("year"), _first(r["container-title"]).alias("venue"), _first(r["volume"]).alias("volume"), B.normalize_pages(_first(r["pages"])).alias("pages"), _first(r["doi"]).alias("doi"))


def rekey(key: Column, made: Column) -> Column:
    """Keys that a parser only counted are made anew."""
    return F.when(key.isNull() | key.isin("-1", "1", ""), made).otherwise(key)
