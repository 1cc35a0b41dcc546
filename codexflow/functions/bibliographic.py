"""Keys, identifiers, types, years and pages as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codexflow.functions import text as T

YEAR = r"(?i)\b(?:1[6-9]|20|21)\d{2}[a-z]?\b"
CORPUS_YEAR = r"\b((?:18|19|20)\d{2})\b"
QUERY_YEAR = r"\b(1[6-9]\d{2}|20\d{2}|21\d{2})\b"
DOI = r"(?i)\b10\.\d{4,9}/[-._;()/:A-Z0-9]+\b"
URL = r"(?i)https?://\S+"
ARXIV = r"(?i)\barXiv:\s*([A-Za-z0-9.\-]+)"
ISBN = r"\bISBN(?:-1[03])?:?\s*([0-9Xx\-]{10,20})\b"
ISSN = r"(?i)\bISSN:?\s*([0-9Xx\-]{8,12})\b"

#: What each scheme's identifiers look like after trimming (fixed values).
SCHEMES = {
    "doi": (r"^10\.\d{4,9}/\S+$", F.lower),
    "pmid": (r"^\d{5,7}$", lambda c: c),
    "pmcid": (r"^pmc(?:\d+|[0-9a-f]+)$", F.lower),
    "arxiv": (r"^\d{4}\.\d{4,5}$", lambda c: F.substring_index(F.lower(c), "v", 1)),
    "orcid": (r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$", lambda c: F.replace(F.upper(c), F.lit(" "), F.lit(""))),
    "ror": (r"(?i)^https?://ror\.org/[0-9a-z]{4,10}$", F.lower),
    "dblp": (r"^[a-zA-Z0-9_]+:[a-zA-Z0-9_]+$", lambda c: c),
    "openalex": (r"^W(?:[0-9]{4}-[A-F0-9]{4}|[0-9]+)$", F.upper),
}
PRIORITY = ("doi", "pmid", "pmcid", "arxiv", "dblp", "openalex")

CROSSREF_TYPES = {"journal-article": "article", "proceedings-article": "inproceedings", "book-chapter": "incollection", "book": "book", "proceedings": "proceedings"}
OPENALEX_TYPES = {"article": "article", "book": "book", "book-chapter": "incollection", "dissertation": "phdthesis", "proceedings-article": "inproceedings"}
DATACITE_TYPES = {
    "book": "book", "bookchapter": "incollection", "conferencepaper": "inproceedings", "dissertation": "phdthesis",
    "journalarticle": "article", "report": "techreport",
}


def _alnum(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, "[^A-Za-z0-9]+", ""))


def _or(c: Column, default: str) -> Column:
    return F.coalesce(F.nullif(c, F.lit("")), F.lit(default))


def family_of(authors: Column) -> Column:
    """The first author's family name: before the comma, else the last word."""
    first = F.trim(F.substring_index(T.collapse(T.text(authors)), " and ", 1))
    return F.when(first.contains(","), F.substring_index(first, ",", 1)).otherwise(F.regexp_extract(first, r"(\S+)$", 1))


def first_word(title: Column) -> Column:
    return F.regexp_extract(T.text(title), r"^\s*(\S+)", 1)


def reference_key(authors: Column, year: Column, title: Column, ordinal: Column) -> Column:
    """Of an extracted reference: family, year, first title word, ordinal."""
    return F.concat(_or(_alnum(family_of(authors)), "ref"), T.text(year), _or(_alnum(first_word(title)), "untitled"), ordinal.cast("string"))


def resolution_key(authors: Column, year: Column, title: Column) -> Column:
    """Of a resolved record: family, year, first title word, letters of any script."""
    keep = lambda c: F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]+", "")
    word = F.when(F.trim(T.text(title)) == "", "untitled").otherwise(keep(first_word(title)))
    return F.concat(_or(keep(family_of(authors)), "ref"), T.text(year), word)


def cited_key(doi: Column, authors: Column, year: Column, title: Column, ordinal: Column) -> Column:
    """Of a cited work: its doi, else as an extracted reference with ``nd`` for no year."""
    return F.when(T.filled(doi).isNotNull(), F.concat(F.lit("doi"), _alnum(doi))).otherwise(reference_key(authors, _or(T.text(year), "nd"), title, ordinal))


def openalex_key(doi: Column, openalex: Column, authors: Column, year: Column, title: Column, no_year: str = "n.d.") -> Column:
    fallback = resolution_key(_or(T.text(authors), "openalex"), _or(T.text(year), no_year), _or(T.text(title), "untitled"))
    return F.when(T.filled(doi).isNotNull(), F.concat(F.lit("doi"), _alnum(doi))).when(T.filled(openalex).isNotNull(), F.concat(F.lit("openalex"), _alnum(openalex))).otherwise(fallback)


def pubmed_key(doi: Column, pmid: Column, authors: Column, year: Column, title: Column) -> Column:
    return F.when(T.filled(doi).isNotNull(), F.concat(F.lit("doi"), _alnum(doi))).when(T.filled(pmid).isNotNull(), F.concat(F.lit("pmid"), pmid)).otherwise(resolution_key(authors, year, title))


def prefixed_key(prefix: str, value: Column) -> Column:
    """``s2``, ``ol``, ``pmid`` and the like before the letters and digits of an id."""
    return F.concat(F.lit(prefix), _alnum(value))


def normalize_identifier(scheme: Column, value: Column) -> Column:
    """An identifier in its scheme's form, or null if it isn't one."""
    out = F.when(F.lit(False), F.lit(None).cast("string"))
    for name, (pattern, change) in SCHEMES.items():
        said = change(F.trim(T.text(value)))
        out = out.when(scheme == name, F.when(said.rlike(pattern), said))
    return out


def identifiers(fields: Column) -> Column:
    """All valid identifiers of a field map, in priority order, then orcid and ror."""
    order = [*PRIORITY, "orcid", "ror"]
    each = [F.struct(F.lit(s).alias("scheme"), normalize_identifier(F.lit(s), F.try_element_at(fields, F.lit(s))).alias("value")) for s in order]
    return F.filter(F.array(*each), lambda x: x["value"].isNotNull())


def primary_identifier(fields: Column) -> Column:
    """The first valid one by priority, as ``scheme:value``."""
    return F.coalesce(*[F.concat(F.lit(s + ":"), normalize_identifier(F.lit(s), F.try_element_at(fields, F.lit(s)))) for s in PRIORITY])


def found(c: Column, pattern: str, group: int = 0) -> Column:
    """What a pattern finds first, or null."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def identifier_fields(line: Column) -> Column:
    """doi, url, arxiv, isbn and issn named in a line of text."""
    bare = lambda c: F.rtrim(c, F.lit(".,;)"))
    doi = bare(found(line, DOI))
    url = F.coalesce(F.concat(F.lit("https://doi.org/"), doi), bare(found(line, URL)))
    values = {"doi": doi, "url": url, "arxiv": bare(found(line, ARXIV, 1)), "isbn": found(line, ISBN, 1), "issn": found(line, ISSN, 1)}
    return F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda _, v: v.isNotNull())


def entry_type_of(venue: Column) -> Column:
    """The type that a venue's words suggest; the first rule that fits."""
    low = F.lower(T.text(venue))
    has = lambda *words: low.rlike("|".join(w.replace(".", r"\.") for w in words))
    return (
        F.when(low.contains("master") & low.contains("thesis"), "mastersthesis")
        .when(has("ph.d", "phd", "thesis", "dissertation"), "phdthesis")
        .when(has("technical report", "tech report", "report no", "working paper", "bulletin"), "techreport")
        .when(has("retrieved from", "available at", "accessed", "http://", "https://", "www."), "misc")
        .when(has("journal", "transactions", "review", "letters"), "article")
        .when(has("proceedings", "conference", "workshop", "symposium"), "inproceedings")
        .when(has("press", "publisher", "publications", "springer", "wiley", "elsevier", "university"), "book")
        .otherwise("misc")
    )


def mapped_type(c: Column, table: dict[str, str], default: str = "misc") -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), T.text(c)), F.lit(default))


def openalex_type(work: Column, source: Column) -> Column:
    by_source = F.when(source == "journal", "article").when(source == "conference", "inproceedings").otherwise("misc")
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in OPENALEX_TYPES.items() for x in kv]), T.text(work)), by_source)


def merged_type(base: Column, new: Column) -> Column:
    base, new = T.text(base), T.text(new)
    return F.when((base == "misc") & (new != "") & (new != "misc"), new).when(base == "", new).otherwise(base)


def normalize_pages(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(c), r"\s*[–-]+\s*", "--"), "-{3,}", "--")


def band(value: Column) -> Column:
    return (
        F.when(value.isNull(), "unknown").when(value < 0.2, "very_low").when(value < 0.4, "low").when(value < 0.7, "moderate").when(value < 0.9, "high").otherwise("very_high")
    )


def is_recent(year: Column, as_of_year: int, within: int) -> Column:
    """A year of digits only that is at most ``within`` years before."""
    return F.coalesce(year.rlike(r"^\d+$") & (year.try_cast("int") >= as_of_year - within), F.lit(False))


def is_placeholder(name: Column | str, value: Column) -> Column:
    """Blank, or a title that only stands in for one."""
    low = F.lower(T.collapse(T.text(value)))
    name = F.lit(name) if isinstance(name, str) else name
    return (low == "") | ((name == "title") & (low.rlike(r"^referenced work \d+$") | low.startswith("untitled")))


def inverted_text(index: Column) -> Column:
    """The text of a map from words to positions; of words at one position the last stays."""
    at = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda p: F.struct(p.cast("int").alias("p"), e["key"].alias("w")))))
    return T.normalize_text(F.array_join(F.transform(F.array_sort(at), lambda x: x["w"]), " "))


#: Text of web pages that were taken for abstracts (fixed values).
PAGE_MARKS = (
    "research article|", "download citation file", "this content is only available via pdf", "get citation alerts", "views icon",
    "toolbar search", "publisher site get access", "authors info & claims", "publication history", "copyright ",
)


def is_page_blob(c: Column) -> Column:
    return (F.length(c) > 60) & F.exists(F.array(*map(F.lit, PAGE_MARKS)), lambda m: F.lower(c).contains(m))
