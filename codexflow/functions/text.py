"""Text functions as column expressions: all run inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words without meaning for duplicate-topic keywords (fixed values).
TOPIC_STOP = (
    "about across after among analysis book books conference data edition effects example first from human humans journal method methods "
    "paper papers review science second studies study system their theory title using"
).split()
#: Endings in the order in which the keyword stemmer tries them (fixed values).
SUFFIXES = ("isms", "ists", "ation", "ment", "ings", "ness", "ism", "ist", "ing", "ers", "er", "ies", "ied", "ed", "es", "s")
#: Related words; a term belongs to the first group that holds it (fixed values).
RELATED = (
    ("human", "hominid", "hominin", "homo"),
    ("chimpanzee", "chimp", "pan", "ape", "apes", "primate"),
    ("primate", "ape", "apes", "hominid", "hominin"),
    ("evolution", "evolutionary", "phylogeny", "phylogen", "ancestor", "ancestral"),
    ("origin", "origins", "abiogenesis", "prebiotic"),
    ("morphometry", "morphology", "cranial", "dental", "skeletal", "body"),
    ("paleolithic", "paleoanthropology", "paleoanthropological", "pleistocene", "fossil"),
)
CLAIM_STOP = ("this", "that", "with", "from", "their", "there", "into", "about", "through", "using")
CATALOG_STOP = ("the", "and", "for", "with", "from", "into", "after", "all")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _latin_folds() -> tuple[str, str]:
    """Accented lower-case Latin letters and their base letters, by decomposition."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))) for c in range(0xC0, 0x250)]
    pairs = [(a, b[0]) for a, b in pairs if len(b) > 1 and b[0].isascii() and a == a.lower()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def text(c: Column | str) -> Column:
    """A column with null as the empty text."""
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def let(c: Column, f) -> Column:
    """``f`` of a value that is computed once for a row, however often ``f`` names it."""
    return F.get(F.transform(F.array(c), f), 0)


def filled(c: Column | str) -> Column:
    """The trimmed value, or null if it is missing or blank."""
    return F.nullif(F.trim(text(c)), F.lit(""))


def collapse(c: Column) -> Column:
    """White space as single blanks, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def fold(c: Column) -> Column:
    """Lower case without diacritics, as the search index has it."""
    a, b = _latin_folds()
    return F.translate(F.lower(c), a, b)


def strip_chars(c: Column, chars: str) -> Column:
    """Trim any of ``chars`` at both ends."""
    return F.btrim(c, F.lit(chars))


def normalize_text(c: Column) -> Column:
    """Without entities and tags, white space collapsed, none inside brackets or before punctuation."""
    for entity, said in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(said))
    c = collapse(F.regexp_replace(F.regexp_replace(c, r"<[^>]+>", " "), " ", " "))
    return F.regexp_replace(F.regexp_replace(c, r"([\(\[\{])\s+", "$1"), r"\s+([\)\]\},.;:!?])", "$1")


def normalize_abstract(c: Column) -> Column:
    return F.regexp_replace(normalize_text(c), r"(?i)^abstract\s*[:.\-]?\s*", "")


def clean_title(c: Column) -> Column:
    return F.regexp_replace(strip_chars(c, " .,;:\"'"), r"\s+", " ")


def normalize_authors(c: Column) -> Column:
    c = F.replace(c, F.lit(" & "), F.lit(" and "))
    c = F.regexp_replace(c, r"\bet al\.?$", "and others")
    c = F.regexp_replace(F.regexp_replace(c, r"\s+and\s+", " and "), r"\s*,\s*", ", ")
    return strip_chars(c, " .")


def names(c: Column) -> Column:
    """The names of an author field."""
    return F.filter(F.transform(F.split(text(c), " and "), lambda x: F.trim(x)), lambda x: x != "")


def person(c: Column) -> Column:
    """Family and given names: split at the comma, else the last word is the family name."""
    comma = c.contains(",")
    words = F.split(F.trim(c), r"\s+")
    given = F.array_join(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), " ")
    return F.struct(
        F.when(comma, F.trim(F.substring_index(c, ",", 1))).otherwise(F.element_at(words, -1)).alias("family"),
        F.when(comma, F.trim(F.regexp_replace(c, "^[^,]*,", ""))).otherwise(given).alias("given"),
    )


def surname(c: Column) -> Column:
    """Lower case; before the comma, else the last word."""
    c = F.trim(text(c))
    return F.lower(F.when(c.contains(","), F.trim(F.substring_index(c, ",", 1))).otherwise(F.regexp_extract(c, r"(\S+)$", 1)))


def relation_values(c: Column) -> Column:
    """Keys in a relation field, split at line ends, semicolons and commas."""
    return F.filter(F.transform(F.split(text(c), "[\n;,]"), lambda x: F.trim(x)), lambda x: x != "")


def tokens(c: Column) -> Column:
    """Distinct lower-case runs of letters, digits and underscores."""
    return F.array_distinct(F.filter(F.split(F.lower(text(c)), r"[^\p{L}\p{N}_]+"), lambda x: x != ""))


def slug(c: Column, default: str = "topic", unicode: bool = False) -> Column:
    """Lower-case words joined by hyphens; ``unicode`` keeps letters beyond ASCII."""
    kept = r"[^\p{L}\p{N}]+" if unicode else "[^a-z0-9]+"
    return F.coalesce(F.nullif(strip_chars(F.regexp_replace(F.lower(text(c)), kept, "-"), "-"), F.lit("")), F.lit(default))


def slug_key(c: Column, default: str = "verification") -> Column:
    """ASCII letters and digits only, at most 40."""
    return F.coalesce(F.nullif(F.substring(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", ""), 1, 40), F.lit("")), F.lit(default))


def match_text(c: Column) -> Column:
    """For title matches: lower case, everything but letters and digits as a blank."""
    return F.trim(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_]+", " "))


def duplicate_text(c: Column) -> Column:
    """For duplicate keys: ASCII only."""
    c = F.replace(F.lower(text(c)), F.lit("&"), F.lit(" and "))
    return collapse(F.regexp_replace(c, r"[^a-z0-9\s]+", " "))


def claim_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text(c)), "[^a-z0-9]+", " "))


def title_fingerprint(c: Column) -> Column:
    return F.nullif(collapse(F.regexp_replace(F.lower(text(c)), r"[^\p{L}\p{N}_\s]", " ")), F.lit(""))


def meaningful_tokens(c: Column) -> Column:
    return F.array_except(F.regexp_extract_all(F.lower(text(c)), F.lit("[a-z0-9]{4,}"), F.lit(0)), F.array(*map(F.lit, CLAIM_STOP)))


def topic_tokens(c: Column) -> Column:
    """Words of a title that may become topic keywords."""
    return F.filter(F.split(duplicate_text(c), " "), lambda x: (F.length(x) >= 4) & ~x.isin(*TOPIC_STOP))


def stem(c: Column) -> Column:
    """Remove the first ending that leaves more than three letters."""
    out = F.when(F.lit(False), c)
    for s in SUFFIXES:
        cut = F.left(c, F.length(c) - len(s))
        out = out.when((F.length(c) > len(s) + 3) & c.endswith(s), F.concat(cut, F.lit("y")) if s in ("ies", "ied") else cut)
    return out.otherwise(c)


def keyword_terms(c: Column) -> Column:
    """Distinct stems of the words with at least four letters or digits."""
    words = F.regexp_extract_all(F.replace(F.lower(text(c)), F.lit("ß"), F.lit("ss")), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda x: F.length(x) >= 4), stem))


def related_terms() -> dict[str, list[str]]:
    """Each related word with the others of its first group."""
    out: dict[str, list[str]] = {}
    for group in RELATED:
        for term in group:
            out.setdefault(term, sorted(set(group) - {term}))
    return out


def expanded_terms(c: Column) -> Column:
    """Keyword terms with their related words."""
    table = F.create_map(*[x for k, v in related_terms().items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    more = lambda terms: F.flatten(F.transform(terms, lambda t: F.coalesce(F.try_element_at(table, t), F.array().cast("array<string>"))))
    return let(keyword_terms(c), lambda terms: F.array_distinct(F.concat(terms, more(terms))))


def catalog_tokens(c: Column) -> Column:
    words = F.filter(F.regexp_extract_all(match_text(c), F.lit("[a-z0-9]+"), F.lit(0)), lambda x: (F.length(x) >= 4) & ~x.isin(*CATALOG_STOP))
    return F.array_distinct(F.transform(words, lambda x: F.when(x.endswith("ical") & (F.length(x) > 6), F.concat(F.left(x, F.length(x) - 4), F.lit("ic"))).otherwise(x)))


def author_tokens(c: Column) -> Column:
    words = F.regexp_extract_all(match_text(c), F.lit("[a-z0-9]+"), F.lit(0))
    return F.array_distinct(F.filter(words, lambda x: (F.length(x) >= 2) & ~x.isin("and", "et", "al")))


def overlap(a: Column, b: Column) -> Column:
    """The share of ``a`` that ``b`` has; 0 if either is empty."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.when((F.size(s["a"]) == 0) | (F.size(s["b"]) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(s["a"], s["b"])) / F.greatest(F.size(s["a"]), F.lit(1))))


def jaccard(a: Column, b: Column) -> Column:
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: F.coalesce(F.try_divide(F.size(F.array_intersect(s["a"], s["b"])), F.size(F.array_union(s["a"], s["b"]))), F.lit(0.0)))


def initials(c: Column) -> Column:
    """``JRR`` as ``J. R. R.``"""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit("[A-Za-z]"), F.lit(0)), lambda x: F.concat(F.upper(x), F.lit("."))), " ")


def is_initials(c: Column) -> Column:
    letters = F.regexp_replace(c, "[^A-Za-z]+", "")
    return F.length(letters).between(1, 4) & (F.upper(letters) == letters)


def display_name(c: Column) -> Column:
    """``J.R., Smith K`` as ``Smith, K. J. R.``; other names only normalised."""
    said = normalize_text(text(c))
    left = F.trim(F.substring_index(said, ",", 1))
    right = F.split(F.trim(F.regexp_replace(said, "^[^,]*,", "")), r"\s+")
    # Words from the end while they are initials.
    split = F.aggregate(
        F.reverse(right), F.struct(F.array().cast("array<string>").alias("tail"), F.array().cast("array<string>").alias("head")),
        lambda a, x: F.when((F.size(a["head"]) == 0) & is_initials(x), F.struct(F.concat(F.array(x), a["tail"]).alias("tail"), a["head"].alias("head")))
        .otherwise(F.struct(a["tail"].alias("tail"), F.concat(F.array(x), a["head"]).alias("head"))),
    )
    given = F.trim(F.concat_ws(" ", F.nullif(initials(F.array_join(split["tail"], " ")), F.lit("")), initials(left)))
    swapped = F.concat_ws(", ", F.array_join(split["head"], " "), F.nullif(given, F.lit("")))
    return F.when(said.contains(",") & is_initials(left) & (F.size(split["head"]) > 0) & (F.array_join(split["head"], "") != ""), swapped).otherwise(said)


def escape_html(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def escape_dot(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def escape_cell(c: Column) -> Column:
    """For Markdown tables."""
    return F.trim(F.replace(F.regexp_replace(c, "[\r\n]+", " "), F.lit("|"), F.lit("\\|")))


def file_name(c: Column) -> Column:
    return F.coalesce(F.nullif(strip_chars(F.regexp_replace(text(c), "[^A-Za-z0-9._-]+", "-"), "-"), F.lit("")), F.lit("item"))
