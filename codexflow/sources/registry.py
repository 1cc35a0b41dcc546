"""The sources by name, and the catalogue of services."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.sources import payloads

_SOURCES: dict[str, Callable[..., DataFrame]] = {
    "crossref": payloads.crossref, "crossref_plain": payloads.crossref_plain, "dblp": payloads.dblp, "openalex": payloads.openalex, "datacite": payloads.datacite, "europepmc": payloads.europepmc, "semanticscholar": payloads.semantic_scholar,
    "openlibrary": payloads.open_library, "opencitations": payloads.open_citations, "unpaywall": payloads.unpaywall, "arxiv": payloads.arxiv, "pubmed": payloads.pubmed,
}

#: Services by label with their state and what they offer.
SERVICES = [
    ("Crossref", "now", ["lookup", "search", "references"]), ("DataCite", "now", ["lookup", "search"]), ("OpenAlex", "now", ["lookup", "search", "citations"]),
    ("PubMed", "now", ["lookup", "search"]), ("arXiv", "now", ["lookup"]), ("DBLP", "now", ["lookup", "search"]), ("Europe PMC", "next", ["lookup", "search", "fulltext"]),
    ("Semantic Scholar", "next", ["lookup", "search"]), ("Unpaywall", "next", ["open access"]), ("OpenCitations", "next", ["citations"]), ("Open Library", "selective", ["search"]),
    ("OAI-PMH", "selective", ["harvest"]), ("CORE", "evaluate", ["fulltext"]),
]


def register(name: str, source: Callable[..., DataFrame]) -> None:
    _SOURCES[name] = source


def get(name: str) -> Callable[..., DataFrame]:
    return _SOURCES[name]


def names() -> list[str]:
    return sorted(_SOURCES)


def catalog(spark: SparkSession) -> DataFrame:
    """All services by priority, then label."""
    rank = F.create_map(*[F.lit(x) for i, s in enumerate(("now", "next", "selective", "evaluate")) for x in (s, i)])
    return spark.createDataFrame(SERVICES, "label string, state string, capabilities array<string>").withColumn("rank", rank[F.col("state")]).orderBy("rank", F.lower("label"))
