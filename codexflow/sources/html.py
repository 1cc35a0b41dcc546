"""Links and reference texts out of HTML columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codexflow.functions import text as T


def links(html: Column) -> Column:
    """The targets of all ``<a href>`` in order."""
    return F.regexp_extract_all(T.text(html), F.lit(r"(?i)<a\s[^>]*?href=[\"']([^\"']*)[\"']"), F.lit(1))


def absolute(base: Column, link: Column) -> Column:
    """A link as seen from its page, without its fragment."""
    host, folder = F.regexp_extract(base, r"^(https?://[^/?#]+)", 1), F.regexp_extract(base, r"^(https?://[^/?#]+(?:/[^?#]*/|/)?)", 1)
    made = F.when(link.rlike("^https?://"), link).when(link.startswith("//"), F.concat(F.lit("http:"), link)).when(link.startswith("/"), F.concat(host, link)).otherwise(F.concat(F.when(folder.endswith("/"), folder).otherwise(F.concat(folder, F.lit("/"))), link))
    return F.regexp_replace(made, "#.*$", "")


def topic_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """Links below each page's own folder and host, distinct, with the page."""
    rows = pages.select(F.col(url).alias("page"), F.explode(F.array_distinct(links(F.col(html)))).alias("link"))
    rows = rows.select("page", absolute(F.col("page"), F.col("link")).alias("link"))
    host = lambda c: F.regexp_extract(c, "^https?://([^/?#]+)", 1)
    own = (host(F.col("page")) == host(F.col("link"))) & ~F.col("link").rlike(r"(?:biblio|origins\.html)$")
    return rows.filter(own).distinct()


def reference_text(html: Column) -> Column:
    """The text of ``<pre>`` parts, or of the paragraphs of a bibliography."""
    pre = F.regexp_extract_all(T.text(html), F.lit(r"(?is)<pre[^>]*>(.*?)</pre>"), F.lit(1))
    div = F.regexp_extract(T.text(html), r"(?is)<div[^>]*class=[\"'][^\"']*bibliography[^\"']*[\"'][^>]*>(.*?)</div>", 1)
    paragraphs = F.regexp_extract_all(div, F.lit(r"(?is)<p[^>]*>(.*?)(?=<p|</p>|\z)"), F.lit(1))
    parts = F.when(F.size(pre) > 0, pre).otherwise(paragraphs)
    return F.array_join(F.transform(parts, lambda x: F.trim(F.regexp_replace(x, "<[^>]+>", ""))), "\n\n")
