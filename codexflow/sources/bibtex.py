"""BibTeX: reader and writer.

Files are read whole, one entry list each, so a file is the unit of work; text
columns with BibTeX in them are parsed where they lie.
"""

from __future__ import annotations

import re
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as S

from codexflow.functions import text as T

ENTRY = S.StructType([S.StructField("entry_type", S.StringType()), S.StructField("citation_key", S.StringType()), S.StructField("fields", S.MapType(S.StringType(), S.StringType()))])
#: The order of well-known fields in rendered entries; others follow by name.
FIELD_ORDER = ["author", "editor", "title", "year", "journal", "booktitle", "publisher", "volume", "number", "pages", "doi", "url", "isbn", "abstract", "keywords"]
_ESCAPES = re.compile(r"\\([_&%$#])")
_OPEN = re.compile(r"@\s*([A-Za-z]+)\s*([{(])")


def _value(text: str, at: int, macros: dict[str, str]) -> tuple[str, int]:
    """A field's value: braced, quoted, number or macro, joined by ``#``."""
    parts = []
    while True:
        while at < len(text) and text[at].isspace():
            at += 1
        if at >= len(text):
            break
        if text[at] in '{"':
            quoted, depth, start = text[at] == '"', 0, at + 1
            at += 1
            while at < len(text) and not (depth == 0 and text[at] == ('"' if quoted else "}")):
                depth += {"{": 1, "}": -1}.get(text[at], 0)
                at += 1 + (text[at] == "\\")
            parts.append(text[start:at])
            at += 1
        else:
            m = re.compile(r"[^\s,#})]*").match(text, at)
            parts.append(macros.get(m[0].lower(), m[0]))
            at = m.end()
        m = re.compile(r"\s*#").match(text, at)
        if not m:
            break
        at = m.end()
    return " ".join("".join(parts).split()), at


def parse(text: str | None) -> list[dict]:
    """All entries of a text in order; comments, preambles and macros are handled, broken entries end at the next ``@``."""
    out, macros, at, text = [], {}, 0, text or ""
    while m := _OPEN.search(text, at):
        kind, at = m[1].lower(), m.end()
        if kind in ("comment", "preamble"):
            continue
        key = ""
        if kind != "string":
            k = re.compile(r"\s*([^\s,{}()]*)\s*,?").match(text, at)
            key, at = k[1], k.end()
        fields: dict[str, str] = {}
        while f := re.compile(r"\s*,?\s*([A-Za-z][\w:.+-]*)\s*=\s*").match(text, at):
            said, at = _value(text, f.end(), macros)
            fields.setdefault(f[1].lower(), _ESCAPES.sub(r"\1", said))
        if kind == "string":
            macros |= fields
        elif key:
            for people in ("author", "editor"):
                if people in fields:
                    fields[people] = " and ".join(p.strip() for p in re.split(r"\s+and\s+", fields[people]))
            out.append({"entry_type": kind, "citation_key": key, "fields": {k: v for k, v in fields.items() if v}})
    return out


@F.pandas_udf(S.ArrayType(ENTRY))
def parse_column(texts: pd.Series) -> pd.Series:
    return texts.map(parse)


def parse_entries(texts: DataFrame, text: str = "text") -> DataFrame:
    """The entries in a text column, with their position; other columns stay."""
    rows = texts.select("*", F.posexplode(parse_column(text)).alias("position", "_e"))
    return rows.select(*[c for c in texts.columns if c != text], "position", "_e.*")


def read_bibtex(spark: SparkSession, path: str) -> DataFrame:
    """Entries of all files at a path, with the file that each is from."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("text"), F.col("_metadata.file_path").alias("seed_bib"))
    return parse_entries(files)


def balanced(c: Column) -> Column:
    """A value whose braces match; else without braces."""
    marks = F.regexp_extract_all(c, F.lit(r"\\.|[{}]"), F.lit(0))
    depth = F.aggregate(marks, F.lit(0), lambda a, m: F.when(a < 0, a).when(m == "{", a + 1).when(m == "}", a - 1).otherwise(a))
    return F.when(depth == 0, c).otherwise(F.regexp_replace(c, "[{}]", ""))


def render(entry_type: Column, key: Column, fields: Column) -> Column:
    """An entry as BibTeX: known fields in their order, others by name."""
    known = F.array(*[F.struct(F.lit(i).alias("o"), F.lit(k).alias("k"), F.try_element_at(fields, F.lit(k)).alias("v")) for i, k in enumerate(FIELD_ORDER)])
    others = F.transform(F.filter(F.map_entries(fields), lambda e: ~e["key"].isin(*FIELD_ORDER)), lambda e: F.struct(F.lit(len(FIELD_ORDER)).alias("o"), e["key"].alias("k"), e["value"].alias("v")))
    kept = F.array_sort(F.filter(F.concat(known, others), lambda x: F.trim(T.text(x["v"])) != ""))
    escaped = lambda v: F.regexp_replace(balanced(v), r"(?<!\\)([_&%$#])", r"\\$1")
    lines = F.transform(kept, lambda x: F.concat(F.lit("  "), x["k"], F.lit(" = {"), escaped(x["v"]), F.lit("}")))
    return F.concat(F.lit("@"), entry_type, F.lit("{"), key, F.lit(",\n"), F.array_join(lines, ",\n"), F.lit("\n}"))


def write_bibtex(entries: DataFrame, path: str) -> None:
    """Entries ``(entry_type, citation_key, fields)`` as text files, in order of key within each."""
    rows = entries.select(F.concat(render(F.col("entry_type"), F.col("citation_key"), F.col("fields")), F.lit("\n")).alias("value"), "citation_key")
    rows.repartitionByRange("citation_key").sortWithinPartitions("citation_key").select("value").write.mode("overwrite").text(path)
