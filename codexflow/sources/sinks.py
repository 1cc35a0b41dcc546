"""Exports: rendered pages, graph profiles and bundles as tables of paths and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codexflow.functions import text as T
from codexflow.sources import bibtex


def export_bibtex(entries: DataFrame, is_stub, with_stubs: bool = False) -> DataFrame:
    """``citation_key`` and ``bibtex`` of the entries ``(entry_type, citation_key, fields)``; stubs only on demand."""
    rows = entries if with_stubs else entries.filter(~is_stub)
    return rows.select("citation_key", bibtex.render(F.col("entry_type"), F.col("citation_key"), F.col("fields")).alias("bibtex"))


def work_pages(entries: DataFrame) -> DataFrame:
    """A Markdown page with front matter for each work: ``path`` and ``content``."""
    row = lambda name, c: F.concat(F.lit(f"| {name} | "), T.escape_cell(T.text(c)), F.lit(" |"))
    front = F.concat(F.lit('---\ntype: work\nid: "'), "citation_key", F.lit('"\ntitle: "'), F.replace(T.text("title"), F.lit('"'), F.lit('\\"')), F.lit('"\n---\n\n# '), T.text("title"), F.lit("\n\n| field | value |\n| --- | --- |\n"))
    body = F.concat_ws("\n", row("author", "author"), row("year", "year"), row("doi", "doi"))
    return entries.select(F.concat(F.lit("works/"), T.file_name(F.col("citation_key")), F.lit(".md")).alias("path"), F.concat(front, body, F.lit("\n")).alias("content"))


def topic_pages(entries: DataFrame, topics: DataFrame) -> DataFrame:
    """A page for each topic: how many works, and which years; the list is its own table."""
    sums = entries.groupBy("topic").agg(F.count("*").alias("n"), F.min("year").alias("first"), F.max("year").alias("last"))
    rows = topics.join(sums, topics.slug == sums.topic, "left")
    text = F.concat(F.lit("# "), "name", F.lit("\n\n"), F.coalesce("n", F.lit(0)).cast("string"), F.lit(" works, "), T.text("first"), F.lit(" to "), T.text("last"), F.lit("\n"))
    return rows.select(F.concat(F.lit("topics/"), "slug", F.lit(".md")).alias("path"), text.alias("content"))


def graph_profile(entries: DataFrame, relations: DataFrame, entry_topics: DataFrame) -> DataFrame:
    """Nodes and edges of citations and topics as JSON lines, each with its kind."""
    nodes = entries.select(F.lit("node").alias("kind"), F.to_json(F.struct(F.col("citation_key").alias("id"), T.text("title").alias("label"), "entry_type")).alias("json"))
    cites = relations.select(F.lit("edge").alias("kind"), F.to_json(F.struct("source", "target", "relation")).alias("json"))
    member = entry_topics.select(F.lit("edge").alias("kind"), F.to_json(F.struct(F.col("citation_key").alias("source"), F.col("slug").alias("target"), F.lit("has_topic").alias("relation"))).alias("json"))
    return nodes.unionByName(cites).unionByName(member)


def write_pages(pages: DataFrame, path: str) -> None:
    """Pages as JSON lines ``(path, content)``: any number of them, written by all tasks."""
    pages.write.mode("overwrite").json(path)
