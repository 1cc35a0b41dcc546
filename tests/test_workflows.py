"""Composed operators on small rows."""

import os

import pytest
from codexflow.operators import workflows
from codexflow.plans import catalog, corpus
from codexflow.sources import bibtex
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"
ENTRY = "citation_key string, entry_type string, title string, author string, year string, doi string"


def test_verification_output(spark):
    e = spark.createDataFrame([("a", "article", "On graphs", "Lee, A and Bo, C", "2001", "10.1/a"), ("b", "book", "On trees", "Roe, K", "2002", None)], ENTRY)
    v = spark.createDataFrame([(1, 1, "a", 0.95, "exact"), (1, 2, "b", 0.5, "ambiguous"), (2, 1, None, None, "not_found")], "query_id int, rank int, citation_key string, score double, status string")
    got = {r.query_id: bibtex.parse(r.bibtex)[0] for r in workflows.verification_bibtex(v, e).collect()}
    assert got[1]["citation_key"] == "a" and got[1]["fields"]["x_status"] == "exact" and got[1]["fields"]["x_match_score"] == "0.95"
    assert got[1]["fields"]["x_alternates"] == "|On trees|Roe, K|2002|0.50"
    assert got[2]["citation_key"] == "verification2" and got[2]["entry_type"] == "misc" and got[2]["fields"]["x_status"] == "not_found"


def test_support_gaps_leave_out_what_is_cited(spark):
    e = spark.createDataFrame([("a", "Learning agents", "10.1/A"), ("b", "Learning agents", None), ("c", "Complex agents", "10.2/c"), ("d", "Other things", None)], "citation_key string, title string, doi string")
    c = spark.createDataFrame([(1, "Learning and complex agents matter.")], "claim_id int, claim string")
    none = e.limit(0).select("title", "doi")
    got = [(r["rank"], r.citation_key, r.score, r.label) for r in workflows.support_gaps(c, e, none).orderBy("rank").collect()]
    assert got == [(1, "a", 1.0, "candidate_support"), (2, "c", 1.0, "candidate_support")]
    cited = spark.createDataFrame([("LEARNING: agents", None), ("x", "10.2/C ")], "title string, doi string")
    assert workflows.support_gaps(c, e, cited).count() == 0


def test_batches_and_snapshots(spark, tmp_path):
    e = spark.createDataFrame([("a", "article", "Graph search", "", "2001", None), ("b", "book", "Trees", "", "2002", None)], ENTRY).withColumn("abstract", F.lit(None).cast("string"))
    rel = spark.createDataFrame([("a", "b", "cites")], "source string, target string, relation string")
    cand = spark.createDataFrame([("n", "New graph", None, "crossref"), ("o", "Else", "graph", "openalex")], "citation_key string, title string, abstract string, source string")
    jobs = [{"name": "one", "topic": "graph"}, {"name": "two", "topic": "graph", "expand": False}]
    got = sorted(map(tuple, workflows.bootstrap_batch(jobs, e, rel, lambda j: e.filter("citation_key = 'a'"), cand).collect()))
    assert got == [("one", "a", "seed"), ("one", "b", "expansion"), ("one", "n", "topic"), ("two", "a", "seed"), ("two", "n", "topic")]
    workflows.snapshot({"entries": e}, str(tmp_path / "s"))
    assert workflows.restore(spark, str(tmp_path / "s"), ["entries"])["entries"].count() == 2


@pytest.mark.skipif(not os.path.isdir(DATA), reason="needs the test tables")
def test_whole_tables_are_verified_and_searched(spark):
    e = catalog.QUERIES["verification_bibtex"](spark, DATA)
    assert e.select("query_id").distinct().count() == corpus.entries(spark, DATA).count()
    gaps = catalog.QUERIES["support_gaps"](spark, DATA)
    assert gaps.filter("claim_id % 1000 > 0").count() > 0
