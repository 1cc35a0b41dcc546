"""The text of a group's member is joined once, however many blocks it goes to."""

from codexflow.llm import near_dedup
from test_resolve import joined_rows


def test_texts_are_joined_once_a_member(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BLOCK", 400)
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    described = near_dedup.describe(docs, 4)
    texts = near_dedup.packed_texts(docs, described, described.select("node"))
    none, found = spark.createDataFrame([], "node long, root long"), []
    groups = described.selectExpr("1L as grp", "node")
    assert joined_rows(spark, lambda: found.extend(near_dedup._group_links(groups, none, texts, 4).collect())) == 30
    assert found
