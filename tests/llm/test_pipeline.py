"""The pipeline's stages on small rows, each against what it must keep."""

import random

import corpus_pipeline
from codexflow.llm import common


def test_stages(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n)).capitalize() + "."
    items = [(i, prose(25)) for i in range(3)]
    good = [(i, prose(120)) for i in range(60)]
    junk = [(100 + i, " | ".join(word() for _ in range(120)) if i % 2 else prose(60).upper().replace(" ", "!! ")) for i in range(20)]
    copies = [(200 + i, good[i][1] + " Tail.") for i in range(5)]
    leaks = [(300 + i, prose(60) + " " + items[i][1] + " " + prose(60)) for i in range(3)]
    secret = [(400, prose(80) + " password: hunter2secret " + prose(80))]
    rows = [(d, t, "en", "s", len(t)) for d, t in good + junk + copies + leaks + secret]
    sf = common.scratch_path(spark, "tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(d, int(d < 100)) for d, _ in good + junk], "doc_id long, quality int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    docs = common.read(spark, sf, "documents")
    left, columns = {}, docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = common.write_table(stage(spark, docs, sf), name)
        left[name] = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "secrets":
            assert "hunter2" not in docs.filter("doc_id = 400").first().text
        assert name == "packing" or docs.columns == columns
    clean = {d for d, _ in good + leaks + secret} | {200 + i for i in range(5)}
    assert left["quality"] == clean
    assert left["near_dedup"] == clean - {200 + i for i in range(5)}
    assert left["decontaminate"] == left["secrets"] == left["packing"] == {d for d, _ in good + secret}
    assert corpus_pipeline.run(spark, sf).count() == docs.count()
