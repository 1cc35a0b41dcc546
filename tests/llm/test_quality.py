"""The quality classifier: held-out accuracy, and edge rows."""

import random
import zlib

import numpy as np
from codexflow.llm import quality


def made(n, seed=4):
    rng = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(20, 120))]
        good = rng.random() < 0.7
        text = " ".join(words) + "." if good else rng.choice([" | ".join(words), "!! ".join(words).upper(), " ".join(w for w in words for _ in range(9)), "%%% ".join(words)])
        docs.append((i, text))
        labels.append((i, int(good)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = made(400)
    docs += [(500, None), (501, ""), (None, "a b c"), (1, "twice here now."), (502, "x" * 300000)]
    labels += [(None, 1), (3, None), (1, 1)]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as quality", "2 as score")
    y = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "'no' as text")
    got = quality.classify(d, y).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    truth = dict(labels[:400])
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in got if r.doc_id is not None)
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.97 * len(held) > 50
    kept = quality.keep_quality(d, y)
    assert kept.columns == d.columns and kept.count() == sum(r.predicted for r in got)
    none = quality.classify(d, y.limit(0)).collect()
    assert {r.score for r in none} == {0.5}
    assert quality.classify(d.limit(0), y).count() == 0


def test_the_whole_text_is_compressed():
    rng = random.Random(9)
    clean = " ".join("".join(rng.choice("abcdeilnorst") for _ in range(rng.randint(2, 9))) for _ in range(4000))
    junk = "buy now " * (len(clean) // 8)
    at = quality.FEATURES.index("packed")
    value = lambda text: quality.features(text)[at]
    assert value(junk) < 0.1 < 0.4 < value(clean)
    for mixed in (clean + junk, junk + clean):
        assert abs(value(mixed) - (value(clean) + value(junk)) / 2) < 0.02
    assert value(clean[:9000]) == len(zlib.compress(clean[:9000].encode(), 1)) / 9000


def test_sample_is_bounded(spark):
    y = spark.range(1000).selectExpr("id as doc_id", "cast(id % 2 as int) as quality")
    assert quality.learned_rows(y, 100).count() == 100


def test_all_labelled_rows_are_fitted_in_blocks(spark):
    docs, labels = made(600)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    assert quality.learned_rows(spark.range(60_001).selectExpr("id as doc_id", "1 as quality")).count() == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(60_001)) > 20_000
    rows = quality.described(d)
    whole, blocks = quality.train(rows, y), quality.train(rows, y, block_rows=90)
    assert abs(whole.mean - blocks.mean).max() < 1e-12 and abs(whole.scale - blocks.scale).max() < 1e-12
    truth = dict(labels)
    got = quality.classify(d, y, block_rows=90).collect()
    assert len(got) == 600
    assert sum(r.predicted == truth[r.doc_id] for r in got if r.held_out) >= 0.97 * sum(r.held_out for r in got)


def test_order_statistics_and_pairs(spark):
    values = [float((i * 7919) % 1000) / 3 for i in range(3000)]
    v = spark.createDataFrame([(x,) for x in values], "v double")
    assert quality._order_statistics(v, [1199, 1200, 1201], most=5, bins=8) == {k: sorted(values)[k] for k in (1199, 1200, 1201)}
    z = np.arange(10.0)[:, None]
    diff = quality._differences(z, z[:, 0] != 4, 3)
    assert {float(x) for x in diff[:, 0] + 4} == {0.0, 1.0, 2.0, 3.0, 5.0, 6.0, 7.0, 8.0, 9.0}
