"""Decontamination against brute-force edit distances."""

import random

from codexflow.llm import decontaminate as dc


def least_edits(pattern, text):
    """Least edits of the pattern anywhere in the text, by the full table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(pattern, 1):
        last, row = row, [i]
        for j, d in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (c != d)))
    return min(row)


def edited(rng, text, n):
    x = list(text)
    for _ in range(n):
        i = rng.randrange(len(x))
        rng.choice([lambda: x.pop(i), lambda: x.insert(i, "q"), lambda: x.__setitem__(i, "Z")])()
    return "".join(x)


def made(rng, n):
    return " ".join("".join(rng.choice("abdeinorst") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_windows_within_the_budget_are_found_and_no_others():
    rng = random.Random(11)
    items = [(i, made(rng, rng.choice([6, 12, 20]))) for i in range(8)]
    index = dc.Index(items)
    for _ in range(60):
        item_id, text = rng.choice(items)
        doc = made(rng, 15) + " " + edited(rng, text, rng.randint(0, len(text) // 6)).upper() + "\n" + made(rng, 15)
        found = {(w.item_id, w.at): (e, a, b) for w, e, a, b in index.find(doc)}
        x = "".join(map(chr, dc.codes(doc)))
        for w in index.windows:
            pattern = "".join(map(chr, w.codes))
            least = least_edits(pattern, x)
            assert (least <= w.k) == ((w.item_id, w.at) in found), (least, w.k, pattern)
            if least <= w.k:
                e, a, b = found[w.item_id, w.at]
                assert e == least == least_edits(pattern, x[a:b])


def test_short_quotes_are_found_wherever_they_begin(spark):
    rng = random.Random(5)
    items = [(i, made(rng, rng.choice([12, 40, 60]))) for i in range(6)]
    index = dc.Index(items)
    for item_id, text in items:
        for a in range(0, len(text) - 64 + 1, 7):
            quote = text[a : a + 64]
            found = index.find(made(rng, 10) + " " + quote + " " + made(rng, 10))
            assert {w.item_id for w, *_ in found} == {item_id} and min(e for _, e, *_ in found) == 0, (len(text), a)
    docs = [(i, made(rng, 30) + " " + text[len(text) // 2 - 40 : len(text) // 2 + 40] + " " + made(rng, 30)) for i, text in items if len(text) > 200] + [(99, made(rng, 80))]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert [r.doc_id for r in dc.drop_contaminated(d, b).collect()] == [99] and len(docs) > 1


def test_table(spark):
    rng = random.Random(3)
    items = [(1, made(rng, 30)), (1, made(rng, 30)), (2, None), (3, "short"), (None, made(rng, 20)), (5, "")]
    clean = made(rng, 400)
    rows = [(1, None), (2, ""), (3, clean), (4, clean + items[0][1] + clean), (4, items[1][1]), (None, items[4][1]), (6, items[0][1].upper().replace(" ", "\n")), (7, clean * 40 + items[1][1][:150])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as item_id", "'x' as start")
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "9 as doc_id")
    got = {(r.doc_id, r.item_id): r for r in dc.contaminated(docs, bench).collect()}
    assert set(got) == {(4, 1), (None, None), (6, 1), (7, 1)}
    assert got[6, 1].edits == 0 and (got[6, 1].start, got[6, 1].end) == (0, len(items[0][1]))
    kept = dc.drop_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [1, 2, 3]
    assert dc.contaminated(docs.limit(0), bench).count() == 0 and dc.contaminated(docs, bench.limit(0)).count() == 0
    assert dc.drop_contaminated(docs, bench.limit(0)).count() == len(rows)


def test_blocks_of_items(spark):
    rng = random.Random(7)
    items = [(i, made(rng, 12)) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    size, dc.BLOCK_ITEMS = dc.BLOCK_ITEMS, 4
    try:
        assert {(r.doc_id, r.item_id) for r in dc.contaminated(spark.createDataFrame(items, "doc_id long, text string"), bench).collect()} == {(i, i) for i in range(9)}
    finally:
        dc.BLOCK_ITEMS = size


def test_repetitive_texts_are_searched_in_stretches():
    rng = random.Random(3)
    items = [(1, "a" * 119), (2, made(rng, 30)), (3, "ab " * 60)]
    index = dc.Index(items)
    hits, dc.HITS = dc.HITS, 20_000
    try:
        found = index.find("x y " + "a" * 30_000 + " " + items[1][1] + " " + "ab " * 5_000)
        assert {f[0].item_id for f in found} == {1, 2, 3} and all(f[1] == 0 for f in found)
        doc = made(rng, 400) + edited(rng, items[1][1][:120], 6) + made(rng, 400)
        few = {(f[0].item_id, f[0].at, len(f[0].codes)): f[1:] for f in index.find(doc)}
        dc.HITS = 10
        assert {(f[0].item_id, f[0].at, len(f[0].codes)): f[1:] for f in index.find(doc)} == few
    finally:
        dc.HITS = hits


def test_banded_alignment_is_that_of_the_full_table():
    rng = random.Random(12)
    for _ in range(400):
        pattern = "".join(rng.choice("abc") for _ in range(rng.randint(1, 14)))
        text = "".join(rng.choice("abc") for _ in range(rng.randint(0, 24)))
        k = rng.randint(0, 4)
        least, got = least_edits(pattern, text), dc.align(dc.codes(pattern), dc.codes(text), k)
        assert (got is not None) == (least <= k), (pattern, text, k, least, got)
        if got:
            assert got[0] == least and least_edits(pattern, text[got[1] : got[2]]) == least


def test_several_blocks_give_what_one_gives(spark):
    rng = random.Random(7)
    items = [(i, made(rng, 20)) for i in range(12)] + [(None, made(rng, 20))]
    docs = [(i, made(rng, 30) + (" " + items[i][1] if i < 13 else "") + " end") for i in range(20)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    whole = sorted(map(tuple, dc.contaminated(d, b).collect()), key=str)
    many, dc.BLOCK_ITEMS = dc.BLOCK_ITEMS, 4
    try:
        assert sorted(map(tuple, dc.contaminated(d, b).collect()), key=str) == whole
        assert {r.doc_id for r in dc.drop_contaminated(d, b).collect()} == set(range(13, 20))
        assert dc.contaminated(d, b.limit(0)).count() == 0 and dc.drop_contaminated(d, b.limit(0)).count() == 20
    finally:
        dc.BLOCK_ITEMS = many


def test_items_under_the_least_length_are_found_as_they_are_and_as_whole_words(spark):
    rng = random.Random(3)
    items = ["what is 2+2?", "aaaaaaaa", "Name the  capital", "is the sky blue", "seven b"]
    index = dc.Index(list(enumerate(items)))
    for _ in range(200):
        words = [rng.choice([i, i.upper(), "x" + i, i + "x", i[:-1], i.replace("e", "q", 1), "aaaaaaaaa", "word"]) for i in (rng.choice(items) for _ in range(5))]
        x = "".join(map(chr, dc.codes(" ".join(words))))
        wanted = set()
        for n, item in enumerate(items):
            p = "".join(map(chr, dc.codes(item)))
            places = [a for a in range(len(x)) if x.startswith(p, a)]
            alone = [a for a in places if not any(0 < c < len(x) and x[c - 1].isalnum() and x[c].isalnum() for c in (a, a + len(p)))]
            if alone and len(p) >= dc.Q:
                wanted.add(n)
        assert {w.item_id for w, *_ in index.find(x)} == wanted, x
    docs = spark.createDataFrame([(1, "So, what is 2+2? Four."), (2, "what is 2+2x"), (3, None)], "doc_id long, text string")
    some = spark.createDataFrame([(1, items[0])], "item_id long, text string")
    assert sorted(r.doc_id for r in dc.drop_contaminated(docs, some).collect()) == [2, 3]
