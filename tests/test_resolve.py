"""Verification and title matching against brute force, and the rows that their joins make."""

import random

import pytest
from codexflow.operators import resolve, workflows

ROW = "citation_key string, title string, author string, year string, doi string"


def joined_rows(spark, run):
    """The most rows that one join made while ``run`` ran."""
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    most = 0
    for k in range(before, store.executionsCount()):
        made, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for i in range(nodes.size()):
            node = nodes.apply(i)
            for j in range(node.metrics().size()) if "Join" in node.name() else ():
                m = node.metrics().apply(j)
                if m.name() == "number of output rows" and made.contains(m.accumulatorId()):
                    most = max(most, int(made.apply(m.accumulatorId()).replace(",", "")))
    return most


def some_rows(n, seed):
    pick = random.Random(seed)
    words, years = [f"w{i}" for i in range(14)], ["", "1999", "2000", "2001", " 2001", "x"]
    made = []
    for i in range(n):
        title = f"Referenced work {i}" if i % 7 == 0 else " ".join(pick.choices(words, [1 / (k + 1) for k in range(14)], k=pick.randint(0, 9)))
        made.append((f"k{i}", title, pick.choice(["Lee, A", "Bo, C and Lee, A", "", "Wu"]), pick.choice(years) or None, pick.choice([None, "10.1/a", "10.1/b"])))
    return made


def tokens(title):
    return set(title.lower().split())


def best_by_brute_force(asked, rows, keep=4):
    surname = lambda a: a.split(" and ")[0].split(",")[0].lower()
    out = []
    for i, (_, qt, qa, qy, _) in enumerate(asked):
        qw, qy, found = tokens(qt), (qy or "").strip(), {}
        for key, ct, ca, cy, doi in rows:
            share = len(qw & tokens(ct)) / max(len(qw), 1)
            if share < 0.5:
                continue
            y = (cy or "").strip()
            near = qy.isdigit() and y.isdigit() and abs(int(qy) - int(y)) == 1
            s = (0.55 if share >= 0.9 else 0.4 if share >= 0.7 else 0.2) + (0.25 if qa and surname(qa) == surname(ca) else 0)
            s += 0 if not qy or not y else 0.15 if qy == y else 0.07 if near else 0
            same = ((doi or ""), " ".join(ct.lower().split()), cy or "")
            found[same] = min(found.get(same, ("~",)), (key, round(s, 4), cy or ""))
        ranked = sorted(found.values(), key=lambda x: (-x[1], x[2], x[0]))[:keep]
        out += [(i, r + 1, k, s) for r, (k, s, _) in enumerate(ranked)] or [(i, 1, None, None)]
    return out


@pytest.mark.parametrize("rare, many, small", [(2, 12, 1), (2, 2, 1), (64, 12, 16), (20, 5, 4)])
def test_verification_equals_brute_force(spark, monkeypatch, rare, many, small):
    for name, value in (("RARE", rare), ("MANY", many), ("SMALL", small)):
        monkeypatch.setattr(resolve, name, value)
    asked, rows = some_rows(60, 1), some_rows(220, 2)
    q = spark.createDataFrame([(i, *r[1:4]) for i, r in enumerate(asked)], "query_id int, title string, author string, year string")
    got = [(r.query_id, r["rank"], r.citation_key, r.score) for r in resolve.verify(q, spark.createDataFrame(rows, ROW)).collect()]
    assert sorted(got, key=lambda r: r[:2]) == best_by_brute_force(asked, rows)


def stubs(spark, n):
    return spark.range(n).selectExpr("id as query_id", "concat('k', id) as citation_key", "concat('Referenced work ', id + 1000) as title", "concat('N', id % 9, ', A') as author", "cast(1960 + id % 60 as string) as year", "cast(null as string) as doi", "'misc' as entry_type")


def test_titles_of_frequent_words_make_no_pairs(spark):
    c = stubs(spark, 2000)
    q = c.select("query_id", "title", "author", "year")
    found = []
    # Each stub shares two of three words with all others.
    assert joined_rows(spark, lambda: found.extend(resolve.verify(q, c).collect())) < 100_000
    assert len(found) == 8000
    assert [(r.citation_key, r.score) for r in sorted(found, key=lambda r: (r.query_id, r["rank"]))[:4]] == [("k0", 0.95), ("k1080", 0.6), ("k1260", 0.6), ("k1440", 0.6)]


def test_bibtex_of_frequent_titles_makes_no_pairs(spark):
    c, found = stubs(spark, 1500), []
    q = c.select("query_id", "title", "author", "year")
    assert joined_rows(spark, lambda: found.extend(workflows.verification_bibtex(resolve.verify(q, c), c.drop("query_id")).collect())) < 75_000
    assert len(found) == 1500


def test_similar_titles_make_no_pairs(spark):
    c, found = stubs(spark, 2000), []
    q = c.selectExpr("query_id", "title", "'1900' as year").unionByName(c.select("query_id", "title", "year").limit(5))
    # No year fits, so every title is compared with those that it may be like.
    assert joined_rows(spark, lambda: found.extend(resolve.catalog_matches(q, c).collect())) < 20_000
    assert len(found) == 5


def test_title_matches_equal_brute_force(spark):
    pick = random.Random(5)
    words, years = [f"word{i}" for i in range(9)], ["", "1999", "2000"]
    made = lambda n: [(i, " ".join(pick.choices(words, k=pick.randint(0, 8))) if i % 9 else " ".join(f"long{k}" for k in range(pick.randint(20, 40))), pick.choice(years)) for i in range(n)]
    asked, rows = made(80), made(120)
    expected = []
    for i, t, y in asked:
        a = set(t.split())
        fit = [(-round(len(a & b) / len(a | b), 6), f"k{k}") for k, ct, cy in rows for b in [set(ct.split())] if a and b and (not y or not cy or y == cy)]
        if (best := min(fit, default=(0,)))[0] <= -0.6:
            expected.append((i, best[1], -best[0]))
    c = spark.createDataFrame([(f"k{k}", t, y) for k, t, y in rows], "citation_key string, title string, year string")
    got = resolve.catalog_matches(spark.createDataFrame(asked, "query_id int, title string, year string"), c)
    assert sorted(map(tuple, got.collect())) == expected
    assert {s for *_, s in expected} > {1.0}
