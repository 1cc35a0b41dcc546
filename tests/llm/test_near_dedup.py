"""Near-dedup against brute force over all pairs of sets."""

import random

import numpy as np
from codexflow.llm import near_dedup


def brute(rows, words):
    """Components by comparing all pairs of word-shingle sets."""
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i, (d, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(d)
    return [(d, len(s), min(groups[find(i)])) for i, ((d, _), s) in enumerate(zip(rows, sets))]


def corpus(seed=6):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 5)))
    rows, shared = [], [word() for _ in range(30)]
    for _ in range(12):
        base = [word() for _ in range(rng.randint(8, 150))]
        for _ in range(rng.choice([1, 2, 5, 40])):
            copy = list(base)
            for _ in range(int(len(base) * rng.choice([0, 0.01, 0.02, 0.04, 0.1]))):
                copy[rng.randrange(len(copy))] = word()
            rows.append(" ".join(copy))
    rows += [" ".join(shared + [word() for _ in range(rng.randint(1, 60))]) for _ in range(40)]
    rows += ["", "one", "ONE", "one two", "a b c d", "A  B\nc\td", "é b c d", "É b c d", " "]
    rng.shuffle(rows)
    return [(7 * i + 3, t) for i, t in enumerate(rows)]


def test_components_are_those_of_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).selectExpr("*", "1 as node", "'x' as half")
    for words in (4, 5):
        got = near_dedup.dedup(df, words).collect()
        assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute(rows, words))
        assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = near_dedup.drop_near_copies(df, 5)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {c for _, _, c in brute(rows, 5)}


def test_blocks_and_left_over_buckets_find_the_same(spark):
    rows = corpus(9)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    block, near_dedup.BLOCK = near_dedup.BLOCK, 300
    try:
        described = near_dedup.describe(df, 4)
        for rounds in (1, 2):
            roots = {r.node: r.root for r in near_dedup.near_links(df, described, 4, rounds=rounds).collect()}
            least = {}
            for r in described.collect():
                if r.node is not None:
                    k = roots.get(r.node, r.node)
                    least[k] = min(r.doc_id, least.get(k, r.doc_id))
            got = {r.doc_id: r.doc_id if r.node is None else least[roots.get(r.node, r.node)] for r in described.collect()}
            assert got == {d: c for d, _, c in brute(rows, 4)}
    finally:
        near_dedup.BLOCK = block


def test_edge_rows(spark):
    long = " ".join(f"w{i % 5000}" for i in range(60000))
    rows = [(1, None), (2, ""), (3, "x y z q r"), (None, "x y z q r"), (None, "only here without id"), (3, "x y z q r"), (3, "other text than before"), (8, long), (9, long + " end")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dedup.dedup(df, 4).collect()), key=str)
    assert got == sorted(
        [(1, 0, 1, True), (2, 0, 2, True), (3, 2, 3, True), (None, 2, 3, False), (None, 1, None, False), (3, 2, 3, True), (3, 1, 3, True), (8, 5000, 8, True), (9, 5001, 8, False)],
        key=str,
    )
    assert near_dedup.dedup(df.limit(0), 4).count() == 0


def test_half_keys_agree_with_the_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1000, dtype=np.uint64)
    y = np.concatenate([x[:900], rng.integers(0, 2**63, 100, dtype=np.uint64)])
    same = (near_dedup.half_keys(x, 400, 2) == near_dedup.half_keys(y, 400, 2)).mean()
    assert abs(same - (900 / 1100) ** 2) < 0.06


def test_one_row_of_each_component_is_left(spark):
    near = " ".join(f"w{i}" for i in range(60))
    rows = [(1, "p q r s t u"), (1, "other text of the same id"), (1, "p q r s t u"), (2, near), (2, near + " end"), (4, near), (5, None), (5, ""), (None, near), (None, "alone without an id"), (None, "Alone without an id")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "2 as rows", "3 as root")
    got = near_dedup.drop_near_copies(df, 5)
    left = sorted(((r.doc_id, (r.text or "").lower()) for r in got.collect()), key=str)
    two = [x for x in left if x[0] == 2]
    assert got.columns == df.columns and len(two) == 1 and two[0][1] in (near, near + " end")
    assert [x for x in left if x[0] != 2] == sorted([(1, "p q r s t u"), (1, "other text of the same id"), (5, ""), (5, ""), (None, "alone without an id")], key=str)


def test_components_of_long_paths_and_stars(spark):
    rng = random.Random(3)
    names = rng.sample(range(-(10**6), 10**6), 900)
    links = [(names[i], names[i + 1]) for i in range(300)] + [(names[400], names[i]) for i in range(401, 800)] + [(names[700], names[850]), (names[850], names[850])]
    root = {n: n for n in names}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    df = spark.createDataFrame(links, "a long, b long")
    got = {r.node: r.root for r in near_dedup.components(df).collect()}
    assert got == {n: find(n) for n in {n for a, b in links if a != b for n in (a, b)}}
    assert near_dedup.components(df.limit(0)).count() == 0


def test_links_of_a_block_are_fewer_than_its_components(spark):
    base = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join(base[:k] + [f"x{k}"] + base[k + 1 :])) for k in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    described = near_dedup.describe(docs, 4)
    nodes = described.select("node")
    texts = near_dedup.packed_texts(docs, described, nodes)
    groups = nodes.selectExpr("1L as grp", "node")
    none = spark.createDataFrame([], "node long, root long")
    found = near_dedup._group_links(groups, none, texts, 4)
    links = found.collect()
    assert 0 < len(links) < 30
    assert {r.root for r in near_dedup.components(found).collect()} == {min(r.node for r in nodes.collect())}
    # Members meet their group's sizes in one join, which is written, not once for each branch.
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert not [line for line in plan.splitlines() if "Join" in line and "grp" in line]
