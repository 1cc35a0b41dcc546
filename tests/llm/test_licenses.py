"""License scans: known notices, inheritance and edge rows; cosines by hand."""

import math
from collections import Counter

from codexflow.llm import licenses


def cosine(text, name):
    rows, idf, unseen = licenses.template_weights(licenses.TEMPLATES)
    counts = Counter(licenses.terms_of(text))
    norm = math.sqrt(sum((n * idf.get(t, unseen)) ** 2 for t, n in counts.items()))
    return sum(counts[t] * idf.get(t, unseen) * w for k, t, w in rows if k == name) / norm


def test_files_notices_and_directories(spark):
    mit, gpl, cc = (licenses.TEMPLATES[k] for k in ("MIT", "GPL-3.0", "CC-BY-NC-4.0"))
    rows = [
        (1, "a/LICENSE", mit), (2, "a/b/c/x.py", "print(1)\n" * 500), (3, "a/b/COPYING", gpl), (4, "a/y.py", "# " + cc + "\ncode"), (5, "z/y.py", "code"),
        (6, "a/b/w.py", None), (7, None, mit), (8, None, ""), (9, "top.py", "x"), (10, "ab/x.py", "x"), (11, "a/LICENSE", mit), (12, "a/b/c/d/" + "e" * 50, "word " * 90000 + "\n" + mit),
    ]
    df = spark.createDataFrame(rows, "uid long, path string, text string").selectExpr("*", "'q' as license", "1 as score")
    got = {r.uid: (r.license, r.origin, r.from_path) for r in licenses.scan_licenses(df).collect()}
    assert got == {
        1: ("MIT", "file", None), 2: ("GPL-3.0", "inherited", "a/b/COPYING"), 3: ("GPL-3.0", "file", None), 4: ("CC-BY-NC-4.0", "notice", None) if cosine("# " + cc + "\ncode", "CC-BY-NC-4.0") < 0.6 else ("CC-BY-NC-4.0", "file", None),
        5: (None, "none", None), 6: ("GPL-3.0", "inherited", "a/b/COPYING"), 7: ("MIT", "file", None), 8: (None, "none", None), 9: (None, "none", None),
        10: (None, "none", None), 11: ("MIT", "file", None), 12: ("MIT", "notice", None),
    }
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_cosines(spark):
    texts = [(1, "Licensed under the Apache License 2.0 by us"), (2, "GNU general stuff, version 3"), (3, "nothing of it"), (4, "all rights")]
    got = {(r.uid, r.license): r.score for r in licenses.score_units(spark.createDataFrame(texts, "uid long, unit string"), licenses.TEMPLATES).collect()}
    for uid, text in texts:
        for name in licenses.TEMPLATES:
            assert abs(got.get((uid, name), 0) - cosine(text, name)) < 1e-9


def test_long_licence_files_speak_for_their_directory(spark):
    full = "\n".join(f"Section {i} of the licence grants right{i} and denies claim{i * 7} under clause{i * 3}." for i in range(200))
    templates = {**licenses.TEMPLATES, "Long-1.0": full}
    rows = [(1, "a/LICENSE", "Copyright Someone\n" + full), (2, "a/b/x.py", "code"), (3, "c/x.py", "code")]
    df = spark.createDataFrame(rows, "uid long, path string, text string")
    assert len(licenses.terms_of(full)) > 400
    got = {r.uid: (r.license, r.origin, r.from_path) for r in licenses.scan_licenses(df, templates).collect()}
    assert got == {1: ("Long-1.0", "file", None), 2: ("Long-1.0", "inherited", "a/LICENSE"), 3: (None, "none", None)}


def test_real_licence_files_and_headers(spark):
    from codexflow.llm.license_texts import HEADERS, TEXTS

    rest = "\n".join(f"{i}. Further terms number {i} of this long document, with clauses about thing{i} and matter{i * 3}." for i in range(300))
    rows, want = [], {}
    for i, (name, text) in enumerate(TEXTS):
        # Long licences go on behind their head; short ones come with a year and a holder.
        whole = text.replace("year", "2021").replace("name", "Some Body") + ("\n" + rest if name in ("Apache-2.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "AGPL-3.0", "MPL-2.0", "CC0-1.0", "CC-BY-4.0") else "")
        rows += [(2 * i, f"p{i}/LICENSE", whole), (2 * i + 1, f"p{i}/src/deep/x.py", "import os\n")]
        want[2 * i], want[2 * i + 1] = (name, "file", None), (name, "inherited", f"p{i}/LICENSE")
    code = "\n".join(f"value{i} = compute{i}(other{i})" for i in range(100))
    for i, (name, text) in enumerate(HEADERS, 100):
        rows.append((i, f"q/{i}.py", code + "\n\n" + "\n".join("# " + x for x in text.split("\n")) + "\n\n" + code))
        want[i] = (name, "notice", None)
    rows.append((200, "r/title", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"))
    df = spark.createDataFrame(rows, "uid long, path string, text string")
    got = {r.uid: (r.license, r.origin, r.from_path) for r in licenses.scan_licenses(df).collect()}
    assert got[200][0] == "GPL-3.0"
    assert {k: got[k] for k in want} == want


def test_anchors_leave_nothing_out_and_ties_go_by_name(spark):
    import random

    rng = random.Random(1)
    words = sorted({t for _, text, _ in licenses.ALL for t in licenses.terms_of(text)}) + [f"x{i}" for i in range(20)]
    texts = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + " " + " ".join(rng.choice(licenses.ALL)[1].split()[: rng.randint(0, 40)])) for i in range(300)]
    units = spark.createDataFrame(texts, "uid long, unit string")
    every = {(r.uid, r.license): round(r.score, 9) for r in licenses.score_units(units, licenses.ALL).collect() if r.score >= 0.6}
    some = {(r.uid, r.license): round(r.score, 9) for r in licenses.score_units(units, licenses.ALL, 0.6).collect() if r.score >= 0.6}
    assert some == every and every
    two = {"B-1": "same words here", "A-1": "same words here"}
    df = spark.createDataFrame([(1, "d/one", "same words here"), (2, "d/two", "same words here"), (3, "d/e/f", "")], "uid long, path string, text string")
    got = {r.uid: (r.license, r.from_path) for r in licenses.scan_licenses(df, two).collect()}
    assert got == {1: ("A-1", None), 2: ("A-1", None), 3: ("A-1", "d/one")}
