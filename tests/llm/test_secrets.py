"""Secret scans against a plain scan and planted nested layers."""

import base64
import bz2
import gzip
import hashlib
import random
import re
import urllib.parse
import zlib

from codexflow.llm import secrets

SECRET = "password: hunter2secret"


def plain(text):
    found = []
    for kind, rx, ok in (
        ("assign", r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", lambda m: len(m[2]) >= 6),
        ("access", r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
        ("hex", r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
    ):
        found += [(kind, *m.span()) for m in re.finditer(rx, text) if ok(m)]
    return sorted(found, key=lambda s: (s[1], secrets.KINDS.index(s[0])))


def test_base_spans_are_those_of_a_plain_scan():
    rng = random.Random(2)
    parts = ["password", "PassWord", "api_key", "APIKEY", "ſecret", "toKen", "=", ": ", '"', "'", "abcdef", "abc", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "é", " ", "\n", "token=token=abcdef"]
    for _ in range(3000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        base, spans, _ = secrets.scan(text)
        assert base == plain(text) and set(base) <= set(spans), text


def test_nested_layers_map_to_the_original():
    b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    url = lambda s: "".join(f"%{b:02X}" for b in s.encode())
    uni = lambda s: "".join(f"\\u{ord(c):04x}" for c in s)
    for wrapped in (
        b64(SECRET), url(SECRET), uni(SECRET), b64(gzip.compress(SECRET.encode())), b64(zlib.compress(bz2.compress(SECRET.encode()))),
        url(b64(uni(SECRET))), uni(url(SECRET)), b64(b64(b64(SECRET))), urllib.parse.quote(b64(gzip.compress(url(SECRET).encode()))),
        "".join(f"&#x{ord(c):x};" for c in SECRET),
    ):
        text = "é before " + wrapped + " after"
        base, spans, layers = secrets.scan(text)
        assert layers > 1 and not base, wrapped
        assert [text[a:b] for k, a, b in spans if k == "assign"] == [wrapped] or all(9 <= a < b <= 9 + len(wrapped) for _, a, b in spans) and spans, (wrapped, spans)


def test_partly_encoded_values_and_cycles():
    text = "token = abc%41%42%43xyz!"
    base, spans, _ = secrets.scan(text)
    assert base == [] and spans == [("assign", 0, 23)]
    assert secrets.scan("%2525252541" * 3)[2] > 3
    assert secrets.scan("\\ud83d\\ude00 \\ud800 &#9999999; %ff %zz" + "A" * 5000)[0] == []
    assert secrets.redact("x password=abcdef y AKIA", [("assign", 2, 17), ("hex", 11, 17)]) == "x [SECRET] y AKIA"


def test_a_pair_beyond_the_base_plane():
    text = "\\ud83d\\ude00 token=\\u0061bcdef"
    assert [text[a:b] for _, a, b in secrets.scan(text)[1]] == ["token=\\u0061bcdef"]


def test_layers_with_odd_characters_lines_and_members():
    b64 = lambda s: base64.b64encode(s if isinstance(s, bytes) else s.encode()).decode()
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij klmnop\n") for _ in range(600))
    wrap = lambda s, n=64: "\n".join(s[i : i + n] for i in range(0, len(s), n))
    for wrapped in (
        *(b64("a" + c + "b " + SECRET + " and more") for c in "\u00a0\u200d\ufeff\f\0"), b64(b"caf\xe9 " + SECRET.encode() + b" and more"),
        b64(SECRET.encode("utf-16")), b64(SECRET.encode("utf-16-le")), b64(SECRET.encode("utf-16-be")),
        b64(gzip.compress(b"\x00\xff\x01" * 50 + SECRET.encode())), b64(gzip.compress(SECRET.encode("utf-16"))),
        wrap(b64(gzip.compress((long + SECRET).encode()))), wrap(b64(bz2.compress((long + SECRET).encode())), 76).replace("\n", "\r\n"),
        b64(gzip.compress(b"first") + gzip.compress(SECRET.encode())), b64(bz2.compress(b"first") + bz2.compress(SECRET.encode())),
    ):
        text = "\u00e9 before " + wrapped + " after"
        base, spans, _ = secrets.scan(text)
        assert not base and any(k == "assign" for k, *_ in spans), wrapped
        assert all(9 <= a < b <= 9 + len(wrapped) for _, a, b in spans), (wrapped, spans)
    text = "%70assword%3A%FFx %ff%70assword%3A%20hunter2secret"
    assert [text[a:b] for _, a, b in secrets.scan(text)[1]] == ["%70assword%3A%20hunter2secret"]
    # A secret that goes over the end of a line.
    text = "x " + wrap(b64("some words before it, then the " + SECRET + " and so on and so on"), 48)
    assert any(k == "assign" and "\n" in text[a:b] for k, a, b in secrets.scan(text)[1])


def test_table(spark):
    rows = [(1, SECRET), (1, SECRET), (None, "é"), (3, None), (4, ""), (5, "word " * 40000 + SECRET), (6, base64.b64encode(SECRET.encode()).decode())]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' as spans", "0L as n_chars")
    got = {r.doc_id: r for r in secrets.scan_secrets(df).collect()}
    assert [s.start for s in got[5].base] == [200000] and got[6].base == [] and got[6].spans[0].start == 0
    assert got[1].redacted == "[SECRET]" and got[3].redacted == ""
    clean = {r.doc_id: r for r in secrets.redact_documents(df).collect()}
    assert clean[3].text is None and clean[1].n_chars == 8 and clean[None].text == "é" and clean[1].spans == "x"
    assert secrets.scan_secrets(df.limit(0)).count() == 0
    df.drop("spans").write.parquet(path := secrets.common.scratch_path(spark, "t") + "/documents.parquet")
    q = {r.doc_id: r for r in secrets.op7_secret_worklist(spark, path.rpartition("/")[0]).collect()}
    assert (q[1].n_assign, q[1].spans, q[6].n_assign) == (1, f"assign:0:{len(SECRET)}", 0)
    assert q[1].base_sha256 == hashlib.sha256(q[1].spans.encode()).hexdigest() and q[4].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_deep_nesting_takes_few_layers_and_no_recursion():
    for text in (
        "%" + "25" * 1100 + "41 password=hunter2secret",
        "%" + "25" * 300_000 + "41 " + urllib.parse.quote(SECRET, safe=""),
        "\\" + "u005c" * 50_000 + "u0041 " + "".join(f"\\u{ord(c):04x}" for c in SECRET),
        "&" + "#38;" * 50_000 + "#65; " + "".join(f"&#{ord(c)};" for c in SECRET),
    ):
        base, spans, layers = secrets.scan(text)
        assert any(k == "assign" for k, _, _ in spans) and layers < 25
    mixed = SECRET
    for _ in range(60):
        mixed = urllib.parse.quote(mixed, safe="").replace("%", "\\u0025")
    assert any(k == "assign" for k, _, _ in secrets.scan(mixed)[1])


def test_data_too_large_for_a_layer_is_scanned_as_a_stream():
    most, secrets.MAX_UNPACKED = secrets.MAX_UNPACKED, 1 << 20
    try:
        for place in (0, 1_048_570, 2_500_000, 3_999_900):
            raw = bytearray(b"lorem ipsum " * 340_000)
            raw[place : place + len(SECRET)] = SECRET.encode()
            for pack in (gzip.compress, zlib.compress, bz2.compress):
                wrapped = base64.b64encode(pack(bytes(raw))).decode()
                text = "before " + wrapped + " after"
                # The encoded form of such data may itself look like hex.
                assert [s for s in secrets.scan(text)[1] if s[0] != "hex"] == [("assign", 7, 7 + len(wrapped))], place
        assert secrets.scan(base64.b64encode(gzip.compress(b"lorem ipsum " * 340_000)).decode())[0] == secrets.scan(base64.b64encode(gzip.compress(b"lorem ipsum " * 340_000)).decode())[1]
    finally:
        secrets.MAX_UNPACKED = most


def test_random_nests_against_a_plain_fixpoint():
    rng = random.Random(8)
    b64 = lambda s: base64.b64encode(s.encode()).decode()
    ways = [
        lambda s: "".join(f"%{b:02x}" for b in s.encode()), lambda s: urllib.parse.quote(s, safe=""), lambda s: "".join(f"\\u{ord(c):04x}" for c in s),
        lambda s: "".join(f"&#{ord(c)};" for c in s), b64, lambda s: base64.b64encode(gzip.compress(s.encode())).decode(), lambda s: base64.b64encode(bz2.compress(s.encode())).decode(),
    ]
    for _ in range(200):
        hidden, depth = SECRET, rng.randint(1, 4)
        for _ in range(depth):
            hidden = rng.choice(ways)(hidden)
            if len(hidden) > 4000:
                break
        text = "start " + hidden + " end"
        spans = [s for s in secrets.scan(text)[1] if s[0] == "assign"]
        assert spans and all(6 <= a < b <= 6 + len(hidden) for _, a, b in spans), text[:200]
        assert "hunter2" not in "".join(secrets.redact(text, spans))
