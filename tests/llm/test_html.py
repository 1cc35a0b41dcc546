"""Main text of pages: parsing, boilerplate by kind, templates by counting."""

from codexflow.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header class="site-header"><h1>Site</h1></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="ad">Buy</div>
<article><header><h1>Title &amp;  more</h1><span>by me</span></header><p><b>Bold start.<br><p>Second&nbsp;one
with <i>mark</i>up.</p><div class="cookie-notice">Cookies</div><form><p>mail</form><ul><li>One<li>Two</ul>
<table><tr><td>a<td>b</table><section id="comments"><p>I agree</p></section>tail &lt;p&gt;</article>
<aside><p>Side</aside><footer>&copy; foot</footer></body></html>"""


def text(source):
    return "\n".join(b for b, kind in html_text.blocks(source)[0] if kind != html_text.WEAK)


def test_article_text():
    assert text(PAGE) == "Title & more\nBold start.\nSecond one with markup.\nOne\nTwo\na b\ntail <p>"


def test_pages_without_an_article_and_broken_pages():
    assert text("<body><div id=nav-bar>x</div><div><h2>H</h2>one<p>two<div hidden>no</div></div></body>") == "H\none\ntwo"
    assert text("<p>open <b>bold") == "open bold"
    assert text("plain & text <") == "plain & text <"
    assert text("<article><p>a<!-- no --> b<!-- open") == "a b"
    assert text("<script>never closed <p>x") == "" and text(None) == "" and text("") == ""
    assert text("<main>x<br>y<hr>z</main>") == "x y\nz"


def test_templates_are_counted_per_host(spark):
    box = "<div><p>Join our list</p><p>Every week</p></div>"
    rows = [(i, f"http://a.example/{i}", f"<body>{box}<p>Own text {i}</p></body>") for i in range(8)]
    rows += [(20 + i, f"http://b{i}.example/", f"<body>{box}<p>Own {i}</p></body>") for i in range(8)]
    # Copies of an article on one host keep their text.
    rows += [(40 + i, "http://c.example/", "<article><h1>Same</h1><p>Same text.</p></article>") for i in range(8)]
    rows += [(60, None, f"<body>{box}</body>"), (61, "http://[bad", None), (None, "http://a.example/x", ""), (62, "http://a.example/y", box)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'z' as text", "1 as key", "2 as uid")
    got = {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(df).collect()}
    assert got[3] == ("Own text 3", 10) and got[62] == ("", 0)
    assert got[23][0] == "Join our list\nEvery week\nOwn 3" and got[44][0] == "Same\nSame text."
    assert got[60][0] == "Join our list\nEvery week" and got[61] == ("", 0) and got[None] == ("", 0)
    assert len(got) == len(rows) and html_text.extract_pages(df.limit(0)).count() == 0
    few = html_text.BROADCAST_ROWS
    html_text.BROADCAST_ROWS = -1
    try:
        assert {r.page_id: (r.text, r.n_chars) for r in html_text.extract_pages(df).collect()} == got
    finally:
        html_text.BROADCAST_ROWS = few


def test_recurring_paragraphs_of_articles_go_and_teasers_hide_no_text(spark):
    notice = "<p>This story was sent to you by our readers' club.</p>"
    rows = [(i, f"http://a.example/{i}", f"<article><h1>Story {i}</h1><p>Text of {i}.</p>{notice}</article>") for i in range(8)]
    rows += [(20, "http://b.example/", "<body><p>The long main text of this page, in full.</p><article>Teaser</article></body>")]
    got = {r.page_id: r.text for r in html_text.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[i] == f"Story {i}\nText of {i}." for i in range(8))
    assert got[20] == "The long main text of this page, in full.\nTeaser"


def test_names_must_say_nothing_else_and_main_holds_its_article():
    kept = "<section id='discussion'><p>a</p></section><div class='share-price'>b</div><div class='related-work'>c</div><fieldset>d</fieldset><label>e</label>"
    assert text(f"<article><p>x</p>{kept}<div class='share-buttons'>no</div><div class='comments-area'>no</div></article>") == "x\na\nb\nc\nd\ne"
    assert text("<main><h1>T</h1><p>one</p><article><p>two</p></article><p>three</p></main><p>out</p>") == "T\none\ntwo\nthree"
    assert text("<div class='sidebar'><article><p>only one</p></article></div>") == "only one"


def test_deep_broken_and_repetitive_markup():
    for tag in ("div", "b", "span"):
        assert text(f"<{tag}>" * 50_000 + "deep" + f"</{tag}>" * 50_000) == "deep"
    found, spans = html_text.blocks("<div>x" * 20_000, "h")
    assert len(found) == 20_000 and len(spans) == 20_000
    assert text('one <a href="x>two three') == 'one <a href="x>two three'[:4].strip() + " two three"
    assert text('<p title="a > b">c</p>') == "c" and text("<p title='it\"s > '>d") == "d"
    for odd in ('<a "', "<a '", "<!", "</b>", '<a ">', "<", "<p><b>"):
        text(odd * 50_000)


def test_counts_agree_with_brute_force_and_mirrors_keep_their_text(spark):
    import random

    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    prose = lambda n: " ".join(word() for _ in range(n))
    hosts = {f"h{h}.example": (f"<div><ul><li>{prose(2)}<li>{prose(2)}</ul></div>", f"<p>{prose(6)}</p>") for h in range(3)}
    rows, own = [], {}
    for i in range(60):
        host = f"h{i % 3}.example"
        menu, tail = hosts[host]
        own[i] = [prose(12) for _ in range(3)]
        rows.append((i, f"http://{host}/{i}", f"<body>{menu}{''.join(f'<p>{t}</p>' for t in own[i])}{tail}</body>"))
    same = [prose(15) for _ in range(20)]
    for i in range(60, 80):
        menu, tail = hosts["h0.example"]
        own[i] = same[:-1] + [word()]
        rows.append((i, f"http://h0.example/{i}", f"<body>{menu}{''.join(f'<p>{t}</p>' for t in own[i])}{tail}</body>"))
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    parsed = html_text.parse_pages(df)
    pages, seen = {}, {}
    for i, url, source in rows:
        host = html_text.host_of(url)
        pages[host] = pages.get(host, 0) + 1
        for key in {s[0] for s in html_text.blocks(source, host)[1]}:
            seen[host, key] = seen.get((host, key), 0) + 1
    brute = {(h, k, n) for (h, k), n in seen.items() if n >= html_text.MIN_PAGES and n >= html_text.MIN_SHARE * pages[h]}
    assert {tuple(r) for r in html_text.count_subtrees(parsed).collect()} == brute
    got = {r.page_id: r.text for r in html_text.extract_pages(df).collect()}
    assert got == {i: "\n".join(t) for i, t in own.items()}
    counts = {(r.counted, r.weak): r.n_blocks for r in html_text.removal_counts(parsed, html_text.find_templates(parsed)).collect()}
    assert counts[True, False] == 3 * 80
