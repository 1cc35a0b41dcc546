"""Main text of web pages: site templates found by counting subtrees per host.

Each page is parsed once. Every element that holds whole blocks of text, menus
and footers like paragraphs, gets a hash of its tags and text. Spark counts on
how many pages of a host each hash occurs, and subtrees that recur across many
of them are deleted. Pages of which next to nothing is left by that are copies
of an article, not a template; they are left out and the rest counted again, so
that mirrored articles keep their text. A main part's headings are never counted
alone, since articles share headings.

What recurs nowhere is judged by weaker evidence: kinds of elements that are
never main text (scripts, menus, forms), class, id and role names that say
nothing but such a kind, and, where a page marks its main part and that holds at
least half of its text, a place outside it.

A block's subtrees are kept as ranges of blocks, so a page takes memory in
proportion to its length however deep it is nested, and nothing recurses.

Nulls and edges: null html is the empty page, with text "" and 0 characters. A
null url is a host of its own without templates. Rows that share a ``page_id``
give a row each. An attribute's quote that is never closed ends with its tag. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import html
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import column

#: A subtree is a template if on so many pages of its host, and such a share of them.
MIN_PAGES, MIN_SHARE = 5, 0.2
#: Pages with a smaller share of text of their own are copies, and aren't counted.
OWN_SHARE = 0.1
#: Removed subtrees up to this many rows are sent to all executors; beyond, a shuffle join is used.
BROADCAST_ROWS = 100_000

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes template svg math".split())
_NEVER = frozenset("nav footer aside form button select input script style noscript iframe head title template svg math canvas object audio video dialog menu map textarea option datalist".split())
#: Of these, without any text that is shown.
_SILENT = frozenset("script style noscript iframe head title template svg math canvas object audio video select input map textarea option datalist".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
_HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element, up to the named enclosing one.
_CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
#: Words in class, id or role names of elements that aren't main text.
_NAMES = frozenset(
    """ad ads advert adverts advertisement advertising adbox adsense banner sponsor sponsored promo promotion promoted nav navbar navigation menu submenu
    breadcrumb breadcrumbs pagination pager masthead topbar header footer sidebar rail widget widgets notice notices cookie cookies consent gdpr alert
    newsletter subscribe subscription signup login comment comments commentlist disqus respond replies reply share sharing social
    related recommended popup modal overlay toolbar skip contentinfo complementary search searchbox form""".split()
)
#: Words that such names may have beside them; a name with any other word says something else.
_BESIDE = frozenset(
    """area articles bar bars block blocks body bottom box button buttons column container content entry footers global group holder icons inner item items left
    link links list main message middle module page panel posts primary reader readers right secondary section site slot stories text thread top trail unit user users""".split()
)
_START = re.compile(r"<(/?)([A-Za-z][A-Za-z0-9:-]*)([^>]*)>")
_QUOTED = re.compile(r"\"[^\"]*\"|'[^']*'")
_NAMED = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?:[\s=/]|$)|aria-hidden\s*=\s*["']?true|style\s*=\s*["'][^"']*display\s*:\s*none)""", re.IGNORECASE)
_WORD = re.compile(r"[a-z]+")
_END_TAGS: dict[str, re.Pattern] = {}


#: Why an element isn't main text: by its kind, or by its name only.
KIND, NAME = 1, 2


class Node:
    """An element: its tag, its text and elements in order, and why it isn't main text (0: it may be)."""

    __slots__ = ("tag", "inside", "why", "key", "parent")

    def __init__(self, tag: str, why: int = 0, parent: Node | None = None):
        self.tag, self.inside, self.why, self.key, self.parent = tag, [], why, 0, parent


def _why(tag: str, attributes: str) -> int:
    if tag in _NEVER:
        return KIND
    if not attributes or tag in ("html", "body", "main"):
        return 0
    if _HIDDEN.search(attributes):
        return KIND
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").lower().split():
            words = _WORD.findall(name)
            if not _NAMES.isdisjoint(words) and all(w in _NAMES or w in _BESIDE for w in words):
                return NAME
    return 0


def _tag_end(source: str, m: re.Match) -> tuple[int, str]:
    """Where a start tag ends, and its attributes; a ``>`` in a quoted value doesn't end it."""
    at, said = m.end(), m[3]
    if '"' not in said and "'" not in said:
        return at, said
    while True:
        rest = _QUOTED.sub("", said)
        quote = min((q for q in "\"'" if q in rest), key=rest.find, default=None)
        if quote is None:
            return at, said
        # The value goes on behind this bracket if its quote is closed at all.
        close = source.find(quote, at)
        end = source.find(">", close) if close >= 0 else -1
        if end < 0 or "<" in source[at:close] and ">" in source[at:close]:
            return m.end(), m[3]
        at, said = end + 1, source[m.start(3) : end]


def parse(source: str) -> Node:
    """The element tree, with end tags supplied where they are missing."""
    root = Node("html")
    stack, open_, at, end = [root], {}, 0, len(source)
    last = source.rfind(">")

    def close(depth: int) -> None:
        for n in stack[depth:]:
            open_[n.tag] -= 1
        del stack[depth:]

    while at < end:
        found = source.find("<", at)
        if found < 0:
            stack[-1].inside.append(source[at:])
            break
        if found > at:
            stack[-1].inside.append(source[at:found])
        if source.startswith("<!--", found):
            at = source.find("-->", found + 4) + 3
            if at < 3:
                break
            continue
        if found > last:
            stack[-1].inside.append(source[found:])
            break
        if source.startswith(("<!", "<?"), found):
            at = source.find(">", found) + 1
            continue
        m = _START.match(source, found)
        if m is None:
            stack[-1].inside.append("<")
            at = found + 1
            continue
        tag = m[2].lower()
        if m[1]:
            at = m.end()
            depth = next(i for i in range(len(stack) - 1, 0, -1) if stack[i].tag == tag) if open_.get(tag) else 0
            # The end tag of an inline element closes no block around it.
            if depth and (tag in _BLOCK or not any(n.tag in _BLOCK for n in stack[depth + 1 :])):
                close(depth)
            continue
        at, attributes = _tag_end(source, m)
        if tag in _BLOCK and open_.get("p") and (depth := _open_p(stack)):
            close(depth)
        if tag in _CLOSES:
            ends, bounds = _CLOSES[tag]
            if any(open_.get(t) for t in ends):
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in bounds:
                        break
                    if stack[i].tag in ends:
                        close(i)
        node = Node(tag, _why(tag, attributes), stack[-1])
        stack[-1].inside.append(node)
        if tag in _VOID or attributes.endswith("/") and tag not in _BLOCK:
            continue
        if tag in _RAW:
            shut = _END_TAGS.setdefault(tag, re.compile(rf"</{tag}\s*>", re.IGNORECASE)).search(source, at)
            at = shut.end() if shut else end
            continue
        stack.append(node)
        open_[tag] = open_.get(tag, 0) + 1
    return root


def _open_p(stack: list[Node]) -> int:
    """The depth of an open paragraph that a new block ends; 0 if there is none."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag == "p":
            return i
        if stack[i].tag in ("button", "table", "td", "th", "article", "section", "div", "li", "blockquote", "main"):
            return 0
    return 0


def _all(root: Node) -> list[Node]:
    """Every element whose text is shown, parents first."""
    out, work = [], [root]
    while work:
        node = work.pop()
        out.append(node)
        work += [x for x in node.inside if not isinstance(x, str) and x.tag not in _SILENT]
    return out


def _hash(host: str, nodes: list[Node]) -> None:
    """Give every element a signed 64-bit key of the tags and text below it, for this host."""
    prefix = host.encode("utf-8", "surrogatepass") + b"\0"
    for node in reversed(nodes):
        h = hashlib.blake2b(prefix + node.tag.encode(), digest_size=8)
        for x in node.inside:
            if isinstance(x, str):
                if said := " ".join(x.split()):
                    h.update(b"\1" + said.encode("utf-8", "surrogatepass"))
            elif x.tag not in _SILENT:
                h.update(b"\2" + x.key.to_bytes(8, "little", signed=True))
        node.key = int.from_bytes(h.digest(), "little", signed=True)


def _tops(nodes: list[Node]) -> set[Node]:
    """The outermost main parts, else articles, if they hold at least half of the page's text; else none."""
    letters, hidden, marked = {}, {}, {"main": [], "article": []}
    for n in nodes:
        hidden[n] = n.why or n.tag == "header" or n.parent is not None and hidden[n.parent]
        if n.tag in marked and not hidden[n]:
            marked[n.tag].append(n)
    if not any(marked.values()):
        # Names mustn't hide the only article: those around the first one are wrong.
        first = next((n for n in nodes if n.tag in marked), None)
        around, at = [], first.parent if first else None
        while at is not None:
            around.append(at)
            at = at.parent
        if first is None or first.why == KIND or any(n.why == KIND for n in around):
            return set()
        for n in (first, *around):
            n.why = 0
        return _tops(nodes)
    for n in reversed(nodes):
        own = sum(len("".join(x.split())) for x in n.inside if isinstance(x, str))
        letters[n] = 0 if n.why or n.tag == "header" else own + sum(letters.get(x, 0) for x in n.inside if not isinstance(x, str))
    for tag in ("main", "article"):
        some = set(marked[tag])
        inner = set()
        for n in nodes:
            if n.parent is not None and (n.parent in some or n.parent in inner):
                inner.add(n)
        tops = some - inner
        if tops and 2 * sum(letters[n] for n in tops) >= letters[nodes[0]]:
            return tops
    return set()


MAIN, WEAK, HEADING = 0, 1, 2


def blocks(source: str | None, host: str = "") -> tuple[list[tuple[str, int]], list[tuple[int, int, int, bool]]]:
    """A page's blocks in order with their kind, and its subtrees: key, first block, last block + 1, whether it holds main text.

    A block is ``MAIN`` text, a ``HEADING`` of it, or ``WEAK``: no main text by
    its element's kind, name or place. ``header`` is main text only for the
    headings of a main part's own header.
    """
    root = parse(source or "")
    nodes = _all(root)
    _hash(host, nodes)
    tops = _tops(nodes)
    out: list[tuple[str, int]] = []
    spans: list[tuple[int, int, int, bool]] = []
    parts: dict[int, list[str]] = {MAIN: [], WEAK: [], HEADING: []}

    def flush() -> None:
        for kind, some in parts.items():
            if some and (text := " ".join(html.unescape("".join(some)).split())):
                out.append((text, kind))
            some.clear()

    def pending() -> int:
        return sum(any(x and not x.isspace() for x in some) for some in parts.values())

    # Each open element: itself, what is left of it, its state, its first block, and main blocks before it.
    # The state: within a main part, not main text, within a heading, headings only.
    mains = 0
    counted = 0
    open_ = [(root, iter(root.inside), (not tops, False, False, False), 0, 0)]
    while open_:
        node, rest, state, first, before = open_[-1]
        inside, weak, heading, only = state
        kind = WEAK if weak or not inside or only and not heading else HEADING if heading and tops else MAIN
        for x in rest:
            if isinstance(x, str):
                parts[kind].append(x)
                continue
            if x.tag in _SILENT:
                continue
            if x.tag in ("br", "td", "th", "img"):
                parts[kind].append(" ")
            if x.tag in _VOID and x.tag not in _BLOCK:
                continue
            if x.tag in _BLOCK:
                flush()
            mains += sum(k != WEAK for _, k in out[counted:])
            counted = len(out)
            header = x.tag == "header"
            state = (inside or x in tops, weak or x.why > 0 or header and not (tops and inside), heading or x.tag in _HEADING, only or header)
            open_.append((x, iter(x.inside), state, len(out) + pending(), mains))
            break
        else:
            open_.pop()
            if node.tag in _BLOCK or not open_:
                flush()
            mains += sum(k != WEAK for _, k in out[counted:])
            counted = len(out)
            alone = node.tag in ("html", "body") or node in tops or tops and node.tag in _HEADING and inside
            if host and first < len(out) and not alone:
                spans.append((node.key, first, len(out), mains > before))
    return out, spans


def host_of(url: str | None) -> str:
    try:
        return (urlsplit(url or "").hostname or "").lower()
    except ValueError:
        return ""


_ROWS = 128
_SPAN = "key: long, first: int, last: int, main: boolean"
_PARSED = f"uid long, page_id long, url string, host string, texts array<string>, kinds array<int>, spans array<struct<{_SPAN}>>"
_PARSED_TYPES = [
    pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()),
    pa.list_(pa.struct([("key", pa.int64()), ("first", pa.int32()), ("last", pa.int32()), ("main", pa.bool_())])),
]
_PARSED_NAMES = ["uid", "page_id", "url", "host", "texts", "kinds", "spans"]


def parse_pages(pages: DataFrame) -> DataFrame:
    """The written table of parsed pages: blocks with their kinds, and subtrees as ranges of blocks."""

    def work(batches):
        task, n = TaskContext.get().partitionId(), 0
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                out = []
                for page_id, url, source in zip(*(column(whole.slice(at, _ROWS), c) for c in ("page_id", "url", "html"))):
                    host = host_of(url)
                    found, spans = blocks(source, host)
                    out.append((task << 40 | n, page_id, url, host, [t for t, _ in found], [k for _, k in found], [dict(zip(("key", "first", "last", "main"), s)) for s in spans]))
                    n += 1
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), _PARSED_TYPES)], _PARSED_NAMES)

    src = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return common.write_table(src.mapInArrow(work, _PARSED), "pages")


def count_subtrees(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """The written ``host``, ``key`` and ``n_pages`` of the subtrees that recur across a host's pages."""
    hosts = parsed.filter("host <> ''").groupBy("host").agg(F.count("*").alias("host_pages"))
    keys = parsed.select("host", F.explode(F.array_distinct("spans.key")).alias("key"))
    many = keys.groupBy("host", "key").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    recur = many.join(hosts, "host").filter(F.col("n_pages") >= min_share * F.col("host_pages")).select("host", "key", "n_pages")
    return common.write_table(recur, "templates")


def template_ranges(parsed: DataFrame, templates: DataFrame, main_only: bool = True) -> DataFrame:
    """The written ``uid`` and ``cut``: its ranges of blocks in a template, those without any main text aside."""
    spans = parsed.select("uid", F.explode("spans").alias("s")).select("uid", "s.*")
    if main_only:
        spans = spans.filter("main")
    # The key already holds the host. A common template's rows are split by skew handling in the join.
    hit = spans.join(templates.select("key"), "key")
    return common.write_table(hit.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("cut")), "ranges")


def _with_ranges(parsed: DataFrame, ranges: DataFrame) -> DataFrame:
    """Pages with their blocks as ``(text, kind, gone)``; few ranges go to all executors, many are joined by a shuffle."""
    few = ranges.select(F.coalesce(F.sum(F.size("cut")), F.lit(0))).first()[0] <= BROADCAST_ROWS
    both = parsed.drop("spans").join(F.broadcast(ranges) if few else ranges, "uid", "left")
    gone = "cut is not null and exists(cut, c -> c.first <= i and i < c.last)"
    return both.withColumn("blocks", F.expr(f"transform(arrays_zip(texts, kinds), (b, i) -> struct(b.texts as text, b.kinds as kind, {gone} as gone))"))


def find_templates(parsed: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """``host``, ``key`` and ``n_pages`` of the templates: subtrees that recur on pages with text of their own."""
    recur = count_subtrees(parsed, min_pages, min_share)
    seen = _with_ranges(parsed, template_ranges(parsed, recur)).filter("cut is not null")
    length = lambda where: F.expr(f"aggregate(filter(blocks, b -> {where}), 0L, (n, b) -> n + length(b.text))")
    copies = common.write_table(seen.select("uid", length("b.kind = 0").alias("main"), length("b.kind = 0 and not b.gone").alias("own")).filter(F.col("own") < OWN_SHARE * F.col("main")).select("uid"), "copies")
    if not copies.limit(1).count():
        return recur
    return count_subtrees(parsed.join(copies, "uid", "left_anti"), min_pages, min_share)


def remove_templates(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """Each page's main text without the blocks that lie in a template's subtree."""
    pages = _with_ranges(parsed, template_ranges(parsed, templates))
    text = F.array_join(F.expr(f"transform(filter(blocks, b -> b.kind <> {WEAK} and not b.gone), b -> b.text)"), "\n")
    return pages.select("page_id", "url", text.alias("text"), F.length(text).cast("long").alias("n_chars"))


def removal_counts(parsed: DataFrame, templates: DataFrame) -> DataFrame:
    """How many blocks are removed, by whether the count found them and whether kind, name or place would have."""
    pages = _with_ranges(parsed, template_ranges(parsed, templates, main_only=False))
    rows = pages.select(F.explode("blocks").alias("b")).select(F.col("b.gone").alias("counted"), (F.col("b.kind") == WEAK).alias("weak"))
    return rows.groupBy("counted", "weak").agg(F.count("*").alias("n_blocks"))


def extract_pages(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Main text of every page: ``page_id``, ``url``, ``text``, ``n_chars``."""
    parsed = parse_pages(pages)
    return remove_templates(parsed, find_templates(parsed, min_pages, min_share))


def op4_html_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(common.read(spark, sf_dir, "pages"))
