"""Secret scans with a worklist of decoded layers.

A text is scanned, then each way of unwrapping it (URL escapes, Unicode
escapes, base64, compressed data within base64) gives a further layer, in which
the decoded parts stand where their encoded form stood. Each new layer is
scanned and unwrapped in turn until none is new; a layer seen before is not
taken again, so cycles end. Spans of a layer are mapped back through all layers
to code points of the original text.

Nulls and edges: a null text is the empty text. Rows that share a ``doc_id``
give a row each; a null ``doc_id`` stays null. An empty table gives no rows.
Other columns of the input are not read by ``scan_secrets``.

Bounds: data that would unpack to more than ``MAX_UNPACKED`` bytes makes no
layer; it is unpacked as a stream and scanned chunk by chunk, each with its own
worklist, and what is found there has the span of the whole encoded form. An
escape that is itself escaped ``DEEP`` times or more (``%252525...41``) loses
all of that in one step, since the layers between differ in nothing else; so
texts of nested escapes don't need a layer for each. Layers give up their text
once they are unwrapped.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import unicodedata
import zlib
from bisect import bisect_right
from collections import deque

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import column

KINDS = ("assign", "access", "hex")
#: The bound on one unpacked layer, against decompression bombs.
MAX_UNPACKED = 64 << 20

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")
_WORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")

#: Escapes of an escape's first character, from which on they are taken in one step.
DEEP = 16
_URL_ONE = re.compile(rf"%(?:25){{{DEEP},}}|%[0-9A-Fa-f]{{2}}")
_URL = re.compile(rf"(?:{_URL_ONE.pattern})+")
_DEEP_SLASH = rf"\\(?:u005[cC]|x5[cC]|U0000005[cC]|u\{{0*5[cC]\}}){{{DEEP},}}"
_DEEP_AND = rf"&(?:#0*38;|#[xX]0*26;){{{DEEP},}}"
_UNICODE = re.compile(
    rf"(?:{_DEEP_SLASH}|{_DEEP_AND})|((?:(?!{_DEEP_SLASH}|{_DEEP_AND})"
    + r"(?:\\u[0-9A-Fa-f]{4}|\\u\{[0-9A-Fa-f]{1,6}\}|\\U[0-9A-Fa-f]{8}|\\x[0-9A-Fa-f]{2}|&#[0-9]{1,7};|&#[xX][0-9A-Fa-f]{1,6};))+)"
)
_UNICODE_ONE = re.compile(r"\\u\{([0-9A-Fa-f]+)\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#([0-9]+);|&#[xX]([0-9A-Fa-f]+);")
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{12,}={0,2}")
#: Two lines of base64 or more, of which only the last may be short.
_WRAPPED = re.compile(r"[A-Za-z0-9+/_-]{12,}(?:\r?\n[ \t]*[A-Za-z0-9+/_-]{12,})*\r?\n[ \t]*[A-Za-z0-9+/_-]+={0,2}")
_LINE_BREAK = re.compile(r"\r?\n[ \t]*")
#: Least share of readable characters in decoded base64 that isn't compressed.
READABLE = 0.85


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """The spans of one layer: leftmost and non-overlapping for each kind."""
    found = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        found += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", *m.span()) for m in _HEX.finditer(text)]
    return found


class Layer:
    """A text and where its parts stand in its parent.

    ``parts``: (start here, start there, end there, decoded). Copied parts map
    each code point to one; a decoded part maps to the whole encoded form.
    """

    def __init__(self, text: str, parent: Layer | None = None, parts: list[tuple[int, int, int, bool]] | None = None):
        self.text, self.parent, self.parts = text, parent, parts or []
        self._starts = [p[0] for p in self.parts]
        #: Spans found in data too large for a layer of its own.
        self.streamed: list[tuple[str, int, int]] = []

    def origin(self, start: int, end: int) -> tuple[int, int]:
        """A span's place in the original text."""
        layer = self
        while layer.parent is not None:
            a, first, _, decoded = layer.parts[bisect_right(layer._starts, start) - 1]
            low = first if decoded else first + start - a
            b, first, last, decoded = layer.parts[bisect_right(layer._starts, end - 1) - 1]
            start, end = low, last if decoded else first + end - b
            layer = layer.parent
        return start, end


def _replaced(layer: Layer, changes: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer | None:
    """A layer with decoded parts in place: (start, end, [(decoded, from, to)])."""
    if not changes:
        return None
    out, parts, size, at = [], [], 0, 0

    def add(text: str, start: int, end: int, decoded: bool) -> None:
        nonlocal size
        if text:
            parts.append((size, start, end, decoded))
            out.append(text)
            size += len(text)

    for start, end, pieces in changes:
        add(layer.text[at:start], at, start, False)
        for text, a, b in pieces:
            add(text, a, b, True)
        at = end
    add(layer.text[at:], at, len(layer.text), False)
    return Layer("".join(out), layer, parts)


def decode_url(layer: Layer) -> Layer | None:
    changes = []
    for m in _URL.finditer(layer.text) if "%" in layer.text else ():
        units = [u.span() for u in _URL_ONE.finditer(layer.text, *m.span())]
        raw = bytes(0x25 if b - a > 3 else int(layer.text[a + 1 : b], 16) for a, b in units)
        pieces, at = [], 0
        for c, n in _utf8(raw):
            a, b = units[at][0], units[at + n - 1][1]
            # Bytes that are no character stay as they were.
            pieces.append((layer.text[a:b] if c is None else c, a, b))
            at += n
        if any(layer.text[a:b] != said for said, a, b in pieces):
            changes.append((*m.span(), pieces))
    return _replaced(layer, changes)


def decode_unicode(layer: Layer) -> Layer | None:
    changes = []
    for m in _UNICODE.finditer(layer.text) if "\\" in layer.text or "&#" in layer.text else ():
        pieces, high = [], None
        if m[1] is None:
            changes.append((*m.span(), [(m[0][0], *m.span())]))
            continue
        for one in _UNICODE_ONE.finditer(layer.text, *m.span()):
            code = int(one[5]) if one[5] else int(next(g for g in one.groups() if g), 16)
            if high is not None and 0xDC00 <= code < 0xE000:
                start = pieces.pop()[1]
                pieces.append((chr(0x10000 + (high - 0xD800 << 10) + code - 0xDC00), start, one.end()))
                high = None
            else:
                high = code if 0xD800 <= code < 0xDC00 else None
                # What is no character stays as it was.
                said = chr(code) if code < 0x110000 and not 0xD800 <= code < 0xE000 else one[0]
                pieces.append((said, *one.span()))
        if any(layer.text[a:b] != said for said, a, b in pieces):
            changes.append((*m.span(), pieces))
    return _replaced(layer, changes)


def _utf8(raw: bytes) -> list[tuple[str | None, int]]:
    """Characters and their bytes; a byte that is part of none gives None."""
    return [(None, 1) if "\udc80" <= c <= "\udcff" else (c, len(c.encode())) for c in raw.decode("utf-8", "surrogateescape")]


def _encoding(raw: bytes) -> str:
    """UTF-16 by its mark or by zeros in every other place; else UTF-8."""
    half = len(raw) // 2
    little, big = raw[1::2].count(0), raw[: 2 * half : 2].count(0)
    if raw[:2] == b"\xff\xfe" or little > 0.3 * half and big < 0.1 * little:
        return "utf-16-le"
    if raw[:2] == b"\xfe\xff" or big > 0.3 * half and little < 0.1 * big:
        return "utf-16-be"
    return "utf-8"


def _utf16(raw: bytes, name: str) -> list[tuple[str | None, int]]:
    said = raw[: len(raw) // 2 * 2].decode(name, "surrogatepass")
    return [(None, 2) if "\ud800" <= c <= "\udfff" else (c, 4 if c > "\uffff" else 2) for c in said]


def _unpacker(raw: bytes):
    """A decompressor for data of a known format, or None."""
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if raw[:1] == b"\x78" and len(raw) > 5 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == b"\xfd7zXZ\0" else None


class _TooLarge(Exception):
    pass


def _unpack(raw: bytes) -> bytes | None:
    """Decompress all members of data of a known format; None if it is none.

    What follows the last whole member is left out.
    """
    out, size = [], 0
    while (made := _unpacker(raw)) is not None:
        try:
            # A bound of 0 is none to zlib.
            some = made.decompress(raw, MAX_UNPACKED - size + 1)
        except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
            break
        size += len(some)
        if size > MAX_UNPACKED:
            raise _TooLarge
        if not made.eof:
            break
        out.append(some)
        raw = made.unused_data.lstrip(b"\0")
    return b"".join(out) if out else None


#: Bytes of unpacked data scanned at once, and how many of them again with the next ones.
_CHUNK, _AGAIN = 1 << 20, 1 << 16


def _stream(raw: bytes):
    """Chunks of the unpacked data of all members, overlapping."""
    held = b""
    while (made := _unpacker(raw)) is not None:
        zlib_like = hasattr(made, "unconsumed_tail")
        given = raw
        while not made.eof:
            try:
                some = made.decompress(given, _CHUNK)
            except (zlib.error, OSError, lzma.LZMAError, ValueError, EOFError):
                some = b""
            given = made.unconsumed_tail if zlib_like else b""
            if not some and not given and not made.eof:
                yield held
                return
            held += some
            if len(held) >= _CHUNK:
                yield held
                held = held[-_AGAIN:]
        raw = made.unused_data.lstrip(b"\0")
    yield held


def _streamed_kinds(raw: bytes) -> set[str]:
    """The kinds of secrets in data too large for a layer."""
    kinds: set[str] = set()
    for chunk in _stream(raw):
        kinds.update(kind for kind, _, _ in scan(chunk.decode(_encoding(chunk), "replace"))[1])
        if len(kinds) == len(KINDS):
            break
    return kinds


def _as_text(raw: bytes) -> list[tuple[str, int]] | None:
    """Bytes as characters with the bytes of each, or None if they are no text.

    Most characters must be readable, zeros aside; those that are none are replaced.
    """
    name = _encoding(raw)
    said = _utf8(raw) if name == "utf-8" else _utf16(raw, name)
    some = [c for c, _ in said if c != "\0"]
    good = sum(c is not None and (c.isprintable() or c in "\t\n\r\f\v" or unicodedata.category(c) in ("Cf", "Zs", "Zl", "Zp")) for c in some)
    return [("\ufffd" if c is None else c, n) for c, n in said] if good and good >= READABLE * len(some) else None


def _decode_base64(layer: Layer, pattern: re.Pattern) -> Layer | None:
    changes = []
    for m in pattern.finditer(layer.text):
        # Where each character of the encoded form stands.
        places, at = [], m.start()
        for line in _LINE_BREAK.finditer(layer.text, *m.span()) if pattern is _WRAPPED else ():
            places.append(range(at, line.start()))
            at = line.end()
        places.append(range(at, m.end()))
        body = "".join(layer.text[r.start : r.stop] for r in places).rstrip("=")
        if pattern is _WRAPPED and len(body) % 4 == 1:
            # The last line is no part of it.
            body = body[: sum(map(len, places[:-1]))]
        if len(body) % 4 == 1:
            continue
        try:
            raw = base64.b64decode(body.replace("-", "+").replace("_", "/") + "=" * (-len(body) % 4), validate=True)
        except binascii.Error:
            continue
        seen, packed = set(), False
        try:
            while (inner := _unpack(raw)) is not None and (key := hashlib.sha256(inner).digest()) not in seen:
                seen.add(key)
                raw, packed = inner, True
        except _TooLarge:
            layer.streamed += [(kind, *m.span()) for kind in _streamed_kinds(raw)]
            continue
        if packed:
            # What was compressed is data in any case, and is taken whatever it holds.
            pieces = [(raw.decode(_encoding(raw), "replace"), *m.span())]
        elif (said := _as_text(raw)) is None:
            continue
        else:
            pieces, at, flat = [], 0, [i for r in places for i in r]
            for c, n in said:
                a, b = at * 4 // 3, min(len(flat), -(-(at + n) * 4 // 3))
                pieces.append((c, flat[a], flat[b - 1] + 1))
                at += n
        changes.append((*m.span(), pieces))
    return _replaced(layer, changes)


def decode_base64(layer: Layer) -> Layer | None:
    """Base64 of readable text, or of (repeatedly) compressed data."""
    return _decode_base64(layer, _BASE64)


def decode_wrapped(layer: Layer) -> Layer | None:
    """The same of base64 that goes over several lines."""
    return _decode_base64(layer, _WRAPPED) if "\n" in layer.text else None


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]], int]:
    """Spans of the text itself, all spans with those of its layers, and the layers' number."""
    root = Layer(text or "")
    base = find_spans(root.text)
    spans, seen, work = set(base), {hashlib.sha256(root.text.encode("utf-8", "surrogatepass")).digest()}, deque([root])
    while work:
        layer = work.popleft()
        for decode in (decode_url, decode_unicode, decode_base64, decode_wrapped):
            inner = decode(layer)
            spans.update((kind, *layer.origin(a, b)) for kind, a, b in layer.streamed)
            layer.streamed.clear()
            if inner is None or (key := hashlib.sha256(inner.text.encode("utf-8", "surrogatepass")).digest()) in seen:
                continue
            seen.add(key)
            spans.update((kind, *inner.origin(a, b)) for kind, a, b in find_spans(inner.text))
            work.append(inner)
        layer.text = ""
    return ordered(base), ordered(spans), len(seen)


def ordered(spans) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str:
    """The text with each span, or overlapping spans together, replaced by ``mark``."""
    out, at = [], 0
    for _, a, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join([*out, text[at:]])


_SPANS = "array<struct<kind: string, start: long, end: long>>"
_SCANNED = f"doc_id long, base array<struct<kind: string, start: long, end: long>>, spans {_SPANS}, n_layers long, redacted string"
_ROWS = 256
_SPAN_TYPE = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))


def scan_secrets(documents: DataFrame, with_text: bool = True) -> DataFrame:
    """Base spans, all spans, number of layers and the redacted text of each row."""

    def work(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                texts = column(batch, "text")
                found = [scan(t) for t in texts]
                struct = lambda spans: [{"kind": k, "start": a, "end": b} for k, a, b in spans]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(column(batch, "doc_id"), pa.int64()),
                        pa.array([struct(f[0]) for f in found], _SPAN_TYPE),
                        pa.array([struct(f[1]) for f in found], _SPAN_TYPE),
                        pa.array([f[2] for f in found], pa.int64()),
                        pa.array([redact(t or "", f[1]) if with_text else None for t, f in zip(texts, found)], pa.string()),
                    ],
                    ["doc_id", "base", "spans", "n_layers", "redacted"],
                )

    docs = documents.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return docs.mapInArrow(work, _SCANNED)


def redact_documents(documents: DataFrame) -> DataFrame:
    """``documents`` with secrets replaced in ``text`` and ``n_chars`` set anew; other columns stay.

    A null text stays null.
    """

    @F.pandas_udf("string")
    def clean(texts):
        return texts.map(lambda t: t if t is None else redact(t, scan(t)[1]))

    out = documents.withColumn("text", clean("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out


def op7_secret_worklist(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(common.read(spark, sf_dir, "documents"), with_text=False)
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    join = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    return found.select("doc_id", *map(count, KINDS), F.sha2(join("base"), 256).alias("base_sha256"), join("spans").alias("spans"), "n_layers")
