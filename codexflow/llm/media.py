"""MPEG audio as a column: write, resynchronise, parse tags and tables, seek.

``write_audio`` stores a payload losslessly in an MPEG-1 Layer III stream: each
frame is silent (its side information names no main data), carries a checksum
and holds payload bytes where decoders skip ancillary data. An ID3v2 tag holds
the payload's sizes and a Xing table the frame count, size and seek points.

``parse_audio`` reads any MPEG-1/2/2.5 stream of layers I to III: it skips
ID3v2 and ID3v1 tags, finds frame headers again after foreign bytes, reads
Xing, Info and VBRI tables, verifies the checksums of all three layers
and gives the exact duration (samples over rate) and each frame's offset.

Nulls and edges of the query: a null text is the empty text, whose payload is
64 zero bytes. Rows that share a ``doc_id`` give a row each; a null ``doc_id``
stays null. Equal texts give equal values. An empty table gives no rows. Other
columns of the input are not read. Media bytes that hold no frame parse to no
frames; null media has nulls in all columns but its id. A stream that
``write_audio`` didn't make has its facts, and nulls in the payload's columns.
"""

from __future__ import annotations

import hashlib
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codexflow.llm import common
from codexflow.llm.encode import column

# Fixed values of the MPEG audio formats: kbit/s by bitrate index 1 to 14.
KBITS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

PAYLOAD_UNIT = 64
#: Header, checksum and side information of a mono MPEG-1 Layer III frame.
_OVERHEAD = 4 + 2 + 17


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    rate: int
    channels: int
    size: int
    samples: int
    side: int
    #: Subbands below it have an allocation for each channel, those from it on one for both.
    bound: int


@lru_cache(maxsize=4096)
def parse_header(word: bytes) -> Header | None:
    """A frame header of four bytes, or None."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer is None or index in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    kbits, hz = KBITS[1 if version == 1 else 2, layer][index - 1], RATES[version][rate]
    padding, channels = word[2] >> 1 & 1, 1 if word[3] >> 6 == 3 else 2
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12000 * kbits // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hz + padding
    side = 0 if layer != 3 else (17 if channels == 1 else 32) if version == 1 else 9 if channels == 1 else 17
    bound = 4 * ((word[3] >> 4 & 3) + 1) if word[3] >> 6 == 1 else 32
    return Header(version, layer, not word[1] & 1, kbits, hz, channels, size, samples, side, bound)


@lru_cache(maxsize=4096)
def checksum(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 from 0xFFFF, high bit first."""
    crc = 0xFFFF
    for byte in data:
        crc ^= byte << 8
        for _ in range(8):
            crc = (crc << 1 ^ 0x8005 if crc & 0x8000 else crc << 1) & 0xFFFF
    return crc


#: Layer II: subbands by the bits of their allocation (fixed values), as (subbands, bits) in order.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low": ((4, 4), (7, 3), (19, 2)),
}


def _allocation(h: Header) -> tuple[tuple[int, int], ...]:
    """The table that a layer II frame's rate and bitrate choose."""
    if h.version != 1:
        return ALLOCATIONS["low"]
    each = h.kbits // h.channels
    if each <= 48:
        return ALLOCATIONS["d" if h.rate == 32000 else "c"]
    return ALLOCATIONS["a" if each <= 80 or h.rate == 48000 else "b"]


def covered_bits(body: bytes, h: Header) -> int | None:
    """How many bits behind the checksum it covers, besides the header's last 16; None if they are cut off."""
    if h.layer == 3:
        return 8 * h.side
    if h.layer == 1:
        return 4 * (min(h.bound, 32) * h.channels + (32 - h.bound if h.bound < 32 else 0))
    bits, at, used = int.from_bytes(body, "big"), 8 * len(body), 0
    band = 0
    for subbands, wide in _allocation(h):
        for _ in range(subbands):
            shared = h.channels == 2 and band >= h.bound
            for _ in range(1 if shared else h.channels):
                at -= wide
                if at < 0:
                    return None
                # What both channels share is selected for each.
                used += (bits >> at & (1 << wide) - 1 != 0) * (2 if shared else 1)
            band += 1
    return 8 * len(body) - at + 2 * used


def _bit_checksum(head: bytes, body: bytes, n_bits: int) -> int:
    """The checksum of two bytes and the first bits of a body."""
    crc, whole = 0xFFFF, n_bits // 8
    crc = checksum(head + body[:whole])
    for i in range(n_bits % 8):
        bit = (body[whole] >> 7 - i & 1) ^ (crc >> 15)
        crc = (crc << 1 & 0xFFFF) ^ (0x8005 if bit else 0)
    return crc


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _frame(index: int) -> bytes:
    """Header, checksum and empty side information of a 48 kHz mono frame."""
    head = bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC0])
    side = bytes(17)
    return head + checksum(head[2:] + side).to_bytes(2, "big") + side


_STARTS = [b""] + [_frame(i) for i in range(1, 15)]
_BODIES = [0] + [3 * k - _OVERHEAD for k in KBITS[1, 3]]


def write_audio(payload: bytes, n_bytes: int) -> bytes:
    """The payload as an MPEG stream; ``n_bytes`` of it are not padding."""
    frames, full = [], _BODIES[14]
    for at in range(0, len(payload), full):
        part = payload[at : at + full]
        index = next(i for i in range(1, 15) if _BODIES[i] >= len(part))
        frames.append(_STARTS[index] + part.ljust(_BODIES[index], b"\0"))
    table = 3 * KBITS[1, 3][7]
    total = table + sum(map(len, frames))
    offsets, at = [], table
    for f in frames:
        offsets.append(at)
        at += len(f)
    toc = bytes(min(255, offsets[i * len(frames) // 100] * 256 // total) for i in range(100))
    xing = _STARTS[8] + b"Xing" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + toc + (0).to_bytes(4, "big")
    body = b""
    for name, value in (("payload_bytes", len(payload)), ("text_bytes", n_bytes)):
        text = b"\x03" + name.encode() + b"\0" + str(value).encode()
        body += b"TXXX" + _syncsafe(len(text)) + b"\0\0" + text
    return b"ID3\x04\0\0" + _syncsafe(len(body)) + body + xing.ljust(table, b"\0") + b"".join(frames)


@dataclass
class Audio:
    """What a stream holds. ``offsets``: of the sound frames, tables excluded."""

    tags: dict[str, str] = field(default_factory=dict)
    version: float | None = None
    layer: int | None = None
    rate: int | None = None
    channels: int | None = None
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    bits: set[int] = field(default_factory=set)
    checked: int = 0
    bad_checksums: int = 0
    resyncs: int = 0
    skipped: int = 0
    table: str | None = None
    table_frames: int | None = None
    table_bytes: int | None = None
    toc: bytes | None = None
    table_fits: bool | None = None
    bodies: list[tuple[int, int]] = field(default_factory=list)

    def seek(self, sample: int) -> int | None:
        """The offset of the frame that holds a sample."""
        per = self.samples // len(self.offsets) if self.offsets else 0
        return self.offsets[sample // per] if per and 0 <= sample < self.samples else None


def _tag(data: bytes) -> tuple[int, dict[str, str]]:
    """The size of an ID3v2 tag at the start and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    safe = lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end = min(len(data), 10 + safe(data[6:10]))
    at, tags = 10, {}
    if data[3] < 3:
        return end, tags
    if data[5] & 0x40 and at + 4 <= end:
        at += safe(data[10:14]) if data[3] == 4 else 4 + int.from_bytes(data[10:14], "big")
    while at + 10 <= end and data[at] and data[at : at + 4].isalnum():
        name = data[at : at + 4].decode("latin-1")
        size = safe(data[at + 4 : at + 8]) if data[3] == 4 else int.from_bytes(data[at + 4 : at + 8], "big")
        text = data[at + 10 : min(end, at + 10 + size)]
        if name[0] == "T" and text:
            said = text[1:].decode(["latin-1", "utf-16", "utf-16-be", "utf-8"][min(text[0], 3)], "replace")
            key, _, value = said.partition("\0") if name == "TXXX" else (name, "", said)
            tags[key] = value.strip("\0")
        at += 10 + size
    return end + (10 if data[5] & 0x10 else 0), tags


def _find(data: bytes, at: int, end: int, like: Header | None) -> int:
    """The next place whose header is valid and followed by another or the end."""
    while (at := data.find(b"\xff", at, end)) >= 0:
        h = parse_header(data[at : at + 4])
        if h and at + h.size <= end and (like is None or (h.version, h.layer, h.rate) == (like.version, like.layer, like.rate)):
            after = at + h.size
            if after + 4 > end or parse_header(data[after : after + 4]) or like is not None and _sound(data, at, h):
                return at
        at += 1
    return end


def _sound(data: bytes, at: int, h: Header) -> bool | None:
    """Whether a frame's checksum holds; None if it has none."""
    if not h.protected:
        return None
    start = at + 6
    # The longest cover is layer II's: 30 subbands of two channels.
    body = data[start : min(at + h.size, start + 64)]
    n_bits = covered_bits(body, h)
    if n_bits is None or n_bits > 8 * len(body):
        return False
    return _bit_checksum(data[at + 2 : at + 4], body, n_bits) == int.from_bytes(data[at + 4 : start], "big")


def parse_audio(data: bytes | None) -> Audio | None:
    """Parse a whole stream; see the module's text."""
    if data is None:
        return None
    found = Audio()
    at, found.tags = _tag(data)
    end = len(data)
    if end - at >= 128 and data[-128:-125] == b"TAG":
        end -= 128
        found.tags.setdefault("TIT2", data[end + 3 : end + 33].decode("latin-1").strip("\0 "))
    start, like, first = at, None, True
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        if h is None or at + h.size > end or like is not None and (h.version, h.layer, h.rate) != (like.version, like.layer, like.rate):
            to = _find(data, at + (h is not None), end, like)
            found.resyncs += 1
            found.skipped += to - at
            at = to
            continue
        if (good := _sound(data, at, h)) is not None:
            found.checked += 1
            found.bad_checksums += not good
        body = at + 4 + 2 * h.protected + h.side
        if first:
            like = h
            found.version, found.layer, found.rate, found.channels = h.version, h.layer, h.rate, h.channels
        if first and _table(data, at, body, h, found, start):
            first = False
            at += h.size
            continue
        first = False
        found.offsets.append(at)
        found.bodies.append((body, at + h.size))
        found.samples += h.samples
        found.bits.add(h.kbits)
        at += h.size
    if found.table:
        found.table_fits = found.table_frames in (None, len(found.offsets)) and found.table_bytes in (None, end - start)
    return found


def _table(data: bytes, at: int, body: int, h: Header, found: Audio, start: int) -> bool:
    """Read the Xing, Info or VBRI table of a first frame, if it has one."""
    number = lambda p: int.from_bytes(data[p : p + 4], "big")
    if (name := data[body : body + 4]) in (b"Xing", b"Info"):
        flags, p = number(body + 4), body + 8
        if flags & 1:
            found.table_frames, p = number(p), p + 4
        if flags & 2:
            found.table_bytes, p = number(p), p + 4
        if flags & 4:
            found.toc, p = data[p : p + 100], p + 100
    elif data[at + 36 : at + 40] == b"VBRI":
        name = b"VBRI"
        found.table_bytes, found.table_frames = number(at + 46), number(at + 50)
    else:
        return False
    found.table = name.decode()
    return True


def read_payload(data: bytes, audio: Audio) -> bytes | None:
    """The payload that ``write_audio`` stored; None if the stream isn't one of its own."""
    sizes = [audio.tags.get(name, "") for name in ("payload_bytes", "text_bytes")]
    if not all(x.isascii() and x.isdecimal() for x in sizes):
        return None
    payload = b"".join(data[a:b] for a, b in audio.bodies)[: int(sizes[0])]
    return payload if len(payload) == int(sizes[0]) >= int(sizes[1]) else None


def feature(audio: Audio) -> str:
    """A stream's facts in one line; the seek offsets by their crc32."""
    seek = zlib.crc32(b"".join(o.to_bytes(8, "little") for o in audio.offsets))
    return (
        f"mpeg{audio.version or 0:g} layer{audio.layer} {audio.rate}Hz ch{audio.channels} frames={len(audio.offsets)} samples={audio.samples} "
        f"kbits={min(audio.bits, default=0)}-{max(audio.bits, default=0)} table={audio.table}:{audio.table_fits} "
        f"crc={audio.checked - audio.bad_checksums}/{audio.checked} resyncs={audio.resyncs} seek={seek:08x}"
    )


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's UTF-8 bytes, padded to a positive multiple of 64, and their number."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return raw + bytes(-len(raw) % PAYLOAD_UNIT or (0 if raw else PAYLOAD_UNIT)), len(raw)


#: Rows handled at once, so that long texts don't add up.
_ROWS = 256


def write_media(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``media``: the written table of the streams."""

    def write(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                media = [write_audio(*payload_of(t)) for t in column(batch, "text")]
                yield pa.RecordBatch.from_arrays([pa.array(column(batch, "doc_id"), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "media"])

    docs = documents.select(F.col("doc_id").cast("long"), common.text_or_empty().alias("text"))
    return common.write_table(docs.mapInArrow(write, "doc_id long, media binary"), "media")


_PARSED = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, "
    "frames long, duration_samples long, sample_rate int, seek_offsets array<long>"
)


def parse_media(media: DataFrame) -> DataFrame:
    """Facts, digests, exact duration and seek offsets of any streams; see the module's text for foreign ones."""

    def parse(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                out = []
                for d, data in zip(*(column(whole.slice(at, _ROWS), c) for c in ("doc_id", "media"))):
                    if data is None:
                        out.append((d, *[None] * (len(_PARSED_NAMES) - 1)))
                        continue
                    audio = parse_audio(data)
                    payload = read_payload(data, audio)
                    own = (None,) * 4 if payload is None else (int(audio.tags["text_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-PAYLOAD_UNIT:]))
                    out.append((d, *own, len(data), hashlib.sha256(data).hexdigest(), feature(audio), len(audio.offsets), audio.samples, audio.rate, audio.offsets))
                columns = list(zip(*out))
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _PARSED_TYPES)], _PARSED_NAMES)

    return media.select("doc_id", "media").mapInArrow(parse, _PARSED)


_PARSED_NAMES = [x.split()[0] for x in _PARSED.split(", ")]
_L, _S = pa.int64(), pa.string()
_PARSED_TYPES = [_L, _L, _L, _S, _L, _L, _S, _S, _L, _L, pa.int32(), pa.list_(_L)]


def op10_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return parse_media(write_media(common.read(spark, sf_dir, "documents"))).drop("seek_offsets")
