"""MPEG streams: round trips, damage, foreign streams and edge rows."""

import hashlib
import random
import zlib

from codexflow.llm import media


def test_payloads_come_back_whole():
    rng = random.Random(1)
    for n in (0, 1, 63, 64, 65, 936, 937, 938, 5000, 200_000):
        text = "".join(rng.choice("aé\n\xff 日") for _ in range(n))
        payload, size = media.payload_of(text)
        assert len(payload) % 64 == 0 and len(payload) >= 64 and payload[:size].decode() == text
        audio = media.parse_audio(data := media.write_audio(payload, size))
        assert media.read_payload(data, audio) == payload
        assert audio.table == "Xing" and audio.table_fits and not audio.bad_checksums and not audio.resyncs
        assert audio.samples == 1152 * len(audio.offsets) and audio.checked == len(audio.offsets) + 1
        assert audio.seek(audio.samples - 1) == audio.offsets[-1] and audio.seek(audio.samples) is None
        for percent in range(0, 100, 9):
            at = audio.offsets[percent * len(audio.offsets) // 100]
            assert abs(audio.toc[percent] * audio.table_bytes / 256 - (at - 71)) <= audio.table_bytes / 256 + 100


def test_resync_after_damage_and_checksums():
    payload, size = media.payload_of("x" * 9000)
    data = media.write_audio(payload, size)
    whole = media.parse_audio(data)
    third = whole.offsets[3]
    broken = media.parse_audio(data[:third] + b"\xff\xfa junk \xff" * 5 + data[third:] + b"TAG" + b"name".ljust(125, b"\0"))
    assert len(broken.offsets) == len(whole.offsets) and broken.resyncs == 1 and broken.skipped == 45 and broken.tags["TIT2"] == "name"
    flipped = bytearray(data)
    flipped[third + 7] ^= 1
    assert media.parse_audio(bytes(flipped)).bad_checksums == 1
    cut = media.parse_audio(data[: whole.offsets[-1] + 5])
    assert len(cut.offsets) == len(whole.offsets) - 1 and cut.table_fits is False


def test_headers_and_foreign_bytes():
    h = media.parse_header(bytes([0xFF, 0xFB, 0x90, 0x00]))
    assert (h.size, h.samples, h.rate, h.kbits, h.side) == (417, 1152, 44100, 128, 32)
    h = media.parse_header(bytes([0xFF, 0xF3, 0x82, 0xC0]))
    assert (h.version, h.size, h.samples) == (2, 209, 576)
    assert media.parse_header(b"\xff\xff\xf0\0") is None and media.parse_header(b"ab") is None
    assert media.parse_audio(None) is None and media.parse_audio(b"").offsets == [] and media.parse_audio(b"\xff" * 999).samples == 0


def test_table_of_media(spark):
    rows = [(1, "a" * 70), (1, "a" * 70), (None, "é"), (3, None), (4, ""), (5, "long " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as media", "2 as frames")
    got = sorted(media.parse_media(media.write_media(df)).collect(), key=str)
    want = []
    for d, t in rows:
        p, n = media.payload_of(t)
        want.append((d, n, len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    assert sorted([tuple(r[:5]) for r in got], key=str) == sorted(want, key=str)
    assert len({(r.media_sha256, r.feature) for r in got if r.doc_id in (1, 3, 4)}) == 2
    assert media.parse_media(media.write_media(df.limit(0))).count() == 0


def _crc(bits):
    """CRC-16 bit by bit, told apart from the module's."""
    crc = 0xFFFF
    for bit in bits:
        top = crc >> 15 & 1
        crc = crc << 1 & 0xFFFF
        if top ^ bit:
            crc ^= 0x8005
    return crc


def _bits(data):
    return [b >> i & 1 for b in data for i in range(7, -1, -1)]


def _frame(layer, index, rate, mode, extension, rng, version=3):
    """A protected frame with random allocations, as the standard lays them out."""
    head = bytes([0xFF, 0xE0 | version << 3 | (4 - layer) << 1, index << 4 | rate << 2, mode << 6 | extension << 4])
    h = media.parse_header(head)
    bound = 4 * (extension + 1) if mode == 1 else 32
    bits = []
    if layer == 1:
        for band in range(32):
            for _ in range(1 if mode == 3 or band >= bound else 2):
                bits += [rng.randint(0, 1) for _ in range(4)]
    elif layer == 2:
        widths = [n for many, n in (((4, 4), (7, 3), (19, 2)) if version != 3 else media._allocation(h)) for _ in range(many)]
        chosen = []
        for band, wide in enumerate(widths):
            shared = mode == 1 and band >= bound
            for _ in range(1 if mode == 3 or shared else 2):
                some = [rng.randint(0, 1) for _ in range(wide)]
                bits += some
                chosen += [any(some)] * (2 if shared else 1)
        for _ in range(sum(chosen)):
            bits += [rng.randint(0, 1), rng.randint(0, 1)]
    else:
        bits = [rng.randint(0, 1) for _ in range(8 * h.side)]
    crc = _crc(_bits(head[2:]) + bits)
    body = bits + [0] * (-len(bits) % 8)
    raw = bytes(int("".join(map(str, body[i : i + 8])), 2) for i in range(0, len(body), 8))
    return (head + crc.to_bytes(2, "big") + raw).ljust(h.size, b"\0")


def test_streams_that_were_not_written_here():
    rng = random.Random(5)
    for layer, index, rate, mode, extension, version in (
        (1, 10, 0, 0, 0, 3), (1, 10, 1, 1, 1, 3), (1, 9, 0, 3, 0, 3), (2, 8, 0, 0, 0, 3), (2, 10, 1, 1, 2, 3), (2, 2, 2, 3, 0, 3), (2, 12, 0, 1, 0, 3),
        (2, 8, 0, 1, 1, 2), (3, 9, 0, 1, 2, 3), (3, 9, 1, 3, 0, 2), (3, 5, 0, 0, 0, 0),
    ):
        frames = [_frame(layer, index, rate, mode, extension, rng, version) for _ in range(9)]
        text = b"\x00" + b"A title"
        tag = b"TIT2" + len(text).to_bytes(4, "big") + b"\0\0" + text
        stream = b"ID3\x03\0\0" + bytes([0, 0, 0, len(tag)]) + tag + b"".join(frames[:4]) + b"junk\xff\xfbjunk" + b"".join(frames[4:])
        found = media.parse_audio(stream)
        assert (found.layer, len(found.offsets), found.checked, found.bad_checksums) == (layer, 9, 9, 0), (layer, mode, found)
        assert found.tags == {"TIT2": "A title"} and found.skipped == 10 and found.resyncs == 1
        bad = bytearray(stream)
        bad[found.offsets[2] + 6] ^= 0x80
        # A flipped allocation bit is seen wherever the frame's length stays the same.
        assert media.parse_audio(bytes(bad)).bad_checksums == 1
    first = bytearray(_frame(3, 9, 0, 0, 0, rng))
    frames = [_frame(3, 9, 0, 0, 0, rng) for _ in range(5)]
    size = len(first) + sum(map(len, frames))
    first[36:54] = b"VBRI\0\1\0\0\0d" + size.to_bytes(4, "big") + (5).to_bytes(4, "big")
    found = media.parse_audio(bytes(first) + b"".join(frames))
    assert (found.table, found.table_frames, found.table_bytes, found.table_fits, len(found.offsets)) == ("VBRI", 5, size, True, 5)


def test_foreign_null_and_odd_media_as_a_table(spark):
    rng = random.Random(6)
    foreign = b"".join(_frame(2, 8, 0, 0, 0, rng) for _ in range(3))
    own = media.write_audio(*media.payload_of("some text"))
    rows = [(1, own), (2, foreign), (3, None), (4, b""), (5, b"no audio at all"), (None, own[:200]), (7, own.replace(b"payload_bytes\x0064", b"payload_bytes\x00xx"))]
    df = spark.createDataFrame(rows, "doc_id long, media binary").selectExpr("*", "1 as frames", "'f' as feature")
    got = {r.doc_id: r for r in media.parse_media(df).collect()}
    assert got[1].n_bytes == 9 and got[1].payload_bytes == 64
    assert (got[2].frames, got[2].duration_samples, got[2].payload_bytes, got[2].media_bytes) == (3, 3456, None, len(foreign))
    assert all(v is None for k, v in got[3].asDict().items() if k != "doc_id")
    assert got[4].frames == got[5].frames == 0 and got[4].payload_sha256 is None and got[7].payload_sha256 is None
    assert media.parse_media(df.limit(0)).count() == 0
