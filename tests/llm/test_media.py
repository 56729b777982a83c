import hashlib
import struct
import zlib
from collections import Counter

import pytest

from splatframe.llm import media

from . import cases


def frame(rate=9, fill=b"\1", protected=False):
    four = bytes((0xFF, 0xFA if protected else 0xFB, rate << 4 | 2 << 2, 0xC0))
    h = media.header(four)
    side = bytes(h.side)
    crc = struct.pack(">H", media.crc16(four[2:] + side)) if protected else b""
    return (four + crc + side).ljust(h.length, fill)


def test_header_values():
    h = media.header(bytes((0xFF, 0xFB, 0x90, 0x00)))
    assert (h.version, h.layer, h.kbps, h.hertz, h.length, h.samples, h.channels) == (1, 3, 128, 44100, 417, 1152, 2)
    assert media.header(bytes((0xFF, 0xF3, 0x40, 0xC0))).samples == 576
    assert media.header(bytes((0xFF, 0xFF, 0x10, 0x00))).layer == 1
    for bad in (b"", b"\xff\xfb\x00\x00", b"\xff\xfb\xf0\x00", b"\xff\xfb\x9c\x00", b"\xff\xeb\x90\x00", b"\x7f\xfb\x90\x00"):
        assert media.header(bad) is None


@pytest.mark.parametrize("n", [0, 1, 63, 64, 1417, 1418, 5000, 200_000])
def test_round_trip(n):
    data = media.pad_payload((bytes(range(256)) * (n // 256 + 1))[:n])
    stream = media.encode(data)
    found = media.probe(stream)
    assert media.payload(stream, found) == data and found.skipped == 0 and found.failed == 0
    assert found.checked == found.frames == found.vbr_frames == len(found.offsets)
    assert found.samples == 1152 * found.frames and found.vbr == "Xing"
    assert all(media.header(stream[o : o + 4]) for o in found.offsets)
    assert found.vbr_bytes == len(stream) - 128 - (10 + int.from_bytes(stream[9:10], "big") + 128 * stream[8])


def test_resynchronises_and_counts_damage():
    good = [frame(fill=b"\2") for _ in range(4)]
    junk = b"\xff\xfb\x90 not a frame \xff"
    found = media.probe(junk + good[0] + good[1] + junk + good[2] + good[3] + b"\xff\xfb\x90\xc4half a frame")
    assert found.frames == 4 and found.samples == 4 * 1152
    assert found.offsets == [len(junk), len(junk) + len(good[0]), 2 * len(junk) + 2 * len(good[0]), 2 * len(junk) + 3 * len(good[0])]
    assert found.skipped == 2 * len(junk) + len(b"\xff\xfb\x90\xc4half a frame")


def test_checksums_are_verified():
    frames = [bytearray(frame(protected=True)) for _ in range(3)]
    frames[1][8] ^= 1
    found = media.probe(b"".join(frames))
    assert (found.checked, found.failed) == (3, 1) and found.damaged == [len(frames[0])]


@pytest.mark.parametrize(
    ("second", "third", "fourth", "allocations", "selects"),
    [
        (0xFC, 4 << 4 | 1 << 2, 0xC0, 88, 54),  # 48 kHz, mono, 64 kbit/s: 27 subbands
        (0xFC, 10 << 4, 0x00, 188, 120),  # 44.1 kHz, stereo, 192 kbit/s: 30 subbands
        (0xFC, 10 << 4, 0x40, 110, 120),  # the same, joint from subband 4
        (0xFC, 1 << 4, 0xC0, 26, 16),  # 44.1 kHz, mono, 32 kbit/s: 8 subbands
        (0xFC, 1 << 4 | 2 << 2, 0xC0, 38, 24),  # 32 kHz: 12 subbands
        (0xF4, 8 << 4, 0xC0, 75, 60),  # MPEG-2
    ],
)
def test_checksums_of_layer_2(second, third, fourth, allocations, selects):
    four = bytes((0xFF, second, third, fourth))
    h = media.header(four)
    assert h.layer == 2 and h.protected

    def made(allocation, covered):
        body = allocation * allocations + "10" * 200
        crc = 0xFFFF
        for bit in f"{third:08b}{fourth:08b}" + body[:covered]:
            crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
        body = body[: len(body) // 8 * 8]
        return bytearray((four + struct.pack(">H", crc) + int(body, 2).to_bytes(len(body) // 8, "big"))[: h.length].ljust(h.length, b"\1"))

    for allocation, covered in (("1", allocations + selects), ("0", allocations)):
        good, bad, after = (made(allocation, covered) for _ in range(3))
        bad[6 + (covered - 1) // 8] ^= 0x80 >> (covered - 1) % 8
        after[6 + covered // 8] ^= 0x80 >> covered % 8
        found = media.probe(bytes(good + bad + after)) if allocation == "1" else media.probe(bytes(good + after))
        assert (found.frames, found.checked, found.failed) == ((3, 3, 1) if allocation == "1" else (2, 2, 0))


def test_vbri_and_tags():
    first = bytearray(frame())
    first[36 : 36 + 30] = b"VBRI" + struct.pack(">HHHIIHHHH", 1, 0, 75, 4 * len(first), 4, 2, 1, 2, 2) + struct.pack(">HH", len(first), len(first))
    tag = b"ID3\4\0\0\0\0\0\x11" + b"TIT2\0\0\0\7\0\0\3titled"
    found = media.probe(tag + bytes(first) + frame() * 4 + b"TAG" + b"song".ljust(125, b"\0"))
    assert found.vbr == "VBRI" and found.vbr_frames == 4 and found.frames == 4
    assert found.vbr_seeks == [len(tag) + len(first), len(tag) + 2 * len(first)] == found.offsets[:2]
    assert found.tags["TIT2"] == "titled" and found.tags["ID3v1:title"] == "song"


def test_nothing_to_find():
    for data in (b"", b"\xff" * 500, b"ID3", bytes(1000)):
        found = media.probe(data)
        assert found.frames == 0 and found.samples == 0
    stream = bytearray(media.encode(media.pad_payload(b"hello")))
    stream[-128 - 144 + 23] ^= 255
    with pytest.raises(ValueError):
        media.payload(bytes(stream), media.probe(bytes(stream)))


def test_query(spark):
    docs = cases.documents(spark)
    got = Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) for r in media.documents_as_media(docs).collect())
    want = Counter()
    for r in docs.collect():
        data = (r.text or "").encode()
        padded = data + bytes(-len(data) % 64 or (64 if not data else 0))
        stream = media.encode(padded)
        want[r.doc_id, len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]), len(stream), hashlib.sha256(stream).hexdigest()] += 1
    assert got == want
    assert media.documents_as_media(cases.empty(spark)).count() == 0


def test_any_stream_column(spark):
    df = spark.createDataFrame([(1, bytearray(frame() * 2), "kept"), (2, None, None)], "id int, clip binary, probe string")
    rows = {r.id: r for r in media.probe_media(df, "clip", "found", stored=False).collect()}
    assert rows[1].found.frames == 2 and rows[1].found.seconds == 2 * 1152 / 32000 and rows[1].probe == "kept"
    assert rows[2].found.frames == 0 and rows[2].found.offsets == []


def test_durations_and_seek_offsets_are_in_the_rows(spark):
    docs = cases.documents(spark)
    rows = {r.doc_id: r for r in media.documents_as_media(docs).collect()}
    for r in docs.where("doc_id is not null").collect():
        stream = media.encode(media.pad_payload((r.text or "").encode()))
        got = rows[r.doc_id]
        assert len(got.offsets) == got.frames and got.seconds == got.frames * 1152 / 32000
        assert all(media.header(stream[at : at + 4]) is not None for at in got.offsets)


def test_names_that_need_quotes(spark):
    df = spark.createDataFrame([(1, "some text", "x", "y")], "id bigint, `te``xt` string, `a``b c` string, Media string")
    out = media.probe_media(media.encode_media(df, "te`xt"))
    assert out.columns == ["id", "te`xt", "a`b c", "probe"] and out.first().probe.payload_bytes == 64
