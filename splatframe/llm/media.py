"""MPEG audio columns: store bytes as audio frames, and probe any MPEG audio stream.

``encode_media`` stores a text as a playable MPEG-1 Layer III stream (32 kHz, mono):
an ID3v2 tag, a frame holding the variable-bitrate table, one silent frame after
another whose ancillary bytes carry the text, and an ID3v1 tag. Every audio frame
is protected by its CRC-16. ``probe_media`` works on any stream: it steps over tags,
resynchronises on frame headers, checks the frames' checksums, reads the
variable-bitrate table, and yields the exact duration and the offset of each frame.

Both are row-wise, so neither shuffles, and a lost task is simply run again.

Defined results: a null or empty text is stored as 64 zero bytes. A null stream, and
one without a frame, has zero frames and a zero duration. Repeated rows are
treated alike; other columns are kept, whatever their names. Frames of the free
format (bitrate index 0) are no frames here. Checksums are verified in all three layers.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructType

from .common import by_chunk, numbered, quoted, with_field

# Fixed values of the MPEG audio format: kbit/s by bitrate index 1 to 14, and Hz.
KBPS = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}

#: Payloads are padded with zero bytes to a multiple of this.
UNIT = 64
_SIDE = 17  # bytes of side information of a mono MPEG-1 Layer III frame
_HEAD = 4 + 2 + _SIDE  # header, checksum, side information
_RATE_INDEX = 2  # 32 kHz: every frame length is then a whole number of bytes
_LENGTHS = [144 * k * 1000 // 32000 for k in KBPS[1, 3]]


def _crc_table() -> list[int]:
    table = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1) ^ 0x8005 if c & 0x8000 else c << 1
        table.append(c & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(maxsize=4096)
def crc16(data: bytes) -> int:
    """The checksum of MPEG audio frames: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = ((c << 8) & 0xFFFF) ^ _CRC[(c >> 8) ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbps: int
    hertz: int
    channels: int
    mode: int
    extension: int
    length: int
    samples: int

    @property
    def side(self) -> int:
        """Bytes of side information (Layer III)."""
        if self.version == 1:
            return 17 if self.channels == 1 else 32
        return 9 if self.channels == 1 else 17


@lru_cache(maxsize=65536)
def header(four: bytes) -> Header | None:
    """The frame header in these four bytes, or None if they are no header."""
    if len(four) < 4 or four[0] != 0xFF or four[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get((four[1] >> 3) & 3)
    layer = {1: 3, 2: 2, 3: 1}.get((four[1] >> 1) & 3)
    rate, hz = four[2] >> 4, (four[2] >> 2) & 3
    if version is None or layer is None or rate in (0, 15) or hz == 3 or four[3] & 3 == 2:
        return None
    kbps, hertz, pad = KBPS[1 if version == 1 else 2, layer][rate - 1], HERTZ[version][hz], (four[2] >> 1) & 1
    if layer == 1:
        samples, length = 384, (12 * kbps * 1000 // hertz + pad) * 4
    else:
        samples = 576 if layer == 3 and version != 1 else 1152
        length = samples // 8 * kbps * 1000 // hertz + pad
    mode = four[3] >> 6
    return Header(version, layer, not four[1] & 1, kbps, hertz, 1 if mode == 3 else 2, mode, (four[3] >> 4) & 3, length, samples)


def _header_bytes(rate: int, protected: bool) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, rate << 4 | _RATE_INDEX << 2, 0xC0))


def _frame_start(rate: int) -> bytes:
    """Header, checksum and side information (all zero: silence) of a frame."""
    four = _header_bytes(rate, True)
    return four + struct.pack(">H", crc16(four[2:] + bytes(_SIDE))) + bytes(_SIDE)


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 0x7F for s in (21, 14, 7, 0))


def pad_payload(data: bytes) -> bytes:
    """*data* and zero bytes up to a positive multiple of ``UNIT``."""
    return data + bytes(max(UNIT, -(-len(data) // UNIT) * UNIT) - len(data))


def encode(payload: bytes) -> bytes:
    """An MPEG audio stream that carries *payload* in its frames' ancillary bytes."""
    room = _LENGTHS[-1] - _HEAD
    full, rest = divmod(len(payload), room)
    body = np.empty((full, _LENGTHS[-1]), np.uint8)
    body[:, :_HEAD] = np.frombuffer(_frame_start(14), np.uint8)
    body[:, _HEAD:] = np.frombuffer(payload, np.uint8, full * room).reshape(full, room)
    parts, offsets = [body.tobytes()], [i * _LENGTHS[-1] for i in range(full)]
    if rest:
        rate = next(i for i, n in enumerate(_LENGTHS) if n - _HEAD >= rest)
        offsets.append(full * _LENGTHS[-1])
        parts.append((_frame_start(rate + 1) + payload[full * room :]).ljust(_LENGTHS[rate], b"\0"))
    table_length = _LENGTHS[0]
    total = table_length + sum(map(len, parts))
    toc = bytes(min(255, (offsets[i * len(offsets) // 100] + table_length) * 256 // total) for i in range(100)) if offsets else bytes(100)
    table = (_header_bytes(1, False) + bytes(_SIDE) + b"Xing" + struct.pack(">III", 15, len(offsets), total) + toc + struct.pack(">I", 100)).ljust(table_length, b"\0")
    milliseconds = len(offsets) * 1152 * 1000 // 32000
    frames = b"".join(
        name + struct.pack(">IH", len(text) + 1, 0) + b"\0" + text
        for name, text in ((b"TLEN", b"%d" % milliseconds), (b"TXXX", b"payload_bytes\0%d" % len(payload)), (b"TXXX", b"payload_crc32\0%08x" % zlib.crc32(payload)))
    )
    return b"".join((b"ID3\3\0\0", _synchsafe(len(frames)), frames, table, *parts, b"TAG".ljust(127, b"\0") + b"\xff"))


@dataclass
class Probe:
    """What a stream holds. ``offsets`` are those of the audio frames, the table's frame left out."""

    frames: int = 0
    samples: int = 0
    hertz: int = 0
    layer: int = 0
    channels: int = 0
    min_kbps: int = 0
    max_kbps: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0
    vbr: str = ""
    vbr_frames: int = -1
    vbr_bytes: int = -1
    vbr_seeks: list[int] = field(default_factory=list)
    offsets: list[int] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    damaged: list[int] = field(default_factory=list)


def _text(raw: bytes) -> str:
    kind, raw = raw[:1], raw[1:]
    return raw.decode({b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be"}.get(kind, "utf-8"), "replace").rstrip("\0")


def _read_id3v2(data: bytes, at: int, tags: dict[str, str]) -> int:
    """Where the ID3v2 tag at *at* ends; its text frames go to *tags*."""
    major, flags = data[at + 3], data[at + 5]
    size = 0
    for b in data[at + 6 : at + 10]:
        size = size << 7 | b & 0x7F
    end = at + 10 + size
    body = data[at + 10 : end]
    if flags & 0x80:
        body = body.replace(b"\xff\0", b"\xff")
    p, wide = 0, 6 if major == 2 else 10
    if flags & 0x40 and len(body) >= 4 and major > 2:
        p = int.from_bytes(body[:4], "big") + 4 if major == 3 else int.from_bytes(body[:4], "big")
    while p + wide <= len(body) and body[p]:
        if major == 2:
            name, n = body[p : p + 3], int.from_bytes(body[p + 3 : p + 6], "big")
        else:
            name, raw = body[p : p + 4], body[p + 4 : p + 8]
            n = sum((b & 0x7F) << s for b, s in zip(raw, (21, 14, 7, 0), strict=True)) if major == 4 else int.from_bytes(raw, "big")
        value = body[p + wide : p + wide + n]
        if name[:1] == b"T" and value:
            text = _text(value)
            if name in (b"TXXX", b"TXX"):
                key, _, text = text.partition("\0")
                tags[f"TXXX:{key}"] = text
            else:
                tags[name.decode("latin-1")] = text
        p += wide + n
    return min(len(data), end + 10 * bool(flags & 0x10))


def _tail(data: bytes, tags: dict[str, str]) -> int:
    """Where the audio ends: before ID3v1 and APE tags."""
    end = len(data)
    if end >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        for key, a, b in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93)):
            if text := data[end + a : end + b].rstrip(b"\0 ").decode("latin-1"):
                tags[f"ID3v1:{key}"] = text
    if end >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        size, flags = struct.unpack("<I4xI", data[end - 20 : end - 8])
        end = max(0, end - size - 32 * bool(flags >> 31))
    return end


def _allocation_bits(h: Header) -> tuple[int, ...]:
    """Bits of the allocation of each subband of a Layer II frame."""
    if h.version != 1:
        return (4,) * 4 + (3,) * 7 + (2,) * 19
    per = h.kbps // h.channels
    if per < 56:
        return (4,) * 2 + (3,) * (10 if h.hertz == 32000 else 6)
    return (4,) * 11 + (3,) * 12 + (2,) * (7 if per >= 96 and h.hertz != 48000 else 4)


def _checksum_2(frame: bytes, h: Header) -> bool:
    """Of a Layer II frame: its checksum covers the header, the allocations, and two bits for each subband and channel that has one."""
    bits = "".join(f"{b:08b}" for b in frame[6:46])
    widths = _allocation_bits(h)
    bound = 4 * (h.extension + 1) if h.mode == 1 else len(widths)
    n, selects = 0, 0
    for band, width in enumerate(widths):
        for _ in range(h.channels if band < bound else 1):
            if "1" in bits[n : n + width]:
                selects += 1 if band < bound else h.channels
            n += width
    n += 2 * selects
    if n > len(bits):
        return False
    crc = crc16(frame[2:4] + frame[6 : 6 + n // 8])
    for bit in bits[n // 8 * 8 : n]:
        crc = (crc << 1 ^ (0x8005 if (crc >> 15) ^ int(bit) else 0)) & 0xFFFF
    return crc == int.from_bytes(frame[4:6], "big")


def _checksum(data: bytes, at: int, h: Header) -> bool:
    """Whether the frame's checksum is right."""
    if h.layer == 3:
        n = h.side
    elif h.layer == 1:
        bound = 32 if h.mode != 1 else 4 * (h.extension + 1)
        n = (bound * h.channels + 32 - bound) // 2 if h.channels == 2 else 16
    else:
        return _checksum_2(data[at : at + h.length], h)
    return crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + n]) == int.from_bytes(data[at + 4 : at + 6], "big")


def _vbr(data: bytes, at: int, h: Header, out: Probe) -> bool:
    """Reads a Xing, Info or VBRI table from the frame at *at*, if it has one."""
    p = at + 4 + h.side
    for p in (p, p + 2):
        if data[p : p + 4] in (b"Xing", b"Info"):
            out.vbr = data[p : p + 4].decode()
            flags, p = int.from_bytes(data[p + 4 : p + 8], "big"), p + 8
            if flags & 1:
                out.vbr_frames, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 2:
                out.vbr_bytes, p = int.from_bytes(data[p : p + 4], "big"), p + 4
            if flags & 4:
                total = max(0, out.vbr_bytes)
                out.vbr_seeks = [at + b * total // 256 for b in data[p : p + 100]]
            return True
    p = at + 36
    if data[p : p + 4] == b"VBRI" and len(data) >= p + 26:
        out.vbr = "VBRI"
        out.vbr_bytes, out.vbr_frames, entries, scale, wide = struct.unpack(">IIHHH", data[p + 10 : p + 24])
        seek, q = at + h.length, p + 26
        for _ in range(entries):
            out.vbr_seeks.append(seek)
            seek, q = seek + int.from_bytes(data[q : q + wide], "big") * scale, q + wide
        return True
    return False


def _same(a: Header, b: Header | None) -> bool:
    return b is not None and (a.version, a.layer, a.hertz) == (b.version, b.layer, b.hertz)


def probe(data: bytes) -> Probe:
    """Finds the frames of *data*, whatever stands around or between them."""
    out, at, end = Probe(), 0, 0
    end = _tail(data, out.tags)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        at = _read_id3v2(data, at, out.tags)
    last: Header | None = None
    while at + 4 <= end:
        h = header(data[at : at + 4])
        # A header counts if another follows where its frame ends, or the audio ends there;
        # in step with the frame before it, it also counts ahead of damage.
        fits = h is not None and at + h.length <= end
        if fits and not (last and _same(last, h)):
            fits = at + h.length == end or _same(h, header(data[at + h.length : at + h.length + 4]))
        if not fits:
            last, step = None, data.find(b"\xff", at + 1, end)
            step = end if step < 0 else step
            out.skipped, at = out.skipped + step - at, step
            continue
        if h.layer == 3 and not out.frames and not out.vbr and _vbr(data, at, h, out):
            last, at = h, at + h.length
            continue
        if h.protected:
            out.checked += 1
            if not _checksum(data, at, h):
                out.failed += 1
                out.damaged.append(at)
        if not out.frames:
            out.hertz, out.layer, out.channels, out.min_kbps = h.hertz, h.layer, h.channels, h.kbps
        out.frames, out.samples = out.frames + 1, out.samples + h.samples
        out.min_kbps, out.max_kbps = min(out.min_kbps, h.kbps), max(out.max_kbps, h.kbps)
        out.offsets.append(at)
        last, at = h, at + h.length
    out.skipped += max(0, end - at)
    return out


def payload(data: bytes, found: Probe) -> bytes:
    """The bytes that ``encode`` stored, taken from the frames and checked against the tag."""
    parts = []
    for at in found.offsets:
        h = header(data[at : at + 4])
        parts.append(data[at + 4 + 2 * h.protected + h.side : at + h.length])
    stored = b"".join(parts)[: int(found.tags.get("TXXX:payload_bytes", 0))]
    if f"{zlib.crc32(stored):08x}" != found.tags.get("TXXX:payload_crc32"):
        raise ValueError("the stream's payload doesn't have the checksum in its tag")
    return stored


def feature(found: Probe) -> str:
    """A line that tells layer, rates, frames, exact duration, checksums and seek points."""
    seeks = zlib.crc32(np.array(found.offsets, "<i8").tobytes())
    return (
        f"layer={found.layer};hz={found.hertz};channels={found.channels};kbps={found.min_kbps}-{found.max_kbps};frames={found.frames};"
        f"duration={found.samples}/{found.hertz or 1};crc={found.checked - found.failed}/{found.checked};skipped={found.skipped};"
        f"vbr={found.vbr}:{found.vbr_frames}:{found.vbr_bytes};seeks={len(found.offsets)}:{seeks:08x}"
    )


_PROBE = pa.struct(
    [
        ("frames", pa.int64()), ("samples", pa.int64()), ("hertz", pa.int32()), ("seconds", pa.float64()), ("layer", pa.int32()), ("channels", pa.int32()),
        ("min_kbps", pa.int32()), ("max_kbps", pa.int32()), ("crc_checked", pa.int64()), ("crc_failed", pa.int64()), ("skipped_bytes", pa.int64()),
        ("vbr", pa.string()), ("vbr_frames", pa.int64()), ("vbr_bytes", pa.int64()), ("offsets", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string())), ("feature", pa.string()),
        ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()),
    ]
)
PROBE_DDL = (
    "struct<frames:bigint,samples:bigint,hertz:int,seconds:double,layer:int,channels:int,min_kbps:int,max_kbps:int,crc_checked:bigint,crc_failed:bigint,skipped_bytes:bigint,"
    "vbr:string,vbr_frames:bigint,vbr_bytes:bigint,offsets:array<bigint>,tags:map<string,string>,feature:string,"
    "payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,media_bytes:bigint,media_sha256:string>"
)


def _describe(data: bytes | None, stored: bool) -> dict:
    data = data or b""
    found = probe(data)
    out = {
        "frames": found.frames, "samples": found.samples, "hertz": found.hertz, "seconds": found.samples / found.hertz if found.hertz else 0.0, "layer": found.layer, "channels": found.channels,
        "min_kbps": found.min_kbps, "max_kbps": found.max_kbps, "crc_checked": found.checked, "crc_failed": found.failed, "skipped_bytes": found.skipped,
        "vbr": found.vbr, "vbr_frames": found.vbr_frames, "vbr_bytes": found.vbr_bytes, "offsets": found.offsets, "tags": list(found.tags.items()), "feature": feature(found),
        "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
    }
    if stored:
        back = payload(data, found)
        out |= {"payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-UNIT:])}
    return out


def _others(df: DataFrame, *names: str) -> DataFrame:
    """*df* without the columns *names*."""
    taken = {n.lower() for n in names}
    return df.select(*(F.col(quoted(c)) for c in df.columns if c.lower() not in taken))


def encode_media(df: DataFrame, text: str = "text", media: str = "media") -> DataFrame:
    """Column *media* (in place of one of that name): the stream that stores the UTF-8 bytes of column *text*, padded."""

    df = _others(df, media)
    k = df.columns.index(text)

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([encode(pad_payload(x or b"")) for x in batch.column(k).cast(pa.binary()).to_pylist()], pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, "made"])

    rows = numbered(df)
    return rows.mapInArrow(by_chunk(make, 512), with_field(rows, "made", BinaryType())).toDF(*df.columns, media)


def probe_media(df: DataFrame, media: str = "media", into: str = "probe", stored: bool = True) -> DataFrame:
    """Column *into* (in place of one of that name), a struct of all that ``probe`` finds in column *media*, which is dropped.

    With *stored* the streams are ``encode_media``'s, and what they carry is read back and digested.
    """

    def make(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = pa.array([_describe(x, stored) for x in batch.column(batch.num_columns - 1).to_pylist()], _PROBE)
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], made], [*batch.schema.names[:-1], "made"])

    kept = _others(df, media, into)
    kind = StructType.fromDDL(f"probe {PROBE_DDL}").fields[0].dataType
    rows = numbered(df.select(*(F.col(quoted(c)) for c in kept.columns), F.col(quoted(media))))
    return rows.mapInArrow(by_chunk(make, 512), with_field(numbered(kept), "made", kind)).toDF(*kept.columns, into)


def documents_as_media(documents: DataFrame) -> DataFrame:
    """Each document stored as MPEG audio and read back; see the module's docstring for nulls and empty texts."""
    rows = documents.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"))
    rows = probe_media(encode_media(rows).drop("text"))
    kept = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "frames", "samples", "hertz", "seconds", "offsets", "crc_checked", "crc_failed"]
    return rows.select("doc_id", "n_bytes", *(F.col(f"probe.{c}").alias(c) for c in kept))
