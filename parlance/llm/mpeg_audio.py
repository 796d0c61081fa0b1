"""MPEG audio media columns: frames that carry payload bytes, and a reader for such streams.

``read_stream`` walks any MPEG-1/2/2.5 Layer I-III stream: it reads the text frames of an ID3v2 tag
(undoing unsynchronisation, past an extended header and a footer), finds the first frame by two agreeing
headers, follows frame lengths, resynchronises after damage, reads a Xing/Info or VBRI table, verifies the
CRC-16 of protected frames of all layers and gives exact durations and the byte offset of every frame.

``write_stream`` stores bytes losslessly: each protected Layer III frame (48 kHz, mono, 224 kbit/s)
has silent side information and carries 576 payload bytes as ancillary data; an ID3v2 tag holds the
unpadded length and a first Xing frame the frame count, byte count and seek table.

Edge cases: a null or empty text is a payload of 576 bytes 255; repeated rows give equal values;
rows are independent, so an empty table gives an empty one; other columns are ignored;
damaged bytes between frames are counted in ``skipped``, a cut last frame is not a frame.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stored

UNIT = 576  # payload bytes of a frame
PAD = b"\xff"

# Fixed values of the MPEG audio standards, that results depend on: kbit/s by bitrate index, Hz by version, samples a frame.
KBITS = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
HERTZ = {1.0: (44100, 48000, 32000), 2.0: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SAMPLES = {(1, 1): 384, (1, 2): 1152, (1, 3): 1152, (2, 1): 384, (2, 2): 1152, (2, 3): 576}
SIDE_INFO = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}  # Layer III: by version and mono
# Layer II: bits of the allocation of each subband, as (subbands, bits), by allocation table
ALLOCATION = {"a": ((11, 4), (12, 3), (4, 2)), "b": ((11, 4), (12, 3), (7, 2)), "c": ((2, 4), (6, 3)), "d": ((2, 4), (10, 3)), "low": ((4, 4), (7, 3), (19, 2))}
# End of fixed values.


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    kbits: int
    hertz: int
    mono: bool
    samples: int
    length: int
    side: int
    checked_bits: int  # bits after the checksum that it covers; for Layer II those of the bit allocation

    @property
    def kind(self) -> tuple[float, int, int]:
        return self.version, self.layer, self.hertz

    @property
    def body(self) -> int:
        return 4 + 2 * self.protected + self.side


def _allocation(family: int, kbits: int, hertz: int, mono: bool) -> list[int]:
    """Bits of each subband's allocation in a Layer II frame."""
    each = kbits // (1 if mono else 2)
    if family == 2:
        table = "low"
    elif each <= 48:
        table = "d" if hertz == 32000 else "c"
    else:
        table = "b" if each > 80 and hertz != 48000 else "a"
    return [bits for n, bits in ALLOCATION[table] for _ in range(n)]


def _checked_bits(family: int, layer: int, kbits: int, hertz: int, mode: int, extension: int) -> int:
    """Bits after the checksum that it covers (mode 1 is joint stereo, 3 mono); Layer II's scale factor selection comes on top."""
    mono = mode == 3
    if layer == 3:
        return 8 * SIDE_INFO[family, mono]
    widths = [4] * 32 if layer == 1 else _allocation(family, kbits, hertz, mono)
    bound = 0 if mono else min(4 * (extension + 1), len(widths)) if mode == 1 else len(widths)  # subbands with two channels of their own
    return 2 * sum(widths[:bound]) + sum(widths[bound:])


@lru_cache(4096)
def parse_header(word: bytes) -> Header | None:
    """The header in four bytes, or None where they are none (free format is not followed)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = {0: 2.5, 2: 2.0, 3: 1.0}.get(word[1] >> 3 & 3), {1: 3, 2: 2, 3: 1}.get(word[1] >> 1 & 3)
    rate, hz = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer is None or rate in (0, 15) or hz == 3:
        return None
    family = 1 if version == 1.0 else 2
    kbits, hertz, padded, mono = KBITS[family, layer][rate], HERTZ[version][hz], word[2] >> 1 & 1, word[3] >> 6 == 3
    samples = SAMPLES[family, layer]
    length = (12000 * kbits // hertz + padded) * 4 if layer == 1 else samples // 8 * 1000 * kbits // hertz + padded
    return Header(version, layer, not word[1] & 1, kbits, hertz, mono, samples, length, SIDE_INFO[family, mono] if layer == 3 else 0, _checked_bits(family, layer, kbits, hertz, word[3] >> 6, word[3] >> 4 & 3))


def _crc_table() -> list[int]:
    table = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = (x << 1) ^ (0x8005 if x & 0x8000 else 0)
        table.append(x & 0xFFFF)
    return table


_CRC = _crc_table()


@lru_cache(4096)
def crc16(data: bytes) -> int:
    """The audio frame checksum: polynomial 8005, start value FFFF."""
    x = 0xFFFF
    for byte in data:
        x = (x << 8 & 0xFF00) ^ _CRC[x >> 8 ^ byte]
    return x


def _crc_bits(x: int, data: bytes, start: int, bits: int) -> int:
    """Continues the checksum ``x`` with ``bits`` bits of ``data`` from bit ``start``."""
    for i in range(start, start + bits):
        bit = data[i >> 3] >> (7 - (i & 7)) & 1
        x = (x << 1 & 0xFFFF) ^ (0x8005 if (x >> 15) ^ bit else 0)
    return x


def _selected(body: bytes, mode: int, extension: int, widths: list[int]) -> int:
    """Bits of the scale factor selection of a Layer II frame: two for each subband and channel with samples."""
    at = found = 0
    bound = 4 * (extension + 1) if mode == 1 else len(widths)
    for band, width in enumerate(widths):
        channels = 1 if mode == 3 else 2
        for _ in range(channels if band < bound else 1):
            value = int.from_bytes(body[at >> 3 : (at >> 3) + 2], "big") >> (16 - (at & 7) - width) & ((1 << width) - 1)
            at += width
            found += 2 * bool(value) * (1 if band < bound else channels)
    return found


def checksum(frame: bytes, h: Header) -> int:
    """The checksum that a protected frame should have."""
    bits = h.checked_bits
    if h.layer == 2:
        mode, extension = frame[3] >> 6, frame[3] >> 4 & 3
        bits += _selected(frame[6:], mode, extension, _allocation(1 if h.version == 1.0 else 2, h.kbits, h.hertz, h.mono))
    whole = bits // 8
    return _crc_bits(crc16(frame[2:4] + frame[6 : 6 + whole]), frame, 8 * (6 + whole), bits - 8 * whole)


@dataclass
class Stream:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of audio frames, the table frame left out
    headers: list[Header] = field(default_factory=list)
    samples: int = 0
    micros: int = 0  # exact duration, rounded down
    checked: int = 0
    failed: int = 0
    skipped: int = 0  # bytes that belong to no frame or tag
    table: dict[str, object] = field(default_factory=dict)


def _synchsafe(raw: bytes) -> int:
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(reversed(raw)))


def _id3v2(data: bytes, out: Stream) -> int:
    """Reads a tag at the start; returns where it ends."""
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    major, flags = data[3], data[5]
    end = min(10 + _synchsafe(data[6:10]), len(data))
    tag = data[10:end]
    if flags & 0x80 and major < 4:  # a zero byte follows each 255; version 4 marks it frame by frame
        tag = tag.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and len(tag) >= 4 and major in (3, 4):  # an extended header; its size counts itself in version 4 only
        at = _synchsafe(tag[:4]) if major == 4 else 4 + struct.unpack(">I", tag[:4])[0]
    while at + 10 <= len(tag) and tag[at] != 0 and major in (3, 4):
        name, raw, how = tag[at : at + 4].decode("latin-1"), tag[at + 4 : at + 8], tag[at + 9]
        length = struct.unpack(">I", raw)[0] if major == 3 else _synchsafe(raw)
        body = tag[at + 10 : at + 10 + length]
        if major == 4 and how & 1:  # a length that was meant for readers of unsynchronised frames
            body = body[4:]
        if major == 4 and (how & 2 or flags & 0x80):
            body = body.replace(b"\xff\0", b"\xff")
        if name[0] == "T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            key, _, value = text.partition("\0") if name == "TXXX" else (name, "", text)
            out.tags[key] = value
        at += 10 + length
    return min(end + (10 if flags & 0x10 and major == 4 else 0), len(data))


def _table(data: bytes, at: int, h: Header) -> dict[str, object]:
    """The Xing/Info or VBRI table of a frame, empty where it has none."""
    x = at + h.body
    if data[x : x + 4] not in (b"Xing", b"Info"):
        x = at + 4 + h.side
    if data[x : x + 4] in (b"Xing", b"Info"):
        flags, found, x = struct.unpack(">I", data[x + 4 : x + 8])[0], {"kind": data[x : x + 4].decode()}, x + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                found[name], x = struct.unpack(">I", data[x : x + 4])[0], x + 4
        if flags & 4:
            found["seek"], x = list(data[x : x + 100]), x + 100
        if flags & 8:
            found["quality"] = struct.unpack(">I", data[x : x + 4])[0]
        return found
    x = at + 36
    if data[x : x + 4] == b"VBRI" and at + h.length >= x + 26:
        _, _, quality, size, frames, entries, scale, width, per = struct.unpack(">HHHIIHHHH", data[x + 4 : x + 26])
        seek = [int.from_bytes(data[x + 26 + width * i : x + 26 + width * (i + 1)], "big") * scale for i in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "quality": quality, "seek": seek, "per_entry": per}
    return {}


def _agrees(data: bytes, at: int, h: Header) -> bool:
    """Whether another frame of the same kind, or the end or a closing tag, follows a frame."""
    nxt = at + h.length
    if nxt == len(data) or data[nxt : nxt + 3] == b"TAG":
        return True
    follow = parse_header(data[nxt : nxt + 4])
    return follow is not None and follow.kind == h.kind


def read_stream(data: bytes) -> Stream:
    out = Stream()
    at, end, kind, per_kind = _id3v2(data, out), len(data), None, {}
    closing = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else -1
    synced, first = False, True
    while at + 4 <= end:
        if at == closing:  # an ID3v1 tag; inside a frame these letters are audio
            out.tags.setdefault("TIT2", data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1"))
            end = at
            break
        h = parse_header(data[at : at + 4])
        cut = h is not None and at < closing < at + h.length and not _agrees(data, at, h)
        if h is None or cut or at + h.length > end or (kind and h.kind != kind) or (not synced and not _agrees(data, at, h)):
            synced = False
            nxt = data.find(b"\xff", at + 1, end)
            nxt = end if nxt < 0 else nxt
            if at < closing < nxt:
                nxt = closing
            out.skipped += nxt - at
            at = nxt
            continue
        synced, kind = True, h.kind
        if h.protected:
            out.checked += 1
            out.failed += checksum(data[at : at + h.length], h) != struct.unpack(">H", data[at + 4 : at + 6])[0]
        if first and h.layer == 3 and (table := _table(data, at, h)):
            out.table = table
        else:
            out.offsets.append(at)
            out.headers.append(h)
            per_kind[h.hertz] = per_kind.get(h.hertz, 0) + h.samples
        first = False
        at += h.length
    out.skipped += max(0, end - at)
    out.samples = sum(per_kind.values())
    out.micros = sum(n * 1_000_000 // hz for hz, n in per_kind.items())
    return out


# ---------------------------------------------------------------- writing

_WORD = bytes([0xFF, 0xFA, 0xC4, 0xC0])  # MPEG-1 Layer III, protected, 224 kbit/s, 48 kHz, mono
_FRAME = parse_header(_WORD)
_HEAD = _WORD + struct.pack(">H", crc16(_WORD[2:] + bytes(_FRAME.side))) + bytes(_FRAME.side)
_TAIL = bytes(_FRAME.length - len(_HEAD) - UNIT)


def padded(text: bytes) -> bytes:
    """Bytes 255 are appended up to a positive multiple of UNIT."""
    return text + PAD * (-len(text) % UNIT or (0 if text else UNIT))


def write_stream(payload: bytes, n_bytes: int) -> bytes:
    """A stream whose frames hold ``payload``, a positive multiple of UNIT bytes."""
    frames = [_HEAD + payload[i : i + UNIT] + _TAIL for i in range(0, len(payload), UNIT)]
    size = (len(frames) + 1) * _FRAME.length
    seek = bytes(min(255, 256 * (_FRAME.length * (1 + len(frames) * p // 100)) // size) for p in range(100))
    table = b"Xing" + struct.pack(">III", 7, len(frames), size) + seek
    first = _HEAD + table + bytes(_FRAME.length - len(_HEAD) - len(table))
    body = b"\0n_bytes\0" + str(n_bytes).encode()
    tag = b"TXXX" + struct.pack(">IH", len(body), 0) + body
    head = b"ID3\x03\0\0" + bytes(len(tag) >> s & 0x7F for s in (21, 14, 7, 0))
    return b"".join([head, tag, first, *frames])


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The ancillary bytes that ``write_stream`` put into the frames."""
    return b"".join(data[at + h.body : at + h.body + UNIT] for at, h in zip(stream.offsets, stream.headers, strict=True))


def feature(stream: Stream) -> str:
    offsets = zlib.crc32(struct.pack(f"<{len(stream.offsets)}Q", *stream.offsets))
    agree = stream.table.get("frames") == len(stream.offsets)
    return f"frames={len(stream.offsets)};samples={stream.samples};us={stream.micros};crc={stream.checked - stream.failed}/{stream.checked};skipped={stream.skipped};table={int(agree)};seek={offsets:08x}"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, last, data, offs in slices(batch["text"]):
            media = pa.array([write_stream(padded(x), len(x)) for x in (data[a:b].tobytes() for a, b in zip(offs[:-1], offs[1:], strict=True))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), media], ["doc_id", "media"])


SCHEMA = "doc_id long, n_bytes long, media binary, payload binary, frames long, samples long, duration_us long, frame_offsets array<long>, crc_checked long, crc_failed long, skipped long, feature string"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.int64(), pa.string()]
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    for batch in batches:
        for first, last, whole, offs in slices(batch["media"]):
            rows = []
            for a, b in zip(offs[:-1], offs[1:], strict=True):
                data = whole[a:b].tobytes()
                s = read_stream(data)
                size = s.tags.get("n_bytes", "")
                rows.append((int(size) if size.isdigit() else None, data, payload_of(data, s), len(s.offsets), s.samples, s.micros, s.offsets, s.checked, s.failed, s.skipped, feature(s)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"].slice(first, last - first), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)


def media_table(docs: DataFrame) -> DataFrame:
    """(doc_id, media): the text of each row as an audio stream, written to the shared folder."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return stored(docs.mapInArrow(_write, "doc_id long, media binary"), "media")


def media_features(media: DataFrame) -> DataFrame:
    """Parses a media column (doc_id, media): payload, durations, seek offsets and checks (SCHEMA)."""
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(_read, SCHEMA)
