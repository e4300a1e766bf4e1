"""MPEG audio as a media column: lossless payloads in Layer III frames, and a parser.

The writer stores a payload as a stream of MPEG-1 Layer III frames (48 kHz,
stereo, CRC-protected): an ID3v2 tag with the payload's length and checksum, an
``Xing`` frame with the variable-bitrate table, then frames whose side
information is silent and whose main data are the payload's bytes. Bitrates
are chosen frame by frame, the smallest that holds what is left.

The parser works on any Layer I to III stream: it skips ID3 tags, looks for
two consistent frame headers in a row to synchronise, at the start and again
after damage (a last frame must end where the stream does), reads
``Xing``/``Info`` and ``VBRI`` headers, verifies the CRC-16 of Layer I and III
frames (that of Layer II covers a part whose length needs its allocation
tables: such frames are counted as unchecked), and reports exact durations
(samples over rate, as a fraction) and the byte offset of every frame for seeking.

Null texts are empty; an empty text is one block of 64 zero bytes; equal texts
give equal media; rows without an id keep none, repeated rows are treated
alike, other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from assaybook.llm.common import stored, utf8

# Fixed values of the MPEG audio standards: kbit/s by version and layer, Hz by version.
BITRATES = {
    (1, 1): (32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
BITRATES[2, 3] = BITRATES[2, 2]
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
_VERSIONS = {0: 2.5, 2: 2, 3: 1}
UNIT = 64


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The frames' check word: polynomial 0x8005, start 0xFFFF."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass(frozen=True)
class Header:
    version: float
    layer: int
    protected: bool
    bitrate: int
    rate: int
    padded: bool
    mode: int
    extension: int

    @property
    def mono(self) -> bool:
        return self.mode == 3

    @property
    def kind(self) -> tuple:
        """What all frames of a stream have in common."""
        return self.version, self.layer, self.rate

    @property
    def samples(self) -> int:
        return 384 if self.layer == 1 else 576 if self.layer == 3 and self.version != 1 else 1152

    @property
    def size(self) -> int:
        if self.layer == 1:
            return (12_000 * self.bitrate // self.rate + self.padded) * 4
        return self.samples // 8 * 1000 * self.bitrate // self.rate + self.padded

    @property
    def side(self) -> int:
        """Bytes of side information, Layer III only."""
        if self.layer != 3:
            return 0
        return (17 if self.mono else 32) if self.version == 1 else (9 if self.mono else 17)

    @property
    def checked(self) -> int | None:
        """Bytes after the check word that it covers; None for Layer II."""
        if self.layer == 1:
            # four bits of allocation a subband and channel; in joint stereo, one for both from the bound on
            bound = 4 * (self.extension + 1) if self.mode == 1 else 32
            return 16 if self.mono else (bound * 8 + (32 - bound) * 4) // 8
        return self.side if self.layer == 3 else None


def parse_header(word: bytes) -> Header | None:
    """The header in four bytes, or None: no sync, a reserved value, or free format."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = _VERSIONS.get(word[1] >> 3 & 3), 4 - (word[1] >> 1 & 3)
    bitrate, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer == 4 or bitrate in (0, 15) or rate == 3 or word[3] & 3 == 2:
        return None
    return Header(version, layer, not word[1] & 1, BITRATES[1 if version == 1 else 2, layer][bitrate - 1], RATES[version][rate], bool(word[2] & 2), word[3] >> 6, word[3] >> 4 & 3)


@dataclass
class Parsed:
    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    vbr: dict | None = None
    bad_crc: int = 0
    unchecked: int = 0
    resyncs: int = 0
    skipped: int = 0

    @property
    def duration(self) -> Fraction:
        """Seconds, exact. The frame that only holds the variable-bitrate table doesn't count."""
        return sum((Fraction(h.samples, h.rate) * n for h, n in self._kinds()), Fraction(0))

    def _kinds(self):
        counted: dict[Header, int] = {}
        for h in self.headers:
            counted[h] = counted.get(h, 0) + 1
        return counted.items()


def _syncsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def _to_syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def parse_id3(data: bytes) -> tuple[int, dict[str, str]]:
    """Length of an ID3v2 tag at the start (0: none), and its text frames."""
    if data[:3] != b"ID3" or len(data) < 10 or any(b & 0x80 for b in data[6:10]):
        return 0, {}
    major, end, at, found = data[3], 10 + _syncsafe(data[6:10]), 10, {}
    while at + 10 <= min(end, len(data)) and data[at] and major in (3, 4):
        name = data[at : at + 4].decode("latin-1")
        size = _syncsafe(data[at + 4 : at + 8]) if major == 4 else struct.unpack(">I", data[at + 4 : at + 8])[0]
        body = data[at + 10 : at + 10 + size]
        if name.startswith("T") and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").rstrip("\0")
            key, _, value = text.partition("\0")
            found[f"TXXX:{key}" if name == "TXXX" else name] = value if name == "TXXX" else text
        at += 10 + size
    return end + 10 * bool(data[5] & 0x10), found


def _vbr(frame: bytes, h: Header) -> dict | None:
    at = 4 + 2 * h.protected + h.side
    if h.layer == 3 and frame[at : at + 4] in (b"Xing", b"Info"):
        flags = struct.unpack(">I", frame[at + 4 : at + 8])[0]
        out, p = {"kind": frame[at : at + 4].decode()}, at + 8
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name] = struct.unpack(">I", frame[p : p + 4])[0]
                p += 4
        if flags & 4:
            out["toc"] = tuple(frame[p : p + 100])
        return out
    if frame[36:40] == b"VBRI":
        size, frames = struct.unpack(">II", frame[46:54])
        return {"kind": "VBRI", "bytes": size, "frames": frames}
    return None


def parse(data: bytes) -> Parsed:
    """Tags, frames, table and damage of a stream of bytes."""
    out = Parsed()
    at, out.tags = parse_id3(data)
    end = len(data) - 128 if data[-128:-125] == b"TAG" else len(data)
    if end != len(data):
        out.tags["ID3v1"] = data[-125:-95].split(b"\0")[0].decode("latin-1")
    synced, like = False, None
    while at + 4 <= end:
        h = parse_header(data[at : at + 4])
        good = h is not None and at + h.size <= end
        if good and synced:
            good = h.kind == like
        elif good:
            # out of step: believe a header only if another of its kind stands where it says, or the stream ends there
            follow = parse_header(data[at + h.size : min(at + h.size + 4, end)])
            good = follow.kind == h.kind if follow else at + h.size == end and like in (None, h.kind)
        if not good:
            out.resyncs += synced
            synced = False
            step = data.find(b"\xff", at + 1, end)
            out.skipped += (step if step >= 0 else end) - at
            at = step if step >= 0 else end
            continue
        synced, like = True, h.kind
        if h.protected and h.checked is None:
            out.unchecked += 1
        elif h.protected:
            out.bad_crc += crc16(data[at + 2 : at + 4] + data[at + 6 : at + 6 + h.checked]) != struct.unpack(">H", data[at + 4 : at + 6])[0]
        table = _vbr(data[at : at + h.size], h) if not out.headers and out.vbr is None else None
        if table:
            out.vbr = table
        else:
            out.offsets.append(at)
            out.headers.append(h)
        at += h.size
    return out


# The writer's stream: MPEG-1 Layer III, protected, 48 kHz, stereo.
_LEAD = bytes((0xFF, 0xFA))
_SIDE = bytes(32)


def _make_head(index: int) -> bytes:
    word = bytes((index + 1 << 4 | 1 << 2, 0))
    return _LEAD + word + struct.pack(">H", crc16(word + _SIDE)) + _SIDE


_HEADS = tuple(_make_head(i) for i in range(14))
_SIZES = tuple(144_000 * b // 48_000 for b in BITRATES[1, 3])
_ROOM = tuple(s - len(_HEADS[0]) for s in _SIZES)


def padded(text) -> tuple[bytes, int]:
    """UTF-8 of the text with zero bytes up to a positive multiple of 64, and its own length."""
    raw = utf8(text)
    return raw + bytes((-len(raw)) % UNIT or (UNIT if not raw else 0)), len(raw)


def _text_frame(description: str, value: str) -> bytes:
    body = b"\x00" + description.encode() + b"\x00" + value.encode()
    return b"TXXX" + _to_syncsafe(len(body)) + b"\x00\x00" + body


def write(payload: bytes, unpadded: int) -> bytes:
    """The payload as an MPEG audio stream."""
    frames, sizes, at, largest = [], [], 0, _ROOM[-1]
    while at < len(payload):
        left = len(payload) - at
        k = 13 if left >= largest else next(i for i, room in enumerate(_ROOM) if room >= left)
        part = payload[at : at + _ROOM[k]]
        frames.append(_HEADS[k] + part + bytes(_ROOM[k] - len(part)))
        sizes.append(_SIZES[k])
        at += _ROOM[k]
    audio = b"".join(frames)
    table = 9  # 160 kbit/s: room for the table
    total = len(audio) + _SIZES[table]
    # equal frames but the last: entry i is where i percent of the frames have passed
    toc = bytes(min(255, (_SIZES[table] + sum(sizes[:1]) * (len(sizes) * i // 100)) * 256 // total) for i in range(100))
    xing = b"Xing" + struct.pack(">III", 7, len(frames), total) + toc
    tag = _text_frame("payload_bytes", str(len(payload))) + _text_frame("unpadded_bytes", str(unpadded)) + _text_frame("payload_crc32", f"{zlib.crc32(payload):08x}")
    return b"ID3\x04\x00\x00" + _to_syncsafe(len(tag)) + tag + (_HEADS[table] + xing).ljust(_SIZES[table], b"\0") + audio


def read(media: bytes) -> tuple[bytes, Parsed]:
    """Payload and structure of a stream made by ``write``; raises if anything was damaged."""
    found = parse(media)
    if found.resyncs or found.bad_crc:
        raise ValueError(f"damaged stream: {found.resyncs} resynchronisations, {found.bad_crc} wrong frame checksums")
    if not found.vbr or found.vbr["frames"] != len(found.offsets):
        raise ValueError("the stream's frames are not those of its table")
    payload = b"".join([media[o + 4 + 2 + h.side : o + h.size] for o, h in zip(found.offsets, found.headers, strict=True)])[: int(found.tags["TXXX:payload_bytes"])]
    if f"{zlib.crc32(payload):08x}" != found.tags["TXXX:payload_crc32"]:
        raise ValueError("the payload's checksum differs")
    return payload, found


def feature(found: Parsed) -> str:
    """Exact duration, frames, mean bitrate and the seek offsets' digest, as text."""
    seconds = found.duration
    offsets = struct.pack(f"<{len(found.offsets)}Q", *found.offsets)
    bits = 8 * sum(h.size for h in found.headers)
    return f"seconds={seconds.numerator}/{seconds.denominator};frames={len(found.offsets)};bitrate={bits * seconds.denominator // seconds.numerator if seconds else 0};seek={zlib.crc32(offsets):08x};vbr={found.vbr['kind'] if found.vbr else '-'}"


SCHEMA = "doc_id long, media binary, n_bytes long"


def store_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, media``: each text as an MPEG audio stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            media = [write(*padded(x.as_py())) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col)).mapInArrow(run, "doc_id long, media binary")


def media_features(media: DataFrame) -> DataFrame:
    """What the stored streams hold, read back: payload digests, sizes, exact duration, frame offsets."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "seek_offsets"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item in batch.column(1):
                data = item.as_py()
                payload, found = read(data)
                rows.append((int(found.tags["TXXX:unpadded_bytes"]), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(found), found.offsets))
            columns = list(zip(*rows, strict=True)) or [()] * 8
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, k) for c, k in zip(columns, kinds[1:], strict=True))], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seek_offsets array<long>")


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The media column is written to the shared folder and read back."""
    media = stored(store_media(spark.read.parquet(f"{sf_dir}/documents.parquet")), "media")
    return media_features(media).drop("seek_offsets")
