"""MPEG audio as a media column: write byte payloads as a variable-bitrate stream, and read streams back frame by frame.

Reading resynchronises on frame headers, parses ID3v2 and ID3v1 tags and the Xing or VBRI table of a variable bitrate, verifies the CRC-16 of
protected layer III frames (those of layers I and II are passed over), and gives exact durations (samples over rate) and the byte offset of every frame.

A stored payload is the main data of MPEG-1 layer III frames, one byte for each 8 bits, at 48 kHz mono, where a frame has exactly three
bytes for each kbit/s of bitrate: frames of the largest bitrate, then smaller ones for the rest. What a frame has beyond the payload is
zero ancillary data; the ID3v2 tag carries the payload's length.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import slices, table, text_bytes

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by index for (version 1, layer I, II, III) and (version 2, layer I, II and III), Hz.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (2, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {1: (44100, 48000, 32000), 2: (22050, 24000, 16000), 2.5: (11025, 12000, 8000)}
SIDE = {(1, False): 32, (1, True): 17, (2, False): 17, (2, True): 9}  # layer III side information by (version, mono)
MULTIPLE = 192


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


def crc16(data: bytes) -> int:
    """The frame checksum: polynomial 0x8005, start 0xFFFF, high bit first."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


@dataclass
class Frame:
    offset: int
    size: int
    version: float
    layer: int
    bitrate: int
    rate: int
    mono: bool
    protected: bool
    samples: int


@dataclass
class Stream:
    """What a stream says: frames without the table frame, tags, the table, checksum failures, and bytes skipped to find sync."""

    frames: list[Frame] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    table: dict = field(default_factory=dict)
    bad_checksums: int = 0
    skipped: int = 0

    @property
    def duration(self) -> tuple[int, int]:
        """Samples and their rate: the exact duration is their quotient."""
        return sum(f.samples for f in self.frames), self.frames[0].rate if self.frames else 0


def header(data: bytes, at: int) -> Frame | None:
    """The frame whose header is at `at`, if there is a valid one."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    b1, b2, b3 = data[at + 1], data[at + 2], data[at + 3]
    version, layer = {0: 2.5, 2: 2, 3: 1}.get(b1 >> 3 & 3), {1: 3, 2: 2, 3: 1}.get(b1 >> 1 & 3)
    if version is None or layer is None or b2 >> 4 in (0, 15) or b2 >> 2 & 3 == 3 or b3 & 3 == 2:
        return None
    bitrate, rate, pad = BITRATES[1 if version == 1 else 2, layer][b2 >> 4], RATES[version][b2 >> 2 & 3], b2 >> 1 & 1
    samples = 384 if layer == 1 else 1152 if layer == 2 or version == 1 else 576
    size = (12_000 * bitrate // rate + pad) * 4 if layer == 1 else samples // 8 * 1000 * bitrate // rate + pad
    return Frame(at, size, version, layer, bitrate, rate, b3 >> 6 == 3, not b1 & 1, samples)


def _synchsafe(b: bytes) -> int:
    return b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]


def parse(data: bytes | None) -> Stream:
    """Read a stream. Null, empty and foreign bytes give a stream without frames; a cut last frame isn't counted."""
    out, data = Stream(), data or b""
    at, end = 0, len(data)
    if data[:3] == b"ID3" and end >= 10:
        stop, at = min(end, 10 + _synchsafe(data[6:10])), 10
        while at + 10 <= stop and data[at] and data[3] >= 3:
            size = _synchsafe(data[at + 4 : at + 8]) if data[3] >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : min(stop, at + 10 + size)]
            name = data[at : at + 4].decode("latin-1")
            if body and name[0] == "T":
                out.tags[name] = body[1:].decode({1: "utf-16", 2: "utf-16-be", 3: "utf-8"}.get(body[0], "latin-1"), "replace").rstrip("\0")
            at += 10 + size
        at = stop
    if end - at >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
        out.tags.setdefault("TIT2", data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1"))
    first = True
    while at < end:
        f = header(data, at)
        alike = f and out.frames and all(getattr(f, k) == getattr(out.frames[-1], k) for k in ("version", "layer", "rate", "mono", "protected"))
        sure = f and at + f.size <= end and (at + f.size == end or header(data, at + f.size) or alike)
        if not sure:
            to = data.find(b"\xff", at + 1, end)  # resynchronise on the next possible header
            to = end if to < 0 else to
            out.skipped += to - at
            at = to
            continue
        body = at + 4 + 2 * f.protected
        side = SIDE[1 if f.version == 1 else 2, f.mono] if f.layer == 3 else 0
        if f.protected and f.layer == 3 and int.from_bytes(data[at + 4 : at + 6], "big") != crc16(data[at + 2 : at + 4] + data[body : body + side]):
            out.bad_checksums += 1
        mark = data[body + side : body + side + 4]
        if first and f.layer == 3 and mark in (b"Xing", b"Info"):
            out.table = _table(data[body + side : at + f.size])
        elif first and f.layer == 3 and data[at + 36 : at + 40] == b"VBRI":
            # After the mark: version, delay and quality in two bytes each, then bytes and frames in four each.
            out.table = {"bytes": int.from_bytes(data[at + 46 : at + 50], "big"), "frames": int.from_bytes(data[at + 50 : at + 54], "big")}
        else:
            out.frames.append(f)
        first = False
        at += f.size
    return out


def _table(data: bytes) -> dict:
    """Flags, frames, bytes, seek points and quality of a Xing table."""
    flags, at, out = int.from_bytes(data[4:8], "big"), 8, {"kind": data[:4].decode()}
    for bit, name in ((1, "frames"), (2, "bytes")):
        if flags & bit:
            out[name] = int.from_bytes(data[at : at + 4], "big")
            at += 4
    if flags & 4:
        out["seek"] = list(data[at : at + 100])
        at += 100
    if flags & 8:
        out["quality"] = int.from_bytes(data[at : at + 4], "big")
    return out


#: 48 kHz, MPEG-1 layer III, protected, mono: the header of each bitrate, and how many payload bytes its frame takes.
_OVERHEAD = 4 + 2 + 17


def _head(index: int) -> bytes:
    return bytes((0xFF, 0xFA, index << 4 | 0x04, 0xC0))


_SIZES = [(i, 3 * r - _OVERHEAD) for i, r in enumerate(BITRATES[1, 3]) if r]
_FULL, _ROOM = _SIZES[-1]
#: Head, checksum and empty side information of each bitrate's frame.
_LEAD = {i: _head(i) + crc16(_head(i)[2:] + bytes(17)).to_bytes(2, "big") + bytes(17) for i, _ in _SIZES}


def stored(payload: bytes) -> bytes:
    """The payload as a stream of its own: an ID3v2 tag with its length, a Xing table, then frames that hold it in order."""
    frames = [(_FULL, payload[a : a + _ROOM]) for a in range(0, len(payload) - len(payload) % _ROOM, _ROOM)]
    rest = payload[len(frames) * _ROOM :]
    if rest:
        frames.append((next(i for i, room in _SIZES if room >= len(rest)), rest))
    room = dict(_SIZES)
    body = b"".join(_LEAD[i] + p.ljust(room[i], b"\0") for i, p in frames)
    text = b"\x03payload\0" + str(len(payload)).encode()
    tag = b"TXXX" + bytes((0, 0, 0, len(text))) + b"\0\0" + text
    table = 8  # bitrate index of the table's frame: 336 bytes of 112 kbit/s
    total = len(body) + 3 * BITRATES[1, 3][table]
    ends = np.cumsum([3 * BITRATES[1, 3][i] for i, _ in frames])
    marks = np.append(0, ends)[np.arange(100) * len(frames) // 100] if frames else np.zeros(100, int)
    seek = bytes(((marks * 256) // max(1, len(body))).clip(0, 255).astype(np.uint8).tolist())
    xing = b"Xing" + (15).to_bytes(4, "big") + len(frames).to_bytes(4, "big") + total.to_bytes(4, "big") + seek + (0).to_bytes(4, "big")
    return b"ID3\x04\0\0" + bytes((0, 0, 0, len(tag))) + tag + _LEAD[table] + xing.ljust(room[table], b"\0") + body


def payload(data: bytes, stream: Stream) -> bytes:
    """What stored() put in: the main data of all frames, up to the length in the tag."""
    raw = b"".join(data[f.offset + _OVERHEAD : f.offset + f.size] for f in stream.frames)
    size = stream.tags.get("TXXX", "").split("\0")[-1]
    return raw[: int(size)] if size.isdigit() else raw


def written_media(docs: DataFrame, multiple: int = MULTIPLE) -> DataFrame:
    """doc_id, n_bytes, media for every row of docs (doc_id, text; other columns are ignored): the text's UTF-8 bytes (null: none), padded
    with spaces to a positive multiple of `multiple`, as a stream."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            raw = [t or b"" for t in text_bytes(piece)]
            media = [stored(t.ljust(max(1, -(-len(t) // multiple)) * multiple)) for t in raw]
            yield pa.RecordBatch.from_arrays([piece.column("doc_id"), pa.array([len(t) for t in raw], pa.int64()), pa.array(media, pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_READ = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "samples long, rate int, n_frames int, bad_checksums int, skipped long, seek array<long>, feature string"
)


def read_media(media: DataFrame, keep_seek: bool = True) -> DataFrame:
    """Features of rows (doc_id, n_bytes, media) of streams; one row for each.

    samples / rate is the exact duration, seek the byte offset of every frame (null unless keep_seek). feature sums up the stream:
    version, layer, rate, frames, duration in milliseconds, bitrates with their counts, the table and the checksums. Null, empty or
    foreign bytes have no frames, an empty payload and duration zero.
    """
    schema = pa.schema([(n, {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "array<long>": pa.list_(pa.int64())}[k]) for n, k in (x.split() for x in _READ.split(", "))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "media", 4 << 20):
            rows = []
            for d, n, data in zip(*(piece.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                data = data or b""
                s = parse(data)
                back = payload(data, s)
                samples, rate = s.duration
                rates: dict[int, int] = {}
                for f in s.frames:
                    rates[f.bitrate] = rates.get(f.bitrate, 0) + 1
                about = f"v{s.frames[0].version}l{s.frames[0].layer} {rate}Hz" if s.frames else "none"
                table = s.table.get("frames") == len(s.frames) and s.table.get("bytes") == sum(f.size for f in s.frames) + s.frames[0].offset - len(data[: data.find(b"\xff")]) if s.frames else False
                feature = f"{about} frames={len(s.frames)} ms={samples * 1000 // rate if rate else 0} kbps={','.join(f'{k}x{v}' for k, v in sorted(rates.items()))} table={'ok' if table else 'bad'} crc={'ok' if not s.bad_checksums else s.bad_checksums}"
                rows.append((d, n, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-16:]), len(data), hashlib.sha256(data).hexdigest(), samples, rate,
                             len(s.frames), s.bad_checksums, s.skipped, [f.offset for f in s.frames] if keep_seek else None, feature))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(schema, zip(*rows, strict=True), strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, _READ)


def op9_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = read_media(written_media(table(spark, sf_dir, "documents")))
    out = out.withColumn("seek", F.array_join("seek", ","))
    return out.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "samples", "rate", "n_frames", "bad_checksums", "seek")
