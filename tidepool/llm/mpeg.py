"""MPEG audio columns: writing bytes into frames, and reading frames, tags, tables and durations back.

A payload is kept in the ancillary bytes of MPEG-1 layer III frames (mono, 48 kHz, with checksum): their side
information declares no main data, so the frames decode to silence and everything after it is the payload. An ID3v2.4
tag names the payload's length, and a first frame holds a Xing table for the variable bit rate. The unit of the format is the frame.

The reader makes no use of how the writer works: it skips tags, looks for headers that are followed by another header (or the end),
passes over damaged bytes, verifies the CRC-16 of protected frames of all three layers, and derives durations and seek offsets from the frames
themselves, exactly, also where sample rates change within a file.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fractions import Fraction

import pyarrow as pa
from pyspark.sql import DataFrame

from tidepool.llm.bytestext import slices, small_batches, utf8
from tidepool.llm.columns import taken

# Fixed values of ISO/IEC 11172-3 and 13818-3: kbit/s by (version 1?, layer) and sample rates by version.
BIT_RATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
SAMPLE_RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
VERSIONS = {3: "1", 2: "2", 0: "2.5"}
SEEK_POINTS = 100
#: Of layer II: bits of the allocation of each subband, as (bits, up to which subband).
ALLOCATIONS = {"a": ((4, 11), (3, 23), (2, 27)), "b": ((4, 11), (3, 23), (2, 30)), "c": ((4, 2), (3, 8)), "d": ((4, 2), (3, 12)), "low": ((4, 4), (3, 11), (2, 30))}
SUBBANDS = 32

#: Parts of a second in which the length of every frame is a whole number: the least common multiple of all sample rates.
TICKS = math.lcm(*(rate for rates in SAMPLE_RATES.values() for rate in rates))


def _crc_steps() -> tuple[int, ...]:
    out = []
    for byte in range(256):
        x = byte << 8
        for _ in range(8):
            x = ((x << 1) ^ 0x8005 if x & 0x8000 else x << 1) & 0xFFFF
        out.append(x)
    return tuple(out)


_STEPS = _crc_steps()


def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of MPEG audio over all bits of ``data``, or the first ``bits``: polynomial 0x8005, all ones at first."""
    whole, rest = divmod(8 * len(data) if bits is None else bits, 8)
    x = 0xFFFF
    for byte in data[:whole]:
        x = (x << 8 & 0xFF00) ^ _STEPS[x >> 8 ^ byte]
    for k in range(rest):
        odd = (x >> 15) ^ (data[whole] >> (7 - k) & 1)
        x = (x << 1 & 0xFFFF) ^ (0x8005 if odd else 0)
    return x


@dataclass(frozen=True)
class Header:
    """What four header bytes say; ``size`` is the frame's bytes, ``checked`` the bytes of layer III side information under the checksum.

    From subband ``bound`` on, both channels share their allocation (layers I and II).
    """

    version: int
    layer: int
    protected: bool
    bit_rate: int
    sample_rate: int
    channels: int
    size: int
    samples: int
    checked: int
    bound: int

    @property
    def ticks(self) -> int:
        return self.samples * TICKS // self.sample_rate


_headers: dict[bytes, Header | None] = {}


def read_header(four: bytes) -> Header | None:
    """The header, or None if these bytes can't be one (free format included, whose size no header tells)."""
    if four in _headers:
        return _headers[four]
    found = _read_header(four) if len(four) == 4 else None
    if len(_headers) < 4096:
        _headers[four] = found
    return found


def _read_header(four: bytes) -> Header | None:
    a, b, c, d = four
    version, layer = b >> 3 & 3, 4 - (b >> 1 & 3)
    rate, frequency = c >> 4, c >> 2 & 3
    if a != 0xFF or b < 0xE0 or version == 1 or layer == 4 or rate in (0, 15) or frequency == 3 or d & 3 == 2:
        return None
    first = version == 3
    bit_rate, sample_rate, padding = BIT_RATES[first, layer][rate] * 1000, SAMPLE_RATES[version][frequency], c >> 1 & 1
    channels = 1 if d >> 6 == 3 else 2
    if layer == 1:
        size, samples, checked = (12 * bit_rate // sample_rate + padding) * 4, 384, 0
    else:
        samples = 576 if layer == 3 and not first else 1152
        size = samples // 8 * bit_rate // sample_rate + padding
        checked = {(True, 1): 17, (True, 2): 32, (False, 1): 9, (False, 2): 17}[first, channels] if layer == 3 else 0
    bound = 4 * (d >> 4 & 3) + 4 if d >> 6 == 1 else SUBBANDS
    return Header(version, layer, not b & 1, bit_rate, sample_rate, channels, size, samples, checked, bound)


def allocation_bits(header: Header) -> list[int]:
    """Of a layer II frame: how many bits the allocation of each subband has."""
    each, rate = header.bit_rate // header.channels // 1000, header.sample_rate
    if header.version != 3:
        kind = "low"
    elif rate == 48000 and each >= 56 or 56 <= each <= 80:
        kind = "a"
    elif each >= 96:
        kind = "b"
    else:
        kind = "d" if rate == 32000 else "c"
    out: list[int] = []
    for bits, upto in ALLOCATIONS[kind]:
        out += [bits] * (upto - len(out))
    return out


def checked_bits(header: Header, body: bytes) -> int:
    """How many bits after the checksum it covers: side information (III), allocation (I), or allocation and scale factor selection (II)."""
    if header.layer == 3:
        return 8 * header.checked
    channels = header.channels
    if header.layer == 1:
        both = min(header.bound, SUBBANDS)
        return 4 * (channels * both + SUBBANDS - both)
    number, length, at, selections = int.from_bytes(body, "big"), 8 * len(body), 0, 0
    for band, bits in enumerate(allocation_bits(header)):
        for _ in range(channels if band < header.bound else 1):
            at += bits
            if at > length:
                return length
            if number >> (length - at) & ((1 << bits) - 1):
                selections += 1 if band < header.bound else channels
    return min(at + 2 * selections, length)


def checksum_holds(header: Header, frame: bytes) -> bool:
    body = frame[6:] if header.layer == 3 else frame[6:86]  # 80 bytes hold the most that layers I and II have under the checksum
    bits = checked_bits(header, body)
    return crc16(frame[2:4] + body[: -(-bits // 8)], 16 + bits) == int.from_bytes(frame[4:6], "big")


# ---------------------------------------------------------------- writing

_HEAD = {index: bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0)) for index in range(1, 15)}
_SIDE = bytes(17)
_OVERHEAD = 4 + 2 + len(_SIDE)
_SIZES = {index: 144 * BIT_RATES[True, 3][index] * 1000 // 48000 for index in range(1, 15)}
_ROOM = {index: size - _OVERHEAD for index, size in _SIZES.items()}
_START = {index: head + crc16(head[2:] + _SIDE).to_bytes(2, "big") + _SIDE for index, head in _HEAD.items()}


def _synchsafe(n: int) -> bytes:
    return bytes(n >> shift & 0x7F for shift in (21, 14, 7, 0))


def _unsynchsafe(four: bytes) -> int:
    return four[0] << 21 | four[1] << 14 | four[2] << 7 | four[3]


def _id3(values: dict[str, str]) -> bytes:
    frames = b""
    for name, value in values.items():
        body = b"\x03" + name.encode() + b"\0" + value.encode()
        frames += b"TXXX" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _synchsafe(len(frames)) + frames


def write(payload: bytes) -> bytes:
    """An MPEG audio file that holds ``payload``; equal payloads, equal files."""
    largest, sizes, parts = 14, [], []
    for at in range(0, len(payload), _ROOM[largest]):
        piece = payload[at : at + _ROOM[largest]]
        index = next(k for k in range(1, 15) if _ROOM[k] >= len(piece))
        parts.append(_START[index] + piece.ljust(_ROOM[index], b"\0"))
        sizes.append(_SIZES[index])
    table_size = _SIZES[9]
    total, places, at = table_size + sum(sizes), [], table_size
    for size in sizes:
        places.append(at)
        at += size
    toc = bytes(min(255, 256 * places[len(places) * k // SEEK_POINTS] // total) if places else 0 for k in range(SEEK_POINTS))
    xing = b"Xing" + (0x7).to_bytes(4, "big") + len(sizes).to_bytes(4, "big") + total.to_bytes(4, "big") + toc
    return _id3({"payload": str(len(payload))}) + _START[9] + xing.ljust(_ROOM[9], b"\0") + b"".join(parts)


# ---------------------------------------------------------------- reading


@dataclass
class Audio:
    """What a file holds.

    ``offsets``, ``sizes`` and ``begins`` (in ticks) are of each audio frame, ``samples`` are by sample rate; ``table`` is the Xing, Info or VBRI frame's content.
    """

    tags: dict[str, str] = field(default_factory=dict)
    table: dict[str, object] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    begins: list[int] = field(default_factory=list)
    bit_rates: dict[int, int] = field(default_factory=dict)
    samples: dict[int, int] = field(default_factory=dict)
    first: Header | None = None
    ticks: int = 0
    checked: int = 0
    failed: int = 0
    skipped: int = 0

    @property
    def duration(self) -> Fraction:
        """The exact duration in seconds, whatever the sample rates of the frames."""
        return Fraction(self.ticks, TICKS)

    def seek(self, seconds: Fraction | int) -> int | None:
        """The file offset of the frame that holds a moment."""
        tick = seconds * TICKS
        if not 0 <= tick < self.ticks:
            return None
        return self.offsets[bisect.bisect_right(self.begins, tick) - 1]


def _tag_texts(body: bytes, major: int, flags: int) -> dict[str, str]:
    out: dict[str, str] = {}
    if flags & 0x80 and major < 4:
        body = body.replace(b"\xff\0", b"\xff")
    at = 0
    if flags & 0x40 and len(body) >= 4:
        at = _unsynchsafe(body[:4]) if major == 4 else int.from_bytes(body[:4], "big") + 4
    coding = {0: "latin-1", 1: "utf-16", 2: "utf-16-be", 3: "utf-8"}
    head = 6 if major == 2 else 10
    while at + head <= len(body) and body[at]:
        if major == 2:
            name, size = body[at : at + 3].decode("latin-1"), int.from_bytes(body[at + 3 : at + 6], "big")
        else:
            name, four = body[at : at + 4].decode("latin-1"), body[at + 4 : at + 8]
            size = _unsynchsafe(four) if major == 4 else int.from_bytes(four, "big")
        value = body[at + head : at + head + size]
        if name[0] == "T" and value:
            parts = value[1:].decode(coding.get(value[0], "latin-1"), "replace").split("\0")
            if name in ("TXXX", "TXX"):
                out[parts[0]] = "\0".join(parts[1:]).rstrip("\0")
            else:
                out[name] = "\0".join(parts).rstrip("\0")
        at += head + size
    return out


def _vbr_table(frame: bytes, header: Header) -> dict[str, object]:
    for at in (4 + 2 * header.protected + header.checked, 4 + header.checked):
        if frame[at : at + 4] in (b"Xing", b"Info"):
            flags, rest = int.from_bytes(frame[at + 4 : at + 8], "big"), frame[at + 8 :]
            out: dict[str, object] = {"kind": frame[at : at + 4].decode()}
            for bit, name in ((1, "frames"), (2, "bytes")):
                if flags & bit:
                    out[name], rest = int.from_bytes(rest[:4], "big"), rest[4:]
            if flags & 4:
                out["toc"] = list(rest[:SEEK_POINTS])
            return out
    if frame[36:40] == b"VBRI":
        return {"kind": "VBRI", "bytes": int.from_bytes(frame[46:50], "big"), "frames": int.from_bytes(frame[50:54], "big")}
    return {}


def read(data: bytes) -> Audio:
    """Tags, table and frames of a file. Empty or foreign bytes give no frames; all their bytes count as skipped."""
    out, at, end = Audio(), 0, len(data)
    while data[at : at + 3] == b"ID3" and at + 10 <= end:
        size = _unsynchsafe(data[at + 6 : at + 10])
        out.tags |= _tag_texts(data[at + 10 : at + 10 + size], data[at + 3], data[at + 5])
        at += 10 + size + (10 if data[at + 5] & 0x10 else 0)
    # an ID3v1 tag only where no frame goes on: the same bytes inside a whole frame are the frame's
    tail = end - 128 if end - at >= 128 and data[end - 128 : end - 125] == b"TAG" else end
    synced = False
    while at < end:
        if at == tail:
            for name, low, high in (("title", 3, 33), ("artist", 33, 63), ("album", 63, 93), ("year", 93, 97)):
                if value := data[at + low : at + high].split(b"\0")[0].decode("latin-1").strip():
                    out.tags.setdefault(name, value)
            break
        header = read_header(data[at : at + 4])
        after = at + header.size if header else 0
        if not header or after > end or not (synced and not at < tail < after or after in (tail, end) or _follows(header, data[after : after + 4])):
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            found = tail if at < tail < found else found
            out.skipped += found - at
            at, synced = found, False
            continue
        synced = after < end and _follows(header, data[after : after + 4])
        frame = data[at:after]
        if header.protected:
            out.checked += 1
            out.failed += not checksum_holds(header, frame)
        if not out.offsets and not out.table and (table := _vbr_table(frame, header)):
            out.table = table
        else:
            out.first = out.first or header
            out.offsets.append(at)
            out.sizes.append(header.size)
            out.begins.append(out.ticks)
            out.ticks += header.ticks
            out.samples[header.sample_rate] = out.samples.get(header.sample_rate, 0) + header.samples
            out.bit_rates[header.bit_rate] = out.bit_rates.get(header.bit_rate, 0) + 1
        at = after
    return out


def _follows(header: Header, four: bytes) -> bool:
    other = read_header(four)
    return other is not None and (other.version, other.layer, other.sample_rate) == (header.version, header.layer, header.sample_rate)


def payload_of(data: bytes, audio: Audio) -> bytes:
    """The bytes that ``write`` was given, from the file and what ``read`` found in it."""
    pieces = [data[a + _OVERHEAD : a + n] for a, n in zip(audio.offsets, audio.sizes, strict=True)]
    length = int(audio.tags["payload"])
    out = bytearray()
    for piece in pieces:
        out += piece[: length - len(out)]
    return bytes(out)


def feature(audio: Audio) -> str:
    """Format, exact duration, bit rates, checksums, table and tenths of the seek offsets, in one line."""
    if not audio.first:
        return "none"
    points = [audio.seek(audio.duration * k / 10) for k in range(10)]
    return ";".join(
        (
            f"mpeg{VERSIONS[audio.first.version]}-layer{audio.first.layer}",
            f"{audio.first.sample_rate}Hz x{audio.first.channels}",
            f"frames={len(audio.offsets)}",
            "duration=" + "+".join(f"{n}/{rate}" for rate, n in sorted(audio.samples.items())),
            "rates=" + ",".join(f"{k // 1000}:{n}" for k, n in sorted(audio.bit_rates.items())),
            f"crc={audio.checked - audio.failed}/{audio.checked}",
            f"table={audio.table.get('kind', 'none')}:{audio.table.get('frames', '')}",
            f"skipped={audio.skipped}",
            "seek=" + ",".join(map(str, points)),
        )
    )


def padded(raw: bytes) -> bytes:
    """With zero bytes up to a positive multiple of 64."""
    return raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def media_column(docs: DataFrame, text: str = "text", id_column: str = "doc_id", keep_media: bool = True) -> DataFrame:
    """One row per document: its text stored as MPEG audio, and what reading that file back gives.

    ``duration_seconds`` is ``duration_ticks`` (exact) over ``TICKS``; ``frame_offsets`` says where in the file each audio frame begins. Null texts count as empty: 64
    zero bytes. Texts of any length are stored whole, an empty table gives an empty table. Repeated rows stay; other columns of
    ``docs`` are neither read nor returned, whatever their names.
    """
    asked = taken(docs, id=id_column, text=text)
    kinds = {"n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    kinds |= {"duration_ticks": "long", "duration_seconds": "double", "frame_offsets": "array<long>"} | ({"media": "binary"} if keep_media else {})
    types = [{"long": pa.int64(), "string": pa.string(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()), "binary": pa.binary()}[k] for k in kinds.values()]

    def row(raw: bytes) -> tuple:
        media = write(padded(raw))
        audio = read(media)
        back = payload_of(media, audio)
        digest = hashlib.sha256(back).hexdigest()
        told = len(raw), len(back), digest, zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature(audio)
        return *told, audio.ticks, audio.ticks / TICKS, audio.offsets, media

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            rows = [row(x.as_py()) for x in batch.column(1)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *kinds])

    kind = asked.schema["id"].dataType.simpleString()
    made = small_batches(asked).select("id", utf8("text").alias("text")).mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} {k}" for n, k in kinds.items()))
    return made.withColumnRenamed("id", id_column)
