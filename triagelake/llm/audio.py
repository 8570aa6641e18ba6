"""MPEG audio media columns: writing, resynchronising, verifying and indexing.

The writer makes a plain MPEG-1 Layer III file (48 kHz, mono, variable
bitrate): an ID3v2.3 tag, a frame with the variable-bitrate table ("Xing":
frame count, byte count, 100-entry seek table), then frames whose headers and
side information are protected by CRC-16 and whose main data are the payload's
bytes. The payload's unpadded and padded lengths are in the tag.

The reader trusts nothing but the bytes: it parses tags at the front and the
end, looks for the next header that is followed by another one (or the end)
when a frame is not where it should be, checks every CRC, reads the table if
there is one, and reports exact durations (whole samples) and the byte offset
of every frame for seeking.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from triagelake.llm.arrow import by_bytes, tidy
from triagelake.llm.shared import Scratch, table

# Fixed values of the format (ISO/IEC 11172-3 and 13818-3): kbit/s by index, Hz by index.
BITRATES = {
    (1, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (1, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (1, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (2, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (2, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = (44100, 48000, 32000)
SIDE_INFO = {(1, True): 17, (1, False): 32, (2, True): 9, (2, False): 17}  # by version (1, or 2 and 2.5) and mono
PAYLOAD_OWNER = b"payload"


@dataclass(frozen=True, slots=True)
class Header:
    """A frame header; ``version`` is 1, 2 or 2.5."""

    version: float
    layer: int
    protected: bool
    kbps: int
    rate: int
    mono: bool
    size: int
    samples: int


@functools.lru_cache(4096)
def parse_header(word: bytes) -> Header | None:
    """The header in four bytes, or None if they cannot be one (free format counts as none)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version = {0: 2.5, 2: 2, 3: 1}.get(word[1] >> 3 & 3)
    layer = {1: 3, 2: 2, 3: 1}.get(word[1] >> 1 & 3)
    bitrate, rate = word[2] >> 4, word[2] >> 2 & 3
    if version is None or layer is None or bitrate in (0, 15) or rate == 3:
        return None
    family = (1, layer) if version == 1 else (2, min(layer, 2))
    kbps, hz = BITRATES[family][bitrate], RATES[rate] // {1: 1, 2: 2, 2.5: 4}[version]
    padding = word[2] >> 1 & 1
    samples = 384 if layer == 1 else 576 if layer == 3 and version != 1 else 1152
    size = (12000 * kbps // hz + padding) * 4 if layer == 1 else samples // 8 * 1000 * kbps // hz + padding
    return Header(version, layer, not word[1] & 1, kbps, hz, word[3] >> 6 == 3, size, samples)


def _crc_table() -> list[int]:
    out = []
    for i in range(256):
        c = i << 8
        for _ in range(8):
            c = (c << 1 ^ 0x8005 if c & 0x8000 else c << 1) & 0xFFFF
        out.append(c)
    return out


_CRC = _crc_table()


@functools.lru_cache(4096)
def crc16(data: bytes) -> int:
    """The frame checksum over the last two header bytes and the side information."""
    c = 0xFFFF
    for b in data:
        c = (c << 8 & 0xFFFF) ^ _CRC[c >> 8 ^ b]
    return c


# ---- writing -------------------------------------------------------------

HEAD = 4 + 2 + 17  # header, CRC, side information of a mono frame


@functools.lru_cache(64)
def _shape(need: int) -> tuple[int, int]:
    """Bitrate index and frame size of the smallest frame that holds ``need`` bytes, or of the largest."""
    sizes = [144 * k * 1000 // 48000 for k in BITRATES[1, 3]]
    for i in range(1, 15):
        if sizes[i] - HEAD >= need:
            return i, sizes[i]
    return 14, sizes[14]


@functools.lru_cache(2048)
def _frame_head(index: int, used: int) -> bytes:
    header = bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))
    # main_data_begin 0, private bits, scfsi; then for each of two granules part2_3_length (12 bits) leads 59 bits
    half = (used * 8 + 1) // 2
    bits = "0" * 9 + "0" * 5 + "0" * 4 + f"{half:012b}" + "0" * 47 + f"{used * 8 - half:012b}" + "0" * 47
    side = int(bits, 2).to_bytes(17, "big")
    return header + struct.pack(">H", crc16(header[2:] + side)) + side


def _syncsafe(n: int) -> bytes:
    return bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))


def write_mpeg(payload: bytes, unpadded: int) -> bytes:
    """The payload as the main data of Layer III frames, behind a tag and a variable-bitrate table."""
    body = PAYLOAD_OWNER + b"\0" + struct.pack(">QQ", unpadded, len(payload))
    tag_frame = b"PRIV" + struct.pack(">I", len(body)) + b"\0\0" + body
    tag = b"ID3\x03\0\0" + _syncsafe(len(tag_frame)) + tag_frame
    frames, starts, at = [], [], 0
    full = _shape(1 << 30)[1] - HEAD
    for first in range(0, len(payload), full):
        part = payload[first : first + full]
        index, size = _shape(len(part))
        frames += (_frame_head(index, len(part)), part, bytes(size - HEAD - len(part)))
        starts.append(at)
        at += size
    index, size = _shape(160)
    total = size + at
    seek = bytes(min(255, (size + starts[len(starts) * k // 100]) * 256 // total) for k in range(100)) if starts else bytes(100)
    info = b"Xing" + struct.pack(">III", 7, len(starts), total) + seek
    head = _frame_head(index, 0)
    first = head + info + bytes(size - len(head) - len(info))
    return b"".join((tag, first, *frames))


# ---- reading -------------------------------------------------------------

_SYNC = re.compile(rb"\xff[\xe2-\xff]")


@dataclass
class Probe:
    """What is in a file; offsets and lengths are bytes, durations are exact counts of samples."""

    tags: dict[str, bytes] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    resyncs: int = 0
    skipped: int = 0
    crc_good: int = 0
    crc_bad: int = 0
    vbr: str = ""
    vbr_frames: int | None = None
    vbr_bytes: int | None = None
    seek: bytes = b""
    payload: list[bytes] = field(default_factory=list)


def _id3(data: bytes, at: int, tags: dict[str, bytes]) -> int:
    """Reads an ID3v2 tag at ``at``; the place after it."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10:
        return at
    size = data[at + 6] << 21 | data[at + 7] << 14 | data[at + 8] << 7 | data[at + 9]
    end, p, major = min(len(data), at + 10 + size), at + 10, data[at + 3]
    while p + 10 <= end and data[p]:
        name, raw = data[p : p + 4].decode("latin-1"), data[p + 4 : p + 8]
        n = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if major == 4 else int.from_bytes(raw, "big")
        if n > end - p - 10:
            break
        body = data[p + 10 : p + 10 + n]
        if name == "PRIV":
            owner, _, body = body.partition(b"\0")
            name += ":" + owner.decode("latin-1")
        tags.setdefault(name, body)
        p += 10 + n
    return end


def _vbr_table(frame: bytes, h: Header, out: Probe) -> bool:
    side = 4 + 2 * h.protected + SIDE_INFO[1 if h.version == 1 else 2, h.mono]
    if frame[side : side + 4] in (b"Xing", b"Info") and len(frame) >= side + 8:
        out.vbr = frame[side : side + 4].decode().lower()
        flags, p = int.from_bytes(frame[side + 4 : side + 8], "big"), side + 8
        if flags & 1:
            out.vbr_frames, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 2:
            out.vbr_bytes, p = int.from_bytes(frame[p : p + 4], "big"), p + 4
        if flags & 4:
            out.seek = frame[p : p + 100]
        return True
    if frame[36:40] == b"VBRI" and len(frame) >= 54:
        out.vbr, out.vbr_bytes, out.vbr_frames = "vbri", int.from_bytes(frame[46:50], "big"), int.from_bytes(frame[50:54], "big")
        return True
    return False


def _plausible(data: bytes, at: int, end: int) -> Header | None:
    """A header at ``at`` whose frame ends where another header, or the data, does."""
    h = parse_header(data[at : at + 4])
    if h is None or at + h.size > end:
        return None
    return h if at + h.size == end or parse_header(data[at + h.size : at + h.size + 4]) else None


def read_mpeg(data: bytes) -> Probe:
    """Parses a file; never raises on damaged or empty ones, but skips to the next frame and counts that."""
    out = Probe()
    at, end = _id3(data, 0, out.tags), len(data)
    while at < end:
        if end - at == 128 and data[at : at + 3] == b"TAG":  # only where a frame would start: a payload may hold these bytes too
            out.tags["ID3v1"] = data[at:end]
            break
        h = parse_header(data[at : at + 4])
        if h is None or at + h.size > end:
            start = at
            while (m := _SYNC.search(data, at + 1, end)) and not _plausible(data, m.start(), end):
                at = m.start()
            at = m.start() if m else end
            out.resyncs += 1
            out.skipped += at - start
            continue
        frame = data[at : at + h.size]
        side = SIDE_INFO[1 if h.version == 1 else 2, h.mono] if h.layer == 3 else 0
        if h.protected and h.layer == 3:
            good = crc16(frame[2:4] + frame[6 : 6 + side]) == int.from_bytes(frame[4:6], "big")
            out.crc_good += good
            out.crc_bad += not good
        if not (not out.offsets and not out.vbr and _vbr_table(frame, h, out)):
            out.offsets.append(at)
            out.sizes.append(h.size)
            out.samples += h.samples
            out.payload.append(frame[4 + 2 * h.protected + side :])
        out.rate = out.rate or h.rate
        at += h.size
    return out


def payload_of(probe: Probe) -> bytes | None:
    """The payload that the writer stored, or None where there is none or a checksum fails."""
    note = probe.tags.get(f"PRIV:{PAYLOAD_OWNER.decode()}", b"")
    if len(note) != 16 or probe.crc_bad:
        return None
    length = struct.unpack(">QQ", note)[1]
    data = b"".join(probe.payload)
    return data[:length] if len(data) >= length else None


def feature_of(probe: Probe) -> str:
    """Frames, samples, rate, exact duration, table, checksums, resynchronisations, and a digest of all seek offsets."""
    seek = zlib.crc32(b"".join(struct.pack(">Q", x) for x in probe.offsets))
    millionths = probe.samples * 1_000_000 // probe.rate if probe.rate else 0
    return (
        f"frames={len(probe.offsets)};samples={probe.samples};rate={probe.rate};us={millionths};vbr={probe.vbr or 'none'}"
        f";crc_ok={probe.crc_good};crc_bad={probe.crc_bad};resyncs={probe.resyncs};seek_crc={seek:08x}"
    )


# ---- columns -------------------------------------------------------------

BATCH = 8 << 20


def with_audio(docs: DataFrame) -> DataFrame:
    """doc_id and ``media``: each text as UTF-8 (null: none), zero bytes up to a positive multiple of 64, as an MPEG file."""
    def run(batches):
        for batch in by_bytes(batches, "text", BATCH):
            out = []
            for raw in batch["text"].cast(pa.binary()).to_pylist():
                raw = raw or b""
                out.append(write_mpeg(raw + bytes(-len(raw) % 64 or (0 if raw else 64)), len(raw)))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(out, pa.binary())], ["doc_id", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(tidy(run), "doc_id long, media binary")


PROBED = "n_bytes long, payload binary, feature string, samples long, rate int, frame_offsets array<long>, crc_bad int, resyncs int"


def probe_audio(media: DataFrame) -> DataFrame:
    """``media`` (doc_id, media) with what its bytes say: payload, exact durations, frame seek offsets, checks.

    Null or damaged media give null n_bytes and payload, and whatever frames are found.
    """
    def run(batches):
        for batch in by_bytes(batches, "media", BATCH):
            probes = [read_mpeg(x or b"") for x in batch["media"].to_pylist()]
            notes = [p.tags.get(f"PRIV:{PAYLOAD_OWNER.decode()}", b"") for p in probes]
            yield pa.RecordBatch.from_arrays(
                [
                    batch["doc_id"], batch["media"],
                    pa.array([struct.unpack(">QQ", x)[0] if len(x) == 16 else None for x in notes], pa.int64()),
                    pa.array([payload_of(p) for p in probes], pa.binary()), pa.array([feature_of(p) for p in probes], pa.string()),
                    pa.array([p.samples for p in probes], pa.int64()), pa.array([p.rate for p in probes], pa.int32()),
                    pa.array([p.offsets for p in probes], pa.list_(pa.int64())),
                    pa.array([p.crc_bad for p in probes], pa.int32()), pa.array([p.resyncs for p in probes], pa.int32()),
                ],
                ["doc_id", "media", *(x.split()[0] for x in PROBED.split(", "))],
            )

    return media.select("doc_id", "media").mapInArrow(tidy(run), "doc_id long, media binary, " + PROBED)


def op5_mpeg_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document; a null text counts as empty, repeated rows repeat, an empty table gives no rows."""
    stored = Scratch(spark).save(with_audio(table(spark, sf_dir, "documents")))  # what is probed is what the files give back
    probed = probe_audio(stored)
    n = F.length("payload")
    return probed.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.substring(F.col("payload"), n - 63, F.lit(64))).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )
