"""MPEG audio media columns: frames written from a payload, and a reader for streams in the wild.

The reader skips tags, resynchronises on frame headers, reads variable-bitrate tables, verifies the checksums of all three
layers, and gives exact durations and the byte offset of every frame, from which it seeks. Tags are read only outside the
chain of frames: an ID3v2 tag at the start, an ID3v1 tag where the last frame ends 128 bytes before the end; what looks
like a tag or a header within a frame is its data. The writer stores a payload losslessly as the main data of Layer III
frames; the number of payload bytes stands in an ID3v2 tag.

Null texts count as empty; an empty text is one block of 64 zero bytes. Repeated rows and equal texts give equal results.
Texts are stored whole however long (a text of n bytes needs about 2 n in its task). A null doc_id stays null. An empty
table gives an empty result. Other columns are ignored, whatever their names. Of the frames that follow a lost header the
first with a second one of its kind behind it counts, so a tie between two chains goes to the earlier.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of the MPEG audio standard: bitrates in kbit/s by (version 1?, layer), sampling rates by version.
BITRATES = {
    (True, 1): (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448),
    (True, 2): (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384),
    (True, 3): (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320),
    (False, 1): (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256),
    (False, 2): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
    (False, 3): (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160),
}
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}

SIDE_BYTES = 17  # Layer III, version 1, one channel
WRITE_RATE = 48000
TAG_KEY = b"payload-bytes"


@dataclass(frozen=True)
class Header:
    """One decoded frame header."""

    version: int  # 3: version 1, 2: version 2, 0: version 2.5
    layer: int
    protected: bool
    kbps: int
    rate: int
    padding: int
    channels: int
    bound: int = 32  # first subband of joint coding, Layers I and II

    @property
    def samples(self) -> int:
        if self.layer == 1:
            return 384
        return 1152 if self.layer == 2 or self.version == 3 else 576

    @property
    def length(self) -> int:
        if self.layer == 1:
            return (12000 * self.kbps // self.rate + self.padding) * 4
        return self.samples // 8 * 1000 * self.kbps // self.rate + self.padding

    @property
    def side(self) -> int:
        if self.layer != 3:
            return 0
        return (17 if self.channels == 1 else 32) if self.version == 3 else (9 if self.channels == 1 else 17)


@lru_cache(4096)
def decode_header(word: bytes) -> Header | None:
    """The header in four bytes, or None if they are none (reserved values included; free format isn't read)."""
    if len(word) < 4 or word[0] != 0xFF or word[1] & 0xE0 != 0xE0:
        return None
    version, layer = word[1] >> 3 & 3, 4 - (word[1] >> 1 & 3)
    index, rate = word[2] >> 4, word[2] >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or rate == 3:
        return None
    mode = word[3] >> 6
    return Header(
        version=version,
        layer=layer,
        protected=not word[1] & 1,
        kbps=BITRATES[version == 3, layer][index],
        rate=RATES[version][rate],
        padding=word[2] >> 1 & 1,
        channels=1 if mode == 3 else 2,
        bound=4 + 4 * (word[3] >> 4 & 3) if mode == 1 else 32,
    )


@lru_cache(4096)
def crc16(data: bytes, bits: int | None = None) -> int:
    """The checksum of protected frames over the first bits (all) of data: polynomial 0x8005 from all ones, most significant bit first."""
    value, left = 0xFFFF, 8 * len(data) if bits is None else bits
    for byte in data:
        for k in range(7, 7 - min(8, left), -1):
            top = value >> 15 ^ byte >> k & 1
            value = (value << 1 & 0xFFFF) ^ (0x8005 if top else 0)
        left -= 8
        if left <= 0:
            break
    return value


# Fixed values of the standard, Layer II: (subbands, bits of the allocation field) from the lowest subband, by table.
ALLOCATIONS = {
    "a": ((11, 4), (12, 3), (4, 2)),
    "b": ((11, 4), (12, 3), (7, 2)),
    "c": ((2, 4), (6, 3)),
    "d": ((2, 4), (10, 3)),
    "low rates": ((4, 4), (7, 3), (19, 2)),
}


def allocation_fields(head: Header) -> list[int]:
    """Bits of the allocation field of each subband of a Layer II frame."""
    each = head.kbps // head.channels
    if head.version != 3:
        name = "low rates"
    elif each <= 48:
        name = "d" if head.rate == 32000 else "c"
    else:
        name = "a" if head.rate == 48000 or each <= 80 else "b"
    return [width for n, width in ALLOCATIONS[name] for _ in range(n)]


def protected_bits(head: Header, body: bytes) -> int:
    """How many bits after a frame's checksum it covers: side information, or allocations and (Layer II) which scale factors follow."""
    if head.layer == 3:
        return 8 * head.side
    if head.layer == 1:
        bound = min(head.bound, 32) if head.channels == 2 else 0
        return 4 * (bound * 2 + 32 - bound)
    value, size, at, used = int.from_bytes(body[:64], "big"), 8 * len(body[:64]), 0, 0
    fields = allocation_fields(head)
    for band, width in enumerate(fields):
        shared = head.channels == 1 or band >= head.bound
        for _ in range(1 if shared else 2):
            used += (value >> max(0, size - at - width) & (1 << width) - 1 > 0) * (head.channels if shared else 1)
            at += width
    return at + 2 * used


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 0x7F for s in (21, 14, 7, 0))


def _write_header(kbps: int) -> bytes:
    index = BITRATES[True, 3].index(kbps)
    return bytes((0xFF, 0xFA, index << 4 | RATES[3].index(WRITE_RATE) << 2, 0xC4))


@lru_cache(64)
def _frame_head(kbps: int) -> bytes:
    head, side = _write_header(kbps), bytes(SIDE_BYTES)
    return head + struct.pack(">H", crc16(head[2:4] + side)) + side


def _capacity(kbps: int) -> int:
    return 3 * kbps - 4 - 2 - SIDE_BYTES


def write_stream(payload: bytes) -> bytes:
    """A variable-bitrate Layer III stream whose frames hold payload in order.

    Full frames have the highest bitrate; the last has the lowest that holds what is left.
    """
    rates = BITRATES[True, 3][1:]
    full = _capacity(rates[-1])
    frames = [_frame_head(rates[-1]) + payload[i : i + full] for i in range(0, len(payload) - full + 1, full)]
    rest = payload[len(frames) * full :]
    if rest or not frames:
        kbps = next(k for k in rates if _capacity(k) >= len(rest))
        frames.append((_frame_head(kbps) + rest).ljust(3 * kbps, b"\0"))
    info_kbps = 64
    sizes = [3 * info_kbps, *map(len, frames)]
    total, at, toc, offsets = sum(sizes), 0, bytearray(), []
    for s in sizes:
        offsets.append(at)
        at += s
    for percent in range(100):
        toc.append(min(255, offsets[percent * len(offsets) // 100] * 256 // total))
    table = b"Xing" + struct.pack(">III", 7, len(frames), total) + bytes(toc)
    info = (_frame_head(info_kbps) + table).ljust(3 * info_kbps, b"\0")
    text = b"\0" + TAG_KEY + b"\0" + str(len(payload)).encode()
    tag = b"TXXX" + struct.pack(">IH", len(text), 0) + text
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + info + b"".join(frames)


@dataclass
class Stream:
    """What read_stream finds."""

    frames: list[int] = field(default_factory=list)
    headers: list[Header] = field(default_factory=list)
    tags: dict[str, str] = field(default_factory=dict)
    vbr: dict[str, int] | None = None
    toc: bytes = b""
    checked: int = 0
    bad_checksums: int = 0
    skipped: int = 0
    samples: int = 0

    @property
    def seconds(self) -> float:
        return self.samples / self.headers[0].rate if self.headers else 0.0

    def seek(self, second: float) -> int | None:
        """Byte offset of the frame that plays at a second."""
        at = 0
        for offset, h in zip(self.frames, self.headers, strict=True):
            at += h.samples
            if at > second * h.rate:
                return offset
        return None


def _read_id3(data: bytes, tags: dict[str, str]) -> int:
    if data[:3] != b"ID3" or len(data) < 10:
        return 0
    size = 10 + (data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]) + (10 if data[5] & 0x10 else 0)
    at = 10
    while at + 10 <= min(size, len(data)) and data[at : at + 4].strip(b"\0"):
        kind, n = data[at : at + 4].decode("latin-1"), int.from_bytes(data[at + 4 : at + 8], "big")
        if data[3] >= 4:
            b = data[at + 4 : at + 8]
            n = b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
        body = data[at + 10 : at + 10 + n]
        if kind.startswith("T") and body:
            raw = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = raw.partition("\0") if kind == "TXXX" else (kind, "", raw)
            tags[key] = value.rstrip("\0")
        at += 10 + n
    return size


def read_stream(data: bytes) -> Stream:
    """Parse a stream. Bytes that belong to no frame or tag are counted as skipped.

    A header counts if the next frame's header follows it with the same version, layer and rate, or if the data or all but
    an ID3v1 tag end there.
    """
    out = Stream()
    at, end = _read_id3(data, out.tags), len(data)
    last = end - 128 if data[-128:-125] == b"TAG" else end  # where a chain of frames may end besides the end
    known = None
    while at + 4 <= end:
        head = decode_header(data[at : at + 4])
        stop = at + head.length if head else 0
        if head and known and (head.version, head.layer, head.rate) != known:
            head = None
        if head and stop not in (end, last):
            after = decode_header(data[stop : stop + 4]) if stop + 4 <= end else None
            if after is None or (after.version, after.layer, after.rate) != (head.version, head.layer, head.rate):
                head = None
        if head is None:
            found = data.find(b"\xff", at + 1, end)
            found = end if found < 0 else found
            out.skipped += found - at
            at = found
            continue
        known = (head.version, head.layer, head.rate)
        body = at + 4 + 2 * head.protected
        if head.protected:
            bits = protected_bits(head, data[body : body + 64])
            held = data[at + 2 : at + 4] + data[body : body + (bits + 7) // 8]
            out.checked += 1
            out.bad_checksums += crc16(held, 16 + bits) != int.from_bytes(data[at + 4 : at + 6], "big")
        mark = body + head.side
        if not out.frames and out.vbr is None and data[mark : mark + 4] in (b"Xing", b"Info"):
            out.vbr, out.toc = _xing_table(data[mark : mark + 116])
        elif not out.frames and out.vbr is None and data[at + 36 : at + 40] == b"VBRI":
            size, n = struct.unpack(">II", data[at + 46 : at + 54].ljust(8, b"\0"))
            out.vbr = {"frames": n, "bytes": size}
        else:
            out.frames.append(at)
            out.headers.append(head)
            out.samples += head.samples
        at = stop
        if at == last < end:
            out.tags.setdefault("TIT2", data[last + 3 : last + 33].rstrip(b"\0 ").decode("latin-1"))
            return out
    out.skipped += max(0, end - at)
    return out


def _xing_table(raw: bytes) -> tuple[dict[str, int], bytes]:
    """Frames, bytes (-1 where not given) and seek table of a Xing or Info table; its fields stand one after another as far as flagged."""
    flags, at, found = int.from_bytes(raw[4:8], "big"), 8, {}
    for bit, name in ((1, "frames"), (2, "bytes")):
        found[name] = int.from_bytes(raw[at : at + 4], "big") if flags & bit else -1
        at += 4 if flags & bit else 0
    return found, raw[at : at + 100] if flags & 4 else b""


def payload_of(data: bytes, stream: Stream) -> bytes:
    """The payload that write_stream stored."""
    parts = [data[at + 4 + 2 * h.protected + h.side : at + h.length] for at, h in zip(stream.frames, stream.headers, strict=True)]
    return b"".join(parts)[: int(stream.tags[TAG_KEY.decode()])]


def padded(text: str | None) -> tuple[int, bytes]:
    """Bytes of a text as UTF-8, and these with zero bytes up to a positive multiple of 64."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw.ljust(max(64, -(-len(raw) // 64) * 64), b"\0")


def feature(stream: Stream) -> str:
    """Frames, exact samples and milliseconds, table entries, checksum results and a digest of the seek offsets, as text."""
    seek = zlib.crc32(b"".join(struct.pack(">Q", x) for x in stream.frames))
    table = stream.vbr or {"frames": -1, "bytes": -1}
    played = f"frames={len(stream.frames)};samples={stream.samples};ms={round(stream.seconds * 1000)};vbr={table['frames']}/{table['bytes']}"
    return f"{played};crc={stream.checked - stream.bad_checksums}/{stream.checked};skipped={stream.skipped};seek={seek:08x}"


MEDIA_SCHEMA = "doc_id long, n_bytes long, media binary"
DIGEST_SCHEMA = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, "
    "feature string, n_frames long, duration_ms double, bad_checksums long, seek_offsets array<long>"
)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and a media column: each whole text as an MPEG audio stream."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                rows = [padded(t) for t in part.column(1).to_pylist()]
                sizes, streams = pa.array([n for n, _ in rows], pa.int64()), pa.array([write_stream(p) for _, p in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), sizes, streams], ["doc_id", "n_bytes", "media"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]).mapInArrow(run, MEDIA_SCHEMA)


def media_features(media: DataFrame) -> DataFrame:
    """Read stored streams (doc_id, n_bytes, media): digests, features, and the byte offset of every frame to seek by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part, rows = batch.slice(i, 512), []
                for value in part.column(2):
                    data = value.as_py()
                    stream = read_stream(data)
                    body = payload_of(data, stream)
                    stored_ = (len(body), hashlib.sha256(body).hexdigest(), zlib.crc32(body[-64:]), len(data), hashlib.sha256(data).hexdigest())
                    rows.append((*stored_, feature(stream), len(stream.frames), stream.seconds * 1000, stream.bad_checksums, stream.frames))
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64(), pa.list_(pa.int64())]
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *columns], DIGEST_NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, DIGEST_SCHEMA)


DIGEST_NAMES = [x.split()[0] for x in DIGEST_SCHEMA.split(", ")]
