"""Media column: MPEG-1 Layer III audio that carries bytes without loss, and a reader of such streams.

Writing. A payload is cut into frames of 48 kHz mono with a checksum. The audio of a frame is silence (an empty side
information); the payload is its ancillary data, the bytes that the format leaves free behind the audio. Full frames have
the highest bit rate, the last one the lowest that holds the rest, so the stream has a variable bit rate. An ID3v2 tag
with the payload's length and a Xing table (frames, bytes, 100 seek points) come first, an ID3v1 tag may follow.

Reading works on any bytes. Tags are parsed and skipped; a header counts as a frame only if its fields are legal and
another frame, a tag or the end follows where it says; what doesn't fit is skipped byte by byte until frames are found
again. Frames of free format take their size from the distance to the next like header. The letters TAG 128 bytes before the
end are an ID3v1 tag only where no frame holds them; they may be payload. Every protected frame's CRC-16 is computed from
the stream and compared. Xing, Info and VBRI tables are read, with the encoder's delay and padding. Durations are exact
fractions of a second: samples over sample rate, summed over the rates that occur. They are stored, with the offset of
every frame for seeking, in a table beside the streams.

Defined cases: a null or empty text is a payload of 64 zero bytes (n_bytes 0). Bytes that hold no frame have 0 frames.
Every row is handled by itself: equal texts give equal values; repeated rows, null ids and other columns are no matter.
An empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import struct
from dataclasses import dataclass, field
from fractions import Fraction
from functools import cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import slices, stored

# Fixed values of the format (MPEG-1/2/2.5 Layer III).
BITRATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = {3: (44100, 48000, 32000), 2: (22050, 24000, 16000), 0: (11025, 12000, 8000)}
POLYNOMIAL = 0x8005

ALIGN = 64
HEAD, CRC, SIDE = 4, 2, 17  # bytes of a mono frame before its data
RATE, SAMPLES = 48000, 1152
FULL = 14 * ALIGN  # payload bytes of a full frame
ID3_FRAME = b"TXXX"


@cache
def _crc_table():
    import numpy as np

    out = []
    for byte in range(256):
        c = byte << 8
        for _ in range(8):
            c = (c << 1 ^ (POLYNOMIAL if c & 0x8000 else 0)) & 0xFFFF
        out.append(c)
    return np.array(out, np.uint32)


def crc16(rows):
    """The frame checksum of each row of bytes (the last two header bytes and the side information)."""
    import numpy as np

    table = _crc_table()
    c = np.full(len(rows), 0xFFFF, np.uint32)
    for col in rows.T:
        c = (c << 8 & 0xFF00) ^ table[(c >> 8) ^ col]
    return c


def _header(index: int) -> bytes:
    """Of a protected mono frame at 48 kHz with the bit rate of that index."""
    return bytes([0xFF, 0xFA, index << 4 | 1 << 2, 0xC4])


@cache
def shell(index: int) -> bytes:
    """Header, checksum and silent side information."""
    import numpy as np

    head, side = _header(index), bytes(SIDE)
    return head + struct.pack(">H", int(crc16(np.frombuffer(head[2:] + side, np.uint8)[None])[0])) + side


def _frame_bytes(index: int) -> int:
    return 144 * BITRATES_1[index] * 1000 // RATE


def _syncsafe(n: int) -> bytes:
    return bytes(n >> s & 127 for s in (21, 14, 7, 0))


def padded(raw: bytes, align: int = ALIGN) -> bytes:
    """raw with zero bytes appended up to a positive multiple of align."""
    return raw + bytes(max(align, -(-len(raw) // align) * align) - len(raw))


def write_stream(payload: bytes) -> bytes:
    """An MPEG stream that carries payload."""
    import numpy as np

    n, rest = divmod(len(payload), FULL)
    top = len(BITRATES_1) - 1
    size = _frame_bytes(top)
    frames = np.zeros((n, size), np.uint8)
    frames[:, : len(shell(top))] = np.frombuffer(shell(top), np.uint8)
    frames[:, HEAD + CRC + SIDE : HEAD + CRC + SIDE + FULL] = np.frombuffer(payload, np.uint8, n * FULL).reshape(n, FULL)
    last = b""
    if rest:
        index = next(i for i in range(1, top + 1) if _frame_bytes(i) - HEAD - CRC - SIDE >= rest)
        last = (shell(index) + payload[n * FULL :]).ljust(_frame_bytes(index), b"\0")
    ten = next(i for i in range(1, top + 1) if _frame_bytes(i) >= HEAD + CRC + SIDE + 4 + 4 + 4 + 4 + 100)
    audio = _frame_bytes(ten) + n * size + len(last)
    count = n + bool(rest)
    toc = bytes(min(255, 256 * (_frame_bytes(ten) + (k * count // 100) * size) // audio) for k in range(100))
    xing = (shell(ten) + b"Xing" + struct.pack(">III", 7, count, audio) + toc).ljust(_frame_bytes(ten), b"\0")
    body = b"\0payload\0" + str(len(payload)).encode()
    tag = ID3_FRAME + struct.pack(">I", len(body)) + b"\0\0" + body
    return b"ID3\3\0\0" + _syncsafe(len(tag)) + tag + xing + frames.tobytes() + last


@dataclass
class Stream:
    """What `read_stream` finds."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)  # of the audio frames
    sizes: list[int] = field(default_factory=list)
    samples: int = 0
    seconds: Fraction = Fraction(0)
    rates: dict[int, int] = field(default_factory=dict)  # frames by bit rate in kbit/s
    skipped: int = 0
    bad_checksums: int = 0
    protected: int = 0
    table: tuple[int, int] | None = None  # frames and bytes by the Xing, Info or VBRI table
    table_kind: str = ""
    seek_points: tuple[int, ...] = ()  # Xing: 256ths of the bytes at each hundredth; VBRI: offsets behind the table's frame
    delay: int = 0  # samples that the encoder put before and after the sound
    padding: int = 0

    @property
    def nanoseconds(self) -> int:
        """The duration, rounded down."""
        return int(self.seconds * 10**9)

    payload: bytes = b""
    missing: int = 0  # bytes of the payload that the frames don't hold


def _parse(head: int) -> tuple[int, int, int, int, int] | None:
    """(frame bytes, bit rate, sample rate, samples, bytes of side information) of a legal Layer III header."""
    version, layer, index, rate = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version == 1 or layer != 1 or index in (0, 15) or rate == 3:
        return None
    kbit = (BITRATES_1 if version == 3 else BITRATES_2)[index]
    hertz, samples = RATES[version][rate], 1152 if version == 3 else 576
    mono = head >> 6 & 3 == 3
    side = (17 if mono else 32) if version == 3 else (9 if mono else 17)
    return samples // 8 * kbit * 1000 // hertz + (head >> 9 & 1), kbit, hertz, samples, side


#: Header bits that all frames of a free-format stream share: synchronisation, version, layer, bit rate, sample rate.
ALIKE = 0xFFFEFC00
FREE_MOST = 8192


def _free(data: bytes, at: int, end: int) -> int:
    """Bytes, without padding, of the free-format frame that begins there: the distance to the next like header that is confirmed by a third, the end or a tag; else 0."""
    head = int.from_bytes(data[at : at + 4], "big")
    version, layer, index, rate = head >> 19 & 3, head >> 17 & 3, head >> 12 & 15, head >> 10 & 3
    if head >> 21 != 0x7FF or version == 1 or layer != 1 or index or rate == 3:
        return 0
    like, pad = lambda p: p + 4 <= end and (int.from_bytes(data[p : p + 4], "big") ^ head) & ALIKE == 0, head >> 9 & 1
    p = at
    while 0 <= (p := data.find(b"\xff", p + 1 if p > at else at + HEAD + 9, min(end, at + FREE_MOST))):
        if like(p):
            size = p - at - pad
            after = p + size + (data[p + 2] >> 1 & 1)
            if like(after) or after == end or data[after : after + 3] == b"TAG":
                return size
    return 0


def _info(data: bytes, at: int, data_at: int, end: int) -> tuple | None:
    """(kind, frames, bytes, seek points, delay, padding) of the table in a frame, if it holds one."""
    u16, u32 = lambda p: int.from_bytes(data[p : p + 2], "big"), lambda p: int.from_bytes(data[p : p + 4], "big")
    if data[data_at : data_at + 4] in (b"Xing", b"Info"):
        flags, where, values = u32(data_at + 4), data_at + 8, [0, 0]
        for k in (0, 1):
            if flags >> k & 1:
                values[k], where = u32(where), where + 4
        points = tuple(data[where : where + 100]) if flags & 4 else ()
        where += 100 * (flags >> 2 & 1) + 4 * (flags >> 3 & 1)
        delays = int.from_bytes(data[where + 21 : where + 24], "big") if where + 24 <= end and data[where : where + 4].isalnum() else 0
        return data[data_at : data_at + 4].decode(), *values, points, delays >> 12, delays & 0xFFF
    fixed = at + HEAD + 32  # whatever the side information takes
    if data[fixed : fixed + 4] == b"VBRI" and fixed + 26 <= end:
        count, scale, width = u16(fixed + 18), u16(fixed + 20), u16(fixed + 22)
        steps = [int.from_bytes(data[p : p + width], "big") * scale for p in range(fixed + 26, min(end, fixed + 26 + count * width), max(1, width))]
        return "VBRI", u32(fixed + 14), u32(fixed + 10), tuple(itertools.accumulate(steps)), u16(fixed + 6), 0
    return None


def _tag_size(data: bytes, at: int) -> int:
    """Bytes of an ID3v2 tag that begins there, else 0."""
    if data[at : at + 3] != b"ID3" or len(data) < at + 10 or max(data[at + 6 : at + 10]) > 127:
        return 0
    a, b, c, d = data[at + 6 : at + 10]
    return 10 + (a << 21 | b << 14 | c << 7 | d) + 10 * (data[at + 5] >> 4 & 1)


def _tags(data: bytes, at: int, end: int, into: dict[str, str]) -> None:
    syncsafe = data[at + 3] >= 4
    at += 10
    while at + 10 <= end and data[at] != 0:
        name, raw = data[at : at + 4], data[at + 4 : at + 8]
        size = raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3] if syncsafe else int.from_bytes(raw, "big")
        body = data[at + 10 : min(end, at + 10 + size)]
        if name[:1] == b"T" and body:
            text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace")
            key, _, value = text.partition("\0") if name == ID3_FRAME else (name.decode("latin-1"), "", text)
            into[key] = value.rstrip("\0")
        at += 10 + size


def read_stream(data: bytes) -> Stream:
    """Frames, tags, tables, checksums, duration and seek offsets of any bytes."""
    import numpy as np

    s, at, end = Stream(), 0, len(data)
    tag_at = end - 128 if data[-128:-125] == b"TAG" else end
    follows = lambda p: p >= end or p == tag_at or _tag_size(data, p) or (p + 4 <= end and (_parse(int.from_bytes(data[p : p + 4], "big")) or (free and int.from_bytes(data[p : p + 4], "big") & 0xFFFEF000 == free)))
    checks: dict[int, list[int]] = {}
    ticks: dict[int, int] = {}
    starts: list[int] = []
    locked = False
    free = free_size = 0  # the header and the size of free-format frames, once they are known
    while at < end:
        if at == tag_at:
            s.tags.setdefault("title", data[at + 3 : at + 33].rstrip(b"\0 ").decode("latin-1"))
            break
        if size := _tag_size(data, at):
            _tags(data, at, min(end, at + size), s.tags)
            at += size
            continue
        frame = _parse(int.from_bytes(data[at : at + 4], "big")) if at + 4 <= end else None
        if frame is None and data[at] == 0xFF and at + 4 <= end and data[at + 2 : at + 3] < b"\x10" and (size := _free(data, at, tag_at) or (free_size if free == int.from_bytes(data[at : at + 4], "big") & 0xFFFEF000 else 0)):
            head = int.from_bytes(data[at : at + 4], "big")
            free, free_size = head & 0xFFFEF000, size
            _, _, hertz, samples, side = _parse(head | 1 << 12)
            frame = (size + (head >> 9 & 1), size * 8 * hertz // samples // 1000, hertz, samples, side)
        if frame is None or at + frame[0] > end or not ((locked and not at < tag_at < at + frame[0]) or follows(at + frame[0])):
            locked = False
            stop = tag_at if at < tag_at else end
            step = data.find(b"\xff", at + 1, stop)
            step = stop if step < 0 else step
            s.skipped += step - at
            at = step
            continue
        size, kbit, hertz, samples, side = frame
        locked = bool(follows(at + size))
        protected = not data[at + 1] & 1
        data_at = at + HEAD + CRC * protected + side
        if protected:
            checks.setdefault(side, []).append(at)
        if not s.offsets and s.table is None and (info := _info(data, at, data_at, end)):
            s.table_kind, s.table, s.seek_points, s.delay, s.padding = info[0], info[1:3], *info[3:]
        else:
            s.offsets.append(at)
            s.sizes.append(size)
            starts.append(data_at)
            s.samples += samples
            ticks[hertz] = ticks.get(hertz, 0) + samples
            s.rates[kbit] = s.rates.get(kbit, 0) + 1
        at += size
    s.seconds = sum((Fraction(n, hertz) for hertz, n in ticks.items()), Fraction(0))
    raw = np.frombuffer(data, np.uint8)
    for side, where in checks.items():
        base = np.array(where)[:, None]
        rows = raw[base + np.array([2, 3, *range(HEAD + CRC, HEAD + CRC + side)])]
        stored_crc = raw[base[:, 0] + 4].astype(np.uint32) << 8 | raw[base[:, 0] + 5]
        s.protected += len(where)
        s.bad_checksums += int((crc16(rows) != stored_crc).sum())
    left = int(s.tags["payload"]) if s.tags.get("payload", "").isdigit() else 0
    parts = []
    for at, size, data_at in zip(s.offsets, s.sizes, starts, strict=True):
        take = min(left, FULL, at + size - data_at)
        parts.append(data[data_at : data_at + take])
        left -= take
    s.payload, s.missing = b"".join(parts), left
    return s


def encoded(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): the stream of every whole text."""

    def run(batches):
        import pyarrow as pa

        for part in slices(batches, 250):
            raw = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array([write_stream(padded(x)) for x in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What is read from a stream: its exact duration in seconds as a fraction, whole nanoseconds, frames and seek offsets.
INSPECTED = "duration struct<numerator:long,denominator:long>, duration_ns long, frames long, samples long, delay long, padding long, skipped long, protected long, bad_checksums long, vbr boolean, table_kind string, table_frames long, table_bytes long, seek_offsets array<long>, tags map<string,string>"


def inspected(media: DataFrame, column: str = "media", payload: bool = True) -> DataFrame:
    """The columns of media but the streams, with those of INSPECTED, and what the streams carry (payload) or its digests.

    Digests are (payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256). Columns of these names give way.
    """
    import pyarrow as pa

    fixed = {"duration": pa.struct([("numerator", pa.int64()), ("denominator", pa.int64())]), "seek_offsets": pa.list_(pa.int64()), "tags": pa.map_(pa.string(), pa.string()), "vbr": pa.bool_(), "table_kind": pa.string(), "payload": pa.binary(), "payload_sha256": pa.string(), "media_sha256": pa.string()}
    carried = "payload binary" if payload else "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string"
    made = {x.split()[0] for x in f"{INSPECTED}, {carried}".split(", ")} | {column}
    kept = [f for f in media.schema.fields if f.name not in made]

    def run(batches):
        import hashlib
        import zlib

        for part in slices(batches, 250):
            streams = [x or b"" for x in part.column(len(kept)).to_pylist()]
            found = [read_stream(x) for x in streams]
            if short := sum(s.missing > 0 for s in found):
                raise ValueError(f"{short} streams hold less than the payload that their tags state")
            cols = {"duration": [{"numerator": s.seconds.numerator, "denominator": s.seconds.denominator} for s in found], "duration_ns": [s.nanoseconds for s in found], "frames": [len(s.offsets) for s in found], "samples": [s.samples for s in found]}
            cols |= {"delay": [s.delay for s in found], "padding": [s.padding for s in found], "skipped": [s.skipped for s in found], "protected": [s.protected for s in found], "bad_checksums": [s.bad_checksums for s in found], "vbr": [len(s.rates) > 1 for s in found]}
            cols |= {"table_kind": [s.table_kind or None for s in found], "table_frames": [s.table[0] if s.table else None for s in found], "table_bytes": [s.table[1] if s.table else None for s in found], "seek_offsets": [s.offsets for s in found], "tags": [list(s.tags.items()) for s in found]}
            if payload:
                cols["payload"] = [s.payload for s in found]
            else:
                cols |= {"payload_bytes": [len(s.payload) for s in found], "payload_sha256": [hashlib.sha256(s.payload).hexdigest() for s in found], "tail_crc32": [zlib.crc32(s.payload[-ALIGN:]) for s in found], "media_bytes": [len(m) for m in streams], "media_sha256": [hashlib.sha256(m).hexdigest() for m in streams]}
            yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *(pa.array(v, fixed.get(k, pa.int64())) for k, v in cols.items())], [*(f.name for f in kept), *cols])

    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)
    return media.select(*(f"`{f.name}`" for f in kept), f"`{column}`").mapInArrow(run, ", ".join(x for x in (names, INSPECTED, carried) if x))


def media_tables(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(streams, index): the stored streams, and the table that is read from the stored bytes, with durations and seek offsets, stored as well."""
    streams = stored(encoded(docs, doc_id, text), "mpeg")
    return streams, stored(inspected(streams, payload=False), "mpeg-index")


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature), from the stored tables."""
    _, index = media_tables(docs)
    number = lambda name: F.coalesce(F.col(name), F.lit(0)).cast("string")
    offsets = F.lpad(F.lower(F.hex(F.crc32(F.array_join(F.col("seek_offsets").cast("array<string>"), ",").cast("binary")))), 8, "0")
    feature = F.concat(F.lit("layer3;frames="), number("frames"), F.lit(";seconds="), number("duration.numerator"), F.lit("/"), number("duration.denominator"), F.lit(";vbr="), F.col("vbr").cast("int").cast("string"), F.lit(";crc="), (F.col("protected") - F.col("bad_checksums")).cast("string"), F.lit("/"), number("protected"), F.lit(";table="), number("table_frames"), F.lit(";seek="), offsets)
    return index.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
