"""MPEG audio columns: payloads in Layer III frames, read back frame by frame.

A stored stream is an ID3v2 tag, an information frame with a variable-bitrate table
(frame and byte counts, 100 seek entries), and CRC-protected mono frames of 48 kHz whose
granules declare no coded data, so a decoder plays silence and everything after the side
information is ancillary bytes: there the payload lies. The last frame takes the lowest
bitrate that holds the rest.

Reading takes Layer III of MPEG 1, 2 and 2.5, mono or with two channels, and trusts
nothing: it finds the first header that another header follows at the computed distance,
resynchronises after damage, checks each frame's checksum, and yields exact durations
(samples over sample rate) and the byte offset of every frame. Tags are read from both
ends (ID3v2.2 to 2.4 in all four text encodings, ID3v1), tables of both kinds (Xing or
Info after the side information, VBRI at its fixed place), and held against the frames.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyforge.llm import _bytes as B
from tallyforge.llm._session import staged

UNIT = 576
# Fixed values of the format: kbit/s by index for MPEG-1 Layer III and for the lower
# sample rates, Hz by index, side-information bytes in mono, samples of a frame.
KBITS = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
KBITS_LOW = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
HERTZ = (44100, 48000, 32000)
SIDE = 17
SAMPLES = 1152
#: By the header's version bits: what divides the sample rates; 1 is reserved.
DIVIDED = {3: 1, 2: 2, 0: 4}
VBRI_AT = 36
RATE = 1
#: Header, checksum and side information come before a frame's free bytes.
HEAD = 4 + 2 + SIDE


def frame_bytes(bitrate: int, rate: int = RATE, padding: int = 0) -> int:
    return 144000 * KBITS[bitrate] // HERTZ[rate] + padding


def header(bitrate: int, protected: bool, rate: int = RATE) -> bytes:
    return bytes((0xFF, 0xFA if protected else 0xFB, bitrate << 4 | rate << 2, 0xC0))


def crc16(data: bytes) -> int:
    """CRC-16 with polynomial 0x8005 and all ones at the start."""
    value = 0xFFFF
    for byte in data:
        value ^= byte << 8
        for _ in range(8):
            value = (value << 1 ^ 0x8005 if value & 0x8000 else value << 1) & 0xFFFF
    return value


def _lead(bitrate: int) -> bytes:
    own = header(bitrate, protected=True)
    side = bytes(SIDE)
    return own + crc16(own[2:] + side).to_bytes(2, "big") + side


LEADS = {b: np.frombuffer(_lead(b), np.uint8) for b in range(1, 15)}
BIG = 14
ROOM = frame_bytes(BIG) - HEAD


def padded(data: bytes) -> bytes:
    """With bytes 255 up to a positive multiple of the unit."""
    return data + b"\xff" * (max(1, -(-len(data) // UNIT)) * UNIT - len(data))


def _tag(title: str) -> bytes:
    body = b"\x03" + title.encode()
    frame = b"TIT2" + _synchsafe(len(body)) + b"\0\0" + body
    return b"ID3\x04\0\0" + _synchsafe(len(frame)) + frame


def _synchsafe(n: int) -> bytes:
    return bytes((n >> s) & 127 for s in (21, 14, 7, 0))


TAG = _tag("text payload")


def encode(payload: bytes) -> bytes:
    full, rest = divmod(len(payload), ROOM)
    last = next((b for b in range(1, 15) if frame_bytes(b) - HEAD >= rest), BIG) if rest else 0
    parts = []
    if full:
        frames = np.empty((full, frame_bytes(BIG)), np.uint8)
        frames[:, :HEAD] = LEADS[BIG]
        frames[:, HEAD:] = np.frombuffer(payload, np.uint8, full * ROOM).reshape(full, ROOM)
        parts.append(frames.tobytes())
    if rest:
        tail = payload[full * ROOM :]
        parts.append(LEADS[last].tobytes() + tail + bytes(frame_bytes(last) - HEAD - len(tail)))
    body = b"".join(parts)
    frames_n = full + bool(rest)
    info = header(5, protected=False)
    size = frame_bytes(5)
    total = size + len(body)
    sizes = np.full(frames_n, frame_bytes(BIG), np.int64)
    if rest:
        sizes[-1] = frame_bytes(last)
    starts = size + np.concatenate(([0], np.cumsum(sizes)))[:-1]
    seek = bytes(min(255, int(256 * starts[k * frames_n // 100] / total)) for k in range(100))
    table = b"Xing" + (15).to_bytes(4, "big") + frames_n.to_bytes(4, "big") + total.to_bytes(4, "big") + seek + (0).to_bytes(4, "big")
    # the payload's length is told in the encoder field, so padding of the last frame is no data
    table += b"PAYL" + len(payload).to_bytes(8, "big")
    first = info + bytes(SIDE) + table
    return TAG + first + bytes(size - len(first)) + body


@dataclass(frozen=True)
class Frame:
    """What a header says."""

    bytes: int
    samples: int
    hertz: int
    kbits: int
    side: int
    protected: bool

    @property
    def kind(self) -> tuple[int, int]:
        return self.samples, self.hertz


@dataclass
class Parsed:
    tags: dict[str, str]
    table: dict[str, int]
    offsets: np.ndarray
    bitrates: np.ndarray
    seconds: float
    samples: int
    rate: int
    bad_checksums: int
    skipped: int
    payload: bytes
    seek: bytes
    agrees: bool


@lru_cache(maxsize=4096)
def _frame(head: bytes) -> Frame | None:
    """The frame of four header bytes, if they are a valid Layer III header."""
    if len(head) < 4 or head[0] != 0xFF or head[1] & 0xE6 != 0xE2 or head[1] >> 3 & 3 not in DIVIDED:
        return None
    bitrate, rate = head[2] >> 4, head[2] >> 2 & 3
    if not 0 < bitrate < 15 or rate == 3:
        return None
    by = DIVIDED[head[1] >> 3 & 3]
    hertz, mono = HERTZ[rate] // by, head[3] >> 6 == 3
    kbits = (KBITS if by == 1 else KBITS_LOW)[bitrate]
    samples = SAMPLES if by == 1 else SAMPLES // 2
    side = (SIDE if mono else 32) if by == 1 else (9 if mono else SIDE)
    return Frame(samples // 8 * 1000 * kbits // hertz + (head[2] >> 1 & 1), samples, hertz, kbits, side, not head[1] & 1)


def _frame_at(data: bytes, i: int) -> Frame | None:
    return _frame(data[i : i + 4])


def _followed(data: bytes, i: int, frame: Frame, end: int) -> bool:
    """The frame ends the data, or another of its kind follows."""
    if i + frame.bytes == end:
        return True
    after = _frame_at(data, i + frame.bytes)
    return after is not None and after.kind == frame.kind


def _resync(data: bytes, i: int, end: int) -> int:
    """The next place of a frame that ends the data or that another frame follows."""
    while 0 <= (i := data.find(b"\xff", i)) < end:
        frame = _frame_at(data, i)
        if frame and i + frame.bytes <= end and _followed(data, i, frame, end):
            return i
        i += 1
    return end


def _number(data: bytes, bits: int = 8) -> int:
    """A big-endian number of so many bits a byte."""
    out = 0
    for b in data:
        out = out << bits | b & (1 << bits) - 1
    return out


def _text(data: bytes) -> str:
    """An ID3v2 text: its encoding, then its characters up to a closing null."""
    kind, rest = data[:1], data[1:]
    name = {b"\0": "latin-1", b"\1": "utf-16", b"\2": "utf-16-be", b"\3": "utf-8"}.get(kind, "latin-1")
    return rest.decode(name, "replace").split("\0")[0]


def _tags_ahead(data: bytes) -> tuple[dict[str, str], int]:
    """Text frames of the ID3v2 tag, by name, and where it ends."""
    tags: dict[str, str] = {}
    if data[:3] != b"ID3" or len(data) < 10:
        return tags, 0
    version, flags = data[3], data[5]
    end = 10 + _number(data[6:10], 7)
    body = data[10:end]
    if flags & 0x80 and version < 4:  # unsynchronised as a whole
        body = body.replace(b"\xff\0", b"\xff")
    i = 0
    if flags & 0x40 and version > 2:
        i = _number(body[:4], 7) if version == 4 else 4 + _number(body[:4])
    name, sized = (3, 6) if version == 2 else (4, 10)
    while i + sized <= len(body) and body[i] != 0:
        n = _number(body[i + name : i + 2 * name], 7 if version == 4 else 8)
        own = body[i + sized : i + sized + n]
        if version == 4 and body[i + 9] & 2:
            own = own.replace(b"\xff\0", b"\xff")
        if body[i : i + 1] == b"T":
            tags.setdefault(body[i : i + name].decode("latin-1"), _text(own))
        i += sized + n
    return tags, min(len(data), end + 10 * bool(version == 4 and flags & 0x10))


#: Fixed values of the format: fields of an ID3v1 tag under the names of ID3v2.
OLD_TAG = (("TIT2", 3, 33), ("TPE1", 33, 63), ("TALB", 63, 93), ("TYER", 93, 97), ("COMM", 97, 127))


def _tags_behind(data: bytes) -> tuple[dict[str, str], int]:
    """Fields of the ID3v1 tag and where it starts."""
    tail = data[-128:]
    if len(tail) < 128 or tail[:3] != b"TAG":
        return {}, len(data)
    found = {name: tail[a:b].split(b"\0")[0].decode("latin-1").rstrip() for name, a, b in OLD_TAG}
    return {k: v for k, v in found.items() if v}, len(data) - 128


def _table_at(data: bytes, at: int, frame: Frame) -> tuple[dict[str, int], bytes | None, list[int]]:
    """The numbers of an information frame's table, its 100 seek entries, or the bytes of
    its stretches of frames; all empty if the frame has no table."""
    table: dict[str, int] = {}
    i = at + 4 + 2 * frame.protected + frame.side
    if data[i : i + 4] in (b"Xing", b"Info"):
        flags = _number(data[i + 4 : i + 8])
        i += 8
        seek = None
        for bit, name, size in ((1, "frames", 4), (2, "bytes", 4), (4, "", 100), (8, "quality", 4)):
            if flags & bit:
                if name:
                    table[name] = _number(data[i : i + size])
                else:
                    seek = data[i : i + size]
                i += size
        if data[i : i + 4] == b"PAYL":
            table["payload"] = _number(data[i + 4 : i + 12])
        return table, seek, []
    i = at + VBRI_AT
    if data[i : i + 4] == b"VBRI":
        table = {"quality": _number(data[i + 8 : i + 10]), "bytes": _number(data[i + 10 : i + 14]), "frames": _number(data[i + 14 : i + 18])}
        entries, scale, width, table["stretch"] = (_number(data[i + k : i + k + 2]) for k in (18, 20, 22, 24))
        return table, None, [scale * _number(data[i + 26 + k * width : i + 26 + (k + 1) * width]) for k in range(entries)]
    return table, None, []


def parse(data: bytes) -> Parsed:
    """Tags, table, frames and payload of a stream, damaged or not."""
    tags, at = _tags_ahead(data)
    old, end = _tags_behind(data)
    tags = old | tags
    table: dict[str, int] = {}
    seek, stretches, info = None, [], 0
    frames: list[Frame] = []
    starts, parts = [], []
    bad = skipped = 0
    checked: dict[bytes, bool] = {}
    while at < end:
        frame = _frame_at(data, at)
        right = True
        if frame and frame.protected:
            lead = data[at : at + 6 + frame.side]
            if lead not in checked:
                checked[lead] = crc16(lead[2:4] + lead[6:]) == int.from_bytes(lead[4:6], "big")
            right = checked[lead]
        # a frame is one that a frame follows, or the end, or whose own checksum says so
        if not frame or at + frame.bytes > end or not (_followed(data, at, frame, end) or frame.protected and right):
            to = _resync(data, at + bool(frame), end)
            skipped += to - at
            at = to
            continue
        if not starts and not table:
            table, seek, stretches = _table_at(data, at, frame)
            if table or seek:
                info = at
                at += frame.bytes
                continue
        bad += not right
        starts.append(at)
        frames.append(frame)
        parts.append(data[at + 4 + 2 * frame.protected + frame.side : at + frame.bytes])
        at += frame.bytes
    payload = b"".join(parts)
    offsets = np.array(starts, np.int64)
    agrees = _agrees(table, seek, stretches, offsets, info, end)
    samples = sum(f.samples for f in frames)
    one = len({f.hertz for f in frames}) < 2
    rate = frames[0].hertz if frames else HERTZ[RATE]
    seconds = samples / rate if one else sum(f.samples / f.hertz for f in frames)
    return Parsed(tags, table, offsets, np.array([f.kbits for f in frames], np.int64), seconds, samples, rate, bad, skipped, payload[: table.get("payload", len(payload))], seek or b"", agrees)


def _agrees(table: dict[str, int], seek: bytes | None, stretches: list[int], offsets: np.ndarray, info: int, end: int) -> bool:
    """The table tells the frames found, and its bytes and seek entries, if any, theirs."""
    n, total = len(offsets), end - info
    if table.get("frames", -1) != n or table.get("bytes", total) != total:
        return False
    if stretches:
        each = max(1, table["stretch"])
        edges = np.append(offsets, end)[np.minimum(np.arange(len(stretches) + 1) * each, n)]
        return stretches == np.diff(edges).tolist()
    if seek is None or not n:
        return True
    places = np.minimum(255, 256 * (offsets[np.arange(100) * n // 100] - info) // total)
    return seek == places.astype(np.uint8).tobytes()


def store(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text's stream, written as a table in the shared folder.

    Null texts are empty, and so one unit of bytes 255. Equal texts give equal streams.
    Repeated rows and null ids are rows like others; other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, buf, offsets in B.text_chunks(batch, "text"):
                data = buf.tobytes()
                media = [encode(padded(data[a:b])) for a, b in zip(offsets[:-1], offsets[1:])]
                yield pa.record_batch([batch.column("id").slice(lo, hi - lo), pa.array(np.diff(offsets)), pa.array(media, pa.binary())], ["id", "n_bytes", "media"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = dict(rows.dtypes)["id"]
    out = staged(rows.mapInArrow(run, f"id {kind}, n_bytes long, media binary"), "media", compression="zstd", **{"parquet.block.size": str(32 << 20)})
    return out.withColumnRenamed("id", id_col)


def read(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """What the stored streams hold: digests, exact duration, frames and their offsets.

    A null stream is empty: no frames, no payload. Damage is skipped and counted.
    """
    columns = [c for c in ("n_bytes",) if c in media.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                out = []
                for cell in part.column("media"):
                    data = cell.as_py() or b""
                    p = parse(data)
                    tail = zlib.crc32(p.payload[-32:])
                    first, last = (int(p.offsets[0]), int(p.offsets[-1])) if len(p.offsets) else (-1, -1)
                    mean = len(data) * 8 / p.seconds / 1000 if p.seconds else 0.0
                    feature = f"frames={len(p.offsets)};samples={p.samples};rate={p.rate};kbps={mean:.3f};first={first};last={last};bad={p.bad_checksums};skipped={p.skipped};title={p.tags.get('TIT2', '')}"
                    out.append((len(p.payload), hashlib.sha256(p.payload).hexdigest(), tail, len(data), hashlib.sha256(data).hexdigest(), feature, p.seconds, len(p.offsets), p.offsets, p.bad_checksums, p.agrees))
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.int64(), pa.list_(pa.int64()), pa.int64(), pa.bool_())
                yield pa.record_batch([part.column("id"), *(part.column(c) for c in columns), *(pa.array(list(x), k) for x, k in zip(zip(*out), kinds))], names)

    made = "payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, seconds double, n_frames long, frame_offsets array<long>, bad_checksums long, table_agrees boolean"
    names = ["id", *columns, *(x.split(" ")[0] for x in made.split(", "))]
    rows = media.select(F.col(id_col).alias("id"), *columns, F.col(media_col).alias("media"))
    kind = dict(rows.dtypes)["id"]
    return rows.mapInArrow(run, f"id {kind}, " + "".join(f"{c} long, " for c in columns) + made).withColumnRenamed("id", id_col)
