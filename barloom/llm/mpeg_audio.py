"""MPEG audio media columns: frames that carry a payload, and a reader for such streams.

A stream is an ID3v2.3 tag, a frame with a Xing table (frames, bytes, 100-entry seek
table) and MPEG-1 layer III frames.  Every frame has a checksum over its header and side
information; its side information is zero (silence), so the main data area holds payload
bytes as ancillary data.  The last frame has the smallest bitrate that holds the rest,
hence the variable-bitrate table.

A frame's checksum covers no main data, so the stream's tag also has a checksum of the
payload.

The reader takes any bytes: it skips tags, resynchronises after damage by looking for two
consecutive headers of one kind, verifies checksums of layer III frames, parses Xing and
VBRI tables, and gives exact durations (samples over the sampling rate) and the offset of
every frame of layers I, II and III.  Frames of free format, whose length no header tells,
are skipped like damage.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from barloom.llm.textarrays import buffer_of

# Fixed values of MPEG audio: kbit/s by index (MPEG-1 and 2, layers I to III), sampling rates.
BITRATES_1_I = (0, 32, 64, 96, 128, 160, 192, 224, 256, 288, 320, 352, 384, 416, 448)
BITRATES_1_II = (0, 32, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320, 384)
BITRATES_1 = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)
BITRATES_2_I = (0, 32, 48, 56, 64, 80, 96, 112, 128, 144, 160, 176, 192, 224, 256)
BITRATES_2 = (0, 8, 16, 24, 32, 40, 48, 56, 64, 80, 96, 112, 128, 144, 160)
RATES = (44100, 48000, 32000)

SAMPLES = 1152
RATE = 48000
HEAD, CRC, SIDE = 4, 2, 17  # MPEG-1 mono
OVERHEAD = HEAD + CRC + SIDE
_SYNC = re.compile(rb"\xff[\xe0-\xff]")
_FULL = len(BITRATES_1) - 1


def _crc_table() -> np.ndarray:
    out = []
    for b in range(256):
        c = b << 8
        for _ in range(8):
            c = ((c << 1) ^ 0x8005) & 0xFFFF if c & 0x8000 else (c << 1) & 0xFFFF
        out.append(c)
    return np.array(out, np.uint16)


CRC_TABLE = _crc_table()


def checksums(rows: np.ndarray) -> np.ndarray:
    """CRC-16 (0x8005, starts at 0xFFFF) of each row of bytes, column by column."""
    c = np.full(len(rows), 0xFFFF, np.uint16)
    for k in range(rows.shape[1]):
        c = (c << np.uint16(8)) ^ CRC_TABLE[(c >> np.uint16(8)).astype(np.uint8) ^ rows[:, k]]
    return c


def frame_bytes(index: int) -> int:
    return 144 * BITRATES_1[index] * 1000 // RATE


def _header(index: int) -> bytes:
    """MPEG-1 layer III with checksum, 48 kHz, no padding, mono."""
    return bytes((0xFF, 0xFA, index << 4 | 1 << 2, 0xC0))


_EMPTY = {i: _header(i) + int(checksums(np.frombuffer(_header(i)[2:] + bytes(SIDE), np.uint8)[None])[0]).to_bytes(2, "big") + bytes(SIDE) for i in range(1, _FULL + 1)}


def encode(payload: bytes) -> bytes:
    """The stream that carries ``payload``; ``scan`` gives it back."""
    body = frame_bytes(_FULL) - OVERHEAD
    whole, rest = divmod(len(payload), body)
    frames = np.zeros((whole, OVERHEAD + body), np.uint8)
    if whole:
        frames[:, :OVERHEAD] = np.frombuffer(_EMPTY[_FULL], np.uint8)
        frames[:, OVERHEAD:] = np.frombuffer(payload, np.uint8, whole * body).reshape(whole, body)
    tail = b""
    if rest:
        index = next(i for i in range(1, _FULL + 1) if frame_bytes(i) - OVERHEAD >= rest)
        tail = _EMPTY[index] + payload[whole * body :].ljust(frame_bytes(index) - OVERHEAD, b"\0")
    audio_frames, audio_bytes = whole + bool(rest), whole * (OVERHEAD + body) + len(tail)
    info_index = next(i for i in range(1, _FULL + 1) if frame_bytes(i) - OVERHEAD >= 116)
    size = frame_bytes(info_index)
    total = size + audio_bytes
    at = [min(255, 256 * (size + min(audio_bytes, int(audio_frames * k / 100) * (OVERHEAD + body))) // total) for k in range(100)]
    xing = b"Xing" + struct.pack(">III", 7, audio_frames, total) + bytes(at)
    info = (_EMPTY[info_index] + xing).ljust(size, b"\0")
    tag = b""
    for name, value in (("payload_bytes", len(payload)), ("payload_crc32", zlib.crc32(payload))):
        text = f"\0{name}\0{value}".encode()
        tag += b"TXXX" + struct.pack(">IH", len(text), 0) + text
    n = len(tag)
    head = b"ID3\x03\0\0" + bytes((n >> 21 & 127, n >> 14 & 127, n >> 7 & 127, n & 127))
    return b"".join((head, tag, info, frames.tobytes(), tail))


@dataclass
class Scan:
    """What a stream holds; ``duration`` is samples over rate, exactly."""

    tags: dict[str, str] = field(default_factory=dict)
    offsets: list[int] = field(default_factory=list)
    samples: int = 0
    rate: int = 0
    vbr: dict | None = None
    checked: int = 0
    bad_crc: int = 0
    resyncs: int = 0
    payload: bytes = b""
    missing: int = 0  # bytes that the tag promises and the frames do not hold
    intact: bool | None = None  # whether the payload has the tag's checksum, if it has one


def parse_header(data: bytes, at: int) -> tuple[int, int, int, int, bool, int] | None:
    """Frame length, samples, rate, side information bytes, whether a checksum can be
    verified, and a number for the kind of stream, of the header there, or None."""
    if at + 4 > len(data) or data[at] != 0xFF or data[at + 1] & 0xE0 != 0xE0:
        return None
    version, layer, b2 = data[at + 1] >> 3 & 3, 4 - (data[at + 1] >> 1 & 3), data[at + 2]
    index, r = b2 >> 4, b2 >> 2 & 3
    if version == 1 or layer == 4 or index in (0, 15) or r == 3:
        return None
    first = version == 3
    rate = RATES[r] >> {3: 0, 2: 1, 0: 2}[version]
    table = (BITRATES_1_I, BITRATES_1_II, BITRATES_1) if first else (BITRATES_2_I, BITRATES_2, BITRATES_2)
    bits, padding, kind = table[layer - 1][index] * 1000, b2 >> 1 & 1, data[at + 1] & 0xFE | r << 8
    if layer == 1:
        return (12 * bits // rate + padding) * 4, 384, rate, 0, False, kind
    samples = 576 if layer == 3 and not first else 1152
    mono = data[at + 3] >> 6 == 3
    side = 0 if layer == 2 else (17 if mono else 32) if first else (9 if mono else 17)
    return samples // 8 * bits // rate + padding, samples, rate, side, layer == 3 and not data[at + 1] & 1, kind


def parse_tags(data: bytes) -> tuple[dict[str, str], int, int]:
    """ID3v2 text frames; where audio starts, and where it ends if "TAG" 128 bytes before
    the end is an ID3v1 tag and not data, which the frames tell (``scan``)."""
    tags, start, end = {}, 0, len(data)
    if data[:3] == b"ID3" and len(data) >= 10 and max(data[6:10]) < 128:
        n = data[6] << 21 | data[7] << 14 | data[8] << 7 | data[9]
        start, at, stop = min(end, 10 + n), 10, min(len(data), 10 + n)
        while at + 10 <= stop and data[at : at + 4].strip(b"\0"):
            name = data[at : at + 4].decode("latin-1")
            raw = data[at + 4 : at + 8]
            size = int.from_bytes(raw, "big") if data[3] < 4 else raw[0] << 21 | raw[1] << 14 | raw[2] << 7 | raw[3]
            if at + 10 + size > stop:
                break
            value = data[at + 10 : at + 10 + size]
            if name[0] == "T" and value:
                code = {0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(value[0], "utf-8")
                said = value[1:].decode(code, "replace").rstrip("\0")
                key, _, said = said.partition("\0") if name == "TXXX" else (name, "", said)
                tags[key] = said
            at += 10 + size
    if end - start >= 128 and data[end - 128 : end - 125] == b"TAG":
        end -= 128
    return tags, start, end


def _table(data: bytes, at: int, body: int, length: int) -> dict | None:
    """The Xing, Info or VBRI table in a frame."""
    stop = at + length
    if data[body : body + 4] in (b"Xing", b"Info") and body + 8 <= stop:
        flags, p, out = int.from_bytes(data[body + 4 : body + 8], "big"), body + 8, {"kind": data[body : body + 4].decode()}
        for bit, name in ((1, "frames"), (2, "bytes")):
            if flags & bit:
                out[name], p = int.from_bytes(data[p : p + 4], "big"), p + 4
        if flags & 4:
            out["toc"] = list(data[p : p + 100])
        return out
    p = at + HEAD + 32
    if data[p : p + 4] == b"VBRI" and p + 26 <= stop:
        size, frames = struct.unpack(">II", data[p + 10 : p + 18])
        entries, scale, width, per = struct.unpack(">HHHH", data[p + 18 : p + 26])
        toc = [int.from_bytes(data[p + 26 + k * width : p + 26 + (k + 1) * width], "big") * scale for k in range(entries)]
        return {"kind": "VBRI", "frames": frames, "bytes": size, "toc": toc, "frames_per_entry": per}
    return None


def scan(data: bytes) -> Scan:
    """Reads a stream.  Frames with a wrong checksum count as bad and still give data;
    bytes between frames are skipped, and each such gap is one resynchronisation.

    "TAG" 128 bytes before the end is data where unbroken frames run over it to the very
    end, and else an ID3v1 tag.
    """
    tags, start, end = parse_tags(data)
    if end < len(data):
        whole, unbroken = _walk(data, start, len(data))
        if unbroken < end:
            whole.tags = tags
            return _trimmed(whole)
    out, _ = _walk(data, start, end)
    out.tags = tags if end == len(data) else {"TIT2": data[end + 3 : end + 33].rstrip(b"\0 ").decode("latin-1")} | tags
    return _trimmed(out)


def _trimmed(out: Scan) -> Scan:
    n = out.tags.get("payload_bytes", "")
    if n.isdigit():
        out.missing = max(0, int(n) - len(out.payload))
        out.payload = out.payload[: int(n)]
    if "payload_crc32" in out.tags:
        out.intact = str(zlib.crc32(out.payload)) == out.tags["payload_crc32"]
    return out


def _walk(data: bytes, at: int, end: int) -> tuple[Scan, int]:
    """The frames between two places, and from where on they run unbroken to ``end``."""
    out, since = Scan(), end
    parts, sure, seen = [], False, {}
    crc_rows: dict[int, tuple[list[int], list[int]]] = {}
    while at + HEAD <= end:
        raw = data[at : at + 4]
        got = seen.get(raw)
        if got is None:
            got = seen[raw] = parse_header(data, at) or ()
        fits = bool(got) and got[0] > HEAD + got[3] and at + got[0] <= end
        if fits and not sure:  # the next header must fit as well, or the stream ends there
            following = parse_header(data, at + got[0])
            fits = at + got[0] == end or (following is not None and following[5] == got[5])
        if not fits:
            m = _SYNC.search(data, at + 1, end)
            if sure or not out.offsets:
                out.resyncs += 1
            sure = False
            since = end
            if m is None:
                break
            at = m.start()
            continue
        length, samples, rate, side, crc, _ = got
        since = min(since, at)
        body = at + HEAD + 2 * crc + side
        if crc:
            starts, wanted = crc_rows.setdefault(side, ([], []))
            starts.append(at)
            wanted.append(data[at + 4] << 8 | data[at + 5])
        table = _table(data, at, body, length) if not out.offsets and out.vbr is None else None
        if table:
            out.vbr = table
        else:
            out.offsets.append(at)
            out.samples += samples
            out.rate = out.rate or rate
            parts.append(data[body : at + length])
        sure, at = True, at + length
    raw = np.frombuffer(data, np.uint8)
    for side, (starts, wanted) in crc_rows.items():
        s = np.array(starts)[:, None]
        rows = np.concatenate([raw[s + np.arange(2, 4)], raw[s + np.arange(6, 6 + side)]], axis=1)
        out.checked += len(starts)
        out.bad_crc += int((checksums(rows) != np.array(wanted, np.uint16)).sum())
    out.payload = b"".join(parts)
    return out, since if at == end else end


def payload_of(data: bytes) -> bytes:
    """Zero bytes up to a positive multiple of 64."""
    return data + bytes(-len(data) % 64 if data else 64)


MEDIA_SCHEMA = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, duration_samples long, sample_rate int, frame_offsets array<long>"


def _columns(media: bytes) -> tuple:
    s = scan(media)
    feature = f"mpeg1-l3;frames={len(s.offsets)};samples={s.samples}/{s.rate};crc={s.checked - s.bad_crc}/{s.checked};resync={s.resyncs};vbr={(s.vbr or {}).get('kind', '-')}:{(s.vbr or {}).get('frames', 0)};payload={s.intact}"
    return s, feature


def store_texts(docs: DataFrame, keep_media: bool = False) -> DataFrame:
    """A media row per document: its text's bytes as an MPEG stream, read back.  A stream
    that does not give them back is an error.

    Null and empty texts give 64 zero bytes; texts may be of any length that a row can hold
    with its stream.  doc_id may be null, and rows may repeat; other columns are ignored; an
    empty table gives no rows.  With ``keep_media`` the stream itself is
    the last column.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in MEDIA_SCHEMA.split(", ")] + ["media"] * keep_media
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                b = batch.slice(lo, 256)
                buf, off = buffer_of(b.column("text"))
                rows = []
                for s, e in zip(off[:-1].tolist(), off[1:].tolist(), strict=True):
                    payload = payload_of(buf[s:e].tobytes())
                    media = encode(payload)
                    got, feature = _columns(media)
                    back = got.payload
                    if back != payload or not got.intact:
                        raise ValueError(f"{got.missing} of {len(payload)} bytes are missing, or others differ, in the stream read back")
                    rows.append((e - s, len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature, got.samples, got.rate, got.offsets, media))
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
                cols = [pa.array([r[k] for r in rows], kinds[k]) for k in range(10 + keep_media)]
                yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=names)

    return docs.select("doc_id", "text").mapInArrow(run, MEDIA_SCHEMA + ", media binary" * keep_media)


def read_media(rows: DataFrame, media: str = "media") -> DataFrame:
    """What streams from any encoder hold: doc_id, tags, duration, table, offsets, checks;
    ``intact`` is null where a stream's tags have no checksum of its payload.

    Null media reads as empty: no frames, duration 0.
    """
    schema = "doc_id long, tags map<string,string>, duration_samples long, sample_rate int, vbr_kind string, vbr_frames long, checked long, bad_crc long, resyncs long, frame_offsets array<long>, intact boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [scan(x or b"") for x in b.column(media).to_pylist()]
            cols = [
                pa.array([list(s.tags.items()) for s in got], pa.map_(pa.string(), pa.string())), pa.array([s.samples for s in got], pa.int64()), pa.array([s.rate for s in got], pa.int32()),
                pa.array([(s.vbr or {}).get("kind") for s in got], pa.string()), pa.array([(s.vbr or {}).get("frames") for s in got], pa.int64()),
                *(pa.array([getattr(s, k) for s in got], pa.int64()) for k in ("checked", "bad_crc", "resyncs")), pa.array([s.offsets for s in got], pa.list_(pa.int64())), pa.array([s.intact for s in got], pa.bool_()),
            ]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *cols], names=[c.rsplit(" ", 1)[0].strip() for c in re.split(r", (?=\w+ )", schema)])

    return rows.select("doc_id", media).mapInArrow(run, schema)
