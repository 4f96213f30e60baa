"""Media columns: Matroska files to packet tables.

`demux` walks the variable-length EBML elements of a file: the header, the segment
(of known or unknown size), its info, tracks, clusters with their simple
blocks and block groups, all three lacings, and the cues. It gives a packet for every
frame: track, timestamp, key frame flag, lacing, and the frame's byte range in
the file; and the cue points, each checked against the cluster that it names.
`mux` writes 8-bit PCM samples as such a file, without loss.

Each file is read in its own row's batch: memory is bounded by a batch of
files, nothing is shuffled, and a lost task is simply run again.

Defined cases: a null file has no packets; a file that is cut short or malformed gives the
packets before the fault and a row whose `error` says what is wrong; an empty
payload is stored as one block of 64 zero bytes; equal payloads give equal
files; an empty table gives an empty result; other columns aren't looked at.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lakesift.llm.common import table

# Element ids of the public Matroska and EBML specifications.
EBML, EBML_VERSION, EBML_READ_VERSION, EBML_MAX_ID, EBML_MAX_SIZE = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3
DOC_TYPE, DOC_TYPE_VERSION, DOC_TYPE_READ_VERSION = 0x4282, 0x4287, 0x4285
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS = 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469
TIMESTAMP_SCALE, DURATION, MUXING_APP, WRITING_APP = 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, CODEC_ID = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x86
DEFAULT_DURATION, AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0x23E383, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER_TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
#: Elements that end a cluster of unknown size.
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, CHAPTERS, TAGS, ATTACHMENTS}
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3

PAD = 64
RATE = 8000
FRAME = 256
FRAMES_PER_BLOCK = 8
BLOCKS_PER_CLUSTER = 32


@dataclass
class Media:
    """What a file holds. packets: (track, timestamp in ns, offset, size, key, lacing, cluster)."""

    scale: int = 1_000_000
    duration: float = 0.0
    tracks: dict[int, dict] = field(default_factory=dict)
    clusters: list[int] = field(default_factory=list)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    cues: list[tuple[int, int, int, bool]] = field(default_factory=list)
    error: str | None = None


class Malformed(ValueError):
    pass


def _vint(data: bytes, at: int, end: int) -> tuple[int, int, bool]:
    """A number of variable length: its value, where it ends, and whether all of its bits are set (unknown)."""
    if at >= end:
        raise Malformed(f"no number at byte {at}")
    first = data[at]
    length = 9 - first.bit_length()
    if length > 8 or at + length > end:
        raise Malformed(f"bad number at byte {at}")
    value = int.from_bytes(data[at : at + length], "big") & ((1 << 7 * length) - 1)
    return value, at + length, value == (1 << 7 * length) - 1


def elements(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int, int | None]]:
    """(id, where the element begins, where its content begins, where that ends or None for an unknown size)."""
    while at < end:
        start, length = at, 9 - data[at].bit_length()
        if length > 4 or at + length > end:
            raise Malformed(f"bad element id at byte {at}")
        name = int.from_bytes(data[at : at + length], "big")
        size, at, unknown = _vint(data, at + length, end)
        if not unknown and at + size > end:
            raise Malformed(f"element {name:X} at byte {start} runs past byte {end}")
        stop = None if unknown else at + size
        yield name, start, at, stop
        if stop is None:
            return  # the caller goes on inside
        at = stop


def _inside(data: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(id, where the content begins, where it ends) of elements whose size must be known."""
    for name, start, begin, stop in elements(data, at, end):
        if stop is None:
            raise Malformed(f"element {name:X} of unknown size at byte {start}")
        yield name, begin, stop


def _uint(data: bytes, at: int, end: int) -> int:
    if end - at > 8:
        raise Malformed(f"number of {end - at} bytes at byte {at}")
    return int.from_bytes(data[at:end], "big")


def _long(value: int, at: int) -> int:
    """The value, if a signed long holds it."""
    if not -(1 << 63) <= value < 1 << 63:
        raise Malformed(f"number out of range at byte {at}")
    return value


def _float(data: bytes, at: int, end: int) -> float:
    if end - at not in (0, 4, 8):
        raise Malformed(f"bad float at byte {at}")
    return 0.0 if end == at else struct.unpack(">f" if end - at == 4 else ">d", data[at:end])[0]


def _lace(data: bytes, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(offset, size) of each frame of a block's content, which begins after the block's header."""
    if lacing == NO_LACING:
        return [(at, end - at)]
    if at >= end:
        raise Malformed(f"no lace at byte {at}")
    count, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if lacing == FIXED:
        if (end - at) % count:
            raise Malformed(f"uneven fixed lace at byte {at}")
        sizes = [(end - at) // count] * count
    elif lacing == XIPH:
        for _ in range(count - 1):
            size = 0
            while True:
                if at >= end:
                    raise Malformed(f"lace cut short at byte {at}")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
        sizes.append(end - at - sum(sizes))
    else:
        for k in range(count - 1):
            begin = at
            value, at, _ = _vint(data, at, end)
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * (at - begin) - 1) - 1))
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Malformed(f"lace larger than its block at byte {at}")
    out = []
    for size in sizes:
        out.append((at, size))
        at += size
    return out


def _block(media: Media, data: bytes, at: int, end: int, base: int, key: bool | None) -> None:
    track, at, _ = _vint(data, at, end)
    if at + 3 > end:
        raise Malformed(f"block cut short at byte {at}")
    relative, flags = struct.unpack_from(">hB", data, at)
    lacing = flags >> 1 & 3
    step = media.tracks.get(track, {}).get("default_duration", 0)
    begin = (base + relative) * media.scale
    _long(begin + 255 * step, at)
    whole, here = bool(flags & 0x80) if key is None else key, len(media.clusters) - 1
    for k, (offset, size) in enumerate(_lace(data, at + 3, end, lacing)):
        media.packets.append((track, _long(begin, at) + k * step, offset, size, whole, lacing, here))


def _cluster(media: Media, data: bytes, start: int, at: int, end: int | None, limit: int) -> int:
    """Reads a cluster; gives where it ends."""
    media.clusters.append(start)
    base, stop = 0, limit if end is None else end
    for name, begin, inner, close in elements(data, at, stop):
        if end is None and name in TOP_LEVEL:
            return begin
        if close is None:
            raise Malformed(f"element {name:X} of unknown size at byte {begin}")
        if name == CLUSTER_TIMESTAMP:
            base = _uint(data, inner, close)
        elif name == SIMPLE_BLOCK:
            _block(media, data, inner, close, base, None)
        elif name == BLOCK_GROUP:
            parts = {n: (a, b) for n, a, b in _inside(data, inner, close)}
            if BLOCK in parts:
                _block(media, data, *parts[BLOCK], base, REFERENCE_BLOCK not in parts)
    return stop


def _track(data: bytes, at: int, end: int) -> tuple[int, dict]:
    number, out = 0, {}
    for name, a, b in _inside(data, at, end):
        if name == TRACK_NUMBER:
            number = _uint(data, a, b)
        elif name == TRACK_TYPE:
            out["type"] = _uint(data, a, b)
        elif name == CODEC_ID:
            out["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif name == DEFAULT_DURATION:
            out["default_duration"] = _uint(data, a, b)
        elif name == AUDIO:
            for inner, c, d in _inside(data, a, b):
                if inner == SAMPLING_FREQUENCY:
                    out["rate"] = _float(data, c, d)
                elif inner == CHANNELS:
                    out["channels"] = _uint(data, c, d)
                elif inner == BIT_DEPTH:
                    out["bits"] = _uint(data, c, d)
    return number, out


def _segment(media: Media, data: bytes, at: int, end: int) -> None:
    origin, points = at, []
    while at < end:
        name, start, inner, close = next(elements(data, at, end))
        if name == CLUSTER:
            at = _cluster(media, data, start, inner, close, end)
            continue
        if close is None:
            raise Malformed(f"element {name:X} of unknown size at byte {start}")
        if name == INFO:
            for n, a, b in _inside(data, inner, close):
                if n == TIMESTAMP_SCALE:
                    media.scale = _uint(data, a, b)
                elif n == DURATION:
                    media.duration = _float(data, a, b)
        elif name == TRACKS:
            media.tracks |= dict(_track(data, a, b) for n, a, b in _inside(data, inner, close) if n == TRACK_ENTRY)
        elif name == CUES:
            for n, a, b in _inside(data, inner, close):
                if n != CUE_POINT:
                    continue
                time = 0
                for m, c, d in _inside(data, a, b):
                    if m == CUE_TIME:
                        time = _uint(data, c, d)
                    elif m == CUE_TRACK_POSITIONS:
                        got = {x: _uint(data, p, q) for x, p, q in _inside(data, c, d) if x in (CUE_TRACK, CUE_CLUSTER_POSITION)}
                        points.append((time, got.get(CUE_TRACK, 0), got.get(CUE_CLUSTER_POSITION, -1)))
        at = close
    known = set(media.clusters)
    media.cues = [(_long(time * media.scale, at), track, origin + where, origin + where in known) for time, track, where in points]


def demux(data: bytes) -> Media:
    media = Media()
    try:
        at, seen = 0, False
        while at < len(data):
            name, start, inner, close = next(elements(data, at, len(data)))
            if not seen and name != EBML:
                raise Malformed("no EBML header")
            seen = True
            if name == SEGMENT:
                _segment(media, data, inner, len(data) if close is None else close)
            elif close is None:
                raise Malformed(f"element {name:X} of unknown size at byte {start}")
            at = len(data) if close is None else close
        if not seen:
            raise Malformed("no EBML header")
    except Malformed as fault:
        media.error = str(fault)
    return media


def _size(n: int) -> bytes:
    length = 1
    while n >= (1 << 7 * length) - 1:
        length += 1
    return (n | 1 << 7 * length).to_bytes(length, "big")


def _element(name: int, content: bytes) -> bytes:
    return name.to_bytes((name.bit_length() + 7) // 8, "big") + _size(len(content)) + content


def _number(name: int, value: int) -> bytes:
    return _element(name, value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big"))


_HEADER = _element(
    EBML,
    _number(EBML_VERSION, 1) + _number(EBML_READ_VERSION, 1) + _number(EBML_MAX_ID, 4) + _number(EBML_MAX_SIZE, 8)
    + _element(DOC_TYPE, b"matroska") + _number(DOC_TYPE_VERSION, 4) + _number(DOC_TYPE_READ_VERSION, 2),
)


def lace(frames: list[bytes], lacing: int) -> bytes:
    """The lace head of a block and its frames."""
    if lacing == NO_LACING:
        return frames[0]
    sizes = [len(x) for x in frames]
    head = bytes([len(frames) - 1])
    if lacing == XIPH:
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == EBML_LACING:
        head += _size(sizes[0]) if len(frames) > 1 else b""
        for a, b in zip(sizes[:-2], sizes[1:-1]):
            length = 1
            while not -((1 << 7 * length - 1) - 1) <= b - a <= (1 << 7 * length - 1) - 1:
                length += 1
            head += (b - a + (1 << 7 * length - 1) - 1 | 1 << 7 * length).to_bytes(length, "big")
    return head + b"".join(frames)


def mux(samples: bytes, rate: int = RATE) -> bytes:
    """A Matroska file of one track of unsigned 8-bit PCM samples."""
    step = FRAME * 1_000_000_000 // rate
    info = _element(INFO, _number(TIMESTAMP_SCALE, 1_000_000) + _element(DURATION, struct.pack(">d", len(samples) * 1000 / rate)) + _element(MUXING_APP, b"lakesift") + _element(WRITING_APP, b"lakesift"))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, struct.pack(">d", rate)) + _number(CHANNELS, 1) + _number(BIT_DEPTH, 8))
    track = _number(TRACK_NUMBER, 1) + _number(TRACK_UID, 1) + _number(TRACK_TYPE, 2) + _number(FLAG_LACING, 1) + _number(DEFAULT_DURATION, step)
    parts = [info, _element(TRACKS, _element(TRACK_ENTRY, track + _element(CODEC_ID, b"A_PCM/INT/LIT") + audio))]
    at, cues = sum(map(len, parts)), []
    per_block, per_cluster = FRAME * FRAMES_PER_BLOCK, FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for begin in range(0, len(samples), per_cluster):
        time = begin * 1000 // rate
        blocks = [_number(CLUSTER_TIMESTAMP, time)]
        for where in range(begin, min(begin + per_cluster, len(samples)), per_block):
            piece = samples[where : where + per_block]
            frames = [piece[k : k + FRAME] for k in range(0, len(piece), FRAME)]
            even = len(frames) > 1 and len(piece) % FRAME == 0
            lacing = NO_LACING if len(frames) == 1 else FIXED if even and where // per_block % 2 == 0 else EBML_LACING if even or where // per_block % 2 else XIPH
            blocks.append(_element(SIMPLE_BLOCK, b"\x81" + struct.pack(">hB", where * 1000 // rate - time, 0x80 | lacing << 1) + lace(frames, lacing)))
        cluster = _element(CLUSTER, b"".join(blocks))
        cues.append(_element(CUE_POINT, _number(CUE_TIME, time) + _element(CUE_TRACK_POSITIONS, _number(CUE_TRACK, 1) + _number(CUE_CLUSTER_POSITION, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEADER + _element(SEGMENT, b"".join(parts))


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (-len(text) % PAD or (0 if text else PAD))


def read_back(media: Media, data: bytes, track: int = 1) -> bytes:
    return b"".join(data[at : at + size] for n, _, at, size, *_ in media.packets if n == track)


def feature(media: Media, samples: bytes) -> str:
    """Numbers of tracks, clusters, packets, laced packets and good cues, time in ms, then level, power and sign changes of the samples."""
    wave = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    laced = sum(x[5] != NO_LACING for x in media.packets)
    end = media.packets[-1][1] // 1_000_000 if media.packets else 0
    crossings = int(np.count_nonzero((wave[1:] < 0) != (wave[:-1] < 0)))
    return (
        f"tracks={len(media.tracks)};clusters={len(media.clusters)};packets={len(media.packets)};laced={laced};cues={sum(x[3] for x in media.cues)};"
        f"last_ms={end};level={wave.sum()};power={(wave * wave).sum()};crossings={crossings}"
    )


def packet_table(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """A row for each packet of each file, and one with the error of each faulty file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                media = demux(data) if data is not None else Media()
                rows = [(key, k, *x, media.tracks.get(x[0], {}).get("codec"), None) for k, x in enumerate(media.packets)]
                if media.error:
                    rows.append((key, len(rows), *[None] * 8, media.error))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["id", "packet", "track", "timestamp_ns", "offset", "size", "key", "lacing", "cluster", "codec", "error"]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.string(), pa.string()]
    schema = "id string, packet long, track long, timestamp_ns long, offset long, size long, key boolean, lacing int, cluster int, codec string, error string"
    return df.selectExpr(f"cast(`{id_col}` as string) as id", f"`{media_col}` as media").mapInArrow(run, schema)


def stored(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text as a media file, read back through its packets; the file's and the payload's digests and features."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                data = mux(payload_of(text or b""))
                media = demux(data)
                if media.error:
                    raise Malformed(media.error)
                back = read_back(media, data)
                rows.append((key, len(text or b""), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-PAD:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, back)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return df.selectExpr(f"cast(`{id_col}` as long) as doc_id", f"`{text_col}` as text").mapInArrow(run, schema)


def op2_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored(table(spark, sf_dir, "documents"))
