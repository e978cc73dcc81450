"""Matroska media columns: EBML elements, clusters, lacing and cues as packet tables.

`mux` stores samples in a Matroska file with one audio track; `packets` parses any Matroska bytes into
a packet table (track, timestamp, byte range of every frame), including variable-length ids and sizes,
unknown-size clusters and segments, SimpleBlocks and BlockGroups, and all four lacings.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import table, with_columns_from

# Element ids of the Matroska specification.
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES, VOID = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B, 0xEC
TIMESTAMP_SCALE, MUXING_APP, WRITING_APP, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC_ID, AUDIO = 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1
SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xB5, 0x9F, 0x6264
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
HEADER = ((0x4286, 1), (0x42F7, 1), (0x42F2, 4), (0x42F3, 8), (0x4282, b"matroska"), (0x4287, 4), (0x4285, 2))
MASTERS = {SEGMENT, TRACKS, TRACK_ENTRY, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS, INFO, AUDIO}
TOP = {CLUSTER, CUES, INFO, TRACKS, 0x114D9B74, 0x1043A770, 0x1254C367, 0x1941A469}

#: Samples of a frame, frames of a laced block, blocks of a cluster; milliseconds of a frame at 8 kHz.
FRAME, LACED, BLOCKS, FRAME_MS = 192, 16, 32, 24


def _id(n: int) -> bytes:
    return n.to_bytes((n.bit_length() + 7) // 8, "big")


def _size(n: int, width: int = 0) -> bytes:
    """`n` as a variable-length size, as short as it can be or of `width` bytes."""
    k = width or next(k for k in range(1, 9) if n < (1 << 7 * k) - 1)
    return (1 << 7 * k | n).to_bytes(k, "big")


def _element(n: int, value: bytes | int | float) -> bytes:
    if isinstance(value, int):
        value = value.to_bytes(max(1, (value.bit_length() + 7) // 8), "big")
    elif isinstance(value, float):
        value = struct.pack(">d", value)
    return _id(n) + _size(len(value)) + value


def _ebml_lace(sizes: list[int]) -> bytes:
    """Frame sizes of an EBML lace but the last: the first as a size, the others as signed differences."""
    out = [_size(sizes[0])]
    for a, b in zip(sizes, sizes[1:-1]):
        d = b - a
        k = next(k for k in range(1, 9) if abs(d) < (1 << 7 * k - 1) - 1)
        out.append((1 << 7 * k | d + (1 << 7 * k - 1) - 1).to_bytes(k, "big"))
    return b"".join(out)


def mux(samples: bytes) -> bytes:
    """A Matroska file of one 8-bit 8 kHz mono PCM track; the same samples always give the same bytes.

    Full blocks lace 16 frames at a fixed size; the last block laces what is left, its final frame
    joined from two, with EBML sizes. Every cluster has a cue.
    """
    n = -(-len(samples) // FRAME)
    head = _element(EBML, b"".join(_element(i, v) for i, v in HEADER))
    info = _element(INFO, _element(TIMESTAMP_SCALE, 1_000_000) + _element(MUXING_APP, b"scholarflow") + _element(WRITING_APP, b"scholarflow") + _element(DURATION, float(n * FRAME_MS)))
    audio = _element(AUDIO, _element(SAMPLING_FREQUENCY, 8000.0) + _element(CHANNELS, 1) + _element(BIT_DEPTH, 8))
    entry = [(TRACK_NUMBER, 1), (TRACK_UID, 1), (TRACK_TYPE, 2), (FLAG_LACING, 1), (DEFAULT_DURATION, FRAME_MS * 1_000_000), (CODEC_ID, b"A_PCM/INT/LIT")]
    body = [info, _element(TRACKS, _element(TRACK_ENTRY, b"".join(_element(i, v) for i, v in entry) + audio))]
    at, cues = sum(map(len, body)), []
    step = FRAME * LACED
    for first in range(0, len(samples), step * BLOCKS):
        time = first // FRAME * FRAME_MS
        parts = [_element(CLUSTER_TIME, time)]
        for start in range(first, min(first + step * BLOCKS, len(samples)), step):
            data = samples[start : start + step]
            frames = -(-len(data) // FRAME)
            rel = struct.pack(">Bh", 0x81, start // FRAME * FRAME_MS - time)  # track 1 as a size
            if len(data) == step:
                parts.append(_element(SIMPLE_BLOCK, rel + b"\x84" + bytes([LACED - 1]) + data))
            elif frames > 2:
                sizes = [FRAME] * (frames - 2) + [len(data) - FRAME * (frames - 2)]
                parts.append(_element(SIMPLE_BLOCK, rel + b"\x86" + bytes([len(sizes) - 1]) + _ebml_lace(sizes) + data))
            else:
                parts.append(_element(SIMPLE_BLOCK, rel + b"\x80" + data))
        cluster = _element(CLUSTER, b"".join(parts))
        cues.append(_element(CUE_POINT, _element(CUE_TIME, time) + _element(CUE_POSITIONS, _element(CUE_TRACK, 1) + _element(CUE_CLUSTER, at))))
        body.append(cluster)
        at += len(cluster)
    if cues:
        body.append(_element(CUES, b"".join(cues)))
    inside = b"".join(body)
    return head + _id(SEGMENT) + _size(len(inside), 8) + inside


class Packet(NamedTuple):
    track: int
    time: int  # in timestamp units, of the block and its place in the lace
    start: int  # byte range in the file
    end: int
    key: bool
    cluster: int


class Media(NamedTuple):
    packets: list[Packet]
    tracks: list[dict]
    cues: list[tuple[int, int, int]]  # time, track, byte position of the cluster
    scale: int
    clusters: int
    lacings: tuple[int, int, int, int]  # blocks with no, Xiph, fixed and EBML lacing


def _vint(data: bytes, at: int, keep: bool = False) -> tuple[int, int, bool]:
    """The variable-length number at `at`, where it ends, and whether it means "unknown"."""
    first = data[at]
    k = 9 - first.bit_length()
    if k > 8 or at + k > len(data):
        raise ValueError(f"no variable-length number at byte {at}")
    n = int.from_bytes(data[at : at + k], "big")
    low = n & (1 << 7 * k) - 1
    return n if keep else low, at + k, low == (1 << 7 * k) - 1


def _lace(data: bytes, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """Frame sizes of a block's payload, and where the frames start."""
    if kind == 0:
        return [end - at], at
    n, at = data[at] + 1, at + 1
    if kind == 2:
        if (end - at) % n:
            raise ValueError(f"fixed lace of {n} frames does not divide {end - at} bytes")
        return [(end - at) // n] * n, at
    sizes: list[int] = []
    for k in range(n - 1):
        if kind == 1:
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            size, at = size + data[at], at + 1
        else:
            size, after, _ = _vint(data, at)
            if k:
                size += sizes[-1] - (1 << 7 * (after - at) - 1) + 1
            at = after
        sizes.append(size)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lace runs past its block")
    return sizes, at


def packets(data: bytes) -> Media:
    """The packet table of Matroska bytes. Raises ValueError on a broken structure."""
    found: list[Packet] = []
    tracks: list[dict] = []
    cues: list[tuple[int, int, int]] = []
    scale, clusters, time, base, duration = 1_000_000, 0, 0, 0, 0
    lacings = [0, 0, 0, 0]
    cue = [0, 0, 0]
    names = {TRACK_NUMBER: "number", TRACK_TYPE: "type", CODEC_ID: "codec", DEFAULT_DURATION: "frame_ns", SAMPLING_FREQUENCY: "rate", CHANNELS: "channels", BIT_DEPTH: "bits"}
    stack: list[tuple[int, int]] = [(0, len(data))]  # element id and end
    at = 0
    frame_time: dict[int, int] = {}
    while at < len(data):
        while len(stack) > 1 and at >= stack[-1][1]:
            closed, _ = stack.pop()
            if closed == CUE_POINT:
                cues.append((cue[0], cue[1], cue[2]))
        ident, at_size, _ = _vint(data, at, keep=True)
        size, start, unknown = _vint(data, at_size)
        if ident in TOP:  # a top-level element ends a cluster of unknown size
            while len(stack) > 1 and stack[-1][0] == CLUSTER:
                stack.pop()
        end = stack[-1][1] if unknown else start + size
        if end > stack[-1][1]:
            raise ValueError(f"element {ident:#x} at byte {at} runs past its parent")
        at = end
        if ident in MASTERS:
            if ident == SEGMENT:
                base = start
            elif ident == CLUSTER:
                clusters += 1
            elif ident == TRACK_ENTRY:
                tracks.append({})
            stack.append((ident, end))
            at = start
        elif ident in (SIMPLE_BLOCK, BLOCK):
            track, p, _ = _vint(data, start)
            rel, flags = struct.unpack_from(">hB", data, p)
            kind = flags >> 1 & 3
            sizes, p = _lace(data, p + 3, end, kind)
            lacings[kind] += 1
            step = frame_time.get(track)
            if step is None:
                ns = next((t.get("frame_ns", 0) for t in tracks if t.get("number") == track), 0)
                step = frame_time[track] = ns // scale
            key = bool(flags & 0x80) or ident == BLOCK
            for i, n in enumerate(sizes):
                found.append(Packet(track, time + rel + i * step, p, p + n, key, clusters - 1))
                p += n
        elif ident in names and tracks:
            raw = data[start:end]
            tracks[-1][names[ident]] = raw.decode("ascii", "replace") if ident == CODEC_ID else struct.unpack(">d" if len(raw) == 8 else ">f", raw)[0] if ident == SAMPLING_FREQUENCY else int.from_bytes(raw, "big")
        elif ident == TIMESTAMP_SCALE:
            scale = int.from_bytes(data[start:end], "big")
        elif ident == CLUSTER_TIME:
            time = int.from_bytes(data[start:end], "big")
        elif ident in (CUE_TIME, CUE_TRACK, CUE_CLUSTER):
            cue[(CUE_TIME, CUE_TRACK, CUE_CLUSTER).index(ident)] = int.from_bytes(data[start:end], "big") + (base if ident == CUE_CLUSTER else 0)
    if any(ident == CUE_POINT for ident, _ in stack):
        cues.append((cue[0], cue[1], cue[2]))
    return Media(found, tracks, cues, scale, clusters, tuple(lacings))


def payload_of(text: str | None) -> tuple[int, bytes]:
    """Bytes of the text (null: empty), and the text padded with bytes 32 to a positive multiple of 192."""
    raw = (text or "").encode("utf-8", "replace")
    n = len(raw)
    return n, raw + b" " * (-n % FRAME or (0 if n else FRAME))


RESULT = T.StructType(
    [T.StructField("n_bytes", T.LongType()), T.StructField("payload_bytes", T.LongType()), T.StructField("payload_sha256", T.StringType())]
    + [T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("feature", T.StringType())]
)


def features(media: Media, data: bytes, samples: bytes) -> str:
    """What the packet table and the samples show, as one line of text."""
    x = np.frombuffer(samples, np.uint8)
    mean = float(x.mean()) if len(x) else 0.0
    signed = x >= 128
    crossings = int(np.count_nonzero(signed[1:] != signed[:-1]))
    last = media.packets[-1].time if media.packets else 0
    good = sum(data[p : p + 4] == _id(CLUSTER) for _, _, p in media.cues)
    return f"tracks={len(media.tracks)};clusters={media.clusters};packets={len(media.packets)};laced={media.lacings[2]}+{media.lacings[3]};cues={good};last_ms={last * media.scale // 1_000_000};mean={mean:.4f};peak={int(x.max()) if len(x) else 0};crossings={crossings}"


def store_and_read(text: str | None) -> tuple:
    n, payload = payload_of(text)
    data = mux(payload)
    media = packets(data)
    back = b"".join([data[p.start : p.end] for p in media.packets])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    return n, len(back), sha(back), zlib.crc32(back[-16:]), len(data), sha(data), features(media, data, back)


def packet_table(media: DataFrame, column: str = "media") -> DataFrame:
    """One row per frame of the Matroska bytes in `column`: the other columns, then track, time, byte range, key, cluster.

    Bytes that are null or broken give no rows.
    """
    from pyspark.sql import functions as F

    row = T.StructType([T.StructField("track", T.IntegerType()), T.StructField("time", T.LongType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("key", T.BooleanType()), T.StructField("cluster", T.IntegerType())])

    def rows(data):
        try:
            return ([tuple(p) for p in packets(bytes(data)).packets],) if data is not None else (None,)
        except (ValueError, IndexError, struct.error):
            return (None,)

    out = with_columns_from(media, column, T.StructType([T.StructField("packets", T.ArrayType(row))]), lambda: lambda values: [rows(v) for v in values])
    return out.select(*[c for c in media.columns if c != column], F.explode("_out.packets").alias("_p")).select(*[c for c in media.columns if c != column], "_p.*")


def media_columns(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` with a struct `_out` of digests and features of the text stored as Matroska and read back."""
    return with_columns_from(docs, text, RESULT, lambda: lambda values: [store_and_read(v) for v in values])


def op4_matroska(spark, sf_dir: str) -> DataFrame:
    """One row per document; a null text counts as empty, and an empty one has a payload of 192 spaces."""
    return media_columns(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "_out.*")
