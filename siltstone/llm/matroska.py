"""Matroska media columns: an EBML parser that turns files into packet tables, and a writer for lossless payloads.

The parser walks variable-length elements (known and unknown sizes), reads tracks, clusters, simple blocks and block
groups, undoes all four lacings (none, Xiph, fixed, EBML) and reads the cues. A packet is one frame: its track,
timestamp in nanoseconds, byte range in the file, key-frame flag and lacing.

The writer stores a payload as 8-bit PCM in one audio track: frames of ``FRAME`` samples, eight frames to a
fixed-size-laced block, blocks in clusters of at most ``CLUSTER_BLOCKS``, and cues to the clusters. The file depends on
the payload alone.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, sized, table, utf8

# Element ids of the Matroska format (fixed values).
EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
TIMESTAMP_SCALE, DURATION, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE = 0x2AD7B1, 0x4489, 0xAE, 0xD7, 0x73C5, 0x83
CODEC_ID, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH, DEFAULT_DURATION = 0x86, 0xE1, 0xB5, 0x9F, 0x6264, 0x23E383
CLUSTER_TIME, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, REFERENCE = 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
DOC_TYPE, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x4282, 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TOP = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS, SEGMENT, EBML}

FRAME, RATE, LACED, CLUSTER_BLOCKS = 576, 8000, 8, 32
#: Bytes of texts or files that a task handles at once.
MEDIA_BYTES = 8 << 20
#: Nanoseconds of a timestamp unit; a frame lasts a whole number of them, and a cluster fewer than 2^15.
UNIT = 1_000_000


def element_id(data, at: int) -> tuple[int, int]:
    """(id with its length marker, next place)."""
    n = 9 - data[at].bit_length()
    if n > 4 or at + n > len(data):
        raise ValueError("not an element id")
    return int.from_bytes(data[at : at + n], "big"), at + n


def vint(data, at: int) -> tuple[int | None, int, int]:
    """(value without its marker, next place, length); value None: all ones, an unknown size."""
    first = data[at]
    n = 9 - first.bit_length()
    if n > 8 or at + n > len(data):
        raise ValueError("not a variable-length integer")
    value = int.from_bytes(data[at : at + n], "big") & ((1 << 7 * n) - 1)
    return (None if value == (1 << 7 * n) - 1 else value), at + n, n


def children(data, at: int, end: int, unknown_in: int = 0) -> Iterator[tuple[int, int, int]]:
    """(id, first byte, end) of the elements between at and end. An element of unknown size ends where one that can't
    be its child begins, or at ``end``."""
    while at < end:
        kind, body = element_id(data, at)
        if unknown_in == CLUSTER and kind in TOP or unknown_in == SEGMENT and kind in (SEGMENT, EBML):
            return
        size, body, _ = vint(data, body)
        stop = end if size is None else body + size
        if size is None and kind == CLUSTER:
            stop = body
            for _, _, stop in children(data, body, end, CLUSTER):
                pass
        if stop > end:
            raise ValueError("an element runs past its parent")
        yield kind, body, stop
        at = stop


def number(data, at: int, end: int) -> int:
    return int.from_bytes(data[at:end], "big")


def real(data, at: int, end: int) -> float:
    return struct.unpack(">d" if end - at == 8 else ">f", data[at:end])[0] if end > at else 0.0


def frame_ranges(data, at: int, end: int, lacing: int) -> list[tuple[int, int]]:
    """(first byte, end) of each frame of a block's body."""
    if lacing == 0:
        return [(at, end)]
    n = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == 1:  # Xiph: bytes of 255 and one below
        for _ in range(n - 1):
            size = 0
            while data[at] == 255:
                size, at = size + 255, at + 1
            sizes.append(size + data[at])
            at += 1
    elif lacing == 3:  # EBML: the first size, then signed differences
        size, at, _ = vint(data, at)
        sizes.append(size)
        for _ in range(n - 2):
            raw, at, width = vint(data, at)
            raw = (1 << 7 * width) - 1 if raw is None else raw
            size += raw - ((1 << 7 * width - 1) - 1)
            sizes.append(size)
        sizes = sizes[: n - 1]
    else:
        if (end - at) % n:
            raise ValueError("frames of unequal size in a fixed-size lacing")
        sizes = [(end - at) // n] * (n - 1)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("laced frames run past their block")
    out = []
    for size in sizes:
        out.append((at, at + size))
        at += size
    return out


def parse(data: bytes) -> dict:
    """{doc_type, scale, duration, tracks: {number: {...}}, packets: [(track, ns, start, end, key, lacing)], cues: [(ns, track, place)], clusters}."""
    out: dict = {"doc_type": "", "scale": 1_000_000, "duration": None, "tracks": {}, "packets": [], "cues": [], "clusters": 0}
    durations: dict[int, int] = {}

    def block(at: int, end: int, base: int, simple: bool, key: bool) -> None:
        track, at, _ = vint(data, at)
        relative, flags = struct.unpack(">hB", data[at : at + 3])
        lacing = flags >> 1 & 3
        for i, (a, b) in enumerate(frame_ranges(data, at + 3, end, lacing)):
            ns = (base + relative) * out["scale"] + i * durations.get(track, 0)
            out["packets"].append((track, ns, a, b, bool(flags & 128) if simple else key, lacing))

    for kind, at, end in children(data, 0, len(data)):
        if kind == EBML:
            out["doc_type"] = next((bytes(data[a:b]).decode() for k, a, b in children(data, at, end) if k == DOC_TYPE), "")
        if kind != SEGMENT:
            continue
        first = at
        for k, a, b in children(data, at, end, SEGMENT):
            if k == INFO:
                for x, p, q in children(data, a, b):
                    if x == TIMESTAMP_SCALE:
                        out["scale"] = number(data, p, q)
                    elif x == DURATION:
                        out["duration"] = real(data, p, q)
            elif k == TRACKS:
                for x, p, q in children(data, a, b):
                    if x == TRACK_ENTRY:
                        track: dict = {"number": 0, "type": 0, "codec": "", "rate": None, "channels": None, "bits": None}
                        for y, r, s in children(data, p, q):
                            if y in (TRACK_NUMBER, TRACK_TYPE):
                                track["number" if y == TRACK_NUMBER else "type"] = number(data, r, s)
                            elif y == CODEC_ID:
                                track["codec"] = bytes(data[r:s]).decode()
                            elif y == DEFAULT_DURATION:
                                track["frame_ns"] = number(data, r, s)
                            elif y == AUDIO:
                                for z, t, u in children(data, r, s):
                                    if z == SAMPLING:
                                        track["rate"] = real(data, t, u)
                                    elif z in (CHANNELS, BIT_DEPTH):
                                        track["channels" if z == CHANNELS else "bits"] = number(data, t, u)
                        out["tracks"][track["number"]] = track
                        durations[track["number"]] = track.get("frame_ns", 0)
            elif k == CLUSTER:
                out["clusters"] += 1
                base = 0
                for x, p, q in children(data, a, b, CLUSTER):
                    if x == CLUSTER_TIME:
                        base = number(data, p, q)
                    elif x == SIMPLE_BLOCK:
                        block(p, q, base, True, False)
                    elif x == BLOCK_GROUP:
                        parts = list(children(data, p, q))
                        key = all(y != REFERENCE for y, _, _ in parts)
                        for y, r, s in parts:
                            if y == BLOCK:
                                block(r, s, base, False, key)
            elif k == CUES:
                for x, p, q in children(data, a, b):
                    if x == CUE_POINT:
                        when, parts = 0, []
                        for y, r, s in children(data, p, q):
                            if y == CUE_TIME:
                                when = number(data, r, s)
                            elif y == CUE_POSITIONS:
                                fields = {z: number(data, t, u) for z, t, u in children(data, r, s)}
                                parts.append((fields.get(CUE_TRACK, 0), first + fields.get(CUE_CLUSTER, 0)))
                        out["cues"] += [(when * out["scale"], t, place) for t, place in parts]
    return out


def size_bytes(n: int) -> bytes:
    width = 1
    while n >= (1 << 7 * width) - 1:
        width += 1
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(kind: int, body: bytes) -> bytes:
    return kind.to_bytes((kind.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def uint(kind: int, n: int, width: int = 0) -> bytes:
    return element(kind, n.to_bytes(width or max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, uint(0x4286, 1) + uint(0x42F7, 1) + uint(0x42F2, 4) + uint(0x42F3, 8) + element(DOC_TYPE, b"matroska") + uint(0x4287, 4) + uint(0x4285, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, uint(TRACK_NUMBER, 1) + uint(TRACK_UID, 1) + uint(TRACK_TYPE, 2) + uint(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC_ID, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + uint(CHANNELS, 1) + uint(BIT_DEPTH, 8))))


def write(payload: bytes) -> bytes:
    """A Matroska file with the payload, whose length is a multiple of FRAME, as 8-bit PCM."""
    frames, step = len(payload) // FRAME, FRAME * 10**9 // RATE // UNIT
    info = element(INFO, uint(TIMESTAMP_SCALE, UNIT) + element(DURATION, struct.pack(">d", frames * step)) + element(0x4D80, b"siltstone") + element(0x5741, b"siltstone"))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    span = CLUSTER_BLOCKS * LACED
    for first in range(0, frames, span):
        blocks = [uint(CLUSTER_TIME, first * step)]
        for f in range(first, min(first + span, frames), LACED):
            n = min(LACED, frames - f)
            head = b"\x81" + struct.pack(">hB", (f - first) * step, 0x84 if n > 1 else 0x80) + (bytes([n - 1]) if n > 1 else b"")
            blocks.append(element(SIMPLE_BLOCK, head + payload[f * FRAME : (f + n) * FRAME]))
        cluster = element(CLUSTER, b"".join(blocks))
        cues.append(element(CUE_POINT, uint(CUE_TIME, first * step) + element(CUE_POSITIONS, uint(CUE_TRACK, 1) + uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    return _HEAD + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def payload_of(text: str | None) -> tuple[bytes, int]:
    """(UTF-8 filled up with bytes 255 to a positive multiple of FRAME, its length before)."""
    raw = (text or "").encode()
    return raw + b"\xff" * (max(FRAME, -(-len(raw) // FRAME) * FRAME) - len(raw)), len(raw)


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, text -> (doc_id, n_bytes, media). Null text is empty; every row gives a file."""

    def run(batches):
        for some in sized(batches, 1, MEDIA_BYTES):
            made = [payload_of(t) for t in some.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([some.column(0).cast(pa.int64()), pa.array([n for _, n in made], pa.int64()), pa.array([write(p) for p, _ in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def packets(media: DataFrame, keep: str = "doc_id") -> DataFrame:
    """Packet table of the files in column ``media``: one row per frame. Null media has no packets; a file that can't be
    parsed has one row with its error."""

    def run(batches):
        for batch in sized(batches, 1, MEDIA_BYTES):
            for row in batch.to_pylist():
                out = []
                if row["media"] is not None:
                    try:
                        found = parse(row["media"])
                        out = [(row[keep], i, t, ns, a, b - a, key, lacing, None) for i, (t, ns, a, b, key, lacing) in enumerate(found["packets"])]
                    except (ValueError, IndexError, struct.error) as e:
                        out = [(row[keep], None, None, None, None, None, None, None, str(e))]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.string()), strict=True)], ["id", "packet", "track", "timestamp_ns", "start", "size", "key_frame", "lacing", "error"])

    return media.select(F.col(keep).cast("long").alias(keep), "media").mapInArrow(run, "id long, packet int, track int, timestamp_ns long, start long, size long, key_frame boolean, lacing int, error string").withColumnRenamed("id", keep)


def feature_of(found: dict) -> str:
    """Counts and times of a parsed file in one line."""
    p = found["packets"]
    track = found["tracks"].get(1, {})
    return (
        f"codec={track.get('codec', '')};rate={track.get('rate') or 0:.0f};bits={track.get('bits') or 0};tracks={len(found['tracks'])};clusters={found['clusters']};"
        f"cues={len(found['cues'])};packets={len(p)};laced={sum(x[5] != 0 for x in p)};key={sum(x[4] for x in p)};last_ns={p[-1][1] if p else 0};bytes={sum(x[3] - x[2] for x in p)}"
    )


def media_digest(media: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media) -> the payload gathered from the packets of each stored file, its digests and the file's
    features. Null media has nulls in all of these; a file that can't be parsed has its own length and digest, and the
    error as its feature. Every row gives one; other columns are ignored."""
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        stored = (len(data), hashlib.sha256(data).hexdigest())
        try:
            found = parse(data)
        except (ValueError, IndexError, struct.error) as e:
            return (None, None, None, *stored, f"error={e}")
        payload = b"".join([data[a:b] for _, _, a, b, _, _ in found["packets"]])
        return (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), *stored, feature_of(found))

    def run(batches):
        for some in sized(batches, 2, MEDIA_BYTES):
            out = [(row["doc_id"], row["n_bytes"], *digest(row["media"])) for row in some.to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    kinds = ", ".join(f"{n} {'string' if t == pa.string() else 'long'}" for n, t in zip(names, types, strict=True))
    return media.select("doc_id", "n_bytes", "media").mapInArrow(run, kinds)


def op4_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as Matroska in the shared folder, read back and digested."""
    return media_digest(Scratch(spark, "media").table(encode_media(table(spark, sf_dir, "documents")), "media"))
