"""Media columns in Matroska: text payloads stored as 8-bit PCM in laced blocks, and a parser that turns a media
column into packet tables with timestamps, tracks and byte ranges.

A null text is the empty payload. An empty payload is one packet of padding. Extra columns are ignored; repeated
rows give repeated results; equal texts give equal bytes, as nothing in a file depends on time or chance.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

from pyspark.sql import DataFrame

from . import common

# Element ids of the Matroska and EBML specifications.
EBML, SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1
CUES, CUE_POINT, CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
EBML_VERSION, EBML_READ, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ = 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SCALE, MUXER, WRITER, DURATION = 0x2AD7B1, 0x4D80, 0x5741, 0x4489
NUMBER, UID, TYPE, LACING, CODEC, RATE, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xB5, 0x9F, 0x6264
#: Elements that hold elements.
MASTERS = {SEGMENT, TRACKS, TRACK_ENTRY, INFO, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_POSITIONS}
#: Level-1 elements, which end a cluster of unknown size.
LEVEL_1 = {CLUSTER, CUES, TRACKS, INFO, 0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}

FRAME = 576  # bytes, and as 8-bit mono also samples, of a packet
FRAME_MS = 72  # at 8000 samples a second
LACED = 8  # packets of a block
CLUSTERED = 64  # packets of a cluster


def _size(n: int, width: int = 0) -> bytes:
    """Variable-length size; the all-ones pattern of a width means unknown and is left out."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return ((1 << 7 * width) | n).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + _size(len(body)) + body


def _uint(ident: int, n: int) -> bytes:
    return _element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = _element(EBML, _uint(EBML_VERSION, 1) + _uint(EBML_READ, 1) + _uint(MAX_ID, 4) + _uint(MAX_SIZE, 8) + _element(DOC_TYPE, b"matroska") + _uint(DOC_VERSION, 4) + _uint(DOC_READ, 2))
_TRACKS = _element(TRACKS, _element(TRACK_ENTRY, _uint(NUMBER, 1) + _uint(UID, 1) + _uint(TYPE, 2) + _uint(LACING, 1) + _element(CODEC, b"A_PCM/INT/LIT") + _element(AUDIO, _element(RATE, struct.pack(">d", 8000.0)) + _uint(CHANNELS, 1) + _uint(DEPTH, 8))))


def pad(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of a packet."""
    return data + b"\xff" * (-len(data) % FRAME or (0 if data else FRAME))


def encode(payload: bytes) -> bytes:
    """A Matroska file whose packets are the payload, a multiple of FRAME bytes. Blocks of several packets use fixed-size lacing."""
    frames = len(payload) // FRAME
    info = _element(INFO, _uint(SCALE, 1_000_000) + _element(MUXER, b"granary") + _element(WRITER, b"granary") + _element(DURATION, struct.pack(">d", float(frames * FRAME_MS))))
    parts, at, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    for first in range(0, frames, CLUSTERED):
        last = min(first + CLUSTERED, frames)
        body = [_uint(TIMESTAMP, first * FRAME_MS)]
        for block in range(first, last, LACED):
            n = min(LACED, last - block)
            head = b"\x81" + struct.pack(">hB", (block - first) * FRAME_MS, 0x84 if n > 1 else 0x80) + (bytes([n - 1]) if n > 1 else b"")
            body.append(_element(SIMPLE_BLOCK, head + payload[block * FRAME : (block + n) * FRAME]))
        cluster = _element(CLUSTER, b"".join(body))
        cues.append(_element(CUE_POINT, _uint(CUE_TIME, first * FRAME_MS) + _element(CUE_POSITIONS, _uint(CUE_TRACK, 1) + _uint(CUE_CLUSTER, at))))
        parts.append(cluster)
        at += len(cluster)
    parts.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(parts))


def _vint(data, at: int, keep_marker: bool = False) -> tuple[int, int, bool]:
    """Value, next offset and whether it is the unknown size, of the variable-length integer at an offset."""
    first = data[at]
    if not first:
        raise ValueError(f"no variable-length integer at {at}")
    width = 9 - first.bit_length()
    if at + width > len(data):
        raise ValueError(f"cut variable-length integer at {at}")
    whole = int.from_bytes(data[at : at + width], "big")
    value = whole & ((1 << 7 * width) - 1)
    return (whole if keep_marker else value), at + width, value == (1 << 7 * width) - 1


def elements(data, at: int, end: int) -> Iterator[tuple[int, int, int, bool]]:
    """(id, start of the body, end of the body, unknown size) of the elements between two offsets."""
    while at < end:
        ident, at, _ = _vint(data, at, True)
        size, at, unknown = _vint(data, at)
        stop = end if unknown else at + size
        if unknown and ident == CLUSTER:
            pos = at
            while pos < end:  # a cluster of unknown size ends where the next level-1 element begins
                inner, body, _ = _vint(data, pos, True)
                if inner in LEVEL_1:
                    break
                n, body, _ = _vint(data, body)
                pos = body + n
            stop = pos
        if stop > end:
            raise ValueError(f"element {ident:X} at {at} goes beyond its parent")
        yield ident, at, stop, unknown
        at = stop


def laced(data, at: int, end: int, kind: int) -> list[tuple[int, int]]:
    """(offset, size) of the packets of a block whose lacing head begins at an offset; kind: 0 none, 1 Xiph, 2 fixed, 3 EBML."""
    if kind == 0:
        return [(at, end - at)]
    count, at = data[at] + 1, at + 1
    if kind == 2:
        each, rest = divmod(end - at, count)
        if rest:
            raise ValueError("fixed-size lacing doesn't divide the block")
        return [(at + i * each, each) for i in range(count)]
    sizes: list[int] = []
    for i in range(count - 1):
        if kind == 1:
            n = 0
            while data[at] == 255:
                n, at = n + 255, at + 1
            n, at = n + data[at], at + 1
        else:
            value, after, _ = _vint(data, at)
            n = value if i == 0 else sizes[-1] + value - ((1 << 7 * (after - at) - 1) - 1)
            at = after
        sizes.append(n)
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("lacing goes beyond its block")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return out


def parse(data) -> dict:
    """Tracks, packets (track, timestamp in ms, offset, size, key frame), cues and duration of one file."""
    found: dict = {"tracks": [], "packets": [], "cues": [], "clusters": 0, "duration_ms": 0.0}
    number = lambda a, b: int.from_bytes(data[a:b], "big")
    segment, scale, blocks = 0, 1_000_000, []
    # (element range, cluster time, open cue or track)
    for ident, a, b, _ in elements(data, 0, len(data)):
        if ident != SEGMENT:
            continue
        segment = a
        for kind, x, y, _ in elements(data, a, b):
            if kind == INFO:
                for k, s, e, _ in elements(data, x, y):
                    if k == SCALE:
                        scale = number(s, e)
                    elif k == DURATION:
                        found["duration_ms"] = struct.unpack(">d" if e - s == 8 else ">f", data[s:e])[0]
            elif kind == TRACKS:
                for k, s, e, _ in elements(data, x, y):
                    if k == TRACK_ENTRY:
                        track = {i: (p, q) for i, p, q, _ in elements(data, s, e)}
                        found["tracks"].append((number(*track[NUMBER]), bytes(data[slice(*track[CODEC])]).decode()))
            elif kind == CLUSTER:
                found["clusters"] += 1
                time = 0
                for k, s, e, _ in elements(data, x, y):
                    if k == TIMESTAMP:
                        time = number(s, e)
                    elif k == SIMPLE_BLOCK:
                        blocks.append((time, s, e, bool(data[_vint(data, s)[1] + 2] & 0x80)))
                    elif k == BLOCK_GROUP:
                        blocks += [(time, s2, e2, True) for k2, s2, e2, _ in elements(data, s, e) if k2 == BLOCK]
            elif kind == CUES:
                for k, s, e, _ in elements(data, x, y):
                    cue = {i: (p, q) for i, p, q, _ in elements(data, s, e)}
                    where = {i: (p, q) for i, p, q, _ in elements(data, *cue[CUE_POSITIONS])}
                    found["cues"].append((number(*cue[CUE_TIME]), number(*where[CUE_TRACK]), segment + number(*where[CUE_CLUSTER])))
    for time, s, e, key in blocks:
        track, at, _ = _vint(data, s)
        relative = struct.unpack(">h", data[at : at + 2])[0]
        packets = laced(data, at + 3, e, data[at + 2] >> 1 & 3)
        for i, (offset, size) in enumerate(packets):
            # Packets of one lace follow each other at the track's rate of a byte a sample.
            found["packets"].append((track, (time + relative) * scale // 1_000_000 + i * size * 1000 // 8000, offset, size, key))
    return found


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (binary) of docs(doc_id, text, ...).

    A null text is empty; an empty one is padded like any other, a very long one is stored whole in as many clusters as it
    needs; equal texts and repeated rows get equal media; extra columns are ignored; an empty table gives no rows.
    """

    def write(batches):
        import pyarrow as pa

        for b in batches:
            texts = [(b.column(1)[i].as_py() or "").encode("utf-8") for i in range(b.num_rows)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in texts], pa.int64()), pa.array([encode(pad(x)) for x in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    common.small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """One row for each packet of media(doc_id, media): track, timestamp_ms, byte offset and size, key frame. A null media has none."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            rows = [(b.column(0)[i].as_py(), k, *p) for i in range(b.num_rows) if (m := b.column(1)[i].as_py()) is not None for k, p in enumerate(parse(m)["packets"])]
            cols = list(zip(*rows, strict=True)) or [()] * 7
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "packet", "track", "timestamp_ms", "offset", "size", "key"])

    return media.select("doc_id", "media").mapInArrow(read, "doc_id long, packet long, track long, timestamp_ms long, offset long, size long, key boolean")


def media_features(media: DataFrame) -> DataFrame:
    """Digests of media(doc_id, n_bytes, media) computed from the packets that the parser finds in the stored bytes; a null media has none, and its row stays."""

    def read(batches):
        import pyarrow as pa

        for b in batches:
            out: list[tuple] = []
            for i in range(b.num_rows):
                m = b.column(2)[i].as_py()
                if m is None:
                    out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), *[None] * 6))
                    continue
                found = parse(m)
                payload = b"".join(m[o : o + n] for _, _, o, n, _ in found["packets"])
                marks = {at for _, _, at in found["cues"]}
                seekable = sum(m[at : at + 4] == b"\x1fC\xb6u" for at in marks)
                feature = f"codec={found['tracks'][0][1]};packets={len(found['packets'])};clusters={found['clusters']};cues={seekable};duration_ms={found['duration_ms']:.0f};last_ms={found['packets'][-1][1]};mean={sum(payload) / len(payload):.4f}"
                out.append((b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature))
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=NAMES)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(read, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


NAMES = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
