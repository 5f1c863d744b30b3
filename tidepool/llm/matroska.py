"""Matroska: write and parse EBML files of laced audio blocks; packet, track and cue tables.

The parser follows RFC 8794 (EBML) and RFC 9559 (Matroska): identifiers and sizes of variable length, unknown sizes of
Segment and Cluster, SimpleBlocks and BlockGroups, all four lacings and cues. Byte ranges are positions in the file, so a
packet can be read without parsing again.

A null file has no packets, tracks or cues. A broken or truncated file gives what precedes the fault, and the fault in the
column `error` of media_summary(). Columns other than the id and the file are ignored; equal files give equal rows; an empty
table gives empty tables. Null and repeated ids are carried along. A text of any length that a binary value holds (2 GB) becomes one
file; a task holds one file and its packet table, and hands files on every OUT_BYTES.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepool.llm.common import small_batches

# Fixed values of the format.
EBML, DOC_TYPE = 0x1A45DFA3, 0x4282
SEGMENT, INFO, TRACKS, CLUSTER, CUES = 0x18538067, 0x1549A966, 0x1654AE6B, 0x1F43B675, 0x1C53BB6B
SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS = 0x114D9B74, 0x1254C367, 0x1043A770, 0x1941A469
TIMESTAMP_SCALE, DURATION = 0x2AD7B1, 0x4489
TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, CODEC_ID, DEFAULT_DURATION = 0xAE, 0xD7, 0x73C5, 0x83, 0x86, 0x23E383
AUDIO, SAMPLING_FREQUENCY, CHANNELS, BIT_DEPTH = 0xE1, 0xB5, 0x9F, 0x6264
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE_BLOCK = 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION, CUE_RELATIVE_POSITION = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1, 0xF0
TOP_LEVEL = {INFO, TRACKS, CLUSTER, CUES, SEEK_HEAD, TAGS, CHAPTERS, ATTACHMENTS}
LACINGS = ("none", "xiph", "fixed", "ebml")

#: Bytes of files that a task hands on together.
OUT_BYTES = 32 << 20
RATE, FRAME, FRAMES_PER_BLOCK, BLOCKS_PER_CLUSTER = 8000, 512, 8, 16
UNIT = 64


class Broken(ValueError):
    pass


# --- writing ---


def size_bytes(n: int, width: int = 0) -> bytes:
    """A size as EBML writes it, in as few bytes as hold it, or in `width`."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(ident: int, body: bytes) -> bytes:
    return ident.to_bytes((ident.bit_length() + 7) // 8, "big") + size_bytes(len(body)) + body


def number(ident: int, n: int) -> bytes:
    return element(ident, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def block(ident: int, track: int, relative: int, frames: list[bytes], lacing: str, flags: int = 0x80) -> bytes:
    """A (Simple)Block of some frames; fixed lacing takes frames of one size only."""
    kind = LACINGS.index(lacing)
    head = size_bytes(track) + struct.pack(">hB", relative, (flags | kind << 1) & 0xFF)
    sizes = [len(f) for f in frames]
    if kind:
        head += bytes([len(frames) - 1])
    if lacing == "xiph":
        head += b"".join(b"\xff" * (n // 255) + bytes([n % 255]) for n in sizes[:-1])
    elif lacing == "ebml" and len(frames) > 1:
        head += size_bytes(sizes[0])
        for d in (b - a for a, b in zip(sizes[:-2], sizes[1:-1], strict=True)):
            width = next(w for w in range(1, 9) if abs(d) < (1 << 7 * w - 1) - 1)
            head += size_bytes(d + (1 << 7 * width - 1) - 1, width)
    elif lacing == "fixed" and len(set(sizes)) > 1:
        raise ValueError("fixed lacing needs frames of one size")
    return element(ident, head + b"".join(frames))


def mux(payload: bytes, lacing: str = "auto") -> bytes:
    """payload as 8-bit mono PCM samples in a Matroska file: laced SimpleBlocks in clusters, and a cue for each cluster."""
    header = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(DOC_TYPE, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
    info = element(INFO, number(TIMESTAMP_SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(0x4D80, b"tidepool") + element(0x5741, b"tidepool"))
    audio = element(AUDIO, element(SAMPLING_FREQUENCY, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))
    tracks = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + element(CODEC_ID, b"A_PCM/INT/LIT") + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + audio))
    parts, at, cues = [info, tracks], len(info) + len(tracks), []
    per_cluster = FRAME * FRAMES_PER_BLOCK * BLOCKS_PER_CLUSTER
    for start in range(0, len(payload), per_cluster):
        time = start * 1000 // RATE
        blocks = []
        for first in range(start, min(start + per_cluster, len(payload)), FRAME * FRAMES_PER_BLOCK):
            frames = [payload[i : i + FRAME] for i in range(first, min(first + FRAME * FRAMES_PER_BLOCK, len(payload)), FRAME)]
            how = lacing if lacing != "auto" else "none" if len(frames) == 1 else "fixed" if len(frames[-1]) == FRAME else "ebml"
            blocks.append(block(SIMPLE_BLOCK, 1, first * 1000 // RATE - time, frames, how))
        body = element(CLUSTER, number(TIMESTAMP, time) + b"".join(blocks))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, at))))
        parts.append(body)
        at += len(body)
    return header + element(SEGMENT, b"".join(parts) + element(CUES, b"".join(cues)))


# --- parsing ---


@dataclass
class Media:
    doc_type: str = ""
    scale: int = 1_000_000
    tracks: list[dict] = field(default_factory=list)
    packets: list[tuple] = field(default_factory=list)  # track, timestamp_ns, keyframe, lacing, frame, cluster, start, length
    cues: list[tuple] = field(default_factory=list)  # track, timestamp_ns, cluster
    clusters: int = 0
    error: str | None = None


def read_size(data: bytes, at: int, end: int, keep_marker: bool = False) -> tuple[int | None, int]:
    """(number, next position). None: all ones, the unknown size."""
    if at >= end or not data[at]:
        raise Broken(f"no variable-length number at {at}")
    width = 9 - data[at].bit_length()
    if at + width > end:
        raise Broken(f"cut off at {at}")
    n = int.from_bytes(data[at : at + width], "big")
    if keep_marker:
        return n, at + width
    n &= (1 << 7 * width) - 1
    return (None if n == (1 << 7 * width) - 1 else n), at + width


def children(data: bytes, at: int, end: int, stop: set[int] = frozenset()) -> Iterator[tuple[int, int, int, bool]]:
    """(identifier, body's start, body's end, whether it is cut off) of the elements from `at`; ends before one of `stop`."""
    while at < end:
        ident, body = read_size(data, at, end, keep_marker=True)
        if ident in stop:
            return
        n, body = read_size(data, body, end)
        if n is None:
            if ident == CLUSTER:
                last = body
                try:
                    for _, _, last, _ in children(data, body, end, TOP_LEVEL):
                        pass
                except Broken:  # whoever reads the cluster meets the fault after what precedes it
                    last = end
            elif ident == SEGMENT:
                last = end
            else:
                raise Broken(f"unknown size at {at}")
        else:
            last = body + n
        if last > end:
            yield ident, body, end, True
            raise Broken(f"cut off at {end}")
        yield ident, body, last, False
        at = last


def integer(data: bytes, start: int, end: int) -> int:
    return int.from_bytes(data[start:end], "big")


def real(data: bytes, start: int, end: int) -> float:
    return struct.unpack({4: ">f", 8: ">d"}[end - start], data[start:end])[0] if end > start else 0.0


def frames_of(data: bytes, start: int, end: int) -> tuple[int, int, int, str, list[tuple[int, int]]]:
    """(track, relative time, flags, lacing, byte ranges) of a block."""
    track, at = read_size(data, start, end)
    if at + 3 > end:
        raise Broken(f"cut off at {at}")
    relative, flags = struct.unpack(">hB", data[at : at + 3])
    at += 3
    lacing = LACINGS[flags >> 1 & 3]
    if lacing == "none":
        return track, relative, flags, lacing, [(at, end - at)]
    if at >= end:
        raise Broken(f"cut off at {at}")
    count = data[at] + 1
    at += 1
    sizes: list[int] = []
    if lacing == "fixed":
        if (end - at) % count:
            raise Broken(f"uneven fixed lacing at {at}")
        sizes = [(end - at) // count] * count
    else:
        for i in range(count - 1):
            if lacing == "xiph":
                n = 0
                while True:
                    if at >= end:
                        raise Broken(f"cut off at {at}")
                    n += data[at]
                    at += 1
                    if data[at - 1] != 255:
                        break
            else:
                before = at
                n, at = read_size(data, at, end)
                if n is None:
                    raise Broken(f"unknown lace size at {before}")
                if i:
                    n += sizes[-1] - ((1 << 7 * (at - before) - 1) - 1)
            sizes.append(n)
        sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise Broken(f"laces pass the block's end at {at}")
    out = []
    for n in sizes:
        out.append((at, n))
        at += n
    return track, relative, flags, lacing, out


def parse(data: bytes | None) -> Media:
    out = Media()
    if data is None:
        return out
    try:
        for ident, a, b, _ in children(data, 0, len(data)):
            if ident == EBML:
                for i, x, y, _ in children(data, a, b):
                    if i == DOC_TYPE:
                        out.doc_type = data[x:y].rstrip(b"\0").decode("ascii", "replace")
            elif ident == SEGMENT:
                _segment(data, a, b, out)
    except (Broken, KeyError, struct.error) as e:
        out.error = str(e) or type(e).__name__
    return out


def _segment(data: bytes, start: int, end: int, out: Media) -> None:
    cues = []
    for ident, a, b, _ in children(data, start, end):
        if ident == INFO:
            for i, x, y, _ in children(data, a, b):
                if i == TIMESTAMP_SCALE:
                    out.scale = integer(data, x, y)
        elif ident == TRACKS:
            out.tracks += [_track(data, x, y) for i, x, y, _ in children(data, a, b) if i == TRACK_ENTRY]
        elif ident == CLUSTER:
            out.clusters += 1
            _cluster(data, a, b, out)
        elif ident == CUES:
            for i, x, y, _ in children(data, a, b):
                if i == CUE_POINT:
                    time, places = 0, []
                    for j, p, q, _ in children(data, x, y):
                        if j == CUE_TIME:
                            time = integer(data, p, q)
                        elif j == CUE_TRACK_POSITIONS:
                            places.append({k: integer(data, m, n) for k, m, n, _ in children(data, p, q) if k in (CUE_TRACK, CUE_CLUSTER_POSITION)})
                    cues += [(p.get(CUE_TRACK), time, start + p.get(CUE_CLUSTER_POSITION, 0)) for p in places]
    out.cues = [(track, time * out.scale, at) for track, time, at in cues]


def _track(data: bytes, start: int, end: int) -> dict:
    out = {"track": None, "kind": None, "codec": "", "default_duration_ns": None, "rate": None, "channels": None, "bits": None}
    for i, a, b, _ in children(data, start, end):
        if i == TRACK_NUMBER:
            out["track"] = integer(data, a, b)
        elif i == TRACK_TYPE:
            out["kind"] = integer(data, a, b)
        elif i == CODEC_ID:
            out["codec"] = data[a:b].rstrip(b"\0").decode("ascii", "replace")
        elif i == DEFAULT_DURATION:
            out["default_duration_ns"] = integer(data, a, b)
        elif i == AUDIO:
            for j, x, y, _ in children(data, a, b):
                if j == SAMPLING_FREQUENCY:
                    out["rate"] = real(data, x, y)
                elif j == CHANNELS:
                    out["channels"] = integer(data, x, y)
                elif j == BIT_DEPTH:
                    out["bits"] = integer(data, x, y)
    return out


def _cluster(data: bytes, start: int, end: int, out: Media) -> None:
    time, steps = 0, {t["track"]: t["default_duration_ns"] or 0 for t in out.tracks}

    def add(a: int, b: int, key: bool | None) -> None:
        track, relative, flags, lacing, ranges = frames_of(data, a, b)
        first = (time + relative) * out.scale
        out.packets += [(track, first + i * steps.get(track, 0), bool(flags & 0x80) if key is None else key, lacing, i, start, at, n) for i, (at, n) in enumerate(ranges)]

    for i, a, b, cut in children(data, start, end, TOP_LEVEL):
        if i == TIMESTAMP:
            time = integer(data, a, b)
        elif i == SIMPLE_BLOCK and not cut:
            add(a, b, None)
        elif i == BLOCK_GROUP:
            inner = list(children(data, a, b))
            key = all(j != REFERENCE_BLOCK for j, *_ in inner)
            for j, x, y, _ in inner:
                if j == BLOCK:
                    add(x, y, key)


# --- tables ---

PACKETS = "track int, timestamp_ns long, keyframe boolean, lacing string, frame int, cluster_start long, start long, length long"
TRACK_COLUMNS = "track int, kind int, codec string, default_duration_ns long, rate double, channels int, bits int"
CUE_COLUMNS = "track int, timestamp_ns long, cluster_start long"


def _table(files: DataFrame, id_col: str, data_col: str, columns: str, rows) -> DataFrame:
    names = [c.strip().split(" ")[0] for c in columns.split(",")]
    kinds = {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "double": pa.float64()}
    types = [kinds[c.strip().split(" ")[1]] for c in columns.split(",")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(i, *r) for i, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True) for r in rows(parse(data))]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], t) for k, t in enumerate([b.schema.field(0).type, *types])], [id_col, *names])

    small_batches(files.sparkSession)
    kind = dict(files.dtypes)[id_col]
    return files.select(id_col, F.col(data_col).cast("binary")).mapInArrow(run, f"`{id_col}` {kind}, {columns}")


def packets(files: DataFrame, id_col: str = "doc_id", data_col: str = "media") -> DataFrame:
    """One row a packet: track, timestamp, keyframe, lacing and byte range."""
    return _table(files, id_col, data_col, PACKETS, lambda m: m.packets)


def tracks(files: DataFrame, id_col: str = "doc_id", data_col: str = "media") -> DataFrame:
    return _table(files, id_col, data_col, TRACK_COLUMNS, lambda m: [tuple(t.values()) for t in m.tracks])


def cues(files: DataFrame, id_col: str = "doc_id", data_col: str = "media") -> DataFrame:
    """Where each cue points: the cluster's position in the file."""
    return _table(files, id_col, data_col, CUE_COLUMNS, lambda m: m.cues)


def padded(text: bytes | None) -> bytes:
    """The bytes of a text (null: none), with zeros up to a positive multiple of 64."""
    text = text or b""
    return text.ljust(max(UNIT, -(-len(text) // UNIT) * UNIT), b"\0")


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, files, begin, held = [], [], 0, 0
            for i, text in enumerate(b.column(1)):
                t = text.as_py() or b""
                sizes.append(len(t))
                files.append(mux(padded(t)))
                held += len(files[-1])
                if held > OUT_BYTES or i == len(b) - 1:
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(begin, len(files)), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], [id_col, "n_bytes", "media"])
                    sizes, files, begin, held = [], [], i + 1, 0

    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, F.col(text_col).cast("string").cast("binary").alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, media binary")


def feature(media: Media, samples: bytes) -> str:
    """What the stored form holds: structure and signal, from integers only, so equal files give equal strings."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    n = max(len(x), 1)
    crossings = int(np.count_nonzero(np.diff(x >= 0))) if len(x) else 0
    last = media.packets[-1][1] // 1_000_000 if media.packets else 0
    laced = "/".join(sorted({p[3] for p in media.packets}))
    codec = media.tracks[0]["codec"] if media.tracks else "-"
    return f"{codec} tracks={len(media.tracks)} clusters={media.clusters} cues={len(media.cues)} packets={len(media.packets)} lacing={laced} last_ms={last} mean_milli={int(x.sum()) * 1000 // n} power={int((x * x).sum()) // n} crossings={crossings}"


def media_summary(files: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Read stored files back: length and hash of the payload that their packets carry, and features of it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(2).to_pylist():
                media = parse(data)
                payload = b"".join(data[p[6] : p[6] + p[7]] for p in media.packets)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), feature(media, payload), media.error))
            types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([r[k] for r in rows], t) for k, t in enumerate(types))], [id_col, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"])

    kind = dict(files.dtypes)[id_col]
    return files.select(id_col, "n_bytes", "media").mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
