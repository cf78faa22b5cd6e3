"""Media columns: ISO base media files in a binary column, and what their boxes say.

:func:`wrap` stores a payload losslessly as 8-bit samples of a one-track file: ``ftyp``, ``moov`` with
the sample tables, ``mdat``. :func:`probe` walks the nested boxes of such a file, decodes the
sample tables and gives codec, duration and the time and byte range of every keyframe; it reads box
headers and tables only, never the payload. :func:`media_column` writes the files to a table, and
:func:`described` reads such a table.

Cases: null text or bytes count as empty, which still fill one unit of zeros; equal payloads give
equal files; ids may be null; repeated rows repeat; texts of any length are stored whole, and files over 4 GiB
use 64-bit sizes and offsets; an empty table gives an empty result; other columns, whatever their names, are not read.
A file whose boxes overrun it, or that lacks a table, gives a ``ValueError`` naming the box.
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
from pyspark.sql import types as T

from .scratch import table

UNIT = 64
RATE = 8000
#: Samples of one chunk; each chunk starts with a sync sample.
CHUNK = 1 << 16
#: Boxes that hold boxes, with the number of bytes before the first.
NESTED = {b"moov": 0, b"trak": 0, b"mdia": 0, b"minf": 0, b"stbl": 0, b"dinf": 0, b"stsd": 8, b"edts": 0}


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, flags: int, *parts: bytes, version: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def padded(payload: bytes, unit: int = UNIT) -> bytes:
    """``payload`` with zeros up to a positive multiple of ``unit``."""
    return payload + bytes(-len(payload) % unit if payload else unit)


def wrap(payload: bytes, rate: int = RATE, chunk: int = CHUNK) -> bytes:
    """An ISO media file with ``payload`` as unsigned 8-bit mono audio: one byte a sample."""
    n = len(payload)
    chunks = max(1, -(-n // chunk))
    last = n - (chunks - 1) * chunk
    to_chunk = [(1, chunk)] if last == chunk else [(1, last)] if chunks == 1 else [(1, chunk), (chunks, last)]
    matrix = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
    entry = box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"mp41")

    def moov(first: int) -> bytes:
        at = first + chunk * np.arange(chunks, dtype=np.int64)
        wide = int(at[-1]) >= 1 << 32
        offsets = full_box(b"co64" if wide else b"stco", 0, struct.pack(">I", chunks), at.astype(">u8" if wide else ">u4").tobytes())
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, struct.pack(">III", 1, n, 1)),
            full_box(b"stsc", 0, struct.pack(">I", len(to_chunk)), *[struct.pack(">III", c, k, 1) for c, k in to_chunk]),
            full_box(b"stsz", 0, struct.pack(">II", 1, n)),
            offsets,
            full_box(b"stss", 0, struct.pack(">I", chunks), (1 + chunk * np.arange(chunks, dtype=np.int64)).astype(">u4").tobytes()),
        )
        dinf = box(b"dinf", full_box(b"dref", 0, struct.pack(">I", 1), full_box(b"url ", 1)))
        minf = box(b"minf", full_box(b"smhd", 0, bytes(4)), dinf, stbl)
        mdhd = full_box(b"mdhd", 0, struct.pack(">IIIIHH", 0, 0, rate, n, 0x55C4, 0)) if n < 1 << 32 else full_box(b"mdhd", 0, struct.pack(">QQIQHH", 0, 0, rate, n, 0x55C4, 0), version=1)
        hdlr = full_box(b"hdlr", 0, bytes(4), b"soun", bytes(12), b"samples\0")
        tkhd = full_box(b"tkhd", 7, struct.pack(">IIIII", 0, 0, 1, 0, min(n, (1 << 32) - 1)), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), matrix, bytes(8))
        mvhd = full_box(b"mvhd", 0, struct.pack(">IIIIIH", 0, 0, rate, min(n, (1 << 32) - 1), 0x10000, 0x100), bytes(10), matrix, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = 8 if n + 8 < 1 << 32 else 16
    size = len(ftyp) + len(moov(0)) + head
    while True:  # 64-bit offsets make the table itself larger
        body = moov(size)
        if len(ftyp) + len(body) + head == size:
            return ftyp + body + box(b"mdat", payload)
        size = len(ftyp) + len(body) + head


@dataclass
class Track:
    """One track's tables, decoded; ``times`` (ticks) and ``ranges`` (offset, size) are of every sync sample's run up to the next."""

    handler: str = ""
    codec: str = ""
    timescale: int = 0
    duration: int = 0  # ticks of all samples, by the time-to-sample table
    stated: int = 0  # the duration in the media header
    samples: int = 0
    times: list[int] = field(default_factory=list)
    ranges: list[tuple[int, int]] = field(default_factory=list)
    tables: dict[bytes, memoryview] = field(default_factory=dict)


def walk(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """(kind, body start, body end) of the boxes from ``start`` to ``end``, in order, not of those inside."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            (size,) = struct.unpack_from(">Q", data, body)
            body += 8
        size = size or end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} overruns what holds it")
        yield kind, body, start + size
        start += size


def probe(data: bytes) -> list[Track]:
    """The tracks of an ISO media file."""
    view, tracks = memoryview(data), []

    def visit(start: int, end: int) -> None:
        for kind, a, b in walk(view, start, end):
            if kind == b"trak":
                tracks.append(Track())
            if kind == b"mdhd":
                wide = view[a] == 1
                tracks[-1].timescale, tracks[-1].stated = struct.unpack_from(">IQ" if wide else ">II", view, a + (20 if wide else 12))
            elif kind == b"hdlr" and tracks:
                tracks[-1].handler = bytes(view[a + 8 : a + 12]).decode("latin-1")
            elif kind == b"stsd":
                tracks[-1].codec = bytes(view[a + 12 : a + 16]).decode("latin-1")
            elif kind in (b"stts", b"stsc", b"stsz", b"stco", b"co64", b"stss"):
                tracks[-1].tables[kind] = view[a:b]
            elif kind in NESTED:
                visit(a + NESTED[kind], b)

    visit(0, len(view))
    for track in tracks:
        _locate(track)
    return tracks


def _table(track: Track, kind: bytes, columns: int, dtype: str = ">u4", skip: int = 4) -> np.ndarray:
    raw = track.tables.get(kind)
    if raw is None:
        raise ValueError(f"no {kind!r} box")
    (count,) = struct.unpack_from(">I", raw, skip)
    return np.frombuffer(raw, dtype=dtype, count=count * columns, offset=skip + 4).astype(np.int64).reshape(-1, columns)


def _locate(track: Track) -> None:
    """Samples and the byte range of each sync sample with those that follow it in its chunk run."""
    raw = track.tables.get(b"stsz")
    if raw is None:
        raise ValueError("no b'stsz' box")
    one, track.samples = struct.unpack_from(">II", raw, 4)
    chunks = (_table(track, b"co64", 1, ">u8") if b"co64" in track.tables else _table(track, b"stco", 1))[:, 0]
    runs = _table(track, b"stsc", 3)
    until = np.append(runs[1:, 0], len(chunks) + 1)
    per_chunk = np.repeat(runs[:, 1], until - runs[:, 0])[: len(chunks)]
    first = np.cumsum(per_chunk) - per_chunk
    sync = _table(track, b"stss", 1)[:, 0] - 1 if b"stss" in track.tables else first
    chunk = np.searchsorted(first, sync, "right") - 1
    if one:
        offset = chunks[chunk] + (sync - first[chunk]) * one
        nexts = np.append(sync[1:], track.samples)
        size = (np.minimum(nexts, first[chunk] + per_chunk[chunk]) - sync) * one
    else:
        sizes = _table(track, b"stsz", 1, skip=8)[:, 0]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        offset = chunks[chunk] + upto[sync] - upto[first[chunk]]
        nexts = np.minimum(np.append(sync[1:], track.samples), first[chunk] + per_chunk[chunk])
        size = upto[nexts] - upto[sync]
    track.ranges = list(zip(offset.tolist(), size.tolist(), strict=True))
    steps = _table(track, b"stts", 2)  # runs of samples that last equally long
    track.duration = int((steps[:, 0] * steps[:, 1]).sum())
    upto = np.cumsum(steps[:, 0]) - steps[:, 0]
    begun = np.cumsum(steps[:, 0] * steps[:, 1]) - steps[:, 0] * steps[:, 1]
    run = np.searchsorted(upto, sync, "right") - 1
    track.times = (begun[run] + (sync - upto[run]) * steps[run, 1]).tolist() if len(steps) else [0] * len(sync)


def payload(data: bytes, track: Track) -> bytes:
    """The stored bytes of a track, read by its ranges."""
    return b"".join(data[a : a + n] for a, n in track.ranges)


def describe(track: Track) -> str:
    first, last = track.ranges[0], track.ranges[-1]
    return f"{track.codec.strip()};{track.duration}/{track.timescale};samples={track.samples};sync={len(track.ranges)};first={first[0]}+{first[1]};last={last[0]}+{last[1]}"


FEATURES = "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
KEYFRAMES = "array<struct<time:bigint,offset:bigint,size:bigint>>"
#: Files of one Arrow batch.
FILES = 500


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, FILES):
            piece = batch.slice(at, FILES)
            raw = [(t or "").encode("utf-8", "surrogatepass") for t in piece.column(1).to_pylist()]
            yield pa.record_batch([piece.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([wrap(padded(r)) for r in raw], pa.binary())], names=[batch.schema.names[0], "n_bytes", "media"])


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: str = "") -> DataFrame:
    """(id, n_bytes, media): each text as a file, written to a table and read back."""
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)]).add("n_bytes", T.LongType()).add("media", T.BinaryType())
    return table(docs.select(F.col(id_col), F.col(text_col).alias("_text")).mapInArrow(_store, schema), "media", scope)


def _describe(with_keyframes: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, frames = [], []
            for media in batch.column(2):
                data = media.as_py()
                (track,) = probe(data)
                back = payload(data, track)
                rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(data), hashlib.sha256(data).hexdigest(), describe(track)))
                if with_keyframes:
                    frames.append([{"time": t, "offset": a, "size": n} for t, (a, n) in zip(track.times, track.ranges, strict=True)])
            columns = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            arrays = [batch.column(0), batch.column(1), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]]
            names = [batch.schema.names[0], *[c.split()[0] for c in FEATURES.split(", ")]]
            if with_keyframes:
                arrays.append(pa.array(frames, pa.list_(pa.struct([(c, pa.int64()) for c in ("time", "offset", "size")]))))
                names.append("keyframes")
            yield pa.record_batch(arrays, names=names)

    return run


def described(stored: DataFrame, with_keyframes: bool = True) -> DataFrame:
    """(id, n_bytes, media) to one row a file: id, digests of payload and file, ``feature`` and ``keyframes`` (time in ticks, offset, size)."""
    schema = T.StructType([stored.schema.fields[0], *T._parse_datatype_string(FEATURES).fields])
    if with_keyframes:
        schema = schema.add("keyframes", T._parse_datatype_string(KEYFRAMES))
    return stored.mapInArrow(_describe(with_keyframes), schema)
