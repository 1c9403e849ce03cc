"""Operator 5, media columns: ISO media containers.

The reader walks the nested boxes of a container, decodes its sample tables and reports codec, size, duration and
the byte ranges of chunks and keyframes; it never decodes a payload. The writer stores bytes losslessly as raw
8-bit grey frames of 24 x 24 samples, one track, so a payload of k * 576 bytes has k frames.

Defined results: null text is stored as one frame of filling; a blob that is null, cut short or no container gives
a row with its error and null features, never a failure; equal bytes give equal results; repeated rows are
treated each for itself; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh, slices, texts_of

SIDE = 24
FRAME = SIDE * SIDE
FILL = b"\xff"
RATE, CHUNK, KEY_EVERY = 25, 64, 12

_NESTED = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta"}
_MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def _box(kind: bytes, *parts: bytes) -> bytes:
    size = 8 + sum(map(len, parts))
    return b"".join((struct.pack(">I4s", size, kind), *parts))


def _full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", version << 24 | flags), *parts)


def _table(kind: bytes, rows: np.ndarray, dtype: str = ">u4") -> bytes:
    return _full(kind, struct.pack(">I", len(rows)), rows.astype(dtype).tobytes())


def write_container(payload: bytes) -> bytes:
    """A file with the payload as frames; its length must be a positive multiple of FRAME."""
    frames, rest = divmod(len(payload), FRAME)
    if rest or not frames:
        raise ValueError("the payload must be a positive multiple of a frame")
    chunks = -(-frames // CHUNK)
    last = frames - CHUNK * (chunks - 1)
    wide = len(payload) > 0xF0000000
    kind = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")
    head = struct.pack(">I4sQ", 1, b"mdat", 16 + len(payload)) if wide else struct.pack(">I4s", 8 + len(payload), b"mdat")

    def movie(first: int) -> bytes:
        at = first + np.arange(chunks, dtype=np.uint64) * np.uint64(CHUNK * FRAME)
        runs = [[1, CHUNK, 1], [chunks, last, 1]] if chunks > 1 and last != CHUNK else [[1, min(CHUNK, frames), 1]]
        entry = _box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH", SIDE, SIDE, 0x480000, 0x480000, 0, 1), bytes(32), struct.pack(">Hh", 40, -1))
        tables = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _table(b"stts", np.array([[frames, 1]])),
            _table(b"stss", np.arange(1, frames + 1, KEY_EVERY)),
            _table(b"stsc", np.array(runs)),
            _full(b"stsz", struct.pack(">II", FRAME, frames)),
            _table(b"co64" if wide else b"stco", at, ">u8" if wide else ">u4"),
        )
        info = _box(b"minf", _full(b"vmhd", bytes(8), flags=1), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), tables)
        media = _box(b"mdia", _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, RATE, frames, 0x55C4, 0)), _full(b"hdlr", bytes(4), b"vide", bytes(12), b"frames\0"), info)
        track = _box(b"trak", _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, frames), bytes(8), bytes(8), _MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16), flags=3), media)
        return _box(b"moov", _full(b"mvhd", struct.pack(">IIII", 0, 0, RATE, frames), struct.pack(">IH", 0x10000, 0x100), bytes(10), _MATRIX, bytes(24), struct.pack(">I", 2)), track)

    first = len(kind) + len(movie(0)) + len(head)
    return b"".join((kind, movie(first), head, payload))


def walk(data: bytes, start: int = 0, end: int | None = None, path: bytes = b"") -> Iterator[tuple[bytes, int, int]]:
    """Path, first and last byte of the content of every box, parents first; ValueError where sizes don't fit."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box is cut short")
        size, kind = struct.unpack_from(">I4s", data, start)
        head = 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box is cut short")
            size, head = struct.unpack_from(">Q", data, start + 8)[0], 16
        elif size == 0:
            size = end - start
        if size < head or start + size > end:
            raise ValueError("a box is longer than what holds it")
        here = path + b"/" + kind
        yield here, start + head, start + size
        if kind in _NESTED:
            yield from walk(data, start + head, start + size, here)
        start += size


def _rows(data: bytes, at: int, end: int, width: int, dtype: str = ">u4") -> np.ndarray:
    n = struct.unpack_from(">I", data, at + 4)[0]
    if at + 8 + n * width * np.dtype(dtype).itemsize > end:
        raise ValueError("a table is longer than its box")
    return np.frombuffer(data, dtype, n * width, at + 8).astype(np.int64).reshape(n, width)


def read_container(data: bytes) -> dict:
    """Codec, width, height, duration, number of samples, chunk ranges and keyframe ranges of the first track."""
    found: dict[bytes, tuple[int, int]] = {}
    for path, at, end in walk(data):
        found.setdefault(path, (at, end))
    stbl = b"/moov/trak/mdia/minf/stbl/"
    try:
        at, end = found[stbl + b"stsd"]
        codec = data[at + 12 : at + 16].decode("latin-1")
        width, height = struct.unpack_from(">HH", data, at + 40)
        at, end = found[b"/moov/trak/mdia/mdhd"]
        if data[at]:
            scale, length = struct.unpack_from(">IQ", data, at + 20)
        else:
            scale, length = struct.unpack_from(">II", data, at + 12)
        fixed, n = struct.unpack_from(">II", data, found[stbl + b"stsz"][0] + 4)
        if n * fixed > len(data):
            raise ValueError("samples lie beyond the end")
        if fixed:
            sizes = np.full(n, fixed, np.int64)
        else:
            at, end = found[stbl + b"stsz"]
            if at + 12 + 4 * n > end:
                raise ValueError("a table is longer than its box")
            sizes = np.frombuffer(data, ">u4", n, at + 12).astype(np.int64)
        wide = stbl + b"co64" in found
        chunks = _rows(data, *found[stbl + (b"co64" if wide else b"stco")], 1, ">u8" if wide else ">u4")[:, 0]
        runs = _rows(data, *found[stbl + b"stsc"], 3)
        times = _rows(data, *found[stbl + b"stts"], 2)
        keys = _rows(data, *found[stbl + b"stss"], 1)[:, 0] - 1 if stbl + b"stss" in found else np.arange(n)
    except (KeyError, struct.error) as e:
        raise ValueError(f"no readable track: {e}") from None
    if not scale or len(runs) == 0 and n:
        raise ValueError("no time scale or no chunks")
    per = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0] - 1, len(chunks)))) if n else np.empty(0, np.int64)
    if len(per) != len(chunks) or per.sum() != n or times[:, 0].sum() != n or len(keys) and not 0 <= keys.min() <= keys.max() < n:
        raise ValueError("the sample tables disagree")
    chunk = np.repeat(np.arange(len(chunks)), per)
    before = np.concatenate(([0], np.cumsum(sizes)))
    first = np.concatenate(([0], np.cumsum(per)))[:-1]
    place = chunks[chunk] + before[:-1] - before[first[chunk]]
    length_of = before[first + per] - before[first]
    if n and (place + sizes).max() > len(data):
        raise ValueError("samples lie beyond the end")
    ticks = int((times[:, 0] * times[:, 1]).sum())
    return {
        "codec": codec, "width": width, "height": height, "timescale": scale, "duration_ms": 1000 * (length or ticks) // scale, "n_samples": int(n),
        "chunks": np.stack([chunks, length_of], 1), "keyframes": np.stack([place[keys], sizes[keys]], 1),
    }


def read_payload(data: bytes, chunks: np.ndarray) -> bytes:
    """The stored bytes, by the chunks' ranges."""
    return b"".join(data[a : a + n] for a, n in chunks.tolist())


def padded(raw: bytes) -> bytes:
    """raw, filled up to a positive multiple of a frame."""
    return raw + FILL * (-len(raw) % FRAME or (0 if raw else FRAME))


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text), media (the container with the text's bytes as frames)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, limit=8 << 20):
            raw = texts_of(batch)
            media = [write_container(padded(x)) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


_RANGES = "array<struct<start:long,length:long>>"
FEATURES = f"codec string, width int, height int, timescale long, duration_ms long, n_samples long, chunks {_RANGES}, keyframes {_RANGES}, error string"


def inspect(blobs: DataFrame, column: str = "media") -> DataFrame:
    """The rows with the features of the containers in `column` and, for those that can't be read, the error.

    A feature whose name a column has already gets an underscore more.
    """
    names = [fresh(blobs, x.split()[0]) for x in FEATURES.split(", ")]
    features = ", ".join(f"`{n}` {x.split(' ', 1)[1]}" for n, x in zip(names, FEATURES.split(", ")))
    ranges = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), ranges, ranges, pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, column, 8 << 20):
            rows = []
            for x in batch.column(column).to_pylist():
                try:
                    info = read_container(x or b"")
                    rows.append(info | {k: [{"start": a, "length": n} for a, n in info[k].tolist()] for k in ("chunks", "keyframes")})
                except ValueError as e:
                    rows.append({"error": str(e)})
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array([r.get(n.split()[0]) for r in rows], k) for n, k in zip(FEATURES.split(", "), kinds))], names=[*batch.schema.names, *names])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in blobs.schema)
    return blobs.mapInArrow(run, f"{own}, {features}")


def digest(media: DataFrame) -> DataFrame:
    """to_media()'s rows, read back: digests of payload and container, and the features in one string."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in slices(batches, "media", 8 << 20):
            out = []
            for data in batch.column("media").to_pylist():
                info = read_container(data)
                payload, keys = read_payload(data, info["chunks"]), info["keyframes"]
                feature = f"codec={info['codec'].strip()} size={info['width']}x{info['height']} samples={info['n_samples']} duration_ms={info['duration_ms']} keyframes={len(keys)} first={keys[0, 0]}+{keys[0, 1]} last={keys[-1, 0]}+{keys[-1, 1]} ranges={zlib.crc32(keys.astype('<i8').tobytes()):08x}"
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *(pa.array([x[i] for x in out], k) for i, k in enumerate(kinds))], names=names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
