"""ISO media containers: bytes kept as raw 8-bit video samples, and a reader that decodes boxes and sample tables.

wrap() stores bytes as frames of 8 x 8 grey samples in an MP4 of one track, in chunks, with a sync sample table.
probe() walks the nested boxes of any such file, takes codec, time scale and duration from the headers and the
place of every sample from stsc, stsz or stz2, stco or co64, and tells keyframe byte ranges by stss (all samples
where there is none). Payload bytes are never decoded; read_samples() only copies them.

Both run over whole rows in Arrow batches and hold one row's bytes at a time beside them; nothing is shuffled.

Defined results: null text is empty and stored as one frame of zeros; equal texts give equal files; a null or
broken file gives null values and the reason in `error`; extra columns stay.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

FRAME, SIDE = 64, 8
FRAMES_A_CHUNK, FRAMES_A_KEY, RATE = 256, 16, 25
#: Boxes that hold boxes.
CONTAINERS = frozenset({b"moov", b"trak", b"edts", b"mdia", b"minf", b"dinf", b"stbl", b"mvex", b"moof", b"traf", b"udta"})
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full_box(kind: bytes, version: int, flags: int, *parts: bytes) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    return data + b"\0" * (-len(data) % FRAME or (FRAME if not data else 0))


def wrap(data: bytes) -> bytes:
    """data, padded with zeros to whole frames, as a file."""
    data = pad(data)
    n = len(data) // FRAME
    chunks = -(-n // FRAMES_A_CHUNK)
    last = n - (chunks - 1) * FRAMES_A_CHUNK
    keys = np.arange(1, n + 1, FRAMES_A_KEY, dtype=">u4")
    runs = [(1, FRAMES_A_CHUNK, 1)] if last == FRAMES_A_CHUNK else [(1, FRAMES_A_CHUNK, 1)] * (chunks > 1) + [(chunks, last, 1)]
    wide = len(data) + 8 >= 1 << 31
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomqt  ")

    def moov(first: int) -> bytes:
        places = first + np.arange(chunks, dtype=np.int64) * (FRAME * FRAMES_A_CHUNK)
        entry = box(b"raw ", bytes(6), struct.pack(">H", 1), bytes(16), struct.pack(">HHIIIH32sHh", SIDE, SIDE, 0x480000, 0x480000, 0, 1, b"", 40, -1))
        stbl = box(
            b"stbl",
            full_box(b"stsd", 0, 0, struct.pack(">I", 1), entry),
            full_box(b"stts", 0, 0, struct.pack(">III", 1, n, 1)),
            full_box(b"stss", 0, 0, struct.pack(">I", len(keys)), keys.tobytes()),
            full_box(b"stsc", 0, 0, struct.pack(">I", len(runs)), *[struct.pack(">III", *r) for r in runs]),
            full_box(b"stsz", 0, 0, struct.pack(">II", FRAME, n)),
            full_box(b"co64" if wide else b"stco", 0, 0, struct.pack(">I", chunks), places.astype(">u8" if wide else ">u4").tobytes()),
        )
        minf = box(b"minf", full_box(b"vmhd", 0, 1, bytes(8)), box(b"dinf", full_box(b"dref", 0, 0, struct.pack(">I", 1), full_box(b"url ", 0, 1))), stbl)
        mdhd = full_box(b"mdhd", 1, 0, struct.pack(">QQIQHH", 0, 0, RATE, n, 0x55C4, 0))
        hdlr = full_box(b"hdlr", 0, 0, bytes(4), b"vide", bytes(12), b"frames\0")
        tkhd = full_box(b"tkhd", 1, 3, struct.pack(">QQIIQ", 0, 0, 1, 0, n), bytes(8), struct.pack(">hhHH", 0, 0, 0, 0), MATRIX, struct.pack(">II", SIDE << 16, SIDE << 16))
        mvhd = full_box(b"mvhd", 1, 0, struct.pack(">QQIQIH", 0, 0, RATE, n, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2))
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    head = len(ftyp) + len(moov(0)) + (16 if len(data) + 8 >= 1 << 32 else 8)
    return ftyp + moov(head) + box(b"mdat", data)


def boxes(data: memoryview, start: int = 0, end: int | None = None) -> Iterator[tuple[bytes, int, int]]:
    """kind and body of each box between start and end. Sizes that leave the enclosing box raise ValueError."""
    end = len(data) if end is None else end
    while start < end:
        if end - start < 8:
            raise ValueError("a box header is cut off")
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1:
            if end - start < 16:
                raise ValueError("a box header is cut off")
            (size,), body = struct.unpack_from(">Q", data, body), body + 8
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            raise ValueError(f"box {kind!r} leaves its container")
        yield kind, body, start + size
        start += size


def tree(data: memoryview, start: int = 0, end: int | None = None, depth: int = 0) -> dict[bytes, list]:
    """Boxes by kind: nested dicts for containers, else (start, end) of the body."""
    if depth > 16:
        raise ValueError("boxes are nested too deeply")
    found: dict[bytes, list] = {}
    for kind, a, b in boxes(data, start, end):
        found.setdefault(kind, []).append(tree(data, a, b, depth + 1) if kind in CONTAINERS else (a, b))
    return found


def _table(data: memoryview, place: tuple[int, int], dtype: str, columns: int = 1, skip: int = 4) -> np.ndarray:
    """The rows of a full box that begins with their number, after skip bytes."""
    a, b = place[0] + skip, place[1]
    (n,) = struct.unpack_from(">I", data, a)
    width = np.dtype(dtype).itemsize * columns
    if a + 4 + n * width > b:
        raise ValueError("a table is cut off")
    rows = np.frombuffer(data, dtype, n * columns, a + 4).astype(np.int64)
    return rows.reshape(n, columns) if columns > 1 else rows


def _sizes(data: memoryview, stbl: dict) -> np.ndarray:
    if b"stsz" in stbl:
        a, b = stbl[b"stsz"][0]
        same, n = struct.unpack_from(">II", data, a + 4)
        if not same:
            return _table(data, (a, b), ">u4", skip=8)
        if n > len(data):
            raise ValueError("more samples than bytes")
        return np.full(n, same, np.int64)
    a, b = stbl[b"stz2"][0]
    bits = data[a + 7]
    if bits in (8, 16):
        return _table(data, (a, b), f">u{bits // 8}", skip=8)
    (n,) = struct.unpack_from(">I", data, a + 8)
    raw = np.frombuffer(data, np.uint8, (n + 1) // 2, a + 12)
    return np.stack([raw >> 4, raw & 15], 1).reshape(-1)[:n].astype(np.int64)


def tracks(data: bytes) -> list[dict]:
    """For each track: codec, timescale, duration (in its time scale), offsets and sizes of samples, keys (their places)."""
    view = memoryview(data)
    out = []
    for moov in tree(view).get(b"moov", []):
        for trak in moov.get(b"trak", []):
            mdia = trak[b"mdia"][0]
            stbl = mdia[b"minf"][0][b"stbl"][0]
            at = mdia[b"mdhd"][0][0]
            timescale, duration = struct.unpack_from(">IQ", view, at + 20) if view[at] else struct.unpack_from(">II", view, at + 12)
            codec = next((bytes(k) for k, _, _ in boxes(view, stbl[b"stsd"][0][0] + 8, stbl[b"stsd"][0][1])), b"")
            sizes = _sizes(view, stbl)
            places = _table(view, stbl[b"stco"][0], ">u4") if b"stco" in stbl else _table(view, stbl[b"co64"][0], ">u8")
            runs = _table(view, stbl[b"stsc"][0], ">u4", 3)
            if len(runs) and (runs[0, 0] != 1 or (np.diff(runs[:, 0]) <= 0).any()):
                raise ValueError("stsc is out of order")
            upto = np.append(runs[1:, 0], len(places) + 1) if len(runs) else runs[:, 0]
            per_chunk = np.repeat(runs[:, 1], np.maximum(upto - runs[:, 0], 0))[: len(places)]
            if per_chunk.sum() < len(sizes):
                raise ValueError("stsc has too few samples")
            chunk = np.repeat(np.arange(len(places)), np.minimum(per_chunk, len(sizes)))[: len(sizes)]
            before = np.concatenate([[0], np.cumsum(sizes)])
            first = np.searchsorted(chunk, chunk)
            offsets = places[chunk] + before[:-1] - before[first]
            if len(sizes) and (offsets + sizes).max() > len(data):
                raise ValueError("a sample leaves the file")
            keys = _table(view, stbl[b"stss"][0], ">u4") - 1 if b"stss" in stbl else np.arange(len(sizes))
            if len(keys) and (keys.min() < 0 or keys.max() >= len(sizes)):
                raise ValueError("stss names a sample that isn't there")
            out.append({"codec": codec.decode("latin-1"), "timescale": timescale, "duration": duration, "offsets": offsets, "sizes": sizes, "keys": keys})
    return out


def read_samples(data: bytes, track: dict) -> bytes:
    """The track's samples, one after the other."""
    o, s = track["offsets"], track["sizes"]
    if not len(o):
        return b""
    breaks = np.flatnonzero(o[1:] != o[:-1] + s[:-1]) + 1
    starts, ends = np.append(0, breaks), np.append(breaks, len(o)) - 1
    return b"".join(data[a:b] for a, b in zip(o[starts].tolist(), (o[ends] + s[ends]).tolist(), strict=True))


FEATURES = (
    "struct<codec:string,duration_s:double,samples:bigint,keyframes:array<struct<offset:bigint,length:bigint>>,"
    "payload_bytes:bigint,payload_sha256:string,tail_crc32:bigint,error:string>"
)
KEY = pa.list_(pa.struct([("offset", pa.int64()), ("length", pa.int64())]))
ARROW = pa.schema(
    [("codec", pa.string()), ("duration_s", pa.float64()), ("samples", pa.int64()), ("keyframes", KEY),
     ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("error", pa.string())]
)


def probe(data: bytes | None) -> dict:
    """The features of a file's first track."""
    if data is None:
        return {"error": "no file"}
    try:
        found = tracks(data)
        if not found:
            return {"error": "no track"}
        t = found[0]
        payload = read_samples(data, t)
        return {
            "codec": t["codec"],
            "duration_s": t["duration"] / t["timescale"] if t["timescale"] else None,
            "samples": len(t["sizes"]),
            "keyframes": [{"offset": a, "length": b} for a, b in zip(t["offsets"][t["keys"]].tolist(), t["sizes"][t["keys"]].tolist(), strict=True)],
            "payload_bytes": len(payload),
            "payload_sha256": hashlib.sha256(payload).hexdigest(),
            "tail_crc32": zlib.crc32(payload[-FRAME:]),
        }
    except (ValueError, KeyError, IndexError, struct.error, OverflowError, MemoryError) as e:
        return {"error": f"{type(e).__name__}: {e}"[:200]}


def _mapped(df: DataFrame, source: str, name: str, spark_type: str, arrow_type: pa.DataType, one) -> DataFrame:
    """df with a column that `one` makes of each value of source, in batches bounded by bytes on the way out."""
    schema = StructType([f for f in df.schema.fields if f.name != name]).add(name, StructType.fromDDL(f"x {spark_type}")["x"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, len(whole), 256):
                batch = whole.slice(at, 256)
                made = pa.array([one(x.as_py()) for x in batch.column(source)], arrow_type)
                keep = [n for n in batch.schema.names if n != name]
                yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], made], names=[*keep, name])

    return df.mapInArrow(run, schema)


def with_media(df: DataFrame, text_col: str = "text", out: str = "media") -> DataFrame:
    """df with its text's UTF-8 bytes as a file."""
    return _mapped(df, text_col, out, "binary", pa.binary(), lambda t: wrap((t or "").encode()))


def with_features(df: DataFrame, media_col: str = "media", out: str = "features") -> DataFrame:
    """df with what probe() finds in its files."""
    return _mapped(df, media_col, out, FEATURES, pa.struct(list(ARROW)), probe)


def feature_text(features: Column) -> Column:
    """codec, duration and keyframe ranges as one string."""
    ranges = F.array_join(F.transform(features["keyframes"], lambda k: F.concat_ws("+", k["offset"], k["length"])), ",")
    return F.concat_ws(";", features["codec"], F.format_string("%.3f", features["duration_s"]), features["samples"].cast("string"), ranges)
