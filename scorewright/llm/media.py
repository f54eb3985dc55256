"""Media columns: ISO base media files as binary columns, with an index from their boxes.

``build`` stores a payload as one audio track of 8-bit samples in an ISO base media
file.  ``index`` walks the nested boxes of any such file and decodes the sample
tables (stsd, stts, stsc, stsz, stco or co64, stss) into codec, duration, sample
byte ranges and key samples; it touches no payload byte.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.textops import slices, texts_of

UNIT = 576
CHUNK = 8
KEY_EVERY = 16
RATE = 8000
# Boxes that hold boxes.
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"dinf", b"edts", b"udta", b"mvex", b"moof", b"traf"}
IDENTITY = struct.pack(">9i", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)
RESULT = (
    "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, "
    "media_bytes long, media_sha256 string, feature string"
)


def _box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return struct.pack(">I", len(body) + 8) + kind + body


def _full(kind: bytes, *parts: bytes, flags: int = 0) -> bytes:
    return _box(kind, struct.pack(">I", flags), *parts)


def build(payload: bytes, unit: int = UNIT, chunk: int = CHUNK, key_every: int = KEY_EVERY, rate: int = RATE) -> bytes:
    """A file whose only track stores ``payload`` (a multiple of ``unit``) as samples of ``unit`` bytes.

    Samples are 8-bit audio frames, ``chunk`` samples a chunk; every ``key_every``-th is a key sample.
    """
    n = len(payload) // unit
    if n < 1 or n * unit != len(payload):
        raise ValueError("the payload is no positive multiple of the unit")
    chunks = -(-n // chunk)
    stsc = [(1, chunk if n >= chunk else n, 1)]
    if chunks > 1 and n % chunk:
        stsc.append((chunks, n % chunk, 1))
    keys = range(1, n + 1, key_every)
    entry = _box(b"raw ", bytes(6), struct.pack(">HIIHHHHI", 1, 0, 0, 1, 8, 0, 0, rate << 16))
    ftyp = _box(b"ftyp", b"isom", struct.pack(">I", 512), b"isomiso2")

    def moov(first: int) -> bytes:
        stbl = _box(
            b"stbl",
            _full(b"stsd", struct.pack(">I", 1), entry),
            _full(b"stts", struct.pack(">III", 1, n, unit)),
            _full(b"stsc", struct.pack(">I", len(stsc)), *(struct.pack(">III", *x) for x in stsc)),
            _full(b"stsz", struct.pack(">II", unit, n)),
            _full(b"stco", struct.pack(">I", chunks), (first + np.arange(chunks) * chunk * unit).astype(">u4").tobytes()),
            _full(b"stss", struct.pack(">I", len(keys)), np.array(keys).astype(">u4").tobytes()),
        )
        minf = _box(b"minf", _full(b"smhd", bytes(4)), _box(b"dinf", _full(b"dref", struct.pack(">I", 1), _full(b"url ", flags=1))), stbl)
        mdia = _box(
            b"mdia",
            _full(b"mdhd", struct.pack(">IIIIHH", 0, 0, rate, n * unit, 0x55C4, 0)),
            _full(b"hdlr", bytes(4), b"soun", bytes(12), b"\0"),
            minf,
        )
        tkhd = _full(b"tkhd", struct.pack(">IIIII", 0, 0, 1, 0, n * unit), bytes(8), struct.pack(">hhhH", 0, 0, 0x100, 0), IDENTITY, bytes(8), flags=7)
        mvhd = _full(b"mvhd", struct.pack(">IIIIIH", 0, 0, rate, n * unit, 0x10000, 0x100), bytes(10), IDENTITY, bytes(24), struct.pack(">I", 2))
        return _box(b"moov", mvhd, _box(b"trak", tkhd, mdia))

    head = moov(0)
    return ftyp + moov(len(ftyp) + len(head) + 8) + _box(b"mdat", payload)


def walk(data: memoryview, lo: int = 0, hi: int | None = None, path: tuple[bytes, ...] = ()) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path, body start, body end) of every box, outer boxes first; 64-bit and to-the-end sizes included."""
    hi = len(data) if hi is None else hi
    while lo + 8 <= hi:
        size, kind, head = int.from_bytes(data[lo : lo + 4], "big"), bytes(data[lo + 4 : lo + 8]), 8
        if size == 1:
            size, head = int.from_bytes(data[lo + 8 : lo + 16], "big"), 16
        elif size == 0:
            size = hi - lo
        if size < head or lo + size > hi:
            raise ValueError(f"box {kind!r} at {lo} leaves its parent")
        yield (*path, kind), lo + head, lo + size
        if kind in CONTAINERS:
            yield from walk(data, lo + head, lo + size, (*path, kind))
        lo += size


class Track(NamedTuple):
    codec: str
    timescale: int
    duration: int
    offset: np.ndarray  # of each sample
    size: np.ndarray
    time: np.ndarray
    key: np.ndarray  # sample numbers from 0


def _table(data: memoryview, at: int, columns: int, kind: str = ">u4") -> np.ndarray:
    n = int.from_bytes(data[at : at + 4], "big")
    return np.frombuffer(data, kind, n * columns, at + 4).astype(np.int64).reshape(n, columns)


def index(data: bytes) -> list[Track]:
    """Tracks of a file from its box headers and sample tables."""
    view, tracks, boxes = memoryview(data), [], {}

    def close() -> None:
        if b"stsz" not in boxes:
            return
        fixed, n = struct.unpack(">II", view[boxes[b"stsz"] + 4 : boxes[b"stsz"] + 12])
        if n > len(data):
            raise ValueError(f"{n} samples in {len(data)} bytes")
        size = np.full(n, fixed, np.int64) if fixed else np.frombuffer(view, ">u4", n, boxes[b"stsz"] + 12).astype(np.int64)
        chunk = _table(view, boxes[b"co64"] + 4, 1, ">u8") if b"co64" in boxes else _table(view, boxes[b"stco"] + 4, 1)
        runs = _table(view, boxes[b"stsc"] + 4, 3)
        per_chunk = np.repeat(runs[:, 1], np.diff(np.append(runs[:, 0], len(chunk) + 1)))
        steps = _table(view, boxes[b"stts"] + 4, 2)
        if max(per_chunk.sum(), steps[:, 0].sum()) > len(data):
            raise ValueError("the sample tables name more samples than bytes")
        of = np.repeat(np.arange(len(chunk)), per_chunk)[:n]
        before = np.cumsum(size) - size
        first = np.searchsorted(of, np.arange(len(chunk)))
        offset = chunk[of, 0] + before - before[first[of]]
        step = np.repeat(steps[:, 1], steps[:, 0])[:n]
        key = _table(view, boxes[b"stss"] + 4, 1)[:, 0] - 1 if b"stss" in boxes else np.arange(n)
        if min(len(of), len(step)) < n:
            raise ValueError("the sample tables name fewer samples than there are")
        if len(key) and (key.min() < 0 or key.max() >= n):
            raise ValueError("key numbers lie beyond the samples")
        at = boxes[b"mdhd"]
        wide = view[at] == 1
        scale = int.from_bytes(view[at + (20 if wide else 12) :][:4], "big")
        length = int.from_bytes(view[at + (24 if wide else 16) :][: 8 if wide else 4], "big")
        codec = bytes(view[boxes[b"stsd"] + 12 : boxes[b"stsd"] + 16]).decode("latin-1")
        tracks.append(Track(codec, scale, length, offset, size, np.cumsum(step) - step, key))

    for path, lo, _ in walk(view):
        if path[-1] == b"trak":
            close()
            boxes = {}
        elif b"trak" in path:
            boxes[path[-1]] = lo
    close()
    return tracks


def payload_of(data: bytes, track: Track) -> bytes:
    """The track's samples in order."""
    gaps = np.flatnonzero(track.offset[1:] != track.offset[:-1] + track.size[:-1]) + 1
    first, last = np.concatenate([[0], gaps]), np.concatenate([gaps, [len(track.size)]]) - 1
    return b"".join(data[track.offset[a] : track.offset[b] + track.size[b]] for a, b in zip(first.tolist(), last.tolist(), strict=True))


def feature_of(track: Track) -> str:
    """codec, duration in seconds, samples, and the byte range of each key sample."""
    ranges = ",".join(f"{o}+{s}" for o, s in zip(track.offset[track.key].tolist(), track.size[track.key].tolist(), strict=True))
    return f"codec={track.codec};duration={track.duration / track.timescale:.6f};samples={len(track.size)};keys={ranges}"


def media_column(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and the stored file (``media`` binary) of every whole text.

    Null text is empty; a null doc_id stays null; repeated rows give equal files; an empty table none; only doc_id and text are read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            raw = [t.encode() for t in texts_of(part)]
            media = [build(r + b"\xff" * (max(UNIT, -(-len(r) // UNIT) * UNIT) - len(r))) for r in raw]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(len, raw), pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


#: What a truncated, damaged or foreign file makes ``index`` raise.
DAMAGED = (ValueError, IndexError, KeyError, ZeroDivisionError, RecursionError, struct.error)


def media_entry(data: bytes | None) -> tuple[str | None, float | None, list[dict] | None, str | None]:
    """codec, seconds and key ranges of a file's first track, and why they are null if the file is damaged."""
    if not data:
        return None, None, None, None
    try:
        found = index(data)
        if not found:
            return None, None, None, "no track"
        t = found[0]
        if len(t.size) and (t.offset.min() < 0 or (t.offset + t.size).max() > len(data)):
            return None, None, None, "samples lie beyond the file"
        keys = [{"start": int(t.offset[k]), "length": int(t.size[k])} for k in t.key.tolist()]
        return t.codec, t.duration / t.timescale, keys, None
    except DAMAGED as e:
        return None, None, None, f"{type(e).__name__}: {e}"


def media_index(media: DataFrame) -> DataFrame:
    """Codec, duration and key sample byte ranges of the first track of each file; payloads are not read.

    Expects doc_id and media.  Null or empty media gives null columns, a damaged file or one without
    a track null columns and ``error``, which says why; repeated rows give a row each, an empty table none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 16 << 20):
            cols = zip(*map(media_entry, part.column("media").to_pylist()), strict=True)
            kinds = (pa.string(), pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())])), pa.string())
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], ["doc_id", "codec", "seconds", "key_ranges", "error"]
            )

    kind = "doc_id long, codec string, seconds double, key_ranges array<struct<start: long, length: long>>, error string"
    return media.select(F.col("doc_id").cast("long"), "media").mapInArrow(run, kind)


def media_digest(media: DataFrame) -> DataFrame:
    """Digests of every stored file and of the payload read back from it, and its index as text.

    ``media`` is the result of ``media_column``: equal texts give equal values, repeated
    rows a row each, an empty table none.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "media", 16 << 20):
            rows = []
            for m in part.column("media").to_pylist():
                track = index(m)[0]
                payload = payload_of(m, track)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), feature_of(track)))
            cols = zip(*rows, strict=True)
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("n_bytes"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names)

    return media.mapInArrow(run, RESULT)
