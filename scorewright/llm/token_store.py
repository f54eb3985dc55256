"""Token ids in a bit-packed binary file format with random access.

File layout (little-endian):

    8 bytes   magic "SWTOKEN2"
    u32       bits per id
    u32       ids per block
    blocks    ids as consecutive ``bits``-wide fields, first id in the lowest bits,
              each block padded to 8 bytes
    u64 x blocks   byte offset of each block from the start of the file
    u64       blocks
    u64       ids in the file
    8 bytes   magic

``bits`` is the least width that holds every id of the vocabulary.  A block holds
a multiple of 64 ids, so any block unpacks alone.  Offsets come last, so a writer streams
its blocks and holds one of them; files end at a document after ``FILE_IDS`` ids.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scorewright.llm import bytebpe
from scorewright.llm.textops import shared_path, slices, texts_of, written

MAGIC = b"SWTOKEN2"
BLOCK = 8192
#: Ids after which a file ends, and text bytes of one range of documents, about.
FILE_IDS = 1 << 28
RANGE_BYTES = 256 << 20
MANIFEST = "doc_id long, file string, first long, n_tokens long"


def width_of(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack_bits(ids: np.ndarray, bits: int) -> bytes:
    """Ids as consecutive fields of ``bits`` bits, padded to 8 bytes."""
    if bits in (8, 16, 32):
        raw = ids.astype(f"<u{bits // 8}").tobytes()
    else:
        fields = (ids.astype(np.uint64)[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        raw = np.packbits(fields.astype(np.uint8).ravel(), bitorder="little").tobytes()
    return raw + b"\0" * (-len(raw) % 8)


def unpack_bits(raw: bytes, n: int, bits: int) -> np.ndarray:
    """The first n ids of a block as uint32."""
    if bits in (8, 16, 32):
        return np.frombuffer(raw, f"<u{bits // 8}", n).astype(np.uint32)
    fields = np.unpackbits(np.frombuffer(raw, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    return (fields.astype(np.uint32) << np.arange(bits, dtype=np.uint32)).sum(1, dtype=np.uint32)


class Writer:
    """Takes ids in any portions and gives each block to ``put`` as it fills; ``close`` gives the rest and the footer.

    Without ``put`` the parts are kept for ``image``.
    """

    def __init__(self, bits: int, block: int = BLOCK, put: Callable[[bytes], object] | None = None):
        self.bits, self.block, self.n = bits, block, 0
        self._parts: list[bytes] = []
        self._out, self._at, self._offsets = put or self._parts.append, 0, []
        self._rest = np.zeros(0, np.uint32)
        self._put(MAGIC + np.array([bits, block], "<u4").tobytes())

    def _put(self, raw: bytes) -> None:
        self._out(raw)
        self._at += len(raw)

    def _put_block(self, ids: np.ndarray) -> None:
        self._offsets.append(self._at)
        self._put(pack_bits(ids, self.bits))

    def add(self, ids: np.ndarray) -> None:
        self.n += len(ids)
        ids = np.concatenate([self._rest, ids])
        full = len(ids) // self.block * self.block
        for i in range(0, full, self.block):
            self._put_block(ids[i : i + self.block])
        self._rest = ids[full:]

    def close(self) -> None:
        if len(self._rest):
            self._put_block(self._rest)
        foot = np.array([*self._offsets, len(self._offsets), self.n], "<u8").tobytes()
        self._put(foot + MAGIC)

    def image(self) -> Iterator[bytes]:
        """The file's bytes, in parts."""
        self.close()
        yield from self._parts


class Reader:
    """Random access: ``ids(first, n)`` reads the blocks that hold the range and no others."""

    def __init__(self, stream):
        self._in = stream
        head = stream.read(16)
        stream.seek(0, 2)
        end = stream.tell()
        stream.seek(max(0, end - 24))
        tail = stream.read(24)
        if head[:8] != MAGIC or tail[16:] != MAGIC:
            raise ValueError("not a whole token file")
        self.bits, self.block = np.frombuffer(head, "<u4", 2, 8).tolist()
        blocks, self.n = np.frombuffer(tail, "<u8", 2).tolist()
        stream.seek(end - 24 - 8 * blocks)
        self._at = np.frombuffer(stream.read(8 * blocks), "<u8")
        self._have: tuple[int, np.ndarray] = (-1, np.zeros(0, np.uint32))

    def _block(self, k: int) -> np.ndarray:
        if self._have[0] != k:
            n = min(self.block, self.n - k * self.block)
            self._in.seek(int(self._at[k]))
            self._have = (k, unpack_bits(self._in.read(-(-n * self.bits // 64) * 8), n, self.bits))
        return self._have[1]

    def ids(self, first: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            k, at = divmod(first, self.block)
            got = self._block(k)[at : at + n]
            parts.append(got)
            first, n = first + len(got), n - len(got)
        return np.concatenate(parts) if parts else np.zeros(0, np.uint32)


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def write_tokens(
    docs: DataFrame, folder: str, tokenizer: str | None = None, partitions: int | None = None, file_ids: int = FILE_IDS
) -> DataFrame:
    """Write token files in ascending doc_id order; returns the manifest, lazily.

    Ranges of doc_id, as many as the texts' bytes ask for, order files; sorting orders documents
    within one.  A task streams blocks under a name of its own and renames the file when whole,
    so a repeated task replaces a file by the same bytes.  Null text is the end id alone; rows without doc_id come first;
    repeated rows are stored each; an empty table writes no file; only doc_id and text are read.
    """
    path = tokenizer or bytebpe.default_path()
    spark = docs.sparkSession
    if partitions is None:
        total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // RANGE_BYTES), 1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext

        enc, where, base = bytebpe.encoder(path), *_filesystem(folder)
        task, part_no, stream, own, out = TaskContext.get().partitionId(), 0, None, "", None

        def name() -> str:
            return f"part-{task:06d}-{part_no:06d}.tokens"

        def end() -> None:
            out.close()
            stream.close()
            where.move(own, f"{base}/{name()}")

        for part in slices(batches):
            if stream is None:
                where.create_dir(base, recursive=True)
                own = f"{base}/_{name()}.{uuid.uuid4().hex}"
                stream = where.open_output_stream(own)
                out = Writer(width_of(enc.vocab_size), put=stream.write)
            ids, off = enc.encode(texts_of(part))
            first = off[:-1] + out.n
            out.add(ids)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array([name()] * part.num_rows), pa.array(first, pa.int64()), pa.array(np.diff(off), pa.int64())],
                ["doc_id", "file", "first", "n_tokens"],
            )
            if out.n >= file_ids:
                end()
                stream, part_no = None, part_no + 1
        if stream is not None:
            end()

    ordered = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .repartitionByRange(partitions, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    )
    return ordered.mapInArrow(run, MANIFEST)


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document of a written manifest: its ids' count and crc32, read back from the files; an empty manifest gives no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, base = _filesystem(folder)
        name, reader = None, None
        for batch in batches:
            crc = []
            for file, first, n in zip(*(batch.column(c).to_pylist() for c in ("file", "first", "n_tokens")), strict=True):
                if file != name:
                    name, reader = file, Reader(where.open_input_file(f"{base}/{file}"))
                crc.append(zlib.crc32(reader.ids(first, n).astype("<u4").tobytes()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in ("doc_id", "file", "first", "n_tokens")] + [pa.array(crc, pa.int64())],
                ["doc_id", "file", "first", "n_tokens", "ids_crc32"],
            )

    return manifest.mapInArrow(run, MANIFEST + ", ids_crc32 long")


def file_starts(manifest: DataFrame) -> DataFrame:
    """Ids before each file.  One row per file: bounded by the corpus over ``FILE_IDS`` and the range count, not by documents."""
    per_file = manifest.groupBy("file").agg(F.sum("n_tokens").alias("n")).collect()
    rows, before = [], 0
    for r in sorted(per_file, key=lambda r: r["file"]):
        rows.append((r["file"], before))
        before += r["n"]
    return manifest.sparkSession.createDataFrame(rows, "file string, before long")


def token_store(docs: DataFrame, folder: str | None = None, tokenizer: str | None = None) -> DataFrame:
    """Write all documents' ids to ``folder`` and return per document what the files hold.

    Null text is empty (the end id alone); null doc_ids come first; repeated ids
    keep one entry per row; an empty table writes no file and gives no rows; only
    doc_id and text are read, so other columns cannot clash.
    """
    spark: SparkSession = docs.sparkSession
    folder = folder or shared_path(spark, "tokens")
    manifest = written(write_tokens(docs, folder, tokenizer), "manifest")
    starts = F.broadcast(file_starts(manifest))  # one row per file
    return (
        read_tokens(manifest, folder)
        .join(starts, "file")
        .select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids_crc32", "file")
    )
