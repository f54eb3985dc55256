"""Packing by powers of two: no sequence holds tokens of two documents, and none is padded.

A document of n tokens is cut into as many pieces of the greatest length as it has and then one
piece for each binary digit of the rest, longest first.  Each piece is a sequence of its own, and
sequences of equal length form a bucket, from which batches of one shape are drawn.  The
lengths follow from n alone, so nothing is shuffled to cut; only writing buckets moves rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import wordbpe
from scorewright.llm.textops import slices, texts_of

CAPACITY = 2048
#: Bits of a sequence's number that count a task's sequences of one bucket, and those that name the task.
COUNT_BITS, TASK_BITS = 34, 24
#: Sequences in a file of a bucket, at most.
FILE_ROWS = 1 << 20

PIECES = "doc_id long, start long, length long, doc_tokens long, bucket int, sequence_id long, offset long, ids binary"


def binary_cuts(n: int, capacity: int) -> np.ndarray:
    """Where the pieces of a document of n tokens start, and its end: whole capacities, then falling powers of two."""
    whole, rest = divmod(n, capacity)
    powers = [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]
    return np.concatenate([[0], np.cumsum(np.array([capacity] * whole + powers, np.int64))])


def power_of_two_pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = wordbpe.END_ID) -> DataFrame:
    """One row per piece, which is a sequence: doc_id, start, length, doc_tokens, bucket, sequence_id, offset (0), ids.

    ``bucket`` is the length's binary logarithm, ``ids`` little-endian unsigned 32-bit integers.  A
    sequence's number is made of bucket, task and a count, so numbers of a bucket are one range.
    Null text is the empty text, which is one piece that holds the end id alone; a null doc_id stays
    null; repeated rows give pieces each; an empty table gives no rows; only doc_id and text are read,
    so other columns cannot clash.
    """
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    path = tokenizer or wordbpe.default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, task = wordbpe.encoder(path), TaskContext.get().partitionId()
        if task >> TASK_BITS:
            raise ValueError(f"more than {1 << TASK_BITS} tasks")
        made = np.zeros(capacity.bit_length(), np.int64)
        for part in slices(batches):
            ids, off = enc.encode(texts_of(part), end_id)
            total = np.diff(off)
            cuts = [binary_cuts(n, capacity) for n in total.tolist()]
            doc = np.repeat(np.arange(len(cuts)), [len(c) - 1 for c in cuts])
            start = np.concatenate([c[:-1] for c in cuts])
            length = np.concatenate([np.diff(c) for c in cuts])
            bucket = np.log2(length).astype(np.int64)
            count = np.empty(len(bucket), np.int64)
            for b in np.unique(bucket):
                at = bucket == b
                count[at] = made[b] + np.arange(at.sum())
                made[b] += at.sum()
            number = (bucket << (COUNT_BITS + TASK_BITS)) + (np.int64(task) << COUNT_BITS) + count
            ends = 4 * np.concatenate([[0], np.cumsum(length)])
            raw = pa.Array.from_buffers(pa.large_binary(), len(length), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            cols = [part.column("doc_id").take(pa.array(doc)), start, length, total[doc], bucket.astype(np.int32), number, np.zeros(len(doc), np.int64), raw.cast(pa.binary())]
            names = ["doc_id", "start", "length", "doc_tokens", "bucket", "sequence_id", "offset", "ids"]
            yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names)

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def write_buckets(packed: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Write sequences as Parquet, a folder per bucket, in files of at most ``file_rows``.

    Rows are dealt by bucket with a rebalance hint, so Spark splits the buckets that hold most rows.
    """
    packed.hint("rebalance", "bucket").write.option("maxRecordsPerFile", file_rows).partitionBy("bucket").parquet(path)


def read_bucket(spark, path: str, bucket: int) -> DataFrame:
    """The sequences of 2^bucket tokens; only that bucket's folder is read."""
    return spark.read.schema(PIECES).parquet(path).where(F.col("bucket") == bucket)


def batches_of(sequences: Iterable[bytes], length: int, rows: int) -> Iterator[np.ndarray]:
    """Matrices of ``rows`` sequences of one length; the last may have fewer."""
    held: list[bytes] = []
    for s in sequences:
        held.append(s)
        if len(held) == rows:
            yield np.frombuffer(b"".join(held), "<u4").reshape(-1, length)
            held = []
    if held:
        yield np.frombuffer(b"".join(held), "<u4").reshape(-1, length)


def packing_digest(packed: DataFrame) -> DataFrame:
    """The pieces without their ids, which become ids_crc32."""
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "bucket"
    )
