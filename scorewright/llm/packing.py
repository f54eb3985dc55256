"""Best-fit packing of documents into fixed-length training sequences.

Sum-of-squares placement: with N(g) open sequences that have g tokens left, a
piece goes to the gap for which the sum of N(g)^2 over all gaps becomes smallest,
and to a new sequence if it fits no gap.  Pieces of one shard are placed in falling
length, which is the order in which the rule wastes least.  A shard is one Spark partition with
about ``shard_pieces`` documents, so memory is bounded and shards are independent;
only the few sequences open at each shard's end are not full.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm import bytebpe
from scorewright.llm.textops import slices, texts_of, written

CAPACITY = 1024
SHARD_PIECES = 32_768

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def piece_bounds(n: int, capacity: int) -> np.ndarray:
    """Cuts of a document of n tokens: only the first piece may be shorter than ``capacity``."""
    first = n % capacity or capacity
    return np.concatenate([[0], np.arange(first, n + 1, capacity)])


def token_pieces(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document: doc_id, piece, start, length, ids_crc32."""
    path = tokenizer or bytebpe.default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bytebpe.encoder(path)
        for part in slices(batches):
            ids, off = enc.encode(texts_of(part))
            raw, out = ids.astype("<u4").tobytes(), []
            for doc, lo, hi in zip(part.column("doc_id").to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True):
                cuts = piece_bounds(hi - lo, capacity).tolist()
                for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                    out.append((doc, k, a, b - a, zlib.crc32(raw[4 * (lo + a) : 4 * (lo + b)])))
            cols = list(zip(*out, strict=True))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ("doc_id", "piece", "start", "length", "ids_crc32")
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], list(names))

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, PIECES)


def sum_of_squares(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, placed in the order given.

    Putting a piece of length s into gap g changes the sum of squares by
    (2 N(g-s) + 1) - (2 N(g) - 1); a gap of 0 is a closed sequence and counts nothing.
    Ties take the smallest gap.
    """
    count = np.zeros(capacity + 1, np.int64)
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    gone = np.int64(1) << 60
    seq, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    made = 0
    for i, s in enumerate(lengths.tolist()):
        if s >= capacity:
            seq[i], made = made, made + 1
            continue
        gaps = count[s:]
        cost = 2 * (count[: capacity + 1 - s] - gaps) + 2
        cost[0] -= 1  # the sequence becomes full: its gap leaves the sum
        cost[gaps == 0] = gone
        cost[-1] = gone - 1  # a new sequence, if no gap is open
        g = int(np.argmin(cost)) + s
        if g == capacity:
            b, made = made, made + 1
        else:
            b = open_at[g].pop()
            count[g] -= 1
        seq[i], offset[i] = b, capacity - g
        if g > s:
            count[g - s] += 1
            open_at[g - s].append(b)
    return seq, offset


def pack_pieces(pieces: DataFrame, shards: int, capacity: int = CAPACITY) -> DataFrame:
    """Deal the pieces evenly over ``shards`` partitions and pack each by sums of squares."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        batches = list(batches)
        if not batches:
            return
        table = pa.Table.from_batches(batches)
        shard = TaskContext.get().partitionId()
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        seq, offset = sum_of_squares(table.column("length").to_numpy(), capacity)
        table = table.append_column("sequence_id", pa.array((np.int64(shard) << 40) + seq))
        yield from table.append_column("offset", pa.array(offset)).to_batches(max_chunksize=65_536)

    return pieces.repartition(shards).mapInArrow(run, PACKED)


def best_fit_pack(
    docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY, shard_pieces: int = SHARD_PIECES
) -> DataFrame:
    """Pack all documents; one row per piece with its sequence and place.

    Null text is the empty text, which is one piece that holds the end id alone;
    a null doc_id stays null; repeated rows are packed each; an empty table gives no
    rows; only doc_id and text are read, so other columns cannot clash.
    """
    pieces = written(token_pieces(docs, tokenizer, capacity), "pieces")
    shards = max(1, -(-pieces.count() // shard_pieces))
    return pack_pieces(pieces, shards, capacity)
