"""Spelling variants: words one edit apart, found by their rarest bigrams.

One edit spoils at most two of a word's bigrams, so of two near words each keeps, among its three
rarest bigrams in one global order of frequency, one that the other's three rarest hold too, at the same place
or one further.  (Bigrams of one kind are ordered by place; then this holds for repeated ones as well:
the first kept one of the kind is among the three of both words.)  As the edit lies on one side
of a kept bigram, the word is the same on the other side, up to and including the bigram: that equal part
is the key on which words are joined, a bigram with its place from the word's start or end.

Words of a common key, where a join would grow with the square of their number, meet by deletions on the
edited side instead: two words that differ there by a replaced character are equal once it is
deleted from both, and by an inserted one once it is deleted from the longer, so such a group has
no more words than the alphabet allows.  Every pair found is verified on the words themselves.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.graph import BROADCAST_ROWS, lookup
from scorewright.llm.textops import slices, written

#: Bytes of a run of letters in UTF-8: ASCII letters, lower-cased, and U+00C0 to U+00FF.
RUN = re.compile(rb"(?:[a-z]++|\xc3[\x80-\xbf])++")
#: A run whose checksum with the document's id this divides has a character dropped.
DROP = 97
LEAST_CHARS, LEAST_COUNT = 5, 3
#: A form occurs so many times as often as the word, at least.
TIMES = 2
#: Bigrams of a word that are its keys: one edit spoils at most one fewer.
RAREST = 3
#: A key with more words than this is joined by deletions.
KEY_WORDS = 32
#: Multiplier of the hashes of strings, and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)


def word_counts(docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, drop: int = DROP) -> DataFrame:
    """word, n: runs of letters, some with a character dropped, of at least so many characters and occurrences."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            found: Counter[bytes] = Counter()
            for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").cast(pa.binary()).to_pylist(), strict=True):
                start = zlib.crc32(b":" if doc is None else b"%d:" % doc)
                for word, n in Counter(RUN.findall((text or b"").lower())).items():
                    h = zlib.crc32(word, start)
                    if h % drop == 0:
                        chars = word.decode()
                        at = h % len(chars)
                        word = (chars[:at] + chars[at + 1 :]).encode()
                    found[word] += n
            kept = [(w, n) for w, n in found.items() if len(w) >= least_chars and len(w.decode()) >= least_chars]
            yield pa.RecordBatch.from_arrays(
                [pa.array([w for w, _ in kept], pa.binary()).cast(pa.string()), pa.array([n for _, n in kept], pa.int64())], ["word", "n"]
            )

    counts = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def codes_of(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Characters of all words, a byte each as none is beyond U+00FF, and the words' offsets."""
    raw = [w.encode("latin-1") for w in words.to_pylist()]
    off = np.zeros(len(raw) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, raw), np.int64, len(raw)), out=off[1:])
    return np.frombuffer(b"".join(raw), np.uint8), off


def bigrams_of(codes: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bigrams of all words as numbers below 65536, the word of each, and its place in the word."""
    lens = np.diff(off)
    word = np.repeat(np.arange(len(lens)), np.maximum(lens - 1, 0))
    first = np.ones(len(codes), bool)
    first[off[1:] - 1] = False  # a word's last character begins none
    at = np.flatnonzero(first)
    return codes[at].astype(np.int64) << 8 | codes[at + 1], word, at - off[word]


def bigram_ranks(words: DataFrame) -> np.ndarray:
    """Place of each of the 65536 bigrams in the order of frequency over all words; one row per bigram comes to the driver."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 16, np.int64)
        for part in slices(batches, "word", max_rows=65_536):
            total += np.bincount(bigrams_of(*codes_of(part.column("word")))[0], minlength=1 << 16)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["gram", "n"])

    rows = words.select("word").mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).collect()
    ranks = np.zeros(1 << 16, np.int64)
    for i, r in enumerate(sorted(rows, key=lambda r: (r["n"], r["gram"]))):
        ranks[r["gram"]] = i
    return ranks


def rarest(codes: np.ndarray, off: np.ndarray, ranks: np.ndarray, k: int = RAREST) -> tuple[np.ndarray, np.ndarray]:
    """Word and place of the ``k`` rarest bigrams of each word; of equal bigrams the first in the word."""
    gram, word, place = bigrams_of(codes, off)
    order = np.lexsort((place, ranks[gram], word))
    counts = np.bincount(word, minlength=len(off) - 1)
    nth = np.arange(len(order)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = order[nth < k]
    return word[kept], place[kept]


def keyed(words: DataFrame, ranks: np.ndarray) -> DataFrame:
    """Each word under the keys of its rarest bigrams: key, side (0: the edit is left, 1: right), from, size (of that side), word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word", max_rows=16_384):
            column = part.column("word")
            codes, off = codes_of(column)
            word, place = rarest(codes, off, ranks)
            length = np.diff(off)[word]
            both = pa.array(np.concatenate([word, word]))
            side = np.repeat(np.array([0, 1], np.int8), len(word))
            start = np.concatenate([np.zeros(len(word), np.int64), place + 2])
            size = np.concatenate([place, length - place - 2])
            yield pa.RecordBatch.from_arrays(
                [column.take(both), pa.array(side), pa.array(start.astype(np.int32)), pa.array(size.astype(np.int32))], ["word", "side", "start", "size"]
            )

    rows = words.select("word").mapInArrow(run, "word string, side byte, start int, size int")
    equal = F.when(F.col("side") == 0, F.substr("word", F.col("size") + 1)).otherwise(F.substr("word", F.lit(1), F.col("start")))
    return rows.withColumn("key", F.xxhash64("side", equal))


def deletions(rows: DataFrame) -> DataFrame:
    """Words of common keys under what deletions on the edited side leave: at, role (0: replaced, 1: shorter, 2: longer), word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "word", max_rows=4096):
            key, start, size = (part.column(c).to_numpy().astype(np.int64) for c in ("key", "start", "size"))
            codes, off = codes_of(part.column("word"))
            n = size.astype(np.int64)
            row = np.repeat(np.arange(len(n)), n)
            i = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            char = codes[np.repeat(off[:-1] + start, n) + i].astype(np.uint64) + np.uint64(1)
            with np.errstate(over="ignore"):
                powers = np.full(int(n.max(initial=0)) + 1, BASE, np.uint64)
                powers[0] = 1
                term = char * np.cumprod(powers, dtype=np.uint64)[i]
                upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(term, dtype=np.uint64)])
                ends = np.cumsum(n)
                total = upto[ends] - upto[ends - n]
                before = upto[:-1] - upto[np.repeat(ends - n, n)]
                after = total[row] - before - term
                mixed = _mixed(key.view(np.uint64))
                replaced = _mixed(mixed[row] + _mixed(before + after) + _mixed(n[row].astype(np.uint64) << np.uint64(32) | i.astype(np.uint64)))
                longer = _mixed(mixed[row] + _mixed(before + after * np.uint64(INVERSE)) + (n[row] - 1).astype(np.uint64) + np.uint64(1 << 63))
                shorter = _mixed(mixed + _mixed(total) + n.astype(np.uint64) + np.uint64(1 << 63))
            at = np.concatenate([replaced, shorter, longer]).view(np.int64)
            role = np.repeat(np.array([0, 1, 2], np.int8), [len(row), len(n), len(row)])
            word = part.column("word").take(pa.array(np.concatenate([row, np.arange(len(n)), row])))
            yield from pa.Table.from_arrays([pa.array(at), pa.array(role), word], ["at", "role", "word"]).to_batches(max_chunksize=65_536)

    return rows.select("key", "start", "size", "word").mapInArrow(run, "at long, role byte, word string")


def _mixed(x: np.ndarray) -> np.ndarray:
    """Numbers of 64 bits, stirred."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def near_pairs(words: DataFrame, key_words: int = KEY_WORDS) -> DataFrame:
    """Pairs of words (a before b) that differ by one inserted, deleted or replaced character; ``words`` is read twice."""
    rows = written(keyed(words, bigram_ranks(words)), "word-keys")
    common = written(rows.groupBy("key").agg(F.count("*").alias("words")).where(F.col("words") > key_words).select("key"), "common-keys")
    few = common.count() <= BROADCAST_ROWS
    table = F.broadcast(common) if few else common
    one = F.levenshtein("a", "b", 1) == 1

    plain = rows.join(table, "key", "left_anti").select("key", "side", "size", "word")
    left = plain.withColumnRenamed("word", "a")
    right = plain.select("key", "side", F.col("size").alias("size_b"), F.col("word").alias("b"))
    by_key = left.join(right, ["key", "side"]).where("a < b AND abs(size - size_b) <= 1").where(one).select("a", "b")

    apart = deletions(rows.join(table, "key", "left_semi"))
    left = apart.where("role < 2").withColumnRenamed("word", "a")
    right = apart.where("role <> 1").select("at", F.col("role").alias("role_b"), F.col("word").alias("b"))
    met = left.join(right, "at").where("(role = 0 AND role_b = 0 AND a < b) OR (role = 1 AND role_b = 2)").where(one)
    by_deletion = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return by_key.unionByName(by_deletion).distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: the last word that forms lead to, from ``forms`` (word, form).

    A form occurs at least ``TIMES`` as often as its word, so chains end and are short; each round
    doubles the steps that a row has gone.
    """
    rows = written(forms.select("word", F.col("form").alias("root")), "roots")
    n = rows.count()
    while True:
        over = rows.select(F.col("word").alias("root"), F.col("root").alias("further"))
        nxt = written(lookup(rows, over, n, "root", "word", "left").select("word", F.coalesce("further", "root").alias("root"), "further"), "roots")
        if nxt.where("further IS NOT NULL").isEmpty():
            return nxt.select("word", "root")
        rows = nxt.select("word", "root")


def spelling_variants(
    docs: DataFrame, least_chars: int = LEAST_CHARS, least_count: int = LEAST_COUNT, times: int = TIMES, key_words: int = KEY_WORDS, drop: int = DROP
) -> DataFrame:
    """word, form, root, n, n_near, form_n of every word of ``docs``.

    ``form`` is the near word with the largest n (of several the first in code-point order) if it occurs
    ``times`` as often as the word, else null; ``root`` is where forms lead, the word itself if it has none.
    Null text holds no word; with a null doc_id the checksum begins at the colon; repeated rows
    count each; an empty table gives no rows; only doc_id and text are read, so other columns cannot clash.
    """
    if least_chars <= RAREST:
        raise ValueError(f"words need at least {RAREST + 1} characters to have {RAREST} bigrams")
    words = written(word_counts(docs, least_chars, least_count, drop), "words")
    pairs = near_pairs(words, key_words)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    with_n = both.join(words.select(F.col("word").alias("b"), F.col("n").alias("near_n")), "b")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("b").alias("word"))).alias("best")
    near = with_n.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), best)
    good = -F.col("best.minus") >= times * F.col("n")
    rows = words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("best.word")).alias("form"), F.when(good, -F.col("best.minus")).alias("form_n")
    )
    rows = written(rows, "forms")
    roots = roots_of(rows.where("form IS NOT NULL"))
    return rows.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
