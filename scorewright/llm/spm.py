"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A text becomes words that start at a run of U+2581 (no piece has it after another
character, which ``_Model`` checks).  All new words of a batch lie in one flat numpy
array of symbols.  A round looks up the rank of each adjacent pair, takes the
smallest rank per word (segmented minimum), merges all its occurrences at once from
the left, and compacts the array; words leave when none of their pairs is a piece.

The library merges one pair at a time, the best first.  Merging all occurrences at
once differs only if the merge makes a pair that is as good as or better than the
one just merged; words where a round with several merges does that are done again
with one merge a round.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.textops import slices, texts_of

SPACE = "▁"
NONE = np.int32(2**31 - 1)
CACHE_WORDS = 300_000
CACHE_IDS = 4_000_000
CACHED_LENGTH = 64
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Pairs:
    """(left symbol, right symbol) -> (rank, merged symbol), in an open-addressed numpy table."""

    def __init__(self, left, right, rank, merged, symbols: int):
        self._mul = np.int64(symbols)
        key = left.astype(np.int64) * self._mul + right
        self._shift = np.uint64(64 - max(4, int(len(key) * 4).bit_length()))
        size = 1 << (64 - int(self._shift))
        self._key, self._val = np.full(size + 64, -1, np.int64), np.zeros(size + 64, np.int32)
        self.rank, self.merged = np.append(rank, NONE).astype(np.int32), np.append(merged, -1).astype(np.int32)
        self._most = 0
        for k, slot, i in zip(key.tolist(), self._slot(key).tolist(), range(len(key)), strict=True):
            at = slot
            while self._key[at] >= 0:
                at += 1
            self._key[at], self._val[at] = k, i
            self._most = max(self._most, at - slot)
        self._nothing = len(key)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in ``rank`` and ``merged``; the last index stands for no piece."""
        key = left.astype(np.int64) * self._mul + right
        at = self._slot(key)
        out = np.full(len(key), self._nothing, np.int32)
        todo = np.arange(len(key))
        for _ in range(self._most + 1):
            have = self._key[at]
            hit = have == key
            out[todo[hit]] = self._val[at[hit]]
            more = ~hit & (have >= 0)
            if not more.any():
                break
            todo, key, at = todo[more], key[more], at[more] + 1
        return out


class Model:
    """The tables of one model file and a bounded cache of encoded words."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        kind = [sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) for i in range(n)]
        pieces = {sp.id_to_piece(i): i for i in range(n) if not kind[i]}
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p in pieces) or any(sp.is_unused(i) for i in range(n)):
            raise ValueError(f"{path}: pieces span words, or some are unused")
        self.bos, self.eos = sp.bos_id(), sp.eos_id()
        self.byte_ids = np.array([sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        score = {p: sp.get_score(i) for p, i in pieces.items()}
        order = {s: r for r, s in enumerate(sorted(set(score.values()), reverse=True))}
        symbols = dict(pieces)  # symbol numbers: ids of pieces, then characters that are only parts of pieces
        for p in pieces:
            for c in p:
                symbols.setdefault(c, n + len(symbols))
        self._symbol = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self._symbol[ord(s)] = i
        rows = [
            (symbols[p[:k]], symbols[p[k:]], order[score[p]], i)
            for p, i in pieces.items()
            for k in range(1, len(p))
            if p[:k] in symbols and p[k:] in symbols
        ]
        self._pairs = _Pairs(*np.array(rows, np.int64).T, symbols=2 * n + len(symbols) + 1)
        self._n = n
        text = [b"" if sp.is_control(i) else bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self._text = np.frombuffer(b"".join(text), np.uint8)
        self._text_len = np.array([len(t) for t in text], np.int64)
        self._text_at = np.cumsum(self._text_len) - self._text_len
        self._spaced = np.array([t[:1] == b" " for t in text])
        self._words = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+").findall
        self._reset()

    def _reset(self) -> None:
        self._index: dict[str, int] = {}
        self._ids = np.zeros(0, np.int32)
        self._len = np.zeros(0, np.int64)

    # --- merging -----------------------------------------------------------------

    def _rounds(self, sym: np.ndarray, cp: np.ndarray, word: np.ndarray, single: bool) -> tuple:
        """Merge until no pair of a word is a piece; words must be ascending.

        Returns the symbols, their first characters and words, in order, and the words
        to be done again one merge at a time.
        """
        done: list[tuple] = []
        again: list[np.ndarray] = []
        find, rank_of, merged = self._pairs.find, self._pairs.rank, self._pairs.merged
        pair = np.full(len(sym), len(rank_of) - 1, np.int32)
        near = np.flatnonzero((word[1:] == word[:-1]) & (sym[1:] >= 0) & (sym[:-1] >= 0))
        pair[near] = find(sym[near], sym[near + 1])
        last = np.full(0, 0, np.int32)  # rank of each live word's last round if that merged several, else -1
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            size = np.diff(np.append(first, len(word)))
            rank = rank_of[pair]
            best = np.minimum.reduceat(rank, first)
            if not len(last):
                last = np.full(len(first), -1, np.int32)
            redo = best <= last
            live = (best < NONE) & ~redo
            if redo.any():
                again.append(word[first[redo]])
            if not live.all():
                keep = np.repeat(live, size)
                gone = np.repeat(~live & ~redo, size)
                done.append((sym[gone], cp[gone], word[gone]))
                sym, cp, word, pair, rank = sym[keep], cp[keep], word[keep], pair[keep], rank[keep]
                best, size = best[live], size[live]
                if not len(sym):
                    break
                first = np.cumsum(size) - size
            hit = rank == np.repeat(best, size)
            if single:  # the leftmost only
                at = np.flatnonzero(hit)
                at = at[np.concatenate([[True], word[at[1:]] != word[at[:-1]]])]
            else:
                at = np.flatnonzero(hit)
                run = np.concatenate([[False], at[1:] == at[:-1] + 1])
                if run.any():  # overlapping occurrences: every other one, from the left
                    k = np.arange(len(at))
                    begin = np.maximum.accumulate(np.where(run, 0, k))
                    at = at[(k - begin) % 2 == 0]
            merges = np.bincount(np.searchsorted(first, at, "right") - 1, minlength=len(first))
            last = np.where(merges > 1, best, -1).astype(np.int32)
            sym[at] = merged[pair[at]]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep) - 1
            at = moved[at]
            sym, cp, word, pair = sym[keep], cp[keep], word[keep], pair[keep]
            fresh = np.concatenate([at, at[at > 0] - 1])  # may hold a position twice, with the same result
            pair[fresh] = len(rank_of) - 1
            fresh = fresh[fresh + 1 < len(sym)]
            fresh = fresh[(word[fresh] == word[fresh + 1]) & (sym[fresh] >= 0) & (sym[fresh + 1] >= 0)]
            pair[fresh] = find(sym[fresh], sym[fresh + 1])
        if done:
            sym, cp, word = (np.concatenate(x) for x in zip(*done, strict=True))
            order = np.argsort(word, kind="stable")
            sym, cp, word = sym[order], cp[order], word[order]
        return sym, cp, word, np.concatenate(again) if again else np.zeros(0, np.int64)

    def _merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of distinct words, and how many each has."""
        cp = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        word = np.repeat(np.arange(len(words)), size)
        sym = self._symbol[cp]
        out_sym, out_cp, out_word, again = self._rounds(sym.copy(), cp, word, single=False)
        if len(again):
            keep = np.isin(word, again)
            more = self._rounds(sym[keep], cp[keep], word[keep], single=True)
            out_sym, out_cp, out_word = (np.concatenate(x) for x in zip((out_sym, out_cp, out_word), more[:3], strict=True))
            order = np.argsort(out_word, kind="stable")
            out_sym, out_cp, out_word = out_sym[order], out_cp[order], out_word[order]
        raw = (out_sym < 0) | (out_sym >= self._n)  # characters that are no piece become their UTF-8 bytes
        if raw.any():
            n = np.ones(len(out_sym), np.int64)
            c = out_cp[raw]
            n[raw] = 1 + (c > 0x7F) + (c > 0x7FF) + (c > 0xFFFF)
            ids = np.repeat(out_sym, n)
            ids[np.repeat(raw, n)] = self.byte_ids[np.frombuffer(c.astype("<u4").tobytes().decode("utf-32-le").encode(), np.uint8)]
            return ids.astype(np.int32), np.bincount(np.repeat(out_word, n), minlength=len(words))
        return out_sym.astype(np.int32), np.bincount(out_word, minlength=len(words))

    def _learn(self, words: list[str]) -> None:
        ids, size = self._merge(words)
        n = len(self._index)
        self._ids, self._len = np.concatenate([self._ids, ids]), np.concatenate([self._len, size])
        self._at = np.cumsum(self._len) - self._len
        self._index.update(zip(words, range(n, n + len(words)), strict=True))

    # --- whole texts -------------------------------------------------------------

    def encode(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids with begin and end ids, and the ``len(texts) + 1`` offsets; null is empty."""
        if len(self._index) > CACHE_WORDS or len(self._ids) > CACHE_IDS:
            self._reset()
        words: list[str] = []
        n_words = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts):
            if t:
                found = self._words(SPACE + t.replace(" ", SPACE))
                n_words[i + 1] = len(found)
                words += found
        new = set(words).difference(self._index)
        long = [w for w in new if len(w) > CACHED_LENGTH]
        if new:
            self._learn([w for w in new if len(w) <= CACHED_LENGTH] + long)
        at = np.fromiter(map(self._index.__getitem__, words), np.int64, len(words))
        size = self._len[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(size)
        cum = np.concatenate([[0], ends])
        offsets = cum[np.cumsum(n_words)]
        ids = self._ids[np.arange(int(cum[-1])) + np.repeat(self._at[at] - (ends - size), size)] if len(at) else np.zeros(0, np.int32)
        if long:  # not kept: a cache of long words would not be bounded in bytes
            for w in long:
                del self._index[w]
            kept = len(self._index)
            self._len, self._ids = self._len[:kept], self._ids[: int(self._len[:kept].sum())]
            self._at = self._at[:kept]
        n = np.diff(offsets)
        around = offsets + 2 * np.arange(len(offsets))
        out = np.empty(int(around[-1]), np.int32)
        out[around[:-1]], out[around[1:] - 1] = self.bos, self.eos
        out[np.arange(len(ids)) + np.repeat(2 * np.arange(len(n)) + 1, n)] = ids
        return out, around

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """UTF-8 text of each ids[offsets[i]:offsets[i + 1]]."""
        size = self._text_len[ids]
        ends = np.cumsum(size)
        cum = np.concatenate([[0], ends])
        raw = self._text[np.arange(int(cum[-1])) + np.repeat(self._text_at[ids] - (ends - size), size)].tobytes()
        out = []
        for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            a, b = int(cum[lo]), int(cum[hi])
            k = lo
            while k < hi and size[k] == 0:  # begin id
                k += 1
            out.append(raw[a + bool(k < hi and self._spaced[ids[k]]) : b])
        return out


@lru_cache(maxsize=2)
def model(path: str) -> Model:
    """One model per worker process and file."""
    return Model(path)


@lru_cache(maxsize=2)
def _library(path: str):
    """The library's model of a file, and which ids are no ordinary pieces."""
    import sentencepiece

    found = sentencepiece.SentencePieceProcessor(model_file=path)
    return found, np.array([found.is_unknown(i) or found.is_control(i) or found.is_byte(i) for i in range(found.get_piece_size())])


def encode_documents(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and token ids (array<int>, with begin and end ids) of every whole text.

    Null text is empty; a null doc_id stays null; repeated rows give a row each; an empty table none; only doc_id and text are read.
    """
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part in slices(batches):
            ids, off = m.encode(texts_of(part))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of every row of token ids, such as the pieces of a packed document.

    Rows with an unknown id, byte pieces or marks inside go to the library, which knows what becomes of parts of a character.
    Null ids are empty; a null doc_id stays null; repeated rows give a row each; an empty table none.
    """
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        library, special = _library(path)
        for batch in batches:
            rows = [np.array(x or [], np.int32) for x in batch.column("ids").to_pylist()]
            odd = [bool(special[r[1:-1]].any() or (len(r) and (special[r[[0, -1]]] & ~np.isin(r[[0, -1]], (m.bos, m.eos))).any())) for r in rows]
            plain = [r[:0] if o else r for r, o in zip(rows, odd, strict=True)]
            off = np.concatenate([[0], np.cumsum([len(r) for r in plain])]).astype(np.int64)
            flat = np.concatenate(plain) if plain else np.zeros(0, np.int32)
            texts = [library.decode(r.tolist()) if o else t.decode() for r, o, t in zip(rows, odd, m.decode(flat, off), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode every whole text in one pass; digests of the ids and of the decoded text.

    Null text is empty (begin and end id); repeated rows and null ids give a row
    each; an empty table gives no rows; only doc_id and text are read.
    """
    path = path or default_path()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path)
        for part in slices(batches, max_bytes=8 << 20):
            ids, off = m.encode(texts_of(part))
            raw = ids.astype("<u4").tobytes()
            digest = [hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
            text = [hashlib.sha256(t).hexdigest() for t in m.decode(ids, off)]
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(off), pa.int64()), pa.array(digest, pa.string()), pa.array(text, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, RESULT)
