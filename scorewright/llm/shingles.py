"""Hashed sets of word shingles for whole texts, in numpy.

A word's hash takes its bytes eight at a time through a scrambling that is not linear; words
longer than ``LONG_WORD`` bytes take BLAKE2.  Each shingle has a second hash from words hashed
under another key, so shingles of two texts are told apart by 128 bits; those of one text by 64.
"""

from __future__ import annotations

import hashlib

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOW = np.arange(256, dtype=np.uint8)
_LOW[ord("A") : ord("Z") + 1] += 32
#: Words of more bytes are hashed one by one.
LONG_WORD = 256
#: The lowest 0 to 8 bytes of a lane.
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _random(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_PLACE = _random(64, 6)
_KEYS = _random(4, 7)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _word_hashes(low: np.ndarray, first: np.ndarray, size: np.ndarray, which: int) -> np.ndarray:
    """Hash ``which`` (0 or 1) of the words at ``first`` with ``size`` bytes; ``low`` has 8 bytes more than the texts."""
    lanes = np.ndarray(len(low) - 7, "<u8", low, strides=(1,))
    add, times = _KEYS[2 * which], _KEYS[2 * which + 1]
    out = mix(size.astype(np.uint64) * times + add)
    left = np.flatnonzero(size <= LONG_WORD)
    for at in range(0, LONG_WORD, 8):
        rest = size[left] - at
        if at:
            left, rest = left[rest > 0], rest[rest > 0]
        if not len(left):
            break
        lane = lanes[first[left] + at] & _MASK[np.minimum(rest, 8)]
        out[left] = mix((out[left] ^ lane) * times + add)
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        raw = low[first[i] : first[i] + size[i]]
        out[i] = int.from_bytes(hashlib.blake2b(raw, digest_size=8, salt=bytes([which])).digest(), "little")
    return out


def shingle_sets(texts: list[str], words: int, checks: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """Per text the sorted distinct 64-bit hashes of its shingles of ``words`` words.

    A-Z are lower-cased; words are runs of anything but ASCII space characters; a text with fewer
    words has one shingle, all its words; one without words has none.  A list ``checks`` gets, per
    text, the second hashes of the same shingles in the same order.
    """
    raw = [t.encode() for t in texts]
    bytes_of = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum(bytes_of)
    space = _SPACE[flat]
    edge = np.zeros(len(flat) + 1, bool)  # where a text begins
    edge[ends - bytes_of], edge[ends] = True, True
    first = np.flatnonzero(~space & (np.concatenate([[True], space])[: len(flat)] | edge[:-1]))
    last = np.flatnonzero(~space & (np.concatenate([space[1:], [True]])[: len(flat)] | edge[1:])) + 1
    low = np.zeros(len(flat) + 8, np.uint8)
    low[: len(flat)] = _LOW[flat]
    bounds = np.searchsorted(first, np.concatenate([[0], ends])).tolist()
    hashes, codes = [], []
    for which in range(1 if checks is None else 2):
        word = _word_hashes(low, first, last - first, which)
        full = max(0, len(word) - words + 1)
        code = np.zeros(full, np.uint64)
        for j in range(words):
            code += word[j : j + full] * _PLACE[j]
        hashes.append(word)
        codes.append(mix(code))
    out = []
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        if b - a >= words:
            x = codes[0][a : b - words + 1]
            if checks is None:
                x = np.sort(x)
            else:
                order = np.argsort(x, kind="stable")
                x, y = x[order], codes[1][a : b - words + 1][order]
            new = np.concatenate([[True], x[1:] != x[:-1]])
            out.append(x[new])
            if checks is not None:
                checks.append(y[new])
        else:
            few = [mix((w[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)) if b > a else np.zeros(0, np.uint64) for w in hashes]
            out.append(few[0])
            if checks is not None:
                checks.append(few[1])
    return out
