"""Exact byte-level BPE ids for whole texts, shared by packing and the token store.

The vocabulary and merge order come from a ``tokenizers`` JSON file; the merges
themselves run in ``tiktoken``, which gives the same ids several times faster
(the tests hold both libraries against each other).  Added tokens, such as ``<|endoftext|>``,
are found in the text first and get their one id, as in ``tokenizers``.  The split pattern of
``tiktoken`` runs out of stack on about a million whitespace characters in a row, so texts with
a very long run go to ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

# Fixed value: the vocabulary's published split pattern.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_ID = 2
#: Whitespace characters in a row from which a text goes to ``tokenizers``.
LONG_RUN = 100_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_of_char() -> dict[str, int]:
    """The printable stand-in that byte-level vocabularies use for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """Encoder with the ids of ``tokenizers`` for the same file and ``add_special_tokens=False``."""

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges, byte = spec["model"]["vocab"], spec["model"]["merges"], _byte_of_char()
        for i, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if vocab[left + right] != 256 + i:
                raise ValueError(f"{path}: ids do not follow the merge order")
        self._path, self._library = path, None
        added = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        if any(t.get(k) for t in spec.get("added_tokens", []) for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError(f"{path}: an added token takes in its surroundings, which this encoder does not know")
        self._added = added
        self._cut = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True)))) if added else None
        ranks = {bytes(byte[c] for c in tok): i for tok, i in vocab.items() if tok not in added}
        self.vocab_size = max(*vocab.values(), *added.values()) + 1
        self._encode = tiktoken.Encoding(
            "byte_bpe", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={}
        ).encode_ordinary

    def _ids(self, text: str) -> list[int]:
        """Ids of a text: added tokens, leftmost first, and the ordinary text between them."""
        out, at = [], 0
        for m in self._cut.finditer(text) if self._cut else ():
            out += self._ordinary(text[at : m.start()])
            out.append(self._added[m.group()])
            at = m.end()
        return out + self._ordinary(text[at:]) if at else self._ordinary(text)

    def _ordinary(self, text: str) -> list[int]:
        if len(text) < LONG_RUN or max((m.end() - m.start() for m in re.finditer(r"\s+", text)), default=0) < LONG_RUN:
            return self._encode(text)
        if self._library is None:
            from tokenizers import Tokenizer

            self._library = Tokenizer.from_file(self._path)
        return self._library.encode(text, add_special_tokens=False).ids

    def encode(self, texts: Sequence[str | None], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts and the ``len(texts) + 1`` offsets; a null text is empty."""
        tail = [] if end_id is None else [end_id]
        parts = [np.array(self._ids(t or "") + tail, np.uint32) for t in texts]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=offsets[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> ByteBpe:
    """One encoder per worker process and vocabulary file."""
    return ByteBpe(path)
