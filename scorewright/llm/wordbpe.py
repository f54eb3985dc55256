"""Exact ids of a word-level BPE file for whole texts.

The file's pipeline lower-cases, cuts at white space, which it drops, and into runs of letters, single
digits and runs of other characters, and merges inside these words; a word's last symbol carries an
end mark.  Here the words of Latin text are found by one pattern and joined by blanks, and
``tiktoken`` merges them, the blank being the end mark: it is joined to a word's last byte before any
other pair.  What stands between ASCII white space and holds other characters or an added token goes to
``tokenizers`` itself, as its ids do not depend on its surroundings.
"""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np

from scorewright.llm.bytebpe import _byte_of_char

END_ID = 1
# The split pattern of the file, and the letters, digits and white space below U+0180 that its classes hold.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS, DIGITS, SPACES = "a-zA-ZªµºÀ-ÖØ-öø-ſ", "0-9²³¹¼-¾", " \t-\r\x85\xa0"
#: The pattern over characters below U+0180, and the dot above that a lower-cased U+0130 leaves, which is no letter.
WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{SPACES}{LETTERS}{DIGITS}]+")
MARK = "</w>"
#: Unknown chunks that go to ``tokenizers`` at once hold about so many characters.
BATCH_CHARS = 1 << 18


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordBpe:
    """Encoder with the ids of ``tokenizers`` for the same file and ``add_special_tokens=False``."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, added = spec["model"], spec.get("added_tokens", [])
        cuts = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        steps = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        if (
            model.get("end_of_word_suffix") != MARK
            or cuts[0].get("pattern", {}).get("Regex") != SPLIT
            or cuts[0].get("behavior") != "Removed"
            or steps != ["NFC", "Replace", "Lowercase"]
            or any(t.get(k) for t in added for k in ("single_word", "lstrip", "rstrip"))
            or any(c.isspace() for t in added for c in t["content"])
        ):
            raise ValueError(f"{path}: not a word-level file of the kind this encoder knows")
        vocab, merges, byte = model["vocab"], model["merges"], _byte_of_char()
        for i, pair in enumerate(merges):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            if vocab[left + right] != 2 * len(byte) + i:
                raise ValueError(f"{path}: ids do not follow the merge order")
        names = {t["content"] for t in added}
        ranks = {
            bytes(byte[c] for c in t.removesuffix(MARK)) + b" " * t.endswith(MARK): i for t, i in vocab.items() if t not in names
        }
        self._library = Tokenizer.from_file(path)
        self._merge = tiktoken.Encoding("word_bpe", pat_str="[^ ]+ ", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self._other = re.compile("|".join(["[^\0-ſ]", *map(re.escape, sorted(names))]))

    def _plain(self, text: str) -> list[int]:
        words = WORD.findall(text.lower())
        return self._merge(" ".join(words) + " ") if words else []

    def _ids(self, text: str) -> list[int]:
        if self._other.search(text) is None:
            return self._plain(text)
        chunks = re.findall(r"[^\x20\x09-\x0D]+", text)
        other = [self._other.search(c) is not None for c in chunks]
        out: list[int] = []
        lo = 0
        while lo < len(chunks):  # runs of like chunks
            hi, held = lo, 0
            while hi < len(chunks) and other[hi] == other[lo] and held < BATCH_CHARS:
                held += len(chunks[hi])
                hi += 1
            part = " ".join(chunks[lo:hi])
            out += self._library.encode(part, add_special_tokens=False).ids if other[lo] else self._plain(part)
            lo = hi
        return out

    def encode(self, texts: Sequence[str | None], end_id: int | None = END_ID) -> tuple[np.ndarray, np.ndarray]:
        """Flat uint32 ids of all texts and the ``len(texts) + 1`` offsets; a null text is empty."""
        tail = [] if end_id is None else [end_id]
        parts = [np.array(self._ids(t or "") + tail, np.uint32) for t in texts]
        offsets = np.zeros(len(parts) + 1, np.int64)
        np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)), out=offsets[1:])
        return (np.concatenate(parts) if parts else np.zeros(0, np.uint32)), offsets


@lru_cache(maxsize=2)
def encoder(path: str) -> WordBpe:
    """One encoder per worker process and vocabulary file."""
    return WordBpe(path)
