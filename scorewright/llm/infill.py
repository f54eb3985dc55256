"""Fill-in-the-middle: cut texts at units and put the middle last, for training models that complete gaps.

One Aho-Corasick automaton runs over a text and reports events: characters that end or change a
unit, and sentinels.  Between events lies nothing of interest, so the number of units before an
event, and the place where the k-th unit ends, follow from the events' places by arithmetic; the text
is never cut into its units.  Cuts are drawn from a digest of the document's id, so they
depend on nothing else.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.textops import slices, texts_of

#: Marks of prefix, suffix and middle.
SENTINELS = ("<P>", "<S>", "<M>")
#: Units and the ASCII characters that end them (lines) or whose runs are units of their own (words).
UNITS = {"lines": "\n", "words": " \t\n\x0b\f\r", "characters": ""}

INFILLED = "doc_id long, text string, n long, form string, prefix_chars long, middle_chars long"


@lru_cache(maxsize=8)
def automaton(unit: str, sentinels: tuple[str, ...]):
    """Finds the unit's characters (value 0) and sentinels (value 1)."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for char in UNITS[unit]:
        found.add_word(char, 0)
    for mark in sentinels:
        found.add_word(mark, 1)
    found.make_automaton()
    return found


def events(text: str, unit: str, sentinels: tuple[str, ...]) -> tuple[np.ndarray, bool]:
    """Places of the unit's characters in a text, rising, and whether it holds a sentinel."""
    at, marked = [], False
    for end, mark in automaton(unit, sentinels).iter(text):
        if mark:
            marked = True
        else:
            at.append(end)
    return np.array(at, np.int64), marked


class Ranks:
    """Number of units of a text of ``length`` code points, and where each ends, from its events."""

    def __init__(self, at: np.ndarray, length: int, unit: str):
        self._every = unit == "characters"
        if self._every:
            self.n = length
            return
        if unit == "lines":
            ends = at + 1
        else:  # a run of events is a unit, and so is a gap between runs
            first = np.concatenate([at[:1], at[1:][np.diff(at) > 1]])
            last = np.concatenate([at[:-1][np.diff(at) > 1], at[-1:]])
            ends = np.stack([first, last + 1], 1).ravel()
            ends = ends[ends > 0]
        if length and (not len(ends) or ends[-1] < length):
            ends = np.append(ends, length)
        self._ends, self.n = ends, len(ends)

    def end(self, k: int) -> int:
        """Code points of the first ``k`` units."""
        if self._every or not k:
            return k
        return int(self._ends[k - 1])


def draws(seed: int, doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers from the digest of seed and id (a null id: no digits)."""
    raw = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(raw[i : i + 4], "big") for i in (0, 4, 8, 12))


def infilled(
    text: str, doc_id: int | None, unit: str, sentinels: tuple[str, ...], seed: int, fim_percent: int, spm_percent: int
) -> tuple[str, int, str, int | None, int | None]:
    """Output, number of units, form, and code points of prefix and middle of one text."""
    at, marked = events(text, unit, sentinels)
    ranks = Ranks(at, len(text), unit)
    h1, h2, h3, h4 = draws(seed, doc_id)
    if not text or marked or h3 % 100 >= fim_percent:
        return text, ranks.n, "plain", None, None
    low, high = sorted((h1 % (ranks.n + 1), h2 % (ranks.n + 1)))
    a, b = ranks.end(low), ranks.end(high)
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = sentinels
    if h4 % 100 < spm_percent:
        return f"{s}{suffix}{p}{prefix}{m}{middle}", ranks.n, "spm", a, b - a
    return f"{p}{prefix}{s}{suffix}{m}{middle}", ranks.n, "psm", a, b - a


def fill_in_middle(
    docs: DataFrame,
    unit: str = "lines",
    sentinels: tuple[str, str, str] = SENTINELS,
    seed: int = 7,
    fim_percent: int = 100,
    spm_percent: int = 50,
) -> DataFrame:
    """doc_id, text (the output), n units, form (plain, psm, spm), prefix_chars and middle_chars (null if plain).

    Null text is the empty text, which stays plain, as does a text with a sentinel in it; a null doc_id
    draws as an id without digits; repeated rows give a row each with equal values; an empty table gives
    no rows; only doc_id and text are read, so other columns cannot clash.
    """
    if unit not in UNITS:
        raise ValueError(f"unit is one of {', '.join(UNITS)}")
    if not _apart(sentinels):
        raise ValueError("sentinels must be such that none begins inside itself or another")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            ids = part.column("doc_id")
            rows = [infilled(t, d, unit, sentinels, seed, fim_percent, spm_percent) for t, d in zip(texts_of(part), ids.to_pylist(), strict=True)]
            text, n, form, a, b = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(text, pa.string()), pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(a, pa.int64()), pa.array(b, pa.int64())],
                ["doc_id", "text", "n", "form", "prefix_chars", "middle_chars"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, INFILLED)


def _apart(sentinels: tuple[str, ...]) -> bool:
    """Whether three distinct marks stay findable next to any text: none has a mark's first character but at its start."""
    firsts = {s[:1] for s in sentinels}
    return len(set(sentinels)) == 3 and all(s and not firsts & set(s[1:]) for s in sentinels) and not any(
        a != b and b.startswith(a) for a in sentinels for b in sentinels
    )


def restored(text: Column, form: Column, sentinels: tuple[str, str, str] = SENTINELS) -> Column:
    """The text from which an output of that form was made, from the output alone."""
    parts = F.split(text, "|".join(rf"\Q{s}\E" for s in sentinels), -1)  # the first is empty
    psm, spm = (F.concat(parts[a], parts[3], parts[b]) for a, b in ((1, 2), (2, 1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(text)


def infill_digest(rows: DataFrame, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """What ``fill_in_middle`` made, texts by their digests: output_sha256, and restored_sha256 of the text put together again."""
    back = restored(F.col("text"), F.col("form"), sentinels)
    return rows.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("text", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256")
    )
