"""Quality classifier from weak labels.

Heuristic labellers vote good, junk or nothing on every document.  Votes are counted
by pattern over all documents (at most 3 ** labellers patterns, whatever the input);
expectation-maximisation on those counts estimates each labeller's accuracy and the
posterior of every pattern.  The posteriors of a bounded sample of documents label
the training of a logistic scorer on hashed features, which then scores every text.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.textops import slices, texts_of

BUCKETS = 4096
SAMPLE_DOCS = 12_000
THRESHOLD = 0.5
RESULT = "doc_id long, score double, kept boolean, votes string"

# Character classes of the byte shapes, and frequent function words.
_OTHER, _LOWER, _UPPER, _DIGIT, _SPACE, _BREAK, _STOP, _COMMA, _HIGH = range(9)
_SYMBOLS = b"#$%&*|~^<>{}[]=\\/@+!_`"
STOP_WORDS = frozenset(
    "the of and to in a is that for it on with as are was be by at this from or an not have "
    "der die und das den von zu mit sich des im ist nicht ein eine auf für dem "
    "de la le les et un une des du en que pour dans qui sur pas avec est "
    "el los las una por con para del al se lo como más y o su".split()
)


def _class_table() -> np.ndarray:
    table = np.full(256, _OTHER, np.uint8)
    table[128:] = _HIGH
    table[ord("a") : ord("z") + 1], table[ord("A") : ord("Z") + 1], table[ord("0") : ord("9") + 1] = _LOWER, _UPPER, _DIGIT
    for b in b" \t\x0b\x0c\r":
        table[b] = _SPACE
    table[ord("\n")] = _BREAK
    for b in b".?":
        table[b] = _STOP
    for b in b",;:'\"()-":
        table[b] = _COMMA
    return table


_CLASS = _class_table()
_IS_SYMBOL = np.isin(np.arange(256), np.frombuffer(_SYMBOLS, np.uint8))


class Stats(NamedTuple):
    """Per document: bytes, class counts, symbols, words, and shares over words and lines."""

    size: np.ndarray
    classes: np.ndarray
    symbols: np.ndarray
    words: np.ndarray
    distinct: np.ndarray
    repeated: np.ndarray
    stop: np.ndarray
    lines: np.ndarray


def measure(texts: list[str]) -> tuple[Stats, np.ndarray, np.ndarray]:
    """Statistics of whole texts, the flat class of each byte, and the owner of each byte."""
    raw = [t.encode() for t in texts]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    flat = np.frombuffer(b"".join(raw), np.uint8)
    owner = np.repeat(np.arange(len(raw)), size)
    kind = _CLASS[flat]
    n = len(raw)
    classes = np.bincount(owner * 9 + kind, minlength=9 * n).reshape(n, 9)
    symbols = np.bincount(owner[_IS_SYMBOL[flat]], minlength=n)
    words, distinct, repeated, stop, lines = (np.zeros(n) for _ in range(5))
    for i, t in enumerate(texts):
        w = t.split()
        if w:
            words[i] = len(w)
            distinct[i] = len(set(w))
            repeated[i] = sum(map(str.__eq__, w, w[1:]))
            stop[i] = sum(map(STOP_WORDS.__contains__, t.lower().split()))
            rows = t.split("\n")
            lines[i] = len(set(rows)) / len(rows)
    return Stats(size, classes, symbols, words, distinct, repeated, stop, lines), kind, owner


def _vote(value: np.ndarray, good: np.ndarray, junk: np.ndarray, able: np.ndarray) -> np.ndarray:
    return np.where(able & junk, -1, np.where(able & good, 1, 0)).astype(np.int8)


def votes(s: Stats) -> np.ndarray:
    """documents x labellers: 1 good, -1 junk, 0 nothing.  An empty text gets junk from the last labeller."""
    w, size = np.maximum(s.words, 1), np.maximum(s.size, 1)
    letters = s.classes[:, _LOWER] + s.classes[:, _UPPER] + s.classes[:, _HIGH]
    some, many = s.words >= 5, s.words >= 20
    symbols, caps = s.symbols / w, s.classes[:, _UPPER] / np.maximum(letters, 1)
    repeat, fresh = s.repeated / w, s.distinct / w
    ends, stop, alpha = s.classes[:, _STOP] / w, s.stop / w, letters / size
    mean = letters / w
    columns = [
        _vote(symbols, symbols < 0.05, symbols > 0.3, some),
        _vote(caps, caps < 0.2, caps > 0.5, some),
        _vote(repeat, repeat < 0.1, repeat > 0.4, some),
        _vote(fresh, fresh > 0.35, fresh < 0.1, many & (s.words <= 2000)),
        _vote(mean, (mean > 2) & (mean < 14), (mean <= 1) | (mean > 30), some),
        _vote(ends, (ends > 0.02) & (ends < 0.4), ends < 0.003, many),
        _vote(stop, stop > 0.12, stop < 0.01, many),
        _vote(alpha, alpha > 0.72, alpha < 0.6, some),
        _vote(s.lines, s.lines > 0.7, s.lines < 0.3, s.classes[:, _BREAK] >= 4),
        np.where(s.words < 1, -1, 0).astype(np.int8),
    ]
    return np.stack(columns, 1)


def pattern_of(v: np.ndarray) -> list[str]:
    """Votes as text: '+', '-' or '.' per labeller."""
    return [row.tobytes().decode() for row in np.array([45, 46, 43], np.uint8)[v + 1]]


def votes_of(patterns: list[str]) -> np.ndarray:
    return np.array([[{"-": -1, ".": 0, "+": 1}[c] for c in p] for p in patterns], np.int8)


class WeakModel(NamedTuple):
    prior: float  # of good
    hit: np.ndarray  # per labeller: P(vote good | it votes, good)
    miss: np.ndarray  # per labeller: P(vote good | it votes, junk)

    def posterior(self, v: np.ndarray) -> np.ndarray:
        """P(good) of each row of votes; without a vote it is the prior."""
        odds = np.log(self.prior / (1 - self.prior))
        up, down = np.log(self.hit / self.miss), np.log((1 - self.hit) / (1 - self.miss))
        return 1 / (1 + np.exp(-np.clip(odds + (v > 0) @ up + (v < 0) @ down, -30, 30)))


def expectation_maximisation(v: np.ndarray, count: np.ndarray, rounds: int = 100) -> WeakModel:
    """Two classes, labellers independent given the class; starts from the majority of votes."""
    total = v.sum(1)
    p = np.where((v < 0).any(1), np.where(total >= 4, 0.4, 0.1), 0.95)
    good, junk = (v > 0).astype(float), (v < 0).astype(float)
    for _ in range(rounds):
        g, b = p * count, (1 - p) * count
        prior = float(np.clip((g.sum() + 2) / (count.sum() + 3), 0.05, 0.99))
        hit = (g @ good + 9) / (g @ (good + junk) + 10)  # a labeller starts at nine tenths right
        miss = (b @ good + 1) / (b @ (good + junk) + 2)
        model = WeakModel(prior, np.clip(hit, 0.01, 0.999), np.clip(miss, 0.001, 0.99))
        new = model.posterior(v)
        if np.abs(new - p).max() < 1e-6:
            break
        p = new
    return model


def hashed_features(s: Stats, kind: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """documents x BUCKETS: shares of hashed class trigrams, and hashed levels of the statistics."""
    n = len(s.size)
    x = np.zeros((n, BUCKETS), np.float32)
    if len(kind) >= 3:
        k = kind.astype(np.int64)
        code = ((k[:-2] * 9 + k[1:-1]) * 9 + k[2:]) * 2654435761 % 4294967296 >> 21  # 2048 buckets
        same = owner[:-2] == owner[2:]
        x[:, :2048] = np.bincount((owner[:-2] * 2048 + code)[same], minlength=2048 * n).reshape(n, 2048)
        x[:, :2048] = np.sqrt(x[:, :2048] / np.maximum(s.size, 1)[:, None])
    w = np.maximum(s.words, 1)
    shares = np.stack([s.symbols / w, s.repeated / w, np.minimum(1, s.distinct / w * np.maximum(1, np.log10(w))), s.stop / w, s.lines], 1)
    level = np.clip(shares * 16, 0, 31).astype(np.int64) + 32 * np.arange(shares.shape[1])
    at = 2048 + level * 2654435761 % 4294967296 % 2048
    np.add.at(x, (np.arange(n)[:, None], at), 0.5)
    return x


#: With fewer words than this a text's evidence counts in proportion, against the prior.
FULL_WORDS = 20


class Scorer(NamedTuple):
    weights: np.ndarray
    bias: float
    prior: float

    def __call__(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        """P(good); 0 without words."""
        odds = np.log(self.prior / (1 - self.prior))
        z = np.clip(x @ self.weights + self.bias, -30, 30)
        z = odds + (z - odds) * np.minimum(1, words / FULL_WORDS)
        return np.where(words > 0, 1 / (1 + np.exp(-z)), 0.0)


def train(x: np.ndarray, p: np.ndarray, prior: float = 0.5, steps: int = 400, rate: float = 0.5, decay: float = 1e-5) -> Scorer:
    """Logistic regression on soft labels; both classes weigh alike; momentum on the full sample."""
    weight = np.where(p > 0.5, 0.5 / max((p > 0.5).sum(), 1), 0.5 / max((p <= 0.5).sum(), 1)).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    vw, vb = np.zeros_like(w), 0.0
    for _ in range(steps):
        g = (1 / (1 + np.exp(-np.clip(x @ w + b, -30, 30))) - p) * weight
        vw, vb = 0.9 * vw - rate * (x.T @ g.astype(np.float32) + decay * w), 0.9 * vb - rate * float(g.sum())
        w, b = w + vw, b + vb
    return Scorer(w.astype(np.float64), b, prior)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")


def count_patterns(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """How often each pattern of votes occurs, over all documents."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array(pattern_of(votes(measure(texts_of(part))[0])))], ["pattern"])

    rows = _texts(docs).mapInArrow(run, "pattern string").groupBy("pattern").agg(F.count("*").alias("n")).collect()
    rows.sort()
    return [r["pattern"] for r in rows], np.array([r["n"] for r in rows], float)


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, seed: int = 11) -> Scorer | None:
    """Train on at most about ``sample_docs`` documents, drawn by a hash of id and text; None without documents.

    Null text counts as empty, a null id as any other; repeated rows are drawn together.
    """
    patterns, count = count_patterns(docs)
    if not patterns:
        return None
    weak = expectation_maximisation(votes_of(patterns), count)
    grain = 1 << 30
    share = int(min(1.0, sample_docs / count.sum()) * grain)
    drawn = _texts(docs).where(F.pmod(F.xxhash64("doc_id", "text", F.lit(seed)), F.lit(grain)) < share)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_rows=512):
            s, kind, owner = measure(texts_of(part))
            x = hashed_features(s, kind, owner)
            rows = [np.flatnonzero(r) for r in x]
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    pa.array(pattern_of(votes(s))),
                    pa.array([r.astype("<i2").tobytes() for r in rows], pa.binary()),
                    pa.array([x[i, r].astype("<f4").tobytes() for i, r in enumerate(rows)], pa.binary()),
                ],
                ["doc_id", "pattern", "at", "value"],
            )

    got = drawn.mapInArrow(run, "doc_id long, pattern string, at binary, value binary").collect()
    got.sort(key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["pattern"], bytes(r["value"])))
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i, r in enumerate(got):
        x[i, np.frombuffer(r["at"], "<i2")] = np.frombuffer(r["value"], "<f4")
    if not got:
        return None
    return train(x, weak.posterior(votes_of([r["pattern"] for r in got])), weak.prior)


def score(docs: DataFrame, scorer: Scorer | None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score (P(good)), kept (score >= threshold) and the labellers' votes of every whole text.

    Null text is the empty text, which scores 0 and is not kept; repeated rows give a
    row each; an empty table none; only doc_id and text are read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(scorer)  # BUCKETS weights, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_rows=512):
            s, kind, owner = measure(texts_of(part))
            p = shared.value(hashed_features(s, kind, owner), s.words) if shared.value else np.zeros(len(s.size))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(p, pa.float64()), pa.array(p >= threshold), pa.array(pattern_of(votes(s)), pa.string())],
                ["doc_id", "score", "kept", "votes"],
            )

    return _texts(docs).mapInArrow(run, RESULT)


def classify(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """Fit on the documents and score them all.

    Null text and text without words are scored as empty ones; a null doc_id stays null; repeated rows score alike;
    an empty table gives no rows; only doc_id and text are read.
    """
    return score(docs, fit(docs, sample_docs), threshold)


def without_junk(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns, in one pass over the rows.

    Null text counts as empty; repeated rows fare alike; an empty table gives no rows; columns of any name stay as they are.
    """
    scorer = fit(docs, sample_docs)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, max_rows=512):
            s, kind, owner = measure(texts_of(part))
            p = shared.value(hashed_features(s, kind, owner), s.words) if shared.value else np.zeros(len(s.size))
            yield part.filter(pa.array(p >= threshold))

    return docs.mapInArrow(run, docs.schema)
