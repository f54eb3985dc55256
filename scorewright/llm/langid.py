"""Language identification with a byte convolutional network in numpy.

A text is cut into overlapping windows of fixed length; each goes through a byte
embedding, convolutions of several widths, a rectifier, max pooling over the window
and a softmax.  A document's class is the one with the largest mean window
probability, windows weighted by their letters.  Weights are trained on the driver
from a bounded sample of windows of labelled documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scorewright.llm.textops import slices, texts_of

WINDOW = 256
WIDTHS = (2, 3, 4)
OVERLAP = max(WIDTHS) - 1
FILTERS = 16
EMBED = 8
EPOCHS = 6
#: Bounds of the training sample: documents of each language, and windows of each document.
DOCS_PER_LANG = 500
WINDOWS_PER_DOC = 3
UNKNOWN = "und"
RESULT = "doc_id long, held_out boolean, lang_pred string, score double"

_has_letter = re.compile(r"[^\W\d_]").search
#: Bytes that count as part of letters: ASCII letters and every byte of a longer UTF-8 sequence.
_LETTER = np.array([chr(b).isalpha() if b < 128 else True for b in range(256)])


def cut(raw: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n x WINDOW, zero-padded) that cover each byte range, and the range of each."""
    stride = WINDOW - OVERLAP
    n = np.maximum(1, -(-(lengths - OVERLAP) // stride))
    owner = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    at = starts[owner] + k * stride
    have = np.minimum(WINDOW, starts[owner] + lengths[owner] - at)
    pos = np.arange(WINDOW)
    index = at[:, None] + pos
    inside = pos < have[:, None]
    out = raw[np.minimum(index, max(len(raw) - 1, 0))] if len(raw) else np.zeros((len(owner), WINDOW), np.uint8)
    out[~inside] = 0
    return out, owner


class Net(NamedTuple):
    langs: list[str]
    embed: np.ndarray  # 256 x E
    conv: list[np.ndarray]  # per width: width x E x F
    bias: list[np.ndarray]
    dense: np.ndarray  # (widths * F) x langs
    offset: np.ndarray


def train(windows: np.ndarray, labels: np.ndarray, langs: list[str], epochs: int = EPOCHS, seed: int = 7) -> Net:
    """Adam on cross entropy; the gradient of a max pool goes to the first position that holds the maximum."""
    rng = np.random.default_rng(seed)
    f32 = np.float32
    params = [rng.normal(0, 0.3, (256, EMBED)).astype(f32)]
    params += [rng.normal(0, 1 / np.sqrt(w * EMBED), (w * EMBED, FILTERS)).astype(f32) for w in WIDTHS]
    params += [np.zeros(FILTERS, f32) for _ in WIDTHS]
    params += [rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(langs))).astype(f32), np.zeros(len(langs), f32)]
    m1, m2, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    k = len(WIDTHS)
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for lo in range(0, len(order), 64):
            pick = order[lo : lo + 64]
            x, y, n = windows[pick].astype(np.int64), labels[pick], len(pick)
            e = params[0][x]
            pooled, where, parts = [], [], []
            for i, w in enumerate(WIDTHS):
                size = WINDOW - w + 1
                wide = np.concatenate([e[:, j : j + size] for j in range(w)], axis=2)
                z = wide.reshape(-1, w * EMBED) @ params[1 + i]
                z = z.reshape(n, size, FILTERS)
                at = z.argmax(1)
                pooled.append(np.take_along_axis(z, at[:, None], 1)[:, 0] + params[1 + k + i])
                where.append(at)
                parts.append(wide)
            pre = np.concatenate(pooled, 1)
            h = np.maximum(pre, 0)
            s = h @ params[1 + 2 * k] + params[2 + 2 * k]
            p = np.exp(s - s.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(n), y] -= 1
            p /= n
            grad = [np.zeros_like(q) for q in params]
            grad[1 + 2 * k], grad[2 + 2 * k] = h.T @ p, p.sum(0)
            back = (p @ params[1 + 2 * k].T) * (pre > 0)
            for i, w in enumerate(WIDTHS):
                g, at = back[:, i * FILTERS : (i + 1) * FILTERS], where[i]
                grad[1 + k + i] = g.sum(0)
                rows = np.take_along_axis(parts[i][:, :, None, :], at[:, None, :, None], 1)[:, 0]  # n x F x wE
                grad[1 + i] = np.einsum("nf,nfd->df", g, rows)
                to = (g[:, :, None] * params[1 + i].T[None]).reshape(n, FILTERS, w, EMBED)
                byte = x[np.arange(n)[:, None, None], at[:, :, None] + np.arange(w)]
                np.add.at(grad[0], byte.ravel(), to.reshape(-1, EMBED))
            step += 1
            for q, g, a, b in zip(params, grad, m1, m2, strict=True):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                q -= 0.004 * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.999**step)) + 1e-8)
    conv = [params[1 + i].reshape(w, EMBED, FILTERS) for i, w in enumerate(WIDTHS)]
    return Net(langs, params[0], conv, params[1 + k : 1 + 2 * k], params[1 + 2 * k], params[2 + 2 * k])


class Scorer:
    """Applies a net to batches of windows; convolutions are sums of per-byte and per-pair tables."""

    def __init__(self, net: Net):
        self.net = net
        by_byte = [[net.embed @ kernel for kernel in conv] for conv in net.conv]  # width, place -> 256 x F
        pair = lambda a, b: (a[:, None] + b[None]).reshape(65536, FILTERS)
        self._tables = []  # per width: (offset, table, whether pairs index it)
        for t in by_byte:
            rows = [(j, pair(t[j], t[j + 1]), True) for j in range(0, len(t) - 1, 2)]
            self._tables.append(rows + ([(len(t) - 1, t[-1], False)] if len(t) % 2 else []))

    def __call__(self, windows: np.ndarray, block: int = 256) -> np.ndarray:
        """Class probabilities of each window."""
        out = np.empty((len(windows), len(self.net.langs)), np.float32)
        for lo in range(0, len(windows), block):
            x = windows[lo : lo + block].astype(np.int32)
            two = x[:, :-1] * 256 + x[:, 1:]
            pooled = []
            for w, tables, bias in zip(WIDTHS, self._tables, self.net.bias, strict=True):
                size, z = WINDOW - w + 1, None
                for j, table, pairs in tables:
                    got = np.take(table, (two if pairs else x)[:, j : j + size], axis=0)
                    z = got if z is None else np.add(z, got, out=z)
                pooled.append(z.max(1) + bias)
            s = np.maximum(np.concatenate(pooled, 1), 0) @ self.net.dense + self.net.offset
            p = np.exp(s - s.max(1, keepdims=True))
            out[lo : lo + block] = p / p.sum(1, keepdims=True)
        return out

    def documents(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Class number and score of each non-empty text."""
        raw = [t.encode() for t in texts]
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        flat = np.frombuffer(b"".join(raw), np.uint8)
        windows, owner = cut(flat, np.cumsum(lengths) - lengths, lengths)
        weight = _LETTER[windows].sum(1) + 1e-3
        total = np.zeros((len(texts), len(self.net.langs)))
        np.add.at(total, owner, self(windows) * weight[:, None])
        mean = total / total.sum(1, keepdims=True)
        best = mean.argmax(1)
        return best, np.clip(mean[np.arange(len(best)), best], 0, 1)


def is_held_out(column: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def training_windows(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG, seed: int = 7) -> tuple[np.ndarray, np.ndarray, list[str]]:
    """A bounded sample of windows: at most ``docs_per_lang`` x WINDOWS_PER_DOC of each language.

    Documents are chosen by a hash of their id, windows at hashed places anywhere in the text.
    """
    known = docs.where(~is_held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return np.zeros((0, WINDOW), np.uint8), np.zeros(0, np.int64), []
    langs, grain = sorted(counts), 1 << 30
    share = F.create_map(*[x for k in langs for x in (F.lit(k), F.lit(int(min(1.0, 1.3 * docs_per_lang / counts[k]) * grain)))])
    draw = F.xxhash64("doc_id", F.lit(seed))
    sample = known.where(F.pmod(draw, F.lit(grain)) < share[F.col("lang")]).select("lang", "text", draw.alias("draw"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            rows = []
            for lang, text, draw in zip(*(part.column(c).to_pylist() for c in ("lang", "text", "draw")), strict=True):
                if _has_letter(text):
                    raw, rng = np.frombuffer(text.encode(), np.uint8), np.random.default_rng(abs(draw))
                    for k in range(WINDOWS_PER_DOC):
                        at = int(rng.integers(0, max(1, len(raw) - WINDOW + 1)))
                        have = len(raw) - at if rng.random() > 0.3 else int(rng.integers(16, WINDOW))  # short ones too
                        rows.append((lang, draw, k, raw[at : at + min(have, WINDOW)].tobytes().ljust(WINDOW, b"\0")))
            cols = list(zip(*rows, strict=True)) or [[], [], [], []]
            kinds = (pa.string(), pa.int64(), pa.int32(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["lang", "draw", "k", "bytes"])

    drawn = sorted(sample.mapInArrow(run, "lang string, draw long, k int, bytes binary").collect())
    taken, kept = dict.fromkeys(langs, 0), []
    for r in drawn:
        if taken[r["lang"]] < docs_per_lang * WINDOWS_PER_DOC:
            taken[r["lang"]] += 1
            kept.append(r)
    x = np.frombuffer(b"".join(bytes(r["bytes"]) for r in kept), np.uint8).reshape(-1, WINDOW)
    return x, np.array([langs.index(r["lang"]) for r in kept], np.int64), langs


def identify(docs: DataFrame, net: Net | None) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text.

    ``und`` with score 0 for a null text, a text without a letter, or if no language
    was learned; repeated rows give a row each; an empty table none.  Only doc_id and
    text are read for the prediction.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net)  # some 10,000 weights, whatever the input

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(shared.value) if shared.value else None
        for part in slices(batches):
            texts = texts_of(part)
            able = [i for i, t in enumerate(texts) if score and _has_letter(t)]
            lang, sure = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if able:
                best, p = score.documents([texts[i] for i in able])
                for i, b, s in zip(able, best.tolist(), p.tolist(), strict=True):
                    lang[i], sure[i] = score.net.langs[b], s
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("held_out"), pa.array(lang, pa.string()), pa.array(sure, pa.float64())],
                ["doc_id", "held_out", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), is_held_out().alias("held_out"), "text").mapInArrow(run, RESULT)


def language_id(docs: DataFrame, docs_per_lang: int = DOCS_PER_LANG) -> DataFrame:
    """Train on the labelled documents that are not held out, then predict every document.

    Null text, and text without a letter, is ``und``, as is all text if no document has a label; a null doc_id stays null; repeated
    rows are predicted alike; an empty table gives no rows; only doc_id, text and lang are read.
    """
    x, y, langs = training_windows(docs, docs_per_lang)
    return identify(docs, train(x, y, langs) if len(x) else None)
