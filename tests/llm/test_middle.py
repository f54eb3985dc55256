"""Fill-in-the-middle, power-of-two packing and spelling variants against plain versions."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from scorewright.llm import dyadic, infill, queries, spelling, wordbpe
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"
UNIT_PATTERNS = {"lines": r"[^\n]*\n|[^\n]+", "words": r"[\x20\x09-\x0D]+|[^\x20\x09-\x0D]+", "characters": r"[\s\S]"}


def plain_infill(doc, text, pattern=UNIT_PATTERNS["lines"]):
    """Output, n, form, prefix and middle by cutting the text into its units."""
    units = re.findall(pattern, text or "")
    digest = hashlib.sha256(f"7:{'' if doc is None else doc}".encode()).hexdigest()
    h = [int(digest[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in infill.SENTINELS):
        return text or "", len(units), "plain", None, None
    out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 50 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return out[1], len(units), out[0], len(p), len(m)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("unit", infill.UNITS)
def test_cuts_are_those_of_the_pattern(unit):
    rng = random.Random(7)
    texts = ["".join(rng.choice("ab \n\n\t\r😀é<P>S") for _ in range(rng.randrange(40))) for _ in range(4000)]
    for i, t in enumerate([*texts, "\n", "\n\n", "x", " ", "a\n<M>\nb", "line\n" * 5000]):
        assert infill.infilled(t, i, unit, infill.SENTINELS, 7, 100, 50) == plain_infill(i, t, UNIT_PATTERNS[unit])


def test_infill_query_on_odd_rows(spark, odd, odd_rows, none):
    extra = [(100 + i, t) for i, t in enumerate(["a<P>b\nc", "<\nP>\n<S\n>", "a\n<", "one line", "\n\n\n", "q\nr\n" * 40_000])]
    docs = odd.unionByName(frame(spark, extra))
    want = []
    for doc, text, *_ in [*odd_rows, *extra]:
        out, n, form, a, b = plain_infill(doc, text)
        want.append((doc, n, form, a, b, sha(out), sha(text or "")))
    got = infill.infill_digest(infill.fill_in_middle(docs))
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert infill.fill_in_middle(none).count() == 0


def test_other_sentinels_and_shares(spark):
    docs = frame(spark, [(i, f"alpha beta\ngamma {i}\ndelta\n") for i in range(400)])
    marks = ("<|pre|>", "<|suf|>", "<|mid|>")
    made = infill.fill_in_middle(docs, unit="words", sentinels=marks, fim_percent=60, spm_percent=0)
    rows = made.withColumn("back", infill.restored(F.col("text"), F.col("form"), marks)).join(docs.select("doc_id", F.col("text").alias("old")), "doc_id").collect()
    assert all(r["back"] == r["old"] for r in rows)
    forms = Counter(r["form"] for r in rows)
    assert set(forms) == {"plain", "psm"} and 180 < forms["psm"] < 300
    with pytest.raises(ValueError, match="begins inside"):
        infill.fill_in_middle(docs, sentinels=("<<", "<S>", "<M>"))
    with pytest.raises(ValueError, match="unit"):
        infill.fill_in_middle(docs, unit="pages")


@pytest.fixture(scope="module")
def word_library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_word_ids_equal_the_library(word_library):
    rng = random.Random(1)
    alphabet = " \t\n\x0b\x1c\x85 　aA'sS'llT1é́ΣσİßÅƁɏ<|endoftext|>한글हि日本½-_!?.\x00"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(5000)]
    texts += ["<|endoftext|> a<|startoftext|>b", "x" * 50_000, "日本" * 5000, "word " * 20_000, " " * 200_000, *(f"a{chr(c)}b {chr(c)}" for c in range(0x300))]
    enc = wordbpe.encoder(wordbpe.default_path())
    ids, off = enc.encode(texts, None)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == word_library(t), t[:80]


def packed_plainly(doc, text, library, capacity=2048):
    ids = [*library(text), 1]
    left, at, out = len(ids), 0, []
    while left:
        size = min(capacity, 1 << (left.bit_length() - 1))
        raw = np.array(ids[at : at + size], "<u4").tobytes()
        out.append((doc, at, size, zlib.crc32(raw), len(ids)))
        at, left = at + size, left - size
    return out


def test_packing_query_on_odd_rows(odd, odd_rows, none, word_library):
    rows = dyadic.packing_digest(dyadic.power_of_two_pack(odd)).collect()
    want = [x for doc, text, *_ in odd_rows for x in packed_plainly(doc, text, word_library)]
    assert sorted(((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows), key=str) == sorted(want, key=str)
    assert len({r["sequence_id"] for r in rows}) == len(rows) and all(r["offset"] == 0 and r["length"] == 1 << r["bucket"] for r in rows)
    assert dyadic.power_of_two_pack(none).count() == 0


def test_packing_query_on_a_table(spark, word_library):
    rows = queries.op12_power_of_two_pack(spark, SF).collect()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = [x for doc, text in docs for x in packed_plainly(doc, text, word_library)]
    assert sorted((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in rows) == sorted(want)


def test_buckets_read_back(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = dyadic.power_of_two_pack(docs, capacity=64)
    path = str(tmp_path / "buckets")
    dyadic.write_buckets(packed, path, file_rows=50)
    want = Counter(r["bucket"] for r in packed.select("bucket").collect())
    for bucket, n in want.items():
        got = dyadic.read_bucket(spark, path, bucket)
        assert {f.split("bucket=")[1].split("/")[0] for f in got.inputFiles()} >= {str(bucket)} and got.count() == n
        assert "PartitionFilters: [isnotnull(bucket" in got._jdf.queryExecution().simpleString()
    longest = dyadic.read_bucket(spark, path, 6).orderBy("doc_id", "start").limit(7).collect()
    batches = list(dyadic.batches_of((bytes(r["ids"]) for r in longest), 64, 3))
    assert [b.shape for b in batches] == [(3, 64), (3, 64), (1, 64)]
    assert zlib.crc32(batches[0][0].tobytes()) == zlib.crc32(bytes(longest[0]["ids"]))
    with pytest.raises(ValueError, match="power of two"):
        dyadic.power_of_two_pack(docs, capacity=1000)


def plain_variants(docs, least_count=3):
    count = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{w}".encode())
            count[w[: h % len(w)] + w[h % len(w) + 1 :] if h % 97 == 0 else w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= least_count}
    near, holes = defaultdict(set), defaultdict(list)
    for w in words:
        for i in range(len(w)):
            holes[i, w[:i] + w[i + 1 :]].append(w)
            if (v := w[:i] + w[i + 1 :]) in words:
                near[v].add(w)
                near[w].add(v)
    for group in holes.values():
        for w in group:
            near[w] |= set(group) - {w}
    form = {}
    for w in near:
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        if best and words[best] >= 2 * words[w]:
            form[w] = best

    def root(w):
        while w in form:
            w = form[w]
        return w

    return sorted((w, form.get(w), root(w), n, len(near[w]), words.get(form.get(w))) for w, n in words.items())


@pytest.mark.parametrize("key_words", [0, 3, spelling.KEY_WORDS, 10**6])
def test_variants_by_keys_and_by_deletions(spark, key_words):
    """Few letters, so that bigrams repeat and words are near: each way of joining alone, and both."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abé×") for _ in range(rng.randrange(5, 9))) for _ in range(700)]
    words += ["nananana", "nanananana", "ananana", "nanananan", "aaaaa", "aaaaaa", "aaaaaaa"]
    docs = [(i, " ".join(rng.choices(words, k=300))) for i in range(30)]
    got = spelling.spelling_variants(frame(spark, docs), key_words=key_words)
    want = plain_variants(docs)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == want and sum(r[4] for r in want) > 1000


def test_variants_on_odd_rows(spark, odd, odd_rows, none):
    long = "z" * 30_000
    extra = [(200, f"{long} {long}x {long} {long}x, COLOUR colour Colour colours"), (None, f"colour's color {long}x {long}"), (201, "ÀÉcolour àécolour ÀÉcolour ÀÉcolour àécolour àécolour" * 2)]
    docs = [(r[0], r[1]) for r in odd_rows] + extra
    got = spelling.spelling_variants(odd.unionByName(frame(spark, extra)))
    assert sorted(map(tuple, got.collect()), key=lambda r: r[0]) == plain_variants(docs)
    assert spelling.spelling_variants(none).count() == 0


def test_roots_follow_chains(spark):
    chain = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(37)] + [("a", "w30"), ("b", "c")], "word string, form string")
    assert {tuple(r) for r in spelling.roots_of(chain).collect()} == {(f"w{i}", "w37") for i in range(37)} | {("a", "w37"), ("b", "c")}
