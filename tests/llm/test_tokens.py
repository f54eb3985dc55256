"""SentencePiece, packing and the token store against the libraries, and exact round trips."""

from __future__ import annotations

import hashlib
import io
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from scorewright.llm import bytebpe, packing, spm, token_store

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def pieces():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def random_texts(n=2000, seed=1):
    rng = random.Random(seed)
    alphabet = " ▁ab\n\tethe.,éß日\U0001f600\x00  ingrs0189_'"
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(n)]
    return [*texts, "", " ", " " * 77, "a" * 3000, "ab" * 2000 + " " * 33 + "the" * 999]


def test_pieces_equal_the_library(pieces):
    texts = random_texts()
    model = spm.model(spm.default_path())
    ids, off = model.encode(texts)
    back = model.decode(ids, off)
    for i, t in enumerate(texts):
        expected = pieces.encode(t, add_bos=True, add_eos=True)
        assert ids[off[i] : off[i + 1]].tolist() == expected
        assert back[i].decode() == pieces.decode(expected)


def test_round_trip_query(spark, odd, odd_rows, none, pieces):
    got = sorted((tuple(r) for r in spm.round_trip(odd).collect()), key=str)
    want = []
    for doc, text, *_ in odd_rows:
        ids = pieces.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(pieces.decode(ids).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert spm.round_trip(none).count() == 0


def test_encode_and_decode_frames(spark, odd, odd_rows, pieces):
    back = spm.decode_documents(spm.encode_documents(odd)).collect()
    assert sorted((r.doc_id, r.text) for r in back if r.doc_id) == sorted((d, pieces.decode(pieces.encode(t or ""))) for d, t, *_ in odd_rows if d)


def test_byte_pairs_equal_the_library(library):
    enc = bytebpe.encoder(bytebpe.default_path())
    texts = [*random_texts(), "<|endoftext|> it's　'll \x1c\x85\xa0 ²³ ١٢"]
    ids, off = enc.encode(texts)
    for i, t in enumerate(texts):
        assert ids[off[i] : off[i + 1]].tolist() == [*library(t), 2]


@pytest.mark.parametrize("text", ["<|endoftext|>", "x <|endoftext|> y", " <|endoftext|><|endoftext|>z", "<|endoftext|", "<|<|endoftext|>|>", "a\n<|endoftext|>\nb's", "<|ENDOFTEXT|>", "x <|endoftext|>" + " " * 150_000 + "y<|endoftext|>"])
def test_added_tokens_have_one_id(library, text):
    ids, _ = bytebpe.encoder(bytebpe.default_path()).encode([text])
    assert ids.tolist() == [*library(text), 2]
    assert ids.tolist().count(50256) == text.count("<|endoftext|>")


@pytest.mark.parametrize("char", [" ", "\n", "a", "7", "!", "日"])
def test_two_million_equal_characters(library, char):
    ids, off = bytebpe.encoder(bytebpe.default_path()).encode([char * 2_000_000, "after"])
    assert ids[: off[1]].tolist() == [*library(char * 2_000_000), 2]


@pytest.mark.parametrize("run", [" " * 1_200_000, "\n" * 1_200_000, " \t\u3000" * 400_000], ids=["spaces", "lines", "mixed"])
@pytest.mark.parametrize("tail", ["word", "", "!"])
def test_byte_pairs_of_long_whitespace(library, run, tail):
    ids, off = bytebpe.encoder(bytebpe.default_path()).encode(["before", "it's" + run + tail, "after"])
    assert ids[off[1] : off[2]].tolist() == [*library("it's" + run + tail), 2]
    assert ids[: off[1]].tolist() == [*library("before"), 2] and ids[off[2] :].tolist() == [*library("after"), 2]


@pytest.mark.parametrize("run", [" " * 99_998, "\n" * 99_998])
def test_both_encoders_agree_below_the_long_run(library, run):
    ids, _ = bytebpe.encoder(bytebpe.default_path()).encode([run + "word"])
    assert ids.tolist() == [*library(run + "word"), 2]


@pytest.mark.parametrize("lengths", [[], [1024], [1, 1023, 1024, 600, 500, 424], list(range(1, 400))])
def test_sum_of_squares_places(lengths):
    lengths = np.array(sorted(lengths, reverse=True), np.int64)
    seq, off = packing.sum_of_squares(lengths, 1024)
    used = defaultdict(int)
    for s, o, n in zip(seq.tolist(), off.tolist(), lengths.tolist(), strict=True):
        assert used[s] == o
        used[s] += n
    assert all(v <= 1024 for v in used.values())
    assert len(used) <= -(-lengths.sum() // 1024) * 1.02 + 1


def test_sum_of_squares_follows_its_rule():
    """Against a slow version that tries every gap."""
    rng, cap = random.Random(4), 30
    lengths = [rng.randrange(1, 30) for _ in range(300)]
    seq, off = packing.sum_of_squares(np.array(lengths), cap)
    gaps: dict[int, int] = {}
    for s, b, o in zip(lengths, seq.tolist(), off.tolist(), strict=True):
        count = defaultdict(int)
        for g in gaps.values():
            count[g] += g > 0

        def squares(g):
            c = dict(count)
            c[g] = c.get(g, 0) - 1
            if g > s:
                c[g - s] = c.get(g - s, 0) + 1
            return sum(v * v for v in c.values())

        fit = [g for g in count if count[g] and g >= s]
        best = min(fit, key=lambda g: (squares(g), g)) if fit else cap
        assert gaps.get(b, cap) == best and o == cap - best
        gaps[b] = best - s


def check_packed(rows, texts, library, capacity=1024):
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
    for r in by_seq.values():
        at = 0
        for x in sorted(r, key=lambda x: x.offset):
            assert x.offset == at and x.length > 0
            at += x.length
        assert at <= capacity
    for doc, text in texts.items():
        ids = [*library(text), 2]
        parts = sorted(by_doc[doc], key=lambda x: x.piece)
        assert [p.piece for p in parts] == list(range(-(-len(ids) // capacity)))
        assert all(p.length == capacity for p in parts[1:])
        for p in parts:
            assert zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes()) == p.ids_crc32
        assert sum(p.length for p in parts) == len(ids)
    total = sum(r.length for r in rows)
    return len(by_seq), -(-total // capacity)


def test_packing_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.best_fit_pack(docs).collect()
    used, least = check_packed(rows, {r.doc_id: r.text for r in docs.collect()}, library)
    assert used <= least * 1.05 + 1
    several = packing.best_fit_pack(docs, shard_pieces=60).collect()
    check_packed(several, {r.doc_id: r.text for r in docs.collect()}, library)


def test_packing_odd_rows(odd, odd_rows, none, library):
    rows = packing.best_fit_pack(odd).collect()
    check_packed(rows, {d: t for d, t, *_ in odd_rows if d not in (None, 5)}, library)
    assert sum(r.doc_id is None for r in rows) == 2 and sum(r.doc_id == 5 for r in rows) == 2
    assert packing.best_fit_pack(none).count() == 0


@pytest.mark.parametrize("bits", [1, 2, 3, 7, 8, 9, 13, 16, 17, 24, 32])
def test_bit_fields(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1000, dtype=np.uint64).astype(np.uint32)
    assert (token_store.unpack_bits(token_store.pack_bits(ids, bits), len(ids), bits) == ids).all()
    w = token_store.Writer(bits, block=64)
    for part in np.array_split(ids, 7):
        w.add(part)
    r = token_store.Reader(io.BytesIO(b"".join(w.image())))
    for first, n in ((0, 1000), (0, 0), (63, 2), (500, 130), (999, 1)):
        assert (r.ids(first, n) == ids[first : first + n]).all()
    assert token_store.width_of(1 << bits) == bits


def test_token_store_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = sorted(token_store.token_store(docs).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    at = 0
    for r, d in zip(got, sorted(docs.collect(), key=lambda d: d.doc_id), strict=True):
        ids = [*library(d.text), 2]
        assert tuple(r) == (d.doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_token_store_odd_rows(odd, odd_rows, none, library):
    rows = token_store.token_store(odd).collect()
    assert sorted(r.n_tokens for r in rows) == sorted(len(library(t)) + 1 for _, t, *_ in odd_rows)
    assert {r.start for r in rows if r.doc_id is None} == {0, len(library("a text without id")) + 1}
    assert token_store.token_store(none).count() == 0


def test_token_files_end_and_stream(spark, library, tmp_path):
    """Small files: several of a range, each whole, found in order, with blocks given away as they fill."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = f"file://{tmp_path}/tokens"
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 30)
    try:
        manifest = token_store.written(token_store.write_tokens(docs.repartition(3), folder, partitions=2, file_ids=1), "manifest")
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list((tmp_path / "tokens").glob("part-*-000002.tokens"))) == 2
    before = {r.file: r.before for r in token_store.file_starts(manifest).collect()}
    got = sorted(token_store.read_tokens(manifest, folder).collect(), key=lambda r: before[r.file] + r.first)
    assert [r.doc_id for r in got] == sorted(r.doc_id for r in docs.collect())
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r.ids_crc32 == zlib.crc32(np.array([*library(texts[r.doc_id]), 2], "<u4").tobytes()) for r in got)
    assert not [f for f in (tmp_path / "tokens").iterdir() if f.name.startswith("_")]
    parts = []
    w = token_store.Writer(16, 64, parts.append)
    for _ in range(50):
        w.add(np.arange(100, dtype=np.uint32))
        assert len(w._rest) < 64
    assert len(parts) == 1 + 5000 // 64
    with pytest.raises(ValueError):
        token_store.Reader(io.BytesIO(b"".join(parts)))


def test_decode_pieces_cut_anywhere(spark, pieces):
    """Ids cut inside a character, unknown ids and marks inside: as the library decodes them."""
    rng = random.Random(6)
    ids = pieces.encode("日本語 é ß \U0001f600 the end ▁ x\x00", add_bos=True, add_eos=True)
    rows = [ids[a:b] for a in range(0, len(ids), 2) for b in range(a, len(ids), 3)] + [[rng.randrange(32_000) for _ in range(rng.randrange(12))] for _ in range(300)]
    rows += [[rng.randrange(300) for _ in range(rng.randrange(9))] for _ in range(300)] + [[], None, [0], [1], [2, 1], [259], [1, 29871, 2]]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, ids array<int>").repartition(3)
    got = {r.doc_id: r.text for r in spm.decode_documents(df).collect()}
    for i, r in enumerate(rows):
        assert got[i] == pieces.decode(r or []), r
