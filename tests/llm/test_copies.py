"""Exact and near duplicates against brute force."""

from __future__ import annotations

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from scorewright.llm import exact_dedup, graph, ngram_join, shingles, textops
from scorewright.llm.graph import components
from scorewright.llm.queries import ORACLE_SQL, QUERIES
from tests.compare import same
from tests.llm.conftest import frame

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_exact_dedup", "op4_ngram_jaccard"])
def test_query_equals_sql(spark, name):
    same(QUERIES[name](spark, SF), SF, ORACLE_SQL[name])


def dedup_brute(rows):
    groups = defaultdict(list)
    for d, t, *_ in rows:
        groups[re.sub("[\x20\x09-\x0d]", "", t or "")].append((-len(t or ""), d is None, d or 0))
    out = []
    for norm, members in groups.items():
        keep = min(members)
        keep_id = None if keep[1] else keep[2]
        for _, none, d in members:
            doc = None if none else d
            out.append((doc, keep_id, len(members), doc == keep_id, hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=str)


def test_dedup_odd_rows(odd, odd_rows, none):
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(odd).collect()), key=str)
    assert got == dedup_brute(odd_rows)
    assert exact_dedup.exact_dedup(none).count() == 0


def test_dedup_hot_group(spark):
    rows = [(i, "same text " + " " * (i % 3)) for i in range(1000)] + [(5000 + i, f"text {i}") for i in range(300)]
    got = sorted((tuple(r) for r in exact_dedup.exact_dedup(frame(spark, rows)).collect()), key=str)
    assert got == dedup_brute(rows)


def test_without_copies_keeps_columns(odd):
    kept = exact_dedup.without_copies(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} >= {5, 6, 7, 8, 9}


def sets_of(rows, k):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    out = {}
    for d, t in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (t or "").translate(lower))
        out[d] = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    return out


def jaccard_brute(rows, k, percent):
    sets = sets_of(rows, k)
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = defaultdict(list)
    for a in sorted(sets):
        shared = Counter()
        for s in sets[a]:
            shared.update(holders[s])
            holders[s].append(a)
        for b, i in shared.items():
            if 100 * i >= percent * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return sorted((d, len(s), find(d)) for d, s in sets.items())


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80)])
def test_jaccard_equals_brute_force(spark, words, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, words, percent).collect())) == jaccard_brute(rows, words, percent)


def near_copies(n=140, seed=2):
    """Chains of edits, texts at the threshold, and a passage that all share."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    common = [rng.choice(vocab) for _ in range(30)]
    rows, base = [], [rng.choice(vocab) for _ in range(120)]
    for i in range(n):
        if i % 20 == 0:
            base = [rng.choice(vocab) for _ in range(rng.choice([4, 7, 40, 120]))]
        text = list(base)
        for _ in range(rng.randrange(3)):
            text[rng.randrange(len(text))] = rng.choice(vocab)
        rows.append((i, " ".join([*text, *common] if i % 3 else text)))
    return rows


@pytest.mark.parametrize("size", [90, 300, 1500])
def test_jaccard_with_tiny_tiles(spark, monkeypatch, size):
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", size)
    rows = near_copies()
    assert sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows)).collect())) == jaccard_brute(rows, 4, 85)


def test_jaccard_odd_rows(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(odd).collect()}
    assert {(1, 9, 1), (2, 0, 2), (3, 0, 3), (4, 0, 4), (5, 9, 1), (None, 1, None), (7, 1, 7), (9, 1, 9), (10, 1, 10), (11, 1, 10)} <= got
    assert ngram_join.jaccard_components(odd).count() == odd.count()
    assert ngram_join.jaccard_components(none).count() == 0


def test_exact_links_span_what_all_pairs_span():
    rng = np.random.default_rng(1)
    base = [np.unique(rng.integers(0, 1 << 63, 80, dtype=np.uint64)) for _ in range(12)]
    sets = []
    for b in base:
        for _ in range(8):
            sets.append(np.unique(np.concatenate([b[rng.random(len(b)) > 0.05], rng.integers(0, 1 << 63, int(rng.integers(0, 9)), dtype=np.uint64)])))
    sets.sort(key=len)

    def groups(pairs):
        parent = list(range(len(sets)))

        def find(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in pairs:
            parent[max(find(a), find(b))] = min(find(a), find(b))
        return [find(i) for i in range(len(sets))]

    slow = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * (k := len(np.intersect1d(sets[i], sets[j]))) >= 85 * (len(sets[i]) + len(sets[j]) - k)]
    assert groups(ngram_join.exact_links(sets, 85)) == groups(slow)


def test_bitmaps_never_prune_a_similar_pair():
    rng = np.random.default_rng(2)
    for n in (3, 20, 200, 2000):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[len(a) // 12 :], rng.integers(0, 1 << 63, n // 15, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        for w in (1, 2, 8, 64):
            x, y = ngram_join.parity_bitmap(a, w), ngram_join.parity_bitmap(b, w)
            assert np.bitwise_count(x ^ y).sum() <= differ
            assert (ngram_join.folded(ngram_join.parity_bitmap(a, 2 * w), w) == x).all()


def test_components_chain_and_star(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(7, 7), (5000, 4000)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(80)) and got[5000] == 4000
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_keeps_the_smallest(spark):
    rows = near_copies(60)
    kept = sorted(r.doc_id for r in ngram_join.one_of_each(frame(spark, rows)).collect())
    assert kept == [d for d, _, c in jaccard_brute(rows, 5, 80) if d == c]


def thue_morse(n):
    word = "a"
    for _ in range(n):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


@pytest.mark.parametrize("n", [3, 6, 8, 10, 12])
def test_words_of_a_regular_pattern_have_other_hashes(n):
    """A polynomial modulo 2 ** 64 gives such a word and its complement the same hash."""
    word, checks = thue_morse(n), []
    a, b = shingles.shingle_sets([word, word.translate(str.maketrans("ab", "ba"))], 4, checks)
    assert a.tolist() != b.tolist() and checks[0].tolist() != checks[1].tolist()


def test_regular_patterns_are_not_linked(spark):
    word = thue_morse(10)
    rows = [(1, word), (2, word.translate(str.maketrans("ab", "ba"))), (3, word.upper())]
    assert sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows)).collect())) == [(1, 1, 1), (2, 1, 2), (3, 1, 1)]


def test_word_hashes_by_plain_words():
    """Equal hashes for equal lower-cased shingles and for no others, in texts of all lengths of words."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choice("abAé") for _ in range(rng.choice([1, 2, 7, 8, 9, 16, 17, 255, 256, 257, 700]))) for _ in range(rng.randrange(12))) for _ in range(300)]
    for checks in (None, []):
        found = shingles.shingle_sets(texts, 2, checks)
        plain = sets_of(enumerate(texts), 2)
        assert [len(x) for x in found] == [len(plain[i]) for i in range(300)]
        assert len(np.unique(np.concatenate(found))) == len(set().union(*plain.values()))


def test_second_hashes_decide():
    """Elements that agree in the first hash only are not shared."""
    x = np.arange(1, 101, dtype=np.uint64)
    assert ngram_join.exact_links([x, x], 85, checks=[x, x]) == [(0, 1)]
    assert ngram_join.exact_links([x, x], 85, checks=[x, x + np.uint64(1)]) == []


def test_common_keys_in_parts(spark, monkeypatch):
    """Keys of many classes, whose rows are dealt over parts and whose classes meet in several tiles."""
    rng = random.Random(8)
    base = [f"v{i}" for i in range(12)]
    rows = [(i, " ".join([*base, f"x{rng.randrange(150)}", f"y{i % 2}"])) for i in range(400)]
    docs = frame(spark, rows)
    over = ngram_join.excess(ngram_join.count_sketch(docs, 4, 1 << 16))
    monkeypatch.setattr(ngram_join, "KEY_ROWS", 5)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", 40)
    signed = ngram_join.signatures(docs.selectExpr("doc_id", "text", "CAST(null AS BINARY) AS tag"), 4, 60, over, len(rows)).collect()
    assert all(len(r.parts) == len(r.tokens) for r in signed) and max(p for r in signed for p in r.parts) > 1
    assert sorted(map(tuple, ngram_join.jaccard_components(docs, 4, 60).collect())) == jaccard_brute(rows, 4, 60)


def test_sketch_counts_beyond_32_bits():
    many = np.array([1_500_000_000, 2_000_000_000], np.int64)
    assert (ngram_join.excess(np.concatenate([many * 4, np.zeros(6, np.int64)])) >= 0).all()


def test_sketch_counts_all_shingles(spark):
    rows = [(i, f"a b c d e{i % 7} f") for i in range(200)] + [(900, None)]
    counts = ngram_join.count_sketch(frame(spark, rows).repartition(5), 4, 1 << 16)
    assert counts.dtype == np.int64 and counts.sum() == 600 and counts.max() == 200


def test_components_of_a_hub(spark, monkeypatch):
    """A hub of 100,000 edges through the salted joins."""
    monkeypatch.setattr(graph, "BROADCAST_ROWS", 100)
    e = spark.range(1, 100_001).selectExpr("CAST(0 AS LONG) AS a", "id AS b").unionByName(spark.createDataFrame([(100_001, 100_002), (100_002, 100_003)], "a long, b long"))
    got = components(e).groupBy("component").count().collect()
    assert sorted(map(tuple, got)) == [(0, 100_001), (100_001, 3)]


ODD_IDS = [
    (None, "same words here again and again"), (None, "same  words here again and again"), (None, "same words here again and again"),
    (7, "twice the very same row"), (7, "twice the very same row"), (7, "another text under the same id"), (8, "twice the very same  row"),
    (None, "alone without an id"), (9, None), (10, ""), (10, ""), (11, "  "),
]


def test_without_copies_leaves_one_row_of_each_text(spark):
    kept = exact_dedup.without_copies(frame(spark, ODD_IDS).repartition(3)).collect()
    assert sorted(((r.doc_id, r.text) for r in kept), key=str) == sorted(
        [(None, "same  words here again and again"), (7, "another text under the same id"), (8, "twice the very same  row"), (None, "alone without an id"), (11, "  ")], key=str
    )


def test_one_of_each_leaves_one_row_of_each_component(spark):
    kept = ngram_join.one_of_each(frame(spark, ODD_IDS).repartition(3)).collect()
    words = [(r.doc_id, r.text.split()) for r in kept if (r.text or "").strip()]
    assert sorted(words, key=str) == sorted(
        [(None, "same words here again and again".split()), (7, "another text under the same id".split()), (7, "twice the very same row".split()), (None, "alone without an id".split())], key=str
    )
    assert sorted((r.doc_id, r.text or "") for r in kept if not (r.text or "").strip()) == [(9, ""), (10, ""), (10, ""), (11, "  ")]
    assert set(kept[0].asDict()) == set(frame(spark, []).columns)


def test_scratch_deletes_what_was_written_inside(spark):
    before = textops.written(spark.range(3).toDF("x"), "outer")
    with textops.scratch(spark):
        inner = textops.written(spark.range(5).toDF("x"), "inner")
        assert inner.count() == 5
        path = inner.inputFiles()[0].rsplit("/", 1)[0].removeprefix("file://")
    import os

    assert not os.path.exists(path) and before.count() == 3


def test_written_leaves_no_shuffle_files(spark):
    """Else all shuffles of a query stay on disk together, as long as the driver collects no garbage."""
    import time
    from pathlib import Path

    dirs = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    files = lambda: {f for d in dirs for f in Path(d).rglob("shuffle_*")}
    before, setting = files(), spark.conf.get(textops.SHUFFLE_CLEANUP)
    rows = textops.written(spark.range(1000).selectExpr("id % 10 AS k").groupBy("k").count(), "counts")
    for _ in range(50):
        if files() - before:
            time.sleep(0.1)
    assert not files() - before and rows.count() == 10
    assert spark.conf.get(textops.SHUFFLE_CLEANUP) == setting


def test_one_of_each_leaves_only_the_rows_to_keep(spark):
    """Signatures, classes and links go before the texts of all documents are shuffled."""
    import os

    at = textops.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(at))
    kept = ngram_join.one_of_each(frame(spark, [(i, f"w{i // 2} b c d e f g h") for i in range(20)]))
    assert [x.rsplit("-", 1)[0] for x in set(os.listdir(at)) - before] == ["keep"]
    assert kept.count() == 10


def test_sketch_blocks_take_as_few_bytes_as_their_counts():
    for most, width in ((0, 1), (255, 1), (256, 2), (70_000, 4), (1 << 33, 8)):
        counts = np.zeros(ngram_join.SKETCH_BLOCK, np.int64)
        counts[5] = most
        raw = ngram_join.packed(counts)
        assert len(raw) == width * len(counts) and (ngram_join.unpacked(raw) == counts).all()


def test_shared_folder_must_be_set_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Spark:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere:7077"

            class _jsc:
                @staticmethod
                def sc():
                    class S:
                        @staticmethod
                        def getCheckpointDir():
                            class O:
                                @staticmethod
                                def getOrElse(x):
                                    return x

                            return O

                    return S

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        textops.shared_dir(Spark())


def test_components_of_long_chains(spark, monkeypatch):
    """Chains in rising, falling and mixed order, a star and a circle: few rounds whatever the order."""
    n = 1500
    mixed = random.Random(2).sample(range(10_000, 10_000 + n), n)
    edges = [(i, i + 1) for i in range(n)] + [(20_000 + n - i, 20_000 + n - i - 1) for i in range(n)] + list(zip(mixed, mixed[1:], strict=False))
    edges += [(30_500, 30_000 + i) for i in range(400)] + [(40_000 + i, 40_000 + (i + 1) % 50) for i in range(50)]
    made = []
    real = graph.written
    monkeypatch.setattr(graph, "written", lambda df, name, path=None: (made.append(name), real(df, name, path))[1])
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert made.count("edges") <= 14
    want = {i: 0 for i in range(n + 1)} | {i: 20_000 for i in range(20_000, 20_001 + n)} | dict.fromkeys(mixed, min(mixed)) | {30_500: 30_000} | {30_000 + i: 30_000 for i in range(400)} | {40_000 + i: 40_000 for i in range(50)}
    assert got == want


@pytest.mark.parametrize("ids", ["none", "one", "pairs"])
def test_near_copies_without_ids_of_their_own(spark, ids):
    """Texts of one id, of none, or of an id that two texts share link as texts of many do; repeated rows too."""
    base = [f"w{i}" for i in range(60)]
    texts = [" ".join([*base[:30], f"x{i}", *base[31:]]) for i in range(120)] + [f"alone {i} {i + 1} {i + 2} {i + 3}" for i in range(10)]
    doc = {"none": lambda i: None, "one": lambda i: 7, "pairs": lambda i: i // 2}[ids]
    rows = [(doc(i), t) for i, t in enumerate(texts)] + [(doc(0), texts[0])] * 50
    got = [(r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(frame(spark, rows), words=4, percent=85).collect()]
    first = {"none": None, "one": 7, "pairs": 0}[ids]
    want = [(doc(i), 57, first) for i in range(120)] + [(doc(i), len(set(zip(*[t.split()[k:] for k in range(4)], strict=False))), doc(i)) for i, t in enumerate(texts) if i >= 120]
    want += [(doc(0), 57, first)] * 50
    assert sorted(got, key=str) == sorted(want, key=str)
    assert ngram_join.one_of_each(frame(spark, rows), words=4, percent=85).count() == 11


def test_near_copies_of_all_texts_shuffle_little(spark):
    """Keys whose classes are one cluster need no tile, and tiles get texts: their rows and shingles are many times the texts."""
    rng = random.Random(5)
    texts = [" ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(400)) for _ in range(500)]
    docs = frame(spark, [(i + 1000 * k, t + more) for i, t in enumerate(texts) for k, more in enumerate(("", " one", " two"))])
    sc = spark.sparkContext._jsc.sc()

    def shuffled():
        sc.listenerBus().waitUntilEmpty()
        return sc.statusStore().executorList(False).apply(0).totalShuffleWrite()

    before = shuffled()
    assert sorted(r.doc_id for r in ngram_join.one_of_each(docs).collect()) == list(range(500))
    assert shuffled() - before < 3.5 * 3 * sum(map(len, texts))


@pytest.mark.parametrize("tile_rows", [10, 4096])
def test_jaccard_in_passes(spark, monkeypatch, tile_rows):
    """Clusters of one pass go on in the next; a common key's largest cluster is met by the others only."""
    monkeypatch.setattr(ngram_join, "PASS_DOCS", 20)
    monkeypatch.setattr(ngram_join, "TILE_ROWS", tile_rows)
    rng = random.Random(11)
    words = [f"w{i}" for i in range(500)]
    rows, base = [], [rng.choice(words) for _ in range(70)]
    for i in range(120):
        copy = list(base)
        for _ in range(rng.randrange(7)):
            copy[rng.randrange(len(copy))] = rng.choice(words)
        rows.append((i, " ".join(copy[: rng.randrange(40, 71)])))
    assert sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows), 3, 80).collect())) == jaccard_brute(rows, 3, 80)


def test_many_tiles_in_turns(spark, monkeypatch):
    """A cluster dealt over many tiles ships its texts in turns."""
    monkeypatch.setattr(ngram_join, "TILE_SHINGLES", 200)
    real, made = ngram_join.written, []
    monkeypatch.setattr(ngram_join, "written", lambda df, name, path=None: made.append(name) or real(df, name, path))
    rows = [(i, " ".join(f"w{j if j != i else -i}" for j in range(100))) for i in range(40)]
    assert sorted(map(tuple, ngram_join.jaccard_components(frame(spark, rows)).collect())) == jaccard_brute(rows, 4, 85)
    assert made.count("links") > 1


def test_connected_pairs_skip_known_components():
    key, node, n = np.zeros(3, np.int64), np.array([7, 8, 9]), np.full(3, 10, np.int32)
    bits = [ngram_join.parity_bitmap(np.arange(10, dtype=np.uint64) << np.uint64(20), 1).tobytes()] * 3
    assert [p[:2] for p in ngram_join.connected_pairs(key, node, n, bits, 80)] == [(7, 8), (8, 9)]
    assert [p[:2] for p in ngram_join.connected_pairs(key, node, n, bits, 80, np.array([7, 7, 9]))] == [(8, 9)]


@pytest.mark.parametrize("most", [100, 1])
def test_merged_components(spark, monkeypatch, most):
    monkeypatch.setattr(graph, "BROADCAST_ROWS", most)
    found = spark.createDataFrame([(1, 1), (2, 1), (3, 3), (4, 3)], "node long, component long")
    more = spark.createDataFrame([(1, 0), (3, 0), (0, 0), (8, 5), (5, 5)], "node long, component long")
    assert sorted(map(tuple, graph.merged(found, more).collect())) == [(0, 0), (1, 0), (2, 0), (3, 0), (4, 0), (5, 5), (8, 5)]
