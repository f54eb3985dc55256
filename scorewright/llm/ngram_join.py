"""N-gram Jaccard self-join: size-banded tiles with hashed bitmap signatures.

1. Equal shingle sets are one class; all later steps see classes only.
2. A class's rarest shingles, as many as a similar set must share one of, are its
   keys (prefix filter); rarity comes from a sketch of counts over all documents, and the
   classes that share a key are counted exactly.
3. Classes that share a key meet in a tile.  A tile is ordered by set size, so that
   only sizes within the threshold are compared, and the number of differing bits of
   two hashed bitmaps bounds the overlap from above.  Tiles carry short bitmaps; pairs of
   sets too large for those are held against bitmaps as long as the sets.  Pairs that
   pass connect classes to clusters, which hold every similar pair.  A key shared by very
   many classes is dealt over tiles of bounded size by size band and hash.  Keys are joined in
   passes, so that only a share of their rows is on disk at once: the first takes few keys, by
   which most near copies meet; later ones leave out keys whose classes are one cluster by then.
4. Clusters meet in tiles again, now with their texts, which become sorted shingle arrays
   there: bitmaps as long as the sets bound the overlap, then sorted-array intersection decides exactly.
   Pairs that are connected already need no decision.  A cluster too large for a tile is
   first dealt twice at random, which joins most of it; then only rows outside its largest
   component meet the others.  Verified links give components.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scorewright.llm.graph import components, lookup, merged, salted_lookup, salts_for
from scorewright.llm.shingles import shingle_sets
from scorewright.llm.textops import drop_path, scratch, shared_path, slices, take_rows, text_tag, texts_of, written

#: Rows of a key that are joined in one place: so many at least, and one in so many documents.
KEY_ROWS, KEY_SHARE = 20_000, 4096
#: Classes that share a key in one tile, and shingles of a cluster in one tile, about.
TILE_ROWS = 4096
TILE_SHINGLES = 4_000_000
#: Keys come in so many kinds; the first pass joins those of one kind, the later ones, one for so many documents but
#: no more than PASSES, all kinds.
KINDS, PASS_DOCS, PASSES = 16, 200_000, 5
SLICE = 2 << 20
SKETCH_BLOCK = 4096
#: 64-bit words of a short and of a full bitmap, at most; and the set size from which a short one bounds too little.
BITMAP_WORDS, FULL_WORDS = 8, 1024
LARGE_SET = 1200
#: Large sets that are near each other in a tile's order are paired at once, others by their short bitmaps.
NEAR = 64


def least_overlap(total: np.ndarray | int, percent: int):
    """The least intersection of two sets of ``total`` elements together with Jaccard >= percent / 100."""
    return -(-percent * total // (100 + percent))


# --- rarity ------------------------------------------------------------------------


def packed(counts: np.ndarray) -> bytes:
    """One block of counts, in the fewest bytes that its largest takes."""
    return counts.astype(np.min_scalar_type(int(counts.max()))).tobytes()


def unpacked(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, f"u{len(raw) // SKETCH_BLOCK}").astype(np.int64)


def count_sketch(docs: DataFrame, words: int, slots: int) -> np.ndarray:
    """Counts of all documents' shingles by hash slot: ``slots`` numbers, whatever the input."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for part in slices(batches, max_bytes=SLICE):
            sets = shingle_sets(texts_of(part), words)
            total += np.bincount((np.concatenate(sets) & np.uint64(slots - 1)).astype(np.int64), minlength=slots)
        if total.any():
            rows = total.reshape(-1, SKETCH_BLOCK)
            yield pa.RecordBatch.from_arrays([pa.array(range(len(rows)), pa.int32()), pa.array([packed(r) for r in rows], pa.binary())], ["block", "counts"])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column("block").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                total[k] = total.get(k, 0) + unpacked(raw)
        if total:
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([packed(v) for v in total.values()], pa.binary())], ["block", "counts"])

    kind = "block int, counts binary"
    rows = written(docs.select("text").mapInArrow(count, kind).repartition("block").mapInArrow(add, kind), "sketch").collect()
    out = np.zeros((slots // SKETCH_BLOCK, SKETCH_BLOCK), np.int64)
    for r in rows:
        out[r["block"]] += unpacked(r["counts"])
    return out.ravel()


def excess(counts: np.ndarray) -> np.ndarray:
    """Counts above what other shingles put in a slot on average."""
    return np.maximum(0, counts - int(counts.mean())).astype(np.int64)


# --- signatures --------------------------------------------------------------------


def bitmap_words(n: int, most: int = BITMAP_WORDS) -> int:
    """A power of two of 64-bit words with over 0.6 bits per element, at most ``most``."""
    words = 1
    while words < most and words * 64 < 0.6 * n:
        words *= 2
    return words


def parity_bitmap(x: np.ndarray, words: int) -> np.ndarray:
    """Bit h is the parity of how many elements hash to h: differing bits never outnumber differing elements."""
    bits = np.bincount((x >> np.uint64(20)).astype(np.int64) & (words * 64 - 1), minlength=words * 64) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view(np.uint64)


def folded(bitmap: np.ndarray, words: int) -> np.ndarray:
    """The bitmap of the same elements with fewer words."""
    return np.bitwise_xor.reduce(bitmap.reshape(-1, words), axis=0)


def set_digest(x: np.ndarray, check: np.ndarray) -> bytes:
    """A digest of a set by both hashes of its shingles."""
    return hashlib.blake2b(x.tobytes() + check.tobytes(), digest_size=16).digest()


SIGNED = "doc_id long, tag binary, n int, digest binary, short binary, bitmap binary, tokens array<long>, parts array<int>"


def signatures(docs: DataFrame, words: int, percent: int, over: np.ndarray, n_docs: int) -> DataFrame:
    """Per document (doc_id, text, tag): set size, digest, bitmap and its prefix of rarest shingles.

    Each of these has the number of parts that its rows are dealt over, which depends on the shingle alone.
    """
    slots = len(over)
    noise = 8 + 4 * int(math.sqrt(max(1.0, float(over.mean()))))
    level = np.where(over > noise, 1 + np.log2(np.maximum(over, 1) / noise), 0).astype(np.uint8)
    parts_at = np.ceil(noise * 2.0 ** np.arange(int(level.max()) + 1) / max(KEY_ROWS, n_docs // KEY_SHARE)).astype(np.int32)
    shared = docs.sparkSession.sparkContext.broadcast(level)  # a fixed number of slots

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = shared.value
        for part in slices(batches, max_bytes=SLICE):
            checks: list[np.ndarray] = []
            sets = shingle_sets(texts_of(part), words, checks)
            sizes, digests, short, bitmaps, tokens, parts = [], [], [], [], [], []
            for x, check in zip(sets, checks, strict=True):
                n = len(x)
                sizes.append(n)
                digests.append(set_digest(x, check))
                if not n:
                    short.append(b"")
                    bitmaps.append(b"")
                    continue
                bits = parity_bitmap(x, bitmap_words(n, FULL_WORDS))
                bitmaps.append(bits.tobytes())
                short.append(folded(bits, min(len(bits), BITMAP_WORDS)).tobytes())
                slot = (x & np.uint64(slots - 1)).astype(np.int64)
                p = n - (-(-percent * n // 100)) + 1
                rarest = np.argsort(level[slot], kind="stable")[:p]  # x is sorted, so ties go by hash
                tokens.append(x[rarest])
                parts.append(parts_at[level[slot[rarest]]])
            off = np.concatenate([[0], np.cumsum([n and n - (-(-percent * n // 100)) + 1 for n in sizes])]).astype(np.int32)
            flat = np.concatenate(tokens).view(np.int64) if tokens else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column("doc_id"),
                    part.column("tag"),
                    pa.array(sizes, pa.int32()),
                    pa.array(digests, pa.binary()),
                    pa.array(short, pa.binary()),
                    pa.array(bitmaps, pa.binary()),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(flat)),
                    pa.ListArray.from_arrays(pa.array(off), pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int32))),
                ],
                ["doc_id", "tag", "n", "digest", "short", "bitmap", "tokens", "parts"],
            )

    return docs.select("doc_id", "text", "tag").mapInArrow(run, SIGNED)


# --- tiles -------------------------------------------------------------------------


def size_place(n: Column, percent: int) -> Column:
    """Where a size lies: those of similar sets are less than 1 apart."""
    return F.log(n.cast("double")) / F.lit(-math.log(percent / 100 - 0.001))


def tile_keys(key: Column, m: Column, n: Column, member: Column, percent: int) -> Column:
    """Keys of the tiles in which a row meets all rows of its ``key`` of similar size.

    One tile if m is 1.  Else rows have a size band, as wide as the threshold allows sizes to
    differ, and one of m blocks; tiles are pairs of blocks of one band or of neighbouring bands.
    """
    band = F.floor(size_place(n, percent))
    block = F.pmod(F.xxhash64(member, F.lit("block")), m)
    js = F.sequence(F.lit(0).cast("long"), m.cast("long") - 1)

    def tile(low: Column, high: Column, i: Column, j: Column) -> Column:
        return F.xxhash64(key, low, high, i.cast("long"), j.cast("long"))

    many = F.flatten(
        F.array(
            F.transform(js, lambda j: tile(band, band, F.least(block.cast("long"), j), F.greatest(block.cast("long"), j))),
            F.transform(js, lambda j: tile(band, band + 1, block, j)),
            F.transform(js, lambda j: tile(band - 1, band, j, block)),
        )
    )
    return F.when(m <= 1, F.array(key)).otherwise(many)


def tiles_across(key: Column, inside: Column, m_b: Column, m_s: Column, n: Column, member: Column, percent: int) -> Column:
    """Keys of the tiles in which the rows outside a key's largest component meet all others of similar size.

    Rows ``inside`` it, in m_b blocks, meet only those outside it, in m_s blocks.
    """
    band = F.floor(size_place(n, percent))
    steps = F.array(*(F.lit(d).cast("long") for d in (-1, 0, 1)))
    upto = lambda m: F.sequence(F.lit(0).cast("long"), m.cast("long") - 1)
    across = lambda low, i, high, j: F.xxhash64(key, F.lit("across"), low, i.cast("long"), high, j.cast("long"))
    i, j = F.pmod(F.xxhash64(member, F.lit("i")), m_b), F.pmod(F.xxhash64(member, F.lit("j")), m_s)
    inner = F.flatten(F.transform(steps, lambda d: F.transform(upto(m_s), lambda y: across(band, i, band + d, y))))
    outer = F.flatten(F.transform(steps, lambda d: F.transform(upto(m_b), lambda x: across(band + d, x, band, j))))
    outer = F.concat(outer, tile_keys(F.xxhash64(key, F.lit("others")), m_s, n, member, percent))
    return F.when(inside, inner).otherwise(outer)


def groups_of(batches: Iterable[pa.RecordBatch], key: str, rows: int) -> Iterator[pa.Table]:
    """Tables of at least about ``rows`` rows that end where ``key`` changes, from sorted batches."""
    held: list[pa.RecordBatch] = []
    n = 0
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= rows:
            table = pa.Table.from_batches(held)
            keys = table.column(key).to_numpy()
            cut = int(np.flatnonzero(keys != keys[-1])[-1]) + 1 if keys[0] != keys[-1] else 0
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).combine_chunks().to_batches() if cut else table.combine_chunks().to_batches()
            n = len(keys) - cut
            rows = max(rows, 2 * n) if not cut else rows
    if n:
        yield pa.Table.from_batches(held)


def roots(parent: np.ndarray) -> np.ndarray:
    while True:
        up = parent[parent]
        if (up == parent).all():
            return up
        parent = up


def _join(parent: np.ndarray, a: int, b: int) -> bool:
    while parent[a] != a:
        parent[a] = parent[parent[a]]
        a = parent[a]
    while parent[b] != b:
        parent[b] = parent[parent[b]]
        b = parent[b]
    if a == b:
        return False
    parent[max(a, b)] = min(a, b)
    return True


def connected_pairs(
    key: np.ndarray, node: np.ndarray, n: np.ndarray, bitmap: list[bytes], percent: int, known: np.ndarray | None = None
) -> list[tuple[int, int, bool]]:
    """Pairs of nodes that share a key and pass size and bitmap bounds, without those that close a circle.

    Rows are sorted by key and n.  Row i is held against row i + d for d = 1, 2, ... at once.  A
    pair of large sets whose short bitmaps do not tell them apart is given each once with False.
    ``known``: a component of each node from before, or None.
    """
    names, row, at = np.unique(node, return_index=True, return_inverse=True)
    words = np.fromiter(map(len, bitmap), np.int64, len(bitmap)) // 8
    by: dict[int, np.ndarray] = {}
    for w in (1 << k for k in range(BITMAP_WORDS.bit_length())):
        if w <= BITMAP_WORDS:
            by[w] = np.zeros((len(node), w), np.uint64)
    for w in set(words.tolist()):
        pick = np.flatnonzero(words == w)
        bits = np.frombuffer(b"".join(bitmap[i] for i in pick), np.uint64).reshape(-1, w)
        k = w
        while k:
            by[k][pick] = bits
            bits, k = (bits[:, : k // 2] ^ bits[:, k // 2 :], k // 2) if k > 1 else (bits, 0)
    parent = np.arange(len(names))
    if known is not None:
        _, first, of = np.unique(known[row], return_index=True, return_inverse=True)
        parent = first[of]
    out, left, d = [], np.arange(len(node)), 0
    open_pairs: set[tuple[int, int]] = set()
    while len(left):
        d += 1
        left = left[left + d < len(node)]
        left = left[key[left] == key[left + d]]
        left = left[100 * n[left].astype(np.int64) >= percent * n[left + d].astype(np.int64)]
        if not len(left):
            break
        parent = roots(parent)
        i = left[parent[at[left]] != parent[at[left + d]]]
        total = n[i].astype(np.int64) + n[i + d]
        room = total - 2 * least_overlap(total, percent)
        fewer = np.minimum(words[i], words[i + d])
        for w in np.unique(fewer).tolist():
            q = np.flatnonzero(fewer == w)
            differ = np.bitwise_count(by[w][i[q]] ^ by[w][i[q] + d]).sum(1)
            near = i[q[differ <= room[q]]]
            large = (n[near] > LARGE_SET) if d <= NEAR else np.zeros(len(near), bool)
            open_pairs.update(zip(node[near[large]].tolist(), node[near[large] + d].tolist(), strict=True))
            for k in near[~large].tolist():
                if _join(parent, int(at[k]), int(at[k + d])):
                    out.append((int(node[k]), int(node[k + d]), True))
    return out + [(a, b, False) for a, b in open_pairs]


def full_bitmaps_pass(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """Ends (x, y) of pairs (a, b) of nodes whose full bitmaps allow the threshold.  bits: node, n, bitmap."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches:
            total = part.column("n_a").to_numpy() + part.column("n_b").to_numpy().astype(np.int64)
            room = total - 2 * least_overlap(total, percent)
            keep = []
            for p, q, most in zip(part.column("bits_a").to_pylist(), part.column("bits_b").to_pylist(), room.tolist(), strict=True):
                p, q = np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64)
                w = min(len(p), len(q))
                keep.append(int(np.bitwise_count(folded(p, w) ^ folded(q, w)).sum()) <= most)
            yield part.select(["x", "y"]).filter(pa.array(keep, pa.bool_()))

    at_a = bits.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("bitmap").alias("bits_a"))
    at_b = bits.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("bitmap").alias("bits_b"))
    return pairs.join(at_a, "a").join(at_b, "b").select("x", "y", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "x long, y long")


def candidate_clusters(reps: DataFrame, bits: DataFrame, percent: int, n_docs: int) -> DataFrame:
    """Clusters (node, component) of the classes that may be similar to others; a similar pair is in one cluster.

    reps: node, tokens, parts.  bits: node, n, short, bitmap.
    """
    spark = reps.sparkSession
    passes = min(PASSES, 1 + n_docs // PASS_DOCS)
    ends = [KINDS * k // passes for k in range(passes + 1)]
    found, old = None, None
    for low, high in [(0, 1), *zip(ends[:-1], ends[1:], strict=True)]:
        path = shared_path(spark, "clusters")
        with scratch(spark):
            more = components(candidate_edges(reps, bits, percent, low, high, found), "x", "y")
            found = written(more if found is None else merged(found, more), "clusters", path)
        if old:
            drop_path(spark, old)
        old = path
    return found


def candidate_edges(reps: DataFrame, bits: DataFrame, percent: int, low: int, high: int, found: DataFrame | None) -> DataFrame:
    """Edges (x, y) between clusters of ``found``, where None has each class alone, by keys of the kinds from low to high - 1.

    With the clusters they cover all pairs that may be similar and share such a key, except that without
    ``found`` a common key's rows are dealt over its tiles once, so not all of them meet.
    """
    c = F.col
    keys = F.filter(F.arrays_zip("tokens", "parts"), lambda t: F.pmod(t["tokens"], F.lit(KINDS)).between(low, high - 1))
    rows = reps.select("node", keys.alias("keys")).where(F.size("keys") > 0)
    rows = rows.withColumn("component", c("node")) if found is None else rows.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    rows = rows.select("node", "component", F.explode("keys").alias("t")).select("node", "component", "t.tokens", "t.parts").toDF("node", "component", "token", "parts")
    rows = written(rows, "tokens")
    # exact counts of a key's classes, added up before the shuffle; only keys of several clusters go on,
    # and the rows of a common one, dealt over its parts, fetch its count; written, as the shuffle of
    # all keys then goes before that of all rows comes
    of_key = rows.groupBy("token").agg(F.count("*").alias("met"), F.first("parts").alias("parts"), F.min("component").alias("low"), F.max("component").alias("high"))
    shared = written(of_key.where("low < high").select("token", "met", "parts"), "shared")
    # of a common key's classes those of its largest cluster need not meet each other
    hot = shared.where(c("met") > TILE_ROWS).select("token")
    n_hot = 0 if found is None else hot.count()
    if n_hot:
        each = lookup(rows, hot, n_hot, "token", "node").groupBy("token", "component").agg(F.count("*").alias("part"))
        base = each.groupBy("token").agg(F.max_by("component", F.struct("part", "component")).alias("base"), F.max("part").alias("most"))
        shared = shared.join(written(base, "base"), "token", "left")
    else:
        shared = shared.withColumns({"base": F.lit(None).cast("long"), "most": F.lit(None).cast("long")})
    shares = shared.select("token", "met", "base", "most", F.explode(F.sequence(F.lit(0), c("parts") - 1)).alias("part"))
    part = F.when(c("parts") > 1, F.pmod(F.xxhash64("node", F.lit("part")), c("parts"))).otherwise(0).cast("int")
    met = rows.select("node", "component", "token", part.alias("part")).join(shares, ["token", "part"]).drop("part").join(bits.select("node", "n", "short"), "node")
    if found is None:  # bands of every other key lie half a band apart
        band = F.floor(size_place(c("n"), percent) + F.pmod(F.floor(c("token") / KINDS), F.lit(2)) / 2)
        dealt = F.array(F.xxhash64("token", F.lit("once"), band, F.pmod(F.xxhash64("node", "token"), F.ceil(c("met") / TILE_ROWS))))
    else:
        m_b, m_s = F.ceil(c("most") / TILE_ROWS), F.ceil((c("met") - c("most")) / TILE_ROWS)
        dealt = tiles_across(c("token"), c("component") == c("base"), m_b, m_s, c("n"), c("node"), percent)
    keys = F.when(c("met") <= TILE_ROWS, F.array("token")).otherwise(dealt)
    tiles = met.select("node", "component", "n", "short", F.explode(keys).alias("key")).repartition("key").sortWithinPartitions("key", "n")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "key", 50_000):
            key, node, n, component = (t.column(c).to_numpy() for c in ("key", "node", "n", "component"))
            pairs = connected_pairs(key, node, n, t.column("short").to_pylist(), percent, component)
            a, b, sure = zip(*pairs, strict=True) if pairs else ((), (), ())
            of = dict(zip(node.tolist(), component.tolist(), strict=True)) if pairs else {}
            cols = [a, b, [of[i] for i in a], [of[i] for i in b]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int64()) for x in cols), pa.array(sure, pa.bool_())], ["a", "b", "x", "y", "sure"])

    pairs = tiles.select("key", "node", "n", "short", "component").mapInArrow(run, "a long, b long, x long, y long, sure boolean")
    pairs = written(pairs, "pairs")
    doubtful = pairs.where("NOT sure").select("a", "b", "x", "y").distinct()
    return pairs.where("sure").select("x", "y").unionByName(full_bitmaps_pass(doubtful, bits, percent))


# --- exact decision ----------------------------------------------------------------


def exact_links(
    sets: list[np.ndarray], percent: int, known: list | None = None, block: int = 32, checks: list[np.ndarray] | None = None
) -> list[tuple[int, int]]:
    """Similar pairs of a tile, without those whose ends are connected already; sets are in order of size.

    ``known``: a component of each set from before, or None.  ``checks``: second hashes of the
    elements, which must agree as well, or None.
    """
    n = np.fromiter(map(len, sets), np.int64, len(sets))
    words = max(1, bitmap_words(int(np.median(n)), 256))
    while words > 1 and words * 64 > 4 * n.max():
        words //= 2
    bits = np.stack([parity_bitmap(x, words) for x in sets])
    label = np.arange(len(sets))
    if known:
        first: dict = {}
        label = np.array([i if c is None else first.setdefault(c, i) for i, c in enumerate(known)])
    out = []
    low = np.searchsorted(n, -(-percent * n // 100))  # 100 * smaller >= percent * larger
    for j in range(1, len(sets)):
        lo = int(low[j])
        near = lo + np.flatnonzero(label[lo:j] != label[j])
        if not len(near):
            continue
        total = n[near] + n[j]
        differ = np.bitwise_count(bits[near] ^ bits[j]).sum(1)
        good = differ <= total - 2 * least_overlap(total, percent)
        near, differ = near[good], differ[good]
        near = near[np.argsort(differ, kind="stable")]
        while len(near):
            part, near = near[:block], near[block:]
            flat = np.concatenate([sets[i] for i in part])
            at = np.minimum(np.searchsorted(sets[j], flat), n[j] - 1)
            hit = sets[j][at] == flat
            if checks is not None:
                hit &= checks[j][at] == np.concatenate([checks[i] for i in part])
            ends = np.cumsum(n[part])
            shared = np.diff(np.concatenate([[0], np.cumsum(hit)[ends - 1]]))
            for i in part[(100 + percent) * shared >= percent * (n[part] + n[j])].tolist():
                if label[i] != label[j]:
                    out.append((i, j))
                    a, b = sorted((label[i], label[j]))
                    label[label == b] = a
            near = near[label[near] != label[j]]
    return out


def verified_links(docs: DataFrame, members: DataFrame, words: int, percent: int, salts: int) -> DataFrame:
    """Links (a, b) between digests of similar classes, enough to connect all that are; ``members``: digest, doc_id and tag of one text, n, cluster."""
    c = F.col
    sizes = members.groupBy("cluster").agg(F.sum("n").alias("total"))
    rows = written(salted_lookup(members, sizes, "cluster", "digest", salts=salts).withColumn("m", F.ceil(c("total") / TILE_SHINGLES)), "members")
    place = size_place(c("n"), percent)

    def deal(r: int) -> Column:  # bands lie half a band apart in the two deals
        block = F.pmod(F.xxhash64("digest", F.lit(r)), c("m"))
        return F.xxhash64("cluster", F.lit(r), F.floor(place + r / 2), block)

    once = F.when(c("m") <= 1, F.array("cluster")).otherwise(F.array(deal(0), deal(1)))
    links = tile_links(docs, rows.select("doc_id", "tag", "digest", "n", once.alias("tiles"), F.lit(None).cast("binary").alias("known")), words, percent)
    large = rows.where("m > 1")
    if large.isEmpty():
        return links
    joined = components(links).select(c("node").alias("digest"), "component")
    large = written(large.join(joined, "digest", "left").withColumn("known", F.coalesce("component", "digest")), "large")
    parts = large.groupBy("cluster", "known").agg(F.sum("n").alias("part"))
    base = parts.groupBy("cluster").agg(F.max_by("known", F.struct("part", "known")).alias("base"), F.max("part").alias("most"), F.count("*").alias("parts"))
    rest = salted_lookup(large, base.where("parts > 1"), "cluster", "digest", salts=salts)
    # the largest component's rows (i of m_b blocks) meet the other rows (j of m_s blocks), and those each other
    m_b, m_s = F.ceil(c("most") / TILE_SHINGLES), F.ceil((c("total") - c("most")) / TILE_SHINGLES)
    tiles = tiles_across(c("cluster"), c("known") == c("base"), m_b, m_s, c("n"), c("digest"), percent)
    return links.unionByName(tile_links(docs, rest.select("doc_id", "tag", "digest", "n", tiles.alias("tiles"), "known"), words, percent))


def tile_links(docs: DataFrame, tiled: DataFrame, words: int, percent: int) -> DataFrame:
    """Links inside tiles; ``tiled``: digest, doc_id and tag of one text, n, known, tiles (array of keys).

    Texts that go to many tiles do so in turns, in each of which about as much is shuffled as all these texts are.
    """
    tiled = written(tiled, "tiled")
    sums = tiled.agg(F.sum("n"), F.sum(F.col("n") * F.size("tiles"))).first()
    turns = max(1, round(sums[1] / sums[0])) if sums[0] else 1
    texts = docs.select(F.col("doc_id").cast("long").alias("_doc"), F.col("tag").alias("_tag"), "text")
    met = F.col("_doc").eqNullSafe(F.col("doc_id")) & (F.col("_tag") == F.col("tag"))

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for part in batches:
            # repeated rows, same id and text, come one after the other from the merge join
            given = part.column("digest").to_pylist()
            yield part.filter(pa.array([d != before for d, before in zip(given, [last, *given], strict=False)], pa.bool_()))
            last = given[-1] if given else last

    def links(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups_of(batches, "tile", 1):
            key = t.column("tile").to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])).tolist()
            digest, known = (t.column(c).to_pylist() for c in ("digest", "known"))
            sets, checks = [], []
            for part in slices(t.to_batches(), max_bytes=SLICE):
                sets += shingle_sets(texts_of(part), words, checks)
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                at = [i for i in range(a, b) if (i == a or digest[i] != digest[i - 1]) and set_digest(sets[i], checks[i]) == digest[i]]
                pairs = exact_links([sets[i] for i in at], percent, [known[i] for i in at], checks=[checks[i] for i in at]) if len(at) > 1 else []
                yield pa.RecordBatch.from_arrays(
                    [pa.array([digest[at[i]] for i, _ in pairs], pa.binary()), pa.array([digest[at[j]] for _, j in pairs], pa.binary())], ["a", "b"]
                )

    out = []
    for turn in range(turns):
        own = F.filter("tiles", lambda t: F.pmod(F.xxhash64(t, F.lit("turn")), F.lit(turns)) == F.lit(turn))  # noqa: B023
        part = tiled.withColumn("tiles", own).where(F.size("tiles") > 0)
        rows = texts.join(part.hint("merge"), met).select("digest", "text", "n", "tiles", "known")
        rows = rows.mapInArrow(once, "digest binary, text string, n int, tiles array<long>, known binary")
        rows = rows.select(F.explode("tiles").alias("tile"), "n", "digest", "known", "text")
        out.append(written(rows.repartition("tile").sortWithinPartitions("tile", "n", "digest").mapInArrow(links, "a binary, b binary"), "links"))
    return reduce(DataFrame.unionByName, out)


def linked_classes(docs: DataFrame, words: int, percent: int) -> tuple[DataFrame, DataFrame, int]:
    """Signed documents; per class with shingles: digest, component (a digest that names it), least doc_id of it; and salts.

    ``docs``: doc_id long, text, tag (``text_tag``), by which texts of one id, or of none, are told apart.
    """
    n_docs = docs.count()
    salts = salts_for(n_docs)
    slots = 1 << min(22, max(16, (4 * n_docs).bit_length()))
    over = excess(count_sketch(docs, words, slots))
    spark = docs.sparkSession
    wide_path, reps_path = shared_path(spark, "signatures"), shared_path(spark, "reps")
    wide = written(signatures(docs, words, percent, over, n_docs), "signatures", wide_path)
    first_bytes = F.conv(F.substring(F.hex("digest"), 1, 15), 16, 10).cast("long")
    of = wide.where("n > 0").groupBy("digest")
    least_row = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag")).alias("of")
    classes = of.agg(least_row, *(F.first(c).alias(c) for c in ("n", "short", "bitmap")))
    classes = written(classes.select("digest", "of.doc_id", "of.tag", "n", "short", "bitmap", first_bytes.alias("node")), "classes")
    reps = of.agg(*(F.first(c).alias(c) for c in ("tokens", "parts"))).select(first_bytes.alias("node"), "tokens", "parts")
    reps = written(reps, "reps", reps_path)
    signed = written(wide.select("doc_id", "tag", "n", "digest"), "signed")
    drop_path(spark, wide_path)
    clusters = candidate_clusters(reps, classes.select("node", "n", "short", "bitmap"), percent, n_docs)
    drop_path(spark, reps_path)
    members = written(
        classes.join(clusters, "node").select("digest", "doc_id", "tag", "n", F.col("component").alias("cluster")), "members"
    )
    linked = components(verified_links(docs, members, words, percent, salts))
    linked = written(linked.select(F.col("node").alias("digest"), "component"), "linked")
    least = classes.select("digest", "doc_id").join(linked, "digest").groupBy("component").agg(F.min("doc_id").alias("least"))
    found = salted_lookup(linked, least, "component", "digest", salts=salts).select("digest", "component", "least")
    of_class = classes.select("digest", F.col("doc_id").alias("own")).join(found, "digest", "left")
    return signed, of_class.select("digest", F.coalesce("component", "digest").alias("component"), F.coalesce("least", "own").alias("least")), salts


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable by links) of every document.

    Null text and text without words have no shingle and are linked with nothing; their
    component is their own doc_id.  Equal sets are linked.  A null doc_id counts as larger than
    any other, so it names a component only alone; repeated rows give a row each; an empty table none;
    only doc_id and text are read.
    """
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_tag().alias("tag"))
    signed, of_class, salts = linked_classes(narrow, words, percent)
    some = signed.where("n > 0").select("doc_id", "n", "digest")
    rows = salted_lookup(some, of_class.select("digest", F.col("least").alias("component_id")), "digest", "doc_id", salts=salts)
    rest = signed.where("n = 0").select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return rows.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id").unionByName(rest)


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of ``docs`` for each component, that with the smallest doc_id, with all its columns.

    A null doc_id counts as larger than any other; rows of a component that share its smallest
    doc_id are told apart by their texts' digests, and of rows that repeat id and text one is taken.
    Texts without words, null ones too, are linked with nothing and all stay; an empty table gives
    no rows; columns of any name are kept as they are.
    """
    spark = docs.sparkSession
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", text_tag().alias("tag"))
    path = shared_path(spark, "keep")
    with scratch(spark):  # signatures and the like go before the documents' texts are shuffled
        signed, of_class, salts = linked_classes(narrow, words, percent)
        some = signed.where("n > 0").select("doc_id", "tag", "digest").withColumn("by", F.xxhash64("doc_id", "tag"))
        met = salted_lookup(some, of_class.select("digest", "component"), "digest", "by", salts=salts)
        rows = met.groupBy("component", "doc_id", "tag").agg(F.count("*").alias("n"))
        order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tag", "n")
        best = rows.groupBy("component").agg(F.min(order).alias("best")).select("best.doc_id", "best.tag", "best.n")
        bare = signed.where("n = 0").select("doc_id", "tag", F.lit(1).cast("long").alias("n"))
        keep = written(best.unionByName(bare), "keep", path)
    return take_rows(docs, keep)
