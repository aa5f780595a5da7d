"""Near-duplicate detection by SimHash fingerprints and distances to reference
fingerprints (pivots).

Two operators. ``near_duplicates`` links 64-bit fingerprints that differ in at
most three bits, exactly. ``similar_texts`` links texts by an estimated
similarity of their 5-word shingles, 0.8 or more by default.

``near_duplicates``: fingerprints that differ in at most three of 64 bits agree
in full on at least one of four 16-bit blocks. For each block a table holds the
Hamming distances of the block's value to the same block of many reference
fingerprints (the pivots); equal rows of that table are the join key, so every
pair to be found meets in some bucket. A bucket is ordered by the distance to
the first pivot, and only neighbours in that order whose distances differ by
at most the radius make a pair; a pair is discarded as soon as one of the other
coordinates, the distances to the whole pivots, differs by more (the triangle
inequality), and survivors are verified bit by bit. A bucket above
``MAX_BUCKET`` is split exactly: its members agree on the key's block, so the
three differing bits lie in the rest, which is cut into four blocks again, down
to 52 agreeing bits, of which there are at most 4096 different fingerprints.

``similar_texts``: a wide fingerprint of 256 bits, of the set of 5-word
shingles, estimates the similarity: sets of Jaccard similarity J have the cosine
2J / (1 + J), and differ in each bit with the probability angle / pi. Links are
of fingerprints within the radius that stands for ``similarity``; the standard
error is 6 bits, 0.03 in J there. Candidates agree on one of several blocks of a
second fingerprint, of 3-word shingles, which near copies change less. Blocks
have as many bits as the number of texts asks for to keep a bucket small, and
there are so many that ``RECALL`` of the pairs at the limit share one, at
``BLOCK_NOISE`` differing bits: closer pairs are hardly ever missed. As above, the
join key is a block's row in the pivot distance table, so equal blocks meet (and
hardly any other), a bucket is ordered by the distance to the first pivot, and
survivors of the pivots are verified bit by bit. At this radius the distances of
whole fingerprints to a pivot tell little, so a pivot's coordinate has a part for
each 16-bit block: the sum of the parts' differences is no more than the number
of differing bits (the triangle inequality in each block), and a pair is
discarded if the largest such sum is above the radius. In a long bucket members
become pivots in turn: what lies within the radius of one is linked to it, and by
the triangle inequality only rows within twice the radius have to be compared
with those.

Scale: one row per *distinct* fingerprint is keyed, copies collapse before
(``min`` combines map-side): 4 rows a text in one operator; in the other, 16 at
5 10^4 texts, 39 at 1.5 10^7 and 115 at 10^10, which is what finding pairs this far
apart by SimHash costs. A bucket emits a spanning forest, never all
of its pairs. Components come from alternating star contraction over written
tables.

Defined results: a text that is null, empty or blank has fingerprint zero and
is linked like any other; rows with a null id keep their fingerprint, take the
component of equal or near fingerprints with an id (null if there is none) and
never name a component; repeated rows and ids give repeated result rows; an
empty table gives an empty result. Other columns of the input are ignored, and
kept by ``stage``, whatever their names.
"""

from __future__ import annotations

import math
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import free_name, materialize, shuffle_parts, table, text_bytes

RADIUS = 3
SEED = 42
SHINGLE = 3
PIVOTS = 16
MAX_BUCKET = 4096
#: Bits that a bucket's key fixes at each level of splitting.
LEVELS = (16, 12, 9, 6, 5, 4)

_PIVOT = np.random.default_rng(20_240_607).integers(0, 2**64, PIVOTS, dtype=np.uint64)


def fingerprint(data: bytes) -> int:
    """The unsigned 64-bit SimHash of a UTF-8 text."""
    import xxhash

    words = data.lower().split()  # bytes: A-Z only, and exactly the six ASCII blanks
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles, n = iter([b" ".join(words)]), 1
    else:
        shingles, n = map(b" ".join, zip(words, words[1:], words[2:], strict=False)), len(words) - 2
    h = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = h[at : at + (1 << 16)]
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def _fingerprints(batches):
    for rb in batches:
        fps = np.fromiter((fingerprint(x) for x in rb.column(1).to_pylist()), np.uint64, rb.num_rows)
        yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp): one row per row of ``docs``; fp is the signed 64-bit word."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"))
    return slim.mapInArrow(_fingerprints, "doc_id long, fp long")


def _blocks(fixed: tuple[int, ...], level: int) -> list[tuple[int, ...]]:
    """Cut the bits outside ``fixed`` into four blocks (the last takes the rest)."""
    free, n = [b for b in range(64) if b not in fixed], LEVELS[level]
    return [tuple(free[i * n : (i + 1) * n if i < 3 else len(free)]) for i in range(4)]


def _mask(bits) -> np.uint64:
    return np.uint64(sum(1 << b for b in bits))


def block_code(fp: np.ndarray, bits: tuple[int, ...]) -> np.ndarray:
    """The row of the pivot distance table for these bits, as one number: the
    distances to the pivots within the block, in base 17 (a block has at most
    16 bits, and 15 digits fit in 64 bits)."""
    mask, code = _mask(bits), np.zeros(len(fp), np.uint64)
    for p in _PIVOT[:15]:
        code = code * np.uint64(17) + np.bitwise_count((fp ^ p) & mask).astype(np.uint64)
    return code


def _keys(level: int):
    def run(batches):
        for rb in batches:
            fp = rb.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            rep, old = rb.column(1), rb.column(2).to_numpy(zero_copy_only=False)
            path = rb.column(3).to_numpy(zero_copy_only=False)
            for way in np.unique(path):
                at = np.flatnonzero(path == way)
                fixed: tuple[int, ...] = ()
                for depth in range(level):  # way: base-4 digits of the blocks taken so far, after a leading 1
                    fixed += _blocks(fixed, depth)[(int(way) >> (2 * (level - 1 - depth))) & 3]
                for i, bits in enumerate(_blocks(fixed, level)):
                    code = block_code(fp[at], bits)
                    key = (old[at].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ code) * np.uint64(0xD6E8FEB86659FD93)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(fp[at].view(np.int64)), rep.take(pa.array(at)), pa.array(key.view(np.int64)), pa.array(np.full(len(at), int(way) * 4 + i, np.int64))],
                        ["fp", "rep", "key", "way"],
                    )

    return run


KEYED = "fp long, rep long, key long, way long"


def _distances(fp: np.ndarray) -> np.ndarray:
    """The pivot distance table of whole fingerprints."""
    return np.bitwise_count(fp[:, None] ^ _PIVOT[None, :]).astype(np.int8)


def _find(parent: dict, x: int) -> int:
    while parent.get(x, x) != x:
        parent[x] = parent.get(parent[x], parent[x])
        x = parent[x]
    return x


def _forest(keys: np.ndarray, fp: np.ndarray, rep: np.ndarray) -> tuple[list[int], list[int]]:
    """Links within runs of equal keys, as a spanning forest of each run."""
    left, right = [], []
    n = len(keys)
    if n < 2 or not (keys[1:] == keys[:-1]).any():
        return left, right
    table_ = _distances(fp)
    order = np.lexsort((table_[:, 0], keys))
    keys, fp, rep, table_ = keys[order], fp[order], rep[order], table_[order]
    label, parent = np.arange(n), {}
    alive = np.arange(n - 1)
    lag = 0
    while len(alive):  # neighbours in the order of the first coordinate, until it differs by more than the radius
        lag += 1
        alive = alive[alive + lag < n]
        alive = alive[keys[alive] == keys[alive + lag]]
        alive = alive[table_[alive + lag, 0] - table_[alive, 0] <= RADIUS]
        i = alive[label[alive] != label[alive + lag]]
        for k in range(1, PIVOTS):  # discard by the largest coordinate difference
            if not len(i):
                break
            i = i[np.abs(table_[i, k] - table_[i + lag, k]) <= RADIUS]
        i = i[np.bitwise_count(fp[i] ^ fp[i + lag]) <= RADIUS]  # verify
        if len(i):
            for a, b in zip(i.tolist(), (i + lag).tolist(), strict=True):
                x, y = _find(parent, a), _find(parent, b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    left.append(int(rep[a]))
                    right.append(int(rep[b]))
            touched = np.fromiter(parent, np.int64, len(parent))
            label[touched] = [_find(parent, int(x)) for x in touched]
    return left, right


def _links(batches):
    """Rows come sorted by (way, key); the last run of a batch is carried on."""
    rest = None
    names = ["way", "key", "fp", "rep"]

    def out(cols):
        code = cols["key"].view(np.uint64) ^ (cols["way"].view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        a, b = _forest(code, cols["fp"].view(np.uint64), cols["rep"])
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b).astype(np.int64)), pa.array(np.maximum(a, b).astype(np.int64))], ["a", "b"])

    for rb in batches:
        cols = {x: rb.column(x).to_numpy(zero_copy_only=False) for x in names}
        if rest is not None:
            cols = {x: np.concatenate([rest[x], cols[x]]) for x in names}
        n = len(cols["key"])
        if not n:
            continue
        last = int(np.flatnonzero((cols["key"] != cols["key"][-1]) | (cols["way"] != cols["way"][-1]))[-1]) + 1 if np.any((cols["key"] != cols["key"][-1]) | (cols["way"] != cols["way"][-1])) else 0
        rest = {x: cols[x][last:] for x in names}
        if last:
            yield out({x: cols[x][:last] for x in names})
    if rest is not None:
        yield out(rest)


def links(distinct: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(a, b): links that connect the same fingerprints as all pairs within the
    radius do. ``distinct`` has (fp, rep), one row per fingerprint."""
    start = distinct.select("fp", "rep", F.lit(0).cast("long").alias("key"), F.lit(1).cast("long").alias("way"))
    found, level = None, 0
    keyed = start.mapInArrow(_keys(0), KEYED)
    while True:
        hot = None
        if level < len(LEVELS) - 1:  # beyond, a bucket fixes 52 bits and has at most 4096 members
            keyed = materialize(keyed, "keys") if level == 0 else keyed
            hot = keyed.groupBy("way", "key").count().filter(F.col("count") > max_bucket).select("way", "key")
            hot = materialize(hot, "hot")
            hot = None if hot.isEmpty() else hot
        cold = keyed if hot is None else keyed.join(hot, ["way", "key"], "left_anti")
        runs = cold.select("way", "key", "fp", "rep").repartition("way", "key").sortWithinPartitions("way", "key", "fp")
        part = runs.mapInArrow(_links, "a long, b long")
        found = part if found is None else found.unionByName(part)
        if hot is None:
            return found
        level += 1
        keyed = materialize(keyed.join(hot, ["way", "key"], "left_semi").select("fp", "rep", "key", "way").mapInArrow(_keys(level), KEYED), "keys")


#: Rows that a round's files have, where there are so many: a round of few edges writes few files.
EDGES_A_FILE = 100_000


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): the smallest node reachable from each node of
    ``edges`` (a, b), by alternating large-star and small-star contraction."""
    now = materialize(edges.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if now.isEmpty():
        return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
    mark = lambda df: df.agg(F.count("*"), F.bit_xor(F.xxhash64("a", "b")), F.bit_xor(F.xxhash64(F.lit(1), "b", "a"))).first()
    seen = mark(now)
    tasks = shuffle_parts(now.sparkSession)
    for _ in range(rounds):
        both = now.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(now.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = both.join(least, "u").filter("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).filter("a <> b").distinct()
        least = big.groupBy("b").agg(F.min("a").alias("m"))
        small = big.join(least, "b")
        now = materialize(
            small.select(F.least("a", "m").alias("a"), F.greatest("a", "m").alias("b")).unionByName(small.select(F.col("m").alias("a"), "b")).filter("a <> b").distinct().coalesce(min(tasks, 1 + seen[0] // EDGES_A_FILE)),
            "edges",
        )
        after = mark(now)
        if after == seen:
            return now.select(F.col("b").alias("node"), F.col("a").alias("component"))
        seen = after
    raise RuntimeError("components did not settle")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of ``docs``."""
    fps = materialize(fingerprints(docs, id_col, text_col), "fps")
    distinct = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    comp = components(links(distinct.select("fp", F.col("fp").alias("rep"))))  # nodes are fingerprints, as ids may be null
    grouped = distinct.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    grouped = materialize(grouped, "grouped")
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("component_id")), "component").select("fp", "component_id")
    return fps.join(named, "fp", "left").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


# Texts by similarity

#: Bits of the fingerprint that estimates the similarity, and the words of its shingles.
WIDE = 256
SIMILARITY, WORDS = 0.8, 5
#: The share of pairs at the limit that share a block, the share of differing bits there, and the words of the blocks' shingles.
RECALL, BLOCK_NOISE, BLOCK_WORDS = 0.96, 0.10, 3
#: Buckets up to this length are compared by the table of the pivots, longer ones by pivots of their own.
SHORT = 64

_WIDE_PIVOT = np.random.default_rng(20_240_608).integers(0, 2**64, (PIVOTS, WIDE // 64), dtype=np.uint64)


def radius_of(similarity: float, bits: int = WIDE) -> int:
    """Differing bits that stand for a Jaccard similarity of sets."""
    return int(bits * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def block_plan(texts: int) -> tuple[int, int]:
    """(bits of a block, number of blocks) for so many different texts."""
    bits = max(16, math.ceil(math.log2(max(2, texts))))
    return bits, math.ceil(math.log(1 - RECALL) / math.log(1 - (1 - BLOCK_NOISE) ** bits))


def _shingles(words: list[bytes], n: int) -> np.ndarray:
    """Hashes of the distinct shingles of n words (fewer words: all of them)."""
    import xxhash

    if not words:
        return np.zeros(0, np.uint64)
    made = {b" ".join(words)} if len(words) < n else set(map(b" ".join, zip(*(words[k:] for k in range(n)), strict=False)))
    return np.fromiter(map(xxhash.xxh64_intdigest, made, repeat(SEED)), np.uint64, len(made))


def majority(hashes: np.ndarray, words: int) -> np.ndarray:
    """A SimHash of 64 bits a word: each hash is spread over all words."""
    counts = np.zeros(64 * words, np.int64)
    salt = np.arange(1, words + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for at in range(0, len(hashes), 255):
        x = hashes[at : at + 255, None] ^ salt
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        x ^= x >> np.uint64(31)
        counts += np.add.reduce(np.unpackbits(x.view(np.uint8), axis=1, bitorder="little"), axis=0, dtype=np.uint8)  # at most 255 ones
    return np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")


def wide_print(data: bytes, bits: int, blocks: int) -> tuple[bytes, list[int]]:
    """The wide fingerprint of a text, and its blocks as numbers."""
    words = data.lower().split()
    wide = majority(_shingles(words, WORDS), WIDE // 64)
    near = majority(_shingles(words, BLOCK_WORDS), -(-bits * blocks // 64))
    cut = np.unpackbits(near.view(np.uint8), bitorder="little")[: bits * blocks].reshape(blocks, bits)
    return wide.tobytes(), (cut.astype(np.int64) << np.arange(bits)).sum(axis=1).tolist()


def table_codes(blocks: np.ndarray, bits: int) -> np.ndarray:
    """The rows of the pivot distance table of blocks of so many bits, each as
    one number: the distances to the pivots within the block."""
    code = np.zeros(blocks.shape, np.uint64)
    for p in _PIVOT:
        code = code * np.uint64(0x9E3779B97F4A7C15) + np.bitwise_count((blocks ^ p) & _mask(range(bits)))
    return code


def _wide_prints(bits: int, blocks: int):
    def run(batches):
        for rb in batches:
            found = [wide_print(x, bits, blocks) for s in range(0, rb.num_rows, 500) for x in rb.column(1).slice(s, 500).to_pylist()]
            codes = table_codes(np.array([b for _, b in found], np.int64).reshape(-1, blocks).view(np.uint64), bits).view(np.int64)
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * np.int32(blocks), pa.array(codes.ravel()))
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(2), pa.array([w for w, _ in found], pa.binary()), lists], ["doc_id", "h", "wide", "blocks"])

    return run


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int32)


def wide_distances(wide: np.ndarray) -> np.ndarray:
    """The pivot distance table of wide fingerprints: of each pivot the distances
    within each block of 16 bits, whose sum is the whole distance."""
    return np.bitwise_count((wide[:, None, :] ^ _WIDE_PIVOT[None, :, :]).view(np.uint16)).view(np.int8)


def _near(key: np.ndarray, wide: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within runs of equal keys, as a spanning forest of each run."""
    out: list[tuple[int, int]] = []
    first = np.bitwise_count(wide ^ _WIDE_PIVOT[0]).sum(axis=1, dtype=np.int32)
    order = np.lexsort((first, key))
    key, wide, first = key[order], wide[order], first[order]
    table_ = wide_distances(wide)
    n, lag, label, parent = len(key), 0, np.arange(len(key)), {}
    alive = np.arange(n)
    while len(alive):  # neighbours in the order of the first pivot, until their distances differ by more than the radius
        lag += 1
        alive = alive[alive + lag < n]
        alive = alive[key[alive] == key[alive + lag]]
        alive = alive[first[alive + lag] - first[alive] <= radius]
        i = alive[label[alive] != label[alive + lag]]
        for k in range(PIVOTS):  # discard by the largest coordinate difference
            if not len(i):
                break
            i = i[np.abs(table_[i, k] - table_[i + lag, k]).sum(axis=1, dtype=np.int32) <= radius]
        i = i[_apart(wide[i], wide[i + lag]) <= radius]  # verify
        if len(i):
            for a, b in zip(i.tolist(), (i + lag).tolist(), strict=True):
                x, y = _find(parent, a), _find(parent, b)
                if x != y:
                    parent[max(x, y)] = min(x, y)
                    out.append((int(order[a]), int(order[b])))
            touched = np.fromiter(parent, np.int64, len(parent))
            label[touched] = [_find(parent, int(x)) for x in touched]
    return out


def _pivoted(wide: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect all pairs within the radius: rows become pivots in
    turn, until none is left."""
    out, left = [], np.arange(len(wide))
    while len(left) > 1:
        pivot = left[0]
        d = _apart(wide[left], wide[pivot])
        near, rim = left[d <= radius], left[(d > radius) & (d <= 2 * radius)]
        out += [(int(pivot), int(x)) for x in near if x != pivot]
        for y in rim.tolist():  # no farther row is within the radius of a near one
            for s in range(0, len(near), 1 << 16):
                hit = np.flatnonzero(_apart(wide[near[s : s + (1 << 16)]], wide[y]) <= radius)
                if len(hit):
                    out.append((int(near[s + hit[0]]), y))
                    break
        left = left[d > radius]
    return out


def wide_links(key: np.ndarray, wide: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links within runs of equal keys, by the rows' places."""
    n, out = len(key), []
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    sizes = np.diff(np.r_[starts, n])
    for a, size in zip(starts[sizes > SHORT].tolist(), sizes[sizes > SHORT].tolist(), strict=True):
        out += [(a + x, a + y) for x, y in _pivoted(wide[a : a + size], radius)]
    short = np.flatnonzero(np.repeat((sizes > 1) & (sizes <= SHORT), sizes))
    out += [(int(short[x]), int(short[y])) for x, y in _near(key[short], wide[short], radius)]
    return out


def _wide_links(radius: int):
    def run(batches):
        """Rows come sorted by (no, value); the last run of a batch is carried on."""
        rest = None
        for rb in batches:
            t = pa.Table.from_batches([rb])
            t = pa.concat_tables([rest, t]) if rest is not None else t
            if not t.num_rows:
                continue
            cols = [t.column(x).to_numpy() for x in ("no", "value")]
            key = np.cumsum(np.r_[False, (cols[0][1:] != cols[0][:-1]) | (cols[1][1:] != cols[1][:-1])])
            last = int(np.searchsorted(key, key[-1]))
            rest = t.slice(last)
            yield from out(t.slice(0, last), key[:last])
        if rest is not None:
            yield from out(rest, np.zeros(rest.num_rows, np.int64))

    def out(t, key):
        if t.num_rows > 1:
            wide = np.frombuffer(b"".join(t.column("wide").to_pylist()), np.uint64).reshape(-1, WIDE // 64)
            found = wide_links(key, wide, radius)
            nodes = t.column("node").combine_chunks()
            a, b = (nodes.take(pa.array([x[k] for x in found], pa.int64())) for k in (0, 1))
            yield pa.RecordBatch.from_arrays([a, b], ["a", "b"])

    return run


def similar_texts(docs: DataFrame, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, least_id, least_h) for every row of ``docs``: the hash of its
    text, and of its group the row with the smallest id and then hash. Different
    fingerprints are told apart by 64 bits of a hash."""
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"))
    texts = texts.withColumn("h", F.xxhash64("b"))
    bits, blocks = block_plan(docs.count())
    prints = materialize(texts.select("doc_id", "b", "h").mapInArrow(_wide_prints(bits, blocks), "doc_id long, h long, wide binary, blocks array<long>").withColumn("node", F.xxhash64("wide", "blocks")), "prints")
    distinct = prints.groupBy("node").agg(F.first("wide").alias("wide"), F.first("blocks").alias("blocks"), F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "h"))).alias("least"))
    distinct = materialize(distinct, "distinct")
    keyed = distinct.select("node", "wide", F.posexplode("blocks").alias("no", "value"))
    runs = keyed.repartition("no", "value").sortWithinPartitions("no", "value", "node")
    comp = components(runs.select("no", "value", "wide", "node").mapInArrow(_wide_links(radius_of(similarity)), "a long, b long"))
    grouped = distinct.select("node", "least").join(comp, "node", "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    grouped = materialize(grouped, "grouped")
    named = grouped.join(grouped.groupBy("component").agg(F.min("least").alias("of")), "component").select("node", F.col("of.doc_id").alias("least_id"), F.col("of.h").alias("least_h"))
    return prints.select("doc_id", "h", "node").join(named, "node", "left").select("doc_id", "h", "least_id", "least_h")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of similar texts: the one with the
    smallest id (of several texts of that id, the one with the least hash; of
    equal rows any). Rows without an id are no group's choice and stay."""
    del spark, sf_dir
    own = free_name(docs, "row")
    keep = similar_texts(docs).filter("doc_id = least_id and h = least_h").select(F.col("doc_id").alias(f"{own}1"), F.col("h").alias(f"{own}2")).distinct()
    rows = docs.withColumn(f"{own}1", F.col("doc_id").cast("long")).withColumn(f"{own}2", F.xxhash64(text_bytes("text")))
    kept = rows.join(keep, [f"{own}1", f"{own}2"], "left_semi").dropDuplicates([f"{own}1", f"{own}2"])
    return kept.unionByName(rows.filter(F.col(f"{own}1").isNull())).select([F.col(f"`{c}`") for c in docs.columns])
