"""BLAKE3 against the published test vectors and a plain implementation."""

import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from ravelin.functions import blake3 as B

#: The input of the published vectors is 0, 1, ... 250, 0, 1, ...
INPUT = bytes(i % 251 for i in range(10_000))
#: The first bytes of published hashes by length of input.
HASHES = {0: "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", 1: "2d3adedff11b61f14c886e35afa036736dcd87a74d27b5c1510225d0f592e213", 1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7", 1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444", 2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a", 2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030"}


def plain(data, key=tuple(B.IV.tolist()), mode=0):
    """One text, by the book."""
    turn = lambda x, n: (x >> n | x << (32 - n)) & 0xFFFFFFFF

    def compress(cv, block, counter, flags):
        m = list(struct.unpack("<16I", block.ljust(64, b"\0")))
        v = [*cv, *B.IV[:4].tolist(), counter & 0xFFFFFFFF, counter >> 32, len(block), flags]
        for _ in range(7):
            for a, b, c, d, k in ((0, 4, 8, 12, 0), (1, 5, 9, 13, 2), (2, 6, 10, 14, 4), (3, 7, 11, 15, 6), (0, 5, 10, 15, 8), (1, 6, 11, 12, 10), (2, 7, 8, 13, 12), (3, 4, 9, 14, 14)):
                for x, p, q in ((m[k], 16, 12), (m[k + 1], 8, 7)):
                    v[a] = (v[a] + v[b] + x) & 0xFFFFFFFF
                    v[d] = turn(v[d] ^ v[a], p)
                    v[c] = (v[c] + v[d]) & 0xFFFFFFFF
                    v[b] = turn(v[b] ^ v[c], q)
            m = [m[k] for k in B.PERMUTATION]
        return tuple(v[i] ^ v[i + 8] for i in range(8))

    def tree(part, counter, root):
        if len(part) <= 1024:
            cv, blocks = key, [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
            for i, block in enumerate(blocks):
                end = i == len(blocks) - 1
                cv = compress(cv, block, counter, mode | (i == 0) | 2 * end | 8 * (end and root))
            return cv
        half = 1024
        while half * 2 < len(part):
            half *= 2
        both = tree(part[:half], counter, False) + tree(part[half:], counter + half // 1024, False)
        return compress(key, struct.pack("<16I", *both), 0, mode | 4 | 8 * root)

    return struct.pack("<8I", *tree(data, 0, True))


@pytest.mark.parametrize("n", sorted(HASHES))
def test_published_vectors(n):
    assert plain(INPUT[:n]).hex() == HASHES[n]
    assert B.digests([INPUT[:n]]).astype("<u4").tobytes().hex() == HASHES[n]


def test_many_texts_at_once():
    rng = random.Random(1)
    texts = [INPUT[: rng.choice([0, 1, 63, 64, 65, 1023, 1024, 1025, 3000, 5120, 7169, 9999])] for _ in range(60)]
    assert [x.astype("<u4").tobytes() for x in B.digests(texts)] == [plain(t) for t in texts]
    key = tuple(np.frombuffer(plain(b"a context", mode=32), "<u4").tolist())
    assert B.derived(texts, "a context", 32) == [plain(t, key, 64) for t in texts] and B.derived([], "x") == []


def test_identities_of_records(spark):
    rows = [("zeek", "é record"), ("s", ""), (None, "x"), ("s", None), ("long", "y" * 5000)]
    got = [r.i for r in spark.createDataFrame(rows, "source string, raw string").select(B.identity("ctx", F.col("source"), F.col("raw")).alias("i")).collect()]
    want = [None if a is None or b is None else B.derived([struct.pack("<Q", len(a)) + a.encode() + b.encode()], "ctx")[0].hex() for a, b in rows]
    assert got == want and len(got[0]) == 32
