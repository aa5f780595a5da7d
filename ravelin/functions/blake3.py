"""BLAKE3 of many texts at once, in numpy: identities that other systems make
with a derived key can be made here too. The hash's constants are fixed values
of its public specification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT, KEY_CONTEXT, KEY_MATERIAL = 1, 2, 4, 8, 32, 64
CHUNK, BLOCK = 1024, 64


def _turn(x: np.ndarray, n: int) -> np.ndarray:
    return x >> np.uint32(n) | x << np.uint32(32 - n)


def _mix(v: list[np.ndarray], a: int, b: int, c: int, d: int, x: np.ndarray, y: np.ndarray) -> None:
    for m, first, second in ((x, 16, 12), (y, 8, 7)):
        v[a] = v[a] + v[b] + m
        v[d] = _turn(v[d] ^ v[a], first)
        v[c] = v[c] + v[d]
        v[b] = _turn(v[b] ^ v[c], second)


def _compress(key: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """The chaining values of rows: keys (n, 8) and blocks (n, 16)."""
    n = len(words)
    v = [*key.T, *(np.full(n, x) for x in IV[:4]), (counter & 0xFFFFFFFF).astype(np.uint32), (counter >> 32).astype(np.uint32), length.astype(np.uint32), flags.astype(np.uint32)]
    m = list(words.T)
    for turn in range(7):
        if turn:
            m = [m[k] for k in PERMUTATION]
        for k in range(4):
            _mix(v, k, 4 + k, 8 + k, 12 + k, m[2 * k], m[2 * k + 1])
        for k in range(4):
            _mix(v, k, 4 + (k + 1) % 4, 8 + (k + 2) % 4, 12 + (k + 3) % 4, m[8 + 2 * k], m[9 + 2 * k])
    return np.stack([v[k] ^ v[k + 8] for k in range(8)], axis=1)


def digests(texts: list[bytes], key: np.ndarray = IV, mode: int = 0) -> np.ndarray:
    """(n, 8) words of 32-byte hashes, all texts together."""
    chunks = np.array([max(1, -(-len(t) // CHUNK)) for t in texts], np.int64)
    owner = np.repeat(np.arange(len(texts)), chunks)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
    sizes = np.minimum(CHUNK, np.array([len(t) for t in texts], np.int64)[owner] - place * CHUNK)
    data = np.zeros((len(owner), CHUNK), np.uint8)
    for i, (t, p) in enumerate(zip(owner.tolist(), place.tolist(), strict=True)):
        part = texts[t][p * CHUNK : (p + 1) * CHUNK]
        data[i, : len(part)] = np.frombuffer(part, np.uint8)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    alone = chunks[owner] == 1
    value = np.repeat(key[None, :], len(owner), axis=0)
    for b in range(int(blocks.max(initial=0))):
        live = np.flatnonzero(blocks > b)
        last = blocks[live] == b + 1
        flags = mode | CHUNK_START * (b == 0) | np.where(last, CHUNK_END, 0) | np.where(last & alone[live], ROOT, 0)
        words = np.ascontiguousarray(data[live, b * BLOCK : (b + 1) * BLOCK]).view("<u4")
        value[live] = _compress(value[live], words, place[live], np.minimum(BLOCK, sizes[live] - b * BLOCK), flags)
    while len(owner) > len(texts):  # neighbours join; the last of an odd number waits
        place = np.arange(len(owner)) - np.searchsorted(owner, owner)
        count = np.bincount(owner, minlength=len(texts))[owner]
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < count))
        words = np.concatenate([value[left], value[left + 1]], axis=1)
        zero = np.zeros(len(left), np.int64)
        value[left] = _compress(np.repeat(key[None, :], len(left), axis=0), words, zero, zero + BLOCK, mode | PARENT | np.where(count[left] == 2, ROOT, 0))
        keep = np.ones(len(owner), bool)
        keep[left + 1] = False
        owner, value = owner[keep], value[keep]
    return value


@lru_cache(maxsize=16)
def derived_key(context: str) -> np.ndarray:
    """The key that a context gives."""
    return digests([context.encode()], IV, KEY_CONTEXT)[0]


def derived(texts: list[bytes], context: str, size: int = 16) -> list[bytes]:
    """The first ``size`` bytes (up to 32) of each text's keyed hash."""
    if not texts:
        return []
    found = np.ascontiguousarray(digests(texts, derived_key(context), KEY_MATERIAL).astype("<u4"))
    return [row.tobytes()[:size] for row in found]


def identity(context: str, prefix: Column, rest: Column) -> Column:
    """32 hex digits of the keyed hash of ``prefix``'s length (8 bytes, the
    least first), ``prefix`` and ``rest``, in UTF-8; null if one is null."""

    @F.arrow_udf("string")
    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            rows = values.to_pylist()
            out: list[str | None] = [None] * len(rows)
            good = [i for i, r in enumerate(rows) if r is not None]
            for s in range(0, len(good), 512):
                own = good[s : s + 512]
                for i, d in zip(own, derived([rows[i] for i in own], context), strict=True):
                    out[i] = d.hex()
            yield pa.array(out, pa.string())

    return ids(F.concat(_little(F.octet_length(prefix)), prefix.cast("binary"), rest.cast("binary")))


def _little(size: Column) -> Column:
    """A size as 8 bytes, the least first."""
    digits = F.lpad(F.hex(size.cast("bigint")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * k, 2) for k in range(8)]))
