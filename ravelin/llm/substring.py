"""Substring dedup: seed and extend over winnowed anchors.

A seed is an anchor: the 8-word gram that winnowing selects from the 13 grams
of a 20-word window, so that equal windows select the same anchor at the same
offset. Anchors that occur once in the corpus can belong to no repeat. Around
each anchor that occurs again, the match is extended both ways over every
window that selected it: windows are compared by the anchor's hash with one of
their own, made of another hash of the words (128 bits together, independent;
words themselves are not compared), the earliest place of each is found, and
runs of matching windows join to maximal repeats of at least 20 words. A word
goes if a window that covers it starts earlier too (smaller id, or earlier in
the same document); windows are judged on the input, not on what is left.

Scale: texts are cut into blocks of about 8 MB. A block sends each hash once
(pre-aggregated, so a passage that a third of all documents share costs one
entry a block), gets one answer per hash, and nothing is gathered by passage.
Hashes are dealt to as many ranges as keep one at ``RANGE_BYTES``, however large
the input; a task keeps what blocks sent as it came, and works on it a bounded
number of hashes at a time. Texts move twice, compressed, to meet the answers
for their block; both exchanges are keyed by block, which are of even size.
Written tables cut lineage.

Defined results: null, empty and blank texts give 0, 0 and the digest of the
empty string; texts under 20 words lose nothing; rows with a null id are later
than all others and, among themselves, like rows of one document; rows that
repeat an id count as the same document, so equal rows do not remove each
other's first windows; an empty table gives an empty result. Other columns are
ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialize, shuffle_parts, table, text_bytes

WINDOW = 20
GRAM = 8
BLOCK_BYTES = 8 << 20
#: Stands for a null id: later than any other.
LAST = np.int64(2**63 - 1)

#: Bytes of hashes that a range is dealt, and hashes that are worked on at a time.
RANGE_BYTES = 16 << 20
AT_ONCE = 1 << 20

#: Bases of the rolling hashes of grams and of windows.
_BASE, _BASE2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


class _WordHashes(dict):
    """Numbers words, and has two independent hashes for each number."""

    MOST = 400_000

    def __init__(self):
        self.one, self.two = np.zeros(self.MOST, np.uint64), np.zeros(self.MOST, np.uint64)

    def __missing__(self, word: bytes) -> int:
        import xxhash

        both = xxhash.xxh3_128_intdigest(word)
        n = self[word] = len(self)
        self.one[n], self.two[n] = both & 0xFFFFFFFFFFFFFFFF, both >> 64
        return n

    def of(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Both hashes of each word."""
        if len(self) + len(words) > self.MOST:
            self.clear()
        if len(words) > self.MOST:  # more than fit: a part at a time
            parts = [self.of(words[a : a + self.MOST // 2]) for a in range(0, len(words), self.MOST // 2)]
            return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
        at = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.one[at], self.two[at]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def _rolling(h: np.ndarray, k: int, base: np.uint64 = _BASE) -> np.ndarray:
    """Hash of every run of k words, by doubling: h(2m) = h(m) * B^m + h(m)."""
    n = len(h) - k + 1
    out, done, part, size = np.zeros(n, np.uint64), 0, h, 1
    while True:
        power = np.uint64(pow(int(base), size, 2**64))
        if k & size:
            out = out * power + part[done : done + n]
            done += size
        if size * 2 > k:
            return _mix(out)
        part = part[:-size] * power + part[size:]
        size *= 2


def anchors(h: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """For word hashes: the gram hashes, and for each window the place of the
    gram it selects (the least hash, the first of equal ones)."""
    grams = _rolling(h, gram)
    span = window - gram + 1
    view = np.lib.stride_tricks.sliding_window_view(grams, span)
    return grams, np.arange(len(view)) + view.argmin(axis=1)


def _unpack(ids: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes]]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(texts)
    ids = np.frombuffer(ids, np.int64)
    n = len(ids)
    ends = np.frombuffer(raw, np.int64, n)
    starts = np.r_[n * 8, ends[:-1]] if n else ends
    return ids, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]


def _pack_blocks(batches):
    """Blocks of texts with the anchors' hashes: each once, and apart those
    that the block holds twice or more."""
    import zstandard
    from pyspark import TaskContext

    part, made = TaskContext.get().partitionId(), 0
    ids, texts, size, words = [], [], 0, _WordHashes()

    def block():
        nonlocal made
        found, windows = [], 0
        for t in texts:
            w = t.split()
            if len(w) >= WINDOW:
                grams, at = anchors(words.of(w)[0])
                found.append(grams[np.unique(at)])
                windows += len(w) - WINDOW + 1
        hashes, counts = np.unique(np.concatenate(found), return_counts=True) if found else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
        ends = np.cumsum([len(t) for t in texts]) + 8 * len(texts)
        packed = zstandard.ZstdCompressor(level=3).compress(ends.astype(np.int64).tobytes() + b"".join(texts))
        made += 1
        return pa.RecordBatch.from_arrays(
            [pa.array([f"{part}-{made}"]), pa.array([np.array(ids, np.int64).tobytes()]), pa.array([packed]), pa.array([hashes[counts == 1].tobytes()]), pa.array([hashes[counts > 1].tobytes()]), pa.array([windows], pa.int64())],
            ["block", "ids", "texts", "once", "more", "windows"],
        )

    for rb in batches:
        for i, t in zip(rb.column(0).to_pylist(), rb.column(1).to_pylist(), strict=True):
            ids.append(LAST if i is None else i)
            texts.append(t)
            size += len(t)
            if size >= BLOCK_BYTES:
                yield block()
                ids, texts, size = [], [], 0
    if ids:
        yield block()


BLOCKS = "block string, ids binary, texts binary, once binary, more binary, windows long"


def _deal_hashes(parts: int):
    def run(batches):
        for rb in batches:
            for row in rb.to_pylist():
                for kind in ("once", "more"):
                    h = np.frombuffer(row[kind], np.uint64)
                    to = (h >> np.uint64(11)) % np.uint64(parts)
                    order = np.argsort(to, kind="stable")
                    h, to = h[order], to[order]
                    cuts = np.flatnonzero(np.r_[True, to[1:] != to[:-1]]) if len(h) else []
                    groups = np.split(h, cuts[1:]) if len(h) else []
                    if groups:
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(to[cuts].astype(np.int32)), pa.array([row["block"]] * len(groups)), pa.array([kind == "more"] * len(groups)), pa.array([g.tobytes() for g in groups])],
                            ["part", "block", "twice", "hashes"],
                        )

    return run


def _repeated(batches):
    """Of each block's hashes, those that the corpus holds twice or more."""
    rows, every, counts, waiting, size = [], np.zeros(0, np.uint64), np.zeros(0, np.int64), [], 0

    def count() -> None:
        nonlocal every, counts, waiting, size
        hashes = np.concatenate([every, *(h for h, _ in waiting)])
        times = np.concatenate([counts, *(np.full(len(h), t) for h, t in waiting)])
        every, back = np.unique(hashes, return_inverse=True)
        counts = np.minimum(2, np.bincount(back.reshape(-1), weights=times, minlength=len(every))).astype(np.int64)
        waiting, size = [], 0

    for rb in batches:
        for b, t, raw in zip(*(rb.column(x).to_pylist() for x in ("block", "twice", "hashes")), strict=True):
            h = np.frombuffer(raw, np.uint64)
            rows.append((b, h))
            waiting.append((h, 1 + t))
            size += len(h)
            if size >= AT_ONCE:
                count()
    count()
    every = every[counts > 1]
    for s in range(0, len(rows) if len(every) else 0, 256):
        out = []
        for b, h in rows[s : s + 256]:
            hit = h[every[np.minimum(np.searchsorted(every, h), len(every) - 1)] == h]
            if len(hit):
                out.append((b, hit.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out]), pa.array([h for _, h in out])], ["block", "answer"])


def _by_block(batches):
    """(block, its answers, ids, texts) from rows sorted by block, answers
    before texts."""
    block, answers = None, []
    for rb in batches:
        for i in range(rb.num_rows):
            b = rb.column("block")[i].as_py()
            if b != block:
                block, answers = b, []
            if (a := rb.column("answer")[i].as_py()) is not None:
                answers.append(a)
            if (t := rb.column("texts")[i].as_py()) is not None:
                yield b, answers, rb.column("ids")[i].as_py(), t


def _runs(doc: np.ndarray, at: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """Starts of runs of consecutive places in one document (and equal more)."""
    if not len(doc):
        return np.zeros(0, np.int64)
    new = (doc[1:] != doc[:-1]) | (at[1:] != at[:-1] + 1)
    for m in more:
        new |= m[1:] != m[:-1]
    return np.flatnonzero(np.r_[True, new])


_RUN = np.dtype([("doc", "<i8"), ("row", "<i4"), ("at", "<i8"), ("n", "<i4")])
_ASK = np.dtype([("anchor", "<u8"), ("doc", "<i8"), ("row", "<i4"), ("at", "<i8"), ("n", "<i4")])


def _extend(parts: int):
    """Windows that selected a repeated anchor: those that are later than an
    equal one in the block are told at once, the first of each are asked about."""

    def run(batches):
        words = _WordHashes()
        for block, answers, ids, texts in _by_block(batches):
            ids, texts = _unpack(ids, texts)
            hit = np.unique(np.concatenate([np.frombuffer(a, np.uint64) for a in answers])) if answers else np.zeros(0, np.uint64)
            cols = []
            for row, t in enumerate(texts if len(hit) else ()):
                w = t.split()
                if len(w) < WINDOW:
                    continue
                h, other = words.of(w)
                grams, sel = anchors(h)
                place = np.searchsorted(hit, grams[sel])
                at = np.flatnonzero(hit[np.minimum(place, len(hit) - 1)] == grams[sel])
                if len(at):
                    cols.append((np.full(len(at), ids[row]), np.full(len(at), row, np.int32), at, grams[sel[at]], _rolling(other, WINDOW, _BASE2)[at]))
            if not cols:
                continue
            doc, row, at, anchor, own = (np.concatenate(x) for x in zip(*cols, strict=True))
            order = np.lexsort((row, at, doc, own, anchor))
            same = np.r_[False, (own[order][1:] == own[order][:-1]) & (anchor[order][1:] == anchor[order][:-1])]
            group = np.cumsum(~same) - 1
            head = order[~same]
            later = np.zeros(len(doc), bool)
            later[order] = (doc[order] != doc[head][group]) | (at[order] != at[head][group])
            first = np.zeros(len(doc), bool)
            first[head] = True
            # an equal (id, place) in the block gets the same answer as the head: both carry their row, so all of them ask
            ask = ~later
            told = np.flatnonzero(later)
            s = _runs(row[told], at[told])
            runs = np.zeros(len(s), _RUN)
            if len(s):
                runs["doc"], runs["row"], runs["at"], runs["n"] = doc[told][s], row[told][s], at[told][s], np.diff(np.r_[s, len(told)])
                yield _w(block, -1, runs.tobytes(), None)
            ask = np.flatnonzero(ask)
            doc, row, at, anchor, own = doc[ask], row[ask], at[ask], anchor[ask], own[ask]
            to = (anchor >> np.uint64(11)) % np.uint64(parts)
            order = np.argsort(to, kind="stable")
            doc, row, at, anchor, own, to = (x[order] for x in (doc, row, at, anchor, own, to))
            cuts = np.r_[np.flatnonzero(np.r_[True, to[1:] != to[:-1]]), len(to)] if len(to) else [0]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                s = a + _runs(row[a:b], at[a:b], anchor[a:b])
                asks = np.zeros(len(s), _ASK)
                asks["anchor"], asks["doc"], asks["row"], asks["at"], asks["n"] = anchor[s], doc[s], row[s], at[s], np.diff(np.r_[s, b])
                yield _w(block, int(to[a]), asks.tobytes(), own[a:b].tobytes())

    return run


def _w(block, part, runs, own):
    return pa.RecordBatch.from_arrays([pa.array([block]), pa.array([part], pa.int32()), pa.array([runs], pa.binary()), pa.array([own], pa.binary())], ["block", "part", "runs", "own"])


WINDOWS = "block string, part int, runs binary, own binary"


class _Asked:
    """What blocks asked, as it came, and its windows a part at a time."""

    def __init__(self, batches):
        self.rows = [(b, np.frombuffer(r, _ASK), np.frombuffer(o, np.uint64)) for rb in batches for b, r, o in zip(*(rb.column(x).to_pylist() for x in ("block", "runs", "own")), strict=True)]

    def parts(self):
        """(anchor, own, doc, at, row of the document, which of ``rows``)."""
        part, size = [], 0
        for k, (_, r, own) in enumerate(self.rows):
            n = r["n"]
            step = np.arange(len(own)) - np.repeat(np.cumsum(n) - n, n)
            part.append((np.repeat(r["anchor"], n), own, np.repeat(r["doc"], n), np.repeat(r["at"], n) + step, np.repeat(r["row"], n), np.full(len(own), k)))
            size += len(own)
            if size >= AT_ONCE:
                yield tuple(map(np.concatenate, zip(*part, strict=True)))
                part, size = [], 0
        if part:
            yield tuple(map(np.concatenate, zip(*part, strict=True)))


def _key(anchor: np.ndarray, own: np.ndarray) -> np.ndarray:
    return anchor * _BASE + own


def _earliest(batches):
    """Windows asked about that start earlier in some other block or place."""
    asked = _Asked(batches)
    first = (np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    for part in asked.parts():  # the first place of each window so far, sorted by its key
        anchor, own, doc, at = (np.concatenate([a, b]) for a, b in zip(first, part, strict=False))
        order = np.lexsort((at, doc, own, anchor, _key(anchor, own)))
        anchor, own, doc, at = anchor[order], own[order], doc[order], at[order]
        new = np.r_[True, (own[1:] != own[:-1]) | (anchor[1:] != anchor[:-1])]
        first = anchor[new], own[new], doc[new], at[new]
    keys = _key(*first[:2])
    for anchor, own, doc, at, row, src in asked.parts():
        head = np.searchsorted(keys, _key(anchor, own))
        while len(other := np.flatnonzero((first[0][head] != anchor) | (first[1][head] != own))):
            head[other] += 1  # another window of the same key
        later = np.flatnonzero((doc != first[2][head]) | (at != first[3][head]))
        later = later[np.lexsort((at[later], row[later], src[later]))]
        s = _runs(row[later], at[later], src[later])
        if not len(s):
            continue
        runs = np.zeros(len(s), _RUN)
        runs["doc"], runs["row"], runs["at"], runs["n"] = doc[later][s], row[later][s], at[later][s], np.diff(np.r_[s, len(later)])
        of = src[later][s]
        cuts = np.r_[np.flatnonzero(np.r_[True, of[1:] != of[:-1]]), len(of)]
        yield pa.RecordBatch.from_arrays([pa.array([asked.rows[of[a]][0] for a in cuts[:-1]]), pa.array([runs[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)])], ["block", "answer"])


def _cut(keep_text: bool):
    def run(batches):
        for _, answers, ids, texts in _by_block(batches):
            ids, texts = _unpack(ids, texts)
            runs = np.concatenate([np.frombuffer(a, _RUN) for a in answers]) if answers else np.zeros(0, _RUN)
            runs = runs[np.argsort(runs["row"], kind="stable")]
            rows, starts = np.unique(runs["row"], return_index=True)
            of = dict(zip(rows.tolist(), np.split(runs, starts[1:]) if len(rows) else [], strict=True))
            out = {x: [] for x in ("doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")}
            for k, t in enumerate(texts):
                words = t.split()
                n, gone = len(words), 0
                if (r := of.get(k)) is not None:
                    edge = np.zeros(n + 1, np.int32)
                    np.add.at(edge, r["at"], 1)
                    np.add.at(edge, r["at"] + r["n"] + WINDOW - 1, -1)
                    keep = np.cumsum(edge[:-1]) == 0
                    gone = n - int(keep.sum())
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                kept = b" ".join(words)
                out["doc_id"].append(None if ids[k] == LAST else int(ids[k]))
                out["n_words"].append(n)
                out["n_removed"].append(gone)
                out["kept_sha256"].append(hashlib.sha256(kept).hexdigest())
                if keep_text:
                    out["kept_text"].append(kept.decode("utf-8", "replace"))
            if not keep_text:
                del out["kept_text"]
            yield pa.RecordBatch.from_pydict(out, pa.schema([(x, pa.int64() if x in ("doc_id", "n_words", "n_removed") else pa.string()) for x in out]))

    return run


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept_text]), a row per row."""
    least = shuffle_parts(docs.sparkSession)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"))
    blocks = materialize(slim.mapInArrow(_pack_blocks, BLOCKS), "blocks")
    size = blocks.agg(F.count("*").alias("blocks"), F.sum(F.length("once") + F.length("more")).alias("hashes"), F.sum("windows").alias("windows")).first()
    ranges = max(least, -(-(size.hashes or 0) // RANGE_BYTES))
    window_ranges = max(least, -(-8 * (size.windows or 0) // RANGE_BYTES))
    tasks = max(least, size.blocks // 8)
    none = F.lit(None).cast("binary")

    def meet(answers: DataFrame) -> DataFrame:
        """Answers and texts of a block in one task, answers first."""
        both = answers.select("block", "answer", none.alias("ids"), none.alias("texts")).unionByName(blocks.select("block", none.alias("answer"), "ids", "texts"))
        return both.repartition(tasks, "block").sortWithinPartitions("block", F.col("texts").isNotNull())

    asked = blocks.select("block", "once", "more").mapInArrow(_deal_hashes(ranges), "part int, block string, twice boolean, hashes binary")
    repeated = asked.repartitionById(ranges, "part").mapInArrow(_repeated, "block string, answer binary")
    windows = materialize(meet(repeated).mapInArrow(_extend(window_ranges), WINDOWS), "windows")
    earlier = windows.filter("part >= 0").repartitionById(window_ranges, "part").mapInArrow(_earliest, "block string, answer binary")
    told = windows.filter("part < 0").select("block", F.col("runs").alias("answer"))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * keep_text
    return meet(earlier.unionByName(told)).mapInArrow(_cut(keep_text), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))
