"""Byte-level BPE encoding and decoding by tree concatenation.

A short text is encoded at once. A long one is cut into halves until the
leaves are short; the leaves are encoded in parallel threads, and neighbours
are put together: a window around the join is encoded anew and grown until both
sides agree with it exactly. Agreement is exact, not a guess. The window and a
side must share a token boundary, and it must be a seam of one of two kinds:
a place where the splitting pattern splits any text (one blank between two
letters), so that left and right are independent; or, in a long run of letters
that nothing splits, a place where the two neighbouring tokens, encoded
together, give themselves again, which for every pair of neighbours makes a
sequence the run's encoding. A text with neither is re-encoded over ever
larger windows, in the end as a whole.

The vocabulary is a public file whose place is a parameter. Token ids are
those of the tokenizers library with the JSON form of the vocabulary; the
special token's string in a text is the special token. Decoding joins the
tokens' bytes.

Scale: no shuffle; each row is on its own, so a hot source or group of copies
does not matter. Memory is one Arrow batch with its ids.

Defined results: null and empty texts have no tokens and the digests of the
empty string; equal rows give equal results; null ids stay; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
import json
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import table, vocabulary

VOCABULARY = "byte_bpe_50k.json"
#: Texts of more characters are encoded as a tree of leaves of about this size.
LEAF = 1 << 15
#: Characters re-encoded on each side of a join at first; doubled until both sides agree.
REACH = 64
THREADS = 2


def _unicode_bytes() -> dict[str, int]:
    """Byte-level vocabularies write each byte as a printable character: itself
    where Latin-1 prints it, else the next free one from U+0100."""
    kept = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    other = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(other)}


@lru_cache(maxsize=4)
def encoding(path: str):
    """The vocabulary of a tokenizers JSON file as an encoder. Merges are in
    the order of ids, which is checked, so that ranks and ids are the same."""
    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, special = spec["model"], {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
    at = _unicode_bytes()
    ranks = {bytes(at[c] for c in token): i for token, i in model["vocab"].items() if token not in special}
    last = -1
    for m in model["merges"]:
        i = model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))]
        if i < last:
            raise ValueError("merges are not in the order of ids")
        last = i
    return tiktoken.Encoding("ravelin", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def _plain(enc, text: str) -> list[int]:
    return enc.encode(text, allowed_special="all")


def _is_seam(text: str, at: int) -> bool:
    """Does every encoding of the whole text split before ``at``? So it is
    where one blank stands between two letters: the pattern can neither join
    the letter before to the blank, nor take the blank but with what follows."""
    return 0 < at < len(text) - 1 and text[at] == " " and text[at - 1].isalpha() and text[at + 1].isalpha()


def _char_ends(enc, ids: list[int]) -> list[int]:
    """For each token, the characters that end with it or before; -1 where a
    token ends within a character."""
    ends, chars, need = [], 0, 0
    for token in enc.decode_tokens_bytes(ids):
        for b in token:
            if need:
                need -= 1
            else:
                chars += 1
                need = 0 if b < 0x80 else 1 if b < 0xE0 else 2 if b < 0xF0 else 3
        ends.append(-1 if need else chars)
    return ends


def _in_letters(text: str, at: int) -> bool:
    """Does ``at`` lie within a run of letters, too far in for a contraction?"""
    return 3 <= at < len(text) and text[at - 3 : at + 1].isalpha()


def _agree(enc, one: int, two: int) -> bool:
    """Two neighbours in one run of letters stay as they are if encoding their
    bytes gives them again; a sequence of such pairs is the run's encoding."""
    return enc._encode_single_piece(enc.decode_single_token_bytes(one) + enc.decode_single_token_bytes(two)) == [one, two]


def _join(enc, text: str, a: int, m: int, b: int, left: list[int], right: list[int], reach: int) -> list[int]:
    """The ids of text[a:b] from those of text[a:m] and text[m:b]."""
    while True:
        lo, hi = max(a, m - reach), min(b, m + reach)
        if hi - lo >= b - a:
            return _plain(enc, text[a:b])
        plain_lo, plain_hi = lo == a, hi == b
        if not plain_lo and (seam := next((p for p in range(lo, m - 1) if _is_seam(text, p)), None)) is not None:
            lo, plain_lo = seam, True
        if not plain_hi and (seam := next((p for p in range(hi, m + 1, -1) if _is_seam(text, p)), None)) is not None:
            hi, plain_hi = seam, True
        cut_l, lo = (_cut_tail(enc, left, m - lo), lo) if plain_lo else _tail_boundary(enc, left, m, m - lo)
        cut_r, hi = (_cut_head(enc, right, hi - m), hi) if plain_hi else _head_boundary(enc, right, m, hi - m)
        if cut_l is not None and cut_r is not None and (plain_lo or _in_letters(text, lo)) and (plain_hi or _in_letters(text, hi)):
            window = _plain(enc, text[lo:hi])
            if (plain_lo or not cut_l or _agree(enc, left[cut_l - 1], window[0])) and (plain_hi or cut_r == len(right) or _agree(enc, window[-1], right[cut_r])):
                return left[:cut_l] + window + right[cut_r:]
        reach *= 2


def _tail_boundary(enc, ids: list[int], m: int, chars: int) -> tuple[int | None, int]:
    """The last token boundary at least ``chars`` characters before ``m``."""
    got, k = 0, len(ids)
    while k:
        k -= 1
        data = enc.decode_single_token_bytes(ids[k])
        got += sum(1 for x in data if x & 0xC0 != 0x80)
        if got >= chars and data[0] & 0xC0 != 0x80:
            return k, m - got
    return None, m


def _head_boundary(enc, ids: list[int], m: int, chars: int) -> tuple[int | None, int]:
    """The first token boundary at least ``chars`` characters after ``m``."""
    step = 256
    while True:
        for k, end in enumerate(_char_ends(enc, ids[:step])):
            if end >= chars:
                return k + 1, m + end
        if step >= len(ids):
            return None, m
        step *= 4


def _cut_head(enc, ids: list[int], chars: int) -> int | None:
    """The number of tokens that hold the first ``chars`` characters exactly."""
    if not chars:
        return 0
    step = 256
    while True:
        part = ids[: min(len(ids), step)]
        ends = _char_ends(enc, part)
        if ends and max(ends) >= chars or step >= len(ids):
            return ends.index(chars) + 1 if chars in ends else None
        step *= 4


def _cut_tail(enc, ids: list[int], chars: int) -> int | None:
    """The number of tokens before the last ``chars`` characters, if these
    begin a token."""
    if not chars:
        return len(ids)
    got, k = 0, len(ids)
    while k and got < chars:
        k -= 1
        got += sum(1 for b in enc.decode_single_token_bytes(ids[k]) if b & 0xC0 != 0x80)
    return k if got == chars and (enc.decode_single_token_bytes(ids[k])[0] & 0xC0) != 0x80 else None


def encode(enc, text: str, leaf: int = LEAF, reach: int = REACH, threads: int = THREADS) -> list[int]:
    """The ids of a text, as the encoder gives them for the whole of it."""
    if len(text) <= leaf or any(s in text for s in enc.special_tokens_set):
        return _plain(enc, text)
    cuts = [0, len(text)]
    while max(y - x for x, y in zip(cuts, cuts[1:], strict=False)) > leaf:
        cuts = sorted({*cuts, *((x + y) // 2 for x, y in zip(cuts, cuts[1:], strict=False))})
    parts = enc.encode_ordinary_batch([text[x:y] for x, y in zip(cuts, cuts[1:], strict=False)], num_threads=threads)
    while len(parts) > 1:
        edges = [*cuts[:: 2][: (len(parts) + 1) // 2], cuts[-1]]
        joined = []
        for k in range(0, len(parts), 2):
            joined.append(_join(enc, text, cuts[k], cuts[k + 1], cuts[k + 2], parts[k], parts[k + 1], reach) if k + 1 < len(parts) else parts[k])
        parts, cuts = joined, edges
    return parts[0]


def decode(enc, ids: list[int]) -> str:
    return enc.decode_bytes(ids).decode("utf-8", "replace")


def _rows(name: str, folder: str | None):
    def run(batches):
        enc = encoding(vocabulary(name, folder))
        for rb in batches:
            n, ids_sha, text_sha = [], [], []
            for text in rb.column(1).to_pylist():
                ids = encode(enc, text or "")
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
                text_sha.append(hashlib.sha256(decode(enc, ids).encode("utf-8", "surrogatepass")).hexdigest())
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return run


def encode_table(docs: DataFrame, vocab: str = VOCABULARY, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``' ids with the token ids of each text: (doc_id, ids)."""

    def run(batches):
        enc = encoding(vocabulary(vocab, folder))
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([encode(enc, t or "") for t in rb.column(1).to_pylist()], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_table(encoded: DataFrame, vocab: str = VOCABULARY, folder: str | None = None) -> DataFrame:
    """(doc_id, text) from (doc_id, ids)."""

    def run(batches):
        enc = encoding(vocabulary(vocab, folder))
        for rb in batches:
            yield pa.RecordBatch.from_arrays([rb.column(0), pa.array([decode(enc, x or []) for x in rb.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocab: str = VOCABULARY, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(_rows(vocab, folder), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    del spark, sf_dir
    return round_trip(docs)
