"""Quality rules from tokeniser fertility.

Each whole text is measured in two public vocabularies, a byte-level BPE of
many languages and a piece BPE with byte fallback: characters per token in
both, the share of byte-fallback pieces, and the entropy (bits) of the piece
distribution. A text is rejected if a measure lies outside of the band of its
script, or script and language where the language column names a known one.
Bands are robust and cover the whole table: the median of all texts of the
band, give or take a number of median absolute deviations, floored so
that an even corpus does not reject its own tail.

Base rules (too few words, too many words in repeated windows) come first.

Scale: words are measured once per task and kept in a bounded cache, so a text
costs a lookup a word. The rows that the bands are taken from are slim (five
numbers) and written to the shared folder; medians are approximate percentiles
with a fixed error, which combine map-side; there are at most eight scripts
times twenty-one languages of bands, so they are joined by broadcast.

Defined results: null, empty and blank texts have no words, fail the base rule
and have no measures; rows with a null id keep it; equal rows give equal
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ravelin.llm.common import materialize, table, text_bytes, vocabulary

PIECES = "piece_bpe_32k.model"
BYTES = "byte_bpe_multi_50k.tiktoken"
MIN_WORDS = 50
MAX_REPEAT = 50
#: Deviations allowed below and above the median, and the least width of a band's side as a share of the median.
BANDS = {"bpe_chars": (6.0, 9.0, 0.10), "piece_chars": (6.0, 9.0, 0.12), "entropy": (9.0, 9.0, 0.25)}
#: Byte-fallback pieces: the median's share plus this.
MAX_FALLBACK = 0.10
CACHE = 300_000
TEXTS_AT_ONCE = 256
#: Language codes that have bands of their own; texts of other or no language have their script's.
LANGS = ("en", "de", "fr", "es", "it", "pt", "nl", "pl", "ru", "uk", "ar", "he", "hi", "ja", "zh", "ko", "tr", "el", "vi", "cs")
SYMBOLS = b"#*$%&|<>"
SCRIPTS = ("latin", "greek", "cyrillic", "hebrew_arabic", "indic", "kana_han", "hangul", "other")
#: First code points after each script's range, in the order of SCRIPTS as SCRIPT_OF names them.
RANGES = (0x250, 0x370, 0x400, 0x530, 0x590, 0x900, 0xE00, 0x2E80, 0xA000, 0xAC00, 0xD7B0, 0x110000)
SCRIPT_OF = (0, 7, 1, 2, 7, 3, 4, 7, 5, 7, 6, 7)


@lru_cache(maxsize=2)
def _vocabularies(folder: str | None):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    with open(vocabulary(BYTES, folder), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    bpe = tiktoken.Encoding("ravelin-bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES, folder))
    fallback = np.array([pieces.IsByte(i) for i in range(pieces.GetPieceSize())])
    begins = np.array([x.startswith(b" ") for x in bpe.decode_tokens_bytes(range(bpe.n_vocab))])
    return bpe, pieces, fallback, begins


class _Numbers(dict):
    """Numbers words in the order they are met, and lists the new ones."""

    def __init__(self):
        self.new: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.new.append(word)
        return n


class _Measures:
    """Per word, by its number: characters, BPE tokens, script and pieces."""

    def __init__(self, folder: str | None):
        self.bpe, self.pieces, self.fallback, self.begins = _vocabularies(folder)
        self.clear()

    def clear(self) -> None:
        self.number = _Numbers()
        self.chars, self.tokens, self.scripts, self.flat = (np.zeros(0, t) for t in (np.int64, np.int64, np.int8, np.int32))
        self.starts = np.zeros(1, np.int64)

    def learn(self) -> None:
        """Measure the words that were numbered since the last time."""
        new, self.number.new = self.number.new, []
        if not new:
            return
        texts = [w.decode("utf-8", "replace") for w in new]
        # one call for all: each word, with its blank, is split from its neighbours, and only its first token begins with a blank
        starts = self.begins[np.array(self.bpe.encode_ordinary("".join(" " + t for t in texts)), np.int64)]
        ids = self.pieces.encode(texts, num_threads=1)
        n = np.fromiter(map(len, ids), np.int64, len(ids))
        first = np.array([next((ord(c) for c in t if c.isalpha()), -1) for t in texts])
        scripts = np.where(first < 0, -1, np.array(SCRIPT_OF)[np.searchsorted(RANGES, np.maximum(first, 0), side="right")])
        self.chars = np.concatenate([self.chars, np.fromiter(map(len, texts), np.int64, len(texts))])
        self.tokens = np.concatenate([self.tokens, np.diff(np.r_[np.flatnonzero(starts), len(starts)])])
        self.scripts = np.concatenate([self.scripts, scripts.astype(np.int8)])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(ids), np.int32, int(n.sum()))])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(n)])

    def of(self, kinds: np.ndarray):
        """(characters, tokens, scripts, pieces' number, pieces one after the other)."""
        a, n = self.starts[kinds], self.starts[kinds + 1] - self.starts[kinds]
        at = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.chars[kinds], self.tokens[kinds], self.scripts[kinds], n, self.flat[at]


def repeated_words(local: np.ndarray, kinds: int) -> int:
    """Words within 3-word windows that occur twice or more in the text."""
    n = len(local)
    if n < 4:
        return 0
    local = local.astype(np.int64)
    if kinds < 1 << 21:
        key = (local[:-2] * kinds + local[1:-1]) * kinds + local[2:]
    else:  # pairs get numbers first, so that keys stay exact
        pair = np.unique(local[:-1] * kinds + local[1:], return_inverse=True)[1].reshape(-1)
        key = pair[:-1] * np.int64(kinds) + local[2:]
    _, back, counts = np.unique(key, return_inverse=True, return_counts=True)
    twice = counts[back.reshape(-1)] > 1
    cover = np.zeros(n, bool)
    for k in range(3):
        cover[k : n - 2 + k] |= twice
    return int(cover.sum())


def duplicate_lines(data: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    if b"\n" not in data:
        return 0
    lines = [x for x in data.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


COLUMNS = "doc_id long, lang string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, script string, bpe_chars double, piece_chars double, fallback double, entropy double"


def _row(known: _Measures, doc_id, lang, data: bytes, at: np.ndarray) -> tuple:
    """The measures of a text whose words have the numbers ``at``."""
    n = len(at)
    lines, symbols = duplicate_lines(data), sum(map(data.count, (bytes([x]) for x in SYMBOLS)))
    if not n:
        return (doc_id, lang, 0, 0, symbols, lines, 0, "other", None, None, None, None)
    kinds, local, times = np.unique(at, return_inverse=True, return_counts=True)
    chars, tokens, scripts, n_ids, flat = known.of(kinds)
    word_chars, n_tokens, n_pieces = int((chars * times).sum()), int((tokens * times).sum()), int((n_ids * times).sum())
    counts = np.bincount(flat, weights=np.repeat(times, n_ids), minlength=len(known.fallback))
    share = counts[counts > 0] / n_pieces
    lettered = scripts >= 0
    script = int(np.bincount(scripts[lettered], weights=(chars * times)[lettered], minlength=len(SCRIPTS)).argmax()) if lettered.any() else len(SCRIPTS) - 1
    return (doc_id, lang, n, word_chars, symbols, lines, repeated_words(local.reshape(-1), len(kinds)), SCRIPTS[script], word_chars / n_tokens, word_chars / n_pieces, float(counts[known.fallback].sum() / n_pieces), float(-(share * np.log2(share)).sum()))


def _measure(folder: str | None):
    def run(batches):
        known = _Measures(folder)
        for rb in batches:
            out = []
            for s in range(0, rb.num_rows, TEXTS_AT_ONCE):
                if len(known.number) > CACHE:
                    known.clear()
                rows = list(zip(*(c.slice(s, TEXTS_AT_ONCE).to_pylist() for c in rb.columns), strict=True))
                numbers = []
                for _, data, _ in rows:
                    words = data.split()
                    numbers.append(np.fromiter(map(known.number.__getitem__, words), np.int64, len(words)))
                known.learn()
                out += [_row(known, doc_id, lang, data, at) for (doc_id, data, lang), at in zip(rows, numbers, strict=True)]
            cols = list(zip(*out, strict=True)) if out else [()] * 12
            kinds_ = [pa.int64(), pa.string()] + [pa.int64()] * 5 + [pa.string()] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds_, strict=True)], [x.split()[0] for x in COLUMNS.split(", ")])

    return run


def measures(docs: DataFrame, folder: str | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """A row of measures for every row of ``docs``; ``lang_col`` may be missing."""
    lang = F.col(lang_col).cast("string") if lang_col in docs.columns else F.lit(None).cast("string")
    out = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_bytes(text_col).alias("b"), lang.alias("lang")).mapInArrow(_measure(folder), COLUMNS)
    return out.withColumn("band", F.when(F.col("lang").isin(*LANGS), F.concat_ws(":", "script", "lang")).otherwise(F.col("script"))).drop("lang")


def bands(measured: DataFrame, rules: dict = BANDS, max_fallback: float = MAX_FALLBACK) -> DataFrame:
    """(band, and for each measure its least and greatest value); one row a
    band, from all texts that have words."""
    names = [*rules, "fallback"]
    mid = measured.filter("n_words > 0").groupBy("band").agg(*[F.percentile_approx(x, 0.5, 1000).alias(f"{x}_mid") for x in names])
    off = measured.filter("n_words > 0").join(F.broadcast(mid), "band").groupBy("band").agg(*[F.first(f"{x}_mid").alias(f"{x}_mid") for x in names], *[F.percentile_approx(F.abs(F.col(x) - F.col(f"{x}_mid")), 0.5, 1000).alias(f"{x}_off") for x in rules])
    sides = []
    for x, (below, above, least) in rules.items():
        width = lambda k, x=x, least=least: F.greatest(F.lit(k) * F.col(f"{x}_off"), F.lit(least) * F.col(f"{x}_mid"))
        sides += [(F.col(f"{x}_mid") - width(below)).alias(f"{x}_least"), (F.col(f"{x}_mid") + width(above)).alias(f"{x}_most")]
    return off.select("band", *sides, (F.col("fallback_mid") + max_fallback).alias("fallback_most"))


def judge(docs: DataFrame, folder: str | None = None, rules: dict = BANDS, max_fallback: float = MAX_FALLBACK, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, base counts, base_failed, kept, the measures) of every row."""
    measured = materialize(measures(docs, folder, id_col, text_col), "fertility")
    limits = bands(measured, rules, max_fallback)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT * F.col("n_words"))
    inside = F.col("fallback") <= F.col("fallback_most")
    for x in rules:
        inside &= F.col(x).between(F.col(f"{x}_least"), F.col(f"{x}_most"))
    out = measured.join(F.broadcast(limits), "band", "left").withColumn("base_failed", base)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", (~F.col("base_failed") & F.coalesce(inside, F.lit(False))).alias("kept"), "band", "bpe_chars", "piece_chars", "fallback", "entropy")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
