"""Toxicity: a support vector machine over a gapped subsequence kernel with
Nystroem landmarks.

Kernel: two words are alike as far as they share subsequences of three
letters, each one discounted by ``DECAY`` for every letter it skips, over at
most ``SPAN`` letters. So inserted characters and gaps weaken a match instead
of breaking it. Words are scaled by a factor of their length alone, which
keeps the kernel positive definite.

Model: landmarks are words of the labelled sample, those that tell toxic
from clean texts best (greedy over uncovered toxic texts) and frequent clean
ones. A word is mapped to K_mm^(-1/2) k(landmarks, word). A linear squared-hinge
machine is trained on labelled sentences as bags of words: words that stand out
in toxic texts are positive instances, found anew after each fit; words of
clean texts are negative, the hardest ones always; copies of the positives
with inserted characters make it tolerant. A text's score is a logistic
function, fitted on the sample, of its highest word margins and of how much
stands out among its words: one plain insult is enough, while a doubtful word
counts with others. Words of more than ``MAX_WORD`` letters (texts without
blanks, addresses) are judged by their pieces, the highest of which counts, so
every character is scored.

A margin is linear in the subsequence counts, so the trained machine collapses
to one weight per subsequence: scoring looks weights up and never compares a
word with the landmarks one by one. Runs of single characters ("i d i o t")
count as words too.

Scale: the fit sees at most ``SAMPLE`` labelled texts of at most
``SAMPLE_CHARS`` characters, chosen by a hash of the id; ids are collected
from the slim labels table first, and of an id that several rows have one text
comes to the driver, so the texts of a fit are at most the bound.
Scoring is map-only, whole texts, with a bounded cache of distinct words, so
copies and hot sources do not matter. The model is one array of 1 MB.

Defined results: null, empty and blank texts get the score of no word at all,
the lowest; a label that is null counts as unlabelled, of several for one id
the highest counts; without both classes in the sample all scores are 0; equal
rows get equal results; rows with a null id are scored and not held out; an
empty table gives an empty result; other columns are ignored by ``score`` and
kept by ``stage``.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ravelin.llm.common import free_name, table

DECAY = 0.6
SPAN = 5
SAMPLE = 6_000
SAMPLE_CHARS = 40_000
LANDMARKS = 160
CLEAN_LANDMARKS = 40
ROUNDS = 4
#: Distinct positive words of a fit, the most frequent ones.
POSITIVES = 3000
THRESHOLD = 0.3
#: Log likelihood ratios asked of a word where the sample is too small to prove any against chance.
SURE = (5.0, 3.0, 0.5)
CACHE = 100_000
#: Letters that are judged as one word; a longer word is judged by its pieces.
MAX_WORD = 64
#: Stands before and after each word, so that a subsequence can tell its ends.
EDGE = "\x01"
SEED = 7

#: Letter codes: a-z, digits, and 26 that all other letters share, the nearer ones by code point and those of further scripts by a hash of it.
CODES = 64
_MARKS = re.compile(r"[\W_]+")
_SPELLED = re.compile(r"(?<!\S)\S(?:\s\S){3,}(?!\S)")


@lru_cache(maxsize=1)
def _code_table() -> np.ndarray:
    point = np.arange(0x110000, dtype=np.uint64)
    code = 36 + np.where(point < 0x500, point, point * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(26)
    code[ord("a") : ord("z") + 1] = np.arange(26)
    code[ord("0") : ord("9") + 1] = 26 + np.arange(10)
    code[ord(EDGE)] = 63
    return code.astype(np.uint8)


@lru_cache(maxsize=128)
def _places(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Index triples within SPAN letters of each other, and their weights."""
    found = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    at = np.array(found, np.int32).reshape(-1, 3)
    weight = DECAY ** (at[:, 2] - at[:, 0] - 2.0) if len(at) else np.zeros(0)
    return at, (weight / np.sqrt((weight**2).sum()) if len(at) else weight).astype(np.float32)


def pieces(word: str) -> list[str]:
    """A long word cut into windows that overlap by SPAN letters, so that no
    subsequence is lost, and into the parts between its marks, which are words
    of their own; other words as they are."""
    if len(word) <= MAX_WORD:
        return [word]
    parts = [x for x in _MARKS.split(word) if len(x) >= 3]
    step = MAX_WORD - SPAN
    found = [x for x in parts if len(x) <= MAX_WORD]
    for long in dict.fromkeys([word, *(x for x in parts if len(x) > MAX_WORD)]):
        found += [long[a : a + MAX_WORD] for a in range(0, len(long) - MAX_WORD, step)] + [long[-MAX_WORD:]]
    return list(dict.fromkeys(found))


def features(words: list[str]):
    """Groups of words of one length: (positions, subsequences, weights)."""
    by: dict[int, list[int]] = {}
    for i, w in enumerate(words):
        if len(w) >= 3:
            by.setdefault(len(w) + 2, []).append(i)
    table_ = _code_table()
    for n, own in by.items():
        at, weight = _places(n)
        for s in range(0, len(own), 4096):
            part = own[s : s + 4096]
            letters = np.frombuffer("".join(f"{EDGE}{words[i]}{EDGE}" for i in part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            c = table_[letters].astype(np.int32)
            yield np.array(part), (c[:, at[:, 0]] * CODES + c[:, at[:, 1]]) * CODES + c[:, at[:, 2]], weight


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """k(word, landmark)."""
    known: dict[int, int] = {}
    rows: list[dict[int, float]] = []
    for _, seen, weight in ((*x,) for lm in landmarks for x in (list(features([lm])) or [(None, np.zeros((1, 0), int), np.zeros(0))])):
        row: dict[int, float] = {}
        for f, w in zip(seen[0].tolist(), weight.tolist(), strict=True):
            row[f] = row.get(f, 0.0) + w
            known.setdefault(f, len(known) + 1)
        rows.append(row)
    place = np.zeros(CODES**3, np.int32)
    value = np.zeros((len(known) + 1, len(landmarks)), np.float32)
    for f, i in known.items():
        place[f] = i
    for j, row in enumerate(rows):
        for f, w in row.items():
            value[known[f], j] += w
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for part, seen, weight in features(words):
        for s in range(0, len(part), 64):  # a piece of the driver's memory: words x subsequences x landmarks
            out[part[s : s + 64]] = np.einsum("bml,m->bl", value[place[seen[s : s + 64]]], weight, optimize=True)
    return out


TOP = 4
#: The margin of what is too short to be a word, which counts for nothing.
SHORT = -999.0


def summary(margins: np.ndarray, bias: float) -> np.ndarray:
    """What the final logistic function sees of a text's distinct words: the
    highest margins, how much stands out, and that against the words' number."""
    margins = margins[margins > SHORT]
    n = len(margins)
    top = np.full(TOP, min(bias, -1.0))
    if n:
        best = np.sort(np.partition(margins, max(0, n - TOP))[max(0, n - TOP) :])[::-1]
        top[: len(best)] = best
    out = np.maximum(0.0, margins + 0.3).sum() if n else 0.0
    return np.r_[np.clip(top, -3, 2), np.log1p(out), np.log1p(100 * out / (n + 20)), np.log1p(n) / 4]


class Model:
    """A trained machine: a weight per subsequence, a bias, and the logistic
    function that turns a text's margins into its score."""

    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias, self.final = weights, bias, np.zeros(TOP + 4)

    def margins(self, words: list[str]) -> np.ndarray:
        """Of each word; the highest of its pieces stands for a long one."""
        cut = [(i, x) for i, w in enumerate(words) if len(w) > MAX_WORD for x in pieces(w)]
        judged = [w if len(w) <= MAX_WORD else "" for w in words] + [x for _, x in cut]
        out = np.full(len(judged), SHORT, np.float32)
        for part, seen, weight in features(judged):
            out[part] = self.bias + self.weights[seen] @ weight
        np.maximum.at(out, np.array([i for i, _ in cut], np.int64), out[len(words) :])
        return out[: len(words)]

    def probability(self, margins: np.ndarray) -> float:
        z = float(np.r_[summary(margins, self.bias), 1.0] @ self.final)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def words_of(text: str) -> set[str]:
    """Distinct words, lower case, and those spelled out letter by letter."""
    text = text.lower()
    found = set(text.split())
    for run in _SPELLED.findall(text):
        found.add("".join(run.split()))
    return found


def _strip(word: str) -> str:
    """The word without marks around it; letters that marks part one by one
    ("i.d.i.o.t") are put together."""
    word = word.strip(".,;:!?\"'()[]{}*#$%&|-_")
    if len(word) > 6 and not word[1].isalnum() and not any(c.isalnum() for c in word[1::2]) and word[::2].isalnum():
        return word[::2]
    return word


def tokens(text: str) -> set[str]:
    return {p for x in words_of(text) if len(w := _strip(x)) >= 3 for p in pieces(w)}


def _noised(word: str, rng) -> list[str]:
    """Copies with a character inserted, with two, and with one in every gap."""
    one = word
    copies = []
    for _ in range(2):
        at = int(rng.integers(1, max(2, len(one))))
        one = one[:at] + "*.-_1xq"[int(rng.integers(7))] + one[at:]
        copies.append(one)
    return [*copies, ".-*_"[int(rng.integers(4))].join(word)]


def _machine(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 2e-3) -> np.ndarray:
    """Squared-hinge linear machine by Newton steps; the last column is the bias."""
    x = np.c_[x, np.ones(len(x), np.float32)].astype(np.float64)
    w = np.zeros(x.shape[1])
    penalty = ridge * np.eye(x.shape[1])
    penalty[-1, -1] = 1e-6
    for _ in range(30):
        live = y * (x @ w) < 1
        a = x[live] * cost[live, None]
        new = np.linalg.solve(a.T @ x[live] + penalty, a.T @ y[live])
        if np.abs(new - w).max() < 1e-6:
            break
        w = new
    return w


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3) -> np.ndarray:
    """A logistic function by Newton steps; the last weight is the offset."""
    x = np.c_[x, np.ones(len(x))]
    w, pull = np.zeros(x.shape[1]), ridge * np.eye(x.shape[1])
    pull[-1, -1] = 1e-3
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull, x.T @ (p - y) + pull @ w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _distinct(bags: list[list[str]]) -> list[int]:
    """The bags that are no near copy of an earlier one: a copied text says
    nothing new about its words. Near copies share 8 of 16 least hashes."""
    keep, seen = [], {}
    mix = np.random.default_rng(SEED).integers(1, 2**63, 16, dtype=np.uint64) | np.uint64(1)
    for i, bag in enumerate(bags):
        if not bag:
            continue
        h = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in bag), np.uint64, len(bag))
        least = [(k, int(x)) for k, x in enumerate((((h[:, None] + np.uint64(1)) * mix) >> np.uint64(20)).min(axis=0))]
        met = Counter(j for x in least for j in seen.get(x, ()))
        if not met or max(met.values()) < 8:
            keep.append(i)
            for x in least:
                seen.setdefault(x, []).append(i)
    return keep


def train(texts: list[str], labels: list[int], landmarks: int = LANDMARKS) -> Model | None:
    """A model from labelled texts; None without texts of both classes."""
    bags = [sorted(tokens(t)) for t in texts]
    kept = _distinct(bags)
    whole = [[_strip(w) for w in words_of(texts[i])] for i in kept]
    bags, y = [bags[i] for i in kept], np.array([labels[i] for i in kept])
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(SEED)
    toxic, clean = [b for b, v in zip(bags, y, strict=True) if v], [b for b, v in zip(bags, y, strict=True) if not v]
    in_toxic, in_clean = Counter(w for b in toxic for w in b), Counter(w for b in clean for w in b)
    # how sure it is that a word prefers toxic texts: a log likelihood ratio; labels are noisy, so chance finds must stay out
    rate = len(toxic) / len(bags)

    def sure(w: str) -> float:
        a, b = in_toxic[w], in_clean.get(w, 0)
        share = a / (a + b)
        return 0.0 if share <= rate else a * np.log(share / rate) + (b * np.log((1 - share) / (1 - rate)) if b else 0.0)

    holders: dict[str, list[int]] = {}
    tried = sum(1 for n in in_toxic.values() if n >= 4)
    for least in (max(SURE[0], float(np.log(tried + 1.0))), *SURE):
        proven = {w: x for w in in_toxic if (x := sure(w)) > least}
        if len(proven) >= 5:
            break
    for i, b in enumerate(toxic):
        for w in b:
            if w in proven:
                holders.setdefault(w, []).append(i)
    # landmarks of the toxic class, by turns the best by what it adds to the texts covered so far
    chosen: list[str] = []
    cover = np.zeros(len(toxic))
    ranked = sorted(holders, key=lambda w: (-proven[w], w))[:2000]
    while ranked and len(chosen) < landmarks - CLEAN_LANDMARKS:
        best = max(ranked, key=lambda w: (sum(0.5 ** cover[i] for i in holders[w]), proven[w], w))
        chosen.append(best)
        ranked.remove(best)
        cover[holders[best]] += 1
    if not chosen:
        return None
    common = [w for w, _ in sorted(in_clean.items(), key=lambda x: (-x[1], x[0])) if w not in proven][:400]
    marks = chosen + [common[i] for i in sorted(rng.choice(len(common), min(CLEAN_LANDMARKS, len(common)), replace=False))]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(np.float64))
    kept = values > 1e-4
    root = vectors[:, kept] / np.sqrt(values[kept])
    lift = lambda ws: kernel(ws, marks) @ root

    place = np.zeros(CODES**3)
    negatives = sorted(w for w in in_clean if w not in proven)
    ease = rng.permutation(len(negatives))
    hard = [negatives[i] for i in ease[:8000]]
    # the first positives are proven words; later ones are all that stand out in a toxic text
    picks = [w for w in holders for _ in holders[w]]
    model = None
    for turn in range(ROUNDS):
        strong = Counter(picks)
        pos = sorted(strong, key=lambda w: (-strong[w], w))[:POSITIVES]
        noisy = [x for w in pos for x in _noised(w, rng)]
        xs = np.r_[lift(pos), lift(noisy), lift(hard)]
        ys = np.r_[np.ones(len(pos) + len(noisy)), -np.ones(len(hard))]
        cost = np.r_[[min(20.0, strong[w]) for w in pos], np.repeat([min(20.0, strong[w]) / 3 for w in pos], 3), [min(20.0, in_clean[w] ** 0.5) for w in hard]]
        w = _machine(xs, ys, cost)
        alpha = root @ w[:-1]
        place[:] = 0
        for j, mark in enumerate(marks):
            for _, seen, weight in features([mark]):
                np.add.at(place, seen[0], alpha[j] * weight)
        model = Model(place.astype(np.float32), float(w[-1]))
        if turn == ROUNDS - 1:
            break
        every = model.margins(negatives)
        worst = np.argsort(-every, kind="stable")[:4000]
        hard = sorted({negatives[i] for i in worst} | {negatives[i] for i in ease[: 4000]})
        picks = []
        for b in toxic:  # a text in which nothing stands out is taken for a wrong label
            m = model.margins(b)
            picks += [w for w, x in zip(b, m.tolist(), strict=True) if w in proven or x > 0.5 and not in_clean.get(w)]
    model.final = _logistic(np.array([summary(model.margins(w), model.bias) for w in whole]), y)
    return model


def _scorer(model: Model | None, name: str = "score"):
    def run(batches):
        known: dict[str, float] = {}
        for rb in batches:
            scores: list[float] = []
            for s in range(0, rb.num_rows if model else 0, 500):
                sets = [words_of(t or "") for t in rb.column(1).slice(s, 500).to_pylist()]
                if len(known) > CACHE:
                    known.clear()
                new = [w for w in set().union(*sets) if w not in known]
                known.update(zip(new, model.margins([_strip(w) for w in new]).tolist(), strict=True))
                scores += [model.probability(np.fromiter(map(known.__getitem__, own), np.float32, len(own))) for own in sets]
            yield pa.RecordBatch.from_arrays([*rb.columns[2:], pa.array(scores if model else [0.0] * rb.num_rows, pa.float64())], [*rb.schema.names[2:], name])

    return run


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, chars: int = SAMPLE_CHARS, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model | None:
    """Train on at most ``sample`` labelled texts, half of them toxic at most."""
    per = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).alias("toxic")).filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    per = per.filter(F.crc32(F.col("doc_id").cast("string")) % 4 != 2).withColumn("order", F.xxhash64("doc_id"))
    ids = {r.doc_id: int(r.toxic) for kind, n in ((1, sample // 3), (0, sample - sample // 3)) for r in per.filter(F.col("toxic") == kind).orderBy("order", "doc_id").limit(n).select("doc_id", "toxic").collect()}
    if not ids:
        return None
    wanted = docs.sparkSession.createDataFrame([(i,) for i in ids], "doc_id long")
    rows = (
        docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
        .filter(F.col("text").isNotNull() & (F.length("text") <= chars))
        .join(F.broadcast(wanted), "doc_id", "left_semi")
        .groupBy("doc_id")
        .agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
        .collect()
    )
    rows = sorted((r.doc_id, r.text) for r in rows)
    return train([t for _, t in rows], [ids[i] for i, _ in rows])


def score(docs: DataFrame, model: Model | None, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
    slim = docs.select(F.lit(0).alias("none"), F.col(text_col).alias("text"), F.col(id_col).cast("long").alias("doc_id"), held.alias("held_out"))
    out = slim.mapInArrow(_scorer(model), "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the model does not call toxic; whole rows pass through
    one map, nothing is joined."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    names, own = [F.col(f"`{c}`") for c in docs.columns], free_name(docs, "score")
    carried = docs.select(F.lit(0).alias(f"{own}1"), F.col("text").alias(f"{own}2"), *names)
    kept = carried.mapInArrow(_scorer(model, own), StructType([*docs.schema.fields, StructField(own, DoubleType())]))
    return kept.filter(F.col(own) < THRESHOLD).select(names)
