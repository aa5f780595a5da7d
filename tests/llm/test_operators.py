"""The training-data operators against brute force, round trips and held-out
accuracy, and their defined results for odd input."""

import collections
import hashlib
import html
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ravelin.llm import bpe, fertility, gif, html_blocks, html_extract, html_model, mixing, secrets, simhash, substring, toxicity, urls
from ravelin.llm.common import vocabulary

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, texts, schema=SCHEMA):
    return spark.createDataFrame([(i, t, "en", f"src{i % 3}", len(t or "")) for i, t in enumerate(texts)], schema)


def odd(spark):
    """Nulls, empty and blank texts, repeats, a long text, clashing columns."""
    rows = [(1, None, None, None), (2, "", "en", "b"), (2, "", "en", "b"), (3, " \n\t", None, "a"), (None, "some words here", "en", None), (None, None, None, None), (5, "w " * 30_000, "xx", "b"), (6, "x" * 50_000, "en", "a"), (7, "é 中 🎉 \u00a0", "fr", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for clash in ("fp", "key", "block", "size", "score", "band", "spans", "blob", "component_id", "taken", "rule"):
        df = df.withColumn(clash, F.lit("clash"))
    return df


# 1


def brute_components(fps, ids):
    parent = list(range(len(fps)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in np.flatnonzero(np.bitwise_count(fps ^ fps[i]) <= 3):
            a, b = root(i), root(int(j))
            parent[max(a, b)] = min(a, b)
    least = {}
    for i, d in enumerate(ids):
        least[root(i)] = min(least.get(root(i), d), d)
    return [least[root(i)] for i in range(len(fps))]


def test_fingerprint_is_the_majority_of_hashes():
    import xxhash

    text = "The Quick\tbrown  FOX jumps é"
    words = ["the", "quick", "brown", "fox", "jumps", "é"]
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + 3]).encode(), 42) for i in range(4)]
    want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > 4)
    assert simhash.fingerprint(text.encode()) == want
    assert simhash.fingerprint(b" \n") == 0
    assert simhash.fingerprint(b"One two") == xxhash.xxh64_intdigest(b"one two", 42)


@pytest.mark.parametrize("most", [4096, 8])
def test_links_find_every_component(spark, most):
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 2**64, 40, dtype=np.uint64)
    fps = [int(c) for c in centres]
    for c in centres[:12]:  # near copies, also chains and a dense ball
        at = int(c)
        for _ in range(12):
            at ^= sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 5), replace=False))
            fps.append(at)
    fps = np.array(sorted(set(fps)), np.uint64)
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    found = {r.node: r.component for r in simhash.components(simhash.links(df, most)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, list(range(len(fps))))


def test_near_duplicates_of_odd_input(spark):
    out = simhash.near_duplicates(odd(spark)).collect()
    assert len(out) == 9
    zero = [r for r in out if r.fingerprint == "0" * 16]
    assert len(zero) == 5 and {r.component_id for r in zero} == {1}
    assert simhash.near_duplicates(odd(spark).limit(0)).count() == 0
    kept = simhash.stage(spark, odd(spark), "")
    assert kept.columns == odd(spark).columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 0, 1, 5, 6, 7]


def test_deep_buckets_are_split(spark):
    """Fingerprints that agree on 40 bits: every level of splitting is used."""
    rng = np.random.default_rng(9)
    fps = np.unique(rng.integers(0, 2**24, 3000, dtype=np.uint64) << np.uint64(20))
    df = spark.createDataFrame([(int(f), i) for i, f in enumerate(fps.view(np.int64))], "fp long, rep long")
    found = {r.node: r.component for r in simhash.components(simhash.links(df, 60)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_components(fps, list(range(len(fps))))


def shingles(text, n=5):
    w = text.lower().split()
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def test_similar_texts_are_found(spark):
    rng = random.Random(6)
    words = [f"w{i}" for i in range(3000)]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(60, 300))) for _ in range(150)]
    pairs = []
    for i in range(150):
        w = texts[i].split()
        for _ in range(max(1, int(len(w) * rng.choice([0.002, 0.01, 0.015, 0.05, 0.1])))):
            w[rng.randrange(len(w))] = rng.choice(words)
        texts.append(" ".join(w))
        a, b = shingles(texts[i]), shingles(texts[-1])
        pairs.append((len(a & b) / len(a | b), i, len(texts) - 1))
    of = {r.doc_id: r.least_id for r in simhash.similar_texts(frame(spark, texts)).collect()}
    close = [of[a] == of[b] == a for j, a, b in pairs if j >= 0.8]
    assert len(close) > 50 and np.mean(close) >= 0.93
    assert all(of[a] != of[b] for j, a, b in pairs if j < 0.6) and all(of[i] == i for i in range(150))
    kept = {r.doc_id for r in simhash.stage(spark, frame(spark, texts), "").collect()}
    assert kept == {i for i in of if of[i] == i}


@pytest.mark.parametrize("short", [64, 0])
def test_links_of_wide_fingerprints(short, monkeypatch):
    monkeypatch.setattr(simhash, "SHORT", short)
    rng = np.random.default_rng(2)
    wide = rng.integers(0, 2**64, (200, 4), dtype=np.uint64)
    for k in range(60, 200):  # chains and balls around the first ones
        wide[k] = wide[rng.integers(0, k)]
        for b in rng.choice(256, rng.integers(1, 60), replace=False):
            wide[k, b // 64] ^= np.uint64(1 << (b % 64))
    key = np.sort(rng.integers(0, 3, 200))

    def classes(links):
        parent = list(range(200))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in links:
            parent[max(root(a), root(b))] = min(root(a), root(b))
        return [root(x) for x in range(200)]

    every = [(a, b) for a in range(200) for b in range(a) if key[a] == key[b] and simhash._apart(wide[a], wide[b]) <= 38]
    found = simhash.wide_links(key, wide, 38)
    assert set(map(frozenset, found)) <= set(map(frozenset, every)) and classes(found) == classes(every)


def test_wide_pivots_discard_pairs_before_they_are_verified(monkeypatch):
    rng = np.random.default_rng(4)
    wide = rng.integers(0, 2**64, (640, 4), dtype=np.uint64)
    for k in range(1, 640, 2):  # each second row is near the one before
        wide[k] = wide[k - 1] ^ np.array([0xFF, 0xFF00, 0, 0xFF], np.uint64)
    key, verified, apart = np.repeat(np.arange(10), 64), [], simhash._apart
    monkeypatch.setattr(simhash, "_apart", lambda a, b: (verified.append(len(a)), apart(a, b))[1])
    assert sorted(map(sorted, simhash.wide_links(key, wide, 38))) == [[k, k + 1] for k in range(0, 640, 2)]
    assert 320 <= sum(verified) < 0.05 * 10 * 64 * 63 / 2
    # no coordinate differs by more than the fingerprints do
    d = np.abs(simhash.wide_distances(wide)[1:] - simhash.wide_distances(wide)[:-1]).sum(axis=2)
    assert (d <= apart(wide[1:], wide[:-1])[:, None]).all()
    # copies give one link less than there are rows, not all pairs
    assert len(simhash.wide_links(np.zeros(60, int), np.repeat(wide[:1], 60, axis=0), 38)) == 59


@pytest.mark.parametrize("bits", [16, 17, 24, 33])
def test_keys_of_blocks_are_rows_of_the_pivot_table(bits):
    blocks = np.unique(np.random.default_rng(bits).integers(0, 2**bits, 50_000, dtype=np.uint64))
    assert len(np.unique(simhash.table_codes(blocks, bits))) > 0.999 * len(blocks)
    assert (simhash.table_codes(np.stack([blocks, blocks]), bits)[1] == simhash.table_codes(blocks, bits)).all()


def test_null_ids_link_texts(spark, monkeypatch):
    # 9 and 4 are near only the fingerprint of a row without an id; a pair without ids stays null
    fps = [(9, 0), (None, 0b111), (4, 0b111111), (7, -1), (None, 0xFFFF << 20), (None, 0xFFFF << 20 | 1), (None, -2), (3, 0xFF << 50)]
    made = spark.createDataFrame(fps, "doc_id long, fp long")
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: made)
    got = {(r.doc_id, int(r.fingerprint, 16)): r.component_id for r in simhash.near_duplicates(made).collect()}
    want = [4, 4, 4, 7, None, None, 7, 3]
    assert got == {(i, f % 2**64): w for (i, f), w in zip(fps, want, strict=True)}


# 2


def made_toxic(n, seed):
    rng = random.Random(seed)
    syll = "ka lo mi ren tas vel dor in an ou par".split()
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randint(1, 3)))
    texts, labels = [], []
    for _ in range(n):
        words = [word() for _ in range(rng.randint(10, 60))]
        bad = rng.random() < 0.3
        for _ in range(rng.randint(2, 3) if bad else 0):
            words[rng.randrange(len(words))] = rng.choice(["wretch", "scoundrel", "imbecile", "dunce", "buffoon"])
        texts.append(" ".join(words))
        labels.append(int(bad))
    return texts, labels


def test_toxicity_on_held_out_texts():
    texts, labels = made_toxic(500, 1)
    model = toxicity.train(texts, labels)
    score = lambda t: model.probability(model.margins([toxicity._strip(w) for w in toxicity.words_of(t)]))
    held, truth = made_toxic(200, 2)
    got = [int(score(t) >= 0.3) for t in held]
    assert sum(a == b for a, b in zip(got, truth, strict=True)) >= 190
    clean = "lomi katas velou doran parin miren"
    for insult in ("scoun-drel", "imbeeecile", "buffooon", "i m b e c i l e", "w.r.e.t.c.h"):
        assert score(f"{clean} {insult} {insult} {clean}") > 3 * score(clean)


def test_toxicity_reads_words_to_their_end():
    texts, labels = made_toxic(600, 3)
    model = toxicity.train(texts, labels)
    insult = max((w for t, v in zip(texts, labels, strict=True) if v for w in toxicity.tokens(t)), key=lambda w: model.margins([w])[0])
    for mark in "-_.,/":
        clean = mark.join(["kalo"] * 60)
        assert model.margins([f"{clean}{mark}{insult}"])[0] >= model.margins([insult])[0] > model.margins([clean])[0]
    clean = "kalo" * 60
    assert all(model.margins([clean[:at] + insult + clean[at:]])[0] > model.margins([clean])[0] for at in range(0, 241, 20))
    rng = random.Random(4)
    for n in (64, 65, 123, 124, 1000):
        word = "".join(rng.choice("abcdefghij-.") for _ in range(n))
        cut = toxicity.pieces(word)
        assert max(map(len, cut)) <= 64 and all(any(word[a : a + toxicity.SPAN] in x for x in cut) for a in range(n))


def test_kernel_is_a_dot_product_of_shared_subsequences():
    far = ["傻瓜蛋们", "笨猪头们", "أحمق", "غبيا", "मूर्ख", "बेवकूफ"]  # scripts beyond the first code points
    assert (np.abs(toxicity.kernel(far, far) - np.diag(np.diag(toxicity.kernel(far, far)))) < 0.5 * np.diag(toxicity.kernel(far, far)).min()).all()
    k = toxicity.kernel(["idiot", "idxiot", "table", "ab"], ["idiot"])[:, 0]
    assert np.isclose(k[0], 1.0, atol=0.4) and k[0] > k[1] > k[2] >= 0 and k[3] == 0
    both = toxicity.kernel(["idiot", "clown", "moron"], ["idiot", "clown", "moron"])
    assert np.allclose(both, both.T, atol=1e-5) and (np.linalg.eigvalsh(both) > -1e-5).all()


def brute_features(word):
    """Subsequences of three letters within SPAN letters, by hand."""
    padded = toxicity.EDGE + word + toxicity.EDGE
    found, norm = collections.defaultdict(float), 0.0
    for i in range(len(padded)):
        for j in range(i + 1, len(padded)):
            for k in range(j + 1, min(len(padded), i + toxicity.SPAN)):
                w = toxicity.DECAY ** (k - i - 2)
                found[padded[i] + padded[j] + padded[k]] += w
                norm += w * w
    return {f: w / norm**0.5 for f, w in found.items()}


def test_kernel_and_margins_by_brute_force():
    rng = random.Random(8)
    words = ["".join(rng.choice("abcdez09") for _ in range(rng.randint(3, 9))) for _ in range(40)]
    maps = [brute_features(w) for w in words]
    want = [[sum(x * b.get(f, 0.0) for f, x in a.items()) for b in maps[:12]] for a in maps]
    assert np.allclose(toxicity.kernel(words, words[:12]), want, atol=1e-5)
    weights = np.random.default_rng(1).normal(size=toxicity.CODES**3).astype(np.float32)
    code = lambda c: int(toxicity._code_table()[ord(c)])
    place = lambda f: (code(f[0]) * toxicity.CODES + code(f[1])) * toxicity.CODES + code(f[2])
    got = toxicity.Model(weights, 0.25).margins([*words, "ab"])
    assert np.allclose(got[:-1], [0.25 + sum(x * weights[place(f)] for f, x in m.items()) for m in maps], atol=1e-4) and got[-1] == toxicity.SHORT


def test_toxicity_of_odd_input(spark, monkeypatch):
    texts, labels = made_toxic(200, 4)
    model = toxicity.train(texts, labels)
    out = toxicity.score(odd(spark), model).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in out)
    assert {r.held_out for r in out if r.doc_id is None} == {False}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in out if r.doc_id is not None)
    assert toxicity.train(["a b c"], [1]) is None
    assert {r.score for r in toxicity.score(odd(spark), None).collect()} == {0.0}
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(odd(spark), none) is None
    many = frame(spark, texts).unionByName(frame(spark, ["another text"] * 3).withColumn("doc_id", F.lit(1).cast("long")))
    marks = spark.createDataFrame([(i, v) for i, v in enumerate(labels)], "doc_id long, toxic int")
    assert toxicity.fit(many, marks) is not None
    monkeypatch.setattr(toxicity, "table", lambda *a: marks)
    clash = frame(spark, texts).withColumn("score", F.lit("clash")).withColumn("Score1", F.lit(1))
    kept = toxicity.stage(spark, clash, "")
    assert kept.columns == clash.columns and {r.score for r in kept.collect()} == {"clash"}
    by_hand = toxicity.score(clash, toxicity.fit(clash, marks)).filter("predicted = 0")
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in by_hand.collect())
    assert toxicity.score(odd(spark).limit(0), model).count() == 0


# 3


def brute_substring(rows):
    seen, out = {}, {}
    windows = []
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        for a in range(len(w) - 19):
            key = tuple(w[a : a + 20])
            place = (float("inf") if i is None else i, a)
            seen[key] = min(seen.get(key, place), place)
            windows.append((k, a, key, place))
    gone = collections.defaultdict(set)
    for k, a, key, place in windows:
        if place > seen[key]:
            gone[k].update(range(a, a + 20))
    for k, (i, t) in enumerate(rows):
        w = (t or "").encode().split()
        out.setdefault((i, len(w), len(gone[k]), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone[k])).hexdigest()), 0)
        out[(i, len(w), len(gone[k]), hashlib.sha256(b" ".join(x for j, x in enumerate(w) if j not in gone[k])).hexdigest())] += 1
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_is_exact(spark, seed, monkeypatch):
    rng = random.Random(seed)
    passages = [[f"p{k}w{j}" for j in range(rng.randint(15, 70))] for k in range(6)]
    rows = []
    for i in range(60):
        words = []
        for _ in range(rng.randint(0, 5)):
            if rng.random() < 0.5:
                p = rng.choice(passages)
                a = rng.randint(0, 5)
                words += p[a : len(p) - rng.randint(0, 5)]
            else:
                words += [f"u{rng.randint(0, 3)}" for _ in range(rng.randint(1, 30))]
        rows.append((rng.choice([i, i, i // 2, None]), "\n ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    monkeypatch.setattr(substring, "RANGE_BYTES", 1 << 20 if seed == 1 else 2048)  # few or many ranges
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(df).collect())
    assert got == brute_substring(rows)


@pytest.mark.parametrize("most", [7, 1 << 20])
def test_ranges_are_worked_on_in_parts(most, monkeypatch):
    rng = np.random.default_rng(4)
    monkeypatch.setattr(substring, "AT_ONCE", most)
    blocks = [rng.choice(60, rng.integers(1, 30), replace=False).astype(np.uint64) for _ in range(20)]
    twice = rng.random(20) < 0.2
    batch = pa.RecordBatch.from_pydict({"block": [str(i) for i in range(20)], "twice": twice.tolist(), "hashes": [b.tobytes() for b in blocks]})
    times = collections.Counter(int(x) for b, t in zip(blocks, twice, strict=True) for x in b for _ in range(1 + t))
    got = {b: np.frombuffer(a, np.uint64).tolist() for rb in substring._repeated(iter([batch])) for b, a in zip(rb["block"].to_pylist(), rb["answer"].to_pylist(), strict=True)}
    assert got == {str(i): hit for i, b in enumerate(blocks) if (hit := [x for x in b.tolist() if times[x] > 1])}

    rows, first = [], {}
    for k in range(30):
        own = rng.integers(0, 9, 5).astype(np.uint64)
        run = np.array([(int(rng.integers(0, 2)), int(rng.integers(0, 20)), 0, int(rng.integers(0, 50)), 5)], substring._ASK)
        rows.append((str(k), run, own))
        for j, o in enumerate(own.tolist()):
            at = (int(run["anchor"][0]), o), (int(run["doc"][0]), int(run["at"][0]) + j)
            first[at[0]] = min(first.get(at[0], at[1]), at[1])
    batch = pa.RecordBatch.from_pydict({"block": [b for b, _, _ in rows], "runs": [r.tobytes() for _, r, _ in rows], "own": [o.tobytes() for _, _, o in rows]})
    got = {(b, int(r["at"]) + j) for rb in substring._earliest(iter([batch])) for b, a in zip(rb["block"].to_pylist(), rb["answer"].to_pylist(), strict=True) for r in np.frombuffer(a, substring._RUN) for j in range(r["n"])}
    want = {(b, int(r["at"][0]) + j) for b, r, own in rows for j, o in enumerate(own.tolist()) if (int(r["doc"][0]), int(r["at"][0]) + j) != first[int(r["anchor"][0]), o]}
    assert got == want


def test_substring_dedup_of_odd_input(spark):
    rows = [(r.doc_id, r.text) for r in odd(spark).collect()]
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.substring_dedup(odd(spark)).collect())
    assert got == brute_substring(rows)
    assert substring.substring_dedup(odd(spark).limit(0)).count() == 0


# 4

BASE = [("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6), ("access", re.compile("AKIA[A-Z0-9]+"), 0, 20), ("hex", re.compile("[0-9a-f]+"), 0, 24)]


def brute_spans(text):
    found = []
    for k, (name, p, group, least) in enumerate(BASE):
        found += [(m.start(), k, m.end(), name) for m in p.finditer(text or "") if len(m.group(group)) >= least]
    return ",".join(f"{n}:{a}:{b}" for a, _, b, n in sorted(found))


def test_secret_spans(spark):
    rng = random.Random(1)
    parts = ["password", "=", ":", " ", '"', "api_key", "TOKEN", "secret", "abcdef", "0123456789abcdef01234567", "AKIA", "ABCDEFGH12345678", "é", "🎉", "x", "'", "\n", "Passwd=hunter22"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(400)]
    out = {r.doc_id: r for r in secrets.scan(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        want = brute_spans(t)
        assert out[i].base_sha256 == hashlib.sha256(want.encode()).hexdigest(), t
        assert [out[i].n_assign, out[i].n_access, out[i].n_hex] == [sum(x.startswith(k) for x in want.split(",")) for k in ("assign", "access", "hex")]


def test_ledger_scans_only_what_is_new(spark, tmp_path):
    path = str(tmp_path / "ledger")
    texts = ["password = abcdef1", "clean", "password = abcdef1"]
    first = secrets.scan(frame(spark, texts), path).collect()
    assert spark.read.parquet(path).count() == 2 and sum(r.n_assign for r in first) == 2
    secrets.scan(frame(spark, [*texts, "new"]), path).collect()
    assert spark.read.parquet(path).count() == 3
    rules = (*secrets.RULES, ("pin", 1, r"PIN-\d{4}", 0, 0, ("pin-",)))
    again = secrets.scan(frame(spark, [*texts, "PIN-1234"]), path, rules).collect()
    # the three old blobs are tried with the new rule alone, the new one with all
    tried = sorted(len(r.rules) for r in spark.read.parquet(path).collect())
    assert tried == [1, 1, 8, 8, 8, 9] and any("pin:0:8" in r.spans for r in again)
    assert sum(r.n_assign for r in again) == 2
    # another version of a rule is another rule, and what the old one found is not its finding
    changed = tuple((k, 2, "clean", 0, 0, ()) if k == "hex" else (k, *x) for k, *x in secrets.RULES)
    third = {r.doc_id: r for r in secrets.scan(frame(spark, texts), path, changed).collect()}
    assert [third[i].n_hex for i in range(3)] == [0, 1, 0] and third[0].n_assign == 1
    # a ledger that holds the findings redacts without a scan of its own
    docs = frame(spark, texts)
    before = spark.read.parquet(path).count()
    assert [r.text for r in secrets.redact(docs, ledger_path=path).orderBy("doc_id").collect()] == ["[SECRET]", "clean", "[SECRET]"]
    assert spark.read.parquet(path).count() == before


def test_query_reads_a_part_filled_ledger(spark, monkeypatch):
    asked = []
    scan_blobs = secrets.scan_blobs
    monkeypatch.setattr(secrets, "scan_blobs", lambda docs, ledger, *a, **k: asked.append(None if ledger is None else ledger.count()) or scan_blobs(docs, ledger, *a, **k))
    texts = [f"token: abcdef{i % 40}" for i in range(200)]
    out = secrets.scan(frame(spark, texts), increments=secrets.INCREMENTS).collect()
    assert asked[0] is None and 0 < asked[1] <= 40 and sum(r.n_assign for r in out) == 200


def test_many_spans(spark):
    text = "token=abcdef1 é " * 5000
    r = secrets.scan(frame(spark, [text])).first()
    assert r.n_assign == 5000 and r.base_sha256 == hashlib.sha256(brute_spans(text).encode()).hexdigest()
    assert secrets.redact(frame(spark, [text])).first().text == "[SECRET] é " * 5000
    assert secrets.scan(frame(spark, ["token=abcdef1"] * 3000)).filter("n_assign = 1").count() == 3000  # a hot blob


def test_secrets_of_odd_input_and_redaction(spark):
    out = secrets.scan(odd(spark)).collect()
    assert len(out) == 9 and {r.spans for r in out} == {""}
    docs = frame(spark, ["a token: abcdef99 b", None, "🎉 password=secret=token=123456 x", "ffffffffffffffffffffffff"])
    clean = secrets.redact(docs).orderBy("doc_id").collect()
    assert [r.text for r in clean] == ["a [SECRET] b", None, "🎉 [SECRET] x", "[SECRET]"]
    assert [r.n_chars for r in clean] == [12, 0, 12, 8]
    assert secrets.scan(odd(spark).limit(0)).count() == 0
    clash = odd(spark)
    for c in ("null", "clean", "rules", "known", "every", "low"):
        clash = clash.withColumn(c, F.lit("clash"))
    kept = secrets.redact(clash)
    assert kept.columns == clash.columns and collections.Counter(map(tuple, kept.collect())) == collections.Counter(map(tuple, clash.collect()))


# 5


def test_bpe_is_the_librarys(spark):
    from tokenizers import Tokenizer

    enc, own = bpe.encoding(vocabulary(bpe.VOCABULARY)), Tokenizer.from_file(vocabulary(bpe.VOCABULARY))
    rng = random.Random(1)
    mixed = ["a", "b", " ", "  ", "\n", "é", "ß", "中", "🎉", "'s", "'", "1", "the", " the", "ing", "!", "\t", "<|endoftext|>", "\u00a0", "\u0301", "'ll", "ſ"]
    letters = ["a", "b", "th", "ing", "é", "n", "s", "Q"]
    for k in range(2500):
        t = "".join(rng.choice(mixed if k % 2 else letters) for _ in range(rng.randint(0, 90)))
        ids = bpe.encode(enc, t, rng.choice([5, 9, 20]), rng.choice([1, 2, 4]))
        want = own.encode(t, add_special_tokens=False).ids
        assert ids == want, t
        assert bpe.decode(enc, ids) == own.decode(want, skip_special_tokens=False) == t
    long = "ab" * 40_000
    assert bpe.encode(enc, long) == own.encode(long, add_special_tokens=False).ids


def test_bpe_tables(spark):
    out = bpe.round_trip(odd(spark)).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(out) == 9 and sum(r.n_tokens == 0 and r.ids_sha256 == empty for r in out) == 4
    back = bpe.decode_table(bpe.encode_table(odd(spark))).collect()
    assert collections.Counter((r.doc_id, r.text) for r in back) == collections.Counter((r.doc_id, r.text or "") for r in odd(spark).collect())
    assert bpe.round_trip(odd(spark).limit(0)).count() == 0


# 6


def test_url_rules(spark):
    cases = {
        "http://example.com/en/1": ("com/", None),
        None: ("", "allow"),
        "no scheme example.com/en/": ("", "allow"),
        "https://WWW.Example.COM/en/x?y#z": ("www.example.com/en/", "allow"),
        "https://a.b.example.com/en/": ("example.com/en/", "block"),
        "https://notexample.com/en/": ("com/", "allow"),
        "https://x.net/es/a": ("net/es/", "block"),
        "https://x.net/ES/a": ("", "allow"),
        "https://example.com": ("", "allow"),
        "https://example.com?/en/": ("", "allow"),
        "x://y://z.net/fr/": ("", "allow"),
        "https://casino.example.org/a": ("", "block"),
        "https://m.best-casino.example.org/a": ("", "block"),
        "https://alphabets.example.org/": ("", "allow"),
        "https://sussexxx.ac.uk/": ("", "allow"),
        "https://" + "a." * 3000 + "net/fr/": ("net/fr/", "block"),
        "https://casino.com/": ("com/", "allow"),
        "https://net/fr/": ("net/fr/", "block"),
    }
    cases["http://example.com/en/1"] = ("example.com/en/", "block")
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(cases)], "page_id long, url string, short string")
    out = {r.page_id: r for r in urls.judge(df.unionByName(df)).collect()}
    for i, (u, (rule, verdict)) in enumerate(cases.items()):
        assert ((out[i].rule or ""), out[i].verdict) == (rule, verdict), u
    assert urls.judge(df.unionByName(df)).count() == 2 * len(cases) and urls.judge(df.limit(0)).count() == 0
    assert (out[3].host, out[3].path, out[8].path) == ("www.example.com", "/en/x", "")


# 7


def test_fertility_counts_and_bands(spark):
    rng = random.Random(1)
    good = [" ".join(rng.choice("the quick brown fox jumps over lazy dogs while seven wizards brew strong potions under pale moons near quiet rivers".split()) + rng.choice(["", ",", "s"]) for _ in range(rng.randint(60, 200))) for _ in range(60)]
    junk = [" ".join(f"{rng.choice('abcdefgh')}#{rng.randint(0, 99)}$%&" for _ in range(120)) for _ in range(5)]
    out = {r.doc_id: r for r in fertility.judge(frame(spark, good + junk)).collect()}
    assert all(out[i].kept for i in range(60) if not out[i].base_failed) and not any(out[60 + i].kept for i in range(5))
    text = "a b c a b c\nx y\n \nx y\n# $x"
    r = fertility.judge(frame(spark, [text])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept) == (12, 13, 2, 1, 6, True, False)
    out = fertility.judge(odd(spark)).collect()
    assert len(out) == 9 and not any(r.kept for r in out if not r.n_words)
    assert fertility.judge(odd(spark).limit(0)).count() == 0
    assert fertility.judge(odd(spark).drop("lang")).count() == 9


def test_fertility_by_brute_force(spark):
    import base64

    import public_tokenizers
    import sentencepiece
    import tiktoken

    rng = random.Random(4)
    pools = {"en": "the quick brown fox jumps over lazy dogs while wizards brew it's 42 #tag potions".split(), "ru": "мир труд май слово дело время рука".split(), "zz": "naïve café 中文 字 🎉 x1y2 ünïcode".split()}
    rows = []
    for i in range(150):
        lang = rng.choice([*pools, None])
        pool = pools.get(lang, pools["en"])
        words = [rng.choice(pool) if rng.random() < 0.9 else "".join(rng.choice("qzxj#é~") for _ in range(9)) for _ in range(rng.choice([5, 60, 90, 200]))]
        if rng.random() < 0.1:
            words = words[:3] * 30
        rows.append((i, rng.choice([" ", "\n", " \n"]).join(words) + rng.choice(["", "\na b\na b", "\n"]), lang))
    with open(vocabulary(fertility.BYTES), "rb") as f:
        bpe_ = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks={base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}, special_tokens={})
    pieces = sentencepiece.SentencePieceProcessor(model_file=vocabulary(fertility.PIECES))
    want = {}
    for i, text, lang in rows:
        w = text.split()
        grams = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        covered = {j + k for j in range(len(w) - 2) for k in range(3) if grams[tuple(w[j : j + 3])] > 1}
        lines = [x for x in text.split("\n") if x.strip()]
        ids = [t for x in w for t in pieces.encode(x)]
        share = [n / len(ids) for n in collections.Counter(ids).values()]
        chars = sum(map(len, w))
        script = collections.Counter()
        for x in w:
            first = next((c for c in x if c.isalpha()), None)
            if first:
                script["latin" if ord(first) < 0x250 else "cyrillic" if 0x400 <= ord(first) < 0x530 else "kana_han"] += len(x)
        name = max(script, key=lambda x: (script[x], -fertility.SCRIPTS.index(x))) if script else "other"
        want[i] = {
            "n_words": len(w), "word_chars": chars, "n_symbols": sum(text.count(c) for c in "#*$%&|<>"), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": len(covered),
            "base_failed": len(w) < 50 or 100 * len(covered) > 50 * len(w), "band": f"{name}:{lang}" if lang in fertility.LANGS else name,
            "bpe_chars": chars / sum(len(bpe_.encode_ordinary(" " + x)) for x in w), "piece_chars": chars / len(ids), "fallback": sum(pieces.IsByte(t) for t in ids) / len(ids), "entropy": -sum(p * np.log2(p) for p in share),
        }
    middle = lambda values: sorted(values)[(len(values) + 1) // 2 - 1]  # noqa: E731 - the percentile is one of the values
    for r in want.values():
        band = [x for x in want.values() if x["band"] == r["band"]]
        inside = r["fallback"] <= middle([x["fallback"] for x in band]) + fertility.MAX_FALLBACK
        for x, (below, above, least) in fertility.BANDS.items():
            mid = middle([b[x] for b in band])
            off = middle([abs(b[x] - mid) for b in band])
            inside &= mid - max(below * off, least * mid) - 1e-9 <= r[x] <= mid + max(above * off, least * mid) + 1e-9
        r["kept"] = inside and not r["base_failed"]
    out = {r.doc_id: r for r in fertility.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    for i, r in want.items():
        for name, value in r.items():
            assert out[i][name] == (pytest.approx(value, abs=1e-9) if isinstance(value, float) else value), (i, name)
    assert {r["kept"] for r in want.values()} == {True, False}


# 8

#: A known small file (ten by ten pixels in three colours) and its samples' first and last rows.
SAMPLE = bytes.fromhex("47494638396 10A000A00910000FFFFFFFF00000000FF00000021F9040000000000 2C000000000A000A000002168C2D99872A1CDC33A00275EC95FAA8DE608C04914C01003B".replace(" ", ""))


def test_gif_of_others():
    (left, top, w, h, samples, palette, _), *_ = gif.images(SAMPLE)
    assert (left, top, w, h) == (0, 0, 10, 10)
    assert samples[0].tolist() == [1] * 5 + [2] * 5 and samples[9].tolist() == [2] * 5 + [1] * 5
    assert next(gif.decode(SAMPLE)).rgba[0, 0].tolist() == [255, 0, 0, 255]


def test_lzw_round_trips():
    rng = random.Random(3)
    for n in (0, 1, 2, 300, 4096, 60_000):
        for data in (os.urandom(n), b"a" * n, bytes(rng.choice(b"ab ") for _ in range(n))):
            assert gif.lzw_decode(gif.lzw_encode(data), 8, n + 3) == data


def film(*frames):
    """Two by one pixels, four colours: (samples, disposal, transparent, delay)."""
    out = [b"GIF89a", b"\x02\x00\x01\x00\x91\x00\x00", bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])]
    for samples, disposal, clear, delay in frames:
        codes = [4, *samples, 5]  # widths 3, 3, 3, 3: clear, two samples, end
        bits = sum(c << 3 * i for i, c in enumerate(codes))
        out += [b"\x21\xf9\x04", bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0, 0]), b"\x2c\0\0\0\0\x02\0\x01\0\0\x02", b"\x02" + bits.to_bytes(2, "little") + b"\0"]
    return b"".join([*out, b"\x3b"])


def test_disposal_transparency_and_time():
    f = list(gif.decode(film(([1, 2], 1, None, 5), ([3, 0], 3, 0, 7), ([0, 3], 2, 0, 1), ([0, 1], 0, 0, 2))))
    colour = lambda k: [tuple(p) for p in f[k].rgba[0].tolist()]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert [colour(k) for k in range(4)] == [[red, green], [blue, green], [red, blue], [none, red]]
    assert [(x.start_ms, x.duration_ms) for x in f] == [(0, 50), (50, 70), (120, 10), (130, 20)]


def test_media_tables(spark):
    rows = [(1, bytearray(SAMPLE)), (2, bytearray(b"GIF89a")), (3, None), (4, bytearray(SAMPLE[:40])), (5, bytearray(film(([1, 2], 1, None, 5), ([3, 0], 1, 0, 7))))]
    out = gif.media_table(spark.createDataFrame(rows, "media_id long, data binary")).collect()
    assert sorted((r.media_id, r.frame if r.error is None else -1) for r in out) == [(1, 0), (2, -1), (3, -1), (4, -1), (5, 0), (5, 1)]
    assert sum(next(r for r in out if r.media_id == 1).histogram) == 100
    huge = bytearray(SAMPLE)
    huge[6:10] = b"\xff" * 4  # claims 65535 x 65535 pixels
    (r,) = gif.media_table(spark.createDataFrame([(6, huge)], "media_id long, data binary")).collect()
    assert r.error == "too large" and r.frame is None
    texts = ["x" * 64, "hello", "long " * 70_000]
    got = {r.doc_id: r for r in gif.store_texts(frame(spark, texts)).collect()}
    for i, t in enumerate(texts):
        data = t.encode()
        padded = data + b"\0" * (-len(data) % 64)
        assert (got[i].n_bytes, got[i].payload_bytes, got[i].payload_sha256, got[i].tail_crc32) == (len(data), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:]))
        film_ = got[i].frames
        assert [f.start_ms for f in film_] == [40 * k for k in range(len(film_))] and sum(sum(f.histogram) for f in film_) == len(padded)
        assert [sum(f.histogram[c * 21] for f in film_) for c in range(4)] == [sum(c * 64 <= b < c * 64 + 64 for b in padded) for c in range(4)]
    out = gif.store_texts(odd(spark)).collect()
    assert len(out) == 9 and {r.payload_bytes for r in out if r.n_bytes == 0} == {64}
    assert gif.store_texts(odd(spark).limit(0)).count() == 0


# 9


def test_mix_meets_its_targets(spark):
    rng = random.Random(2)
    rows = [(i, "w " * rng.randint(0, 40), rng.choice(["a", "b", "b", "b", "c", "é", None])) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(7)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again)) and len(out) == 3000
    of = dict((i, s) for i, _, s in rows)
    size, taken, target = collections.Counter(), collections.Counter(), {}
    for r in out:
        assert 0 <= r.taken <= 2 * r.size and (r.size == 0 or r.taken % r.size == 0)
        size[of[r.doc_id]] += r.size
        taken[of[r.doc_id]] += r.taken
        target[of[r.doc_id]] = r.target
    names = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    total, free, want = 1.5 * sum(size.values()), set(names), {}
    while free:
        left = total - sum(want.values())
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > 2 * size[s]}
        want |= {s: 2.0 * size[s] for s in full} if full else share
        free = free - full if full else set()
    for s in names:
        assert abs(target[s] - want[s]) < 1e-6 * (1 + want[s])
        assert abs(taken[s] - target[s]) <= 25


def test_mix_of_odd_input(spark):
    out = mixing.mix(odd(spark)).collect()
    assert len(out) == 9 and all(r.taken == 0 for r in out if r.size == 0)
    assert mixing.mix(odd(spark).limit(0)).count() == 0
    docs = frame(spark, ["a b c", "d e", "f g h i", ""])
    mixed = mixing.stage(spark, docs, "")
    assert mixed.columns == docs.columns and max(collections.Counter(r.doc_id for r in mixed.collect()).values()) <= 2

    clash = odd(spark)
    for c in ("mix", "mix1", "key", "m", "h", "rank", "cut"):
        clash = clash.withColumn(c, F.lit("clash"))
    mixed = mixing.stage(spark, clash, "")
    assert mixed.columns == clash.columns and all(r.mix == "clash" for r in mixed.collect())


def test_choice_of_documents_by_brute_force(spark):
    rng = random.Random(5)
    rows = [(i if rng.random() < 0.9 else None, "w " * rng.randint(0, 30) + str(i), rng.choice(["a", "b", "c", None])) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    figures = {r.source: r for r in mixing.targets(mixing.sizes(df)).collect()}
    lit = lambda x: F.lit(x)
    ranked = collections.defaultdict(list)
    for source, r in figures.items():
        f = r.target / r.source_size
        whole = int(f + 1e-12)
        own = mixing.sizes(df).filter(F.col("source").eqNullSafe(lit(source)))
        for x in own.select("doc_id", "size", "h", mixing._rank(lit(max(0.0, f - whole)), F.col("size"), lit(r.source_size / r.n_docs), F.col("doc_id"), F.col("h"), mixing.SEED, mixing.SIZE_POWER).alias("rank")).collect():
            ranked[source].append((x.rank, x.size, x.doc_id, whole))
    want = collections.Counter()
    for source, own in ranked.items():
        left = figures[source].target - own[0][3] * figures[source].source_size
        for rank, size, doc_id, whole in sorted(own, key=lambda x: (x[0] is None, x[0])):
            taken = rank is not None and size / 2 < left
            left = left - size if taken else -1 if rank is not None else left
            want[doc_id, size, size * (whole + taken)] += 1
    assert collections.Counter((r.doc_id, r.size, r.taken) for r in mixing.mix(df).collect()) == want


def test_ties_at_the_cut_meet_the_target(spark):
    texts = [(None, " ".join(["w"] * 10), "a")] * 500 + [(None, " ".join([f"x{i}"] * 10), "b") for i in range(500)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    taken = collections.Counter()
    for r in mixing.mix(df).collect():
        taken[r.target] += r.taken
    assert len(taken) == 2 and all(abs(t - n) <= 5 for t, n in taken.items())
    assert abs(mixing.stage(spark, df, "").count() * 10 - sum(taken)) <= 10


# 10


def test_labeller_on_pages_it_never_saw():
    model = html_model.trained()
    pages = html_model.training_pages(150, 99)
    got = html_model.label(model, [x for x, _ in pages])
    right = [a == (y > 0) for a, (_, y) in zip(got, pages, strict=True)]
    assert np.concatenate(right).mean() > 0.98


def test_blocks_and_texts(spark):
    page = '<!-- x --><html><head><title>T</title><script>var t="</p>";</script></head><body><nav><a href=/>Home</a></nav><article><h1>A  &amp;amp; b</h1><p>One <b>t</b>wo\n<br>three<p>four&nbsp;five</article><footer>&copy; x</footer>'
    assert [b.text for b in html_blocks.blocks(page)] == ["Home", "A &amp; b", "One two", "three", "four five", "© x"]
    rows = [(1, "u", page, "clash"), (2, None, None, ""), (3, "", "", ""), (None, "v", "<p", ""), (1, "u", page, "clash")]
    out = html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    assert [(r.page_id, r.url, r.text, r.n_chars) for r in out if r.page_id == 1] == [(1, "u", "A &amp; b One two three four five", 33)] * 2
    assert {(r.text, r.n_chars) for r in out if r.page_id != 1} == {("", 0)}
    assert html_extract.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_odd_markup_takes_linear_time():
    n = 30_000
    assert len(html_blocks.blocks("<div>x" * n)) == n
    for page in ('<a href="x>y ' * n + "'", '<p title="abc ' * n, "<a <a " * n, "<div>" * n + "</span></section>" * n + "<li>x" * n):
        html_blocks.blocks(page)
    assert [b.text for b in html_blocks.blocks("a < b <p title='x>y'>c <i d")] == ["a < b", "c <i d"]
    deep = html_blocks.blocks("<nav><div class=menu>" + "<div>" * 3000 + "x")[0]
    assert deep.path.depth == 3002 and deep.path.nearest.marks == ("menu",)
    assert html_model.vectors([deep]).shape == (1, html_model.DIM)


def test_labels_see_the_whole_page():
    long = np.concatenate([x for x, _ in html_model.training_pages(150, 98)])
    keen = html_model.Labeller(np.random.default_rng(1))
    for d in "fr":  # forgets hardly anything
        keen.p[f"b{d}"][html_model.HIDDEN : 2 * html_model.HIDDEN] = 7
    pages = [long, long[:700], long[:5], long[:0]]
    assert len(long) > 1500
    for model in (keen, html_model.trained()):
        for p in pages[:3]:
            states = [model._run(p[:, None], np.ones((len(p), 1), np.float32), d, False)[0][:, 0] for d in "fr"]
            z = np.hstack(states) @ model.p["v"][:, 0]
            model.p["c"][0] = -np.median(z) if model is keen else model.p["c"][0]
            z += model.p["c"][0]
            clear = np.abs(z) > 1e-4
            got = (html_model.label(model, [p])[0], html_model.label(model, [p, *pages])[0])
            assert all(np.array_equal(q[clear], (z > 0)[clear]) for q in got)
    assert not len(html_model.label(keen, pages)[3])


def test_long_pages_keep_every_character():
    model = html_model.trained()
    texts = [f"Paragraph number {i} with some words." for i in range(5000)]
    page = "<body><nav><a>Home</a></nav><article>" + "".join(f"<p>{t}</p>" for t in texts) + "</article>"
    assert html_extract.main_texts(model, [page]) == [" ".join(texts)]


def test_marks_after_many_classes_count():
    many = "flex items-center justify-between px-4 py-2 text-sm text-gray-500 rounded-lg shadow-md mt-8"
    for late, mark in (('id="comments"', "comments"), ("hidden", "hidden"), ('style="display:none"', "hidden"), ('role="navigation"', "navigation")):
        (block,) = html_blocks.blocks(f'<div class="{many} w-full" {late}>x</div>')
        assert mark in block.path.marks and {"flex", "full"} <= set(block.path.marks)


# The pipeline


def test_pipeline_stages_keep_the_columns(spark, tmp_path):
    import corpus_pipeline

    texts, labels = made_toxic(120, 9)
    texts += [texts[0], "password = abcdef12 " + texts[1]]
    labels += [labels[0], labels[1]]
    frame(spark, texts).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, v) for i, v in enumerate(labels)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "secrets", "mix", "bpe"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
    left = {r.doc_id for r in docs.collect()}
    assert left and not any(labels[i] for i in left if i < 120 and labels[i]) or len([i for i in left if labels[i]]) <= 5
    assert not docs.filter(F.contains("text", F.lit("abcdef12"))).count()
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
