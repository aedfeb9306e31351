"""Operators on documents against brute force, and their defined cases."""

import collections
import functools
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from conftest import SMALL
from pyspark.sql import functions as F

import corpus_pipeline
from lookalike.llm import bpe, minhash, mixing, quality, queries, sampling, substrings, words

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = "_id long, text string, lang string, source string, n_chars long, doc_id long, component_id string, `_row` string, score int, kept string, ids string"


def frame(spark, rows):
    """doc_id, text rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(7, t, "en", s, len(t or ""), i, "c", "r", 1, "k", "x") for i, t, s in rows], ODD)


def odd_rows():
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(400)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(130)) for _ in range(12)]
    edited = [b.replace("w1 ", "zz ", 1).replace("w2", "yy", 1) for b in base[:6]]
    mixed = [base[i][:300] + " " + base[i + 1][300:] for i in range(6)]
    texts = [*base, *base[:3], *edited, *mixed, "", None, " \n\t ", "one two", "one two", "é漢 🎉 one\x0btwo", "x" * 3000, " ".join(["same"] * 300), " ".join(base), base[0].upper()]
    rows = [(i * 3, t, f"s{i % 4}" if i % 7 else None) for i, t in enumerate(texts)]
    return [*rows, (9, texts[5], "s1"), (9, texts[5], "s1"), (12, "another text of the same id", "s0"), (None, texts[2], "s0"), (None, "no id", "s2")]


def sets_of(rows, size=5):
    out = []
    for i, t, _ in rows:
        w = WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
        out.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    return out


# Words


def test_words_and_windows():
    texts = ["", "a b  c", None, "\x0bx\x0cy ", "é 漢字", "q" * 200000 + " r", "A b"]
    w = words.split(pa.array(texts))
    data = w.data.tobytes()
    got = [[data[s:e].decode() for s, e in zip(w.start[a:b], w.end[a:b])] for a, b in zip(w.first, w.first[1:])]
    assert got == [WORD.findall(t or "") for t in texts]
    h = words.word_hashes(w)
    flat = [x for t in got for x in t]
    assert len({int(x) for x in h}) == len(set(flat)) and (words.word_hashes(w, True)[-2:] == h[:2]).all()
    assert words.split(pa.array([], pa.string())).counts.tolist() == []
    x = np.arange(200000, dtype=np.uint64) % 7
    full = words.window_hashes(x, 50)
    assert len({int(v) for v in full}) == 7 and (full == np.concatenate([words.window_hashes(x[:100010], 50), words.window_hashes(x[99961:], 50)])).all()


# MinHash near-dedup


def brute_components(rows, percent):
    sets = sets_of(rows)
    ids = [i for i, _, _ in rows]
    order = [2**63 if i is None else i for i in ids]
    first = {}
    for o, s in zip(order, sets):
        if s:
            first[frozenset(s)] = min(o, first.get(frozenset(s), o))
    root = {o: o for o in order}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = list(first)
    for a in range(len(keys)):
        for b in range(a):
            if 100 * len(keys[a] & keys[b]) >= percent * len(keys[a] | keys[b]):
                x, y = sorted((find(first[keys[a]]), find(first[keys[b]])))
                root[y] = x
    comp = [find(first[frozenset(s)]) if s else o for o, s in zip(order, sets)]
    return collections.Counter((i, len(s), None if c == 2**63 else c, o == c) for i, s, c, o in zip(ids, sets, comp, order))


@pytest.mark.parametrize("percent", [85, 80])
def test_near_duplicates(spark, percent):
    rows = odd_rows()
    got = minhash.near_duplicates(frame(spark, rows), percent=percent).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, percent)


def test_near_copies_in_many_blocks(spark, monkeypatch):
    """A group of near copies over several blocks is one component, its outsiders are none."""
    rng = random.Random(8)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(120):
        w = list(base)
        for p in rng.sample(range(200), rng.choice([0, 1, 2, 9])):
            w[p] = f"x{i}-{p}"
        rows.append((i, " ".join(w), "s"))
    monkeypatch.setattr(minhash, "BLOCK", 16)
    monkeypatch.setattr(minhash, "REST_BLOCK", 16)
    got = minhash.near_duplicates(frame(spark, rows)).collect()
    assert collections.Counter(map(tuple, got)) == brute_components(rows, 85)


def test_near_duplicates_of_nothing(spark):
    assert minhash.near_duplicates(frame(spark, [(1, "a", "s")]).limit(0)).collect() == []
    got = minhash.near_duplicates(frame(spark, [(1, None, "s"), (2, "", "s")])).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_keep_one(spark):
    """Rows are judged by their texts: no unique text is lost with an id, equal rows leave one."""
    rng = random.Random(6)
    texts = [" ".join(f"t{k}-{rng.randrange(10**6)}" for _ in range(100)) for k in range(5)]
    rows = [(1, texts[0], "s"), (None, texts[0] + " more", "s"), (None, texts[1], "s"), (None, texts[2], "s"), (2, texts[3], "s"), (3, texts[3] + " more", "s"), (3, texts[4], "s")]
    docs = frame(spark, [*rows, rows[0], rows[3]])
    got = minhash.keep_one(docs)
    want = [rows[k][:2] for k in (0, 2, 3, 4, 6)]
    assert got.columns == docs.columns and collections.Counter((r["doc_id"], r["text"]) for r in got.collect()) == collections.Counter(want)


def brute_groups(sets, percent):
    groups = []
    for s in {frozenset(s) for s in sets if s}:
        near = [g for g in groups if any(100 * len(s & t) >= percent * len(s | t) for t in g)]
        groups = [g for g in groups if g not in near] + [{s}.union(*near)]
    return groups


def test_keep_one_leaves_one_row_of_each_group(spark):
    rows = odd_rows()
    sets = sets_of(rows)
    kept = sets_of([(r["doc_id"], r["text"], "") for r in minhash.keep_one(frame(spark, rows)).collect()])
    groups = brute_groups(sets, 80)
    assert sum(1 for s in kept if s) == len(groups) and all(sum(frozenset(s) in g for s in kept) == 1 for g in groups)
    assert sum(1 for s in kept if not s) == sum(1 for s in sets if not s)


def test_rows_without_an_id_are_judged_by_their_texts(spark):
    """A near copy goes, and takes no unrelated row of its id (or of none) with it; one row of each group stays."""
    rng = random.Random(5)
    texts = [" ".join(f"t{k}-{rng.randrange(10**6)}" for _ in range(100)) for k in range(6)]
    near = [t + " more" for t in texts]
    rows = [(1, texts[0], "s"), (None, near[0], "s"), (None, texts[1], "s"), (None, "", "s"), (None, None, "s")]  # a near copy without an id
    rows += [(None, texts[2], "a"), (None, near[2], "b"), (None, texts[2].upper(), "c"), (None, texts[2], "d")]  # near and exact copies, no id at all
    rows += [(2, texts[3], "s"), (5, near[3], "s"), (5, texts[4], "s"), (5, "", "s"), (7, texts[5], "s"), (7, texts[5], "s")]  # repeated ids
    docs = frame(spark, rows)
    got = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.keep_one_of_near(spark, docs.repartition(3), SMALL).collect())
    of_two = [x for x in got if x[1] and x[1].lower().startswith("t2-")]
    want = [(1, texts[0]), (None, texts[1]), (None, ""), (None, None), (2, texts[3]), (5, texts[4]), (5, ""), (7, texts[5])]
    assert len(of_two) == 1 and of_two[0] in [(None, texts[2]), (None, near[2]), (None, texts[2].upper())]
    assert got == collections.Counter([*want, *of_two])
    found = minhash.near_duplicates(docs, percent=80).collect()
    assert len(found) == len(rows) and all(r["component_id"] is None or r["component_id"] <= (r["doc_id"] or 2**63) for r in found)
    assert sorted((r["component_id"], r["kept"]) for r in found if r["doc_id"] == 5) == [(2, False), (5, True), (5, True)]


# Substring dedup


def brute_removal(rows, length):
    order = lambda i: 2**63 if i is None else i
    first, out = {}, []
    split = [(i, WORD.findall(t or "")) for i, t, _ in rows]
    for i, w in split:
        for p in range(len(w) - length + 1):
            k = tuple(w[p : p + length])
            first[k] = min(first.get(k, order(i)), order(i))
    for i, w in split:
        keep = [True] * len(w)
        for p in range(len(w) - length + 1):
            if first[tuple(w[p : p + length])] < order(i):
                keep[p : p + length] = [False] * length
        out.append((i, w, keep))
    return out


@pytest.mark.parametrize("length", [50, 7, 2])
def test_substring_digests(spark, length):
    rows = odd_rows()
    want = collections.Counter((i, len(w), len(w) - sum(k), hashlib.sha256(" ".join(x for x, y in zip(w, k) if y).encode()).hexdigest()) for i, w, k in brute_removal(rows, length))
    got = substrings.digests(frame(spark, rows).repartition(5), length=length).collect()
    assert collections.Counter(map(tuple, got)) == want


def test_substring_removal_keeps_rows_and_lines(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    got = substrings.remove(docs)
    assert got.columns == docs.columns
    want = collections.Counter((i, " ".join(x for x, y in zip(w, k) if y)) for i, w, k in brute_removal(rows, 50) if not k or any(k))
    assert collections.Counter((r["doc_id"], " ".join(WORD.findall(r["text"] or ""))) for r in got.collect()) == want
    assert all(r["n_chars"] == len(r["text"] or "") and r["_id"] == 7 for r in got.collect())
    passage = " ".join(f"p{k}" for k in range(60))
    two = substrings.remove(frame(spark, [(1, passage, "s"), (2, f"head one\nhead two\n{passage}\ntail", "s")])).filter("doc_id = 2").first()
    assert two["text"] == "head one\nhead two\ntail"
    assert substrings.digests(docs.limit(0)).collect() == []


def digests_of(rows, length):
    return collections.Counter((i, len(w), len(w) - sum(k), hashlib.sha256(" ".join(x for x, y in zip(w, k) if y).encode()).hexdigest()) for i, w, k in brute_removal(rows, length))


def test_levels():
    assert substrings.levels(50) == [25, 50] and substrings.levels(200) == [25, 50, 100, 200]
    assert substrings.levels(2) == [1, 2] and substrings.levels(1) == [1, 1] and substrings.levels(50, 6) == [7, 13, 25, 50]


@pytest.mark.parametrize("length, shortest, batch", [(40, 5, 4000), (23, 3, 1 << 22), (1, 25, 4000)])
def test_several_levels(spark, monkeypatch, length, shortest, batch):
    """Passages of all lengths, repeated in several documents: some fall out at each level."""
    monkeypatch.setattr(substrings, "BATCH_BYTES", batch)
    rng = random.Random(9)
    own = lambda k: [f"o{rng.randrange(10**9)}" for _ in range(k)]
    passages = [own(n) for n in (4, 8, 12, 22, 39, 41, 45, 60, 90)]
    rows = [(i, " ".join(sum(([*p, *own(rng.randint(1, 9))] for p in rng.sample(passages, 4)), own(3))), "s") for i in range(30)]
    rows += [(31, None, "s"), (4, rows[4][1], "s"), (4, rows[5][1], "s"), (40, " ".join(own(500)), "s"), (50, " ".join(["a"] * 200), "s"), (51, " ".join(["a"] * 300), "s")]
    docs = frame(spark, rows).repartition(4)
    assert collections.Counter(map(tuple, substrings.digests(docs, length=length, shortest=shortest).collect())) == digests_of(rows, length)


def test_no_candidates_at_the_first_level(spark):
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(300)), "s") for i in range(5)]
    got = substrings.digests(frame(spark, rows), length=200)
    assert collections.Counter(map(tuple, got.collect())) == digests_of(rows, 200)


def test_many_rows_without_an_id(spark):
    """Each is judged by its own text; they don't remove each other's words, and what a document with an id has goes."""
    rng = random.Random(3)
    passage = " ".join(f"p{k}" for k in range(55))
    texts = [" ".join(f"n{i}x{k}" for k in range(rng.randint(0, 80))) + (f" {passage} end{i}" if i % 3 else "") for i in range(300)]
    rows = [(None, t, "s") for t in texts] + [(7, f"first {passage}", "s"), (8, texts[1], "s"), (None, texts[1], "s"), (None, texts[2], "s"), (None, texts[2], "s"), (None, None, "s")]
    docs = frame(spark, rows).repartition(6)
    assert collections.Counter(map(tuple, substrings.digests(docs).collect())) == digests_of(rows, 50)
    want = collections.Counter((i, " ".join(x for x, y in zip(w, k) if y)) for i, w, k in brute_removal(rows, 50) if not k or any(k))
    assert collections.Counter((r["doc_id"], " ".join(WORD.findall(r["text"] or ""))) for r in substrings.remove(docs).collect()) == want


def test_a_very_long_text(spark):
    rng = random.Random(5)
    long = [f"l{rng.randrange(10**7)}" for _ in range(200000)]
    rows = [(1, " ".join(long[100000:100400]), "s"), (2, " ".join(long), "s"), (3, "x" * 2000000 + " " + " ".join(long[5:70]), "s")]
    assert collections.Counter(map(tuple, substrings.digests(frame(spark, rows)).collect())) == digests_of(rows, 50)


# Mixing


def brute_targets(sizes, weights=(5, 2, 1), most=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        heft = sum(w[s] for s in free)
        over = [s for s in free if left * w[s] > most * sizes[s] * heft]
        if not over:
            return target | {s: left * w[s] / heft for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= most * sizes[s]
            free.discard(s)
    return target


def test_mix(spark):
    rows = [(i, t, s) for i, t, s in odd_rows() if i is not None]
    sizes = collections.Counter()
    for _, t, s in rows:
        sizes[s] += len(WORD.findall(t or ""))
    want = brute_targets(sizes)
    docs = frame(spark, rows)
    got = mixing.plan(docs).collect()
    assert len(got) == len(rows) and sorted(map(tuple, got), key=repr) == sorted(map(tuple, mixing.plan(docs.repartition(3)).collect()), key=repr)
    largest = max(r["size"] for r in got)
    for s in sizes:
        mine = [r for r in got if r["source"] == s]
        assert all(r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and 0 <= r["copies"] <= 3 for r in mine)
        assert abs(sum(r["size"] * r["copies"] for r in mine) - want[s]) <= largest / 2 + 1
        assert max(r["copies"] for r in mine) - min(r["copies"] for r in mine) <= 1
    out = mixing.mix(docs)
    assert out.columns == docs.columns and out.count() >= sum(r["copies"] for r in got if r["doc_id"] != 9)
    assert mixing.plan(docs.limit(0)).collect() == []


def test_mix_takes_what_is_planned(spark):
    """Row by row, null ids, repeated ids and equal rows among them."""
    rows = odd_rows()
    docs = frame(spark, rows)
    ids = {hash_: t for hash_, t in docs.selectExpr("coalesce(xxhash64(text), 0) h", "text").distinct().collect()}
    copies = {}
    planned = mixing.plan(docs).collect()
    for r in planned:
        copies[r["doc_id"], ids[r["_digest"]]] = max(r["copies"], copies.get((r["doc_id"], ids[r["_digest"]]), 0))
    want = collections.Counter()
    for i, t, _ in rows:
        want[i, t] += copies[i, t]
    assert len(planned) == len(rows) and collections.Counter((r["doc_id"], r["text"]) for r in mixing.mix(docs).collect()) == +want


def brute_plan(rows, weights=(5, 2, 1), most=3):
    """rows: id, size, source, key, digest. Copies of each, by sorting whole sources."""
    sizes = collections.Counter()
    for _, n, s, _, _ in rows:
        sizes[s] += n
    target = brute_targets(sizes, weights, most)
    out = collections.Counter()
    for s in {r[2] for r in rows}:
        epochs = min(most, int(target[s] // sizes[s])) if sizes[s] else 0
        rest = target[s] - epochs * sizes[s] if epochs < most else 0
        before = 0
        for i, n, _, k, d in sorted((r for r in rows if r[2] == s), key=lambda r: (r[3], -(2**63) if r[0] is None else r[0], r[4])):
            out[i, n, d, epochs + (rest - before > n / 2)] += 1
            before += n
    return out


def test_plan_against_brute_force(spark):
    rng = random.Random(7)
    texts = [" ".join(rng.choice(["a", "##", "c!"]) for _ in range(rng.randint(0, 40))) for _ in range(500)]
    rows = [(rng.choice([i, i, None]), t, rng.choice(["p", "q", "p", "r", None])) for i, t in enumerate(texts)]
    docs = frame(spark, rows)
    keyed = docs.select("doc_id", mixing.n_words("text"), "source", mixing.sample_key("doc_id", mixing.quality_weight("text")), mixing.text_digest("text"))
    got = collections.Counter((r["doc_id"], r["size"], r["_digest"], r["copies"]) for r in mixing.plan(docs).collect())
    assert got == brute_plan([tuple(r) for r in keyed.collect()])


def test_quality_weights_favour_clean_texts(spark):
    rows = [(i, "clean words here" if i % 2 else "### $$$ %%%", "a") for i in range(600)] + [(i, "other source word", "b") for i in range(600, 1200)]
    got = mixing.plan(frame(spark, rows), weights=(1, 5)).filter("source = 'a' and copies > 0").collect()
    assert sum(r["doc_id"] % 2 for r in got) > 0.8 * len(got) > 0


# Fingerprints


def weighted_jaccard(a, b):
    x, y = (collections.Counter(WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), t))) for t in (a, b))
    return sum(min(x[k], y[k]) for k in x | y) / max(1, sum(max(x[k], y[k]) for k in x | y))


def test_collisions_are_generalised_jaccard():
    rng = random.Random(5)
    vocabulary = [f"t{k}" for k in range(80)]
    true, seen = [], []
    for _ in range(60):
        a = [rng.choice(vocabulary) for _ in range(100)]
        b = a[: rng.randint(0, 100)] + [rng.choice(vocabulary) for _ in range(40)]
        x, y = sampling.signatures(pa.array([" ".join(a), " ".join(b)]), 512)
        true.append(weighted_jaccard(" ".join(a), " ".join(b)))
        seen.append((x == y).mean())
    assert abs(np.mean(np.array(true) - seen)) < 0.01 and np.abs(np.array(true) - seen).max() < 0.09


def test_compare_with_next(spark):
    rows = [(i, t, s) for i, t, s in odd_rows()]
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()))
    want = collections.Counter()
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        want[i, n, hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest()] += 1
    got = sampling.compare_with_next(frame(spark, rows)).collect()
    assert collections.Counter((r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got) == want
    by_text = collections.defaultdict(set)
    fingerprints = sampling.fingerprints(frame(spark, rows)).collect()
    for r in fingerprints:
        by_text[r["text"] or ""].add(r["fingerprint"])
    assert all(len(v) == 1 for v in by_text.values()) and all(0 <= r["near_next"] <= 1 for r in got)
    alone = sampling.compare_with_next(frame(spark, [(4, "abcd", "s")])).first()
    assert alone["near_next"] == 1.0 and alone["edited_sha256"] == hashlib.sha256(b"abab").hexdigest()
    assert sampling.compare_with_next(frame(spark, rows).limit(0)).collect() == []


def test_next_across_blocks(spark):
    docs = frame(spark, [(i * 2, f"text {i}", "s") for i in range(2600)])
    got = {r["doc_id"]: r["edited_sha256"] for r in sampling.compare_with_next(docs.repartition(6)).collect()}
    for i in range(2600):
        t, after = f"text {i}", f"text {(i + 1) % 2600}"
        n = len(t)
        assert got[i * 2] == hashlib.sha256((t[: n - n // 2] + after[: n // 2]).encode()).hexdigest()


@functools.cache
def slow_values(word, n, samples):
    """Of one term and weight, sample by sample, the tables' values drawn as the module says."""
    h = int(words.word_hashes(words.split(pa.array([word])))[0])
    out = []
    for k in range(samples):
        x = int(words.mix(np.array([(h + k * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0])
        i, j, b, c = (x >> s & 0xFFFF for s in (0, 16, 32, 48))
        r, rest = sampling._exponential[i] + sampling._exponential[j], sampling._one_less_b[b]
        value = sampling._log_gamma[c] - r * rest
        out.append(value - r * np.floor(np.float32(round(np.log(n) * 2**20) / 2**20) / r + (1 - rest)) if n > 1 else value)
    return out


def slow_signature(text, samples=128):
    counts = collections.Counter(WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text)))
    return sampling._samples(np.array([slow_values(w, n, samples) for w, n in counts.items()] or [[np.inf] * samples], np.float32).min(axis=0)[None])[0]


def test_tables_are_the_distributions():
    rng = np.random.default_rng(1)
    one, other = (sampling._exponential[rng.integers(0, 1 << 16, 200000)] for _ in range(2))
    gamma = np.sort(rng.gamma(2, 1, 200000))
    assert np.abs(np.sort(one + other) - gamma)[:198000].max() < 0.12
    assert np.abs(np.exp(sampling._log_gamma) - gamma[(sampling._u * len(gamma)).astype(int)])[:64000].max() < 0.12
    assert (np.diff(sampling._log_gamma) >= 0).all() and sampling._exponential.min() > 0


def test_fingerprints_against_brute_force(spark):
    rows = odd_rows()
    order = sorted(rows, key=lambda r: (-(2**63) if r[0] is None else r[0], r[1] is not None, (r[1] or "").encode()))
    want = collections.Counter()
    for k, (i, t, _) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        n = len(t)
        own, edited, following = (slow_signature(x) for x in (t, t[: n - n // 2] + after[: n // 2], after))
        want[i, sampling.text_form(own), sampling.text_form(edited), float((own == edited).mean()), float((own == following).mean())] += 1
    got = sampling.compare_with_next(frame(spark, rows).repartition(3)).collect()
    assert collections.Counter((r["doc_id"], r["fingerprint"], r["edited_fingerprint"], r["near_edited"], r["near_next"]) for r in got) == want


def test_texts_in_slices(monkeypatch):
    """A text cut into slices, and terms drawn in parts, give the same samples; a word is never cut."""
    texts = pa.array([" ".join(f"w{k % 700}" for k in range(3000)), None, "x" * 9000 + " y " + "z" * 5000, "w1 w2", ""])
    want = sampling.signatures(texts)
    monkeypatch.setattr(sampling, "SLICE_BYTES", 500)
    monkeypatch.setattr(sampling, "TERMS", 64)
    assert (sampling.signatures(texts) == want).all()


def test_many_rows_of_one_id_are_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(sampling, "BLOCK_ROWS", 32)
    rows = [(None, f"text {i * 7919 % 1000}", "s") for i in range(700)] + [(5, f"five {i}", "s") for i in range(300)] + [(i, f"own {i}", "s") for i in range(100)] + [(None, "same", "s")] * 40
    order = sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1].encode()))
    want = collections.Counter()
    for k, (i, t, _) in enumerate(order):
        after = order[(k + 1) % len(order)][1]
        want[i, hashlib.sha256((t[: len(t) - len(t) // 2] + after[: len(t) // 2]).encode()).hexdigest()] += 1
    docs = frame(spark, rows).repartition(5)
    assert collections.Counter((r["doc_id"], r["edited_sha256"]) for r in sampling.compare_with_next(docs).collect()) == want
    sizes = [r["count"] for r in sampling.with_next(docs, "doc_id", "text").groupBy("_block").count().collect()]
    assert len(sizes) > 10 and max(sizes) < 400


# Byte-level BPE


@pytest.fixture(scope="module")
def library():
    import base64

    import tiktoken

    path, pattern = queries.tokenizer_file()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def test_bitmap():
    b, want, rng = bpe.Bitmap(), set(), random.Random(1)
    for _ in range(3000):
        x = rng.choice([rng.randrange(64**3), rng.randrange(70)])
        if x in want:
            b.remove(x)
            want.discard(x)
        else:
            b.add(x)
            want.add(x)
        assert b.first() == min(want, default=-1)


def test_ids_are_the_library_s(library):
    rng = random.Random(2)
    texts = ["", "aaaa" * 9, "<|endoftext|> it's", " \n\n  x", "é漢🎉" * 50, "ab" * 5000, "".join(rng.choice("abcdefgh") for _ in range(20000))]
    texts += ["".join(rng.choice(a) for _ in range(rng.choice([2, 9, 80]))) for a in ("ab", "the ing", "é漢 a\n", "0123 .!-=_*", "AaBb'st") for _ in range(200)]
    ids, off = bpe.tokenizer(*queries.tokenizer_file()).encode_batch(texts)
    for k, t in enumerate(texts):
        mine = ids[off[k] : off[k + 1]]
        assert mine.tolist() == library.encode_ordinary(t)
        assert bpe.tokenizer(*queries.tokenizer_file()).decode(mine) == t.encode()


def test_small_vocabulary_with_hasty_merges():
    """A longer token of a lower rank goes before a shorter one's other places."""
    tokens = [bytes([b]) for b in range(256)] + [b"bc", b"abc", b"ab", b"aa", b"aaa"]
    t = bpe.Tokenizer(tokens, r"\w+")

    def slow(piece):
        if piece in t.ids:
            return [t.ids[piece]]
        parts = [bytes([b]) for b in piece]
        while True:
            best = min(((t.ids[x + y], k) for k, (x, y) in enumerate(zip(parts, parts[1:])) if x + y in t.ids), default=None)
            if best is None:
                return [t.ids[p] for p in parts]
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]

    rng = random.Random(6)
    pieces = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 30))) for _ in range(400)]
    ids, off = t.encode_batch(pieces)
    assert [ids[a:b].tolist() for a, b in zip(off, off[1:])] == [slow(p.encode()) for p in pieces]


def test_token_columns(spark, library):
    rows = odd_rows()
    docs = frame(spark, rows)
    file = queries.tokenizer_file()
    got = bpe.decode(bpe.encode(docs, *file, decodes="score"), *file).collect()
    assert all(r["score"] is True for r in got)
    assert all(r["ids"] == library.encode_ordinary(r["text"] or "") and bytes(r["decoded"]) == (r["text"] or "").encode() for r in got) and len(got) == len(rows)
    want = collections.Counter()
    for i, t, _ in rows:
        ids = library.encode_ordinary(t or "")
        want[i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()] += 1
    assert collections.Counter(map(tuple, bpe.digests(docs, *file).collect())) == want


# Quality


def test_statistics_of_odd_texts():
    x = quality.statistics(pa.array(["", None, "one two. ONE!! ### one", "x" * 10000, "a a a a a a", "é\x0b漢"]))
    assert x.shape == (6, len(quality.STATISTICS)) and np.isfinite(x).all() and (x[0] == x[1]).all()
    assert x[4][quality.STATISTICS.index("stutters")] > 0.8
    one_by_one = [quality.statistics(pa.array([t]))[0] for t in ("one two. ONE!! ### one", "a a a a a a")]
    assert np.allclose(one_by_one, x[[2, 4]])


def test_classifier_on_held_out_rows(spark):
    docs = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL.replace('0.001', '0.01')}/labels.parquet")
    model, known = quality.learn(docs, labels)
    rows = quality.score_statistics(known, model).join(labels, "doc_id").withColumn("held", quality.fold() == 1).collect()
    held = [r for r in rows if r["held"]]
    good, bad = ([r["score"] for r in held if r["quality"] == q] for q in (1, 0))
    assert np.mean([[(g > b) + 0.5 * (g == b) for b in bad] for g in good]) > 0.97
    assert np.mean([(r["score"] >= 0.5) == (r["quality"] == 1) for r in held]) > 0.93
    again = {r["doc_id"]: r["score"] for r in quality.score_texts(docs, model).collect()}
    assert all(again[r["doc_id"]] == pytest.approx(r["score"]) for r in rows)


def test_classifier_without_labels(spark):
    docs = frame(spark, odd_rows())
    none = spark.createDataFrame([], "doc_id long, quality int")
    model, known = quality.learn(docs, none)
    assert {r["score"] for r in quality.score_statistics(known, model).collect()} == {0.5}
    one = spark.createDataFrame([(0, 1), (3, 1), (6, 1), (6, None), (None, 0), (21, 1)], "doc_id long, quality int")
    assert quality.learn(docs, one)[0].prior == 1.0
    few = spark.createDataFrame([(i * 3, i % 2) for i in range(20)], "doc_id long, quality int")
    model, known = quality.learn(docs, few)
    assert all(0 <= r["score"] <= 1 for r in quality.score_statistics(known, model).collect())


def test_isotonic():
    rng = np.random.default_rng(3)
    n = rng.integers(1, 9, 60).astype(float)
    p = np.clip(rng.normal(np.linspace(0, 1, 60), 0.3), 0, 1) * n
    level = quality._isotonic(p, n)
    assert (np.diff(level) >= -1e-12).all() and (level * n).sum() == pytest.approx(p.sum())


# The pipeline


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mix", "tokens"]
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert out and all(r["decodes"] and r["n_tokens"] == len(r["ids"]) for r in out)
    assert {r["doc_id"] for r in out} <= {r["doc_id"] for r in docs.collect()}


def test_mix_follows_the_classifier(spark, tmp_path):
    """Of two kinds of texts, the one that labels call good is taken first, whatever its symbols."""
    rng = random.Random(2)
    text = lambda good: " ".join(rng.choice(["fine###", "words###"] if good else ["spam", "x"]) for _ in range(30))
    rows = [(i, text(i % 2), "a" if i < 400 else "b") for i in range(800)]
    spark.createDataFrame([(i, i % 2) for i in range(800)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = frame(spark, rows).withColumn("source", F.when(F.col("source") == "a", "b").otherwise("a"))  # b's target is below its size
    got = [r["doc_id"] for r in corpus_pipeline.mix_sources(spark, docs, str(tmp_path)).filter("source = 'b'").collect()]
    assert 0 < len(got) < 400 and sum(i % 2 for i in got) > 0.75 * len(got)


def test_stages_keep_columns_and_repeat_brute_force(spark, tmp_path):
    rows = [(i, t, s) for i, t, s in odd_rows() if i is not None]
    docs = frame(spark, rows)
    near = corpus_pipeline.keep_one_of_near(spark, docs, SMALL)
    assert near.columns == docs.columns
    gone = {i for (i, _, _, kept), _ in brute_components(rows, 80).items() if not kept}
    assert {r["doc_id"] for r in near.collect()} == {i for i, _, _ in rows} - gone
    cut = corpus_pipeline.cut_repeats(spark, docs, SMALL)
    assert cut.columns == docs.columns
    want = collections.Counter((i, " ".join(x for x, y in zip(w, k) if y)) for i, w, k in brute_removal(rows, 50) if not k or any(k))
    assert collections.Counter((r["doc_id"], " ".join(WORD.findall(r["text"] or ""))) for r in cut.collect()) == want
    mixed = corpus_pipeline.mix_sources(spark, docs, SMALL)
    assert mixed.columns == docs.columns
    spark.createDataFrame([(0, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = corpus_pipeline.keep_quality(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and kept.count() == len(rows)
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
