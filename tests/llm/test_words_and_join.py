"""Word hashes, the n-gram join and components against brute force."""

import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from packetloom.llm import words as W
from packetloom.llm.components import components
from packetloom.llm.ngram_join import SKETCH, Scheme, _narrowed, fine_sketch, jaccard_components, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def sets_of(rows, k):
    out = {}
    for d, t in rows:
        w = WORD.findall((t or "").translate(LOWER))
        out[d] = frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)]) if w else frozenset()
    return out


def brute_components(rows, k, num, den):
    sets = sets_of(rows, k)
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1:]:
            both = len(sets[a] & sets[b])
            if both and den * both >= num * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), root(d)) for d in ids}


@pytest.mark.parametrize("block", [7, 64, 1 << 20])
def test_word_hashes_follow_words_and_rows(monkeypatch, block):
    monkeypatch.setattr(W, "BLOCK", block)
    texts = ["The the\tTHE", "", None, "a" * 300 + " b", "é É\nx", "  ", "x"]
    data, offsets = W.text_bytes(pa.array(texts))
    hashes, starts = W.word_hashes(data, offsets)
    words = [WORD.findall((t or "").translate(LOWER)) for t in texts]
    assert np.diff(starts).tolist() == [len(w) for w in words]
    flat = [w for ws in words for w in ws]
    seen = dict(zip(flat, hashes.tolist()))
    assert [seen[w] for w in flat] == hashes.tolist()
    assert len(set(seen.values())) == len(seen)


def near_copies(seed, n_groups=12, members=25):
    rng, rows, i = np.random.default_rng(seed), [], 0
    for g in range(n_groups):
        base = [f"w{rng.integers(400)}" for _ in range(int(rng.choice([3, 12, 30, 60, 150, 400])))]
        for _ in range(members):
            w = list(base)
            for _ in range(int(rng.integers(0, 1 + max(1, len(base) // 12)))):
                at = int(rng.integers(len(w)))
                w[at:at + 1] = [[], ["new"], [f"x{rng.integers(9)}"], [w[at], w[at]]][int(rng.integers(4))]
            rows.append((i, " ".join(w)))
            i += 1
    return rows


@pytest.mark.parametrize("k,num", [(3, 90), (5, 80), (2, 70)])
def test_components_equal_brute_force(spark, k, num):
    rows = near_copies(num) + [(5000, None), (5001, ""), (5002, "  \n"), (5003, "one"), (5004, "ONE"), (5005, "one two"), (5006, "long " * 4000)]
    rows += [(6000 + i, "same text again and again " * 5) for i in range(40)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, key string, component_id long").repartition(5)
    got = jaccard_components(df, k, num, 100).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, k, num, 100)


def test_repeated_and_null_ids(spark):
    rows = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "q r s t u v w"), (None, "a b c d e f g"), (None, None), (3, None)]
    got = sorted(map(tuple, jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 3, 90, 100).collect()), key=str)
    assert got == sorted([(1, 5, 1), (1, 5, 1), (2, 5, 1), (None, 5, None), (None, 0, None), (3, 0, 3)], key=str)


def test_empty_table(spark):
    assert jaccard_components(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketch_never_exceeds_the_difference():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 1 << 60, 300).astype(np.uint64))
        b = np.unique(np.concatenate([a[:rng.integers(1, len(a))], rng.integers(0, 1 << 60, 20).astype(np.uint64)]))
        differ = sum(bin(int(x) & (1 << 64) - 1).count("1") for x in sketch(a) ^ sketch(b))
        assert differ <= len(np.setxor1d(a, b))


def test_fine_sketches_drop_only_pairs_that_differ_too_much(spark):
    rng = np.random.default_rng(4)
    sets, rows, pairs = {}, [], []
    for i in range(0, 240, 2):
        a = np.unique(rng.integers(0, 1 << 60, int(rng.choice([300, 600, 1000, 1030, 2040, 2100, 5000]))).astype(np.uint64))
        keep = max(1, int(len(a) * rng.choice([0.1, 0.5, 0.8, 0.9, 0.97, 1.0])))
        sets[i], sets[i + 1] = a, np.unique(np.concatenate([a[:keep], rng.integers(0, 1 << 60, len(a) - keep + int(rng.integers(0, 20))).astype(np.uint64)]))
        pairs.append((i, i + 1))
    for i, values in sets.items():
        fine = fine_sketch(values)
        assert (fine is None) == (len(values) <= 64 * SKETCH)
        rows.append((i, len(values), None if fine is None else [int(x) for x in fine]))
    classes = spark.createDataFrame(rows, "h1 long, n long, fine array<long>")
    left = {tuple(r) for r in _narrowed(spark.createDataFrame(pairs, "x long, y long"), classes, 80, 100).collect()}
    dropped = 0
    for x, y in pairs:
        both, union = len(np.intersect1d(sets[x], sets[y])), len(np.union1d(sets[x], sets[y]))
        assert 100 * both < 80 * union or (x, y) in left
        if len(sets[x]) <= 64 * SKETCH or len(sets[y]) <= 64 * SKETCH:
            assert (x, y) in left
        elif 100 * both < 60 * union:
            assert (x, y) not in left
            dropped += 1
    assert dropped


def test_long_near_copies_equal_brute_force(spark):
    rng, rows = np.random.default_rng(9), []
    for g in range(6):
        base = [f"w{rng.integers(900)}" for _ in range(int(rng.choice([700, 1100, 2600])))]
        for i in range(9):
            w = list(base)
            for at in rng.integers(0, len(w), int(len(w) * rng.choice([0.0, 0.01, 0.02, 0.024, 0.03, 0.2]))):
                w[at] = f"x{rng.integers(99)}"
            rows.append((100 * g + i, " ".join(w)))
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 5, 80, 100).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == brute_components(rows, 5, 80, 100)


def test_every_similar_pair_shares_a_probed_key():
    rng, scheme = np.random.default_rng(2), Scheme(80, 100)
    for _ in range(400):
        n = int(rng.integers(5, 300))
        a = np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64))
        drop = int(rng.integers(0, 1 + len(a) // 5))
        b = np.unique(np.concatenate([a[drop:], rng.integers(0, 1 << 60, int(rng.integers(0, 1 + n // 9))).astype(np.uint64)]))
        both, union = len(np.intersect1d(a, b)), len(np.union1d(a, b))
        if 100 * both < 80 * union or both == union:
            continue
        (ka, pa_), (kb, pb) = scheme.keys(a), scheme.keys(b)
        assert set(ka[pa_].tolist()) & set(kb.tolist()) or set(kb[pb].tolist()) & set(ka.tolist())


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, i) for i in range(101, 160)] + [(300, 299), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 100 for i in range(100, 160)) and got[300] == 299
    assert Counter(got.values())[299] == 2 and not defaultdict(int)[1]
