"""Ranked search over document tries against plain scoring of every document."""

import math
import re
from collections import Counter, defaultdict

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from packetloom.llm import fp_search
from packetloom.llm.fp_search import NO_ID, Best, Trie, Weights, ranked_documents

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = {i: i + 32 for i in range(65, 91)}


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def plain_search(docs, items, k):
    tfs = [(i, Counter(terms(t))) for i, t in docs]
    live = [c for _, c in tfs if c]
    n_docs, n_words = len(live), sum(sum(c.values()) for c in live)
    df = Counter(t for c in live for t in c)
    weight = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * d + 1))) for t, d in df.items()}
    asked = defaultdict(set)
    for i, text in items:
        asked[i].update(terms(text))
    found = []
    for i, wanted in asked.items():
        scored = []
        for doc_id, tf in tfs:
            if tf:
                m = 50 + 50 * sum(tf.values()) * n_docs // n_words
                scored.append((-sum(weight[t] * (10**9 * tf[t] // (1000 * tf[t] + 20 * m)) for t in wanted if t in tf), doc_id is None, doc_id or 0))
        for rank, (score, no_id, doc_id) in enumerate(sorted(s for s in scored if s[0] < 0)[:k], 1):
            found.append((i, rank, None if no_id else doc_id, -score))
    return found


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


vectors = st.lists(st.dictionaries(st.integers(0, 11), st.integers(1, 4), min_size=1, max_size=8), min_size=1, max_size=120)


@given(vectors, st.lists(st.sets(st.integers(0, 11), min_size=1, max_size=6), min_size=1, max_size=5), st.integers(1, 6), st.randoms())
@settings(max_examples=150, deadline=None)
def test_tries_find_the_best_of_any_vectors(docs, items, k, random):
    weight = np.array([random.choice([0, 1, 5, 700, 9000]) for _ in range(12)], float)
    rows = [(sorted(d), i, random.choice([50, 60, 300])) for i, d in enumerate(docs)]
    pairs = [(i, t) for i, of in enumerate(items) for t in of]
    weights = Weights(np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs]), weight, len(items), 12)
    best = Best(k, np.zeros(len(items)))
    half = random.randrange(len(rows) + 1)
    for part in (rows[:half], rows[half:]):  # lists go on from trie to trie
        if part:
            part = sorted(part)
            sizes = [len(p) for p, _, _ in part]
            Trie(np.array([i for _, i, _ in part]), np.array([m for _, _, m in part]), np.concatenate([[0], np.cumsum(sizes)]),
                 np.array([t for p, _, _ in part for t in p]), np.array([docs[i][t] for p, i, _ in part for t in p])).search(weights, best)
    for i, of in enumerate(items):
        scored = [(-sum(int(weight[t]) * (10**9 * docs[d][t] // (1000 * docs[d][t] + 20 * m)) for t in of if t in docs[d]), d) for _, d, m in rows]
        want = sorted(s for s in scored if s[0] < 0)[:k]
        assert [(-int(s), d) for s, d in zip(best.scores[i], best.docs[i])] == want


def test_bounds_close_subtrees():
    """Documents without an item's rare term are not scored once the list is full."""
    n = 4000
    term = np.array([t for i in range(n) for t in ((0, 2) if i < 200 else (1, 2))])
    trie = Trie(np.arange(n), np.full(n, 100), np.arange(0, 2 * n + 1, 2), term, np.ones(2 * n, np.int64))
    weights, seen = Weights(np.array([0, 0]), np.array([0, 2]), np.array([9000.0, 10.0, 5.0]), 1, 3), []
    best = Best(50, np.zeros(1))
    offer = best.offer
    best.offer = lambda scores, docs: (seen.append(len(docs)), offer(scores, docs))
    trie.search(weights, best)
    assert best.docs[0].tolist() == list(range(50)) and sum(seen) < 600


def test_documents_and_benchmark(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()], 50)
    same(ranked_documents(docs, items).collect(), want)


def test_odd_rows(spark):
    filler = [(100 + i, f"alpha filler{i % 7} common") for i in range(300)]
    docs = [(1, None), (2, ""), (3, " ,.-"), (4, "Alpha beta"), (5, "alpha BETA"), (6, "Ünïcode É é 日本 42"), (7, "x" * 500_000 + " beta"),
            (8, "gamma " * 200_000), (9, "gamma\x00gamma"), (None, "beta alpha"), (10, "beta alpha"), (10, "beta alpha"), *filler]
    items = [(1, "alpha BETA beta"), (2, "ünïcode É 42"), (3, None), (4, ""), (5, "nowhere"), (None, "gamma"), (6, "common alpha"), (6, "Filler3"),
             (6, "common alpha"), (7, "x" * 500_000)]
    d = spark.createDataFrame([(i, t, "a", 1) for i, t in docs], "doc_id long, text string, item_id string, rank int").repartition(3)
    q = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, score int")
    for k in (2, 50):
        same(ranked_documents(d, q, k).collect(), plain_search(docs, items, k))


def test_blocks_of_items(spark, monkeypatch):
    rng = np.random.default_rng(5)
    words = [f"w{i}" for i in range(80)]
    text = lambda n: " ".join(rng.choice(words, n, p=(np.arange(80) + 1) / 3240))
    docs = [(i, text(int(rng.integers(1, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[i % 3][1]) for i in range(200)]  # copies: ties in every list
    items = [(i, text(6)) for i in range(25)]
    monkeypatch.setattr(fp_search, "ITEMS", 7)
    found = ranked_documents(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), 10)
    same(found.collect(), plain_search(docs, items, 10))


def test_empty_tables(spark):
    none = lambda name: spark.createDataFrame([], f"{name} long, text string")
    one = lambda name: spark.createDataFrame([(1, "word")], f"{name} long, text string")
    for docs, items in ((none("doc_id"), one("item_id")), (one("doc_id"), none("item_id")), (none("doc_id"), none("item_id"))):
        found = ranked_documents(docs, items)
        assert found.count() == 0 and found.dtypes == [("item_id", "bigint"), ("rank", "int"), ("doc_id", "bigint"), ("score", "bigint")]


def test_terms_need_hash_and_length():
    hashes, sizes, starts = fp_search._terms(fp_search.pa.array(["One, two", None, "", "one"]))
    assert starts.tolist() == [0, 2, 2, 2, 3] and hashes[0] == hashes[2] and sizes.tolist() == [2, 2, 2] and NO_ID > 2**62
