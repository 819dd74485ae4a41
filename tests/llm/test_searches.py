"""License scans, benchmark decontamination, PII and the pipeline."""

import hashlib
import math
import random
import re
from collections import Counter

import corpus_pipeline
import pytest
from oracle_check import compare, connect
from pyspark.sql import functions as F

from packetloom.llm import decontaminate, licenses
from packetloom.llm.decontaminate import benchmark_matches, decontaminated
from packetloom.llm.pii import pii_spans, sanitised
from packetloom.llm.queries import ORACLES, QUERIES
from packetloom.session import materialise

SF = "/root/testdata/sf0.01"


# --- licenses ------------------------------------------------------------------------------------

def test_license_oracle(spark):
    problems, rows = compare(QUERIES["op4_license_scan"](spark, SF), connect(SF), ORACLES["op4_license_scan"])
    assert not problems and rows == 1000


def test_license_cases(spark):
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the Software), to deal in the Software\n" \
          "without restriction, including without limitation the rights to use, copy, modify, merge,\npublish, distribute, sublicense, and/or sell copies of the Software"
    rows = [(1, None), (2, ""), (3, "The MIT\nLicense. mit-license MIT Licenses"), (4, "intro\n\n" + mit + "\n\nmore"), (5, mit), (6, "MIT LİCENSE mit Kicense"),
            (7, "General Public License; general public license"), (None, "apache license"), (8, "Licensed under the Apache License, Version 2.0"), (9, "x " * 50_000 + "mit license")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, words int, row string")
    con = connect("/root/testdata/sf0.001")
    con.execute("DROP VIEW documents")
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    problems, n = compare(licenses.license_scan(df), con, licenses.oracle_sql())
    assert not problems and n == len(rows)
    got = {r.doc_id: r for r in licenses.license_scan(df).collect()}
    assert (got[3].n_base, got[3].first_word, got[3].last_word, got[3].labels) == (2, 1, 3, "mit")
    assert got[4].labels == "mit" and got[4].n_base == 0 and got[5].labels == ""
    assert licenses.license_scan(df.limit(0)).collect() == []


# --- decontamination -----------------------------------------------------------------------------

GAP = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def brute_matches(docs, bench, k=5, level=0.8):
    items = [(i, GAP.findall((t or "").lower())) for i, t in bench]
    items = [(i, w) for i, w in items if len(w) >= k]
    sets = [{tuple(w[j:j + k]) for j in range(len(w) - k + 1)} for _, w in items]
    df = Counter(s for x in sets for s in x)
    weigh = lambda shingles: sum(math.log(1 + len(items) / df[s]) for s in shingles)
    out = {}
    for d, t in docs:
        w = GAP.findall((t or "").lower())
        for (i, words), own in zip(items, sets):
            best = 0.0
            for a in range(len(w) - len(words) + 1):
                seen = {tuple(w[j:j + k]) for j in range(a, a + len(words) - k + 1)}
                if seen & own:
                    both = seen & own
                    best = max(best, weigh(both) / (weigh(own) + (len(seen) - len(both)) * math.log(1 + len(items))))
            if best >= level - 1e-12:
                out[d, i] = round(best, 9)
    return out


def test_windows_equal_brute_force(spark):
    rng = random.Random(3)
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "too short item"), (901, None), (902, "")]
    docs = [(-1, None), (-2, ""), (-3, "few words"), (-4, "pad " * 30_000 + bench[0][1])]
    for n in range(120):
        w = rng.choice(bench[:40])[1].split()
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            w[rng.randrange(len(w))] = f"zz{rng.randrange(9)}"
        docs.append((n, " ".join([f"pre{rng.randrange(50)}" for _ in range(rng.randrange(30))] + [x.upper() if n % 3 else x + "," for x in w] + ["post"] * 9)))
    docs += [(500 + i, bench[1][1]) for i in range(20)]
    df = spark.createDataFrame([(*d, 7) for d in docs], "doc_id long, text string, key int")
    items = spark.createDataFrame(bench, "item_id long, text string")
    got = benchmark_matches(df, items).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == brute_matches(docs, bench)
    assert len(got) == len({(r.doc_id, r.item_id) for r in got})
    bad = {r.doc_id for r in got}
    assert {r.doc_id for r in decontaminated(df, items).collect()} == {d for d, _ in docs} - bad
    assert benchmark_matches(df.limit(0), items).collect() == [] and benchmark_matches(df, items.limit(0)).collect() == []


def test_windows_at_the_ends_of_texts(spark):
    rng = random.Random(11)
    items = [(n, " ".join(f"i{n}w{rng.randrange(10**6)}" for _ in range(60))) for n in range(12)]
    docs = []
    for n, t in items:
        w = t.split()
        gone = w[:30] + w[31:]
        docs += [(100 * n, " ".join([f"pre{j}" for j in range(40)] + gone)), (100 * n + 1, " ".join(gone)), (100 * n + 2, " ".join(w[:51])), (100 * n + 3, " ".join(w[:45])),
                 (100 * n + 4, " ".join(["pad"] * 20 + w[:53] + [f"post{j}" for j in range(30)])), (100 * n + 5, " ".join(w[7:] + ["pad"] * 20))]

    def shares(w):
        return {tuple(w[j:j + 5]) for j in range(len(w) - 4)}

    want = {}
    for d, t in docs:
        w = t.split()
        for i, u in items:
            own = shares(u.split())
            best = max(len(s & own) / len(s | own) for s in (shares(w[a:a + 60]) for a in range(max(0, len(w) - 60) + 1)))
            if best >= 0.8:
                want[d, i] = round(best, 9)
    assert {d % 100 for d, _ in want} == {0, 1, 2, 4, 5}
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = benchmark_matches(df, bench).collect()
    assert {(r.doc_id, r.item_id): round(r.similarity, 9) for r in got} == want
    assert {r.n_words for r in got if r.doc_id % 100 == 1} == {59} and {r.n_words for r in got if r.doc_id % 100 == 4} == {60}
    assert {r.doc_id for r in decontaminated(df, bench).collect()} == {d for d, _ in docs} - {d for d, _ in want}


def shuffled_rows(plan):
    """Rows that the exchanges of an executed plan (without adaptive execution) wrote."""
    own = plan.metrics().apply("shuffleRecordsWritten").value() if plan.nodeName() == "Exchange" else 0
    return own + sum(shuffled_rows(plan.children().apply(i)) for i in range(plan.children().size()))


def test_texts_without_a_benchmark_shingle_are_not_shuffled(spark, monkeypatch):
    item = " ".join(f"word{j}" for j in range(40))
    docs = [(n, f"clean{n} " * 8) for n in range(3000)] + [(n, f"pre{n} {item} post{n}") for n in range(3000, 3020)] + [(4000, None), (4001, "")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    written = {}
    monkeypatch.setattr(decontaminate, "materialise", lambda rows, name: written.setdefault(name, rows) and materialise(rows, name))
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    try:
        for k, v in zip(before, ("false", "-1")):  # as with too many texts for a broadcast
            spark.conf.set(k, v)
        assert {(r.doc_id, r.item_id) for r in benchmark_matches(df, bench).collect()} == {(n, 1) for n in range(3000, 3020)}
        texts = written["benchmark-texts"]
        assert {r.doc_id for r in texts.collect()} == set(range(3000, 3020))
        assert shuffled_rows(texts._jdf.queryExecution().executedPlan()) < 600
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


@pytest.mark.parametrize("n", [0, 1, 2, 3000])
def test_sieve_keeps_every_key(spark, n):
    rows = spark.range(-20_000, 20_000).select(F.when(F.col("id") != 0, F.xxhash64("id")).alias("key"), F.col("id").alias("n"))
    keys = rows.where(F.col("n").between(1, n)).select("key")
    got = [r.n for r in decontaminate._sifted(rows, keys).collect()]
    assert len(got) == len(set(got)) and set(got) >= set(range(1, n + 1)) and len(got) < n + 2500 and 0 not in got


# --- PII -----------------------------------------------------------------------------------------

KINDS = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
         ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 * (int(c) > 4)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute_spans(text):
    out = []
    for k, (name, pattern) in enumerate(KINDS):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if name == "ip" else True, "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[name]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_plain_patterns(spark):
    rng = random.Random(5)
    bits = ["1", "2.", "25", "@", "a.", "-b", " ", "+1", "(2) ", "é", "𝔘", "4111 1111 1111 1111", "c@d.e_f@g.h", "+1 (499) 555-6503", "1.2.3.4.5", "a@b.c"]
    rows = [(i, "".join(rng.choice(bits) for _ in range(rng.randrange(30)))) for i in range(800)]
    rows += [(9000, None), (9001, ""), (9002, "1" * 20_000 + "@" + "a." * 9_000 + "1.2.3.4"), (None, "x a@b.cd"), (9003, rows[5][1]), (9003, rows[5][1])]
    df = spark.createDataFrame([(*r, 0, "b") for r in rows], "doc_id long, text string, terms int, base string")
    got = Counter((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii_spans(df, support=10**6).collect())
    want = Counter()
    for d, t in rows:
        spans = brute_spans(t)
        n = Counter(k for _, k, _ in spans)
        want[(d, n[0], n[1], n[2], n[3], hashlib.sha256(",".join(f"{KINDS[k][0]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest())] += 1
    assert got == want
    assert pii_spans(df.limit(0)).collect() == []


def test_terms_that_give_an_entity_away(spark):
    rows = [(i, f"Notes {i} say that Zebulon writes from zed@mail.com about the day {'and more ' * (i % 5)}") for i in range(6)]
    rows += [(100 + i, f"the day {i} says about more notes that the others wrote and a{i}@b.org") for i in range(40)] + [(200 + i, "the same copy of Quixotta q@x.org here") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii_spans(df).collect()}
    for i, t in rows[:6]:
        at = t.index("Zebulon")
        assert f"term:{at}:{at + 7}" in got[i].spans.split(",")
        assert f"term:{t.index('about')}" not in got[i].spans
    assert all(got[100 + i].n_term == 0 for i in range(40))
    assert all(got[200 + i].n_term == 0 for i in range(30))  # copies of one text are no evidence
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert "Zebulon" not in clean[0] and "[TERM]" in clean[0] and "[EMAIL]" in clean[0] and clean[100].endswith("and [EMAIL]")


def test_terms_far_from_their_entity(spark):
    rows = [(i, f"Zebulon in the headline {'and more of the day ' * (9 + i)}is zed@mail.com here {'and more of the day ' * 9}by zebulon again") for i in range(6)]
    rows += [(100 + i, f"the headline {i} is here and more of the day by others again in a{i}@b.org") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii_spans(df).collect()}
    for i, t in rows[:6]:
        last = t.index("zebulon")
        assert [s for s in got[i].spans.split(",") if s.startswith("term")] == ["term:0:7", f"term:{last}:{last + 7}"]
    assert all(got[100 + i].n_term == 0 for i in range(40))
    clean = {r.doc_id: r.text for r in sanitised(df).collect()}
    assert all("zebulon" not in clean[i].lower() and clean[i].count("[TERM]") == 2 for i in range(6))


# --- pipeline ------------------------------------------------------------------------------------

def test_pipeline_stage_by_stage(spark):
    from packetloom.session import materialise

    con = connect(SF)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, bench = docs.columns, con.sql("SELECT item_id, text FROM benchmark").fetchall()
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, materialise(stage(spark, docs, SF), f"test-{name}")
        kept[name] = docs
        if name != "source_mixing":
            assert docs.columns == columns
        if name == "ngram_jaccard_join":
            sets = {r.doc_id: shingles(r.text) for r in before.collect()}
            left = {r.doc_id for r in docs.collect()}
            for d, s in sets.items():
                near = [x for x in sets if x != d and s and 100 * len(s & sets[x]) >= 80 * len(s | sets[x])]
                assert d in left or near
                assert not (d in left and any(x in left for x in near))
        if name == "benchmark_decontamination":
            rows = [(r.doc_id, r.text) for r in before.collect()]
            assert {r.doc_id for r in docs.collect()} == {d for d, _ in rows} - {d for d, _ in brute_matches(rows, bench)}
        if name == "pii":
            assert docs.count() == before.count()
            assert not any(brute_spans(r.text) and [s for s in brute_spans(r.text) if s[1] in (0, 1)] for r in docs.collect())
    copies = Counter(r.doc_id for r in docs.collect())
    assert max(copies.values()) <= 2 and set(copies) <= {r.doc_id for r in kept["pii"].collect()}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text.translate({i: i + 32 for i in range(65, 91)}))
    return frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) > 4 else frozenset([tuple(w)]) if w else frozenset()


def test_pipeline_on_hostile_rows(spark, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, kept int, _key string, words int"
    rows = [(1, None, None, None, None, "a", 1, "k", 1), (2, "", "en", "s", 0, None, None, None, None), (3, "w " * 40_000, "en", "s", 1, "a", 1, "k", 1)]
    text = " ".join(f"word{i} of the day and it is on that" for i in range(30))
    rows += [(4, text, "en", "s", 1, "a", 1, "k", 1)] * 3 + [(None, text + " end", None, None, 1, "a", 1, "k", 1)] + [(10 + i, text, "xx", "t", 1, "a", 1, "k", 1) for i in range(5)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        path = str(tmp_path / stage.__name__)
        docs.write.parquet(path)
        docs = spark.read.parquet(path)
    assert set(docs.columns) >= {"doc_id", "row", "kept", "_key", "words", "mix_copy"}
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).collect() == []


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_read_whole_tables(name):
    assert name == "pipeline" or re.fullmatch(r"op([1-9]|10)_\w+", name)
