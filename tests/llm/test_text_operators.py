"""Quality rules, mixing, token counts and language-model scores against brute force."""

import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from packetloom.llm.context_tree import lm_scores
from packetloom.llm.mixing import WEIGHTS, mix_sources
from packetloom.llm.quality import quality_verdicts
from packetloom.llm.token_counts import MARK, token_counts, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {i: i + 32 for i in range(65, 91)}
TOKENIZER = "/opt/tokenizers/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def texts_of(documents):
    return {r.doc_id: r.text for r in documents.collect()}


# --- quality -------------------------------------------------------------------------------------

def base_counts(text):
    words, seen, dup = WORD.findall(text or ""), set(), 0
    for line in (text or "").split("\n"):
        dup += line in seen and bool(WORD.search(line))
        seen.add(line)
    windows, covered = Counter(tuple(words[i:i + 8]) for i in range(len(words) - 7)), set()
    for i in range(len(words) - 7):
        if windows[tuple(words[i:i + 8])] > 1:
            covered.update(range(i, i + 8))
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), dup, len(covered), n < 20 or 100 * len(covered) > 30 * n


def test_quality_base_counts(spark, documents):
    odd = [(-1, None), (-2, ""), (-3, "\n\n \n"), (-4, "a b\r\na b\n a b\na b"), (-5, "x y z " * 5000), (-6, "é日本 <#> 𝔘"), (-7, "q" * 200_000)]
    extra = spark.createDataFrame([(d, t, None, "s", 1) for d, t in odd], documents.schema)
    both = documents.unionByName(extra).withColumnRenamed("n_chars", "kept").withColumnRenamed("source", "_lang")
    want = {**texts_of(documents), **dict(odd)}
    for r in quality_verdicts(both).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base_counts(want[r.doc_id])
        assert not (r.kept and r.base_failed)


def test_quality_follows_the_labels(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = quality_verdicts(spark.read.parquet(f"{sf}/documents.parquet")).collect()
    clean = [r for r in rows if labels.get(r.doc_id) == 1 and not r.base_failed]
    junk = [r for r in rows if labels.get(r.doc_id) == 0]
    assert sum(r.kept for r in clean) >= 0.99 * len(clean)
    assert sum(not r.kept for r in junk) >= 0.9 * len(junk)


def test_quality_keeps_a_small_language(spark, documents):
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list(letters), 6)) for letters in ("aeioukstlnm", "αεικλμνοπρσ") for _ in range(400)]
    small = [(-1 - k, " ".join(rng.choice(words[400 * (k % 2):400 * (k % 2) + 400], 200)), ("fi", "el")[k % 2], "s", 1) for k in range(8)]
    small += [(-20 - k, small[k][1] + " end", None, "s", 1) for k in range(2)] + [(-30, "again " * 200, "fi", "s", 1)]
    got = {r.doc_id: r for r in quality_verdicts(documents.unionByName(spark.createDataFrame(small, documents.schema))).collect()}
    limit = 0.12 + 1.7 / math.sqrt(200)
    assert all(got[d].kept and got[d].word_distance > limit for d, *_ in small[:-1])
    assert not got[-30].kept


def test_quality_of_nothing(spark, documents):
    assert quality_verdicts(documents.limit(0)).collect() == []


# --- mixing --------------------------------------------------------------------------------------

def expected_targets(totals, share=1.5, most=2):
    names = sorted([s for s in totals if s is not None], key=lambda s: s.encode()) + [None] * (None in totals)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(names)}
    left, open_, target = share * sum(totals.values()), set(names), {}
    while True:
        whole = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / whole > most * totals[s]]
        if not over:
            return {**target, **{s: left * weight[s] / whole for s in open_}}
        for s in over:
            target[s] = most * totals[s]
        left -= sum(target[s] for s in over)
        open_ -= set(over)


def test_mixing_meets_targets(spark, documents):
    odd = [(-1, None, "src1"), (-2, "", None), (-3, "one two", None), (-4, "three " * 50, None), (-5, "hot copy of a text", "src2"), (-9, None, "empty")]
    odd += [(-5, "hot copy of a text", "src2")] * 300
    df = documents.select("doc_id", "text", "source", documents.n_chars.alias("size")).unionByName(
        spark.createDataFrame([(*r, 0) for r in odd], "doc_id long, text string, source string, size long"))
    given = df.collect()
    rows = mix_sources(df, keep=["doc_id", "source"]).collect()
    assert len(rows) == len(given)
    totals, taken, target = Counter(), Counter(), {}
    for r in given:
        totals[r.source] += len(WORD.findall(r.text or ""))
    for r in rows:
        taken[r.source] += r.taken
        target[r.source] = r.target
        assert r.taken == r.copies * r.size <= 2 * r.size and r.source_size == totals[r.source]
    want = expected_targets(totals)
    for s in totals:
        assert target[s] == pytest.approx(want[s], abs=1e-6)
        assert abs(taken[s] - target[s]) <= 0.02 * target[s] + 30
    again = mix_sources(df.repartition(7), keep=["doc_id", "source"]).collect()
    assert sorted(map(tuple, again), key=str) == sorted(map(tuple, rows), key=str)


def test_mixing_without_broadcast_and_without_ids(spark, documents, monkeypatch):
    given = documents.select("doc_id", "text", "source").unionByName(spark.createDataFrame(
        [(None, "one two three four", "src1")] * 41 + [(7, None, None)] * 3 + [(8, "", "src2")], "doc_id long, text string, source string"))
    rows = sorted(map(tuple, mix_sources(given, keep=["doc_id", "source"]).collect()), key=str)
    monkeypatch.setattr("packetloom.llm.mixing.BROADCAST_BYTES", -1)
    assert sorted(map(tuple, mix_sources(given, keep=["doc_id", "source"]).collect()), key=str) == rows
    assert len(rows) == given.count()


def test_mixing_takes_the_same_number_of_copies_from_tied_rows(spark):
    given = spark.createDataFrame([(None, "one two three", "a")] * 40 + [(i, "four five six", "a") for i in range(20)] + [
        (100 + i, "one two three", "b") for i in range(20)], "doc_id long, text string, source string")
    rows = mix_sources(given, keep=["source"]).collect()
    target = {r.source: r.target for r in rows}
    for s in "ab":
        assert abs(sum(r.taken for r in rows if r.source == s) - target[s]) <= 3
    assert len(rows) == 80 and target == pytest.approx(expected_targets({"a": 180, "b": 60}))


def test_mixing_nothing(spark, documents):
    assert mix_sources(documents.limit(0)).collect() == []


# --- token counts --------------------------------------------------------------------------------

def test_token_counts_equal_the_tokenizer(spark, documents):
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.Unigram([("<unk>", 0.0), *vocabulary(TOKENIZER)], unk_id=0))
    tokenizer.pre_tokenizer = pre_tokenizers.Metaspace(replacement=MARK, prepend_scheme="always")
    odd = ["", "  ", " a  b ", MARK + "x", "a" + MARK + "b", "日本語 テキスト", "a\nb\n\nc", "x" * 3000, "𝔘𝔫 \U0001F600\U0001F601", "\x00 \x01"]
    want = {**texts_of(documents), **{-i - 1: t for i, t in enumerate(odd)}, -99: None}
    df = spark.createDataFrame([(d, t, 5) for d, t in want.items()], "doc_id long, text string, n_tokens long")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, TOKENIZER).collect()}
    assert got == {d: len(tokenizer.encode(t or "").ids) for d, t in want.items()}


# --- language model ------------------------------------------------------------------------------

def brute_scores(rows, depth):
    held = {d: zlib.crc32((str(d) if d is not None else "").encode()) % 7 == 2 for d, _ in rows}
    pad = bytes([0xFF])

    def grams(text):
        s = pad * depth + (text or "").translate(LOWER).encode() + pad
        return [s[i - depth:i + 1] for i in range(depth, len(s))]

    tokens = {d: [*WORD.findall((t or "").translate(LOWER)), "\n"] for d, t in rows}
    count = Counter(w for d, _ in rows if not held[d] for w in tokens[d])
    n, v = sum(count.values()), len(count)
    nodes, children = defaultdict(lambda: [0, 0]), defaultdict(set)
    for d, t in rows:
        for g in grams(t) if not held[d] else ():
            for k in range(8):
                node, bit = (1 << k) | (g[-1] >> (8 - k)), (g[-1] >> (7 - k)) & 1
                for c in range(depth + 1):
                    context = g[depth - c:depth]
                    nodes[context, node][bit] += 1
                    if c:
                        children[context[1:], node].add(context)

    def kt(a, b):
        return math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)

    memo = {}

    def weighted(context, node):
        if (context, node) not in memo:
            own = kt(*nodes.get((context, node), (0, 0)))
            if len(context) < depth:
                below = sum(weighted(c, node) for c in children.get((context, node), ()))
                own = float(np.logaddexp(own, below)) - math.log(2)
            memo[context, node] = own
        return memo[context, node]

    def log_p(g):
        total = 0.0
        for k in range(8):
            node, bit, p, rest = (1 << k) | (g[-1] >> (8 - k)), (g[-1] >> (7 - k)) & 1, 0.0, 1.0
            for c in range(depth + 1):
                a, b = nodes.get((g[depth - c:depth], node), (0, 0))
                share = 1.0 if c == depth else math.exp(kt(a, b) - weighted(g[depth - c:depth], node) - math.log(2))
                p, rest = p + rest * share * (b + 0.5) / (a + b + 1), rest * (1 - share)
            total += math.log(p if bit else 1 - p)
        return total

    return {d: (held[d], len(tokens[d]), sum(count[w] > 0 for w in tokens[d]), n,
                sum(math.log10((count[w] + 1) / (n + v + 1)) for w in tokens[d]), sum(map(log_p, grams(t))) / math.log(10)) for d, t in rows}


@pytest.mark.parametrize("block_bytes", [2_000, 32 << 20])
def test_scores_equal_brute_force(spark, documents, block_bytes):
    rows = [(r.doc_id, r.text[:1500]) for r in documents.limit(60).collect()] + [(9001, None), (9002, ""), (9003, "Ünï cödé 日本"), (9004, "a b " * 4000), (None, "no id")]
    want = brute_scores(rows, 3)
    got = lm_scores(spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3), depth=3, block_bytes=block_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        w = want[r.doc_id]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == w[:4]
        assert r.base_score == pytest.approx(w[4], rel=1e-9) and r.score == pytest.approx(w[5], rel=1e-8)


def test_held_out_texts_are_predicted(spark, documents):
    rows = lm_scores(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).where("held_out and n_tokens > 50").collect()
    assert sum(r.bits_per_byte for r in rows) / len(rows) < 2.6  # eight without a model


def test_scores_of_nothing(spark, documents):
    assert lm_scores(documents.limit(0)).collect() == []
