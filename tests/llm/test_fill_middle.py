"""Fill-in-middle cuts against a plain cut of the same units, and the exact way back."""

import hashlib
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.llm.fill_middle import SkipList, fill_in_middle, fill_in_middle_digests, restored

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_cut(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{doc_id}".encode()).hexdigest()
    h = [int(digest[i:i + 8], 16) for i in range(0, 32, 8)]
    n = len(units)
    if doc_id is None or not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h[3] % 100 < 80:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


@given(st.lists(st.integers(1, 50), max_size=600))
@settings(max_examples=60, deadline=None)
def test_skip_list_reaches_every_rank(widths):
    units = SkipList(np.array(widths, np.int64))
    before = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    assert [units.seek(r) for r in range(len(widths) + 1)] == before.tolist()


def test_express_lanes_thin_out():
    units = SkipList(np.ones(100_000, np.int64))
    sizes = [len(lane[0]) for lane in units.lanes]
    assert all(a > 2 * b for a, b in zip(sizes, sizes[1:])) and sizes[-1] <= 8
    assert all(lane[0].sum() == lane[1].sum() == 100_000 for lane in units.lanes)


def check(rows, want):
    assert len(rows) == len(want)
    for r in rows:
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == plain_cut(r.doc_id, want[r.doc_id]), r.doc_id
        assert r.back == (want[r.doc_id] or "")


def with_way_back(df):
    return df.withColumn("back", restored(F.col("output"), F.col("form"))).collect()


def test_cuts_of_the_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    want = {r.doc_id: r.text for r in docs.collect()}
    check(with_way_back(fill_in_middle(docs)), want)
    digests = {r.doc_id: r for r in fill_in_middle_digests(docs).collect()}
    for doc_id, text in want.items():
        assert digests[doc_id].restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert digests[doc_id].output_sha256 == hashlib.sha256(plain_cut(doc_id, text)[4].encode()).hexdigest()


def test_odd_texts(spark):
    odd = [None, "", " ", "\n\t ", "one", " one", "one ", "a b c", "日本 𝔘𝔘 é\r\nx", "< <P <S>", "a<P>b", "<M", "a<S b<P c<", "x" * 3_000_000,
           "w  " * 700_000, " " * 2_500_000 + "z", ("é" * 999_999 + " ") * 3]
    # every text under many ids, so that all forms occur
    rows = [(1000 * i + j, t, "other", j) for i, t in enumerate(odd) for j in range(40 if len(t or "") < 100 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n string, output int").repartition(4)
    check(with_way_back(fill_in_middle(docs)), {i: t for i, t, *_ in rows})


def test_repeated_rows_and_rows_without_id(spark):
    rows = [(None, "a b c"), (7, "a b c"), (7, "a b c"), (7, "a b c d e f g")]
    found = with_way_back(fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")))
    assert sorted((r.doc_id or 0, r.back) for r in found) == sorted((i or 0, t) for i, t in rows)
    assert [r.form for r in found if r.doc_id is None] == ["plain"]
    assert len({r.output for r in found if r.back == "a b c" and r.doc_id == 7}) == 1


def test_empty_table(spark):
    made = fill_in_middle_digests(spark.createDataFrame([], "doc_id long, text string"))
    assert made.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"]
    assert made.count() == 0
