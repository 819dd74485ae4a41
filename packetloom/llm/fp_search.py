"""Ranked lexical search over document FP-trees with branch and bound.

Documents are restricted to the terms the items use, and every restricted vector is ordered by term
frequency, rarest first. Sorted vectors share prefixes, so a run of them is a trie whose nodes are
ranges of documents. The largest tf of each term and the smallest m below a node bound the score of
every document in it from above; a term that no document below a node has adds nothing. A depth-first walk
takes the most promising child first and drops an item from a subtree as soon as the bound cannot reach
the item's k best any more; an item's list starts from the k-th best score of a first wave of
documents, a lower bound of the final one. No document is left out otherwise.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.llm.tables import only
from packetloom.llm.words import slices, text_bytes, word_hashes
from packetloom.session import materialise, settled

ITEMS, CHARS = 20_000, 16 << 20  # items of one pass over the documents: at most about so many, so long
CHUNK = 2_000_000  # term entries of one trie
LEAF = 16  # documents of a subtree that is not divided further
CELLS = 4_000_000  # entries worked on at once
FIRST_WAVE = 16  # one document of so many goes into the first wave
PREFIX = 16  # bytes of a path by which documents are dealt; a hot path is dealt on by document
NO_ID = np.iinfo(np.int64).max

# bytes between terms; all others, also those of other scripts, belong to a term
_BETWEEN = np.zeros(256, bool)
_BETWEEN[:0x30] = _BETWEEN[0x3A:0x41] = _BETWEEN[0x5B:0x61] = _BETWEEN[0x7B:0x80] = True


def _terms(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and bytes of every term, and where each row's terms begin."""
    data, offsets = text_bytes(texts)
    hashes, starts, first, last = word_hashes(data, offsets, _BETWEEN[data], spans=True)
    return hashes, last - first, starts


def _item_terms(items: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            hashes, sizes, starts = _terms(piece.column("text"))
            owner = np.repeat(np.arange(piece.num_rows), np.diff(starts))
            yield pa.RecordBatch.from_arrays(
                [piece.column("item_id").fill_null(NO_ID).take(pa.array(owner)), pa.array(hashes.view(np.int64)), pa.array(sizes)], ["item_id", "h", "size"])

    return items.mapInArrow(run, "item_id long, h long, size long").distinct()


def _vectors(docs: DataFrame, vocabulary: Broadcast) -> DataFrame:
    """Length and restricted term vector (term numbers and counts as int32) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, known_sizes = vocabulary.value
        for piece in slices(batches):
            hashes, sizes, starts = _terms(piece.column("text"))
            owner = np.repeat(np.arange(piece.num_rows), np.diff(starts))
            term = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            here = (known[term] == hashes) & (known_sizes[term] == sizes)
            key, tf = np.unique(owner[here] * len(known) + term[here], return_counts=True)
            row, term = np.divmod(key, len(known))
            cuts = np.searchsorted(row, np.arange(piece.num_rows + 1)) * 4
            term, tf = (pa.py_buffer(x.astype(np.int32)) for x in (term, tf))
            cuts = pa.py_buffer(cuts.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(np.diff(starts), pa.int64()),
                 pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, cuts, term]),
                 pa.Array.from_buffers(pa.binary(), piece.num_rows, [None, cuts, tf])],
                ["doc_id", "n", "terms", "tfs"])

    return docs.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def _packed(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column and where each row's begin."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int32, len(column) + 1, column.offset * 4).astype(np.int64)
    raw = np.frombuffer(data, np.uint8)[at[0]:at[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.frombuffer(raw.tobytes(), kind), (at - at[0]) // 4


def _counts(vectors: DataFrame, n_terms: int) -> DataFrame:
    """Documents of each term; -1 counts the documents with a term, -2 their terms."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n_docs, n_words = np.zeros(n_terms, np.int64), 0, 0
        for batch in batches:
            terms, _ = _packed(batch.column("terms"), "<i4")
            df += np.bincount(terms, minlength=n_terms)
            n = batch.column("n").to_numpy()
            n_docs, n_words = n_docs + int(np.count_nonzero(n)), n_words + int(n.sum())
        seen = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.append(seen, [-1, -2]), pa.int64()), pa.array(np.append(df[seen], [n_docs, n_words]), pa.int64())], ["term", "n"])

    return vectors.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def _paths(vectors: DataFrame, rank: Broadcast, n_docs: int, n_words: int) -> DataFrame:
    """Vectors as trie paths: term ranks, rarest first, as big-endian bytes that sort like the path."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, starts = _packed(batch.column("terms"), "<i4")
            tfs, _ = _packed(batch.column("tfs"), "<i4")
            owner = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            ranks = rank.value[terms]
            order = np.lexsort((ranks, owner))
            cuts = pa.py_buffer((starts * 4).astype(np.int32))
            path, tf = pa.py_buffer(ranks[order].astype(">u4")), pa.py_buffer(tfs[order].astype("<i4"))
            m = 50 + 50 * batch.column("n").to_numpy() * n_docs // n_words
            ids = batch.column("doc_id").fill_null(NO_ID)
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(m, pa.int64()), pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, cuts, path]),
                 pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, cuts, tf])],
                ["doc_id", "m", "path", "tfs"])

    return vectors.where("length(terms) > 0").mapInArrow(run, "doc_id long, m long, path binary, tfs binary")


class Weights:
    """The items' term weights, by term rank."""

    def __init__(self, item: np.ndarray, rank: np.ndarray, weight: np.ndarray, n_items: int, n_terms: int):
        order = np.argsort(rank, kind="stable")
        self.item, self.weight = item[order], weight[rank[order]].astype(np.float64)
        self.begin = np.searchsorted(rank[order], np.arange(n_terms + 1))
        self.n_items, self.n_terms = n_items, n_terms

    def used_by(self, items: np.ndarray) -> np.ndarray:
        """Flags of the terms that any of the items has."""
        chosen = np.zeros(self.n_items, bool)
        chosen[items] = True
        used = np.zeros(self.n_terms, bool)
        used[np.repeat(np.arange(self.n_terms), np.diff(self.begin))[chosen[self.item]]] = True
        return used

    def scores(self, group: np.ndarray, term: np.ndarray, tf: np.ndarray, m: np.ndarray) -> np.ndarray:
        """(group, item) sums of w * ((10^9 tf) div (1000 tf + 20 m)); exact, as all stay below 2^53."""
        gain = (1_000_000_000 * tf // (1000 * tf + 20 * m[group])).astype(np.float64)
        begin, n = self.begin[term], self.begin[term + 1] - self.begin[term]
        at = np.repeat(begin - np.cumsum(n) + n, n) + np.arange(int(n.sum()))
        cell = np.repeat(group * self.n_items, n) + self.item[at]
        total = np.bincount(cell, np.repeat(gain, n) * self.weight[at], len(m) * self.n_items)
        return total.reshape(len(m), self.n_items)


class Best:
    """The k best (score, document) of every item so far."""

    def __init__(self, k: int, floor: np.ndarray):
        self.k, self.floor = k, floor.astype(np.float64)
        self.last = np.full(len(floor), NO_ID)  # document a tie with ``floor`` has to precede
        self.scores = [np.zeros(0) for _ in floor]
        self.docs = [np.zeros(0, np.int64) for _ in floor]

    def open(self, bounds: np.ndarray, first_doc: np.ndarray) -> np.ndarray:
        """Which (group, item) can still bring a document into the list."""
        tie = (bounds == self.floor) & (first_doc[:, None] <= self.last)
        return (bounds > 0) & ((bounds > self.floor) | tie)

    def offer(self, scores: np.ndarray, docs: np.ndarray) -> None:
        """Scores of documents in all items."""
        row, item = np.nonzero(self.open(scores, docs))
        order = np.argsort(item, kind="stable")
        row, item = row[order], item[order]
        cuts = np.flatnonzero(np.diff(item, prepend=-1))
        for a, b in zip(cuts, [*cuts[1:], len(item)]):
            i = item[a]
            score = np.concatenate([self.scores[i], scores[row[a:b], i]])
            doc = np.concatenate([self.docs[i], docs[row[a:b]]])
            best = np.lexsort((doc, -score))[:self.k]
            self.scores[i], self.docs[i] = score[best], doc[best]
            if len(best) == self.k:
                self.floor[i], self.last[i] = self.scores[i][-1], self.docs[i][-1]


class Trie:
    """Sorted paths; a node is a range of documents that share their first terms."""

    def __init__(self, docs: np.ndarray, m: np.ndarray, begin: np.ndarray, term: np.ndarray, tf: np.ndarray):
        self.docs, self.m, self.begin, self.term, self.tf = docs, m, begin, term, tf
        size, depth = np.diff(begin), 0
        self.shared = np.zeros(max(0, len(docs) - 1), np.int64)  # first terms a document shares with the next
        left = np.flatnonzero(np.minimum(size[:-1], size[1:]) > 0)
        while len(left):
            left = left[term[begin[left] + depth] == term[begin[left + 1] + depth]]
            depth += 1
            self.shared[left] = depth
            left = left[np.minimum(size[left], size[left + 1]) > depth]

    def children(self, a: int, b: int) -> np.ndarray:
        """Cuts between the children of the node ``[a, b)``."""
        if b - a <= LEAF:
            return np.arange(a, b + 1)
        inner = self.shared[a:b - 1]
        return np.concatenate([[a], a + 1 + np.flatnonzero(inner == inner.min()), [b]])

    def summary(self, cuts: np.ndarray, used: np.ndarray) -> tuple[np.ndarray, ...]:
        """Largest tf of every used term below each child, and the children's smallest m."""
        x, y = self.begin[cuts[0]], self.begin[cuts[-1]]
        group = np.repeat(np.arange(len(cuts) - 1), np.diff(self.begin[cuts]))
        keep = used[self.term[x:y]]
        group, term, tf = group[keep], self.term[x:y][keep], self.tf[x:y][keep]
        if np.any(np.diff(cuts) > 1) and len(group):
            key = group * len(used) + term
            order = np.argsort(key, kind="stable")
            first = np.flatnonzero(np.diff(key[order], prepend=-1))
            tf = np.maximum.reduceat(tf[order], first)
            group, term = group[order][first], term[order][first]
        return group, term, tf, np.minimum.reduceat(self.m[cuts[0]:cuts[-1]], cuts[:-1] - cuts[0])

    def search(self, weights: Weights, best: Best) -> None:
        """Offer all documents that the bounds do not rule out to the items' lists."""
        every = np.arange(weights.n_items)
        stack = [(0, len(self.docs), every, np.full(weights.n_items, np.inf))]
        while stack:
            a, b, items, bounds = stack.pop()
            items = items[best.open(self._wide(bounds, items, weights.n_items), self.docs[a:b].min()[None])[0][items]]
            if not len(items):
                continue
            used, cuts = weights.used_by(items), self.children(a, b)
            ahead = []
            for part in self._parts(cuts, weights.n_items):
                scores = weights.scores(*self.summary(part, used))
                if len(items) < weights.n_items:
                    shut = np.ones(weights.n_items, bool)
                    shut[items] = False
                    scores[:, shut] = 0
                single = np.diff(part) == 1
                best.offer(scores[single], self.docs[part[:-1][single]])
                inner = np.flatnonzero(~single)
                first = np.minimum.reduceat(self.docs[part[0]:part[-1]], part[:-1] - part[0])
                may = best.open(scores[inner], first[inner])
                for row, child in zip(may, inner):
                    if row.any():
                        of = np.flatnonzero(row)
                        ahead.append((scores[child][of].sum(), (int(part[child]), int(part[child + 1]), of, scores[child][of])))
            stack += [node for _, node in sorted(ahead, key=lambda x: x[0])]

    @staticmethod
    def _wide(bounds: np.ndarray, items: np.ndarray, n_items: int) -> np.ndarray:
        wide = np.zeros((1, n_items))
        wide[0, items] = bounds
        return wide

    def _parts(self, cuts: np.ndarray, n_items: int) -> Iterator[np.ndarray]:
        """Runs of children that hold a bounded number of entries and cells together."""
        entries = self.begin[cuts] - self.begin[cuts[0]] + (cuts - cuts[0]) * n_items
        at = 0
        while at + 1 < len(cuts):
            to = max(at + 1, int(np.searchsorted(entries, entries[at] + CELLS, "right")) - 1)
            yield cuts[at:to + 1]
            at = to


def _search(paths: DataFrame, weights: Broadcast, k: int, tasks: int | None = None) -> DataFrame:
    """The k best documents per item and task; tries hold a bounded number of entries each."""
    def tries(batches: Iterator[pa.RecordBatch]) -> Iterator[Trie]:
        held, entries = [], 0
        for batch in batches:
            term, begin = _packed(batch.column("path"), ">u4")
            tf, _ = _packed(batch.column("tfs"), "<i4")
            held.append((batch.column("doc_id").to_numpy(), batch.column("m").to_numpy(), np.diff(begin), term.astype(np.int64), tf.astype(np.int64)))
            entries += len(term)
            if entries >= CHUNK:
                yield joined(held)
                held, entries = [], 0
        if held:
            yield joined(held)

    def joined(held: list) -> Trie:
        docs, m, sizes, term, tf = (np.concatenate(x) for x in zip(*held))
        return Trie(docs, m, np.concatenate([[0], np.cumsum(sizes)]), term, tf)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, floor = weights.value
        best = Best(k, floor)
        for trie in tries(batches):
            trie.search(of, best)
        sizes = [len(x) for x in best.docs]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(len(sizes)), sizes), pa.int64()), pa.array(np.concatenate(best.docs), pa.int64()),
             pa.array(np.concatenate(best.scores).astype(np.int64), pa.int64())], ["item", "doc_id", "score"])

    dealt = paths.repartitionByRange(F.substring("path", 1, PREFIX), "doc_id")
    dealt = (dealt.coalesce(tasks) if tasks else dealt).sortWithinPartitions("path", "doc_id")
    return dealt.mapInArrow(run, "item long, doc_id long, score long")


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("item").orderBy(F.desc("score"), "doc_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def _search_block(docs: DataFrame, items: DataFrame, k: int) -> DataFrame:
    """(item_id, rank, doc_id, score) of one bounded block of items."""
    spark = docs.sparkSession
    send = spark.sparkContext.broadcast
    asked = _item_terms(items).toPandas()  # at most about CHARS characters' worth of terms
    ids, item = np.unique(asked["item_id"].to_numpy(np.int64), return_inverse=True)
    hashes = asked["h"].to_numpy(np.int64).view(np.uint64)
    known, first, term = np.unique(hashes, return_index=True, return_inverse=True)
    nothing = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    if not len(known):
        return nothing

    vectors = materialise(_vectors(docs, send((known, asked["size"].to_numpy(np.int64)[first]))), "fp-vectors")
    counts = {r.term: r.n for r in _counts(vectors, len(known)).collect()}  # one row per term of the block
    n_docs, n_words = counts.pop(-1, 0), counts.pop(-2, 0)
    if not n_words:
        return nothing
    df = np.zeros(len(known), np.int64)
    df[list(counts)] = list(counts.values())
    rank = np.empty(len(known), np.int64)
    rank[np.argsort(df, kind="stable")] = np.arange(len(known))
    weight = np.empty(len(known))
    weight[rank] = np.floor(1000 * np.log((2 * n_docs + 2) / (2 * df + 1)))
    weights = Weights(item, rank[term], weight, len(ids), len(known))

    early = F.pmod(F.xxhash64("doc_id"), F.lit(FIRST_WAVE)) == 0
    sent_rank = send(rank)
    wave = lambda rows: _paths(rows, sent_rank, n_docs, n_words)
    few = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // FIRST_WAVE)  # as many documents a task as in the rest
    ahead = _search(wave(vectors.where(early)), send((weights, np.zeros(len(ids)))), k, few)
    ahead = materialise(_ranked(ahead, k), "fp-ahead")
    floor = np.zeros(len(ids))
    for r in ahead.where(F.col("rank") == k).collect():  # one row per item of the block
        floor[r.item] = r.score
    rest = _search(wave(vectors.where(~early)), send((weights, floor)), k)
    named = spark.createDataFrame([(i, None if x == NO_ID else int(x)) for i, x in enumerate(ids)], "item long, item_id long")
    return _ranked(ahead.drop("rank").unionByName(rest), k).join(F.broadcast(named), "item").select(
        "item_id", "rank", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "score")


def ranked_documents(docs: DataFrame, items: DataFrame, k: int = 50) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item, equal scores by doc_id.

    ``docs`` has doc_id and text, ``items`` item_id and text, ids being integers. Items are taken in
    blocks of bounded size, each in one pass over the documents. Null and empty texts have no terms and
    are found by nothing; rows of ``items`` with one item_id, null included, are one item with the
    terms of all; every row of ``docs`` is a document of its own, those without a doc_id come last among
    equal scores. Empty tables give no rows. Terms are known by 64-bit hash and length. Other columns
    are ignored.
    """
    docs = only(docs, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    items = only(items, "item_id", "text").withColumn("item_id", F.col("item_id").cast("long"))
    spark = docs.sparkSession
    size = items.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("chars")).first()
    blocks = max(1, math.ceil(size["n"] / ITEMS), math.ceil(size["chars"] / CHARS))
    result = None
    for i in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == i)
        found = settled(spark, lambda block=block: _search_block(docs, block, k), "fp-found")
        result = found if result is None else result.unionByName(found)
    return result


def oracle_sql() -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    terms = rf"regexp_extract_all(translate(text, '{upper}', '{lower}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
    return rf"""
WITH doc_terms AS (
  SELECT doc_id, unnest({terms}) AS term FROM documents
), tfs AS (
  SELECT doc_id, term, count(*) AS tf FROM doc_terms GROUP BY doc_id, term
), lengths AS (
  SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM tfs GROUP BY doc_id
), corpus AS (
  SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS words FROM lengths
), dfs AS (
  SELECT term, count(*) AS df FROM tfs GROUP BY term
), weights AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM dfs, corpus
), ms AS (
  SELECT doc_id, 100 - 50 + ((50 * n * docs) // words) AS m FROM lengths, corpus
), item_terms AS (
  SELECT DISTINCT item_id, unnest({terms}) AS term FROM benchmark
), scored AS (
  SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score
  FROM item_terms JOIN tfs USING (term) JOIN weights USING (term) JOIN ms USING (doc_id) GROUP BY item_id, doc_id
), ranked AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM scored WHERE score > 0
)
SELECT * FROM ranked WHERE rank <= 50"""
