"""Language-model scoring by context-tree weighting, next to a smoothed unigram base score.

The corpus is packed into blocks of bounded size. Every block reports its distinct words and byte
``depth + 1``-grams with their training counts; Spark sums them over the corpus and sends each block
its own share back, so that no task ever holds the whole model.

A byte is eight binary decisions. Each decision has one binary context tree whose nodes are the last
0 to ``depth`` bytes. A node with ``a`` zeros and ``b`` ones has the Krichevsky-Trofimov estimate
``Pe(a, b)`` and the weighted ``Pw = (Pe + prod Pw(children)) / 2``; the share of ``Pe`` in ``Pw`` says
how much of the probability stays at this depth, the rest goes on to the deeper context.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import only
from packetloom.llm.words import slices, text_bytes, word_hashes
from packetloom.session import materialise

BLOCK_BYTES = 24 << 20
RUN_BYTES = 1 << 20
END = -1  # key of the token that ends every document
EDGE = 0xFF  # never a byte of UTF-8: stands before and after every text
_CHUNK = 1 << 20
WORD, GRAM = 0, 1


def _blocks(docs: DataFrame, block_bytes: int) -> DataFrame:
    """One row per block of about ``block_bytes``: ids, held-out flags, lengths and packed texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base, k = TaskContext.get().partitionId() << 32, 0
        ids, held, sizes, parts, total = [], [], [], [], 0

        def flush() -> pa.RecordBatch:
            blob = zstandard.ZstdCompressor(level=1).compress(b"".join(parts))
            return pa.RecordBatch.from_arrays(
                [pa.array([base + k], pa.int64()), pa.array([ids], pa.list_(pa.int64())), pa.array([held], pa.list_(pa.bool_())),
                 pa.array([sizes], pa.list_(pa.int64())), pa.array([blob], pa.binary())], ["block", "ids", "held", "sizes", "blob"])

        for piece in slices(batches):
            data, offsets = text_bytes(piece.column("text"))
            ids += piece.column("doc_id").to_pylist()
            held += piece.column("held_out").to_pylist()
            sizes += np.diff(offsets).tolist()
            parts.append(data.tobytes())
            total += len(data)
            if total >= block_bytes:
                yield flush()
                ids, held, sizes, parts, total, k = [], [], [], [], 0, k + 1
        if ids:
            yield flush()

    return docs.mapInArrow(run, "block long, ids array<long>, held array<boolean>, sizes array<long>, blob binary")


def _opened(row: dict) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of documents of a block: (which, bytes, offsets, held-out flags), a few MB each."""
    data = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["blob"]), np.uint8)
    offsets = np.concatenate([[0], np.cumsum(row["sizes"], dtype=np.int64)])
    held = np.array(row["held"], bool)
    a = 0
    while a < len(held):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + RUN_BYTES, "right")) - 1)
        b = min(b, len(held))
        yield slice(a, b), data[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], held[a:b]
        a = b


def _grams(data: np.ndarray, offsets: np.ndarray, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(gram, row) of every byte and every end, in chunks; a gram is the context and the byte."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n, dtype=np.int32), np.diff(offsets) + depth + 1)
    stream = np.full(len(data) + n * (depth + 1), EDGE, np.uint8)
    body = np.ones(len(stream), bool)
    for j in range(depth + 1):  # the edges before each text and the one after it
        body[(offsets[1:] if j == depth else offsets[:-1]) + np.arange(n) * (depth + 1) + j] = False
    stream[body] = data
    body[offsets[1:] + np.arange(n) * (depth + 1) + depth] = True  # an end is scored, a beginning is not
    for a in range(0, len(stream), _CHUNK):
        b = min(len(stream), a + _CHUNK)
        at = np.flatnonzero(body[a:b]) + a
        gram = np.zeros(len(at), np.int64)
        for j in range(depth, -1, -1):
            gram = (gram << 8) | stream[at - j]
        yield gram, row[at]


def _counts(blocks: DataFrame, depth: int) -> DataFrame:
    """(block, kind, key, n): distinct words and grams of every block with their training counts."""
    def tally(keys: list[np.ndarray], n: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values, index = np.unique(np.concatenate(keys), return_inverse=True)
        return values, np.bincount(index, np.concatenate(n), len(values)).astype(np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                keys, n = {WORD: [], GRAM: []}, {WORD: [], GRAM: []}
                for _, data, offsets, held in _opened(row):
                    hashes, starts = word_hashes(data, offsets)
                    train = np.repeat(~held, np.diff(starts)).astype(np.int64)
                    ends = np.array([END], np.int64)
                    got = tally([hashes.view(np.int64), ends], [train, np.array([(~held).sum()])])
                    keys[WORD].append(got[0])
                    n[WORD].append(got[1])
                    for gram, at in _grams(data, offsets, depth):
                        got = tally([gram], [(~held[at]).astype(np.int64)])
                        keys[GRAM].append(got[0])
                        n[GRAM].append(got[1])
                for kind in (WORD, GRAM):
                    values, sums = tally(keys[kind], n[kind])
                    for a in range(0, len(values), 100_000):
                        part = values[a:a + 100_000]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(part), row["block"])), pa.array(np.full(len(part), kind, np.int32)), pa.array(part), pa.array(sums[a:a + 100_000])],
                            ["block", "kind", "key", "n"])

    return blocks.select("block", "held", "sizes", "blob").mapInArrow(run, "block long, kind int, key long, n long")


def _lgamma(x: Column) -> Column:
    """log Gamma for x > 0: Stirling's series at x + 8 and the recurrence back."""
    y = x + 8
    product = x
    for j in range(1, 8):
        product = product * (x + j)
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + 0.5 * math.log(2 * math.pi) + series - F.log(product)


def _log_kt(a: Column, b: Column) -> Column:
    return _lgamma(a + 0.5) + _lgamma(b + 0.5) - _lgamma(a + b + 1.0) - math.log(math.pi)


def gram_log_probabilities(grams: DataFrame, depth: int) -> DataFrame:
    """(key, value): log probability of each gram's last byte after the others, from (key, n)."""
    bits = grams.select("key", "n", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select(
        "key", "n", F.expr("shiftright(key, 8)").alias("ctx"),
        F.expr("shiftleft(1, k) | cast(shiftright(key & 255, 8 - k) as int)").alias("node"),
        F.expr("cast(shiftright(key & 255, 7 - k) & 1 as int)").alias("bit"))
    level = bits.groupBy("ctx", "node").agg(
        F.sum(F.when(F.col("bit") == 0, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("bit") == 1, F.col("n")).otherwise(0)).alias("b"))
    level = level.select("*", _log_kt(F.col("a"), F.col("b")).alias("pe")).select("*", F.col("pe").alias("pw"), F.lit(1.0).alias("share"))
    levels = [materialise(level, "tree-level")]
    for d in range(depth - 1, -1, -1):
        up = levels[-1].groupBy((F.col("ctx").bitwiseAND((1 << 8 * d) - 1)).alias("ctx"), "node").agg(
            F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum("pw").alias("below"))
        up = up.select("*", _log_kt(F.col("a"), F.col("b")).alias("pe"))
        top = F.greatest("pe", "below")
        up = up.select("*", (F.log(F.exp(F.col("pe") - top) + F.exp(F.col("below") - top)) + top - math.log(2)).alias("pw"))
        levels.append(materialise(up.select("ctx", "node", "a", "b", "pe", "pw", F.exp(F.col("pe") - F.col("pw") - math.log(2)).alias("share")), "tree-level"))
    mixed = None
    for d, level in enumerate(reversed(levels)):
        one = (F.col("b") + 0.5) / (F.col("a") + F.col("b") + 1.0)
        if mixed is None:
            mixed = level.select("ctx", "node", (F.col("share") * one).alias("p"), (1 - F.col("share")).alias("rest"))
            continue
        above = mixed.select(F.col("ctx").alias("up"), "node", F.col("p").alias("p0"), F.col("rest").alias("r0"))
        mixed = level.withColumn("up", F.col("ctx").bitwiseAND((1 << 8 * (d - 1)) - 1)).join(above, ["up", "node"]).select(
            "ctx", "node", (F.col("p0") + F.col("r0") * F.col("share") * one).alias("p"), (F.col("r0") * (1 - F.col("share"))).alias("rest"))
    chosen = F.when(F.col("bit") == 1, F.col("p")).otherwise(1 - F.col("p"))
    return bits.join(mixed, ["ctx", "node"]).groupBy("key").agg(F.sum(F.log(chosen)).alias("value"))


def lm_scores(docs: DataFrame, depth: int = 4, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text); columns as in the query, and bits_per_byte.

    Documents whose crc32(doc_id as text) mod 7 is 2 are held out, all others train both models.
    Null and empty texts consist of the end alone; a null doc_id hashes as the empty text. Repeated
    rows train and are scored once each. Extra columns are ignored; an empty table gives no rows.
    """
    docs = only(docs, "doc_id", "text").select(
        F.col("doc_id").cast("long").alias("doc_id"), "text",
        (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 7 == 2).alias("held_out"))
    blocks = materialise(_blocks(docs, block_bytes), "lm-blocks")
    counts = materialise(_counts(blocks, depth), "lm-counts")
    words = counts.where(f"kind = {WORD}")
    vocabulary = words.groupBy("key").agg(F.sum("n").alias("n"))
    vocabulary = materialise(vocabulary, "lm-vocabulary")
    known = vocabulary.where("n > 0").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).head()
    train_tokens, distinct = known["n"], known["v"]
    grams = counts.where(f"kind = {GRAM}")
    model = gram_log_probabilities(materialise(grams.groupBy("key").agg(F.sum("n").alias("n")), "lm-grams"), depth)
    values = vocabulary.select(F.lit(WORD).alias("kind"), "key", F.col("n").cast("double").alias("value")).union(
        model.select(F.lit(GRAM).alias("kind"), "key", "value"))
    shares = counts.select("block", "kind", "key").join(values, ["kind", "key"])
    unseen = math.log10(train_tokens + distinct + 1)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = right.column("kind").to_numpy()
        tables = {}
        for k in (WORD, GRAM):
            keys, value = right.column("key").to_numpy()[kind == k], right.column("value").to_numpy()[kind == k]
            order = np.argsort(keys)
            tables[k] = keys[order], value[order]
        out = []
        for row in left.to_pylist():
            for which, data, offsets, held in _opened(row):
                n = len(held)
                hashes, starts = word_hashes(data, offsets)
                owner = np.concatenate([np.repeat(np.arange(n), np.diff(starts)), np.arange(n)])
                tokens = np.concatenate([hashes.view(np.int64), np.full(n, END, np.int64)])
                c = tables[WORD][1][np.searchsorted(tables[WORD][0], tokens)]
                base = np.bincount(owner, np.log10(c + 1) - unseen, n)
                score = np.zeros(n)
                for gram, at in _grams(data, offsets, depth):
                    score += np.bincount(at, tables[GRAM][1][np.searchsorted(tables[GRAM][0], gram)], n)
                out.append(pa.table({
                    "doc_id": pa.array(row["ids"][which], pa.int64()), "held_out": pa.array(held), "n_tokens": pa.array(np.bincount(owner, minlength=n), pa.int64()),
                    "n_known": pa.array(np.bincount(owner, c > 0, n).astype(np.int64)), "train_tokens": pa.array(np.full(n, train_tokens, np.int64)),
                    "base_score": pa.array(base), "score": pa.array(score / math.log(10)), "bits_per_byte": pa.array(-score / math.log(2) / (np.diff(offsets) + 1))}))
        schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                            ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
        return pa.concat_tables(out) if out else schema.empty_table()

    return blocks.groupBy("block").cogroup(shares.groupBy("block")).applyInArrow(
        run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double")
