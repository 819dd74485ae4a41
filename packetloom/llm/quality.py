"""Quality rules: counted base rules, and divergence of a text's histograms from its language.

References are gathered from the corpus: per language, the character-class and common-word
histograms of all documents that pass the base rules and the length guards. A document is rejected
when the Jensen-Shannon distance between its own histogram and its language's exceeds the limit.
Where the corpus holds too little of a language, or none is given, only the base rules decide.
Short texts have noisy histograms: below the guards a histogram has no say, above them the limit is
widened by a term that falls with the square root of the length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.llm.words import _SPACE, mix, slices, text_bytes, windows, word_hashes
from packetloom.session import materialise

# Frequent function words of four languages.
COMMON_WORDS = (
    "the of and to in a is that it was for on are as with at by from "
    "der die und das in den von zu mit ist des auf für eine ein im auch sich "
    "de la le et les des en un une du que qui dans est pour pas par sur "
    "de la que el en y los las un una por con para es del se lo su"
)
SYMBOLS = b"#*$%&|<>"
WORDS = list(dict.fromkeys(COMMON_WORDS.split()))
N_WORD = len(WORDS) + 1

# classes: 0 vowel, 1 consonant, 2 capital, 3 digit, 4 white space, 5 punctuation, 6 symbol, 7 beyond ASCII
N_CHAR = 8
_CLASS = np.full(256, 6, np.int64)
_CLASS[97:123], _CLASS[[ord(c) for c in "aeiouy"]] = 1, 0
_CLASS[65:91], _CLASS[48:58], _CLASS[[0x20, *range(9, 14)]] = 2, 3, 4
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_CLASS[0xC0:], _CLASS[0x80:0xC0] = 7, N_CHAR  # continuation bytes go to a slot of their own
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def _word_table() -> tuple[np.ndarray, np.ndarray]:
    forms = [(form, i) for i, w in enumerate(WORDS) for form in (w, w.capitalize(), w.upper())]
    h, _ = word_hashes(*text_bytes(pa.array([f for f, _ in forms]), lower=False))
    order = np.argsort(h)
    return h[order], np.array([i for _, i in forms])[order]


_HASHES, _INDEX = _word_table()


def _per_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def features(texts: pa.Array) -> dict[str, np.ndarray]:
    """Base counts and both histograms of every text."""
    data, offsets = text_bytes(texts, lower=False)
    n, space = len(offsets) - 1, _SPACE[data]
    row = np.repeat(np.arange(n), np.diff(offsets))
    hashes, starts = word_hashes(data, offsets)
    owner = np.repeat(np.arange(n), np.diff(starts))
    salt = mix(np.arange(n, dtype=np.uint64) + np.uint64(77))

    line, line_starts, first, last = word_hashes(data, offsets, data == 10, spans=True)
    full = np.concatenate([[0], np.cumsum(~space)])
    real = full[last + 1] > full[first]
    line_row = np.repeat(np.arange(n), np.diff(line_starts))[real]
    _, index = np.unique(line[real] ^ salt[line_row], return_index=True)
    dup_lines = np.bincount(line_row, minlength=n) - np.bincount(line_row[index], minlength=n)

    value, at = windows(hashes, starts, 8)
    key = value ^ salt[owner[at]]
    order = np.argsort(key)
    same = np.zeros(len(key), bool)
    if len(key) > 1:
        equal = key[order][1:] == key[order][:-1]
        same[order[1:][equal]] = True
        same[order[:-1][equal]] = True
    steps = np.zeros(len(hashes) + 9, np.int64)
    steps[at[same]] += 1
    np.subtract.at(steps, at[same] + 8, 1)
    repeat = _per_row(np.cumsum(steps)[:len(hashes)] > 0, starts)

    slot = np.minimum(np.searchsorted(_HASHES, hashes), len(_HASHES) - 1)
    kind = np.where(_HASHES[slot] == hashes, _INDEX[slot], N_WORD - 1)
    return {
        "n_words": np.diff(starts), "word_chars": _per_row(~space & ((data & 0xC0) != 0x80), offsets),
        "n_symbols": _per_row(_SYMBOL[data], offsets), "n_dup_lines": dup_lines, "n_repeat_words": repeat,
        "chars": np.bincount(row * (N_CHAR + 1) + _CLASS[data], minlength=n * (N_CHAR + 1)).reshape(n, -1)[:, :N_CHAR],
        "words": np.bincount(owner * N_WORD + kind, minlength=n * N_WORD).reshape(n, -1),
    }


def base_failed(found: dict[str, np.ndarray]) -> np.ndarray:
    return (found["n_words"] < 20) | (100 * found["n_repeat_words"] > 30 * found["n_words"])


def distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (square root, base 2) of each row's histogram from its reference."""
    p = counts / np.maximum(counts.sum(1, keepdims=True), 1)
    q = reference / np.maximum(reference.sum(1, keepdims=True), 1e-300)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        part = np.where(p > 0, p * np.log2(p / m), 0) + np.where(q > 0, q * np.log2(q / m), 0)
    return np.sqrt(np.clip(part.sum(1) / 2, 0, 1))


def language_references(docs: DataFrame, min_words: int) -> DataFrame:
    """(lang, histogram) over the whole corpus; lang null stands for all languages together."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            found = features(piece.column("text"))
            good = ~base_failed(found) & (found["n_words"] >= min_words)
            both = np.hstack([found["chars"], found["words"]])
            codes = piece.column("lang").dictionary_encode()
            at = codes.indices.fill_null(len(codes.dictionary)).to_numpy(zero_copy_only=False)
            for code, lang in enumerate([*codes.dictionary.to_pylist(), None]):
                mine = both[good & (at == code)]
                if len(mine):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * both.shape[1], pa.string()), pa.array(range(both.shape[1]), pa.int32()), pa.array(mine.sum(0), pa.int64())],
                        ["lang", "slot", "n"])

    slots = docs.select("lang", "text").mapInArrow(run, "lang string, slot int, n long")
    sums = slots.groupBy("lang", "slot").agg(F.sum("n").alias("n"))
    whole = sums.groupBy("slot").agg(F.sum("n").alias("n")).select(F.lit(None).cast("string").alias("lang"), "slot", "n")
    return sums.where("lang is not null").union(whole).groupBy("lang").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("slot", "n"))), lambda x: x["n"].cast("double")).alias("reference"))


def quality_verdicts(
    docs: DataFrame, keep: list[str] = ("doc_id",), min_words: int = 60, min_reference: int = 2_000,
    char_limit: float = 0.22, char_noise: float = 1.0, word_limit: float = 0.12, word_noise: float = 1.7,
) -> DataFrame:
    """The columns ``keep`` of every row with its base counts, distances and verdict.

    ``docs`` needs text and lang; null and empty texts have no words and fail the base rules. A
    language with fewer than ``min_reference`` reference words, or none given, has only the base rules;
    its distances, from all languages together, have no say. Extra columns are ignored unless kept; repeated rows are judged alike.
    """
    refs = materialise(language_references(docs, min_words), "quality-references")
    whole = refs.where("lang is null").head()  # one row
    fallback = np.array(whole["reference"]) if whole else np.zeros(N_CHAR + N_WORD)
    named = refs.where("lang is not null").select(F.col("lang").alias("_lang"), F.col("reference").alias("_reference"))
    rows = docs.select(*[F.col(f"`{k}`") for k in keep if k != "text"], F.col("lang").alias("_key"), F.col("text").alias("_text"))
    rows = rows.join(named, rows["_key"] == named["_lang"], "left").drop("_key", "_lang")
    plain = list(keep)
    counted = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    schema = T.StructType([
        *[T.StructField(k, docs.schema[k].dataType) for k in plain], *[T.StructField(k, T.LongType()) for k in counted],
        *[T.StructField(k, T.BooleanType()) for k in ("base_failed", "kept")], *[T.StructField(k, T.DoubleType()) for k in ("char_distance", "word_distance")]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches, "_text"):
            found = features(piece.column("_text"))
            given = piece.column("_reference")
            reference = np.tile(fallback, (piece.num_rows, 1))
            enough = ~np.asarray(given.is_null())
            if enough.any():
                own = given.flatten().to_numpy(zero_copy_only=False).reshape(-1, N_CHAR + N_WORD)
                large = own[:, N_CHAR:].sum(1) >= min_reference
                enough[enough] = large
                reference[enough] = own[large]
            by_char = distance(found["chars"], reference[:, :N_CHAR])
            by_word = distance(found["words"], reference[:, N_CHAR:])
            failed, n = base_failed(found), np.maximum(found["n_words"], 1)
            judged = (found["n_words"] >= min_words) & enough
            far = (by_char > char_limit + char_noise / np.sqrt(n)) | (by_word > word_limit + word_noise / np.sqrt(n))
            kept = ~failed & ~(judged & far)
            columns = [piece.column("_text" if k == "text" else k) for k in plain]
            columns += [pa.array(found[k], pa.int64()) for k in counted]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(failed), pa.array(kept), pa.array(by_char), pa.array(by_word)],
                schema.fieldNames())

    return rows.mapInArrow(run, schema)
