"""Token counts of a unigram tokenizer without building its token lists.

Aho-Corasick enumerates every vocabulary piece inside a word; a forward pass carries, for each
position, the best score, the number of pieces and whether the last piece is unknown. It keeps the
tokenizer's rules on ties: a later candidate wins only with a strictly better score, candidates come by
their start, then by their length, and neighbouring unknown pieces count as one. Words recur, so a
task counts each distinct word once and looks the rest up by its hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from packetloom.llm.tables import only
from packetloom.llm.words import slices, text_bytes, word_hashes

MARK = "▁"
UNKNOWN_PENALTY = 10.0
CACHE_WORDS = 2_000_000


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a tokenizer file; control, unknown and byte pieces are left out."""
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size())
            if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Number of tokens of one word that starts with the space mark."""

    def __init__(self, pieces: list[tuple[str, float]]):
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY

    def count(self, word: str) -> int:
        n = len(word)
        starts: list[list[tuple[int, float]]] = [[] for _ in range(n)]
        for end, (length, score) in self.automaton.iter(word):
            starts[end - length + 1].append((length, score))
        best: list[float | None] = [None] * (n + 1)
        pieces, tail = [0] * (n + 1), [False] * (n + 1)
        best[0] = 0.0
        for i in range(n):
            here, single = best[i], False
            for length, score in sorted(starts[i]):
                single = single or length == 1
                total, end = here + score, i + length
                if best[end] is None or total > best[end]:
                    best[end], pieces[end], tail[end] = total, pieces[i] + 1, False
            if not single:
                total = here + self.unknown
                if best[i + 1] is None or total > best[i + 1]:
                    best[i + 1], pieces[i + 1], tail[i + 1] = total, pieces[i] + (not tail[i]), True
        return pieces[n]


def token_counts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_words, n_tokens) per row of ``docs`` (doc_id, text).

    ``path`` names the tokenizer file, read by the driver; its bounded vocabulary travels with the
    tasks. Text is cut before every space, which becomes the space mark (a mark in the text is a space); a mark is put before the text
    unless it starts with a space. Null and empty texts count 0. Repeated rows are counted alike, extra
    columns ignored.
    """
    pieces = docs.sparkSession.sparkContext.broadcast(vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, known = Counter(pieces.value), {}
        mark = counter.count(MARK)
        for piece in slices(batches):
            data, offsets = text_bytes(pa.compute.replace_substring(piece.column("text"), MARK, " "), lower=False)
            space = data == 0x20
            hashes, starts, first, last = word_hashes(data, offsets, space, spans=True)
            _, index, inverse = np.unique(hashes, return_index=True, return_inverse=True)
            raw, counts = data.tobytes(), np.zeros(len(index), np.int64)
            for j, i in enumerate(index.tolist()):
                key = int(hashes[i])
                got = known.get(key)
                if got is None:
                    got = known[key] = counter.count(MARK + raw[first[i]:last[i] + 1].decode())
                counts[j] = got
            if len(known) > CACHE_WORDS:
                known.clear()
            total = np.concatenate([[0], np.cumsum(counts[inverse])])
            n_words = np.diff(starts)
            blanks = np.concatenate([[0], np.cumsum(space)])
            blanks = blanks[offsets[1:]] - blanks[offsets[:-1]]
            filled = np.diff(offsets) > 0
            opens = filled.copy()
            opens[filled] = ~space[offsets[:-1][filled]]
            lone = blanks + opens - n_words  # marks with no word behind them
            tokens = total[starts[1:]] - total[starts[:-1]] + lone * mark
            yield pa.RecordBatch.from_arrays(
                [piece.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(tokens, pa.int64())], ["doc_id", "n_words", "n_tokens"])

    return only(docs, "doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, n_words long, n_tokens long")
