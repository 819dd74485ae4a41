"""Word hashes of whole Arrow batches of texts, computed with numpy inside a task.

A word is a run of bytes that are no white space (space, tab to carriage return); A-Z count as
a-z. Its 64-bit hash is a polynomial over the UTF-8 bytes, read off one running sum, so that no
Python code runs per word. Long batches are walked in blocks that end at white space, which bounds
the memory whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


_VALUES = mix(np.arange(1, 257, dtype=np.uint64)) | np.uint64(1)


def _running_powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK), base, np.uint64)
        steps[0] = 1
        have = _powers[base] = np.cumprod(steps)
    return have[:n]


def text_bytes(texts: pa.Array, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column and the offset of each row's text; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    raw = raw[at[0]:at[-1]]
    return (_LOWER[raw] if lower else raw), at - at[0]


def _blocks(space: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    start, n = 0, len(space)
    while start < n:
        end = min(n, start + BLOCK)
        if end < n:
            cuts = np.flatnonzero(space[start:end])
            row = offsets[np.searchsorted(offsets, end, "right") - 1]
            cut = max(start + int(cuts[-1]) + 1 if len(cuts) else start, int(row))
            while cut <= start and end < n:  # one word longer than the block
                end = min(n, end + BLOCK)
                more = np.flatnonzero(space[start:end])
                nxt = int(offsets[np.searchsorted(offsets, start, "right")])
                cut = min(start + int(more[0]) + 1 if len(more) else end, nxt if nxt > start else end)
                if not len(more) and nxt >= end and end < n:
                    cut = start
            end = cut if cut > start else n
        yield start, end
        start = end


def word_hashes(
    data: np.ndarray, offsets: np.ndarray, space: np.ndarray | None = None, spans: bool = False,
) -> tuple[np.ndarray, ...]:
    """Hashes of all words in order, and where each row's words begin (one more than rows).

    ``space`` marks the bytes that separate words (default: white space). With ``spans`` the first
    and last byte of every word follow.
    """
    space = _SPACE[data] if space is None else space
    hashes, starts, ends = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    rows = np.zeros(len(data) + 1, bool)
    rows[offsets] = True
    for begin, end in _blocks(space, offsets):
        part, gap, edge = data[begin:end], space[begin:end], rows[begin:end + 1].copy()
        edge[0] = edge[-1] = True
        word = ~gap
        first = word.copy()
        first[1:] &= gap[:-1] | edge[1:-1]
        last = word.copy()
        last[:-1] &= gap[1:] | edge[1:-1]
        a, b = np.flatnonzero(first), np.flatnonzero(last)
        terms = _VALUES[part]
        terms *= _running_powers(_BASE, len(part))
        total = np.cumsum(terms)
        value = total[b]
        value[a > 0] -= total[a[a > 0] - 1]
        value *= _running_powers(_INVERSE, len(part))[a]
        value += (b - a).astype(np.uint64)
        hashes.append(mix(value))
        starts.append(a + begin)
        ends.append(b + begin)
    at = np.concatenate(starts)
    found = np.concatenate(hashes), np.searchsorted(at, offsets)
    return (*found, at, np.concatenate(ends)) if spans else found


_STEPS = mix(np.arange(1001, 1065, dtype=np.uint64)) | np.uint64(1)


def windows(hashes: np.ndarray, starts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all ``size``-word windows and the word index at which each begins."""
    n = max(0, len(hashes) - size + 1)
    total = np.zeros(n, np.uint64)
    for j in range(size):
        total += hashes[j:j + n] * _STEPS[j]
    ends = np.repeat(starts[1:], np.diff(starts))[:n]
    inside = np.flatnonzero(np.arange(n) + size <= ends)
    return mix(total[inside]), inside


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Sorted distinct ``size``-word shingles of each row; a shorter text is one shingle."""
    hashes, starts = word_hashes(*text_bytes(texts))
    values, at = windows(hashes, starts, size)
    bounds = np.searchsorted(at, starts)
    for i in range(len(starts) - 1):
        a, b = starts[i], starts[i + 1]
        if b - a >= size:
            yield np.unique(values[bounds[i]:bounds[i + 1]])
        elif b > a:
            yield mix(np.array([(hashes[a:b] * _STEPS[:b - a]).sum(dtype=np.uint64) + np.uint64(b - a)]))
        else:
            yield np.zeros(0, np.uint64)


def slices(batches, column: str = "text", limit: int = 4 << 20):
    """Arrow batches cut so that the texts of one piece hold about ``limit`` bytes."""
    for batch in batches:
        lengths = pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False)
        piece = (np.cumsum(lengths, dtype=np.int64) - lengths) // limit
        cuts = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            if b > a:
                yield batch.slice(a, b - a)
