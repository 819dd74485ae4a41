"""Fill-in-middle: texts cut at two drawn unit ranks, found in an indexable skip list.

A unit is a word with the white space before it, or the white space a text ends with. The units of a
text form the ground lane of a skip list; every express lane keeps about a quarter of the nodes below
it, and each link carries how many units and how many code points it jumps over. A cut rank is reached
by descending from the top lane: links are taken while their units still fit, and the code points they
add up to are the place of the cut. Cuts are thus exact in units and in code points, and no text is
walked unit by unit.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from packetloom.llm.tables import only
from packetloom.llm.words import mix, slices, text_bytes

MARKERS = ("<P>", "<S>", "<M>")
LANE_END = 8  # a lane this short needs no express lane above it
_BLOCK = 1 << 20


class SkipList:
    """Express lanes over units of the given code-point widths."""

    def __init__(self, chars: np.ndarray):
        self.size = len(chars)
        at, units = np.arange(self.size), np.ones(self.size, np.int64)
        self.lanes = [(units, chars, None)]
        while len(at) > LANE_END:
            salt = np.uint64(len(self.lanes))
            stays = mix(at.astype(np.uint64) + (salt << np.uint64(56))) >> np.uint64(62) == 0
            stays[0] = True
            down = np.flatnonzero(stays)
            units, chars, at = np.add.reduceat(units, down), np.add.reduceat(chars, down), at[down]
            below = len(self.lanes[-1][0])
            self.lanes.append((units, chars, np.append(down, below)))

    def seek(self, rank: int) -> int:
        """Code points in front of the unit of this rank; all of them for ``rank == size``."""
        i, units_passed, chars_passed = 0, 0, 0
        for units, chars, down in reversed(self.lanes):
            while i < len(units) and units_passed + units[i] <= rank:
                units_passed += int(units[i])
                chars_passed += int(chars[i])
                i += 1
            if down is not None:
                i = int(down[i])
        return chars_passed


def unit_widths(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of every unit of a batch of texts, and where each row's units begin."""
    last = np.zeros(len(data) + 1, bool)
    last[offsets[1:]] = True  # entry i + 1: byte i ends its row (entry 0 is for empty rows)
    chars, ends = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    left = 0  # code points of a unit that runs on from the block before
    for a in range(0, len(data), _BLOCK):
        b = min(len(data), a + _BLOCK)
        part, row_end = data[a:b], last[a + 1:b + 1]
        space = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
        ahead = np.empty_like(space)  # white space follows
        ahead[:-1] = space[1:]
        ahead[-1] = b < len(data) and (data[b] == 0x20 or 0x09 <= data[b] <= 0x0D)
        end = np.flatnonzero(row_end | (~space & ahead))
        points = np.cumsum((part & 0xC0) != 0x80)
        here = points[end]
        chars.append(np.diff(here, prepend=0))
        if len(end):
            chars[-1][0] += left
            left = int(points[-1] - here[-1])
        else:
            left += int(points[-1])
        ends.append(end + a)
    ends = np.concatenate(ends)
    return np.concatenate(chars), np.searchsorted(ends, offsets)


def draws(seed: int, doc_id) -> list[int]:
    """Four 32-bit numbers that depend on the seed and the document alone."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 16, 4)]


def arrange(text: str, a: int, b: int, form: str) -> str:
    """``text`` cut at code points ``a`` and ``b``, in the order of the form."""
    p, s, m = MARKERS
    if form == "psm":
        return f"{p}{text[:a]}{s}{text[b:]}{m}{text[a:b]}"
    return f"{s}{text[b:]}{p}{text[:a]}{m}{text[a:b]}"


def restored(output: Column, form: Column) -> Column:
    """The text an output was made from. Outputs of other forms than plain hold each marker once."""
    p, s, m = (F.instr(output, marker) for marker in MARKERS)
    first, second = F.least(p, s), F.greatest(p, s)
    part = lambda start, end: F.substring(output, start + 3, end - start - 3)
    one, two, middle = part(first, second), part(second, m), part(m, F.length(output) + 1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(one, middle, two)).otherwise(F.concat(two, middle, one))


def fill_in_middle(docs: DataFrame, seed: int = 42, rate: int = 50, spm: int = 80) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) per row of ``docs`` (doc_id, text).

    ``rate`` % of the texts are rearranged, ``spm`` % of them with the suffix first. Texts that are
    empty or hold a marker stay plain, as do rows without a doc_id, which have no draw. A null text is
    empty. Repeated rows come out alike, an empty table gives no rows, extra columns are ignored. A
    text is taken whole, however long; the working arrays of one text are a few times its own size.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in slices(batches):
            chars, starts = unit_widths(*text_bytes(piece.column("text"), lower=False))
            ids, texts = piece.column("doc_id"), piece.column("text")
            counts, forms, prefixes, middles, outputs = np.diff(starts), [], [], [], []
            for i, n in enumerate(counts.tolist()):
                doc_id, text = ids[i].as_py(), texts[i].as_py() or ""
                h1, h2, h3, h4 = draws(seed, doc_id)
                if not text or doc_id is None or h3 % 100 >= rate or any(marker in text for marker in MARKERS):
                    forms.append("plain")
                    prefixes.append(None)
                    middles.append(None)
                    outputs.append(text)
                    continue
                units = SkipList(chars[starts[i]:starts[i + 1]])
                a, b = sorted(units.seek(h % (n + 1)) for h in (h1, h2))
                form = "spm" if h4 % 100 < spm else "psm"
                forms.append(form)
                prefixes.append(a)
                middles.append(b - a)
                outputs.append(arrange(text, a, b, form))
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(counts, pa.int64()), pa.array(forms, pa.string()), pa.array(prefixes, pa.int64()),
                 pa.array(middles, pa.int64()), pa.array(outputs, pa.string())],
                ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, "doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def fill_in_middle_digests(docs: DataFrame) -> DataFrame:
    """The operator's result with SHA-256 digests of the output and of the text rebuilt from it."""
    made = fill_in_middle(docs)
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
        F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


def oracle_sql() -> str:
    unit = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
    draw = ", ".join(f"CAST('0x' || substr(digest, {8 * i + 1}, 8) AS UBIGINT) AS h{i + 1}" for i in range(4))
    return rf"""
WITH texts AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || CAST(doc_id AS VARCHAR)) AS digest FROM documents
), units AS (
  SELECT *, regexp_extract_all(text, '{unit}') AS u FROM texts
), drawn AS (
  SELECT *, CAST(len(u) AS BIGINT) AS n, {draw} FROM units
), formed AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN doc_id IS NULL OR text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
      OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM drawn
), cut AS (
  SELECT *, array_to_string(list_slice(u, 1, CAST(a AS BIGINT)), '') AS prefix,
    array_to_string(list_slice(u, CAST(a AS BIGINT) + 1, CAST(b AS BIGINT)), '') AS middle,
    array_to_string(list_slice(u, CAST(b AS BIGINT) + 1, n), '') AS suffix
  FROM formed
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle
    ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM cut"""
