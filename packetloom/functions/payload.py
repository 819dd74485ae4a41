"""Payload functions: attack patterns, DNS names, entropy, printable share, shellcode."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom import vocab
from packetloom.functions.columns import contains_any


def http_class(payload: Column) -> Column:
    """``HTTP_<class>`` of the first class with a pattern in the text, null if none."""
    text = F.lower(payload)
    chain = None
    for name, patterns in vocab.HTTP_PATTERNS.items():
        condition = contains_any(text, patterns)
        value = f"HTTP_{name}"
        chain = F.when(condition, value) if chain is None else chain.when(condition, value)
    return chain


def dns_class(query: Column) -> Column:
    """Tunnel or exfiltration class of a DNS name, null if unsuspicious."""
    text = F.lower(query)
    return (
        F.when(F.length(text) > 50, "DNS_TUNNELING")
        .when(contains_any(text, vocab.DNS_KEYWORDS), "DNS_EXFILTRATION")
        .when(F.regexp_count(text, F.lit("[0-9]")) > 5, "DNS_EXFILTRATION")
    )


def payload_text(df: DataFrame, name: str = "payload") -> Column:
    """A payload column as text; captured bytes become one character each, so that ratios and
    entropies are over bytes."""
    if isinstance(df.schema[name].dataType, T.BinaryType):
        return F.decode(df[name], "ISO-8859-1")
    return df[name]


def printable_ratio(text: Column) -> Column:
    """Share of printable ASCII characters; 0 for empty text."""
    length = F.length(text)
    printable = F.length(F.regexp_replace(text, r"[^\x20-\x7e\t\n\r\x0b\x0c]", ""))
    return F.when(length > 0, printable / length).otherwise(F.lit(0.0))


def _entropy(data: bytes | None) -> float:
    if not data:
        return 0.0
    counts = np.bincount(np.frombuffer(data, dtype=np.uint8), minlength=256)
    p = counts[counts > 0] / len(data)
    return float(-(p * np.log2(p)).sum())


@F.pandas_udf(T.DoubleType())
def byte_entropy(data: pd.Series) -> pd.Series:
    """Shannon entropy (bits) of the byte histogram; 0 for empty or null payloads."""
    return data.map(_entropy, na_action=None)


def text_entropy(text: Column) -> Column:
    """Shannon entropy (bits) over characters, without leaving the JVM; for short texts.

    The distinct characters are few, so each is counted with one ``replace`` over the text;
    H = log2(n) - sum(c * log2(c)) / n.
    """
    n = F.length(text).cast("double")
    # splitting is faster but cuts UTF-16 units, so it serves plain ASCII only
    whole = F.regexp_extract_all(text, F.lit("(?s)."), F.lit(0))
    characters = F.when(F.octet_length(text) == F.length(text), F.split(text, "")).otherwise(whole)
    counts = F.transform(F.array_distinct(characters), lambda c: n - F.length(F.replace(text, c, F.lit(""))))
    weighted = F.aggregate(counts, F.lit(0.0), lambda acc, c: acc + c * F.log2(c))
    return F.when(n > 0, F.log2(n) - weighted / n).otherwise(F.lit(0.0))


def nop_sled(data: Column) -> Column:
    """True where a known no-op sequence starts at a byte boundary."""
    return F.hex(data).rlike("^(..)*?(" + "|".join(vocab.NOP_SEQUENCES) + ")")


def is_shellcode(data: Column, entropy: Column) -> Column:
    """No-op sled, or entropy above the limit, in the raw bytes."""
    return F.coalesce(nop_sled(data), F.lit(False)) | (F.coalesce(entropy, F.lit(0.0)) > vocab.SHELLCODE_ENTROPY)
