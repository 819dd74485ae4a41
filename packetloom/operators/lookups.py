"""Joins with small dimensions, address ranges and earlier decisions."""

from __future__ import annotations

import functools
import ipaddress
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packetloom.functions.addresses import LOWEST, signed, with_address_key, with_ipv6_key
from packetloom.functions.packets import ipv4_number
from packetloom.operators.timeline import cut_points, running
from packetloom.session import materialise

BROADCAST_ROWS = 50_000


def small_side(df: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Broadcast ``df`` when it is proven small; one row past the limit is enough to refuse.

    The check evaluates the side, so the rows it fetched (never more than the limit) are reused
    instead of computing them again. A larger side stays a plain, distributed join.
    """
    rows = df.limit(limit + 1).toArrow()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if rows.num_rows <= limit else df


def dimension(df: DataFrame, key: Column, dim: DataFrame, dim_key: str, value: str, default: Column, out: str) -> DataFrame:
    """Left lookup of ``value`` in a dimension table; ``default`` where the key is absent."""
    named = small_side(dim.select(F.col(dim_key).alias("_dim_key"), F.col(value).alias("_dim_value")))
    return df.join(named, key == F.col("_dim_key"), "left").withColumn(
        out, F.coalesce("_dim_value", default)).drop("_dim_key", "_dim_value")


def _network_test(ip: str, six: str, network: str) -> Column:
    net = ipaddress.ip_network(network)
    first, last = int(net.network_address), int(net.broadcast_address)
    if net.version == 4:
        return F.coalesce(ipv4_number(F.col(ip)).between(first, last), F.lit(False))
    halves = lambda n: (signed(n >> 64), signed(n & (1 << 64) - 1))
    key, (hi_1, lo_1), (hi_2, lo_2) = F.col(six), halves(first), halves(last)
    inside = key["hi"].between(hi_1, hi_2)
    if hi_1 == hi_2:
        inside = inside & key["lo"].between(lo_1, lo_2)
    return F.coalesce(inside, F.lit(False))


def in_networks(df: DataFrame, outs: dict[str, str], networks: list[str]) -> DataFrame:
    """Flag columns: is the address column inside one of a few fixed networks."""
    keyed, sixes = df, {ip: f"_six_{i}" for i, ip in enumerate(sorted(set(outs.values())))}
    if any(ipaddress.ip_network(n).version == 6 for n in networks):
        for ip, six in sixes.items():
            keyed = with_ipv6_key(keyed, ip, six)

    def test(ip: str) -> Column:
        return functools.reduce(lambda a, b: a | b, [_network_test(ip, sixes[ip], n) for n in networks], F.lit(False))

    return keyed.select(*[F.col(f"`{c}`") for c in df.columns], *[test(ip).alias(out) for out, ip in outs.items()])


BLOCK = T.StructType([T.StructField("_family", T.IntegerType()), T.StructField("_n", T.IntegerType()),
                      T.StructField("_hi", T.LongType()), T.StructField("_lo", T.LongType())])
HALF = (1 << 64) - 1


def _key_of(family: int, number: int) -> tuple[int, int]:
    """(hi, lo) as in ``with_address_key``."""
    return (0, number) if family == 4 else (signed(number >> 64), signed(number & HALF))


def _number_of(family: int, hi: int, lo: int) -> int:
    return lo if family == 4 else (hi - LOWEST) << 64 | (lo - LOWEST)


def _range_blocks(ranges: DataFrame) -> DataFrame:
    """IPv4 ranges (lo, hi) as aligned blocks, at most 62 each."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for row in frame.dropna(subset=["lo", "hi"]).to_dict("records"):
                lo, hi = int(row.pop("lo")), int(row.pop("hi"))
                if lo <= hi:
                    nets = ipaddress.summarize_address_range(ipaddress.IPv4Address(lo), ipaddress.IPv4Address(hi))
                    found += [{**row, "_family": 4, "_n": n.prefixlen, "_hi": 0, "_lo": int(n.network_address)} for n in nets]
            yield pd.DataFrame(found, columns=[*[c for c in frame.columns if c not in ("lo", "hi")], "_family", "_n", "_hi", "_lo"])

    kept = ranges.drop("lo", "hi").schema
    return ranges.mapInPandas(run, T.StructType([*kept.fields, *BLOCK.fields]))


def _text_blocks(networks: DataFrame) -> DataFrame:
    """Networks by their text; texts that name none drop out."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            blocks = []
            for text in frame["network"]:
                try:
                    net = ipaddress.ip_network(text or "", strict=False)
                    blocks.append((net.version, net.prefixlen, *_key_of(net.version, int(net.network_address))))
                except ValueError:
                    blocks.append(None)
            fit = np.array([b is not None for b in blocks], bool)
            named = pd.DataFrame([b for b in blocks if b], columns=["_family", "_n", "_hi", "_lo"], index=frame.index[fit])
            yield pd.concat([frame[fit], named], axis=1)

    return networks.mapInPandas(run, T.StructType([*networks.schema.fields, *BLOCK.fields]))


def _cuts(blocks: DataFrame) -> DataFrame:
    """Where a block starts or the address behind it, per family."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for family, n, hi, lo in frame[["_family", "_n", "_hi", "_lo"]].itertuples(index=False):
                width = 32 if family == 4 else 128
                behind = _number_of(family, hi, lo) + (1 << width - n)
                found.append((family, hi, lo))
                if behind < 1 << width:
                    found.append((family, *_key_of(family, behind)))
            yield pd.DataFrame(found, columns=["_family", "_hi", "_lo"])

    return blocks.mapInPandas(run, "_family int, _hi long, _lo long").distinct()


def _holders(cuts: DataFrame, lengths: list[tuple[int, int]]) -> DataFrame:
    """Every cut with the blocks of the given (family, bits) that would hold it."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = []
            for family, hi, lo in frame[["_family", "_hi", "_lo"]].itertuples(index=False):
                number, width = _number_of(family, hi, lo), 32 if family == 4 else 128
                found += [(family, hi, lo, n, *_key_of(family, number >> width - n << width - n)) for f, n in lengths if f == family]
            yield pd.DataFrame(found, columns=["_family", "_at_hi", "_at_lo", "_n", "_hi", "_lo"])

    return cuts.mapInPandas(run, "_family int, _at_hi long, _at_lo long, _n int, _hi long, _lo long")


def network_join(df: DataFrame, ip: str, networks: DataFrame) -> DataFrame:
    """Rows whose address lies in one of many networks, with the network's columns.

    ``networks`` holds either ``network`` texts such as ``10.0.0.0/8`` or ``2001:db8::/32`` alone, or
    IPv4 ranges ``(lo, hi, network)``, which become aligned blocks. Starts and ends of all blocks cut the
    address space into intervals inside which no block begins or ends. Each distinct address looks up
    its interval as the last cut at or before it, an ordered scan that is balanced over the addresses;
    which blocks hold an interval is found from the cuts alone, by equality of their leading bits. Rows
    meet the result by their address, so no row is copied and no wide block gathers rows.
    """
    listed = _range_blocks(networks) if "lo" in networks.columns else _text_blocks(networks)
    listed = materialise(listed, "networks")
    block = ["_family", "_n", "_hi", "_lo"]
    blocks = listed.select(block).distinct()
    cuts = materialise(_cuts(blocks), "cuts")
    lengths = [tuple(r) for r in listed.select("_family", "_n").distinct().collect()]  # 162 at most
    holders = _holders(cuts, lengths).join(blocks, block)

    place = F.when(F.col("_family") == 4, F.col("_lo").cast("double")).otherwise(F.lit(1e20) + F.col("_hi").cast("double")).alias("_place")
    found = with_address_key(df.select(F.col(ip).alias("_ip")).distinct(), "_ip", "_key").where("_key is not null").select(
        "_ip", F.col("_key.family").alias("_family"), F.col("_key.hi").alias("_hi"), F.col("_key.lo").alias("_lo"))
    found = materialise(found.select("*", place), "addresses")
    both = found.withColumn("_is_row", F.lit(1)).unionByName(cuts.select("*", place, F.lit(0).alias("_is_row")), allowMissingColumns=True)
    at = F.when(F.col("_is_row") == 0, F.struct(F.col("_hi").alias("hi"), F.col("_lo").alias("lo")))
    located = running(both, ["_family"], ["_place", "_hi", "_lo", "_is_row"], cut_points(found, "_place"), lasts={"_at": at})
    located = located.where("_is_row = 1").select("_ip", "_family", F.col("_at.hi").alias("_at_hi"), F.col("_at.lo").alias("_at_lo"))
    matched = located.join(holders, ["_family", "_at_hi", "_at_lo"]).join(listed, block).drop("_at_hi", "_at_lo", *block)
    return df.join(matched, F.col(ip) == F.col("_ip")).drop("_ip")


def drop_decided(packets: DataFrame, decisions: DataFrame, keys: list[str]) -> DataFrame:
    """Packets of flows not yet judged benign."""
    return packets.join(decisions.where("decision = 'benign'").select(*keys).distinct(), keys, "left_anti")


def prefix_labels(files: DataFrame, name: str, prefixes: DataFrame, suffix: str = ".csv") -> DataFrame:
    """Files with the label of every prefix their name starts with; other files drop out.

    Prefixes have few lengths, so each name is cut at those lengths and joined by equality.
    """
    lengths = [r[0] for r in prefixes.select(F.length("prefix")).distinct().collect()]
    cut = F.explode(F.array_distinct(F.array(*[F.substring(name, 1, n) for n in sorted(lengths)])))
    named = files.where(F.endswith(F.col(name), F.lit(suffix))).select("*", cut.alias("prefix"))
    return named.join(small_side(prefixes), "prefix")


def keep_classes(df: DataFrame, label: str, min_rows: int = 2) -> DataFrame:
    """Rows of classes with at least ``min_rows`` rows."""
    valid = df.groupBy(label).count().where(F.col("count") >= min_rows).select(label)
    return df.join(small_side(valid), label, "left_semi")


def unseen(labels: DataFrame, known: DataFrame, label: str) -> DataFrame:
    """Distinct labels the known table does not hold."""
    return labels.select(label).distinct().join(known.select(label), label, "left_anti")
