"""Address texts as ordered numbers: IPv4 as one bigint, IPv6 as two."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions.packets import ipv4_number

LOWEST = -(1 << 63)  # an unsigned 64-bit number minus 2^63 sorts as a bigint


def signed(number: int) -> int:
    """An unsigned 64-bit number as the bigint that stands for it in a key."""
    return number + LOWEST


def with_ipv6_key(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Add (hi, lo) of an IPv6 text in any spelling, ordered like the addresses; null for anything else.

    Each step is a projection of its own, so that what it computes is not repeated inside the next one;
    a text without a colon is null from the first step on. The one-element explode keeps filters on the
    key above all steps; pushed below them, they would repeat each step inside the next again.
    """
    low = df.select("*", F.when(F.contains(F.col(ip), F.lit(":")), F.lower(F.col(ip))).alias("_low"))
    number = ipv4_number(F.regexp_extract("_low", r"([0-9]+\.[0-9]+\.[0-9]+\.[0-9]+)$", 1))
    dotted = low.select("*", F.when(F.contains("_low", F.lit(".")), number).alias("_tail"))
    two_groups = F.concat(F.hex(F.shiftright("_tail", 16)), F.lit(":"), F.hex(F.col("_tail").bitwiseAND(65535)))
    plain = dotted.select("*", F.when(F.col("_tail").isNotNull(), F.lower(F.concat(
        F.regexp_replace("_low", r"[0-9.]+$", ""), two_groups))).otherwise(F.col("_low")).alias("_plain"))
    sides = plain.select("*", F.when(F.contains("_plain", F.lit("::")), F.split("_plain", "::", 2)).alias("_sides"))
    left, right = F.col("_sides")[0], F.col("_sides")[1]
    size = lambda side: F.when(side == "", 0).otherwise(F.size(F.split(side, ":")))
    zeros = F.repeat(F.lit("0:"), 8 - size(left) - size(right))
    filled = F.concat(F.when(left == "", "").otherwise(F.concat(left, F.lit(":"))), zeros, right)
    full = sides.select("*", F.coalesce(F.regexp_replace(filled, ":$", ""), "_plain").alias("_full"))
    eight = full.select("*", F.when(F.col("_full").rlike("^([0-9a-f]{1,4}:){7}[0-9a-f]{1,4}$"), F.split("_full", ":")).alias("_groups"))
    half = lambda at: functools.reduce(
        lambda a, b: a.bitwiseOR(b), [F.shiftleft(F.conv(F.col("_groups")[at + i], 16, 10).cast("long"), 48 - 16 * i) for i in range(4)])
    key = F.struct(half(0).bitwiseXOR(F.lit(LOWEST)).alias("hi"), half(4).bitwiseXOR(F.lit(LOWEST)).alias("lo"))
    return eight.select(*[F.col(f"`{c}`") for c in df.columns], F.explode(F.array(F.when(F.col("_groups").isNotNull(), key))).alias(out))


def with_address_key(df: DataFrame, ip: str, out: str) -> DataFrame:
    """Add (family, hi, lo) of an address text; null for anything else. IPv4 has its number in ``lo``."""
    both = with_ipv6_key(df, ip, "_six").select("*", ipv4_number(F.col(ip)).alias("_four"))
    four = F.struct(F.lit(4).alias("family"), F.lit(0).cast("long").alias("hi"), F.col("_four").alias("lo"))
    six = F.struct(F.lit(6).alias("family"), F.col("_six.hi").alias("hi"), F.col("_six.lo").alias("lo"))
    return both.withColumn(out, F.when(F.col("_four").isNotNull(), four).when(F.col("_six").isNotNull(), six)).drop("_four", "_six")
