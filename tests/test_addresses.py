"""Address keys, network tests and the network join against the ipaddress module."""

import ipaddress
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from packetloom.functions.addresses import LOWEST, with_address_key
from packetloom.operators import lookups

SPELLINGS = ["::", "::1", "1::", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "::2:3:4:5:6:7:8", "FE80::A", "2001:db8::ffff:0:1", "::ffff:10.0.0.1",
             "64:ff9b::192.0.2.33", "ffff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "8000::", "7fff:ffff:ffff:ffff::", "0:0:0:0:8000::", "10.0.0.1", "255.255.255.255",
             "0.0.0.0"]
NO_ADDRESS = ["", ":", ":::", "1:2", "1:2:3:4:5:6:7:8:9", "1::2::3", "12345::", "g::", "1.2.3", "x", "fe80::1%eth0", "::1/128", None]


def test_keys_order_like_addresses(spark):
    rows = spark.createDataFrame([(t,) for t in SPELLINGS + NO_ADDRESS], "ip string")
    rows = with_address_key(rows, "ip", "k").collect()
    for r in rows:
        if r.ip in NO_ADDRESS:
            assert r.k is None, r.ip
            continue
        number = int(ipaddress.ip_address(r.ip))
        if "." in r.ip and ":" not in r.ip:
            assert tuple(r.k) == (4, 0, number)
        else:
            assert tuple(r.k) == (6, (number >> 64) + LOWEST, (number & (1 << 64) - 1) + LOWEST), r.ip


def holds(ip, network):
    return ip.version == network.version and ip in network


@pytest.mark.parametrize("chunk", ["1000000", "40"])
def test_join_with_nested_networks(spark, chunk):
    rng = np.random.default_rng(int(chunk))
    nets, ips = set(), set()
    for _ in range(60):
        v4, v6 = int(rng.integers(0, 2**32)), int.from_bytes(rng.bytes(16), "big")
        for base, width, lengths in ((v4, 32, (0, 3, 8, 17, 24, 30, 32)), (v6, 128, (0, 1, 48, 63, 64, 65, 100, 127, 128))):
            for n in rng.choice(lengths, 2):
                network = ipaddress.ip_network((base, int(n)) if width == 128 or n else (base, 0), strict=False)
                nets.add(str(network))
                inside = int(network.network_address)
                for x in (inside, int(network.broadcast_address), inside - 1, int(network.broadcast_address) + 1):
                    if 0 <= x < 2**width:
                        ips.add(str(ipaddress.IPv4Address(x) if network.version == 4 else ipaddress.IPv6Address(x)))
    rows = [(i, k) for k, i in enumerate(sorted(ips))] * 2 + [(None, -1), ("none", -2)]
    spark.conf.set("packetloom.rowsPerChunk", chunk)
    joined = lookups.network_join(spark.createDataFrame(rows, "ip string, k int"), "ip", spark.createDataFrame([(n, 7) for n in sorted(nets)], "network string, tag int"))
    got = Counter((r.ip, r.k, r.network) for r in joined.collect())
    spark.conf.unset("packetloom.rowsPerChunk")
    parsed = [(n, ipaddress.ip_network(n)) for n in nets]
    want = Counter()
    for i, k in rows[:-2]:
        a = ipaddress.ip_address(i)
        want.update((i, k, n) for n, network in parsed if holds(a, network))
    assert got == want and joined.columns == ["ip", "k", "network", "tag"]


def test_rows_are_not_copied_per_prefix_length(spark):
    nets = spark.createDataFrame([(f"10.0.0.0/{n}",) for n in range(33)], "network string")
    df = spark.range(1000).select(F.lit("192.168.0.1").alias("ip"), "id")
    joined = lookups.network_join(df, "ip", nets)
    assert joined.count() == 1000  # 0.0.0.0/0 alone
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "bin(" not in plan and "_bits" not in plan


def test_six_bit_networks_as_flags(spark):
    rows = [(t,) for t in SPELLINGS + NO_ADDRESS]
    nets = ["::/3", "8000::/1", "2001:db8::/120", "10.0.0.0/8", "::ffff:0:0/96"]
    df = spark.createDataFrame(rows, "ip string")
    for n in nets:
        got = {r.ip for r in lookups.in_networks(df, {"x": "ip"}, [n]).where("x").collect()}
        assert got == {t for t in SPELLINGS if holds(ipaddress.ip_address(t), ipaddress.ip_network(n))}, n
