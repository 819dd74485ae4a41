"""Captures read in ranges against the same files read whole."""

import random
import struct

import pytest

from packetloom.sources import pcap
from test_sources import capture, frame
from test_wider_inputs import next_generation


def frames(n, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        body = rng.randbytes(rng.choice([0, 3, 40, 700]))
        if i % 7 == 0:  # a capture inside a packet, and zeros that look like empty records
            body = capture([b"x" * 5] * 9)[24:] + b"\0" * 64
        out.append(frame(17, struct.pack("!HHHH", 1000 + i, 53, 8 + len(body), 0) + body))
    return out


def sections(parts):
    """A pcapng file of several sections, one of them big-endian with a second interface."""
    def block(kind, body, order):
        body += b"\0" * (-len(body) % 4)
        return struct.pack(order + "II", kind, len(body) + 12) + body + struct.pack(order + "I", len(body) + 12)

    out = next_generation(parts[:20])
    out += block(0x0A0D0D0A, struct.pack(">IHHq", 0x1A2B3C4D, 1, 0, -1), ">")
    for link, power in ((1, 6), (1, 9)):
        out += block(1, struct.pack(">HHI", link, 0, 0) + struct.pack(">HHBxxx", 9, 1, power), ">")
    for i, f in enumerate(parts[20:]):
        at = (500 + i) * (10 ** 9 if i % 2 else 10 ** 6)
        out += block(6, struct.pack(">IIIII", i % 2, at >> 32, at & 0xFFFFFFFF, len(f), len(f)) + f, ">")
        if i == 10:
            out += block(5, b"\0" * 12, ">")  # statistics: no packet
    return out


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    path = tmp_path_factory.mktemp("captures")
    (path / "a.pcap").write_bytes(capture(frames(60)))
    (path / "b.pcap").write_bytes(capture(frames(40, 2), ">", cut=11))
    (path / "c.pcapng").write_bytes(sections(frames(50, 3)))
    (path / "d.pcap").write_bytes(b"no capture at all" * 40)
    (path / "e.pcap").write_bytes(b"")
    (path / "f.pcap").write_bytes(capture([]))
    return str(path)


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0], r[1]))


@pytest.mark.parametrize("range_bytes", [64, 1000, 20_000])
def test_ranges_hold_what_the_file_holds(spark, folder, range_bytes):
    whole = rows_of(pcap.read_pcaps(spark, folder, "*.pcap*"))
    counts = {name: sum(r[0] == name for r in whole) for name in ("a.pcap", "b.pcap", "c.pcapng")}
    assert counts == {"a.pcap": 60, "b.pcap": 39, "c.pcapng": 50} and len(whole) == 149
    assert [r[1] for r in whole if r[0] == "c.pcapng"] == list(range(50)) and max(r[2] for r in whole if r[0] == "c.pcapng") < 600
    assert rows_of(pcap.read_pcaps(spark, folder, "*.pcap*", range_bytes)) == whole


@pytest.mark.parametrize("range_bytes", [500, 1 << 27])
def test_cut_tails_are_listed(spark, folder, range_bytes):
    size = len(capture(frames(40, 2), ">"))
    last = 16 + len(frames(40, 2)[-1])
    found = pcap.cut_captures(spark, folder, "*.pcap*", range_bytes).collect()
    assert [(r.path.rsplit("/")[-1], r.length, r.whole) for r in found] == [("b.pcap", size - 11, size - last)]
    # Spark lists no empty files: there is nothing in them to skip
    assert [r.path.rsplit("/")[-1] for r in pcap.skipped_captures(spark, folder).collect()] == ["d.pcap"]


def test_one_capture_is_read_by_many_tasks(spark, folder):
    assert pcap.read_pcaps(spark, folder, "a.pcap", 2000).rdd.getNumPartitions() > 3
