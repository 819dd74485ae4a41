"""Capture files as packet rows: one task per byte range, records unpacked in Arrow batches."""

from __future__ import annotations

import re
import socket
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.session import materialise

PACKET_SCHEMA = (
    "file string, pkt_id long, ts_s double, ip_version int, src_ip string, dst_ip string, proto int, sport int, dport int, "
    "length int, ttl int, tcp_flags int, tcp_window int, tcp_seq long, tcp_ack long, udp_len int, icmp_type int, icmp_code int, payload binary"
)
COLUMNS = [c.split()[0] for c in PACKET_SCHEMA.split(", ")]
BATCH = 50_000
RANGE = 128 << 20  # bytes of a capture that one task reads
MOST_TASKS = 100_000
CHAIN = 8  # plausible records in a row that make a start
# File magic -> (byte order, seconds per fraction unit).
MAGICS = {b"\xd4\xc3\xb2\xa1": ("<", 1e-6), b"\xa1\xb2\xc3\xd4": (">", 1e-6), b"\x4d\x3c\xb2\xa1": ("<", 1e-9), b"\xa1\xb2\x3c\x4d": (">", 1e-9)}

NEXT_GENERATION = b"\x0a\x0d\x0d\x0a"


def _transport(proto: int, data: bytes) -> dict:
    if proto == 6 and len(data) >= 20:
        sport, dport, seq, ack, offset, flags, window = struct.unpack("!HHIIBBH", data[:16])
        return {"sport": sport, "dport": dport, "tcp_seq": seq, "tcp_ack": ack, "tcp_flags": flags, "tcp_window": window, "payload": data[(offset >> 4) * 4:]}
    if proto == 17 and len(data) >= 8:
        sport, dport, size = struct.unpack("!HHH", data[:6])
        return {"sport": sport, "dport": dport, "udp_len": size, "payload": data[8:]}
    if proto in (1, 58) and len(data) >= 2:
        return {"icmp_type": data[0], "icmp_code": data[1], "payload": data[8:]}
    return {"payload": data}


def _network(frame: bytes) -> dict:
    """IP header and transport fields; empty for frames that are not IP."""
    if not frame:
        return {}
    version = frame[0] >> 4
    if version == 4 and len(frame) >= 20:
        header, total = (frame[0] & 15) * 4, struct.unpack("!H", frame[2:4])[0]
        return {"ip_version": 4, "ttl": frame[8], "proto": frame[9], "src_ip": socket.inet_ntop(socket.AF_INET, frame[12:16]),
                "dst_ip": socket.inet_ntop(socket.AF_INET, frame[16:20]), **_transport(frame[9], frame[header:max(total, header)])}
    if version == 6 and len(frame) >= 40:
        size = struct.unpack("!H", frame[4:6])[0]
        return {"ip_version": 6, "ttl": frame[7], "proto": frame[6], "src_ip": socket.inet_ntop(socket.AF_INET6, frame[8:24]),
                "dst_ip": socket.inet_ntop(socket.AF_INET6, frame[24:40]), **_transport(frame[6], frame[40:40 + size])}
    return {}


def _link_payload(link: int, frame: bytes) -> bytes:
    """Network-layer bytes of Ethernet (VLAN tags skipped), raw IP and loopback frames."""
    if link == 1:
        at = 12
        while frame[at:at + 2] in (b"\x81\x00", b"\x88\xa8"):
            at += 4
        return frame[at + 2:] if frame[at:at + 2] in (b"\x08\x00", b"\x86\xdd") else b""
    return frame[4:] if link == 0 else frame


class _File:
    """Byte ranges of a file, read ahead a block at a time."""

    AHEAD = 1 << 20

    def __init__(self, path: str, size: int):
        if path.startswith("file:"):
            system, name = fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
        else:  # the names Hadoop has for stores that Arrow knows
            system, name = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", path))
        self.file, self.size, self.at, self.block = system.open_input_file(name), size, 0, b""

    def get(self, at: int, n: int) -> bytes:
        """Up to ``n`` bytes; fewer at the end of the file."""
        if at < self.at or at + n > self.at + len(self.block):
            self.at, self.block = at, self.file.read_at(max(n, self.AHEAD), at) if at < self.size else b""
        return self.block[at - self.at:at - self.at + n]

    def close(self) -> None:
        self.file.close()


class _Classic:
    """Records of a classic capture: a file header, then one fixed header per record."""

    step, first = 1, 24

    def __init__(self, head: bytes):
        self.order, self.unit = MAGICS[head[:4]]
        snap, link = struct.unpack(self.order + "II", head[16:24])
        self.link, self.most = link & 0x0FFFFFFF, max(snap, 262_144)

    def size(self, file: _File, at: int) -> int | None:
        """Bytes of the record at a place; None if the file does not hold all of it."""
        head = file.get(at, 16)
        if len(head) < 16:
            return None
        size = 16 + struct.unpack(self.order + "I", head[8:12])[0]
        return size if at + size <= file.size else None

    def likely(self, file: _File, at: int) -> bool:
        head = file.get(at, 16)
        if len(head) < 16:
            return False
        _, fraction, kept, length = struct.unpack(self.order + "IIII", head)
        return fraction * self.unit < 1 and kept <= min(length, self.most)

    def mark(self, file: _File, at: int, size: int) -> bytes:
        return b""

    def holds_packet(self, file: _File, at: int) -> bool:
        return True

    def packet(self, file: _File, at: int, size: int) -> tuple[float, int, int, bytes] | None:
        """(time, original length, link type, frame) of the record."""
        seconds, fraction, _, length = struct.unpack(self.order + "IIII", file.get(at, 16))
        return seconds + fraction * self.unit, length, self.link, file.get(at + 16, size - 16)


class _NextGeneration:
    """Blocks of a pcapng file. Section and interface blocks hold for the packets behind them: they are
    marks, and a range that starts in the middle is told those of the blocks before it."""

    step, first = 4, 0

    def __init__(self, head: bytes):
        self.order, self.links = "<", []
        self.follow(head)

    def follow(self, block: bytes) -> None:
        """Take in a section or interface block."""
        if block[:4] == NEXT_GENERATION:
            self.order, self.links = ("<" if block[8:12] == b"\x4d\x3c\x2b\x1a" else ">"), []
            return
        body, unit, option = block[8:-4], 1e-6, 8
        while option + 4 <= len(body):  # how fine the clock of the interface is
            code, length = struct.unpack(self.order + "HH", body[option:option + 4])
            if code == 9 and length == 1:
                power = body[option + 4]
                unit = 2.0 ** -(power & 127) if power & 128 else 10.0 ** -power
            option += 4 + -(-length // 4) * 4
            if code == 0:
                break
        self.links.append((struct.unpack(self.order + "H", body[:2])[0], unit))

    def replay(self, marks: bytes) -> None:
        at = 0
        while at < len(marks):
            if marks[at:at + 4] == NEXT_GENERATION:
                self.follow(marks[at:at + 12])
            size = struct.unpack(self.order + "I", marks[at + 4:at + 8])[0]
            if marks[at:at + 4] != NEXT_GENERATION:
                self.follow(marks[at:at + size])
            at += size

    def _head(self, file: _File, at: int) -> tuple[int, int] | None:
        head = file.get(at, 12)
        if len(head) < 12:
            return None
        order = ("<" if head[8:12] == b"\x4d\x3c\x2b\x1a" else ">") if head[:4] == NEXT_GENERATION else self.order
        return struct.unpack(order + "II", head[:8])

    def size(self, file: _File, at: int) -> int | None:
        head = self._head(file, at)
        return head[1] if head and head[1] >= 12 and at + head[1] <= file.size else None

    def likely(self, file: _File, at: int) -> bool:
        head = self._head(file, at)
        if not head or head[1] < 12 or head[1] % 4 or head[1] > 1 << 26 or at + head[1] > file.size:
            return False
        return file.get(at + head[1] - 4, 4) == file.get(at + 4, 4)

    def mark(self, file: _File, at: int, size: int) -> bytes:
        head = self._head(file, at)
        if file.get(at, 4) != NEXT_GENERATION and head[0] != 1:
            return b""
        block = file.get(at, size)
        self.follow(block)
        return block

    def holds_packet(self, file: _File, at: int) -> bool:
        return self._head(file, at)[0] in (3, 6)

    def packet(self, file: _File, at: int, size: int) -> tuple[float, int, int, bytes] | None:
        """As for classic captures; simple packet blocks carry no time. None if the interface is unknown."""
        kind = self._head(file, at)[0]
        body = file.get(at + 8, size - 12)
        if kind == 6 and len(body) >= 20:
            which, high, low, kept, length = struct.unpack(self.order + "IIIII", body[:20])
            if which < len(self.links):
                return ((high << 32) + low) * self.links[which][1], length, self.links[which][0], body[20:20 + kept]
        if kind == 3 and self.links:
            return 0.0, struct.unpack(self.order + "I", body[:4])[0], self.links[0][0], body[4:]
        return None


def _layout(file: _File) -> _Classic | _NextGeneration | None:
    """What kind of capture a file is; None: no capture."""
    head = file.get(0, 24)
    if head[:4] == NEXT_GENERATION:
        return _NextGeneration(head)
    return _Classic(head) if head[:4] in MAGICS and len(head) == 24 else None


def _walk(file: _File, layout, at: int, stop: int) -> tuple[int, int, bytes]:
    """Where the first record behind ``stop`` starts, the packets before it, and the marks passed. The
    end of the file stands for a next start beyond a cut-off record, its own place for the cut."""
    n, marks = 0, []
    while at < stop:
        size = layout.size(file, at)
        if size is None:
            return -at - 1, n, b"".join(marks)
        mark = layout.mark(file, at, size)
        marks.append(mark)
        n += not mark and layout.holds_packet(file, at)
        at += size
    return at, n, b"".join(marks)


def _guess(file: _File, layout, begin: int, end: int) -> int | None:
    """The first place in a range where a run of records seems to start."""
    at = begin + -begin % layout.step
    while at < end:
        place = at
        for _ in range(CHAIN):
            if place >= file.size or not layout.likely(file, place):
                break
            place += layout.size(file, place) or file.size
        else:
            return at
        if place == file.size and place > at:  # the file ends with the run
            return at
        at += layout.step
    return None


def _scan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """What each range would hold if its guessed start is right."""
    for frame in frames:
        rows = []
        for path, length, begin, end in frame[["path", "length", "begin", "end"]].itertuples(index=False):
            file = _File(path, length)
            layout = _layout(file)
            if layout is not None:
                start = layout.first if begin == 0 else _guess(file, layout, begin, end)
                behind, n, marks = _walk(file, layout, start, end) if start is not None else (None, 0, b"")
                rows.append((path, length, begin, end, start, behind, n, marks))
            file.close()
        yield pd.DataFrame(rows, columns=["path", "length", "begin", "end", "start", "behind", "n", "marks"]).astype({"start": "Int64", "behind": "Int64"})


def _settle(frame: pd.DataFrame) -> pd.DataFrame:
    """The ranges of one file in order: a start that is not where the range before ended is put right by
    walking that range again. Adds the number of earlier packets and the marks in force."""
    rows, expected, before, marks, file = [], None, 0, b"", None
    for path, length, begin, end, start, behind, n, passed in frame.sort_values("begin").itertuples(index=False):
        start, behind = (None if pd.isna(x) else int(x) for x in (start, behind))
        if expected is None:
            expected = start
        if expected < 0 or expected >= end:  # nothing starts here
            start, behind, n, passed = expected, expected, 0, b""
        elif start != expected:
            file = file or _File(path, length)
            layout = _layout(file)
            if marks:
                layout.replay(marks)
            start, (behind, n, passed) = expected, _walk(file, layout, expected, end)
        rows.append((path, length, start, end, behind, before, marks))
        expected, before, marks = behind, before + n, marks + passed
    if file is not None:
        file.close()
    return pd.DataFrame(rows, columns=["path", "length", "start", "end", "behind", "before", "marks"])


def _read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Packets that start in each range."""
    fields = {"sport": 0, "dport": 0, "tcp_flags": 0, "tcp_window": 0, "ip_version": 0, "payload": b""}
    for frame in frames:
        for path, length, start, end, before, marks in frame[["path", "length", "start", "end", "before", "marks"]].itertuples(index=False):
            file = _File(path, length)
            layout, number, rows = _layout(file), before, []
            if layout is None or start < 0:
                file.close()
                continue
            if marks:
                layout.replay(marks)
            at = max(start, layout.first)
            while at < end and (size := layout.size(file, at)) is not None:
                if not layout.mark(file, at, size) and layout.holds_packet(file, at):
                    if (packet := layout.packet(file, at, size)) is not None:
                        ts, original, link, data = packet
                        rows.append({**fields, "file": path.rsplit("/", 1)[-1], "pkt_id": number, "ts_s": ts, "length": original,
                                     **_network(_link_payload(link, data))})
                    number += 1
                    if len(rows) == BATCH:
                        yield pd.DataFrame(rows, columns=COLUMNS)
                        rows = []
                at += size
            file.close()
            if rows:
                yield pd.DataFrame(rows, columns=COLUMNS)


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    return spark.read.format("binaryFile").load(f"{folder}/{pattern}").select("path", "length")


def _settled(files: DataFrame, range_bytes: int) -> DataFrame:
    """Ranges of the files with the place where the first record of each starts."""
    begin = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(range_bytes).cast("long")))
    ranges = files.select("path", "length", begin.alias("begin")).withColumn("end", F.least(F.col("begin") + range_bytes, F.col("length")))
    scanned = _dealt(ranges).mapInPandas(
        _scan, "path string, length long, begin long, end long, start long, behind long, n long, marks binary")
    return scanned.groupBy("path").applyInPandas(
        _settle, "path string, length long, start long, end long, behind long, before long, marks binary")


def _dealt(ranges: DataFrame) -> DataFrame:
    """One task per range, up to a bound: their few bytes say nothing about the work."""
    return ranges.repartition(max(1, min(ranges.count(), MOST_TASKS)))


def read_pcaps(spark: SparkSession, folder: str, pattern: str = "*.pcap", range_bytes: int = RANGE) -> DataFrame:
    """Packets of every capture file in ``folder``; ``pkt_id`` counts inside a file.

    A file above ``range_bytes`` is read by one task per range. Records carry no marker, so a range guesses
    its first record from a run of plausible headers; the ranges of a file are then held against each other,
    and where one does not start where the one before ends, it is walked again from there. Guesses thus
    cost time when wrong, never rows. Files are opened by Arrow's file systems (local, HDFS, S3, GCS).
    """
    files = _files(spark, folder, pattern)
    small = files.where(F.col("length") <= range_bytes).select(
        "path", "length", F.lit(0).cast("long").alias("start"), F.col("length").alias("end"), F.lit(0).cast("long").alias("before"),
        F.lit(b"").alias("marks"))
    large = _settled(files.where(F.col("length") > range_bytes), range_bytes)
    ranges = small.unionByName(materialise(large.drop("behind"), "captures"))
    return _dealt(ranges).mapInPandas(_read, PACKET_SCHEMA)


def skipped_captures(spark: SparkSession, folder: str, pattern: str = "*.pcap*") -> DataFrame:
    """(path, length) of the files that ``read_pcaps`` cannot read, by their first bytes."""
    def unknown(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            keep = []
            for path, length in frame.itertuples(index=False):
                file = _File(path, length)
                keep.append(_layout(file) is None)
                file.close()
            yield frame[np.array(keep, bool)]

    return _files(spark, folder, pattern).mapInPandas(unknown, "path string, length long")


def cut_captures(spark: SparkSession, folder: str, pattern: str = "*.pcap*", range_bytes: int = RANGE) -> DataFrame:
    """(path, length, whole) of the captures that end inside a record, which starts at byte ``whole``."""
    last = _settled(_files(spark, folder, pattern), range_bytes).groupBy("path").agg(
        F.max("length").alias("length"), F.min("behind").alias("behind"))
    return last.where("behind < 0").select("path", "length", (-F.col("behind") - 1).alias("whole"))


def labelled_pcaps(spark: SparkSession, folder: str) -> DataFrame:
    """IP packets of the captures, labelled with the file name up to its first underscore."""
    packets = read_pcaps(spark, folder).where("ip_version IN (4, 6)")
    return packets.withColumn("label", F.regexp_replace(F.split("file", "_")[0], r"\.pcap$", ""))
