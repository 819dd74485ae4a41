"""WARC archives: writer with revisit records, and a splittable reader.

Every record is a gzip member of its own. A reading task owns the records that start inside its byte
range: it scans for gzip magic, decodes each candidate and accepts it only if a WARC header comes out,
then follows member after member until one starts beyond its range. Archives lie in the shared folder
and are reached through the file system their URI names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm.tables import only
from packetloom.session import materialise, run_folder

MAGIC = b"\x1f\x8b\x08"
LEVEL = 4
FILE_BYTES = 64 << 20
RANGE_BYTES = 8 << 20
CHUNK = 1 << 18
NAME = re.compile(r"<urn:page:(-?\d+)>")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One gzip member; a revisit names the response and carries the digest, not the payload."""
    kind = "response" if refers_to is None else "revisit"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>",
        "WARC-Target-URI: " + re.sub(r"[\r\n]+", " ", url or ""), "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{digest(payload)}", f"X-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        payload = b""
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(payload)}"]
    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def parse(raw: bytes) -> dict | None:
    """Header fields and payload of a decoded member; None if it is no WARC record."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    if not gap or not head.startswith(b"WARC/1."):
        return None
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    length = fields.get("Content-Length", "")
    if not length.isdigit() or len(rest) < int(length):
        return None
    return {"fields": fields, "payload": rest[:int(length)]}


def write_archives(pages: DataFrame, folder: str, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write (page_id, url, html, refers_to) rows below ``folder``; the manifest is (path, bytes).

    Every attempt of a task writes files of its own name, so a repeated attempt overwrites nothing and
    only files of the manifest count.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        scheme = folder[:len(folder) - len(root)] if folder.endswith(root) else ""
        out, path, size = None, "", 0

        def closed() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([scheme + path]), pa.array([size], pa.int64())], ["path", "bytes"])

        for batch in batches:
            for row in zip(*[batch.column(c) for c in ("page_id", "url", "html", "refers_to")]):
                page_id, url, html, refers_to = (x.as_py() for x in row)
                if out is None:
                    path, size = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(path, compression=None)
                size += out.write(record(page_id, url, (html or "").encode(), refers_to))
                if size >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return materialise(pages.select("page_id", "url", "html", "refers_to").mapInArrow(run, "path string, bytes long"), "warc-manifest")


def _members(stream, start: int, end: int, size: int) -> Iterator[bytes]:
    """Decoded members that start in [start, end); a start is proved by decoding a WARC header."""
    at, held, begin, synced = start, b"", start, start == 0
    while True:
        if not synced:  # look for magic in what is held, reading on as needed
            i = held.find(MAGIC)
            if i < 0:
                keep = held[-(len(MAGIC) - 1):]
                begin += len(held) - len(keep)
                if begin >= end or at >= size:
                    return
                stream.seek(at)
                more = stream.read(CHUNK)
                at += len(more)
                held = keep + more
                continue
            begin, held = begin + i, held[i:]
        if begin >= end or begin >= size:
            return
        unpack, parts, feed = zlib.decompressobj(31), [], held
        good = True
        while not unpack.eof:
            if not feed:
                if at >= size:
                    good = False
                    break
                stream.seek(at)
                feed = stream.read(CHUNK)
                at += len(feed)
                held += feed
            try:
                parts.append(unpack.decompress(feed))
            except zlib.error:
                good = False
                break
            feed = b""
            if not synced and sum(map(len, parts)) >= 7 and not b"".join(parts)[:7].startswith(b"WARC/1."):
                good = False
                break
        raw = b"".join(parts)
        if good and raw.startswith(b"WARC/1."):
            used = len(held) - len(unpack.unused_data)
            yield raw
            begin, held, synced = begin + used, unpack.unused_data, True
        elif synced:
            raise ValueError(f"broken WARC member at byte {begin}")
        else:
            begin, held = begin + 1, held[1:]


def read_archives(spark: SparkSession, manifest: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload, payload_bytes, payload_digest) of all records."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(range_bytes).cast("long"))
    ranges = manifest.select("path", "bytes", F.explode(starts).alias("start"))
    ranges = ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*[c.to_pylist() for c in (batch.column("path"), batch.column("bytes"), batch.column("start"))]):
                store, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with store.open_input_file(name) as stream:
                    for raw in _members(stream, start, min(start + range_bytes, size), size):
                        got = parse(raw)
                        if got is None:
                            raise ValueError(f"no WARC record in {path}")
                        f, payload = got["fields"], got["payload"]
                        target = NAME.match(f.get("WARC-Refers-To", ""))
                        rows.append((int(NAME.match(f["WARC-Record-ID"])[1]), f["WARC-Target-URI"], f["WARC-Type"], int(target[1]) if target else None,
                                     payload, int(f["X-Payload-Length"]), f["WARC-Payload-Digest"].removeprefix("sha1:")))
                        if f["WARC-Type"] == "response" and (digest(payload) != rows[-1][6] or len(payload) != rows[-1][5]):
                            raise ValueError(f"payload of page {rows[-1][0]} does not match its digest")
                        held += len(payload)
                        if held > 8 << 20:
                            yield _batch(rows)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows)

    return ranges.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)],
                                      ["page_id", "url", "record_type", "refers_to", "payload", "payload_bytes", "payload_digest"])


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Pages with ``refers_to``: the largest page_id of an equal payload, null for that one itself.

    Payloads shorter than ``least_bytes`` are all responses. The winner of a payload comes from a
    map-side combined aggregate and is joined back, so copies of one page never meet in one task.
    """
    pages = only(pages, "page_id", "url", "html").where("page_id is not null").withColumn("_sha", F.sha1(F.coalesce("html", F.lit(""))))
    winners = pages.groupBy("_sha").agg(F.max("page_id").alias("winner"))
    repeated = (F.col("winner") != F.col("page_id")) & (F.octet_length(F.coalesce("html", F.lit(""))) >= least_bytes)
    return pages.join(winners, "_sha").select("page_id", "url", "html", F.when(repeated, F.col("winner")).alias("refers_to"))


def warc_round_trip(pages: DataFrame, least_bytes: int = 0, folder: str | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as archives and read all records back.

    Null html is an empty payload, a null url an empty one; rows without a page_id cannot be named and
    are left out. Rows that share a page_id and payload are both responses or both revisits. An empty
    table writes nothing and reads nothing; extra columns are ignored.
    """
    spark = pages.sparkSession
    manifest = write_archives(with_revisits(pages, least_bytes), folder or run_folder(spark, "warc"))
    return read_archives(spark, manifest, range_bytes)
