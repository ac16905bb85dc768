"""WARC archives: a writer of one gzip member per record and a sequential reader.

The writer puts each page into a WARC/1.1 record, a ``response`` or, for a payload that a page of a smaller id has, a
``revisit`` that names it. The reader inflates a stream piece by piece, one gzip member per record, takes the block by
its Content-Length, and checks block and payload digests. Files go to the folder that driver and executors share, under a
name of the attempt's own; only those that a finished task reports are read, so a task may be run again at any time.

Null html is the empty payload, a null url an empty target. Pages with equal payloads and the smallest id, when repeated,
are all responses; pages without an id are revisits of one that has an id and else responses. Other columns are ignored.
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
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import bounded, cut, fresh_path, slices

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n}\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
URN = "<urn:x-page:{}>"
#: Bytes that the reader takes from a file at a time, and digests of repeated payloads that a broadcast may hold.
PIECE, BROADCAST_ROWS = 1 << 18, 1_000_000


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id, url: str | None, payload: bytes, refers_to=None, revisit: bool = False, level: int = 6) -> bytes:
    """One record as a gzip member of its own. A revisit has the HTTP head alone as its block."""
    sha = digest(payload)
    block = HTTP.format(n=len(payload)).encode() + (b"" if revisit else payload)
    head = {
        "WARC-Type": "revisit" if revisit else "response",
        "WARC-Record-ID": URN.format("" if page_id is None else page_id),
        "WARC-Date": DATE,
        "WARC-Target-URI": re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or ""),
        "Content-Type": "application/http; msgtype=response",
        "WARC-Payload-Digest": f"sha1:{sha}",
        "WARC-Block-Digest": f"sha1:{digest(block)}",
        "X-Payload-Length": str(len(payload)),
    }
    if revisit:
        head |= {"WARC-Profile": PROFILE, "WARC-Refers-To": URN.format(refers_to)}
    head["Content-Length"] = str(len(block))
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(text.encode() + block + b"\r\n\r\n") + pack.flush()


def members(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """The content of each gzip member of a stream that comes in pieces, inflated as the pieces come."""
    inflate, got, held = zlib.decompressobj(31), [], False
    for piece in pieces:
        while piece:
            got.append(inflate.decompress(piece))
            held = True
            piece = inflate.unused_data if inflate.eof else b""
            if inflate.eof:
                yield b"".join(got)
                inflate, got, held = zlib.decompressobj(31), [], False
    if held:
        raise ValueError("the archive ends inside a gzip member")


def parse(member: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """(headers in lower case, block, payload) of a record; ValueError where the frame or a digest is wrong."""
    head, sep, rest = member.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at the start of a gzip member")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    n = int(fields["content-length"])
    block, tail = rest[:n], rest[n:]
    if len(block) != n or tail != b"\r\n\r\n":
        raise ValueError(f"record {fields.get('warc-record-id')}: the block does not end where its content-length says")
    if "warc-block-digest" in fields and fields["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong block digest")
    payload = block
    if fields.get("content-type", "").startswith("application/http"):
        payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] != "revisit" and "warc-payload-digest" in fields and fields["warc-payload-digest"] != f"sha1:{digest(payload)}":
        raise ValueError(f"record {fields.get('warc-record-id')}: wrong payload digest")
    return fields, block, payload


def read_file(path: str) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    files, name = fs.FileSystem.from_uri(path)
    with files.open_input_stream(name) as stream:
        yield from map(parse, members(iter(lambda: stream.read(PIECE), b"")))


def with_originals(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload, refers_to): refers_to is the smallest id with an equal payload, if another page has it.

    Digests and ids alone are grouped. The digests that repeat are broadcast where they are counted and few, else joined.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload")).withColumn("sha", F.sha1("payload"))
    groups = rows.where(F.length("payload") >= min_bytes).groupBy("sha").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n"))
    groups = cut(groups.where("n > 1").select("sha", "first_id"), "originals")
    if groups.count() <= BROADCAST_ROWS:
        groups = F.broadcast(groups)
    other = (F.col("first_id").isNotNull()) & ~(F.col("first_id").eqNullSafe(F.col("page_id")))
    return rows.join(groups, "sha", "left").select("page_id", "url", "payload", F.when(other & (F.length("payload") >= min_bytes), F.col("first_id")).alias("refers_to"))


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write the archives of ``pages`` (page_id, url, html), a file a task; returns (path, records) of what finished tasks wrote."""
    spark = pages.sparkSession
    folder = folder or fresh_path(spark, "archives")
    if "://" not in folder:
        folder = "file://" + folder.removeprefix("file:")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, stream, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", None, 0
        for b in slices(batches, 4096):
            if stream is None:
                files, name = fs.FileSystem.from_uri(path)
                files.create_dir(name.rpartition("/")[0], recursive=True)
                stream = files.open_output_stream(name)
            for page, url, payload, first in zip(*(b.column(i).to_pylist() for i in range(4))):
                stream.write(record(page, url, payload, first, first is not None, level))
                n += 1
        if stream is not None:
            stream.close()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([n], pa.int64())], names=["path", "records"])

    return cut(with_originals(bounded(pages), min_bytes).mapInArrow(run, "path string, records long"), "manifest")


def read(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the files in the column ``path``: (page_id, payload_bytes, payload_digest, record_type, refers_to, url, payload).

    The payload of a revisit is null: the record has its digest and length alone. Without ``payloads`` that column stays out.
    """
    spark = archives.sparkSession
    columns = {"page_id": ("long", pa.int64()), "payload_bytes": ("long", pa.int64()), "payload_digest": ("string", pa.string()), "record_type": ("string", pa.string()), "refers_to": ("long", pa.int64()), "url": ("string", pa.string())}
    columns |= {"payload": ("binary", pa.binary())} if payloads else {}
    arrow = pa.schema([(k, t) for k, (_, t) in columns.items()])

    def page(urn: str | None) -> int | None:
        found = re.fullmatch(r"<urn:x-page:(-?\d+)>", urn or "")
        return found and int(found[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column(0).to_pylist():
                rows, held = [], 0
                for f, _, payload in read_file(path):
                    revisit = f["warc-type"] == "revisit"
                    n = int(f["x-payload-length"]) if revisit else len(payload)
                    row = (page(f["warc-record-id"]), n, f["warc-payload-digest"].removeprefix("sha1:"), f["warc-type"], page(f.get("warc-refers-to")), f["warc-target-uri"])
                    rows.append((*row, None if revisit else payload) if payloads else row)
                    held += n if payloads else 0
                    if held > 16e6 or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), arrow.types)], schema=arrow)

    tasks = max(1, min(archives.count(), 4 * spark.sparkContext.defaultParallelism))
    return archives.select("path").repartition(tasks).mapInArrow(run, ", ".join(f"{k} {t}" for k, (t, _) in columns.items()))
