"""WARC archives without repeated payloads.

Headers alone (digest and page) are shuffled by payload digest to find which
page of each payload comes first; all others become revisit records that refer
to it. Archives are written by the tasks into a shared folder, one compressed
member a record, with fresh headers; a manifest lists the files of finished
tasks, so what a lost task leaves behind is never read. Reading takes the
manifest, and resolving joins revisits to the records they refer to.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut_lineage, shared_folder, slices, whole

#: Compressed bytes after which a task begins a new archive.
ARCHIVE_BYTES = 32 << 20
NAMES = uuid.UUID("6f1c3a52-0d7e-5a7b-9c55-1d0b7f0f8a11")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
RECORDS = "page_id long, url string, record_type string, record_id string, refers_to_id string, payload_bytes long, payload_digest string, payload binary"


def file_system(uri: str):
    """The file system and path of a URI; Spark's names of the S3 schemes are told to pyarrow by its own."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMES, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, first: int | None, revisit: bool, date: str) -> bytes:
    """One compressed record. A revisit's block holds the response's header and no payload."""
    digest = digest_of(payload)
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    fields = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", record_id(page_id, digest)), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f\x80-\x9f  ]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)))
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(first, digest))]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if page_id is not None:
        fields.append(("X-Page-ID", str(page_id)))
    fields.append(("Content-Length", str(len(block))))
    header = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(header.encode("utf-8") + block + b"\r\n\r\n", 4, mtime=0)


def originals(pages: DataFrame) -> DataFrame:
    """(page_id, sha1, first) of the rows whose payload belongs to an earlier page; takes (page_id, sha1) headers."""
    first = pages.groupBy("sha1").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").select("sha1", "first")
    return pages.join(cut_lineage(first), "sha1").filter("page_id is null or page_id <> first").select("page_id", "sha1", "first").distinct()


def write_archives(pages: DataFrame, folder: str, date: str = "2024-01-01T00:00:00Z", id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for every row below `folder`, a URI all executors share; returns the manifest.

    Of rows with equal payloads those with the least page_id are responses, the
    others revisits of it. Null payloads are empty ones; a null id is never the
    first of several; a row repeated with its id and payload is a response
    again. Other columns are left out.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), whole(html_col).alias("html"), F.col(url_col).cast("string").alias("url")).withColumn("sha1", F.sha1(F.col("html").cast("binary")))
    later = cut_lineage(originals(rows.select("page_id", "sha1")))
    later = later.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("key"), F.col("sha1").alias("later_sha1"), "first")
    dealt = rows.withColumn("key", F.coalesce("page_id", F.lit(-(1 << 63))))
    joined = dealt.join(later, (dealt["key"] == later["key"]) & (dealt["sha1"] == later["later_sha1"]), "left").select("page_id", "html", "url", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = file_system(folder)
        system.create_dir(base, recursive=True)
        done: list[tuple[str, int, int]] = []
        out, path, records, size = None, "", 0, 0

        def finish() -> None:
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, records, size))
                out = None

        for batch in batches:
            for cut in slices(batch, 1):
                for page_id, text, url, first in zip(*(c.to_pylist() for c in cut.columns), strict=True):
                    if out is None:
                        path, records, size = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                        out = system.open_output_stream(f"{base}/{path.rpartition('/')[2]}", compression=None)
                    member = record(page_id, url, text.encode("utf-8"), first, first is not None, date)
                    out.write(member)
                    records, size = records + 1, size + len(member)
                    if size >= ARCHIVE_BYTES:
                        finish()
        finish()
        columns = list(zip(*done, strict=True)) if done else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64())], names=["path", "records", "bytes"])

    return cut_lineage(joined.mapInArrow(write, MANIFEST))


def members(stream) -> Iterator[bytes]:
    """The decompressed members of a file, one after another, reading a piece at a time."""
    rest, inflate, made = b"", zlib.decompressobj(31), []
    while True:
        data = rest or stream.read(1 << 20)
        if not data:
            if made:
                raise ValueError("the archive ends inside a record")
            return
        made.append(inflate.decompress(data))
        rest = inflate.unused_data
        if inflate.eof:
            yield b"".join(made)
            inflate, made = zlib.decompressobj(31), []
        elif not any(made):
            made = [b""]


def parse(member: bytes) -> tuple:
    """A row of RECORDS from a record."""
    head, _, rest = member.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    payload = block.partition(b"\r\n\r\n")[2]
    revisit = fields["WARC-Type"] == "revisit"
    page = int(fields["X-Page-ID"]) if "X-Page-ID" in fields else None
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not revisit and digest_of(payload) != digest:
        raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not have its digest")
    return page, fields.get("WARC-Target-URI"), fields["WARC-Type"], fields["WARC-Record-ID"], fields.get("WARC-Refers-To"), None if revisit else len(payload), digest, None if revisit else payload


def read_archives(manifest: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of the manifest's archives; with payloads=False the payloads are checked and left behind."""
    schema = RECORDS if payloads else RECORDS.removesuffix(", payload binary")
    names = [c.split(" ")[0] for c in schema.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.binary()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], types[k]) for k in range(len(names))], names=names)

        for batch in batches:
            for path in batch.column(0).to_pylist():
                system, place = file_system(path)
                rows, size = [], 0
                with system.open_input_stream(place, compression=None) as stream:
                    for member in members(stream):
                        rows.append(parse(member))
                        size += len(member) if payloads else 300
                        if size >= 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                yield batch_of(rows)

    return manifest.select("path").mapInArrow(read, schema)


def resolve(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits with what the response they refer to has."""
    responses = records.filter("record_type = 'response'")
    targets = responses.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("target_bytes"), F.col("payload_digest").alias("target_digest")).dropDuplicates(["target"])
    revisits = records.filter("record_type = 'revisit'").select("page_id", "record_type", "refers_to_id", "payload_digest")
    found = revisits.join(targets, revisits["refers_to_id"] == targets["target"], "left")
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", F.lit(None).cast("long").alias("refers_to")).union(
        found.select("page_id", F.col("target_bytes").alias("payload_bytes"), F.coalesce("target_digest", "payload_digest").alias("payload_digest"), "record_type", "refers_to")
    )


def archive(pages: DataFrame, spark: SparkSession) -> DataFrame:
    """Writes the pages into a new folder among the shared ones, reads the archives back and resolves their revisits."""
    manifest = write_archives(pages, f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}")
    return resolve(cut_lineage(read_archives(manifest, payloads=False)))
