"""WARC archives: a writer, a normaliser of monolithic gzip files, and a reader by offset.

The writer makes archives that are one gzip stream each, as crawlers without record compression do. The normaliser
inflates such a file once, as a stream, rewrites every record as a gzip member of its own and writes a sidecar index of
offsets. The reader opens single records by offset.

Files go to a folder that all executors share, through pyarrow's file systems; each is written under a name of its attempt
and moved into place, so that a repeated task replaces its own file. Archives are closed at a size, and no more than one
record is held at a time.

Payloads of at least REVISIT_BYTES that are equal (SHA-1 and length) are stored once: the record with the largest page_id
is the response, the others are revisits that refer to it. Equal payloads are found by aggregation, so groups of any size
may occur.

Defined results: null html is an empty payload; a null url leaves out the target; a page without page_id gets a response
record; rows that repeat a page_id and payload are written as often as they occur, all as responses if the id is the
largest of its group; an empty table makes no archive and an empty result; other columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from firmgraph.llm.common import Workspace, broadcast_if_small

REVISIT_BYTES = 1000
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 20
INDEX = "archive string, offset long, length long, record_id string, record_type string"
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def open_fs(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(re.sub(r"^(file:)?/+", "file:///", uri))


class Placed:
    """A file that appears under its name only when whole."""

    def __init__(self, uri: str):
        self.fs, self.path = open_fs(uri)
        self.attempt = f"{self.path}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.fs.open_output_stream(self.attempt, compression=None)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.attempt, self.path)


def record_bytes(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record; a revisit has the HTTP header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        head.append("WARC-Target-URI: " + urllib.parse.quote(url, safe="".join(map(chr, range(33, 127)))))
    head.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    return {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}


def read_record(data: bytes) -> tuple:
    """page_id, payload bytes, digest, type, refers_to of one inflated record; a response's digest is computed anew."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = parse_head(head)
    block = block[: int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    number = lambda x: None if "None" in x else int(x.strip("<>").rsplit(":", 1)[1])
    if fields["warc-type"] == "response":
        return number(fields["warc-record-id"]), len(payload), hashlib.sha1(payload).hexdigest(), "response", None
    digest = base64.b32decode(fields["warc-payload-digest"].split(":")[1]).hex()
    return number(fields["warc-record-id"]), int(parse_head(http)["content-length"]), digest, "revisit", number(fields["warc-refers-to"])


def inflated(stream) -> Iterator[bytes]:
    """The bytes of a gzip file with one or more members, in chunks of bounded size."""
    more = zlib.decompressobj(31)
    while data := stream.read(CHUNK):
        while data:
            piece = more.decompress(data, CHUNK)
            if piece:
                yield piece
            data = more.unconsumed_tail
            if more.eof:
                data = more.unused_data
                more = zlib.decompressobj(31)
    if piece := more.flush():
        yield piece


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of a stream of inflated bytes."""
    held = bytearray()
    need = None
    for piece in pieces:
        held += piece
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(parse_head(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held.strip():
        raise ValueError("an archive ends within a record")


def normalise_archive(source: str, target: str) -> int:
    """Rewrite one archive with a gzip member for each record, beside its index; the number of records."""
    fs, path = open_fs(source)
    out, index = Placed(target), Placed(target + ".idx")
    offset = n = 0
    with fs.open_input_stream(path, compression=None) as stream:
        for record in split_records(inflated(stream)):
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            member = packer.compress(record) + packer.flush()
            fields = parse_head(record.partition(b"\r\n\r\n")[0])
            out.out.write(member)
            index.out.write(f"{target}\t{offset}\t{len(member)}\t{fields['warc-record-id']}\t{fields['warc-type']}\n".encode())
            offset += len(member)
            n += 1
    out.close()
    index.close()
    return n


def with_revisits(pages: DataFrame, work: Workspace, least: int = REVISIT_BYTES) -> DataFrame:
    """page_id, url, payload, digest, refers_to (null for responses)."""
    raw = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    raw = raw.withColumn("digest", F.sha1("payload"))
    large = raw.select("page_id", "digest", F.octet_length("payload").alias("n")).filter(F.col("n") >= least)
    groups = large.groupBy("digest", "n").agg(F.max("page_id").alias("keep"), F.count("*").alias("rows")).filter("rows > 1")
    groups = work.save(groups.select("digest", "n", "keep"), "groups")
    same = raw.withColumn("n", F.octet_length("payload")).join(broadcast_if_small(groups, 128), ["digest", "n"], "left")
    return same.select("page_id", "url", "payload", "digest", F.when(F.col("page_id") < F.col("keep"), F.col("keep")).alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write monolithic archives, a few for each partition; a row for each: archive, records."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, k, out, held, n, done = TaskContext.get().partitionId(), 0, None, 0, 0, []

        def close():
            if out is not None:
                out.out.write(packer.flush())
                out.close()
                done.append((name, n))

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if out is None or held >= archive_bytes:
                    close()
                    name, held, n = f"{folder}/part-{part:05d}-{k:05d}.warc.gz", 0, 0
                    out, packer, k = Placed(name), zlib.compressobj(1, zlib.DEFLATED, 31), k + 1
                data = record_bytes(*row)
                out.out.write(packer.compress(data))
                held += len(data)
                n += 1
        close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64())], ["archive", "records"])

    return records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, "archive string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Normalise each archive of archives(archive) into folder; a row for each: archive (the new one), records."""

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for source in batch.column("archive").to_pylist():
                target = f"{folder}/{source.rsplit('/', 1)[1]}"
                n = normalise_archive(source, target)
                yield pa.RecordBatch.from_arrays([pa.array([target]), pa.array([n], pa.int64())], ["archive", "records"])

    return archives.select("archive").mapInArrow(rewrite, "archive string, records long")


def read_archives(spark, folder: str) -> DataFrame:
    """A row for each record of the normalised archives in folder, read by the offsets of their indices."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stream = None, None
        for batch in batches:
            rows = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if name != current:
                    fs, path = open_fs(name)
                    current, stream = name, fs.open_input_file(path)
                stream.seek(offset)
                rows.append(read_record(zlib.decompress(stream.read(length), 31)))
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], [x.split()[0] for x in RESULT.split(", ")])

    index = spark.read.schema(INDEX).csv(f"{folder}/*.idx", sep="\t")
    return index.mapInArrow(read, RESULT)


def archive_pages(pages: DataFrame, least: int = REVISIT_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write pages(page_id, url, html) as archives, normalise them and read every record back."""
    spark = pages.sparkSession
    work = Workspace(spark, "warc")
    made = work.save(write_archives(with_revisits(pages, work, least), f"{work.path}/raw", archive_bytes), "made")
    n = made.count()
    if not n:
        return spark.createDataFrame([], T._parse_datatype_string(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>"))
    work.save(normalise(made.repartition(max(1, min(n, 10_000))), f"{work.path}/archives"), "normalised")
    work.drop("raw")
    return read_archives(spark, f"{work.path}/archives")
