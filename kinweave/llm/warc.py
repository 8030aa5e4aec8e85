"""WARC archives: a writer of whole-file gzip streams, a normaliser and a reader by offsets.

write_archives puts each partition's records into archives that are one gzip stream (as many crawlers leave
them). normalise inflates such a stream once, front to back, writes every record as a gzip member of its own
and a sidecar index of (record id, offset, length), so that a single record can be read without the rest.
read_records reads members by the index.

Files lie below a folder that all executors share, under names given by partition and record ids, and appear
by a rename, so that a task that runs again after a lost executor writes the same file anew.

Cases: a null payload counts as empty; a null id or URL is written as an empty header and read back as null;
equal payloads of at least `min_bytes` bytes are revisits of the one with the smallest id, rows of that same
id are all responses; null ids come last; smaller payloads are all responses; very long payloads take
memory in proportion to one record; an empty table gives an empty result; extra columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
import io
import json
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, checkpoint, own_dir, partitions, small_batches, texts

LEVEL = 5
#: Payload bytes after which a new archive is begun.
ARCHIVE_BYTES = 64 << 20
CHUNK = 1 << 18


def store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI of any store that pyarrow knows (file, hdfs, s3, gs)."""
    return fs.FileSystem.from_uri(uri)


class Writer:
    """A file that appears under its name when it is complete."""

    def __init__(self, uri: str):
        self.fs, self.path = store(uri)
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.temporary = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, self.path)


def record(headers: dict[str, str], body: bytes) -> bytes:
    """One WARC/1.1 record."""
    head = "".join(f"{k}: {v}\r\n" for k, v in headers.items())
    return b"WARC/1.1\r\n" + head.encode() + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def take(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers, body and raw bytes of each record, read front to back."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line in (b"\r\n", b"\n"):
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        head, headers = [line], {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            head.append(line)
            k, _, v = line.decode().partition(":")
            headers[k.strip().lower()] = v.strip()
        n = int(headers["content-length"])
        body = stream.read(n)
        if len(body) != n:
            raise ValueError("a record ends early")
        yield headers, body, b"".join(head) + b"\r\n" + body + b"\r\n\r\n"


class Inflated(io.RawIOBase):
    """The inflated bytes of a file of one or many gzip members, as a stream read once."""

    def __init__(self, source):
        self.source, self.inflater, self.rest, self.ready = source, zlib.decompressobj(31), b"", memoryview(b"")

    def readable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        while not self.ready:
            if self.inflater.eof:
                self.rest, self.inflater = self.inflater.unused_data, zlib.decompressobj(31)
            data = self.rest or self.source.read(CHUNK)
            self.rest = b""
            if not data:
                return 0
            self.ready = memoryview(self.inflater.decompress(data, len(buffer) * 4))
            self.rest = self.inflater.unconsumed_tail
        n = min(len(buffer), len(self.ready))
        buffer[:n] = self.ready[:n]
        self.ready = self.ready[n:]
        return n


def http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload) + payload


def classify(pages: DataFrame, *, id_col: str = "page_id", payload_col: str = "html", url_col: str = "url", min_bytes: int = 100) -> DataFrame:
    """id, url, payload, digest and the smallest id of an equal payload where that makes the record a revisit."""
    own = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("payload"))
    own = own.withColumn("digest", F.sha2(F.col("payload").cast("binary"), 256))
    firsts = own.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    joined = own.join(firsts, "digest", "left")  # only repeated digests: small or else a skew-split merge join
    return joined.withColumn("first", F.when(F.col("id").isNull() | (F.col("id") > F.col("first")), F.col("first"))).select("id", "url", "payload", "digest", "first")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """Writes the records of classify() into archives of one gzip stream each; returns (path, records)."""
    small_batches(records.sparkSession)
    out_schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        from pyspark import TaskContext

        part, made, kept = TaskContext.get().partitionId(), 0, []
        out = deflater = None
        n = size = 0
        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for page, url, payload, digest, first in zip(*cols, strict=True):
                if out is None:
                    out, deflater, n, size = Writer(f"{folder}/whole/{part:06d}-{made:04d}.warc.gz"), zlib.compressobj(1, zlib.DEFLATED, 31), 0, 0
                body = payload.encode()
                headers = {
                    "WARC-Type": "response" if first is None else "revisit",
                    "WARC-Record-ID": f"<urn:page:{'' if page is None else page}>",
                    "WARC-Target-URI": " ".join((url or "").split()),
                    "WARC-Payload-Digest": f"sha256:{digest}",
                    "X-Payload-Length": str(len(body)),
                }
                if first is not None:
                    headers |= {"WARC-Refers-To": f"<urn:page:{first}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
                out.write(deflater.compress(record(headers, http(body) if first is None else b"")))
                n += 1
                size += len(body)
                if size >= ARCHIVE_BYTES:
                    out.write(deflater.flush())
                    out.close()
                    kept.append((out.path, n))
                    out, made = None, made + 1
        if out is not None:
            out.write(deflater.flush())
            out.close()
            kept.append((out.path, n))
        yield batch(out_schema, path=[f"{folder}/whole/{p.rpartition('/')[2]}" for p, _ in kept], records=[n for _, n in kept])

    return records.select("id", "url", "payload", "digest", "first").mapInArrow(run, "path string, records long")


def normalise(archives: DataFrame, folder: str) -> DataFrame:
    """Rewrites each archive (column path) with a gzip member a record, beside a sidecar `.idx` of JSON lines.

    Returns the index: path, record_id, offset, length.
    """
    schema = pa.schema([("path", pa.string()), ("record_id", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches):
        for b in batches:
            for path in texts(b.column(0)):
                source, at = store(path)
                name = f"{folder}/members/{path.rpartition('/')[2]}"
                out, index = Writer(name), []
                with source.open_input_stream(at, compression=None) as f:
                    for headers, _, data in take(io.BufferedReader(Inflated(f), CHUNK)):
                        deflater = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                        member = deflater.compress(data) + deflater.flush()
                        index.append((headers.get("warc-record-id", ""), out.size, len(member)))
                        out.write(member)
                out.close()
                sidecar = Writer(f"{name}.idx")
                sidecar.write("".join(json.dumps({"id": i, "offset": o, "length": n}) + "\n" for i, o, n in index).encode())
                sidecar.close()
                for i in range(0, len(index), 4096):
                    part = index[i : i + 4096]
                    yield batch(schema, path=[name] * len(part), record_id=[x[0] for x in part], offset=[x[1] for x in part], length=[x[2] for x in part])

    return archives.select("path").repartition(max(1, partitions(archives.sparkSession)), "path").mapInArrow(run, "path string, record_id string, offset long, length long")


def urn(value: str | None) -> int | None:
    inner = (value or "").removeprefix("<urn:page:").removesuffix(">")
    return int(inner) if inner else None


def read_records(index: DataFrame) -> DataFrame:
    """Reads each member of the index: id, url, record_type, refers_to, payload (null for revisits), payload_bytes, payload_digest.

    The digest of a response is taken from the bytes read and must equal the header's; a revisit's is that of
    its header.
    """
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches):
        open_path = opened = None
        for b in batches:
            rows = []
            for path, offset, length in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if path != open_path:
                    source, at = store(path)
                    open_path, opened = path, source.open_input_file(at)
                opened.seek(offset)
                headers, body, _ = next(take(io.BytesIO(zlib.decompress(opened.read(length), 31))))
                said = headers["warc-payload-digest"].removeprefix("sha256:")
                payload, size = None, int(headers["x-payload-length"])
                if headers["warc-type"] == "response":
                    payload = body.partition(b"\r\n\r\n")[2]
                    if hashlib.sha256(payload).hexdigest() != said or len(payload) != size:
                        raise ValueError(f"{path} at {offset}: the payload isn't that of its header")
                rows.append((urn(headers["warc-record-id"]), headers.get("warc-target-uri") or None, headers["warc-type"], urn(headers.get("warc-refers-to")), payload, size, said))
            yield batch(schema, **{f.name: [r[i] for r in rows] for i, f in enumerate(schema)})

    return index.select("path", "offset", "length").mapInArrow(run, "id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string")


def archive(pages: DataFrame, *, folder: str | None = None, **columns) -> DataFrame:
    """Writes pages into archives below folder, normalises them and returns the index.

    All files are written here, once: the paths and the index are tables, so reading the result again writes nothing.
    A task that is run again writes its files over.
    """
    folder = folder or own_dir(pages.sparkSession, "warc")
    written = checkpoint(write_archives(classify(pages, **columns), folder))
    return checkpoint(normalise(written, folder))
