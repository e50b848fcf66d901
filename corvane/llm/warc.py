"""WARC archives: written with one gzip member a record, read one record after the other in bounded memory."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import checkpoint, scratch, table

#: Fixed values of the format.
VERSION = b"WARC/1.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
#: Bytes asked of a file at a time, the longest header read, bytes of payload an archive takes before the next is begun,
#: records that go to Python at a time.
READ, HEADER, ARCHIVE, BATCH = 1 << 16, 1 << 20, 1 << 28, 512
#: Digests (20 bytes and an id each) up to which they are broadcast.
KNOWN = 200_000
DATE = "2024-01-01T00:00:00Z"
RECORDS = "page_id bigint, url string, record_type string, refers_to bigint, payload_bytes bigint, payload_digest string, digest_ok boolean"


class WarcError(ValueError):
    """An archive that isn't framed as it says."""


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _line(text: str | None) -> str:
    """A value that fits on one header line, reversibly."""
    return (text or "").replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")


def _unline(text: str) -> str:
    return text.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")


def record(page_id: int | None, url: str | None, payload: bytes | None, refers_to: int | None, date: str = DATE) -> bytes:
    """A record as one gzip member. A revisit has the HTTP head of the page, so its length is told, but no payload."""
    body = payload or b""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(body)
    block = http if refers_to is not None else http + body
    head = [
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(body)}",
        f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.insert(3, f"WARC-Target-URI: {_line(url)}")
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {REVISIT_PROFILE}"]
    raw = VERSION + b"\r\n" + "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _Members:
    """The decompressed bytes of a file of gzip members, a member at a time; never more than asked for and READ."""

    def __init__(self, stream: BinaryIO) -> None:
        self.stream, self.rest, self.z, self.out = stream, b"", None, bytearray()

    def begin(self) -> bool:
        """Goes to the next member; False at the end of the file."""
        if self.out or self.z and not self.z.eof:
            raise WarcError("bytes after the record in its gzip member")
        if not self.rest:
            self.rest = self.stream.read(READ)
        if not self.rest:
            return False
        self.z = zlib.decompressobj(31)
        return True

    def _more(self) -> bool:
        if self.z is None or self.z.eof:
            return False
        data = self.z.unconsumed_tail or self.rest
        if not self.z.unconsumed_tail:
            self.rest = b""
            if not data:
                data = self.stream.read(READ)
                if not data:
                    raise WarcError("the file ends within a gzip member")
        try:
            self.out += self.z.decompress(data, READ)
        except zlib.error as e:
            raise WarcError(str(e)) from e
        if self.z.eof:
            self.rest = self.z.unused_data + self.rest
        return True

    def line(self) -> bytes:
        at = 0
        while (end := self.out.find(b"\r\n", at)) < 0:
            at = max(0, len(self.out) - 1)
            if len(self.out) > HEADER or not self._more():
                raise WarcError("a header line doesn't end")
        found = bytes(self.out[:end])
        del self.out[: end + 2]
        return found

    def take(self, n: int) -> Iterator[bytes]:
        while n:
            if not self.out and not self._more():
                raise WarcError("a block is shorter than its Content-Length")
            part = bytes(self.out[:n])
            del self.out[: len(part)]
            n -= len(part)
            if part:
                yield part

    def ends(self) -> None:
        while self._more():
            if len(self.out) > 4:
                break


@dataclass
class Record:
    page_id: int | None
    url: str | None
    record_type: str
    refers_to: int | None
    payload_bytes: int
    payload_digest: str
    digest_ok: bool
    payload: bytes | None = None


def _page(value: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(found[1]) if found else None


def read_records(stream: BinaryIO, keep_payload: bool = False) -> Iterator[Record]:
    """The records of an archive in order, each digest checked against its bytes.

    A block is passed through the digests as it is decompressed, so memory doesn't grow with a record unless
    keep_payload. A revisit's payload is that of the record it refers to; its length is what its HTTP head says. An HTTP
    head of more than HEADER bytes counts as payload, and a digest that isn't told can't be wrong.
    """
    members = _Members(stream)
    while members.begin():
        if members.line() != VERSION:
            raise WarcError("no WARC record at the start of a gzip member")
        head: dict[str, str] = {}
        while line := members.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip() if name.lower() != "warc-target-uri" else value[1:]
        try:
            length = int(head["content-length"])
        except (KeyError, ValueError) as e:
            raise WarcError("a record without a Content-Length") from e
        kind = head.get("warc-type", "")
        of_block, of_payload, http, n, kept = hashlib.sha1(), hashlib.sha1(), bytearray(), 0, bytearray()
        # Only an HTTP message has a head before its payload; of any other record the block is the payload.
        told = None if head.get("content-type", "").lower().startswith("application/http") else -1
        for part in members.take(length):
            of_block.update(part)
            if told is None:
                seen = max(0, len(http) - 3)
                http += part
                end = http.find(b"\r\n\r\n", seen)
                if end < 0 and len(http) <= HEADER:
                    continue
                found = re.search(rb"(?im)^content-length:\s*(\d+)", http[: max(end, 0)])
                told, part = int(found[1]) if found else -1, bytes(http[end + 4 :]) if end >= 0 else bytes(http)
            of_payload.update(part)
            n += len(part)
            if keep_payload:
                kept += part
        if b"".join(members.take(4)) != b"\r\n\r\n":
            raise WarcError("a block is longer than its Content-Length")
        members.ends()
        digest = head.get("warc-payload-digest", "").removeprefix("sha1:")
        ok = head.get("warc-block-digest", "") in ("", f"sha1:{base64.b32encode(of_block.digest()).decode()}")
        if kind == "revisit":
            n = max(told or 0, 0)
        else:
            ok = ok and digest in ("", base64.b32encode(of_payload.digest()).decode()) and told in (None, -1, n)
        uri = head.get("warc-target-uri")
        yield Record(_page(head.get("warc-record-id")), None if uri is None else _unline(uri), kind, _page(head.get("warc-refers-to")), n, digest, ok, bytes(kept) if keep_payload and kind != "revisit" else None)


def mark_revisits(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: what records of ``pages`` (page_id, url, html) have to say.

    payload is html in UTF-8, empty for null. Of equal payloads of at least ``min_bytes`` that with the largest page_id is
    the response and the others revisit it; smaller payloads are all responses. Repeated rows of that page_id are
    responses all; a null page_id counts as smaller than any. Null and empty html are one payload, the empty one; no rows
    give no records. Only digests are grouped, and they are counted by task before they are dealt. Those of payloads that
    occur twice or more are broadcast up to KNOWN of them, so payloads stay where they are; beyond, payloads are dealt by
    digest, and a digest of a third of the pages is a skewed key that adaptive execution splits.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.unhex(F.sha1("payload")))
    first = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = checkpoint(first)
    if first.count() <= KNOWN:
        first = F.broadcast(first)
    return rows.join(first, "digest", "left").select("page_id", "url", "payload", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("refers_to"))


def write_warc(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE) -> DataFrame:
    """Writes archives of ``records`` (page_id, url, payload, refers_to) into ``folder``; returns path, records, bytes of each.

    ``folder`` is a URI that all executors reach. Each task attempt writes files of its own names, and the list of files
    is written last, from the attempts that Spark took; files of lost or repeated attempts are never listed. Null urls are
    left out of a record, null payloads are empty, a null page_id is written as none; no records give no archives.
    """
    spark = records.sparkSession

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _filesystem(folder)
        fs.create_dir(root, recursive=True)
        task, out, done, n, raw = TaskContext.get(), None, [], 0, 0
        path = ""
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*batch.columns, strict=True):
                if out is None:
                    path = f"{root}/part-{task.partitionId():05d}-{task.taskAttemptId()}-{len(done):04d}.warc.gz"
                    out, n, raw = fs.open_output_stream(path, compression=None), 0, 0
                body = payload.as_py()
                out.write(record(page_id.as_py(), url.as_py(), body, refers_to.as_py()))
                n, raw = n + 1, raw + len(body or b"")
                if raw >= archive_bytes:
                    out.close()
                    done.append((path, n, raw))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n, raw))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[0].rpartition("/")[2] for x in done]), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["file", "records", "bytes"])

    # Payloads are large: fewer go to Python at a time than of ordinary rows. The write ends before the setting goes back.
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(min(int(before) if int(before) > 0 else BATCH, BATCH)))
    try:
        records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "file string, records bigint, bytes bigint").write.parquet(f"{folder}/_files")
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    return spark.read.parquet(f"{folder}/_files").select(F.concat(F.lit(f"{folder}/"), "file").alias("path"), "records", "bytes")


def _filesystem(uri: str) -> tuple[pyarrow.fs.FileSystem, str]:
    uri = re.sub(r"^file:/+", "/", uri)
    return (pyarrow.fs.LocalFileSystem(), uri) if uri.startswith("/") else pyarrow.fs.FileSystem.from_uri(uri)


def read_warc(spark: SparkSession, files: DataFrame, payload: bool = False) -> DataFrame:
    """The records of the archives named in ``files`` (path, and bytes if known), one task an archive at a time.

    Columns: RECORDS, and payload (null for revisits) if asked for. digest_ok tells if the record's digests are those of
    its bytes; an archive that isn't framed as it says raises WarcError. An empty list gives no rows.
    """
    schema = RECORDS + ", payload binary" * payload
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary()}
    types = [kinds[c.split()[1]] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                fs, where = _filesystem(path)
                with fs.open_input_stream(where, compression=None) as stream:
                    rows, held = [], 0
                    for r in read_records(stream, payload):
                        rows.append([getattr(r, c) for c in names])
                        held += r.payload_bytes if payload else 0
                        if len(rows) >= 4096 or held > 1 << 24:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

    n = max(1, files.count())
    return files.select("path").repartition(n, F.xxhash64("path")).mapInArrow(run, schema)


def query(spark, sf_dir):
    """op2: page_id, payload_bytes, payload_digest, record_type, refers_to, url, digest_ok, read back from the archives."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    files = write_warc(mark_revisits(pages), scratch(spark, "warc"))
    return read_warc(spark, files).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "digest_ok")


def sql() -> str:
    """Without payload_digest, which needs base 32: the caller adds it."""
    digits = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    # Base 32 by way of the bits: 160 of them, so no padding.
    base32 = f"""list_aggregate(list_transform(range(32), lambda i: substr('{digits}', 1 + CAST(substr(bits, 1 + 5 * i, 5)::BIT AS BIGINT), 1)), 'string_agg', '')"""
    return f"""
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS payload FROM pages),
d AS (SELECT page_id, url, CAST(octet_length(payload) AS BIGINT) AS payload_bytes, sha1(payload) AS hex FROM p),
b AS (SELECT *, list_aggregate(list_transform(range(40), lambda i: right(bin(CAST(concat('0x', substr(hex, 1 + i, 1)) AS BIGINT) + 16), 4)), 'string_agg', '') AS bits FROM d),
f AS (SELECT hex, max(page_id) AS first, count(*) AS n FROM d GROUP BY hex)
SELECT page_id, payload_bytes, {base32} AS payload_digest,
  CASE WHEN n > 1 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n > 1 AND page_id <> first THEN first END AS refers_to, url, TRUE AS digest_ok
FROM b JOIN f USING (hex)"""
