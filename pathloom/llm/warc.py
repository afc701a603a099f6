"""WARC archives as a chunked record table: payloads travel as (record, chunk number) rows of bounded size.

Writing: each payload is cut into chunks of ``CHUNK`` bytes by built-in functions; an Arrow function streams the chunks of its
partition into gzip members of files of about ``MOST_FILE`` bytes, and takes the digest along, chunk by chunk, against
the one that the header states. Reading streams the other way: a file is inflated block by block, and a record leaves as rows of
one chunk each; digest and length are carried along and stand in a record's last row. Python never holds more than a batch of
chunks (64 MB, Spark's bound), however long a record is. A payload that comes from a table's column is held whole by the scan
alone.

Files lie below the session's shared checkpoint folder (or a folder given by its URI), and every attempt of a task writes under names of
its own. Only files in the manifest count, and a lost or repeated attempt's files never get there, so records are neither lost
nor doubled. Records: ``response`` with HTTP headers and payload, or ``revisit`` (profile identical-payload-digest), which
has the HTTP headers alone: Content-Length there and WARC-Payload-Digest state the full payload.

A record's id is made of its page_id and payload digest. Of equal payloads of at least ``LEAST`` bytes the smallest page_id's is the
response. Rows that share that page_id and the payload are all responses; so are all rows where no page_id is known. Where
there are null ids beside others, they revisit. Null html is an empty payload; a null url leaves out the target; control
characters and spaces in it are percent-encoded. Columns other than page_id, url and html are ignored. An empty table writes
no file and reads back as an empty table. A damaged archive yields what precedes the damage, and one row of type ``damaged``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside_groups, checkpoint_dir, store, table

CHUNK, BLOCK, MOST_FILE, LEAST, MOST_HEADER = 1 << 20, 1 << 18, 1 << 28, 100, 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, records long, bytes long"
CHUNKS = (
    "path string, record_no long, record_id string, record_type string, target string, refers_to string, stated_digest string, stated_bytes long, "
    "chunk_no long, data binary, is_last boolean, payload_bytes long, payload_digest string"
)
_END = b"\r\n\r\n"


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder that all machines share, and the path in it."""
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


# --- writing ----------------------------------------------------------------------------------------------------


def records(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """page_id, url, payload, size, digest, and first_id: the page_id of the response that a revisit refers to, else null."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    p = p.withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    same = p.where(F.col("size") >= least).groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("page_id").alias("first_id")).where("n > 1")
    out = beside_groups(p, same, "digest")
    return out.withColumn("first_id", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")))


def chunks_of(rows: DataFrame, size: int = CHUNK) -> DataFrame:
    """``rows`` with payload as rows of chunk_no, data and is_last; a revisit has one empty chunk."""
    body = F.when(F.col("first_id").isNull(), F.col("payload")).otherwise(F.lit(b""))
    pieces = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.floor((F.octet_length(body) - 1) / size)).cast("int")), lambda i: F.substring(body, i * size + 1, F.lit(size)))
    out = rows.select("page_id", "url", "size", "digest", "first_id", pieces.alias("pieces")).withColumn("n_pieces", F.size("pieces"))
    out = out.select("page_id", "url", "size", "digest", "first_id", "n_pieces", F.posexplode("pieces").alias("chunk_no", "data"))
    return out.withColumn("is_last", F.col("chunk_no") == F.col("n_pieces") - 1).drop("n_pieces")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest[:32]}>"


def _head(page_id: int | None, url: str | None, size: int, digest: str, first_id: int | None, date: str) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    fields = ["WARC/1.1", f"WARC-Type: {'response' if first_id is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        fields.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if first_id is not None:
        fields += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(first_id, digest)}"]
    length = len(http) + (size if first_id is None else 0)
    fields += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {length}"]
    return ("\r\n".join(fields) + "\r\n\r\n" + http).encode()


class _Archive:
    """A file of gzip members, one a record, written as its chunks come."""

    def __init__(self, folder: str) -> None:
        self.path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
        at, path = opened(self.path)
        self.out, self.records, self.bytes, self.member = at.open_output_stream(path, compression=None), 0, 0, None
        self.begin(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:{uuid.uuid4()}>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: 0\r\n\r\n".encode())
        self.end()
        self.records = 0

    def begin(self, head: bytes) -> None:
        self.member = zlib.compressobj(1, zlib.DEFLATED, 31)
        self.add(head)

    def add(self, data: bytes | memoryview) -> None:
        self._put(self.member.compress(data))

    def end(self) -> None:
        self.add(_END)
        self._put(self.member.flush())
        self.records += 1

    def _put(self, data: bytes) -> None:
        if data:
            self.out.write(data)
            self.bytes += len(data)

    def close(self) -> tuple[str, int, int]:
        self.out.close()
        return self.path, self.records, self.bytes


def write(pages: DataFrame, folder: str | None = None, chunk: int = CHUNK, most_file: int = MOST_FILE, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Writes a record a page below ``folder`` (a URI); the manifest: path, records, bytes of each file."""
    folder = folder or f"{checkpoint_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    at, path = opened(folder)
    at.create_dir(path, recursive=True)
    names = ["page_id", "url", "size", "digest", "first_id", "chunk_no", "data", "is_last"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, seen, done = None, None, []
        for batch in batches:
            data = batch.column("data")
            for i, (page_id, url, size, digest, first_id, n, last) in enumerate(zip(*[batch.column(c).to_pylist() for c in names if c != "data"], strict=True)):
                if n == 0:
                    archive, seen = archive or _Archive(folder), hashlib.sha256()
                    archive.begin(_head(page_id, url, size, digest, first_id, date))
                piece = memoryview(data[i].as_buffer())
                seen.update(piece)
                archive.add(piece)
                if last:
                    if first_id is None and seen.hexdigest() != digest:
                        raise ValueError(f"chunks of {record_id(page_id, digest)} don't give its digest")
                    archive.end()
                    if archive.bytes >= most_file:
                        done.append(archive.close())
                        archive = None
        if archive:
            done.append(archive.close())
        columns = list(zip(*done, strict=True)) or [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["path", "records", "bytes"])

    return store(chunks_of(records(pages), chunk).select(*names).mapInArrow(run, MANIFEST))


# --- reading ----------------------------------------------------------------------------------------------------


def _inflated(source) -> Iterator[bytes]:
    """A file's bytes in blocks; gzip members one after another are inflated, ``BLOCK`` bytes at most at a time."""
    block = source.read(BLOCK)
    if block[:2] != b"\x1f\x8b":
        while block:
            yield block
            block = source.read(BLOCK)
        return
    member, begun = zlib.decompressobj(31), False
    while block:
        out, begun = member.decompress(block, BLOCK), True
        if out:
            yield out
        if member.eof:
            block, member, begun = member.unused_data, zlib.decompressobj(31), False
            block = block or source.read(BLOCK)
        else:
            block = member.unconsumed_tail or source.read(BLOCK)
    while begun and not member.eof and (out := member.decompress(b"", BLOCK)):
        yield out
    if begun and not member.eof:
        raise zlib.error("the last gzip member is torn")


class _Bytes:
    """Reads up to a mark or a number of bytes from blocks, and holds one block and a header at most."""

    def __init__(self, blocks: Iterator[bytes]) -> None:
        self.blocks, self.held = blocks, b""

    def more(self) -> bool:
        block = next(self.blocks, b"")
        self.held += block
        return bool(block)

    def header(self, most: int = MOST_HEADER) -> bytes | None:
        """The lines up to an empty one; None at the end of the file or where there is no header of at most ``most`` bytes."""
        while (at := self.held.find(_END)) < 0:
            if len(self.held) > most or not self.more():
                return None
        out, self.held = self.held[:at], self.held[at + len(_END) :]
        return out

    def some(self, most: int) -> bytes:
        if not self.held:
            self.more()
        out, self.held = self.held[:most], self.held[most:]
        return out


def _fields(lines: bytes) -> dict[str, str]:
    out = {}
    for line in lines.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        out.setdefault(name.strip().lower(), value.strip())
    return out


def _whole_number(text: str | None) -> int | None:
    return int(text) if text and re.fullmatch(r"[0-9]{1,18}", text) else None


def read_file(path: str, chunk: int = CHUNK) -> Iterator[tuple]:
    """Rows of ``CHUNKS``, in order, of one archive."""
    at, inner = opened(path)
    with at.open_input_stream(inner, compression=None) as source:
        stream, number = _Bytes(_inflated(source)), 0
        damaged = (None, "damaged", None, None, None, None, 0, b"", True, None, None)
        try:
            while True:
                head = stream.header()
                if head is None:
                    if stream.held.strip():
                        yield (path, number, *damaged)
                    return
                fields = _fields(head)
                left = _whole_number(fields.get("content-length"))
                if not head.lstrip().startswith(b"WARC/") or left is None:
                    yield (path, number, *damaged)
                    return
                stated = None
                if fields.get("content-type", "").startswith("application/http"):
                    http = stream.header(min(MOST_HEADER, left))
                    if http is None:
                        yield (path, number, *damaged)
                        return
                    left -= len(http) + len(_END)
                    stated = _whole_number(_fields(http).get("content-length"))
                kind = fields.get("warc-type")
                same = (path, number, fields.get("warc-record-id"), kind, fields.get("warc-target-uri"), fields.get("warc-refers-to"), fields.get("warc-payload-digest", "").partition(":")[2] or None, stated)
                seen, size, n, data = hashlib.sha256(), 0, 0, b""
                while True:
                    parts, held = [data], len(data)
                    while left and held < chunk and (piece := stream.some(min(left, chunk - held))):
                        parts.append(piece)
                        held += len(piece)
                        left -= len(piece)
                    data = b"".join(parts)
                    if left and held < chunk:
                        yield (path, number, *damaged)
                        return
                    seen.update(data)
                    size += len(data)
                    yield (*same, n, data, not left, None if left else size, None if left else seen.hexdigest())
                    n, data = n + 1, b""
                    if not left:
                        break
                end = b""
                while len(end) < len(_END) and (piece := stream.some(len(_END) - len(end))):
                    end += piece
                if end != _END:
                    yield (path, number + 1, *damaged)
                    return
                number += 1
        except zlib.error:
            yield (path, number, *damaged)


def read(manifest: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The chunked record table (``CHUNKS``) of a manifest's files (path), a file a task at most.

    Without ``data`` only each record's last row comes, with its digest and length; everything is read all the same.
    """
    schema = pa.schema([("path", pa.string()), ("record_no", pa.int64()), *[(c, pa.string()) for c in ("record_id", "record_type", "target", "refers_to", "stated_digest")], ("stated_bytes", pa.int64()),
                        ("chunk_no", pa.int64()), ("data", pa.binary()), ("is_last", pa.bool_()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                held, rows = 0, []
                for row in read_file(path, chunk):
                    if not data and not row[10]:
                        continue
                    rows.append(row if data else (*row[:9], None, *row[10:]))
                    held += len(row[9]) if data else 0
                    if held > 16 * CHUNK or len(rows) >= 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        held, rows = 0, []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    files = max(1, manifest.count())
    return manifest.select("path").repartition(files).mapInArrow(run, CHUNKS)


def pages_of(chunks: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of response and revisit records.

    A response's length and digest are what reading found; a revisit's are stated in its headers.
    """
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+):", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    revisit = F.col("record_type") == "revisit"
    return chunks.where(F.col("is_last") & F.col("record_type").isin("response", "revisit")).select(
        number("record_id").alias("page_id"), F.when(revisit, F.col("stated_bytes")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.col("payload_digest")).alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"),
    )


def op12_warc_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages_of(read(write(table(spark, sf_dir, "pages")), data=False))
