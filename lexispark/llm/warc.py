"""WARC archives written and read as streams of bounded chunks.

Writing: Spark takes the digests of all payloads first; of equal payloads of MIN_REVISIT bytes or more the
smallest id is kept as response and the others become revisit records, which name it. Payloads
then travel as rows of at most CHUNK bytes. Each task writes one archive, a gzip member for each record, in the
shared folder, and digests the chunks as they pass; it is put in place whole, so a task that runs again does no harm.

Reading gives a chunked record table: (path, record_no, chunk_no, data, ...) rows of at most CHUNK
bytes, with the digest of everything up to and including the chunk, so no record is ever held
as a whole. records() folds the rows of that table by record: lengths add up, and the digest that the last chunk
carries is that of the payload.

Defined cases: a null payload is empty. An empty payload has one chunk of no bytes. Rows with the same id and payload as
the response are responses too; a null id is written as such and is a response only if every
id of its payload is null. Only the id, url and payload columns are read. An archive that is damaged, lacks a chunk, or whose
digests are not those of its headers is an error.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shards import Scratch, if_small, put_file

#: Bytes of a payload that a chunk has at most.
CHUNK = 1 << 18
#: Bytes from which an equal payload becomes a revisit.
MIN_REVISIT = 0
_DATE = "2024-01-01T00:00:00Z"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def originals(pages: DataFrame, scratch: Scratch, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """(page_id, refers_to, sha1) of the pages whose payload a page of smaller id has, too."""
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    found = pages.select("page_id", F.unhex(F.sha1(body)).alias("sha1"), F.octet_length(body).alias("bytes")).where(F.col("bytes") >= min_revisit)
    first = found.groupBy("sha1", "bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1 and refers_to is not null").drop("n")
    # A written table: so a payload that very many pages have is a join that Spark can split.
    first = scratch.save(first, "firsts")
    return found.join(if_small(first), ["sha1", "bytes"]).where("page_id is null or page_id <> refers_to").select("page_id", "refers_to", "sha1").distinct()


def _head(kind: str, record_id: str, length: int, more: dict[str, str]) -> bytes:
    fields = {"WARC-Type": kind, "WARC-Record-ID": f"<{record_id}>", "WARC-Date": _DATE} | more | {"Content-Type": "text/html; charset=utf-8", "Content-Length": str(length)}
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n").encode("utf-8")


def record_id(page_id: int | None) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}"


def write(pages: DataFrame, scratch: Scratch, min_revisit: int = MIN_REVISIT, chunk: int | None = None) -> DataFrame:
    """Writes the archives; (path, records) of each, a written table."""
    chunk = chunk or CHUNK
    folder = scratch.folder("warc")
    revisits = scratch.save(originals(pages, scratch, min_revisit), "revisits")
    body = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    pages = pages.select("page_id", "url", body.alias("html"), F.sha1(body).alias("_sha1"))
    right = if_small(revisits.select(F.col("page_id").alias("_page"), "refers_to", F.lower(F.hex("sha1")).alias("_of")))
    joined = pages.join(right, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("_sha1") == F.col("_of")), "left").select("page_id", "url", "html", "_sha1", "refers_to")
    size = F.octet_length("html")
    # A revisit sends no payload. The chunks of a page come one after another, in order.
    last = F.when(F.col("refers_to").isNull() & (size > 0), F.floor((size - 1) / chunk).cast("int")).otherwise(0)
    piece = F.when(F.col("refers_to").isNull(), F.substring(F.col("html"), F.col("chunk_no") * chunk + 1, F.lit(chunk)))
    dealt = joined.withColumn("bytes", size).withColumn("chunk_no", F.explode(F.sequence(F.lit(0), last))).select("page_id", "url", "_sha1", "refers_to", "bytes", "chunk_no", piece.alias("data"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, n = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0

        def put(f) -> None:
            nonlocal n
            record: _Writer | None = None
            for b in batches:
                for row in zip(*(b.column(c).to_pylist() for c in ("page_id", "url", "_sha1", "refers_to", "bytes", "chunk_no")), b.column("data"), strict=True):
                    *about, chunk_no, data = row
                    if chunk_no == 0:
                        if record:
                            record.end()
                        record = _Writer(f, *about)
                        n += 1
                    record.add(memoryview(data.as_buffer()) if data.is_valid else memoryview(b""))
            if record:
                record.end()

        put_file(path, put)
        if n:
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return scratch.save(dealt.mapInArrow(run, "path string, records long"), "archives")


class _Writer:
    """One record as a gzip member, from its chunks."""

    def __init__(self, file, page: int | None, url: str | None, sha1: str, to: int | None, size: int):
        self.file, self.page, self.to, self.size, self.sha1 = file, page, to, size, bytes.fromhex(sha1)
        more = {"WARC-Target-URI": " ".join((url or "").split()), "WARC-Payload-Digest": f"sha1:{base32(self.sha1)}"}
        if to is not None:
            more |= {"WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", "WARC-Refers-To": f"<{record_id(to)}>", "X-Payload-Length": str(size)}
        self.z, self.digest = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
        file.write(self.z.compress(_head("response" if to is None else "revisit", record_id(page), size if to is None else 0, more)))
        self.left = size if to is None else 0

    def add(self, data: memoryview) -> None:
        self.left -= len(data)
        self.digest.update(data)
        self.file.write(self.z.compress(data))

    def end(self) -> None:
        if self.left or (self.to is None and self.digest.digest() != self.sha1):
            raise ValueError(f"the chunks of page {self.page} are not its payload")
        self.file.write(self.z.compress(b"\r\n\r\n"))
        self.file.write(self.z.flush())


class _Stream:
    """Reads concatenated gzip members, or plain text, by lines and by counts of bytes."""

    def __init__(self, path: str):
        self.file = open(path, "rb")  # noqa: SIM115
        self.buf, self.packed, self.z = b"", b"", None

    def more(self) -> bool:
        while True:
            raw = self.packed or self.file.read(1 << 16)
            self.packed = b""
            if not raw:
                return False
            if self.z is None:
                self.z = zlib.decompressobj(31)
            out = self.z.decompress(raw, CHUNK)
            self.packed = self.z.unconsumed_tail
            if self.z.eof:
                self.packed, self.z = self.z.unused_data, None
            if out:
                self.buf += out
                return True

    def line(self) -> bytes:
        while b"\r\n" not in self.buf:
            if not self.more():
                raise EOFError("an archive ends within a record")
        out, _, self.buf = self.buf.partition(b"\r\n")
        return out

    def take(self, n: int) -> bytes:
        while len(self.buf) < n:
            if not self.more():
                raise EOFError("an archive ends within a record")
        out, self.buf = self.buf[:n], self.buf[n:]
        return out


def chunks(path: str, chunk: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, bytes, bool]]:
    """(header fields, chunk number, data, digest so far, whether last) of every record of an archive."""
    s = _Stream(path)
    while s.buf or s.more():
        if not s.line().startswith(b"WARC/"):
            raise ValueError(f"{path} has no record where one should start")
        head: dict[str, str] = {}
        while line := s.line():
            k, _, v = line.decode("utf-8").partition(":")
            head[k.strip().lower()] = v.strip()
        left, sha, no = int(head["content-length"]), hashlib.sha1(), 0
        while True:
            data = s.take(min(chunk, left))
            left -= len(data)
            sha.update(data)
            yield head, no, data, sha.digest(), not left
            no += 1
            if not left:
                break
        if s.take(4) != b"\r\n\r\n":
            raise ValueError(f"{path} has a record that doesn't end where its length says")
    s.file.close()


def _spread(archives: DataFrame) -> DataFrame:
    """One archive a task, as far as there are tasks."""
    return archives.repartition(max(1, archives.count()))


#: Bytes of payload that a batch of chunk rows has at most, but for one chunk, and rows.
_BATCH_BYTES, _BATCH_ROWS = 1 << 20, 2000
_TABLE = pa.schema(
    [
        ("path", pa.string()), ("record_no", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("said_digest", pa.string()), ("said_bytes", pa.int64()),
        ("chunk_no", pa.int32()), ("offset", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("is_last", pa.bool_()),
    ]
)


def chunk_table(archives: DataFrame, chunk: int | None = None) -> DataFrame:
    """(path, record_no, record_id, record_type, refers_to, said_digest, said_bytes, chunk_no, offset, data, digest, is_last) of all records."""
    chunk = chunk or CHUNK

    def rows(path: str) -> Iterator[tuple]:
        no, at = -1, 0
        for head, chunk_no, data, digest, last in chunks(path, chunk):
            if chunk_no == 0:
                no, at = no + 1, 0
            said = head.get("x-payload-length", head["content-length"])
            yield path, no, head["warc-record-id"], head["warc-type"], head.get("warc-refers-to"), head["warc-payload-digest"].partition(":")[2], int(said), chunk_no, at, data, base32(digest), last
            at += len(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path in b.column("path").to_pylist():
                held, size = [], 0
                for row in rows(path):
                    held.append(row)
                    size += len(row[9])
                    if size >= _BATCH_BYTES or len(held) >= _BATCH_ROWS:
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _TABLE, strict=True)], schema=_TABLE)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), _TABLE, strict=True)], schema=_TABLE)

    schema = "path string, record_no long, record_id string, record_type string, refers_to string, said_digest string, said_bytes long, chunk_no int, offset long, data binary, digest string, is_last boolean"
    return _spread(archives).mapInArrow(run, schema)


def records(archives: DataFrame, chunk: int | None = None) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record, folded from the rows of the chunk table."""
    by_chunk = chunk_table(archives, chunk)
    last = F.max(F.struct("chunk_no", "digest", "is_last"))
    folded = by_chunk.groupBy("path", "record_no").agg(
        *(F.first(c).alias(c) for c in ("record_id", "record_type", "refers_to", "said_digest", "said_bytes")), last.alias("end"), F.count("*").alias("n_chunks"), F.sum(F.octet_length("data")).alias("bytes")
    )
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c).cast("long"))
    response = F.col("record_type") == "response"
    whole = F.col("end.is_last") & (F.col("n_chunks") == F.col("end.chunk_no") + 1) & (~response | ((F.col("end.digest") == F.col("said_digest")) & (F.col("bytes") == F.col("said_bytes"))))
    digest = F.when(whole, F.when(response, F.col("end.digest")).otherwise(F.col("said_digest"))).otherwise(F.raise_error(F.concat_ws(" ", F.lit("damaged record"), "record_id", "path")))
    return folded.select(number("record_id").alias("page_id"), F.when(response, F.col("bytes")).otherwise(F.col("said_bytes")).alias("payload_bytes"), digest.alias("payload_digest"), "record_type", number("refers_to").alias("refers_to"))
