"""WARC archives: a writer, and a sequential reader with digest verification.

Writing: each record is a gzip member of its own.  Records with the same
payload of at least ``min_bytes`` bytes are stored once: that of the smallest
key is the ``response``, the others are ``revisit`` records that refer to it.
Spark writes the archives as files of any file system that it knows: a row of
its text writer is one archive of bounded size, and the line separator is an
empty gzip member, which closes the archive (as BGZF files end).

Reading: one pass over each archive.  ``zlib`` inflates it piece by piece; a
record's header gives the length of its block, which frames it; block and
payload digests are recomputed and compared.

Defined results: null payload is empty; null keys stay null and are never the
smallest; rows that repeat the smallest key are responses all; a null target
is left out; an empty table gives archives without records and no rows back;
further columns are passed by.  A record that is cut short or whose digest
differs comes back with its ``error`` (of the first kind, the archive ends there).
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the formats.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
RECORDS = ("record_key string, target string, record_type string, refers_to string, payload_bytes long, "
           "payload_digest string, payload binary, error string")


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _name(key: str | None) -> str:
    return "<urn:row:null>" if key is None else f"<urn:row:key:{quote(key, safe='')}>"


def _key(name: str | None) -> str | None:
    return unquote(name[13:-1]) if name and name.startswith("<urn:row:key:") else None


def record(kind: str, key: str | None, target: str | None, payload: bytes | None, n_bytes: int, digest: str,
           refers_to: str | None = None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """An uncompressed record.  A revisit keeps the payload's length and digest, not the payload."""
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n_bytes + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_name(key)}", f"WARC-Date: {date}"]
    if target is not None:
        head.append(f"WARC-Target-URI: {quote(target, safe=':/?#[]@!$&()*+,;=%~')}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha256:{digest}",
             f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def write(df: DataFrame, path: str, *, key: str, payload: str, target: str | None = None, min_bytes: int = 100,
          archive_bytes: int = 16 << 20, level: int = 4) -> None:
    """Write a record per row of ``df`` to archives of about ``archive_bytes`` under ``path``."""
    rows = df.select(F.col(key).alias("k"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("html"),
                     (F.col(target) if target else F.lit(None)).cast("string").alias("target"))
    digest = F.sha2(F.encode("html", "UTF-8"), 256)
    firsts = (rows.select(F.col("k"), digest.alias("digest")).where(F.octet_length("html") >= min_bytes)
              .groupBy("digest").agg(F.min("k").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1 and first is not null").select("digest", "first"))

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, out = [], []
            for dig, k, uri, html in zip(*(c.to_pylist() for c in b.columns)):
                data = html.encode("utf-8")
                sizes.append(len(data))
                out.append(_gzip(record("response", k, uri, data, len(data), dig), level))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(sizes, pa.int64()), pa.array(out, pa.binary())],
                                             ["digest", "k", "target", "n_bytes", "member"])

    # The payload's digest deals the rows out; only compressed members are shuffled.
    made = rows.select(digest.alias("digest"), F.col("k").cast("string").alias("k"), "target", "html").mapInArrow(
        members, "digest string, k string, target string, n_bytes long, member binary")
    joined = made.join(firsts.withColumn("first", F.col("first").cast("string")), "digest", "left")
    joined = joined.select("digest", "k", "target", "n_bytes", F.when(F.col("first").eqNullSafe(F.col("k")), None).otherwise(F.col("first")).alias("first"), "member")

    def archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size = 0
        for b in batches:
            for dig, k, uri, n, first, member in zip(*(c.to_pylist() for c in b.columns)):
                if first is not None:
                    member = _gzip(record("revisit", k, uri, None, n, dig, first), level)
                held.append(member)
                size += len(member)
                if size >= archive_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], ["archive"])

    (joined.mapInArrow(archives, "archive binary").select(F.col("archive").cast("string"))
     .write.option("encoding", "ISO-8859-1").option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", 1).text(path))


class Reader:
    """Iterates over the records of one archive, given as an iterator of byte chunks.

    Holds one record at a time.  Yields ``(headers, block, error)``.
    """

    def __init__(self, chunks: Iterator[bytes]):
        self.chunks, self.ready = iter(chunks), b""

    def _members(self) -> Iterator[Iterator[bytes]]:
        while self.ready or (chunk := next(self.chunks, b"")):
            if not self.ready:
                self.ready = chunk
            yield self._inflate()

    def _inflate(self) -> Iterator[bytes]:
        z = zlib.decompressobj(31)
        while not z.eof:
            if not self.ready:
                self.ready = next(self.chunks, b"")
                if not self.ready:
                    raise EOFError("the archive ends within a gzip member")
            out = z.decompress(self.ready)
            self.ready = z.unused_data if z.eof else b""
            if out:
                yield out

    def __iter__(self) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
        for member in self._members():
            head, block, need, headers = bytearray(), bytearray(), None, {}
            try:
                for data in member:
                    if need is None:
                        head += data
                        if (cut := head.find(b"\r\n\r\n")) < 0:
                            continue
                        headers = parse_headers(bytes(head[:cut]))
                        need = int(headers["content-length"])
                        data = bytes(head[cut + 4:])
                    block += data
                if need is None:
                    if head:
                        raise ValueError("a record's header has no end")
                    continue                                 # an empty member
                if len(block) != need + 4 or block[need:] != b"\r\n\r\n":
                    raise ValueError("a record's block is not as long as its header says")
            except (EOFError, ValueError, KeyError, zlib.error) as e:
                yield headers, bytes(block), f"{type(e).__name__}: {e}"
                return
            body = bytes(memoryview(block)[:need])
            yield headers, body, _digest_error(headers.get("warc-block-digest"), body, "block")


def parse_headers(data: bytes) -> dict[str, str]:
    """Header fields by lower-case name; a line that starts with a space or tab goes on with the one before."""
    lines = data.decode("utf-8", "replace").replace("\r\n ", " ").replace("\r\n\t", " ").split("\r\n")
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}


def _digest_error(said: str | None, data: bytes, what: str) -> str | None:
    """Digests may be written in hex or in base32, the usual form elsewhere; what cannot be checked is said to be so."""
    if said is None:
        return None
    kind, _, value = said.partition(":")
    try:
        digest = hashlib.new(kind.strip().lower().replace("-", ""), data).digest()
    except (ValueError, TypeError):
        return f"{what} digest not verified: unknown algorithm {kind}"
    value = value.strip()
    right = value.lower() == digest.hex() or value.upper().rstrip("=") == base64.b32encode(digest).decode().rstrip("=")
    return None if right else f"{what} digest differs"


def parse(headers: dict[str, str], block: bytes, error: str | None) -> tuple:
    kind, http, _, payload = headers.get("warc-type"), *block.partition(b"\r\n\r\n")
    said = headers.get("warc-payload-digest")
    if kind == "revisit":
        size, payload = parse_headers(http).get("content-length"), None
    else:
        size, error = len(payload), error or _digest_error(said, payload, "payload")
    return (_key(headers.get("warc-record-id")), headers.get("warc-target-uri"), kind, _key(headers.get("warc-refers-to")),
            None if size is None else int(size), said.partition(":")[2].lower() if said else None, payload, error)


def read(spark: SparkSession, path: str, *, payloads: bool = True, chunk: int = 1 << 16) -> DataFrame:
    """All records of the archives under ``path``; without ``payloads``, these are verified and left out."""
    names = [x.split()[0] for x in RECORDS.split(", ")]
    types = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.binary(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for b in batches:
            for content in b.column(0):
                data, rows, size = memoryview(content.as_buffer()), [], 0
                for headers, block, error in Reader(data[i:i + chunk] for i in range(0, len(data), chunk)):
                    row = parse(headers, block, error)
                    rows.append(row if payloads else (*row[:6], None, row[7]))
                    size += len(block) if payloads else 100
                    if size > 8 << 20:
                        yield batch(rows)
                        rows, size = [], 0
                if rows:
                    yield batch(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, RECORDS)
