"""WARC archives as a chunked record table.

Payloads go in and out as rows (record, chunk number, bytes), so that neither writer nor reader holds
a whole record; the reader's rows carry the SHA-1 of the payload up to and with their chunk. Archives
are sequences of gzip members, one a record (WARC 1.1). Copies of a payload become revisit records.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, materialize, partitions, work_dir
from .files import reading, writing

CHUNK = 256 << 10
#: Compressed bytes after which a task begins another archive.
ARCHIVE_BYTES = 256 << 20
DATE = "2020-01-01T00:00:00Z"
# The alphabets of base 32 as conv() writes it and as RFC 4648 does.
CONV32, RFC32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_NAMESPACE = uuid.UUID("6ba7b812-9dad-11d1-80b4-00c04fd430c8")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 of a binary column, bare upper-case base 32."""
    h = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(h, i, 10), 16, 32), 8, "0") for i in (1, 11, 21, 31)]
    return F.translate(F.upper(F.concat(*parts)), CONV32, RFC32)


def record_uri(key: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{key}')}>"


def chunk_rows(pages: DataFrame, id_col: str, url_col: str, payload_col: str, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, record_type, refers_to, payload_bytes, payload_digest, chunk, n_chunks, data) of every row.

    Null payloads are empty. Of rows with equal payloads of at least least_bytes bytes those with the
    smallest id are responses and the others revisits; a null id is larger than any other. A revisit
    is one chunk without data. Only digests meet by digest. The list of revisits then meets the rows by
    id: broadcast if Spark finds it small enough, else by a shuffle of the rows with their payloads.
    """
    payload = F.encode(F.coalesce(pages[payload_col], F.lit("")), "UTF-8")
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest"))
    copies = rows.groupBy("payload_digest", "payload_bytes").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n"))
    copies = materialize(copies.where(f"n > 1 and refers_to is not null and payload_bytes >= {least_bytes}").drop("n"), "copies")
    small = rows.select("page_id", "payload_digest", "payload_bytes")
    again = small.join(copies, ["payload_digest", "payload_bytes"]).where("not page_id <=> refers_to").distinct()
    again = materialize(again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), "refers_to"), "revisits")
    drop_table(copies)
    rows = rows.join(again, rows["page_id"].eqNullSafe(again["_id"]) & (rows["payload_digest"] == again["_digest"]), "left")
    response = F.col("refers_to").isNull()
    n = F.when(response, F.greatest(F.lit(1), F.ceil(F.col("payload_bytes") / CHUNK).cast("int"))).otherwise(1)
    rows = rows.withColumn("record_type", F.when(response, "response").otherwise("revisit")).withColumn("n_chunks", n)
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    data = F.when(response, F.col("payload").substr(F.col("chunk") * CHUNK + 1, F.lit(CHUNK))).otherwise(F.lit(b""))
    return rows.select("page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "chunk", "n_chunks", data.alias("data"))


def _head(r: dict) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['payload_bytes']}\r\n\r\n"
    size = len(http) + (r["payload_bytes"] if r["record_type"] == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {r['record_type']}", f"WARC-Record-ID: {record_uri(r['page_id'])}", f"WARC-Date: {DATE}"]
    if r["url"] is not None:
        lines.append("WARC-Target-URI: " + r["url"].replace("\r", "%0D").replace("\n", "%0A"))
    if r["record_type"] == "revisit":
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_uri(r['refers_to'])}", f"X-Refers-To-Key: {r['refers_to']}"]
    if r["page_id"] is not None:
        lines.append(f"X-Record-Key: {r['page_id']}")
    lines += [f"WARC-Payload-Digest: sha1:{r['payload_digest']}", "Content-Type: application/http; msgtype=response", f"Content-Length: {size}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode("utf-8", "surrogatepass")


def write_archives(chunks: DataFrame, folder: str, level: int = 1) -> DataFrame:
    """Writes chunk rows (each record's in order, one after the other) to archives; returns (path, records)."""
    schema = pa.schema([("path", pa.string()), ("records", pa.int64())])

    def run(batches):
        rows = (r for b in batches for i in range(0, b.num_rows, 64) for r in b.slice(i, 64).to_pylist())
        part, number, row = TaskContext.get().partitionId(), 0, next(rows, None)
        while row is not None:
            path, records, size = f"{folder}/{part:06d}-{number:06d}.warc.gz", 0, 0
            with writing(path) as out:
                while row is not None and size < ARCHIVE_BYTES:
                    z = zlib.compressobj(level, zlib.DEFLATED, 31)
                    size += out.write(z.compress(_head(row)))
                    for _ in range(row["n_chunks"]):
                        size += out.write(z.compress(row["data"]))
                        row = next(rows, None)
                    size += out.write(z.compress(b"\r\n\r\n") + z.flush())
                    records += 1
            yield pa.RecordBatch.from_pylist([{"path": path, "records": records}], schema=schema)
            number += 1

    return materialize(chunks.mapInArrow(run, "path string, records long"), "archives")


class _Stream:
    """The bytes of a file of gzip members, read piece by piece."""

    def __init__(self, file):
        self.file, self.z, self.raw, self.held = file, zlib.decompressobj(31), b"", b""

    def more(self) -> bool:
        """Adds to what is held; false at the end."""
        while True:
            if not self.raw:
                self.raw = self.file.read(1 << 16)
                if not self.raw:
                    return False
            got = self.z.decompress(self.raw, CHUNK)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:
                self.raw, self.z = self.z.unused_data, zlib.decompressobj(31)
            if got:
                self.held += got
                return True

    def until(self, end: bytes) -> bytes:
        while end not in self.held:
            if not self.more():
                raise EOFError("an archive ends within a head")
        got, _, self.held = self.held.partition(end)
        return got

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self.more():
                raise EOFError("an archive ends within a block")
        got, self.held = self.held[:n], self.held[n:]
        return got

    def ended(self) -> bool:
        return not self.held and not self.more()


def _fields(head: bytes) -> dict[str, str]:
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode("utf-8", "surrogatepass").split("\r\n")[1:])}


def records(file):
    """Chunk rows of an archive: a dict per chunk, with the digest of the payload so far."""
    s = _Stream(file)
    while not s.ended():
        warc = _fields(s.until(b"\r\n\r\n"))
        http = s.until(b"\r\n\r\n")
        size = int(warc["content-length"]) - len(http) - 4
        key = warc.get("x-record-key")
        row = {"page_id": int(key) if key else None, "url": warc.get("warc-target-uri"), "record_type": warc["warc-type"], "refers_to": int(warc["x-refers-to-key"]) if "x-refers-to-key" in warc else None}
        row |= {"declared_bytes": int(_fields(http)["content-length"]), "declared_digest": warc["warc-payload-digest"].partition(":")[2]}
        sha, at, chunk = hashlib.sha1(), 0, 0
        while chunk == 0 or at < size:
            data = s.take(min(CHUNK, size - at))
            sha.update(data)
            yield row | {"chunk": chunk, "first_byte": at, "data": data, "digest": base64.b32encode(sha.digest()).decode(), "last": at + len(data) >= size}
            at, chunk = at + len(data), chunk + 1
        if s.take(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")


def read_chunks(archives: DataFrame, with_data: bool = True) -> DataFrame:
    """The chunked record table of archives (path): a row per record and chunk, see records().

    digest is the base-32 SHA-1 of the payload up to and with the chunk. with_data=False leaves data
    null, for callers that need lengths and digests only; the payloads are read all the same.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("declared_bytes", pa.int64()), ("declared_digest", pa.string()), ("chunk", pa.int32()), ("first_byte", pa.int64()), ("n_bytes", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("last", pa.bool_())])

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                with reading(path) as f:
                    held, size = [], 0
                    for r in records(f):
                        r["n_bytes"] = len(r["data"])
                        size += r["n_bytes"]
                        held.append(r if with_data else r | {"data": None})
                        if size > 8 * CHUNK or len(held) > 2000:
                            yield pa.RecordBatch.from_pylist(held, schema=schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema=schema)

    spread = archives.select("path").repartition(partitions(archives.sparkSession))
    return spread.mapInArrow(run, "page_id long, url string, record_type string, refers_to long, declared_bytes long, declared_digest string, chunk int, first_byte long, n_bytes long, data binary, digest string, last boolean")


def record_table(chunks: DataFrame) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to): a row per record.

    Bytes and digest of a response are those read; a revisit's are those it declares for the payload
    that it refers to.
    """
    revisit = F.col("record_type") == "revisit"
    size = F.when(revisit, F.col("declared_bytes")).otherwise(F.col("first_byte") + F.col("n_bytes"))
    return chunks.where("last").select("page_id", "url", size.alias("payload_bytes"), F.when(revisit, F.col("declared_digest")).otherwise(F.col("digest")).alias("payload_digest"), "record_type", "refers_to")


def round_trip(spark: SparkSession, pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record per row to archives in the shared folder, and reads the record table back.

    Nulls, copies and ids: see chunk_rows. Repeated rows stay, a payload of any length travels in chunks,
    an empty table gives no rows. Other columns of pages are not read.
    """
    archives = write_archives(chunk_rows(pages, id_col, url_col, payload_col, least_bytes), work_dir(spark, "warc"))
    return record_table(read_chunks(archives, with_data=False))
