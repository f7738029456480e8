"""WARC archives by way of a table of chunk rows.

A payload of any size travels as rows (record, chunk number, bytes): the JVM cuts it where it is read, before any
shuffle, and the writer streams one chunk after the other into its record's own gzip member, with an incremental
SHA-1 that must end at the digest in the record's header. The reader streams an archive back as
chunk rows that carry the bytes so far and the digest so far; no side holds a whole record.

Of records with equal payloads of at least ``least`` bytes, the one with the largest id is a
response and the others are revisits of it, without the payload but with its length and digest. That is decided on
(id, length, digest) alone, and chunk rows are dealt by id and digest, so copies of one page under many ids
spread over all tasks. Up to ``BROADCAST_ROWS`` revisits, counted first, are known before the deal, and their payloads stay behind.

Defined results: a null html counts as empty; a null url gives no target header; null ids come
before all others; rows that repeat both id and payload are all responses of that id, as a
record can't refer to itself. Empty tables give no archives and empty results; further columns play no part.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shuffle_width, stored, work_dir

#: Bytes of a chunk, and payload bytes from which equal payloads are stored once.
CHUNK, LEAST = 1 << 16, 1000
#: Revisits, of some 80 bytes each, that are broadcast: 8 MB at most.
BROADCAST_ROWS = 100_000
DATE = "1970-01-01T00:00:00Z"
_ID = "urn:paperloom:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_ROW = pa.schema([
    ("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("chunk_no", pa.int64()),
    ("chunk", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("last", pa.bool_()),
])
_ROW_SQL = "page_id long, record_type string, refers_to long, url string, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean"


def _rows(pages: DataFrame) -> DataFrame:
    """Each page with payload, length and digest; k and null stand for its id, row tells rows of one id and payload apart."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    key = {"k": F.coalesce("page_id", F.lit(0)), "null": F.col("page_id").isNull(), "n": F.octet_length("payload").cast("long"), "digest": F.sha1("payload"), "row": F.monotonically_increasing_id()}
    return rows.withColumns(key)


def revisits(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """k, null, digest of the records that are revisits, and the id that they refer to."""
    rows = _rows(pages).where(F.col("n") >= least).select("page_id", "k", "null", "n", "digest")
    firsts = rows.groupBy("digest", "n").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("rows")).where("rows > 1 AND refers_to IS NOT NULL").drop("rows")
    firsts = stored(firsts, work_dir(pages.sparkSession), "firsts")  # so that the join can split a digest with very many rows
    again = rows.join(firsts, ["digest", "n"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    return again.select("k", "null", "digest", "refers_to").distinct()


def chunked(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """One row per chunk, in order, all of a record next to each other in one task; a revisit has one empty chunk."""
    spark = pages.sparkSession
    again = stored(revisits(pages, least), work_dir(spark), "revisits")
    few = again.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    last = F.greatest(F.ceil(F.col("n") / chunk) - 1, F.lit(0)).cast("long")
    rows = _rows(pages).withColumn("chunk_no", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    rows = rows.withColumn("chunk", F.substring("payload", F.col("chunk_no").cast("int") * chunk + 1, F.lit(chunk))).drop("payload")
    key, deal = ["k", "null", "digest"], (shuffle_width(spark), "k", "null", "digest")
    if not few:
        rows = rows.repartition(*deal)
    typed = rows.join(F.broadcast(again) if few else again.hint("merge"), key, "left")
    whole = F.col("refers_to").isNull()
    typed = typed.where(whole | (F.col("chunk_no") == 0)).withColumns({"chunk": F.when(whole, F.col("chunk")).otherwise(F.lit(b"")), "record_type": F.when(whole, "response").otherwise("revisit")})
    dealt = typed.repartition(*deal) if few else typed
    return dealt.sortWithinPartitions("k", "null", "digest", "row", "chunk_no").select("page_id", "url", "n", "digest", "record_type", "refers_to", "chunk_no", "chunk")


def _name(page_id: int | None) -> str:
    return f"<{_ID}{'null' if page_id is None else page_id}>"


def _heads(row: dict) -> tuple[bytes, bytes]:
    """The WARC header and the HTTP header of a record."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n']}\r\n\r\n".encode()
    size = len(http) + (row["n"] if row["record_type"] == "response" else 0)
    lines = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {_name(row['page_id'])}", f"WARC-Date: {DATE}"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + quote(row["url"], safe="!#$%&'()*+,/:;=?@[]~"))
    lines.append("WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["digest"])).decode())
    if row["record_type"] == "revisit":
        lines += [f"WARC-Refers-To: {_name(row['refers_to'])}", f"WARC-Profile: {_PROFILE}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {size}", "", ""]
    return "\r\n".join(lines).encode(), http


class RecordWriter:
    """Streams records into an archive, chunk by chunk; a record is a gzip member."""

    def __init__(self, out):
        self.out, self.pack, self.records = out, None, 0

    def chunk(self, row: dict) -> None:
        if row["chunk_no"] == 0:
            self._end()
            self.pack, self.sha, self.want = zlib.compressobj(6, zlib.DEFLATED, 31), hashlib.sha1(), row["digest"] if row["record_type"] == "response" else None
            for head in _heads(row):
                self.out.write(self.pack.compress(head))
            self.records += 1
        self.sha.update(row["chunk"])
        self.out.write(self.pack.compress(row["chunk"]))

    def _end(self) -> None:
        if self.pack is not None:
            if self.want is not None and self.sha.hexdigest() != self.want:
                raise ValueError("a payload's chunks don't have its digest")
            self.out.write(self.pack.compress(b"\r\n\r\n") + self.pack.flush())
            self.pack = None

    def close(self) -> int:
        self._end()
        self.out.close()
        return self.records


def write(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes chunk rows to an archive for each task; returns the manifest (name, records)."""
    schema = pa.schema([("name", pa.string()), ("records", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        writer, part = None, f"{base}/_{uuid.uuid4().hex}"
        for batch in batches:
            for i in range(batch.num_rows):
                if writer is None:
                    store.create_dir(base, recursive=True)
                    writer = RecordWriter(store.open_output_stream(part))
                writer.chunk({name: batch.column(k)[i].as_py() for k, name in enumerate(batch.schema.names)})
        if writer is not None:
            name, n = f"part-{TaskContext.get().partitionId():06d}.warc.gz", writer.close()
            store.move(part, f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"name": name, "records": n}], schema=schema)

    return stored(chunks.mapInArrow(run, "name string, records long"), folder, "manifest")


class _Inflated:
    """The bytes of a multi-member gzip file, read piece by piece."""

    def __init__(self, source, size: int = CHUNK):
        self.source, self.size, self.raw, self.have, self.gz = source, size, b"", b"", None

    def _more(self) -> bool:
        if not self.raw:
            self.raw = self.source.read(self.size)
            if not self.raw:
                return False
        if self.gz is None:
            self.gz = zlib.decompressobj(31)
        self.have += self.gz.decompress(self.raw, self.size)
        self.raw = self.gz.unconsumed_tail
        if self.gz.eof:
            self.raw, self.gz = self.gz.unused_data or self.raw, None
        return True

    def line(self) -> bytes | None:
        while b"\r\n" not in self.have:
            if not self._more():
                return None
        line, _, self.have = self.have.partition(b"\r\n")
        return line

    def up_to(self, n: int) -> bytes:
        """Between 1 and n bytes."""
        while not self.have:
            if not self._more():
                raise EOFError("an archive ends within a record")
        out, self.have = self.have[:n], self.have[n:]
        return out

    def heads(self) -> dict[str, str]:
        found = {}
        while line := self.line():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            found[name.lower()] = value.strip()
        return found


def _page(name: str) -> int | None:
    tail = name.strip("<>").removeprefix(_ID)
    return None if tail == "null" else int(tail)


def records_of(source, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive, with bytes and digest so far; the last one has the payload's own."""
    data = _Inflated(source, chunk)
    while (line := data.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a record")
        warc = data.heads()
        data.line()  # HTTP status
        http = data.heads()
        n = int(http["content-length"])
        row = {"page_id": _page(warc["warc-record-id"]), "record_type": warc["warc-type"], "url": warc.get("warc-target-uri"), "refers_to": None, "chunk_no": 0}
        told = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        if warc["warc-type"] == "revisit":
            yield row | {"refers_to": _page(warc["warc-refers-to"]), "chunk": b"", "payload_bytes": n, "payload_digest": told, "last": True}
            continue
        sha, seen, k = hashlib.sha1(), 0, 0
        while k == 0 or seen < n:
            piece = b""
            while len(piece) < chunk and seen + len(piece) < n:
                piece += data.up_to(min(chunk - len(piece), n - seen - len(piece)))
            sha.update(piece)
            seen += len(piece)
            if seen == n and sha.hexdigest() != told:
                raise ValueError("a payload doesn't have its header's digest")
            yield row | {"chunk_no": k, "chunk": piece, "payload_bytes": seen, "payload_digest": sha.hexdigest(), "last": seen == n}
            k += 1


def read(spark: SparkSession, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The chunk table of all archives of a folder."""
    names = spark.read.schema("name string, records long").parquet(f"{folder}/manifest").select("name")
    at_once, most = 256, 8 << 20

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as f:
                    rows, held = [], 0
                    for row in records_of(f, chunk):
                        rows.append(row)
                        held += len(row["chunk"])
                        if len(rows) == at_once or held >= most:
                            yield pa.RecordBatch.from_pylist(rows, schema=_ROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, schema=_ROW)

    return names.repartition(shuffle_width(spark), "name").mapInArrow(run, _ROW_SQL)


def through_archives(pages: DataFrame, least: int = LEAST, chunk: int = CHUNK) -> DataFrame:
    """Writes all pages to archives in the shared folder and reads the chunk table back."""
    folder = f"{work_dir(pages.sparkSession)}/warc"
    write(chunked(pages, least, chunk), folder)
    return read(pages.sparkSession, folder, chunk)
