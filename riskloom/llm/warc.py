"""WARC archives as a chunked record table.

``chunk_rows`` turns every page into (record, chunk number) rows: slices of the
payload with the digest and length of everything up to that slice, so no step
copies a whole payload. Each chunk becomes one WARC/1.1 record: the first a
``response``, further ones ``continuation`` segments of it; a page whose
payload was archived under a smaller page_id becomes one ``revisit`` record
without payload. Spark's text sink writes the records (its line separator is
the record terminator) as gzip files in the shared folder; ``read_chunks``
streams those files back into chunk rows and digests them anew.

A file ends after ``FILE_RECORDS`` records wherever that falls, so the segments
of a long record may lie in two files or more. Records of one segment are
digested where they are read. Segments are put together by record key and
segment number: an exchange of long records alone, sorted and streamed, one
segment in memory at a time.

Defined results: a null html is an empty payload; payloads under ``min_bytes``
are always responses; a null page_id never names a response, it revisits the
smallest id of its payload if there is one; repeated rows are archived each;
an empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir
from .text import text_arrays

CHUNK_BYTES = 64 << 10
MIN_BYTES = 100
#: Records of one archive file; with the chunk size it bounds a file that is read as one row.
FILE_RECORDS = 512
END = b"\r\n\r\n"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Fixed date of all records: an archive of the same table is the same archive.
DATE = "2024-01-01T00:00:00Z"

CHUNK_SCHEMA = ("page_id long, url string, record_type string, refers_to long, payload_digest string, "
                "payload_bytes long, chunk int, start long, data binary, running_digest string, last boolean")
SEGMENT_SCHEMA = ("record_key string, number int, page_id long, url string, kind string, refers_to long, payload_digest string, "
                  "payload_bytes long, last boolean, data binary")


def decide(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Pages with payload digest, length, record type and the page a revisit refers to."""
    html = F.coalesce("html", F.lit(""))
    facts = pages.select("page_id", "url", "html", F.sha2(html.cast("binary"), 256).alias("payload_digest"),
                         F.octet_length(html).cast("long").alias("payload_bytes"))
    first = (facts.where((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull())
             .groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
             .select(F.col("payload_digest").alias("d"), "first"))
    again = (F.col("payload_bytes") >= min_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return (facts.join(first, F.col("payload_digest") == F.col("d"), "left")
            .select("page_id", "url", "html", "payload_digest", "payload_bytes",
                    F.when(again, "revisit").otherwise("response").alias("record_type"),
                    F.when(again, F.col("first")).alias("refers_to")))


def _flush(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)


CHUNK_ARROW = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                         ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()),
                         ("data", pa.binary()), ("running_digest", pa.string()), ("last", pa.bool_())])
SEGMENT_ARROW = pa.schema([("record_key", pa.string()), ("number", pa.int32()), ("page_id", pa.int64()), ("url", pa.string()), ("kind", pa.string()),
                           ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("last", pa.bool_()),
                           ("data", pa.binary())])


def chunk_rows(decided: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The chunked record table; a revisit has one chunk without data."""
    def cut(batches):
        for batch in batches:
            data, offsets = text_arrays(batch.column(batch.schema.get_field_index("html")))
            names = ("page_id", "url", "record_type", "refers_to", "payload_digest", "payload_bytes")
            heads = list(zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in names)))
            rows, held = [], 0
            for head, lo, hi in zip(heads, offsets[:-1].tolist(), offsets[1:].tolist()):
                if head[2] == "revisit":
                    lo = hi
                sha, at, k = hashlib.sha256(), lo, 0
                while True:
                    piece = data[at : min(at + chunk_bytes, hi)].tobytes()
                    sha.update(piece)
                    last = at + len(piece) >= hi
                    rows.append((*head, k, at - lo, piece, sha.hexdigest(), last))
                    held, at, k = held + len(piece), at + len(piece), k + 1
                    if held >= 1 << 20 or len(rows) >= 1000:
                        yield _flush(rows, CHUNK_ARROW)
                        rows, held = [], 0
                    if last:
                        break
            if rows:
                yield _flush(rows, CHUNK_ARROW)
    return decided.mapInArrow(cut, CHUNK_SCHEMA)


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}:{digest}')}>"


def slices(batches, rows: int = 32):
    """The batches a few rows at a time: with chunks of 64 KB, about two megabytes are Python objects at once."""
    for batch in batches:
        for lo in range(0, batch.num_rows, rows):
            yield batch.slice(lo, rows)


def record_bytes(chunks: DataFrame) -> DataFrame:
    """One WARC record (without its terminator) per chunk row, in chunk order."""
    def encode(batches):
        task, record = TaskContext.get().partitionId(), 0
        for batch in slices(batches):
            out = []
            for r in batch.to_pylist():
                record += r["chunk"] == 0  # tells repeated rows apart, whose record ids are the same
                own = _record_id(r["page_id"], r["payload_digest"])
                k, segmented = r["chunk"], r["chunk"] > 0 or not r["last"]
                kind = "continuation" if k else r["record_type"]
                body = (HTTP if not k else b"") + r["data"]
                url = "".join((r["url"] or "urn:none").split())
                head = ["WARC/1.1", f"WARC-Type: {kind}",
                        f"WARC-Record-ID: {own if not k else _record_id(own, k)}", f"WARC-Date: {DATE}",
                        f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha256:{r['payload_digest']}",
                        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
                        f"X-Payload-Bytes: {r['payload_bytes']}"]
                if r["page_id"] is not None:
                    head.append(f"X-Page-Id: {r['page_id']}")
                if segmented:
                    head += [f"WARC-Segment-Number: {k + 1}", f"X-Record-Key: {task}-{record}"]
                    if k:
                        head.append(f"WARC-Segment-Origin-ID: {own}")
                    if r["last"]:
                        head.append(f"WARC-Segment-Total-Length: {len(HTTP) + r['start'] + len(r['data'])}")
                if kind == "revisit":
                    head += [f"WARC-Refers-To: {_record_id(r['refers_to'], r['payload_digest'])}",
                             f"X-Refers-To-Page: {r['refers_to']}",
                             "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
                head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
                out.append("\r\n".join(head).encode() + END + body)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
    return chunks.mapInArrow(encode, "record binary").select(F.col("record").cast("string").alias("value"))


def write_archives(pages: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, min_bytes: int = MIN_BYTES,
                   file_records: int = FILE_RECORDS) -> None:
    """Write ``pages`` (page_id, url, html) as gzip WARC files under ``path``."""
    records = record_bytes(chunk_rows(decide(pages, min_bytes), chunk_bytes))
    (records.write.option("lineSep", END.decode()).option("compression", "gzip")
     .option("maxRecordsPerFile", file_records).text(path))


class _Stream:
    """Bytes of a gzip archive, decompressed a piece at a time."""

    def __init__(self, packed: memoryview, piece: int = 64 << 10) -> None:
        self.packed, self.piece, self.at = packed, piece, 0
        self.inflate, self.held = zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        if self.at >= len(self.packed) and not self.inflate.unconsumed_tail:
            rest = self.inflate.flush()
            self.held += rest
            return bool(rest)
        source = self.inflate.unconsumed_tail
        if not source:
            source = self.packed[self.at : self.at + self.piece]
            self.at += len(source)
        self.held += self.inflate.decompress(source, 4 * self.piece)
        if self.inflate.eof and (rest := self.inflate.unused_data):
            self.at -= len(rest)
            self.inflate = zlib.decompressobj(31)
        return True

    def until(self, mark: bytes) -> bytes | None:
        while (found := self.held.find(mark)) < 0:
            if not self._more():
                if self.held:
                    raise ValueError("archive ends inside a record")
                return None
        out = bytes(self.held[:found])
        del self.held[: found + len(mark)]
        return out

    def take(self, n: int) -> bytes:
        while len(self.held) < n:
            if not self._more():
                raise ValueError("archive ends inside a record")
        out = bytes(self.held[:n])
        del self.held[:n]
        return out


def _records(packed: memoryview):
    """(headers, body) of one archive file, each checked against its block digest."""
    stream = _Stream(packed)
    while (head := stream.until(END)) is not None:
        first, *lines = head.decode().split("\r\n")
        if not first.startswith("WARC/"):
            raise ValueError(f"not a WARC record: {first[:40]!r}")
        h = dict(line.split(": ", 1) for line in lines)
        body = stream.take(int(h["Content-Length"]))
        if stream.take(len(END)) != END:
            raise ValueError("record without its end")
        if f"sha256:{hashlib.sha256(body).hexdigest()}" != h["WARC-Block-Digest"]:
            raise ValueError(f"damaged record {h['WARC-Record-ID']}")
        yield h, body if h["WARC-Type"] == "continuation" else body[len(HTTP):]


def _number(h: dict, name: str) -> int | None:
    return int(h[name]) if name in h else None


def _check(record: str, kind: str, digest: str, size: int, said_digest: str, said_size: int) -> None:
    if kind == "response" and (digest != said_digest or size != said_size):
        raise ValueError(f"payload differs from its digest: {record}")


def _whole(packed: memoryview):
    """Chunk rows of the records of one segment."""
    for h, data in _records(packed):
        if "WARC-Segment-Number" not in h:
            digest, said, size = hashlib.sha256(data).hexdigest(), h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Bytes"])
            _check(h["WARC-Record-ID"], h["WARC-Type"], digest, len(data), said, size)
            yield (_number(h, "X-Page-Id"), h["WARC-Target-URI"], h["WARC-Type"], _number(h, "X-Refers-To-Page"), said, size, 0, 0, data, digest, True)


def _segments(packed: memoryview):
    """Segment rows (``SEGMENT_SCHEMA``) of the longer records."""
    for h, data in _records(packed):
        if "WARC-Segment-Number" in h:
            yield (h["X-Record-Key"], int(h["WARC-Segment-Number"]), _number(h, "X-Page-Id"), h["WARC-Target-URI"], h["WARC-Type"], _number(h, "X-Refers-To-Page"),
                   h["WARC-Payload-Digest"].removeprefix("sha256:"), int(h["X-Payload-Bytes"]), "WARC-Segment-Total-Length" in h, data)


def _batched(rows, schema: pa.Schema, data_at: int):
    """Record batches of about a megabyte."""
    out, held = [], 0
    for row in rows:
        out.append(row)
        held += len(row[data_at])
        if held >= 1 << 20 or len(out) >= 1000:
            yield _flush(out, schema)
            out, held = [], 0
    if out:
        yield _flush(out, schema)


def _put_together(batches):
    """Chunk rows of long records from their segments in order; only the digest and the length so far are held."""
    def rows():
        key, sha, start, number, first = None, None, 0, 0, None
        for batch in slices(batches):
            for r in batch.to_pylist():
                if r["record_key"] != key:
                    if key is not None and first is not None:
                        raise ValueError(f"record {key} lacks its last segment")
                    key, sha, start, number, first = r["record_key"], hashlib.sha256(), 0, 0, r
                if r["number"] != number + 1 or first is None:
                    raise ValueError(f"record {key}: segment {r['number']} after {number}")
                number, data = r["number"], r["data"]
                sha.update(data)
                digest = sha.hexdigest()
                if r["last"]:
                    _check(key, first["kind"], digest, start + len(data), r["payload_digest"], r["payload_bytes"])
                yield (r["page_id"], r["url"], first["kind"], first["refers_to"], r["payload_digest"], r["payload_bytes"], number - 1, start, data, digest, r["last"])
                start += len(data)
                first = None if r["last"] else first
        if first is not None:
            raise ValueError(f"record {key} lacks its last segment")
    yield from _batched(rows(), CHUNK_ARROW, 8)


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    """The chunked record table read back from archives."""
    def parsed(parse, schema: pa.Schema, data_at: int, kind: str) -> DataFrame:
        def read(batches):
            yield from _batched((row for batch in batches for content in batch.column(0) for row in parse(memoryview(content.as_buffer()))), schema, data_at)
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").schema("path string, modificationTime timestamp, length long, content binary")
        return files.load(path).select("content").mapInArrow(read, kind)

    segments = parsed(_segments, SEGMENT_ARROW, 9, SEGMENT_SCHEMA).repartition("record_key").sortWithinPartitions("record_key", "number")
    return parsed(_whole, CHUNK_ARROW, 8, CHUNK_SCHEMA).unionByName(segments.mapInArrow(_put_together, CHUNK_SCHEMA))


def archive_round_trip(pages: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write the archives to the shared folder, read them back: one row per record."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path, chunk_bytes)
    return read_chunks(spark, path).where("last").select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
