"""Web archives as a chunked record table.

Payloads travel as (record, chunk number) rows of at most CHUNK bytes, so neither the writer nor the
reader of an archive ever holds a whole record, and each chunk row read carries the digest of its
payload up to and including it. A payload that several records share is stored once, as a response;
the others are revisits that name it.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from resolvescope.llm.common import Scratch, small_batches, text_of

CHUNK = 1 << 20
PIECE = 1 << 16
ROWS_AT_ONCE, BYTES_AT_ONCE = 512, 16 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


PAYLOADS = pa.schema([
    ("record", pa.int64()), ("page_id", pa.int64()), ("url", pa.string()), ("n_bytes", pa.int64()), ("chunk", pa.int32()), ("payload", pa.binary()),
    ("so_far", pa.string()), ("digest", pa.string()), ("is_last", pa.bool_()),
])


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def payload_chunks(records: DataFrame, payload: bool = True, chunk: int = CHUNK) -> DataFrame:
    """(record, page_id, url, n_bytes, chunk, payload, so_far, digest, is_last): the rows of at most ``chunk``
    bytes of every record (record, page_id, url, html).

    ``so_far`` is the digest of the payload up to and including the row, ``digest`` that of the last row, both
    from one pass over the payload. Without ``payload`` only the last row of a record is made, without bytes.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            own = [batch.column(c) for c in ("record", "page_id", "url", "html")]
            for record, page_id, url, html in zip(*own):
                data, digest, so_far = memoryview(html.as_buffer()), hashlib.sha1(), []
                for start in range(0, max(len(data), 1), chunk):
                    digest.update(data[start:start + chunk])
                    so_far.append(base32(digest.digest()))
                head = {"record": record.as_py(), "page_id": page_id.as_py(), "url": url.as_py(), "n_bytes": len(data), "digest": so_far[-1]}
                for k in range(len(so_far)) if payload else [len(so_far) - 1]:
                    part = bytes(data[k * chunk:(k + 1) * chunk]) if payload else None
                    rows.append(head | {"chunk": k, "payload": part, "so_far": so_far[k], "is_last": k == len(so_far) - 1})
                    held += len(part or b"")
                    if len(rows) >= ROWS_AT_ONCE or held >= BYTES_AT_ONCE:
                        yield pa.RecordBatch.from_pylist(rows, schema=PAYLOADS)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=PAYLOADS)

    schema = "record long, page_id long, url string, n_bytes long, chunk int, payload binary, so_far string, digest string, is_last boolean"
    return records.mapInArrow(cut, schema)


def record_roles(records: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, digest, n_bytes, record_type, refers_to), distinct, of (page_id, digest, n_bytes) rows.

    Of the records with one digest and at least ``least_bytes`` that of the largest page_id is the
    response. The shared digests are found by a map-side combined count, so a digest of a third of all
    records is one row per task; the join back carries ids and digests only.
    """
    shared = records.where(F.col("n_bytes") >= least_bytes).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return records.join(shared, "digest", "left").select(
        "page_id", "digest", "n_bytes", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to")).distinct()


def write_archives(pages: DataFrame, scratch: Scratch, least_bytes: int = 0, date: str = "2024-01-01T00:00:00Z", html: str = "html") -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) and return the archives: (path, n_records).

    Payloads travel as chunk rows, each checked against its digest so far when it is written. Every task streams its records into one gzip-per-record archive in the shared folder. A file counts
    only once its task has returned its name, so a task that is lost and run again leaves no double.
    Payloads cross the network once, for the join with their roles; a revisit's is not written.
    """
    spark = pages.sparkSession
    small_batches(spark)
    own = pages.select(F.monotonically_increasing_id().alias("record"), F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), text_of(html).cast("binary").alias("html"))
    digested = scratch.cut(payload_chunks(own, payload=False).select("page_id", "digest", "n_bytes"))
    roles = scratch.cut(record_roles(digested, least_bytes)).select(F.col("page_id").alias("r_id"), F.col("digest").alias("r_digest"), "record_type", "refers_to")
    # Cut into chunks before they are dealt out: no row that is shuffled or sorted holds more than one chunk.
    joined = payload_chunks(own).join(roles.hint("shuffle_hash"), F.col("page_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")))
    kept = joined.where((F.col("record_type") == "response") | (F.col("chunk") == 0))
    payload = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit("").cast("binary"))
    chunks = kept.select("record", "page_id", "url", "digest", "n_bytes", "record_type", "refers_to", payload.alias("payload"), "chunk", "so_far")
    chunks = chunks.sortWithinPartitions("page_id", "digest", "record", "chunk")
    folder = scratch.folder("archives")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(folder)
        path, out, packer, n = f"{root}/{uuid.uuid4().hex}.warc.gz", None, None, 0
        try:
            for batch in batches:
                for row in batch.to_pylist():
                    if out is None:
                        fs.create_dir(root)
                        out = fs.open_output_stream(path, compression=None)
                    if row["chunk"] == 0:
                        if packer is not None:
                            out.write(packer.compress(b"\r\n\r\n") + packer.flush())
                        packer, seen = zlib.compressobj(1, zlib.DEFLATED, 31), hashlib.sha1()
                        out.write(packer.compress(record_head(row, date)))
                        n += 1
                    if row["record_type"] == "response":
                        seen.update(row["payload"])
                        if base32(seen.digest()) != row["so_far"]:
                            raise ValueError(f"chunk {row['chunk']} of page {row['page_id']} does not follow on the one before")
                    out.write(packer.compress(row["payload"]))
            if packer is not None:
                out.write(packer.compress(b"\r\n\r\n") + packer.flush())
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_pylist([{"path": path, "n_records": n}] if n else [], schema=pa.schema([("path", pa.string()), ("n_records", pa.int64())]))

    return scratch.cut(chunks.mapInArrow(write, "path string, n_records long"))


def filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a Spark path, and the path on it."""
    if re.match(r"file:/(?!/)", folder):
        folder = "file://" + folder[len("file:"):]
    return pafs.FileSystem.from_uri(folder)


def record_head(row: dict, date: str) -> bytes:
    """What stands in an archive before a record's payload."""
    response = row["record_type"] == "response"
    http = HTTP % row["n_bytes"]
    clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"] or "")
    named = lambda page: f"<urn:page:{'' if page is None else page}>"
    fields = [
        ("WARC-Type", row["record_type"]), ("WARC-Record-ID", named(row["page_id"])), ("WARC-Date", date), ("WARC-Target-URI", clean or "about:blank"),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"), ("X-Payload-Bytes", str(row["n_bytes"])),
        *([] if response else [("WARC-Profile", PROFILE), ("WARC-Refers-To", named(row["refers_to"]))]),
        ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(http) + (row["n_bytes"] if response else 0))),
    ]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + http


class Inflated:
    """A stream of gzip members as bytes, at most about PIECE of them in memory."""

    def __init__(self, stream):
        self.stream, self.unpacker, self.packed, self.buffer = stream, zlib.decompressobj(31), b"", bytearray()

    def _more(self) -> bool:
        if self.unpacker.eof:
            self.packed, self.unpacker = self.unpacker.unused_data, zlib.decompressobj(31)
        if not self.packed:
            self.packed = self.stream.read(PIECE)
            if not self.packed:
                return False
        self.buffer += self.unpacker.decompress(self.packed, PIECE)
        self.packed = self.unpacker.unconsumed_tail
        return True

    def line(self) -> bytes:
        """Up to and without the next CRLF; empty at the end."""
        while (end := self.buffer.find(b"\r\n")) < 0:
            if not self._more():
                return b""
        found = bytes(self.buffer[:end])
        del self.buffer[:end + 2]
        return found

    def take(self, most: int) -> bytes:
        """Some bytes, at most so many; empty at the end."""
        while not self.buffer and self._more():
            pass
        found = bytes(self.buffer[:most])
        del self.buffer[:most]
        return found


def archive_chunks(stream, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of an archive's records, in order, with the digest of the payload so far."""
    source = Inflated(stream)
    while version := source.line():
        if not version.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while line := source.line():
            name, _, value = line.decode().partition(": ")
            fields[name] = value
        left, status = int(fields["Content-Length"]), source.line()
        left -= len(status) + 2
        while line := source.line():
            left -= len(line) + 2
        left -= 2
        page = lambda text: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", text or "")) else None
        head = {"page_id": page(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"], "refers_to": page(fields.get("WARC-Refers-To")), "payload_bytes": int(fields["X-Payload-Bytes"])}
        stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        digest, number, offset = hashlib.sha1(), 0, 0
        while True:
            part = bytearray()
            while left and len(part) < chunk:
                got = source.take(min(left, chunk - len(part)))
                if not got:
                    raise ValueError(f"record of page {head['page_id']} ends early")
                part += got
                left -= len(got)
            digest.update(part)
            so_far = base32(digest.digest()) if head["record_type"] == "response" else stated
            yield head | {"chunk": number, "offset": offset, "data": bytes(part), "digest": so_far, "is_last": not left}
            number, offset = number + 1, offset + len(part)
            if not left:
                break
        if so_far != stated:
            raise ValueError(f"payload of page {head['page_id']} does not have its digest")
        if source.line() or source.line():
            raise ValueError(f"record of page {head['page_id']} does not end where it says")


CHUNKS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
    ("chunk", pa.int32()), ("offset", pa.int64()), ("data", pa.binary()), ("digest", pa.string()), ("is_last", pa.bool_()),
])
def read_chunks(archives: DataFrame, payload: bool = True) -> DataFrame:
    """The chunked record table of archives: page_id, url, record_type, refers_to, payload_bytes, chunk,
    offset, data, digest (of the payload so far; a revisit's as stated), is_last.

    Files are dealt over the tasks and streamed; payloads are checked against their digests. With
    ``payload`` false the data column is null.
    """
    files = archives.select("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                with filesystem(path)[0].open_input_stream(filesystem(path)[1], compression=None) as stream:
                    rows, held = [], 0
                    for row in archive_chunks(stream):
                        held += len(row["data"]) if payload else 0
                        rows.append(row if payload else row | {"data": None})
                        if len(rows) >= ROWS_AT_ONCE or held >= BYTES_AT_ONCE:
                            yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)
                            rows, held = [], 0
                    yield pa.RecordBatch.from_pylist(rows, schema=CHUNKS)

    schema = "page_id long, url string, record_type string, refers_to long, payload_bytes long, chunk int, offset long, data binary, digest string, is_last boolean"
    return files.repartition(max(1, files.count())).mapInArrow(read, schema)


def archived(pages: DataFrame, least_bytes: int = 0, html: str = "html") -> DataFrame:
    """Write ``pages`` to archives and read them back: page_id, payload_bytes, payload_digest, record_type,
    refers_to of every record.

    A null html is an empty payload, which has a digest like any other. Rows that repeat a page_id and
    payload have the same role. A row with a null page_id is a response only if no row with an id has
    its payload. An empty table gives no archive and no rows; extra columns are ignored.
    """
    archives = write_archives(pages, Scratch(pages.sparkSession), least_bytes, html=html)
    return read_chunks(archives, payload=False).where("is_last").select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
