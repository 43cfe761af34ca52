"""WARC archives written and read as tables of chunks.

A payload is never handled as a whole by the writer or the reader: it is a run
of rows (record, chunk_no, data), each of ``CHUNK_BYTES`` at most, and what must
be known of all of it (size, SHA-1) is carried along from chunk to chunk.

Writing. Payload digests are grouped to find payloads that several records
share; of these the smallest page_id is written as ``response``, the others as
``revisit`` records that name it and have no payload. Rows become chunk rows
beside each other in their partition, and a task streams them into archives in
the shared folder: ``.warc.gz``, one gzip member a record, a new file beyond
``ARCHIVE_BYTES``. The task's result is a manifest: (archive, offset, length,
records) of segments of some MB that begin at a record. Spark commits the
manifest, so files of failed or repeated attempts are never read.

Reading. Segments are dealt to tasks; each is decompressed and parsed as a
stream, giving chunk rows with the digest of all payload bytes so far. A
record's last chunk row thus has its payload's digest and size without any
grouping, and ``intact`` tells whether they are the declared ones.

The folder must be one that pyarrow.fs opens (local or NFS, HDFS, S3, GCS).

Edge cases: a null payload is an empty one; empty payloads are equal; payloads
below ``least_bytes`` are all responses; rows that share the smallest page_id
and the payload are all responses; a null page_id is written as ``null``, loses
to any other, and is a response only among null ids; in urls all but printable
ASCII is percent-encoded, a null url is ``about:blank``; an empty table gives
no archive and reads back empty; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from risklens.llm.tables import SMALL_ROWS, bound_batches, load, new_folder, written

CHUNK_BYTES = 1 << 20
SEGMENT_BYTES = 8 << 20
ARCHIVE_BYTES = 1 << 30
COMPRESSION = 6
#: Chunk rows of one Arrow batch that the reader makes, and their bytes.
BATCH_ROWS, BATCH_BYTES = 2000, 4 << 20

MANIFEST = "archive string, offset long, length long, records long"
CHUNKS = ("record_id string, record_type string, target_uri string, refers_to string, declared_digest string, declared_bytes long, "
          "chunk_no int, last boolean, payload_bytes long, payload_digest string, data binary")
_HTTP_TYPE = "application/http;msgtype=response"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_name(page_id: int | None, sha1_hex: str) -> str:
    return f"urn:page:{'null' if page_id is None else page_id}:{base32(bytes.fromhex(sha1_hex))}"


def page_of(record_id: Column) -> Column:
    """page_id of a record's name."""
    return F.regexp_extract(record_id, r"^urn:page:(-?\d+):", 1).try_cast("long")


def with_roles(rows: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``rows`` (page_id, sha1, n_bytes, ...) with ``first``: the smallest
    page_id that has the payload, where it is another one, else null.

    Only digests of several rows are joined. Few of them are broadcast; beyond
    that, those that hold more than 1/50,000 of all rows each, of which there
    can't be more than 50,000, so that no key of the shuffle join is hot.
    """
    named = F.struct(F.col("page_id").alias("id"))  # never null, so that null ids count
    shared = written(
        rows.where(F.col("n_bytes") >= least_bytes).groupBy("sha1")
        .agg(F.count("*").alias("held"), F.min("page_id").alias("least"), F.count_distinct(named).alias("ids"))
        .where(F.col("ids") > 1).select(F.col("sha1").alias("s_sha1"), "held", "least"), "warc-shared")
    n = shared.count()
    if n <= SMALL_ROWS:
        met = rows.join(F.broadcast(shared), F.col("sha1") == F.col("s_sha1"), "left")
    else:
        total = rows.count()
        is_hot = F.col("held") * SMALL_ROWS > total
        hot = shared.where(is_hot).select(F.col("s_sha1").alias("h_sha1"), F.col("least").alias("h_least"))
        # rows of hot digests get keys of their own, which meet nothing
        key = F.when(F.col("h_sha1").isNull(), F.col("sha1")).otherwise(F.concat(F.lit("-"), F.xxhash64("page_id").cast("string")))
        met = (rows.join(F.broadcast(hot), F.col("sha1") == F.col("h_sha1"), "left").withColumn("key", key)
               .join(shared.where(~is_hot), F.col("key") == F.col("s_sha1"), "left")
               .withColumn("least", F.coalesce("h_least", "least")))
    first = F.when(~F.col("page_id").eqNullSafe(F.col("least")), F.col("least"))
    return met.select(*rows.columns, first.alias("first"))


def chunked(rows: DataFrame, payload: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``rows`` with their binary ``payload`` as rows ``chunk_no, last, data``, one at least."""
    last = F.floor(F.greatest(F.length(payload) - 1, F.lit(0)) / chunk_bytes).cast("int")
    others = [c for c in rows.columns if c != payload]
    return (rows.select(*others, payload, F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
            .select(*others, "chunk_no", (F.col("chunk_no") == last).alias("last"),
                    F.substring(F.col(payload), F.col("chunk_no") * chunk_bytes + 1, F.lit(chunk_bytes)).alias("data")))


def _file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


class ArchiveWriter:
    """Streams chunk rows into archives; ``done`` collects finished segments."""

    def __init__(self, folder: str, name: str, date: str):
        self.fs, self.path = _file_system(folder)
        self.folder, self.name, self.date = folder, name, date
        self.files, self.out, self.done = 0, None, []

    def open(self) -> None:
        file = f"{self.name}-{self.files:03d}.warc.gz"
        self.archive, self.out = f"{self.folder}/{file}", self.fs.open_output_stream(f"{self.path}/{file}", compression=None)
        self.files, self.at, self.start, self.records = self.files + 1, 0, 0, 0
        body = b"software: chunked record tables\r\nformat: WARC File Format 1.1\r\n"
        self.begin([("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:archive:{file}>"), ("WARC-Date", self.date),
                    ("WARC-Filename", file), ("Content-Type", "application/warc-fields"), ("Content-Length", len(body))])
        self.put(body)
        self.end()
        self.records = 0

    def put(self, data: bytes) -> None:
        packed = self.gzip.compress(data)
        if packed:
            self.out.write(packed)
            self.at += len(packed)

    def begin(self, fields: list[tuple]) -> None:
        self.gzip = zlib.compressobj(COMPRESSION, zlib.DEFLATED, 31)
        self.put(("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode())

    def end(self) -> None:
        packed = self.gzip.compress(b"\r\n\r\n") + self.gzip.flush()
        self.out.write(packed)
        self.at += len(packed)
        self.records += 1

    def segment(self) -> None:
        if self.at > self.start:
            self.done.append((self.archive, self.start, self.at - self.start, self.records))
            self.start, self.records = self.at, 0

    def close(self) -> None:
        if self.out is not None:
            self.segment()
            self.out.close()
            self.out = None

    def add(self, row: dict) -> None:
        """The next chunk row; a record's chunks come one after the other."""
        from urllib.parse import quote

        if row["chunk_no"] == 0:
            if self.out is None:
                self.open()
            visible = "".join(map(chr, range(0x21, 0x7F)))
            url = "about:blank" if row["url"] is None else quote(row["url"], safe=visible)
            http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['n_bytes']}\r\n\r\n").encode()
            fields = [("WARC-Type", "response" if row["first"] is None else "revisit"),
                      ("WARC-Record-ID", f"<{record_name(row['page_id'], row['sha1'])}>"), ("WARC-Date", self.date), ("WARC-Target-URI", url),
                      ("WARC-Payload-Digest", f"sha1:{base32(bytes.fromhex(row['sha1']))}")]
            if row["first"] is not None:
                fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", f"<{record_name(row['first'], row['sha1'])}>")]
            held = row["n_bytes"] if row["first"] is None else 0
            self.begin([*fields, ("Content-Type", _HTTP_TYPE), ("Content-Length", len(http) + held)])
            self.put(http)
            self.so_far = hashlib.sha1()
        self.put(row["data"])
        self.so_far.update(row["data"])
        if row["last"]:
            if row["first"] is None and self.so_far.hexdigest() != row["sha1"]:
                raise ValueError(f"chunks of page {row['page_id']} don't make up its payload")
            self.end()
            if self.at - self.start >= SEGMENT_BYTES:
                self.segment()
            if self.at >= ARCHIVE_BYTES:
                self.close()


def write(pages: DataFrame, folder: str, page_id: str = "page_id", url: str = "url", payload: str = "html",
          least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` to archives in ``folder``; their manifest."""
    def archive(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        writer = ArchiveWriter(folder, f"part-{task.partitionId():05d}-{task.taskAttemptId()}", date)
        try:
            for batch in batches:
                columns = {c: batch.column(c) for c in batch.schema.names}
                for i in range(batch.num_rows):
                    writer.add({c: x[i].as_py() for c, x in columns.items()})
        finally:
            writer.close()
        yield pa.RecordBatch.from_pylist([dict(zip(("archive", "offset", "length", "records"), s)) for s in writer.done],
                                         pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()), ("records", pa.int64())]))

    bound_batches(pages.sparkSession)
    fs, path = _file_system(folder)
    fs.create_dir(path, recursive=True)
    body = F.coalesce(F.col(payload).cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "n_bytes": F.octet_length("payload").cast("long")})
    placed = with_roles(rows, least_bytes).withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")).otherwise(F.lit(b"")))
    return written(chunked(placed, "payload", chunk_bytes).mapInArrow(archive, MANIFEST), "warc-manifest")


class _Stream:
    """The decompressed bytes of a segment, read piece by piece."""

    def __init__(self, file, length: int, chunk_bytes: int):
        self.file, self.left, self.chunk = file, length, chunk_bytes
        self.gzip, self.raw, self.held = zlib.decompressobj(31), b"", bytearray()

    def more(self) -> bool:
        """Decompress up to one chunk; False at the end."""
        while True:
            if self.gzip.eof:
                self.raw, self.gzip = self.gzip.unused_data or self.raw, zlib.decompressobj(31)
            if not self.raw:
                self.raw = self.file.read(min(self.left, self.chunk))
                self.left -= len(self.raw)
                if not self.raw:
                    return False
            made = self.gzip.decompress(self.raw, self.chunk)
            self.raw = b"" if self.gzip.eof else self.gzip.unconsumed_tail
            if made:
                self.held += made
                return True

    def line(self) -> bytes | None:
        """The next line without its end, None at the end."""
        while (end := self.held.find(b"\r\n")) < 0:
            if not self.more():
                return None
        out = bytes(self.held[:end])
        del self.held[:end + 2]
        return out

    def take(self, most: int) -> bytes:
        """Up to ``most`` bytes, none only at the end."""
        if not self.held:
            self.more()
        out = bytes(self.held[:most])
        del self.held[:most]
        return out

    def fields(self) -> dict[str, str]:
        out = {}
        while line := self.line():
            key, _, value = line.decode("utf-8", "replace").partition(":")
            out[key.strip().lower()] = value.strip()
        return out


def _records(stream: _Stream, chunk_bytes: int) -> Iterator[dict]:
    """Chunk rows of the response and revisit records of a stream."""
    while (line := stream.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields = stream.fields()
        left, kind = int(fields["content-length"]), fields["warc-type"]
        declared = 0
        if fields.get("content-type", "").replace(" ", "").lower() == _HTTP_TYPE:
            # the status line and the fields of the HTTP message come before its payload
            while (line := stream.line()):
                left -= len(line) + 2
                key, _, value = line.partition(b":")
                if key.strip().lower() == b"content-length":
                    declared = int(value)
            left -= 2
        named = {"record_id": fields["warc-record-id"].strip("<>"), "record_type": kind, "target_uri": fields.get("warc-target-uri"),
                 "refers_to": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
                 "declared_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None, "declared_bytes": declared}
        so_far, n, chunk_no = hashlib.sha1(), 0, 0
        while True:
            parts, size = [], 0
            while left and size < chunk_bytes:
                piece = stream.take(min(left, chunk_bytes - size))
                if not piece:
                    raise ValueError(f"{named['record_id']} ends too early")
                parts.append(piece)
                left, size = left - len(piece), size + len(piece)
            data = b"".join(parts)
            so_far.update(data)
            n += size
            if kind in ("response", "revisit"):
                yield named | {"chunk_no": chunk_no, "last": not left, "payload_bytes": n, "payload_digest": base32(so_far.copy().digest()), "data": data}
            chunk_no += 1
            if not left:
                break


def read_chunks(spark: SparkSession, manifest: DataFrame, with_data: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """The archives of ``manifest`` as chunk rows: a record's names and declared
    values, chunk_no, whether it is the last, bytes and SHA-1 of the payload up
    to and with this chunk, and its data (null without ``with_data``)."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(CHUNKS))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for segment in batch.to_pylist():
                fs, path = _file_system(segment["archive"])
                with fs.open_input_file(path) as file:
                    file.seek(segment["offset"])
                    for row in _records(_Stream(file, segment["length"], chunk_bytes), chunk_bytes):
                        if not with_data:
                            row["data"] = None
                        rows.append(row)
                        size += len(row["data"] or b"") + 300
                        if len(rows) == BATCH_ROWS or size >= BATCH_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, size = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema)

    n = manifest.count()
    dealt = manifest.select("archive", "offset", "length").repartition(max(1, min(n, 64), -(-n // 16)), "archive", "offset")
    return dealt.mapInArrow(read, CHUNKS)


def records(chunks: DataFrame) -> DataFrame:
    """A row per record, from its last chunk: names, size and digest of the full
    payload (of a revisit, as declared), and whether a response is ``intact``."""
    own = F.col("record_type") == "response"
    return (chunks.where("last")
            .select("record_id", "record_type", "target_uri", "refers_to",
                    F.when(own, F.col("payload_bytes")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
                    F.when(own, F.col("payload_digest")).otherwise(F.col("declared_digest")).alias("payload_digest"),
                    (~own | ((F.col("payload_bytes") == F.col("declared_bytes"))
                             & F.col("payload_digest").eqNullSafe(F.col("declared_digest")))).alias("intact")))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = write(load(spark, sf_dir, "pages"), new_folder(spark, "warc"))
    return (records(read_chunks(spark, manifest, with_data=False))
            .select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                    page_of(F.col("refers_to")).alias("refers_to")))


def _sql() -> str:
    # 20 bits are five hex digits and four base-32 digits
    letter = lambda k, j: f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, {5 * k + 1}, 5) AS BIGINT) >> {15 - 5 * j}) & 31), 1)"
    digest = " || ".join(letter(k, j) for k in range(8) for j in range(4))
    return f"""WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS x, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least
  FROM pages)
SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, {digest} AS payload_digest,
       CASE WHEN page_id IS NOT DISTINCT FROM least THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM least THEN least END AS refers_to
FROM p"""


OP11_SQL = _sql()
