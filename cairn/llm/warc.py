"""WARC archives through a chunked record table.

A payload is cut into chunk rows (record, chunk number, bytes) before it leaves the JVM.
Writer tasks stream the chunks of their records into archive files and reader tasks stream
archive files back into chunk rows, each with the SHA-1 state so far, so neither holds a
whole record. Files go to the shared folder under a name of their own per task attempt, and the
manifest, written by Spark's committer, names the files of the attempts that count: what
a lost executor leaves behind is never read.

Of records with equal payloads of ``REVISIT_BYTES`` or more, the one with the largest id is a
response and the others are revisits that refer to it.

Defined results: a NULL payload is empty; a record with a NULL id is written with the id
"null" and read back as NULL, and is never the one referred to unless no other exists; rows that
repeat with the same id are all responses if that id is the largest; an empty table
gives no archive and an empty result; NULL urls are written as "urn:none"; other columns are
ignored. A payload may hold any bytes: its length, not its content, ends a record.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint_dir, materialize, ship_package

REVISIT_BYTES = 1000
CHUNK_BYTES = 1 << 18
READ_BYTES = 1 << 18
ARCHIVE_BYTES = 1 << 26     # a new archive file begins after so many bytes
END = b"\r\n\r\n"
LEVEL = 5                   # each record is a gzip member of its own


def _open(uri: str):
    """File system and path of a shared folder: local paths, file: and what pyarrow reaches."""
    from pyarrow import fs
    if "://" not in uri and uri.startswith("file:"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


def roles(pages: DataFrame, id_col: str = "page_id", url: str = "url", payload: str = "html",
          least: int = REVISIT_BYTES) -> DataFrame:
    """(page_id, url, payload, payload_bytes, payload_digest, record_type, refers_to). Equal
    payloads are found by SHA-1 and length and proven by SHA-256. Groups are counted before the shuffle;
    only those with two rows or more come back to the payloads."""
    p = pages.select(F.col(id_col).alias("page_id"), F.col(url).cast("string").alias("url"),
                     F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"))
    p = p.select("*", F.length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"),
                 F.sha2("payload", 256).alias("proof"))
    groups = (p.filter(F.col("payload_bytes") >= least).groupBy("payload_bytes", "payload_digest", "proof")
              .agg(F.max("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n"))
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return p.join(groups, ["payload_bytes", "payload_digest", "proof"], "left").select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(again, F.lit("revisit")).otherwise(F.lit("response")).alias("record_type"),
        F.when(again, F.col("first")).alias("refers_to"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK_BYTES) -> DataFrame:
    """One row per chunk; a revisit and an empty payload have one row without bytes."""
    body = F.when(F.col("record_type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    last = F.greatest(F.lit(0), F.ceil(F.length("body") / chunk).cast("int") - 1)
    return (records.withColumn("body", body)
            .select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to",
                    F.length("body").cast("long").alias("body_bytes"), "body",
                    F.explode(F.sequence(F.lit(0), last)).alias("chunk_no"))
            .withColumn("bytes", F.expr(f"substring(body, chunk_no * {chunk} + 1, {chunk})")).drop("body"))


def header(page_id, url, payload_bytes, payload_digest, record_type, refers_to, body_bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: <urn:page:{page_id}>",
             f"WARC-Target-URI: {' '.join((url or 'urn:none').split())}", "WARC-Date: 1970-01-01T00:00:00Z",
             f"WARC-Payload-Digest: sha1:{payload_digest}"]
    if record_type == "revisit":
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/"
                  "revisit/identical-payload-digest", f"X-Payload-Length: {payload_bytes}"]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {body_bytes}"]
    return "\r\n".join(lines).encode() + END


def write(records: DataFrame, folder: str, chunk: int = CHUNK_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write the records of :func:`roles` as archives in ``folder``; returns the manifest
    (archive, n_records, n_bytes), one row per file, itself a table of that folder."""
    ship_package(records.sparkSession)

    def run(batches):
        import zlib

        import pyarrow as pa
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        sink = name = member = None
        size = count = 0

        def put(data: bytes) -> int:
            sink.write(data)
            return len(data)

        def close_record() -> int:
            return put(member.compress(END) + member.flush())

        try:
            for batch in batches:
                columns = [batch.column(c).to_pylist() for c in
                           ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "body_bytes")]
                numbers, data = batch.column("chunk_no").to_pylist(), batch.column("bytes")
                done = []
                for i, k in enumerate(numbers):
                    if k == 0:
                        if sink is not None:
                            size += close_record()
                            if size >= archive_bytes:
                                sink.close()
                                done.append((name, count, size))
                                sink = None
                        if sink is None:
                            name, size, count = f"part-{uuid.uuid4().hex}.warc.gz", 0, 0
                            sink = store.open_output_stream(f"{base}/{name}", compression=None)
                        head = header(*(c[i] if c[i] is not None else None for c in columns)).replace(
                            b"<urn:page:None>", b"<urn:page:null>")
                        member, count = zlib.compressobj(LEVEL, zlib.DEFLATED, 31), count + 1
                        size += put(member.compress(head))
                    value = data[i].as_buffer()
                    if value is not None:
                        size += put(member.compress(value))
                if done:
                    yield _manifest(pa, done)
            if sink is not None:
                size += close_record()
                yield _manifest(pa, [(name, count, size)])
        finally:
            if sink is not None:
                sink.close()

    rows = chunk_rows(records, chunk)
    manifest = rows.mapInArrow(run, "archive string, n_records long, n_bytes long")
    manifest.write.mode("overwrite").parquet(f"{folder}/manifest")
    return records.sparkSession.read.parquet(f"{folder}/manifest")


def _manifest(pa, rows):
    return pa.RecordBatch.from_pydict({"archive": pa.array([r[0] for r in rows], pa.string()),
                                       "n_records": pa.array([r[1] for r in rows], pa.int64()),
                                       "n_bytes": pa.array([r[2] for r in rows], pa.int64())})


def _head(stream) -> dict | None:
    """Header fields of the next record, None at the end of the archive."""
    line = stream.readline()
    if not line:
        return None
    if not line.startswith(b"WARC/"):
        raise ValueError(f"no record begins here: {line[:40]!r}")
    out = {}
    while (line := stream.readline().rstrip(b"\r\n")):
        name, _, value = line.decode().partition(":")
        out[name.lower()] = value.strip()
    return out


def chunks_of(stream, read_bytes: int = READ_BYTES):
    """(fields, chunk number, bytes, SHA-1 so far, bytes so far, is last) of every chunk."""
    while (fields := _head(stream)) is not None:
        left, number, seen, digest = int(fields["content-length"]), 0, 0, hashlib.sha1()
        while True:
            data = stream.read(min(left, read_bytes))
            if left and not data:
                raise ValueError("the archive ends inside a record")
            left, seen = left - len(data), seen + len(data)
            digest.update(data)
            yield fields, number, data, digest.hexdigest(), seen, left == 0
            if not left:
                break
            number += 1
        if stream.read(len(END)) != END:
            raise ValueError("a record does not end where its length says")


def _number(urn: str | None):
    raw = None if urn is None else urn.strip("<>").rpartition(":")[2]
    return None if raw in (None, "null") else int(raw)


def read(spark: SparkSession, folder: str, with_bytes: bool = True, read_bytes: int = READ_BYTES) -> DataFrame:
    """The chunk table of the archives in ``folder``: page_id, url, record_type, refers_to,
    declared_digest, declared_bytes (of revisits), chunk_no, digest (SHA-1 of the record's
    bytes so far), bytes_so_far, is_last and, unless ``with_bytes`` is off, the bytes."""
    ship_package(spark)
    schema = ("page_id long, url string, record_type string, refers_to long, declared_digest string, "
              "declared_bytes long, chunk_no int, digest string, bytes_so_far long, is_last boolean"
              + ", bytes binary" * with_bytes)

    def run(batches):
        import gzip
        import io

        import pyarrow as pa
        store, base = _open(folder)
        types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.string(),
                 pa.int64(), pa.bool_()] + [pa.binary()] * with_bytes
        names = [x.split()[0] for x in schema.split(", ")]

        def out(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

        for batch in batches:
            for name in batch.column("archive").to_pylist():
                with store.open_input_stream(f"{base}/{name}", compression=None) as raw:
                    rows, held = [], 0
                    for f, k, data, digest, seen, last in chunks_of(io.BufferedReader(gzip.GzipFile(fileobj=raw)), read_bytes):
                        declared = f.get("x-payload-length")
                        url = f.get("warc-target-uri")
                        rows.append((_number(f["warc-record-id"]), None if url == "urn:none" else url, f["warc-type"],
                                     _number(f.get("warc-refers-to")), f["warc-payload-digest"].rpartition(":")[2],
                                     None if declared is None else int(declared), k, digest, seen, last)
                                    + (data,) * with_bytes)
                        held += 200 + len(data) * with_bytes
                        if held > 8 << 20:
                            yield out(rows)
                            rows, held = [], 0
                    if rows:
                        yield out(rows)

    archives = spark.read.parquet(f"{folder}/manifest").select("archive")
    n = max(1, archives.count())
    return archives.repartition(n, "archive").mapInArrow(run, schema)


def records_of(table: DataFrame) -> DataFrame:
    """One row per record from its last chunk: a response's length and digest are those of the
    bytes that were read, and must be the declared ones; a revisit states both."""
    own = F.col("record_type") == "response"
    digest = F.when(~own, F.col("declared_digest")).when(F.col("digest") == F.col("declared_digest"), F.col("digest"))
    return table.filter("is_last").select(
        "page_id", F.when(own, F.col("bytes_so_far")).otherwise(F.col("declared_bytes")).alias("payload_bytes"),
        F.coalesce(digest, F.raise_error(F.lit("a payload's digest is not the declared one")).cast("string"))
        .alias("payload_digest"), "record_type", "refers_to")


def payloads(table: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, chunk_no, bytes) of all records: a revisit's chunks are those of the response it
    refers to."""
    own = table.filter("record_type = 'response'").select("page_id", "chunk_no", "bytes")
    again = table.filter("record_type = 'revisit'").select(F.col("page_id").alias("id"), "refers_to")
    other = again.join(own, again["refers_to"] == own["page_id"]).select(F.col("id").alias("page_id"), "chunk_no", "bytes")
    return own.unionByName(other)


# ---- registered query and its SQL --------------------------------------------------

def op2_warc(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write(roles(pages), folder)
    return materialize(records_of(read(spark, folder, with_bytes=False)), "warc-records")


OP2_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h, octet_length(encode(coalesce(html, '')))::BIGINT AS n FROM pages),
g AS (SELECT *, CASE WHEN n >= {REVISIT_BYTES} THEN max(page_id) OVER (PARTITION BY h) ELSE page_id END AS m FROM p)
SELECT page_id, n AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN m <> page_id THEN m END AS refers_to FROM g"""
