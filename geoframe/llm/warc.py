"""WARC archives, index first.

Writing gives one row per record with the archive's path, the record's offset and length
in it, the URL and the payload digest. Reading takes index rows, sorts them by place, joins
neighbouring byte ranges, fetches each joined range with one read, and cuts the records out.
Every record is a gzip member of its own, as WARC readers expect.

Of records with equal payloads of at least `least` bytes the one with the largest id is a
`response`; the others are `revisit` records, which hold no payload but name it.
Archives lie in the shared folder under names that a retried task never reuses: the index
has the names of the attempt that counted.

Edge cases: null html is an empty payload; a null id is written as an empty header, never
revisits and is never revisited; repeated rows with the largest id are all responses; an
empty table makes no archive and gives no rows.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoframe.llm import common

INDEX = "page_id long, path string, offset long, length long, url string, digest string, kind string"
RECORDS = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _member(raw: bytes) -> bytes:
    gz = zlib.compressobj(4, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


def _line(value) -> str:
    return str("" if value is None else value).replace("\r", "%0D").replace("\n", "%0A")


def record(kind: str, page_id, url, digest: str, size: int, payload: bytes = b"", refers_to=None) -> bytes:
    """A WARC/1.1 record, compressed. size: of the full payload, which a revisit doesn't carry."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>",
            f"WARC-Target-URI: {_line(url)}", f"X-Page-ID: {_line(page_id)}", f"X-Payload-Length: {size}", f"WARC-Payload-Digest: sha1:{digest}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    body = http + payload
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}"]
    return _member("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n")


def parse(member: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to, payload) of a compressed record.

    A response's size and digest are taken from its payload, and must agree with its headers."""
    head, _, rest = zlib.decompress(member, 31).partition(b"\r\n\r\n")
    field = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    payload = rest[:int(field["Content-Length"])].partition(b"\r\n\r\n")[2]
    page = int(field["X-Page-ID"]) if field["X-Page-ID"] else None
    kind, size, digest = field["WARC-Type"], int(field["X-Payload-Length"]), field["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "revisit":
        return page, size, digest, kind, int(field["WARC-Refers-To"][len("<urn:page:"):-1]), b""
    found = hashlib.sha1(payload).hexdigest()
    if (len(payload), found) != (size, digest):
        raise ValueError(f"the record of page {page} is damaged")
    return page, size, found, kind, None, payload


def write(pages: DataFrame, folder: str, least: int = 1000, most: int = 64 << 20) -> DataFrame:
    """Write a record per row of pages (page_id, url, html); the index, as a written table.

    Records are compressed where the pages are read, so that what is shuffled to find equal
    payloads is about as large as the archives."""
    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    source = source.select("page_id", "url", F.sha1(F.col("html").cast("binary")).alias("digest"), F.octet_length("html").cast("long").alias("size"), "html")

    big = source.where((F.col("size") >= least) & F.col("page_id").isNotNull())
    groups = big.groupBy("digest").agg(F.max("page_id").alias("last"), F.count("*").alias("copies")).where("copies > 1")
    groups = common.written(groups, "copies")

    def compress(batches):
        for b in batches:
            page, url, digest, size, html = (b.column(c).to_pylist() for c in ("page_id", "url", "digest", "size", "html"))
            made = [record("response", *x[:4], x[4].encode("utf-8", "replace")) for x in zip(page, url, digest, size, html)]
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(made, pa.binary())], names=["page_id", "url", "digest", "size", "record"])

    made = source.mapInArrow(compress, "page_id long, url string, digest string, size long, record binary")
    # small payloads and rows without an id stand for themselves: their key matches nothing
    made = made.withColumn("key", F.when((F.col("size") >= least) & F.col("page_id").isNotNull(), F.col("digest")))
    known = common.with_lookup(made, groups.withColumnRenamed("digest", "key"), ["key"], "copies", F.col("page_id"))
    revisit = F.col("last").isNotNull() & (F.col("last") != F.col("page_id"))
    rows = known.select("page_id", "url", "digest", "size", F.when(revisit, F.col("last")).alias("refers_to"), F.when(~revisit | F.col("last").isNull(), F.col("record")).alias("record"))

    def archive(batches):
        from pyarrow import fs

        system, root = fs.FileSystem.from_uri(folder)
        system.create_dir(root, recursive=True)
        out, path, at = None, "", 0
        try:
            for b in batches:
                index = []
                for page, url, digest, size, refers, raw in zip(*(b.column(c).to_pylist() for c in b.schema.names)):
                    kind = "response" if raw is not None else "revisit"
                    raw = raw if raw is not None else record("revisit", page, url, digest, size, refers_to=refers)
                    if out is None or at > most:
                        if out is not None:
                            out.close()
                        path, at = f"{root}/{uuid.uuid4().hex}.warc.gz", 0
                        out = system.open_output_stream(path, compression=None)
                    out.write(raw)
                    index.append((page, path, at, len(raw), url, digest, kind))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*index)) or [[]] * 7, [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()])], names=[x.split()[0] for x in INDEX.split(", ")])
        finally:
            if out is not None:
                out.close()

    return common.written(rows.mapInArrow(archive, INDEX), "warc-index")


def joined_ranges(rows: list[tuple[int, int]], gap: int = 64 << 10, most: int = 8 << 20) -> list[tuple[int, int, int, int]]:
    """(first row, row after the last, offset, end) of the reads for sorted (offset, length) rows."""
    reads: list[list[int]] = []
    for k, (offset, length) in enumerate(rows):
        if reads and offset <= reads[-1][3] + gap and offset + length - reads[-1][2] <= most:
            reads[-1][1], reads[-1][3] = k + 1, max(reads[-1][3], offset + length)
        else:
            reads.append([k, k + 1, offset, offset + length])
    return [tuple(x) for x in reads]


def read(index: DataFrame, folder: str, payload: bool = True) -> DataFrame:
    """The records of the index rows, by coalesced byte-range reads in the order of their place."""
    near = index.select("path", "offset", "length").repartitionByRange(common.shuffle_partitions(index.sparkSession), "path", "offset").sortWithinPartitions("path", "offset")
    schema = RECORDS if payload else RECORDS.removesuffix(", payload binary")
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: 6 if payload else 5]

    def fetch(batches):
        from pyarrow import fs

        system, _ = fs.FileSystem.from_uri(folder)
        for b in batches:
            path, offset, length = (b.column(c).to_pylist() for c in ("path", "offset", "length"))
            lo = 0
            while lo < len(path):
                hi = lo
                while hi < len(path) and path[hi] == path[lo]:
                    hi += 1
                with system.open_input_file(path[lo]) as source:
                    for first, last, begin, end in joined_ranges(list(zip(offset[lo:hi], length[lo:hi]))):
                        raw = source.read_at(end - begin, begin)
                        got = [parse(raw[offset[lo + k] - begin:][:length[lo + k]]) for k in range(first, last)]
                        yield pa.RecordBatch.from_arrays([pa.array([g[c] for g in got], t) for c, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])
                lo = hi

    return near.mapInArrow(fetch, schema)


def op7_warc(spark, sf_dir):
    folder = common.fresh_path(spark, "warc")
    index = write(common.table(spark, sf_dir, "pages"), folder)
    return read(index, folder, payload=False)


OP7_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS n, sha1(html) AS g FROM p),
w AS (SELECT g, max(page_id) AS last FROM d WHERE n >= 1000 GROUP BY g)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.g AS payload_digest,
       CASE WHEN w.last <> d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN w.last <> d.page_id THEN w.last END AS refers_to
FROM d LEFT JOIN w ON d.g = w.g AND d.n >= 1000
"""
