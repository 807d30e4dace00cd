"""WARC archives: written by tasks, one gzip member a record, and read back by ranges of bytes."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import _delete, discard, shared_dir, store, table

#: A file is closed and a new one begun once it has so many bytes; a range of so many is read by one task.
FILE_BYTES, RANGE_BYTES = 512 << 20, 16 << 20
#: Bytes that are read from a file, and decompressed, at once.
PIECE = 1 << 20
#: A record's own header, or the HTTP header in it, is shorter than this.
HEADER = 1 << 16
#: Groups of equal payloads that are sent to every task: at most 2**17 rows of below 100 bytes. If there are more, pages move to them.
GROUPS = 1 << 17
MAGIC = b"\x1f\x8b\x08"
DATE = "1970-01-01T00:00:00Z"
FILES = "path string, bytes long, records long"
RECORD = "path string, offset long, next_offset long, record_type string, record_id string, target_uri string, date string, row_id string, refers_to string, refers_to_row string, payload_digest string, payload_bytes long, problem string"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def _urn(*parts: object) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5('|'.join(map(str, parts)).encode()).digest())}>"


def member(header: list[tuple[str, str | None]], block: list[bytes], level: int = 6) -> bytes:
    """A record as a gzip member of its own; headers without a value are left out, what would end a header line is escaped."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    length = sum(map(len, block))
    clean = lambda v: re.sub(r"[\x00-\x20\x7f]", lambda c: f"%{ord(c[0]):02X}", v)
    lines = [f"{k}: {clean(v) if k == 'WARC-Target-URI' else v}" for k, v in header if v is not None]
    head = "\r\n".join(["WARC/1.1", *lines, f"Content-Length: {length}", "", ""]).encode()
    return b"".join([z.compress(head), *(z.compress(b) for b in block), z.compress(b"\r\n\r\n"), z.flush()])


def decisions(pages: DataFrame, id_col: str, min_bytes: int) -> DataFrame:
    """(digest, to, twins): of each payload of at least ``min_bytes`` that several rows have, the largest id, and how many rows have that id."""
    slim = pages.where(F.octet_length("payload") >= min_bytes).groupBy("digest", F.col(id_col).alias("to")).agg(F.count(F.lit(1)).alias("n"))
    # a null id is smaller than any
    most = F.max(F.struct(F.col("to").isNotNull().alias("known"), "to", F.col("n").alias("twins")))
    return slim.groupBy("digest").agg(most.alias("most"), F.sum("n").alias("n")).where("n > 1").select("digest", "most.to", "most.twins")


def record_rows(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, groups: int = GROUPS) -> DataFrame:
    """Pages with what is to be written of them: (id, url, payload, digest, length, to, response, grouped: others have this payload
    too). Revisits have no payload."""
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))
    found = store(decisions(rows, "id", min_bytes), "groups")
    out = rows.join(F.broadcast(found) if found.count() <= groups else found, "digest", "left")
    alone, first = F.col("twins").isNull(), F.col("id").eqNullSafe(F.col("to"))
    kept = lambda c: F.when(c, F.col("payload"))
    fields = lambda response: ("id", "url", kept(response).alias("payload"), "digest", F.octet_length("payload").cast("long").alias("length"), "to", response.alias("response"), F.col("twins").isNotNull().alias("grouped"))
    single = out.where(alone | ~first | (F.col("twins") == 1)).select(*fields(alone | first))
    if found.where("twins > 1").isEmpty():
        return single
    # rows of one id and payload: told apart by their number only, so they are counted for each url, and one becomes the response
    twins = out.where(F.col("twins").isNotNull() & first & (F.col("twins") > 1)).groupBy("digest", "id", "url", "to", "twins").agg(F.first("payload").alias("payload"), F.count(F.lit(1)).alias("n"))
    twins = twins.withColumn("best", F.row_number().over(W.partitionBy("digest", "id").orderBy(F.col("url").desc_nulls_last())) == 1)
    twins = twins.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))))
    return single.unionByName(twins.select(*fields(F.col("best") & (F.col("k") == 1))))


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, date: str = DATE, file_bytes: int = FILE_BYTES, groups: int = GROUPS) -> DataFrame:
    """Write a record for each page to files in ``folder`` (a URI that pyarrow's file systems reach) -> stored table of the files: path, bytes, records.

    The payload is the html in UTF-8, null being empty. Of records with equal payloads of at least ``min_bytes`` bytes the one with the largest
    id is a response and the others are revisits of it; all other records are responses. Of equal ids with equal payloads one row is the
    response and the others revisit it; a null id is smaller than any. A null url has no Target-URI. A file's name holds the attempt that wrote
    it, and only the files of tasks that were committed are in the table: what a lost task has left is never read. No pages give no files.
    Other columns, whatever their names, are not read.
    """
    rows = record_rows(pages, id_col, url_col, html_col, min_bytes, groups)

    def http(length: int) -> bytes:
        return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, top = pyarrow.fs.FileSystem.from_uri(folder)
        path, out, records, number = "", None, 0, 0

        def closed() -> pa.RecordBatch:
            size = out.tell()
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64()), pa.array([records], pa.int64())], names=["path", "bytes", "records"])

        for b in batches:
            for r in b.to_pylist():
                if out is None:
                    name = f"part-{task.partitionId():06d}-{number:04d}-{uuid.uuid4().hex}.warc.gz"
                    path, number, records = f"{folder}/{name}", number + 1, 0
                    fs.create_dir(top, recursive=True)
                    out = fs.open_output_stream(f"{top}/{name}", compression=None)  # by its name it would be compressed once more
                    info = b"software: factloom\r\nformat: WARC File Format 1.1\r\n"
                    out.write(member([("WARC-Type", "warcinfo"), ("WARC-Record-ID", _urn(path)), ("WARC-Date", date), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], [info]))
                key, known = base32(r["digest"]), r["id"] is not None
                kind = "response" if r["response"] else "revisit"
                named = _urn(r["id"], key) if r["response"] and r["grouped"] else _urn(r["id"], key, path, records)  # by the first, revisits name it
                header = [("WARC-Type", kind), ("WARC-Record-ID", named), ("WARC-Date", date), ("WARC-Target-URI", r["url"]), ("WARC-Payload-Digest", f"sha1:{key}"), ("X-Row-ID", str(r["id"]) if known else None)]
                if not r["response"]:
                    header += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _urn(r["to"], key)), ("X-Refers-To-Row-ID", None if r["to"] is None else str(r["to"]))]
                header.append(("Content-Type", "application/http;msgtype=response"))
                out.write(member(header, [http(r["length"]), *([r["payload"]] if r["response"] else [])]))
                records += 1
                if out.tell() >= file_bytes:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return store(rows.mapInArrow(write, FILES), "archives")


def archives_in(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the .warc.gz files in a folder, listed by Spark."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").option("recursiveFileLookup", "true").load(folder).select("path", F.col("length").alias("bytes"))


class _Bytes:
    """A file's bytes from any place on, a block of PIECE bytes at a time."""

    def __init__(self, file, size: int):
        self.file, self.size, self.base, self.block = file, size, 0, b""

    def at(self, pos: int) -> memoryview:
        if not self.base <= pos < self.base + len(self.block) - 2 and pos < self.size and not (self.base <= pos and self.base + len(self.block) >= self.size):
            self.file.seek(pos)
            self.base, self.block = pos, self.file.read(min(PIECE, self.size - pos))
        return memoryview(self.block)[pos - self.base :]

    def find(self, what: bytes, start: int, stop: int) -> int:
        """The first place from start on, but before stop, at which ``what`` begins; -1 if there is none."""
        while start < stop:
            self.at(start)
            found = self.block.find(what, start - self.base)
            if found >= 0:
                return self.base + found if self.base + found < stop else -1
            end = self.base + len(self.block)
            if end >= self.size or end < start + len(what):  # the end, or a file shorter than it was said to be
                return -1
            start = end - len(what) + 1
        return -1


def _inflated(source: _Bytes, offset: int, ended: list[int]) -> Iterator[bytes]:
    """The content of the gzip member at ``offset``, piece by piece; its end goes to ``ended`` if it has one. Bytes that are none raise zlib.error."""
    z, pos, limit = zlib.decompressobj(31), offset, 512  # little at first: a header in front of damage is still read
    while not z.eof:
        part = z.unconsumed_tail
        if not part:
            part = source.at(pos) if pos < source.size else b""
            if not len(part):
                return
            pos += len(part)
        yield z.decompress(part, limit)
        limit = min(limit * 4, PIECE)
    ended.append(pos - len(z.unused_data))


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if v}


def _split(pieces: Iterator[bytes], held: bytes = b"") -> tuple[bytes | None, bytes]:
    """Read to the blank line that ends a header -> header (None without one), what is read beyond it."""
    while b"\r\n\r\n" not in held[: HEADER + 4]:
        if len(held) > HEADER or (piece := next(pieces, None)) is None:
            return None, held
        held += piece
    head, _, rest = held.partition(b"\r\n\r\n")
    return head, rest


def read_member(source: _Bytes, offset: int, keep: bool = False) -> tuple | None:
    """The record whose gzip member begins at ``offset`` (RECORD without the path, with the payload), or None where none begins: it has to
    decompress to a header that says WARC/1. Memory does not grow with the record unless its payload is kept."""
    ended: list[int] = []
    pieces = _inflated(source, offset, ended)
    try:
        start = next(pieces, b"")
        while len(start) < 7:
            piece = next(pieces, None)
            if piece is None:
                return None
            start += piece
        if not start.startswith(b"WARC/1."):
            return None
        head, rest = _split(pieces, start)
    except zlib.error:
        return None
    if head is None:
        return None
    said = _fields(head)
    kind, problem, digest, size, body = said.get("warc-type"), None, hashlib.sha1(), 0, []
    try:
        left = int(said.get("content-length", ""))
    except ValueError:
        return None
    http = {}
    try:
        if kind in ("response", "revisit", "request") and said.get("content-type", "").startswith("application/http"):
            inner, after = _split(pieces, rest)
            if inner is not None:
                http, left, rest = _fields(inner), left - len(inner) - 4, after
        while left > 0:
            part = rest[:left]
            digest.update(part)
            size, left = size + len(part), left - len(part)
            if keep:
                body.append(part)
            rest = next(pieces, None) if left > 0 else b""
            if rest is None:
                problem = "truncated"
                break
        for _ in pieces:
            pass
        if not ended:
            problem = "truncated"
    except zlib.error:
        problem = "corrupt"
    declared = said.get("warc-payload-digest", "").rpartition(":")[2].upper() or None
    found = base32(digest.digest())
    if kind == "revisit":
        found, size = declared, int(http["content-length"]) if http.get("content-length", "").isdigit() else None
    elif problem is None and declared not in (None, found):
        problem = "digest"
    return (
        offset, ended[0] if ended else offset + 1, kind, said.get("warc-record-id"), said.get("warc-target-uri"), said.get("warc-date"), said.get("x-row-id"),
        said.get("warc-refers-to"), said.get("x-refers-to-row-id"), found, size, problem, b"".join(body) if keep else None,
    )


def scan_warc(files: DataFrame, payloads: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """files (path, bytes) -> a row for each record (RECORD, and ``payload`` if asked for).

    A task gets a range of a file. It looks for gzip's magic bytes, takes a place as the start of a record only if a WARC header decompresses
    from it, and goes on behind that record; records that start in its range are its own, wherever they end. A record that is cut off, damaged
    or whose payload does not match its digest has a ``problem``, and the search goes on right behind its start. A WARC record inside the
    payload of another one can be found where a range begins in between: outermost() takes such rows out. No files give no rows.
    """
    spark = files.sparkSession
    some = files.where("bytes > 0").select("path", "bytes")
    total = some.agg(F.sum("bytes"), F.sum(F.ceil(F.col("bytes") / range_bytes))).first()
    tasks = max(1, min(int(total[1] or 0), max(spark.sparkContext.defaultParallelism, int(total[0] or 0) // range_bytes + 1)))
    ranges = some.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(x.split()[1], pa.string()) for x in schema.split(", ")]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for b in batches:
            for r in b.to_pylist():
                fs, path = pyarrow.fs.FileSystem.from_uri(r["path"])
                with fs.open_input_file(path) as file:
                    source, at, stop = _Bytes(file, r["bytes"]), r["start"], min(r["start"] + range_bytes, r["bytes"])
                    rows, weight = [], 0
                    while (at := source.find(MAGIC, at, stop)) >= 0:
                        found = read_member(source, at, payloads)
                        if found is None:
                            at += 1
                            continue
                        rows.append((r["path"], *(found if payloads else found[:-1])))
                        at, weight = found[1], weight + 1000 + len(found[-1] or b"")
                        if weight > 4 * PIECE:
                            yield batch(rows)
                            rows, weight = [], 0
                    if rows:
                        yield batch(rows)

    return ranges.repartition(tasks).mapInArrow(run, schema)


def outermost(records: DataFrame) -> DataFrame:
    """Rows of scan_warc() that start behind the ends of all records before them in their file; a file's rows meet in one task."""
    before = F.max("next_offset").over(W.partitionBy("path").orderBy("offset").rowsBetween(W.unboundedPreceding, -1))
    return records.withColumn("_end", before).where("_end is null or offset >= _end").drop("_end")


def _number(c: str) -> Column:
    return F.expr(f"try_cast({c} as long)")


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    files = write_warc(table(spark, sf_dir, "pages"), folder)
    rows = outermost(scan_warc(files)).where("record_type in ('response', 'revisit')")
    read = store(rows.select(_number("row_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", _number("refers_to_row").alias("refers_to"), "problem"), "records")
    discard(files)
    _delete(spark, folder)
    return read


OP12_SQL = r"""
WITH p AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k, first_value(page_id) OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS top FROM pages
), d AS (
  SELECT *, list_transform(range(40), lambda i: strpos('0123456789abcdef', substr(hex, i + 1, 1)) - 1) AS x FROM p
)
SELECT page_id, payload_bytes,
  list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((((x[(i * 5) // 4 + 1] * 16 + x[(i * 5) // 4 + 2]) >> (3 - (i * 5) % 4)) & 31) + 1)::BIGINT, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN top END AS refers_to, NULL::VARCHAR AS problem
FROM d
"""
