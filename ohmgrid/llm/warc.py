"""WARC archives written and read by Spark, with copies resolved into revisits.

A record is a column: its headers, a block and, from the line separator of Spark's
text writer, the two line ends that close a record.  So archives are written by
Spark's own committer, as gzip files of the shared store.  They are read file by
file and parsed by ``Content-Length``, whatever the payloads hold.

Resolution takes headers only: they are shuffled by payload digest, each digest's
original is found by an aggregate, and copies are joined to it.  The records are then
written once more, originals whole and copies as revisits, with fresh headers.
"""

from __future__ import annotations

import base64
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.functions.storage import new_folder, small_side
from ohmgrid.llm.common import durable

# Format words.
VERSION, END_OF_LINE, END_OF_RECORD = "WARC/1.1", "\r\n", "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
HTTP_TYPE = "application/http; msgtype=response"
BASE32, DIGITS32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEFGHIJKLMNOPQRSTUV"
#: Payload bytes of a file, about: a reader holds one packed file at a time.
FILE_BYTES = 64 << 20
#: Bytes of records that a reader hands on at once, and of a file that are unpacked at once.
BATCH_BYTES, UNPACKED = 8 << 20, 1 << 20

HEADERS = "record_id string, record_type string, target_uri string, date string, key string, payload_digest string, payload_bytes long, refers_to_id string"
NAMES = [c.split()[0] for c in HEADERS.split(", ")]


def sha1_base32(body: Column) -> Column:
    """SHA-1 as upper-case base32; ten hex digits are eight characters."""
    hexed = F.sha1(body)
    parts = [F.lpad(F.conv(F.substring(hexed, 1 + 10 * k, 10), 16, 32), 8, "0") for k in range(4)]
    return F.translate(F.concat(*parts), DIGITS32, BASE32)


def _line(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; characters that end lines are percent-encoded."""
    safe = F.replace(F.replace(value, F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(END_OF_LINE)), F.lit(""))


def record(kind: Column, record_id: Column, uri: Column, date: Column, key: Column, digest: Column, payload: Column, refers: dict[str, Column] | None = None) -> Column:
    """A record as text, without the line ends that close it: a response with its payload, or a revisit without."""
    size = F.octet_length(payload).cast("string")
    http = F.concat(F.lit(HTTP), size, F.lit(END_OF_RECORD))
    block = F.when(kind == "response", F.concat(http, payload)).otherwise(F.lit(""))
    lines = {"WARC-Type": kind, "WARC-Record-ID": record_id, "WARC-Date": date, "WARC-Target-URI": uri, "WARC-Payload-Digest": F.concat(F.lit("sha1:"), digest), "X-Record-Key": key}
    lines |= {name: F.when(kind == "revisit", value) for name, value in ({"WARC-Profile": F.lit(PROFILE)} | (refers or {})).items()}
    lines |= {"Content-Type": F.when(kind == "response", HTTP_TYPE), "Content-Length": F.octet_length(block).cast("string")}
    return F.concat(F.lit(VERSION + END_OF_LINE), *[_line(n, v) for n, v in lines.items()], F.lit(END_OF_LINE), block)


def write_records(records: DataFrame, path: str, size: Column | None = None) -> None:
    """Writes a column of records as ``.txt.gz`` archives at ``path``; ``size`` (bytes of a row) bounds the records of a file by their mean."""
    most = 0
    if size is not None:
        total = records.agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("bytes")).first()
        most = max(1, FILE_BYTES * total["n"] // max(total["bytes"] or 0, 1))
    out = records.select("record").write.option("lineSep", END_OF_RECORD).option("compression", "gzip").option("maxRecordsPerFile", most)
    out.text(path)


def write_pages(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", body: str = "html", date: str | None = None) -> None:
    """A response for each page: payload the body in UTF-8, null as empty; ids are random, as a record's id has to be."""
    payload = F.coalesce(F.col(f"`{body}`").cast("string"), F.lit(""))
    when = F.lit(date) if date else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    ident = F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">"))
    made = record(F.lit("response"), ident, F.col(f"`{url}`").cast("string"), when, F.col(f"`{key}`").cast("string"), sha1_base32(payload), payload)
    write_records(pages.select(made.alias("record"), F.octet_length(payload).alias("size")), path, F.col("size"))


class _Unpacked(io.RawIOBase):
    """A packed or plain archive as a stream of its bytes; members of a gzip file follow each other."""

    def __init__(self, raw: memoryview):
        self.raw, self.at, self.left = raw, 0, b""
        self.packed = bytes(raw[:2]) == b"\x1f\x8b"
        self.inflate = zlib.decompressobj(31)

    def readable(self) -> bool:
        return True

    def readinto(self, into) -> int:
        while not self.left and self.at < len(self.raw):
            part = bytes(self.raw[self.at : self.at + UNPACKED])
            if self.packed:
                self.left = self.inflate.decompress(part, UNPACKED)
                self.at += len(part) - len(self.inflate.unconsumed_tail) - len(self.inflate.unused_data)
                if self.inflate.eof:
                    self.inflate = zlib.decompressobj(31)
            else:
                self.left, self.at = part, self.at + len(part)
        if not self.left and self.packed:
            self.left = self.inflate.flush()
        n = min(len(into), len(self.left))
        into[:n], self.left = self.left[:n], self.left[n:]
        return n


def parse(raw: memoryview, path: str = "") -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record; a file that ends early or is none is an error."""
    stream = io.BufferedReader(_Unpacked(raw), UNPACKED)
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"{path}: no record where one should begin")
        headers: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        size = int(headers.get("content-length", "-1"))
        block = stream.read(size) if size >= 0 else b""
        if size < 0 or len(block) != size:
            raise ValueError(f"{path}: a record is cut off")
        yield headers, block


def payload_of(headers: dict[str, str], block: bytes) -> bytes:
    """The block without the response's own headers."""
    if headers.get("content-type", "").startswith("application/http"):
        return block.partition(b"\r\n\r\n")[2]
    return block


def read_archives(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The response and revisit records of all archives at ``path``: headers, file, and the ``payload`` if asked for.

    A response whose payload has another SHA-1 than its header says is an error.  ``payload_bytes`` of a
    revisit is null, as its record does not have it.  A task holds one packed file and unpacks it in
    parts, so a file may hold any number of records; a record is held whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1), strict=True):
                rows, held = [], 0
                for headers, block in parse(memoryview(content.as_buffer()), name.as_py()):
                    kind = headers.get("warc-type")
                    if kind not in ("response", "revisit"):
                        continue
                    body = payload_of(headers, block) if kind == "response" else None
                    digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    if body is not None:
                        own = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if digest not in (None, own):
                            raise ValueError(f"{name}: {headers.get('warc-record-id')} is not what its digest says")
                        digest = own
                    row = [headers.get(f"warc-{c}") for c in ("record-id", "type", "target-uri", "date")]
                    row += [headers.get("x-record-key"), digest, len(body) if body is not None else None, headers.get("warc-refers-to"), name.as_py()]
                    rows.append([*row, body] if payload else row)
                    held += len(body or b"") if payload else 500
                    if held >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], schema=shape)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(shape.names, r, strict=True)) for r in rows], schema=shape)

    shape = pa.schema([(n, pa.int64() if n == "payload_bytes" else pa.string()) for n in [*NAMES, "file"]] + ([("payload", pa.binary())] if payload else []))
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("path", "content")
    return files.mapInArrow(run, f"{HEADERS}, file string" + (", payload binary" if payload else ""))


def resolve(headers: DataFrame, least_bytes: int = 0, key_type: str = "long") -> DataFrame:
    """``headers`` with ``kind`` (response or revisit), ``original`` (record_id, target_uri, date, key) and ``payload_bytes`` filled.

    Of responses with equal payloads of ``least_bytes`` or more the one with the largest key, read as
    ``key_type``, is the original (null keys are the smallest, ties go to the larger record id) and the others revisit it.  Records that
    were revisits before follow the original of their digest, or stay as they are if it is not there.  Smaller ones
    stay responses.  Digests that fill a thousandth of the records are fewer than a thousand and meet
    their originals by broadcast; all others by an exchange of headers.
    """
    headers = durable(headers.select(*NAMES))
    n = headers.count()
    able = headers.where((F.col("record_type") == "response") & (F.col("payload_bytes") >= least_bytes))
    best = F.max(F.struct(F.col("key").cast(key_type).alias("k"), "record_id", "target_uri", "date", "key", "payload_bytes"))
    met = headers.groupBy("payload_digest").agg(F.count(F.lit(1)).alias("n"))
    originals = able.groupBy("payload_digest").agg(best.alias("original")).join(met, "payload_digest").where("n > 1")
    originals = durable(originals.select(F.col("payload_digest").alias("of"), "original", "n"))
    heavy = F.broadcast(originals.where(F.col("n") * 1000 > n).drop("n"))
    light = originals.where(F.col("n") * 1000 <= n).drop("n")
    same = F.col("payload_digest") == F.col("of")
    common = headers.join(heavy, same)
    rest = headers.join(heavy, same, "left_anti").join(light, same, "left")
    both = common.unionByName(rest).drop("of")
    large = F.coalesce(F.col("payload_bytes"), F.col("original.payload_bytes")) >= least_bytes
    copy = F.col("original").isNotNull() & large & (F.col("original.record_id") != F.col("record_id"))
    kind = F.when((F.col("record_type") == "revisit") | F.coalesce(copy, F.lit(False)), "revisit").otherwise("response")
    own = F.when(F.coalesce(copy, F.lit(False)), F.struct(*[F.col(f"original.{c}").alias(c) for c in ("record_id", "target_uri", "date", "key")]))
    return both.withColumns({"kind": kind, "payload_bytes": F.coalesce("payload_bytes", "original.payload_bytes"), "original": own})


def deduplicate(spark: SparkSession, path: str, out: str, least_bytes: int = 0, key_type: str = "long") -> None:
    """Reads the archives at ``path`` and writes them to ``out`` with copies as revisits and fresh headers.

    The payloads stay where they were read: what is joined to them is a row for each revisit, sent to all if counting proves
    it small and exchanged by record id otherwise.  Headers of an empty archive give an empty one.
    """
    resolved = resolve(read_archives(spark, path), least_bytes, key_type)
    copies = resolved.where((F.col("kind") == "revisit") & F.col("original").isNotNull()).select(F.col("record_id").alias("of"), "original")
    records = read_archives(spark, path, payload=True).join(small_side(durable(copies)), F.col("record_id") == F.col("of"), "left")
    kind = F.when(F.col("original").isNotNull(), "revisit").otherwise(F.col("record_type"))
    refers = {"WARC-Refers-To": F.coalesce("original.record_id", "refers_to_id"), "WARC-Refers-To-Target-URI": F.col("original.target_uri"), "WARC-Refers-To-Date": F.col("original.date")}
    body = F.coalesce(F.col("payload").cast("string"), F.lit(""))
    made = record(kind, F.col("record_id"), F.col("target_uri"), F.col("date"), F.col("key"), F.col("payload_digest"), body, refers)
    write_records(records.select(made.alias("record")), out)


def resolved_archive(spark: SparkSession, path: str, key_type: str = "long") -> DataFrame:
    """The records of a deduplicated archive, revisits joined to the responses that they name.

    (key, payload_bytes, payload_digest, record_type, refers_to), one row a record; the sizes of revisits are those of their originals.
    """
    found = resolve(read_archives(spark, path), 0, key_type)
    as_key = F.col("original.key").cast(key_type)
    return found.select(F.col("key").cast(key_type).alias("key"), "payload_bytes", "payload_digest", F.col("record_type"), F.when(F.col("record_type") == "revisit", as_key).alias("refers_to"))


def archive_pages(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", body: str = "html", least_bytes: int = 0, date: str | None = None) -> DataFrame:
    """Writes ``pages`` to ``folder``/crawl, deduplicates them into ``folder``/archive and returns what reading that gives.

    Null and empty bodies are empty payloads, which are equal like any others; null urls have no
    target; null and repeated keys and wholly equal rows are records of their own.  Bodies of any length are written whole.
    An empty table gives no rows.  Other columns, whatever their names, are ignored.
    """
    spark = pages.sparkSession
    key_type = pages.select(f"`{key}`").schema[0].dataType.simpleString()
    write_pages(pages, f"{folder}/crawl", key, url, body, date)
    deduplicate(spark, f"{folder}/crawl", f"{folder}/archive", least_bytes, key_type)
    return resolved_archive(spark, f"{folder}/archive", key_type).withColumnRenamed("key", key)


def op12_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages through an archive in the shared folder, copies as revisits of the page with the largest id."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return archive_pages(pages, new_folder(spark, "warc"))


ORACLE_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages
), d AS (
  SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, body, sha1(body) AS h FROM p
), b AS (
  SELECT page_id, payload_bytes, body, array_to_string(flatten([[
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[CAST((CAST('0x' || h[10 * g + 1:10 * g + 10] AS BIGINT) >> CAST(35 - 5 * k AS INTEGER)) & 31 AS INTEGER) + 1]
    FOR k IN range(8)] FOR g IN range(4)]), '') AS payload_digest FROM d
), o AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS original FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> original THEN original END AS refers_to FROM o
"""
