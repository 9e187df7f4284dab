"""Secret scan over an incremental ledger of content-addressed blobs.

Every version of every path is addressed by the SHA-256 of its text.  Only the
(blob, rule version) pairs that the ledger does not hold are scanned, each once;
findings are joined back to all paths that carry the blob.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ohmgrid.llm.common import shared_folder

#: Fixed patterns of the base rules, as the contract states them.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
PEM = r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY-----"
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "pem")
RULE_VERSION = 1

_ASSIGN = re.compile(ASSIGN, re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(ACCESS)
_HEX = re.compile(HEX)
_PEM = re.compile(PEM)
_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
_IS_HEX = bytes(1 if c in b"0123456789abcdef" else 0 for c in range(256))
_HEX_RUN = b"\x01" * 24

FINDINGS = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, rank of kind, end) of every span, sorted; offsets count code points.

    The byte tests only skip patterns that cannot match anywhere in the text.
    """
    raw = text.encode("utf-8", "surrogatepass")
    lowered = raw.lower()
    found = []
    if any(w in lowered for w in _WORDS):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 20]
    if _HEX_RUN in raw.translate(_IS_HEX):
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    if b"-----BEGIN " in raw:
        found += [(m.start(), 3, m.end()) for m in _PEM.finditer(text)]
    return sorted(found)


def _first_of_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops blobs that the task has already passed on; the digests of one task are bounded by its input."""
    seen: set[str] = set()
    for batch in batches:
        keep = []
        for digest in batch.column(0).to_pylist():
            keep.append(digest not in seen)
            seen.add(digest)
        yield batch.filter(pa.array(keep))


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen: set[str] = set()
    for batch in batches:
        blobs, findings = [], []
        for digest, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if digest in seen:
                continue
            seen.add(digest)
            blobs.append(digest)
            findings.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in find_secrets(text.as_py())])
        yield pa.RecordBatch.from_arrays([pa.array(blobs, pa.string()), pa.array(findings, pa.list_(FINDINGS))], names=["blob", "findings"])


FINDINGS_TYPE = "array<struct<kind:string,start:bigint,end:bigint>>"
SCAN_SCHEMA = f"blob string, findings {FINDINGS_TYPE}"
LEDGER_SCHEMA = f"blob string, rule_version int, findings {FINDINGS_TYPE}"


def address(versions: DataFrame, text: str) -> DataFrame:
    """Adds ``blob``, the content address; a null text is the empty blob."""
    return versions.withColumn("blob", F.sha2(F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")), 256))


def scan_unseen(versions: DataFrame, text: str = "text", ledger: DataFrame | None = None, rule_version: int = RULE_VERSION) -> DataFrame:
    """New ledger rows (blob, rule_version, findings) for the blobs that ``ledger`` lacks under this rule version.

    Copies are dropped first within each task, so that a blob that fills a third
    of the table reaches the exchange once a task; then each blob meets itself by
    its address and is scanned once.
    """
    blobs = address(versions, text).select("blob", F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("body"))
    blobs = blobs.mapInArrow(_first_of_task, "blob string, body string")
    if ledger is not None:
        known = ledger.where(F.col("rule_version") == rule_version).select("blob").distinct()
        blobs = blobs.join(known, "blob", "left_anti")
    scanned = blobs.repartition("blob").mapInArrow(_scan, SCAN_SCHEMA)
    return scanned.select("blob", F.lit(rule_version).alias("rule_version"), "findings")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger stored at ``path``; an empty one where there is none yet."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return spark.createDataFrame([], LEDGER_SCHEMA)
    return spark.read.schema(LEDGER_SCHEMA).parquet(path)


def update_ledger(versions: DataFrame, path: str, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """Appends what the ledger at ``path`` lacks for ``versions`` and returns all of it.

    A run that is repeated finds its blobs in the ledger and scans nothing; two
    runs at once may both add a blob, which the reader counts once.
    """
    spark = versions.sparkSession
    scan_unseen(versions, text, read_ledger(spark, path), rule_version).write.mode("append").parquet(path)
    return read_ledger(spark, path)


def findings_by_path(versions: DataFrame, ledger: DataFrame, text: str = "text", rule_version: int = RULE_VERSION) -> DataFrame:
    """``versions`` with ``blob`` and ``findings`` in place of the text: one row per version, none lost.

    Columns of ``versions`` named like these two are left out.
    """
    others = [f"`{c}`" for c in versions.columns if c not in (text, "blob", "findings")]
    rows = address(versions, text).select(*others, "blob")
    held = ledger.where(F.col("rule_version") == rule_version).groupBy("blob").agg(F.first("findings").alias("findings"))
    return rows.join(held, "blob", "left")


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op10_secret_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document, by the first update of a new ledger in the shared folder.

    Null and empty texts have no findings and the digest of the empty string;
    repeated rows and ids are each reported.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = findings_by_path(docs, update_ledger(docs, f"{shared_folder(spark)}/ledger-{uuid.uuid4().hex}"))
    base = F.filter("findings", lambda s: s["kind"].isin(*BASE_KINDS))

    def count(kind):
        return F.size(F.filter("findings", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("findings")).alias("spans"))
