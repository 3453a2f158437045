"""WARC archives: a deterministic sharded writer and its reader.

Writing: digests of the payloads are counted map-side to find equal payloads, and only payloads are shuffled, once: the pages are range-sorted by id; each task
streams its range, so a task holds one record at a time, and starts a new file when the compressed size is
reached. Headers, record ids and digests come from the row alone and every record is one gzip member without a time stamp, so a
repeated task writes the same bytes. A file is written under a name of its attempt and then renamed to its
final name, and the manifest, a Parquet table that Spark commits as a whole, lists the files with size and digest. Readers
follow the manifest, so files of lost or repeated attempts are never read.

Reading: one task per listed file at a time, record by record; payload digests are computed again and compared.

Odd input: a null payload is empty; a null url gives a record without target; a null id is allowed, sorts first and never answers
for others; of repeated rows with one id and payload the first is the response and the others revisit it; an empty
table gives an empty manifest and no records; other columns are not written.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chainwright.session import scratch, stash

#: Payloads from this size on are written once.
REVISIT_BYTES = 100
FILE_BYTES = 64 << 20
#: Digests of payloads held more than once (about 100 bytes each) are broadcast up to so many.
BROADCAST_ROWS = 200_000
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "path string, shard int, part int, records long, bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload string"


def filesystem(root: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a shared folder given as a path or URI."""
    if "://" not in root and not root.startswith("file:"):
        return pafs.LocalFileSystem(), root
    return pafs.FileSystem.from_uri(re.sub("^file:/+", "file:///", root))


def _header(fields: list[tuple[str, str]], first: str) -> bytes:
    """A header block; control characters of a value are percent-encoded, so a value cannot end its line."""
    lines = [first, *[f"{k}: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", v) for k, v in fields]]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One compressed record: a response with its payload, or a revisit with the response's headers alone."""
    http = _header([("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))], "HTTP/1.1 200 OK")
    block = http if refers_to is not None else http + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{'' if page_id is None else page_id}>"), ("WARC-Date", DATE)]
    if url is not None:
        fields.append(("WARC-Target-URI", url))
    if refers_to is not None:
        fields += [("WARC-Refers-To", f"<urn:page:{refers_to}>"), ("WARC-Profile", PROFILE)]
    else:
        fields.append(("WARC-Block-Digest", f"sha256:{hashlib.sha256(block).hexdigest()}"))
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return gzip.compress(_header(fields, "WARC/1.1") + block + b"\r\n\r\n", 6, mtime=0)


def _writer(root: str, limit: int):
    """Task that writes sorted rows (id, url, payload, digest, first id of the payload) and returns its manifest rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        fs, base = filesystem(root)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        done: list[tuple] = []
        out, temporary, size, count, digest = None, "", 0, 0, hashlib.sha256()

        def close() -> None:
            nonlocal out, size, count, digest
            if out is not None:
                out.close()
                final = f"{base}/pages-{shard:06d}-{len(done):05d}.warc.gz"
                fs.move(temporary, final)
                done.append((final.removeprefix(base + "/"), shard, len(done), count, size, digest.hexdigest()))
                out, size, count, digest = None, 0, 0, hashlib.sha256()

        before = None
        for b in batches:
            for page_id, url, payload, sha, first in zip(*[c.to_pylist() for c in b.columns], strict=True):
                data = (payload or "").encode()
                again = before == (page_id, sha)
                before = (page_id, sha)
                revisits = first is not None and len(data) >= REVISIT_BYTES and (first != page_id or again)
                made = record(page_id, url, data, sha, first if revisits else None)
                if out is None:
                    fs.create_dir(f"{base}/_temporary", recursive=True)
                    temporary = f"{base}/_temporary/{attempt}-{len(done):05d}"
                    out = fs.open_output_stream(temporary, compression=None)
                out.write(made)
                digest.update(made)
                size, count = size + len(made), count + 1
                if size >= limit:
                    close()
        close()
        columns = list(zip(*done, strict=True)) or [()] * 6
        kinds = (pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["path", "shard", "part", "records", "bytes", "sha256"])

    return run


def write_warc(pages: DataFrame, root: str, key: str = "page_id", url: str = "url", payload: str = "html", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all rows below ``root`` and return the committed manifest."""
    spark = pages.sparkSession
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(payload), F.lit("")).alias("payload"))
    rows = rows.withColumn("sha", F.sha2("payload", 256))
    # one narrow row per payload that is held twice; its ids meet only as counts and minima
    firsts = (
        rows.where(F.octet_length("payload") >= REVISIT_BYTES).groupBy("sha").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL").select(F.col("sha").alias("_s"), "first")
    )
    firsts = stash(firsts, "firsts")
    if firsts.count() <= BROADCAST_ROWS:
        firsts = F.broadcast(firsts)
    whole = rows.join(firsts, F.col("sha") == F.col("_s"), "left").select("page_id", "url", "payload", "sha", "first")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    ranged = whole.repartitionByRange(parts, "page_id", "sha").sortWithinPartitions("page_id", "sha", "url")
    ranged.mapInArrow(_writer(root, file_bytes), MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def members(stream) -> Iterator[bytes]:
    """The decompressed gzip members of a stream, one after the other."""
    left = b""
    while True:
        unpack, parts = zlib.decompressobj(31), []
        while not unpack.eof:
            left = left or stream.read(1 << 20)
            if not left:
                if parts:
                    raise ValueError("a record is cut off")
                return
            parts.append(unpack.decompress(left))
            left = unpack.unused_data
        yield b"".join(parts)


def parse(raw: bytes) -> tuple:
    """Fields of RECORD from one decompressed record; a digest that does not fit its payload is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = int(re.search(rb"(?im)^content-length: *([0-9]+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (hashlib.sha256(payload).hexdigest() != digest or len(payload) != length):
        raise ValueError(f"record {fields['WARC-Record-ID']} does not fit its digest")
    number = lambda name: int(x) if (x := fields[name][len("<urn:page:") : -1]) else None
    return (number("WARC-Record-ID"), fields.get("WARC-Target-URI"), length, digest, kind, number("WARC-Refers-To") if kind == "revisit" else None, payload.decode() if kind == "response" else None)


def read_warc(manifest: DataFrame, root: str, payloads: bool = True) -> DataFrame:
    """All records of the files of a manifest. The texts of revisits are null: they are those of ``refers_to``."""
    spark = manifest.sparkSession
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string())
    names = [x.split()[0] for x in RECORD.split(", ")]
    keep = len(names) if payloads else len(names) - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = filesystem(root)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:keep], kinds[:keep], strict=True)], names[:keep])

        for b in batches:
            for path in b.column(0).to_pylist():
                with fs.open_input_stream(f"{base}/{path}", compression=None) as stream:
                    rows, size = [], 0
                    for raw in members(stream):
                        rows.append(parse(raw))
                        size += len(raw)
                        if size > 4 << 20:
                            yield batch(rows)
                            rows, size = [], 0
                    if rows:
                        yield batch(rows)

    files = manifest.select("path").repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1), "path")
    return files.mapInArrow(run, ", ".join(RECORD.split(", ")[:keep]))


def op9_warc(spark, folder: str) -> DataFrame:
    """Write every page to archives in the shared folder and read them back."""
    root = scratch(spark, "warc")
    manifest = write_warc(spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url", "html"), root)
    return read_warc(manifest, root, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS s FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY s) AS m, row_number() OVER (PARTITION BY s, page_id) AS k FROM p)
SELECT page_id, n AS payload_bytes, s AS payload_digest, CASE WHEN n >= 100 AND m IS NOT NULL AND (m IS DISTINCT FROM page_id OR k > 1) THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 100 AND m IS NOT NULL AND (m IS DISTINCT FROM page_id OR k > 1) THEN m END AS refers_to
FROM f"""
