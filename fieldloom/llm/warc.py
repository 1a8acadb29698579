"""WARC archives: a writer and a splittable reader.

Each record is a gzip member of its own. The reader deals byte ranges to tasks: a task scans its range for the gzip
magic, takes a place for a member only if it inflates to a WARC version line and a full header block, owns the records
that start inside its range, and follows the last of them past the range's end. Payloads are streamed through the digest,
so memory does not follow the size of an archive.

Archives lie in one folder of a shared file system (a path or URI that pyarrow.fs opens): file, hdfs, s3 or gs.

Repeated payloads: of records with equal payloads of at least ``least_bytes`` bytes, the one with the largest id is a
response and the others are revisits that refer to it. Digests are compared, not payloads, so a payload that a third of
all pages share costs one row per page and is summed before it is shuffled.

Defined results: a null payload is empty; a row with a null id is a response that nothing refers to; rows that share both
the id and a repeated payload with the largest id are all responses; an empty table writes no archive and reads none.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import shuffle_partitions, table
from fieldloom.session import ensure_checkpoint_dir, stored

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
CRLF = b"\r\n"


@dataclass(frozen=True)
class WarcRules:
    least_bytes: int = 1000
    archive_bytes: int = 64 << 20  # an archive is closed after so many
    split_bytes: int = 16 << 20
    tasks: int = 16  # of the reader at most, for each shuffle partition; below that a task has one range
    read_bytes: int = 1 << 20


def open_folder(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    return pafs.FileSystem.from_uri(uri if not uri.startswith("file:/") or uri.startswith("file://") else "file://" + uri[5:])


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A WARC record as a gzip member."""
    head = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in [*headers, ("Content-Length", str(len(block)))]) + CRLF
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(head + block + CRLF + CRLF) + packer.flush()


def _page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    kind = "response" if refers_to is None else "revisit"
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (f"Content-Length: {len(payload)}\r\n".encode() if refers_to is None else b"") + CRLF
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id}|{url}|{digest}')}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", " ".join((url or "").split())),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Payload-Length", str(len(payload))),
        ("Content-Type", "application/http;msgtype=response"),
    ]
    if page_id is not None:
        headers.append(("WARC-Page-ID", str(page_id)))
    if refers_to is not None:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-ID", str(refers_to))]
    return record(headers, http if refers_to is not None else http + payload)


def write_archives(pages: DataFrame, folder: str, rules: WarcRules = WarcRules(), page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes the pages' records into archives under folder; per archive: path, bytes, records. Run it once: ``stored`` it."""
    pages = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), F.encode(F.coalesce(pages[html], F.lit("")), "UTF-8").alias("payload"))
    digests = stored(pages.select("page_id", F.sha1("payload").alias("digest"), F.length("payload").alias("n")))
    repeated = digests.filter((F.col("n") >= rules.least_bytes) & F.col("page_id").isNotNull()).groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("copies")).filter("copies > 1")
    revisits = digests.filter("page_id is not null").join(repeated, "digest").filter("page_id <> first").select(F.col("page_id").alias("id"), F.col("digest").alias("same"), F.col("first").alias("refers_to")).distinct()
    told = pages.withColumn("digest", F.sha1("payload")).join(revisits, (F.col("page_id") == F.col("id")) & (F.col("digest") == F.col("same")), "left").select("page_id", "url", "payload", "digest", "refers_to")
    most = rules.archive_bytes

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        system, root = open_folder(folder)
        system.create_dir(root, recursive=True)
        done: list[tuple[str, int, int]] = []
        stream, path, size, n = None, "", 0, 0
        for b in batches:
            for row in (r for k in range(0, b.num_rows, 64) for r in zip(*[c.to_pylist() for c in b.slice(k, 64).columns], strict=True)):
                if stream is None:  # a name of its own for each attempt: a lost executor's half-written archive is not listed and never read
                    path, size, n = f"{root}/part-{context.partitionId():05d}-{context.taskAttemptId()}-{len(done):04d}.warc.gz", 0, 0
                    stream = system.open_output_stream(path, compression=None)
                member = _page_record(row[0], row[1], row[2], row[3], row[4])
                stream.write(member)
                size, n = size + len(member), n + 1
                if size >= most:
                    stream.close()
                    done.append((path, size, n))
                    stream = None
        if stream is not None:
            stream.close()
            done.append((path, size, n))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done]) for k in range(3)], ["path", "bytes", "records"])

    return told.mapInArrow(write, "path string, bytes long, records long")


class _Window:
    """Bytes of a file from a place on, read ahead in steps."""

    def __init__(self, source: pa.NativeFile, at: int, size: int, step: int) -> None:
        self.source, self.base, self.size, self.step, self.data = source, at, size, step, b""

    def more(self) -> bool:
        at = self.base + len(self.data)
        if at >= self.size:
            return False
        self.source.seek(at)
        self.data += self.source.read(min(self.step, self.size - at))
        return True

    def drop(self, upto: int) -> None:
        self.data, self.base = self.data[upto - self.base :], upto


def _head(window: _Window, at: int) -> bytes | None:
    """The header block of the record whose member starts at ``at``, or None if no record does."""
    inflate, out, i, end = zlib.decompressobj(31), bytearray(), at - window.base, -1
    try:
        while end < 0:
            while i >= len(window.data):
                if not window.more():
                    return None
            part = window.data[i : i + 512]
            seen = max(0, len(out) - 3)
            out += inflate.decompress(part)
            i += len(part)
            end = out.find(CRLF + CRLF, seen)
            # what starts with the version line is a record, however long its header
            if not out.startswith(VERSION[: len(out)]) or inflate.eof and end < 0:
                return None
    except zlib.error:
        return None
    return bytes(out[:end])


def _member(window: _Window, at: int) -> tuple[Iterator[bytes], list[int]]:
    """The inflated bytes of the member at ``at``, in pieces; the place of its end, once all are taken. Bytes read are dropped."""
    end: list[int] = []

    def pieces() -> Iterator[bytes]:
        inflate = zlib.decompressobj(31)
        window.drop(at)
        while not inflate.eof:
            if not window.data and not window.more():
                raise ValueError(f"a member at {at} has no end")
            taken = window.data
            out = inflate.decompress(taken)
            window.drop(window.base + len(taken) - len(inflate.unused_data))
            if out:
                yield out
        end.append(window.base)

    return pieces(), end


def read_range(system: pafs.FileSystem, path: str, start: int, stop: int, rules: WarcRules = WarcRules(), payloads: bool = False) -> Iterator[dict]:
    """The records that start inside [start, stop): offset, headers, payload_bytes, payload_digest and, if asked for, payload."""
    with system.open_input_file(path) as source:
        window = _Window(source, start, source.size(), rules.read_bytes)
        at = start
        while True:
            while (found := window.data.find(MAGIC, max(0, at - window.base))) < 0:
                at = max(at, window.base + len(window.data) - 2)
                window.drop(min(at, window.base + len(window.data)))
                if at >= stop or not window.more():
                    return
            at = window.base + found
            if at >= stop:
                return
            head = _head(window, at)
            if head is None:
                at += 1
                continue
            lines = head.decode("utf-8", "replace").split("\r\n")[1:]
            headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
            left, skip, digest, held, n, http = int(headers.get("content-length", 0)), len(head) + 4, hashlib.sha1(), [], 0, b""
            is_http, in_http = headers.get("content-type", "").startswith("application/http"), True
            parts, end = _member(window, at)
            for part in parts:
                if skip:
                    cut = min(skip, len(part))
                    part, skip = part[cut:], skip - cut
                part = part[:left]
                left -= len(part)
                if is_http and in_http:
                    http += part
                    if (k := http.find(CRLF + CRLF)) < 0:
                        continue
                    part, in_http = http[k + 4 :], False
                digest.update(part)
                n += len(part)
                if payloads:
                    held.append(part)
            yield {"offset": at, "headers": headers, "payload_bytes": n, "payload_digest": digest.hexdigest(), "payload": b"".join(held) if payloads else None}
            at = end[0]


def read_archives(archives: DataFrame, folder: str, rules: WarcRules = WarcRules()) -> DataFrame:
    """path, offset, page_id, record_type, payload_bytes, payload_digest and refers_to of every record of archives (path, bytes).

    A revisit stands for its payload: its length and digest are those that its header states.
    """
    step = rules.split_bytes
    ranges = archives.select("path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(step).cast("long"))).alias("start"))
    n = archives.agg(F.sum(F.greatest(F.ceil(F.col("bytes") / step), F.lit(1)))).first()[0] or 1
    # dealt in turn to a stated number of tasks: rows are tiny, and adaptive execution would merge them into one task
    ranges = ranges.select("path", "start", F.least(F.col("start") + step, F.col("bytes")).alias("stop")).repartition(min(int(n), rules.tasks * shuffle_partitions(archives.sparkSession)))
    shape = pa.schema([("path", pa.string()), ("offset", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        whole = lambda x: None if x is None else int(x)
        for b in batches:
            for path, start, stop in zip(*[c.to_pylist() for c in b.columns], strict=True):
                rows = []
                for r in read_range(system, path, start, stop, rules):
                    h = r["headers"]
                    revisit = h.get("warc-type") == "revisit"
                    n = int(h["warc-payload-length"]) if revisit else r["payload_bytes"]
                    digest = h["warc-payload-digest"].removeprefix("sha1:") if revisit else r["payload_digest"]
                    rows.append((path, r["offset"], whole(h.get("warc-page-id")), h.get("warc-type"), n, digest, whole(h.get("warc-refers-to-page-id"))))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), shape.types, strict=True)], schema=shape)

    return ranges.mapInArrow(read, "path string, offset long, page_id long, record_type string, payload_bytes long, payload_digest string, refers_to long")


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{ensure_checkpoint_dir(spark).rstrip('/')}/fieldloom-warc-{uuid.uuid4().hex}"
    archives = stored(write_archives(table(spark, sf_dir, "pages"), folder))
    return read_archives(archives, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p LEFT JOIN f USING (payload_digest)"""
