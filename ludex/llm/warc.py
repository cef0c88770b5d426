"""WARC archives written index first and read back by coalesced byte ranges.

Writing: every Spark task appends its records to archives of bounded size in the shared
folder and emits one index row per record (archive, offset, length, url, digest, ...).
Archives have unique names, and index rows leave a task only after their archive is
closed; a retried or lost task writes new archives, and files of failed attempts are
never referred to. The index is a Parquet table. Reading: the selected index rows are
sorted by archive and offset, neighbouring records join into one range up to a size, and
each range is one read.

Records with equal payloads (SHA-1) of at least ``min_revisit_bytes``: the one with the
largest page_id is the response and the others revisit it. A revisit keeps the HTTP
header (so the payload's length) and the payload digest, not the payload.

Edge cases: a null html is an empty payload; a null url has no target header; rows that
repeat the largest page_id of a payload are all responses; a null page_id counts as the
smallest, stays null, and is a response if no row of its payload has an id; an empty table
gives no archive and no rows; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ludex.session import materialize, scratch_path, ship_package

MIN_REVISIT_BYTES = 0
ARCHIVE_BYTES = 32 << 20
RANGE_BYTES = 8 << 20       # longest coalesced read (a longer record is read alone)
RANGE_GAP = 64 << 10        # unselected bytes between two records worth reading over
DATE = "1970-01-01T00:00:00Z"

INDEX = ("archive string, offset long, length long, url string, page_id long, "
         "payload_bytes long, payload_digest string, record_type string, refers_to long")
RECORDS = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
           "refers_to long, payload binary, archive string, offset long, length long")

_INDEX_SCHEMA = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("length", pa.int64()),
                           ("url", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()),
                           ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
_RECORD_SCHEMA = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()),
                            ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                            ("payload", pa.binary()), ("archive", pa.string()), ("offset", pa.int64()),
                            ("length", pa.int64())])


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given by path or URI."""
    if local := re.match(r"(?:file:)?(/.*)", uri):
        return fs.LocalFileSystem(), "/" + local[1].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_uri(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def build_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str,
                 record_type: str, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; the block is an HTTP response, without its body in a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode("ascii")
    block = http + payload if record_type == "response" else http
    head = ["WARC/1.1", f"WARC-Type: {record_type}", f"WARC-Record-ID: {record_uri(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        safe = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {safe}")
    head.append(f"WARC-Payload-Digest: sha1:{payload_digest}")
    if record_type == "revisit":
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        head.append(f"WARC-Refers-To: {record_uri(refers_to)}")
    head.append("Content-Type: application/http; msgtype=response")
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> tuple[str, dict[str, str]]:
    first, *rest = raw.decode("utf-8").split("\r\n")
    return first, {k.lower(): v for k, _, v in (line.partition(": ") for line in rest)}


def _page(uri: str) -> int | None:
    value = uri.removeprefix("<urn:page:").removesuffix(">")
    return None if value == "none" else int(value)


def parse_record(raw: bytes) -> dict:
    """Fields of one record; the response's length and digest come from its payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, h = _headers(head)
    block = rest[:int(h["content-length"])]
    if not version.startswith("WARC/") or rest[len(block):] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    http, _, payload = block.partition(b"\r\n\r\n")
    _, hh = _headers(http)
    kind = h["warc-type"]
    stated = h["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (digest(payload) != stated or len(payload) != int(hh["content-length"])):
        raise ValueError(f"damaged payload of {h['warc-record-id']}")
    return {"page_id": _page(h["warc-record-id"]), "url": h.get("warc-target-uri"),
            "payload_bytes": int(hh["content-length"]), "payload_digest": stated, "record_type": kind,
            "refers_to": _page(h["warc-refers-to"]) if kind == "revisit" else None,
            "payload": payload if kind == "response" else None}


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = MIN_REVISIT_BYTES,
                   archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write all pages as WARC records and return the index (a written table)."""
    spark = pages.sparkSession
    ship_package(spark)
    folder = folder or scratch_path(spark, "warc")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        html.alias("html"), F.sha1(html.cast("binary")).alias("sha"))
    # Payloads met more than once, with their response; counted with map-side combine.
    repeated = (rows.where(F.octet_length("html") >= min_revisit_bytes).groupBy("sha")
                    .agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("keep")).where("n > 1")
                    .select("sha", "keep"))
    # Read from a written table the join's inputs are plain shuffles, which adaptive
    # execution splits where one payload holds many rows.
    repeated = materialize(repeated, "warc-repeated")
    planned = (rows.join(repeated, "sha", "left")
                   .select("page_id", "url", "html",
                           F.when(F.col("keep").isNull() | F.col("keep").eqNullSafe(F.col("page_id")), F.lit(None))
                            .otherwise(F.col("keep")).alias("refers_to")))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        stream = name = None
        offset, index = 0, []

        def close() -> pa.RecordBatch:
            stream.close()
            cols = list(zip(*index, strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _INDEX_SCHEMA, strict=True)],
                                              schema=_INDEX_SCHEMA)

        for batch in batches:
            ids, urls, htmls, refs = batch.columns
            for i in range(batch.num_rows):
                if stream is None:
                    name, offset, index = f"{uuid.uuid4().hex}.warc", 0, []
                    system.create_dir(path, recursive=True)
                    stream = system.open_output_stream(f"{path}/{name}")
                page_id, url, ref = ids[i].as_py(), urls[i].as_py(), refs[i].as_py()
                payload = htmls[i].as_py().encode("utf-8")
                sha = digest(payload)
                kind = "response" if ref is None else "revisit"
                raw = build_record(page_id, url, payload, sha, kind, ref)
                stream.write(raw)
                index.append((name, offset, len(raw), url, page_id, len(payload), sha, kind, ref))
                offset += len(raw)
                if offset >= archive_bytes:
                    yield close()
                    stream = None
        if stream is not None:
            yield close()

    index = planned.mapInArrow(write, INDEX).withColumn("archive", F.concat(F.lit(folder.rstrip("/") + "/"), "archive"))
    return materialize(index, "warc-index")


def coalesce_ranges(offsets: list[int], lengths: list[int], gap: int = RANGE_GAP,
                    limit: int = RANGE_BYTES) -> list[tuple[int, int, int, int]]:
    """(first row, end row, start byte, end byte) of each read over rows sorted by offset."""
    out = []
    for i, (o, n) in enumerate(zip(offsets, lengths, strict=True)):
        if out:
            a, _, start, end = out[-1]
            if o - end <= gap and o + n - start <= limit:
                out[-1] = (a, i + 1, start, max(end, o + n))
                continue
        out.append((i, i + 1, o, o + n))
    return out


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records of the given index rows back from their archives. Archives have a
    bounded size, so dealing rows by archive cannot make a hot partition."""
    ship_package(index.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, stream = None, None
        for batch in batches:
            names = batch.column(0).to_pylist()
            lo = 0
            while lo < len(names):
                hi = lo
                while hi < len(names) and names[hi] == names[lo]:
                    hi += 1
                if opened != names[lo]:
                    system, path = open_folder(names[lo])
                    stream, opened = system.open_input_file(path), names[lo]
                offsets = batch.column(1).slice(lo, hi - lo).to_pylist()
                lengths = batch.column(2).slice(lo, hi - lo).to_pylist()
                for a, b, start, end in coalesce_ranges(offsets, lengths):
                    raw = stream.read_at(end - start, start)
                    found = []
                    for o, n in zip(offsets[a:b], lengths[a:b], strict=True):
                        r = parse_record(raw[o - start:o - start + n])
                        if not payloads:
                            r["payload"] = None
                        found.append(r | {"archive": names[lo], "offset": o, "length": n})
                    yield pa.RecordBatch.from_pylist(found, schema=_RECORD_SCHEMA)
                lo = hi

    n = max(1, -(-(index.agg(F.sum("length")).first()[0] or 0) // (4 * RANGE_BYTES)))
    dealt = (index.select("archive", "offset", "length").repartition(int(n), "archive")
                  .sortWithinPartitions("archive", "offset"))
    return dealt.mapInArrow(read, RECORDS)


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write every page, then read every record back (digests first, then where it lies)."""
    found = read_records(write_archives(pages, **options), payloads=False)
    first = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return found.select(*first, *[c for c in found.columns if c not in first])


__all__ = ["write_archives", "read_records", "round_trip", "build_record", "parse_record", "coalesce_ranges"]
