"""WARC archives: a writer, and a sequential reader.

Every record is a gzip member of its own.  The reader takes one pass over a
file in pieces: it inflates member by member, finds the record header, frames
the block by Content-Length, and checks the payload digest while bytes go by;
a payload is held only where it is asked for.

Archives lie in the shared folder.  A writing task makes files under names of
its own and reports them in a manifest table; only what finished tasks report
is read, so that a lost executor's half files don't count.

Defined results: a null payload is empty; a null url is written as
``about:blank``; blanks and control characters in urls are percent-encoded; a
null page id stays null and is a response unless another page with an id has
its payload; rows repeated with the largest id are all responses; an empty
table makes no file and reads as an empty table; further columns don't matter.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import new_path, saved

CHUNK = 1 << 18
FILE_BYTES = 256 << 20
NO_DIGEST = hashlib.sha1(b"").hexdigest()
MANIFEST = "path string, n_records long, n_bytes long"
RECORD = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, path string, error string"


class WarcError(ValueError):
    """A record that isn't framed, or doesn't hold, what its header says."""


def _open(path: str):
    return pa.fs.FileSystem.from_uri(path)


def _record(page_id: int | None, url: str | None, payload: bytes, sha1: str, refers_to: int | None) -> bytes:
    digest = base64.b32encode(bytes.fromhex(sha1)).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else "about:blank"
    block = http + payload if refers_to is None else http
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'none' if page_id is None else page_id}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join([*head, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def _writer(folder: str, level: int, file_bytes: int):
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = _open(folder)
        out, done, n, size, name = None, [], 0, 0, ""

        def close() -> None:
            out.close()
            done.append((f"{folder}/{name}", n, size))

        for batch in source:
            for page_id, url, payload, sha1, refers in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "sha1", "refers_to")), strict=True):
                if out is None:
                    name, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = fs.open_output_stream(f"{root}/{name}", compression=None)
                body = payload.as_py() or b""
                press = zlib.compressobj(level, zlib.DEFLATED, 31)
                member = press.compress(_record(page_id.as_py(), url.as_py(), body, sha1.as_py(), refers.as_py())) + press.flush()
                out.write(member)
                n, size = n + 1, size + len(member)
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        for path, n_records, n_bytes in done:
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n_records], "n_bytes": [n_bytes]})

    return run


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 4, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write page_id, url, html as WARC files into ``folder``; the manifest (path, n_records, n_bytes), itself a table.

    Of pages with equal payloads of at least ``min_bytes`` the one with the
    largest id is stored, the others become revisit records.
    """
    spark = pages.sparkSession
    fs, root = _open(folder)
    fs.create_dir(root, recursive=True)
    body = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    body = body.withColumn("sha1", F.sha1("payload"))
    ids = pages.select("page_id", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("p")).filter(F.length("p") >= min_bytes)
    first = ids.groupBy(F.sha1("p").alias("sha1")).agg(F.max("page_id").alias("_top"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    linked = body.join(first, "sha1", "left")
    refers = F.when(F.col("_top").isNotNull() & ~F.col("_top").eqNullSafe(F.col("page_id")), F.col("_top"))
    done = linked.select("page_id", "url", "payload", "sha1", refers.alias("refers_to")).mapInArrow(_writer(folder, level, file_bytes), MANIFEST)
    return saved(done, "warc-manifest")


def _members(stream) -> Iterator[Iterator[bytes]]:
    """For each gzip member the pieces of its content; each must be used up before the next."""
    rest = b""
    while rest or (rest := stream.read(CHUNK)):
        inflate = zlib.decompressobj(31)

        def pieces() -> Iterator[bytes]:
            nonlocal rest
            while not inflate.eof:
                data = rest or stream.read(CHUNK)
                if not data:
                    raise WarcError("the file ends within a member")
                rest = b""
                yield inflate.decompress(data, CHUNK)
                while inflate.unconsumed_tail and not inflate.eof:
                    yield inflate.decompress(inflate.unconsumed_tail, CHUNK)
            rest = inflate.unused_data

        yield pieces()


def _record_of(member: Iterator[bytes], payloads: bool) -> dict:
    head = bytearray()
    while (end := head.find(b"\r\n\r\n")) < 0:
        piece = next(member, None)
        if piece is None:
            raise WarcError("no end of the record header")
        head += piece
    lines = head[:end].decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise WarcError(f"not a record: {lines[0][:40]!r}")
    field = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    name = field.get("warc-record-id")
    if not field.get("content-length", "").isdigit():
        raise WarcError(f"{name}: no Content-Length")
    left = int(field["content-length"])
    sha1, n, held, http, after = hashlib.sha1(), 0, bytearray(), bytearray(), bytearray()
    # The payload of a record that holds an HTTP message comes after that message's header; else it is the whole block.
    message = field.get("content-type", "").replace(" ", "").lower().startswith("application/http")
    in_http = message

    def take(data: bytes) -> None:
        nonlocal left, n, in_http, http
        block, extra = data[:left], data[left:]
        left -= len(block)
        after.extend(extra)
        if in_http:
            http += block
            if (cut := http.find(b"\r\n\r\n")) < 0:
                return
            in_http, block = False, bytes(http[cut + 4 :])
            http = http[:cut]
        sha1.update(block)
        n += len(block)
        if payloads:
            held.extend(block)

    take(bytes(head[end + 4 :]))
    for piece in member:
        take(piece)
    if left or bytes(after) != b"\r\n\r\n" or in_http:
        raise WarcError(f"{name}: the block isn't as long as Content-Length says")
    kind, stated = field.get("warc-type", ""), field.get("warc-payload-digest", "")
    digest = base64.b32encode(sha1.digest()).decode()
    length = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", http)
    if kind == "revisit":  # what the payload was is known from the header only
        size, digest = (int(length[1]) if length else None), (stated.removeprefix("sha1:") or None)
    else:
        size = n
        if message and length and int(length[1]) != n:
            raise WarcError(f"{name}: the payload isn't as long as the message says")
        if stated.startswith("sha1:") and stated.removeprefix("sha1:") != digest:
            raise WarcError(f"{name}: the payload doesn't have its digest")
    return {"field": field, "record_type": kind, "payload_bytes": size, "payload_digest": digest, "payload": bytes(held) if payloads else None, "error": None}


def read_records(stream, payloads: bool = False, strict: bool = True) -> Iterator[dict]:
    """The records of an open archive, in order: header fields, record_type, payload_bytes, payload_digest, and ``payload`` if asked for.

    Any WARC type is read (warcinfo, request, metadata ...); a missing digest is
    computed, one of another kind than SHA-1 isn't held against the payload.  A
    bad record raises; unless ``strict`` it becomes a record with an ``error``
    and reading goes on with the next member, if the file can still be inflated.
    """
    bad = lambda e: {"field": {}, "record_type": None, "payload_bytes": None, "payload_digest": None, "payload": None, "error": str(e)}
    members = _members(stream)
    while True:
        try:
            member = next(members, None)
            if member is None:
                return
            try:
                record = _record_of(member, payloads)
            except WarcError as e:
                if strict:
                    raise
                for _ in member:
                    pass
                record = bad(e)
        except (WarcError, zlib.error) as e:
            if strict:
                raise
            yield bad(e)
            return
        yield record


def _page(urn: str | None) -> int | None:
    """The page id in a record id of ours; null for others."""
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def _reader(strict: bool):
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("path", pa.string()), ("error", pa.string())])
    pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in source:
            for path in batch.column("path").to_pylist():
                fs, name = _open(path)
                rows: list[tuple] = []
                with fs.open_input_stream(name, compression=None) as stream:
                    for r in read_records(stream, strict=strict):
                        f = r["field"]
                        rows.append((_page(f.get("warc-record-id")), f.get("warc-target-uri"), r["record_type"], _page(f.get("warc-refers-to")), r["payload_bytes"], r["payload_digest"], path, r["error"]))
                        if len(rows) == 4096:
                            yield pack(rows)
                            rows = []
                if rows:
                    yield pack(rows)

    return run


def read_archives(manifest: DataFrame, strict: bool = False) -> DataFrame:
    """A row for each record of the manifest's files; a file is read by one task, in one pass.

    Bad records have null fields, their file's path and an ``error``; where
    ``strict`` they end the job.
    """
    n = max(1, manifest.count())
    return manifest.select("path").repartition(n).mapInArrow(_reader(strict), RECORD)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    return read_archives(write_archives(pages, new_path(spark, "warc")), strict=True)


_CHARS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
ORACLE = f"""
WITH d AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(h, CAST(5 * i + 1 AS INTEGER), 5))::BIGINT) AS five, max(page_id) OVER (PARTITION BY h) AS top FROM d)
SELECT page_id, payload_bytes,
       list_aggregate(list_transform(five, lambda x: substr('{_CHARS}', CAST((x >> 15) & 31 AS INTEGER) + 1, 1) || substr('{_CHARS}', CAST((x >> 10) & 31 AS INTEGER) + 1, 1)
         || substr('{_CHARS}', CAST((x >> 5) & 31 AS INTEGER) + 1, 1) || substr('{_CHARS}', CAST(x & 31 AS INTEGER) + 1, 1)), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM b
"""
