"""Sources: files, kinds, rasters, TSV, requests, result JSON."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BOX = "struct<x:double,y:double,width:double,height:double>"
LINE = f"struct<text:string,confidence:double,bbox:{BOX},words:array<struct<text:string,confidence:double,bbox:{BOX}>>,char_confidences:array<double>>"
RESULT = f"pages array<struct<page_index:int,text:string,lines:array<{LINE}>,confidence:double>>, timing struct<decode_ms:double,preprocess_ms:double,detect_ms:double,recognize_ms:double,total_ms:double>"
LEGACY = "pageNumber int, x int, y int, width int, height int, text string, textConfidence double, column int, row int, density double, clusterId int"


def kind(content: Column) -> Column:
    """pdf, multi_page_tiff or image, by the first four bytes."""
    head = F.hex(F.substring(content, 1, 4))
    return F.when(head == "25504446", "pdf").when(head.isin("49492A00", "4D4D002A"), "multi_page_tiff").otherwise("image")


def is_jpeg(content: Column) -> Column:
    return F.coalesce(F.hex(F.substring(content, 1, 2)) == "FFD8", F.lit(False))


def files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """path, content, kind of a file or of a folder's own files; unreadable ones are skipped (Spark logs them)."""
    r = spark.read.format("binaryFile").option("recursiveFileLookup", "false").option("ignoreCorruptFiles", "true")
    if glob:
        r = r.option("pathGlobFilter", glob)
    return r.load(path).select("path", "content", kind(F.col("content")).alias("kind"))


def images(spark: SparkSession, path: str) -> DataFrame:
    """path, width, height, channels, data (RGB, top down) of PNG, JPEG, BMP, GIF and first TIFF pages."""
    img = spark.read.format("image").option("dropInvalid", "true").load(path).select("image.*")

    def rgb(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            d = [_rgb(np.frombuffer(x, np.uint8).reshape(h, w, n)) for x, h, w, n in zip(*(b.column(c).to_pylist() for c in ("data", "height", "width", "nChannels")), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("origin"), b.column("width"), b.column("height"), pa.array([3] * len(d), pa.int32()), pa.array(d, pa.binary())], ["path", "width", "height", "channels", "data"])

    return img.mapInArrow(rgb, "path string, width int, height int, channels int, data binary")


def _rgb(bgr: np.ndarray) -> bytes:
    if bgr.shape[2] == 1:
        return np.repeat(bgr, 3, axis=2).tobytes()
    return np.ascontiguousarray(bgr[..., 2::-1]).tobytes()


def byte_of(sample: Column) -> Column:
    """The upper byte of a 16-bit sample."""
    return F.shiftright(sample.cast("int"), 8)


class UnsupportedImage(ValueError):
    pass


def _packbits(data: bytes) -> bytes:
    out, i = bytearray(), 0
    while i < len(data):
        n = data[i]
        i += 1
        if n < 128:
            out += data[i : i + n + 1]
            i += n + 1
        elif n > 128:
            out += data[i : i + 1] * (257 - n)
            i += 1
    return bytes(out)


def tiff_pages(data: bytes, wanted: set[int] | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(source page, RGB) of a TIFF's pages: raw, PackBits or Deflate; gray of 1, 8 or 16 bits, RGB, RGBA."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        raise UnsupportedImage("not a TIFF")
    num = lambda at, n: int.from_bytes(data[at : at + n], "little" if order == "<" else "big")
    at, index = num(4, 4), 0
    while at:
        tags = {}
        for i in range(num(at, 2)):
            e = at + 2 + 12 * i
            size = {1: 1, 3: 2, 4: 4}.get(num(e + 2, 2), 0)
            n = num(e + 4, 4)
            base = e + 8 if size * n <= 4 else num(e + 8, 4)
            if size:
                tags[num(e, 2)] = [num(base + size * k, size) for k in range(n)]
        if wanted is None or index in wanted:
            yield index, _tiff_rgb(data, tags, order)
        at, index = num(at + 2 + 12 * num(at, 2), 4), index + 1


def _tiff_rgb(data: bytes, tags: dict[int, list[int]], order: str) -> np.ndarray:
    w, h, n = tags[256][0], tags[257][0], tags.get(277, [1])[0]
    bits, how = tags.get(258, [1])[0], tags.get(259, [1])[0]
    plain = {1: bytes, 32773: _packbits, 8: zlib.decompress, 32946: zlib.decompress}.get(how)
    if plain is None or tags.get(284, [1])[0] != 1 or (n, bits) not in {(1, 1), (1, 8), (1, 16), (3, 8), (4, 8)}:
        raise UnsupportedImage(f"compression {how}, {n} samples of {bits} bits")
    raw = b"".join(plain(data[o : o + k]) for o, k in zip(tags[273], tags[279], strict=True))
    if bits == 1:
        v = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(h, -1), axis=1)[:, :w] * np.uint8(255)
    elif bits == 16:
        v = (np.frombuffer(raw, order + "u2").reshape(h, w) >> 8).astype(np.uint8)
    else:
        v = np.frombuffer(raw, np.uint8)[: h * w * n].reshape(h, w, n)[..., :3].squeeze()
        v = v.reshape(h, w, -1).squeeze(-1) if n == 1 else v.reshape(h, w, 3)
    if n == 1:
        v = 255 - v if tags.get(262, [1])[0] == 0 else v
        v = np.repeat(v[..., None], 3, axis=2)
    return np.ascontiguousarray(v)


def decode_tiffs(rows: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """path, source_page_index, page_index, width, height, channels, data, error_kind, error from path and content.

    The page filter works inside the decoder.  If it leaves no page, the first
    one is given; what can't be decoded becomes an error row, as PDFs do.
    """
    wanted = None if pages is None else set(pages)
    schema = pa.schema([("path", pa.string()), ("source_page_index", pa.int32()), ("page_index", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("channels", pa.int32()), ("data", pa.binary()), ("error_kind", pa.string()), ("error", pa.string())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                try:
                    if content[:4] == b"%PDF":
                        raise UnsupportedImage("no PDF renderer")
                    found = list(tiff_pages(content, wanted)) or list(tiff_pages(content, {0}))
                    rows = [(path, s, k, v.shape[1], v.shape[0], 3, v.tobytes(), None, None) for k, (s, v) in enumerate(found)]
                except (UnsupportedImage, KeyError, ValueError, IndexError, zlib.error) as e:
                    rows = [(path, None, None, None, None, None, None, "pdf" if content[:4] == b"%PDF" else "decode", str(e))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    return rows.select("path", "content").mapInArrow(run, "path string, source_page_index int, page_index int, width int, height int, channels int, data binary, error_kind string, error string")


def tsv(lines: DataFrame, header: list[str], exact: bool = False) -> DataFrame:
    """Columns of raw tab-split lines (column ``value``); rows need at least, or exactly, as many fields as the header."""
    f = F.split("value", "\t", -1)
    d = lines.filter(F.size(f) == len(header) if exact else F.size(f) >= len(header))
    return d.select(*[f.getItem(i).alias(c) for i, c in enumerate(header)])


def label_text(text: Column, verified: Column) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.nullif(verified, F.lit("")), F.lit(""))


def noisy_json(s: Column, schema: str) -> Column:
    """JSON that starts at the first brace of a noisy text."""
    at = F.locate("{", s)
    return F.when(at > 0, F.from_json(F.substring(s, at, F.length(s)), schema))


def request(rows: DataFrame) -> DataFrame:
    """content, pages, status of JSON requests (column ``body``): 400 for bad base64 or a missing file."""
    r = F.from_json("body", "file string, pages string")
    d = rows.withColumn("_r", r)
    content = F.try_to_binary(F.col("_r.file"), F.lit("base64"))
    return d.withColumns({"content": content, "pages": F.from_json(F.col("_r.pages"), "array<int>")}).withColumn("status", F.when(F.col("content").isNull(), 400).otherwise(200)).drop("_r")


def multipart(rows: DataFrame) -> DataFrame:
    """``rows`` (content_type, body: bytes of multipart/form-data) with content, pages, status and error: the fields ``file`` and ``pages`` (a JSON list of numbers, or null), others ignored; 400 without a file or for bad pages."""

    def fields(kind: str | None, body: bytes | None) -> tuple[bytes | None, str | None, str | None]:
        mark = re.search(r'boundary="?([^";,]+)', kind or "")
        if mark is None:
            return None, None, "multipart error: no boundary"
        found: dict[str, bytes] = {}
        for part in (b"\r\n" + (body or b"")).split(b"\r\n--" + mark[1].encode())[1:]:
            head, gap, data = part.partition(b"\r\n\r\n")
            name = re.search(rb'(?i)content-disposition:[^\r\n]*[; ]name="?([^";\r\n]*)', head)
            if gap and name:
                found[name[1].decode("utf-8", "replace")] = data
        if "file" not in found:
            return None, None, "missing 'file' field"
        return found["file"], found["pages"].decode("utf-8", "replace") if "pages" in found else None, None

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [fields(k, v) for k, v in zip(b.column("content_type").to_pylist(), b.column("body").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], pa.string()), pa.array([g[2] for g in got], pa.string())], ["row", "content", "text", "error"])

    packed = rows.select(F.struct(*rows.columns).alias("row"), "content_type", F.col("body").cast("binary").alias("body"))
    d = packed.mapInArrow(run, f"row {packed.schema['row'].dataType.simpleString()}, content binary, text string, error string")
    pages = F.from_json("text", "array<int>")
    bad = F.col("error").isNull() & (F.trim("text") != "null") & (pages.isNull() | F.exists(pages, lambda v: v.isNull() | (v < 0)))
    error = F.when(F.coalesce(bad, F.lit(False)), "invalid pages").otherwise(F.col("error"))
    d = d.select("row.*", "content", pages.alias("pages"), error.alias("error"))
    return d.withColumn("content", F.when(F.col("error").isNull(), F.col("content"))).withColumn("status", F.when(F.col("error").isNull(), 200).otherwise(400))


def legacy_lines(spark: SparkSession, path: str) -> DataFrame:
    """page, seq, x, y, w, h, text, confidence of result files in the older form: one array of regions a file, numbered by page in their order."""
    d = spark.read.schema(LEGACY).option("multiLine", "true").json(path)
    d = d.withColumn("_i", F.monotonically_increasing_id())
    seq = F.row_number().over(W.partitionBy("page").orderBy("_i")) - 1
    d = d.select(F.col("pageNumber").alias("page"), "x", "y", F.col("width").alias("w"), F.col("height").alias("h"), "text", F.col("textConfidence").alias("confidence"), "_i")
    return d.withColumn("seq", seq).drop("_i")


def page_files(spark: SparkSession, path: str, glob: str = "*.png") -> DataFrame:
    """path, page, content of a folder's page images; the page is the last number in the file's name, null without one.  Order by path for the reference's order."""
    d = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)
    stem = F.regexp_extract(F.col("path"), r"([^/]*)\.[^./]*$", 1)
    number = F.regexp_extract(stem, r"(\d+)\D*$", 1)
    return d.select("path", F.when(number != "", number.cast("int")).alias("page"), "content").orderBy("path")


def first_there(paths: list[str], there: Column, path: Column) -> Column:
    """For ``min_by``: the place of a file among the preferred ones, after all of them for any other, null if it isn't there."""
    rank = F.lit(len(paths))
    for i, p in reversed(list(enumerate(paths))):
        rank = F.when(path == p, F.lit(i)).otherwise(rank)
    return F.when(there, rank)


def result_lines(results: DataFrame) -> DataFrame:
    """page, seq, text, confidence and box of every line of result JSON."""
    p = results.select(F.explode("pages").alias("p")).select(F.col("p.page_index").alias("page"), F.posexplode("p.lines").alias("seq", "l"))
    return p.select("page", "seq", "l.text", "l.confidence", "l.bbox.*")
