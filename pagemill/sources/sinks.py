"""Sinks: page text, JSON, JSON lines, TSV, splits, keyed corpora."""

from __future__ import annotations

import base64
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagemill.functions import text as T
from pagemill.operators.curate import positions


def page_text(pages: DataFrame, doc: str = "doc") -> DataFrame:
    """One text a document: pages under ``--- Page N ---`` lines where there is more than one."""
    many = F.count("*").over(W.partitionBy(doc)) > 1
    part = F.when(many, F.concat(F.lit("--- Page "), F.col("page") + 1, F.lit(" ---\n"), F.col("text"))).otherwise(F.col("text"))
    one = pages.withColumn("_t", part).groupBy(doc).agg(F.array_sort(F.collect_list(F.struct("page", "_t"))).alias("_p"))
    return one.select(doc, F.array_join(F.transform("_p", lambda p: p["_t"]), "\n").alias("text"))


def line_struct(conf: Column) -> Column:
    """``char_confidences`` for JSON: left out when empty."""
    return F.when(F.size(conf) > 0, conf)


def write_results(pages: DataFrame, fmt: str, path: str) -> None:
    """Write pages as ``text``, ``json`` (one array a file), ``jsonl`` or ``tsv``."""
    w = pages.write.mode("errorifexists")
    if fmt == "text":
        page_text(pages).select("text").write.text(path)
    elif fmt == "json":
        pages.select(F.to_json(F.struct(*pages.columns), {"pretty": "true"}).alias("value")).write.text(path)
    elif fmt == "jsonl":
        w.json(path)
    elif fmt == "tsv":
        w.option("sep", "\t").option("header", "true").option("quote", "").csv(path)
    else:
        raise ValueError(f"no such format: {fmt}")


def write_split(df: DataFrame, path: str) -> None:
    df.write.partitionBy("split").parquet(path)


def numbered(df: DataFrame, order: list[str]) -> DataFrame:
    """``n``, ``image-%09d`` and ``label-%09d`` keys, 1-based in the order given."""
    return positions(df, order).withColumns({"image_key": F.format_string("image-%09d", "n"), "label_key": F.format_string("label-%09d", "n")})


def envelope(pages: DataFrame, timing: DataFrame) -> DataFrame:
    """doc, value: ``{"pages": [...], "timing": {...}}`` of each document, indented; pages has doc, page_index, text, lines, confidence, timing doc and the times."""
    fields = [c for c in pages.columns if c != "doc"]
    all_pages = pages.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("pages"))
    t = timing.select("doc", F.struct(*[c for c in timing.columns if c != "doc"]).alias("timing"))
    return all_pages.join(t, "doc", "left").select("doc", F.to_json(F.struct("pages", "timing"), {"pretty": "true"}).alias("value"))


def timing_line(t: str = "timing") -> Column:
    """The times in one line of text, in milliseconds."""
    part = lambda name, k: F.concat(F.lit(f"{name}: "), F.format_string("%.1fms", F.col(f"{t}.{k}")))
    return F.concat_ws(" | ", part("total", "total_ms"), part("decode", "decode_ms"), part("preprocess", "preprocess_ms"), part("detect", "detect_ms"), part("recognize", "recognize_ms"))


def write_evaluation(pairs: DataFrame, metrics: DataFrame, path: str, worst: int = 50) -> None:
    """``metrics`` (one JSON row), ``predictions`` (true, pred, cer, correct; tab-separated) and ``worst`` (the ``worst`` rows of greatest cer, stable) under ``path``."""
    rows = pairs.select(F.col("ref").alias("true"), F.col("hyp").alias("pred"), T.evaluator_cer(F.col("ref"), F.col("hyp")).alias("cer"), (F.col("ref") == F.col("hyp")).alias("correct"), "page", "seq")
    tsv = lambda df, name: df.select("true", "pred", "cer", "correct").write.option("sep", "\t").option("header", "true").csv(f"{path}/{name}")
    metrics.coalesce(1).write.json(f"{path}/metrics")
    tsv(rows, "predictions")
    tsv(rows.orderBy(F.desc("cer"), "page", "seq").limit(worst).coalesce(1), "worst")


def write_report(summary: DataFrame, regions: DataFrame, path: str) -> None:
    """A comparison's ``summary`` (one JSON row) and ``regions`` (JSON lines) under ``path``."""
    summary.coalesce(1).write.json(f"{path}/summary")
    regions.write.json(f"{path}/regions")


def png(rgb: np.ndarray) -> bytes:
    """An 8-bit RGB PNG."""
    h, w = rgb.shape[:2]
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    raw = np.concatenate([np.zeros((h, 1), np.uint8), np.ascontiguousarray(rgb, np.uint8).reshape(h, -1)], axis=1)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw.tobytes())) + chunk(b"IEND", b"")


def crops(pages: DataFrame, regions: DataFrame) -> DataFrame:
    """page, seq, png (base64) of each region, cut from its page's RGB raster and clamped to it; null for nothing left."""
    boxes = regions.groupBy("page").agg(F.collect_list(F.struct("seq", *[F.col(k).cast("double").alias(k) for k in "xywh"])).alias("boxes"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for page, w, h, data, found in zip(*(batch.column(c).to_pylist() for c in ("page", "width", "height", "data", "boxes")), strict=True):
                img, out = np.frombuffer(data, np.uint8).reshape(h, w, 3), []
                for b in found:
                    x0, y0, x1, y1 = (int(min(max(v, 0), top)) for v, top in ((b["x"], w), (b["y"], h), (b["x"] + b["w"], w), (b["y"] + b["h"], h)))
                    out.append(base64.b64encode(png(img[y0:y1, x0:x1])).decode() if x1 > x0 and y1 > y0 else None)
                yield pa.RecordBatch.from_arrays([pa.array([page] * len(out), pa.int64()), pa.array([b["seq"] for b in found], pa.int64()), pa.array(out, pa.string())], ["page", "seq", "png"])

    return pages.join(boxes, "page").select("page", "width", "height", "data", "boxes").mapInArrow(run, "page long, seq long, png string")
