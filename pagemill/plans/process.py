"""From files to pages of text, with a choice of detectors and recognizers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagemill.functions.lineage import checkpointed
from pagemill.operators import decode, evaluate, raster, regions
from pagemill.sources import readers

#: A backend takes line images (3 x height x width, -1 to 1) of one width and gives for each its scores (steps x classes), or its text and confidence.
Backend = Callable[[list[np.ndarray]], list]
Stage = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Config:
    """What to read with.  ``max_batch`` lines at most go to a backend at once."""

    alphabet: str
    detector: str = "morphological"
    recognizer: str = "onnx"
    detector_path: str | None = None
    recognizer_path: str | None = None
    max_batch: int = 64

    def checked(self) -> Config:
        """Itself, if all that its choices need is there."""
        if self.detector not in DETECTORS:
            raise ValueError(f"no such detector: {self.detector}")
        if self.recognizer not in RECOGNIZERS:
            raise ValueError(f"no such recognizer: {self.recognizer}")
        if self.detector != "morphological" and not self.detector_path:
            raise ValueError(f"detector {self.detector} needs detector_path")
        if self.recognizer == "onnx" and not self.recognizer_path:
            raise ValueError("recognizer onnx needs recognizer_path")
        if not self.alphabet or self.max_batch < 1:
            raise ValueError("an alphabet and a positive max_batch are needed")
        return self


@lru_cache(4)
def _session(path: str):
    import onnxruntime

    return onnxruntime.InferenceSession(path)


def onnx_scores(path: str) -> Callable[[], Backend]:
    """A backend factory for a CTC model file; a worker loads it once."""

    def factory() -> Backend:
        session = _session(path)
        name = session.get_inputs()[0].name
        return lambda lines: list(session.run(None, {name: np.stack(lines)})[0])

    return factory


DETECTORS: dict[str, Callable[[Config], Stage]] = {"morphological": lambda config: raster.detect_pages}
RECOGNIZERS: dict[str, Callable[[Config], Callable[[], Backend]]] = {"onnx": lambda config: onnx_scores(config.recognizer_path)}


def register_detector(name: str, make: Callable[[Config], Stage]) -> None:
    """``make(config)`` gives a stage from pages (page, width, height, channels, data) to components (page, seq, x, y, w, h, n, ang)."""
    DETECTORS[name] = make


def register_recognizer(name: str, make: Callable[[Config], Callable[[], Backend]]) -> None:
    """``make(config)`` gives a factory, called once a task, of a backend."""
    RECOGNIZERS[name] = make


def stages(*steps: Stage) -> Stage:
    """One stage out of several."""

    def run(df: DataFrame) -> DataFrame:
        for step in steps:
            df = df.transform(step)
        return df

    return run


def in_batches(lines: list[np.ndarray], backend: Backend, max_batch: int) -> list:
    """Results in the lines' order; lines of one width go together, ``max_batch`` at most."""
    out: list = [None] * len(lines)
    by: dict[int, list[int]] = {}
    for i, x in enumerate(lines):
        by.setdefault(x.shape[2], []).append(i)
    for same in by.values():
        for at in range(0, len(same), max_batch):
            part = same[at : at + max_batch]
            got = backend([lines[i] for i in part])
            if len(got) != len(part):
                raise ValueError(f"the backend gave {len(got)} results for {len(part)} lines")
            for i, r in zip(part, got, strict=True):
                out[i] = r
    return out


def recognize(pages: DataFrame, found: DataFrame, factory: Callable[[], Backend], max_batch: int = 64) -> DataFrame:
    """page, seq, scores, text, confidence of each region: scores from a backend that gives scores, text and confidence from one that reads.  An empty crop reads as "" with confidence 0."""
    boxes = found.groupBy("page").agg(F.sort_array(F.collect_list(F.struct("seq", *[F.col(k).cast("double").alias(k) for k in "xywh"]))).alias("boxes"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        backend = factory()
        for batch in it:
            for page, w, h, data, regions_ in zip(*(batch.column(c).to_pylist() for c in ("page", "width", "height", "data", "boxes")), strict=True):
                rgb = np.frombuffer(data, np.uint8).reshape(h, w, -1)
                rgb = np.repeat(rgb, 3, axis=2) if rgb.shape[2] == 1 else rgb[..., :3]
                live = [b for b in regions_ if min(b["x"] + b["w"], w) > max(b["x"], 0) and min(b["y"] + b["h"], h) > max(b["y"], 0)]
                got = in_batches([raster.crop_line(rgb, b["x"], b["y"], b["w"], b["h"]) for b in live], backend, max_batch)
                read = {b["seq"]: r for b, r in zip(live, got, strict=True)}
                rows = [read.get(b["seq"], ("", 0.0)) for b in regions_]
                text = [r if isinstance(r, tuple) else (None, None) for r in rows]
                scores = [None if isinstance(r, tuple) else np.asarray(r, float).tolist() for r in rows]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([page] * len(rows), pa.int64()), pa.array([b["seq"] for b in regions_], pa.int64()), pa.array(scores, pa.list_(pa.list_(pa.float64()))), pa.array([t[0] for t in text], pa.string()), pa.array([t[1] for t in text], pa.float64())],
                    ["page", "seq", "scores", "text", "confidence"],
                )

    return pages.join(boxes, "page").select("page", "width", "height", "data", "boxes").mapInArrow(run, "page long, seq long, scores array<array<double>>, text string, confidence double")


def lines_of(read: DataFrame, alphabet: str) -> DataFrame:
    """page, seq, text, confidence: scores decoded, late fragments and outer spaces cut; what a backend has read itself stays."""
    scored = decode.decoded(read.filter("scores is not null").withColumn("steps", F.transform("scores", decode.softmax_argmax)).drop("text", "confidence"))
    scored = scored.withColumn("text", decode.text_of(F.col("tokens"), alphabet))
    scored = decode.strip_spaces(decode.trim_trailing(scored)).select("page", "seq", "text", "confidence")
    return scored.unionByName(read.filter("scores is null").select("page", "seq", F.trim("text").alias("text"), "confidence"))


def process(files: DataFrame, config: Config, pages: list[int] | None = None) -> DataFrame:
    """path, page_index, text, n_lines, confidence, error: every page of the files (path, content); unreadable files are rows with an error."""
    config.checked()
    decoded = checkpointed(readers.decode_tiffs(files, pages).withColumn("page", F.monotonically_increasing_id()))
    good = decoded.filter("error is null")
    found = DETECTORS[config.detector](config)(good.select("page", "width", "height", "channels", "data"))
    found = regions.filter_and_cluster(found.join(good.select("page", F.col("width").alias("page_w"), F.col("height").alias("page_h")), "page"))
    read = lines_of(recognize(good, found, RECOGNIZERS[config.recognizer](config), config.max_batch), config.alphabet)
    text = evaluate.assemble(read.join(found.select("page", "seq", "ord"), ["page", "seq"]).select("page", F.col("ord").alias("seq"), "text", "confidence"), good.select("page"))
    names = decoded.select("page", "path", "page_index", "error")
    return names.join(text, "page", "left").select("path", "page_index", "text", "n_lines", "confidence", "error")
