"""Flat token files, and token counts by scanning them for separators.

A file is a bare run of little-endian 16-bit ids; each document ends with the
end-of-document id and nothing tells where.  Files are read in blocks by
independent tasks: a block's separators are found with one vectorised
comparison.  A prefix scan over a file's blocks (separators before, position
of the last one before) gives each document its number within the file and its
length, also where it lies across any number of blocks.

Defined results: a null text is an empty document of 0 tokens; tokens after
the last separator are a last document; repeated rows are documents of their
own; an empty table makes no file; further columns don't matter.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .pieces import PIECE_BYTES, default_model, load
from .shared import batches, new_path, saved

ID = np.dtype("<u2")
FILE_TOKENS = 32 << 20
BLOCK_TOKENS = 1 << 20


def write_tokens(docs: DataFrame, folder: str, model: str | None = None, file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Encode ``doc_id, text`` into token files; the manifest: path, ordinal, doc_id, one row a document."""
    model = model or default_model()
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root, recursive=True)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = load(model)
        fs, root = pa.fs.FileSystem.from_uri(folder)
        out, name, k, written = None, "", 0, 0
        for batch in batches(it, "text", PIECE_BYTES):
            if out is None or written >= file_tokens:
                if out is not None:
                    out.close()
                name, k, written = f"{uuid.uuid4().hex}.tokens", 0, 0
                out = fs.open_output_stream(f"{root}/{name}", compression=None)
            ids, n = pieces.encode(batch.column("text").to_pylist())
            out.write(ids.astype(ID).tobytes())
            written += len(ids)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name}"] * len(n), pa.string()), pa.array(np.arange(k, k + len(n))), batch.column("doc_id")], ["path", "ordinal", "doc_id"])
            k += len(n)
        if out is not None:
            out.close()

    source = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return saved(source.mapInArrow(run, "path string, ordinal long, doc_id long"), "token-manifest")


def _blocks(block_tokens: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path in batch.column("path").to_pylist():
                fs, name = pa.fs.FileSystem.from_uri(path)
                n = fs.get_file_info(name).size // ID.itemsize
                k = -(-n // block_tokens)
                yield pa.RecordBatch.from_pydict({"path": [path] * k, "block": list(range(k)), "total": [n] * k}, pa.schema([("path", pa.string()), ("block", pa.int64()), ("total", pa.int64())]))

    return run


def _separators(block_tokens: int, end: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for path, block, total in zip(*(batch.column(c).to_pylist() for c in ("path", "block", "total")), strict=True):
                fs, name = pa.fs.FileSystem.from_uri(path)
                first = block * block_tokens
                with fs.open_input_file(name) as f:
                    ids = np.frombuffer(f.read_at(min(block_tokens, total - first) * ID.itemsize, first * ID.itemsize), ID)
                at = np.flatnonzero(ids == end) + first
                if first + len(ids) == total and len(ids) and ids[-1] != end:
                    at = np.append(at, total)  # tokens that no separator ends
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([block], pa.int64()), pa.array([at.tolist()], pa.list_(pa.int64()))], ["path", "block", "at"])

    return run


def count_tokens(files: DataFrame, end: int, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """path, ordinal, n_tokens of every document in the files of column ``path`` (each named once)."""
    blocks = files.select("path").mapInArrow(_blocks(block_tokens), "path string, block long, total long")
    seps = blocks.repartition("path", "block").mapInArrow(_separators(block_tokens, end), "path string, block long, at array<bigint>")
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    scan = seps.withColumn("_base", F.coalesce(F.sum(F.size("at")).over(before), F.lit(0))).withColumn("_last", F.coalesce(F.max(F.try_element_at("at", F.lit(-1))).over(before), F.lit(-1).cast("bigint")))
    # Block by block: ends, and the end before each.
    prior = F.concat(F.array("_last"), F.slice("at", 1, F.greatest(F.size("at") - 1, F.lit(0))))
    each = scan.filter(F.size("at") > 0).select("path", "_base", F.posexplode(F.zip_with("at", prior, lambda a, b: a - b - 1)).alias("_i", "n_tokens"))
    return each.select("path", (F.col("_base") + F.col("_i")).cast("bigint").alias("ordinal"), "n_tokens")


def document_counts(spark: SparkSession, docs: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, n_tokens (without the separator), counted from token files made of ``docs``.

    Manifest and counts both have a row a document: neither is a broadcast, however well it compresses.
    """
    model = model or default_model()
    manifest = write_tokens(docs, new_path(spark, "tokens"), model)
    counts = count_tokens(manifest.select("path").distinct(), load(model).end)
    return manifest.join(counts.hint("merge"), ["path", "ordinal"]).select("doc_id", "n_tokens")
