"""Page files as a stream, and metrics of a request stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from pagemill.sources import readers


def arriving(spark: SparkSession, folder: str, glob: str | None = None, at_once: int = 1000) -> DataFrame:
    """path, content, kind of files as they come to a folder; at most ``at_once`` a batch."""
    r = spark.readStream.format("binaryFile").option("maxFilesPerTrigger", at_once)
    if glob:
        r = r.option("pathGlobFilter", glob)
    schema = "path string, modificationTime timestamp, length long, content binary"
    return r.schema(schema).load(folder).select("path", "content", readers.kind(F.col("content")).alias("kind"))


def decoded(files: DataFrame, pages: list[int] | None = None) -> DataFrame:
    """Their pages, as ``readers.decode_tiffs`` gives them; bad files are error rows."""
    return readers.decode_tiffs(files, pages)


def request_windows(requests: DataFrame, length: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """start, status, n, mean_ms by window of ``length`` from requests (ts, status, ms); rows later than ``late`` don't count."""
    w = F.window("ts", length)
    g = requests.withWatermark("ts", late).groupBy(w, "status").agg(F.count("*").alias("n"), F.avg("ms").alias("mean_ms"))
    return g.select(F.col("window.start").alias("start"), "status", "n", "mean_ms")


def write(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    """Write all that is there now as Parquet, once; ``checkpoint`` remembers what has been done."""
    return stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
