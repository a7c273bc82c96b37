"""Views of document-OCR data derived from the driver's tables: for Spark, and as DuckDB common table expressions."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

c = F.col


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def lines(spark: SparkSession, sf: str) -> DataFrame:
    d = table(spark, sf, "documents").select(c("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return d.filter(F.trim("line") != "").withColumn("seq", c("seq").cast("bigint"))


def regions(spark: SparkSession, sf: str) -> DataFrame:
    p, s = c("page"), c("seq")
    div = lambda a, n: F.floor(a / n).cast("bigint")
    return lines(spark, sf).select(
        "page", "seq",
        (60 + (37 * p + 53 * s) % 1900).alias("x"),
        (80 + 58 * div(s, 2) + (11 * p + 17 * s) % 29 + 90 * div(s, 8)).alias("y"),
        (12 + F.least(3 * F.length("line"), F.lit(700))).cast("bigint").alias("w"),
        (18 + (5 * s + p) % 22).alias("h"),
        F.when((p + s) % 9 == 0, (13 * p + 31 * s) % 180).otherwise(s % 4).alias("ang"),
        F.length("line").cast("bigint").alias("len"),
    )


def jitter(spark: SparkSession, sf: str) -> DataFrame:
    return regions(spark, sf).filter("seq % 11 <> 10").withColumns({"x": c("x") + c("seq") % 7 - 3, "y": c("y") + c("seq") % 5 - 2})


def _hyp(k):
    line = c("ref")
    return F.when(k == 0, line).when(k == 1, F.replace(line, F.lit(" "), F.lit(""))).when(k == 2, F.lower(line)).when(k == 3, F.replace(line, F.lit("e"), F.lit("c"))).otherwise(F.concat(F.lit("x "), F.substring(line, 2, 41)))


def pairs(spark: SparkSession, sf: str) -> DataFrame:
    d = lines(spark, sf).withColumnRenamed("line", "ref")
    return d.withColumn("hyp", _hyp((c("page") + c("seq")) % 5))


def triples(spark: SparkSession, sf: str) -> DataFrame:
    d = pairs(spark, sf)
    return d.select("page", "seq", c("hyp").alias("a"), _hyp((c("page") + c("seq") + 1) % 5).alias("b"), c("ref").alias("v"))


def logits(spark: SparkSession, sf: str) -> DataFrame:
    """vec_id, scores: 16 steps of 4 classes."""
    e = table(spark, sf, "embeddings")
    return e.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda t: F.transform(F.slice("embedding", t * 4 + 1, F.lit(4)), lambda v: v.cast("double"))).alias("scores"))


def raster(spark: SparkSession) -> DataFrame:
    """Twenty pages of 24 x 32 RGB pixels: page, width, height, channels, data."""
    v = lambda i: (3 * (i % 32) * (i % 32) + 5 * F.floor(i / 32) * F.floor(i / 32) + 7 * (i % 32) * F.floor(i / 32) + 31 * c("page")) % 256
    px = F.transform(F.sequence(F.lit(0), F.lit(767)), lambda i: F.concat(*[F.lpad(F.hex((v(i) + k) % 256), 2, "0") for k in (0, 85, 170)]))
    return spark.range(20).withColumnRenamed("id", "page").select("page", F.lit(32).alias("width"), F.lit(24).alias("height"), F.lit(3).alias("channels"), F.unhex(F.array_join(px, "")).alias("data"))


V_LINES = """lines AS (
  SELECT doc_id AS page, CAST(i AS BIGINT) AS seq, parts[i + 1] AS line
  FROM (SELECT doc_id, string_split(text, chr(10)) AS parts, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents)
  WHERE trim(parts[i + 1]) <> '')"""
V_REGIONS = f"""{V_LINES}, regions AS (
  SELECT page, seq, 60 + (37 * page + 53 * seq) % 1900 AS x, 80 + 58 * (seq // 2) + (11 * page + 17 * seq) % 29 + 90 * (seq // 8) AS y,
    12 + least(3 * length(line), 700) AS w, 18 + (5 * seq + page) % 22 AS h,
    CASE WHEN (page + seq) % 9 = 0 THEN (13 * page + 31 * seq) % 180 ELSE seq % 4 END AS ang, length(line) AS len FROM lines)"""
V_JITTER = f"""{V_REGIONS}, jitter AS (
  SELECT page, seq, x + seq % 7 - 3 AS x, y + seq % 5 - 2 AS y, w, h, ang, len FROM regions WHERE seq % 11 <> 10)"""


#: Characters of one byte that no text has: DuckDB's distance counts bytes, so that others are put in their place.
_FREE = "".join(map(chr, [*range(1, 9), 11, 12, *range(14, 32)]))


def by_characters(sql: str) -> str:
    """``sql`` with its distances taken in characters: those beyond ASCII (28 different ones at most) stand as one byte each."""
    free = " || ".join(f"chr({ord(x)})" for x in _FREE)
    one = lambda x: f"translate({x}, (SELECT s FROM beyond), {free})"
    return re.sub(r"levenshtein\((\w+), (\w+)\)", lambda m: f"levenshtein({one(m[1])}, {one(m[2])})", sql)


def _sql_hyp(k: str) -> str:
    return f"CASE {k} WHEN 0 THEN ref WHEN 1 THEN replace(ref, ' ', '') WHEN 2 THEN lower(ref) WHEN 3 THEN replace(ref, 'e', 'c') ELSE 'x ' || substr(ref, 2, 41) END"


V_PAIRS = f"""{V_LINES}, beyond AS (
  SELECT coalesce(string_agg(ch, ''), '') AS s FROM (SELECT DISTINCT unnest(string_split(regexp_replace(text, '[\\x00-\\x7F]', '', 'g'), '')) AS ch FROM documents)), pairs AS (
  SELECT *, {_sql_hyp('((page + seq) % 5)')} AS hyp FROM (SELECT page, seq, line AS ref FROM lines))"""
V_TRIPLES = f"""{V_PAIRS}, triples AS (SELECT page, seq, hyp AS a, {_sql_hyp('((page + seq + 1) % 5)')} AS b, ref AS v FROM pairs)"""
V_STEPS = """scores AS (
  SELECT vec_id, t, list_transform(range(0, 4), lambda k: CAST(embedding[CAST(4 * t + k + 1 AS INTEGER)] AS DOUBLE)) AS s FROM (SELECT vec_id, embedding, unnest(range(0, 16)) AS t FROM embeddings)),
tops AS (SELECT vec_id, t, s, list_max(s) AS m FROM scores),
steps AS (SELECT vec_id, t, CAST(list_position(s, m) - 1 AS BIGINT) AS idx, 1 / list_sum(list_transform(s, lambda v: exp(v - m))) AS p FROM tops),
marked AS (SELECT *, lag(idx) OVER (PARTITION BY vec_id ORDER BY t) AS prev FROM steps),
emitted AS (SELECT vec_id, t AS pos, idx - 1 AS token, p, CAST(row_number() OVER (PARTITION BY vec_id ORDER BY t) - 1 AS BIGINT) AS k FROM marked WHERE idx <> 0 AND idx IS DISTINCT FROM prev)"""
V_RASTER = """px AS (
  SELECT page, y, x, (3 * x * x + 5 * y * y + 7 * x * y + 31 * page) % 256 AS r FROM range(0, 20) p(page), range(0, 24) q(y), range(0, 32) s(x)),
gray AS (SELECT page, y, x, (77 * r + 150 * ((r + 85) % 256) + 29 * ((r + 170) % 256)) >> 8 AS v FROM px)"""
