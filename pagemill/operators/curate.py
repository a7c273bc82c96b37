"""Data-set operators: charset policies, splits, oversampling, skip reasons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from pagemill.functions.lineage import checkpointed

#: Rows that one bucket of an exact order should hold.
BUCKET_ROWS = 200_000


def strip_charset(text: Column, allowed: str) -> Column:
    """Delete what isn't in the regular-expression class ``allowed``."""
    return F.regexp_replace(text, f"[^{allowed}]", "")


def in_charset(text: Column, allowed: str) -> Column:
    return ~text.rlike(f"[^{allowed}]")


def skip_reason(has_image: Column, text: Column, allowed: str, most: int = 100) -> Column:
    """missing, charset, length, or null for rows to keep; the first that holds."""
    return F.when(~has_image, "missing").when(~in_charset(text, allowed), "charset").when(~F.length(text).between(1, most), "length")


def place_in(df: DataFrame, bucket: str, order: list[str]) -> DataFrame:
    """``n``: 1-based number over all rows, by ascending ``bucket`` and the order within it; no task sees more than a bucket."""
    counts = df.groupBy(bucket).agg(F.count("*").alias("_c"))
    base = counts.select(bucket, (F.sum("_c").over(W.partitionBy(F.lit(0)).orderBy(bucket)) - F.col("_c")).alias("_b"))  # a row a bucket
    at = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return df.withColumn("_at", at).join(base, bucket).withColumn("n", (F.col("_at") + F.col("_b")).cast("bigint")).drop("_at", "_b", bucket)


def positions(df: DataFrame, order: list[str], rows: int = BUCKET_ROWS) -> DataFrame:
    """``n``: each row's 1-based place in the order given.

    A row's number is its place in its range partition plus the rows of the
    partitions before.  The partitions are written down once: their sampled
    bounds would differ between one look at them and the next.
    """
    parts = max(8, -(-df.count() // rows))
    return place_in(checkpointed(df.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id())), "_p", order)


def ordered_split(df: DataFrame, key: str, seed: str, val: int = 5, test: int = 5) -> DataFrame:
    """``split``: exact percentages in the order of md5(key, seed), train first; in buckets of the hash's first digits, as many as the rows need."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    total = df.count()
    digits = next(k for k in range(1, 33) if total <= BUCKET_ROWS * 16**k)
    d = place_in(df.withColumn("_h", h).withColumn("_bucket", F.substring("_h", 1, digits)), "_bucket", ["_h", key])
    n_val, n_test = total * val // 100, total * test // 100
    n_train = total - n_val - n_test
    return d.withColumn("split", F.when(F.col("n") <= n_train, "train").when(F.col("n") <= n_train + n_val, "val").otherwise("test")).drop("_h", "n")


def oversample(auto: DataFrame, verified: DataFrame, times: int = 4) -> DataFrame:
    return auto.unionByName(verified.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_k"))


def sample_mix(df: DataFrame, key: str, shares: dict[str, float], by: str) -> DataFrame:
    """Keep each class's share of its rows, chosen by hashed key."""
    u = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 8), 16, 10).cast("bigint") / float(1 << 32)
    keep = F.lit(False)
    for name, share in shares.items():
        keep = keep | ((F.col(by) == name) & (u < share))
    return df.filter(keep)


def page_set(text: Column) -> Column:
    """The whole numbers of a comma-separated list; what isn't one is left out."""
    parts = F.transform(F.split(text, ","), lambda t: F.try_to_number(F.trim(t), F.lit("999999999")).cast("int"))
    return F.filter(parts, lambda v: v.isNotNull())


def all_confident(confidences: Column, least: float) -> Column:
    """Whether no confidence lies under ``least``; true for none."""
    return F.forall(confidences, lambda v: v >= least)


def review_route(confidence: Column, accept: float = 0.95, flag: float = 0.7) -> Column:
    """accept, flag or review."""
    return F.when(confidence > accept, "accept").when(confidence >= flag, "flag").otherwise("review")


def without_errors(df: DataFrame, error: str = "error") -> DataFrame:
    return df.filter(F.col(error).isNull())


def with_files(df: DataFrame, files: DataFrame, key: str) -> DataFrame:
    """Rows whose ``key`` is among the files'."""
    return df.join(files.select(key), key, "left_semi")


def seeded_order(df: DataFrame, key: str, seed: str, n: int) -> DataFrame:
    """The first ``n`` rows in the order of md5(key, seed)."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(seed)).cast("binary"))
    return df.withColumn("_h", h).orderBy("_h", key).limit(n).drop("_h")


#: What the second text shows the first to have misread (fixed values): contained in the first, contained in the second (any case if lower), reason.  The last row holds for any second text.
ERROR_PATTERNS = [
    (("O84",), "084", "O vs 0"),
    (("5356300",), "556500", "wrong org.nr"),
    (("Reseryv",), "Reserv", "typo"),
    (("Icasing",), "leasing", "I vs l"),
    (("f2 14", "12-75", "12- /4"), None, "wrong date"),
]


def known_error(text: Column, other: Column, patterns=ERROR_PATTERNS) -> Column:
    """The first pattern's reason that fits two different texts; null for none."""
    reason = F.lit(None).cast("string")
    for found, instead, name in reversed(patterns):
        here = F.lit(False)
        for x in found:
            here = here | F.contains(text, F.lit(x))
        there = F.lit(True) if instead is None else F.contains(F.lower(other) if instead == "leasing" else other, F.lit(instead))
        reason = F.when(here & there, F.lit(name)).otherwise(reason)
    return F.when(text != other, reason)
