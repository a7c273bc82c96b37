"""URL rules behind a blocked Bloom filter.

A rule is (host, path, verdict) and fits its host and all subdomains where the
url's path starts with the rule's path; the longest fitting rule wins.  A url
is looked up by its canonical keys: every suffix of its host's labels joined
with every prefix of its path as long as some rule's path.  A blocked Bloom
filter (one 64-bit word a block, four bits a key) over the rules' keys drops
nearly all keys that no rule has; what passes meets the rules in an exact hash
join, which removes false positives.  Only DataFrame functions are used.

Equal urls are judged once; a page's row waits outside and meets its url's rule
at the end.  Filter and rules are broadcast only when their counted size is
within ``BROADCAST_BYTES``; else distinct keys, not urls, meet them in ordinary
equi-joins (a key like ``com/`` that most urls have arrives once from each
task), and what is found joins the urls by key, where the rules' side has a row
a key and Spark can split a hot one.

Defined results: null urls and urls without ``://`` have an empty host and
path and get the default verdict; repeated rows are each given the
verdict of their url; of rules with the same host and path
"block" wins; rules with a null host, path or verdict are left out; an empty
table gives an empty table; further columns don't matter.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BITS_A_KEY = 16
BROADCAST_BYTES = 4 << 20

#: host, path, verdict (fixed values).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "host string, path string, verdict string")


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), string.ascii_uppercase, string.ascii_lowercase)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def _hashed(df: DataFrame, key: str, blocks: int) -> DataFrame:
    """With ``_block`` and ``_mask`` of the key: the block's number, and four bits of a 64-bit word."""
    bit = "shiftleft(1L, cast(shiftrightunsigned(_h, {}) & 63 as int))"
    mask = F.expr(" | ".join(bit.format(6 * k) for k in range(4)))
    return df.withColumn("_h", F.xxhash64(F.col(key), F.lit(1))).withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks))).withColumn("_mask", mask).drop("_h")


def bloom(rules: DataFrame, blocks: int) -> DataFrame:
    """_block, _word: the filter's words that have a bit."""
    return _hashed(rules.select("_rule"), "_rule", blocks).groupBy("_block").agg(F.bit_or("_mask").alias("_word"))


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """page_id, host, path, rule, verdict for every row of ``pages``."""
    known = rules.filter("host is not null and path is not null and verdict is not null")
    known = known.groupBy("host", "path").agg(F.max(F.struct(F.col("verdict") == "block", "verdict"))["verdict"].alias("verdict"))
    known = known.select(F.concat("host", F.lit("\n"), "path").alias("_rule"), F.concat("host", "path").alias("rule"), "verdict", F.length("host").alias("_hl"), F.length("path").alias("_pl"))
    n, size, lengths = known.agg(F.count("*"), F.coalesce(F.sum(F.length("_rule")), F.lit(0)), F.collect_set("_pl")).first()  # as many lengths as paths have, a few thousand at most
    blocks = max(1, -(-n * BITS_A_KEY // 64))
    small = 2 * size + 64 * n <= BROADCAST_BYTES
    host, path = host_and_path(F.col("url"))
    p = pages.filter("url is not null").select("url").distinct().withColumns({"host": host, "path": path}).filter("host <> ''")
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    lens = F.filter(F.array(*[F.lit(x) for x in sorted(lengths)]).cast("array<int>"), lambda x: x <= F.length("path"))
    prefixes = F.transform(lens, lambda x: F.substring(F.col("path"), F.lit(1), x))
    keys = F.flatten(F.transform(suffixes, lambda s: F.transform(prefixes, lambda q: F.concat(s, F.lit("\n"), q))))
    each = p.select("url", F.explode(keys).alias("_key"))
    passes = F.col("_word").bitwiseAND(F.col("_mask")) == F.col("_mask")
    if small:
        possible = _hashed(each, "_key", blocks).join(F.broadcast(bloom(known, blocks)), "_block").filter(passes)
        hits = possible.join(F.broadcast(known), F.col("_key") == F.col("_rule"))
    else:
        possible = _hashed(each.select("_key").distinct(), "_key", blocks).join(bloom(known, blocks), "_block").filter(passes)
        hits = each.join(possible.select("_key").join(known, F.col("_key") == F.col("_rule")), "_key")
    best = hits.groupBy("url").agg(F.max(F.struct((F.col("_hl") + F.col("_pl")).alias("n"), "_hl", "rule", "verdict")).alias("_best"))
    out = pages.select("page_id", "url").join(best, "url", "left")
    return out.select("page_id", host.alias("host"), path.alias("path"), F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


_CASES = ",\n    ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)
ORACLE = rf"""
WITH rules(rh, rp, rv) AS (VALUES
    {_CASES}),
parts AS (
  SELECT page_id, url, CASE WHEN strpos(coalesce(url, ''), '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
hp AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)', 1), '{string.ascii_uppercase}', '{string.ascii_lowercase}') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM parts),
fit AS (
  SELECT page_id, rh || rp AS rule, rv, row_number() OVER (PARTITION BY page_id ORDER BY length(rh || rp) DESC, length(rh) DESC) AS k
  FROM hp JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp))
SELECT hp.page_id, host, path, rule, coalesce(rv, 'allow') AS verdict FROM hp LEFT JOIN fit ON hp.page_id = fit.page_id AND k = 1
"""
