"""Mixing sources to target weights, in fixed-length blocks.

Every source's documents form one stream of words, cut into blocks of
``block`` words.  A source's target, divided by its mean block, is the number
of output slots that it should get.  Output shards have SHARD slots each, and a
shard's counts by source are a multinomial draw with those numbers as weights:
every slot draws its source.  Counts become running offsets by source: a shard
takes the next positions of each source's stream.  A position stands for a
block through the source's keyed pseudorandom permutation, epoch after epoch,
and meets the documents in an equi-join on (source, block index).

A source that drew more than it should leaves out as many positions, evenly
spread over what it drew; one that drew too few gets the next positions in
shards at the end.  No position lies beyond the second epoch.

The permutations are swap-or-not shuffles: for any size, without tables,
without sorting a source.  Only DataFrame functions are used.

Defined results: a null text has size 0 and is taken 0 times; null sources are
one source, last in order; repeated rows are documents of their own (rows alike in every
column are interchangeable); an empty table gives an empty table; further
columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .shared import saved, words

WEIGHTS = (3, 1, 2)
BUDGET, CAP = 1.5, 2.0
BLOCK, SHARD = 64, 1024
ROUNDS = 12
#: A join side of at most so many rows (of a few dozen bytes) may be broadcast.
BROADCAST_ROWS = 10_000
PIECE = 4096
#: Bins of [0, 1) through which a slot's draw finds its source; buckets of documents; and buckets or shards whose sums are added up together.
BINS, BUCKET, SPAN = 4096, 500, 1024


def permuted(x: Column, size: Column, *key: Column) -> Column:
    """A keyed permutation of 0 .. size - 1 applied to ``x``: swap-or-not, ROUNDS rounds."""

    def step(acc: Column, r: Column) -> Column:
        other = F.pmod(F.pmod(F.xxhash64(F.lit("k"), r, *key), size) - acc, size)
        return F.when(F.pmod(F.xxhash64(F.lit("b"), r, F.greatest(acc, other), *key), F.lit(2)) == 0, acc).otherwise(other)

    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), x.cast("bigint"), step)


def targets(sized: DataFrame) -> DataFrame:
    """source, source_idx, source_size, target: one row a source.

    ``level * weight`` words each, at most CAP times the source: the level at
    which the targets add up to the budget is where resharing ends.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.partitionBy(F.lit(0))  # a row a source
    rank = F.row_number().over(everything.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (F.pmod(F.col("source_idx"), F.lit(len(WEIGHTS))) + 1).cast("int")).cast("double")
    t = sums.withColumn("source_idx", rank).withColumn("_w", weight).withColumn("_full", CAP * F.col("source_size")).withColumn("_at", F.col("_full") / F.col("_w"))
    filled = everything.orderBy("_at", "source_idx")
    before = filled.rowsBetween(W.unboundedPreceding, -1)
    t = t.withColumn("_budget", BUDGET * F.sum("source_size").over(everything))
    t = t.withColumn("_level", (F.col("_budget") - F.coalesce(F.sum("_full").over(before), F.lit(0.0))) / F.sum("_w").over(filled.rowsBetween(0, W.unboundedFollowing)))
    # Sources fill up in the order of _at; the first that its level doesn't fill fixes the level of all after it.
    level = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "source_idx", "_level"))).over(everything)["_level"]
    t = t.withColumn("_final", level)
    return t.select("source", "source_idx", "source_size", F.when(F.col("_final").isNull(), F.col("_full")).otherwise(F.least("_full", F.col("_final") * F.col("_w"))).alias("target"))


def _running(sums: DataFrame, at: str, n: str) -> DataFrame:
    """``sums`` (source_idx, ``at``, ``n``; one row each) with ``_before``: the sum of the source's rows with smaller ``at``.

    Sums over stretches of SPAN come first, so that no task goes through a source.
    """
    s = sums.withColumn("_span", F.floor(F.col(at) / SPAN))
    spans = s.groupBy("source_idx", "_span").agg(F.sum(n).alias("_sum"))
    spans = spans.withColumn("_base", F.sum("_sum").over(W.partitionBy("source_idx").orderBy("_span")) - F.col("_sum")).drop("_sum")
    inner = F.sum(n).over(W.partitionBy("source_idx", "_span").orderBy(at).rowsBetween(W.unboundedPreceding, 0)) - F.col(n)
    return s.withColumn("_in", inner).join(spans, ["source_idx", "_span"]).withColumn("_before", F.col("_base") + F.col("_in")).drop("_span", "_base", "_in")


def _placed(sized: DataFrame, sources: DataFrame, n_docs: int, few: bool) -> DataFrame:
    """Each row of ``sized`` (_id, doc_id, source, size, _h) with its offset in its source's stream: by buckets, then within one."""
    buckets = max(1, n_docs // BUCKET)
    right = F.broadcast(sources) if few else sources
    d = sized.join(right.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    d = d.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "size", "_h"), F.lit(buckets)))
    base = _running(d.groupBy("source_idx", "_bucket").agg(F.sum("size").alias("_sum")), "_bucket", "_sum").drop("_sum")
    inner = W.partitionBy("source_idx", "_bucket").orderBy("doc_id", "size", "_h", "_id").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("_off", F.sum("size").over(inner) - F.col("size")).join(base, ["source_idx", "_bucket"]).withColumn("_off", F.col("_off") + F.col("_before")).drop("_bucket", "_before")


def shares(sources: DataFrame, block: int) -> DataFrame:
    """source_idx, _blocks, _n: of each source with words the number of its blocks, and of the slots that it should get; ``_lo`` and ``_hi``: its part of [0, 1); ``_all`` slots."""
    every = W.partitionBy(F.lit(0)).orderBy("source_idx")  # a row a source
    s = sources.filter("source_size > 0").withColumn("_blocks", F.ceil(F.col("source_size") / block))
    s = s.withColumn("_n", F.least(F.round(F.col("target") * F.col("_blocks") / F.col("source_size")).cast("bigint"), (F.lit(int(CAP)) * F.col("_blocks")).cast("bigint"))).filter("_n > 0")
    s = s.withColumn("_sum", F.sum("_n").over(every)).withColumn("_all", F.sum("_n").over(W.partitionBy(F.lit(0))))
    return s.select("source_idx", "_blocks", "_n", "_all", ((F.col("_sum") - F.col("_n")) / F.col("_all")).alias("_lo"), (F.col("_sum") / F.col("_all")).alias("_hi"))


def draws(spark: SparkSession, parts: DataFrame, few: bool, seed: int) -> DataFrame:
    """shard, source_idx, n: how many slots of each output shard drew each source."""
    total = parts.agg(F.coalesce(F.max("_all"), F.lit(0))).first()[0]
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = spark.range(0, -(-total // SHARD), 1, tasks).withColumnRenamed("id", "shard")
    last = F.least(F.lit(SHARD), F.lit(total) - F.col("shard") * SHARD).cast("int") - 1
    slot = shards.withColumn("_t", F.explode(F.sequence(F.lit(0), last)))
    slot = slot.withColumn("_u", F.shiftrightunsigned(F.xxhash64(F.lit("draw"), F.lit(seed), "shard", "_t"), 11) / float(1 << 53)).withColumn("_bin", F.floor(F.col("_u") * BINS))
    binned = parts.withColumn("_bin", F.explode(F.sequence(F.floor(F.col("_lo") * BINS), F.least(F.floor(F.col("_hi") * BINS), F.lit(BINS - 1).cast("bigint")))))
    binned = binned.select("_bin", "source_idx", "_lo", "_hi")
    hit = slot.join(F.broadcast(binned) if few else binned, "_bin").filter((F.col("_u") >= F.col("_lo")) & (F.col("_u") < F.col("_hi")))
    return hit.groupBy("shard", "source_idx").agg(F.count("*").alias("n"))


def slots(sources: DataFrame, block: int = BLOCK, seed: int = 7, few: bool = False) -> DataFrame:
    """The mix itself: source_idx, block, epoch, shard; one row an output block."""
    spark = sources.sparkSession
    parts = saved(shares(sources, block), "mix-shares")
    side = F.broadcast if few else (lambda df: df)
    drawn = saved(_running(draws(spark, parts, few, seed), "shard", "n"), "mix-draws")
    totals = drawn.groupBy("source_idx").agg(F.sum("n").alias("_drawn"), F.max("shard").alias("_last"))
    goal = parts.join(totals, "source_idx", "left").withColumns({"_drawn": F.coalesce("_drawn", F.lit(0)), "_last": F.coalesce("_last", F.lit(-1))})
    goal = saved(goal.select("source_idx", "_blocks", "_n", "_drawn", "_last"), "mix-goals")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    span = drawn.select("source_idx", "shard", F.col("_before").alias("_a"), (F.col("_before") + F.col("n")).alias("_b"))
    # What is missing: the positions after the last one drawn.
    more = goal.filter("_drawn < _n").withColumn("_k", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_n") - F.col("_drawn") - 1) / PIECE))))
    more = more.select("source_idx", (F.col("_last") + 1 + F.col("_k")).alias("shard"), (F.col("_drawn") + F.col("_k") * PIECE).alias("_a"), F.least(F.col("_drawn") + (F.col("_k") + 1) * PIECE, F.col("_n")).alias("_b"))
    each = span.unionByName(more).repartition(tasks, "source_idx", "shard")  # a fixed count: few rows, but each makes SHARD or PIECE slots
    each = each.join(side(goal), "source_idx").withColumn("_all", F.least(F.col("_drawn"), F.lit(int(CAP)) * F.col("_blocks")))
    each = each.withColumn("_b", F.least("_b", F.lit(int(CAP)) * F.col("_blocks"))).filter("_a < _b").withColumn("_over", F.greatest(F.col("_all") - F.col("_n"), F.lit(0)))
    each = each.withColumn("_j", F.explode(F.sequence(F.col("_a"), F.col("_b") - 1)))
    # Of what was drawn beyond the goal as many positions are left out: those at which j * over / all steps up.
    each = each.filter((F.col("_over") == 0) | (F.expr("(_j + 1) * _over div _all") == F.expr("_j * _over div _all")))
    return each.select(
        "source_idx",
        permuted(F.pmod("_j", F.col("_blocks")), F.col("_blocks"), F.lit(seed), F.col("source_idx")).alias("block"),
        F.floor(F.col("_j") / F.col("_blocks")).alias("epoch"),
        "shard",
    )


def _plan(sized: DataFrame, block: int, seed: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both sides of the join on (source, block) grow with the input: it is never a broadcast.

    sources, placed documents, and parts: one row for each document, block and epoch taken, with the words [_from, _from + _len) of the document.
    """
    sources = saved(targets(sized), "mix-sources")
    few = sources.count() <= BROADCAST_ROWS
    placed = _placed(sized, sources, sized.count(), few)
    spans = placed.filter("size > 0").select("source_idx", "_id", "_off", "size", F.explode(F.sequence(F.floor(F.col("_off") / block), F.floor((F.col("_off") + F.col("size") - 1) / block))).alias("block"))
    lo = F.greatest(F.col("_off"), F.col("block") * block)
    hi = F.least(F.col("_off") + F.col("size"), (F.col("block") + 1) * block)
    spans = spans.select("source_idx", "block", "_id", (lo - F.col("_off")).alias("_from"), (hi - lo).alias("_len"))
    return sources, placed, spans.join(slots(sources, block, seed, few).hint("merge"), ["source_idx", "block"])


def _numbered(docs: DataFrame) -> DataFrame:
    """With ``_id``, a number for each row, which holds once the table is saved."""
    return docs.withColumn("_id", F.monotonically_increasing_id())


def mix(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, taken: how many words of each document the mix takes, repeats counted; first_shard: the first output shard that has some."""
    sized = docs.select("doc_id", "source", F.size(words(F.col("text"))).cast("bigint").alias("size"), F.xxhash64("text").alias("_h"))
    sized = saved(_numbered(sized), "mix-sizes")
    sources, _, parts = _plan(sized, block, seed)
    taken = parts.groupBy("_id").agg(F.sum("_len").alias("_taken"), F.min("shard").alias("first_shard"))
    right = F.broadcast(sources) if sources.count() <= BROADCAST_ROWS else sources
    out = sized.join(right.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).join(taken, "_id", "left")
    return out.select("doc_id", "source", "size", "source_size", "target", F.coalesce("_taken", F.lit(0)).cast("bigint").alias("taken"), "first_shard")


def mixed_documents(docs: DataFrame, block: int = BLOCK, seed: int = 7) -> DataFrame:
    """The mix as documents: a row for each document and epoch, with the words that the epoch takes.

    A document taken whole keeps its text as it is; else the words taken stand
    in order, parted by single spaces, and ``n_chars`` (if there) is the new
    length.  Documents of which nothing is taken are not in the result.
    """
    names = docs.columns
    keep = docs.select(F.col("doc_id"), F.col("source"), F.size(words(F.col("text"))).cast("bigint").alias("size"), F.struct(*names).alias("_row"))
    keep = saved(_numbered(keep.withColumn("_h", F.xxhash64("_row"))), "mix-rows")
    _, _, parts = _plan(keep.drop("_row"), block, seed)
    cut = parts.groupBy("_id", "epoch").agg(F.sort_array(F.collect_list(F.struct("_from", "_len"))).alias("_parts"), F.sum("_len").alias("_sum"))
    out = keep.select("_id", "_row", "size").join(cut, "_id").select("_row", "size", "_parts", "_sum", words(F.col("_row").getField("text")).alias("_w"))
    some = F.array_join(F.flatten(F.transform("_parts", lambda p: F.slice(F.col("_w"), (p["_from"] + 1).cast("int"), p["_len"].cast("int")))), " ")
    field = lambda c: F.col("_row").getField(c)
    out = out.withColumn("_text", F.when(F.col("_sum") == F.col("size"), field("text")).otherwise(some))
    fresh = {"text": F.col("_text"), "n_chars": F.length("_text").cast("bigint")}
    return out.select(*[fresh.get(c, field(c)).alias(c) for c in names])
