"""Evaluation of (ref, hyp) line pairs: page, seq, ref, hyp."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T_
from pyspark.sql import Window as W

from pagemill.functions import text as T
from pagemill.functions.codes import PIECE, code_points, of_points, pieces, places, tallied

c = F.col


def _count(cond: Column) -> Column:
    return F.sum(cond.cast("bigint"))


def r6(x: Column) -> Column:
    return F.round(x, 6)


def micro_cer(p: DataFrame) -> DataFrame:
    edits, n = F.sum(T.levenshtein(c("ref"), c("hyp"))).cast("bigint"), F.sum(F.length("ref")).cast("bigint")
    return p.agg(edits.alias("edits"), n.alias("ref_chars")).withColumn("cer", r6(c("edits") / F.greatest(c("ref_chars"), F.lit(1))))


def micro_wer(p: DataFrame) -> DataFrame:
    n = F.size(F.filter(F.split(F.trim("ref"), r"\s+"), lambda w: w != ""))
    return p.agg(F.sum(T.word_edits(c("ref"), c("hyp"))).cast("bigint").alias("edits"), F.sum(n).cast("bigint").alias("ref_words")).withColumn("wer", r6(c("edits") / F.greatest(c("ref_words"), F.lit(1))))


def exact(p: DataFrame) -> DataFrame:
    return p.agg(F.count("*").alias("n"), _count(c("ref") == c("hyp")).alias("correct")).withColumn("accuracy", r6(c("correct") / F.greatest(c("n"), F.lit(1))))


def _tally(p: DataFrame, letters: str | None = None) -> DataFrame:
    """Characters at equal places of both lines, counted: ref, hyp, n, and the first place as page, seq, _i.

    Only unequal ones of the common length; with ``letters`` all places where the reference has one of them, hyp null past the hypothesis' end.
    Counted by batch: the same two characters come once from each piece of one.
    """
    schema = T_.StructType([T_.StructField("ref", T_.StringType()), T_.StructField("hyp", T_.StringType()), T_.StructField("n", T_.LongType()), p.schema["page"], p.schema["seq"], T_.StructField("_i", T_.IntegerType())])
    d = p.select("page", "seq", "ref", "hyp").mapInArrow(lambda it: _tallies(it, letters), schema)
    return d.groupBy("ref", "hyp").agg(F.sum("n").alias("n"), F.min(F.struct("page", "seq", "_i")).alias("_first"))


def _tallies(it: Iterator[pa.RecordBatch], letters: str | None, size: int = PIECE) -> Iterator[pa.RecordBatch]:
    for batch in it:
        t = pa.table(batch).filter(pc.field("ref").is_valid() & pc.field("hyp").is_valid())
        if not t.num_rows:
            continue
        t = t.take(pc.sort_indices(t, [("page", "ascending"), ("seq", "ascending")], null_placement="at_start")).combine_chunks()
        done = 0
        for x, y in pieces(t["ref"].chunk(0), t["hyp"].chunk(0), size=size):
            k, i, ref, hyp, n = _counted(*code_points(x), *code_points(y), letters)
            at = t.select(["page", "seq"]).take(k + done)
            done += len(x)
            out = [of_points(ref), of_points(hyp), pa.array(n), at["page"], at["seq"], pa.array(i, pa.int32())]
            yield from pa.table(out, names=["ref", "hyp", "n", "page", "seq", "_i"]).combine_chunks().to_batches()


def _counted(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray, letters: str | None) -> tuple[np.ndarray, ...]:
    """Of the code points of lines one after another, n and m long: row, place, both code points (-1: none) and number of each two, by their first place."""
    end, to = np.cumsum(n), np.cumsum(m) - m
    if letters is None:
        common = np.minimum(n, m)
        i, j = places(end - n, common), places(to, common)
        k = np.flatnonzero(a[i] != b[j])
        i, other = i[k], b[j[k]]
    else:
        known = np.zeros(1 + max(a.max(initial=0), *map(ord, letters)), bool)
        known[[ord(x) for x in letters]] = True
        i = np.flatnonzero(known[a])
        row = np.searchsorted(end, i, "right")
        place = i - (end - n)[row]
        other = np.append(b, np.int32(-1))[np.where(place < m[row], to[row] + place, len(b))]
    both, first, count = tallied(a[i], other)
    row = np.searchsorted(end, i[first], "right")
    return row, i[first] - (end - n)[row], *both, count


def confusions(p: DataFrame, top: int = 20) -> DataFrame:
    """The most frequent unequal characters at equal places of the common length."""
    return _tally(p).select(c("ref").alias("true_char"), c("hyp").alias("pred_char"), "n", "_first").orderBy(F.desc("n"), "_first").limit(top).drop("_first")


def diacritics(p: DataFrame, letters: str = T.EVALUATED_LETTERS) -> DataFrame:
    """By letter: total, correct, accuracy; places past the hypothesis count as missing."""
    right = F.when(c("ref") == c("hyp"), c("n")).otherwise(F.lit(0))
    return _tally(p, letters).groupBy(c("ref").alias("letter")).agg(F.sum("n").alias("total"), F.sum(right).alias("correct")).withColumn("accuracy", r6(c("correct") / c("total")))


def length_buckets(p: DataFrame) -> DataFrame:
    n = F.length("ref")
    b = F.when(n <= 10, "1-10").when(n <= 30, "11-30").when(n <= 60, "31-60").otherwise("61+")
    g = p.withColumn("bucket", b).groupBy("bucket").agg(F.count("*").alias("n"), _count(c("ref") == c("hyp")).alias("correct"), F.sum(T.evaluator_cer(c("ref"), c("hyp"))).alias("_s"))
    return g.select("bucket", "n", "correct", r6(c("correct") / c("n")).alias("accuracy"), r6(c("_s") / c("n")).alias("mean_cer"))


def _three(p: DataFrame) -> DataFrame:
    sq = lambda x: T.squeeze(c(x))
    return p.withColumns({"a_exact": c("a") == c("v"), "b_exact": c("b") == c("v"), "a_space": sq("a") == sq("v"), "b_space": sq("b") == sq("v"), "a_cer": T.cer(c("v"), c("a")), "b_cer": T.cer(c("v"), c("b"))})


def _summary() -> list[Column]:
    return [F.count("*").alias("n"), *[_count(c(x)).alias(x) for x in ("a_exact", "b_exact", "a_space", "b_space")], *[r6(F.sum(x)).alias(f"{x}_sum") for x in ("a_cer", "b_cer")]]


def three_way(p: DataFrame) -> DataFrame:
    """Page, a, b, v with v the reference."""
    return _three(p).agg(*_summary())


def three_way_pages(p: DataFrame) -> DataFrame:
    return _three(p).groupBy("page").agg(*_summary())


def three_way_wins(p: DataFrame) -> DataFrame:
    a, b = c("a_exact"), c("b_exact")
    return _three(p).agg(_count(a & b).alias("both_right"), _count(a & ~b).alias("only_a"), _count(~a & b).alias("only_b"), _count(~a & ~b).alias("both_wrong"))


def agreement(p: DataFrame) -> DataFrame:
    a, b = c("a") == c("v"), c("b") == c("v")
    return p.agg(F.count("*").alias("n"), _count(a).alias("correct_a"), _count(b).alias("correct_b"), _count(a & b).alias("both"), _count(a & ~b).alias("only_a"), _count(~a & b).alias("only_b"), _count(c("a") != c("b")).alias("disagree"))


def categories(p: DataFrame) -> DataFrame:
    g = p.groupBy(T.difference_category(c("ref"), c("hyp")).alias("category")).agg(F.count("*").alias("n"))
    return g.withColumn("percent", r6(100 * c("n") / F.sum("n").over(W.partitionBy(F.lit(0)))))


def number_spacing(p: DataFrame) -> DataFrame:
    number = r"^-?[\d\s]+$"
    d = p.filter(c("ref").rlike(number) & (c("ref") != c("hyp")))
    same = T.squeeze(c("ref")) == T.squeeze(c("hyp"))
    return d.agg(F.count("*").alias("n"), F.coalesce(_count(same), F.lit(0)).alias("spacing_only"))


def corpus_cer(p: DataFrame) -> DataFrame:
    """Without hypotheses over three times as long as their (longer than three) reference, digits joined."""
    d = p.filter(~((F.length("hyp") > 3 * F.length("ref")) & (F.length("ref") > 3)))
    d = d.select(T.digit_spacing(c("ref")).alias("ref"), T.digit_spacing(c("hyp")).alias("hyp"))
    return d.agg(F.count("*").alias("n"), F.sum(T.levenshtein(c("ref"), c("hyp"))).cast("bigint").alias("edits"), F.sum(F.greatest(F.length("ref"), F.lit(1))).cast("bigint").alias("ref_len")).withColumn("cer", r6(c("edits") / F.greatest(c("ref_len"), F.lit(1))))


def match_levels(p: DataFrame) -> DataFrame:
    ex, case, space = c("ref") == c("hyp"), F.lower("ref") == F.lower("hyp"), T.squeeze(c("ref")) == T.squeeze(c("hyp"))
    garbage = T.leading_garbage(c("hyp"), c("ref"))
    return p.agg(F.count("*").alias("n"), _count(ex).alias("exact"), _count(~ex & case).alias("case_only"), _count(~ex & ~case & space).alias("space_only"), _count(~ex & ~case & ~space).alias("different"), _count(garbage & ~ex).alias("leading_garbage"))


def worst(p: DataFrame, n: int = 50) -> DataFrame:
    return p.withColumn("cer", r6(T.evaluator_cer(c("ref"), c("hyp")))).orderBy(F.desc("cer"), "page", "seq").limit(n)


def corrections(p: DataFrame, n: int = 30) -> DataFrame:
    d = p.withColumn("cer", r6(T.cer(c("ref"), c("hyp")))).filter((c("cer") > 0.05) & (c("cer") < 0.4) & (F.length("ref") > 5))
    return d.orderBy("cer", "page", "seq").limit(n)


def assemble(lines: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Page text (lines joined in order), number of lines and mean confidence; pages without lines stay."""
    g = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "text"))).alias("_l"), F.count("*").alias("n_lines"), F.avg("confidence").alias("_c"))
    g = g.select("page", F.array_join(F.transform("_l", lambda x: F.coalesce(x["text"], F.lit(""))), "\n").alias("text"), "n_lines", r6("_c").alias("confidence"))
    if pages is None:
        return g
    return pages.select("page").join(g, "page", "left").select("page", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), F.coalesce("confidence", F.lit(0.0)).alias("confidence"))


def zipped(left: DataFrame, right: DataFrame, of: str = "page", k: str = "k") -> DataFrame:
    """Two results joined by page and line number; it is an error if a page that both have differs in its number of lines.  Pages of one side only are left out."""
    counts = left.groupBy(of).agg(F.count("*").alias("_l")).join(right.groupBy(of).agg(F.count("*").alias("_r")), of)
    wrong = F.raise_error(F.concat(F.lit("line counts differ on page "), c(of).cast("string")))
    checked = counts.select(of, F.when(c("_l") != c("_r"), wrong).otherwise(F.lit(True)).alias("_same")).filter("_same")
    return left.join(right, [of, k]).join(checked, of, "left").filter("_same").drop("_same")


def siblings(df: DataFrame, *arrays: str, at: str = "k") -> DataFrame:
    """A row an index of arrays that belong together; shorter ones give null."""
    keep = [x for x in df.columns if x not in arrays]
    return df.select(*keep, F.posexplode(F.arrays_zip(*arrays)).alias(at, "_z")).select(*keep, at, *[c("_z").getField(x).alias(x) for x in arrays])


def gathered(results: DataFrame, regions: DataFrame, key: list[str]) -> DataFrame:
    """Every region with its result, by the key that it was sent under; null where none came back."""
    return regions.join(results, key, "left")


def required(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """``rows`` joined with what is known of their ``key``; it is an error if that isn't there."""
    mark = known.withColumn("_there", F.lit(True))
    d = rows.join(mark, key, "left")
    return d.filter(F.when(c("_there").isNull(), F.raise_error(F.concat(F.lit(f"no such {key}: "), c(key).cast("string"))).cast("boolean")).otherwise(F.lit(True))).drop("_there")


def agreement_by_page(p: DataFrame) -> DataFrame:
    """By page: lines, how many a and b agree on, and the percentage."""
    return p.groupBy("page").agg(F.count("*").alias("n"), _count(c("a") == c("b")).alias("agree")).withColumn("percent", r6(100 * c("agree") / c("n")))


def throughput(times: DataFrame, by: str, ms: str) -> DataFrame:
    """By ``by``: n, total and mean milliseconds, and how many a second; 0 for no time."""
    d = times.groupBy(by).agg(F.count("*").alias("n"), F.round(F.sum(ms), 4).alias("total"))
    return d.withColumns({"mean": r6(c("total") / c("n")), "a_second": r6(F.when(c("total") > 0, 1000 * c("n") / c("total")).otherwise(0.0))})


def progress(done: Column, total: Column, seconds: Column) -> Column:
    """struct(rate, eta): items a second, and seconds until all are done; 0 where nothing can be said."""
    rate = F.when(seconds > 0, done / seconds).otherwise(F.lit(0.0))
    return F.struct(rate.alias("rate"), F.when(rate > 0, (total - done) / rate).otherwise(F.lit(0.0)).alias("eta"))


#: Letters that readers mistake for one another (fixed values).
CONFUSION_PAIRS = ["aå", "aä", "åä", "oö", "oø", "öø", "AÅ", "AÄ", "ÅÄ", "OÖ", "OØ", "ÖØ"]


def confusion_rates(p: DataFrame, pairs=CONFUSION_PAIRS) -> DataFrame:
    """For each pair of letters: how often either stands in the reference, how often the other was read instead, and the share."""
    table = p.sparkSession.createDataFrame([(x, y, x + y) for z in pairs for x, y in (z, z[::-1])], "ref string, other string, pair string")
    table = table.withColumn("pair", F.when(c("pair").isin(*pairs), c("pair")).otherwise(F.reverse("pair")))
    seen = _tally(p, "".join(sorted({x for z in pairs for x in z}))).select("ref", "hyp", c("n").alias("_n"))
    g = table.join(F.broadcast(seen), "ref", "left").groupBy("pair").agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("total"), F.coalesce(F.sum(F.when(c("hyp") == c("other"), c("_n"))), F.lit(0)).alias("confused"))
    return g.withColumn("rate", r6(F.when(c("total") > 0, c("confused") / c("total")).otherwise(0.0)))


def nordic_cer(p: DataFrame) -> DataFrame:
    """micro_cer over the reference's words that hold a letter beyond a-z of the charset, each against the hypothesis' word at its place (empty if there is none)."""
    words = lambda k: F.filter(F.split(k, r"\s+"), lambda w: w != "").alias(k)
    w = siblings(p.select("page", "seq", words("ref"), words("hyp")), "ref", "hyp").filter(T.has_nordic(c("ref")))
    return micro_cer(w.withColumn("hyp", F.coalesce("hyp", F.lit(""))))


def display(text: Column, n: int = 60) -> Column:
    return F.left(F.trim(text), F.lit(n))
