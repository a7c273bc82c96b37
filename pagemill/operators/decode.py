"""Sequence decoding as array expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLANK = 0


def softmax_argmax(scores: Column) -> Column:
    """struct(idx, p) of the first greatest score; (0, 0) for no scores."""
    top = F.array_max(scores)
    total = F.aggregate(scores, F.lit(0.0), lambda a, v: a + F.exp(v.cast("double") - top.cast("double")))
    full = F.size(scores) > 0
    return F.struct(F.when(full, F.array_position(scores, top) - 1).otherwise(F.lit(0)).cast("bigint").alias("idx"), F.when(full, 1 / total).otherwise(F.lit(0.0)).alias("p"))


def ctc_decode(steps: Column, width: Column | None = None, classes: int = 1 << 30) -> Column:
    """Kept steps of array<struct(idx, p)>: array<struct(token, p, pos)>, without blanks and immediate repeats.

    ``width`` is an item's own pixel width, four pixels a step.  A token beyond
    ``classes`` emits nothing but counts as the one before.
    """
    seen = steps if width is None else F.slice(steps, 1, F.floor(width / 4).cast("int"))
    marked = F.transform(seen, lambda s, i: F.struct((s["idx"] - 1).alias("token"), s["p"].alias("p"), i.cast("bigint").alias("pos"), F.coalesce(F.when(i > 0, F.get(seen, i - 1)["idx"]), F.lit(-1)).alias("prev")))
    kept = F.filter(marked, lambda s: (s["token"] != BLANK - 1) & (s["token"] + 1 != s["prev"]) & (s["token"] < classes))
    return F.transform(kept, lambda s: F.struct(s["token"].alias("token"), s["p"].alias("p"), s["pos"].alias("pos")))


def confidence(ps: Column, floor: float = 0.0) -> Column:
    """Geometric mean, 0 for none."""
    logs = F.aggregate(ps, F.lit(0.0), lambda a, p: a + F.ln(F.greatest(p, F.lit(floor)) if floor else p))
    return F.when(F.size(ps) > 0, F.exp(logs / F.size(ps))).otherwise(F.lit(0.0))


def upper_median(xs: Column) -> Column:
    """Element n // 2 of the sorted array; null for none."""
    return F.get(F.sort_array(xs), F.floor(F.size(xs) / 2).cast("int"))


def gaps(pos: Column) -> Column:
    n = F.size(pos)
    return F.when(n > 1, F.zip_with(F.slice(pos, 2, F.greatest(n - 1, F.lit(0))), F.slice(pos, 1, F.greatest(n - 1, F.lit(0))), lambda b, a: F.greatest(b - a, F.lit(0)))).otherwise(F.array().cast("array<bigint>"))


def trailing_cut(pos: Column) -> Column:
    """How many characters to keep: a late wide gap before a few last characters cuts those."""
    n = F.size(pos)
    g = gaps(pos)
    from_ = F.floor(n * 60 / 100).cast("int")
    late = F.slice(g, from_ + 1, F.greatest(F.size(g) - from_, F.lit(0)))
    widest = F.array_max(late)
    at = from_ + F.array_position(late, widest).cast("int") - 1
    mid = upper_median(g)
    rest = n - at - 1
    cut = (n >= 4) & (F.size(late) > 0) & (widest >= 3) & ((mid <= 0) | (widest >= 2 * mid)) & (rest <= 6) & (4 * rest <= n)
    return F.when(F.coalesce(cut, F.lit(False)), at + 1).otherwise(n)


def ar_decode(ids: Column, stops: tuple[int, ...] = (0, 2)) -> Column:
    """Ids before the first stop."""
    at = F.filter(F.transform(ids, lambda t, i: F.when(t.isin(*stops), i)), lambda i: i.isNotNull())
    return F.slice(ids, 1, F.coalesce(F.get(at, F.lit(0)), F.size(ids)).cast("int"))


def tokenizer_encode(text: Column, alphabet: str, bos: int, eos: int, pad: int, size: int | Column) -> Column:
    """BOS, an id for each character (EOS for unknown ones), EOS, then PAD up to ``size``."""
    chars = F.filter(F.split(text, ""), lambda ch: ch != "")
    ids = F.transform(chars, lambda ch: F.when(F.instr(F.lit(alphabet), ch) > 0, F.instr(F.lit(alphabet), ch)).otherwise(F.lit(eos)))
    full = F.concat(F.array(F.lit(bos)), ids, F.array(F.lit(eos)))
    return F.concat(full, F.array_repeat(F.lit(pad), F.greatest(F.lit(size) - F.size(full), F.lit(0))))


def tokenizer_decode(ids: Column, alphabet: str, bos: int, eos: int, pad: int) -> Column:
    """Characters up to the first EOS after BOS."""
    body = ar_decode(F.slice(ids, 2, F.greatest(F.size(ids) - 1, F.lit(0))), (eos,))
    seen = F.filter(body, lambda t: ~t.isin(bos, pad))
    return F.array_join(F.transform(seen, lambda t: F.substring(F.lit(alphabet), t, F.lit(1))), "")


def decoded(df: DataFrame, steps: str = "steps") -> DataFrame:
    """``df`` with n_chars, tokens, ps, pos and confidence of a CTC line."""
    d = df.withColumn("_c", ctc_decode(F.col(steps)))
    return d.withColumns({"tokens": F.col("_c.token"), "ps": F.col("_c.p"), "pos": F.col("_c.pos")}).withColumn("confidence", confidence(F.col("ps"))).drop("_c")


def _cut(df: DataFrame, first: Column, n: Column) -> DataFrame:
    """``df`` (text, tokens, ps, pos, confidence as they are there) cut to ``n`` characters from index ``first``; the confidence is taken anew where anything goes."""
    d = df.withColumn("_f", first.cast("int")).withColumn("_n", n.cast("int"))
    d = d.withColumn("_w", (F.col("_f") == 0) & (F.col("_n") == F.length("text")))
    part = {k: F.slice(F.col(k), F.col("_f") + 1, F.greatest(F.col("_n"), F.lit(0))) for k in ("tokens", "ps", "pos") if k in df.columns}
    d = d.withColumns({**part, "text": F.substring(F.col("text"), F.col("_f") + 1, F.greatest(F.col("_n"), F.lit(0)))})
    return d.withColumn("confidence", F.when(F.col("_w"), F.col("confidence")).otherwise(confidence(F.col("ps")))).drop("_f", "_n", "_w")


def trim_trailing(df: DataFrame) -> DataFrame:
    """Lines without the few characters behind a late wide gap, nor the spaces that then end them; text, ps, pos and confidence go together."""
    kept = F.col("_k")
    d = df.withColumn("_k", trailing_cut(F.col("pos")).cast("int"))
    bare = F.length(F.rtrim(F.substring(F.col("text"), F.lit(1), kept)))
    d = d.withColumn("_k", F.when((kept < F.size("pos")) & (bare >= 1), bare).otherwise(F.length("text")))
    return _cut(d, F.lit(0), F.col("_k")).drop("_k")


def strip_spaces(df: DataFrame) -> DataFrame:
    """Lines without the spaces at either end; a line of spaces only becomes empty, with confidence 0."""
    start = F.length("text") - F.length(F.ltrim("text"))
    return _cut(df.withColumn("_s", start), F.col("_s"), F.length(F.trim("text"))).drop("_s")


def text_of(tokens: Column, alphabet: str, unknown: str = "\ufffd") -> Column:
    """The characters of 0-based tokens; U+FFFD for one that the alphabet doesn't have."""
    return F.array_join(F.transform(tokens, lambda t: F.when((t >= 0) & (t < len(alphabet)), F.substring(F.lit(alphabet), t.cast("int") + 1, F.lit(1))).otherwise(F.lit(unknown))), "")


def from_percent(confidence_: Column) -> Column:
    """A reader's confidence in percent, negative for none, as a share."""
    return F.greatest(confidence_, F.lit(0)) / 100.0
