"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document.  How far a
rule can be trusted isn't given but estimated: expectation-maximisation over a
two-class latent model finds P(vote | quality) for every rule, and a document
is kept when its posterior probability of being good is at least one half.

Everything that grows with the input is DataFrame work.  The model needs only
the number of documents with each combination of votes: at most 3 ** 9 rows
whatever the input, and those are what the driver sees.

Defined results: a null or empty text has no words and fails the base rule;
repeated rows are judged one by one; null ids pass through; an empty table
gives an empty table; further columns of the input are left out (``judge``)
or kept (``keep_good``).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import let, saved, words

SYMBOLS = "#*$%&|<>"
#: Common words of the languages at hand (fixed values).
STOP_WORDS = (
    "the of and to in is that for it as was with be by on not this are or an "
    "der die und das ist nicht ein eine von zu den mit auf für im dem des sich auch "
    "le la les de des et est un une que qui dans pour pas sur au par du en "
    "el los las del y es por con no una su para al lo como"
).split()
RULES = ("length", "symbols", "symbol_share", "marked_words", "lines", "repeats", "shape", "capitals", "function_words")


def _repeat_words(w: Column) -> Column:
    """Number of words that lie in a 3-word window found twice or more in the text.

    The windows' 64-bit hashes are sorted together with the windows' indices;
    equal neighbours are repeats.
    """

    def spread(starts: Column) -> Column:
        """Words covered by the windows that begin at the ascending ``starts``."""
        return let(
            starts,
            lambda s: F.aggregate(
                F.zip_with(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), lambda b, a: F.least(b - a, F.lit(3))),
                F.when(F.size(s) > 0, F.lit(3)).otherwise(F.lit(0)).cast("bigint"),
                lambda acc, x: acc + x,
            ),
        )

    def by_pairs(h: Column) -> Column:
        pairs = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            twin = F.filter(p, lambda x, k: ((k > 0) & (x["h"] == F.get(p, k - 1)["h"])) | ((k < F.size(p) - 1) & (x["h"] == F.get(p, k + 1)["h"])))
            return F.sort_array(F.transform(twin, lambda x: x["i"]))

        return spread(let(pairs, starts))

    def count(v: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(v) - 3), lambda i: F.xxhash64(F.get(v, i), F.get(v, i + 1), F.get(v, i + 2)))
        return F.when(F.size(v) < 3, F.lit(0).cast("bigint")).otherwise(by_pairs(hashes))

    return let(w, count)


def features(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and what the rules look at; one pass over the texts, no shuffle."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = body
    for c in SYMBOLS:
        plain = F.replace(plain, F.lit(c), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda x: F.btrim(x, F.lit(" \t\n\x0b\x0c\r")) != "")
    stage = docs.select(*keys, body.alias("_body"), words(F.col(text)).alias("_w"), lines.alias("_lines"), plain.alias("_plain"))
    return stage.select(
        *keys,
        F.size("_w").cast("bigint").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("bigint").alias("word_chars"),
        (F.length("_body") - F.length("_plain")).cast("bigint").alias("n_symbols"),
        F.size(F.filter("_w", lambda x: x.rlike("[#*$%&|<>]"))).cast("bigint").alias("n_marked"),
        F.size("_lines").cast("bigint").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("bigint").alias("n_dup_lines"),
        _repeat_words(F.col("_w")).alias("n_repeat_words"),
        F.regexp_count("_body", F.lit(r"\p{Lu}")).cast("bigint").alias("n_capitals"),
        F.size(F.array_intersect(F.col("_w"), F.array(*[F.lit(w) for w in sorted(set(STOP_WORDS))]))).cast("bigint").alias("n_function_words"),
    )


def votes() -> dict[str, Column]:
    """Rule -> 1, -1 or 0, from the feature columns (integer arithmetic)."""
    c = F.col
    vote = lambda good, bad: F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    return {
        "length": vote(c("n_words") >= 80, c("n_words") < 50),
        "symbols": vote(20 * c("n_symbols") < c("n_words"), 5 * c("n_symbols") > c("n_words")),
        "symbol_share": vote(200 * c("n_symbols") < c("word_chars"), 33 * c("n_symbols") > c("word_chars")),
        "marked_words": vote(50 * c("n_marked") < c("n_words"), 7 * c("n_marked") > c("n_words")),
        "lines": vote(c("n_dup_lines") == 0, 10 * c("n_dup_lines") > 3 * c("n_lines")),
        "repeats": vote(5 * c("n_repeat_words") < c("n_words"), 100 * c("n_repeat_words") > 40 * c("n_words")),
        "shape": vote((c("word_chars") >= 3 * c("n_words")) & (c("word_chars") <= 9 * c("n_words")), (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 12 * c("n_words"))),
        "capitals": vote(5 * c("n_capitals") < c("word_chars"), 2 * c("n_capitals") > c("word_chars")),
        "function_words": vote(c("n_function_words") >= 2, (c("n_function_words") == 0) & (c("n_words") >= 20)),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50, prior: float = 0.85) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """EM on (votes, number of documents): P(good), and for each rule vote -> (P(vote | good), P(vote | bad))."""
    n_rules = len(RULES)
    good = {-1: 0.02, 0: 0.13, 1: 0.85}
    bad = {-1: 0.5, 0: 0.2, 1: 0.3}
    table = [{v: (good[v], bad[v]) for v in (-1, 0, 1)} for _ in range(n_rules)]
    total = sum(n for _, n in patterns)
    if not total:
        return prior, table
    for _ in range(rounds):
        sums = [{v: [0.0, 0.0] for v in (-1, 0, 1)} for _ in range(n_rules)]
        mass = 0.0
        for pattern, n in patterns:
            p = _posterior(pattern, prior, table)
            mass += p * n
            for s, v in zip(sums, pattern, strict=True):
                s[v][0] += p * n
                s[v][1] += (1 - p) * n
        prior = min(0.99, max(0.01, mass / total))
        # Smoothing by the starting beliefs, worth 2 % of the documents: keeps which class is the good one, and small tables sane.
        a = 0.02 * total + 1
        table = [{v: ((s[v][0] + a * good[v]) / (mass + a), (s[v][1] + a * bad[v]) / (total - mass + a)) for v in (-1, 0, 1)} for s in sums]
    return prior, table


def _posterior(pattern: tuple[int, ...], prior: float, table: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(prior / (1 - prior)) + sum(math.log(t[v][0] / t[v][1]) for t, v in zip(table, pattern, strict=True))
    return 1 / (1 + math.exp(-max(-500.0, min(500.0, odds))))


def judge(docs: DataFrame, keys: list[str] | None = None, text: str = "text") -> DataFrame:
    """keys, the base counts, ``base_failed``, each rule's vote, ``p_good`` and ``kept``."""
    keys = keys or ["doc_id"]
    seen = saved(features(docs, keys, text), "quality").withColumns({f"vote_{r}": v for r, v in votes().items()})
    patterns = [(tuple(r[:-1]), r[-1]) for r in seen.groupBy(*[f"vote_{r}" for r in RULES]).count().collect()]  # 3 ** 9 rows at most
    prior, table = estimate(sorted(patterns))
    odds = F.lit(math.log(prior / (1 - prior)))
    for rule, t in zip(RULES, table, strict=True):
        weight = F.lit(math.log(t[0][0] / t[0][1]))
        for v in (-1, 1):
            weight = F.when(F.col(f"vote_{rule}") == v, F.lit(math.log(t[v][0] / t[v][1]))).otherwise(weight)
        odds = odds + weight
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (
        seen.withColumn("base_failed", failed)
        .withColumn("p_good", 1 / (1 + F.exp(-odds)))
        .withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))
    )


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose documents pass, all columns as they were."""
    verdict = judge(docs.select(F.struct(*docs.columns).alias("_row")).select("_row", F.col(f"_row.`{text}`").alias("_text")), ["_row"], "_text")
    return verdict.filter("kept").select("_row.*")
