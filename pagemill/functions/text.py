"""String functions of evaluation and curation, as column expressions."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.codes import code_points, pieces
from pagemill.functions.distance import distances

#: Letters counted as diacritics by the evaluator, and the wider set of the charset (fixed values).
EVALUATED_LETTERS = "åäöøæÅÄÖØÆ"
NORDIC_LETTERS = "åäöøæðþÅÄÖØÆÐÞ"
#: Folding of diacritics for comparison (fixed values).
FOLD_FROM, FOLD_TO = "åäöøæðþÅÄÖØÆÐÞ", "aaooaooAAOOAOO"


def normalize_ws(s: Column) -> Column:
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def digit_spacing(s: Column) -> Column:
    """Join digits that blanks part, in one pass: "1 2 3" becomes "12 3"."""
    return F.regexp_replace(s, r"(\d)\s+(\d)", "$1$2")


def fold_diacritics(s: Column) -> Column:
    return F.translate(s, FOLD_FROM, FOLD_TO)


def squeeze(s: Column) -> Column:
    return F.replace(s, F.lit(" "), F.lit(""))


def has_nordic(s: Column) -> Column:
    return s.rlike(f"[{NORDIC_LETTERS}]")


def _edits(a: Column, b: Column, ids) -> Column:
    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        there = pc.and_(a.is_valid(), b.is_valid())
        out = [distances(*ids(x, y)) for x, y in pieces(a, b)]
        return pa.array(np.concatenate([np.zeros(0, np.int64), *out]), pa.int32(), mask=~there.to_numpy(zero_copy_only=False))

    return F.arrow_udf(run, "int")(a, b)


def _chars(*texts: pa.Array) -> list[np.ndarray]:
    return [x for t in texts for x in code_points(t)]


def _words(*texts: pa.Array) -> list[np.ndarray]:
    known: dict[str, int] = {}
    lists = [[[known.setdefault(w, len(known)) for w in re.split(r"[ \t\n\x0b\f\r]+", s or "") if w] for s in t.to_pylist()] for t in texts]
    return [x for t in lists for x in (np.array([w for ws in t for w in ws], np.int64), np.array([len(ws) for ws in t], np.int64))]


def levenshtein(a: Column, b: Column) -> Column:
    """Levenshtein distance in characters, taken over a batch's pairs at once."""
    return _edits(a, b, _chars)


def cer(ref: Column, hyp: Column) -> Column:
    """Character error rate; an empty reference gives 0 for an empty hypothesis and 1 for any other."""
    n = F.length(ref)
    return F.when(n == 0, F.when(F.length(hyp) == 0, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(levenshtein(ref, hyp) / F.greatest(n, F.lit(1)))


def evaluator_cer(ref: Column, hyp: Column) -> Column:
    return levenshtein(ref, hyp) / F.greatest(F.length(ref), F.lit(1))


def word_edits(ref: Column, hyp: Column) -> Column:
    """Levenshtein distance over word lists."""
    return _edits(ref, hyp, _words)


def leading_garbage(n: Column, v: Column) -> Column:
    """Whether ``n`` is ``v`` with up to six characters before it (seen on the first eight)."""
    i = F.sequence(F.lit(1), F.lit(6))
    head = F.substring(v, 1, 8)
    ok = (F.length(n) >= 5) & (F.length(v) >= 5) & (F.length(v) >= 8)
    return ok & F.exists(i, lambda k: (k < F.least(F.lit(7), F.length(n) - 1)) & (F.substring(n, k + 1, F.lit(8)) == head))


def difference_category(ref: Column, hyp: Column) -> Column:
    """The first kind of difference that fits."""
    e = cer(ref, hyp)
    return (
        F.when(ref == hyp, "exact")
        .when(digit_spacing(ref) == digit_spacing(hyp), "number_spacing")
        .when(fold_diacritics(ref) == fold_diacritics(hyp), "diacritic")
        .when(e < 0.1, "minor")
        .when(F.length(hyp) > 3 * F.length(ref), "hallucination")
        .when(e > 0.8, "both_differ")
        .otherwise("reference_error")
    )
