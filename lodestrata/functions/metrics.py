"""Answer metrics as column expressions over token arrays and normalized texts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import answer_form

# Fixed values of the answer metrics.
CONTAINED_TOKENS, SUBSET_TOKENS = 3, 12


def answer_tokens(text: Column) -> Column:
    return F.filter(F.split(answer_form(text), " "), lambda x: x != "")


def common(a: Column, b: Column) -> Column:
    """Size of the intersection of two arrays as multisets."""
    count = lambda xs, t: F.size(F.filter(xs, lambda x: x == t))
    return F.aggregate(F.array_intersect(a, b), F.lit(0), lambda s, t: s + F.least(count(a, t), count(b, t)))


def token_f1(predicted: Column, reference: Column) -> Column:
    """struct(f1, precision, recall) of token arrays; all 0 without common tokens."""
    both = common(predicted, reference)
    p, r = both / F.greatest(F.size(predicted), F.lit(1)), both / F.greatest(F.size(reference), F.lit(1))
    return F.struct(F.when(both > 0, 2 * p * r / (p + r)).otherwise(F.lit(0.0)).alias("f1"), p.alias("precision"), r.alias("recall"))


def best_f1(predicted: Column, references: Column) -> Column:
    """token_f1 against the best of several references (array of token arrays); the first wins ties."""
    scored = F.transform(references, lambda r, i: F.struct(token_f1(predicted, r)["f1"].alias("f1"), (-i).alias("i"), token_f1(predicted, r).alias("m")))
    return F.array_max(scored)["m"]


def exact_match(predicted: Column, reference: Column) -> Column:
    """Equal normalized texts, or a reference of at most three words that stands in the answer."""
    a, r = answer_form(predicted), answer_form(reference)
    short = (F.size(F.split(r, " ")) <= CONTAINED_TOKENS) & (r != "")
    return (a == r) | (short & F.contains(F.concat(F.lit(" "), a, F.lit(" ")), F.concat(F.lit(" "), r, F.lit(" "))))


def soft_match(predicted: Column, reference: Column) -> Column:
    """The reference stands in the answer, or has at most twelve words, all of them in the answer."""
    a, r = answer_form(predicted), answer_form(reference)
    words = answer_tokens(reference)
    return (r != "") & (F.contains(a, r) | ((F.size(words) <= SUBSET_TOKENS) & (F.size(F.array_except(words, answer_tokens(predicted))) == 0)))


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence. A row of the table is one number, whose zero bits are the places
    of b at which the length grows; a token of a updates all of them by one addition."""
    places: dict = {}
    for i, t in enumerate(b):
        places[t] = places.get(t, 0) | 1 << i
    whole = (1 << len(b)) - 1
    row = whole
    for t in a:
        hit = row & places.get(t, 0)
        row = ((row + hit) | (row - hit)) & whole
    return len(b) - row.bit_count()


def rouge_l(predicted: Column, references: Column) -> Column:
    """F of the longest common subsequence of a token array and the best of several references (array of token
    arrays); 0 without a common token. Arrow, since there is no built-in form."""
    @F.pandas_udf("double")
    def rouge(a: pd.Series, refs: pd.Series) -> pd.Series:
        def f(x, y) -> float:
            n = lcs(list(x), list(y)) if x is not None and y is not None else 0
            return 2 * n / (len(x) + len(y)) if n else 0.0

        return pd.Series([max((f(x, y) for y in ys), default=0.0) if ys is not None else 0.0 for x, ys in zip(a, refs)])

    return rouge(predicted, references)


def semantic_similarity(predicted: Column, references: Column) -> Column:
    """Greatest cosine of a vector and several references (array of vectors), held to [0, 1]. Null where it cannot be
    told: without a vector, with a zero one, or without any reference that has one of the same length."""
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    valid = F.filter(references, lambda r: r.isNotNull() & (F.size(r) == F.size(predicted)) & (length(r) > 0))
    best = F.array_max(F.transform(valid, lambda r: dot(predicted, r) / (length(predicted) * length(r))))
    return F.when(length(predicted) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), best)) + F.lit(0.0) * best)


def first_hit(found: Column, expected: Column) -> Column:
    """1-based rank of the first found source that holds the expected one or stands in it; 0 if none, and 0
    without an expected one."""
    hits = F.transform(F.array_distinct(found), lambda f, i: F.when(F.contains(f, expected) | F.contains(expected, f), i + 1))
    return F.when(F.coalesce(expected, F.lit("")) == "", F.lit(0)).otherwise(F.coalesce(F.array_min(hits), F.lit(0)))


def outcome(expected_negative: Column, refused: Column) -> Column:
    """TP, TN, FP or FN of an answer: a refusal is right exactly for a question without an answer."""
    return F.when(expected_negative & refused, "TN").when(expected_negative, "FP").when(refused, "FN").otherwise("TP")
