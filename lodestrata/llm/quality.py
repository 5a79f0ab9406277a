"""Quality rules combined by weak supervision.

Each rule votes good (1), bad (-1) or abstains (0) on a document. The votes of all documents are
counted by pattern (at most 3 ** number of rules rows, whatever the corpus size), and
expectation-maximisation on those counts estimates how often each rule is right on good documents and on
those with either kind of fault. A document's posterior probability of being good is then a plain column
expression: a bad vote of a rule that is often wrong on good documents decides nothing by itself.

Edge cases: null, empty and blank texts have no words and fail the base test. The repeated-window
count compares 64-bit hashes of eight words. Texts of any length are counted whole. An empty table gives
an empty result. Rows are judged one by one, so repeated rows get the same verdict; a posterior equal to
the threshold keeps. Extra columns are carried, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS, count_matches, documents, materialize, packed, words

WINDOW = 8
SYMBOLS = "[#*$%&|<>]"
#: What the last character of a finished line may be.
ENDS = (".", "!", "?", ":", ";", '"', "'", ")", "\u201d", "\u2019", "\u00bb", "\u2026", "\u3002")


def _stage(df: DataFrame, **cols: Column) -> DataFrame:
    return df.select("*", *[c.alias(n) for n, c in cols.items()])


def features(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """(__row, counts): the row (or the columns to keep) as a struct and the counts that the rules need."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    row = packed(docs) if keep is None else F.struct(*[F.col(f"`{c}`") for c in keep]).alias("__row")
    df = docs.select(row, text.alias("__t"))
    df = _stage(df, __w=words(F.col("__t")), __l=F.filter(F.split("__t", "\n"), lambda x: x.rlike("[^ \\t\\n\\x0B\\f\\r]")))
    df = _stage(
        df,
        n_words=F.size("__w").cast("long"),
        __h=F.when(
            F.size("__w") > WINDOW,
            F.transform(F.sequence(F.lit(1), F.size("__w") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(F.col("__w"), i, WINDOW))),
        ).otherwise(F.array().cast("array<bigint>")),
    )
    # Only texts with a window hash that occurs twice sort their windows, to find where those start.
    runs = F.array_sort(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    df = _stage(df, __r=F.when(F.size(F.array_distinct("__h")) < F.size("__h"), runs))

    def twice(x: Column, k: Column) -> Column:
        r = F.col("__r")
        before, after = F.get(r, k - 1), F.get(r, k + 1)
        return (before.isNotNull() & (before["h"] == x["h"])) | (after.isNotNull() & (after["h"] == x["h"]))

    df = _stage(df, __p=F.array_sort(F.transform(F.filter("__r", twice), lambda x: x["i"])))
    covered = F.aggregate(
        F.transform("__p", lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("__p"), k + 1) - p, F.lit(WINDOW)))),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    return df.select(
        "__row",
        "n_words",
        F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
        count_matches(F.col("__t"), SYMBOLS).cast("long").alias("n_symbols"),
        (F.size("__l") - F.size(F.array_distinct("__l"))).cast("long").alias("n_dup_lines"),
        F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words"),
        F.size("__l").alias("n_lines"),
        count_matches(F.col("__t"), "[0-9]").alias("n_digits"),
        F.size(F.array_distinct("__w")).alias("n_distinct"),
        count_matches(F.col("__t"), "[.!?]").alias("n_stops"),
        count_matches(F.col("__t"), "[^\\p{L} \\t\\n\\x0B\\f\\r]").alias("n_others"),
        F.size(F.filter("__w", lambda w: w.rlike("\\p{L}"))).alias("n_alphabetic"),
        F.size(F.filter("__l", lambda x: F.right(F.rtrim(x, F.lit(WS)), F.lit(1)).isin(*ENDS))).alias("n_line_ends"),
    )


def _vote(good: Column, bad: Column, asked: Column | None = None) -> Column:
    """1, -1 or 0 (abstains: neither holds, or the rule is not asked)."""
    vote = F.when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))
    return vote if asked is None else F.when(asked, vote).otherwise(F.lit(0))


def _ratio(a: str, b: str) -> Column:
    return F.col(a) / F.greatest(F.col(b), F.lit(1))


#: What a document may be: good, or bad in one of these ways. Rules that look at different faults seldom
#: fire together, so a single bad class would tear apart: one fault would pass for good.
KINDS = ("good", "noise", "repetition")


def rules() -> dict[str, tuple[Column, str | None]]:
    """name -> (vote, the fault that the rule was written for, or None for a rule that is about form).
    Thresholds are ratios, so that long and short documents are judged alike; between the good and the bad
    limit, and where a text is too short to tell, a rule abstains."""
    mean, symbols = _ratio("word_chars", "n_words"), _ratio("n_symbols", "n_words")
    letters, alphabetic = 1 - _ratio("n_others", "word_chars"), _ratio("n_alphabetic", "n_words")
    dup, repeats, variety = _ratio("n_dup_lines", "n_lines"), _ratio("n_repeat_words", "n_words"), _ratio("n_distinct", "n_words")
    digits, stops, ends = _ratio("n_digits", "word_chars"), _ratio("n_stops", "n_words"), _ratio("n_line_ends", "n_lines")
    a_line, some = _ratio("n_words", "n_lines"), F.col("n_words") > 0
    return {
        "symbols": (_vote(symbols <= 0.02, symbols > 0.1, some), "noise"),
        "letters": (_vote(letters >= 0.9, letters < 0.8, some), "noise"),
        "alphabetic": (_vote(alphabetic >= 0.95, alphabetic < 0.8, some), "noise"),
        "digits": (_vote(digits <= 0.03, digits > 0.1, some), "noise"),
        "dup_lines": (_vote(dup <= 0.1, dup > 0.3, F.col("n_lines") >= 5), "repetition"),
        "repeats": (_vote(repeats <= 0.05, repeats > 0.15, some), "repetition"),
        "variety": (_vote(variety >= 0.4, variety < 0.25, F.col("n_words") >= 30), "repetition"),
        "length": (_vote(F.col("n_words") >= 100, F.col("n_words") < 50), None),
        "word_length": (_vote(mean.between(3, 10), (mean < 3) | (mean > 10), some), None),
        "line_length": (_vote(a_line >= 15, a_line < 10, some), None),
        "sentences": (_vote(stops.between(0.03, 0.15), (stops < 0.01) | (stops > 0.25), F.col("n_words") >= 20), None),
        "line_ends": (_vote(ends >= 0.9, ends < 0.5, some), None),
    }


def fit(patterns: list[tuple[tuple[int, ...], int]], faults: list[str | None], start: float = 0.7, strength: float = 0.002, rounds: int = 500) -> tuple[list[float], list[list[float]]]:
    """EM on vote patterns and their counts: the share of documents of each kind and, by rule and kind, how
    often the rule votes bad when it votes. An abstention says nothing.

    Nothing but the start and a mild prior tells the kinds apart: a rule is right with the same probability
    ``start`` on good documents and on those with its fault, and undecided on others. The prior is worth
    ``strength`` of the documents for every estimate, so it does the same at every size. Estimates are free
    otherwise. An empty list gives the start.
    """
    total = sum(n for _, n in patterns)
    weight = strength * total
    first = [[1 - start if kind == "good" else start if kind == fault else 0.5 for kind in KINDS] for fault in faults]
    shares, bad = [1 / len(KINDS)] * len(KINDS), [row[:] for row in first]
    for _ in range(rounds if total else 0):
        sums = [weight / len(KINDS)] * len(KINDS)
        fired = [[weight * p for p in row] for row in first]
        asked = [[weight] * len(KINDS) for _ in faults]
        for votes, n in patterns:
            for k, p in enumerate(posterior(votes, shares, bad)):
                sums[k] += p * n
                for j, v in enumerate(votes):
                    if v:
                        asked[j][k] += p * n
                        if v < 0:
                            fired[j][k] += p * n
        new_shares = [s / (total + weight) for s in sums]
        new = [[f / a for f, a in zip(x, y)] for x, y in zip(fired, asked)]
        moved = max(abs(x - y) for p, q in zip([*new, new_shares], [*bad, shares]) for x, y in zip(p, q))
        shares, bad = new_shares, new
        if moved < 1e-7:
            break
    return shares, bad


def posterior(votes: tuple[int, ...], shares: list[float], bad: list[list[float]]) -> list[float]:
    """Probability of each kind, given a document's votes."""
    logs = [math.log(s) for s in shares]
    for row, v in zip(bad, votes):
        if v:
            logs = [x + math.log(p if v < 0 else 1 - p) for x, p in zip(logs, row)]
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [w / sum(weights) for w in weights]


def _p_good(votes: list[Column], shares: list[float], bad: list[list[float]]) -> Column:
    """posterior()[0] as a column: one over the sum of the odds of every kind against good."""
    odds = F.lit(1.0)
    for k in range(1, len(KINDS)):
        logit = F.lit(math.log(shares[k] / shares[0]))
        for vote, row in zip(votes, bad):
            fires, passes = math.log(row[k] / row[0]), math.log((1 - row[k]) / (1 - row[0]))
            logit = logit + F.when(vote == -1, fires).when(vote == 1, passes).otherwise(F.lit(0.0))
        odds = odds + F.exp(logit)
    return 1 / odds


def judge(docs: DataFrame, text_col: str = "text", threshold: float = 0.5, keep: list[str] | None = None) -> DataFrame:
    """(__row, counts, base_failed, p_good, kept) for every row.

    The texts are read once: their counts are written with the row (all columns, or those to keep), and the
    verdict, which needs the votes of all documents, is taken from what was written.
    """
    feats = materialize(features(docs, text_col, keep), "quality-counts")
    names = list(rules())
    votes = feats.select(*[v.alias(n) for n, (v, _) in rules().items()]).groupBy(*names).count()
    patterns = sorted((tuple(r[:-1]), r[-1]) for r in votes.collect())  # at most 3 ** 12 rows; some hundreds in practice
    shares, bad = fit(patterns, [fault for _, fault in rules().values()])
    base = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    told = feats.select("*", base.alias("base_failed"), _p_good([v for v, _ in rules().values()], shares, bad).alias("p_good"))
    return told.select("*", (~F.col("base_failed") & (F.col("p_good") >= threshold)).alias("kept"))


def quality_filter(docs: DataFrame, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """The documents that are judged good, all columns unchanged."""
    return judge(docs, text_col, threshold).where("kept").select("__row.*")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query; p_good is the posterior quality probability."""
    return judge(documents(spark, sf_dir).select("doc_id", "text"), keep=["doc_id"]).select(
        F.col("__row.doc_id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("p_good", 6).alias("p_good")
    )
