"""Summaries of evaluation runs: rates with their denominators, breakdowns, joins of result sets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What a report says where nothing was measured, and for an error without a text (fixed values).
NOT_MEASURED, UNKNOWN_ERROR = "Ölçülmedi (n=0)", "bilinmeyen hata"
#: Parts of messages that speak of exhausted memory (fixed values).
MEMORY_ERRORS = ["failed to allocate memory", "bfcarena", "out of memory", "cuda error", "error code: 500"]
#: Which of two name-alikes a result holds: both, target only, confuser only, neither (fixed values).
NAME_CASES = ["ikisi de geliyor", "yalnız hedef", "hedef yok, karıştırıcı var", "ikisi de yok"]


def error_kind(message: Column) -> Column:
    """An error's code if it gives one, else the first 40 characters up to a colon, stop or bracket."""
    code = F.regexp_extract(message, "Error code: [0-9]+", 0)
    start = F.substring(F.trim(F.get(F.split(message, "[:.(]", 2), F.lit(0))), 1, 40)
    return F.when(code != "", code).when(start != "", start).otherwise(F.lit(UNKNOWN_ERROR))


def is_memory_error(message: Column) -> Column:
    low = F.lower(message)
    return F.coalesce(F.exists(F.array(*[F.lit(x) for x in MEMORY_ERRORS]), lambda x: F.contains(low, x)), F.lit(False))


def name_case(target: Column, confuser: Column) -> Column:
    both, only, wrong, none = map(F.lit, NAME_CASES)
    return F.when(target & confuser, both).when(target, only).when(confuser, wrong).otherwise(none)


def negative_rates(confusion: DataFrame) -> DataFrame:
    """confusion (tn, fp) with the texts of the right and wrong share of questions without an answer."""
    n = F.col("tn") + F.col("fp")
    told = lambda k: F.when(n == 0, F.lit(NOT_MEASURED)).otherwise(F.format_string("%%%.1f (%d/%d)", F.col(k) / n * 100, F.col(k), n))
    return confusion.select("*", told("tn").alias("negative_right"), told("fp").alias("negative_wrong"))


def retrieval_accuracy(scored: DataFrame) -> DataFrame:
    """(accuracy in percent, n) of (negative, hit_rank): a question without an answer needs no source."""
    hit = F.col("negative") | (F.col("hit_rank") > 0)
    return scored.agg(F.round(100.0 * F.count_if(hit) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("accuracy"), F.count(F.lit(1)).alias("n"))


def category_means(scored: DataFrame, key: str, metrics: list[str], partial: str | None = None) -> DataFrame:
    """Means in percent by category of metrics that only rows with a reference have (0 elsewhere).

    The denominator is the number of rows with a reference (referenced), or of all rows where none has one.
    partial: a metric that may be null; its denominator leaves the missing ones out, and they are counted.
    """
    rows = scored.withColumn("__pool", F.col("referenced").cast("int"))
    sums = rows.groupBy(key).agg(
        F.count(F.lit(1)).alias("total"), F.sum("__pool").alias("scored"), *[F.sum(F.when(F.col("referenced"), F.col(m))).alias(f"__{m}") for m in [*metrics, *[partial] * bool(partial)]],
        *[F.count_if(F.col("referenced") & F.col(partial).isNull()).alias("missing")] * bool(partial),
    )
    base = F.when(F.col("scored") > 0, F.col("scored")).otherwise(F.col("total"))
    mean = lambda m, n: F.round(100 * F.coalesce(F.col(f"__{m}"), F.lit(0)) / n, 2)
    out = [mean(m, base).alias(m) for m in metrics]
    if partial:
        out += [F.when(base > F.col("missing"), mean(partial, base - F.col("missing"))).alias(partial), F.col("missing")]
    return sums.select(key, "total", "scored", *out)


def overall_means(scored: DataFrame, metrics: list[str], digits: int = 1) -> DataFrame:
    """Means over the rows with a reference, of values that are rounded first; nulls do not count."""
    pool = scored.where("referenced")
    return pool.agg(*[F.round(F.coalesce(F.avg(F.round(m, digits)), F.lit(0.0)), 6).alias(m) for m in metrics], F.count(F.lit(1)).alias("n"))


def route_counts(results: DataFrame) -> DataFrame:
    """(route, n)."""
    return results.groupBy("route").agg(F.count(F.lit(1)).alias("n"))


def difficulty_report(results: DataFrame) -> DataFrame:
    """(difficulty, total, scorable, passed) of (difficulty, expected, top): a question is scored if it expects
    a source, and passed if the first source found is or holds it."""
    asked = F.coalesce(~F.col("expected").isin("", "-"), F.lit(False))
    return results.groupBy("difficulty").agg(F.count(F.lit(1)).alias("total"), F.count_if(asked).alias("scorable"), F.count_if(asked & F.contains("top", "expected")).alias("passed"))


def means_without_fn(judged: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean_without_fn) of judged answers that are no false negatives."""
    kept = judged.where(~F.col("outcome").eqNullSafe("FN")).unpivot([], metrics, "metric", "score")
    return kept.groupBy("metric").agg(F.round(F.avg("score"), 6).alias("mean_without_fn"))


def upload_report(files: DataFrame) -> DataFrame:
    """(ok, failed, chunks, seconds) of (ok, chunks, seconds); failed files have no chunks but took time."""
    return files.agg(F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.coalesce(F.sum(F.when(F.col("ok"), F.col("chunks"))), F.lit(0)).alias("chunks"), F.round(F.coalesce(F.sum("seconds"), F.lit(0.0)), 6).alias("seconds"))


def with_judgements(scored: DataFrame, judged: DataFrame, questions: DataFrame) -> DataFrame:
    """scored with its judgement and question, by (set, id); either may be missing."""
    return scored.join(judged, ["set", "id"], "left").join(questions, ["set", "id"], "left")


def missing_sets(sets: DataFrame, results: DataFrame) -> DataFrame:
    """The sets (set) of which there is no result."""
    return sets.select("set").distinct().join(results.select("set").distinct(), "set", "left_anti")
