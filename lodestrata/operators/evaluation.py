"""Evaluation of answers: joins with references, outcome tables, roll-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.metrics import answer_tokens, best_f1, exact_match, first_hit, outcome, soft_match

ERROR_PREFIX = "HATA:"
#: Spellings of "not in the documents" (fixed values).
NEGATIVE_FLAGS = ["hayir", "hayır", "hayÄ±r", "no", "yok", "0", "false"]


def is_error(answer: Column) -> Column:
    return F.ltrim(answer).startswith(ERROR_PREFIX)


def is_negative(source: Column, flag: Column, references: Column) -> Column:
    """A question without an answer: no source, or a negative flag and no reference."""
    return (F.trim(source) == "-") | (F.lower(F.trim(flag)).isin(NEGATIVE_FLAGS) & (F.coalesce(F.size(references), F.lit(0)) <= 0))


def unique_truth(tables: list[tuple[str, DataFrame]]) -> DataFrame:
    """Union of (id, refs, keywords) tables; an id in two of them stops the job with their names."""
    out = None
    for name, t in tables:
        t = t.select("id", "refs", "keywords", F.lit(name).alias("file"))
        out = t if out is None else out.unionByName(t)
    twice = out.groupBy("id").agg(F.sort_array(F.collect_list("file")).alias("files")).where(F.size("files") > 1)
    bad = twice.orderBy("id").limit(1).collect()
    if bad:
        raise ValueError(f"id {bad[0]['id']} stands in {', '.join(bad[0]['files'])}")
    return out.drop("file")


def score_answers(answers: DataFrame, truth: DataFrame) -> DataFrame:
    """answers (id, answer, refused, found array, expected_source, flag) with their metrics against the best
    of (id, refs array<string>). Answers that start with the error mark are left out."""
    joined = answers.where(~is_error(F.col("answer"))).join(truth.select("id", "refs"), "id", "left")
    refs = F.coalesce("refs", F.array().cast("array<string>"))
    f1 = best_f1(answer_tokens(F.col("answer")), F.transform(refs, lambda r: answer_tokens(r)))
    scored = joined.select(
        "*",
        is_negative(F.col("expected_source"), F.col("flag"), F.col("refs")).alias("negative"),
        F.coalesce(f1["f1"], F.lit(0.0)).alias("f1"),
        F.exists(refs, lambda r: exact_match(F.col("answer"), r)).alias("em"),
        F.exists(refs, lambda r: soft_match(F.col("answer"), r)).alias("soft"),
        first_hit(F.col("found"), F.col("expected_source")).alias("hit_rank"),
    )
    return scored.withColumn("outcome", outcome(F.col("negative"), F.col("refused")))


def confusion(scored: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, tp, tn, fp, fn, accuracy in percent) of rows with an outcome."""
    o = F.col("outcome")
    counts = scored.groupBy(*(keys or [])).agg(*[F.count_if(o == k).alias(k.lower()) for k in ("TP", "TN", "FP", "FN")], F.count(F.lit(1)).alias("n"))
    return counts.select(*(keys or []), "tp", "tn", "fp", "fn", F.round(100.0 * (F.col("tp") + F.col("tn")) / F.greatest(F.col("n"), F.lit(1)), 6).alias("accuracy"))


def rollup(scored: DataFrame, keys: list[str], measures: dict[str, Column]) -> DataFrame:
    """Measures by all keys, by each prefix of them and overall; a key that is summed over reads 'all'."""
    out = scored.rollup(*keys).agg(*[m.alias(n) for n, m in measures.items()], *[F.grouping(k).alias(f"g_{k}") for k in keys])
    return out.select(*[F.when(F.col(f"g_{k}") == 1, "all").otherwise(F.col(k)).alias(k) for k in keys], *measures)


def mrr(hits: DataFrame) -> DataFrame:
    """(mrr, recall_at_1, n) in percent of (qid, hit_rank), where 0 is a miss."""
    r = F.col("hit_rank")
    return hits.agg(
        F.round(100 * F.avg(F.when(r > 0, 1 / r).otherwise(F.lit(0.0))), 6).alias("mrr"), F.round(100 * F.avg(F.when(r == 1, 1.0).otherwise(0.0)), 6).alias("recall_at_1"), F.count(F.lit(1)).alias("n")
    )


def latency(df: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """(keys, mean, median, low, high) with the exact median."""
    c = F.col(column)
    return df.groupBy(*(keys or [])).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.percentile(c, 0.5), 6).alias("median"), F.min(c).alias("low"), F.max(c).alias("high"))


def score_distribution(df: DataFrame, metrics: list[str]) -> DataFrame:
    """(metric, mean, low, high, valid, s1 .. s5) of columns with scores 1 to 5; null is not valid."""
    long = df.unpivot([], metrics, "metric", "score")
    s = F.col("score")
    return long.groupBy("metric").agg(F.round(F.avg(s), 6).alias("mean"), F.min(s).alias("low"), F.max(s).alias("high"), F.count(s).alias("valid"), *[F.count_if(s == k).alias(f"s{k}") for k in range(1, 6)])


def judged_summary(judged: DataFrame, metrics: list[str], threshold: int = 4) -> DataFrame:
    """score_distribution, and how many false negatives a score of at least the threshold rewards."""
    base = score_distribution(judged, metrics)
    fn = judged.where(F.col("outcome") == "FN").unpivot([], metrics, "metric", "score").groupBy("metric").agg(F.count_if(F.col("score") >= threshold).alias("rewarded_fn"))
    return base.join(fn, "metric", "left").na.fill(0, ["rewarded_fn"])


def unfinished(rows: DataFrame, judged: DataFrame, keys: list[str], scores: list[str]) -> DataFrame:
    """Rows that have no complete judgement yet: resume by anti join."""
    complete = judged.where(" and ".join(f"{s} is not null" for s in scores)).select(*keys).distinct()
    return rows.join(complete, keys, "left_anti")


def rank_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(qid, same_set, same_order, entered, gone) of two rankings (qid, chunk_id, rank)."""
    gather = lambda d, n: d.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))), lambda x: x["chunk_id"]).alias(n))
    j = gather(old, "a").join(gather(new, "b"), "qid", "full")
    a, b = (F.coalesce(c, F.array().cast("array<bigint>")) for c in ("a", "b"))
    return j.select("qid", (F.sort_array(a) == F.sort_array(b)).alias("same_set"), (a == b).alias("same_order"), F.sort_array(F.array_except(b, a)).alias("entered"), F.sort_array(F.array_except(a, b)).alias("gone"))


def error_streaks(df: DataFrame, limit: int = 3) -> DataFrame:
    """(set_name, first_pos) of the first run of ``limit`` consecutive failures of (set_name, pos, failed)."""
    w = Window.partitionBy("set_name").orderBy("pos")
    back = df.withColumn("k", F.sum(F.col("failed").cast("int")).over(w.rowsBetween(-(limit - 1), 0)))
    return back.where(F.col("k") == limit).groupBy("set_name").agg((F.min("pos") - (limit - 1)).alias("first_pos"))


def truth_skeleton(questions: DataFrame, old: DataFrame) -> DataFrame:
    """(id, question, refs, keywords) for every question; what was filled in before stays only where the
    question's text is the same."""
    o = old.select("id", F.col("question").alias("was"), F.col("refs").alias("r"), F.col("keywords").alias("k"))
    same, none = F.col("was") == F.col("question"), F.array().cast("array<string>")
    j = questions.select("id", "question").join(o, "id", "left")
    return j.select("id", "question", F.when(same, F.coalesce("r", none)).otherwise(none).alias("refs"), F.when(same, F.coalesce("k", none)).otherwise(none).alias("keywords"))


def fill_status(truth: DataFrame) -> DataFrame:
    """(set_name, total, negatives, filled, needed, pct) by set and for all; negatives need no reference."""
    filled = F.size("refs") > 0
    out = truth.rollup("set_name").agg(
        F.count(F.lit(1)).alias("total"), F.count_if("negative").alias("negatives"), F.count_if(filled & ~F.col("negative")).alias("filled"), F.count_if(~F.col("negative")).alias("needed"), F.grouping("set_name").alias("g")
    )
    return out.select(F.when(F.col("g") == 1, "all").otherwise(F.col("set_name")).alias("set_name"), "total", "negatives", "filled", "needed", F.when(F.col("needed") == 0, 100.0).otherwise(F.round(100.0 * F.col("filled") / F.col("needed"), 1)).alias("pct"))


def judge_scores(text: Column, names: list[str]) -> Column:
    """struct of scores from JSON in prose: rounded, held to 1 to 5, null for anything but a number."""
    body = F.regexp_extract(text, "(?s)(\\{.*\\})", 1)
    parts = []
    for n in names:
        value = F.get_json_object(body, f"$.{n}").try_cast("double")
        parts.append(F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(1), F.least(F.lit(5), F.round(value).cast("int")))).alias(n))
    return F.struct(*parts)


def ranks_of_targets(ranking: DataFrame, targets: DataFrame, confusers: DataFrame) -> DataFrame:
    """(qid, first, ahead): rank of the first target of a ranking (qid, chunk_id, rank), and how many
    confusers stand before it; a question without a found target has null and all its confusers."""
    marked = ranking.join(targets.select("qid", "chunk_id", F.lit(True).alias("target")), ["qid", "chunk_id"], "left").join(confusers.select("qid", "chunk_id", F.lit(True).alias("confuser")), ["qid", "chunk_id"], "left")
    first = F.min(F.when(F.col("target"), F.col("rank"))).over(Window.partitionBy("qid"))
    return marked.withColumn("first", first).groupBy("qid", "first").agg(F.count_if(F.col("confuser") & (F.col("first").isNull() | (F.col("rank") < F.col("first")))).alias("ahead"))


def run_report(rows: DataFrame) -> DataFrame:
    """(label, n, ids) of a run's validation labels (id, status): the first word of the status tells the group."""
    label = F.element_at(F.split("status", " "), 1)
    return rows.groupBy(label.alias("label")).agg(F.count(F.lit(1)).alias("n"), F.sort_array(F.collect_list("id")).alias("ids"))
