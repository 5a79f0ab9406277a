"""Routing of questions: signals as boolean columns, one decision chain. One question is the one-row case."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import FOLD_FROM, FOLD_TO, contains_token, route_form
from ..operators.shared import written
from . import signals

RULES, META, SEMANTIC, CODE = "rule_engine", "meta_query", "semantic_rag", "code_interpreter"


def plain(word: str) -> str:
    """A word of the lists in the form in which questions are compared."""
    return word.replace("İ", "i").replace("I", "ı").lower().translate(str.maketrans(FOLD_FROM, FOLD_TO))


def variants(column: str) -> list[str]:
    """A column's name, its parts and their aliases, without those too short or general."""
    parts = [column, *re.split(r"[._\s-]+", column), *re.findall(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", column)]
    names = list(dict.fromkeys(p.lower() for p in parts if p))
    out = [n for n in names if len(n) >= 3 and n not in signals.NO_COLUMN]
    for n in names:
        out += signals.ALIASES.get(n, [])
    return list(dict.fromkeys(plain(x) for x in out))


def schema_words(columns: list[str]) -> tuple[list[str], list[str]]:
    """(strong, weak) words of a schema; weak ones are general words that need a data set context."""
    words = list(dict.fromkeys(v for c in columns for v in variants(c)))
    return [w for w in words if w not in signals.WEAK_WORDS], [w for w in words if w in signals.WEAK_WORDS]


def _any(checks: list[Column]) -> Column:
    out = F.lit(False)
    for c in checks:
        out = out | c
    return out


def _patterns(c: Column, patterns: list[str]) -> Column:
    return c.rlike("(?iU)" + "|".join(f"(?:{p})" for p in patterns))


def route(questions: DataFrame, columns: list[str] | None = None, selected: Column | None = None) -> DataFrame:
    """questions (qid, question) with the signals, target and reason.

    columns: names of the tables' columns. selected: whether the question comes with a chosen table.
    """
    strong, weak = schema_words(columns or [])
    q = questions.withColumn("low", F.lower(F.trim("question"))).withColumn("norm", route_form(F.trim("question")))
    low, norm = F.col("low"), F.col("norm")
    words = lambda ws: _any([contains_token(norm, w) for w in ws])
    q = q.select(
        "*",
        _patterns(low, signals.SIMPLE_RULES).alias("simple"),
        _patterns(low, signals.META).alias("meta"),
        _patterns(low, signals.CONCEPT).alias("concept"),
        words([plain(w) for w in signals.COMPLEX]).alias("complex"),
        words(strong).alias("strong"),
        words(weak).alias("weak"),
        _patterns(norm, signals.GENERIC).alias("generic"),
        _patterns(norm, signals.CONTEXT).alias("context"),
        words([plain(w) for w in signals.INTERROGATIVE]).alias("interrogative"),
    )
    q = q.withColumn("dataset", (selected if selected is not None else F.lit(False)) | F.col("strong") | F.col("generic") | (F.col("weak") & F.col("context")))
    chain = [
        (F.col("simple"), RULES, "simple_rule_pattern"),
        (F.col("meta"), META, "meta_query_pattern"),
        (F.col("concept"), SEMANTIC, "schema_or_doc_conceptual"),
        (F.col("complex") & F.col("dataset"), CODE, "complexity_signal+dataset_signal"),
        (F.col("dataset") & F.col("interrogative"), CODE, "dataset_signal+interrogative"),
    ]
    target, reason = F.lit(SEMANTIC), F.lit("fallback_semantic")
    for condition, t, r in reversed(chain):
        target, reason = F.when(condition, t).otherwise(target), F.when(condition, r).otherwise(reason)
    return q.select("*", target.alias("target"), reason.alias("reason")).drop("low", "norm")


def schema_columns(schema) -> list[str]:
    """Column names of a mapping, of several mappings, of a list of mappings or of names."""
    if not schema:
        return []
    if isinstance(schema, dict):
        out = []
        for k, v in schema.items():
            out += schema_columns(v) if isinstance(v, (dict, list)) else [k]
        return list(dict.fromkeys(out))
    return list(dict.fromkeys(c for x in schema for c in (schema_columns(x) if isinstance(x, dict) else [x])))


#: Patterns that one automaton holds; more go in further passes.
PATTERNS = 50_000


def _found(patterns: list[tuple[int, str, bool]]):
    """Arrow batches (qid, norm) to (qid, pattern): one walk over a question finds all patterns that it holds. A
    pattern that has to start a word is taken only where no word character stands before it."""

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        by_text: dict[str, list[tuple[int, bool]]] = {}
        for i, pattern, starts in patterns:
            by_text.setdefault(pattern, []).append((i, starts))
        for pattern, which in by_text.items():
            automaton.add_word(pattern, (len(pattern), which))
        automaton.make_automaton()
        for batch in batches:
            qids, hits = [], []
            for qid, norm in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = set()
                for end, (size, which) in automaton.iter(norm or ""):
                    before = norm[end - size] if end >= size else " "
                    inside = before.isalnum() or before == "_"
                    seen.update(i for i, starts in which if not (starts and inside))
                qids += [qid] * len(seen)
                hits += sorted(seen)
            yield pa.RecordBatch.from_arrays([pa.array(qids, batch.schema.field(0).type), pa.array(hits, pa.int64())], ["qid", "pattern"])

    return found


def matches(questions: DataFrame, patterns: DataFrame) -> DataFrame:
    """(qid, dataset, kind, text) of the patterns (dataset, kind, text, starts) that questions (qid, norm) hold.

    starts: whether a pattern has to start a word. Rows come out only for matches; patterns travel to the tasks in
    blocks of at most PATTERNS, each as one automaton.
    """
    named = written(patterns.where("text <> ''").distinct().withColumn("pattern", F.monotonically_increasing_id()), "patterns")
    rows = questions.select("qid", "norm")
    kind = rows.schema["qid"].dataType.simpleString()
    blocks = max(1, -(-named.count() // PATTERNS))
    out = None
    for b in range(blocks):
        some = named.where(F.pmod(F.xxhash64("pattern"), F.lit(blocks)) == b).select("pattern", "text", "starts").collect()
        part = rows.mapInArrow(_found([tuple(r) for r in some]), f"qid {kind}, pattern long") if some else None
        out = part if out is None else out if part is None else out.unionByName(part)
    if out is None:
        out = questions.sparkSession.createDataFrame([], f"qid {kind}, pattern long")
    return out.join(named, "pattern").select("qid", "dataset", "kind", "text")


def score_datasets(questions: DataFrame, columns: DataFrame, vocabulary: DataFrame, sizes: DataFrame) -> DataFrame:
    """(qid, dataset, score, rank, gap, reason) for every question and data set.

    columns: (dataset, column); vocabulary: (dataset, column, value); sizes: (dataset, n_rows). A file name's
    word counts 3, each matched column word 1 and each value 2, up to 8 each. Words of columns have to start a
    word of the question; values and parts of names are found anywhere.
    """
    q = questions.select("qid", route_form(F.trim("question")).alias("norm"))
    pattern = lambda kind, text, starts: ("dataset", F.lit(kind).alias("kind"), text.alias("text"), F.lit(starts).alias("starts"))
    names = columns.select(*pattern("column", F.explode(F.transform(F.split("column", "[._]"), lambda x: F.lower(x))), True)).where("length(text) >= 3")
    files = sizes.select(*pattern("file", F.explode(F.split(F.lower("dataset"), "[^a-z]+")), False)).where("length(text) >= 4")
    found = matches(q, names.unionByName(vocabulary.select(*pattern("value", F.col("value"), False))).unionByName(files))
    counts = found.groupBy("qid", "dataset").agg(*[F.count_if(F.col("kind") == k).alias(k) for k in ("column", "value", "file")])
    points = F.least(F.lit(8), F.col("column")) + F.least(F.lit(8), 2 * F.col("value")) + F.when(F.col("file") > 0, 3).otherwise(0)
    every = q.select("qid").crossJoin(sizes)  # the result: a row a question and data set
    scored = every.join(counts.select("qid", "dataset", points.alias("points")), ["qid", "dataset"], "left").select("qid", "dataset", "n_rows", F.coalesce("points", F.lit(0)).cast("double").alias("score"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), F.desc("n_rows"), "dataset")
    ranked = scored.select("*", F.row_number().over(order).alias("rank"), (F.col("score") - F.lead("score").over(order)).alias("gap"), F.lead("score").over(order).alias("next"))
    reason = F.when(F.col("score") <= 0, "fallback_no_signal").when((F.col("next") > 0) & (F.col("gap") < 1.0), "ambiguous_best_score").otherwise("best_score")
    return ranked.select("qid", "dataset", "score", "rank", "gap", F.when(F.col("rank") == 1, reason).alias("reason"))
