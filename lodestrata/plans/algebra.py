"""A bounded plan algebra: JSON-like specifications compiled to DataFrame calls.

It stands in for free code over a table: only listed steps and functions exist, so a specification
cannot read files or run code. A run reports whether a filter let no row through.
"""

from __future__ import annotations

import threading
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import numeric
from ..operators import aggregates


LIMIT = 1000  # rows of an answer that reach the driver


class PlanError(ValueError):
    """A specification that the algebra does not allow; its text is feedback for whoever wrote it."""


COMPARISONS = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
}
AGGREGATES = {
    "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count, "nunique": F.count_distinct, "median": lambda c: F.percentile(c, 0.5),
}


def _column(df: DataFrame, name: str) -> Column:
    if name not in df.columns:
        raise PlanError(f"no column {name!r}; there are {', '.join(df.columns)}")
    return F.col(f"`{name}`")


def predicate(df: DataFrame, spec: dict) -> Column:
    """{"and"|"or": [..]}, {"not": p} or {"col": c, "op": o, "value": v}."""
    if "and" in spec or "or" in spec:
        parts = [predicate(df, p) for p in spec.get("and", spec.get("or"))]
        if not parts:
            raise PlanError("and/or needs at least one part")
        out = parts[0]
        for p in parts[1:]:
            out = out & p if "and" in spec else out | p
        return out
    if "not" in spec:
        return ~predicate(df, spec["not"])
    c, op, v = _column(df, spec["col"]), spec.get("op"), spec.get("value")
    if op in COMPARISONS:
        return COMPARISONS[op](c, F.lit(v))
    text = {"startswith": c.startswith, "contains": c.contains, "endswith": c.endswith}
    if op in text:
        return text[op](v)
    if op == "isin":
        return c.isin(list(v))
    if op == "isnull":
        return c.isNull()
    if op == "notnull":
        return c.isNotNull()
    raise PlanError(f"unknown comparison {op!r}")


def expression(df: DataFrame, spec) -> Column:
    """A number, a string literal {"lit": x}, a column {"col": c}, or {"op": + - * / haversine percent_change, "args": [..]}."""
    if isinstance(spec, (int, float, bool)):
        return F.lit(spec)
    if "lit" in spec:
        return F.lit(spec["lit"])
    if "col" in spec:
        return _column(df, spec["col"])
    args = [expression(df, a) for a in spec.get("args", [])]
    two = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": lambda a, b: F.when(b != 0, a / b), "percent_change": numeric.percent_change}
    if spec.get("op") in two and len(args) == 2:
        return two[spec["op"]](*args)
    if spec.get("op") == "haversine" and len(args) == 4:
        return numeric.haversine(*args)
    raise PlanError(f"unknown expression {spec!r}")


def _step(df: DataFrame, step: dict) -> DataFrame:
    kind = step.get("step")
    if kind == "filter":
        return df.where(predicate(df, step["where"]))
    if kind == "select":
        return df.select(*[_column(df, c) for c in step["columns"]])
    if kind == "with":
        return df.withColumn(step["name"], expression(df, step["expr"]))
    if kind == "group":
        aggs = []
        for name, (fn, col) in step["aggs"].items():
            if fn not in AGGREGATES:
                raise PlanError(f"unknown aggregate {fn!r}; there are {', '.join(AGGREGATES)}")
            aggs.append(AGGREGATES[fn](_column(df, col)).alias(name))
        keys = [_column(df, k) for k in step.get("keys", [])]
        return df.groupBy(*keys).agg(*aggs)
    if kind == "value_counts":
        return aggregates.value_counts(df, step["column"])
    if kind == "explode":
        return df.withColumn(step["column"], F.explode(_column(df, step["column"])))
    if kind == "sort":
        keys = [(F.desc if k.startswith("-") else F.asc)(k.lstrip("-")) for k in step["by"]]
        out = df.orderBy(*keys)
        return out.limit(int(step["limit"])) if "limit" in step else out
    if kind == "ratio":
        return aggregates.ratio(df, predicate(df, step["where"]), step.get("digits", 1))
    if kind == "signed_sum":
        return aggregates.signed_sum(df, _column(df, step["amount"]), predicate(df, step["positive"]), step.get("keys"))
    if kind == "scenario_delta":
        return aggregates.scenario_delta(df, _column(df, step["amount"]), predicate(df, step["narrow"]), predicate(df, step["wide"]))
    raise PlanError(f"unknown step {kind!r}")


def compile_plan(df: DataFrame, steps: list[dict]) -> DataFrame:
    for step in steps:
        df = _step(df, step)
    return df


def bounded(df: DataFrame, limit: int = LIMIT) -> tuple[list[dict], int]:
    """The first ``limit`` rows and the number of all rows, which are counted only where there are more."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return (rows, len(rows)) if len(rows) <= limit else (rows[:limit], df.count())


def _filled(df: DataFrame) -> Column:
    out = F.lit(False)
    for c in df.columns:
        out = out | F.col(f"`{c}`").isNotNull()
    return out


def _observed(df: DataFrame, steps: list[dict]) -> tuple[DataFrame, dict[int, tuple[Observation, DataFrame]]]:
    """The compiled plan, which counts by the way how many rows pass each filter."""
    seen = {}
    for i, step in enumerate(steps):
        df = _step(df, step)
        if step.get("step") == "filter":
            watch = Observation(f"filter-{i}-{uuid.uuid4().hex}")
            before, df = df, df.observe(watch, F.count(F.lit(1)).alias("n"))
            seen[i] = watch, before
    return df, seen


def _passed(watch: Observation, before: DataFrame) -> bool:
    """Whether a filter let rows through. Spark may have dropped the count of a part that it found empty."""
    try:
        return watch.get["n"] > 0
    except Exception:  # no count was kept
        return not before.isEmpty()


#: Rules of the adaptive planner that drop a part, and the counts in it, once it has turned out empty.
_DROPS = "org.apache.spark.sql.execution.adaptive.AQEPropagateEmptyRelation"


@contextmanager
def _counts_kept(spark):
    key = "spark.sql.adaptive.optimizer.excludedRules"
    before = spark.conf.get(key, None)
    spark.conf.set(key, f"{before},{_DROPS}" if before else _DROPS)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def run_plan(df: DataFrame, steps: list[dict], timeout: float = 60.0, limit: int = LIMIT) -> dict:
    """{"rows", "n_rows", "truncated", "columns", "status", "empty_filter"} or {"error"}.

    At most ``limit`` rows reach the driver; n_rows counts all, truncated tells whether rows were cut.
    empty_filter lists the filter steps that no row passed; the one run counts them. A run over its time is
    cancelled by its tag.
    """
    spark = df.sparkSession
    try:
        current, seen = _observed(df, steps)
        tag = f"plan-{uuid.uuid4().hex}"
        spark.addTag(tag)
        timer = threading.Timer(timeout, lambda: spark.interruptTag(tag))
        timer.start()
        try:
            with _counts_kept(spark):
                rows = [r.asDict(recursive=True) for r in current.limit(limit + 1).collect()]
            empty = [i for i, (watch, before) in seen.items() if not _passed(watch, before)]
            n_rows = len(rows) if len(rows) <= limit else compile_plan(df, steps).count()
            # an empty answer is one without any value, also beyond the rows that came
            blank = all(v is None for r in rows[:limit] for v in r.values()) and (n_rows <= limit or current.where(_filled(current)).isEmpty())
        finally:
            timer.cancel()
            spark.removeTag(tag)
    except PlanError as e:
        return {"error": str(e)}
    except Exception as e:  # reported to the caller, who may correct the plan
        return {"error": f"{type(e).__name__}: {str(e)[:400]}"}
    return {"rows": rows[:limit], "n_rows": n_rows, "truncated": n_rows > limit, "columns": current.columns, "empty_filter": empty, "status": "empty" if empty or blank else "ok"}
