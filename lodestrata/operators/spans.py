"""Spans within texts, and names that can be taken for one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written


def outermost(spans: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """The spans of each key that no longer span of the key contains; spans that are equal stay together.

    A sweep instead of a self-join: in order of their starts, the longer first, a span lies in an earlier one
    exactly if the greatest end so far reaches its own. Spans without a start or an end contain nothing and stay.
    """
    order = Window.partitionBy(*keys).orderBy(start, F.desc(end)).rowsBetween(Window.unboundedPreceding, -1)
    places = spans.select(*keys, start, end).where(F.col(start).isNotNull() & F.col(end).isNotNull()).distinct()
    inner = places.withColumn("__reach", F.max(end).over(order)).where(F.col("__reach") >= F.col(end)).drop("__reach")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, start, end)]
    on = same[0]
    for s in same[1:]:
        on = on & s
    return spans.alias("a").join(inner.alias("b"), on, "left_anti")


def confusable(rows: DataFrame, name: Column) -> DataFrame:
    """rows with last (the last word of a name, lower case) and confusable: whether another row's name has the same last
    word and a different rest.

    No pairs are made: a word's least and greatest rest settle it, and they are summed before they are shuffled. A
    name of one word has an empty rest; null and blank names are not confusable.
    """
    words = F.filter(F.split(F.lower(name), "\\s+"), lambda w: w != "")
    n = F.size(words)
    named = rows.select("*", F.when(n > 0, F.element_at(words, -1)).alias("last"), F.when(n > 0, F.array_join(F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))), " ")).alias("__rest"))
    ends = written(named.where("last is not null").groupBy("last").agg(F.min("__rest").alias("__low"), F.max("__rest").alias("__high")), "ends")
    told = named.join(ends, "last", "left")
    return told.select(*rows.columns, "last", F.coalesce(F.col("__low") != F.col("__high"), F.lit(False)).alias("confusable"))
