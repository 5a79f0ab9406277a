"""Chunking: paragraphs, greedy merging, continued pages, record rendering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import CONTEXT_MAX, KEY_MAX, narrative, section_number

MERGE_MIN_CHARS, RECORD_MAX = 500, 3000


def paragraphs(text: Column, separator: str = "\n\n") -> Column:
    """array<struct(n, text)>: trimmed paragraphs, numbered from 1, without blank ones."""
    kept = F.filter(F.transform(F.split(text, separator), lambda p: F.trim(F.regexp_replace(p, "^\\s+|\\s+$", ""))), lambda p: p != "")
    return F.transform(kept, lambda p, i: F.struct((i + 1).alias("n"), p.alias("text")))


def merged(parts: Column, minimum: int = MERGE_MIN_CHARS) -> Column:
    """array<struct(first, last, text)>: paragraphs joined until each chunk has the minimum length; what is
    left at the end joins the last chunk. A fold, since each cut depends on the one before."""
    chunk = "struct<first:int,last:int,text:string>"
    start = F.struct(F.array().cast(f"array<{chunk}>").alias("done"), F.lit(None).cast(chunk).alias("open"))

    def step(acc: Column, p: Column) -> Column:
        o = acc["open"]
        grown = F.when(o.isNull(), F.struct(p["n"].cast("int").alias("first"), p["n"].cast("int").alias("last"), p["text"].alias("text"))).otherwise(
            F.struct(o["first"].alias("first"), p["n"].cast("int").alias("last"), F.concat(o["text"], F.lit("\n\n"), p["text"]).alias("text"))
        )
        full = F.length(grown["text"]) >= minimum
        return F.struct(F.when(full, F.array_append(acc["done"], grown)).otherwise(acc["done"]).alias("done"), F.when(~full, grown).cast(chunk).alias("open"))

    def finish(acc: Column) -> Column:
        done, o = acc["done"], acc["open"]
        last = F.get(done, F.size(done) - 1)
        joined = F.struct(last["first"].alias("first"), o["last"].alias("last"), F.concat(last["text"], F.lit("\n\n"), o["text"]).alias("text"))
        return F.when(o.isNull(), done).when(F.size(done) == 0, F.array(o)).otherwise(F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(joined)))

    return F.aggregate(parts, start, step, finish)


def locator(kind: str, first: Column, last: Column) -> Column:
    """For example ``paragraf 1-2``, or ``paragraf 3`` for a single one."""
    return F.when(first == last, F.concat(F.lit(kind + " "), first.cast("string"))).otherwise(F.concat(F.lit(kind + " "), first.cast("string"), F.lit("-"), last.cast("string")))


def text_chunks(files: DataFrame, separator: str = "\n\n", minimum: int = MERGE_MIN_CHARS) -> DataFrame:
    """(source, seq, content, page_info) of (source, value)."""
    rows = files.select("source", F.posexplode(merged(paragraphs(F.col("value"), separator), minimum)).alias("seq", "c"))
    return rows.select("source", "seq", F.col("c.text").alias("content"), locator("paragraf", F.col("c.first"), F.col("c.last")).alias("page_info"))


def continued_pages(pages: DataFrame) -> DataFrame:
    """(source, first, last, content, page_info): recognised pages that go on with the section of the page
    just before are joined. pages: (source, page, text, recognised). Blank pages are passed over."""
    w = Window.partitionBy("source").orderBy("page")
    p = pages.where(F.length(F.trim("text")) > 0).withColumn("section", section_number(F.col("text")))
    goes_on = F.col("recognised") & F.lag("recognised").over(w) & (F.col("section") == F.lag("section").over(w)) & (F.col("page") == F.lag("page").over(w) + 1)
    grouped = p.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("g", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    out = grouped.groupBy("source", "g").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.transform(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda x: x["text"]).alias("t"))
    return out.select("source", "first", "last", F.array_join("t", "\n").alias("content"), locator("sayfa", F.col("first"), F.col("last")).alias("page_info"))


def blocks(rows: DataFrame) -> DataFrame:
    """(source, block, content): consecutive rows (source, n, text), closed by blank ones."""
    w = Window.partitionBy("source").orderBy("n")
    blank = F.trim("text") == ""
    numbered = rows.withColumn("b", F.sum(blank.cast("int")).over(w)).where(~blank)
    grouped = numbered.groupBy("source", "b").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("t"))
    order = Window.partitionBy("source").orderBy("b")
    return grouped.select("source", F.row_number().over(order).alias("block"), F.array_join("t", "\n").alias("content"))


def record_text(fields: Column) -> Column:
    """One record as text: key fields twice, then context, then narrative fields, each ``name: value``.

    fields: array<struct(name, value)> in order.
    """
    band = lambda low, high: F.filter(fields, lambda f: (F.length(f["value"]) > low) & (F.length(f["value"]) <= high))
    show = lambda xs: F.transform(xs, lambda f: F.concat(f["name"], F.lit(": "), narrative(f["value"])))
    key = show(band(0, KEY_MAX))
    return F.array_join(F.concat(key, key, show(band(KEY_MAX, CONTEXT_MAX)), show(band(CONTEXT_MAX, 1 << 30))), "\n")
