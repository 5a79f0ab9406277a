"""Grouped summaries that questions ask for. Every function returns a DataFrame; ties are pinned."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import normalize

VOCABULARY_MAX, VOCABULARY_MIN_LENGTH = 60, 4


def _c(name: str) -> Column:
    """A column by its name, which may hold dots."""
    return F.col("`" + name.strip("`") + "`")


def ratio(df: DataFrame, predicate: Column, digits: int = 1) -> DataFrame:
    """(n, total, pct) of rows that fulfil a predicate; pct is 0 for an empty table."""
    one = df.agg(F.count_if(predicate).alias("n"), F.count(F.lit(1)).alias("total"))
    return one.select("n", "total", F.when(F.col("total") == 0, 0.0).otherwise(F.round(100.0 * F.col("n") / F.col("total"), digits)).alias("pct"))


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(value, n) without nulls, most frequent first."""
    return df.where(_c(column).isNotNull()).groupBy(_c(column).alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def exploded_counts(df: DataFrame, column: str) -> DataFrame:
    """value_counts over the entries of an array column; repeats within an array count."""
    return value_counts(df.select(F.explode(_c(column)).alias("value")), "value")


def top_excluding(counts: DataFrame, excluded: str | None, n: int = 2) -> DataFrame:
    """The first and further values other than the excluded one."""
    kept = counts if excluded is None else counts.where(F.col("value") != excluded)
    return kept.orderBy(F.desc("n"), "value").limit(n)


def distinct_and_top(df: DataFrame, column: str, n: int) -> DataFrame:
    """(value, n, n_distinct): the n most frequent values, each with the number of distinct ones."""
    counts = df.where(_c(column).isNotNull()).groupBy(_c(column).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.count(F.lit(1)).alias("n_distinct"))
    return counts.orderBy(F.desc("n"), "value").limit(n).crossJoin(total)


def distribution_filter(counts: DataFrame, target: Column) -> DataFrame:
    """(kind, name, n): groups whose count equals the target, and how many groups have each other count."""
    same = counts.where(F.col("n") == target).select(F.lit("match").alias("kind"), F.col("value").alias("name"), "n")
    other = counts.where(F.col("n") != target).groupBy(F.col("n").cast("string").alias("name")).agg(F.count(F.lit(1)).alias("n")).select(F.lit("other").alias("kind"), "name", "n")
    return same.unionByName(other)


def vocabulary(df: DataFrame, name: str) -> DataFrame:
    """(dataset, column, value): normalized values, at least four characters long, of string columns with at
    most sixty distinct values. One pass finds the columns."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not strings:
        return df.sparkSession.createDataFrame([], "dataset string, column string, value string")
    sizes = df.agg(*[F.count_distinct(_c(c)).alias(c) for c in strings]).first()
    small = [c for c in strings if 0 < sizes[c] <= VOCABULARY_MAX]
    out = df.sparkSession.createDataFrame([], "dataset string, column string, value string")
    for c in small:
        part = df.where(_c(c).isNotNull()).select(F.lit(name).alias("dataset"), F.lit(c).alias("column"), normalize(F.trim(_c(c))).alias("value")).distinct()
        out = out.unionByName(part.where(F.length("value") >= VOCABULARY_MIN_LENGTH))
    return out


def few_values(df: DataFrame, columns: list[str], limit: int) -> dict[str, list[str]]:
    """All values of the columns that have from one to ``limit`` distinct ones, in order."""
    sizes = df.agg(*[F.count_distinct(_c(c)).alias(f"n{i}") for i, c in enumerate(columns)]).first()
    small = [c for i, c in enumerate(columns) if 0 < sizes[i] <= limit]
    if not small:
        return {}
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), _c(c).cast("string").alias("value")) for c in small])).alias("pair")
    rows = df.select(pairs).select("pair.*").where("value is not null").distinct().collect()  # at most limit a column
    return {c: sorted(r["value"] for r in rows if r["column"] == c) for c in small}


def signed_sum(df: DataFrame, amount: Column, positive: Column, keys: list[str] | None = None) -> DataFrame:
    """(keys, net): amounts of positive rows minus those of all others, in decimal; 0 without rows."""
    a = amount.cast("decimal(18,4)")
    return df.groupBy(*(keys or [])).agg(F.coalesce(F.sum(F.when(positive, a).otherwise(-a)), F.lit(0)).cast("double").alias("net"))


def scenario_delta(df: DataFrame, amount: Column, narrow: Column, wide: Column) -> DataFrame:
    """(narrow, wide, delta) of sums under two conditions, in one pass."""
    a = amount.cast("decimal(18,4)")
    s = lambda p: F.coalesce(F.sum(F.when(p, a)), F.lit(0))
    one = df.agg(s(narrow).alias("a"), s(wide).alias("b"))
    return one.select(F.col("a").cast("double").alias("narrow"), F.col("b").cast("double").alias("wide"), (F.col("b") - F.col("a")).cast("double").alias("delta"))


def guarded(df: DataFrame, predicate: Column, aggregate: Column) -> DataFrame:
    """(value, matched, status): an aggregate over a filter, with the number of rows that passed, so that
    'no matching rows' is told from a legitimate zero. A mask and its count cost one scan."""
    one = df.where(predicate).agg(aggregate.alias("value"), F.count(F.lit(1)).alias("matched"))
    return one.select("value", "matched", F.when(F.col("matched") == 0, "empty").otherwise("ok").alias("status"))


def profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, n, low, high, n_distinct) of numeric columns, in one pass."""
    parts = []
    for c in columns:
        parts += [F.count(c).alias(f"n_{c}"), F.min(c).cast("double").alias(f"lo_{c}"), F.max(c).cast("double").alias(f"hi_{c}"), F.count_distinct(c).alias(f"d_{c}")]
    one = df.agg(*parts)
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"lo_{c}").alias("low"), F.col(f"hi_{c}").alias("high"), F.col(f"d_{c}").alias("n_distinct")) for c in columns]
    return one.select(F.inline(F.array(*rows)))


#: Pairs of values that mark a sign column (fixed values).
SIGN_PAIRS = [("credit", "debit"), ("alacak", "borç"), ("in", "out"), ("giriş", "çıkış")]


def sign_columns(df: DataFrame) -> list[tuple[str, str, str]]:
    """(column, positive, negative) for string columns with at most six distinct values among them a pair
    of opposite ones."""
    strings = [f.name for f in df.schema.fields if f.dataType.simpleString() == "string"]
    if not strings:
        return []
    low = lambda c: F.lower(F.trim(_c(c)))
    size = df.agg(*[F.count_distinct(low(c)).alias(c) for c in strings]).first()
    few = [c for c in strings if 0 < size[c] <= 6]
    if not few:
        return []
    seen = df.agg(*[F.collect_set(low(c)).alias(c) for c in few]).first()
    return [(c, a, b) for c in few for a, b in SIGN_PAIRS if {a, b} <= set(seen[c])]


def histogram(df: DataFrame, column: str, bins: int = 8) -> DataFrame:
    """(bin, n): equal bins from least to greatest value, the last one closed; empty bins are listed."""
    c = F.col(column)
    ends = df.agg(F.min(c).alias("lo"), F.max(c).alias("hi"))
    placed = df.where(c.isNotNull()).crossJoin(F.broadcast(ends))
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(F.least(F.lit(bins - 1), F.floor((c - F.col("lo")) / ((F.col("hi") - F.col("lo")) / bins)).cast("int")))
    counts = placed.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(counts, "bin", "left").select("bin", F.coalesce("n", F.lit(0)).alias("n"))


def chart(counts: DataFrame, unit: str | None = None) -> DataFrame:
    """(category, value, total, n_categories, top, highest, mean, kind): chart rows with their key figures.

    kind: donut for at most six categories with a unit, horizontal above eight, else bar. Fewer than two
    categories make no chart: no row.
    """
    kpi = counts.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("n_categories"), F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("top"), F.max("n").alias("highest"), F.avg("n").alias("mean")
    )
    kind = F.when((F.col("n_categories") <= 6) & F.lit(unit is not None), "donut").when(F.col("n_categories") > 8, "horizontal").otherwise("bar")
    return counts.crossJoin(F.broadcast(kpi.where("n_categories >= 2"))).select(F.col("value").alias("category"), F.col("n").alias("value"), "total", "n_categories", "top", "highest", "mean", kind.alias("kind"))


def collisions(tokens: DataFrame, words: list[str] | None = None) -> DataFrame:
    """(word, n, n_chunks, n_sources) of (chunk_id, source, token); a chunk belongs to one source. Counted
    by chunk, then by source, then by word: plain sums, each of which is combined before it is dealt."""
    t = tokens if words is None else tokens.where(F.col("token").isin(words))
    by_chunk = t.groupBy(F.col("token").alias("word"), "source", "chunk_id").agg(F.count(F.lit(1)).alias("n"))
    by_source = by_chunk.groupBy("word", "source").agg(F.sum("n").alias("n"), F.count("chunk_id").alias("n_chunks"))
    return by_source.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_chunks").alias("n_chunks"), F.count("source").alias("n_sources"))


def runs(df: DataFrame, key: str, order: str, same: Column) -> DataFrame:
    """Gaps and islands: rows of a key in order, numbered by stretches; ``same`` says whether a row goes on."""
    w = Window.partitionBy(key).orderBy(order)
    flagged = df.withColumn("new", F.when(F.coalesce(same, F.lit(False)), 0).otherwise(1))
    return flagged.withColumn("run", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("new")


#: Names of coordinate columns and the range of their values (fixed values).
COORDINATES = {"lat": (["lat", "latitude", "enlem"], 90.0), "lon": (["lon", "lng", "longitude", "boylam"], 180.0)}


def coordinate_pair(df: DataFrame) -> tuple[str, str] | None:
    """(latitude, longitude) columns: a name that says so, numbers within range and at least two values."""
    numeric = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint") or f.dataType.simpleString().startswith("decimal")]
    named = {kind: [c for c in numeric if set(c.lower().replace(".", "_").split("_")) & set(names)] for kind, (names, _) in COORDINATES.items()}
    asked = named["lat"] + named["lon"]
    if not named["lat"] or not named["lon"]:
        return None
    one = df.agg(*[f(F.col(f"`{c}`")).alias(f"{i}_{c}") for c in asked for i, f in enumerate((F.min, F.max, F.count))]).first()
    fits = lambda c, most: one[f"2_{c}"] >= 2 and -most <= one[f"0_{c}"] and one[f"1_{c}"] <= most
    found = [next((c for c in named[kind] if fits(c, most)), None) for kind, (_, most) in COORDINATES.items()]
    return tuple(found) if all(found) else None


#: Names of amount columns, the most telling first (fixed values).
AMOUNTS = ["amount", "tutar", "miktar", "price", "fiyat", "total", "toplam", "balance", "bakiye"]


def amount_column(df: DataFrame) -> str | None:
    """The amount column by name, else the first numeric one."""
    numeric = [f.name for f in df.schema.fields if f.dataType.simpleString() in ("double", "float", "int", "bigint")]
    return next((c for n in AMOUNTS for c in numeric if n in c.lower()), numeric[0] if numeric else None)


def first_values(df: DataFrame, column: str, order: str, n: int = 5) -> DataFrame:
    """The first n distinct values of a column in order of another one."""
    return df.where(_c(column).isNotNull()).groupBy(_c(column).alias("value")).agg(F.min(order).alias("at")).orderBy("at", "value").limit(n).select("value")
