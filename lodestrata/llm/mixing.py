"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document gets the exponential key -ln(u) / w: u in (0, 1) from a hash of its id, w a quality
weight from its text. Within a source, documents in key order are a weighted sample without
replacement. A target holds as many complete epochs of its source as fit, and then the documents in
key order that fit into the rest; one more document, the one nearest in size, may close the gap.

No source is sorted as a whole: keys fall into fixed buckets, sizes are summed by (source, bucket),
and only the bucket in which the budget ends is sorted (it is found in two steps of 256). So a source with a third of all rows costs no
single task more than any other, and the choice is one comparison per document.

Edge cases: null and blank texts have size 0 and are taken 0 words; a null source is a source, the
last; a null id hashes as such. Rows equal in id and size share a key and are chosen together. Texts of any
length are counted whole. An empty table gives an empty result. Extra columns are carried, whatever their
names. The sources' weights follow their order, so one task sees all sources: a row of some bytes each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import count_matches, documents, materialize, packed, words

EPOCHS = 3
BUCKETS, STEP = 65536, 256
SYMBOLS = "[#*$%&|<>]"
BROADCAST_SOURCES = 100_000


def quality_weight(text: Column, size: Column) -> Column:
    """1 for plain prose, down to 0.1 where symbols are frequent."""
    return F.greatest(F.lit(0.1), F.lit(1.0) - count_matches(text, SYMBOLS) / F.greatest(size, F.lit(1)))


def keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: str = "mix") -> DataFrame:
    """(__row, id, source, size, k, b): k is the exponential key, b its bucket, in key order."""
    text, ident = F.col(f"`{text_col}`"), F.col(f"`{id_col}`")
    sized = docs.select(packed(docs), ident.alias("id"), F.col(f"`{source_col}`").alias("source"), F.size(words(text)).cast("long").alias("size"), text.alias("t"))
    hashed = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(F.col("id").cast("string"), F.lit("null")), F.col("size").cast("string"))), 1, 13), 16, 10).cast("long")
    u = (hashed.cast("double") + 0.5) / float(1 << 52)
    keyed_rows = sized.select("__row", "id", "source", "size", (-F.log(u) / quality_weight(F.col("t"), F.col("size"))).alias("k"))
    return keyed_rows.select("*", F.least(F.lit(BUCKETS - 1), F.floor((1 - F.exp(-F.col("k"))) * BUCKETS).cast("int")).alias("b"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Weights repeat over the sources in
    code point order, null last. What a capped source leaves is shared out by weight again until no
    source is above ``epochs`` times its size; each round is one aggregation over the sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.select("source", "source_size", F.element_at(cycle, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long").alias("w"))
    ranked = materialize(ranked.select("*", (F.col("source_size") * epochs).alias("cap")), "sources")
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    left, share, fixed = total, ranked.agg(F.sum("w")).first()[0] or 1, -1
    while True:
        # capped: cap * share <= left * w, with whole numbers
        full = F.col("cap").cast("decimal(38,0)") * F.lit(share).cast("decimal(12,0)") <= F.lit(left).cast("decimal(24,0)") * F.col("w").cast("decimal(12,0)")
        n, caps, ws = ranked.where(full).agg(F.count(F.lit(1)), F.coalesce(F.sum("cap"), F.lit(0)), F.coalesce(F.sum("w"), F.lit(0))).first()
        if n == fixed:
            break
        fixed, left, share = n, total - caps, (ranked.agg(F.sum("w")).first()[0] or 1) - ws
        if share <= 0:
            break
    target = F.col("cap").cast("double") if share <= 0 else F.when(full, F.col("cap").cast("double")).otherwise((F.col("w") * F.lit(left)).cast("double") / F.lit(float(share)))
    return ranked.select("source", "source_size", F.round(target, 6).alias("target"))


def budgets(rows: DataFrame, goal: DataFrame, epochs: int = EPOCHS) -> DataFrame:
    """By source: complete epochs e; the bucket, key and id up to which the rest is taken; the closing row.

    rows: (id, source, size, k, b). goal: (source, source_size, target).
    """
    goal = goal.select("*", F.least(F.lit(epochs), F.floor(F.col("target") / F.greatest(F.col("source_size"), F.lit(1)))).cast("long").alias("e"))
    goal = goal.select("*", F.when(F.col("e") >= epochs, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), F.col("target") - F.col("e") * F.col("source_size"))).alias("rest"))
    n_sources = goal.count()
    small = (lambda d: F.broadcast(d)) if n_sources <= BROADCAST_SOURCES else (lambda d: d)
    # the bucket in which the rest ends: first among 256 coarse ones, then among the 256 within
    fine = materialize(rows.groupBy("source", "b").agg(F.sum("size").alias("s")), "mix-buckets")
    coarse = fine.groupBy("source", F.floor(F.col("b") / STEP).cast("int").alias("c")).agg(F.sum("s").alias("s"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = coarse.select("source", "c", "s", before.alias("before")).alias("x").join(small(goal.alias("g")), F.col("x.source").eqNullSafe(F.col("g.source")))
    first = materialize(first.where("before < rest and before + s >= rest").select(F.col("g.source").alias("source"), "c", "before", "rest"), "mix-coarse")
    near = fine.alias("x").join(small(first.alias("f")), F.col("x.source").eqNullSafe(F.col("f.source")) & (F.floor(F.col("b") / STEP) == F.col("c")))
    near = near.select(F.col("f.source").alias("source"), "b", "s", "before", "rest")
    more = F.coalesce(F.sum("s").over(Window.partitionBy("source").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    end = near.select("source", "b", "s", "rest", (F.col("before") + more).alias("before")).where("before < rest and before + s >= rest")
    end = materialize(end.select("source", "b", "before", "rest"), "mix-end")
    inside = rows.alias("r").join(small(end.alias("n")), (F.col("r.source").eqNullSafe(F.col("n.source"))) & (F.col("r.b") == F.col("n.b")))
    inside = inside.select(F.col("r.source").alias("source"), "r.id", "r.size", "r.k", "before", "rest")
    order = Window.partitionBy("source").orderBy("k", F.col("id").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    within = inside.select("*", (F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0)) + F.col("size")).alias("through")).where("through <= rest")
    last = within.groupBy("source").agg(F.max(F.struct(F.col("k"), F.col("id").isNull().alias("no_id"), F.col("id"))).alias("last"))
    out = (
        goal.alias("g")
        .join(end.select(F.col("source").alias("s1"), F.col("b").alias("end_b")), F.col("g.source").eqNullSafe(F.col("s1")), "left")
        .join(last.select(F.col("source").alias("s2"), "last"), F.col("g.source").eqNullSafe(F.col("s2")), "left")
        .select("source", "source_size", "target", "e", "rest", F.coalesce("end_b", F.lit(-1)).alias("end_b"), F.col("last.k").alias("end_k"), F.col("last.id").alias("end_id"))
    )
    out = materialize(out, "mix-cut")
    chosen = told(rows, out, n_sources)
    got = chosen.where("picked").groupBy("source").agg(F.sum("size").alias("got"))
    gap = out.alias("o").join(got.select(F.col("source").alias("s3"), "got"), F.col("o.source").eqNullSafe(F.col("s3")), "left")
    gap = materialize(gap.select("source", (F.col("rest") - F.coalesce("got", F.lit(0))).alias("gap")).where("gap >= 1"), "mix-gap")
    spare = chosen.where("not picked and size > 0").alias("c").join(small(gap.alias("p")), F.col("c.source").eqNullSafe(F.col("p.source"))).where("size < 2 * gap")
    closing = spare.groupBy(F.col("c.source").alias("s4")).agg(F.min(F.struct(F.abs(F.col("size") - F.col("gap")).alias("off"), F.col("k"), F.col("id"), F.col("size"))).alias("close"))
    closing = materialize(closing.select("s4", F.col("close.k").alias("close_k"), F.col("close.id").alias("close_id")), "mix-close")
    return out.join(closing, out.source.eqNullSafe(closing.s4), "left").drop("s4")


def told(rows: DataFrame, plan: DataFrame, n_sources: int) -> DataFrame:
    """rows with their source's plan and ``picked``: in the part of an epoch after the complete ones."""
    plan = plan.withColumnRenamed("source", "plan_source")
    side = F.broadcast(plan) if n_sources <= BROADCAST_SOURCES else plan
    joined = rows.join(side, F.col("source").eqNullSafe(F.col("plan_source"))).drop("plan_source")
    key, cut = F.col("k"), F.col("end_k")
    at_end = (F.col("b") == F.col("end_b")) & ((key < cut) | ((key == cut) & (F.col("end_id").isNull() | (F.col("id") <= F.col("end_id")))))
    picked = (F.col("rest") > 0) & ((F.col("b") < F.col("end_b")) | F.coalesce(at_end, F.lit(False)))
    if "close_k" in plan.columns:
        picked = picked | F.coalesce((key == F.col("close_k")) & F.col("id").eqNullSafe(F.col("close_id")), F.lit(False))
    return joined.select("*", picked.alias("picked"))


def _plan(docs: DataFrame, **cols: str) -> tuple[DataFrame, DataFrame, int]:
    narrow = materialize(keyed(docs, **cols).drop("__row"), "mix-keys")
    goal = materialize(targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size"))), "mix-goal")
    return narrow, budgets(narrow, goal), goal.count()


def mix_plan(docs: DataFrame, **cols: str) -> DataFrame:
    """One row per document: (id, source, size, source_size, target, copies)."""
    narrow, plan, n = _plan(docs, **cols)
    return told(narrow, plan, n).select("id", "source", "size", "source_size", "target", (F.col("e") + F.col("picked").cast("long")).alias("copies"))


def mix(docs: DataFrame, **cols: str) -> DataFrame:
    """The mixed documents, each as often as the mix takes it, all columns unchanged.

    The texts are read twice and never shuffled. Documents of size 0 are kept once: they cost nothing.
    """
    _, plan, n = _plan(docs, **cols)
    chosen = told(keyed(docs, **cols), plan, n)
    copies = F.when(F.col("size") == 0, F.lit(1)).otherwise(F.col("e") + F.col("picked").cast("long")).cast("int")
    return chosen.where(copies > 0).select("__row", F.explode(F.sequence(F.lit(1), copies)).alias("__c")).select("__row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, size, source_size, target, taken."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return mix_plan(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


OP10_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS t,
         CASE WHEN trim(coalesce(text, ''), chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)) = '' THEN 0
              ELSE len(string_split_regex(trim(text, chr(32)||chr(9)||chr(10)||chr(11)||chr(12)||chr(13)), '[ \t\n\x0B\f\r]+')) END AS size
  FROM documents),
k AS (
  SELECT doc_id, source, size,
         -ln((CAST('0x' || substr(md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || CAST(size AS VARCHAR)), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496.0::DOUBLE)
         / greatest(0.1::DOUBLE, 1.0::DOUBLE - (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::DOUBLE / greatest(size, 1)::DOUBLE) AS k
  FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM k GROUP BY source),
r AS (
  SELECT *, sum(source_size) OVER () AS total,
         coalesce(sum(3 * source_size) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(w) OVER (ORDER BY 3 * source_size / w::DOUBLE, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s),
c AS (SELECT *, 3 * source_size * w_left <= (total - caps_before) * w AS capped FROM r),
l AS (SELECT max(total) - coalesce(sum(3 * source_size) FILTER (capped), 0) AS lft, coalesce(sum(w) FILTER (NOT capped), 0) AS shr FROM c),
g AS (
  SELECT source, source_size, round(CASE WHEN capped THEN (3 * source_size)::DOUBLE ELSE (w * lft)::DOUBLE / shr::DOUBLE END, 6) AS target FROM c, l),
e AS (SELECT *, least(3, floor(target / greatest(source_size, 1)))::BIGINT AS e FROM g),
h AS (SELECT *, CASE WHEN e >= 3 THEN 0.0 ELSE greatest(0.0, target - e * source_size) END AS rest FROM e),
p AS (
  SELECT k.doc_id, k.size, k.k, h.source, h.source_size, h.target, h.e, h.rest,
         coalesce(sum(k.size) OVER (PARTITION BY h.source ORDER BY k.k, k.doc_id NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + k.size <= h.rest AND h.rest > 0 AS picked
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source),
q AS (SELECT *, rest - coalesce(sum(size) FILTER (picked) OVER (PARTITION BY source), 0) AS gap FROM p),
z AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY CASE WHEN NOT picked AND size > 0 AND gap >= 1 AND size < 2 * gap THEN abs(size - gap) END NULLS LAST, k, doc_id NULLS LAST) AS rn FROM q)
SELECT doc_id, size::BIGINT AS size, source_size, target,
       (size * (e + CASE WHEN picked OR (rn = 1 AND size > 0 AND gap >= 1 AND size < 2 * gap) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM z
"""
