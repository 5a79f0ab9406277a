"""Exact dedup by a heavy-hitter split.

Every row gets the SHA-256 of its normalised text. A Misra-Gries frequent-items sketch (Spark's
approx_top_k) names digests that may be frequent; one aggregation over those verifies their counts
and finds the row that stays. The verified winners, at most ``max_heavy`` rows, are broadcast, so the
copies of frequent texts are settled where they are read. Only the other digests are shuffled, as partial
minima and counts.

Edge cases: a null text counts as empty; all empty texts are one group. A null id sorts after any
other. Rows equal in length and id are copies of each other; the first in row order stays. Texts of any
length are hashed whole. An empty table gives an empty result. Extra columns are carried, whatever their
names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WS_CLASS, documents, materialize, packed


#: Most row numbers to broadcast (8 MB).
BROADCAST_ROWS = 1_000_000


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), WS_CLASS + "+", ""), 256))


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row: bool = False) -> DataFrame:
    """(id, n, digest, rid[, __row]): code points of the text, digest of its normalised form, a row number,
    and all columns where asked. It is written, so the number stays with its row."""
    text = F.col(f"`{text_col}`")
    return materialize(
        docs.select(
            F.col(f"`{id_col}`").alias("id"),
            F.length(F.coalesce(text, F.lit(""))).alias("n"),
            _digest(text).alias("digest"),
            F.monotonically_increasing_id().alias("rid"),
            *[packed(docs)] * row,
        ),
        "digests",
    )


def heavy_winners(table: DataFrame, max_heavy: int = 2048, tracked: int = 8192, least: int = 64) -> DataFrame:
    """Verified frequent digests: (digest, group_size, keep_id, keep_rid), at most max_heavy rows.

    The sketch keeps ``tracked`` counters, so no digest with over 1/(0.75 * tracked) of the rows is missed.
    """
    total = table.count()
    floor = max(least, total // (2 * max_heavy))
    top = table.select(F.xxhash64("digest").alias("k")).agg(F.expr(f"approx_top_k(k, {max_heavy}, {tracked})").alias("top"))
    candidates = top.select(F.explode("top").alias("t")).where(F.col("t.count") >= floor).select(F.col("t.item").alias("k"))
    winners = (
        table.withColumn("k", F.xxhash64("digest"))
        .join(F.broadcast(candidates), "k")
        .groupBy("digest")
        .agg(F.count(F.lit(1)).alias("group_size"), _best().alias("w"))
        .where(F.col("group_size") >= floor)
    )
    return materialize(
        winners.select("digest", "group_size", F.col("w.id").alias("keep_id"), F.col("w.rid").alias("keep_rid")),
        "heavy",
    )


def _best() -> Column:
    """The row that stays: most code points, then smallest id (null last), then smallest row number."""
    return F.min(F.struct((-F.col("n")).alias("neg"), F.col("id").isNull().alias("no_id"), F.col("id"), F.col("rid")))


def light_winners(table: DataFrame, winners: DataFrame) -> DataFrame:
    """(digest, group_size, keep_id, keep_rid) of the digests that are not heavy, summed before they are dealt."""
    rest = table.select("id", "n", "digest", "rid").join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    best = rest.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), _best().alias("w"))
    return best.select("digest", "group_size", F.col("w.id").alias("keep_id"), F.col("w.rid").alias("keep_rid"))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: (id, keep_id, group_size, kept, digest)."""
    table = digests(docs, id_col, text_col)
    winners = heavy_winners(table)
    kept = (F.col("rid") == F.col("keep_rid")).alias("kept")
    heavy = table.join(F.broadcast(winners), "digest").select("id", "keep_id", "group_size", kept, "digest")
    rest = table.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    light = rest.join(light_winners(table, winners), "digest").select("id", "keep_id", "group_size", kept, "digest")
    return light.unionByName(heavy)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with one row of each group of equal texts, all columns unchanged.

    Rows are written with their digests; losers of frequent groups are removed where they are read, and for
    the others only digests and row numbers are dealt. The list of their losers is broadcast up to
    ``BROADCAST_ROWS`` numbers; beyond that the rows are dealt once, by number.
    """
    table = digests(docs, id_col, text_col, row=True)
    winners = heavy_winners(table.select("id", "n", "digest", "rid"))
    told = table.select("digest", "rid", "__row").join(F.broadcast(winners.select("digest", "keep_rid")), "digest", "left")
    rest = told.where("keep_rid is null or keep_rid = rid")
    narrow = table.select("digest", "rid").join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    several = light_winners(table, winners).where("group_size > 1").select("digest", "keep_rid")
    losers = materialize(narrow.join(several, "digest").where("rid <> keep_rid").select("rid"), "losers")
    side = F.broadcast(losers) if losers.count() <= BROADCAST_ROWS else losers
    return rest.join(side, "rid", "left_anti").select("__row.*")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: doc_id, keep_id, group_size, kept, text_sha256."""
    return exact_groups(documents(spark, sf_dir)).select(
        F.col("id").alias("doc_id"), "keep_id", F.col("group_size").cast("long").alias("group_size"), "kept", F.lower(F.hex("digest")).alias("text_sha256")
    )


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[ \t\n\x0B\f\r]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id NULLS LAST) = 1 AS kept,
       text_sha256
FROM d
"""
