"""How filters interact: what each removes, in every order in which they can be applied.

1. One pass over the texts gives every document its part, one bit a filter and one a label. What needs
   other documents (an equal text with a smaller id) is settled by digest: counts and least ids of digests
   are summed before they are shuffled, the few digests that hold many rows are broadcast, the rest joined.
2. A task packs its documents into bitsets, one a filter and one a label, in which each part fills whole
   64-bit words. For every set of filters that can come before another one, an AND-NOT leaves what is still
   there, and population counts, summed over the words of a part, say what the next filter takes.
3. Counts of all tasks are summed by part, set and filter. The orders are a table of (order, step, set
   before the step, filter) that is joined with them; nothing is counted a second time.

State is bounded by a block of rows a task and by 80 counts a part; sets of up to eight filters are allowed.

Edge cases: a null text counts as empty, a null part as the empty string. A null id is neither smaller nor
greater than others: such a row is no duplicate and makes none. Rows that share id and text are not
duplicates of each other. A label of a document counts once, however often it is repeated; labels of a null
id count for no document. Ties cannot occur: every output row has its own part, order and step. An empty
table has no parts and gives an empty result. Texts of any length are read whole. Other columns of both tables
are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, words

BLOCK = 1 << 16
#: Digests with more than total / HEAVY rows are broadcast; there are fewer than HEAVY of them.
HEAVY = 4096
COUNTS = ["before", "removed", "good", "toxic"]


def _mark(batch: pa.RecordBatch, n_filters: int):
    """(parts, first words, bitsets by filter, good, toxic, present): rows in order of their part, whose words
    begin at a multiple of 64."""
    code = batch.column(0).dictionary_encode()
    part, names = code.indices.to_numpy(), code.dictionary
    sizes = np.bincount(part, minlength=len(names))
    n_words = -(-sizes // 64)
    first = np.cumsum(n_words) - n_words
    order = np.argsort(part, kind="stable")
    at = np.arange(len(part)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(first * 64, sizes)
    bits = batch.column(1).to_numpy()[order]

    def packed(flag: np.ndarray) -> np.ndarray:
        room = np.zeros(int(n_words.sum()) * 64, bool)
        room[at] = flag
        return np.packbits(room, bitorder="little").view("<u8")

    return names, first, [packed((bits >> k) & 1 == 1) for k in range(n_filters + 2)], packed(np.ones(len(at), bool))


def _count(n_filters: int):
    steps = [(s, k) for s in range(1 << n_filters) for k in range(n_filters) if not s >> k & 1]
    out_type = pa.struct([("prefix", pa.int32()), ("filter", pa.int32()), *[(c, pa.int64()) for c in COUNTS]])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}

        def flush():
            if total:
                grid = np.stack(list(total.values()))
                n = len(total)
                cols = [np.tile(np.array([s[i] for s in steps], np.int32), n) for i in range(2)] + [grid[:, :, i].ravel() for i in range(len(COUNTS))]
                yield pa.RecordBatch.from_arrays([pa.array(list(total)).take(pa.array(np.repeat(np.arange(n), len(steps)))), *map(pa.array, cols)], ["part", *[f.name for f in out_type]])

        for whole in batches:
            for i in range(0, whole.num_rows, BLOCK):
                names, first, sets, present = _mark(whole.slice(i, BLOCK), n_filters)
                good, toxic = sets[n_filters:]
                sums = lambda x: np.add.reduceat(np.bitwise_count(x).astype(np.int64), first)  # noqa: B023, E731
                grid = np.zeros((len(names), len(steps), len(COUNTS)), np.int64)
                left = {}
                for s in range(1 << n_filters):  # what passes all filters of the set: one AND-NOT from a smaller set
                    top = s.bit_length() - 1
                    left[s] = present if not s else left[s ^ (1 << top)] & ~sets[top]
                for j, (s, k) in enumerate(steps):
                    gone = left[s] & sets[k]
                    for c, x in enumerate((left[s], gone, gone & good, gone & toxic)):
                        grid[:, j, c] = sums(x)
                for name, row in zip(names.to_pylist(), grid):
                    total[name] = total[name] + row if name in total else row
                if len(total) > 4096:
                    yield from flush()
                    total.clear()
        yield from flush()

    return count


def duplicates_of_smaller(rows: DataFrame, name: str) -> DataFrame:
    """rows (doc_id, digest, ...) with a boolean column, whether a smaller id has the same digest."""
    groups = rows.groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("least")).where("n > 1")
    groups = materialize(groups, "digests")
    total = rows.count()
    heavy = F.broadcast(groups.where(F.col("n") * HEAVY > total).select("digest", "least"))  # fewer than HEAVY rows
    light = groups.where(F.col("n") * HEAVY <= total).select("digest", "least")
    flag = F.coalesce(F.col("least") < F.col("doc_id"), F.lit(False)).alias(name)
    hot = rows.join(heavy, "digest")
    cold = rows.join(heavy, "digest", "left_anti").join(light, "digest", "left")
    return hot.unionByName(cold).select(*[c for c in rows.columns if c != "digest"], flag)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Column], repeated: str | None = None, part: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley).

    filters: name (one character) to the condition under which a document fails, in terms of docs. repeated:
    the name of a further filter, which a document fails whose text a smaller id has. labels: (doc_id, quality,
    toxic).
    """
    names = [*filters, *([repeated] if repeated else [])]
    if len(names) > 8:
        raise ValueError("orders of more than eight filters are not listed")
    k, spark = len(names), docs.sparkSession
    bit = lambda condition, i: F.when(condition, F.lit(1 << i)).otherwise(F.lit(0))
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    fails = F.lit(0)
    for i, condition in enumerate(filters.values()):
        fails = fails + bit(condition, i)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{part}`").cast("string"), F.lit("")).alias("part"), fails.alias("bits"), F.sha2(text, 256).alias("digest"))
    marks = labels.where("quality = 1 or toxic = 1").groupBy("doc_id").agg((F.max(bit(F.col("quality") == 1, k)) + F.max(bit(F.col("toxic") == 1, k + 1))).alias("marks"))
    rows = rows.join(materialize(marks, "labels"), "doc_id", "left").select("doc_id", "part", "digest", (F.col("bits") + F.coalesce("marks", F.lit(0))).alias("bits"))
    if repeated:
        rows = duplicates_of_smaller(materialize(rows, "bits"), "again")
        rows = rows.select("part", (F.col("bits") + bit(F.col("again"), k - 1)).alias("bits"))
    counted = rows.select("part", "bits").mapInArrow(_count(k), "part string, prefix int, filter int, " + ", ".join(f"{c} long" for c in COUNTS))
    counted = materialize(counted.groupBy("part", "prefix", "filter").agg(*[F.sum(c).alias(c) for c in COUNTS]), "counts")
    weight = [factorial(n) * factorial(k - 1 - n) if n < k else 0 for n in range(k + 1)]
    by_size = F.element_at(F.array(*map(F.lit, weight)), F.bit_count("prefix") + 1)
    others = F.lit((1 << k) - 1) - F.call_function("shiftleft", F.lit(1), F.col("filter"))
    shares = counted.groupBy("part", "filter").agg(
        F.sum(F.when(F.col("prefix") == 0, F.col("removed"))).alias("fails"), F.sum(F.when(F.col("prefix") == others, F.col("removed"))).alias("unique_fails"), F.sum(F.col("removed") * by_size).alias("shapley")
    )
    orders = [("".join(names[i] for i in p), n + 1, sum(1 << i for i in p[:n]), p[n]) for p in permutations(range(k)) for n in range(k)]
    table = F.broadcast(spark.createDataFrame(orders, "filter_order string, step int, prefix int, filter int"))  # at most 8 x 8! rows, whatever the input
    joined = counted.join(shares, ["part", "filter"]).join(table, ["prefix", "filter"])
    return joined.select(
        "part", "filter_order", "step", (F.col("before") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), "unique_fails", F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley"
    )


#: Upper-case letters of filter C, characters of filter D.
UPPER, SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "#$%&*|"


def standard_filters(text: Column) -> dict[str, Column]:
    """Filters A to D as failure conditions: few words, few distinct words, many capitals, signs."""
    text = F.coalesce(text, F.lit(""))
    w = words(text)
    n = F.size(w)
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    return {
        "A": n < 200,
        "B": 100 * F.size(F.array_distinct(w)) < 50 * n,
        "C": 100 * capitals > 2 * F.length(text),
        "D": F.length(F.translate(text, SIGNS, "")) < F.length(text),
    }


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: filters A to E over all documents, in all 120 orders."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    return audit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), standard_filters(F.col("text")), "E")


OP13_SQL = r"""WITH RECURSIVE l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels WHERE doc_id IS NOT NULL GROUP BY 1),
t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text FROM documents),
x AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda v: v <> '') AS w, min(doc_id) OVER (PARTITION BY text) AS least FROM t),
b AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic, [len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 2 * length(text), regexp_matches(text, '[#$%&*|]'), coalesce(least < x.doc_id, false)] AS f
  FROM x LEFT JOIN l ON l.doc_id = x.doc_id),
g AS (SELECT part, f, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM b GROUP BY ALL),
p AS (SELECT '' AS o, 0 AS n UNION ALL SELECT o || c, n + 1 FROM p, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c) WHERE n < 5 AND NOT contains(o, c)),
s AS (SELECT o, unnest(range(1, 6)) AS step FROM p WHERE n = 5),
k AS (SELECT o, step, ord(o[step]) - 64 AS k, [ord(o[j]) - 64 for j in range(1, step)] AS earlier FROM s),
c AS (SELECT part, o, step, k, n, good, toxic, f[k] AS fails, len(list_filter(earlier, lambda j: f[j])) > 0 AS gone, len(list_filter(f, lambda v: v)) = 1 AS alone FROM g CROSS JOIN k),
r AS (SELECT part, o, step, k, coalesce(sum(n) FILTER (NOT gone AND NOT fails), 0) AS kept, coalesce(sum(n) FILTER (NOT gone AND fails), 0) AS removed, coalesce(sum(n) FILTER (gone AND fails), 0) AS redundant,
  coalesce(sum(n) FILTER (fails AND alone), 0) AS unique_fails, coalesce(sum(good) FILTER (NOT gone AND fails), 0) AS good_lost, coalesce(sum(toxic) FILTER (NOT gone AND fails), 0) AS toxic_lost FROM c GROUP BY ALL)
SELECT part, o AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
  (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM r"""
