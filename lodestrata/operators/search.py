"""Lexical and vector retrieval over a chunk table, for one query or many.

Everything is keyed by qid, so a single question is the one-row case of a batch. Ties are broken by
chunk id throughout. Statistics of the corpus are tables, not driver values: a source-scoped search is
the same plan over a filtered corpus, with its own statistics.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import lexical
from .fusion import flat_vectors

# Cut-offs.
TOP_K, RERANK_TOP_N = 8, 4
#: Query vectors that one pass compares at most; more go in further passes.
QUERY_BLOCK = 4096
#: Queries and chunks whose similarities a task holds at a time.
QUERY_TILE, CHUNK_TILE = 256, 2048
#: Scores that callers round may differ by so much and still tie.
TIED = 2e-9


def bm25(chunks: DataFrame, queries: DataFrame, scope: list[str] | None = None) -> DataFrame:
    """(scope columns, qid, chunk_id, score) for chunks (scope columns, chunk_id, tokens) that share a token with
    a query (qid, tokens); a token that a query repeats counts as often. See the lexical index."""
    return lexical.scores(lexical.index_of(chunks, scope), queries)


def top_k(scores: DataFrame, k: int, score: str = "score", keys: list[str] | None = None) -> DataFrame:
    """Rows with the k best scores of each query, with their rank from 1."""
    order = Window.partitionBy(*(keys or ["qid"])).orderBy(F.desc(score), "chunk_id")
    return scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def cosine_scores(vectors: DataFrame, queries: list[tuple[int, list[float]]], k: int | None = None) -> DataFrame:
    """(qid, chunk_id, score) of (chunk_id, embedding) against query vectors; with k only rows that can be
    among a query's k best by what their task has seen so far. Zero vectors score 0.

    The query matrix is bounded by QUERY_BLOCK rows; a longer list is cut into blocks. A task compares tiles of both,
    so its memory depends on neither table.
    """
    import numpy as np
    import pyarrow as pa

    def block(part: list[tuple[int, list[float]]]) -> DataFrame:
        ids = np.array([q for q, _ in part], np.int64)
        matrix = np.array([v for _, v in part], np.float64).reshape(len(part), -1)
        length = np.linalg.norm(matrix, axis=1, keepdims=True)
        matrix = matrix / np.where(length == 0, 1, length)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            least = np.full(len(ids), -np.inf)
            for batch in batches:
                for at in range(0, batch.num_rows, CHUNK_TILE):
                    tile = batch.slice(at, CHUNK_TILE)
                    rows, chunk = flat_vectors(tile.column(1)).T, tile.column(0).to_numpy()
                    for a in range(0, len(ids), QUERY_TILE):
                        sims = matrix[a : a + QUERY_TILE] @ rows
                        if k is None or k >= len(chunk):
                            q, c = (x.ravel() for x in np.indices(sims.shape))
                        else:
                            # ties at the cut are all kept, and what earlier rows of the task have beaten is not
                            cut = np.partition(sims, len(chunk) - k, axis=1)[:, len(chunk) - k]
                            least[a : a + QUERY_TILE] = cut = np.maximum(least[a : a + QUERY_TILE], cut)
                            q, c = np.nonzero(sims >= cut[:, None] - TIED)
                        yield pa.RecordBatch.from_arrays([pa.array(ids[a + q]), pa.array(chunk[c]), pa.array(sims[q, c])], ["qid", "chunk_id", "score"])

        return vectors.select("chunk_id", "embedding").where("embedding is not null").mapInArrow(score, "qid long, chunk_id long, score double")

    out = None
    for i in range(0, max(1, len(queries)), QUERY_BLOCK):
        part = block(queries[i : i + QUERY_BLOCK])
        out = part if out is None else out.unionByName(part)
    return out


def is_meta(locator: Column) -> Column:
    """Whether a locator points at a part that describes the data set."""
    low = F.lower(locator)
    named = [low.contains(x) for x in ("fieldguide", "safetyanddataquality", "statistics", "metadata")]
    return named[0] | named[1] | named[2] | named[3] | low.startswith("$.meta")


def with_dense_slot(pool: DataFrame, dense: DataFrame, n: int) -> DataFrame:
    """A pool (qid, chunk_id, rank) with the n best dense chunks that it lacks appended in dense order."""
    best = top_k(dense, n).select("qid", "chunk_id", F.col("rank").alias("dense_rank"))
    more = best.join(pool.select("qid", "chunk_id"), ["qid", "chunk_id"], "left_anti")
    size = pool.groupBy("qid").agg(F.max("rank").alias("size"))
    order = Window.partitionBy("qid").orderBy("dense_rank")
    tail = more.join(size, "qid", "left").select("qid", "chunk_id", (F.coalesce("size", F.lit(0)) + F.row_number().over(order)).alias("rank"))
    return pool.select("qid", "chunk_id", "rank").unionByName(tail)


def rerank(pairs: DataFrame, scorer, n: int = RERANK_TOP_N) -> DataFrame:
    """The n best of (qid, chunk_id, query, content) by an injected scorer(queries, contents) -> scores."""
    @F.pandas_udf("double")
    def score(q: pd.Series, c: pd.Series) -> pd.Series:
        return pd.Series(scorer(list(q), list(c)), dtype=float)

    return top_k(pairs.withColumn("score", score("query", "content")), n)


def context(ranked: DataFrame, limit: int = 6000) -> DataFrame:
    """(qid, context): numbered chunks with source and locator, joined by blank lines, cut at a limit.

    ranked: (qid, rank, source, locator, content), a top-k per query, so a group is small.
    """
    line = F.concat(F.lit("["), F.col("rank").cast("string"), F.lit("] Kaynak: "), F.col("source"), F.lit(", "), F.col("locator"), F.lit("\n"), F.col("content"))
    parts = F.array_sort(F.collect_list(F.struct("rank", line.alias("line"))))
    return ranked.groupBy("qid").agg(F.substring(F.array_join(F.transform(parts, lambda p: p["line"]), "\n\n"), 1, limit).alias("context"))
