"""Rank fusion without all pairs: exact ranks by counting, for candidates only.

A chunk's fused score falls with its two ranks. So the best chunks are among the first m by vector or the first m by
words; what is in neither list has a score below a bound that the lists' last ranks give. Boosts that depend on
the chunk and the question alone (it describes the data set, it is of the hinted source) part the chunks of a
question in up to four groups, each with lists and a bound of its own. If a bound is not below the k-th
best score, the lists are made longer and the search is repeated.

A candidate's rank is the number of chunks that beat it: a task sorts its similarities of a question once and
counts, by binary search, how many lie above each candidate; the counts are added up. Rows that leave a task
are as many as the candidates, never questions x chunks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import written

# Fusion constant and boosts.
RRF_K, KEY_BOOST, META_BOOST, HINT_BOOST = 60, 0.08, 0.35, 0.50
#: Questions that one pass takes at most, so that their candidates are a bounded table.
QUESTIONS = 512
DIGITS = 9


@dataclass(frozen=True)
class Question:
    qid: int
    vector: list[float]
    meta: bool = False  # whether it is about the data sets, so that chunks that describe them are lifted
    hint: str | None = None  # a part of the source's name that it hints at


def flat_vectors(column: pa.Array) -> np.ndarray:
    """Arrays of one length as a matrix of double precision, of length one; zero vectors stay."""
    rows = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.linalg.norm(rows, axis=1, keepdims=True)
    return rows / np.where(norm == 0, 1, norm)


class _Scorer:
    """Similarities and boost groups of a batch: columns chunk_id, embedding, source, meta."""

    def __init__(self, questions: list[Question]):
        self.ids = np.array([q.qid for q in questions], np.int64)
        matrix = np.array([q.vector for q in questions], np.float64).reshape(len(questions), -1)
        norm = np.linalg.norm(matrix, axis=1, keepdims=True)
        self.matrix = matrix / np.where(norm == 0, 1, norm)
        self.meta, self.hints = np.array([q.meta for q in questions], bool), [q.hint for q in questions]

    def similarities(self, batch: pa.RecordBatch) -> np.ndarray:
        return np.round(self.matrix @ flat_vectors(batch.column("embedding")).T, DIGITS)

    def groups(self, batch: pa.RecordBatch) -> np.ndarray:
        source = batch.column("source").dictionary_encode()
        names = [x or "" for x in source.dictionary.to_pylist()]
        hinted = np.array([[h is not None and h in n for n in names] + [False] for h in self.hints], bool)
        code = source.indices.fill_null(len(names)).to_numpy()
        meta = batch.column("meta").fill_null(False).to_numpy(zero_copy_only=False).astype(bool)
        return 2 * (self.meta[:, None] & meta[None, :]) + hinted[:, code]


def _nearest(questions: list[Question], m: int):
    """The first m of each question and group within a batch, with all ties at the cut."""
    scorer = _Scorer(questions)

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sims, groups, chunk = scorer.similarities(batch), scorer.groups(batch), batch.column("chunk_id").to_numpy()
            for g in np.unique(groups):
                own = np.where(groups == g, sims, -np.inf)
                cut = -np.partition(-own, min(m, own.shape[1]) - 1, axis=1)[:, min(m, own.shape[1]) - 1 : min(m, own.shape[1])]
                q, c = np.nonzero((own >= cut) & (own > -np.inf))
                yield pa.RecordBatch.from_arrays([pa.array(scorer.ids[q]), pa.array(chunk[c]), pa.array(np.full(len(q), g, np.int32)), pa.array(own[q, c])], ["qid", "chunk_id", "group", "score"])

    return nearest


class _Thresholds:
    """Candidates' scores by question, to be counted against: ties are beaten by smaller ids."""

    def __init__(self, qid: np.ndarray, chunk: np.ndarray, score: np.ndarray):
        order = np.argsort(qid, kind="stable")
        self.chunk, self.score, self.counts = chunk[order], score[order], np.zeros(len(order), np.int64)
        ids, first = np.unique(qid[order], return_index=True)
        self.ranges = {int(i): (int(a), int(b)) for i, a, b in zip(ids, first, [*first[1:], len(order)])}
        self.qid = qid[order]

    def add(self, qid: int, score: np.ndarray, chunk: np.ndarray) -> None:
        if qid not in self.ranges:
            return
        a, b = self.ranges[qid]
        order = np.lexsort((-chunk, score))
        score, chunk = score[order], chunk[order]
        above = np.searchsorted(score, self.score[a:b], "right")
        self.counts[a:b] += len(score) - above
        below = np.searchsorted(score, self.score[a:b], "left")
        for i in np.flatnonzero(above > below):  # equal scores: by falling id, so the smaller ids are at the end
            tied = chunk[below[i] : above[i]]
            self.counts[a + i] += int((tied < self.chunk[a + i]).sum())

    def rows(self) -> pa.RecordBatch:
        some = self.counts > 0
        return pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (self.qid, self.chunk, self.counts)], ["qid", "chunk_id", "n"])


_COUNT = "qid long, chunk_id long, n long"


def _beaten_by_vector(questions: list[Question], wanted: tuple[np.ndarray, ...]):
    scorer = _Scorer(questions)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Thresholds(*wanted)
        for batch in batches:
            if batch.num_rows:
                sims, chunk = scorer.similarities(batch), batch.column("chunk_id").to_numpy()
                for i, q in enumerate(scorer.ids.tolist()):
                    found.add(q, sims[i], chunk)
        yield found.rows()

    return count


def _beaten_by_words(wanted: tuple[np.ndarray, ...]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Thresholds(*wanted)
        for batch in batches:
            qid, chunk, score = (batch.column(c).to_numpy() for c in ("qid", "chunk_id", "score"))
            order = np.argsort(qid, kind="stable")
            heads = np.flatnonzero(np.concatenate([[True], qid[order][1:] != qid[order][:-1]])) if len(order) else []
            for a, b in zip(heads, [*heads[1:], len(order)]):
                rows = order[a:b]
                found.add(int(qid[rows[0]]), score[rows], chunk[rows])
        yield found.rows()

    return count


def _similar(questions: list[Question]):
    scorer = _Scorer(questions)
    place = {int(q): i for i, q in enumerate(scorer.ids)}

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = flat_vectors(batch.column("embedding"))
            q = scorer.matrix[[place[x] for x in batch.column("qid").to_pylist()]].reshape(len(rows), -1)
            yield pa.RecordBatch.from_arrays([batch.column("qid"), batch.column("chunk_id"), pa.array(np.round((q * rows).sum(axis=1), DIGITS))], ["qid", "chunk_id", "dense"])

    return similar


def reciprocal(dense_rank: Column, bm25_rank: Column) -> Column:
    """The fused score of two 0-based ranks, scaled to [0, 1]; a missing rank adds nothing."""
    part = lambda rank: F.coalesce(1 / (RRF_K + rank), F.lit(0.0))
    return (part(dense_rank) + part(bm25_rank)) / (2 / RRF_K)


def _candidates(chunks: DataFrame, lexical: DataFrame, questions: list[Question], m: int) -> DataFrame:
    """(qid, chunk_id, group, dense, bm25, dense_last, bm25_last): last marks the m-th of a list that is full."""
    spark = chunks.sparkSession
    vectors = chunks.where("embedding is not null").select("chunk_id", "embedding", "source", "meta")
    order = Window.partitionBy("qid", "group").orderBy(F.desc("score"), "chunk_id")
    first = lambda df, name: df.withColumn("at", F.row_number().over(order)).where(F.col("at") <= m).select("qid", "chunk_id", "group", (F.col("at") == m).alias(name))
    dense = first(vectors.mapInArrow(_nearest(questions, m), "qid long, chunk_id long, group int, score double"), "dense_last")
    gates = spark.createDataFrame([(q.qid, q.meta, q.hint) for q in questions], "qid long, q_meta boolean, hint string")
    words = lexical.where("score > 0").join(F.broadcast(gates), "qid")  # at most QUESTIONS rows
    if any(q.meta or q.hint for q in questions):
        hints = sorted({q.hint for q in questions if q.hint})
        lifted = F.coalesce(F.col("meta"), F.lit(False)) if any(q.meta for q in questions) else F.lit(False)
        for h in hints:
            lifted = lifted | F.contains("source", F.lit(h))
        words = words.join(chunks.where(lifted).select("chunk_id", "source", "meta"), "chunk_id", "left")
        group = 2 * (F.col("q_meta") & F.coalesce("meta", F.lit(False))).cast("int") + F.coalesce(F.contains("source", "hint"), F.lit(False)).cast("int")
    else:
        group = F.lit(0)
    words = first(words.select("qid", "chunk_id", group.alias("group"), "score"), "bm25_last")
    both = dense.join(words, ["qid", "chunk_id", "group"], "full")
    both = written(both.select("qid", "chunk_id", "group", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("dense_last", "bm25_last")]), "pool")
    pairs = both.select("qid", "chunk_id")
    told = vectors.select("chunk_id", "embedding").join(pairs, "chunk_id").mapInArrow(_similar(questions), "qid long, chunk_id long, dense double")
    scored = lexical.where("score > 0").join(pairs, ["qid", "chunk_id"]).select("qid", "chunk_id", F.col("score").alias("bm25"))
    return written(both.join(told, ["qid", "chunk_id"], "left").join(scored, ["qid", "chunk_id"], "left"), "candidates")


def _ranked(chunks: DataFrame, lexical: DataFrame, questions: list[Question], found: DataFrame) -> DataFrame:
    """found with exact dense_rank and bm25_rank. What is sent to the tasks is bounded: some lists of m rows
    for at most QUESTIONS questions."""
    out = found
    vectors = chunks.where("embedding is not null").select("chunk_id", "embedding")
    for score, rank, count in (("dense", "dense_rank", lambda w: vectors.mapInArrow(_beaten_by_vector(questions, w), _COUNT)), ("bm25", "bm25_rank", lambda w: lexical.where("score > 0").select("qid", "chunk_id", "score").mapInArrow(_beaten_by_words(w), _COUNT))):
        rows = found.where(F.col(score).isNotNull()).select("qid", "chunk_id", score).toPandas()
        wanted = rows["qid"].to_numpy(np.int64), rows["chunk_id"].to_numpy(np.int64), rows[score].to_numpy(np.float64)
        counts = count(wanted).groupBy("qid", "chunk_id").agg(F.sum("n").alias("n"))
        out = out.join(counts, ["qid", "chunk_id"], "left").withColumn(rank, F.when(F.col(score).isNotNull(), F.coalesce("n", F.lit(0).cast("long")))).drop("n")
    return out


def fuse(chunks: DataFrame, lexical: DataFrame, questions: list[Question], k: int, coverage=None, least: int = 0) -> DataFrame:
    """Candidates with their ranks and scores; the k best of each question by (score, chunk_id) are among them.

    chunks: (chunk_id, embedding, source, meta). lexical: (qid, chunk_id, score), read more than once, so it should
    be a written table. coverage: adds a column coverage to rows (qid, chunk_id, ...); without it there is no
    key boost. least: so many of the nearest chunks by vector are among the candidates, too.
    Returns (qid, chunk_id, dense, bm25, dense_rank, bm25_rank, rrf, key_boost, meta_boost, hint_boost, score).
    """
    out = None
    for i in range(0, max(1, len(questions)), QUESTIONS):
        part = _fuse(chunks, lexical, questions[i : i + QUESTIONS], k, coverage, least)
        out = part if out is None else out.unionByName(part)
    return out


def _fuse(chunks: DataFrame, lexical: DataFrame, questions: list[Question], k: int, coverage, least: int) -> DataFrame:
    m = max(RRF_K + 2 * k, least)  # enough without boosts: what is in neither list has two ranks of at least m
    peak = lexical.groupBy("qid").agg(F.max("score").alias("peak"))
    while True:
        found = _ranked(chunks, lexical, questions, _candidates(chunks, lexical, questions, m))
        found = found.join(peak, "qid", "left").withColumn("rrf", F.round(reciprocal(F.col("dense_rank"), F.col("bm25_rank")), 12))
        relative = F.coalesce(F.col("bm25") / F.when(F.col("peak") > 0, F.col("peak")), F.lit(0.0))
        if coverage is not None:
            found = coverage(found).withColumn("key_boost", F.when(F.col("bm25") > 0, KEY_BOOST * relative * F.col("coverage")).otherwise(F.lit(0.0)))
        else:
            found = found.withColumn("key_boost", F.lit(0.0))
        found = found.withColumn("meta_boost", F.when(F.col("group") >= 2, META_BOOST).otherwise(0.0)).withColumn("hint_boost", F.when(F.col("group") % 2 == 1, HINT_BOOST).otherwise(0.0))
        boosts = F.col("meta_boost") + F.col("hint_boost")
        found = written(found.withColumn("score", F.round(F.col("rrf") + F.col("key_boost") + boosts, DIGITS)).withColumn("relative", relative), "fused")
        last = lambda name, c: F.max(F.when(F.col(name), F.col(c)))
        bound = found.groupBy("qid", "group").agg(last("dense_last", "dense_rank").alias("d"), last("bm25_last", "bm25_rank").alias("b"), last("bm25_last", "relative").alias("r"), F.max(boosts).alias("boosts"))
        above = F.col("boosts") + reciprocal(F.col("d") + 1, F.col("b") + 1) + (KEY_BOOST if coverage is not None else 0.0) * F.coalesce("r", F.lit(0.0)) + 1e-8
        best = Window.partitionBy("qid").orderBy(F.desc("score"), "chunk_id")
        kth = found.withColumn("at", F.row_number().over(best)).where(F.col("at") == k).select("qid", F.col("score").alias("kth"))
        open_ = bound.where("d is not null or b is not null").join(kth, "qid", "left").where(F.col("kth").isNull() | (above >= F.col("kth")))
        if open_.isEmpty():
            return found.select("qid", "chunk_id", "dense", "bm25", "dense_rank", "bm25_rank", "rrf", "key_boost", "meta_boost", "hint_boost", "score")
        m *= 4
