"""The tables of a folder: records, metadata, schemas, vocabulary and choice by question."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import aggregates
from ..plans import routing
from .readers import read_table

log = logging.getLogger(__name__)


class Catalog:
    def __init__(self, spark: SparkSession, tables: dict[str, DataFrame] | None = None, metadata: dict[str, dict] | None = None):
        self.spark, self.tables, self.metadata = spark, tables or {}, metadata or {}

    @classmethod
    def load(cls, spark: SparkSession, paths: list[str]) -> Catalog:
        """JSON files by name; a file that cannot be read is logged and passed over."""
        out = cls(spark)
        for p in sorted(paths):
            name = p.rstrip("/").rsplit("/", 1)[-1]
            try:
                out.tables[name], out.metadata[name] = read_table(spark, p)
            except Exception as e:  # one bad file must not hide the others
                log.warning("%s: not loaded: %s", name, str(e)[:200])
        return out

    def schemas(self) -> dict[str, dict[str, str]]:
        return {n: dict(t.dtypes) for n, t in self.tables.items()}

    def columns(self) -> list[str]:
        return routing.schema_columns(self.schemas())

    def choose(self, question: str) -> tuple[str | None, str]:
        """(data set, reason code): a file name in the question, else the best score over columns and values."""
        usable = {n: t for n, t in self.tables.items() if t.columns and not t.isEmpty()}
        if not self.tables:
            return None, "no_datasets_loaded"
        if not usable:
            return None, "no_non_empty_dataframe"
        named = [n for n in usable if n.lower() in question.lower()]
        if named:
            return max(named, key=len), "explicit_filename"
        q = self.spark.createDataFrame([(0, question)], "qid long, question string")
        best = self.ranked(q).where(F.col("rank") == 1).first()
        return best["dataset"], best["reason"]

    def ranked(self, questions: DataFrame) -> DataFrame:
        """(qid, dataset, score, rank, gap, reason) of questions (qid, question) and the tables that have rows."""
        usable = {n: t for n, t in self.tables.items() if t.columns and not t.isEmpty()}
        cols = self.spark.createDataFrame([(n, c) for n, t in usable.items() for c in t.columns], "dataset string, column string")
        vocabulary = self.spark.createDataFrame([], "dataset string, column string, value string")
        for n, t in usable.items():
            vocabulary = vocabulary.unionByName(aggregates.vocabulary(t, n), allowMissingColumns=True)
        sizes = self.spark.createDataFrame([(n, t.count()) for n, t in usable.items()], "dataset string, n_rows long")
        return routing.score_datasets(questions, cols, vocabulary, sizes)
