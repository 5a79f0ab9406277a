"""Result sinks: row tables as CSV, summaries as JSON, written whole or not at all."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union_rows(tables: list[DataFrame]) -> DataFrame:
    """All rows of tables whose columns may differ; a missing column is null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header in UTF-8; the folder appears when the job commits."""
    df.write.mode("overwrite").option("header", True).option("encoding", "UTF-8").option("escape", '"').csv(path)


def write_summary(df: DataFrame, path: str) -> None:
    """One JSON object a row."""
    df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("value")).write.mode("overwrite").text(path)
