"""The chunk store: Parquet partitioned by source, with idempotent replacement of a source."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["chunk_id", "seq", "content", "embedding", "page_info", "source"]
SCHEMA = "chunk_id long, seq int, content string, embedding array<float>, page_info string, source string"


def source_counts(chunks: DataFrame) -> DataFrame:
    """(source, n) in order of source."""
    return chunks.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy("source")


def absent(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key the other table does not have."""
    return rows.join(known.select(key).distinct(), key, "left_anti")


class ChunkStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self) -> DataFrame:
        """All chunks; an empty table before the first write."""
        try:
            return self.spark.read.schema(SCHEMA).parquet(self.path)
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], SCHEMA)

    def upsert(self, chunks: DataFrame, embed=None) -> None:
        """Replace the chunks of every source in ``chunks`` (source, seq, content, page_info[, embedding]).

        Only the partitions of those sources are rewritten, and each appears at once when the job commits.
        embed: an injected function of a list of texts to a list of vectors, applied before the write.
        """
        if embed is not None:
            @F.pandas_udf("array<float>")
            def vectors(texts: pd.Series) -> pd.Series:
                return pd.Series(embed(list(texts)))

            chunks = chunks.withColumn("embedding", vectors("content"))
        elif "embedding" not in chunks.columns:
            chunks = chunks.withColumn("embedding", F.lit(None).cast("array<float>"))
        rows = chunks.withColumn("chunk_id", F.xxhash64("source", "seq")).select(*COLUMNS)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source").parquet(self.path)

    def delete(self, source: str) -> int:
        """Remove a source; the number of chunks that it had. Only its partition is touched."""
        n = self.read().where(F.col("source") == source).count()
        if n:
            jvm = self.spark.sparkContext._jvm
            name = jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.escapePathName(source)
            target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/source={name}")
            target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        return n

    def sources(self) -> DataFrame:
        """(source, n) in order of source."""
        return source_counts(self.read())

    def missing(self, chunks: DataFrame) -> DataFrame:
        """The chunks whose source the store does not have."""
        return absent(chunks, self.read(), "source")

    def ingest(self, chunks: DataFrame, force: bool = False, embed=None) -> None:
        """Write the chunks of new sources, or of all with force."""
        self.upsert(chunks if force else self.missing(chunks), embed)
