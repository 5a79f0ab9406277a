"""Text files that arrive in a folder, cut into chunks and put in the store batch by batch."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import chunking
from ..sources.readers import source_name
from ..sources.store import ChunkStore


def ingest_stream(spark: SparkSession, folder: str, store: ChunkStore, checkpoint: str, separator: str = "\n\n", embed=None, once: bool = True) -> StreamingQuery:
    """Start the query. The checkpoint says which files are done; a repeated batch replaces the same
    sources, so a restart after a failure leaves no double chunks."""
    files = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.txt").load(folder)
    texts = files.select(source_name(F.col("_metadata.file_path")).alias("source"), "value")

    def put(batch, _: int) -> None:
        store.upsert(chunking.text_chunks(batch, separator), embed)

    writer = texts.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="10 seconds")).start()
