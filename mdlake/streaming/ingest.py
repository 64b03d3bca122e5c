"""Continuous ingest of Markdown files with Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from mdlake.sources.store import Store


def files(spark: SparkSession, path: str, per_batch: int = 10_000) -> DataFrame:
    """(path, content) of ``.md`` files as they arrive below a folder."""
    raw = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    raw = raw.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").option("maxFilesPerTrigger", per_batch).load(path)
    return raw.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def ingest(docs: DataFrame, store: Store, checkpoint: str, once: bool = False, compact_every: int = 100) -> StreamingQuery:
    """Every micro-batch is one commit. A batch that is run again after a
    failure replaces the same documents by the same rows. After every
    ``compact_every`` commits the segments are folded into one, so that neither
    reads nor commit files grow with the age of the stream."""

    def commit(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            if store.ingest(batch, on_error="skip") % compact_every == 0:
                store.compact()

    writer = docs.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
