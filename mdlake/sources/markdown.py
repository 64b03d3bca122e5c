"""Sources of Markdown documents: (path, content)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "path string, content string"


def files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` (or that file) whose extension is exactly
    ``md``, read whole. The path of a document is that of its file, without a
    ``file:`` scheme."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md").load(path)
    return raw.select(F.regexp_replace("path", "^file:(//)?", "").alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("content"))


def single(spark: SparkSession, path: str, content: str) -> DataFrame:
    return spark.createDataFrame([(path, content)], SCHEMA)


def lines(docs: DataFrame) -> DataFrame:
    """Plain texts as collections: every line that isn't blank is a paragraph.
    (doc_id, block_id, ordinal, text_content), block_id being ``doc:line``."""
    line = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("ordinal", "text_content")).where(F.trim("text_content") != "")
    return line.select("doc_id", F.concat_ws(":", "doc_id", "ordinal").alias("block_id"), "ordinal", "text_content")
