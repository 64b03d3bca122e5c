"""Structural queries over the four tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK_TYPES = ("heading", "paragraph", "code_block", "list", "list_item", "table", "block_quote", "thematic_break", "image", "html", "footnote_definition")
_BY_NAME = {name.replace("_", ""): name for name in BLOCK_TYPES}


def block_type(name: str) -> str | None:
    """The stored name of a block type: case and underscores don't matter."""
    low = name.lower()
    return low if low in BLOCK_TYPES else _BY_NAME.get(low)


def query_blocks(blocks: DataFrame, doc_id: str | None = None, kind: str | None = None, heading_level: int | None = None, language: str | None = None) -> DataFrame:
    """Blocks that meet all the conditions given. A heading level means
    headings, a language code blocks of exactly that language; an unknown type
    has no blocks."""
    if doc_id is not None:
        blocks = blocks.where(F.col("doc_id") == doc_id)
    if kind is not None:
        known = block_type(kind)
        blocks = blocks.where(F.col("block_type") == known if known else F.lit(False))
    if heading_level is not None:
        blocks = blocks.where((F.col("block_type") == "heading") & (F.col("heading_level") == heading_level))
    if language is not None:
        blocks = blocks.where((F.col("block_type") == "code_block") & (F.col("language") == language))
    return blocks


def by_path(documents: DataFrame, path: str) -> DataFrame:
    return documents.where(F.col("path") == path)


def blocks_of(documents: DataFrame, blocks: DataFrame, path: str) -> DataFrame:
    """The blocks of the document at a path, in order."""
    return blocks.join(by_path(documents, path).select("doc_id"), "doc_id").orderBy("ordinal")


def tags_of(documents: DataFrame, tags: DataFrame, path: str) -> DataFrame:
    return tags.join(by_path(documents, path).select("doc_id"), "doc_id").orderBy("key", "tag_id")


def links_from(documents: DataFrame, links: DataFrame, path: str) -> DataFrame:
    own = by_path(documents, path).select(F.col("doc_id").alias("source_doc_id"))
    return links.join(own, "source_doc_id")


def links_to(links: DataFrame, target: str) -> DataFrame:
    """Links whose target is exactly this."""
    return links.where(F.col("target") == target)


def full_document(documents: DataFrame, blocks: DataFrame, tags: DataFrame, path: str) -> DataFrame:
    """One row: the document with its blocks and tags as arrays in order."""
    own = by_path(documents, path)
    ids = own.select("doc_id")
    b = blocks.join(ids, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("ordinal", "block_id", "block_type", "heading_level", "language", "text_content"))).alias("blocks"))
    t = tags.join(ids, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("key", "value"))).alias("tags"))
    return own.join(b, "doc_id", "left").join(t, "doc_id", "left")


def descendants(blocks: DataFrame, depth: int = 8) -> DataFrame:
    """(ancestor_id, block_id, distance) of every block and the blocks around
    it, up to ``depth`` levels. The joins are told to merge, as blocks are many
    more bytes than what they were parsed from, by which Spark would judge them
    and send them through the driver."""
    step = blocks.where("parent_block_id is not null").select("block_id", F.col("parent_block_id").alias("ancestor_id"))
    out = level = step.withColumn("distance", F.lit(1))
    up = step.select(F.col("block_id").alias("_b"), F.col("ancestor_id").alias("_a"))
    for i in range(2, depth + 1):
        level = level.join(up.hint("merge"), level["ancestor_id"] == up["_b"]).select("block_id", F.col("_a").alias("ancestor_id"), F.lit(i).alias("distance"))
        out = out.unionByName(level)
    return out


def counts(documents: DataFrame, blocks: DataFrame, links: DataFrame, tags: DataFrame) -> DataFrame:
    """(doc_id, path, blocks, links, tags): how many each document has. Of
    documents that are parsed just now, ``parse.counts`` needs no join."""
    out = documents.select("doc_id", "path")
    for name, df, key in (("blocks", blocks, "doc_id"), ("links", links, "source_doc_id"), ("tags", tags, "doc_id")):
        n = df.groupBy(F.col(key).alias("_k")).agg(F.count(F.lit(1)).alias(name))
        out = out.join(n, out["doc_id"] == n["_k"], "left").drop("_k")
    return out.fillna(0, ["blocks", "links", "tags"])
