"""The tables of a collection: flat columns, so that filters and column lists
reach the Parquet scan."""

from __future__ import annotations

from pyspark.sql import types as T


def _table(*columns: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(*c) for c in columns])


STRING, INT, LONG, BOOL = T.StringType(), T.IntegerType(), T.LongType(), T.BooleanType()

DOCUMENTS = _table(
    ("doc_id", STRING), ("path", STRING), ("title", STRING), ("frontmatter", STRING), ("content_hash", STRING),
    ("created_at", T.TimestampType()), ("updated_at", T.TimestampType()), ("version", LONG),
)
BLOCKS = _table(
    ("block_id", STRING), ("doc_id", STRING), ("block_type", STRING), ("heading_level", INT), ("language", STRING), ("list_ordered", BOOL),
    ("depth", INT), ("ordinal", INT), ("parent_block_id", STRING), ("text_content", STRING), ("raw_markdown", STRING),
)
LINKS = _table(
    ("link_id", STRING), ("source_doc_id", STRING), ("source_block_id", STRING), ("target", STRING), ("target_doc_id", STRING), ("link_type", STRING), ("anchor_text", STRING)
)
TAGS = _table(("tag_id", STRING), ("doc_id", STRING), ("key", STRING), ("value", STRING))

TABLES = {"documents": DOCUMENTS, "blocks": BLOCKS, "links": LINKS, "tags": TAGS}
#: The column by which rows of a table belong to a document.
OWNER = {"documents": "doc_id", "blocks": "doc_id", "links": "source_doc_id", "tags": "doc_id"}
#: A total order of each table.
ORDER = {"documents": ["path"], "blocks": ["doc_id", "ordinal"], "links": ["source_doc_id", "link_id"], "tags": ["doc_id", "key", "tag_id"]}
