"""Vector search: exact nearest neighbours by cosine."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from mdlake.functions import embedding as E

PREVIEW = 200


class DimensionError(ValueError):
    pass


def embed_blocks(blocks: DataFrame, provider: E.Provider | None = None) -> DataFrame:
    """(doc_id, block_id, text, vector) of the blocks that are long enough; the
    trimmed text is embedded."""
    rows = blocks.where(E.long_enough(F.col("text_content")))
    return rows.select("doc_id", "block_id", F.col("text_content").alias("text"), E.embed(E.trimmed(F.col("text_content")), provider).alias("vector"))


def index(blocks: DataFrame, documents: DataFrame, provider: E.Provider | None = None) -> DataFrame:
    """(doc_id, block_id, path, text_preview, vector), a row per block."""
    rows = embed_blocks(blocks, provider).join(documents.select("doc_id", "path"), "doc_id")
    return rows.dropDuplicates(["doc_id", "block_id"]).select("doc_id", "block_id", "path", preview(F.col("text")).alias("text_preview"), "vector")


def preview(text: Column) -> Column:
    return F.substring(text, 1, PREVIEW)


def upsert(have: DataFrame, new: DataFrame, dimension: int) -> DataFrame:
    """New vectors take the place of those of the same document and block; a
    vector of another size fails the query."""
    size = F.size("vector")
    checked = new.dropDuplicates(["doc_id", "block_id"]).withColumn("vector", F.when(size == dimension, F.col("vector")).otherwise(F.raise_error(F.concat(F.lit(f"dimension {dimension} expected, got "), size.cast("string")))))
    return have.join(new.select("doc_id", "block_id"), ["doc_id", "block_id"], "left_anti").unionByName(checked)


def clear(have: DataFrame) -> DataFrame:
    """An index without vectors."""
    return have.where(F.lit(False))


def delete_document(have: DataFrame, doc_id: str) -> DataFrame:
    return have.where(F.col("doc_id") != doc_id)


def cosine(a: Column, b: Column) -> Column:
    """0 if either is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.lit(0.0))


def similarity(column: Column, query: Sequence[float]) -> Column:
    """Cosine with one vector, known now: its norm is folded into the literals."""
    norm = sum(float(x) ** 2 for x in query) ** 0.5
    if norm == 0:
        return F.lit(0.0)
    scaled = F.array(*(F.lit(float(x) / norm) for x in query))
    dot = F.aggregate(F.zip_with(column, scaled, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    own = F.sqrt(F.aggregate(column, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))
    return F.when(own > 0, dot / own).otherwise(F.lit(0.0))


def search(vectors: DataFrame, query: Sequence[float], limit: int = 10, dimension: int | None = None, key: Sequence[str] = ("doc_id", "block_id"), column: str = "vector") -> DataFrame:
    """The ``limit`` rows of greatest cosine, best first, ties by key. A query
    of another dimension is an error; no vectors, or a limit of 0, no rows."""
    if dimension is not None and len(query) != dimension:
        raise DimensionError(f"dimension {dimension} expected, got {len(query)}")
    scored = vectors.withColumn("score", similarity(F.col(column), query))
    return scored.orderBy(F.desc(F.round("score", 9)), *key).limit(limit).drop(column)
