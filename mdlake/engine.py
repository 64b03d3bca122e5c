"""One object for a collection: ingest, structural queries, search and graph.

What is derived (full-text entries, vectors, edges) is a function of the tables
at a version, so it never lags behind them. Full-text postings and vectors are
written once per version under the store's ``derived`` folder.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F

from mdlake.functions import embedding as E
from mdlake.operators import blocks as B, fts, graph, knn
from mdlake.plans import mql
from mdlake.sources import markdown
from mdlake.sources.store import NotFoundError, Snapshot, Store


class Engine:
    def __init__(self, spark: SparkSession, path: str, provider: E.Provider | None = None):
        self.spark, self.store, self.provider = spark, Store(spark, path), provider or E.HashProvider()
        self._made: dict[tuple[str, int], Any] = {}

    # documents

    def ingest(self, docs: DataFrame, on_error: str = "raise") -> DataFrame:
        """Ingests (path, content) rows; (doc_id, path, blocks, links, tags), in
        order of path."""
        self.store.ingest(docs, on_error)
        s = self.snapshot()
        mine = docs.select("path").distinct()
        found = s.documents.join(mine, "path", "left_semi")
        return B.counts(found, s.blocks, s.links, s.tags).orderBy("path")

    def ingest_document(self, path: str, content: str) -> dict[str, Any]:
        return self.ingest(markdown.single(self.spark, path, content)).first().asDict()

    def ingest_path(self, path: str, on_error: str = "skip") -> DataFrame:
        """Every ``.md`` file below a folder."""
        return self.ingest(markdown.files(self.spark, path), on_error)

    def snapshot(self, version: int | None = None) -> Snapshot:
        return self.store.snapshot(version)

    def list_documents(self) -> DataFrame:
        return self.snapshot().documents.orderBy("path")

    def get_document(self, path: str) -> DataFrame:
        s = self.snapshot()
        self._known(s, path)
        return B.full_document(s.documents, s.blocks, s.tags, path)

    def delete_document(self, path: str) -> int:
        return self.store.delete_by_path(path)

    def _known(self, s: Snapshot, path: str) -> str:
        row = s.documents.where(F.col("path") == path).select("doc_id").first()
        if row is None:
            raise NotFoundError(path)
        return row[0]

    def query_blocks(self, doc_path: str | None = None, block_type: str | None = None, heading_level: int | None = None, language: str | None = None) -> DataFrame:
        s = self.snapshot()
        doc_id = None if doc_path is None else self._known(s, doc_path)
        return B.query_blocks(s.blocks, doc_id, block_type, heading_level, language).orderBy("doc_id", "ordinal")

    def get_blocks(self, path: str) -> DataFrame:
        return self.query_blocks(doc_path=path)

    def get_links(self, path: str) -> DataFrame:
        s = self.snapshot()
        self._known(s, path)
        return B.links_from(s.documents, s.links, path)

    def get_backlinks(self, target: str) -> DataFrame:
        s = self.snapshot()
        return graph.get_backlinks(graph.edges(s.documents, s.links), target)

    def stats(self) -> DataFrame:
        """(document_count, node_count, edge_count, vector_count)."""
        s = self.snapshot()
        one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
        return one(s.documents, "document_count").crossJoin(self.graph_stats()).crossJoin(one(self.vectors(), "vector_count"))

    def health(self) -> dict[str, Any]:
        return {"status": "ok", "version": self.store.version}

    # search

    def vector_count(self) -> int:
        return self.vectors().count()

    def clear_vectors(self) -> None:
        """Empties the vectors of this version; those of the next are made from
        its blocks."""
        none = knn.clear(self.vectors())
        self._made["vectors", self.store.version] = self.spark.createDataFrame([], none.schema)

    def _derived(self, kind: str) -> Any:
        n = self.store.version
        key = (kind, n)
        if key not in self._made:
            s, path = self.snapshot(), f"{self.store.path}/derived/{kind}-{n:012d}"
            if kind == "fts":
                self._made[key] = fts.Index.build(s.documents, s.blocks, path)
            else:
                knn.index(s.blocks, s.documents, self.provider).write.mode("overwrite").parquet(path)
                self._made[key] = self.spark.read.parquet(path)
        return self._made[key]

    def index(self) -> fts.Index:
        return self._derived("fts")

    def vectors(self) -> DataFrame:
        return self._derived("vectors")

    def search_fulltext(self, query: str, limit: int = 20) -> DataFrame:
        return self.index().search(query, limit)

    def search_semantic(self, query: str, limit: int = 10) -> DataFrame:
        return knn.search(self.vectors(), self.provider.embed(query), limit, self.provider.dimension)

    def query(self, text: str) -> DataFrame:
        """Runs a query of the query language."""
        return mql.plan(text, self.snapshot().table, self.search_fulltext, self.search_semantic)

    # graph

    def _graph(self) -> tuple[DataFrame, DataFrame]:
        s = self.snapshot()
        return graph.edges(s.documents, s.links), s.documents.select("path")

    def graph_stats(self) -> DataFrame:
        return graph.stats(*self._graph())

    def shortest_path(self, start: str, end: str) -> list[str] | None:
        edges, more = self._graph()
        return graph.shortest_path(edges, start, end, more)

    def graph_pagerank(self, damping: float = 0.85, rounds: int = 20, limit: int | None = None) -> DataFrame:
        out = graph.pagerank(*self._graph(), damping, rounds)
        return out if limit is None else out.limit(limit)

    def graph_components(self) -> DataFrame:
        return graph.component_lists(graph.connected_components(*self._graph()))

    def graph_component_members(self) -> DataFrame:
        return graph.component_members(graph.connected_components(*self._graph()))

    @staticmethod
    def to_json(df: DataFrame) -> DataFrame:
        """A row as one JSON text."""
        return df.select(F.to_json(F.struct(*df.columns)).alias("json"))
