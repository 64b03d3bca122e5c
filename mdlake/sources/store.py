"""A collection on disk: immutable Parquet segments under numbered commits.

A commit adds at most one segment: new rows of the four tables, and the list of
documents whose earlier rows it replaces or deletes. Nothing is rewritten by a
commit, so its cost follows the change and not the collection. A read takes the
segments up to its version in one scan per table and leaves out rows of
documents that a later commit dropped; ``compact`` folds all of it into one
segment. The commit file comes last, renamed into place only if its number is
free, so a reader never sees half of a commit. Where renaming is atomic and
doesn't replace (HDFS), of two writers one fails; on a local file system or an
object store two that publish in the same moment may both believe that they
succeeded, so there a collection should have one writer.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from mdlake import schema
from mdlake.operators import parse as P


class StoreError(Exception):
    pass


class ConflictError(StoreError):
    """Another writer has made this commit."""


class ReadOnlyError(StoreError):
    """Snapshots can't be written to."""


class NotFoundError(StoreError, KeyError):
    pass


class ParseError(StoreError, ValueError):
    pass


class Snapshot:
    """The collection at one version."""

    def __init__(self, store: "Store", version: int, segments: list[dict]):
        self.store, self.spark, self.version, self._segments = store, store.spark, version, segments

    def _scan(self, name: str, kind: T.StructType) -> DataFrame:
        paths = [f"{self.store.path}/segments/{s['id']}/{name}" for s in self._segments if name in s["tables"]]
        if not paths:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(*paths)

    def table(self, name: str) -> DataFrame:
        """documents, blocks, links or tags."""
        if name not in schema.TABLES:
            raise StoreError(f"no table {name}")
        kind, owner = schema.TABLES[name], schema.OWNER[name]
        rows = self._scan(name, T.StructType([*kind, T.StructField("_commit", T.LongType())]))
        if any("dropped" in s["tables"] for s in self._segments):
            gone = self._scan("dropped", T.StructType([T.StructField("doc_id", T.StringType()), T.StructField("_commit", T.LongType())]))
            gone = gone.groupBy("doc_id").agg(F.max("_commit").alias("_last")).withColumnRenamed("doc_id", "_gone")
            rows = rows.join(gone, (rows[owner] == gone["_gone"]) & (rows["_commit"] < gone["_last"]), "left_anti")
        return rows.select(*kind.names)

    documents = property(lambda self: self.table("documents"))
    blocks = property(lambda self: self.table("blocks"))
    links = property(lambda self: self.table("links"))
    tags = property(lambda self: self.table("tags"))

    def scan_range(self, name: str, column: str, start: Any = None, end: Any = None) -> DataFrame:
        """Rows with start <= column < end; None is unbounded."""
        rows = self.table(name)
        if start is not None:
            rows = rows.where(F.col(column) >= F.lit(start))
        return rows if end is None else rows.where(F.col(column) < F.lit(end))

    def scan_prefix(self, name: str, column: str, prefix: str) -> DataFrame:
        return self.table(name).where(F.col(column).startswith(prefix))

    def get(self, name: str, key: str) -> DataFrame:
        """The row whose identifier is ``key``, if any."""
        return self.table(name).where(F.col(schema.TABLES[name].names[0]) == key)

    def _refuse(self, *_: Any, **__: Any) -> None:
        raise ReadOnlyError("snapshot is read-only")

    ingest = upsert = delete = delete_by_path = compact = _refuse


class Store:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._jpath = jvm.org.apache.hadoop.fs.Path
        self._fs = self._jpath(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._jpath(f"{self.path}/commits"))

    # commits

    def versions(self) -> list[int]:
        names = (s.getPath().getName() for s in self._fs.listStatus(self._jpath(f"{self.path}/commits")))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    @property
    def version(self) -> int:
        return max(self.versions(), default=0)

    def _commit_file(self, n: int) -> dict:
        stream = self._fs.open(self._jpath(f"{self.path}/commits/{n:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def snapshot(self, version: int | None = None) -> Snapshot:
        have = self.version
        version = have if version is None else version
        if version == 0:
            return Snapshot(self, 0, [])
        if version not in self.versions():
            raise NotFoundError(f"no version {version}")
        return Snapshot(self, version, self._commit_file(version)["segments"])

    def table(self, name: str) -> DataFrame:
        return self.snapshot().table(name)

    def _publish(self, n: int, segments: list[dict]) -> int:
        target = self._jpath(f"{self.path}/commits/{n:012d}.json")
        temp = self._jpath(f"{self.path}/commits/_{n:012d}-{segments[-1]['id'] if segments else 'empty'}")
        stream = self._fs.create(temp, True)
        stream.write(bytearray(json.dumps({"version": n, "segments": segments}).encode()))
        stream.close()
        if self._fs.exists(target) or not self._fs.rename(temp, target):
            self._fs.delete(temp, False)
            raise ConflictError(f"version {n} was committed by another writer")
        return n

    def _write(self, tables: dict[str, DataFrame], dropped: DataFrame | None, keep: list[dict] | None = None) -> int:
        n = self.version + 1
        before = self._commit_file(n - 1)["segments"] if n > 1 else []
        segment = {"id": f"{n:012d}-{uuid.uuid4().hex}", "tables": []}
        for name, df in [*tables.items(), *([("dropped", dropped)] if dropped is not None else [])]:
            key = schema.OWNER.get(name, "doc_id")
            # rows of a document lie together, so that lookups by doc_id skip row groups
            df.withColumn("_commit", F.lit(n).cast("long")).sortWithinPartitions(key).write.parquet(f"{self.path}/segments/{segment['id']}/{name}")
            segment["tables"].append(name)
        return self._publish(n, [*(before if keep is None else keep), segment])

    # writes

    def ingest(self, docs: DataFrame, on_error: str = "raise") -> int:
        """Parses (path, content) rows and replaces the documents at their
        paths; the new version. Of rows that repeat a path the one of greatest
        content counts. Invalid frontmatter raises ParseError, or with
        ``on_error="skip"`` leaves that document as it was. ``created_at`` stays
        and ``version`` rises where a document is replaced."""
        one = docs.where("path is not null").groupBy("path").agg(F.max(F.coalesce("content", F.lit(""))).alias("content"))
        stage = f"{self.path}/staging/{uuid.uuid4().hex}"
        P.parse(one).write.parquet(stage)
        try:
            parsed = self.spark.read.schema(P.PARSED).parquet(stage)
            bad = parsed.where("error is not null").select("path", "error").first() if on_error == "raise" else None
            if bad:
                raise ParseError(f"{bad['path']}: {bad['error']}")
            rows = {name: df.select(*schema.TABLES[name].names) for name, df in P.tables(parsed).items()}
            old = self.snapshot().documents.select("doc_id", F.col("created_at").alias("_was"), F.col("version").alias("_had"))
            new = rows["documents"].join(old, "doc_id", "left")
            rows["documents"] = new.withColumns({"created_at": F.coalesce("_was", "created_at"), "version": F.coalesce(F.col("_had") + 1, "version")}).select(*schema.DOCUMENTS.names)
            return self._write(rows, rows["documents"].select("doc_id"))
        finally:
            self._fs.delete(self._jpath(stage), True)

    def upsert(self, name: str, rows: DataFrame) -> int:
        """Inserts rows of one table, replacing those of equal identifier."""
        kind, key = schema.TABLES[name], schema.TABLES[name].names[0]
        new = rows.select(*(F.col(f.name).cast(f.dataType) for f in kind)).dropDuplicates([key])
        owner = schema.OWNER[name]
        if name == "documents":
            return self._write_part({name: new}, new.select("doc_id"), only=name)
        touched = new.select(F.col(owner).alias("_o")).distinct()
        old = self.snapshot().table(name)
        stay = old.join(touched, old[owner] == touched["_o"], "left_semi").join(new.select(F.col(key).alias("_k")), F.col(key) == F.col("_k"), "left_anti")
        return self._write_part({name: stay.unionByName(new)}, touched.select(F.col("_o").alias("doc_id")), only=name)

    def _write_part(self, tables: dict[str, DataFrame], owners: DataFrame, only: str) -> int:
        """Replaces the rows of some documents in one table; those of the other
        tables are carried over, as a commit drops a document everywhere."""
        now = self.snapshot()
        owners = owners.distinct()
        for name in schema.TABLES:
            if name != only:
                rows = now.table(name)
                tables[name] = rows.join(owners.select(F.col("doc_id").alias("_o")), rows[schema.OWNER[name]] == F.col("_o"), "left_semi")
        return self._write(tables, owners)

    def delete(self, doc_ids: list[str] | DataFrame) -> int:
        """Deletes documents with their blocks, outgoing links and tags; links
        of others to them stay, unknown identifiers do nothing."""
        ids = doc_ids if isinstance(doc_ids, DataFrame) else self.spark.createDataFrame([(x,) for x in doc_ids], "doc_id string")
        return self._write({}, ids.select("doc_id").distinct())

    def delete_by_path(self, path: str) -> int:
        found = self.snapshot().documents.where(F.col("path") == path).select("doc_id")
        if found.isEmpty():
            raise NotFoundError(path)
        return self._write({}, found)

    def compact(self) -> int:
        """Folds all segments into one; older versions stay readable."""
        now = self.snapshot()
        return self._write({name: now.table(name) for name in schema.TABLES}, None, keep=[])


def cascade(tables: dict[str, DataFrame], doc_ids: DataFrame) -> dict[str, DataFrame]:
    """The four tables without some documents."""
    ids = doc_ids.select(F.col("doc_id").alias("_gone"))
    return {name: df.join(ids, df[schema.OWNER[name]] == ids["_gone"], "left_anti") for name, df in tables.items()}


def replace_by_path(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Old rows of the documents at the new rows' paths give way to these."""
    at = new["documents"].select("path")
    old = tables["documents"].join(at, "path", "left_semi").select("doc_id")
    kept = cascade(tables, old)
    return {name: kept[name].unionByName(new[name]) for name in tables}
