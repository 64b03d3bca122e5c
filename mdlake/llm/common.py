"""What the operators of this subpackage share: reading tables, the shared
folder in which lineage is cut, and columns of any name."""

from __future__ import annotations

import pickle
import uuid
from typing import Any, Callable, Iterator

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from ..operators import shared

#: Rows of an Arrow batch. Texts are long, so the default of 10,000 rows would
#: make batches of tens of megabytes.
BATCH_ROWS = 1000

shared_dir, scratch, remove = shared.folder, shared.scratch, shared.remove


def prepare(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder, see ``shared.written``."""
    return shared.written(df, name, compression="zstd")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def fetched(df: DataFrame) -> pa.Table:
    """A small ``written`` table, read by this process from its files."""
    parts = []
    for path in df.inputFiles():
        files, at = opened(path)
        parts.append(pq.read_table(at, filesystem=files))
    return pa.concat_tables(parts) if parts else df.toArrow()


class Shipped:
    """A value of bounded size as a file in the shared folder, which a worker
    reads once: unlike a broadcast it takes no room in the driver's JVM."""

    _last: dict[str, Any] = {}

    def __init__(self, spark: SparkSession, value: Any, name: str):
        self.path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        files, at = opened(self.path)
        with files.open_output_stream(at) as out:
            pickle.dump(value, out, protocol=5)
        shared.note(self.path)

    @property
    def value(self) -> Any:
        if self.path not in Shipped._last:
            Shipped._last.clear()
            files, at = opened(self.path)
            with files.open_input_stream(at) as source:
                Shipped._last[self.path] = pickle.load(source)
        return Shipped._last[self.path]


def placed(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with its columns renamed by their places: ``columns``, found by
    exact name (the first of equals), keep their names, and all others get names
    that nothing else has. So the names of other columns don't matter, whether
    they are reserved elsewhere, hold dots, or differ in case alone."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"missing columns: {', '.join(lacking)}")
    names = [f"__place_{i}" for i in range(len(df.columns))]
    for c in columns:
        names[df.columns.index(c)] = c
    return df.toDF(*names)


def require(df: DataFrame, *columns: str) -> DataFrame:
    """Only these columns, see ``placed``."""
    return placed(df, *columns).select(*columns)


def through(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *columns: str) -> DataFrame:
    """Rows of ``df``, with all their columns, that ``run`` lets through; it
    finds ``columns`` by name."""
    inner = placed(df, *columns)
    return inner.mapInArrow(run, inner.schema).toDF(*df.columns)
