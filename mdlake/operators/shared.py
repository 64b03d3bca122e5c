"""The folder that all executors share, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar
from typing import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession

_noted: ContextVar[list[str] | None] = ContextVar("noted", default=None)


def folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where that is unset a local
    master, as in tests on one machine, gets a temporary folder; on a cluster
    that is an error, as executors couldn't reach it."""
    sc = spark.sparkContext
    have = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not have and not sc.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    have = have or "file://" + tempfile.mkdtemp(prefix="mdlake-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(have)
    return have.rstrip("/")


def written(df: DataFrame, name: str, **options: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts lineage, outlives the loss
    of executors, and is computed once however often it is read."""
    path = f"{folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    note(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(scan: DataFrame) -> DataFrame:
    """A scan over at least as many partitions as there are cores, so that work
    on its rows isn't done by one task where a file has a single row group; a
    table of many files or groups stays as it is and isn't shuffled."""
    cores = scan.sparkSession.sparkContext.defaultParallelism
    return scan if scan._jdf.queryExecution().toRdd().getNumPartitions() >= cores else scan.repartition(cores)


def note(path: str) -> None:
    """Adds a path in the shared folder to those of the block around."""
    if (noted := _noted.get()) is not None:
        noted.append(path)


@contextmanager
def scratch() -> Iterator[list[str]]:
    """The paths of the tables that are ``written`` inside of the block, in
    order, for the caller to remove those that nothing reads any more. A block
    around it gets them, too, removed or not."""
    paths: list[str] = []
    token = _noted.set(paths)
    try:
        yield paths
    finally:
        _noted.reset(token)
        if (outer := _noted.get()) is not None:
            outer += paths


def remove(spark: SparkSession, paths: Iterable[str]) -> None:
    """Deletes folders, or files, in the shared folder."""
    jvm = spark.sparkContext._jvm
    for x in paths:
        path = jvm.org.apache.hadoop.fs.Path(x)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
