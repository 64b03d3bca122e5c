from types import SimpleNamespace

import pytest

from mdlake.operators import shared


def test_a_cluster_needs_a_shared_folder():
    conf = SimpleNamespace(get=lambda _: None)
    sc = SimpleNamespace(getConf=lambda: conf, getCheckpointDir=lambda: None, master="spark://host:7077")
    with pytest.raises(ValueError, match="checkpoint.dir"):
        shared.folder(SimpleNamespace(sparkContext=sc))


def test_tables_are_noted_and_removed(spark):
    with shared.scratch() as paths:
        df = shared.written(spark.range(3), "x")
        with shared.scratch() as inner:
            shared.written(spark.range(2), "y")
    assert len(paths) == 2 and paths[1:] == inner and df.count() == 3
    shared.remove(spark, paths)
    assert not any(spark.sparkContext._jvm.java.io.File(p.removeprefix("file://")).exists() for p in paths)
