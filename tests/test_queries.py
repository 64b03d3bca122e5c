import pytest

import __spark_entry__ as entry
from mdlake.plans import catalog

from .oracle import both

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", list(catalog.QUERIES))
def test_query(spark, name):
    if name not in catalog.ORACLE:
        assert catalog.QUERIES[name](spark, DIR).count() >= 0
        return
    ours, theirs = both(spark, DIR, catalog.QUERIES[name], catalog.ORACLE[name])
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
