import os

import pytest

import __spark_entry__ as entry

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="needs the driver's tables")
def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns == ["dt", "value"] and df.count() > 0


def test_oracles_are_of_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
