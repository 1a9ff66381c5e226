"""Every registered query next to its oracle SQL on the smallest tables."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from tools.compare import canonical, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(entry.queries()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = [tuple(row) for row in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    cursor = duck.execute(sql)
    want = canonical([d[0] for d in cursor.description], cursor.fetchall())
    assert canonical(df.columns, got) == want


def test_entry_is_stable(spark):
    df = entry.entry(spark)
    assert df.columns[0] == "batch_id" and df.count() > 0
